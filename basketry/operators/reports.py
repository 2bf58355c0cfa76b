"""Small reports, rendered on the driver from aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.sinks import canonical_json, markdown_table, write_text_atomically

#: Unresolved strings of a report, digits of a digest, and what stands for a similarity that isn't known; fixed values.
UNRESOLVED, DIGEST, MISSING = 20, 12, "—"


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def percentage(share: float) -> str:
    return f"{100 * share:.2f}%"


def coverage_payload(statistics: dict[str, DataFrame], summaries: dict[str, DataFrame], vocabulary: DataFrame, sources: DataFrame, histogram: DataFrame, unresolved: DataFrame, build: dict) -> dict:
    """The coverage report's figures: by split the methods and both coverages, the vocabulary's sizes, and the strings
    that nothing resolved. All frames are aggregates of a few rows."""
    return {
        "build": dict(build),
        "resolution": {split: {**_rows(summaries[split])[0], "by_method": {r["method"]: {"count": r["mentions"], "percentage": r["share"]} for r in _rows(stats)}} for split, stats in statistics.items()},
        "vocabulary": {**_rows(vocabulary)[0], "aliases_by_source": {r["source"]: r["aliases"] for r in _rows(sources)}, "merge_group_size_histogram": {r["bucket"]: r["groups"] for r in _rows(histogram)}},
        "top_unresolved": [{"string": r["item"], "count": r["mentions"]} for r in _rows(unresolved)],
    }


def coverage_report(payload: dict) -> str:
    """Markdown of a coverage payload."""
    out = ["# Coverage Report\n", "## Build\n", *(f"- {k}: `{str(v)[:DIGEST]}`" for k, v in sorted(payload["build"].items())), ""]
    for split, x in payload["resolution"].items():
        rows = [{"Method": m, "Count": r["count"], "%": percentage(r["percentage"])} for m, r in x["by_method"].items()]
        out += [f"## Resolution ({split})\n", f"- Mentions total: {x['mentions_total']}", f"- Alias tier coverage: {percentage(x['alias_tier_coverage'])}", f"- Full chain coverage: {percentage(x['full_chain_coverage'])}\n", markdown_table(rows, ["Method", "Count", "%"])]
    v = payload["vocabulary"]
    out += ["## Vocabulary\n", f"- Ingredients: {v['ingredient_count']}", f"- Aliases: {v['alias_count']}", f"- Preserved variants: {v['preserved_variant_count']}\n"]
    for title, key, column in (("Aliases by source", "aliases_by_source", "Source"), ("Merge group size histogram", "merge_group_size_histogram", "Aliases")):
        out += [f"### {title}\n", markdown_table([{column: k, "Count": n} for k, n in v[key].items()], [column, "Count"])]
    lost = [f"- {r['string']} ({r['count']})" for r in payload["top_unresolved"][:UNRESOLVED]]
    return "\n".join([*out, f"## Top unresolved (first {UNRESOLVED})\n", *(lost or ["No unresolved strings."])]) + "\n"


def fold_balance_report(balance: DataFrame) -> str:
    rows = _rows(balance.orderBy("label"))
    sizes = [sum(r[c] for r in rows) for c in balance.columns if c != "label"]
    return "# Folds\n\n" + f"- Fold sizes: {', '.join(map(str, sizes))}\n\n" + markdown_table(rows, balance.columns)


def evaluation_report(evaluation: dict, configuration: dict, calibration: dict, baseline: dict, grid: list[tuple[float, float, float]]) -> str:
    """Markdown of an evaluation's frames with its configuration, calibration figures, baseline and grid."""
    mean = _rows(evaluation["mean"])[0]
    folds = [*_rows(evaluation["folds"].orderBy("fold")), {"fold": "mean", **mean}]
    loss = next((round(x, 6) for x, c, w in grid if (c, w) == (configuration["c"], configuration["parent_weight"])), MISSING)
    models = [{"model": "logistic regression", "loss": loss, "accuracy": mean["accuracy"], "macro_f1": mean["macro_f1"]}, {"model": "naive bayes", "loss": baseline["pooled_oof_log_loss"], "accuracy": baseline["mean_accuracy"], "macro_f1": baseline["mean_macro_f1"]}]
    pairs = [{**r, "similarity": MISSING if r.get("similarity") is None else r["similarity"]} for r in _rows(evaluation["confusion_pairs"])]
    out = ["# Model evaluation\n", f"- Configuration: C={configuration['c']}, parent_weight={configuration['parent_weight']}", f"- Temperature: {calibration['temperature']}", f"- ECE before -> after calibration: {calibration['ece_before']} -> {calibration['ece_after']}\n"]
    out += ["## Cross-validation (per fold)\n", markdown_table(folds, ["fold", "accuracy", "macro_f1", "log_loss"]), "## Baseline comparison\n", markdown_table(models, ["model", "loss", "accuracy", "macro_f1"])]
    out += ["## Recall by label\n", markdown_table(_rows(evaluation["per_label"].orderBy("label")), ["label", "basket_count", "recall"])]
    return "\n".join([*out, "## Top confusion pairs\n", markdown_table(pairs, ["truth", "predicted", "n", "similarity"])])


def write_report(path: str, text: str, payload: dict | None = None) -> None:
    write_text_atomically(f"{path}.md", text)
    if payload is not None:
        write_text_atomically(f"{path}.json", canonical_json(payload))
