"""Lexicons: small, ordered configuration that the driver reads and that plans hold as literals."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path


class LexiconError(ValueError):
    """A lexicon file has not the shape that its loader needs."""


def _load(path: str | Path, *keys: str) -> dict:
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8"))
    except json.JSONDecodeError as e:
        raise LexiconError(f"{path}: {e}") from e
    if not isinstance(found, dict):
        raise LexiconError(f"{path}: not an object")
    if missing := [k for k in keys if k not in found]:
        raise LexiconError(f"{path}: lacks {', '.join(missing)}")
    return found


def _regexes(patterns: Iterable[str], where: str) -> tuple[str, ...]:
    for p in patterns:
        try:
            re.compile(p)
        except re.error as e:
            raise LexiconError(f"{where}: {p}: {e}") from e
    return tuple(patterns)


@dataclass(frozen=True)
class Singular:
    irregular: dict[str, str] = field(default_factory=dict)
    unchanged: frozenset[str] = frozenset()

    @classmethod
    def load(cls, path: str | Path) -> Singular:
        found = _load(path, "irregular", "no_singularize")
        return cls(dict(found["irregular"]), frozenset(found["no_singularize"]))


#: Modes of conditional tokens; fixed values.
MODES = ("strip_when_next_in", "keep_when_next_in", "strip_when_head_in")


@dataclass(frozen=True)
class Modifiers:
    phrases: tuple[str, ...] = ()
    tokens: frozenset[str] = frozenset()
    never: frozenset[str] = frozenset()
    protected: frozenset[str] = frozenset()
    guards: dict[str, tuple[str, frozenset[str]]] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str | Path) -> Modifiers:
        found = _load(path, "strip_phrases", "strip_tokens", "conditional_tokens", "never_strip_tokens", "protected_strings")
        guards = {t: (g["mode"], frozenset(g["values"])) for t, g in found["conditional_tokens"].items()}
        if unknown := [t for t, (mode, _) in guards.items() if mode not in MODES]:
            raise LexiconError(f"{path}: unknown mode of {', '.join(unknown)}")
        return cls(_regexes(found["strip_phrases"], str(path)), frozenset(found["strip_tokens"]), frozenset(found["never_strip_tokens"]), frozenset(found["protected_strings"]), guards)


@dataclass(frozen=True)
class Brands:
    """Ordered (pattern, generic) rules; those that keep an item come first."""

    keep: tuple[tuple[str, str], ...] = ()
    patterns: tuple[tuple[str, str], ...] = ()

    @property
    def rules(self) -> tuple[tuple[str, str], ...]:
        return (*self.keep, *self.patterns)

    @classmethod
    def load(cls, path: str | Path) -> Brands:
        found = _load(path, "keep_as_ingredient", "patterns")
        sections = []
        for key in ("keep_as_ingredient", "patterns"):
            rows = [(r["pattern"], r["generic"]) for r in found[key]]
            if any(p != p.lower() or not g.strip() for p, g in rows):
                raise LexiconError(f"{path}: patterns are lower-case and generics not blank")
            _regexes([p for p, _ in rows], str(path))
            sections.append(tuple(rows))
        return cls(*sections)


@dataclass(frozen=True)
class Gate:
    always_merge: tuple[str, ...] = ()
    forced: frozenset[str] = frozenset()
    varieties: frozenset[str] = frozenset()
    never_merge: frozenset[str] = frozenset()

    @classmethod
    def load(cls, always: str | Path, forced: str | Path, varieties: str | Path, never: str | Path) -> Gate:
        get = lambda p, key, name: [r[name] for r in _load(p, key)[key]]
        return cls(_regexes(get(always, "patterns", "pattern"), str(always)), frozenset(get(forced, "overrides", "variant")), frozenset(get(varieties, "varieties", "phrase")), frozenset(get(never, "exceptions", "variant")))


def load_flat_map(path: str | Path) -> dict[str, str]:
    """A map of non-blank strings; keys that begin with _ are comments. Serves manual aliases and label families."""
    whole = _load(path)
    found = {k: v for k, v in whole.get("families", whole).items() if not k.startswith("_")}
    if any(not isinstance(v, str) or not v.strip() for v in found.values()):
        raise LexiconError(f"{path}: values are non-blank strings")
    return found


def load_tokens(path: str | Path) -> frozenset[str]:
    return frozenset(_load(path, "tokens")["tokens"])


@dataclass(frozen=True)
class Lexicons:
    """All lexicons of a vocabulary build."""

    singular: Singular = Singular()
    modifiers: Modifiers = Modifiers()
    brands: Brands = Brands()
    gate: Gate = Gate()
    aliases: dict[str, str] = field(default_factory=dict)
    variant_tokens: frozenset[str] = frozenset()
    families: dict[str, str] = field(default_factory=dict)

    @classmethod
    def load(cls, folder: str | Path) -> Lexicons:
        at = Path(folder)
        return cls(
            Singular.load(at / "singularize_exceptions.json"),
            Modifiers.load(at / "modifier_strip.json"),
            Brands.load(at / "brand_patterns.json"),
            Gate.load(at / "always_merge_patterns.json", at / "forced_merge_overrides.json", at / "named_varieties.json", at / "do_not_merge.json"),
            load_flat_map(at / "manual_aliases.json"),
            load_tokens(at / "variant_modifier_tokens.json"),
            load_flat_map(at / "cuisine_families.json"),
        )
