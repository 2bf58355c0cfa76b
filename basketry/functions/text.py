"""The cleaning chain and keys, as functions from Column to Column. The order of the chain is part of its meaning."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .lexicon import Brands, Modifiers, Singular

# Marks, quotes and punctuation that the chain deletes or folds, and the quantities that it drops.
TRADEMARKS = "®™©"
QUOTES = "’‘"
PUNCTUATION = "-,.()!/"
PARENTHESISED_QUANTITY = r"\(\s*[\d./\s]*oz\.?\s*\)"
LEADING_QUANTITY = r"^\s*\d[\d\s./-]*(?:to\s+\d[\d\s./-]*)?(?:pounds|pound|lbs|lb|ounces|ounce|ounc|oz|inches|inch)\b\.?\s*"


@F.pandas_udf(StringType())
def _repair(texts: pd.Series) -> pd.Series:
    def one(text):
        try:
            return text.encode("cp1252").decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            return text

    return texts.map(one, na_action="ignore")


@F.pandas_udf(StringType())
def _casefold(texts: pd.Series) -> pd.Series:
    return texts.str.casefold()


@F.pandas_udf(StringType())
def _fold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)), na_action="ignore")


def repair_mojibake(text: Column, on: bool = True) -> Column:
    """UTF-8 once read as Windows-1252; strict, so only rows that carry its marks and survive the round trip change."""
    return F.when(text.rlike("â€|Ã"), _repair(text)).otherwise(text) if on else text


def fold_accents(text: Column, on: bool = True) -> Column:
    """Compatibility decomposition without combining marks; only texts beyond ASCII leave the JVM."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _fold(text)).otherwise(text) if on else text


def strip_trademarks(text: Column) -> Column:
    return F.translate(text, TRADEMARKS, "")


def casefold(text: Column, on: bool = True) -> Column:
    """Full case folding; only texts beyond ASCII leave the JVM. on=False folds lower case and ß alone."""
    plain = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    return F.when(text.rlike(r"[^\x00-\x7F]"), _casefold(text)).otherwise(plain) if on else plain


def normalize_quotes(text: Column) -> Column:
    return F.translate(text, QUOTES, "''")


def strip_quantities(text: Column) -> Column:
    """Without parenthesised ounces, wherever they stand, and without one leading quantity with its unit."""
    return F.regexp_replace(F.regexp_replace(text, f"(?U){PARENTHESISED_QUANTITY}", " "), f"(?U){LEADING_QUANTITY}", "")


def ampersand_to_and(text: Column) -> Column:
    return F.replace(text, F.lit("&"), F.lit(" and "))


def delete_apostrophes(text: Column) -> Column:
    return F.translate(text, "'", "")


def punctuation_to_space(text: Column) -> Column:
    return F.translate(text, PUNCTUATION, " " * len(PUNCTUATION))


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clean(text: Column, python: bool = True) -> Column:
    """The whole chain; null where no letter is left. python=False keeps to the JVM: without repair and accents, and with
    the plain case folding."""
    out = casefold(strip_trademarks(repair_mojibake(text, python)), python)
    out = fold_accents(strip_quantities(normalize_quotes(out)), python)
    out = collapse_whitespace(punctuation_to_space(delete_apostrophes(ampersand_to_and(out))))
    return F.when(out.rlike(r"\p{L}"), out)


def singular_token(token: Column, lexicon: Singular = Singular()) -> Column:
    n = F.length(token)
    ends = lambda *s: F.lit(False) if not s else token.rlike(f"(?:{'|'.join(s)})$")
    out = F.when((n >= 5) & ends("ies"), F.concat(token.substr(F.lit(1), n - 3), F.lit("y")))
    out = out.when((n >= 5) & ends("ves"), token.substr(F.lit(1), n - 1))
    out = out.when((n >= 5) & ends("ches", "shes", "sses", "xes", "zes"), token.substr(F.lit(1), n - 2))
    out = out.when((n >= 4) & ends("s") & ~ends("ss", "us", "is"), token.substr(F.lit(1), n - 1)).otherwise(token)
    if lexicon.irregular:
        known = F.create_map(*(F.lit(x) for kv in sorted(lexicon.irregular.items()) for x in kv))
        out = F.coalesce(F.try_element_at(known, token), out)
    return F.when(token.isin(sorted(lexicon.unchanged)), token).otherwise(out) if lexicon.unchanged else out


def lookup_key(cleaned: Column, lexicon: Singular = Singular()) -> Column:
    return F.array_join(F.transform(F.split(cleaned, " "), lambda t: singular_token(t, lexicon)), " ")


def strip_modifiers(cleaned: Column, lexicon: Modifiers) -> Column:
    """Drops phrases, then tokens; what would be empty stays as it was, protected strings too.

    Guards are judged from left to right, each against the tokens that the ones before left: state is (kept, head)."""
    out = cleaned
    for p in lexicon.phrases:
        out = F.regexp_replace(out, p, " ")
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    tokens = F.split(out, " ")
    droppable = sorted(lexicon.tokens - lexicon.never - set(lexicon.guards))
    plain = F.filter(F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: ~x["t"].isin(droppable)) if droppable else F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    if lexicon.guards:

        def judge(left, x):
            others = F.filter(left, lambda y: y["i"] != x["i"])
            head = F.coalesce(F.try_element_at(others, F.lit(-1))["t"], F.lit(""))
            following = F.coalesce(F.get(tokens, x["i"] + 1), F.lit(""))
            drop = F.lit(False)
            for token, (mode, values) in sorted(lexicon.guards.items()):
                value = head if mode == "strip_when_head_in" else following
                hit = value.isin(sorted(values))
                drop = drop | ((x["t"] == token) & (~hit if mode == "keep_when_next_in" else hit))
            return F.when(drop, others).otherwise(left)

        plain = F.aggregate(plain, plain, judge)
    joined = F.array_join(F.transform(plain, lambda x: x["t"]), " ")
    stripped = F.when(joined == "", cleaned).otherwise(joined)
    return F.when(cleaned.isin(sorted(lexicon.protected)), cleaned).otherwise(stripped) if lexicon.protected else stripped


def brand_generic(cleaned: Column, lexicon: Brands) -> Column:
    """The generic name of the first rule that matches anywhere; null if none does or the text has other characters."""
    if not lexicon.rules:
        return F.lit(None).cast("string")
    first = F.coalesce(*(F.when(cleaned.rlike(p), F.lit(g)) for p, g in lexicon.rules))
    return F.when(cleaned.rlike("^[a-z0-9% ]+$"), first)


def slug(name: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(name, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(out.rlike("^[a-z0-9][a-z0-9_]*$"), out)


def decision_id(variant: Column, base: Column) -> Column:
    return F.concat(F.translate(variant, " ", "_"), F.lit("__vs__"), F.translate(base, " ", "_"))


def display_name(identifier: Column, overrides: dict[str, str] | None = None) -> Column:
    shown = F.initcap(F.translate(identifier, "_", " "))
    if not overrides:
        return shown
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in sorted(overrides.items()) for x in kv)), identifier), shown)


def split_arguments(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def percentage(share: Column, digits: int = 2) -> Column:
    return F.concat(F.format_string(f"%.{digits}f", share * 100), F.lit("%"))


def count(value: Column) -> Column:
    """Whole numbers with a comma at each thousand."""
    return F.format_number(value, 0)


def signed(value: Column, digits: int = 2) -> Column:
    return F.format_string(f"%+.{digits}f", value)
