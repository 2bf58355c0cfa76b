import pytest
from pyspark.sql import functions as F

from basketry.functions import text as T
from basketry.functions.lexicon import Brands, LexiconError, Modifiers, Singular, load_flat_map


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("Crème Fraîche", "creme fraiche"), ("(14.5 oz.) Diced Tomatoes", "diced tomatoes"), ("2 lb. Beef", "beef"), ("M&M's®", "m and ms"), ("  half-and-half ", "half and half"), ("1% milk", "1% milk"), ("12", None), ("", None), (None, None), ("Straße", "strasse"), ("cafÃ©", "cafe"), ("2 1/2 to 3 lb. pork", "pork"), ("8 ounc ziti pasta", "ziti pasta"), ("(2 lb.) beef", "2 lb beef"), ("(    oz.) peas", "peas"), ("12 eggs", "12 eggs"), ("pork chops, 1 inch thick", "pork chops 1 inch thick"), ("ﬁne ΟΔΟΣ", "fine οδοσ")],
)
def test_clean(spark, raw, want):
    assert one(spark, raw, T.clean) == want


@pytest.mark.parametrize(("token", "want"), [("berries", "berry"), ("olives", "olive"), ("radishes", "radish"), ("eggs", "egg"), ("glass", "glass"), ("hummus", "hummus"), ("leaves", "leaf"), ("gas", "gas"), ("boxes", "box")])
def test_singular(spark, token, want):
    lexicon = Singular({"leaves": "leaf"}, frozenset({"hummus", "gas"}))
    assert one(spark, token, lambda c: T.singular_token(c, lexicon)) == want


LEX = Modifiers(phrases=(r"\bfat ?free\b", r"\b[12] ?% (?=milk\b)"), tokens=frozenset({"fresh", "chopped", "packed", "sea", "dark"}), never=frozenset({"dark"}), protected=frozenset({"fresh mozzarella"}), guards={"packed": ("keep_when_next_in", frozenset({"in"})), "sea": ("strip_when_head_in", frozenset({"salt"})), "extra": ("strip_when_next_in", frozenset({"large"}))})


@pytest.mark.parametrize(
    ("raw", "want"),
    [("fresh chopped basil", "basil"), ("fresh mozzarella", "fresh mozzarella"), ("fat free milk", "milk"), ("2 % milk", "milk"), ("fresh", "fresh"), ("sea salt", "salt"), ("sea bass", "sea bass"), ("packed in oil", "packed in oil"), ("brown sugar packed", "brown sugar"), ("extra large egg", "large egg"), ("dark rum", "dark rum")],
)
def test_strip(spark, raw, want):
    assert one(spark, raw, lambda c: T.strip_modifiers(c, LEX)) == want


def test_brands_first_match(spark):
    b = Brands(keep=((r"\bmaggi\b", "maggi"),), patterns=((r"\bmaggi\b(?=.*sauce)", "sauce"), (r"\bkraft\b(?=.*cheese)", "cheese"), (r"\bkraft\b", "kraft")))
    got = [one(spark, x, lambda c: T.brand_generic(c, b)) for x in ("maggi sauce", "kraft cheese", "kraft x", "plain", "kraft!")]
    assert got == ["maggi", "cheese", "kraft", None, None]


def test_names(spark):
    assert one(spark, "extra-virgin olive oil!", T.slug) == "extra_virgin_olive_oil"
    assert one(spark, "!!", T.slug) is None
    assert one(spark, "southern_us", lambda c: T.display_name(c, {"southern_us": "Southern US"})) == "Southern US"
    assert one(spark, " a, ,b ", T.split_arguments) == ["a", "b"]


def test_lexicon_errors(tmp_path):
    p = tmp_path / "x.json"
    p.write_text('{"strip_phrases": [], "strip_tokens": [], "conditional_tokens": {"a": {"mode": "odd", "values": []}}, "never_strip_tokens": [], "protected_strings": []}')
    with pytest.raises(LexiconError):
        Modifiers.load(p)
    p.write_text('{"_c": 1, "a": "b"}')
    assert load_flat_map(p) == {"a": "b"}
    p.write_text("[")
    with pytest.raises(LexiconError):
        load_flat_map(p)
