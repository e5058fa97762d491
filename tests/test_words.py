import pytest
from pyspark.sql import functions as F

from sparktext.functions import similarity
from sparktext.functions.stemmers import french, porter, stemmed
from sparktext.functions.words import Tokenizer, enriched


def terms(spark, text, **options):
    return spark.createDataFrame([(text,)], "text string").select(Tokenizer(**options).terms(F.col("text")).alias("t")).first().t


@pytest.mark.parametrize(
    "text, options, want",
    [
        ("Hello, wide World!", {}, ["hello", "wide", "world"]), ("a bc d", {}, ["bc"]), ("a bc d", {"keep_single": True}, ["a", "bc", "d"]), ("Café ﬁancé İstanbul", {}, ["cafe", "fiance", "istanbul"]),
        ("Café", {"fold_diacritics": False}, ["café"]), ("the dog's bone", {"possessive": True, "stop_words": ("the",)}, ["the", "dog", "bone"][1:]), ("e-mail co-op", {"joiners": "-"}, ["e-mail", "co-op"]),
        ("3,14 a.b.c don't 日本", {"unicode_words": True, "keep_single": True}, ["3,14", "a.b.c", "don't", "日", "本"]), ("one two three", {"ngram_max": 2}, ["one", "two", "three", "one two", "two three"]),
        ("one", {"ngram_min": 2, "ngram_max": 3}, ["one"]), (None, {}, []), ("", {}, []), ("§ 12 ½", {}, ["12"]),
    ],
)
def test_tokenizer(spark, text, options, want):
    assert terms(spark, text, **options) == want


def test_porter():
    words = "caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci digitizer operator feudalism decisiveness hopefulness formaliti triplicate formative formalize electrical goodness revival allowance inference airliner adjustable defensible irritant replacement adjustment dependent adoption communism activate effective bowdlerize probate rate cease controll roll"
    stems = "caress poni ti caress cat feed agre plaster bled motor sing conflat troubl size hop tan fall hiss fizz fail file happi sky relat condit ration valenc digit oper feudal decis hope formal triplic form formal electr good reviv allow infer airlin adjust defens irrit replac adjust depend adopt commun activ effect bowdler probat rate ceas control roll"
    assert [porter(w) for w in words.split()] == stems.split()
    assert porter("ab") == "ab" and porter("naïve") == "naïve"


def test_french():
    pairs = {"continu": "continu", "continua": "continu", "continuait": "continu", "continuation": "continu", "majestueusement": "majestu", "quand": "quand", "nationalité": "national", "chevaux": "cheval", "fortement": "fort", "aimait": "aim"}
    assert {w: french(w) for w in pairs} == pairs


def test_stems_are_joined_back(spark):
    rows = stemmed(spark.createDataFrame([("running", 1), ("runs", 2), ("running", 3)], "term string, n int")).collect()
    assert sorted((r.term, r.n, r.stem) for r in rows) == [("running", 1, "run"), ("running", 3, "run"), ("runs", 2, "run")]
    custom = stemmed(spark.createDataFrame([("abc",)], "term string"), lambda w: w[0]).first()
    assert custom.stem == "a"


def test_similarity(spark):
    row = spark.range(1).select(
        similarity.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))).alias("j"), similarity.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("e"),
        similarity.dice(F.array(F.lit("a"), F.lit("a")), F.array(F.lit("a"))).alias("d"), similarity.trigram_dice(F.lit("night"), F.lit("nacht")).alias("t"),
        similarity.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("c"), similarity.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("z"),
        similarity.quantized(F.array(F.lit(-2.0), F.lit(1.0), F.lit(0.5))).alias("q"), enriched(F.lit("body"), [F.lit("title"), F.lit(None).cast("string")]).alias("x"),
    ).first()
    assert row.j == pytest.approx(1 / 3) and row.e == 1 and row.d == 1 and row.t == pytest.approx(2 * 3 / 14) and row.c == pytest.approx(2**-0.5) and row.z == 0
    assert row.q == [-127, 64, 32] and row.x == "title body"
