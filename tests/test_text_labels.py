from pyspark.sql import functions as F

from varietylens.functions import labels as LB
from varietylens.functions import text as T


def one(spark, col, value):
    return spark.createDataFrame([(value,)], "s string").select(col.alias("o")).first()["o"]


def test_word_tokens_split_punctuation(spark):
    assert one(spark, T.word_tokens("s"), "Hello, world! it's 3.5") == "Hello , world ! it ' s 3 . 5"


def test_word_tokens_odd_text(spark):
    """Rows as runs of a pattern, without an array of tokens (odd blanks, marks alone, no text)."""
    texts = [None, "", " \t ", "\u00a0a\u00a0", "a\t\x0bb\r c", "!\u064e!", "..a$0\\1", "e\u0301 \U0001d11e\U0001f600x\u0663", "\x1fa\u2003b\x00", "x_y-z"]
    df = spark.createDataFrame([(t,) for t in texts], "s string").select(
        T.word_tokens("s").alias("got"), F.array_join(F.regexp_extract_all("s", F.lit(T.TOKEN_PATTERN), 1), " ").alias("want"),
        T.strip_marks("s").alias("bare"), F.regexp_replace("s", T.ARABIC_MARKS, "").alias("bare_want"))
    for r in df.collect():
        assert r["got"] == r["want"] and r["bare"] == r["bare_want"]
    assert "regexp_extract_all" not in str(T.word_tokens("s"))


def test_mark_ranges_are_the_marks(spark):
    every = spark.range(0x5f0, 0x700).select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("s"))
    assert every.where(F.col("s").rlike(T.MARK_RANGES) != F.col("s").rlike(T.ARABIC_MARKS)).count() == 0
    assert every.where(F.col("s").rlike(T.MARK_RANGES)).count() == 10


def test_word_tokens_arabic(spark):
    assert one(spark, T.word_tokens("s"), "مرحبا، كيف الحال؟") == "مرحبا ، كيف الحال ؟"


def test_strip_marks_arabic(spark):
    # kasra, shadda, fatha and tatweel removed
    assert one(spark, T.strip_marks("s"), "مُحَمَّـد") == "محمد"


def test_char_stream(spark):
    assert one(spark, T.char_stream("s"), "ab c") == "a b X c"


def test_script_token_filter_arabic(spark):
    assert one(spark, T.script_token_filter("s"), "A: مرحبا hello (كيف)") == "مرحبا"
    assert one(spark, T.script_token_filter("s", extra_chars="A:"), "A: مرحبا hi") == "A: مرحبا"


def test_noise_and_whitespace(spark):
    assert one(spark, T.noise_removal("s", ["tnfs"]), "(abc) tnfs x") == "abc  x"
    assert one(spark, T.whitespace_norm("s"), "  a \t b\n c ") == "a b c"


def test_padded_seg_id(spark):
    assert one(spark, T.padded_seg_id(T.attr_value("s", "id")), '<seg id="7_">') == "007"
    assert one(spark, T.padded_seg_id(T.attr_value("s", "id")), '<seg id="12_345">') == "12_345"


def test_repeat_sentence(spark):
    assert one(spark, T.repeat_sentence("s", 1), "a b") == "a b a b"
    assert one(spark, T.repeat_sentence("s", 0), "a b") == "a b"


def test_label_compose_and_levels(spark):
    df = spark.createDataFrame([("cai", None, "eg", "nile_basin")],
                               "dialect_city_id string, dialect_province_id string, "
                               "dialect_country_id string, dialect_region_id string")
    r = df.select(LB.compose_label("city").alias("c"), LB.compose_label("country").alias("k")).first()
    assert r["c"] == "cai-eg-nile_basin" and r["k"] == "eg-nile_basin"
    df2 = spark.createDataFrame([(None, None, "eg", None)], df.schema)
    assert df2.select(LB.compose_label("city")).first()[0] == "nan-eg-nan"
    lab = spark.createDataFrame([("a-b-c",)], "l string")
    r = lab.select(LB.drop_first_part("l").alias("d"), LB.second_part(LB.drop_first_part("l")).alias("s")).first()
    assert r["d"] == "b-c" and r["s"] == "c"
