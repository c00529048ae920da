from pyspark.sql import functions as F

from varietylens.operators.standardize import standardize
from varietylens.operators.windows import carry_forward, speaker_carry

COLS = "id long, dialect_city_id string, dialect_province_id string, dialect_country_id string, dialect_region_id string"


def gaz(spark):
    rows = [("city", "cairo", ["cai", "cairo_p", "eg", "nile_basin"]),
            ("city", "alexandria", ["alx", "alex_p", "eg", "nile_basin"]),
            ("city", "tunis", ["tun"]),
            ("country", "egypt", ["eg", "nile_basin"]),
            ("country", "syria", ["sy", "levant"]),
            ("country", "levantine", ["levant", "levant"]),
            ("country", "tunisia", ["tn", "maghreb", "x"]),
            ("region", "gulf", ["gulf"]),
            ("region", "egyptian", ["eg"]),
            ("region", "iraqi", ["iraq"])]
    return spark.createDataFrame(rows, "level string, raw string, parts array<string>")


def run(spark, rows, levels):
    df = spark.createDataFrame(rows, COLS)
    return {r["id"]: tuple(r)[1:] for r in standardize(df, "id", gaz(spark), levels).collect()}


def test_city_rules(spark):
    got = run(spark, [(1, " Cairo , alexandria", None, None, None),
                      (2, "cairo,atlantis", None, None, None),
                      (3, "Tunis", None, "tn", None),
                      (4, "", None, None, None)], ["city"])
    assert got[1] == ("cai,alx", "cairo_p", "eg", "nile_basin")
    assert got[2] == ("cairo,atlantis", None, None, None)        # unknown element: unchanged
    assert got[3] == ("tun", None, "tn", None)                   # arity 1: ancestors kept
    assert got[4] == ("", None, None, None)


def test_country_rules(spark):
    got = run(spark, [(1, None, None, "Egypt, syria", None),
                      (2, None, None, "levantine", "x"),
                      (3, None, None, "tunisia", "r"),
                      (4, None, None, "egypt,nowhere", "r")], ["country"])
    assert got[1][2:] == ("eg,sy", "nile_basin")
    assert got[2][2:] == ("", "levant")                           # pseudo-country
    assert got[3][2:] == ("tn", "r")                              # 3 parts: region not set
    assert got[4][2:] == ("egypt,nowhere", "r")


def test_region_rules(spark):
    got = run(spark, [(1, None, None, "xx", "Egyptian, gulf"),
                      (2, None, None, "xx", "IRAQI"),
                      (3, None, None, "xx", "Gulf"),
                      (4, None, None, "xx", "Mars")], ["region"])
    assert got[1][2:] == ("eg", "nile_basin")
    assert got[2][2:] == ("iq", "gulf")
    assert got[3][2:] == ("xx", "gulf")
    assert got[4][2:] == ("xx", "Mars")                           # unknown: original case kept


def test_two_level_carry_equals_window(spark):
    rows = []
    for f in range(3):
        for i in range(0, 500, 3):
            mark = "A" if i % 37 == 0 else ("B" if i % 53 == 0 else None)
            rows.append((f, i, mark))
    df = spark.createDataFrame(rows, "f long, i long, m string")
    a = carry_forward(df, ["f"], "i", F.col("m"), "o", block=None, default="A")
    b = carry_forward(df, ["f"], "i", F.col("m"), "o", block=16, default="A")
    assert sorted(a.collect()) == sorted(b.collect())


def test_speaker_carry(spark):
    lines = spark.createDataFrame([("f", 0, "hello"), ("f", 1, "B: hi"), ("f", 2, "more"),
                                   ("f", 3, "A: back")], "file string, line_no long, text string")
    got = [(r["speaker"], r["text"]) for r in
           speaker_carry(lines, "file", "line_no", "text", block=2).orderBy("line_no").collect()]
    assert got == [("A", "hello"), ("B", " hi"), ("B", "more"), ("A", " back")]


def test_two_level_running_sums_and_lead(spark):
    from varietylens.operators.windows import lead_marker, running_sums
    rows = [(f, i, "m: x" if (i * 7 + f) % 5 < 3 else "plain") for f in range(2) for i in range(0, 300, 2)]
    df = spark.createDataFrame(rows, "f long, i long, t string")
    vals = {"s": F.col("t").startswith("m").cast("int")}
    a = running_sums(df, ["f"], "i", vals, block=None)
    b = running_sums(df, ["f"], "i", vals, block=16)
    assert sorted(a.collect()) == sorted(b.collect())
    la = lead_marker(df, ["f"], "i", "t", ": ", block=None)
    lb = lead_marker(df, ["f"], "i", "t", ": ", block=16)
    assert sorted(la.collect()) == sorted(lb.collect()) and la.count() > 0


def test_dedupe_with_repeated_order_keys(spark):
    from varietylens.operators.clean import dedupe_keep_first
    df = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y"), (1, "z"), (3, None), (4, None)], "id long, t string")
    got = [tuple(r) for r in dedupe_keep_first(df, "t", "id").collect()]
    assert len(got) == 4 and set(got) == {(1, "x"), (2, "y"), (1, "z"), (3, None)}
