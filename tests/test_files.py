"""Readers and sinks on files: charsets, split files, balanced output, ranges,
recorded lookups, packed lists, standardising distinct label tuples."""
import glob
import os

import pytest
from pyspark.sql import functions as F

from varietylens.functions.text import number_or_nil, packed_best
from varietylens.operators.joins import lookup_recorded
from varietylens.operators.standardize import COLS, standardize, standardize_level, standardize_region_first
from varietylens.sources import readers, sinks


@pytest.mark.parametrize("charset", ["iso8859_6", "cp1256", "latin1", "ascii", "utf-8"])
def test_bytes_are_decoded_as_the_codec_does(spark, charset):
    raw = [bytes(range(256)), "مرحبا بكم".encode("cp1256"), "مرحبا".encode("iso8859_6"), "naïve café 漢字".encode(), b"", b"abc \xff\xfe x"]
    df = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(raw)], "i int, raw binary")
    got = {r["i"]: r["t"] for r in df.select("i", readers.decode_bytes(F.col("raw"), charset).alias("t")).collect()}
    assert got == {i: r.decode(charset, errors="ignore") for i, r in enumerate(raw)}


def test_lines_of_split_files_keep_their_numbers(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 50) if i % 7 else "" for i in range(4000)]
    lines[100] = "caf\xe9 here"
    (tmp_path / "a.txt").write_bytes("\n".join(lines).encode("latin1"))
    (tmp_path / "b.txt").write_bytes(b"one\n\ntwo\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = readers.read_ordered_lines_split(spark, str(tmp_path), charset="ascii")
        assert spark.read.text(str(tmp_path / "a.txt")).rdd.getNumPartitions() > 5  # one file, several tasks
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    a = {r["line_no"]: r["text"] for r in rows if r["file"].endswith("a.txt")}
    assert a == {i: t.encode("ascii", "ignore").decode() for i, t in enumerate(lines) if t}
    assert {r["line_no"]: r["text"] for r in rows if r["file"].endswith("b.txt")} == {0: "one", 2: "two"}
    assert sum(r["dropped"] for r in rows) == 1


def test_files_follow_rows_not_tasks_times_labels(spark, tmp_path):
    rows = [("hot" if i % 10 else f"rare{i % 4}", f"sentence {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "label string, t string").repartition(16)
    path = str(tmp_path / "out")
    sinks.write_partitioned_corpus(df, path, ["label"], "t", rows_per_file=1000)
    files = {d: len(glob.glob(f"{path}/{d}/*.txt")) for d in os.listdir(path) if d.startswith("label=")}
    assert files.pop("label=hot") in (3, 4) and set(files.values()) == {1}  # 2,700 rows, 1,000 a file
    back = spark.read.text(path)
    assert sorted((r["label"], r["value"]) for r in back.collect()) == sorted(rows)


def test_numbers_of_file_names_and_their_ranges(spark):
    names = ["/x/17.txt", "/x/n=5/part-0000-a.csv", "/x/Gumar_00093.doc.txt", "/x/none.txt", "/x/88"]
    df = spark.createDataFrame([(n,) for n in names], "file string").withColumn("n", readers.number_in_name(F.col("file")))
    assert [r["n"] for r in df.orderBy("file").collect()] == [17, 88, 93, 5, None]
    ranges = spark.createDataFrame([(1, 6, "low"), (17, 18, "one"), (80, 88, "high")], "first long, end long, kind string")
    got = {r["file"]: r["kind"] for r in readers.label_by_range(df, "n", ranges).collect()}
    assert got == {names[0]: "one", names[1]: "low", names[2]: "", names[3]: "", names[4]: ""}


def test_lookup_records_its_misses(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 5) for i in range(20)], "id long, k long")
    side = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c"), (2, None)], "k long, v string")
    found, missed, counts = lookup_recorded(df, side, "k", "v", str(tmp_path / "out"))
    assert counts == {"rows": 20, "missed": 12}
    assert {(r["k"], r["v"]) for r in found.collect()} == {(0, "a"), (1, "c")} and found.count() == 8
    assert {(r["k"], r["v"]) for r in missed.collect()} == {(2, ""), (3, ""), (4, "")} and missed.count() == 12


def test_packed_lists_with_missing_scores(spark):
    df = spark.createDataFrame([("1.5,<NIL>,0.25",), ("<NIL>,-2,-1",), ("-3,0.5,0.5",), ("x,2,1",)], "s string")
    got = [tuple(r) for r in df.select(packed_best("s", "#4 Features a, b,c", "#4 Features ").alias("b")).select("b.*").collect()]
    assert got == [("a", 1.5), ("a", 0.0), ("b", 0.5), ("b", 2.0)]
    assert [r[0] for r in df.select(number_or_nil(F.split("s", ",")[0])).collect()] == [1.5, 0.0, -3.0, None]


def test_standardising_distinct_tuples_equals_row_by_row(spark):
    cols = list(COLS.values())
    gaz = spark.createDataFrame([("city", "cairo", ["cairo", "q", "eg", "nile"]), ("city", "fez", ["fez", "f", "ma", "maghreb"]),
                                 ("country", "eg", ["eg", "nile"]), ("country", "sham", ["levant", "lev"]), ("region", "egypt", ["eg"]),
                                 ("region", "gulf", ["gulf"])], "level string, raw string, parts array<string>")
    rows = [(i, [None, "cairo", "Cairo, fez", "", "unknown"][i % 5], [None, "p"][i % 2], ["eg", "sham", None][i % 3], ["egypt", "gulf", "", None][i % 4])
            for i in range(120)]
    df = spark.createDataFrame(rows, f"id long, {', '.join(c + ' string' for c in cols)}").withColumn("x", F.lit(1))
    levels = ["city", "country", "region"]
    want = df
    for level in levels:
        want = standardize_region_first(want, gaz) if level == "region" else standardize_level(want, gaz, level)
    got = standardize(df, "id", gaz, levels)
    assert got.columns == df.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*df.columns).collect()))
