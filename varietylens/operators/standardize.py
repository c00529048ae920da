"""Label standardisation against a caller-supplied gazetteer.

Gazetteer: a table ``(level, raw, parts array<string>)`` where ``raw`` is a
lower-case raw label and ``parts`` its canonical name followed by its
ancestors (city: city, province, country, region; province: province,
country, region; country: country[, region]; region: region).

Rules (levels run in the order given; each reads the previous output; a row
whose cell is NULL/empty, or where a lookup fails, is left unchanged):
  city      every comma element must map; city := comma-join of canonical
            names; if the first element has 4 parts, province, country and
            region := its ancestors
  province  same with 3 parts: country, region := ancestors of the first
  country   every element must map; country := join; if the first element
            has exactly 2 parts, region := its 2nd; if its canonical name is
            the pseudo-country ``levant``, country := ''
  region    first element only; ``eg`` => country eg, region nile_basin;
            ``iraq`` => country iq, region gulf; else region := mapped

Physical shape: a level's distinct cell strings are exploded, looked up and
joined together again once each; the result is joined back on the string, so
no shuffle but that join carries rows. No Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import split_list
from ..session import materialize

# Fixed values of the standardisation rules.
COLS = {"city": "dialect_city_id", "province": "dialect_province_id",
        "country": "dialect_country_id", "region": "dialect_region_id"}
PSEUDO_COUNTRY = "levant"
REGION_SPECIAL = {"eg": ("eg", "nile_basin"), "iraq": ("iq", "gulf")}
ANCESTORS = {"city": ["dialect_province_id", "dialect_country_id", "dialect_region_id"],
             "province": ["dialect_country_id", "dialect_region_id"]}
FULL_ARITY = {"city": 4, "province": 3}


def validate_gazetteer(gaz: DataFrame) -> DataFrame:
    """Rows violating: unique (level, raw), parts non-empty, no '-' inside a
    part (it is the label separator). Empty result = valid."""
    dup = (gaz.groupBy("level", "raw").agg(F.count(F.lit(1)).alias("n"))
              .where("n > 1").select("level", "raw", F.lit("duplicate key").alias("problem")))
    bad = (gaz.where((F.size("parts") < 1) | F.exists("parts", lambda p: p.contains("-")))
              .select("level", "raw", F.lit("bad parts").alias("problem")))
    return dup.unionByName(bad)


def _lookup(df: DataFrame, col: str, gaz: DataFrame, level: str) -> DataFrame:
    """Per distinct cell: (all_matched, joined canonical names, parts of the
    first element)."""
    g = gaz.where(F.col("level") == level).select("raw", "parts")
    el = (df.where(F.col(col).isNotNull() & (F.col(col) != "")).select(F.col(col).alias("_cell")).distinct()
            .select("_cell", F.posexplode(split_list("_cell")).alias("pos", "raw")))
    return (el.join(g, on="raw", how="left").groupBy("_cell")
              .agg(F.bool_and(F.col("parts").isNotNull()).alias("_ok"),
                   F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.get(F.col("parts"), 0).alias("p0")))),
                                            lambda s: s["p0"]), ",").alias("_new"),
                   F.min_by("parts", "pos").alias("_first")))


def standardize_level(df: DataFrame, gaz: DataFrame, level: str) -> DataFrame:
    col = COLS[level]
    d = df.join(_lookup(df, col, gaz, level), F.col(col) == F.col("_cell"), "left")
    ok = F.coalesce(F.col("_ok"), F.lit(False))
    first = F.col("_first")
    if level in ("city", "province"):
        d = d.withColumn(col, F.when(ok, F.col("_new")).otherwise(F.col(col)))
        full = ok & (F.size(first) == FULL_ARITY[level])
        for i, anc in enumerate(ANCESTORS[level], start=1):
            d = d.withColumn(anc, F.when(full, F.get(first, i)).otherwise(F.col(anc)))
    elif level == "country":
        two = ok & (F.size(first) == 2)
        new_country = F.when(two & (F.get(first, 0) == PSEUDO_COUNTRY), F.lit("")).otherwise(F.col("_new"))
        d = (d.withColumn("dialect_region_id", F.when(two, F.get(first, 1)).otherwise(F.col("dialect_region_id")))
              .withColumn(col, F.when(ok, new_country).otherwise(F.col(col))))
    else:
        raise ValueError(level)
    return d.drop("_cell", "_ok", "_new", "_first")


def standardize_region_first(df: DataFrame, gaz: DataFrame) -> DataFrame:
    """Region rule uses only the first list element."""
    col = COLS["region"]
    g = gaz.where(F.col("level") == "region").select("raw", "parts")
    first_raw = F.get(split_list(col), 0)
    d = (df.withColumn("_raw", F.when(F.col(col).isNotNull() & (F.col(col) != ""), first_raw))
           .join(g.withColumnRenamed("raw", "_raw").withColumnRenamed("parts", "_first"),
                 on="_raw", how="left"))
    lab = F.get(F.col("_first"), 0)
    hit = F.col("_first").isNotNull()
    country = F.col("dialect_country_id")
    region_new = lab
    for special, (c_new, r_new) in REGION_SPECIAL.items():
        country = F.when(hit & (lab == special), F.lit(c_new)).otherwise(country)
        region_new = F.when(lab == special, F.lit(r_new)).otherwise(region_new)
    return (d.withColumn("dialect_country_id", country)
             .withColumn(col, F.when(hit, region_new).otherwise(F.col(col)))
             .drop("_raw", "_first"))


def standardize(df: DataFrame, id_col: str, gaz: DataFrame, levels: list[str]) -> DataFrame:
    """Apply the level rules in the given order. Rows need no unique id;
    ``id_col`` is kept for callers and not read.

    The rules read the four label columns alone, so they run on the distinct
    combinations, written after each level, and are joined back once: the rows
    are scanned twice, however many levels there are."""
    if not levels:
        raise ValueError("levels is required")
    cols = list(COLS.values())
    was = {c: f"_was_{c}" for c in cols}
    out = materialize(df.select(*cols).distinct())
    out = out.select(*cols, *[F.col(c).alias(was[c]) for c in cols])
    for lv in levels:
        out = materialize(standardize_region_first(out, gaz) if lv == "region" else standardize_level(out, gaz, lv))
    new = out.select(*[F.col(c).alias(f"_new_{c}") for c in cols], *was.values())
    same = [df[c].eqNullSafe(new[was[c]]) for c in cols]
    return df.join(new, same).select(*[new[f"_new_{c}"].alias(c) if c in was else df[c] for c in df.columns])
