"""Fixture queries of label harmonisation: gazetteer standardisers,
corrections, encoding, roll-up, hierarchy audit.

Stand-in hierarchy: customer (city) -> nation (country) -> region, with
raw labels synthesised in varied case, spacing and comma lists, plus
unknown entries. The gazetteer is derived from the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import label_encode
from ..operators.standardize import standardize
from ..sources.tables import table
from . import q_model
from .registry import register

LABEL_COLS = ["dialect_city_id", "dialect_province_id", "dialect_country_id", "dialect_region_id"]

# -- fixture raw labels -------------------------------------------------------
RAW_SQL = """
raw AS (
  SELECT c.c_custkey AS id,
    CASE c.c_custkey % 5 WHEN 0 THEN upper(c.c_name)
                         WHEN 1 THEN ' ' || lower(c.c_name) || ' , ' || c.c_name
                         WHEN 2 THEN c.c_name || ',nowhere'
                         WHEN 3 THEN NULL ELSE c.c_name END AS dialect_city_id,
    CASE c.c_custkey % 6 WHEN 0 THEN 'p' || c.c_nationkey || '_' || (c.c_custkey % 4)
                         WHEN 1 THEN 'P' || c.c_nationkey || '_' || (c.c_custkey % 4) || ', p0_0'
                         ELSE NULL END AS dialect_province_id,
    CASE c.c_custkey % 4 WHEN 0 THEN ' ' || n.n_name
                         WHEN 1 THEN lower(n.n_name) || ', ' || n.n_name
                         WHEN 2 THEN n.n_name || ',atlantis'
                         ELSE '' END AS dialect_country_id,
    CASE c.c_custkey % 3 WHEN 0 THEN upper(r.r_name) || ', asia'
                         WHEN 1 THEN 'Unknown Land' ELSE NULL END AS dialect_region_id
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
                  JOIN region r ON n.n_regionkey = r.r_regionkey)"""

GAZ_SQL = """
gaz AS (
  SELECT 'country' AS level, lower(n.n_name) AS raw,
         CASE n.n_nationkey WHEN 0 THEN ['levant', lower(r.r_name)]
                            WHEN 1 THEN ['n1']
                            WHEN 2 THEN ['n2', lower(r.r_name), 'x']
                            ELSE ['n' || n.n_nationkey, lower(r.r_name)] END AS parts
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
  UNION ALL
  SELECT 'region', lower(r_name),
         [CASE r_regionkey WHEN 0 THEN 'eg' WHEN 4 THEN 'iraq' ELSE 'r' || r_regionkey END]
  FROM region
  UNION ALL
  SELECT 'city', lower(c.c_name),
         CASE WHEN c.c_custkey % 7 = 0 THEN ['c' || c.c_custkey]
              ELSE ['c' || c.c_custkey, 'p' || c.c_nationkey || '_' || (c.c_custkey % 4),
                    'n' || c.c_nationkey, lower(r.r_name)] END
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
                  JOIN region r ON n.n_regionkey = r.r_regionkey
  UNION ALL
  SELECT DISTINCT 'province', 'p' || c.c_nationkey || '_' || (c.c_custkey % 4),
         ['prov' || c.c_nationkey || '-' || (c.c_custkey % 4), 'n' || c.c_nationkey, lower(r.r_name)]
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
                  JOIN region r ON n.n_regionkey = r.r_regionkey)"""


def _views(spark: SparkSession, sf_dir: str) -> None:
    for t in ("customer", "nation", "region"):
        table(spark, sf_dir, t).createOrReplaceTempView(t)


def raw_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir)
    return spark.sql("WITH" + RAW_SQL.replace(" % ", " % ") + " SELECT * FROM raw")


def fixture_gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data-derived gazetteer (level, raw, parts)."""
    _views(spark, sf_dir)
    g = GAZ_SQL.replace("['levant', lower(r.r_name)]", "array('levant', lower(r.r_name))")
    g = g.replace("['n1']", "array('n1')").replace("['n2', lower(r.r_name), 'x']",
                                                   "array('n2', lower(r.r_name), 'x')")
    g = g.replace("['n' || n.n_nationkey, lower(r.r_name)]", "array('n' || n.n_nationkey, lower(r.r_name))")
    g = g.replace("[CASE r_regionkey WHEN 0 THEN 'eg' WHEN 4 THEN 'iraq' ELSE 'r' || r_regionkey END]",
                  "array(CASE r_regionkey WHEN 0 THEN 'eg' WHEN 4 THEN 'iraq' ELSE 'r' || r_regionkey END)")
    g = g.replace("['c' || c.c_custkey]", "array('c' || c.c_custkey)")
    g = g.replace("""['c' || c.c_custkey, 'p' || c.c_nationkey || '_' || (c.c_custkey % 4),
                    'n' || c.c_nationkey, lower(r.r_name)]""",
                  """array('c' || c.c_custkey, 'p' || c.c_nationkey || '_' || (c.c_custkey % 4),
                    'n' || c.c_nationkey, lower(r.r_name))""")
    g = g.replace("""['prov' || c.c_nationkey || '-' || (c.c_custkey % 4), 'n' || c.c_nationkey, lower(r.r_name)]""",
                  """array('prov' || c.c_nationkey || '-' || (c.c_custkey % 4), 'n' || c.c_nationkey, lower(r.r_name))""")
    return spark.sql("WITH" + g + " SELECT * FROM gaz")


# -- oracle for the standardisers ---------------------------------------------
def _std_level_sql(src: str, dst: str, level: str) -> str:
    col = {"city": "dialect_city_id", "province": "dialect_province_id",
           "country": "dialect_country_id", "region": "dialect_region_id"}[level]
    if level == "region":
        return f"""
{dst}_k AS (
  SELECT s.*, g.parts AS fp FROM {src} s LEFT JOIN gaz g
    ON g.level = 'region' AND s.{col} IS NOT NULL AND s.{col} <> ''
   AND g.raw = trim(string_split(lower(s.{col}), ',')[1])),
{dst} AS (
  SELECT id, dialect_city_id, dialect_province_id,
         CASE WHEN fp[1] = 'eg' THEN 'eg' WHEN fp[1] = 'iraq' THEN 'iq' ELSE dialect_country_id END AS dialect_country_id,
         CASE WHEN fp IS NULL THEN {col} WHEN fp[1] = 'eg' THEN 'nile_basin'
              WHEN fp[1] = 'iraq' THEN 'gulf' ELSE fp[1] END AS dialect_region_id
  FROM {dst}_k)"""
    lk = f"""
{dst}_e AS (
  SELECT id, trim(unnest(string_split(lower({col}), ','))) AS raw,
         generate_subscripts(string_split(lower({col}), ','), 1) AS pos
  FROM {src} WHERE {col} IS NOT NULL AND {col} <> ''),
{dst}_l AS (
  SELECT e.id, bool_and(g.parts IS NOT NULL) AS ok,
         string_agg(g.parts[1], ',' ORDER BY e.pos) AS new_v,
         arg_min(g.parts, e.pos) AS fp
  FROM {dst}_e e LEFT JOIN gaz g ON g.level = '{level}' AND g.raw = e.raw GROUP BY e.id),
{dst}_j AS (SELECT s.*, coalesce(l.ok, false) AS ok, l.new_v, l.fp FROM {src} s LEFT JOIN {dst}_l l USING (id))"""
    if level in ("city", "province"):
        n = 4 if level == "city" else 3
        anc = (["dialect_province_id", "dialect_country_id", "dialect_region_id"] if level == "city"
               else ["dialect_country_id", "dialect_region_id"])
        sel = {c: c for c in ["dialect_city_id", "dialect_province_id", "dialect_country_id", "dialect_region_id"]}
        sel[col] = f"CASE WHEN ok THEN new_v ELSE {col} END"
        for i, a in enumerate(anc, start=2):
            sel[a] = f"CASE WHEN ok AND len(fp) = {n} THEN fp[{i}] ELSE {a} END"
    else:
        sel = {c: c for c in ["dialect_city_id", "dialect_province_id", "dialect_country_id", "dialect_region_id"]}
        sel[col] = ("CASE WHEN ok AND len(fp) = 2 AND fp[1] = 'levant' THEN '' "
                    f"WHEN ok THEN new_v ELSE {col} END")
        sel["dialect_region_id"] = "CASE WHEN ok AND len(fp) = 2 THEN fp[2] ELSE dialect_region_id END"
    cols = ", ".join(f"{v} AS {k}" for k, v in sel.items())
    return lk + f""",
{dst} AS (SELECT id, {cols} FROM {dst}_j)"""


def standardize_sql(levels: list[str]) -> str:
    ctes = [RAW_SQL, GAZ_SQL]
    src = "raw"
    for i, lv in enumerate(levels):
        dst = f"s{i}"
        ctes.append(_std_level_sql(src, dst, lv))
        src = dst
    return "WITH " + ",".join(ctes) + f"\nSELECT id, {', '.join(LABEL_COLS)} FROM {src}"


def _std(spark, sf_dir, levels):
    df = raw_labels(spark, sf_dir)
    gaz = fixture_gazetteer(spark, sf_dir)
    return standardize(df, "id", gaz, levels).select("id", *LABEL_COLS)


for _levels in (["city"], ["province"], ["country"], ["region"], ["city", "country", "region"]):
    _name = "standardize_chain" if len(_levels) > 1 else f"standardize_{_levels[0]}"
    register(_name, standardize_sql(_levels))(
        (lambda lv: (lambda spark, sf_dir: _std(spark, sf_dir, lv)))(_levels))


@register("gazetteer_check", "WITH" + GAZ_SQL + """,
dup AS (SELECT level, raw, 'duplicate key' AS problem FROM gaz GROUP BY level, raw HAVING count(*) > 1),
bad AS (SELECT level, raw, 'bad parts' AS problem FROM gaz
        WHERE len(parts) < 1 OR len(list_filter(parts, lambda x: x LIKE '%-%')) > 0)
SELECT * FROM dup UNION ALL SELECT * FROM bad""")
def q_gazetteer_check(spark, sf_dir):
    """Gazetteer validation: duplicate keys and parts containing the label
    separator (the fixture's province names deliberately contain '-')."""
    from ..operators.standardize import validate_gazetteer
    return validate_gazetteer(fixture_gazetteer(spark, sf_dir))


# -- corrections, encoding, roll-up, audit ------------------------------------
CORRECTIONS_SQL = """
SELECT id,
  CASE WHEN dialect_region_id = 'Unknown Land' AND id % 2 = 0 THEN 'fixed_city' ELSE dialect_city_id END AS dialect_city_id,
  CASE WHEN dialect_region_id = 'Unknown Land' AND id % 2 = 0 THEN 'maghreb' ELSE dialect_region_id END AS dialect_region_id,
  CASE WHEN dialect_country_id = '' THEN NULL ELSE dialect_country_id END AS dialect_country_id
FROM raw"""


@register("label_corrections", "WITH" + RAW_SQL + CORRECTIONS_SQL)
def q_label_corrections(spark, sf_dir):
    """Rule-driven correction: predicate on the old row, several columns
    overwritten together (all conditions read the original values)."""
    from ..operators.corrections import apply_corrections
    rules = [
        {"when": (F.col("dialect_region_id") == "Unknown Land") & (F.col("id") % 2 == 0),
         "set": {"dialect_city_id": F.lit("fixed_city"), "dialect_region_id": F.lit("maghreb")}},
        {"when": F.col("dialect_country_id") == "",
         "set": {"dialect_country_id": F.lit(None).cast("string")}},
    ]
    df = raw_labels(spark, sf_dir)
    return apply_corrections(df, rules).select("id", "dialect_city_id", "dialect_region_id",
                                               "dialect_country_id")


@register("label_encode", f"""
WITH {q_model.O.corpus_ctes()},
lab AS (SELECT DISTINCT {q_model.O.label_expr('city')} AS label FROM sent WHERE split = 'train')
SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id FROM lab""")
def q_label_encode(spark, sf_dir):
    s = q_model.sentences(spark, sf_dir).where("split = 'train'").select("label")
    return label_encode(s.distinct(), "label").select("label", F.col("label_id").cast("int"))


@register("hier_label_rollup", f"""
WITH {q_model.O.lines_ctes()}
SELECT dialect_region_id, dialect_country_id, dialect_city_id,
       count(*) AS n_sentences,
       CAST(sum(len(string_split(original_sentence, ' '))) AS BIGINT) AS n_tokens,
       CAST(sum(length(original_sentence)) AS BIGINT) AS n_chars
FROM sent GROUP BY ROLLUP (dialect_region_id, dialect_country_id, dialect_city_id)""")
def q_hier_label_rollup(spark, sf_dir):
    """Corpus statistics rolled up region > country > city (partial
    aggregation before the shuffle; grouping sets expand map-side)."""
    s = q_model.corpus.all_lines(spark, sf_dir)
    return (s.rollup("dialect_region_id", "dialect_country_id", "dialect_city_id")
             .agg(F.count(F.lit(1)).alias("n_sentences"),
                  F.sum(F.size(F.split("original_sentence", " ", -1))).cast("long").alias("n_tokens"),
                  F.sum(F.length("original_sentence")).cast("long").alias("n_chars")))


@register("corpus_stats", f"""
WITH {q_model.O.corpus_ctes()}
SELECT {q_model.O.label_expr('city')} AS label, count(*) AS n_sentences,
       CAST(sum(len(string_split(original_sentence, ' '))) AS BIGINT) AS n_tokens,
       CAST(sum(length(original_sentence)) AS BIGINT) AS n_chars
FROM sent WHERE split = 'train' GROUP BY ALL""")
def q_corpus_stats(spark, sf_dir):
    """Sentences, word tokens and characters per label (training corpus
    of the per-label LMs)."""
    s = q_model.sentences(spark, sf_dir).where("split = 'train'")
    return (s.groupBy("label")
             .agg(F.count(F.lit(1)).alias("n_sentences"),
                  F.sum(F.size(F.split("original_sentence", " ", -1))).cast("long").alias("n_tokens"),
                  F.sum(F.length("original_sentence")).cast("long").alias("n_chars")))


@register("hierarchy_pairs", f"""
WITH {q_model.O.lines_ctes()}
SELECT DISTINCT dialect_country_id, dialect_region_id FROM sent""")
def q_hierarchy_pairs(spark, sf_dir):
    return (q_model.corpus.all_lines(spark, sf_dir)
            .select("dialect_country_id", "dialect_region_id").distinct())


# Corpus-specific gazetteer variant: one country maps to another region
# (as a folder-level lookup would), passed in as a different table.
GAZ_VARIANT_SQL = GAZ_SQL.replace("ELSE ['n' || n.n_nationkey, lower(r.r_name)] END AS parts",
                                  "WHEN 3 THEN ['n3', 'gulf'] ELSE ['n' || n.n_nationkey, lower(r.r_name)] END AS parts")


@register("standardize_country_variant",
          standardize_sql(["country"]).replace(GAZ_SQL, GAZ_VARIANT_SQL))
def q_standardize_country_variant(spark, sf_dir):
    """Country standardisation with a corpus-specific gazetteer variant."""
    df = raw_labels(spark, sf_dir)
    gaz = fixture_gazetteer(spark, sf_dir)
    variant = gaz.withColumn("parts", F.when((F.col("level") == "country") & (F.col("raw") == "nation_3"),
                                             F.array(F.lit("n3"), F.lit("gulf"))).otherwise(F.col("parts")))
    return standardize(df, "id", variant, ["country"]).select("id", *LABEL_COLS)
