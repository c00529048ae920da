"""n-gram arrays built with higher-order array functions.

Character n-grams use one ``split`` of the string and index arithmetic
(linear in the line length), not ``substring`` per position.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.text import collapse_double_space
from ..session import ship
from .rowgrams import row_terms


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _grams(arr: Column, n: int, sep: str) -> Column:
    """All contiguous n-grams of an array column, joined by ``sep``.
    Empty when the array is shorter than n (``sequence(0, -1)`` is not
    empty in Spark, hence the guard)."""
    if n == 1:
        return arr

    def gram(i):  # i is 0-based; direct element access, no slice objects
        items = [arr[i + k] for k in range(n)]
        return F.concat(*items) if sep == "" else F.concat_ws(sep, *items)
    return F.when(
        F.size(arr) >= n,
        F.transform(F.sequence(F.lit(0), F.size(arr) - n), gram),
    ).otherwise(F.array().cast("array<string>"))


def chars(c) -> Column:
    """Characters of a string (empty string -> empty array)."""
    return F.filter(F.split(_c(c), ""), lambda x: x != "")


def char_units(c) -> Column:
    """Characters after collapsing whitespace runs (the char analyser's
    pre-processing); project this once, then call ``grams_of``."""
    return chars(collapse_double_space(c))


def word_units(c) -> Column:
    """Tokens of ``split(text, ' ')`` with empty tokens kept, as the
    reference's tokenizer does."""
    return F.split(_c(c), " ", -1)


def grams_of(arr_col: str, lo: int, hi: int, sep: str) -> Column:
    """n-grams lo..hi of an already projected array column (project the
    array first: Spark does not share a sub-expression across lambda calls,
    so a split inside the lambda would be re-evaluated per position)."""
    arr = F.col(arr_col)
    return F.flatten(F.array(*[_grams(arr, n, sep) for n in range(lo, hi + 1)]))


def bounded_tokens(c, n: int, bos: str = "<s>", eos: str = "</s>") -> Column:
    """Sentence tokens wrapped in ``<s>``/``</s>`` for LM counting/scoring:
    tokens are the non-empty space-separated pieces."""
    toks = F.filter(F.split(_c(c), " ", -1), lambda x: x != "")
    return F.concat(F.array(F.lit(bos)), toks, F.array(F.lit(eos)))


def term_counts(df: DataFrame, keys: list[str], terms: Column, term_col: str = "term",
                count_col: str = "tf") -> DataFrame:
    """(keys, term, tf). Grouping includes the keys, so a frame already
    partitioned by its leading key needs no shuffle here."""
    return (df.select(*keys, F.explode(terms).alias(term_col))
              .groupBy(*keys, term_col).agg(F.count(F.lit(1)).alias(count_col)))


# Character n-grams as exact integer codes: each code point + 1 takes 21
# bits, so an n-gram of up to 3 characters is one long (no collisions, and
# lengths are distinguishable because every component is >= 1). Counting
# on longs avoids building a string per occurrence; the string of each
# counted term is decoded once after the aggregation.
CP_BITS = 21
CP_MASK = (1 << CP_BITS) - 1


def char_codes(c) -> Column:
    """Code point + 1 of every character unit (whitespace runs collapsed)."""
    return F.transform(char_units(c), lambda ch: F.ascii(ch).cast("long") + 1)


def code_grams_of(arr_col: str, lo: int, hi: int) -> Column:
    """Integer codes of the n-grams lo..hi (hi <= 3) of a code array."""
    if hi > 3:
        raise ValueError("integer-coded char n-grams support n <= 3")
    arr = F.col(arr_col)

    def code(n):
        def at(i):
            out = arr[i]
            for k in range(1, n):
                out = out * F.lit(1 << CP_BITS) + arr[i + k]
            return out
        if n == 1:
            return arr
        return F.when(F.size(arr) >= n, F.transform(F.sequence(F.lit(0), F.size(arr) - n), at)) \
                .otherwise(F.array().cast("array<long>"))
    return F.flatten(F.array(*[code(n) for n in range(lo, hi + 1)]))


def decode_char_gram(code: Column) -> Column:
    """Integer code -> the n-gram string."""
    def ch(shift):
        cp = F.shiftright(code, shift).bitwiseAND(F.lit(CP_MASK)) - 1
        return F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")
    three = F.concat(ch(2 * CP_BITS), ch(CP_BITS), ch(0))
    two = F.concat(ch(CP_BITS), ch(0))
    return (F.when(code >= F.lit(1 << (2 * CP_BITS)), three)
             .when(code >= F.lit(1 << CP_BITS), two)
             .otherwise(ch(0)))


def char_term_counts(df: DataFrame, keys: list[str], text_col: str, lo: int, hi: int) -> DataFrame:
    """(keys, term, tf) of character n-grams lo..hi, counted row by row in Arrow
    batches (``rowgrams``); rows of equal keys are counted together."""
    return _counted(df, keys, text_col, "c", lo, hi)


def word_term_counts(df: DataFrame, keys: list[str], text_col: str, lo: int, hi: int) -> DataFrame:
    """(keys, term, tf) of the n-grams lo..hi of ``word_units``."""
    return _counted(df, keys, text_col, "w", lo, hi)


def _counted(df: DataFrame, keys: list[str], text_col: str, unit: str, lo: int, hi: int) -> DataFrame:
    ship(df.sparkSession)
    rows = df.groupBy(*keys).agg(F.collect_list(text_col).alias("_texts"))

    def run(batches):
        for batch in batches:
            for _, _, row, term, tf, names in row_terms(batch.column(len(keys)), unit, lo, hi):
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).take(pa.array(row)) for i in range(len(keys))),
                     names.take(pa.array(term)).cast(pa.string()), pa.array(tf)], names=[*keys, "term", "tf"])
    schema = StructType([*(rows.schema[k] for k in keys), StructField("term", StringType()), StructField("tf", LongType())])
    return rows.mapInArrow(run, schema)
