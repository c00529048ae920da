"""Text column expressions. Everything here is a built-in Spark expression
(JVM side, whole-stage codegen); there are no Python UDFs in the library."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must match the reference's behaviour.
#
# Word tokenisation: a token is a run of letters / marks / digits, or a single
# character that is neither such a character nor whitespace.
TOKEN_PATTERN = r"([\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}])"
# What is neither of a run nor whitespace, and whitespace that is not one blank.
LONE_PATTERN = r"[^\p{L}\p{M}\p{N} \t\n\x0B\f\r]"
GAP_PATTERN = r"[ \t\n\x0B\f\r]{2,}|[\t\n\x0B\f\r]"
# Arabic diacritics removed by the dediacritisation step: fathatan, dammatan,
# kasratan, fatha, damma, kasra, shadda, sukun, superscript alef, tatweel.
ARABIC_MARKS = "[\u064b\u064c\u064d\u064e\u064f\u0650\u0651\u0652\u0670\u0640]"
# The same class; one test decides on characters outside the block.
MARK_RANGES = "[\u0640-\u0670&&[^\u0641-\u064a\u0653-\u066f]]"
# Arabic letter block used by the script-token filters (hamza .. yeh).
ARABIC_LETTERS = "ء-ي"
# Space replacement used by the character stream.
CHAR_SPACE = "X"
# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def word_tokens(c) -> Column:
    """Simple word tokenisation: words and punctuation split apart, joined by
    one space. Lone characters are set apart by blanks, then whitespace becomes one
    blank: no string and no array element a token."""
    return F.trim(F.regexp_replace(F.regexp_replace(_c(c), LONE_PATTERN, " $0 "), GAP_PATTERN, " "))


def strip_marks(c, mark_class: str = MARK_RANGES) -> Column:
    """Remove diacritic marks; the mark class is a regex character class."""
    return F.regexp_replace(_c(c), mark_class, "")


def char_stream(c) -> Column:
    """Character stream used by char LMs: spaces become ``X``, every
    character separated by a space."""
    chars = F.split(F.replace(_c(c), F.lit(" "), F.lit(CHAR_SPACE)), "")
    return F.array_join(F.filter(chars, lambda x: x != ""), " ")


def whitespace_norm(c) -> Column:
    """Collapse whitespace runs to one space and trim."""
    return F.trim(F.regexp_replace(_c(c), r"\s+", " "))


def collapse_double_space(c) -> Column:
    """Runs of two or more whitespace characters become one space (the
    pre-processing of the character n-gram analyser)."""
    return F.regexp_replace(_c(c), r"\s\s+", " ")


def repeat_sentence(c, n: int) -> Column:
    """Sentence repetition augmentation ``A -> A A ...`` (n extra copies)."""
    if n <= 0:
        return _c(c)
    return F.trim(F.repeat(F.concat(_c(c), F.lit(" ")), n + 1))


def script_token_filter(c, letter_class: str = ARABIC_LETTERS,
                        extra_chars: str = "") -> Column:
    """Keep only whitespace tokens written entirely in the given script and
    rebuild the line with single spaces."""
    pattern = f"^[{letter_class}{extra_chars}]+$"
    toks = F.split(_c(c), r"\s+")
    return F.array_join(F.filter(toks, lambda t: t.rlike(pattern)), " ")


def noise_removal(c, noise_words: list[str]) -> Column:
    """Remove every occurrence of the noise strings (plain substrings, as
    the reference does) and the parentheses."""
    out = _c(c)
    for w in noise_words:
        out = F.replace(out, F.lit(w), F.lit(""))
    return F.regexp_replace(out, r"[()]", "")


def transliterate(c, src: str, dst: str) -> Column:
    """One-to-one character map (e.g. a romanisation back to its script)."""
    return F.translate(_c(c), src, dst)


def attr_value(c, attr: str) -> Column:
    """Value of a quoted attribute ``attr="..."`` in a tag line."""
    return F.regexp_extract(_c(c), rf'{attr}="([^"]*)"', 1)


def padded_seg_id(c) -> Column:
    """Segment id normalisation: keep digits and underscores, drop trailing
    underscores, left-pad to three characters (never truncate)."""
    kept = F.regexp_replace(F.regexp_replace(_c(c), r"[^0-9_]", ""), r"_+$", "")
    return F.lpad(kept, F.greatest(F.length(kept), F.lit(3)), "0")


# Fixed value: how packed score lists write a missing score.
NIL = "<NIL>"


def number_or_nil(c) -> Column:
    """A number written as text; NIL is 0, what is no number is NULL."""
    return F.when(F.trim(_c(c)) == NIL, F.lit(0.0)).otherwise(F.trim(_c(c)).try_cast("double"))


def packed_best(packed, header: str, prefix: str = "") -> Column:
    """struct(name, score) of the highest of comma-separated scores; ``header``
    names them (after ``prefix``), the first name wins ties."""
    names = F.array(*[F.lit(n.strip()) for n in header.removeprefix(prefix).split(",")])
    scores = F.transform(F.split(_c(packed), ",", -1), number_or_nil)
    best = F.array_max(scores)
    return F.struct(F.get(names, (F.array_position(scores, best) - 1).cast("int")).alias("name"), best.alias("score"))
