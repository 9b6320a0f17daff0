"""Scalar text functions and predicates (all stay in the JVM)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: combining marks and tatweel that a normalised Arabic text leaves out
ARABIC_MARKS = (
    "\u0610-\u061A\u064B-\u065F\u0670\u06D6-\u06DC\u06DF-\u06E8\u06EA-\u06ED\u0640"
)
# fixed values: alef forms folded to the bare alef
ARABIC_FOLD_FROM = "\u0671\u0622\u0623\u0625"
ARABIC_FOLD_TO = "\u0627\u0627\u0627\u0627"

# fixed values: the same idea for Latin text, combining accents out and common accented letters folded
LATIN_MARKS = "\u0300-\u036F"
LATIN_FOLD_FROM = "àâäáãåçèéêëìíîïñòóôöõùúûüýÿ"
LATIN_FOLD_TO = "aaaaaaceeeeiiiinooooouuuuyy"

TOKEN_PATTERN = r"[^ \t\r\n.,;:!?]+"
UNIT_REF_PATTERN = r"^(\d+):(\d+)(?:-(\d+))?$"


def normalize_text(
    c: Column, marks: str = ARABIC_MARKS, fold_from: str = ARABIC_FOLD_FROM, fold_to: str = ARABIC_FOLD_TO
) -> Column:
    """Drop the marks, then fold letter variants one to one."""
    return F.translate(F.regexp_replace(c, f"[{marks}]", ""), fold_from, fold_to)


def normalize_latin(c: Column) -> Column:
    return normalize_text(F.lower(c), LATIN_MARKS, LATIN_FOLD_FROM, LATIN_FOLD_TO)


def strip_spaces(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def match_contains(query: Column, *columns: Column) -> Column:
    """Literal containment in any of the columns; % and _ have no special meaning."""
    return reduce(lambda x, y: x | y, [F.coalesce(F.contains(c, query), F.lit(False)) for c in columns])


def match_prefix(query: Column, *columns: Column) -> Column:
    return reduce(lambda x, y: x | y, [F.coalesce(F.startswith(c, query), F.lit(False)) for c in columns])


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def clip(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def tokens_of(c: Column, pattern: str = TOKEN_PATTERN) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def letters_of(c: Column) -> Column:
    """Array of single characters (code points)."""
    return F.filter(F.split(c, ""), lambda x: x != F.lit(""))


def format_ref(*parts: Column) -> Column:
    return F.concat_ws(":", *parts)


def parse_ref(c: Column) -> Column:
    """``section:n`` or ``section:a-b`` as struct(section, first, last, error)."""
    t = F.trim(c)
    matched = F.coalesce(F.regexp_like(t, F.lit(UNIT_REF_PATTERN)), F.lit(False))
    # try_cast: numbers too long for an INT count as a bad reference instead of failing the job
    part = lambda i: F.regexp_extract(t, UNIT_REF_PATTERN, i).try_cast("int")
    first = part(2)
    last = F.when(F.regexp_extract(t, UNIT_REF_PATTERN, 3) != "", part(3)).otherwise(first)
    usable = matched & part(1).isNotNull() & first.isNotNull() & last.isNotNull()
    error = (
        F.when(~usable, F.lit("bad_format"))
        .when(last < first, F.lit("end_before_start"))
    )
    good = error.isNull()
    return F.struct(
        F.when(good, part(1)).alias("section"),
        F.when(good, first).alias("first"),
        F.when(good, last).alias("last"),
        error.alias("error"),
    )


def json_from_text(c: Column) -> Column:
    """JSON body of a model answer: fence removed, null unless it is an object or array."""
    body = F.trim(F.regexp_replace(F.trim(c), r"(?s)^```(?:json)?\s*(.*?)\s*```$", "$1"))
    shaped = F.regexp_like(body, F.lit(r"(?s)^[\{\[].*[\}\]]$"))
    return F.when(shaped & F.try_parse_json(body).isNotNull(), body)


def bucket_p(p: Column) -> Column:
    return (
        F.when(p.isNull(), F.lit(None).cast("string"))
        .when(p < 0.001, "p<0.001")
        .when(p < 0.01, "p<0.01")
        .when(p < 0.05, "p<0.05")
        .otherwise("not small")
    )
