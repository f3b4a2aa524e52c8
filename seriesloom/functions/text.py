"""Text expressions: words, tokens, slugs and date-like text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

# White space besides the ASCII kind that a regular expression's \s covers.
OTHER_SPACES = (
    "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003"
    "\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Punctuation taken off both ends of a token.
TOKEN_EDGE = ".,:;()[]"
# Shapes of text that look like a date, and the shape of a clock time.
DATE_SHAPES = (r"\d{4}[-/]\d{1,2}[-/]\d{1,2}", r"\d{1,2}[-/]\d{1,2}[-/]\d{2,4}")
CLOCK_SHAPE = r":.*\d|\d.*:"
# Month formats tried after the general parser, in this order.
MONTH_FORMATS = ("yy-MMM", "yyyy-MMM", "MMM-yy", "MMM-yyyy", "MM-yyyy", "yyyy-MM")
# Day formats that the general parser of Spark does not cover.
DAY_FORMATS = ("M/d/yyyy", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "M-d-yyyy", "yyyy/M/d")


def plain_space(text: Column) -> Column:
    """Every kind of white space outside ASCII as a blank, so that the cheap ``\\s`` is enough afterwards."""
    return F.translate(text, OTHER_SPACES, " " * len(OTHER_SPACES))


def words(text: Column) -> Column:
    """Non-empty words between white space."""
    return F.filter(F.split(plain_space(text), r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def tokens(text: Column) -> Column:
    """Words longer than two characters, punctuation stripped, lower case."""
    kept = F.filter(words(text), lambda w: F.length(w) > 2)
    return F.transform(kept, lambda w: F.lower(F.btrim(w, F.lit(TOKEN_EDGE))))


def token_uses(text: Column, wanted: list[str]) -> Column:
    """The tokens of a text that are among ``wanted``, in order and with repeats, found in one pass over the text."""
    edge = "[" + re.escape(TOKEN_EDGE) + "]*"
    options = "|".join(re.escape(w) for w in sorted(set(wanted), key=len, reverse=True))
    # Between white space (or the ends), three characters or more, punctuation only at the edges.
    pattern = rf"(?<!\S)(?=\S{{3}}){edge}({options}){edge}(?!\S)"
    return F.regexp_extract_all(F.lower(plain_space(text)), F.lit(pattern), F.lit(1))


def token_rows(df: DataFrame, text: str, into: str = "token") -> DataFrame:
    """One row per token, the same tokens as ``tokens``; cheaper than exploding that array."""
    exploded = df.withColumn(into, F.explode(F.split(F.lower(plain_space(F.col(text))), r"\s+"))).where(F.length(into) > 2)
    return exploded.withColumn(into, F.btrim(into, F.lit(TOKEN_EDGE)))


def name_tokens(name: Column) -> Column:
    """Distinct words of a column name longer than two characters (underscores and hyphens separate)."""
    parts = F.split(F.trim(F.translate(F.lower(name), "_-", "  ")), " +")
    return F.array_distinct(F.filter(parts, lambda w: F.length(w) > 2))


def title_from_slug(slug: Column) -> Column:
    """``big-blue_shop`` to ``Big Blue Shop``."""
    parts = F.filter(F.split(slug, "[-_]+"), lambda w: w != "")
    return F.array_join(
        F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))), " "
    )


def owner_of(folder: Column) -> Column:
    """Part before the first ``__``, or else before the first ``--``; null without a separator."""
    return F.when(folder.contains("__"), F.split(folder, "__", 2)[0]).when(
        folder.contains("--"), F.split(folder, "--", 2)[0]
    )


def slug_of(folder: Column) -> Column:
    return (
        F.when(folder.contains("__"), F.split(folder, "__", 2)[1])
        .when(folder.contains("--"), F.split(folder, "--", 2)[1])
        .otherwise(folder)
    )


def title_from_id(dataset_id: Column) -> Column:
    """Readable title: owner, version, long number and the words data/dataset at the end are taken off."""
    slug = (
        F.when(dataset_id.contains("/"), F.split(dataset_id, "/", 2)[1])
        .when(dataset_id.contains("--"), F.split(dataset_id, "--", 2)[1])
        .when(dataset_id.contains("__"), F.split(dataset_id, "__", 2)[1])
        .otherwise(dataset_id)
    )
    for ending in (r"-v\d+$", r"-\d{5,}$", r"-(dataset|data)$"):
        slug = F.regexp_replace(slug, ending, "")
    return F.trim(F.initcap(F.translate(slug, "-_", "  ")))


def is_date_shaped(text: Column) -> Column:
    trimmed = F.trim(text)
    shaped = trimmed.rlike(DATE_SHAPES[0]) | trimmed.rlike(DATE_SHAPES[1]) | trimmed.rlike(CLOCK_SHAPE)
    return (F.length(trimmed) >= 6) & shaped


def parse_candidates(text: Column) -> list[Column]:
    """Timestamp readings of a text column: general parser and day formats first, then each month format."""
    trimmed = F.trim(text)
    general = F.coalesce(trimmed.try_cast("timestamp_ntz"), *[
        F.try_to_timestamp(trimmed, F.lit(f)).cast("timestamp_ntz") for f in DAY_FORMATS
    ])
    months = []
    for f in MONTH_FORMATS:
        parsed = F.try_to_timestamp(trimmed, F.lit(f)).cast("timestamp_ntz")
        if "yyyy" not in f:  # two digits mean 1969 to 2068
            parsed = F.when(F.year(parsed) > 2068, F.add_months(parsed, -1200).cast("timestamp_ntz")).otherwise(parsed)
        months.append(parsed)
    return [general] + months
