"""Text, type and date column functions.

All are built-in expressions, so they stay in whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The English stop-word list the reference filters with
# (the public NLTK ``stopwords.words('english')`` list, 179 words).
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself "
    "yourselves he him his himself she she's her hers herself it it's its itself they them their "
    "theirs themselves what which who whom this that that'll these those am is are was were be "
    "been being have has had having do does did doing a an the and but if or because as until "
    "while of at by for with about against between into through during before after above below "
    "to from up down in out on off over under again further then once here there when where why "
    "how all any both each few more most other some such no nor not only own same so than too "
    "very s t can will just don don't should should've now d ll m o re ve y ain aren aren't "
    "couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma "
    "mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren "
    "weren't won won't wouldn wouldn't"
).split()

# Deletes characters that are neither letters, digits, underscore nor
# whitespace; Unicode-aware (plain ``\w`` is ASCII-only in Java regex).
PUNCT_PATTERN = r"[^\p{L}\p{N}_\s]"
WS_PATTERN = r"\s+"


def lowercase(c: Column) -> Column:
    """Missing stays missing."""
    return F.lower(c)


def remove_punct(c: Column) -> Column:
    """X2."""
    return F.regexp_replace(c, PUNCT_PATTERN, "")


def tokens(c: Column) -> Column:
    """Whitespace tokens, like Python ``str.split()`` (no empty tokens)."""
    return F.filter(F.split(c, WS_PATTERN), lambda w: w != F.lit(""))


def remove_stopwords(c: Column, stop_words=ENGLISH_STOP_WORDS) -> Column:
    """Drop exact (case-sensitive) stop words, rejoin with one space.
    Missing stays missing (the reference turns it into the text 'nan')."""
    words = list(stop_words)
    return F.array_join(F.filter(tokens(c), lambda w: ~w.isin(*words)), " ")


def regex_extract(c: Column, pattern: str) -> Column:
    """Group 1 of the first match; no match -> missing."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1))


def to_numeric(c: Column) -> Column:
    """Unparsable -> missing (a plain cast raises under ANSI mode)."""
    return c.cast("string").try_cast("double")


def to_datetime(c: Column, formats: list[str] | None = None) -> Column:
    """Unparsable -> missing; optional explicit formats tried in order."""
    if not formats:
        return c.cast("string").try_cast("timestamp")
    return F.coalesce(*[F.try_to_timestamp(c.cast("string"), F.lit(f)) for f in formats])


def to_string(c: Column) -> Column:
    """Text form; missing stays missing."""
    return c.cast("string")


def text_clean(df: DataFrame, column: str, action: str, stop_words=ENGLISH_STOP_WORDS) -> DataFrame:
    c = F.col(column)
    if action == "lowercase":
        return df.withColumn(column, lowercase(c))
    if action == "remove_punct":
        return df.withColumn(column, remove_punct(c))
    if action == "remove_stopwords":
        return df.withColumn(column, remove_stopwords(c, stop_words))
    if action == "correct_spelling":
        from kiln.operators.spell import correct_spelling
        return correct_spelling(df, column)
    raise ValueError(f"unknown text_clean action {action!r}")


def type_conversion(df: DataFrame, column: str, to: str) -> DataFrame:
    c = F.col(column)
    if to == "numeric":
        return df.withColumn(column, to_numeric(c))
    if to == "datetime":
        return df.withColumn(column, to_datetime(c))
    if to == "category":
        return df  # values unchanged; codes come from ``encode.label``
    if to == "string":
        return df.withColumn(column, to_string(c))
    raise ValueError(f"unknown type {to!r}")


def extract(df: DataFrame, column: str, pattern: str, new_column: str | None = None) -> DataFrame:
    return df.withColumn(new_column or f"{column}_extracted", regex_extract(F.col(column), pattern))


_PARTS = {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour,
    "weekday": F.weekday,  # Monday = 0, as pandas
    "quarter": F.quarter,
}


def datetime_part(df: DataFrame, column: str, part: str, new_feature: str) -> DataFrame:
    """The source becomes a timestamp (bad text is an error, unlike X7);
    an unknown part adds no column."""
    c = F.col(column)
    if df.schema[column].dataType.typeName() == "string":
        c = F.to_timestamp(c)
    df = df.withColumn(column, c)
    if part not in _PARTS:
        return df
    return df.withColumn(new_feature, _PARTS[part](F.col(column)))
