"""Text compared as the source's database compares it: without case, accents and trailing blanks.

The opt-in mode beside plain strings and ``ILIKE``: equality, grouping and joins under
``UNICODE_CI_AI_RTRIM``, substring search under ``UNICODE_CI_AI``.  The values themselves stay
as they are; only the keys are collated, so shuffles hash the collation key and stay ordinary
equi-joins and aggregations.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EQUAL = "UNICODE_CI_AI_RTRIM"
SEARCH = "UNICODE_CI_AI"


def text_key(col: Column | str) -> Column:
    """The column as a key of equality."""
    return F.collate(F.col(col) if isinstance(col, str) else col, EQUAL)


def same_text(a: Column | str, b: Column | str) -> Column:
    return text_key(a) == text_key(b)


# FLT2: code equal, or name contains.
def match_text(df: DataFrame, code_col: str, name_col: str, text: str) -> DataFrame:
    return df.where(same_text(code_col, F.lit(text)) | F.contains(F.collate(F.col(name_col), SEARCH), F.collate(F.lit(text), SEARCH)))


# FLT3: one of the columns contains the text; NULL columns do not match.
def search_text(df: DataFrame, cols: Sequence[str], text: str | None) -> DataFrame:
    if not text:
        return df
    part = F.collate(F.lit(text), SEARCH)
    return df.where(reduce(lambda a, b: a | b, [
        F.coalesce(F.contains(F.collate(F.col(c), SEARCH), part), F.lit(False)) for c in cols]))


# JN9: rows whose text is (not) among the keys.
def text_join(left: DataFrame, right: DataFrame, on: str, how: str, right_on: str | None = None) -> DataFrame:
    """Join on equal texts; for 'left_semi', 'left_anti', 'inner' and 'left'.  The right key column is dropped."""
    r = right.withColumn("_text", text_key(right_on or on)).drop(right_on or on)
    joined = left.withColumn("_own", text_key(on)).join(r, F.col("_own") == F.col("_text"), how)
    return joined.drop("_own", "_text")


# DQ1: texts that several rows hold.
def duplicate_texts(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """(check, table_name, column_name, value, rows) as ``quality.unique_violations``; value: the smallest spelling."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns]))
    g = (df.select(pairs.alias("p")).where(F.col("p.v").isNotNull())
         .groupBy(F.col("p.c").alias("column_name"), text_key("p.v").alias("_k"))
         .agg(F.min("p.v").alias("value"), F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1))
    return g.select(F.lit("unique").alias("check"), F.lit(table).alias("table_name"), "column_name", "value", "rows")


# SNK2: the first row of each text that is not stored yet.
def insert_ignore_text(target: DataFrame, rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Rows with their outcome ('inserted' or 'ignored'); a NULL key meets nothing."""
    ordk = F.struct(*order)
    # collated work is done on distinct spellings, once: which texts are new, and the order of their first row
    asked = (rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_spelling")).agg(F.min(ordk).alias("_first"))
             .withColumn("_taken", F.lit(False)))
    taken = target.where(F.col(key).isNotNull()).select(F.col(key).alias("_spelling")).distinct().select(
        "_spelling", F.lit(None).cast(asked.schema["_first"].dataType).alias("_first"), F.lit(True).alias("_taken"))
    first = (asked.unionByName(taken).groupBy(text_key("_spelling").alias("_text"))
             .agg(F.min("_first").alias("_first"), F.max("_taken").alias("_taken"))
             .where(~F.col("_taken")).select("_text", "_first"))
    j = (rows.withColumns({"_own": text_key(key), "_order": ordk})
         .join(first, (F.col("_order") == F.col("_first")) & (F.col("_own") == F.col("_text")), "left"))
    wins = F.col(key).isNull() | F.col("_text").isNotNull()
    return j.select(*rows.columns, F.when(wins, "inserted").otherwise("ignored").alias("outcome"))
