"""Lenient scalars, label checks and pseudonym ids as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """A double; null for what is none, NaN or infinite."""
    v = c.try_cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != math.inf), v)


def whole(c: Column) -> Column:
    """A long, cut toward zero; null for what is no finite number."""
    return finite(c).try_cast("long")


def flag01(c: Column) -> Column:
    """1 for anything but 0, false, empty and null, also as text; else 0."""
    text = F.lower(F.trim(c.cast("string")))
    number = finite(text)
    return F.when(c.isNull() | text.isin("", "false", "no", "none", "null"), 0).when(number.isNotNull(), F.when(number != 0, 1).otherwise(0)).otherwise(1)


def is_attack_label(c: Column) -> Column:
    """Whether a label means an attack: a number other than 0, cut toward zero, or the word."""
    n = whole(c)
    return F.when(n.isNotNull(), n != 0).otherwise(F.coalesce(F.lower(F.trim(c.cast("string"))) == "attack", F.lit(False)))


def finite_values(values: Column) -> Column:
    """The finite ones of an array of doubles."""
    return F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != math.inf))


def require_labels(df: DataFrame, label: str) -> DataFrame:
    """df, whose labels are 0 or 1: other ones raise when a row that has one is read."""
    return df.withColumn(label, F.when(F.col(label).isin(0, 1), F.col(label)).otherwise(F.raise_error(F.concat(F.lit("label is not 0 or 1: "), F.coalesce(F.col(label).cast("string"), F.lit("null")))).cast("int")))


def pseudo_ids(ids: Column) -> Column:
    """Trimmed, lower-cased, distinct ids of the form p<number>, in the order of the number."""
    clean = F.array_distinct(F.filter(F.transform(ids, lambda x: F.lower(F.trim(x))), lambda x: x.rlike(r"^p\d+$")))
    return F.transform(F.array_sort(F.transform(clean, lambda x: F.struct(F.substring(x, 2, 20).cast("decimal(20,0)").alias("n"), x.alias("id")))), lambda x: x["id"])


def require_subset(inner: Column, outer: Column, what: str) -> Column:
    """inner, if all of its ids are in outer; else reading the row raises."""
    missing = F.array_except(inner, outer)
    return F.when(F.size(missing) == 0, inner).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), F.array_join(missing, ","))).cast("array<string>"))
