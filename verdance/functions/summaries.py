"""Aggregates with the exact quantile rules of the step tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grid_quantiles(rows: DataFrame, keys: list[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """Quantiles on a grid of thousandths: the smallest grid value with at least ``q * (n - 1) + 1`` values up to it.

    Works on counts per grid value, of which there are at most 1001 in a group
    however many rows it has.
    """
    at = F.rint(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(value))) * 1000).cast("int")
    counts = rows.groupBy(*keys, at.alias("__at")).agg(F.count("*").alias("__n"))
    held = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__at", "__n"))).alias("__h"), F.sum("__n").alias("__all"))
    out = held.select(*keys, *[_grid_at(q).alias(name) for name, q in probabilities.items()])
    return out


def _grid_at(q: float) -> Column:
    first = F.aggregate(
        F.col("__h"),
        F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("at")),
        lambda acc, x: F.struct((acc["seen"] + x["__n"]).alias("seen"), F.when(acc["at"].isNull() & (acc["seen"] + x["__n"] - 1 >= F.lit(q) * (F.col("__all") - 1)), x["__at"]).otherwise(acc["at"]).alias("at")),
    )
    return first["at"] / F.lit(1000.0)


def value_summary(value: Column, prefix: str) -> list[Column]:
    """Count, mean, extremes and linearly interpolated percentiles of the values that are there."""
    names = {"P05": 0.05, "P25": 0.25, "Median": 0.5, "P75": 0.75, "P95": 0.95}
    return [
        F.count(value).alias(f"{prefix}_N"),
        F.avg(value).alias(f"{prefix}_Mean"),
        F.min(value).alias(f"{prefix}_Min"),
        *[F.percentile(value, F.lit(q)).alias(f"{prefix}_{n}") for n, q in names.items()],
        F.max(value).alias(f"{prefix}_Max"),
    ]


def text_value(x: Column, kind: str) -> Column:
    """A value as the step tables print it: NA for nothing, True and False for flags."""
    if kind == "boolean":
        shown = F.when(x, "True").otherwise("False")
        return F.when(x.isNull(), "NA").otherwise(shown)
    if kind in ("double", "float"):
        return F.when(x.isNull() | F.isnan(x), "NA").otherwise(x.cast("string"))
    return F.coalesce(x.cast("string"), F.lit("NA"))


def key_values(row: DataFrame) -> DataFrame:
    """The columns of a one-row frame as ``Item, Value`` rows in their order."""
    pairs = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(f.name).alias("Item"), text_value(F.col(f"`{f.name}`"), f.dataType.simpleString()).alias("Value")) for i, f in enumerate(row.schema)])
    return row.select(F.explode(pairs).alias("p")).select("p.ord", "p.Item", "p.Value").orderBy("ord").drop("ord")
