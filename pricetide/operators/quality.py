"""Data quality reports, gates and layer profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.schema import OBS, Cols


class QualityError(ValueError):
    """A layer failed its quality report."""


def _count_distinct_with_null(name: str) -> Column:
    # NULL counts as one value, as it does for a distinct projection.
    has_null = F.coalesce(F.max(F.col(name).isNull().cast("long")), F.lit(0))
    return F.count_distinct(F.col(name)) + has_null


def quality_report(df: DataFrame, layer: str, c: Cols = OBS) -> DataFrame:
    """One row of counts for ``df``, from a single pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("total_records"),
        _count_distinct_with_null(c.symbol).alias("distinct_symbols"),
        F.count_if(F.col(c.price).isNull()).alias("null_price_count"),
        F.count_if(F.col(c.symbol).isNull()).alias("null_symbol_count"),
        F.count_if(F.col(c.price) < 0).alias("negative_price_count"),
    )
    total = F.col("total_records")

    def pct(name: str) -> Column:
        return F.round(F.try_divide(F.col(name), total) * F.lit(100.0), 2)

    faults = (
        F.col("null_price_count") + F.col("null_symbol_count") + F.col("negative_price_count")
    )
    return counts.select(
        F.lit(layer).alias("layer"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("run_at"),
        "total_records",
        "distinct_symbols",
        "null_price_count",
        pct("null_price_count").alias("null_price_pct"),
        "null_symbol_count",
        pct("null_symbol_count").alias("null_symbol_pct"),
        "negative_price_count",
        (faults == 0).alias("passed"),
    )


def enforce_quality(report: DataFrame) -> dict:
    """The report row as a dict, or a :class:`QualityError` if the layer is unfit."""
    row = report.first().asDict()
    if row["total_records"] == 0:
        raise QualityError(f"{row['layer']} has 0 records")
    if not row["passed"]:
        raise QualityError(f"quality check failed for {row['layer']}: {row}")
    return row


def layer_profile(layers: dict[str, DataFrame], symbol: str = "symbol") -> DataFrame:
    """One row per layer: row count, schema and number of distinct symbols.

    ``distinct_symbols`` is NULL for layers without a symbol column.
    """

    def profile(name: str, df: DataFrame) -> DataFrame:
        distinct = (
            _count_distinct_with_null(symbol)
            if symbol in df.columns
            else F.lit(None).cast("long")
        )
        return df.agg(
            F.count(F.lit(1)).alias("row_count"), distinct.alias("distinct_symbols")
        ).select(
            F.lit(name).alias("layer"),
            "row_count",
            F.lit(df.schema.simpleString()).alias("schema"),
            "distinct_symbols",
        )

    return reduce(DataFrame.unionByName, [profile(n, df) for n, df in layers.items()])


def layer_symbols(layers: dict[str, DataFrame], symbol: str = "symbol") -> DataFrame:
    """The distinct symbols of each layer that has them, one row per symbol."""
    parts = [
        df.select(F.lit(name).alias("layer"), F.col(symbol).alias("symbol")).distinct()
        for name, df in layers.items()
        if symbol in df.columns
    ]
    return reduce(DataFrame.unionByName, parts)


def content_sample(
    df: DataFrame, columns: tuple[str, ...] = ("symbol", "name", "price"), n: int = 20
) -> DataFrame:
    """Up to ``n`` rows of the given columns."""
    return df.select(*columns).limit(n)
