"""The chart query: sums of one measure by one key, largest first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeflow.functions.cells import label, number, text_kind
from lodeflow.sources import store
from lodeflow.sources.records import ROW

GROUPS = 20


def numeric_columns(df: DataFrame, cells: bool = False) -> list[str]:
    """Columns offered as measures: those with some number. Numeric columns with a value, and with cells, text columns in
    which some cell reads as a number; one aggregate."""
    some = []
    for f in df.schema.fields:
        if f.name == ROW:
            continue
        if isinstance(f.dataType, T.NumericType):
            some.append((f.name, F.col(f.name).isNotNull()))
        elif cells and isinstance(f.dataType, T.StringType):
            some.append((f.name, text_kind(F.col(f.name)) == "number"))
    if not some:
        return []
    row = df.agg(*[F.max(has).alias(f"m{i}") for i, (_, has) in enumerate(some)]).first()
    return [c for i, (c, _) in enumerate(some) if row[i]]


def group_sum(df: DataFrame, x: str, y: str, top: int = GROUPS, order: str | None = None, cells: bool = False) -> DataFrame:
    """(label, total): the groups with the largest totals.

    A null measure counts 0 and makes its group appear; one that is no number drops its row. Ties go by the least value
    of the order column, by default the rows' places where df has them, or by the key without one. With cells, text
    measures are CSV cells: true counts 1, false 0.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    order = order or (ROW if ROW in df.columns else None)
    rows = df.select(F.col(x).alias("x"), number(F.col(y), kinds[y], cells).alias("v"), *([F.col(order).alias("o")] if order else []))
    rows = rows.where(~F.isnan("v"))
    tie = F.min("o") if order else F.min("x")
    sums = rows.groupBy("x").agg(F.sum("v").alias("total"), tie.alias("tie"))
    best = sums.orderBy(F.desc("total"), F.asc_nulls_first("tie")).limit(top)
    return best.select(label(F.col("x"), kinds[x]).alias("label"), "total")


def chart(df: DataFrame, x: str, y: str, order: str | None = None, cells: bool = False) -> DataFrame:
    """group_sum, or an error if no row has a usable measure."""
    if not x or not y:
        raise ValueError("a chart needs a key and a measure")
    out = group_sum(df, x, y, order=order, cells=cells)
    if out.isEmpty():
        raise ValueError(f"no row has a number in {y!r}")
    return out


def chart_dataset(spark: SparkSession, root: str, layer: str, name: str, x: str, y: str) -> DataFrame:
    """The chart of a stored dataset; groups of equal totals in the order in which its files have them."""
    return chart(store.read_dataset(spark, root, layer, name, ordered=True), x, y, cells=True)
