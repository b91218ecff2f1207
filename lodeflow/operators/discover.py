"""Extension: merging datasets by what their columns hold, whatever the columns are called.

Each column's values go into a theta sketch, all columns of a dataset in one aggregate. Two columns' sketches tell how many
values they share, so a join is chosen as one from a column to another that holds nearly all of its values, each once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeflow.functions.cells import cell_key
from lodeflow.operators.merge import JOINS, merge
from lodeflow.sources.records import ROW
from lodeflow.sources.shared import staged

#: log2 of the values that a sketch keeps: estimates are within about 3 % then.
LOG_SIZE = 12
#: Of a column's values so many must be in the other column, of whose rows so many must have values of their own.
CONTAINED, UNIQUE = 0.9, 0.9


@dataclass(frozen=True)
class Link:
    """A way to join two datasets: column names, the share of one's values that the other holds, how far the other's values
    are unique, and how alike the two sets of values are."""

    left: str
    right: str
    contained: float
    unique: float
    alike: float

    @property
    def rank(self) -> tuple:
        return (round(self.contained * self.unique, 1), round(self.alike, 1), self.left.lower() == self.right.lower(), self.contained * self.unique, self.alike)


def _value(df: DataFrame, c: str, cells: bool) -> Column:
    key = cell_key(F.col(f"`{c}`"), df.schema[c].dataType, cells)
    return F.concat_ws(":", key["kind"], key["value"])


def sketches(df: DataFrame, cells: bool = False) -> DataFrame:
    """column, sketch, filled: a row for each column that has values; filled counts its cells with one. One aggregate."""
    names = [c for c in df.columns if c != ROW and df.schema[c].dataType.typeName() not in ("array", "map", "struct", "variant")]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, sketch binary, filled long")
    plain = df.select(*[F.when(F.col(f"`{c}`").isNotNull(), _value(df, c, cells)).alias(f"c{i}") for i, c in enumerate(names)])
    whole = plain.agg(*[F.theta_sketch_agg(f"c{i}", LOG_SIZE).alias(f"s{i}") for i in range(len(names))], *[F.count(f"c{i}").alias(f"n{i}") for i in range(len(names))])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("sketch"), F.col(f"n{i}").alias("filled")) for i, c in enumerate(names)]))
    return whole.select(each.alias("e")).select("e.*").where("filled > 0")


def links(a: DataFrame, b: DataFrame) -> list[Link]:
    """All links of two datasets' sketches, the best first: a row for each pair of columns, at most."""
    own = F.struct("column", "sketch", "filled")
    tagged = a.select(F.lit("a").alias("side"), own.alias("s")).union(b.select(F.lit("b"), own))
    # as many sketches as both datasets have columns, in one row
    both = tagged.agg(*[F.collect_list(F.when(F.col("side") == x, F.col("s"))).alias(x) for x in "ab"])
    each = both.select(F.explode("a").alias("a"), "b").select("a", F.explode("b").alias("b"))
    n = lambda c: F.theta_sketch_estimate(c).cast("double")
    shared = n(F.theta_intersection(F.col("a.sketch"), F.col("b.sketch"))).alias("both")
    pairs = each.select(*[F.col(f"{x}.{c}").alias(f"{c}_{x}") for c in ("column", "filled") for x in "ab"], *[n(F.col(f"{x}.sketch")).alias(f"n{x}") for x in "ab"], shared)
    share = lambda x: F.least(F.lit(1.0), x)
    a_in_b, b_in_a = (F.struct(share(F.col("both") / F.col(f"n{x}")).alias("contained"), share(F.col(f"n{y}") / F.col(f"filled_{y}")).alias("unique")) for x, y in ("ab", "ba"))
    better = F.when(a_in_b["contained"] * a_in_b["unique"] >= b_in_a["contained"] * b_in_a["unique"], a_in_b).otherwise(b_in_a)
    found = pairs.select("column_a", "column_b", better.alias("w"), share(F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("alike"))
    rows = found.where((F.col("w.contained") >= CONTAINED) & (F.col("w.unique") >= UNIQUE)).collect()
    return sorted((Link(r["column_a"], r["column_b"], r["w"]["contained"], r["w"]["unique"], r["alike"]) for r in rows), key=lambda x: (*(-v for v in x.rank), x.left, x.right))


def merge_by_content(frames: list[DataFrame], how: str = "inner", cells: bool = False) -> DataFrame:
    """Merge datasets, from the first on always the one next that has the best link to any of those already merged.

    Sketches are made once a dataset. The key keeps the name that it has among the merged columns; other names as in merge.
    A dataset that no link reaches is an error.
    """
    if how not in JOINS or not frames:
        raise ValueError(f"datasets are missing, or how is none of {tuple(JOINS)}")
    known = [staged(sketches(f, cells), "sketches") for f in frames]
    out, names, left = frames[0], {0: {c: c for c in frames[0].columns}}, list(range(1, len(frames)))
    ways = {(i, j): links(known[i], known[j]) for i in range(len(frames)) for j in range(len(frames)) if i != j}
    while left:
        options = [(ways[i, j][0], i, j) for i in names for j in left if ways[i, j]]
        if not options:
            raise ValueError(f"no column's values link dataset {left[0] + 1} to the others")
        best, i, j = max(options, key=lambda o: (o[0].rank, -o[1], -o[2]))
        key = names[i][best.left]
        # what else is called like the key in the new dataset steps aside before the key takes that name
        aside = {c: f"{c}_b" for c in frames[j].columns if c == key and c != best.right}
        new = frames[j].withColumnsRenamed(aside | {best.right: key})
        merged = merge(out, new, how, on=key, cells=cells)
        rest = iter(merged.columns[len(out.columns) :])
        names[j] = {c: key if c == best.right else next(rest) for c in frames[j].columns}
        out = merged
        left.remove(j)
    return out
