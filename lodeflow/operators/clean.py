"""Cleaning: trim, normalize_case, fix_types, dedupe, fill_missing, always in this order."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeflow.functions import cells as readings
from lodeflow.functions.cells import cell_key
from lodeflow.functions.cells import text_kind as cell_kind
from lodeflow.sources import store
from lodeflow.sources.records import ROW

OPERATIONS = ("trim", "normalize_case", "fix_types", "dedupe", "fill_missing")
VOTE = 0.8


def _texts(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _over_texts(df: DataFrame, change, cells: bool = False) -> DataFrame:
    """Change texts; with cells, only those that read as nothing else."""
    texts = set(_texts(df))
    own = lambda c: F.when(cell_kind(c) == "string", change(c)).otherwise(c) if cells else change(c)
    return df.select(*[own(F.col(c)).alias(c) if c in texts else F.col(c) for c in df.columns])


def votes_of(df: DataFrame, cells: bool = False) -> DataFrame:
    """One row: v0, v1, ...: for each text column in turn, cells that aren't missing, of these numbers, of these dates.

    No number is a date, so only other texts are read as dates. The counts of parts of a dataset add up to those of the whole.
    """
    votes = []
    for c in map(F.col, _texts(df)):
        full, other = c != "", F.isnan(readings.cell_number(c, cells))
        votes += [F.count_if(full), F.count_if(full & ~other), F.count_if(full & other & readings.text_date(c).isNotNull())]
    return df.agg(*[v.alias(f"v{i}") for i, v in enumerate(votes)])


def profile(df: DataFrame, cells: bool = False) -> dict[str, tuple[int, int, int]]:
    """For each text column: cells that aren't missing, of these numbers, of these dates. One aggregate, one row."""
    texts = _texts(df)
    if not texts:
        return {}
    row = votes_of(df, cells).first()
    return {c: (row[3 * i], row[3 * i + 1], row[3 * i + 2]) for i, c in enumerate(texts)}


def _fixed(c: Column, votes: tuple[int, int, int], null_dates: str, cells: bool = False) -> Column:
    n, numbers, dates = votes
    if n and numbers / n > VOTE:
        return F.when(c != "", readings.cell_number(c, cells))
    if n and dates / n > VOTE:
        shown = F.coalesce(readings.text_date(c), c)
        return F.coalesce(shown, F.lit("1970-01-01")) if null_dates == "epoch" else shown
    return c


def fix_types(df: DataFrame, null_dates: str = "keep", cells: bool = False, votes: dict[str, tuple[int, int, int]] | None = None) -> DataFrame:
    """Columns voted numeric (over 80 % of their cells) become doubles, failing cells NaN; else dates become yyyy-MM-dd.

    The vote is an action, unless its counts are given. Booleans are numbers here: 1 and 0, with cells also those among
    texts. null_dates="epoch" gives missing dates 1970-01-01.
    """
    votes = profile(df, cells) if votes is None else votes
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for c in df.columns:
        if c in votes:
            out.append(_fixed(F.col(c), votes[c], null_dates, cells).alias(c))
        else:
            out.append(F.col(c).cast("double").alias(c) if isinstance(kinds[c], T.BooleanType) else F.col(c))
    return df.select(*out)


def _key(c: str, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~(F.isnan(c) | (F.abs(c) == float("inf"))), F.col(c) + 0.0)
    return F.col(c)


def dedupe(df: DataFrame, keep: str = "first", subset: list[str] | None = None, order: str | None = None, cells: bool = False) -> DataFrame:
    """Distinct rows; NaN, infinities and null count as the same. With cells, so do CSV cells that read alike (1 and 1.0).

    Extensions: keep "last" or "none" (drop every repeated row), a subset of columns as the key, an order column that
    says which row is first. Without it that is the rows' places where df has them, else the order in which they are read.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    columns = subset or [c for c in df.columns if c != ROW]
    order = order or (ROW if ROW in df.columns else None)
    loose = any(isinstance(kinds[c], (T.DoubleType, T.FloatType)) or cells and isinstance(kinds[c], T.StringType) for c in columns)
    if keep == "first" and not loose and not subset and order is None:
        return df.dropDuplicates()
    own = lambda c: text_key(F.col(c)) if cells and isinstance(kinds[c], T.StringType) else _key(c, kinds[c])
    text_key = lambda c: cell_key(c, T.StringType(), True)
    keys = [own(c).alias(f"key{i}_") for i, c in enumerate(columns)]
    names = [f"key{i}_" for i in range(len(columns))]
    rows = df.select(*keys, F.struct(*df.columns).alias("row_"), (F.col(order) if order else F.monotonically_increasing_id()).alias("ord_"))
    if keep == "none":
        single = rows.groupBy(*names).agg(F.count("*").alias("n_"), F.first("row_").alias("row_")).where("n_ = 1")
        return single.select("row_.*")
    pick = F.min_by if keep == "first" else F.max_by
    return rows.groupBy(*names).agg(pick("row_", "ord_").alias("row_")).select("row_.*")


def fill_missing(df: DataFrame, cells: bool = False) -> DataFrame:
    """Null becomes 0 in numeric columns, NaN stays; elsewhere null becomes empty text.

    In a typed frame a numeric column is one of a numeric type. With cells, a text column is numeric too if some cell of it
    reads as a number, and empty cells are missing ones; finding that out is one aggregate. Columns of other types than
    text become text.
    """
    texts = _texts(df) if cells else []
    found = df.agg(*[F.coalesce(F.bool_or(cell_kind(F.col(c)) == "number"), F.lit(False)).alias(f"m{i}") for i, c in enumerate(texts)]).first() if texts else []
    mixed = {c for c, m in zip(texts, found, strict=True) if m}
    out = []
    for f in df.schema.fields:
        if f.name == ROW:
            out.append(F.col(ROW))
        elif isinstance(f.dataType, T.NumericType):
            out.append(F.coalesce(F.col(f.name), F.lit(0).cast(f.dataType)).alias(f.name))
        elif f.name in mixed:
            out.append(F.coalesce(F.nullif(F.col(f.name), F.lit("")), F.lit("0")).alias(f.name))
        else:
            out.append(F.coalesce(F.col(f.name).cast("string"), F.lit("")).alias(f.name))
    return df.select(*out)


def clean(df: DataFrame, operations: Iterable[str], null_dates: str = "keep", cells: bool = False) -> DataFrame:
    """Apply the chosen operations in their fixed order, however they are listed. Names may differ by case alone.

    cells: text columns hold CSV cells, each of its own kind: only texts are cased, booleans count as numbers (see also
    dedupe and fill_missing). Rows keep their places, if df has them.
    """
    chosen = set(operations)
    if not chosen or chosen - set(OPERATIONS):
        raise ValueError(f"operations must be some of {OPERATIONS}")
    names = df.columns
    out = df.toDF(*[ROW if c == ROW else f"c{i}" for i, c in enumerate(names)])
    if "trim" in chosen:
        out = _over_texts(out, readings.trim)
    if "normalize_case" in chosen:
        out = _over_texts(out, readings.title_case, cells)
    if "fix_types" in chosen:
        out = fix_types(out, null_dates, cells)
    if "dedupe" in chosen:
        out = dedupe(out, cells=cells)
    if "fill_missing" in chosen:
        out = fill_missing(out, cells)
    return out.toDF(*names)


def prepare(spark: SparkSession, root: str, layer: str, name: str, operations: Iterable[str]) -> str:
    """Clean a dataset into Silver with its metadata; returns the new dataset's name. Cells are typed one by one first."""
    out = store.write_silver(clean(store.read_dataset(spark, root, layer, name, ordered=True), operations, cells=True), root, name)
    known = store.load_metadata(spark, root, layer, name)
    record = {"display_name": f"{known.get('display_name') or name} (cleaned)", "owner": "Workspace", "archived": False}
    if known.get("division_override"):
        record["division_override"] = known["division_override"]
    store.save_metadata(spark, root, "Silver", out, record)
    return out

