"""Merging two datasets on one shared column: inner, left, right and full outer joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeflow.functions.cells import cell_key, label
from lodeflow.sources import store
from lodeflow.sources.records import ROW

#: Names that two frames' places have during a merge.
_PLACES = ("_place_a_", "_place_b_")
#: Items that the sketch of frequent keys tracks; salts of a key at most, and so many that a key with all rows would come in
#: PIECES pieces for each partition, which even out.
SKETCH, MOST_SALTS, PIECES = 10_000, 10_000, 8
JOINS = {"inner": "inner", "left": "left", "right": "right", "outer": "full"}


def shared_column(a: DataFrame, b: DataFrame) -> str:
    """The first column of a that b has too, by exact name."""
    for c in a.columns:
        if c in b.columns and c != ROW:
            return c
    raise ValueError("the two datasets share no column")


def output_names(a: list[str], b: list[str], key: str) -> list[str]:
    """a's names, then b's others; a repeated name gets _b until it is new."""
    out = list(a)
    for c in b:
        if c != key:
            while c in out:
                c = f"{c}_b"
            out.append(c)
    return out


def _kind(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return "number"
    return "boolean" if isinstance(kind, T.BooleanType) else "text" if isinstance(kind, T.StringType) else kind.simpleString()


def _digits(kind: T.DataType) -> tuple[int, int]:
    """Digits before and behind the point."""
    return (kind.precision - kind.scale, kind.scale) if isinstance(kind, T.DecimalType) else (19, 0)


def _as_numbers(a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> tuple[Column, Column]:
    """Both in a form in which equal numbers are equal: doubles if one is floating, else a decimal type that holds both, or,
    where none does, their digits as text."""
    if any(isinstance(k, (T.DoubleType, T.FloatType)) for k in (ta, tb)):
        return a.cast("double"), b.cast("double")
    whole, scale = map(max, zip(_digits(ta), _digits(tb), strict=True))
    if whole + scale <= 38:
        return tuple(c.cast(f"decimal({whole + scale},{scale})") for c in (a, b))

    def digits(c: Column, kind: T.DataType) -> Column:
        t = c.cast("string")
        if _digits(kind)[1] == 0:
            return t
        sign, power = F.regexp_extract(t, r"\A-?", 0), F.regexp_extract(t, r"E-([0-9]+)\z", 1).try_cast("int")
        small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), power - 1), F.regexp_replace(t, r"E.*|[.-]", ""))
        plain = F.when(t.contains("E"), small).otherwise(t)
        return F.when(plain.contains("."), F.rtrim(F.rtrim(plain, F.lit("0")), F.lit("."))).otherwise(plain)

    return digits(a, ta), digits(b, tb)


def _keys(ka: Column, ta: T.DataType, kb: Column, tb: T.DataType, cells: bool) -> tuple[Column, Column]:
    """Both keys in a form in which the same keys are equal. Null matches null; values match within one kind only, never by
    conversion."""
    if cells and (isinstance(ta, T.StringType) or isinstance(tb, T.StringType)):
        return cell_key(ka, ta, True), cell_key(kb, tb, True)
    if ta == tb:
        return ka, kb
    if _kind(ta) == _kind(tb) == "number":
        return _as_numbers(ka, ta, kb, tb)
    own = lambda k, t: F.when(k.isNotNull(), F.struct(F.lit(_kind(t)).alias("kind"), k.cast("string").alias("value")))
    return own(ka, ta), own(kb, tb)


def _either(first: Column, t1: T.DataType, second: Column, t2: T.DataType) -> Column:
    if t1 == t2:
        return F.coalesce(first, second)
    if _kind(t1) == _kind(t2) == "number":
        return F.coalesce(*_as_numbers(first, t1, second, t2))
    return F.coalesce(first.cast("string"), second.cast("string"))


def heavy_keys(df: DataFrame, key: Column, share: float, most: int = SKETCH) -> dict[str, float]:
    """key -> share of the rows, of the keys that more than the given share have, by a frequent-items sketch of bounded size.

    The sketch's counts are estimates that it never puts under the true ones; no such key is missed as long as share is
    over 1 / most. Keys are texts here, null among them. At most 1 / share rows reach the driver.
    """
    found = df.select(_named(key).alias("k")).agg(F.count("*").alias("n"), F.call_function("approx_top_k", F.col("k"), F.lit(int(1 / share) + 1), F.lit(most)).alias("top")).first()
    return {r["item"]: r["count"] / found["n"] for r in found["top"] or [] if r["count"] > share * found["n"]}


def _named(key: Column) -> Column:
    """A key of any type as a text."""
    return F.to_json(F.struct(key.alias("k")))


def spread(left: DataFrame, right: DataFrame, ka: Column, kb: Column, share: float) -> tuple[DataFrame, DataFrame]:
    """left and right with columns salt_ and copied_, such that rows which a join on (key, salt_) brings together are those
    which a join on the key does.

    A heavy key's rows get salts in turn on the side that has more of them; on the other side each row is copied to all
    salts. A copy without a partner is none of the result: the side with the salts has the key, so each row copied has
    partners under some salt.
    """
    shares = [heavy_keys(df, k, share) for df, k in ((left, ka), (right, kb))]
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = []
    for k in {**shares[0], **shares[1]}:
        own = [s.get(k, 0.0) for s in shares]
        rows.append((k, int(own[0] < own[1]), max(2, min(MOST_SALTS, round(PIECES * parts * max(own))))))
    known = left.sparkSession.createDataFrame(rows, "heavy_ string, side_ int, salts_ int")  # at most 2 / share rows
    out = []
    for side, (df, key) in enumerate(((left, ka), (right, kb))):
        joined = df.withColumn("named_", _named(key)).join(F.broadcast(known), F.col("named_") == F.col("heavy_"), "left")
        turn = F.array((F.monotonically_increasing_id() % F.col("salts_")).cast("int"))
        salts = F.when(F.col("heavy_").isNull(), F.array(F.lit(0))).when(F.col("side_") == side, turn).otherwise(F.sequence(F.lit(0), F.col("salts_") - 1))
        copied = F.coalesce(F.col("side_") != side, F.lit(False))
        out.append(joined.select(*[df[c] for c in df.columns], copied.alias("copied_"), F.explode(salts).alias("salt_")))
    return out[0], out[1]


def merge(a: DataFrame, b: DataFrame, how: str = "inner", on: str | None = None, right_collision: str = "own", cells: bool = False, heavy: float | None = None) -> DataFrame:
    """Join a and b on one column (by default the first shared one).

    Output: a's columns in order, then b's but the key, with _b on a clash; the key has b's value on right-only rows.
    right_collision="left_slot" puts b's clashing value of a right-only row into a's column instead of its own.
    cells: text keys are CSV cells, each of the kind that it reads as: the number 1 matches 1.0, and never the text "1".
    heavy: the share of a side's rows from which on a key, null too, is spread over many tasks; finding such keys reads both
    key columns once more. Without it such keys are left to the adaptive plan, which can't split full outer joins.
    Where both sides have their rows' places, so has the result: a's rows in order, each with b's in order, then b's alone.
    """
    if how not in JOINS:
        raise ValueError(f"how must be one of {tuple(JOINS)}")
    key = on or shared_column(a, b)
    placed = ROW in a.columns and ROW in b.columns
    if placed:
        a, b = (x.withColumnRenamed(ROW, name) for x, name in ((a, _PLACES[0]), (b, _PLACES[1])))
    a, b = (x.drop(ROW) for x in (a, b))
    an, bn = a.columns, b.columns
    names = output_names([c for c in an if c not in _PLACES], [c for c in bn if c not in _PLACES], key)
    left = a.toDF(*[f"a{i}" for i in range(len(an))]).withColumn("pa", F.lit(True))
    right = b.toDF(*[f"b{i}" for i in range(len(bn))])
    ka, kb = an.index(key), bn.index(key)
    ta, tb = [f.dataType for f in a.schema.fields], [f.dataType for f in b.schema.fields]
    own = (F.col(f"a{ka}"), F.col(f"b{kb}"))
    xa, xb = _keys(own[0], ta[ka], own[1], tb[kb], cells)
    computed = xa is not own[0]
    if heavy or computed:
        # columns of their own: as expressions in the join, keys would be computed again wherever a sort compares them
        left, right = left.withColumn("xa", xa), right.withColumn("xb", xb)
    if heavy:
        left, right = spread(left, right, F.col("xa"), F.col("xb"), heavy)
        left, right = (df.withColumnsRenamed({"salt_": f"salt{s}", "copied_": f"copied{s}"}) for df, s in ((left, "a"), (right, "b")))
        joined = left.join(right, F.col("xa").eqNullSafe(F.col("xb")) & (F.col("salta") == F.col("saltb")), JOINS[how])
        alone = (F.col("salta").isNull() & F.col("copiedb")) | (F.col("saltb").isNull() & F.col("copieda"))
        joined = joined.where(~F.coalesce(alone, F.lit(False)))
    else:
        joined = left.join(right, F.col("xa").eqNullSafe(F.col("xb")) if computed else xa.eqNullSafe(xb), JOINS[how])
    slots = {c: bn.index(c) for c in an if c in bn and c != key} if right_collision == "left_slot" else {}
    only_right = F.col("pa").isNull()
    out = []
    for i, c in enumerate(an):
        if c in _PLACES:
            continue
        if i == ka:
            out.append(_either(F.col(f"a{i}"), ta[i], F.col(f"b{kb}"), tb[kb]))
        elif c in slots:
            j = slots[c]
            same = ta[i] == tb[j]
            x, y = (F.col(f"a{i}"), F.col(f"b{j}")) if same else (F.col(f"a{i}").cast("string"), F.col(f"b{j}").cast("string"))
            out.append(F.when(only_right, y).otherwise(x))
        else:
            out.append(F.col(f"a{i}"))
    for j, c in enumerate(bn):
        if j != kb and c not in _PLACES:
            out.append(F.when(~only_right, F.col(f"b{j}")) if c in slots else F.col(f"b{j}"))
    if placed:
        one, two = F.col(f"a{an.index(_PLACES[0])}"), F.col(f"b{bn.index(_PLACES[1])}")
        out.append(F.struct(only_right.alias("alone"), one.alias("left"), two.alias("right")))
        names.append(ROW)
    return joined.select(*[c.alias(f"o{i}") for i, c in enumerate(out)]).toDF(*names)


def merge_all(frames: list[DataFrame], how: str = "inner") -> DataFrame:
    """Extension: fold several datasets from left to right, each on the first column it shares with what is merged."""
    return reduce(lambda x, y: merge(x, y, how), frames)


def preview(df: DataFrame, order: list[str] | None = None, rows: int = 15) -> DataFrame:
    """The first rows in an order, by default that of their places; all cells as text, null as empty."""
    if order is None and ROW not in df.columns:
        raise ValueError("a preview needs an order: rows have no places")
    order = order or [ROW]
    shown = [F.when(F.col(f.name).isNull(), F.lit("")).otherwise(label(F.col(f.name), f.dataType)).alias(f.name) for f in df.schema.fields if f.name != ROW]
    return df.orderBy(*order).limit(rows).select(*shown)


def preview_counts(df: DataFrame, rows: int = 15) -> DataFrame:
    """(shown, total): how many rows a preview has, of how many."""
    return df.agg(F.least(F.count("*"), F.lit(rows)).alias("shown"), F.count("*").alias("total"))


def merge_datasets(spark: SparkSession, root: str, first: tuple[str, str], second: tuple[str, str], how: str = "inner") -> DataFrame:
    """Merge two stored datasets, each given as (layer, name); they must differ."""
    if not first or not second or first == second:
        raise ValueError("choose two different datasets")
    return merge(store.read_dataset(spark, root, *first, ordered=True), store.read_dataset(spark, root, *second, ordered=True), how, cells=True)


def preview_dataset(spark: SparkSession, root: str, layer: str, name: str, rows: int = 15) -> DataFrame:
    """The first rows of a stored dataset as its files have them."""
    return preview(store.read_dataset(spark, root, layer, name, ordered=True), rows=rows)
