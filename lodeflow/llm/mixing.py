"""Mixing sources to target weights by a low-discrepancy schedule.

Slots 0..n-1 stand for blocks of about `block` words. Slot j's golden-ratio point frac(j * phi) falls into one source's
part of the cumulative targets; the slot's rank among that source's slots names the source's block of that rank. Blocks
come from the source's documents in a hashed order, read over again for up to `most` epochs, cut into equal numbers of
words. So any run of slots is near the targets, and each source's total is its target.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, prefix_sums, staged

GOLDEN = 0x9E3779B9  # 2**32 over the golden ratio
CELLS, SMALL = 4096, 100_000


def golden_point(slot):
    """frac(slot * phi) with 32 bits, in 64-bit arithmetic that can't overflow."""
    low, high = slot.bitwiseAND(F.lit(0xFFFF)), F.shiftright(slot, 16).bitwiseAND(F.lit(0xFFFF))
    return F.pmod(low * F.lit(GOLDEN) + F.pmod(high * F.lit(GOLDEN), F.lit(1 << 16)) * F.lit(1 << 16), F.lit(1 << 32)) / F.lit(float(1 << 32))


def targets(sizes: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """(source, source_size) -> with sid, weight and target. Each target is min(most * size, level * weight).

    The level at which targets add up to all sizes is the largest of (all - capped sizes) / (weights not capped), taken
    over how many sources, in order of most * size / weight, are capped. One row for each source goes through one task.
    """
    cap = F.col("source_size") * F.lit(float(most))
    rows = sizes.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")))
    every = Window.partitionBy()
    below = Window.orderBy(cap / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    capped, used = F.coalesce(F.sum(cap).over(below), F.lit(0.0)), F.coalesce(F.sum("weight").over(below), F.lit(0))
    rows = rows.withColumn("level", (F.sum("source_size").over(every) - capped) / (F.sum("weight").over(every) - used))
    return rows.withColumn("target", F.least(cap, F.max("level").over(every) * F.col("weight"))).drop("level")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = 3, block: int = 128, seed: int = 6, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix's documents and its schedule.

    documents: row, doc_id, source, size, source_size, target, taken, first_slot (null if nothing is taken), slots. row is
    row_col, which must tell rows apart and be 64-bit, or a number of its own. schedule: slot, rank, source, doc_id, row, epoch,
    first_word, last_word (exclusive), one row for each piece of a document in a slot's block.

    Sources in code-point order, null last, have the weights in turn. Defined cases: a null or wordless text has size 0
    and is never taken; repeated rows are taken each for itself; a source without words has target 0; an empty table
    gives empty results; a very long text is cut over as many blocks as it needs; documents of equal hashes (ties) go by doc_id,
    size and row; other columns, however named, are not read. Reruns agree: order depends on doc_id and seed alone.
    """
    spark = docs.sparkSession
    rows = pick(docs, doc_id=id_col, text=text_col, source=source_col, **({"row": row_col} if row_col else {}))
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    sized = staged(rows.select("doc_id", "source", size.alias("size"), (F.col("row") if row_col else F.monotonically_increasing_id()).alias("row")), "sizes")
    by_source = staged(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), weights, most), "sources")
    sources, n_docs, total = by_source.agg(F.count("*"), F.sum("docs"), F.sum("source_size")).first()
    few = F.broadcast if sources <= SMALL else lambda df: df
    n_slots = math.ceil((total or 0) / block)

    edge = F.sum("target").over(Window.orderBy("sid")) / F.sum("target").over(Window.partitionBy())
    parts = by_source.where("target > 0").withColumn("hi", edge).withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("sid")), F.lit(0.0)))
    parts = parts.withColumn("hi", F.when(F.lead("sid").over(Window.orderBy("sid")).isNull(), 2.0).otherwise(F.col("hi")))
    last = F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1))
    cells = parts.select("sid", "lo", "hi", F.explode(F.sequence(F.least(F.floor(F.col("lo") * CELLS), F.lit(CELLS - 1)), last)).alias("at"))
    points = spark.range(n_slots).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("x")).withColumn("cell", F.floor(F.col("x") * CELLS))
    slots = points.join(cells, F.col("cell") == F.col("at")).where("x >= lo and x < hi").select("slot", "sid", F.lit(1).alias("one"))
    ranked = staged(prefix_sums(slots, ["sid"], ["slot"], "one", "rank", F.shiftright("slot", 13)).select("slot", "sid", "rank"), "slots")
    counts = ranked.groupBy("sid").agg(F.count("*").alias("n")).withColumnRenamed("sid", "s")
    plan = by_source.join(counts, F.col("sid") == F.col("s"), "left").select("source", "sid", "source_size", "target", F.round("target").cast("long").alias("words"), F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)).alias("n"), F.col("n").isNull().alias("slotless"))
    plan = staged(plan, "plan")
    ranked = ranked.union(plan.where("slotless and target > 0").select(F.lit(n_slots) + F.col("sid"), "sid", F.lit(0)))

    bits = max(0, min(16, math.ceil(math.log2(max(1, n_docs or 0) / 64))))
    known = sized.join(few(plan), sized["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    shuffled = known.withColumn("h", F.xxhash64("doc_id", F.lit(seed)))
    place = staged(prefix_sums(shuffled, ["sid"], ["h", "doc_id", "size", "row"], "size", "start", F.shiftright("h", 64 - bits) if bits else F.lit(0)), "places")
    length = F.col("words") / F.col("n")
    again = place.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("from", F.col("start") + F.col("epoch") * F.col("source_size")).where("from < words")
    first = F.greatest(F.floor(F.col("from") / length) - 1, F.lit(0))
    final = F.least(F.floor((F.col("from") + F.col("size")) / length) + 1, F.col("n") - 1)
    pieces = again.withColumn("k", F.explode(F.sequence(first, final)))
    bound = lambda k: F.when(k >= F.col("n"), F.col("words")).otherwise(F.floor(k * length))
    pieces = pieces.withColumn("first_word", F.greatest(F.lit(0), bound(F.col("k")) - F.col("from"))).withColumn("last_word", F.least(F.col("size"), bound(F.col("k") + 1) - F.col("from"))).where("first_word < last_word")
    keyed = ranked.select("slot", F.col("sid").alias("s"), "rank")
    schedule = pieces.join(keyed, (F.col("sid") == F.col("s")) & (F.col("k") == F.col("rank"))).select("slot", "rank", "source", "doc_id", "row", "epoch", "first_word", "last_word")
    used = schedule.select("row", "slot", (F.col("last_word") - F.col("first_word")).alias("words")).groupBy("row")
    used = used.agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.size(F.collect_set("slot")).alias("slots")).withColumnRenamed("row", "r")
    documents = place.join(used, F.col("row") == F.col("r"), "left").select("row", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", F.coalesce("slots", F.lit(0)).cast("long").alias("slots"))
    return documents, schedule


def op6_golden_ratio_mix(spark, sf_dir):
    from .common import table

    return mix(table(spark, sf_dir, "documents"))[0].select("doc_id", "size", "source_size", "target", "taken", "first_slot", "slots")
