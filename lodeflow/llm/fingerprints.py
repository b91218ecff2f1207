"""Document fingerprints by consistent weighted sampling, as DataFrame expressions; the joint estimate over BLOCKS blocks
approximates generalised Jaccard similarity, while the plain collision rate of two fingerprints equals it with one block only.

A document is its words with their counts as weights. Each of SAMPLES samples draws, for every word, two Gamma(2, 1)
variates r and c and a uniform b which depend on the word and the sample alone; with weight w, t = floor(ln w / r + b),
ln y = r (t - b), and the word's value is ln c - ln y - r. The sample of a document is the (word, t) of least value. Two
documents' samples agree with a chance of their generalised Jaccard similarity, sum of min(w, w') over sum of max(w, w').

Words are dealt into BLOCKS blocks by their hashes, and each block has SAMPLES samples of its own words, so that a word is
drawn SAMPLES times, once for each of its block's samples with its whole count as weight. A fingerprint also holds each
block's sum of weights, W. The share s of a block's samples that agree estimates the block's similarity; as its sums of
minima and maxima add up to W + W', its sum of maxima is (W + W') / (1 + s), and s times that is its sum of minima. Both
are added over the blocks: the similarity of the whole, however unevenly the blocks weigh. blocks=1 draws every word for
every sample: then the collision rate itself is the estimate, at so much more work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, staged

BLOCKS, SAMPLES = 8, 16
#: Neighbouring ids which stand in one group, for the step from a document to the next one.
GROUP = 64


def _uniform(bits: Column) -> Column:
    """In (0, 1), of an integer of 32 bits."""
    return (bits.cast("double") + 0.5) / float(1 << 32)


def _gamma(h: Column) -> Column:
    """Gamma(2, 1): the two halves of a 64-bit hash give two exponential variates."""
    return -F.log(_uniform(F.shiftrightunsigned(h, 32)) * _uniform(h.bitwiseAND(F.lit(0xFFFFFFFF))))


def sample(word: Column, log_weight: Column, number: Column) -> Column:
    """A word's value and identity in a sample, in one 64-bit integer: the value in the high bits, 32 bits of identity
    (of word and t) below."""
    r, c = _gamma(F.xxhash64(word, number, F.lit(1))), _gamma(F.xxhash64(word, number, F.lit(2)))
    b = _uniform(F.xxhash64(word, number, F.lit(3)).bitwiseAND(F.lit(0xFFFFFFFF)))
    t = F.floor(log_weight / r + b)
    value = F.log(c) - r * (t - b) - r
    rank = F.greatest(F.lit(0), F.least(F.lit((1 << 30) - 1), ((value + 64) * float(1 << 22)).cast("long")))
    return F.shiftleft(rank, 32).bitwiseOR(F.xxhash64(word, t).bitwiseAND(F.lit(0xFFFFFFFF)))


def fingerprint(texts: DataFrame, keys: list[str], facts: list[str], blocks: int = BLOCKS, samples: int = SAMPLES) -> DataFrame:
    """keys, facts, text -> keys, facts, block, weight, s0...: the samples of each text, a row for each block with words.

    Words are runs without white space, A-Z as they are; wordless texts have no rows. facts are columns that the keys
    determine. If texts are partitioned by some of the keys, nothing is shuffled.
    """
    words = texts.select(*keys, *facts, F.explode(F.split("text", r"[ \t\n\x0B\f\r]+")).alias("w")).where("w <> ''")
    counts = words.select(*keys, *facts, F.xxhash64("w").alias("word")).groupBy(*keys, *facts, "word").agg(F.count("*").alias("n"))
    block = F.pmod(F.xxhash64("word", F.lit(0)), F.lit(blocks)).cast("int")
    placed = counts.select(*keys, *facts, "word", "n", F.log("n").alias("lw"), block.alias("block"))
    least = [F.min(sample(F.col("word"), F.col("lw"), F.lit(i))).alias(f"s{i}") for i in range(samples)]
    return placed.groupBy(*keys, *facts, "block").agg(F.sum("n").alias("weight"), *least)


def as_print(found: Column, blocks: int = BLOCKS, samples: int = SAMPLES) -> Column:
    """An array of (block, weight, codes) as a fingerprint: struct of weights, one for each block, and codes of 16 bits,
    `samples` for each; 0 and -1 where a block has no words."""
    slots = F.transform(F.array(*map(F.lit, range(blocks))), lambda g: F.get(F.filter(found, lambda b: b["block"] == g), F.lit(0)))
    weights = F.transform(slots, lambda b: F.coalesce(b["weight"], F.lit(0)))
    codes = F.flatten(F.transform(slots, lambda b: F.coalesce(b["codes"], F.array_repeat(F.lit(-1), samples))))
    return F.struct(weights.alias("weights"), codes.alias("codes"))


def likeness(a: Column, b: Column, blocks: int = BLOCKS, samples: int = SAMPLES) -> Column:
    """The estimated generalised Jaccard similarity of two fingerprints; 1 for two empty ones, 0 for one."""
    least = most = F.lit(0.0)
    for g in range(blocks):
        own, other = (F.slice(x["codes"], g * samples + 1, samples) for x in (a, b))
        s = F.size(F.filter(F.zip_with(own, other, lambda x, y: (x == y) & (x >= 0)), lambda e: e)) / samples
        top = (F.get(a["weights"], F.lit(g)) + F.get(b["weights"], F.lit(g))) / (1 + s)
        least, most = least + s * top, most + top
    return F.when(most == 0, 1.0).otherwise(F.least(least / most, F.lit(1.0)))


def as_text(a: Column) -> Column:
    """The weights in hex digits, then four hex digits for each sample of a block with words; empty for a wordless text."""
    weights = F.array_join(F.transform(a["weights"], lambda v: F.lower(F.hex(v))), ".")
    codes = F.array_join(F.transform(F.filter(a["codes"], lambda v: v >= 0), lambda v: F.lower(F.lpad(F.hex(v), 4, "0"))), "")
    return F.when(F.exists(a["weights"], lambda w: w > 0), F.concat(weights, F.lit("-"), codes)).otherwise("")


def with_next(rows: DataFrame, at: str, order: list[str], value: str, out: str) -> DataFrame:
    """Add out: value of the next row in the order, after the last that of the first. at: numbers of groups of neighbours.

    Groups are windows of their own; only each group's first row also goes to the group before. Which group that is comes
    from a range-sorted table of the groups' numbers: windows over each range, and one over a row for each range.
    """
    inside = Window.partitionBy(at).orderBy(*order)
    marked = rows.withColumn("last_", F.lead(F.lit(1)).over(inside).isNull()).withColumn(out, F.lead(value).over(inside))
    heads = rows.withColumn("k_", F.row_number().over(inside)).where("k_ = 1").select(F.col(at).alias("g_"), F.col(value).alias("head_"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = rows.select(F.col(at).alias("g_")).distinct().repartitionByRange(n, "g_")
    ids = staged(ids.withColumn("range_", F.spark_partition_id()), "groups")
    within, over = Window.partitionBy("range_").orderBy("g_"), Window.orderBy("range_")
    ranges = ids.groupBy("range_").agg(F.min("g_").alias("low_"))
    following = ranges.select(F.col("range_").alias("r_"), F.coalesce(F.lead("low_").over(over), F.min("low_").over(Window.partitionBy())).alias("after_"))
    before = ids.join(following, F.col("range_") == F.col("r_")).select(F.col("g_").alias("to_"), F.coalesce(F.lead("g_").over(within), F.col("after_")).alias("next_"))
    entering = heads.join(before, F.col("g_") == F.col("next_")).select("to_", "head_")
    joined = marked.join(entering, (F.col(at) == F.col("to_")) & F.col("last_"), "left")
    return joined.withColumn(out, F.when(F.col("last_"), F.col("head_")).otherwise(F.col(out))).drop("last_", "to_", "head_")


def edited_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """near, place, doc_id, text, edited: each text, and with its last half replaced by as much of the next document.

    (near, place) numbers the rows: neighbouring ids share near. The order is by doc_id, nulls first, then by the text's
    hash; rows without an id share near by that hash. The result is partitioned by near.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("hash_", F.xxhash64("text"))
    number = F.coalesce(F.floor(F.col("doc_id") / GROUP), F.shiftright("hash_", 44) - (1 << 62))
    n = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("near", number).drop("hash_").repartition(n, "near")
    inside = Window.partitionBy("near").orderBy("doc_id", "hash_", "text")
    rows = rows.withColumn("hash_", F.xxhash64("text")).withColumn("place", F.row_number().over(inside)).drop("hash_")
    half = F.floor(F.char_length("text") / 2).cast("int")
    kept = F.char_length("text") - half
    edited = F.concat(F.substring("text", F.lit(1), kept), F.substring("next", F.lit(1), half))
    return with_next(rows, "near", ["place"], "text", "next").select("near", "place", "doc_id", "text", edited.alias("edited"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", blocks: int = BLOCKS, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row.

    Defined cases: a null text is empty; empty and wordless texts have the empty fingerprint, which is wholly like another
    empty one only; rows of one id follow each other, in the order of their texts' hashes, and repeated rows (ties) in any;
    a lone document is its own next one; a very long text is one row, its words are aggregated like any others; other
    columns, however named, are not read; an empty table gives none.
    """
    texts = edited_texts(docs, id_col, text_col)
    # texts are gone through once: each gives its words, those of the edited text, and one row with the facts
    fact = F.concat_ws(",", F.char_length("text").cast("string"), F.sha2("edited", 256), F.col("doc_id").cast("string"))
    kinds = [(0, F.col("text"), F.lit(None).cast("string")), (1, F.col("edited"), F.lit(None).cast("string")), (2, F.lit("-"), fact)]
    each = texts.select("near", "place", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), t.alias("text"), f.alias("fact")) for k, t, f in kinds])).alias("t"))
    prints = fingerprint(each.select("near", "place", "t.*"), ["near", "place", "kind"], ["fact"], blocks, samples)
    codes = F.array(*[F.col(f"s{i}").bitwiseAND(F.lit(0xFFFF)).cast("int") for i in range(samples)])
    own = lambda kind: as_print(F.collect_list(F.when(F.col("kind") == kind, F.struct("block", "weight", codes.alias("codes")))), blocks, samples)
    whole = prints.groupBy("near", "place").agg(own(0).alias("print"), own(1).alias("edited_print"), F.max("fact").alias("fact"))
    parts = F.split("fact", ",")
    doc_id = F.get(parts, F.lit(2)).cast(docs.schema[id_col].dataType if id_col in docs.columns else "long")
    facts = [doc_id.alias("doc_id"), F.get(parts, F.lit(0)).cast("long").alias("n_chars"), F.get(parts, F.lit(1)).alias("edited_sha256")]
    joined = staged(whole.select("near", "place", "print", "edited_print", *facts), "prints")
    out = with_next(joined, "near", ["place"], "print", "next_print")
    return out.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("print")).alias("fingerprint"), as_text(F.col("edited_print")).alias("edited_fingerprint"), likeness(F.col("print"), F.col("edited_print"), blocks, samples).alias("near_edited"), likeness(F.col("print"), F.col("next_print"), blocks, samples).alias("near_next"))


def op2_weighted_sampling(spark, sf_dir):
    from .common import table

    return fingerprint_edits(table(spark, sf_dir, "documents"))
