"""A training-data pipeline over `documents`: quality, near-duplicates, benchmark leaks, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. Rows keep the columns of documents until the last stage, which returns the token table; further columns,
however named, drop out. Nulls, empty tables and repeated rows are as each stage says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeflow.llm.common import crc_mod, documents, pick, staged, table
from lodeflow.llm.mixing import mix
from lodeflow.llm.near_dedup import near_duplicates
from lodeflow.llm.quality import fit, keep_good
from lodeflow.llm.token_files import token_table
from lodeflow.llm.winnowing import SMALL, decontaminate


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects (score under 0.3) go; empty ones are scored like any other."""
    docs = documents(docs)
    labels = pick(table(spark, sf_dir, "labels"), doc_id="doc_id", quality="quality")
    model = fit(docs.where(crc_mod("doc_id", 5) != 0), labels.where(crc_mod("doc_id", 5) != 0))
    return keep_good(docs, model)


def _keyed(docs: DataFrame) -> DataFrame:
    return documents(docs).withColumn("hash_", F.xxhash64("text"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest doc_id; of repeated rows, one.

    Shingles are of two words, as this operator's contract has it. Rows that share an id but not a text are documents of
    their own. Rows without doc_id are in no group and stay; so do documents without words.
    """
    docs = _keyed(docs)
    kept = near_duplicates(docs, k=2).where("chosen and doc_id is not null").select(F.col("doc_id").alias("kept_id"), "text_hash").distinct().hint("merge")
    found = docs.join(kept, (docs["doc_id"] == F.col("kept_id")) & (docs["hash_"] == F.col("text_hash")), "left_semi").dropDuplicates(["doc_id", "hash_"])
    return found.unionByName(docs.where(docs["doc_id"].isNull())).drop("hash_")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    docs = _keyed(docs)
    leaked = decontaminate(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0").select(F.col("doc_id").alias("leaked"), "text_hash").distinct()
    leaked = staged(leaked, "leaked")
    few = F.broadcast(leaked) if leaked.count() <= SMALL else leaked
    return docs.join(few, docs["doc_id"].eqNullSafe(F.col("leaked")) & docs["hash_"].eqNullSafe(F.col("text_hash")), "left_anti").drop("hash_")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mix's schedule: each stands where the slot of its first block does.

    A document is there once for each epoch in which the mix takes at least half of its words, so as often as taken / size,
    rounded. Rows are told apart by their place in docs, which is read twice: it has to be a table of files, as between
    stages. Wordless documents go; rows without doc_id, of a shared one and repeated ones are documents each for itself.
    """
    docs = documents(docs).withColumn("row_", F.monotonically_increasing_id())
    schedule = mix(docs, row_col="row_")[1]
    own = schedule.groupBy(F.col("row").alias("own_"), "epoch").agg(F.min("slot").alias("slot_"), F.sum(F.col("last_word") - F.col("first_word")).alias("words_"))
    size = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    taken = docs.join(own, F.col("row_") == F.col("own_")).where(2 * F.col("words_") >= size)
    return taken.orderBy("slot_", "row_", "epoch").select(*[docs[c] for c in docs.columns if c != "row_"])


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token file of the mix, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_table(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-ID / binary output", token_stage),
]
#: Compression sizes and tokenizer ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, f"stage{k}")
    return docs
