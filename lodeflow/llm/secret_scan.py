"""Secret scans with corpus-wide ownership frequency, as DataFrame expressions.

Three patterns give the base spans. The values they hold, and other long tokens of mixed characters, are candidates;
each candidate's hash is counted over distinct repositories and owners of the whole corpus. One that many owners carry
is a copied example. One that few owners carry and that looks live (mixed characters, no placeholder words) gets a span
of its own, of kind `live`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, pick, staged

#: Kinds in their order, patterns, and the group and least length that count.
KINDS = ("assign", "access", "hex", "live")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (("assign", ASSIGN, 2, 6), ("access", r"AKIA[A-Z0-9]{16,}", 0, 20), ("hex", r"[0-9a-f]{24,}", 0, 24))
OTHER = r"[A-Za-z0-9+/_-]{20,}"
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|your|xxxx|test|0123456789|abcdef0123|(.)\1{5}"
OWNERS, REPOSITORIES, VARIETY = 2, 3, 10
#: Matches whose lengths are summed at once.
BLOCK = 64
SPAN = "array<struct<start: int, rank: int, stop: int, value: string, at: int>>"


def _stops(lengths: Column) -> Column:
    """Running sums. Those over blocks of BLOCK lengths first, then inside each: an array that grew with each length would
    be copied as often."""
    blocks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int"))
    total = lambda acc, x: acc + x
    zero = F.lit(0)
    sums = F.transform(blocks, lambda b: F.aggregate(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)), zero, total))
    before = F.aggregate(sums, F.array(zero), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    return let(before, lambda own: F.transform(lengths, lambda _, i: F.get(own, F.floor(i / BLOCK).cast("int")) + F.aggregate(F.slice(lengths, i - i % BLOCK + 1, i % BLOCK + 1), zero, total)))


def _found(text: Column, rank: int, pattern: str, group: int, least: int) -> Column:
    """All matches with their places: text between matches comes from splitting by the same pattern, lengths add up."""

    def placed(m: Column) -> Column:
        between = F.split(text, pattern, -1)
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else m
        lengths = let(between, lambda b: F.transform(m, lambda x, i: F.char_length(F.get(b, i)) + F.char_length(x)))

        def build(stops: Column, v: Column) -> Column:
            def span(x: Column, i: Column) -> Column:
                stop, value = F.get(stops, i), F.get(v, i)
                return F.struct((stop - F.char_length(x)).alias("start"), F.lit(rank).alias("rank"), stop.alias("stop"), value.alias("value"), (stop - F.char_length(value)).alias("at"))

            return F.transform(m, span)

        spans = let(let(lengths, _stops), lambda stops: let(values, lambda v: build(stops, v)))
        return F.when(F.size(m) == 0, F.array().cast(SPAN)).otherwise(F.filter(spans, lambda s: F.char_length(s["value"]) >= least))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def looks_live(value: Column) -> Column:
    kinds = reduce(lambda a, b: a + b, [value.rlike(c).cast("int") for c in ("[0-9]", "[a-z]", "[A-Z]")])
    variety = F.size(F.array_distinct(F.split(value, "")))
    return (kinds >= 2) & value.rlike("[0-9]") & (variety >= VARIETY) & (F.char_length(value) >= 16) & ~value.rlike(PLACEHOLDER)


def _once(spans: Column) -> Column:
    """The distinct ones, sorted; array_distinct compares all pairs of structs."""
    return let(F.array_sort(spans), lambda s: F.filter(s, lambda x, i: (i == 0) | (x != F.get(s, i - 1))))


def _named(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "repository", owner_col: str = "owner") -> tuple[DataFrame, DataFrame]:
    """The scan of each row, and the candidates' ownership counts.

    scan: doc_id, n_assign, n_access, n_hex, base, spans (kind:start:end in code points, end exclusive, by start, then by
    KINDS). candidates: hash (SHA-256 of the value), owners, repositories, live. A null or empty text has no spans; null
    owners and repositories count as one; repeated rows each get a scan, with the same spans; an empty table gives none.
    A very long text is scanned whole, by one task; its spans are arrays in its row, and work grows in step with its matches
    but for one addition for each BLOCK of them. Ties: spans that start together stand in the order of KINDS. Only the named
    columns are read, so others may have any name.
    """
    rows = pick(docs, doc_id=id_col, text=text_col, repository=repository_col, owner=owner_col).withColumn("text", F.coalesce("text", F.lit("")))
    found = [_found(F.col("text"), k, pattern, group, least).alias(f"s{k}") for k, (_, pattern, group, least) in enumerate(BASE)]
    scanned = rows.select("doc_id", "repository", "owner", *found, _found(F.col("text"), 3, OTHER, 0, 20).alias("s3"))
    seen = F.concat("s0", "s1", "s2", "s3")
    own = _once(F.transform(F.filter(seen, lambda s: looks_live(s["value"])), lambda s: F.struct(s["at"].alias("start"), s["stop"].alias("stop"), F.sha2(s["value"], 256).alias("hash"))))
    plain = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["stop"].alias("stop")))
    scanned = staged(scanned.select(F.monotonically_increasing_id().alias("row"), "doc_id", "repository", "owner", *[plain(F.col(f"s{k}")).alias(f"s{k}") for k in range(3)], own.alias("candidates")), "scan")
    candidates = scanned.select("row", "repository", "owner", F.explode("candidates").alias("c")).select("row", "repository", "owner", "c.*")
    counts = candidates.groupBy("hash", "owner", "repository").agg(F.count("*").alias("k")).groupBy("hash", "owner").agg(F.count("*").alias("r")).groupBy("hash").agg(F.count("*").alias("owners"), F.sum("r").alias("repositories"))
    counts = staged(counts.withColumn("live", (F.col("owners") <= OWNERS) & (F.col("repositories") <= REPOSITORIES)), "candidates")
    live = candidates.join(counts.where("live").select(F.col("hash").alias("h")), F.col("hash") == F.col("h"))
    live = live.groupBy("row").agg(F.collect_set(F.struct("start", F.lit(3).alias("rank"), "stop")).alias("more")).withColumnRenamed("row", "r")
    out = scanned.join(live, F.col("row") == F.col("r"), "left")
    base = F.concat("s0", "s1", "s2")
    counted = [F.size(f"s{k}").cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    every = F.concat(base, F.coalesce("more", F.array().cast("array<struct<start: int, rank: int, stop: int>>")))
    return out.select("doc_id", *counted, _named(base).alias("base"), _named(every).alias("spans")), counts


def op4_secret_ownership(spark, sf_dir):
    """Owners are the documents' sources, repositories a source's languages."""
    from .common import table

    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text", lang="lang", owner="source")
    scan, _ = scan_secrets(docs.withColumn("repository", F.concat_ws("/", "owner", "lang")))
    return scan.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
