"""Near-duplicate groups by min-max hashing: both extremes of each permutation go into the signature.

One evaluation of a permutation gives two signature places (its minimum and its maximum), so a signature of 2p places
costs p evaluations. Bands of places become bucket keys; documents that share a bucket are candidates, and each
candidate link is confirmed on the full shingle sets.

Documents with equal sets form one class, which the smallest doc_id stands for. In a bucket, members are first compared
with its smallest and its largest member only (a star, not all pairs). What the confirmed links join needs no more
comparing. Members of buckets that still hold several components are the open ones: among these, an exact join on prefixes
finds every link that is left. Shingles have one order, rare ones first; two sets with 100 * intersection >= percent *
union must share one among the first n - ceil(p n) + 1 of the larger set and the first n - ceil(2 p n / (1 + p)) + 1 of
the smaller one (p = percent / 100), whatever else they share, so what very many texts have in common brings no pairs.
Pairs so found are confirmed only if sizes and odd sketches allow a link: the sketch holds the parity of the number of set
members in each of its bins, so two sketches differ in no more bits than their sets have members apart, and no link is
lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed, mix, parts_of, pick, staged, utf8
from .components import components

PERMUTATIONS, BANDS, SKETCH, BINS = 48, 24, 1024, 1 << 18
CHUNK = 1_500_000


def _shingles(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted set of k-word shingle hashes of each text; fewer words: the whole sequence as one; none: empty."""
    words = [t.lower().split() for t in texts]
    flat = hashed([w for ws in words for w in ws])
    out, at = [], 0
    for ws in words:
        h, n = flat[at : at + len(ws)], len(ws)
        at += n
        width = min(k, n)
        if not n:
            out.append(np.empty(0, np.uint64))
            continue
        x = np.full(n - width + 1, np.uint64(width))
        for i in range(width):
            x = mix(x * np.uint64(0x9E3779B97F4A7C15) + h[i : n - width + 1 + i])
        out.append(np.unique(x))
    return out


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240117).integers(0, 2**63, (2, PERMUTATIONS), dtype=np.int64).astype(np.uint64)
    return draw[0] * np.uint64(2) + np.uint64(1), draw[1]


def _bands(sets: list[np.ndarray]) -> np.ndarray:
    """A key for each set (none empty) and band; a band takes both extremes of PERMUTATIONS / BANDS permutations."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    a, b = _multipliers()
    per = PERMUTATIONS // BANDS
    keys = np.empty((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(sets), np.uint64(band + 1))
        for p in range(band * per, band * per + per):
            v = mix(flat * a[p] + b[p]) if p == 0 else flat * a[p] + b[p]
            v = v ^ (v >> np.uint64(32))
            v = v * np.uint64(0xD6E8FEB86659FD93)
            for extreme in (np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts)):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + extreme)
        keys[:, band] = key
    return keys


def _odd_sketch(members: np.ndarray) -> np.ndarray:
    """The parity of the number of members in each of SKETCH bins, as 64-bit words."""
    odd = np.bincount((members >> np.uint64(13)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, text_hash, text) -> (doc_id, text_hash, n_shingles, set_key, bands, odd); the last two are null where the set is empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts_of(batches, CHUNK):
            sets = _shingles([utf8(t) for t in part["text"]], k)
            full = [s for s in sets if len(s)]
            keys = iter(_bands(full).view(np.int64)) if full else iter(())
            yield pd.DataFrame(
                {
                    "doc_id": part["doc_id"],
                    "text_hash": part["text_hash"],
                    "n_shingles": [len(s) for s in sets],
                    "set_key": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                    "bands": [next(keys) if len(s) else None for s in sets],
                    "odd": [_odd_sketch(s) if len(s) else None for s in sets],
                }
            )

    return docs.mapInPandas(run, "doc_id long, text_hash long, n_shingles long, set_key binary, bands array<long>, odd array<long>")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts_of(batches, CHUNK):
            yield pd.DataFrame({"node": part["node"], "members": [s.view(np.int64) for s in _shingles([utf8(t) for t in part["text"]], k)]})

    return docs.mapInPandas(run, "node long, members array<long>")


def _allowed(percent: int, na: str, nb: str, oa: str, ob: str):
    """Whether sizes and odd sketches allow a link: a necessary condition, never false for a link."""
    apart = F.lit(0)
    for i in range(SKETCH // 64):
        apart = apart + F.bit_count(F.get(oa, F.lit(i)).bitwiseXOR(F.get(ob, F.lit(i))))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (apart * (100 + percent) <= (100 - percent) * (F.col(na) + F.col(nb)))


def _likely(pairs: DataFrame, standing: DataFrame, percent: int) -> DataFrame:
    left, right = (standing.select(F.col("node").alias(f"{s}_"), F.col("n").alias(f"n{s}"), F.col("odd").alias(f"o{s}")) for s in "ab")
    return pairs.join(left, F.col("a") == F.col("a_")).join(right, (F.col("b") == F.col("b_")) & _allowed(percent, "na", "nb", "oa", "ob")).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough."""
    left, right = (sets.select(F.col("node").alias(f"{s}_"), F.col("members").alias(f"m{s}")) for s in "ab")
    both = pairs.join(left, pairs["a"] == F.col("a_")).join(right, F.col("b") == F.col("b_"))
    shared = F.size(F.array_intersect("ma", "mb"))
    return both.withColumn("s_", shared).where(F.col("s_") * 100 >= percent * (F.size("ma") + F.size("mb") - F.col("s_"))).select("a", "b")


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How often shingles fall into each of BINS bins: an order of shingles, rare ones first. The driver gets BINS rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(BINS, np.int64)
        for batch in batches:
            for members in batch["members"]:
                seen += np.bincount(_bin(np.asarray(members)), minlength=BINS)
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"bin": at, "n": seen[at]})

    out = np.zeros(BINS, np.int64)
    for r in sets.select("members").mapInPandas(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        out[r["bin"]] = r["n"]
    return out


def _bin(members: np.ndarray) -> np.ndarray:
    return (members.view(np.uint64) >> np.uint64(40)).astype(np.int64) % BINS


def _prefixes(open_sets: DataFrame, percent: int) -> DataFrame:
    """(node, members, part, n, odd) -> (shingle, node, part, n, odd, inner): the first shingles of each set; inner marks
    those by which a set is found as the smaller one of two."""
    often = open_sets.sparkSession.sparkContext.broadcast(_frequencies(open_sets))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                members = np.asarray(row.members)
                n = len(members)
                first = members[np.lexsort((members, often.value[_bin(members)]))[: n - -(-percent * n // 100) + 1]]
                inner = n - -(-2 * percent * n // (100 + percent)) + 1
                yield pd.DataFrame({"shingle": first, "node": row.node, "part": row.part, "n": n, "odd": [row.odd] * len(first), "inner": np.arange(len(first)) < inner})

    return open_sets.mapInPandas(run, "shingle long, node long, part long, n long, odd array<long>, inner boolean")


def _rest(shared: DataFrame, links: DataFrame, standing: DataFrame, sets: DataFrame, percent: int, exact: bool) -> DataFrame:
    """The links between different components of the given links, among nodes of buckets that hold several components; exact: among all nodes."""
    parts = components(links).withColumnRenamed("node", "node_")
    if exact:
        every = standing.select("node").join(parts, F.col("node") == F.col("node_"), "left")
        nodes = staged(every.select(F.col("node").alias("node_"), F.coalesce("component", "node").alias("part")), "open")
        return _joined(nodes, standing, sets, percent)
    placed = staged(shared.select("bucket", "node").join(parts, F.col("node") == F.col("node_"), "left").select("bucket", "node", F.coalesce("component", "node").alias("part")), "placed")
    several = staged(placed.groupBy(F.col("bucket").alias("at")).agg(F.min("part").alias("p0"), F.max("part").alias("p1")).where("p0 < p1").select("at"), "several")
    nodes = staged(placed.join(several, F.col("bucket") == F.col("at"), "left_semi").select(F.col("node").alias("node_"), "part").distinct(), "open")
    return _joined(nodes, standing, sets, percent)


def _joined(nodes: DataFrame, standing: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All links between nodes (node_) of different parts, by the exact join on prefixes."""
    known = standing.select(F.col("node").alias("own"), "odd")
    held = staged(sets.join(nodes, F.col("node") == F.col("node_")).join(known, F.col("node") == F.col("own")).select("node", "members", "part", "odd"), "held")
    firsts = staged(_prefixes(held, percent), "prefixes")
    larger, smaller = (firsts.select(*[F.col(c).alias(f"{c}{s}") for c in ("shingle", "node", "part", "n", "odd", "inner")]) for s in "ab")
    # the smaller set is b; of equal ones, the larger node
    order = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("nodea") < F.col("nodeb")))
    pairs = larger.join(smaller.where("innerb"), (F.col("shinglea") == F.col("shingleb")) & (F.col("parta") != F.col("partb")) & order & _allowed(percent, "na", "nb", "odda", "oddb"))
    return _confirmed(staged(pairs.select(F.col("nodea").alias("a"), F.col("nodeb").alias("b")).distinct(), "pairs"), sets, percent)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", exact: bool = False) -> DataFrame:
    """For each row: doc_id, n_shingles (its set's size), component_id (the smallest doc_id reachable over links), kept
    (whether that is its own), text_hash, group (a number that a component's rows share), chosen (whether its text is the
    one that stands for the group).

    Two documents link if 100 * intersection >= percent * union of their sets of k-word shingles (A-Z lower-cased, words
    split at ASCII white space). A link of two texts that share no bucket, and of which one is in no bucket with several
    components, is missed: at similarity 0.8 this has a chance of about 3e-6, and of 2e-5 for sets of five shingles.
    `exact` takes all distinct sets through the join on prefixes, so none is missed; it shuffles a fifth of all shingles.

    Defined cases: a null, empty or wordless text has an empty set and links with nothing; a
    row without doc_id links with nothing and has no component (kept: true); repeated rows each get a result; rows that
    share a doc_id but not a text are documents of their own; equal sets (ties) fall to the smallest doc_id; a very long
    text is one set in one task; other columns, however named, are not read; an empty table gives an empty result.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    signed = staged(signatures(rows, k), "signatures")
    usable = signed.where("doc_id is not null and n_shingles > 0")
    first = F.min(F.struct("doc_id", "text_hash")).alias("chosen")
    classes = usable.groupBy("set_key").agg(first, F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands"), F.any_value("odd").alias("odd"))
    classes = staged(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    members = classes.select("node", F.explode("bands").alias("bucket"))
    stars = staged(members.groupBy(F.col("bucket").alias("at")).agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high"), "stars")
    shared = staged(members.join(stars, F.col("bucket") == F.col("at")).select("bucket", "node", "low", "high"), "buckets")
    wanted = shared.select(F.col("node").alias("want")).distinct()
    wanted = classes if exact else classes.join(wanted, F.col("node") == F.col("want"))
    wanted = wanted.select("node", "chosen.*").toDF("node", "own", "own_hash")
    texts = rows.join(wanted.hint("merge"), (F.col("doc_id") == F.col("own")) & (F.col("text_hash") == F.col("own_hash"))).select("node", "text").dropDuplicates(["node"])
    sets = staged(_sets(texts, k), "sets")
    ends = F.explode(F.array(F.struct(F.col("low").alias("a"), F.col("node").alias("b")), F.struct(F.col("node").alias("a"), F.col("high").alias("b"))))
    pairs = shared.select(ends.alias("p")).select("p.*").where("a < b").distinct()
    links = staged(_confirmed(_likely(pairs, classes, percent), sets, percent), "confirmed")
    more = _rest(shared, links, classes, sets, percent, exact)
    final = components(links.union(more)).toDF("node_", "root_")
    placed = classes.join(final, F.col("node") == F.col("node_"), "left").select("set_key", "chosen", F.coalesce("root_", "node").alias("group"))
    placed = staged(placed, "placed")
    least = staged(placed.groupBy(F.col("group").alias("g_")).agg(F.min("chosen").alias("first")), "first")
    named = staged(placed.join(least, F.col("group") == F.col("g_")).select(F.col("set_key").alias("own"), "group", "first"), "named")
    out = signed.join(named, (F.col("set_key") == F.col("own")) & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce("first.doc_id", "doc_id")
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    chosen = F.coalesce((F.col("doc_id") == F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash")), F.lit(True))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "text_hash", "group", chosen.alias("chosen"))


def op8_minmax_near_dedup(spark, sf_dir):
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
        ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM w),
g AS (SELECT min(doc_id) AS node, sh, len(sh) AS n FROM (SELECT doc_id, list_sort(sh) AS sh FROM s) GROUP BY sh),
e AS (SELECT node, n, unnest(sh) AS x FROM g),
f AS (SELECT x, count(*) AS df FROM e GROUP BY x),
p AS (SELECT node, n, x FROM (SELECT e.*, row_number() OVER (PARTITION BY node ORDER BY df, e.x) AS k FROM e JOIN f USING (x)) WHERE k <= n - (4 * n + 4) // 5 + 1),
c AS (SELECT DISTINCT a.node AS a, b.node AS b FROM p a JOIN p b ON a.x = b.x AND a.node < b.node AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
i AS (SELECT c.a, c.b, len(list_intersect(x.sh, y.sh)) AS k, x.n AS na, y.n AS nb FROM c JOIN g x ON x.node = c.a JOIN g y ON y.node = c.b),
l AS (SELECT a, b FROM i WHERE 100 * k >= 80 * (na + nb - k)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT node AS a, node AS b FROM g WHERE n > 0 UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
t AS (SELECT a, min(b) AS component FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(t.component, s.doc_id) AS component_id, coalesce(t.component, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN g ON list_sort(s.sh) = g.sh AND len(s.sh) > 0 LEFT JOIN t ON t.a = g.node
"""
