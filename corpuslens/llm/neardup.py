"""Near-duplicate documents by SetSketch registers.

Each document's set of word shingles is sketched by M registers. Register i is floor(1 - log_b h), where h is the
smallest of the shingles' exponential variates of rate A, truncated to 0..Q+1: exponentially spaced truncated minima.
Sketches of parts merge by the maximum, which is how long texts are sketched piece by piece, and the share of equal
registers grows with the Jaccard similarity, so that bands of registers are bucket keys.

1. Documents with equal sets form a class (equal fingerprints and sizes of the sets); its smallest document stands for it.
2. Representatives that agree in a band share a bucket. In each bucket, all are paired with the smallest one.
3. The similarity of a pair is estimated jointly from which registers are larger, smaller and equal, by maximum
   likelihood with the known set sizes; pairs clearly below the threshold go. The others are verified on full sets.
4. Linked pairs are contracted to components. Members of one bucket that are still in different components are
   compared, all with all, block by block, by the same estimate; clusters of components found close that way are
   compared on full sets. No candidate is dropped, and in a bucket of copies nothing is left to compare.

A pair at the threshold is missed with a probability of a few in a million at most (see BANDS, MARGIN).

Defined results: null and empty texts and texts without words have an empty set and are linked with nothing; with
fewer words than a shingle has, the whole sequence is the one shingle. Repeated rows of one doc_id are one document
if their sets are equal, and rows with a null doc_id are never linked: they stand for themselves. Other columns are
not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import Scratch, bound_batches, hash_words, lower_ascii, mix, slices, text_buffer
from corpuslens.llm.components import connected_components

#: Sketch: base, rate and largest register value of 16-bit registers.
BASE, RATE, Q = 1.001, 20.0, 65534
#: Bands of ROWS registers each. At similarity 0.8 all bands differ with probability (1 - 0.8**6)**42 = 3e-6, at 0.85 with 2e-9.
ROWS, BANDS = 6, 42
M = ROWS * BANDS
#: Registers that are compared first; a pair is dropped if fewer of them are equal than at the threshold happens once in 1e8.
FIRST, RARELY = 64, 1e-8
#: An estimate's standard deviation is at most that of the share of equal registers; pairs over 5.7 of them below the
#: threshold (once in 1e8 at it) go unverified. So the three filters miss a pair at 0.85 with a probability of
#: 2e-9 + 1e-8 + 1e-8, at 0.8 of 3e-6 + 1e-8 + 1e-8.
MARGIN = 5.7
#: Documents of a bucket, and of a cluster, that are compared with each other in one block; edges that are verified against one text in one go.
BLOCK, CLUSTER, FAN = 512, 128, 64
#: Bytes of text that are hashed at a time (a longer text alone); hashing takes some 40 bytes for each.
PIECE = 1 << 18
#: Shingles of the documents of one block of a cluster; document ids (8 bytes each) that are broadcast at most.
SHINGLES, IDS = 500_000, 1_000_000

_rng = np.random.Generator(np.random.PCG64(71))
_MUL = (_rng.integers(0, 1 << 63, M, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 64, M, dtype=np.uint64)


@dataclass(frozen=True)
class Link:
    """What links two documents: k-word shingles, and a Jaccard similarity of at least per_cent / 100."""

    k: int = 5
    per_cent: int = 80


def shingle_sets(column, k: int) -> list[np.ndarray]:
    """For each text of an Arrow column, the sorted distinct 64-bit hashes of its k-word shingles; words are runs of other than ASCII white space, A-Z lower-cased."""
    sizes = np.asarray(pa.compute.binary_length(column).fill_null(0), np.int64)
    return [x for lo, hi in slices(sizes, PIECE) for x in _shingle_sets(column.slice(lo, hi - lo), k)]


def _shingle_sets(column, k: int) -> list[np.ndarray]:
    data, starts = text_buffer(column)
    data = lower_ascii(data)
    is_word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    is_word[starts[1:] - 1] = False
    at, h = hash_words(data, is_word)
    first = np.searchsorted(at, starts)
    out = []
    grams = np.zeros(max(len(h) - k + 1, 0), np.uint64)
    for i in range(k):
        grams = mix(grams ^ h[i : len(h) - k + 1 + i]) if len(grams) else grams
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        if hi - lo >= k:
            out.append(np.unique(grams[lo : hi - k + 1]))
        elif hi > lo:
            whole = np.full(1, hi - lo, np.uint64)
            for x in h[lo:hi]:
                whole = mix(whole ^ x)
            out.append(whole)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The registers of a non-empty set of hashes. Minima of pieces merge, so memory does not grow with the set."""
    least = np.full(M, np.iinfo(np.uint64).max)
    for lo in range(0, len(shingles), 512):
        v = np.multiply.outer(_MUL, shingles[lo : lo + 512])
        v += _ADD[:, None]
        np.minimum(least, v.min(axis=1), out=least)
    variate = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(variate, 1e-300)) / math.log(BASE)), 0, Q + 1).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood estimates of the Jaccard similarities of pairs of sketches (rows of a and b) with known set sizes."""
    more, less = (a > b).sum(axis=1).astype(float), (a < b).sum(axis=1).astype(float)
    equal = a.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)
    scale = (BASE - 1) / BASE

    def p(x):
        return -np.log1p(-np.maximum(x, 0) * scale) / math.log(BASE)

    def likelihood(j):
        pa_, pb_ = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return more * np.log(pa_ + tiny) + less * np.log(pb_ + tiny) + equal * np.log(np.maximum(1 - pa_ - pb_, 0) + tiny)

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(30):  # the likelihood is concave in j
        x, y = lo + (hi - lo) * 0.382, lo + (hi - lo) * 0.618
        left = likelihood(x) > likelihood(y)
        lo, hi = np.where(left, lo, x), np.where(left, y, hi)
    return (lo + hi) / 2


def least_equal(link: Link) -> int:
    """The most of FIRST registers that fewer than so many agree with a probability of at most RARELY at the threshold: a binomial quantile."""
    j, below, few = link.per_cent / 100, 0.0, 0
    while (below := below + math.comb(FIRST, few) * j**few * (1 - j) ** (FIRST - few)) <= RARELY:
        few += 1
    return few


def _least_estimate(link: Link) -> float:
    j = link.per_cent / 100
    return j - MARGIN * math.sqrt(j * (1 - j) / M)


def sketches(docs: DataFrame, link: Link) -> DataFrame:
    """doc_id, n (size of the set), f1 and f2 (fingerprint of the set), regs (null for an empty set) of each row."""
    k = link.k

    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column("text"), k)
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            with np.errstate(over="ignore"):
                f1 = np.fromiter((x.sum(dtype=np.uint64) for x in sets), np.uint64, len(sets)).view(np.int64)
                f2 = np.fromiter((mix(x ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64) for x in sets), np.uint64, len(sets)).view(np.int64)
            regs = pa.array([sketch(x).tobytes() if len(x) else None for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(f1), pa.array(f2), regs], ["doc_id", "n", "f1", "f2", "regs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, f1 long, f2 long, regs binary")


def _bands(reps: DataFrame) -> DataFrame:
    """doc, key: the bucket keys of each representative. Band number and registers are hashed to 64 bits; a clash only adds a candidate."""
    width = 2 * ROWS
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("regs", i * width + 1, width)) for i in range(BANDS)])
    return reps.select("doc", F.explode(keys).alias("key"))


def _judge(least: float):
    """Pairs (a, b, na, nb, ra, rb) whose estimate is high enough."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, M) for c in ("ra", "rb"))
            na, nb = (np.asarray(batch.column(c), np.float64) for c in ("na", "nb"))
            good = pa.array(estimate(ra, rb, na, nb) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(good) for c in ("a", "b")], ["a", "b"])

    return run


def _likely(pairs: DataFrame, reps: DataFrame, link: Link) -> DataFrame:
    """Distinct pairs (a, b) whose sizes allow a link and whose joint estimate is high enough."""
    left = reps.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    right = reps.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
    x = pairs.join(left, "a").join(right, "b").filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * link.per_cent)
    return x.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_judge(_least_estimate(link)), "a long, b long")


def _linked(x: np.ndarray, y: np.ndarray, link: Link) -> bool:
    small, large = (x, y) if len(x) < len(y) else (y, x)
    if not len(small):
        return False
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return both > 0 and 100 * both >= link.per_cent * (len(small) + len(large) - both)


def _verify_rows(link: Link):
    """Rows sorted by (a, part, b), the first of each (a, part) being a's own text (b null): pairs with 100 |I| >= per_cent |U|."""
    k = link.k

    def run(batches):
        key, own = None, []
        for batch in batches:
            sets, found = shingle_sets(batch.column("text"), k), []
            for a, part, b, x in zip(batch.column("a").to_pylist(), batch.column("part").to_pylist(), batch.column("b").to_pylist(), sets):
                if b is None:
                    own = [*own, x] if key == (a, part) else [x]
                    key = (a, part)
                    continue
                if key != (a, part):
                    raise RuntimeError(f"the text of document {a} is missing")
                if any(_linked(x, y, link) for y in own):
                    found.append((a, b))
            yield pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return run


def _verified(pairs: DataFrame, texts: DataFrame, link: Link) -> DataFrame:
    """The pairs that are linked, verified on full sets. A text that has many partners is sent out once for FAN of them."""
    texts = _some(texts, pairs.select(F.explode(F.array("a", "b")).alias("doc")))
    count = pairs.groupBy("a").agg(F.count("*").alias("fan"))
    split = pairs.join(count, "a").select("a", F.pmod(F.xxhash64("b"), F.ceil(F.col("fan") / FAN)).alias("part"), "b")
    own = count.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("fan") / FAN) - 1)).alias("part"))
    own = own.join(texts.withColumnRenamed("doc_id", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    other = split.join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "part", "b", "text")
    x = own.unionByName(other).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return x.mapInArrow(_verify_rows(link), "a long, b long")


def _groups(batches, key: list[str]):
    """Lists of the rows (dicts) of equal key, from batches sorted by it."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            k = tuple(row[c] for c in key)
            if held and k != now:
                yield held
                held = []
            now = k
            held.append(row)
    if held:
        yield held


def _sides(rows: list[dict]) -> tuple[list[dict], list[dict]]:
    """The two blocks of a block pair (side 0 and 1), or one block twice (side 2)."""
    if rows[0]["side"] == 2:
        return rows, rows
    return [r for r in rows if r["side"] == 0], [r for r in rows if r["side"] == 1]


def _near_pairs(first: list[dict], second: list[dict], least: float, link: Link):
    """(place in first, places in second) of rows of different roots with a high estimate."""
    if not first or not second:
        return
    ra, rb = (np.frombuffer(b"".join(r["regs"] for r in s), np.uint16).reshape(-1, M) for s in (first, second))
    na, nb = (np.array([r["n"] for r in s], float) for s in (first, second))
    qa, qb = (np.array([r["root"] for r in s], np.int64) for s in (first, second))
    fa, fb = np.ascontiguousarray(ra[:, :FIRST]), np.ascontiguousarray(rb[:, :FIRST])
    few = least_equal(link)
    for lo in range(0, len(first), 16):
        part = slice(lo, lo + 16)
        able = (np.minimum(na[part, None], nb) * 100 >= np.maximum(na[part, None], nb) * link.per_cent) & (qa[part, None] != qb)
        if second is first:
            able &= np.arange(len(second)) > np.arange(lo, min(lo + 16, len(first)))[:, None]
        able &= np.count_nonzero(fa[part, None, :] == fb[None, :, :], axis=2) >= few
        x, y = np.nonzero(able)
        if len(x):
            x += lo
            good = estimate(ra[x], rb[y], na[x], nb[y]) >= least
            yield from zip(x[good].tolist(), y[good].tolist())


class _Forest:
    """Which roots a block pair has joined so far, so that it returns no more links than it has roots."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _near_roots(least: float, link: Link):
    """Rows of block pairs of buckets to pairs of components that have members with a high estimate: a forest per block pair."""

    def run(batches):
        for rows in _groups(batches, ["key", "i", "j"]):
            first, second = _sides(rows)
            forest, out = _Forest(), []
            for x, y in _near_pairs(first, second, least, link):
                p, q = first[x]["root"], second[y]["root"]
                if forest.join(p, q):
                    out.append((min(p, q), max(p, q)))
            yield pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})

    return run


def _links_across(least: float, link: Link):
    """Rows of block pairs of clusters, with texts, to links between components: a forest per block pair, verified on full sets."""

    def run(batches):
        for rows in _groups(batches, ["cluster", "i", "j"]):
            sets = shingle_sets(pa.array([r["text"] for r in rows], pa.string()), link.k)
            for row, own in zip(rows, sets):
                row["set"] = own
            first, second = _sides(rows)
            forest, out = _Forest(), []
            for x, y in _near_pairs(first, second, least, link):
                p, q = first[x], second[y]
                if forest.find(p["root"]) != forest.find(q["root"]) and _linked(p["set"], q["set"], link):
                    forest.join(p["root"], q["root"])
                    out.append((min(p["doc"], q["doc"]), max(p["doc"], q["doc"])))
            yield pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})

    return run


def _block_pairs(x: DataFrame, key: str, blocks) -> DataFrame:
    """Each row once for each pair of blocks of its key that has its own block: i <= j, side."""
    x = x.withColumn("blocks", blocks.cast("int")).withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, "own").alias("i"), F.greatest(o, "own").alias("j"), F.when(o == F.col("own"), 2).when(o > F.col("own"), 0).otherwise(1).alias("side")))
    x = x.withColumn("p", F.explode(pair)).withColumn("i", F.col("p.i")).withColumn("j", F.col("p.j")).withColumn("side", F.col("p.side"))
    return x.drop("p", "own", "blocks")


def _left_over(bands: DataFrame, reps: DataFrame, roots: DataFrame, texts: DataFrame, link: Link, scratch: Scratch) -> DataFrame:
    """Links between components whose members share a bucket.

    First the buckets' registers tell which components are close; only a forest of them is returned. Clusters of close
    components are then compared with full sets, block by block, and again only a forest of links is returned. So rows
    that leave a task never outnumber those that enter it, whatever a bucket holds.
    """
    least = _least_estimate(link)
    x = bands.join(roots, bands["doc"] == roots["node"], "left").select("key", "doc", F.coalesce("root", "doc").alias("root"))
    mixed = x.groupBy("key").agg(F.count("*").alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
    x = x.join(mixed.select("key", "size"), "key").join(reps.select("doc", "n", "regs"), "doc")
    x = _block_pairs(x, "key", F.ceil(F.col("size") / BLOCK)).select("key", "i", "j", "side", "root", "n", "regs")
    close = x.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_near_roots(least, link), "a long, b long")
    clusters = connected_components(scratch.table(close.distinct()), scratch).select(F.col("node").alias("part"), F.col("root").alias("cluster"))
    x = reps.join(roots, reps["doc"] == roots["node"], "left").select("doc", "n", "regs", F.coalesce("root", "doc").alias("root"))
    x = scratch.table(x.join(clusters, F.col("root") == F.col("part")).drop("part"))
    size = x.groupBy("cluster").agg(F.count("*").alias("docs"), F.sum("n").alias("all"))
    x = x.join(_some(texts, x.select("doc")), F.col("doc") == F.col("doc_id")).join(size, "cluster")
    x = _block_pairs(x, "cluster", F.greatest(F.ceil(F.col("docs") / CLUSTER), F.ceil(F.col("all") / SHINGLES)))
    x = x.select("cluster", "i", "j", "side", "doc", "root", "n", "regs", "text").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return x.mapInArrow(_links_across(least, link), "a long, b long")


def _some(texts: DataFrame, docs: DataFrame) -> DataFrame:
    """The texts of the given documents. Few ids (at most IDS, counted) are broadcast, so that other texts are not shuffled."""
    ids = docs.select(F.col("doc").alias("some")).distinct()
    few = ids.limit(IDS + 1).count() <= IDS
    return texts.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("some"), "left_semi")


def near_duplicates(docs: DataFrame, link: Link = Link()) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept."""
    bound_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    all_ = scratch.table(sketches(docs, link))
    usable = all_.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = usable.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("doc"), F.min("regs").alias("regs"))
    reps = scratch.table(classes)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.filter(F.col("doc_id").isNotNull())
    bands = scratch.table(_shared(_bands(reps.select("doc", "regs"))))
    least = bands.groupBy("key").agg(F.min("doc").alias("a"))
    stars = bands.join(least, "key").filter("a < doc").select("a", F.col("doc").alias("b")).distinct()
    links = scratch.table(_verified(scratch.table(_likely(stars, reps, link)), texts, link).distinct())
    roots = connected_components(links, scratch)
    more = scratch.table(_left_over(bands, reps, roots, texts, link, scratch))
    roots = connected_components(links.union(more).distinct(), scratch)
    roots = reps.join(roots, reps["doc"] == roots["node"], "left").select("n", "f1", "f2", F.coalesce("root", "doc").alias("root"))
    x = all_.drop("regs").join(roots, ["n", "f1", "f2"], "left")
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("root")).otherwise(F.col("doc_id"))
    x = x.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return x.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _shared(bands: DataFrame) -> DataFrame:
    """The bands of buckets with more than one document."""
    many = bands.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    return bands.join(many, "key")


def keep_representatives(docs: DataFrame, link: Link = Link()) -> DataFrame:
    """The rows of docs that stand for their component, all columns kept; of equal doc_ids in it, all rows with one text."""
    gone = near_duplicates(docs, link).filter(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone_id"], "left_anti")
