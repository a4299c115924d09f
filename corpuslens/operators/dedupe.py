"""Exact and near duplicates: families by several signals, conflicts of equal texts, banded similarity of texts and vectors.

Rows are samples with sample_id, source_id, source_path, source_record_id, file_sha256, normalized_text_sha256, text,
validation_status and a unique row key `row` (long or string) that follows the canonical order.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpuslens.functions import identity
from corpuslens.operators.components import bounded_batches, checkpointing, connected_components, freeing

#: Text signatures; the seed is our own and a parameter of minhash_signatures().
SEED, MERSENNE, NGRAM, LEAST_CHARS, PERMUTATIONS, BANDS, OWNER_CAP, NEAR, REVIEW = "corpuslens.textdup.v1", 2**61 - 1, 4, 40, 128, 16, 20, 0.85, 0.70
#: Characters of the texts that are signed together, and distinct grams that a worker remembers with their permuted values (512 bytes each).
PIECE, KNOWN_GRAMS = 500_000, 1 << 16
#: Rows of a block of a bucket, texts whose grams are compared at once, and rows of small buckets whose bounds are.
BLOCK, GRAM_BLOCK, BOUND_BLOCK = 512, 128, 2048
#: Ids that are broadcast to read the texts of no others; with more, the texts are joined by a shuffle.
FEW_IDS = 100_000
#: Hamming limits of the three 64-bit hashes, and of likely pairs.
CONFIRMED, LIKELY, IMAGE_CAP = (8, 10, 10), 12, 4096


def canonical_order(failed: Column, *columns: str) -> list[Column]:
    """Failed rows last, then the identifying columns."""
    return [failed.cast("int"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]]


def exact_groups(df: DataFrame, key: str, order: str) -> DataFrame:
    """Adds copies (rows with the same key), canonical (smallest order) and is_canonical. Null keys are alone. Groups are aggregated, not gathered."""
    groups = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("copies"), F.min(order).alias("canonical")).where("copies > 1")
    x = df.drop("copies", "canonical").join(groups, F.col(key) == F.col("_key"), "left").drop("_key")
    x = x.withColumn("copies", F.coalesce("copies", F.lit(1).cast("long"))).withColumn("canonical", F.coalesce("canonical", order))
    return x.withColumn("is_canonical", F.col("canonical") == F.col(order))


def duplicate_groups(df: DataFrame, key: str, id_: str) -> DataFrame:
    """Groups of more than one row: key, copies, first id."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("copies"), F.min(id_).alias("first_id")).where("copies > 1")


def _signals(df: DataFrame) -> Column:
    named = lambda name, *c: F.concat_ws("\x1f", F.lit(name), *c)
    return F.array_compact(F.array(
        named("id", F.col("sample_id")), F.when(F.col("source_record_id") != "", named("record", F.col("source_id"), F.col("source_record_id"))), F.when(F.col("file_sha256") != "", named("hash", F.col("file_sha256"))),
    ))


def classify_duplicates(df: DataFrame) -> DataFrame:
    """Adds root, duplicate_state, duplicate_of and reason.

    Families join rows of equal sample_id, (source_id, source_record_id) or file hash, transitively; the smallest row
    is canonical. Then, among rows that are no duplicates, equal normalized texts over at least two file hashes (null
    counts as one) conflict: all but the smallest.
    """
    members = df.select(F.col("row").alias("node"), F.explode(_signals(df)).alias("signal"))
    x = df.join(connected_components(members).withColumnRenamed("node", "row"), "row")
    family = Window.partitionBy("root")
    many = lambda *c: F.count("*").over(Window.partitionBy("root", *c)) > 1
    x = x.withColumn("family", F.count("*").over(family))
    reason = (
        F.when(many("sample_id"), "duplicate_sample_id").when((F.coalesce("source_record_id", F.lit("")) != "") & many("source_id", "source_record_id"), "duplicate_source_record")
        .when((F.coalesce("file_sha256", F.lit("")) != "") & many("file_sha256"), "duplicate_file_hash").otherwise("duplicate_cluster")
    )
    copy = F.col("row") != F.col("root")
    x = x.withColumn("reason", F.when(copy, reason))
    x = x.withColumn("canonical_id", F.first("sample_id").over(family.orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    x = x.withColumn("state", F.when(F.col("family") == 1, "unique").when(copy, "duplicate").otherwise("canonical"))
    able = F.col("normalized_text_sha256").isNotNull() & (F.col("state") != "duplicate")
    hash_ = F.coalesce("file_sha256", F.lit(""))
    texts = x.where(able).groupBy(F.col("normalized_text_sha256").alias("_text")).agg((F.min(hash_) != F.max(hash_)).alias("differs"), F.min("row").alias("first_row"), F.min_by("sample_id", "row").alias("text_id")).where("differs")
    x = x.join(texts, F.col("normalized_text_sha256") == F.col("_text"), "left")
    conflict = able & F.coalesce(F.col("differs") & (F.col("row") != F.col("first_row")), F.lit(False))
    x = x.withColumn("duplicate_state", F.when(conflict, "conflicting_duplicate").otherwise(F.col("state")))
    x = x.withColumn("duplicate_of", F.when(conflict, F.col("text_id")).when(copy, F.col("canonical_id")))
    return x.drop("family", "canonical_id", "state", "_text", "differs", "first_row", "text_id")


def raw_text_conflicts(df: DataFrame) -> DataFrame:
    """Rows of classify_duplicates(): equal raw texts over two or more known file hashes; members whose hash is not the canonical row's conflict."""
    x = df.withColumn("raw", F.when(F.col("text") != "", identity.raw_text_sha256(F.col("text"))))
    texts = x.where("raw IS NOT NULL").groupBy(F.col("raw").alias("_raw")).agg(
        (F.min("file_sha256") != F.max("file_sha256")).alias("differs"), F.min("row").alias("first_row"), F.min_by(F.struct("file_sha256", "sample_id"), "row").alias("first"),
    ).where("differs")
    x = x.join(texts, F.col("raw") == F.col("_raw"), "left")
    conflict = F.coalesce(F.col("differs") & (F.col("row") != F.col("first_row")) & ~F.col("file_sha256").eqNullSafe(F.col("first.file_sha256")), F.lit(False))
    x = x.withColumn("duplicate_state", F.when(conflict, "conflicting_duplicate").otherwise(F.col("duplicate_state")))
    return x.withColumn("duplicate_of", F.when(conflict, F.col("first.sample_id")).otherwise(F.col("duplicate_of"))).drop("raw", "_raw", "differs", "first_row", "first")


def ordered_pair(a: Column, b: Column) -> Column:
    """struct(a, b) of an unordered pair, null for a row with itself."""
    return F.when(a != b, F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))


def apply_near_pairs(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Confirmed near pairs (a, b of sample_id): in each family of pairs, unique rows become duplicates of the smallest, which becomes canonical."""
    key = F.concat_ws("\x1f", "a", "b")
    members = pairs.select(F.col("a").alias("node"), key.alias("signal")).union(pairs.select(F.col("b").alias("node"), key.alias("signal")))
    roots = connected_components(members).select(F.col("node").alias("sample_id"), F.col("root").alias("near_root"))
    x = df.join(roots, "sample_id", "left")
    unique = (F.col("duplicate_state") == "unique") & F.col("near_root").isNotNull()
    first = F.col("near_root") == F.col("sample_id")
    x = x.withColumn("duplicate_of", F.when(unique & ~first, F.col("near_root")).otherwise(F.col("duplicate_of")))
    x = x.withColumn("reason", F.when(unique & ~first, "near_duplicate_image").otherwise(F.col("reason")))
    return x.withColumn("duplicate_state", F.when(unique & first, "canonical").when(unique, "duplicate").otherwise(F.col("duplicate_state"))).drop("near_root")


def family_clusters(df: DataFrame) -> DataFrame:
    """Families of classify_duplicates() with more than one id: cluster_id, members (sorted), size."""
    many = df.groupBy("root").agg(F.min("sample_id").alias("lo"), F.max("sample_id").alias("hi")).where("lo <> hi").select("root")
    x = df.join(many, "root", "left_semi").groupBy("root").agg(F.array_sort(F.collect_set("sample_id")).alias("members"))  # the id of a cluster is a digest of its members in order
    return x.select(identity.cluster_id(F.col("members")).alias("cluster_id"), "members", F.size("members").alias("size")).dropDuplicates(["cluster_id"])


def _u64(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big")


def _permutations(seed: str = SEED) -> list[tuple[int, int]]:
    out = []
    for i in range(PERMUTATIONS):
        d = hashlib.blake2b(f"{seed}{i}".encode(), digest_size=16).digest()
        out.append((int.from_bytes(d[:8], "big") % MERSENNE or 1, int.from_bytes(d[8:], "big") % MERSENNE))
    return out


def _mulmod(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """a * x mod 2**61 - 1 for a, x < 2**61, in halves that fit 64 bits."""
    p, low = np.uint64(MERSENNE), np.uint64((1 << 31) - 1)
    a_hi, a_lo, x_hi, x_lo = a >> np.uint64(31), a & low, x >> np.uint64(31), x & low
    mid = a_hi * x_lo + a_lo * x_hi  # < 2**62
    total = (a_hi * x_hi << np.uint64(1)) + (mid >> np.uint64(30)) + ((mid & np.uint64((1 << 30) - 1)) << np.uint64(31)) + a_lo * x_lo
    total = (total & p) + (total >> np.uint64(61))
    return np.where(total >= p, total - p, total)


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _gram_codes(points: np.ndarray) -> np.ndarray:
    """A 64-bit code of the NGRAM characters from each place on, of code points."""
    code = np.zeros(max(len(points) - NGRAM + 1, 0), np.uint64)
    for i in range(NGRAM):
        code = (code ^ points[i : i + len(code)]) * _STEP
        code ^= code >> np.uint64(29)
    return code


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def gram_set(text: str) -> np.ndarray:
    """The sorted distinct codes of a text's character 4-grams."""
    return np.unique(_gram_codes(_points(text)))


def _permuted(a: np.ndarray, b: np.ndarray, h: np.ndarray) -> np.ndarray:
    """a * h + b mod 2**61 - 1."""
    v = _mulmod(a, h % np.uint64(MERSENNE)) + b
    return np.where(v >= np.uint64(MERSENNE), v - np.uint64(MERSENNE), v)


class _Grams:
    """Hashes of grams and the upper 32 bits of their permuted values; of grams that several texts may have, kept in a worker until they are too many."""

    def __init__(self, seed: str):
        self.a, self.b = (np.array(x, np.uint64) for x in zip(*_permutations(seed)))
        self.at, self.h, self.high = {}, np.empty(0, np.uint64), np.empty((0, PERMUTATIONS), np.uint32)

    def rows(self, codes: np.ndarray, often: np.ndarray, gram) -> np.ndarray:
        """The rows of distinct codes; often: which are kept; gram(i) gives the characters of the i-th."""
        rows = np.array([self.at.get(c, -1) for c in codes.tolist()], np.int64)
        new = np.flatnonzero(rows < 0)
        if len(self.at) + len(new) > KNOWN_GRAMS:
            some = often[new]
            if len(self.at) + some.sum() > KNOWN_GRAMS:
                self.at, new = {}, np.arange(len(codes))
                some = often & (np.cumsum(often) <= KNOWN_GRAMS)
            new = np.concatenate([new[some], new[~some]])
            kept = int(some.sum())
        else:
            kept = len(new)
        lo, need = len(self.at), len(self.at) + len(new)
        if need > len(self.h) or len(self.h) > 2 * max(need, KNOWN_GRAMS):
            room = max(need, min(2 * need, KNOWN_GRAMS))
            self.h = np.concatenate([self.h[:lo], np.empty(room - lo, np.uint64)])
            self.high = np.concatenate([self.high[:lo], np.empty((room - lo, PERMUTATIONS), np.uint32)])
        rows[new] = np.arange(lo, need)
        self.at.update(zip(codes[new[:kept]].tolist(), range(lo, lo + kept)))
        self.h[lo:need] = h = np.fromiter((_u64(gram(i)) for i in new.tolist()), np.uint64, len(new))
        for k in range(PERMUTATIONS):
            self.high[lo:need, k] = _permuted(self.a[k], self.b[k], h) >> np.uint64(29)
        return rows

    def signature(self, rows: np.ndarray) -> np.ndarray:
        """The least permuted values: by their upper bits, the few that these leave in full."""
        least = np.full(PERMUTATIONS, MERSENNE, np.uint64)
        for lo in range(0, len(rows), 8192):
            some = rows[lo : lo + 8192]
            high = np.take(self.high, some, axis=0)
            i, k = np.divmod(np.flatnonzero((high == high.min(axis=0)).ravel()), PERMUTATIONS)
            np.minimum.at(least, k, _permuted(self.a[k], self.b[k], self.h[some[i]]))
        return least


_known: dict[str, _Grams] = {}


def _parts(codes: np.ndarray) -> bytes | None:
    """How many of a set's codes fall into each of 2**k parts, the power of two from half of the set to all of it; packed. None: more than 254 in one."""
    k = max(0, len(codes).bit_length() - 1)
    counts = np.bincount((codes * _STEP >> np.uint64(32)).astype(np.int64) >> (32 - k), minlength=1 << k)
    if counts.max() > 254:
        return None
    pack = zlib.compressobj(6, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY)
    return pack.compress(counts.astype(np.uint8).tobytes()) + pack.flush()


def minhash_signatures(df: DataFrame, id_: str = "sample_id", text: str = "value", seed: str = SEED) -> DataFrame:
    """id, signature (array of PERMUTATIONS longs), n (distinct character 4-grams) and same (a digest of their set) of normalized texts of at least LEAST_CHARS characters."""
    return _signed(df, id_, text, seed).select("id", "signature", "n", "same").where("n IS NOT NULL")


def _signed(df: DataFrame, id_: str, text: str, seed: str = SEED) -> DataFrame:
    """minhash_signatures() with _parts(), and with nulls for shorter texts. A filter on them here would be evaluated, with what normalizes the texts,
    once more below the exchange that spreads the rows."""

    @F.pandas_udf("signature array<long>, n int, same string, parts binary")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = {c: [None] * len(texts) for c in ("signature", "n", "same", "parts")}
        known = _known[seed] = _known.get(seed) or _Grams(seed)
        able = [i for i, t in enumerate(texts) if t is not None and len(t) >= LEAST_CHARS]
        values, lo = texts.tolist(), 0
        while lo < len(able):  # some texts at a time: each distinct gram is looked up once for them
            hi, size = lo, 0
            while hi < len(able) and (hi == lo or size + len(values[able[hi]]) <= PIECE):
                size += len(values[able[hi]])
                hi += 1
            joined, lengths = "".join(values[i] for i in able[lo:hi]), np.array([len(values[i]) for i in able[lo:hi]])
            ends, every = np.cumsum(lengths), _gram_codes(_points(joined))
            inside = np.ones(len(every), bool)  # where a gram of one text begins
            for back in range(1, NGRAM):
                inside[ends[:-1] - back] = False
            place, count = np.flatnonzero(inside), lengths - NGRAM + 1
            at, codes = pd.factorize(every[place])
            first = np.empty(len(codes), np.int64)
            first[at[::-1]] = place[::-1]
            mark = np.zeros(len(codes), bool)
            rows, cuts = known.rows(codes, np.bincount(at) > 1, lambda i: joined[first[i] : first[i] + NGRAM]), np.cumsum(count) - count
            for i, x, y in zip(able[lo:hi], cuts.tolist(), (cuts + count).tolist()):
                mark[at[x:y]] = True
                own = np.flatnonzero(mark)
                mark[own] = False
                out["signature"][i], out["n"][i], out["parts"][i] = known.signature(rows[own]).astype(np.int64), len(own), _parts(codes[own])
                out["same"][i] = hashlib.blake2b(np.sort(known.h[rows[own]]).tobytes(), digest_size=16).hexdigest()
            lo = hi
        return pd.DataFrame({c: pd.Series(x, dtype="Int32" if c == "n" else object) for c, x in out.items()})

    return df.select(F.col(id_).alias("id"), run(text).alias("r")).select("id", "r.signature", "r.n", "r.same", "r.parts")


def band_buckets(signatures: DataFrame, bands: int = BANDS) -> DataFrame:
    """id, band, bucket, size: in how many signatures' company each is, per band."""
    rows = PERMUTATIONS // bands
    keys = F.array(*[F.struct(F.lit(i).alias("band"), F.xxhash64(F.slice("signature", i * rows + 1, rows)).alias("bucket")) for i in range(bands)])
    x = signatures.select("id", F.explode(keys).alias("k")).select("id", "k.band", "k.bucket")
    return x.join(x.groupBy("band", "bucket").agg(F.count("*").alias("size")).where("size > 1"), ["band", "bucket"])


def _block_pairs(df: DataFrame, key: list[str], id_: str, *more: str, block: int | None = None) -> DataFrame:
    """Rows (key, id_, size: rows of the key, more): each pair of different ids of a key once, as key, structs x and y (id_, more). Keys of
    many rows are joined block by block, so that no task holds more than two blocks."""
    n = F.ceil(F.col("size") / (block or BLOCK)).cast("int")
    x = df.select(*key, F.struct(id_, *more).alias("s"), n.alias("n"), F.pmod(F.xxhash64(id_), n).cast("int").alias("at"))
    left = x.select(*key, F.col("s").alias("x"), F.col("at").alias("i"), F.explode(F.sequence("at", F.col("n") - 1)).alias("j"))
    right = x.select(*key, F.col("s").alias("y"), F.explode(F.sequence(F.lit(0), "at")).alias("i"), F.col("at").alias("j"))
    return left.join(right, [*key, "i", "j"]).where((F.col("i") < F.col("j")) | (F.col(f"x.{id_}") < F.col(f"y.{id_}"))).drop("i", "j")


def _met(rows: pd.DataFrame):
    """(one row, later rows) of rows (bucket, at, id, n, keys up to the bucket's band, i, j) of whole buckets or of two blocks each: those of different ids that this bucket is
    the first to bring together, and of different blocks if these are two."""
    rows = rows.drop_duplicates(["bucket", "id"])
    rows = rows.iloc[np.argsort(rows["bucket"].to_numpy(), kind="stable")]
    bucket, at, n = rows["bucket"].to_numpy(), rows["at"].to_numpy(), rows["n"].to_numpy()
    keys = np.zeros((len(rows), int(bucket[-1] >> 32) + 1), np.int32)
    keys[np.arange(keys.shape[1]) <= (bucket >> 32)[:, None]] = np.concatenate(rows["keys"].to_numpy())
    within, cuts = (rows["i"] == rows["j"]).to_numpy(), np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    pairs = lambda review: (
        (x, later[new & (np.minimum(n[later], n[x]) >= review * np.maximum(n[later], n[x]) * (1 - 1e-9))])  # a bound of the similarity
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()) for band in [int(bucket[lo] >> 32)] for x in range(lo, hi - 1) for later in [np.arange(x + 1, hi)]
        for new in [(keys[later, band] == keys[x, band]) & ~(keys[later, :band] == keys[x, :band]).any(axis=1) & (within[x] | (at[later] != at[x]))]
    )
    return rows, pairs


def _possible(review: float):
    """Rows of buckets to those that a pair may be similar of: texts share no more grams than the smaller counts of their parts add up to."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, pairs = _met(rows)
        n, used = rows["n"].to_numpy().astype(np.int64), np.zeros(len(rows), bool)
        parts = [None if p is None else np.frombuffer(zlib.decompress(p, -15), np.uint8) for p in rows["parts"]]
        width, bucket, now, table = np.array([0 if p is None else len(p) for p in parts]), rows["bucket"].to_numpy(), None, {}
        for x, later in pairs(review):
            if not len(later):
                continue
            if bucket[x] != now:
                now, table, lo = bucket[x], {}, x
                hi = lo + int(np.searchsorted(bucket[lo:], now, "right"))
            both = n[later].copy()  # if there are no counts
            for size in np.unique(least := np.minimum(width[later], width[x])).tolist():
                if not size:
                    continue
                if size not in table:  # the counts of the bucket's texts in so many parts
                    table[size] = np.zeros((hi - lo, size), np.float32)
                    for y in range(lo, hi):
                        if width[y] >= size:
                            table[size][y - lo] = parts[y].reshape(size, -1).sum(axis=1) if width[y] > size else parts[y]
                some = least == size
                both[some] = np.ceil(np.minimum(table[size][later[some] - lo], table[size][x - lo]) @ np.ones(size, np.float32) * (1 + 1e-5))
            may = later[both >= review * (n[later] + n[x] - both) * (1 - 1e-9)]
            used[may] = True
            used[x] |= len(may) > 0
        return rows.loc[used, ["g", "i", "j", "bucket", "at", "id", "n", "keys"]]

    return run


def _similar(review: float):
    """Rows of buckets with texts (value, packed) to the pairs a < b of the exact Jaccard similarity of their grams."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, pairs = _met(rows)
        number, ids = pd.factorize(rows["id"])
        sets = [gram_set(zlib.decompress(v).decode("utf-8", "surrogatepass")) for v in rows["value"].to_numpy()[~rows["id"].duplicated().to_numpy()]]
        size = np.array(list(map(len, sets)))
        grams, distinct = pd.factorize(np.concatenate(sets))
        sets, mark, found = np.split(grams.astype(np.int32), np.cumsum(size)[:-1]), np.zeros(len(distinct), np.uint8), []
        for x, later in pairs(review):
            if not len(later):
                continue
            a, others = number[x], number[later]
            mark[sets[a]] = 1
            for some in np.split(others, np.flatnonzero(np.diff(np.cumsum(size[others]) >> 20)) + 1):  # about a million grams at once
                both = np.add.reduceat(mark[np.concatenate([sets[b] for b in some])], np.cumsum(size[some]) - size[some], dtype=np.int64)
                alike = both / (size[a] + size[some] - both)
                found += [(ids[a], ids[b], j) if ids[a] < ids[b] else (ids[b], ids[a], j) for b, j in zip(some[alike >= review].tolist(), alike[alike >= review].tolist())]
            mark[sets[a]] = 0
        return pd.DataFrame(found, columns=["a", "b", "jaccard"])

    return run


@F.pandas_udf(T.BinaryType())
def _packed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else zlib.compress(t.encode("utf-8", "surrogatepass"), 1))


def keyed_texts(texts: DataFrame, id_: str = "sample_id", text: str = "value", bands: int = BANDS) -> DataFrame:
    """id, same (digest of the set of grams), keys (of the bands), n (grams) and parts of each text, nulls for short ones."""
    rows = PERMUTATIONS // bands
    keys = F.array(*[F.xxhash64(F.slice("signature", i * rows + 1, rows)) for i in range(bands)])
    return _signed(texts, id_, text).select("id", "same", keys.alias("keys"), "n", "parts")


def text_classes(every: DataFrame) -> DataFrame:
    """The classes of equal sets of keyed_texts(): same, keys, n, parts, size (members) and rep (the smallest id)."""
    return every.groupBy("same").agg(F.first("keys").alias("keys"), F.first("n").alias("n"), F.first("parts").alias("parts"), F.count("*").alias("size"), F.min("id").alias("rep"))


def candidate_pairs(sets: DataFrame, cap: int = OWNER_CAP, review: float = REVIEW) -> DataFrame:
    """Pairs a < b of representatives of text_classes() that share a bucket and whose sizes allow the similarity, each once, in the first
    band they share; many: the bucket has more than cap classes."""
    x = sets.select("same", "keys", "n", "rep", F.posexplode("keys").alias("band", "bucket"))
    x = x.join(x.groupBy("band", "bucket").agg(F.count("*").alias("size")).where("size > 1"), ["band", "bucket"])
    pairs = _block_pairs(x, ["band", "bucket"], "same", "keys", "n", "size", "rep")
    before = lambda s: F.slice(f"{s}.keys", F.lit(1), F.col("band"))
    pairs = pairs.where(~F.exists(F.zip_with(before("x"), before("y"), lambda a, b: a == b), lambda e: e))
    pairs = pairs.where(F.least("x.n", "y.n") / F.greatest("x.n", "y.n") >= review)  # a bound of the similarity
    return pairs.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"), (F.col("x.size") > cap).alias("many"))


def near_text_pairs(texts: DataFrame, id_: str = "sample_id", text: str = "value", bands: int = BANDS, cap: int = OWNER_CAP, near: float = NEAR, review: float = REVIEW) -> DataFrame:
    """Normalized texts of at least LEAST_CHARS characters to pairs a < b, by exact Jaccard similarity of their grams: level near, review or copy.

    Texts of one set of grams are a class, for which its smallest id stands: each other member is a pair 'copy' with it. Representatives that
    share a bucket are compared: once, in the first band they share; those of buckets of more than BLOCK classes block by block. None is
    skipped. No pair is stored before it is known to be similar: a bucket first gets counts that bound the similarities, then the texts, packed, of the
    members that a pair may be similar of. So what is stored grows with the texts and the buckets they are in. expand_copies() unfolds the
    classes. Buckets of at most cap classes are put together. Signatures are computed once, texts are read again only where a pair needs them.
    """
    checkpointing(texts.sparkSession)
    bounded_batches(texts.sparkSession)
    every = freeing(keyed_texts(texts, id_, text, bands).checkpoint()).where("n IS NOT NULL")
    kind = every.schema["id"].dataType.simpleString()
    keys = F.transform("keys", lambda k: F.shiftright(k, 32).cast("int"))
    sets = freeing(text_classes(every).select("same", "size", F.col("rep").alias("id"), "n", keys.alias("keys"), "parts").checkpoint())

    no = F.xxhash64("id").alias("no")  # narrow; a collision adds rows to a bucket, which their keys tell apart
    x = sets.select(no, F.posexplode("keys").alias("band", "key")).select("no", (F.shiftleft(F.col("band").cast("long"), 32) + F.col("key").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("bucket"))
    met = freeing(x.join(x.groupBy("bucket").agg(F.count("*").alias("met")).where("met > 1"), "bucket").checkpoint())
    groups = lambda n: F.when(F.col("met") <= cap, -1 - F.pmod(F.xxhash64("bucket"), F.lit(max(1, -(-met.count() // n))))).otherwise(F.col("bucket"))
    blocks = F.ceil(F.col("met") / BLOCK).cast("int")
    rows = met.join(sets.select(no, "id", "n", "keys", "parts"), "no").select(groups(BOUND_BLOCK).alias("g"), "bucket", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("at"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"), "id", "n", F.slice("keys", F.lit(1), F.shiftright("bucket", 32).cast("int") + 1).alias("keys"), "parts")
    rows = rows.select("g", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "bucket", "at", "id", "n", "keys", "parts")
    open_ = freeing(rows.groupBy("g", "i", "j").applyInPandas(_possible(review), f"g long, i int, j int, bucket long, at int, id {kind}, n int, keys array<int>").checkpoint())

    used, values = open_.select(F.col("id").alias("used")).distinct(), texts.select(F.col(id_).alias("same"), F.col(text).alias("value"))
    if used.count() <= FEW_IDS:
        values = values.join(F.broadcast(used), F.col("same") == F.col("used"), "left_semi")
    values = values.select("same", _packed("value").alias("value"))
    bins = F.lit(max(1, -(-open_.where("g < 0").count() // GRAM_BLOCK)))
    open_ = open_.withColumn("g", F.when(F.col("g") < 0, -1 - F.pmod(F.xxhash64("bucket"), bins)).otherwise(F.col("g")))
    across = open_.join(values, F.col("id") == F.col("same")).drop("same").groupBy("g", "i", "j").applyInPandas(_similar(review), f"a {kind}, b {kind}, jaccard double")

    across = across.select("a", "b", "jaccard", F.when(F.col("jaccard") >= near, "near").otherwise("review").alias("level"))
    copies = every.select("same", "id").join(sets.where("size > 1").select("same", F.col("id").alias("rep")), "same").where("id <> rep")
    return across.union(copies.select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("jaccard"), F.lit("copy").alias("level")))


def expand_copies(found: DataFrame) -> DataFrame:
    """near_text_pairs() with every pair of the members of its classes, those of one class as near; as many rows as a group of copies has pairs."""
    copy = F.col("level") == "copy"
    of = found.where(copy).select(F.col("a").alias("rep"), F.col("b").alias("id"))
    of = of.union(found.select(F.explode(F.array_compact(F.array("a", F.when(~copy, F.col("b"))))).alias("rep")).distinct().select("rep", F.col("rep").alias("id")))
    side = lambda n: of.select(F.col("rep").alias(n), F.col("id").alias(f"id_{n}"))
    across = found.where(~copy).join(side("a"), "a").join(side("b"), "b").select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "jaccard", "level")
    size = of.groupBy("rep").agg(F.count("*").alias("size")).where("size > 1")
    inside = _block_pairs(of.join(size, "rep"), ["rep"], "id")
    return across.union(inside.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), F.lit(1.0).alias("jaccard"), F.lit("near").alias("level")))


def skipped_buckets(signatures: DataFrame, bands: int = BANDS, cap: int = OWNER_CAP) -> DataFrame:
    """The buckets that the survey's DUP-9 skips; near_text_pairs() compares them too."""
    return band_buckets(signatures, bands).where(F.col("size") > cap).select("band", "bucket", "size").distinct()


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hash_of_hex(h: Column) -> Column:
    """A 64-bit hash of 16 hexadecimal digits as a long."""
    return F.conv(h, 16, -10).cast("long")


def near_level(p: Column, d: Column, a: Column) -> Column:
    return F.when((p <= CONFIRMED[0]) & (d <= CONFIRMED[1]) & (a <= CONFIRMED[2]), "CONFIRMED").when(p <= LIKELY, "LIKELY").otherwise("CANDIDATE")


def fingerprint_pairs(df: DataFrame, cap: int = IMAGE_CAP) -> DataFrame:
    """Rows (id, phash, dhash, ahash: longs, aspect): all pairs that agree in one of twelve 16-bit bands and the aspect; buckets of more than cap rows by blocks of as many."""
    bands = [F.struct(F.lit(4 * n + i).alias("band"), F.shiftright(F.col(h), 16 * i).bitwiseAND(F.lit(0xFFFF)).alias("bits")) for n, h in enumerate(("phash", "dhash", "ahash")) for i in range(4)]
    x = df.select("id", "aspect", F.explode(F.array(*bands)).alias("k")).select("id", "aspect", "k.band", "k.bits")
    x = x.join(x.groupBy("band", "bits", "aspect").agg(F.count("*").alias("size")).where("size > 1"), ["band", "bits", "aspect"])
    pairs = _block_pairs(x, ["band", "bits", "aspect"], "id", block=cap).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    side = lambda s: df.select(F.col("id").alias(s), *[F.col(h).alias(f"{h}_{s}") for h in ("phash", "dhash", "ahash")])
    x = pairs.join(side("a"), "a").join(side("b"), "b")
    d = [hamming(F.col(f"{h}_a"), F.col(f"{h}_b")).alias(n) for h, n in (("phash", "d_p"), ("dhash", "d_d"), ("ahash", "d_a"))]
    x = x.select("a", "b", *d)
    return x.withColumn("level", near_level(F.col("d_p"), F.col("d_d"), F.col("d_a")))


def adjacent_pages(df: DataFrame) -> DataFrame:
    """Pairs of neighbouring pages (document_id, page_index, id) of one document."""
    w = Window.partitionBy("document_id").orderBy("page_index", "id")
    x = df.where("document_id IS NOT NULL AND page_index IS NOT NULL").withColumn("next_id", F.lead("id").over(w)).withColumn("next_page", F.lead("page_index").over(w))
    return x.where("next_page - page_index = 1").select("document_id", F.least("id", "next_id").alias("a"), F.greatest("id", "next_id").alias("b"))


def close_codes(df: DataFrame, limit: int = 5, bits: int = 64, agree: int = 2) -> DataFrame:
    """Rows (id, code) to pairs a < b within a Hamming distance, of the smallest id of each code; other rows of a code are pairs with it, at distance 0.

    Codes are cut into limit + agree parts. Two codes that close differ in at most limit of them, so they agree in agree parts at least, and
    each choice of so many parts is a key: none is missed, and keys are wide enough to tell most other codes apart.
    """
    parts = limit + agree
    cuts = [i * bits // parts for i in range(parts + 1)]
    part = [F.shiftrightunsigned(F.col("code"), lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(cuts[:-1], cuts[1:])]
    codes = df.groupBy("code").agg(F.min("id").alias("id"))
    keys = F.array(*[F.xxhash64(F.lit(i), *[part[k] for k in some]) for i, some in enumerate(itertools.combinations(range(parts), agree))])
    x = codes.select("id", "code", F.explode(keys).alias("key"))
    pairs = x.alias("x").join(x.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")))
    pairs = pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), hamming(F.col("x.code"), F.col("y.code")).alias("distance")).where(F.col("distance") <= limit).distinct()
    copies = df.select("id", "code").join(codes.select("code", F.col("id").alias("a")), "code").where("id <> a").select("a", F.col("id").alias("b"), F.lit(0).alias("distance"))
    return pairs.unionByName(copies)


def aspect_bucket(width: Column, height: Column) -> Column:
    """The nearest of five common aspect ratios within 2 %, else the ratio in hundredths."""
    r = width / height
    out = None
    for name, value in (("1:1", 1.0), ("4:3", 4 / 3), ("3:4", 0.75), ("16:9", 16 / 9), ("a4", 0.7071)):
        near = F.abs(r - value) <= 0.02 * value
        out = F.when(near, name) if out is None else out.when(near, name)
    return F.when((width > 0) & (height > 0), out.otherwise(F.concat(F.lit("r"), F.round(r * 100).cast("int").cast("string")))).otherwise("unknown")


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of the rows of one key the first, by an order without ties; rows without a key stay."""
    first = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(order).alias("_first"))
    return df.join(first, (F.col(key) == F.col("_key")) & (F.col(order) == F.col("_first")), "left").where(F.col("_key").isNotNull() | F.col(key).isNull()).drop("_key", "_first")
