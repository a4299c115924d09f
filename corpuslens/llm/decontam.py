"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

A benchmark item is the set of its windows (10 consecutive words; a shorter item is one window), and a window is the
set of its 5-word shingles. A window occurs in a document only where all its shingles do, so joining one shingle is
enough: shingles are ordered by how often the documents hold them, and the rarest one is the window's prefix. The
prefix tokens are joined to the documents' rolling shingles; place and length bounds drop candidates that would start
before or end after the document; what is left is verified word by word over a span of the window's size.

The documents' words are rolled once. A sieve, a bit map of the benchmark's shingles that has SIEVE_BITS bits however
large the benchmark is, lets through the places that can matter; only those, without their words, are stored, counted,
ordered and joined. Words are read again for verification, of the documents that have a candidate.

Defined results: null and empty texts have no words, no hits, and are not contaminated. Items without words have no
windows. A null item_id is listed as ''. A null doc_id is a value like others; repeated rows give equal rows each.
Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import Scratch, gram_hash, words_of

WINDOW, SHINGLE = 10, 5
#: Bits of the sieve. It is broadcast as at most SIEVE_BITS / 64 rows of two longs.
SIEVE_BITS = 1 << 26
#: So many documents with candidates (two longs each) at most are broadcast to the scan that verifies, as counted; beyond, texts are shuffled once.
BROADCAST_DOCS = 500_000


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: win (words), items (ids as strings, sorted), wid (the words, joined by blanks)."""
    x = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    x = x.select("item", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0))), lambda i: F.slice("w", i + 1, window))).alias("win"))
    return x.groupBy("win").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("wid", F.concat_ws(" ", "win"))


def _sieve(tokens: DataFrame) -> DataFrame:
    """The bit map of column h: cell, bits."""
    bit = F.pmod("h", F.lit(SIEVE_BITS))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))
    return tokens.groupBy(F.floor(bit / 64).cast("int").alias("cell")).agg(F.bit_or(one).alias("bits"))


def _passes(h: Column, bits: Column) -> Column:
    return F.call_function("shiftrightunsigned", bits, (F.pmod(h, F.lit(SIEVE_BITS)) % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1


def _rolling(docs: DataFrame, lengths: list[int], sieve: DataFrame) -> DataFrame:
    """doc_id, th, n (words), pos, h: the hash of each rolling shingle that the sieve lets through, and a row with null h per row of docs."""
    x = docs.select("doc_id", F.xxhash64("text").alias("th"), F.concat(words_of(F.col("text")), F.array(F.lit(""))).alias("w"))  # an end mark stands for the row
    n, pos = F.size("w") - 1, F.col("pos")
    x = x.select("doc_id", "th", "w", F.posexplode_outer("w").alias("pos", "first"))
    hashes = [gram_hash(F.col("w"), pos, k, n) for k in lengths]
    if len(hashes) > 1:  # the end mark once
        x = x.select("doc_id", "th", "w", "pos", F.explode(F.when(pos == n, F.array(F.lit(None).cast("long"))).otherwise(F.array(*hashes))).alias("h"))
    else:
        x = x.select("doc_id", "th", "w", "pos", hashes[0].alias("h"))
    x = x.withColumn("cell", F.floor(F.pmod("h", F.lit(SIEVE_BITS)) / 64).cast("int")).join(F.broadcast(sieve), "cell", "left")
    x = x.filter((pos == n) | _passes(F.col("h"), F.col("bits")))
    return x.select("doc_id", "th", n.alias("n"), "pos", "h")


def _same_document(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["th"] == right["th"])


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows: doc_id, th (xxhash64 of the text) and n_words of each row of docs; hits per (doc_id, th) that has any: spans
    (start, end of each occurrence) and wids; and the windows."""
    scratch = Scratch(docs.sparkSession)
    windows = scratch.table(item_windows(benchmark, window))
    size = F.least(F.size("win"), F.lit(shingle))
    lengths = windows.agg(F.array_sort(F.collect_set(size))).first()[0] or [shingle]
    tokens = windows.select("wid", "win", F.posexplode("win").alias("off", "first"))
    token = F.lit(None).cast("long")
    for k in lengths:
        token = F.when(size == k, gram_hash(F.col("win"), F.col("off"), k, F.size("win"))).otherwise(token)
    tokens = tokens.select("wid", F.size("win").alias("size"), "off", token.alias("h")).filter(F.col("h").isNotNull())
    places = scratch.table(_rolling(docs, lengths, _sieve(tokens)))
    rows, places = places.filter("h IS NULL").select("doc_id", "th", F.col("n").cast("long").alias("n_words")), places.filter("h IS NOT NULL")

    # how many places of the corpus hold each shingle of the benchmark; the rarest is a window's prefix
    seen = places.groupBy("h").agg(F.count("*").alias("places"))
    prefix = tokens.join(seen, "h").groupBy("wid", "size").agg(F.count("*").alias("found"), F.min(F.struct("places", "h", "off")).alias("p"))
    # a window of which a shingle was seen nowhere occurs nowhere
    prefix = prefix.filter(F.col("found") == F.col("size") - F.least(F.col("size"), F.lit(shingle)) + 1).select("wid", "size", "p.h", "p.off")
    start = F.col("pos") - F.col("off")
    found = places.join(prefix, "h").filter((start >= 0) & (start + F.col("size") <= F.col("n"))).select("doc_id", "th", start.alias("start"), "size", "wid")
    found = scratch.table(found.distinct())

    some = found.select("doc_id", "th").distinct()
    few = some.limit(BROADCAST_DOCS + 1).count() <= BROADCAST_DOCS
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    texts = texts if few else texts.repartition("doc_id", "th")
    texts = texts.join(F.broadcast(some) if few else some, _same_document(texts, some), "left_semi").select("doc_id", "th", words_of(F.col("text")).alias("w"))
    x = texts.join(found if few else found.hint("shuffle_hash"), _same_document(texts, found)).select(texts["doc_id"], texts["th"], "w", "start", "size", "wid")
    x = x.filter(F.array_join(F.slice("w", F.col("start") + 1, F.col("size")), " ") == F.col("wid"))
    hits = x.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end")))).alias("spans"), F.collect_set("wid").alias("wids"))
    return rows, scratch.table(hits), windows.select("wid", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of docs: doc_id, th (xxhash64 of the text), n_words, n_hit (words inside any occurrence), items (ids, sorted), contaminated."""
    rows, hits, windows = benchmark_hits(docs, benchmark, window, shingle)
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n")),
        lambda a, s: F.struct(F.greatest(a["upto"], s["end"]).alias("upto"), (a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["upto"]), F.lit(0))).alias("n")),
    )["n"].cast("long")
    x = hits.select("doc_id", "th", covered.alias("n_hit"), F.explode("wids").alias("wid")).join(windows, "wid")
    x = x.groupBy("doc_id", "th").agg(F.first("n_hit").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    x = rows.join(x, _same_document(rows, x), "left").select(rows["doc_id"], rows["th"], "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return x.withColumn("contaminated", F.col("n_hit") > 0)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs without any hit, all columns kept."""
    bad = benchmark_hits(docs, benchmark, window, shingle)[1].select(F.col("doc_id").alias("bad_id"), F.col("th").alias("bad_th"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["bad_th"]), "left_anti")
