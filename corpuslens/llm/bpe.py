"""Byte-level BPE: encoding by a global shuffle of distinct words, decoding by the table of token bytes.

Encoding. Texts are cut into pre-tokens on the JVM. A chunk (some thousand documents of one partition) turns its pre-tokens
into positions in the chunk's own list of distinct words, so a word that fills the corpus leaves a chunk once, not
once per place. The words of all chunks are shuffled by word: each distinct word is encoded once, by the merges of the
rank file. The ids go back to the chunks that hold the word, meet the documents' position lists there, and the id
sequences are put together by position. Both exchanges carry a chunk's distinct words, so no key is hot.

A chunk's number is a hash of its place (partition, turn in it) and its content. The two branches of the plan cut the
input apart, so the input must be a stored table, whose scans a repeated task cuts alike; what is not is stored first
(parameter stored). Were a chunk ever cut differently, its words would be missing and the job fails instead of giving
wrong ids.

Decoding. The table of token bytes, which the vocabulary bounds, goes to every task, and each Arrow batch's ids are
joined to it there by id, a map-side join on whole arrays: texts are not shuffled to be put together again.

Defined results: null and empty texts encode to no ids and decode to no bytes. Each row of the input gives one row;
null doc_ids and repeated rows are kept. Other columns are not read. Ids outside the table decode to an error.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpuslens.llm.common import Scratch, bound_batches, hash_slices, slices

#: Bytes of pre-tokens of a chunk; of the words of a bucket that are encoded at a time.
CHUNK, PIECE = 32 << 20, 8 << 20
#: White space as the tokenizer's pattern means it; Java's \s is ASCII only.
SPACE = r"\t-\r\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def java_pattern(pattern: str) -> str:
    r"""The pattern for Java: \s, \S and [^\s...] spelled out."""
    return pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"(?!\S)", f"(?![^{SPACE}])").replace(r"\s", f"[{SPACE}]")


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes)))


def _binary(sizes: np.ndarray, data) -> pa.Array:
    """A binary array of values of these sizes that stand one after another in data."""
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(_offsets(sizes).astype(np.int64).tobytes()), pa.py_buffer(data)])


def _parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and bytes of the values of a binary array."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    return np.diff(offsets), data[offsets[0] : offsets[-1]]


def _gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of values that begin at starts, one after another."""
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return values[:0]
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])]


def _pack(*parts: np.ndarray) -> tuple[int, bytes]:
    """Uncompressed size and zstd form of some arrays: their byte lengths, then their bytes."""
    raw = np.array([p.nbytes for p in parts], np.int64).tobytes() + b"".join(p.tobytes() for p in parts)
    return len(raw), pa.compress(raw, "zstd", asbytes=True)


def _unpack(raw: int, blob: bytes, *kinds) -> list[np.ndarray]:
    data, at, out = pa.decompress(blob, raw, "zstd", asbytes=True), 8 * len(kinds), []
    for kind, size in zip(kinds, np.frombuffer(data, np.int64, len(kinds)).tolist()):
        out.append(np.frombuffer(data[at : at + size], kind))
        at += size
    return out


def _cut(pattern: str, buckets: int, id_type: pa.DataType, want: str):
    """Arrow batches of (doc_id, part, tokens, odd) to packed rows of chunks: the chunk's distinct words by bucket of the
    word's hash (want 'words'), or its documents as places in the list of words (want 'docs')."""

    def run(batches):
        import regex
        import xxhash

        other = regex.compile(pattern)
        codes, dictionaries, held, turn = [], [], 0, 0
        per_doc, doc_ids = [], []

        def flush(part):
            """The packed rows of the batches held, one chunk."""
            bases = _offsets([len(d) for d in dictionaries])
            joint = pa.concat_arrays(dictionaries).dictionary_encode()  # of the batches' words the chunk's
            place = np.asarray(joint.indices, np.int32)
            at = np.concatenate([place[b + c] for b, c in zip(bases, codes)])
            sizes, data = _parts(joint.dictionary)
            counts, ids = np.concatenate(per_doc), pa.concat_arrays(doc_ids)
            digest = xxhash.xxh64(np.array([part, turn]).tobytes())
            digest.update(at.tobytes())
            digest.update(sizes.tobytes())
            digest.update(data.tobytes())
            chunk = int(np.uint64(digest.intdigest()).astype(np.int64))
            if want == "words":
                offsets = _offsets(sizes)
                bucket = (hash_slices(data, offsets[:-1], offsets[1:]) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable").astype(np.int32)
                cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
                for lo, hi in zip(cuts[:-1], cuts[1:]):
                    own = order[lo:hi]
                    raw, blob = _pack(own, sizes[own].astype(np.int32), _gather(data, offsets[own], sizes[own]))
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([int(bucket[own[0]])], pa.int32()), "chunk": [chunk], "raw": [raw], "blob": [blob]})
            else:
                offsets = _offsets(counts)
                for lo, hi in slices(counts, 200_000):
                    raw, blob = _pack(counts[lo:hi], at[offsets[lo] : offsets[hi]])
                    some = pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), ids.slice(lo, hi - lo))
                    yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([True]), some, pa.array([raw]), pa.array([blob])], PACKED)

        for batch in batches:
            tokens, odd = batch.column("tokens"), batch.column("odd")
            if odd.null_count < len(odd):  # characters that Java's tables don't know
                tokens = pa.array([t if o is None else other.findall(o) for t, o in zip(tokens.to_pylist(), odd.to_pylist())], pa.list_(pa.string()))
            coded = tokens.flatten().dictionary_encode()
            codes.append(np.asarray(coded.indices, np.int32))
            dictionaries.append(coded.dictionary.cast(pa.binary()))
            per_doc.append(np.asarray(tokens.value_lengths().fill_null(0), np.int64))
            doc_ids.append(batch.column("doc_id").cast(id_type))
            held += tokens.nbytes
            part = batch.column("part")[0].as_py() if len(batch) else -1
            if held >= CHUNK:
                yield from flush(part)
                codes, dictionaries, held, turn = [], [], 0, turn + 1
                per_doc, doc_ids = [], []
        if codes:
            yield from flush(part)

    return run


PACKED = ["chunk", "is_doc", "doc_ids", "raw", "blob"]


def _encode_words(ranks: bytes, pattern: str, id_type: pa.DataType):
    """Packed words sorted by bucket: each distinct word of a bucket is encoded once, its ids go back to each chunk. Holds
    a bucket's distinct words with their ids, and PIECE bytes of its chunks."""

    def run(batches):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})._encode_single_piece

        def flush(held, known):
            parts = [_unpack(x["raw"], x["blob"], np.int32, np.int32, np.uint8) for x in held]
            sizes = np.concatenate([p[1] for p in parts]).astype(np.int64)
            coded = _binary(sizes, b"".join(p[2].tobytes() for p in parts)).dictionary_encode()
            ids = []
            for w in coded.dictionary.to_pylist():
                if (x := known.get(w)) is None:
                    x = known[w] = (i,) if (i := table.get(w)) is not None else tuple(encode(w))
                ids.append(x)
            n = np.fromiter(map(len, ids), np.int32, len(ids))
            flat, first = np.fromiter((i for x in ids for i in x), np.int32, int(n.sum())), np.cumsum(n, dtype=np.int64) - n
            index, lo = np.asarray(coded.indices, np.int64), 0
            none = pa.array([[]], pa.list_(id_type))
            for x, (at, _, _) in zip(held, parts):
                w = index[lo : lo + len(at)]
                lo += len(at)
                raw, blob = _pack(at, n[w], _gather(flat, first[w], n[w].astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([x["chunk"]]), pa.array([False]), none, pa.array([raw]), pa.array([blob])], PACKED)

        bucket, held, size, known = None, [], 0, {}
        for batch in batches:
            for x in batch.to_pylist():
                if held and (x["bucket"] != bucket or size >= PIECE):
                    yield from flush(held, known)
                    held, size = [], 0
                if x["bucket"] != bucket:
                    bucket, known = x["bucket"], {}
                held.append(x)
                size += x["raw"]
        if held:
            yield from flush(held, known)

    return run


class TokenBytes:
    """The table of token bytes by id, as arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        token = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            token[i] = b
        self.sizes = np.fromiter(map(len, token), np.int64, len(token))
        self.data = np.frombuffer(b"".join(token), np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def decode(self, ids: np.ndarray, per_doc: np.ndarray) -> pa.Array:
        """The bytes of runs of ids, joined to the table by id; per_doc: lengths of the runs."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.sizes) or not self.sizes[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        upto = _offsets(self.sizes[ids])[_offsets(per_doc)]
        return _binary(np.diff(upto), _gather(self.data, self.starts[ids], self.sizes[ids]).tobytes()).cast(pa.binary())


def _assemble(id_type: pa.DataType, table: TokenBytes | None, names: list[str]):
    """Packed rows sorted by chunk, a chunk's words before its documents, to (doc_id, ids) and, with a table, the decoded
    bytes. Holds one chunk's words."""

    def run(batches):
        chunk, held, known = None, [], None
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                if (key := row.column("chunk")[0].as_py()) != chunk:
                    chunk, held, known = key, [], None
                raw, blob = row.column("raw")[0].as_py(), row.column("blob")[0].as_py()
                if not row.column("is_doc")[0].as_py():
                    held.append(_unpack(raw, blob, np.int32, np.int32, np.int32))
                    known = None
                    continue
                if known is None:
                    where, n, values = (np.concatenate([np.empty(0, np.int32), *x]) for x in (zip(*held) if held else ((), (), ())))
                    starts, counts = np.full(where.max(initial=-1) + 1, -1, np.int64), np.zeros(where.max(initial=-1) + 1, np.int64)
                    starts[where], counts[where] = np.cumsum(n, dtype=np.int64) - n, n
                    known, held = True, []
                per_doc, w = _unpack(raw, blob, np.int64, np.int32)
                if len(w) and (w.max() >= len(starts) or (starts[w] < 0).any()):
                    raise RuntimeError("a chunk was cut differently in two runs of its task; store the input as a table first")
                ids, upto = _gather(values, starts[w], counts[w]), _offsets(counts[w])[_offsets(per_doc)]
                columns = [row.column("doc_ids").flatten().cast(id_type), pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(ids))]
                yield pa.RecordBatch.from_arrays(columns + ([table.decode(ids, np.diff(upto))] if table else []), names)

    return run


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, stored: bool = False, decoded: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of each row of docs (doc_id, text). ranks_path is read on the driver only.

    stored: docs is a scan of a stored table (columns may be computed from a row alone); else its two columns are written
    to the shared folder first. decoded: the name of a further column, what the ids decode to (as by decode_ids(), but in the
    tasks that put the ids together, so that no second Python worker is needed). A bucket of words is held by one task, so the number of shuffle partitions is to grow
    with the corpus's distinct words, as for any aggregation by word.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select("doc_id", "text") if stored else Scratch(spark).table(docs.select("doc_id", "text"), rows=None)
    with open(ranks_path, "rb") as f:
        ranks = f.read()  # bounded by the vocabulary
    text = F.coalesce(F.col("text"), F.lit(""))
    odd = F.rlike(text, F.lit(r"\p{Cn}"))
    x = docs.select("doc_id", text.alias("text"), odd.alias("o"))
    x = x.select("doc_id", F.spark_partition_id().alias("part"), F.when(F.col("o"), F.col("text")).alias("odd"), F.when(~F.col("o"), F.regexp_extract_all("text", F.lit(java_pattern(pattern)), F.lit(0))).alias("tokens"))
    kind = docs.schema["doc_id"].dataType
    arrow, buckets = to_arrow_type(kind), int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = f"chunk long, is_doc boolean, doc_ids array<{kind.simpleString()}>, raw long, blob binary"
    words = x.mapInArrow(_cut(pattern, buckets, arrow, "words"), "bucket int, chunk long, raw long, blob binary")
    ids = words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_encode_words(ranks, pattern, arrow), packed)
    places = x.mapInArrow(_cut(pattern, buckets, arrow, "docs"), packed)
    both = ids.unionByName(places).repartition("chunk").sortWithinPartitions("chunk", "is_doc")
    names = ["doc_id", "ids"] + ([decoded] if decoded else [])
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("ids", T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.BinaryType())] if decoded else [])])
    return both.mapInArrow(_assemble(arrow, TokenBytes(read_ranks(ranks_path)) if decoded else None, names), schema)


def decode_ids(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes of each row's ids, by a map-side join of the ids with the table of token bytes."""
    table = TokenBytes(read_ranks(ranks_path))
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())])

    def run(batches):
        for batch in batches:
            counts = np.asarray(batch.column(ids).value_lengths().fill_null(0), np.int64)
            for lo, hi in slices(counts, 200_000):  # bounds what is held besides the batch
                part, per_doc = batch.slice(lo, hi - lo), counts[lo:hi]
                flat = np.asarray(part.column(ids).flatten(), np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, table.decode(flat, per_doc)], [*batch.schema.names, out])

    return df.mapInArrow(run, schema)
