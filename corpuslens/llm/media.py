"""Media columns: texts' bytes as 8-bit PCM in an ISO base media file, and features read from its boxes.

store() writes one track of 8-bit unsigned mono samples ('raw ') at RATE per second. A media sample of the container
is a frame of FRAME bytes; frames lie in chunks; every KEY-th frame is marked as a sync sample. walk() reads nested
boxes, inspect() decodes the sample tables (stts, stsc, stsz, stco or co64, stss, stsd) to codec, duration and the
byte ranges of the keyframes, without reading the payload; read_back() follows the tables to the stored bytes.

Defined results: a null text is empty; an empty text is one frame of zero bytes. Each row of the input gives one row;
null doc_ids and repeated rows are kept. Other columns are not read. Broken containers raise ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import bound_batches

RATE, FRAME, KEY, CHUNK_FRAMES = 8000, 64, 16, 256
#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"}


def payload_of(text: bytes) -> bytes:
    """The text with zero bytes up to a positive multiple of FRAME."""
    return text + bytes(-len(text) % FRAME if text else FRAME)


def _box(kind: bytes, *body: bytes) -> bytes:
    data = b"".join(body)
    if len(data) + 8 >= 1 << 32:
        return struct.pack(">I4sQ", 1, kind, len(data) + 16) + data
    return struct.pack(">I4s", len(data) + 8, kind) + data


def _full(kind: bytes, *body: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *body)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def store(payload: bytes) -> bytes:
    """An ISO media file that holds the payload, a positive multiple of FRAME bytes, losslessly."""
    frames = len(payload) // FRAME
    if frames == 0 or len(payload) % FRAME:
        raise ValueError("the payload must be a positive multiple of a frame")
    kind = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    head = _box(b"mdat", payload)[: 16 if len(payload) + 8 >= 1 << 32 else 8]
    first = len(kind) + len(head)
    chunks = -(-frames // CHUNK_FRAMES)
    places = first + np.arange(chunks, dtype=np.uint64) * np.uint64(FRAME * CHUNK_FRAMES)
    long = first + len(payload) >= 1 << 32
    keys = np.arange(1, frames + 1, KEY)
    runs = [(1, min(frames, CHUNK_FRAMES), 1)]
    if frames > CHUNK_FRAMES and frames % CHUNK_FRAMES:
        runs.append((chunks, frames % CHUNK_FRAMES, 1))
    entry = struct.pack(">6xH8xHHIHHI", 1, 1, 8, 0, 0, 0, RATE << 16)[: 28]
    table = _box(
        b"stbl", _full(b"stsd", struct.pack(">I", 1), _box(b"raw ", entry)), _full(b"stts", struct.pack(">III", 1, frames, FRAME)),
        _full(b"stss", struct.pack(">I", len(keys)), keys.astype(">u4").tobytes()), _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        _full(b"stsz", struct.pack(">II", FRAME, frames)), _full(b"co64" if long else b"stco", struct.pack(">I", chunks), places.astype(">u8" if long else ">u4").tobytes()),
    )
    units = frames * FRAME
    wide = int(units >= 1 << 32)
    when = (lambda unit: struct.pack(">QQIQ", 0, 0, unit, units)) if wide else (lambda unit: struct.pack(">IIII", 0, 0, unit, units))
    track = struct.pack(">QQIIQ", 0, 0, 1, 0, units) if wide else struct.pack(">IIIII", 0, 0, 1, 0, units)
    movie = _box(
        b"moov", _full(b"mvhd", when(RATE), struct.pack(">IH10x", 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2), version=wide),
        _box(
            b"trak", _full(b"tkhd", track, struct.pack(">8xHHHxx", 0, 0, 0x100), _MATRIX, bytes(8), version=wide, flags=3),
            _box(
                b"mdia", _full(b"mdhd", when(RATE), struct.pack(">HH", 0x55C4, 0), version=wide), _full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"\0"),
                _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table),
            ),
        ),
    )
    return kind + head + payload + movie


def walk(data, lo: int = 0, hi: int | None = None, path: tuple[bytes, ...] = ()):
    """(path, body start, end) of each box, outer before inner. Sizes of 32 and 64 bits and 'to the end' are known."""
    hi = len(data) if hi is None else hi
    while lo < hi:
        if hi - lo < 8:
            raise ValueError("a box is cut off")
        size, kind = struct.unpack_from(">I4s", data, lo)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, lo + 8)[0] if hi - lo >= 16 else 0, 16
        elif size == 0:
            size = hi - lo
        if size < head or lo + size > hi:
            raise ValueError(f"box {kind!r} is larger than what holds it")
        yield (*path, kind), lo + head, lo + size
        if kind in NESTED:
            yield from walk(data, lo + head, lo + size, (*path, kind))
        lo += size


def _rows(data, lo: int, kind: str, width: int, skip: int = 4) -> np.ndarray:
    n = struct.unpack_from(">I", data, lo + skip)[0]
    return np.frombuffer(data, kind, n * width, lo + skip + 4).astype(np.int64).reshape(n, width)


def inspect(data: bytes) -> list[dict]:
    """For each track: codec, timescale, duration (units), samples, offsets and sizes of the samples, keyframes: array of (start, end)."""
    tracks: list[dict] = []
    for path, lo, hi in walk(data):
        kind = path[-1]
        if kind == b"trak":
            tracks.append({})
        if not tracks:
            continue
        t = tracks[-1]
        if kind == b"mdhd":
            t["timescale"], t["duration"] = struct.unpack_from(">IQ" if data[lo] else ">II", data, lo + (20 if data[lo] else 12))
        elif kind == b"stsd":
            t["codec"] = data[lo + 12 : lo + 16].decode("latin-1")
        elif kind == b"stts":
            t["stts"] = _rows(data, lo, ">u4", 2)
        elif kind == b"stss":
            t["stss"] = _rows(data, lo, ">u4", 1)[:, 0]
        elif kind == b"stsc":
            t["stsc"] = _rows(data, lo, ">u4", 3)
        elif kind == b"stsz":
            each, n = struct.unpack_from(">II", data, lo + 4)
            t["sizes"] = np.full(n, each, np.int64) if each else np.frombuffer(data, ">u4", n, lo + 12).astype(np.int64)
        elif kind in (b"stco", b"co64"):
            t["chunks"] = _rows(data, lo, ">u4" if kind == b"stco" else ">u8", 1)[:, 0]
    out = []
    for t in tracks:
        if missing := {"codec", "timescale", "stts", "stsc", "sizes", "chunks"} - t.keys():
            raise ValueError(f"a track lacks {sorted(missing)}")
        sizes, chunks, runs = t["sizes"], t["chunks"], t["stsc"]
        per_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1)))
        if per_chunk.sum() != len(sizes) or int(t["stts"][:, 0].sum()) != len(sizes):
            raise ValueError("the sample tables disagree")
        before = np.cumsum(sizes) - sizes
        first = np.cumsum(per_chunk) - per_chunk
        offsets = np.repeat(chunks, per_chunk) + before - np.repeat(before[first], per_chunk)
        keys = t["stss"] - 1 if "stss" in t else np.arange(len(sizes))
        out.append({"codec": t["codec"], "timescale": t["timescale"], "duration": int((t["stts"][:, 0] * t["stts"][:, 1]).sum()), "samples": len(sizes), "offsets": offsets, "sizes": sizes, "keyframes": np.stack([offsets[keys], offsets[keys] + sizes[keys]], axis=1)})
    return out


def read_back(data: bytes, track: dict) -> bytes:
    """The samples of a track, in order, joined; neighbouring ones are read at once."""
    offsets, sizes = track["offsets"], track["sizes"]
    cut = np.flatnonzero(np.append(True, offsets[1:] != offsets[:-1] + sizes[:-1]))
    ends = np.append(cut[1:], len(sizes)) - 1
    return b"".join(data[a : b + n] for a, b, n in zip(offsets[cut].tolist(), offsets[ends].tolist(), sizes[ends].tolist()))


SCHEMA = "n_bytes long, media binary, codec string, timescale int, duration long, samples long, keyframes array<struct<start:long,end:long>>"


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id and the media columns of each row's text: the stored file and what its boxes say."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 64):  # bounded output batches
                rows = []
                for text in batch.column("text").slice(lo, 64).cast(pa.binary()).to_pylist():
                    data = store(payload_of(text or b""))
                    t = inspect(data)[0]
                    rows.append((len(text or b""), data, t["codec"], t["timescale"], t["duration"], t["samples"], [{"start": a, "end": b} for a, b in t["keyframes"].tolist()]))
                kinds = [pa.int64(), pa.binary(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, 64), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], ["doc_id", "n_bytes", "media", "codec", "timescale", "duration", "samples", "keyframes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def read_media(media: DataFrame) -> DataFrame:
    """Adds payload_bytes, payload_sha256 and tail_crc32 (of the last FRAME bytes), read from column media through its sample tables."""

    def run(batches):
        for batch in batches:
            rows = []
            for data in batch.column("media").to_pylist():
                payload = read_back(data, inspect(data)[0])
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-FRAME:])))
            n, sha, crc = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(crc, pa.int64())], [*batch.schema.names, "payload_bytes", "payload_sha256", "tail_crc32"])

    from pyspark.sql import types as T

    more = [T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType())]
    return media.mapInArrow(run, T.StructType([*media.schema.fields, *more]))


def feature(media: DataFrame) -> DataFrame:
    """Adds feature: codec, rate, duration, samples, and the number, first and last of the keyframe ranges."""
    k = F.col("keyframes")
    edge = lambda i: F.concat_ws("-", F.element_at(k, i)["start"], F.element_at(k, i)["end"])
    return media.withColumn("feature", F.concat_ws(";", F.concat(F.lit("codec="), F.trim("codec")), F.concat(F.lit("rate="), "timescale"), F.concat(F.lit("duration="), "duration"), F.concat(F.lit("samples="), "samples"), F.concat(F.lit("keys="), F.size(k)), F.concat(F.lit("first="), edge(1)), F.concat(F.lit("last="), edge(-1))))
