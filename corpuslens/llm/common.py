"""What several operators share: word splitting, shared scratch tables, byte-level word hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words once A-Z is lower-cased: ASCII other than 0-9 and a-z.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text as an array: A-Z lower-cased, runs of 0-9, a-z and non-ASCII. Null and empty texts have none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN_WORDS), "")


def gram_hash(words: Column, pos: Column, k: int, n: Column) -> Column:
    """64-bit hash of the k words from pos on, null where fewer are left. Code-generated, unlike a lambda over the array."""
    return F.when(pos + k <= n, F.xxhash64(*[F.get(words, pos + i) for i in range(k)]))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master gets one of its own if that is unset."""
    there = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        there = f"file://{tempfile.mkdtemp(prefix='corpuslens-')}"
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


#: Bytes of an Arrow batch, unless the session sets spark.sql.execution.arrow.maxBytesPerBatch itself. The default of Spark
#: counts rows only, so that long texts would make batches of any size.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Sets the session's limit, which stays: it counts when a result is computed, not when it is declared."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1))) == 2**31 - 1:
        spark.conf.set(key, str(BATCH_BYTES))


#: Rows of a file of a scratch table.
ROWS_PER_FILE = 100_000


class Scratch:
    """Tables written to the shared folder. They cut lineage, survive lost executors and are read column by column.

    A result that reads them is computed when it is used, so they live as long as the driver: Hadoop deletes the folder
    when the driver's JVM ends. A driver that is killed leaves it behind.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", 0

    def table(self, df: DataFrame, rows: int | None = ROWS_PER_FILE) -> DataFrame:
        """A table of df in files of about so many rows each (None: a file per partition).

        The rows are computed by all tasks and kept on the executors' disks until they are written, so that a small
        result of many partitions does not become as many files.
        """
        self.n += 1
        path = f"{self.root}/{self.n}"
        if rows is None:
            df.write.parquet(path)
        else:
            kept = df.persist(StorageLevel.DISK_ONLY)
            files = max(1, -(-kept.count() // rows))
            kept.coalesce(files).write.parquet(path)
            kept.unpersist()
        if self.n == 1:
            root, fs = self._place(self.root)
            fs.deleteOnExit(root)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def _place(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def drop(self, df: DataFrame) -> None:
        """Deletes a table of this scratch that no later plan reads."""
        path, fs = self._place(df.scratch_path)
        fs.delete(path, True)


# ---- hashing of words on whole byte buffers, for the Arrow operators ----

_rng = np.random.Generator(np.random.PCG64(20240917))
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_STEP = np.uint64(int(_rng.integers(0, 1 << 63)) * 2 + 1)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0], have = 1, 1
    with np.errstate(over="ignore"):
        step = base
        while have < n:
            take = min(have, n - have)
            out[have : have + take] = out[:take] * step
            have += take
            step = step * step
    return out


_pow: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def hash_slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice data[start:end] of a byte buffer.

    A prefix sum of byte codes times powers of an odd base gives the hash of any slice as a difference, so a whole
    buffer is hashed by a few vector operations.
    """
    n = len(data)
    if len(_pow[0]) < n + 1:
        size = max(n + 1, 1 << 18)
        _pow[0], _pow[1] = _powers(_STEP, size), _powers(_BACK, size)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _pow[0][:n], out=total[1:])
    h = (total[end] - total[start]) * _pow[1][start]
    return mix(h ^ (end - start).astype(np.uint64))


def hash_words(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of word bytes in a buffer, and a hash of each run. is_word must be False between any two texts."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], is_word, [False])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    return start, hash_slices(data, start, end) if len(start) else np.empty(0, np.uint64)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column, one zero byte after each text, and each text's start (and the end)."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if n and column.buffers()[2] else np.empty(0, np.uint8)
    starts = offsets - offsets[0] + np.arange(n + 1)
    out = np.zeros(len(raw) + n, np.uint8)
    keep = np.ones(len(out), bool)
    keep[starts[1:] - 1] = False
    out[keep] = raw
    return out, starts


def slices(sizes: np.ndarray, most: int):
    """Runs of values with about so much in total; each has one value at least."""
    lo = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > lo and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if len(sizes):
        yield lo, len(sizes)
