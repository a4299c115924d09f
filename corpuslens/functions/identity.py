"""Content-addressed ids as column expressions. The prefixes and lengths are fixed values of the data model."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\x00"
#: A domain of our own; name another store's to get its digests.
RAW_TEXT_DOMAIN = "corpuslens.text.raw.v1"


def sample_id(source: Column, path: Column, key: Column) -> Column:
    return F.concat(F.lit("smp_"), F.substring(F.sha2(F.concat_ws(NUL, source, path, key), 256), 1, 20))


def raw_text_sha256(text: Column, domain: str = RAW_TEXT_DOMAIN) -> Column:
    return F.sha2(F.concat(F.lit(domain + NUL), text), 256)


def digest_id(prefix: str, length: int, domain: str, *parts: Column) -> Column:
    """prefix + sha256(domain NUL part NUL ...)[:length]."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws(NUL, F.lit(domain), *parts), 256), 1, length))


def cluster_id(members: Column) -> Column:
    """Of an array of member ids; the order does not matter."""
    return F.concat(F.lit("CLU_"), F.substring(F.sha2(F.array_join(F.array_sort(members), NUL), 256), 1, 12))


def finding_id(kind: Column, key: Column, ids: Column) -> Column:
    return F.concat(F.lit("LKG_"), F.substring(F.sha2(F.concat_ws("|", kind, key, F.array_join(F.array_sort(ids), "|")), 256), 1, 12))


def shard_digest(*parts: Column) -> Column:
    """Our own id space: SHA-256 instead of BLAKE2b, which Spark lacks."""
    return F.concat(F.lit("shard-"), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 16))


def order_independent_digest(entries: Column) -> Column:
    """Of an array of strings."""
    return F.sha2(F.array_join(F.array_sort(entries), "\n"), 256)


def settings_fingerprint(settings: dict, length: int = 12) -> str:
    """Of a configuration, on the driver."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:length]


def loader_seed(seed: int, epoch: int = 0, world: int = 1, rank: int = 0, workers: int = 1, worker: int = 0, config: str = "") -> int:
    """A 63-bit seed of a loader's place in a run."""
    text = "\x1f".join(map(str, (seed, epoch, world, rank, workers, worker, config)))
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big") >> 1
