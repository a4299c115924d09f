"""Deterministic splits and samples: everything is decided by SHA-256 of seeds and keys."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.operators.components import connected_components

#: Default shares of the splits, in order, and the keys of a stratum, in order.
RATIOS = {"train": 0.8, "validation": 0.1, "test": 0.05, "holdout": 0.05}
STRATA = ["stratum", "difficulty", "document_type", "profile", "language", "source_id", "script"]


def group_key() -> Column:
    """source:group:..., source:document, source:record:... or the sample's id: the first that is known."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    return F.coalesce(F.concat(F.col("source_id"), F.lit(":group:"), some("group_id")), F.concat(F.col("source_id"), F.lit(":"), some("document_id")), F.concat(F.col("source_id"), F.lit(":record:"), some("source_record_id")), F.col("sample_id"))


def boundaries(ratios: dict[str, float] = RATIOS) -> list[tuple[str, str]]:
    """Upper ends of the splits' shares of the 256-bit range, as hexadecimal digits."""
    exact = {k: Fraction(str(v)) for k, v in ratios.items()}
    if set(exact) != set(RATIOS) or sum(exact.values()) != 1 or min(exact.values()) < 0:
        raise ValueError("shares of train, validation, test and holdout must sum to 1")
    out, upto = [], Fraction(0)
    for name in RATIOS:
        upto += exact[name]
        out.append((name, "g" if upto == 1 else format(int(upto * 2**256), "064x")))  # 'g' follows every digit
    return out


def split_for(key: Column, seed: int, ratios: dict[str, float] = RATIOS) -> Column:
    """The split of a key. Digests of fixed width compare as the numbers they spell."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:split:"), key), 256)
    out = None
    for name, end in boundaries(ratios):
        out = F.when(digest < end, name) if out is None else out.when(digest < end, name)
    return out.otherwise("holdout")


def assign_splits(df: DataFrame, seed: int, ratios: dict[str, float] = RATIOS) -> DataFrame:
    """Adds group_key, split_root and target_split (a prior one is read from target_split).

    Groups that share a file hash, a normalized text or a duplicate link are one component and get one split: the prior
    one if all that have one agree, else that of the smallest key. Failed and excluded rows stay unassigned.
    """
    x = df.withColumn("group_key", group_key())
    live = x.where(~F.col("validation_status").isin("error", "excluded"))
    named = lambda name, c: F.when(F.col(c) != "", F.concat(F.lit(name), F.col(c)))
    own = F.array_compact(F.array(F.concat(F.lit("key\x1f"), "group_key"), named("file\x1f", "file_sha256"), named("text\x1f", "normalized_text_sha256"), named("sample\x1f", "sample_id"), named("sample\x1f", "duplicate_of")))
    roots = connected_components(live.select(F.col("group_key").alias("node"), F.explode(own).alias("signal"))).select(F.col("node").alias("group_key"), F.col("root").alias("split_root"))
    known = F.when(F.col("target_split") != "unassigned", F.col("target_split"))
    prior = live.join(roots, "group_key").groupBy("split_root").agg(F.min(known).alias("lo"), F.max(known).alias("hi"))
    prior = prior.select("split_root", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(split_for(F.col("split_root"), seed, ratios)).alias("new_split"))
    x = x.join(roots.join(prior, "split_root"), "group_key", "left")
    failed = F.col("validation_status").isin("error", "excluded")
    return x.withColumn("target_split", F.when(failed, "unassigned").otherwise(F.coalesce("new_split", F.lit("unassigned")))).drop("new_split")


def split_report(df: DataFrame) -> DataFrame:
    """Per split: samples and groups."""
    return df.groupBy("target_split").agg(F.count("*").alias("samples"), F.count_distinct("group_key").alias("groups"))


def split_leaks(df: DataFrame, keys: list[str]) -> DataFrame:
    """For each key column: how many of its values are in more than one split, and in holdout and another."""
    live = df.where("target_split <> 'unassigned'")
    parts = []
    for key in keys:
        x = live.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct("target_split").alias("splits"), F.bool_or(F.col("target_split") == "holdout").alias("held"))
        parts.append(x.agg(F.count_if(F.expr("splits > 1")).alias("leaks"), F.count_if(F.expr("splits > 1 AND held")).alias("holdout_leaks")).withColumn("key", F.lit(key)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("passed", F.col("leaks") == 0)


def document_split(key: Column, seed: int, shares: list[tuple[str, float]]) -> Column:
    """By the first 64 bits of sha256(seed:key) as a fraction."""
    u = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / float(2**64 - 1)
    out, upto = None, 0.0
    for name, share in shares[:-1]:
        upto += share
        out = F.when(u < upto, name) if out is None else out.when(u < upto, name)
    return out.otherwise(shares[-1][0]) if out is not None else F.lit(shares[-1][0])


def evaluation_bucket(key: Column, per_cent: int) -> Column:
    """evaluation or training, by the first 32 bits of sha256(key) modulo 100."""
    n = F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long") % 100
    return F.when(n < per_cent, "evaluation").otherwise("training")


def hash_rank(seed: object, *parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)


def hash_fraction(seed: object, *parts: Column) -> Column:
    """A number in [0, 1) per row that depends on nothing but seed and parts."""
    return F.conv(F.substring(hash_rank(seed, *parts), 1, 12), 16, 10).cast("double") / float(16**12)


def deterministic_sample(df: DataFrame, id_: str, limit: int, seed: int) -> DataFrame:
    """The limit distinct ids of the smallest digests."""
    x = df.select(F.col(id_).alias("id")).distinct().withColumn("digest", hash_rank(seed, F.col("id")))
    return x.orderBy("digest", "id").limit(limit)


def bernoulli_by_stratum(df: DataFrame, weights: dict[str, float], seed: int, epoch: int, stratum: str = "stratum", id_: str = "sample_id", default: float = 1.0) -> DataFrame:
    """Keeps each row with its stratum's probability, whatever the order of the rows."""
    w = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col(stratum)), F.lit(default)) if weights else F.lit(default)
    return df.where(hash_fraction(f"{seed}:{epoch}", F.col(id_)) < w)


def stratum_of(columns: list[str]) -> Column:
    """key=value of the first of the STRATA that has a value."""
    return F.coalesce(*[F.when(F.col(k).cast("string") != "", F.concat(F.lit(f"{k}="), F.col(k).cast("string"))) for k in STRATA if k in columns], F.lit(None).cast("string"))


def per_key_cap(df: DataFrame, key: str, most: int, seed: int, id_: str = "sample_id") -> DataFrame:
    """At most so many rows of each key, those of the smallest digests."""
    w = Window.partitionBy(key).orderBy(hash_rank(seed, F.col(id_)), id_)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def round_robin(df: DataFrame, group: Column, order: list[Column], limit: int | None = None) -> DataFrame:
    """Adds turn (place in its group) and order: the first of each group, then the second of each, ..."""
    x = df.withColumn("grp", group).withColumn("turn", F.row_number().over(Window.partitionBy("grp").orderBy(*order)))
    return x.orderBy("turn", "grp").limit(limit) if limit is not None else x
