"""Record tables: dashboards with conditional aggregates, upserts, guarded transitions, quotas, scores, shards, orders, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.operators.splits import hash_fraction, hash_rank


# ---- dashboards ----


def statistics(df: DataFrame, as_of: str, at: str = "created_at", status: str = "status", cost: str = "cost", quality: str = "quality", seconds: str = "seconds") -> DataFrame:
    """One row: totals, by state, in the windows of a day, a week and a month before as_of (a date), costs, means, success rate."""
    day, when = F.to_date(F.lit(as_of)), F.to_date(F.col(at))
    done, failed = F.col(status) == "done", F.col(status) == "failed"
    n = F.count("*")
    return df.agg(
        n.alias("total"), F.count_if(done).alias("done"), F.count_if(failed).alias("failed"), F.count_if(when == day).alias("today"), F.count_if(when.between(F.date_sub(day, 6), day)).alias("last_7_days"),
        F.count_if(when.between(F.trunc(day, "MM"), day)).alias("this_month"), F.coalesce(F.sum(cost), F.lit(0.0)).alias("cost"), F.coalesce(F.sum(F.when(when == day, F.col(cost))), F.lit(0.0)).alias("cost_today"),
        F.avg(F.when(done, F.col(quality))).alias("mean_quality"), F.avg(F.when(done, F.col(seconds))).alias("mean_seconds"), F.coalesce(F.count_if(done) / F.nullif(F.count_if(done | failed), F.lit(0)), F.lit(0.0)).alias("success_rate"),
    )


def most_frequent(df: DataFrame, column: str, limit: int = 1) -> DataFrame:
    """The values that occur most, ties by value."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count")).orderBy(F.col("count").desc(), column).limit(limit)


def performance(df: DataFrame, by: str, ok: Column) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("runs"), F.count_if(~ok).alias("failures"), F.avg("seconds").alias("mean_seconds"), F.avg("quality").alias("mean_quality"))


def preferred(df: DataFrame, by: list[str], score: str, least: int = 2) -> DataFrame:
    """The combination of the best mean score plus min(6, 0.4 n), of those with at least so many runs."""
    x = df.groupBy(*by).agg(F.avg(score).alias("mean"), F.count("*").alias("n")).where(F.col("n") >= least)
    return x.withColumn("value", F.col("mean") + F.least(F.lit(6.0), 0.4 * F.col("n"))).orderBy(F.col("value").desc(), *by).limit(1)


def provider_score(success: Column, latency: Column, quality: Column, bonus: Column) -> Column:
    """Composite of a success rate, a latency in seconds and a quality in per cent."""
    return 50.0 * success + 0.4 * quality - F.least(F.lit(20.0), latency) + bonus


def rule_confidence(accepted: Column, rejected: Column, sources: Column) -> Column:
    """min(0.99, accepted / max(1, accepted + rejected) * min(1, sources / 3))."""
    return F.least(F.lit(0.99), accepted / F.greatest(F.lit(1), accepted + rejected) * F.least(F.lit(1.0), sources / 3.0))


def rules_of(examples: DataFrame) -> DataFrame:
    """Review examples (pattern, replacement, job_id, accepted) to rules with counts, distinct sources and confidence."""
    x = examples.groupBy("pattern", "replacement").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"), F.count_distinct("job_id").alias("sources"))
    return x.withColumn("confidence", rule_confidence(F.col("accepted"), F.col("rejected"), F.col("sources")))


def active_rules(rules: DataFrame, sources: int = 3, confidence: float = 0.9) -> DataFrame:
    """Rules (id, approved, enabled, is_sensitive, sources, confidence) that may be applied, the surest first."""
    flags = F.col("approved") & F.col("enabled") & ~F.col("is_sensitive")
    return rules.where(flags & (F.col("sources") >= sources) & (F.col("confidence") >= confidence)).orderBy(F.col("confidence").desc(), "id")


def readiness(df: DataFrame, least_jobs: int = 3, least_examples: int = 10) -> DataFrame:
    """Counts of examples, accepted ones, distinct jobs and patterns, and whether they suffice to learn."""
    x = df.agg(F.count("*").alias("examples"), F.count_if("accepted").alias("accepted"), F.count_distinct("job_id").alias("jobs"), F.count_distinct("pattern").alias("patterns"))
    return x.withColumn("label", F.when(F.col("accepted") == 0, "empty").when((F.col("jobs") >= least_jobs) & (F.col("accepted") >= least_examples), "ready").otherwise("collecting"))


def improvement(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("evaluations"), F.avg("before").alias("mean_before"), F.avg("after").alias("mean_after"), F.avg(F.col("after") - F.col("before")).alias("improvement"))


def last_and_best(metrics: DataFrame, larger_is_better: list[str]) -> DataFrame:
    """Metric log (run_id, metric_name, step, value): last and best value of each metric of a run."""
    up = F.col("metric_name").isin(larger_is_better)
    x = metrics.groupBy("run_id", "metric_name").agg(F.max_by("value", "step").alias("last"), F.max("value").alias("hi"), F.min("value").alias("lo"), F.count("*").alias("points"))
    return x.select("run_id", "metric_name", "last", F.when(up, F.col("hi")).otherwise(F.col("lo")).alias("best"), "points")


def best_run(metrics: DataFrame, metric: str, larger_is_better: bool) -> DataFrame:
    value = F.col("best") if larger_is_better else -F.col("best")
    x = last_and_best(metrics.where(F.col("metric_name") == metric), [metric] if larger_is_better else [])
    return x.orderBy(value.desc(), "run_id").limit(1)


def by_class_top(df: DataFrame, group: str, order: list[Column], most: dict[str, int], default: int = 10) -> DataFrame:
    """The first rows of each class, by a number of its own."""
    limit = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in most.items() for x in kv]), F.col(group)), F.lit(default)) if most else F.lit(default)
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= limit)


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds, null if none does."""
    out = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        out = F.when(F.coalesce(rule, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def document_profile(pages: DataFrame, by: str, text: str) -> DataFrame:
    """Per document: pages, mean characters, Arabic share, pages with text, category and signature."""
    arabic = F.regexp_count(F.col(text), F.lit("[؀-ۿ]"))
    x = pages.groupBy(by).agg(F.count("*").alias("pages"), F.avg(F.length(text)).alias("mean_chars"), (F.sum(arabic) / F.greatest(F.sum(F.length(text)), F.lit(1))).alias("arabic_ratio"), F.count_if(F.length(F.trim(text)) > 0).alias("with_text"))
    category = F.when(F.col("with_text") == 0, "scanned").when(F.col("mean_chars") < 200, "sparse").when(F.col("arabic_ratio") > 0.5, "arabic").otherwise("text")
    x = x.withColumn("category", category)
    return x.withColumn("signature", F.concat_ws("|", "category", F.col("pages").cast("string"), F.round(F.col("mean_chars") / 100).cast("long").cast("string")))


# ---- keyed stores ----


def upsert(store: DataFrame, entries: DataFrame, key: str, policy: str, content: str = "content") -> DataFrame:
    """store (key, content, version) with entries (key, content) under a policy: reject (a known key with other content fails), skip_identical
    (also fails on other content), overwrite, or version_new (other content becomes the next version, the old ones stay)."""
    now = store.groupBy(key).agg(F.max("version").alias("_v"), F.max_by(content, "version").alias("_old"))
    x = entries.join(now, key, "left")
    same, known = F.col(content).eqNullSafe(F.col("_old")), F.col("_v").isNotNull()
    if policy in ("reject", "skip_identical"):
        clash = known if policy == "reject" else known & ~same
        fresh = x.where(F.assert_true(~clash, "the key is taken").isNull()).where(~known)
        return store.unionByName(fresh.select(key, content, F.lit(1).alias("version")))
    if policy == "overwrite":
        return store.join(entries.select(key), key, "left_anti").unionByName(x.select(key, content, F.coalesce("_v", F.lit(1)).alias("version")))
    if policy == "version_new":
        return store.unionByName(x.where(~known | ~same).select(key, content, (F.coalesce("_v", F.lit(0)) + 1).alias("version")))
    raise ValueError(f"unknown policy {policy}")


def append_once(store: DataFrame, rows: DataFrame, key: list[str], ignore: list[str]) -> tuple[DataFrame, DataFrame]:
    """(new rows, conflicts): rows whose key is known are dropped if equal but for ignored columns, else conflicts."""
    compared = [c for c in rows.columns if c not in ignore]
    digest = F.sha2(F.to_json(F.struct(*compared), {"ignoreNullFields": "false"}), 256)
    known = store.select(*key, digest.alias("_stored")).distinct()
    x = rows.withColumn("_own", digest).dropDuplicates([*key, "_own"]).join(known, key, "left")
    return x.where("_stored IS NULL").drop("_own", "_stored"), x.where("_stored IS NOT NULL AND _stored <> _own").drop("_own", "_stored")


def transition(df: DataFrame, wanted: DataFrame, allowed: list[tuple[str, str]], key: str) -> DataFrame:
    """Rows (key, status) with wanted (key, target): status moves along allowed steps only; outcome is moved, refused or kept."""
    x = df.join(wanted, key, "left")
    ok = F.lit(False)
    for a, b in allowed:
        ok = ok | ((F.col("status") == a) & (F.col("target") == b))
    outcome = F.when(F.col("target").isNull(), "kept").when(ok, "moved").otherwise("refused")
    return x.withColumn("outcome", outcome).withColumn("status", F.when(F.col("outcome") == "moved", F.col("target")).otherwise(F.col("status"))).drop("target")


def next_version(df: DataFrame, by: str, order: str) -> DataFrame:
    return df.withColumn("version", F.row_number().over(Window.partitionBy(by).orderBy(order)))


def newest(df: DataFrame, at: str, id_: str, limit: int | None = None, where: Column | None = None) -> DataFrame:
    """Rows by falling time and id."""
    x = (df if where is None else df.where(where)).orderBy(F.col(at).desc(), F.col(id_).desc())
    return x.limit(limit) if limit is not None else x


def latest(df: DataFrame, at: str, id_: str, *columns: str) -> DataFrame:
    """One row: the columns of the newest row in which they are known."""
    return df.agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(at, id_))).alias(c) for c in columns])


def recover_stale(df: DataFrame, as_of: Column, seconds: int) -> DataFrame:
    """Processing rows whose heartbeat is older: queued again if retries are left, else failed."""
    stale = (F.col("status") == "processing") & (F.unix_micros(F.col("heartbeat")) < F.unix_micros(as_of) - seconds * 1_000_000)
    return df.withColumn("status", F.when(stale & (F.col("retries_left") > 0), "queued").when(stale, "failed").otherwise(F.col("status"))).withColumn("retries_left", F.when(stale & (F.col("retries_left") > 0), F.col("retries_left") - 1).otherwise(F.col("retries_left")))


def rollup(child: DataFrame, parent: DataFrame, key: str, value: str, total: str) -> DataFrame:
    """The parent with the sum of its children's values, 0 without any."""
    sums = child.groupBy(key).agg(F.sum(value).alias(total))
    return parent.drop(total).join(sums, key, "left").withColumn(total, F.coalesce(total, F.lit(0.0)))


# ---- quotas ----


def daily_quota(df: DataFrame, scope: str, at: str, limit: int, order: str) -> DataFrame:
    """admitted: the first limit events of a scope and UTC day."""
    w = Window.partitionBy(scope, F.to_date(at)).orderBy(at, order)
    return df.withColumn("place", F.row_number().over(w)).withColumn("admitted", F.col("place") <= limit)


def sliding_load(df: DataFrame, scope: str, at: str, seconds: int, amount: Column | None = None) -> DataFrame:
    """load: the amount in the window that ends with each event (its own included, as are those of the same instant)."""
    w = Window.partitionBy(scope).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn("load", F.sum(F.lit(1) if amount is None else amount).over(w))


def sessions(df: DataFrame, scope: str, at: str, gap: str) -> DataFrame:
    x = df.groupBy(scope, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("events"))
    return x.select(scope, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def running_usage(df: DataFrame, by: list[str], at: str, order: str, amounts: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(at, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for a in amounts:
        df = df.withColumn(f"used_{a}", F.sum(a).over(w))
    return df


# ---- shards and orders ----


def with_position(df: DataFrame, key: str, order: str, name: str = "position") -> DataFrame:
    """Place in a partition of the data, from 0."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)


def count_shards(df: DataFrame, order: list[Column], rows: int) -> DataFrame:
    """Shards of rows in a total order: shard, place."""
    from corpuslens.operators.compare import ranked

    x = ranked(df, order, "_rank")
    return x.withColumn("shard", F.floor((F.col("_rank") - 1) / rows).cast("long")).withColumn("place", F.pmod(F.col("_rank") - 1, F.lit(rows)).cast("long")).drop("_rank")


def size_shards(df: DataFrame, order: list[Column], size: str, most: int) -> DataFrame:
    """Shards by the running total of sizes in a total order: shard = floor(total before the row / most).

    A row larger than the limit spans several numbers; a shard exceeds the limit by less than its last row. Unlike a greedy
    fold this needs no single task: totals are taken per part and added.
    """
    from corpuslens.operators.compare import ranked

    x = ranked(df, order, "_rank").withColumn("_block", F.floor((F.col("_rank") - 1) / 10_000))
    sums = x.groupBy("_block").agg(F.sum(size).alias("_sum"))
    before = sums.select("_block", F.coalesce(F.sum("_sum").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_block").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    x = x.join(before, "_block").withColumn("_at", F.col("_base") + F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return x.withColumn("shard", F.floor(F.col("_at") / most).cast("long")).drop("_rank", "_block", "_base", "_at")


def epoch_order(df: DataFrame, id_: str, seed: int, epoch: int) -> DataFrame:
    """The order of an epoch as a sortable key."""
    return df.withColumn("order_key", hash_rank(f"{seed}:{epoch}", F.col(id_)))


def owned_by(id_: Column, slots: int, seed: int = 0) -> Column:
    """Which of so many workers owns a row."""
    return F.floor(hash_fraction(f"slot:{seed}", id_) * slots).cast("int")


def batches(df: DataFrame, order: list[Column], size: int, drop_last: bool = False) -> DataFrame:
    """batch and its rows' ids in order. df: sample_id."""
    x = count_shards(df, order, size)
    x = x.groupBy(F.col("shard").alias("batch")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "sample_id"))), lambda r: r["sample_id"]).alias("sample_ids"))
    return x.where(F.size("sample_ids") == size) if drop_last else x


def bounded_shuffle(df: DataFrame, buffer: int, seed: int) -> DataFrame:
    """Rows of each partition in the order of a shuffle with a buffer of so many rows."""
    import random

    def run(frames):
        import pandas as pd

        rng, held, columns = random.Random(seed), [], None
        for frame in frames:
            columns, out = frame.columns, []
            for row in frame.itertuples(index=False):
                if len(held) < buffer:
                    held.append(row)
                    continue
                i = rng.randrange(buffer)
                out.append(held[i])
                held[i] = row
            if out:
                yield pd.DataFrame(out, columns=columns)
        if held:
            rng.shuffle(held)
            yield pd.DataFrame(held, columns=columns)

    return df.mapInPandas(run, df.schema)


def shard_index(stored: DataFrame) -> DataFrame:
    """shard, rows, and a digest of its ids that does not depend on their order: the sum of their 64-bit hashes, which is aggregated, not gathered."""
    return stored.groupBy("shard").agg(F.count("*").alias("rows"), F.sum(F.xxhash64("sample_id").cast("decimal(38,0)")).alias("digest"))


def verify_shards(stored: DataFrame, index: DataFrame) -> DataFrame:
    """Rows of shards (shard, sample_id) against an index as by shard_index(): problem, shard."""
    own = shard_index(stored).select("shard", F.col("rows").alias("n"), F.col("digest").alias("d"))
    x = index.join(own, "shard", "full")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("rows").isNull(), "unknown").when(F.col("n") != F.col("rows"), "count").when(F.col("d") != F.col("digest"), "digest")
    x = x.select("shard", problem.alias("problem")).where("problem IS NOT NULL")
    twice = stored.groupBy("sample_id").agg(F.count("*").alias("c"), F.min("shard").alias("shard")).where("c > 1").select("shard", F.lit("repeated_id").alias("problem"))
    return x.unionByName(twice)


def digest_of(df: DataFrame, *columns: str) -> DataFrame:
    """Order-independent digest of a table: rows, and the sum of 64-bit row hashes as a decimal, which any partitioning gives alike."""
    return df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("digest"))


def experiment_rows(df: DataFrame, id_: str, kinds: list[str], levels: list[str], variants: int, seed: int) -> DataFrame:
    """Every row with every kind, level and variant of an experiment, each with a seed of its own; the lists are settings."""
    plan = F.flatten(F.transform(F.array(*map(F.lit, kinds)), lambda k: F.flatten(F.transform(F.array(*map(F.lit, levels)), lambda s: F.transform(F.sequence(F.lit(0), F.lit(variants - 1)), lambda v: F.struct(k.alias("kind"), s.alias("level"), v.alias("variant")))))))
    x = df.select(id_, F.explode(plan).alias("p")).select(id_, "p.kind", "p.level", "p.variant")
    return x.withColumn("seed", F.conv(F.substring(hash_rank(seed, F.col(id_), F.col("kind"), F.col("level"), F.col("variant")), 1, 8), 16, 10).cast("long"))


def chunks(df: DataFrame, id_: str, text: str, size: int) -> DataFrame:
    """Texts in pieces of so many characters; equal pieces are marked but for their first."""
    n = F.greatest(F.ceil(F.length(text) / size).cast("int"), F.lit(1))
    x = df.select(id_, text, F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    x = x.select(id_, "chunk", F.substring(F.col(text), F.col("chunk") * size + 1, F.lit(size)).alias("piece")).withColumn("digest", F.sha2("piece", 256))
    w = Window.partitionBy("digest").orderBy(id_, "chunk")
    return x.withColumn("seen", F.row_number().over(w) > 1)


def drift(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, value) rows: expected names that lack or have another value."""
    x = expected.withColumnRenamed("value", "expected").join(observed.withColumnRenamed("value", "observed"), "name", "left")
    return x.where(~F.col("expected").eqNullSafe(F.col("observed"))).withColumn("kind", F.when(F.col("observed").isNull(), "missing").otherwise("changed"))


def reconcile(source: DataFrame, destination: DataFrame) -> DataFrame:
    """Files (path, size, digest) against copies: planned, size_mismatch, checksum_mismatch or verified."""
    x = source.join(destination.select("path", F.col("size").alias("size2"), F.col("digest").alias("digest2")), "path", "left")
    return x.withColumn("status", F.when(F.col("size2").isNull(), "planned").when(F.col("size") != F.col("size2"), "size_mismatch").when(F.col("digest") != F.col("digest2"), "checksum_mismatch").otherwise("verified"))


def preview(df: DataFrame, order: str, limit: int) -> DataFrame:
    """The first rows and whether there are more."""
    x = df.orderBy(order).limit(limit + 1)
    x = x.withColumn("_n", F.row_number().over(Window.orderBy(order))).withColumn("has_more", F.max("_n").over(Window.partitionBy()) > limit)
    return x.where(F.col("_n") <= limit).drop("_n")


def substitutions(df: DataFrame, before: str, after: str, keep: int = 2500) -> DataFrame:
    """Word pairs that replaced each other at the same place of texts with equally many words, the most frequent ones."""
    a, b = F.split(before, " "), F.split(after, " ")
    x = df.where(F.size(a) == F.size(b)).select(F.explode(F.arrays_zip(a.alias("x"), b.alias("y"))).alias("p")).where("p.x <> p.y")
    return x.groupBy(F.col("p.x").alias("before"), F.col("p.y").alias("after")).agg(F.count("*").alias("count")).orderBy(F.col("count").desc(), "before", "after").limit(keep)
