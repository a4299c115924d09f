"""Comparing runs, ranking hard examples, bucketing failures, recommending batches, selecting rows.

Sample rows: sample_id, cer, wer, ncer (double), error_type_counts (map of string to int), metadata (map of strings).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.operators.components import checkpointing
from corpuslens.operators.splits import hash_rank

#: Thresholds, weights, severities and categories of the analysis.
THRESHOLDS = {"improve": 0.05, "regress": 0.05, "failure_cer": 0.5}
WEIGHTS = {"cer": 0.30, "wer": 0.15, "ncer": 0.15, "regression_magnitude": 0.10, "error_diversity": 0.10, "persistent_failure_count": 0.10, "distortion_severity": 0.05, "error_type_rarity": 0.05}
SEVERITY = {"none": 0.0, "low": 0.33, "light": 0.33, "medium": 0.66, "mid": 0.66, "high": 1.0, "heavy": 1.0, "severe": 1.0}
BUCKET_LIMITS = {"high_cer": 0.4, "high_wer": 0.5, "dominant_share": 0.4}
DOMINANT = [
    ("whitespace_heavy", ["whitespace"]),
    ("digit_heavy", ["arabic_digit", "latin_digit", "digit_system_confusion", "digit_word"]),
    ("punctuation_heavy", ["punctuation"]),
    ("diacritics_heavy", ["diacritic", "diacritics_heavy"]),
    ("deletion_heavy", ["missing_arabic_character", "missing_latin_character", "missing_character", "missing_word"]),
    ("insertion_heavy", ["extra_arabic_character", "extra_latin_character", "extra_character", "extra_word"]),
    ("severe_substitution", ["character_substitution", "hamza_alef_variant", "ya_alef_maqsura", "ta_marbuta_ha", "arabic_latin_script", "word_substitution"]),
]
DISTORTED = [
    ("distorted_blur", ["gaussian_blur", "motion_blur", "low_resolution", "defocus"]),
    ("distorted_skew", ["rotation", "skew", "perspective"]),
    ("distorted_compression", ["jpeg_compression", "low_contrast"]),
]
SEED = 20260723


def compare_runs(base: DataFrame, candidate: DataFrame, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """Samples of both runs (sample_id, cer, wer, ncer; ids are unique): before, after, deltas and the class of the change."""
    t = THRESHOLDS | thresholds
    side = lambda df, s: df.select("sample_id", *[F.col(c).alias(f"{c}_{s}") for c in ("cer", "wer", "ncer")])
    x = side(base, "before").join(side(candidate, "after"), "sample_id")
    b, a = F.col("cer_before"), F.col("cer_after")
    change = (
        F.when((b < t["failure_cer"]) & (a >= t["failure_cer"]), "newly_failed").when((b >= t["failure_cer"]) & (a < t["failure_cer"]), "recovered")
        .when(a < b - t["improve"], "improved").when(a > b + t["regress"], "regressed").otherwise("unchanged")
    )
    for c in ("cer", "wer", "ncer"):
        x = x.withColumn(f"{c}_delta", F.col(f"{c}_after") - F.col(f"{c}_before"))
    return x.withColumn("classification", change).withColumn("persistent", (b >= t["failure_cer"]) & (a >= t["failure_cer"]))


def comparison_counts(compared: DataFrame) -> DataFrame:
    return compared.groupBy("classification").agg(F.count("*").alias("samples"), F.avg("cer_delta").alias("mean_cer_delta"))


def extremes(compared: DataFrame, limit: int = 10) -> DataFrame:
    """The worst regressions and best improvements: kind, place, sample_id, cer_delta."""
    one = lambda kind, classes, order: compared.where(F.col("classification").isin(classes)).orderBy(order, "sample_id").limit(limit).withColumn("kind", F.lit(kind))
    x = one("regression", ["regressed", "newly_failed"], F.col("cer_delta").desc()).unionByName(one("improvement", ["improved", "recovered"], F.col("cer_delta")))
    order = [F.when(F.col("kind") == "regression", -F.col("cer_delta")).otherwise(F.col("cer_delta")), "sample_id"]
    return x.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(*order))).select("kind", "place", "sample_id", "cer_delta")


def error_deltas(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """Total change of each error category over the common samples, zero changes of a sample left out."""
    one = lambda df, n: df.select("sample_id", F.explode("error_type_counts").alias("category", n))
    common = base.select("sample_id").join(candidate.select("sample_id"), "sample_id")
    x = one(base, "b").join(one(candidate, "c"), ["sample_id", "category"], "full").join(common, "sample_id", "left_semi")
    x = x.withColumn("delta", F.coalesce("c", F.lit(0)) - F.coalesce("b", F.lit(0))).where("delta <> 0")
    return x.groupBy("category").agg(F.sum("delta").alias("delta"), F.count("*").alias("samples"))


def config_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, value) rows of two flattened configurations: keys whose values differ or lack on a side."""
    x = left.withColumnRenamed("value", "left_value").join(right.withColumnRenamed("value", "right_value"), "key", "full")
    return x.where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def winner(left: Column, right: Column, complete: Column) -> Column:
    """left, right or tie by the smaller metric, if both are complete."""
    return F.when(complete, F.when(left < right, "left").when(left > right, "right").otherwise("tie"))


def _clip(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(x, F.lit(0.0))))


def hard_examples(df: DataFrame, weights: dict[str, float] = WEIGHTS, failure_cer: float = 0.5, digits: int = 6) -> DataFrame:
    """Adds signals, score (rounded half even to so many places) and rank, by falling score and id.

    The batch maxima and category shares are one row each, joined by a broadcast cross join of a single aggregate row.
    """
    if unknown := set(weights) - set(WEIGHTS):
        raise ValueError(f"unknown signals {sorted(unknown)}")
    weights = {k: weights.get(k, WEIGHTS[k]) for k in WEIGHTS}
    counts = F.coalesce("error_type_counts", F.create_map().cast("map<string,int>"))
    x = df.withColumn("_counts", counts)
    top = x.agg(F.greatest(F.max(F.size("_counts")), F.lit(1)).alias("_cats"), F.nullif(F.max(F.coalesce(F.col("persistent_failure_count"), F.lit(0.0))), F.lit(0.0)).alias("_pers"), F.nullif(F.max(F.coalesce(F.col("regression_magnitude"), F.lit(0.0))), F.lit(0.0)).alias("_regr"))
    totals = x.select(F.explode("_counts").alias("category", "n")).groupBy("category").agg(F.sum("n").alias("n"))
    shares = totals.agg(F.map_from_entries(F.collect_list(F.struct("category", "n"))).alias("_totals"), F.sum("n").alias("_all"))  # a row; categories are a closed list
    x = x.join(F.broadcast(top)).join(F.broadcast(shares))
    keys = F.map_keys("_counts")
    share = F.aggregate(keys, F.lit(0.0), lambda s, k: s + F.coalesce(F.try_element_at("_totals", k).cast("double"), F.lit(0.0)) / F.greatest(F.col("_all"), F.lit(1)))
    severity = F.lower(F.coalesce(F.col("severity"), F.lit("none")))
    signals = {
        "cer": _clip(F.col("cer")), "wer": _clip(F.col("wer")), "ncer": _clip(F.col("ncer")), "regression_magnitude": _clip(F.col("regression_magnitude") / F.coalesce("_regr", F.lit(1.0))),
        "error_diversity": F.size(keys) / F.col("_cats"), "persistent_failure_count": _clip(F.col("persistent_failure_count") / F.coalesce("_pers", F.lit(1.0))),
        "distortion_severity": F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in SEVERITY.items() for v in kv]), severity), F.lit(0.0)),
        "error_type_rarity": F.when(F.size(keys) > 0, _clip(1.0 - share / F.size(keys))).otherwise(0.0),
    }
    x = x.withColumn("signals", F.struct(*[F.bround(v, 6).alias(k) for k, v in signals.items()], (F.coalesce("cer", F.lit(0.0)) >= failure_cer).cast("double").alias("cross_model_failure")))
    score = sum((F.lit(weights[k]) * v for k, v in signals.items()), F.lit(0.0))
    x = x.withColumn("score", F.bround(score, digits)).drop("_counts", "_cats", "_pers", "_regr", "_totals", "_all")
    return ranked(x, [F.col("score").desc(), F.col("sample_id")])


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the place of each row in a total order, from 1, without a single task: rows are range-partitioned, counted and numbered in each part.

    The ordered parts are checkpointed: the counts and the numbers must see the same parts, and sampled range bounds may
    differ between two runs of a plan.
    """
    checkpointing(df.sparkSession)
    x = df.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint().withColumn("_at", F.monotonically_increasing_id())
    # the id holds the partition in its upper bits and the place in it in the lower ones
    x = x.withColumn("_part", F.shiftright("_at", 33)).withColumn("_in", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = x.groupBy("_part").agg(F.count("*").alias("_n"))  # a row per part
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    return x.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_in") + 1).cast("long")).drop("_at", "_part", "_in", "_before")


def select_hard(ranked_rows: DataFrame, percentile: float | None = None, least: float | None = None, top: int | None = None) -> DataFrame:
    """Of hard_examples(): the first max(1, round-half-even(n percentile / 100)), then of a least score, then the first top."""
    x = ranked_rows
    if percentile is not None:
        n = ranked_rows.agg(F.greatest(F.lit(1), F.bround(F.count("*") * percentile / 100.0, 0)).alias("_cut"))
        x = x.join(F.broadcast(n)).where(F.col("rank") <= F.col("_cut")).drop("_cut")
    if least is not None:
        x = x.where(F.col("score") >= least)
    return x.orderBy("rank").limit(top) if top is not None else x


def failure_buckets(df: DataFrame, limits: dict[str, float] = BUCKET_LIMITS) -> DataFrame:
    """Adds buckets (array, in the order of the rules, or ['unknown']) and primary_bucket.

    distortions: array of strings; metadata keys: language, content_type, small_text, text_size, document_type.
    """
    limits = BUCKET_LIMITS | limits
    counts = F.coalesce("error_type_counts", F.create_map().cast("map<string,int>"))
    n = lambda names: F.aggregate(F.map_values(F.map_filter(counts, lambda k, _: k.isin(names))), F.lit(0), lambda s, v: s + v)
    total = F.aggregate(F.map_values(counts), F.lit(0), lambda s, v: s + v)
    meta = lambda k: F.try_element_at("metadata", F.lit(k))
    rules = [("high_cer", F.col("cer") >= limits["high_cer"]), ("high_wer", F.col("wer") >= limits["high_wer"])]
    rules += [(name, (total > 0) & (n(cats) / F.greatest(total, F.lit(1)) >= limits["dominant_share"])) for name, cats in DOMINANT]
    rules += [(name, F.arrays_overlap(F.coalesce("distortions", F.array().cast("array<string>")), F.array(*map(F.lit, kinds)))) for name, kinds in DISTORTED]
    rules += [
        ("mixed_arabic_english", F.lower(meta("content_type")).contains("mixed") | meta("language").isin("ar+en", "ar-en", "mixed")),
        ("small_text", (meta("small_text") == "true") | (meta("text_size") == "small")),
        ("table_form", F.lower(meta("document_type")).isin("table", "form", "invoice", "receipt")),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules]))
    x = df.withColumn("buckets", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("unknown"))))
    return x.withColumn("primary_bucket", F.element_at("buckets", 1))


def recommend(df: DataFrame, strategy: str, size: int, seed: int = SEED, history: DataFrame | None = None, group: str = "group") -> DataFrame:
    """size rows of hard_examples() for the next batch, without the ids of history: sample_id, rank, place.

    hardest_only, deterministic_random, balanced_hard (round robin over groups), diversity_first (the hardest of each
    group, then the hardest) or mixed_curriculum (a third hardest, a third next, the rest easiest).
    """
    x = df if history is None else df.join(history.select("sample_id").distinct(), "sample_id", "left_anti")
    if strategy == "hardest_only":
        order = [F.col("rank")]
    elif strategy == "deterministic_random":
        order = [hash_rank(f"lab-recommend:{seed}", F.col("sample_id")), F.col("sample_id")]
    elif strategy in ("balanced_hard", "diversity_first"):
        x = x.withColumn("_turn", F.row_number().over(Window.partitionBy(group).orderBy("rank")))
        order = [F.col("_turn"), F.col(group)] if strategy == "balanced_hard" else [(F.col("_turn") > 1).cast("int"), F.col("rank")]
    elif strategy == "mixed_curriculum":
        hard = -(-size // 3)
        first = x.orderBy("rank").limit(2 * hard).select("sample_id", "rank").withColumn("_part", F.lit(0))
        easy = x.select("sample_id", "rank").orderBy(F.col("rank").desc()).limit(size).join(first.select("sample_id"), "sample_id", "left_anti").withColumn("_part", F.lit(1))
        x = first.limit(size).unionByName(easy)
        order = [F.col("_part"), F.when(F.col("_part") == 0, F.col("rank")).otherwise(-F.col("rank"))]
    else:
        raise ValueError(f"unknown strategy {strategy}")
    x = x.orderBy(*order).limit(size)  # size rows at most: one task numbers them
    return x.withColumn("place", F.row_number().over(Window.orderBy(*order))).select("sample_id", "rank", "place")


def balance_counts(selected: DataFrame, dimension: str) -> DataFrame:
    return selected.groupBy(F.coalesce(F.col(dimension).cast("string"), F.lit("unspecified")).alias(dimension)).agg(F.count("*").alias("count"))


def usage(history: DataFrame) -> DataFrame:
    """history (purpose, sample_ids): in how many batches of which purposes each id was."""
    x = history.select("purpose", F.explode(F.array_distinct("sample_ids")).alias("sample_id"))
    return x.groupBy("sample_id").agg(F.count("*").alias("batches"), F.array_sort(F.collect_set("purpose")).alias("purposes"))


def sample_rows(df: DataFrame, score: str | None = None, id_: str = "sample_id", random: int | None = None, hardest: int | None = None, easiest: int | None = None, window: tuple[float, float] | None = None, limit: int | None = None, seed: int = 0) -> DataFrame:
    """One kind of sampling, by precedence: random, hardest or easiest (missing scores last; 0: all), a percentile window (a missing score is 0), then a limit."""
    if random is not None:
        return df.orderBy(hash_rank(seed, F.col(id_)), id_).limit(random)
    if hardest is not None or easiest is not None:
        order = [F.col(score).desc_nulls_last(), F.col(id_).desc()] if hardest is not None else [F.col(score).asc_nulls_last(), F.col(id_)]
        k = hardest if hardest is not None else easiest
        return df.orderBy(*order).limit(k) if k else df.orderBy(*order)
    x = df
    if window is not None:
        value = F.coalesce(F.col(score), F.lit(0.0))
        ends = df.agg(F.percentile(value, window[0] / 100).alias("_lo"), F.percentile(value, window[1] / 100).alias("_hi"))
        x = x.join(F.broadcast(ends)).where(value.between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    return x.orderBy(id_).limit(limit) if limit is not None else x


def matches(criteria: dict, columns: list[str]) -> Column:
    """The conjunction of criteria over row columns: equality or membership for plain names, tags (all of them), min_/max_ for
    scores (a missing score fails), distortion (any), error_type (a key of error_type_counts)."""
    out = F.lit(True)
    for name, value in criteria.items():
        if value is None:
            continue
        if name == "tags":
            test = F.size(F.array_except(F.array(*map(F.lit, value)), F.coalesce("tags", F.array().cast("array<string>")))) == 0
        elif name == "distortion":
            test = F.arrays_overlap("distortions", F.array(*map(F.lit, [value] if isinstance(value, str) else value)))
        elif name == "error_type":
            test = F.map_contains_key("error_type_counts", F.lit(value))
        elif name.startswith("min_"):
            test = F.col(name[4:]) >= value
        elif name.startswith("max_"):
            test = F.col(name[4:]) <= value
        elif name == "split" and "target_split" in columns:
            test = F.coalesce(F.nullif("target_split", F.lit("")), F.col("split") if "split" in columns else F.lit(None)).isin(value if isinstance(value, list) else [value])
        else:
            test = F.col(name).isin(value if isinstance(value, list) else [value])
        out = out & F.coalesce(test, F.lit(False))
    return out


def select_rows(df: DataFrame, protected: Column, criteria: dict, ids: DataFrame | None = None) -> DataFrame:
    """Rows that are not protected and match; with ids (sample_id), those alone, whatever the criteria."""
    safe = df.where(~F.coalesce(protected, F.lit(True)))
    return safe.join(ids.select("sample_id").distinct(), "sample_id", "left_semi") if ids is not None else safe.where(matches(criteria, df.columns))
