"""The library's operators composed: preparing a corpus, the quality gate, exporting training data, analysing a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import protection
from corpuslens.operators import compare, dedupe, evaluate, quality, splits
from corpuslens.operators.components import checkpointing


def prepare(samples: DataFrame, seed: int, findings: list[Column] | None = None) -> DataFrame:
    """Samples (see dedupe and splits) validated, classified as duplicates and split; the result is checkpointed, since four reports read it."""
    checkpointing(samples.sparkSession)
    x = quality.validate(samples, findings) if findings else samples
    x = dedupe.classify_duplicates(x)
    return splits.assign_splits(x, seed).checkpoint()


def prepare_reports(prepared: DataFrame) -> dict[str, DataFrame]:
    """Health, splits, leaks between splits and duplicate clusters of a prepared corpus."""
    return {
        "health": quality.histograms(prepared, {"language": F.col("language"), "status": F.col("validation_status"), "duplicates": F.col("duplicate_state"), "split": F.col("target_split")}),
        "splits": splits.split_report(prepared), "leaks": splits.split_leaks(prepared, ["group_key", "file_sha256", "normalized_text_sha256"]), "clusters": dedupe.family_clusters(prepared),
    }


def gate(samples: DataFrame, near_texts: DataFrame | None = None) -> dict[str, DataFrame]:
    """The quality gate over prepared samples: findings of leakage, decisions, clean and quarantined rows, verdict over all issues."""
    checkpointing(samples.sparkSession)
    x = samples.withColumn("malformed", F.lit(False)).withColumn("partition", protection.partition_of(F.col("target_split"), F.col("source_split"), F.lit(False)))
    x = x.withColumn("protected", F.col("partition") == "PROTECTED").withColumn("canonical", F.col("duplicate_state") == "canonical").checkpoint()
    leaks = quality.detect_leakage(x, near_texts=near_texts)
    rows = x.withColumn("transformations", F.size("transformations"))
    clusters = rows.join(rows.groupBy("root").count().where("count > 1").select("root"), "root").select(F.col("root").cast("string").alias("cluster_id"), "sample_id")
    issues = rows.where("validation_status = 'error'").select("sample_id", F.lit("VALIDATION_FAILED").alias("code"), F.lit("error").alias("severity"))
    decisions = quality.exclusions(rows, clusters, issues, leaks).checkpoint()
    every = quality.issues_of(leaks).select("severity").unionByName(issues.select("severity"))
    return {"leaks": leaks, "decisions": decisions, "clean": quality.clean_rows(x, decisions), "quarantine": quality.quarantine_rows(x, decisions), "verdict": quality.verdict(every), "report": quality.exclusion_report(decisions)}


def training_export(samples: DataFrame, catalog: DataFrame, purpose: str, seed: int, per_source: int | None = None, balance: Column | None = None) -> DataFrame:
    """Licensed rows, one per file hash, capped per source, interleaved over groups, with a split by document."""
    x = quality.licence_decisions(samples.withColumn("dataset_id", F.col("source_id")), catalog, purpose).where("allowed")
    x = dedupe.keep_first(x, "file_sha256", "sample_id")
    if per_source is not None:
        x = splits.per_key_cap(x, "source_id", per_source, seed)
    if balance is not None:
        x = splits.round_robin(x, balance, [splits.hash_rank(seed, F.col("sample_id")), F.col("sample_id")])
    return x.withColumn("export_split", splits.document_split(F.coalesce("document_id", "sample_id"), seed, [("train", 0.9), ("validation", 0.05), ("test", 0.05)]))


def analyse_run(baseline: DataFrame, candidate: DataFrame, strategy: str = "hardest_only", size: int = 50, history: DataFrame | None = None) -> dict[str, DataFrame]:
    """A run against a baseline: changes, extremes, category deltas, hard examples with buckets, and what to take next."""
    compared = compare.compare_runs(baseline, candidate)
    hard = compare.failure_buckets(compare.hard_examples(candidate))
    return {"changes": compared, "counts": compare.comparison_counts(compared), "extremes": compare.extremes(compared), "deltas": compare.error_deltas(baseline, candidate), "hard": hard, "next": compare.recommend(hard, strategy, size, history=history)}


def evaluate_run(pages: DataFrame, dimensions: list[str]) -> dict[str, DataFrame]:
    """Measured pages: summary by each dimension, metric rows, run summary, worst pages."""
    metrics = evaluate.unpivot_metrics(pages, ["page_id", "model_id"], ["cer", "wer", "ncer", "exact"])
    return {"summary": evaluate.by_each_dimension(pages, dimensions), "metrics": metrics, "run": evaluate.run_summary(metrics, "model_id"), "worst": evaluate.worst(pages, "cer", 50)}
