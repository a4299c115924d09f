"""The driver's tables as the records that operators take, each with the same view in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions import identity
from corpuslens.functions.edit import spread, with_page_metrics


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sample_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id and text of samples(), from the documents alone: no text is shuffled to a label that is not read."""
    n = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select(identity.sample_id(F.col("source"), F.concat(F.lit("docs/"), "lang", F.lit("/"), n, F.lit(".txt")), n).alias("sample_id"), "text")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as samples; quality gives the status, the id the document, group, record and prior split."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    i, n = F.col("doc_id"), F.col("doc_id").cast("string")
    path = F.concat(F.lit("docs/"), "lang", F.lit("/"), n, F.lit(".txt"))
    return d.select(
        i.alias("row"), "doc_id", "text", F.col("lang").alias("language"), F.col("source").alias("source_id"), path.alias("source_path"), identity.sample_id(F.col("source"), path, n).alias("sample_id"), "n_chars", "quality", "toxic",
        F.when(i % 3 == 0, F.concat(F.lit("r"), (i % 200).cast("string"))).alias("source_record_id"), F.sha2("text", 256).alias("file_sha256"),
        F.sha2(F.lower(F.trim(F.regexp_replace("text", r"[ \n\t]+", " "))), 256).alias("normalized_text_sha256"), F.concat(F.lit("d"), F.floor(i / 8).cast("string")).alias("document_id"), (i % 8).cast("int").alias("page_index"),
        F.concat(F.lit("p"), (i % 8).cast("string")).alias("page_id"), F.when(i % 5 == 0, F.concat(F.lit("g"), F.floor(i / 100).cast("string"))).alias("group_id"),
        F.when(F.col("quality") == 0, "error").when(F.col("quality") == 1, "ok").otherwise("warning").alias("validation_status"),
        F.when(i % 11 == 0, "test").when(i % 11 == 1, "Protected_Holdout").when(i % 11 != 2, "train").alias("source_split"), F.lit("unassigned").alias("target_split"),
        F.when(i % 7 == 0, F.array(F.lit("blur"))).otherwise(F.array().cast("array<string>")).alias("transformations"), F.lit(None).cast("string").alias("duplicate_of"),
    )


SAMPLES = r"""s AS (SELECT d.doc_id AS "row", d.doc_id, d.text, d.lang AS language, d.source AS source_id, 'docs/' || d.lang || '/' || d.doc_id || '.txt' AS source_path,
  'smp_' || substr(sha256(d.source || chr(0) || 'docs/' || d.lang || '/' || d.doc_id || '.txt' || chr(0) || d.doc_id), 1, 20) AS sample_id, d.n_chars, l.quality, l.toxic,
  CASE WHEN d.doc_id % 3 = 0 THEN 'r' || (d.doc_id % 200) END AS source_record_id, sha256(d.text) AS file_sha256, sha256(lower(trim(regexp_replace(d.text, '[ \n\t]+', ' ', 'g'), ' '))) AS normalized_text_sha256,
  'd' || (d.doc_id // 8) AS document_id, d.doc_id % 8 AS page_index, 'p' || (d.doc_id % 8) AS page_id, CASE WHEN d.doc_id % 5 = 0 THEN 'g' || (d.doc_id // 100) END AS group_id,
  CASE l.quality WHEN 0 THEN 'error' WHEN 1 THEN 'ok' ELSE 'warning' END AS validation_status,
  CASE WHEN d.doc_id % 11 = 0 THEN 'test' WHEN d.doc_id % 11 = 1 THEN 'Protected_Holdout' WHEN d.doc_id % 11 <> 2 THEN 'train' END AS source_split, d.doc_id % 7 = 0 AS derived
  FROM documents d LEFT JOIN labels l USING (doc_id)),
gk AS (SELECT *, coalesce(source_id || ':group:' || group_id, source_id || ':' || document_id) AS group_key FROM s)"""


def recognized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as pages with a reference (other than ASCII as '?', since DuckDB's edit distance counts bytes), and a prediction with errors of a known kind."""
    t = F.col("turn")
    x = table(spark, sf_dir, "conversations").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string")).alias("page_id"), F.col("conv_id"), t, F.col("role").alias("model_id"), F.concat(F.lit("p"), (F.col("conv_id") % 3).cast("string")).alias("profile"),
        F.regexp_replace("text", r"[^\x00-\x7F]", "?").alias("reference"), (F.col("conv_id") % 17 * 0.5).alias("seconds"),
        F.when(F.col("conv_id") % 4 == 0, F.array(F.lit("gaussian_blur"))).when(F.col("conv_id") % 4 == 1, F.array(F.lit("rotation"), F.lit("jpeg_compression"))).alias("distortions"),
    )
    r = F.col("reference")
    guess = F.when(t % 4 == 0, r).when(t % 4 == 1, F.replace(r, F.lit("e"), F.lit("a"))).when(t % 4 == 2, F.left(r, F.floor(F.length(r) * 3 / 4).cast("int"))).otherwise(F.replace(r, F.lit(" "), F.lit("")))
    return spread(x.withColumn("prediction", guess), "page_id")


RECOGNIZED = r"""r AS (SELECT conv_id || ':' || turn AS page_id, conv_id, turn, role AS model_id, 'p' || (conv_id % 3) AS profile, regexp_replace(text, '[^\x00-\x7F]', '?', 'g') AS reference, conv_id % 17 * 0.5::DOUBLE AS seconds,
  CASE conv_id % 4 WHEN 0 THEN ['gaussian_blur'] WHEN 1 THEN ['rotation', 'jpeg_compression'] END AS distortions FROM conversations),
p AS (SELECT *, CASE turn % 4 WHEN 0 THEN reference WHEN 1 THEN replace(reference, 'e', 'a') WHEN 2 THEN left(reference, length(reference) * 3 // 4) ELSE replace(reference, ' ', '') END AS prediction FROM r),
m AS (SELECT page_id, conv_id, turn, model_id, profile, seconds, distortions, reference, prediction,
  CASE WHEN reference = prediction THEN 0.0::DOUBLE WHEN length(reference) = 0 THEN 1.0::DOUBLE ELSE levenshtein(reference, prediction) / length(reference)::DOUBLE END AS cer FROM p),
e AS (SELECT *, CASE WHEN reference = prediction THEN 1 ELSE 0 END AS exact, CASE WHEN trim(prediction) = '' THEN 1 ELSE 0 END AS empty FROM m)"""


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_page_metrics(recognized(spark, sf_dir))


def analysed(spark: SparkSession, sf_dir: str, run: int = 0) -> DataFrame:
    """Documents as measured samples of a run; all values follow from the id."""
    i = F.col("doc_id")
    n = [((i + run) % 5).cast("int"), (i % 3).cast("int"), ((i * 7 + run) % 4).cast("int")]
    counts = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, ("whitespace", "diacritic", "missing_word"))), F.array(*n)), lambda _, v: v > 0)
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("s"), F.lpad(i.cast("string"), 8, "0")).alias("sample_id"), ((i * 37 + run * 11) % 100 / 100.0).alias("cer"), ((i * 53 + run * 29) % 100 / 100.0).alias("wer"), ((i * 17 + run * 5) % 100 / 100.0).alias("ncer"),
        ((i * 13) % 40 / 100.0).alias("regression_magnitude"), (i % 6).cast("double").alias("persistent_failure_count"), F.element_at(F.array(*map(F.lit, ("none", "low", "medium", "high"))), (i % 4 + 1).cast("int")).alias("severity"), counts.alias("error_type_counts"),
        F.create_map(F.lit("language"), F.when(i % 9 == 0, "ar+en").otherwise(F.col("lang")), F.lit("document_type"), F.when(i % 10 == 0, "Form").otherwise("book")).alias("metadata"),
        F.when(i % 8 == 0, F.array(F.lit("motion_blur"))).when(i % 8 == 1, F.array(F.lit("skew"), F.lit("low_contrast"))).alias("distortions"), F.col("source").alias("group"), F.col("lang").alias("language"),
    )


def analysed_sql(name: str, run: int = 0) -> str:
    return f"""{name} AS (SELECT 's' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS sample_id, (doc_id * 37 + {run * 11}) % 100 / 100.0::DOUBLE AS cer, (doc_id * 53 + {run * 29}) % 100 / 100.0::DOUBLE AS wer, (doc_id * 17 + {run * 5}) % 100 / 100.0::DOUBLE AS ncer,
  (doc_id * 13) % 40 / 100.0::DOUBLE AS regr, (doc_id % 6)::DOUBLE AS pers, [0.0, 0.33, 0.66, 1.0][doc_id % 4 + 1]::DOUBLE AS sev, (doc_id + {run}) % 5 AS n1, doc_id % 3 AS n2, (doc_id * 7 + {run}) % 4 AS n3, doc_id,
  CASE WHEN doc_id % 9 = 0 THEN 'ar+en' ELSE lang END AS mlang, doc_id % 10 = 0 AS form, source AS grp, lang AS language FROM documents)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as jobs with a state, cost, quality and duration."""
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("user_id"), F.col("event_type").alias("engine"), F.when(i % 10 < 7, "done").when(i % 10 < 9, "failed").otherwise("pending").alias("status"),
        (i % 50 / 100.0).alias("cost"), (50 + i % 50).cast("double").alias("quality"), (i % 30 / 2.0).alias("seconds"), F.when(i % 10 >= 7, F.concat(F.lit("reason"), (i % 4).cast("string"))).alias("failure"),
    )


JOBS = """j AS (SELECT event_id AS id, ts AS created_at, user_id, event_type AS engine, CASE WHEN event_id % 10 < 7 THEN 'done' WHEN event_id % 10 < 9 THEN 'failed' ELSE 'pending' END AS status,
  event_id % 50 / 100.0::DOUBLE AS cost, (50 + event_id % 50)::DOUBLE AS quality, event_id % 30 / 2.0::DOUBLE AS seconds, CASE WHEN event_id % 10 >= 7 THEN 'reason' || (event_id % 4) END AS failure FROM events)"""
