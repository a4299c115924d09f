"""Reading and writing: file trees, sidecar texts, record files, manifests with a header, exports."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.functions.text import relative_path, spreadsheet_cell

#: Kinds of files by suffix, folders and files that are never read, columns of the CSV export.
KINDS = {"image": ["png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp"], "text": ["txt"], "record": ["jsonl", "csv", "tsv"], "reference": ["json", "md", "pdf"]}
JUNK = r"(?:^|/)(?:\.[^/]+|__pycache__|node_modules|Thumbs\.db|desktop\.ini|__MACOSX)(?:/|$)"
CSV_COLUMNS = ["sample_id", "source_id", "source_path", "document_id", "page_id", "language", "script", "target_split", "validation_status", "duplicate_state", "file_sha256", "normalized_text_sha256"]
ALIASES = {"text": ["text", "transcription", "ground_truth", "label"], "image_path": ["image_path", "image", "file", "path"], "record_id": ["record_id", "id", "sample_id"], "document_id": ["document_id", "doc_id", "book"], "split": ["split", "target_split", "subset"]}


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def kind_of(path: Column) -> Column:
    """image, text, record, reference or other, by suffix."""
    s, out = suffix(path), None
    for kind, names in KINDS.items():
        out = F.when(s.isin(names), kind) if out is None else out.when(s.isin(names), kind)
    return out.otherwise("other")


def scan(spark: SparkSession, root: str, extensions: list[str] | None = None, content: bool = False) -> DataFrame:
    """Files under a folder: rel_path, kind, size, modified (and content). Junk and unsafe names are left out; without content it is not read."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), r"^file:(//)?", "")
    path = F.regexp_replace(F.col("path"), r"^[a-z]+:(//)?", "")
    x = x.withColumn("rel_path", relative_path(F.substring(path, F.length(base) + 2, F.length(path))))
    x = x.where(F.col("rel_path").isNotNull() & ~F.col("rel_path").rlike(JUNK)).withColumn("kind", kind_of(F.col("rel_path")))
    if extensions is not None:
        x = x.where(suffix(F.col("rel_path")).isin([e.lower().lstrip(".") for e in extensions]))
    return x.select("rel_path", "kind", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *(["content"] if content else []))


def stem_parts(path: Column) -> Column:
    """struct(folder, stem, document, page): a stem like name-12, name_p3 names a page of a document."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    page = F.regexp_extract(name, r"^(.+?)[-_]p?(\d{1,4})$", 2)
    return F.struct(F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("folder"), name.alias("stem"), F.when(page != "", F.regexp_extract(name, r"^(.+?)[-_]p?(\d{1,4})$", 1)).otherwise(name).alias("document"), F.when(page != "", page.cast("int")).alias("page"))


def pair_sidecars(files: DataFrame, orphans: bool = False) -> DataFrame:
    """Images with the text file of the same folder and stem: image_path, text_path; with orphans also texts without an image."""
    x = files.withColumn("p", stem_parts(F.col("rel_path"))).select("rel_path", "kind", "p.folder", "p.stem", "p.document", "p.page")
    image = x.where("kind = 'image'").select("folder", "stem", "document", "page", F.col("rel_path").alias("image_path"))
    text = x.where("kind = 'text'").select("folder", "stem", F.col("rel_path").alias("text_path"))
    out = image.join(text, ["folder", "stem"], "left")
    if orphans:
        alone = x.where("kind = 'text'").join(image.select("folder", "stem"), ["folder", "stem"], "left_anti")
        out = out.unionByName(alone.select("folder", "stem", "document", "page", F.lit(None).cast("string").alias("image_path"), F.col("rel_path").alias("text_path")))
    return out


def with_digest(files: DataFrame) -> DataFrame:
    """Files with content: sha256 instead of it."""
    return files.withColumn("sha256", F.sha2("content", 256)).drop("content")


def reuse_digests(listed: DataFrame, previous: DataFrame, cache: DataFrame) -> DataFrame:
    """Listed files (rel_path, size, modified) with the digest of an unchanged earlier row, else of the cache (last entry wins), else null; and its origin."""
    prev = previous.select("rel_path", "size", "modified", F.col("sha256").alias("_prev"))
    last = cache.where(F.col("sha256").rlike("^[0-9a-f]{64}$")).groupBy("rel_path", "size", "modified").agg(F.max_by("sha256", "seq").alias("_cache"))
    x = listed.join(prev, ["rel_path", "size", "modified"], "left").join(last, ["rel_path", "size", "modified"], "left")
    return x.withColumn("sha256", F.coalesce("_prev", "_cache")).withColumn("origin", F.when(F.col("_prev").isNotNull(), "index").when(F.col("_cache").isNotNull(), "cache").otherwise("hash")).drop("_prev", "_cache")


def index_counts(indexed: DataFrame) -> DataFrame:
    return indexed.agg(F.count("*").alias("files"), F.count_if(F.expr("origin = 'hash'")).alias("hashed"), F.count_if(F.expr("origin <> 'hash'")).alias("reused"))


def aliased(columns: list[str], name: str) -> Column:
    """The first present of a field's names."""
    return F.coalesce(*[F.col(c).cast("string") for c in ALIASES.get(name, [name]) if c in columns], F.lit(None).cast("string"))


def read_records(spark: SparkSession, path: str, limit: int = 1 << 20) -> DataFrame:
    """JSON lines as raw, fields (map of the top level) and problem: too_long, malformed, repeated_key or null."""
    x = spark.read.text(path).withColumnRenamed("value", "raw").where(F.trim("raw") != "")
    keys = F.json_object_keys("raw")
    fields = F.from_json("raw", T.MapType(T.StringType(), T.StringType()))
    problem = F.when(F.octet_length("raw") > limit, "too_long").when(keys.isNull(), "malformed").when(F.size(F.array_distinct(keys)) < F.size(keys), "repeated_key")
    return x.select("raw", F.when(problem.isNull(), fields).alias("fields"), problem.alias("problem"))


def record_drafts(records: DataFrame) -> DataFrame:
    """Records as drafts: the fields under their aliases; malformed ones are kept and flagged."""
    pick = lambda name: F.coalesce(*[F.try_element_at("fields", F.lit(a)) for a in ALIASES[name]])
    return records.select(*[pick(n).alias(n) for n in ALIASES], "problem")


@F.pandas_udf(T.BooleanType())
def strict_json(lines: pd.Series) -> pd.Series:
    """Whether a line is a JSON object without repeated keys at any depth."""

    def pairs(items):
        if len({k for k, _ in items}) < len(items):
            raise ValueError
        return dict(items)

    def one(line):
        try:
            return isinstance(json.loads(line, object_pairs_hook=pairs), dict)
        except (ValueError, TypeError):
            return False

    return lines.map(one)


def read_manifest(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(header rows, data rows) of a JSON lines manifest. Malformed lines fail the read; the header is the row with _row_count."""
    raw = spark.read.text(path)
    is_head = F.get_json_object("value", "$._row_count").isNotNull()
    head = raw.where(is_head).select(F.get_json_object("value", "$._row_count").cast("long").alias("row_count"), F.get_json_object("value", "$.dataset_id").alias("dataset_id"), F.get_json_object("value", "$.dataset_version").alias("dataset_version"))
    rows = raw.where(~is_head).select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return head, rows


def manifest_problems(head: DataFrame, rows: DataFrame) -> DataFrame:
    """Not one header, or another number of rows than it says."""
    x = head.agg(F.count("*").alias("heads"), F.max("row_count").alias("said")).join(F.broadcast(rows.agg(F.count("*").alias("have"))))
    return x.select(F.when(F.col("heads") != 1, "headers").when(F.col("said") != F.col("have"), "row_count").alias("problem"), "heads", "said", "have").where("problem IS NOT NULL")


def write_manifest(df: DataFrame, path: str, dataset_id: str, version: str) -> None:
    """A header line, then the rows in total order, as JSON lines. Range partitions keep the order across files."""
    keys = [c for c in ("source_id", "source_path", "sample_id") if c in df.columns]
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    body = df.select(*keys, row.alias("value")).orderBy(*keys, "value").select("value")
    body.write.mode("overwrite").text(path)
    head = df.agg(F.count("*").alias("_row_count")).select(F.to_json(F.struct("_row_count", F.lit(dataset_id).alias("dataset_id"), F.lit(version).alias("dataset_version"), F.lit("1").alias("_schema_version"))).alias("value"))
    head.coalesce(1).write.mode("append").text(path)


def export_csv(df: DataFrame, path: str, columns: list[str] = CSV_COLUMNS) -> None:
    """The columns of the CSV export, what a spreadsheet would run quoted."""
    df.select(*[spreadsheet_cell(F.col(c).cast("string")).alias(c) for c in columns if c in df.columns]).write.mode("overwrite").option("header", True).csv(path)


def exportable(df: DataFrame, with_duplicates: bool = False, splits: list[str] | None = None) -> DataFrame:
    """Rows that may be exported: ok or warning, not a duplicate unless asked for, of the splits; an unsafe path is an error."""
    states = ["unique", "canonical"] + (["duplicate"] if with_duplicates else [])
    x = df.where(F.col("validation_status").isin("ok", "warning") & F.col("duplicate_state").isin(states))
    x = x.where(F.col("target_split").isin(splits)) if splits else x
    return x.where(F.assert_true(relative_path(F.col("source_path")).isNotNull(), "an unsafe path").isNull())


def export_splits(df: DataFrame, path: str) -> None:
    """JSON lines in a folder per split; folders of splits that no longer exist go."""
    df.write.mode("overwrite").partitionBy("target_split").json(path)


def union_of_keys(*frames: DataFrame) -> DataFrame:
    """Rows of several tables under all their columns; nested values as JSON."""
    flat = []
    for df in frames:
        nested = {f.name for f in df.schema if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))}
        flat.append(df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c).cast("string").alias(c) for c in df.columns]))
    out = flat[0]
    for df in flat[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def evaluation_rows(df: DataFrame, run_id: str, metrics: list[str]) -> dict[str, DataFrame]:
    """One evaluation table (page_id, reference, prediction, model_id, metrics) as pages, truths, predictions and metric rows."""
    page = F.col("page_id")
    return {
        "pages": df.select(page), "truth": df.select(page, F.col("reference").alias("raw_text"), F.sha2("reference", 256).alias("raw_text_sha256")),
        "predictions": df.select(F.lit(run_id).alias("run_id"), page, "model_id", F.col("prediction").alias("text"), F.sha2("prediction", 256).alias("text_sha256")),
        "metrics": df.select(F.lit(run_id).alias("run_id"), page, *[F.col(m).cast("double") for m in metrics]).unpivot(["run_id", "page_id"], metrics, "metric_name", "value"),
    }


def leaderboard_rows(spark: SparkSession, path: str) -> DataFrame:
    """A results CSV, all strings, with numbers where they parse and a status of the run."""
    x = spark.read.option("header", True).csv(path)
    number = lambda c: F.col(c).try_cast("double").alias(c)
    status = F.create_map(*[F.lit(v) for v in ("COMPLETE", "completed", "PARTIAL", "partial", "FAILED_SMOKE", "failed")])
    return x.select("model", "version", F.coalesce(F.try_element_at(status, F.upper("status")), F.lit("unknown")).alias("status"), *[number(c) for c in ("rank", "pages", "cer", "wer", "normalized_arabic_cer", "seconds_per_page") if c in x.columns])


def stale_files(listed: DataFrame, as_of: str, days: int, run: str | None = None) -> DataFrame:
    """Files modified more than so many days before as_of, of one run's folder if named."""
    x = listed.where(F.col("modified") < F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(F.lit(days)))
    return x.where(F.col("rel_path").startswith(f"{run}/")) if run else x


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON lines, or of files that are one JSON array each, under their aliases."""
    whole = spark.read.text(path, wholetext=True)
    is_array = F.substring(F.trim("value"), 1, 1) == "["
    items = whole.where(is_array).select(F.explode(F.from_json("value", T.ArrayType(T.MapType(T.StringType(), T.StringType())))).alias("fields"))
    lines = whole.where(~is_array).select(F.explode(F.split("value", "\n")).alias("raw")).where(F.trim("raw") != "").select(F.from_json("raw", T.MapType(T.StringType(), T.StringType())).alias("fields"))
    return record_drafts(items.unionByName(lines).withColumn("problem", F.when(F.col("fields").isNull(), "malformed")))


def benchmark_pages(rows: DataFrame, dataset_id: str, version: str) -> DataFrame:
    """Rows (page_id, document_id, split, page_number, profile, steps: array of struct distortion, severity) as page records; protection follows the split."""
    from corpuslens.functions.protection import marks_protected

    names = F.transform(F.coalesce("steps", F.array().cast("array<struct<distortion:string,severity:string>>")), lambda s: F.struct(s["distortion"].alias("distortion"), F.coalesce(s["severity"], F.lit("none")).alias("severity")))
    return rows.select("page_id", "document_id", F.lit(dataset_id).alias("dataset_id"), F.lit(version).alias("dataset_version"), F.coalesce("split", F.lit("unassigned")).alias("split"), F.coalesce("page_number", F.lit(1)).alias("page_number"), "profile", marks_protected(F.col("split")).alias("protected"), names.alias("distortions"))


def model_records(runs: DataFrame) -> DataFrame:
    """Run metadata (run_id, raw: JSON) as model lineage rows."""
    at = lambda name, *paths: F.coalesce(*[F.get_json_object("raw", f"$.{p}") for p in paths], F.lit(None).cast("string")).alias(name)
    return runs.select("run_id", at("model_id", "model_id", "model.id", "model"), at("base_model", "base_model", "model.base"), at("revision", "revision", "model.revision"), at("dataset_id", "dataset_id", "dataset.id"), at("status", "status"))


def register(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files (id, checksum) with duplicate_of: the smallest owner of the checksum among known files, else among those before them."""
    from pyspark.sql.window import Window

    owners = known.groupBy("checksum").agg(F.min("id").alias("_owner"))
    first = F.min("id").over(Window.partitionBy("checksum"))
    x = files.join(owners, "checksum", "left").withColumn("_first", first)
    return x.withColumn("duplicate_of", F.coalesce("_owner", F.when(F.col("id") != F.col("_first"), F.col("_first")))).drop("_owner", "_first")


def handoff(prepared: DataFrame, profiles: list[str], seed: int) -> DataFrame:
    """Training rows that a synthesis run may take, with what it is asked for."""
    x = prepared.where("target_split = 'train' AND validation_status <> 'error' AND duplicate_state IN ('unique', 'canonical')")
    return x.select("sample_id", "source_id", "source_path", F.array(*map(F.lit, profiles)).alias("profiles"), F.lit(seed).alias("seed"))


def export_projection(df: DataFrame, normalized: bool = False) -> DataFrame:
    """The columns of a training export; text is the raw or the normalized one, whichever is there."""
    body = F.coalesce("text", "raw_text") if normalized else F.coalesce("raw_text", "text")
    keep = ["sample_id", "source_id", "source_path", "document_id", "page_id", "page_index", "group_id", "image_path", "language", "script", "target_split", "file_sha256", "normalized_text_sha256", "duplicate_state", "validation_status"]
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in keep], body.alias("text"))


def split_protected(df: DataFrame, protected: Column) -> tuple[DataFrame, DataFrame]:
    """(safe rows, counts of safe and protected rows)."""
    flag = F.coalesce(protected, F.lit(True))
    return df.where(~flag), df.agg(F.count_if(~flag).alias("safe"), F.count_if(flag).alias("protected"))


def assert_safe(df: DataFrame, protected: Column) -> DataFrame:
    """df, failing on the first protected row."""
    return df.where(F.assert_true(~F.coalesce(protected, F.lit(True)), "a protected row").isNull())


def only_split(df: DataFrame, split: str) -> DataFrame:
    """Rows of one split, which must not be a protected one."""
    from corpuslens.functions.protection import SPLITS

    if split.strip().lower() in SPLITS:
        raise ValueError(f"{split} is protected")
    return df.where(F.lower(F.trim("target_split")) == split.strip().lower())


def export_run(tables: dict[str, DataFrame], run_id: str, path: str) -> None:
    """All rows of one run, a Parquet folder per table."""
    for name, df in tables.items():
        (df.where(F.col("run_id") == run_id) if "run_id" in df.columns else df).write.mode("overwrite").parquet(f"{path}/{name}")


def approved_rows(examples: DataFrame, revisions: DataFrame) -> DataFrame:
    """Approved examples with their revision's file: id, before, after, digest of the pair, file_hash."""
    x = examples.where("status = 'approved'").join(revisions.select(F.col("id").alias("revision_id"), "file_hash"), "revision_id")
    return x.select("id", "before", "after", F.sha2(F.concat_ws("\x00", "before", "after"), 256).alias("pair_sha256"), "file_hash").orderBy("id")
