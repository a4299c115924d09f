"""Queries of sources, exports, filters, protection and record tables. What is written goes to the shared folder and is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.functions import edit, protection, text
from corpuslens.operators import compare, decisions, dedupe, quality, records, splits
from corpuslens.operators.components import checkpointing
from corpuslens.plans.catalogue import csv, query, rounded
from corpuslens.plans.views import JOBS, RECOGNIZED, SAMPLES, analysed, analysed_sql, jobs, measured, recognized, samples, table
from corpuslens.sources import files


def folder(spark: SparkSession) -> str:
    """A new folder in the shared one, deleted when the driver's JVM ends."""
    checkpointing(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/exchange-{uuid.uuid4().hex}"
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(there)
    fs.deleteOnExit(there)
    return path


# ---- sources and sinks ----


@query("SELECT lang || '/part' AS folder, 'record' AS kind, count(DISTINCT lang) AS files FROM documents GROUP BY lang")
def scanned_files(spark, sf_dir):
    """The files of an export, one folder a language, found again by their names."""
    path = folder(spark)
    table(spark, sf_dir, "documents").select("lang", "doc_id").repartition(1, "lang").write.partitionBy("lang").mode("overwrite").json(path)
    found = files.scan(spark, path).where(F.col("rel_path").endswith(".json"))
    return found.select(F.concat(F.regexp_extract("rel_path", "lang=([^/]+)/", 1), F.lit("/part")).alias("folder"), F.lit("record").alias("kind"), F.lit(1)).groupBy("folder", "kind").agg(F.count("*").alias("files"))


@query("SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 7 = 0 THEN 'malformed' WHEN (conv_id + turn) % 11 = 0 THEN 'repeated_key' END AS problem, CASE WHEN (conv_id + turn) % 7 > 0 AND (conv_id + turn) % 11 > 0 THEN role END AS text FROM conversations")
def record_lines(spark, sf_dir):
    """Lines of records, some broken or with a key twice, read with their problems."""
    path, odd = folder(spark), F.col("conv_id") + F.col("turn")
    body = F.concat(F.lit('"transcription": "'), "role", F.lit('", "n": '), F.concat_ws("", "conv_id"), F.lit(', "t": '), F.concat_ws("", "turn"))
    line = F.when(odd % 7 == 0, F.concat(F.lit("{"), body, F.lit(', "x": '))).when(odd % 11 == 0, F.concat(F.lit("{"), body, F.lit(', "n": 0}'))).otherwise(F.concat(F.lit("{"), body, F.lit("}")))
    table(spark, sf_dir, "conversations").select(line.alias("value")).write.mode("overwrite").text(path)
    place = lambda key: F.regexp_extract("raw", f'"{key}": (\\d+)', 1).cast("long").alias({"n": "conv_id", "t": "turn"}[key])
    read = files.read_records(spark, path).select(place("n"), place("t"), "fields", "problem")
    return read.select("conv_id", "turn", "problem", F.try_element_at("fields", F.lit("transcription")).alias("text"))


@query("SELECT conv_id, turn, (conv_id + turn) % 3 > 0 AS strict FROM conversations")
def strict_lines(spark, sf_dir):
    odd = (F.col("conv_id") + F.col("turn")) % 3 == 0
    line = F.when(odd, F.lit('{"a": {"b": 1, "b": 2}}')).otherwise(F.lit('{"a": {"b": 1, "c": [{}]}}'))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", files.strict_json(line).alias("strict"))


@query("SELECT 'd' AS dataset_id, count(*) AS said, count(*) AS have, sum(l_quantity)::BIGINT AS quantity, 0::BIGINT AS problems FROM lineitem")
def manifest_round_trip(spark, sf_dir):
    """A manifest of line items, written with its header and read back."""
    path = folder(spark)
    x = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("sample_id"), F.col("l_quantity").cast("double").alias("quantity"))
    files.write_manifest(x, path, "d", "1")
    head, rows = files.read_manifest(spark, path, T.StructType.fromDDL("sample_id string, quantity double"))
    sums = rows.agg(F.count("*").alias("have"), F.sum("quantity").cast("long").alias("quantity")).withColumn("problems", F.lit(files.manifest_problems(head, rows).count()).cast("long"))
    return head.select("dataset_id", F.col("row_count").alias("said")).join(F.broadcast(sums))


@query("WITH c AS (SELECT o_orderkey, CASE WHEN regexp_matches(o_orderpriority, '^\\s*[=+\\-@\\t\\r]') THEN '''' || o_orderpriority ELSE o_orderpriority END AS p FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '=' || o_orderpriority ELSE o_orderpriority END AS o_orderpriority FROM orders)) SELECT p AS priority, count(*) AS orders FROM c GROUP BY 1")
def csv_export(spark, sf_dir):
    path = folder(spark)
    p = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("="), "o_orderpriority")).otherwise(F.col("o_orderpriority"))
    files.export_csv(table(spark, sf_dir, "orders").select("o_orderkey", p.alias("priority")), path, ["o_orderkey", "priority"])
    return spark.read.option("header", True).csv(path).groupBy("priority").agg(F.count("*").alias("orders"))


@query("SELECT rel_path, sha256 FROM (SELECT doc_id::VARCHAR AS rel_path, sha256(text) AS sha256 FROM documents)")
def content_digests(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("rel_path"), F.encode("text", "UTF-8").alias("content"))
    return files.with_digest(x)


@query("SELECT count(*) AS files, count(*) FILTER (WHERE doc_id % 3 > 0 AND doc_id % 5 > 0) AS hashed, count(*) FILTER (WHERE doc_id % 3 = 0 OR doc_id % 5 = 0) AS reused FROM documents")
def index_totals(spark, sf_dir):
    i = F.col("doc_id")
    return files.index_counts(table(spark, sf_dir, "documents").select(F.when(i % 3 == 0, "index").when(i % 5 == 0, "cache").otherwise("hash").alias("origin")))


@query(f"WITH {SAMPLES} SELECT coalesce(source_split, 'none') AS target_split, count(*) AS rows, sum(n_chars)::BIGINT AS chars FROM s GROUP BY 1")
def split_folders(spark, sf_dir):
    """JSON lines in a folder for each split, read back."""
    path = folder(spark)
    files.export_splits(samples(spark, sf_dir).select("sample_id", "n_chars", F.coalesce("source_split", F.lit("none")).alias("target_split")), path)
    return spark.read.schema("sample_id string, n_chars long, target_split string").json(path).groupBy("target_split").agg(F.count("*").alias("rows"), F.sum("n_chars").alias("chars"))


@query(f"WITH {SAMPLES} SELECT sample_id, 2 AS profiles, 7 AS seed FROM s WHERE source_split = 'train' AND validation_status <> 'error'")
def synthesis_handoff(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("target_split", F.col("source_split")).withColumn("duplicate_state", F.lit("unique"))
    return files.handoff(s, ["scan", "photo"], 7).select("sample_id", F.size("profiles").alias("profiles"), "seed")


@query("SELECT doc_id::VARCHAR AS record_id, lang AS split FROM documents")
def sample_files(spark, sf_dir):
    """Documents as JSON arrays, one a file, read as samples under their aliases."""
    path = folder(spark)
    item = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("subset")))
    x = table(spark, sf_dir, "documents").select(F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("k"), item.alias("item")).groupBy("k").agg(F.concat(F.lit("["), F.array_join(F.collect_list("item"), ", "), F.lit("]")).alias("value"))
    x.select("k", "value").repartition(64, "k").select("value").write.mode("overwrite").option("lineSep", "\n").text(path)
    return files.record_drafts(spark.read.text(path).select(F.explode(F.from_json("value", "array<map<string,string>>")).alias("fields"), F.lit(None).cast("string").alias("problem"))).select("record_id", "split")


@query("SELECT n_name AS model, CASE n_nationkey % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'partial' WHEN 2 THEN 'failed' ELSE 'unknown' END AS status, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey::DOUBLE END AS cer FROM nation")
def leaderboard_file(spark, sf_dir):
    path, k = folder(spark), F.col("n_nationkey")
    status = F.element_at(F.array(*map(F.lit, ("COMPLETE", "PARTIAL", "FAILED_SMOKE", "other"))), (k % 4 + 1).cast("int"))
    table(spark, sf_dir, "nation").select(F.col("n_name").alias("model"), F.lit("1").alias("version"), status.alias("status"), F.when(k % 2 == 0, k.cast("string")).otherwise("n/a").alias("cer")).write.mode("overwrite").option("header", True).csv(path)
    return files.leaderboard_rows(spark, path).select("model", "status", "cer")


@query("SELECT c_custkey::VARCHAR AS run_id, c_mktsegment AS model_id, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS base_model FROM customer")
def model_lineage(spark, sf_dir):
    k = F.col("c_custkey")
    raw = F.to_json(F.struct(F.struct(F.col("c_mktsegment").alias("id"), F.when(k % 2 == 0, F.col("c_name")).alias("base")).alias("model")))
    return files.model_records(table(spark, sf_dir, "customer").select(k.cast("string").alias("run_id"), raw.alias("raw"))).select("run_id", "model_id", "base_model")


@query("SELECT 'metrics' AS name, count(*) AS rows FROM events WHERE event_type = 'click' UNION ALL SELECT 'pages', count(*) FROM nation")
def run_export(spark, sf_dir):
    """The rows of one run, a folder for each table, read back."""
    path = folder(spark)
    files.export_run({"metrics": table(spark, sf_dir, "events").select(F.col("event_type").alias("run_id"), "value"), "pages": table(spark, sf_dir, "nation")}, "click", path)
    out = [spark.read.parquet(f"{path}/{n}").agg(F.lit(n).alias("name"), F.count("*").alias("rows")) for n in ("metrics", "pages")]
    return out[0].unionByName(out[1])


@query("SELECT e.o_orderkey AS id, sha256(o_orderpriority || chr(0) || o_orderstatus) AS pair_sha256, c_name AS file_hash FROM (SELECT * FROM orders WHERE o_orderstatus = 'F') e JOIN customer ON o_custkey = c_custkey")
def approved_examples(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("open").alias("status"), F.col("o_custkey").alias("revision_id"), F.col("o_orderpriority").alias("before"), F.col("o_orderstatus").alias("after"))
    return files.approved_rows(o, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("file_hash"))).select("id", "pair_sha256", "file_hash")


@query("SELECT doc_id::VARCHAR || '.txt' AS rel_path FROM documents WHERE doc_id % 60 > 30 AND doc_id % 2 = 0")
def stale_files(spark, sf_dir):
    i = F.col("doc_id")
    x = table(spark, sf_dir, "documents").select(F.concat(F.when(i % 2 == 0, "run/").otherwise("other/"), i.cast("string"), F.lit(".txt")).alias("rel_path"), (F.timestamp_seconds(F.lit(1_700_000_000)) - F.make_dt_interval((i % 60).cast("int"))).alias("modified"))
    return files.stale_files(x, "2023-11-14 22:13:20", 30, "run").select(F.substring("rel_path", 5, 100).alias("rel_path"))


@query("SELECT count(*) AS rows, count(DISTINCT a) AS a, count(b) AS b FROM (SELECT r_name AS a, NULL AS b FROM region UNION ALL SELECT NULL, n_name FROM nation)")
def union_of_tables(spark, sf_dir):
    x = files.union_of_keys(table(spark, sf_dir, "region").select(F.col("r_name").alias("a")), table(spark, sf_dir, "nation").select(F.col("n_name").alias("b")))
    return x.agg(F.count("*").alias("rows"), F.count_distinct("a").alias("a"), F.count("b").alias("b"))


@query(f"WITH {SAMPLES} SELECT sample_id, source_split AS target_split, sha256(text) AS text_sha256, NULL::VARCHAR AS script FROM s")
def training_projection(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("target_split", F.col("source_split")).withColumn("raw_text", F.lit(None).cast("string"))
    return files.export_projection(s).select("sample_id", "target_split", F.sha2("text", 256).alias("text_sha256"), "script")


@query(f"WITH {SAMPLES} SELECT count(*) FILTER (WHERE source_split IS DISTINCT FROM 'Protected_Holdout') AS safe, count(*) FILTER (WHERE source_split = 'Protected_Holdout') AS protected FROM s")
def protected_counts(spark, sf_dir):
    s = samples(spark, sf_dir)
    return files.split_protected(s, protection.marks_protected(F.col("source_split")))[1]


@query(f"WITH {SAMPLES} SELECT sample_id FROM s WHERE source_split = 'train'")
def safe_training_rows(spark, sf_dir):
    """Rows of the training split, which fail if any of them were protected."""
    s = samples(spark, sf_dir).withColumn("target_split", F.col("source_split"))
    train = files.only_split(s, "train")
    return files.assert_safe(train, protection.marks_protected(F.col("source_split"))).select("sample_id")


# ---- filters ----


@query(f"WITH {analysed_sql('a')} SELECT sample_id FROM a WHERE cer >= 0.2 AND wer <= 0.9 AND language IN ('en', 'de') AND n2 > 0")
def filtered_rows(spark, sf_dir):
    x = analysed(spark, sf_dir)
    return x.where(compare.matches({"min_cer": 0.2, "max_wer": 0.9, "language": ["en", "de"], "error_type": "diacritic", "distortion": None}, x.columns)).select("sample_id")


@query(f"WITH {analysed_sql('a')} SELECT sample_id FROM a WHERE doc_id % 8 = 0")
def blurred_rows(spark, sf_dir):
    x = analysed(spark, sf_dir)
    return x.where(compare.matches({"distortion": ["motion_blur", "defocus"]}, x.columns)).select("sample_id")


@query("SELECT conv_id, list_filter(range(1, n + 1), lambda p: p % 2 = 1 AND p >= 1)::VARCHAR AS odd, len(list_filter(range(1, n + 1), lambda p: p BETWEEN 2 AND 4)) AS some FROM (SELECT conv_id, count(*)::BIGINT AS n FROM conversations GROUP BY 1)")
def chosen_pages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").cast("int").alias("n"))
    odd = F.concat(F.lit("["), F.array_join(text.selected_pages("odd", F.col("n")).cast("array<string>"), ", "), F.lit("]"))
    return c.select("conv_id", odd.alias("odd"), F.size(text.selected_pages("range", F.col("n"), 2, 4)).cast("long").alias("some"))


@query("SELECT page_id, page_id IN (1, 2, 3, 7) AS chosen FROM pages")
def page_range_rows(spark, sf_dir):
    """Which pages a written range takes."""
    return table(spark, sf_dir, "pages").select("page_id", F.col("page_id").isin(text.page_ranges("1-3, 7")[1]).alias("chosen"))


# ---- duplicates ----


@query(f"WITH {SAMPLES}, t AS (SELECT text, min(\"row\") AS first, count(DISTINCT \"row\" % 2) AS n FROM s WHERE text <> '' GROUP BY text) SELECT doc_id, t.first IS NOT NULL AND n = 2 AND doc_id <> t.first AND doc_id % 2 <> t.first % 2 AS conflict FROM s LEFT JOIN t USING (text)")
def raw_conflicts(spark, sf_dir):
    """Equal texts of files that differ (by the parity of their number)."""
    s = samples(spark, sf_dir).withColumn("file_sha256", (F.col("row") % 2).cast("string")).withColumn("duplicate_state", F.lit("unique")).withColumn("duplicate_of", F.lit(None).cast("string"))
    return dedupe.raw_text_conflicts(s).select("doc_id", (F.col("duplicate_state") == "conflicting_duplicate").alias("conflict"))


@query(f"WITH {SAMPLES}, g AS (SELECT sample_id, doc_id, min(sample_id) OVER (PARTITION BY doc_id // 3) AS first FROM s) SELECT sample_id, CASE WHEN sample_id = first THEN 'canonical' ELSE 'duplicate' END AS state, CASE WHEN sample_id <> first THEN first END AS of FROM g WHERE (SELECT count(*) FROM s t WHERE t.doc_id // 3 = g.doc_id // 3) > 1")
def near_families(spark, sf_dir):
    """Neighbouring documents as confirmed near pairs."""
    s = samples(spark, sf_dir).select("sample_id", "row", F.floor(F.col("doc_id") / 3).alias("g")).withColumn("duplicate_state", F.lit("unique")).withColumn("duplicate_of", F.lit(None).cast("string")).withColumn("reason", F.lit(None).cast("string"))
    pairs = s.alias("a").join(s.alias("b"), (F.col("a.g") == F.col("b.g")) & (F.col("b.row") == F.col("a.row") + 1)).select(dedupe.ordered_pair(F.col("a.sample_id"), F.col("b.sample_id")).alias("p")).select("p.a", "p.b")
    x = dedupe.apply_near_pairs(s, pairs)
    return x.where("duplicate_state <> 'unique'").select("sample_id", F.col("duplicate_state").alias("state"), F.col("duplicate_of").alias("of"))


_HASHES = "h AS (SELECT vec_id AS id, vec_id % 50 AS p, vec_id % 7 AS d, vec_id % 3 AS a FROM embeddings WHERE vec_id >= 0)"


@query(f"WITH {_HASHES} SELECT x.id AS a, y.id AS b, bit_count(xor(x.p, y.p)) AS d_p, bit_count(xor(x.d, y.d)) AS d_d, bit_count(xor(x.a, y.a)) AS d_a, 'CONFIRMED' AS level FROM h x JOIN h y ON x.id < y.id AND x.p // 10 = y.p // 10 AND x.id // 20 = y.id // 20")
def fingerprint_pairs(spark, sf_dir):
    """Fingerprints made of the vectors' numbers; the aspect keeps the buckets small."""
    i = F.col("vec_id")
    x = table(spark, sf_dir, "embeddings").select(i.alias("id"), (i % 50).alias("phash"), (i % 7).alias("dhash"), (i % 3).alias("ahash"), F.concat_ws(":", F.floor(i % 50 / 10).cast("string"), F.floor(i / 20).cast("string")).alias("aspect"))
    return dedupe.fingerprint_pairs(x)


@query("SELECT band, bucket_rows, count(*) AS buckets FROM (SELECT band, key, count(*) AS bucket_rows FROM (SELECT unnest(range(4)) AS band, unnest([p_size % 3, p_size % 5, p_size % 7, p_partkey]) AS key FROM part) GROUP BY ALL HAVING count(*) > 20) GROUP BY ALL")
def large_buckets(spark, sf_dir):
    """Buckets of more than 20 members, which the near text search compares block by block."""
    s = F.col("p_size")
    keys = F.array(*[F.struct(F.lit(i).cast("long").alias("band"), k.cast("long").alias("bucket")) for i, k in enumerate((s % 3, s % 5, s % 7, F.col("p_partkey")))])
    x = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.explode(keys).alias("k")).select("id", "k.band", "k.bucket")
    x = x.join(x.groupBy("band", "bucket").agg(F.count("*").alias("size")).where(F.col("size") > dedupe.OWNER_CAP), ["band", "bucket"])
    return x.select("band", "bucket", "size").distinct().groupBy("band", F.col("size").alias("bucket_rows")).agg(F.count("*").alias("buckets"))


# ---- protection, validation ----


@query("SELECT conv_id, turn, turn % 5 < 3 AS protected, turn % 5 IN (1, 2) AS malformed FROM conversations")
def record_protection(spark, sf_dir):
    t = F.col("turn") % 5
    record = F.when(t == 0, '{"meta": [{"deep": {"role": "Benchmark"}}]}').when(t == 1, '{"split": 3}').when(t == 2, "no record").when(t == 3, '{"split": "train", "protected": "no"}').otherwise('{"metadata": {"split": null}}')
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", protection.record_protected(record).alias("protected"), protection.record_malformed(record).alias("malformed"))


@query("SELECT conv_id, turn, turn % 4 < 2 AS hides, turn % 4 IN (0, 2) AS obfuscated FROM conversations")
def hidden_markers(spark, sf_dir):
    t = F.col("turn") % 4
    block = F.when(t == 0, '{"note": "hold-out"}').when(t == 1, '{"x": {"data split": "the holdout part"}}').when(t == 2, '{"uri": "benchmarks/a"}').otherwise("{}")
    value = F.when(t == 0, "h​old-out").when(t == 1, "train").when(t == 2, "Evaluation.Only").otherwise("dev")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", protection.provenance_hides_marker(block).alias("hides"), protection.obfuscated_marker(value).alias("obfuscated"))


@query(f"WITH {SAMPLES} SELECT source_split IS NOT NULL AND source_split = 'train' AS eligible, count(*) AS rows FROM s GROUP BY 1")
def eligible_rows(spark, sf_dir):
    return samples(spark, sf_dir).groupBy(protection.training_eligible(F.col("source_split")).alias("eligible")).agg(F.count("*").alias("rows"))


@query("SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size * 3 < 32 THEN 'image_too_small' END, CASE WHEN (p_partkey % 500 + 4) * 50 > 20000 THEN 'image_too_large' END, CASE WHEN (p_partkey % 500 + 4) * 50.0 / greatest(least(p_size * 3, (p_partkey % 500 + 4) * 50), 1) > 20.0 AND (p_partkey % 500 + 4) * 50 >= p_size * 3 THEN 'extreme_aspect' END], lambda x: x IS NOT NULL), ',') AS codes FROM part")
def dimension_findings(spark, sf_dir):
    w, h = F.col("p_size") * 3, ((F.col("p_partkey") % 500 + 4) * 50).cast("int")
    found = F.array_compact(F.array(*quality.dimension_findings(w, h)))
    return table(spark, sf_dir, "part").select("p_partkey", csv(F.transform(found, lambda f: f["code"])).alias("codes"))


@query(f"WITH {JOBS} SELECT id, CASE WHEN quality >= 90 OR status = 'pending' AND quality < 60 THEN true ELSE false END AS passes FROM j")
def text_acceptance(spark, sf_dir):
    j = jobs(spark, sf_dir)
    valid = ~((F.col("status") == "pending") & (F.col("quality") < 60))
    return j.select("id", decisions.text_acceptance(F.lit(0), valid, F.col("quality"), F.col("quality")).alias("passes"))


@query("SELECT doc_id, doc_id % 4 = 1 AS accepted, doc_id % 4 >= 2 AS manual_review, CASE doc_id % 4 WHEN 2 THEN 'ocr_failed' WHEN 3 THEN 'review_required' END AS review_reason FROM documents")
def page_states(spark, sf_dir):
    """Pages with a decided state keep its decision, whatever their text."""
    d = edit.spread(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id")
    state = F.element_at(F.array(*map(F.lit, ("blank_page", "accepted_first_pass", "ocr_failed", "review_required"))), (F.col("doc_id") % 4 + 1).cast("int"))
    d = d.withColumn("page_state", state).withColumn("score", F.lit(95.0)).withColumn("manual_review", F.lit(True))
    return decisions.page_state(d).select("doc_id", "accepted", "manual_review", "review_reason")


# ---- edit distance, evaluation ----


@query(f"WITH {RECOGNIZED} SELECT page_id, round(100.0 * cer, 6) AS percent, round(cer, 6) AS ratio FROM e")
def converted_errors(spark, sf_dir):
    m = measured(spark, sf_dir)
    return rounded(m.select("page_id", edit.convert_error(F.col("cer"), "ratio", "percent").alias("percent"), edit.convert_error(100 * F.col("cer"), "percent", "ratio").alias("ratio")), "percent", "ratio")


@query(f"WITH {RECOGNIZED} SELECT count(*) AS pages, round(avg(CASE WHEN reference = prediction THEN 0.0 WHEN lower(reference) = lower(prediction) THEN 0.0 WHEN length(reference) = 0 THEN 1.0 ELSE levenshtein(lower(reference), lower(prediction)) / length(reference)::DOUBLE END), 6) AS mean FROM e")
def folded_error(spark, sf_dir):
    r = recognized(spark, sf_dir)
    return rounded(r.select(edit.cer(F.lower("reference"), F.lower("prediction")).alias("c")).agg(F.count("*").alias("pages"), F.avg("c").alias("mean")), "mean")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events WHERE value IS NOT NULL) WHERE n = 1")
def best_runs(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value IS NOT NULL")
    return e.groupBy("user_id").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("event_id"))


@query("SELECT event_type, round(50.0 * avg(CASE WHEN value > 10 THEN 1 ELSE 0 END) + 0.4 * 80 - least(20.0, avg(value)), 6) AS score FROM events GROUP BY 1")
def provider_scores(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg((F.col("value") > 10).cast("int")).alias("s"), F.avg("value").alias("l"))
    return rounded(e.select("event_type", records.provider_score(F.col("s"), F.col("l"), F.lit(80.0), F.lit(0.0)).alias("score")), "score")


# ---- records, state ----


@query("SELECT count(*) AS rows, count(*) FILTER (WHERE l_quantity > 10) AS some FROM lineitem")
def table_digests(spark, sf_dir):
    """Digests of one table in two orders and partitionings, which are equal."""
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    a, b = records.digest_of(x, *x.columns), records.digest_of(x.repartition(7, "l_quantity"), *x.columns)
    same = a.join(F.broadcast(b.select(F.col("digest").alias("other"))), F.col("digest") == F.col("other")).select("rows")
    some = x.where("l_quantity > 10").agg(F.count("*").alias("some"))
    return same.join(F.broadcast(some))


@query("SELECT count(*) FILTER (WHERE o_orderkey % 3 > 0) AS fresh, count(*) FILTER (WHERE o_orderkey % 6 = 0) AS clash FROM orders")
def appended_rows(spark, sf_dir):
    """Orders into a store that has a third of them, half of those with other content."""
    o, k = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), F.col("o_orderkey")
    store = o.where(k % 3 == 0).withColumn("o_totalprice", F.when(k % 6 == 0, F.lit(-1.0)).otherwise(F.col("o_totalprice")).cast(o.schema["o_totalprice"].dataType))
    fresh, clash = records.append_once(store, o, ["o_orderkey"], ["o_orderstatus"])
    return fresh.agg(F.count("*").alias("fresh")).join(F.broadcast(clash.agg(F.count("*").alias("clash"))))


@query("SELECT conv_id, turn, role, text FROM conversations WHERE role IN ('user', 'assistant')")
def chat_turns(spark, sf_dir):
    """Turns with known roles, as by a filter with membership."""
    c = table(spark, sf_dir, "conversations")
    return c.where(compare.matches({"role": ["user", "assistant"]}, c.columns)).select("conv_id", "turn", "role", "text")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::BIGINT AS place FROM orders")
def placed_rows(spark, sf_dir):
    from pyspark.sql.window import Window

    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long").alias("place"))


@query("SELECT doc_id, replace(replace(text, 'the ', 'a '), 'and', '&') <> text AS changed FROM documents")
def corrected_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", (text.apply_rules(F.col("text"), [("the ", "a "), ("and", "&")]) != F.col("text")).alias("changed"))


@query(r"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '[^\S\n]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS text_sha256 FROM documents")
def collapsed_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.collapse_whitespace(F.col("text")), 256).alias("text_sha256"))


@query("SELECT doc_id, nfc_normalize(text) = text AS composed FROM documents")
def composed_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", (text.unicode_form("NFC")("text") == F.col("text")).alias("composed"))


@query(f"WITH {SAMPLES} SELECT doc_id, coalesce(source_id || ':group:' || group_id, source_id || ':' || document_id) AS group_key FROM s")
def group_keys(spark, sf_dir):
    return samples(spark, sf_dir).select("doc_id", splits.group_key().alias("group_key"))
