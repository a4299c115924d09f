"""Further queries of the catalogue: text scalars, sources, contracts, decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions import edit, protection, text, textquality
from corpuslens.operators import compare, decisions, dedupe, evaluate, quality, records
from corpuslens.plans.catalogue import csv, query, rounded
from corpuslens.plans.views import RECOGNIZED, SAMPLES, analysed, analysed_sql, recognized, samples, table
from corpuslens.sources import files

# ---- text ----


@query(r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g'), ' ' || chr(10))) AS folded_sha256 FROM documents")
def folded_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.fold_for_comparison(F.col("text"), digits=True), 256).alias("folded_sha256"))


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::INT AS words FROM documents")
def word_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).alias("words"))


@query(r"""WITH t AS (SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM conversations), w AS (SELECT *, list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '') AS w FROM t)
SELECT conv_id, turn, t <> '' AND (regexp_matches(t, '^[0-9]+$') OR regexp_matches(t, '\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b') OR regexp_matches(t, '(?i)https?://[^\s]+|www\.[^\s]+') OR regexp_matches(t, '(?:\+?[0-9][\s-]?){8,15}') OR regexp_matches(t, '\b[0-9]{1,4}[/.-][0-9]{1,2}[/.-][0-9]{1,4}\b')
  OR regexp_matches(t, '(?i)\b(?:EGP|USD|EUR)\s*[0-9]+(?:[.,][0-9]+)?\b') OR regexp_matches(t, '\b[0-9]{8,18}\b') OR regexp_matches(t, '\b[A-Z]{2,}[-_/]?[0-9]{2,}\b')
  OR (len(w) BETWEEN 1 AND 3 AND len(list_filter(w, lambda x: NOT (regexp_matches(x, '^[^\pL]') OR regexp_matches(x, '^\p{Lu}')))) = 0)) AS sensitive FROM w""")
def sensitive_turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", textquality.is_sensitive(F.col("text")).alias("sensitive"))


@query("SELECT event_id, CASE WHEN regexp_extract(props, '(\\d{1,9})', 1) <> '' THEN least(50, greatest(10, regexp_extract(props, '(\\d{1,9})', 1)::INT)) END AS score FROM events")
def clamped_scores(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.first_integer(F.col("props"), 10, 50).alias("score"))


@query(r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id, CASE WHEN len(w) > 0 AND length(array_to_string(w, '')) / len(w)::DOUBLE > 7 THEN 'long_words' ELSE 'plain' END AS class FROM w")
def text_classes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.text_class(F.col("text")).alias("class"))


@query(f"""WITH {RECOGNIZED} SELECT page_id, CASE WHEN reference = '' THEN 'insertion' WHEN prediction = '' THEN 'deletion' WHEN replace(reference, ' ', '') = replace(prediction, ' ', '') THEN CASE WHEN length(reference) <> length(prediction) THEN 'word_split_merge' ELSE 'spacing' END
  WHEN regexp_replace(reference, '[^\\w\\s]', '', 'g') = regexp_replace(prediction, '[^\\w\\s]', '', 'g') THEN 'punctuation' ELSE 'replacement' END AS change FROM e""")
def change_types(spark, sf_dir):
    return recognized(spark, sf_dir).select("page_id", textquality.change_type(F.col("reference"), F.col("prediction")).alias("change"))


@query(f"WITH {RECOGNIZED} SELECT page_id, CASE WHEN reference <> prediction THEN CASE WHEN starts_with(reference, prediction) THEN length(prediction) ELSE (SELECT min(i) FROM unnest(range(length(reference))) u(i) WHERE substr(reference, i + 1, 1) <> substr(prediction, i + 1, 1)) END END::INT AS place FROM e")
def first_differences(spark, sf_dir):
    return recognized(spark, sf_dir).select("page_id", text.first_difference(F.col("reference"), F.col("prediction")).alias("place"))


@query(r"SELECT page_id, CASE WHEN regexp_matches(url, '[A-Za-z]:') THEN NULL ELSE url END IS NULL AS refused, regexp_replace(regexp_replace(regexp_extract(url, '//([^?#]*)', 1), '/+', '/', 'g'), '/$', '') AS path FROM pages")
def safe_paths(spark, sf_dir):
    """Addresses are refused as paths for their scheme; the part after it is cleaned."""
    rest = F.regexp_extract("url", r"//([^?#]*)", 1)
    scheme = F.when(F.col("url").rlike("[A-Za-z]:"), None).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", scheme.isNull().alias("refused"), text.relative_path(rest).alias("path"))


@query(f"WITH {RECOGNIZED} SELECT page_id, round(CASE WHEN greatest(length(reference), length(prediction)) = 0 THEN 1.0 ELSE 1.0 - levenshtein(reference, prediction) / greatest(length(reference), length(prediction))::DOUBLE END, 6) AS characters FROM e")
def agreement(spark, sf_dir):
    x = recognized(spark, sf_dir).select("page_id", edit.agreement(F.col("reference"), F.col("prediction")).alias("a"))
    return rounded(x.select("page_id", F.col("a.characters").alias("characters")), "characters")


@query()
def edit_counts(spark, sf_dir):
    x = recognized(spark, sf_dir).select("page_id", edit.edit_counts(edit.alignment()("reference", "prediction")).alias("n"))
    return x.select("page_id", "n.*")


@query()
def word_error_totals(spark, sf_dir):
    x = recognized(spark, sf_dir).select(F.explode(edit.alignment(words=True)("reference", "prediction")).alias("e"))
    return x.groupBy("e.op", edit.word_error(F.col("e.ref"), F.col("e.hyp")).alias("category")).agg(F.count("*").alias("count"))


# ---- sources ----


def _files(spark, sf_dir):
    """Documents as files: images, sidecar texts of most, texts alone, junk."""
    i = F.col("doc_id")
    name = F.concat(F.col("lang"), F.lit("/doc"), F.floor(i / 4).cast("string"), F.lit("-p"), (i % 4).cast("string"))
    return table(spark, sf_dir, "documents").select(F.concat(name, F.when(i % 3 == 0, ".txt").when(i % 17 == 0, ".md").otherwise(".PNG")).alias("rel_path"), "doc_id").withColumn("kind", files.kind_of(F.col("rel_path")))


_FILES = "f AS (SELECT doc_id, lang || '/doc' || (doc_id // 4) || '-p' || (doc_id % 4) || CASE WHEN doc_id % 3 = 0 THEN '.txt' WHEN doc_id % 17 = 0 THEN '.md' ELSE '.PNG' END AS rel_path, CASE WHEN doc_id % 3 = 0 THEN 'text' WHEN doc_id % 17 = 0 THEN 'reference' ELSE 'image' END AS kind FROM documents)"


@query(f"WITH {_FILES} SELECT kind, count(*) AS files FROM f GROUP BY 1")
def file_kinds(spark, sf_dir):
    return _files(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("files"))


@query(f"WITH {_FILES} SELECT doc_id, regexp_extract(rel_path, '^(.*)/', 1) AS folder, 'doc' || (doc_id // 4) AS document, (doc_id % 4)::INT AS page FROM f")
def page_names(spark, sf_dir):
    x = _files(spark, sf_dir).select("doc_id", files.stem_parts(F.col("rel_path")).alias("p"))
    return x.select("doc_id", "p.folder", "p.document", "p.page")


@query(f"""WITH {_FILES}, g AS (SELECT *, regexp_replace(rel_path, '\\.[^.]*$', '') AS stem FROM f), t AS (SELECT replace(stem, 'p2', 'p1') AS stem, rel_path FROM g WHERE kind = 'text')
SELECT i.rel_path AS image_path, t.rel_path AS text_path FROM (SELECT stem, rel_path FROM g WHERE kind = 'image') i LEFT JOIN t USING (stem) UNION ALL SELECT NULL, t.rel_path FROM t WHERE stem NOT IN (SELECT stem FROM g WHERE kind = 'image')""")
def sidecar_pairs(spark, sf_dir):
    """Texts of page 2 are filed under page 1, so that some images have a sidecar."""
    x = _files(spark, sf_dir)
    moved = x.withColumn("rel_path", F.when(F.col("kind") == "text", F.replace(F.col("rel_path"), F.lit("p2."), F.lit("p1."))).otherwise(F.col("rel_path")))
    out = files.pair_sidecars(moved, orphans=True)
    origin = x.where("kind = 'text'").select(F.replace(F.col("rel_path"), F.lit("p2."), F.lit("p1.")).alias("text_path"), F.col("rel_path").alias("origin"))
    return out.join(origin, "text_path", "left").select("image_path", F.col("origin").alias("text_path"))


@query("""SELECT doc_id::VARCHAR AS rel_path, CASE WHEN doc_id % 3 = 0 THEN 'index' WHEN doc_id % 5 = 0 THEN 'cache' ELSE 'hash' END AS origin, CASE WHEN doc_id % 3 = 0 OR doc_id % 5 = 0 THEN sha256(text) END AS sha256 FROM documents""")
def incremental_index(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("rel_path"), F.col("n_chars").alias("size"), F.col("doc_id").alias("modified"), F.sha2("text", 256).alias("sha256"), "doc_id")
    cache = d.where("doc_id % 5 = 0").withColumn("seq", F.lit(1))
    return files.reuse_digests(d.select("rel_path", "size", "modified"), d.where("doc_id % 3 = 0"), cache).select("rel_path", "origin", "sha256")


@query("SELECT d.doc_id AS id, CASE WHEN k.id IS NOT NULL THEN k.id WHEN d.doc_id <> min(d.doc_id) OVER (PARTITION BY sha256(d.text)) THEN min(d.doc_id) OVER (PARTITION BY sha256(d.text)) END AS duplicate_of FROM documents d LEFT JOIN (SELECT sha256(text) AS h, min(-doc_id) AS id FROM documents WHERE doc_id % 10 = 0 GROUP BY 1) k ON k.h = sha256(d.text)")
def registered_files(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("checksum"))
    return files.register(d, d.where("id % 10 = 0").select((-F.col("id")).alias("id"), "checksum")).select("id", "duplicate_of")


@query(f"WITH {SAMPLES} SELECT sample_id FROM s WHERE validation_status IN ('ok', 'warning') AND source_split IN ('train', 'test')")
def exportable_rows(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("duplicate_state", F.lit("unique")).withColumn("target_split", F.coalesce("source_split", F.lit("none")))
    return files.exportable(s, splits=["train", "test"]).select("sample_id")


@query(f"WITH {SAMPLES} SELECT sample_id, source_split = 'Protected_Holdout' AS protected, coalesce(source_split, 'unassigned') AS split, coalesce(page_index, 1)::INT AS page_number FROM s")
def benchmark_page_records(spark, sf_dir):
    s = samples(spark, sf_dir).select(F.col("sample_id").alias("page_id"), "document_id", F.col("source_split").alias("split"), F.col("page_index").alias("page_number"), F.lit("p").alias("profile"), F.lit(None).cast("array<struct<distortion:string,severity:string>>").alias("steps"))
    x = files.benchmark_pages(s, "d", "1")
    return x.select(F.col("page_id").alias("sample_id"), F.when(F.col("split") != "unassigned", F.col("protected")).alias("protected"), "split", "page_number")


@query(f"WITH {SAMPLES} SELECT source_split = 'Protected_Holdout' IS TRUE AS flagged, count(*) AS rows FROM s GROUP BY 1")
def marked_rows(spark, sf_dir):
    return samples(spark, sf_dir).groupBy(protection.marks_protected(F.col("source_split")).alias("flagged")).agg(F.count("*").alias("rows"))


@query("SELECT page_id, substr(sha256(reference), 1, 16) AS truth, metric_name, value FROM (SELECT conv_id || ':' || turn AS page_id, text AS reference, unnest(['length', 'turn']) AS metric_name, unnest([length(text)::DOUBLE, turn::DOUBLE]) AS value FROM conversations)")
def evaluation_tables(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("page_id"), F.col("text").alias("reference"), F.lit("").alias("prediction"), F.col("role").alias("model_id"), F.length("text").alias("length"), "turn")
    t = files.evaluation_rows(c, "run", ["length", "turn"])
    return t["metrics"].join(t["truth"], "page_id").select("page_id", F.substring("raw_text_sha256", 1, 16).alias("truth"), "metric_name", "value")


# ---- contracts and decisions ----


@query(f"""WITH {SAMPLES}, r AS (SELECT 'split' AS rule, sample_id FROM s WHERE source_split <> 'train' OR source_split IS NULL UNION ALL SELECT 'status', sample_id FROM s WHERE validation_status = 'error' UNION ALL SELECT 'protected', sample_id FROM s WHERE source_split = 'Protected_Holdout')
SELECT rule, count(*) AS rows FROM r GROUP BY 1""")
def training_contract(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("target_split", F.col("source_split")).withColumn("duplicate_state", F.lit("unique")).withColumn("protected", protection.marks_protected(F.col("source_split")))
    return decisions.training_contract(s).groupBy("rule").agg(F.count("*").alias("rows"))


@query(f"WITH {SAMPLES} SELECT sample_id, array_to_string(list_filter([CASE WHEN source_record_id IS NULL THEN 'source_record_id' END, CASE WHEN group_id IS NULL THEN 'group_id' END, 'licence'], lambda x: x IS NOT NULL), ',') AS missing FROM s")
def required_fields(spark, sf_dir):
    return decisions.required_fields(samples(spark, sf_dir), ["source_record_id", "group_id", "language", "licence"]).select("sample_id", csv("missing").alias("missing"))


@query(f"WITH {analysed_sql('a')} SELECT sample_id, CASE WHEN cer < 0.3 THEN 'accepted' WHEN doc_id % 2 = 0 THEN 'retry' ELSE 'manual_review' END AS decision FROM a")
def quality_decisions(spark, sf_dir):
    x = analysed(spark, sf_dir)
    even = F.substring("sample_id", 9, 1).cast("int") % 2 == 0
    return x.select("sample_id", decisions.quality_decision(100.0 * (1 - F.col("cer")), F.lit(True), F.lit(0.0), ~even, 70.0000001)["decision"].alias("decision"))


@query(f"""WITH {analysed_sql('a')}, g AS (SELECT *, CASE WHEN wer > 0.8 THEN 'too_slow' WHEN form THEN 'form' END AS rejection FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY language, rejection IS NULL ORDER BY cer DESC, sample_id) AS n FROM g)
SELECT sample_id, rejection, rejection IS NULL AND n = 1 AS chosen FROM c""")
def endpoint_choice(spark, sf_dir):
    form = F.try_element_at("metadata", F.lit("document_type")) == "Form"
    x = decisions.choose(analysed(spark, sf_dir), ["language"], [("too_slow", F.col("wer") > 0.8), ("form", form)], F.col("cer"), ["sample_id"])
    return x.select("sample_id", "rejection", "chosen")


@query(f"""WITH {analysed_sql('a')}, r AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY (cer < 0.5)::INT, CASE WHEN cer >= 0.5 THEN wer END, cer DESC, sample_id) AS n FROM a) SELECT language, string_agg(sample_id, ',' ORDER BY n) AS attempts FROM r WHERE n <= 4 GROUP BY 1""")
def escalation_chain(spark, sf_dir):
    x = analysed(spark, sf_dir).select("language", F.col("sample_id").alias("name"), F.col("cer").alias("score"), F.col("wer").alias("cost"))
    return decisions.escalation(x, ["language"], F.lit(0.5)).select("language", csv("attempts").alias("attempts"))


@query(f"WITH {analysed_sql('a')} SELECT sample_id, CASE WHEN persistent THEN 'HOLDOUT' WHEN regr > 0.35 THEN 'REJECTED' WHEN sev = 1.0 THEN 'GOLD' WHEN cer < 0.98 THEN 'REVIEW' ELSE 'SILVER' END AS tier FROM (SELECT *, doc_id % 20 = 0 AS persistent FROM a)")
def dataset_tiers(spark, sf_dir):
    x = analysed(spark, sf_dir)
    one, zero = F.lit(1.0), F.lit(0)
    x = x.select("sample_id", (F.substring("sample_id", 8, 2).cast("int") % 20 == 0).alias("holdout"), F.lit(True).alias("rights_verified"), (F.col("regression_magnitude") <= 0.35).alias("input_usable"), zero.alias("hallucination_indicators"), F.lit(True).alias("provenance_complete"), (F.col("severity") == "high").alias("human_verified"), F.lit(False).alias("trusted_reference"), F.col("cer").alias("character_agreement"), *[one.alias(n) for n in (*list(decisions.AGREEMENT)[1:], *decisions.COMPLETE)], *[F.lit(0.0).alias(n) for n in decisions.CEILINGS], *[zero.alias(n) for n in decisions.ABSENT.values()])
    return decisions.dataset_tier(x).select("sample_id", "tier")


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM documents), l AS (SELECT *, list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(regexp_replace(x, '[^\S\n]+', ' ', 'g'), '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM t)
SELECT doc_id, CASE WHEN t = '' THEN 'empty_ocr_output' ELSE array_to_string(list_filter([CASE WHEN length(regexp_replace(t, '[^\p{L}\p{N}]+', '', 'g')) < 2 THEN 'suspiciously_sparse_output' END, CASE WHEN length(regexp_replace(t, '[^\x{FFFD}\x{E000}-\x{F8FF}\p{Cc}\p{Cf}]+', '', 'g')) - length(regexp_replace(t, '[^\n\t]+', '', 'g')) > 0 THEN 'unicode_corruption' END,
  CASE WHEN len(list_filter(list_distinct(l), lambda x: len(list_filter(l, lambda y: y = x)) >= 3)) > 0 THEN 'duplicate_line_sequence,repeated_text_block' END], lambda x: x IS NOT NULL), ',') END AS issues FROM l""")
def text_issues(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", csv(decisions.text_issues(F.col("text"), F.lit(True))).alias("issues"))


@query("SELECT conv_id AS page_id, string_agg(CASE WHEN turn % 2 = 1 AND turn * 7 % 5 > conv_id % 5 THEN upper(role) ELSE role END, chr(10) ORDER BY turn) AS text, count(*) FILTER (WHERE turn % 2 = 1 AND turn * 7 % 5 > conv_id % 5) AS replaced FROM conversations GROUP BY 1")
def reread_regions(spark, sf_dir):
    t = F.col("turn")
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page_id"), t.alias("region"), F.col("role").alias("first"), F.when(t % 2 == 1, F.upper("role")).otherwise("").alias("second"), (F.col("conv_id") % 5).alias("confidence"), (t * 7 % 5).alias("second_confidence"))
    return decisions.reread(c)


@query("SELECT 'orders' AS \"table\", count(*) AS rows, 0::BIGINT AS absolute_paths FROM orders UNION ALL SELECT 'pages', count(*), count(*) FILTER (WHERE regexp_matches(url, '^/') OR regexp_matches(html, '^/')) FROM pages")
def table_inventory(spark, sf_dir):
    x = decisions.inventory({"orders": table(spark, sf_dir, "orders"), "pages": table(spark, sf_dir, "pages")})
    return x.select("table", "rows", "absolute_paths")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'outside_root' WHEN doc_id % 3 = 0 THEN 'missing' ELSE 'verified' END AS status FROM documents")
def migrated_paths(spark, sf_dir):
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.when(i % 5 == 0, "/other/").otherwise("/root/data/"), i.cast("string")).alias("path"), F.col("n_chars").alias("size"), F.sha2("text", 256).alias("digest"))
    stored = d.where("doc_id % 3 <> 0").select(F.concat(F.lit("asset://data/"), i.cast("string")).alias("uri"), "size", "digest")
    return decisions.migrate_paths(d, "/root", stored).select("doc_id", "status")


@query("SELECT user_id AS sample_id, count(DISTINCT event_type || ':' || ts::DATE) AS batches FROM events GROUP BY 1")
def selection_usage(spark, sf_dir):
    h = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("purpose"), F.to_date("ts").alias("day")).agg(F.collect_set("user_id").alias("sample_ids"))
    return compare.usage(h).select("sample_id", "batches")


@query("SELECT event_type AS key, count(*)::VARCHAR AS left_value, NULL AS right_value FROM events WHERE event_type = 'click' GROUP BY 1 UNION ALL SELECT 'extra', NULL, '1'")
def run_config_diff(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("key")).agg(F.count("*").cast("string").alias("value"))
    extra = spark.sql("SELECT 'extra' AS key, '1' AS value")
    return compare.config_diff(e, e.where("key <> 'click'").unionByName(extra))


@query("SELECT band::INT AS band, bit, count(*) AS n FROM (SELECT unnest(range(len(embedding))) AS band, unnest(list_transform(embedding, lambda v: v > 0)) AS bit FROM embeddings) GROUP BY ALL")
def sign_histogram(spark, sf_dir):
    """Of all components of the vectors."""
    x = table(spark, sf_dir, "embeddings").select(F.posexplode(F.transform("embedding", lambda v: v > 0)).alias("band", "bit"))
    return x.groupBy("band", "bit").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN abs(p_size / 10.0 - 1.0) <= 0.02 THEN '1:1' WHEN abs(p_size / 10.0 - 4.0 / 3) <= 0.02 * 4 / 3 THEN '4:3' WHEN abs(p_size / 10.0 - 0.75) <= 0.015 THEN '3:4' WHEN abs(p_size / 10.0 - 16.0 / 9) <= 0.02 * 16 / 9 THEN '16:9' WHEN abs(p_size / 10.0 - 0.7071) <= 0.014142 THEN 'a4' ELSE 'r' || (p_size * 10) END AS bucket FROM part")
def aspect_buckets(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", dedupe.aspect_bucket(F.col("p_size"), F.lit(10)).alias("bucket"))


@query("SELECT p_partkey, CASE WHEN p_size * 100 < 500 THEN '<500' WHEN p_size * 100 < 1000 THEN '500-1000' WHEN p_size * 100 < 2000 THEN '1000-2000' WHEN p_size * 100 < 4000 THEN '2000-4000' ELSE '>=4000' END AS bucket FROM part")
def resolution_buckets(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", quality.resolution_bucket(F.col("p_size") * 100).alias("bucket"))


@query("SELECT p_partkey, round(CASE WHEN p_size < 20 THEN (20 - p_size) * 10.0 / (200 + 200 - (20 - p_size) * 10.0) ELSE 0 END, 6) AS iou FROM part")
def box_overlap(spark, sf_dir):
    left = F.array(F.lit(0), F.lit(0), F.lit(20), F.lit(10))
    right = F.array(F.col("p_size"), F.lit(0), F.col("p_size") + 20, F.lit(10))
    return rounded(table(spark, sf_dir, "part").select("p_partkey", quality.overlap(left, right).alias("iou")), "iou")


@query("SELECT CAST(o_orderkey % 10 AS BIGINT) AS shard, CASE WHEN o_orderkey % 10 = 3 THEN 'count' WHEN o_orderkey % 10 = 4 THEN 'missing' END AS problem FROM orders WHERE o_orderkey % 10 IN (3, 4) GROUP BY ALL")
def verified_shards(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 10).alias("shard"), F.col("o_orderkey").cast("string").alias("sample_id"))
    index = records.shard_index(o).withColumn("rows", F.col("rows") + (F.col("shard") == 3).cast("int"))
    return records.verify_shards(o.where("shard <> 4"), index)


@query("SELECT before, after, count(*) AS count FROM (SELECT unnest(string_split(text, ' ')) AS before, unnest(list_transform(string_split(text, ' '), lambda x: replace(x, 'der', 'dem'))) AS after FROM conversations) WHERE before <> after GROUP BY ALL ORDER BY 3 DESC, 1, 2 LIMIT 50")
def learned_substitutions(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("text", F.replace("text", F.lit("der"), F.lit("dem")).alias("fixed"))
    return records.substitutions(c, "text", "fixed", 50)


@query()
def paragraph_edits(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.replace("text", F.lit("the"), F.lit("a")).alias("fixed"))
    return decisions.paragraph_edits(c, "text", "fixed").select("conv_id", "turn", "op", "change_type")


@query("SELECT event_type, count(*) AS count, round(avg(value), 6) AS mean_cer, round(max(value), 6) AS max_cer FROM events GROUP BY 1")
def unioned_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.col("value").alias("cer"))
    both = evaluate.duplicate_free_union(e.where("cer < 10"), e.where("cer >= 10 OR cer IS NULL"))
    return rounded(both.groupBy("event_type").agg(F.count("*").alias("count"), F.avg("cer").alias("mean_cer"), F.max("cer").alias("max_cer")), "mean_cer", "max_cer")
