"""The queries of the library over the driver's tables, and the same in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions import edit, protection, text, textquality
from corpuslens.operators import compare, dedupe, evaluate, quality, records, splits
from corpuslens.plans.views import JOBS, RECOGNIZED, SAMPLES, analysed, analysed_sql, jobs, measured, recognized, sample_texts, samples, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SEED = 13


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


def csv(column: str):
    return F.array_join(column, ",")


def _split_case(key: str, seed: int = SEED) -> str:
    digest = f"sha256('{seed}:split:' || {key})"
    return "CASE " + " ".join(f"WHEN {digest} < '{end}' THEN '{name}'" for name, end in splits.boundaries()) + " ELSE 'holdout' END"


#: Components of (node, signal) pairs in relation `members`.
_REACH = """pairs AS (SELECT DISTINCT node, signal FROM members WHERE node IS NOT NULL AND signal IS NOT NULL),
near AS (SELECT DISTINCT a.node AS x, b.node AS y FROM pairs a JOIN pairs b USING (signal)),
reach(node, other) AS (SELECT DISTINCT node, node FROM pairs UNION SELECT reach.node, near.y FROM reach JOIN near ON reach.other = near.x),
roots AS (SELECT node, min(other) AS root FROM reach GROUP BY node)"""


# ---- duplicates ----


@query("SELECT doc_id, count(*) OVER w AS copies, min(doc_id) OVER w AS canonical, doc_id = min(doc_id) OVER w AS is_canonical FROM documents WINDOW w AS (PARTITION BY sha256(text))")
def exact_dup_families(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return dedupe.exact_groups(d, "h", "doc_id").select("doc_id", "copies", "canonical", "is_canonical")


@query("SELECT sha256(text) AS text_sha256, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    return dedupe.duplicate_groups(table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha256")), "text_sha256", "doc_id")


_CLASSIFY = f"""WITH RECURSIVE {SAMPLES}, members AS (SELECT "row" AS node, unnest(['id' || sample_id, 'record' || source_id || '|' || source_record_id, 'hash' || file_sha256]) AS signal FROM s), {_REACH},
x AS (SELECT s.*, root FROM s JOIN roots ON s."row" = roots.node),
y AS (SELECT *, count(*) OVER (PARTITION BY root) AS family, first_value(sample_id) OVER (PARTITION BY root ORDER BY "row") AS canonical_id, count(*) OVER (PARTITION BY root, sample_id) AS ni,
  count(*) OVER (PARTITION BY root, source_id, source_record_id) AS nr, count(*) OVER (PARTITION BY root, file_sha256) AS nh FROM x),
z AS (SELECT *, CASE WHEN family = 1 THEN 'unique' WHEN "row" <> root THEN 'duplicate' ELSE 'canonical' END AS state,
  CASE WHEN "row" <> root THEN CASE WHEN ni > 1 THEN 'duplicate_sample_id' WHEN source_record_id IS NOT NULL AND nr > 1 THEN 'duplicate_source_record' WHEN nh > 1 THEN 'duplicate_file_hash' ELSE 'duplicate_cluster' END END AS reason FROM y),
t AS (SELECT normalized_text_sha256 AS h, count(DISTINCT file_sha256) AS hashes, min("row") AS first_row, min_by(sample_id, "row") AS text_id FROM z WHERE state <> 'duplicate' GROUP BY 1),
u AS (SELECT z.*, state <> 'duplicate' AND hashes >= 2 AND "row" <> first_row AS conflict, text_id FROM z LEFT JOIN t ON h = normalized_text_sha256)"""


@query(f"{_CLASSIFY} SELECT doc_id, root, reason, CASE WHEN conflict THEN 'conflicting_duplicate' ELSE state END AS duplicate_state, CASE WHEN conflict THEN text_id WHEN \"row\" <> root THEN canonical_id END AS duplicate_of FROM u")
def exact_dup_classify(spark, sf_dir):
    return dedupe.classify_duplicates(samples(spark, sf_dir)).select("doc_id", "root", "reason", "duplicate_state", "duplicate_of")


@query(f"{_CLASSIFY} SELECT 'CLU_' || substr(sha256(string_agg(sample_id, chr(0) ORDER BY sample_id)), 1, 12) AS cluster_id, count(*) AS size FROM u GROUP BY root HAVING count(*) > 1")
def dup_clusters(spark, sf_dir):
    return dedupe.family_clusters(dedupe.classify_duplicates(samples(spark, sf_dir))).select("cluster_id", F.col("size").cast("long").alias("size"))


@query()
def near_text_pairs(spark, sf_dir):
    s = edit.spread(sample_texts(spark, sf_dir), "sample_id").select("sample_id", text.normalize(text.DEDUPE)("text")["value"].alias("value"))
    return rounded(dedupe.near_text_pairs(s), "jaccard")


@query()
def normalized_hash_groups(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.normalize(text.DEDUPE)("text")["value"], 256).alias("h"))
    return dedupe.duplicate_groups(d, "h", "doc_id")


_CODE = "(SELECT vec_id, label, " + ", ".join(f"CAST({' + '.join(f'(CASE WHEN embedding[{16 * k + i + 1}] > 0 THEN {1 << i} ELSE 0 END)' for i in range(16))} AS BIGINT) AS q{k}" for k in range(4)) + " FROM embeddings)"


def _codes(spark, sf_dir):
    """64 sign bits of each vector."""
    bit = lambda i: F.when(F.get("embedding", F.lit(i)) > 0, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    code = bit(0)
    for i in range(1, 64):
        code = code.bitwiseOR(bit(i))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", code.alias("code"))


@query(f"""WITH v AS {_CODE}, r AS (SELECT q0, q1, q2, q3, min(vec_id) AS id FROM v GROUP BY ALL), p AS (SELECT a.id AS a, b.id AS b, bit_count(xor(a.q0, b.q0)) + bit_count(xor(a.q1, b.q1)) + bit_count(xor(a.q2, b.q2)) + bit_count(xor(a.q3, b.q3)) AS distance FROM r a JOIN r b ON a.id < b.id)
SELECT a, b, distance FROM p WHERE distance <= 7 UNION ALL SELECT id, vec_id, 0 FROM v JOIN r USING (q0, q1, q2, q3) WHERE vec_id <> id""")
def hamming_near_pairs(spark, sf_dir):
    return dedupe.close_codes(_codes(spark, sf_dir), limit=7)


@query("SELECT conv_id AS document_id, least(id, next_id) AS a, greatest(id, next_id) AS b FROM (SELECT conv_id, turn, conv_id * 1000 + turn AS id, lead(conv_id * 1000 + turn) OVER w AS next_id, lead(turn) OVER w AS next_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, conv_id * 1000 + turn)) WHERE next_turn - turn = 1")
def adjacent_turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page_index"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    return dedupe.adjacent_pages(c)


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def keep_first_copy(spark, sf_dir):
    return dedupe.keep_first(table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h")), "h", "doc_id").select("doc_id")


# ---- splits and samples ----


@query(f"SELECT doc_id, {_split_case('source || chr(58) || doc_id')} AS split FROM documents")
def hash_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", splits.split_for(F.concat_ws(":", "source", F.col("doc_id").cast("string")), SEED).alias("split"))


_ASSIGN = f"""WITH RECURSIVE {SAMPLES}, live AS (SELECT * FROM gk WHERE validation_status NOT IN ('error', 'excluded')),
members AS (SELECT group_key AS node, unnest(['key' || group_key, 'file' || file_sha256, 'text' || normalized_text_sha256]) AS signal FROM live), {_REACH},
a AS (SELECT gk.*, CASE WHEN validation_status = 'error' OR root IS NULL THEN 'unassigned' ELSE {_split_case('root')} END AS target_split, root FROM gk LEFT JOIN roots ON node = group_key)"""


@query(f"{_ASSIGN} SELECT doc_id, group_key, target_split FROM a")
def group_safe_split(spark, sf_dir):
    return splits.assign_splits(samples(spark, sf_dir), SEED).select("doc_id", "group_key", "target_split")


@query(f"{_ASSIGN} SELECT target_split, count(*) AS samples, count(DISTINCT group_key) AS groups FROM a GROUP BY 1")
def split_report(spark, sf_dir):
    return splits.split_report(splits.assign_splits(samples(spark, sf_dir), SEED))


@query(f"""{_ASSIGN}, l AS (SELECT * FROM a WHERE target_split <> 'unassigned'),
u AS (SELECT 'group_key' AS key, group_key AS v, target_split FROM l UNION ALL SELECT 'file_sha256', file_sha256, target_split FROM l UNION ALL SELECT 'document_id', document_id, target_split FROM l),
g AS (SELECT key, v, count(DISTINCT target_split) AS splits, bool_or(target_split = 'holdout') AS held FROM u GROUP BY ALL)
SELECT key, count(*) FILTER (WHERE splits > 1) AS leaks, count(*) FILTER (WHERE splits > 1 AND held) AS holdout_leaks, count(*) FILTER (WHERE splits > 1) = 0 AS passed FROM g GROUP BY key""")
def split_leakage_checks(spark, sf_dir):
    return splits.split_leaks(splits.assign_splits(samples(spark, sf_dir), SEED), ["group_key", "file_sha256", "document_id"])


@query("WITH h AS (SELECT doc_id, ('0x' || substr(sha256('7:' || doc_id), 1, 16))::UBIGINT / 18446744073709551615.0::DOUBLE AS u FROM documents) SELECT doc_id, CASE WHEN u < 0.9 THEN 'train' WHEN u < 0.95 THEN 'validation' ELSE 'test' END AS split FROM h")
def document_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", splits.document_split(F.col("doc_id"), 7, [("train", 0.9), ("validation", 0.05), ("test", 0.05)]).alias("split"))


@query("SELECT CASE WHEN ('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 8))::UBIGINT % 100 < 20 THEN 'evaluation' ELSE 'training' END AS bucket, count(*) AS orders FROM orders GROUP BY 1")
def eval_bucket(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(splits.evaluation_bucket(F.col("o_orderkey"), 20).alias("bucket")).agg(F.count("*").alias("orders"))


@query("SELECT id, sha256('5:' || id) AS digest FROM (SELECT DISTINCT o_custkey AS id FROM orders) ORDER BY 2, 1 LIMIT 100")
def deterministic_sample(spark, sf_dir):
    return splits.deterministic_sample(table(spark, sf_dir, "orders"), "o_custkey", 100, 5)


_U = "('0x' || substr(sha256('{seed}:' || {id}), 1, 12))::UBIGINT / 281474976710656.0::DOUBLE"


@query(f"SELECT lang, count(*) AS kept FROM documents WHERE {_U.format(seed='3:1', id='doc_id')} < CASE lang WHEN 'en' THEN 0.5 WHEN 'de' THEN 0.25 ELSE 1.0 END GROUP BY lang")
def weighted_stream(spark, sf_dir):
    x = splits.bernoulli_by_stratum(table(spark, sf_dir, "documents"), {"en": 0.5, "de": 0.25}, 3, 1, "lang", "doc_id")
    return x.groupBy("lang").agg(F.count("*").alias("kept"))


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('9:' || doc_id), doc_id) AS n FROM documents) WHERE n <= 5")
def per_source_cap(spark, sf_dir):
    return splits.per_key_cap(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 5, 9, "doc_id")


@query("SELECT doc_id, grp, turn FROM (SELECT doc_id, lang || ':' || source AS grp, row_number() OVER (PARTITION BY lang || ':' || source ORDER BY sha256('4:' || doc_id), doc_id) AS turn FROM documents) ORDER BY turn, grp LIMIT 200")
def balanced_round_robin(spark, sf_dir):
    x = splits.round_robin(table(spark, sf_dir, "documents"), F.concat_ws(":", "lang", "source"), [splits.hash_rank(4, F.col("doc_id")), F.col("doc_id")], 200)
    return x.select("doc_id", "grp", F.col("turn").cast("long").alias("turn"))


@query(f"WITH {SAMPLES} SELECT 'language=' || language AS stratum, count(*) AS count FROM s GROUP BY 1")
def stratified_counts(spark, sf_dir):
    s = samples(spark, sf_dir)
    return s.groupBy(splits.stratum_of(s.columns).alias("stratum")).agg(F.count("*").alias("count"))


# ---- texts ----


@query(r"SELECT doc_id, CASE WHEN regexp_matches(text, '[A-Za-zÀ-ɏ]') THEN 'latin' ELSE 'unknown' END AS script FROM documents")
def char_script_profile(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.script(F.col("text")).alias("script"))


#: The lines that are not blank, trimmed, of the documents, whose only line ends are line feeds.
_LINES = r"l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS lines FROM documents)"


@query(rf"WITH {_LINES}, n AS (SELECT doc_id, list_transform(lines, lambda x: regexp_replace(x, '\s+', ' ', 'g')) AS lines FROM l) SELECT doc_id, CASE WHEN len(lines) < 3 THEN 0.0 ELSE round(1.0 - len(list_distinct(lines)) / len(lines)::DOUBLE, 6) END AS ratio FROM n")
def duplicate_line_ratio(spark, sf_dir):
    return rounded(table(spark, sf_dir, "documents").select("doc_id", textquality.duplicate_line_ratio(F.col("text")).alias("ratio")), "ratio")


def _corruption(spark, sf_dir):
    d = edit.spread(table(spark, sf_dir, "documents").select("doc_id", "text", (50 + F.col("doc_id") % 60).cast("double").alias("estimate")), "doc_id")
    return textquality.with_corruption(d.withColumn("text", text.unicode_form("NFC")("text")), "text", "estimate", F.lit(True))


@query()
def corruption_score(spark, sf_dir):
    x = _corruption(spark, sf_dir).withColumn("a", textquality.acceptance(F.col("corruption"), F.col("estimate")))
    c = F.col("corruption")
    return x.select("doc_id", csv(c["flags"]).alias("flags"), *[c[n].alias(n) for n in ("quality", "readability", "unicode_integrity", "arabic_integrity", "structure", "coverage", "duplication_risk", "hallucination_risk", "route")], "a.accepted", "a.reason")


@query(rf"""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t, 1 + doc_id % 4 AS expected, doc_id % 4 AS converted FROM documents),
n AS (SELECT *, length(regexp_replace(t, '\s+', '', 'g')) AS visible, length(regexp_replace(t, '[^\p{{L}}\p{{N}}]+', '', 'g')) AS useful, length(t) - length(replace(t, chr(65533), '')) AS lost,
  len(list_filter(regexp_split_to_array(t, '\n\s*\n'), lambda p: regexp_matches(p, '\S'))) AS paragraphs FROM d),
p AS (SELECT *, greatest(0.0, least(100.0, 70.0 * useful / greatest(visible, 1)::DOUBLE + 30.0 * least(1.0, length(t) / greatest(40.0, converted * 250.0)) - least(25.0, 5.0 * lost)))::DOUBLE AS a, least(100.0, 100.0 * converted / expected::DOUBLE) AS b,
  CASE WHEN regexp_matches(t, '[A-Za-z]') THEN 95.0 WHEN t <> '' THEN 60.0 ELSE 0.0 END AS c, CASE WHEN t = '' THEN 0.0 ELSE least(100.0, 55.0 + least(30.0, 5.0 * paragraphs) + CASE WHEN contains(t, chr(10)) THEN 15.0 ELSE 0.0 END) END AS e FROM n)
SELECT doc_id, round_even(a, 2) AS text_quality, round_even(b, 2) AS completeness, c::DOUBLE AS direction_quality, e::DOUBLE AS layout_quality, round_even(a * 0.70 + b * 0.15 + c * 0.10 + e * 0.05, 2) AS final_quality FROM p""")
def quality_components(spark, sf_dir):
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", textquality.quality_components(F.col("text"), 1 + i % 4, i % 4).alias("q")).select("doc_id", "q.*")


@query(rf"""WITH {_LINES}, n AS (SELECT doc_id, lines, len(list_filter(lines, lambda x: length(x) < 90 AND (ends_with(x, ':') OR (regexp_matches(x, '\p{{Lu}}') AND NOT regexp_matches(x, '\p{{Ll}}')))))::INT AS titles, len(list_filter(lines, lambda x: contains(x, '|')))::INT AS tables,
  len(list_filter(lines, lambda x: length(x) < 35 AND NOT regexp_matches(x, '[.!]$')))::INT AS side_notes FROM l)
SELECT doc_id, titles, greatest(0, len(lines) - titles - tables - side_notes)::INT AS paragraphs, tables, len(list_filter(lines, lambda x: regexp_matches(x, '(?i)\b(?:figure|img|image)\b')))::INT AS figures, len(list_filter(lines, lambda x: regexp_matches(x, '(?i)\b(?:table|caption)\b')))::INT AS captions,
  CASE WHEN len(lines) > 0 AND length(lines[1]) < 80 THEN 1 ELSE 0 END AS headers, CASE WHEN len(lines) > 1 AND length(lines[len(lines)]) < 80 THEN 1 ELSE 0 END AS footers, side_notes FROM n""")
def layout_profile(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", textquality.layout_profile(F.col("text")).alias("p")).select("doc_id", "p.*")


@query(r"WITH n AS (SELECT doc_id, length(regexp_replace(text, '[^A-Za-z]+', '', 'g')) AS latin FROM documents) SELECT doc_id, 0.0::DOUBLE AS arabic, CASE WHEN latin > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS latin FROM n")
def script_ratios(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", textquality.script_ratios(F.col("text")).alias("r")).select("doc_id", "r.*")


@query(r"SELECT doc_id, sha256(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}\x{202A}-\x{202E}\x{2066}-\x{2069}]', '', 'g')) AS text_sha256, length(text) - length(replace(text, chr(65533), '')) AS corrupt FROM documents")
def document_texts(spark, sf_dir):
    t = textquality.document_text(text.unicode_form("NFC")("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(t, 256).alias("text_sha256"), F.regexp_count("text", F.lit(textquality.COUNTED["replacement"])).cast("long").alias("corrupt"))


_SETTINGS = {"API_KEY": "password", "session-id": "tokens", "user": "the", "REDIS_URL": "http://", "pin_secret": "abc"}


@query("SELECT doc_id, sha256(replace(replace(replace(text, 'password', '<redacted>'), 'tokens', '<redacted>'), 'http://', '<redacted>')) AS redacted_sha256 FROM documents")
def redacted_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(textquality.redact(F.col("text"), _SETTINGS), 256).alias("redacted_sha256"))


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(text, '^\\s*[=+\\-@\\t\\r]') THEN '''' || text ELSE text END AS cell FROM conversations")
def spreadsheet_cells(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.spreadsheet_cell(F.col("text")).alias("cell"))


@query("SELECT doc_id, chunk, digest, row_number() OVER (PARTITION BY digest ORDER BY doc_id, chunk) > 1 AS seen FROM (SELECT doc_id, c::INT AS chunk, sha256(substr(text, c * 1000 + 1, 1000)) AS digest FROM documents, unnest(range(greatest(ceil(length(text) / 1000.0)::INT, 1))) u(c))")
def text_chunks(spark, sf_dir):
    return records.chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 1000).select("doc_id", "chunk", "digest", "seen")


@query("""WITH p AS (SELECT conv_id, count(*) AS pages, avg(length(text)) AS mean_chars, count(*) FILTER (WHERE length(trim(text, ' ')) > 0) AS with_text FROM conversations GROUP BY conv_id)
SELECT conv_id, pages, round(mean_chars, 6) AS mean_chars, CASE WHEN with_text = 0 THEN 'scanned' WHEN mean_chars < 200 THEN 'sparse' ELSE 'text' END AS category,
  CASE WHEN with_text = 0 THEN 'scanned' WHEN mean_chars < 200 THEN 'sparse' ELSE 'text' END || '|' || pages || '|' || round(mean_chars / 100)::BIGINT AS signature FROM p""")
def document_profile(spark, sf_dir):
    x = records.document_profile(table(spark, sf_dir, "conversations"), "conv_id", "text")
    return rounded(x.select("conv_id", "pages", "mean_chars", "category", "signature"), "mean_chars")


# ---- evaluation ----

_DIMENSIONS = ["model_id", "profile", "turn"]


@query(f"WITH {RECOGNIZED} SELECT page_id, round(cer, 6) AS cer, exact, empty FROM e")
def turn_cer(spark, sf_dir):
    return rounded(measured(spark, sf_dir).select("page_id", "cer", "exact", "empty"), "cer")


@query()
def turn_wer(spark, sf_dir):
    return rounded(measured(spark, sf_dir).select("page_id", "wer"), "wer")


_MEASURES = "count(*) AS pages, round(avg(cer), 6) AS mean_cer, round(quantile_cont(cer, 0.5), 6) AS p50_cer, round(quantile_cont(cer, 0.9), 6) AS p90_cer, round(quantile_cont(cer, 0.95), 6) AS p95_cer, round(max(cer), 6) AS max_cer, round(avg(exact), 6) AS exact_rate"


@query(f"WITH {RECOGNIZED} SELECT 'overall' AS dimension, 'all' AS value, {_MEASURES} FROM e " + " ".join(f"UNION ALL SELECT '{d}', CAST({d} AS VARCHAR), {_MEASURES} FROM e GROUP BY {d}" for d in _DIMENSIONS))
def cer_by_dimension(spark, sf_dir):
    x = evaluate.by_each_dimension(measured(spark, sf_dir), _DIMENSIONS)
    x = x.select("dimension", "value", "pages", "mean_cer", "p50_cer", "p90_cer", "p95_cer", "max_cer", "exact_rate")
    return rounded(x, "mean_cer", "p50_cer", "p90_cer", "p95_cer", "max_cer", "exact_rate")


@query(f"WITH {RECOGNIZED} SELECT profile, count(*) AS count, round(avg(cer), 6) AS mean_cer FROM e GROUP BY profile")
def error_summary_by_profile(spark, sf_dir):
    return rounded(evaluate.error_summary(measured(spark, sf_dir), "profile").drop("mean_wer"), "mean_cer")


@query(f"WITH {RECOGNIZED} SELECT page_id, round(cer, 6) AS cer FROM e ORDER BY e.cer DESC, page_id LIMIT 25")
def worst_pages(spark, sf_dir):
    return rounded(evaluate.worst(measured(spark, sf_dir).select("page_id", "cer"), "cer", 25), "cer")


@query(f"WITH {RECOGNIZED} SELECT page_id, round(cer, 6) AS cer FROM (SELECT page_id, cer FROM e ORDER BY cer, page_id DESC LIMIT 25)")
def best_pages(spark, sf_dir):
    return rounded(evaluate.best(measured(spark, sf_dir).select("page_id", "cer"), "cer", 25), "cer")


@query(f"WITH {RECOGNIZED} SELECT page_id, 'cer' AS metric_name, round(cer, 6) AS value FROM e UNION ALL SELECT page_id, 'exact', exact::DOUBLE FROM e")
def metric_unpivot(spark, sf_dir):
    return rounded(evaluate.unpivot_metrics(measured(spark, sf_dir), ["page_id"], ["cer", "exact"]), "value")


@query(f"WITH {RECOGNIZED}, u AS (SELECT model_id, 'cer' AS metric_name, cer AS value FROM e UNION ALL SELECT model_id, 'exact', exact FROM e) SELECT model_id, metric_name, round(avg(value), 6) AS value, count(*) AS pages FROM u GROUP BY ALL")
def run_summary(spark, sf_dir):
    return rounded(evaluate.run_summary(evaluate.unpivot_metrics(measured(spark, sf_dir), ["model_id"], ["cer", "exact"]), "model_id"), "value")


@query(f"WITH {RECOGNIZED}, n AS (SELECT model_id, cer, row_number() OVER (PARTITION BY model_id ORDER BY cer) - 1 AS i, count(*) OVER (PARTITION BY model_id) AS n FROM e) SELECT model_id, round(cer, 6) AS nearest_rank FROM n WHERE i = round_even(0.9 * (n - 1), 0)")
def nearest_rank_p90(spark, sf_dir):
    return rounded(evaluate.nearest_rank(measured(spark, sf_dir), "cer", 0.9, "model_id"), "nearest_rank")


@query(f"WITH {RECOGNIZED}, d AS (SELECT unnest(coalesce(distortions, ['clean'])) AS distortion, model_id, cer FROM e) SELECT model_id, distortion, count(*) AS count, round(avg(cer), 6) AS mean_cer, round(max(cer), 6) AS max_cer FROM d GROUP BY ALL")
def distortion_sensitivity(spark, sf_dir):
    return rounded(evaluate.by_distortion(measured(spark, sf_dir), "model_id"), "mean_cer", "max_cer")


@query(f"""WITH {RECOGNIZED}, g AS (SELECT profile, model_id, count(*) AS runs, avg(cer) AS mean_cer, quantile_cont(cer, 0.5) AS median_cer, avg(CASE WHEN cer < 0.2 THEN 1 ELSE 0 END) AS accept_rate, avg(seconds) AS mean_seconds FROM e GROUP BY ALL)
SELECT profile, model_id, runs, round(mean_cer, 6) AS mean_cer, round(median_cer, 6) AS median_cer, round(accept_rate, 6) AS accept_rate, row_number() OVER (PARTITION BY profile ORDER BY accept_rate DESC, mean_cer, mean_seconds, model_id) = 1 AS is_best FROM g""")
def best_engine(spark, sf_dir):
    x = evaluate.best_engine(measured(spark, sf_dir).withColumn("accepted", F.col("cer") < 0.2), "profile", "model_id")
    return rounded(x.select("profile", "model_id", "runs", "mean_cer", "median_cer", "accept_rate", "is_best"), "mean_cer", "median_cer", "accept_rate")


@query("""WITH b AS (SELECT source AS model, CASE WHEN count(*) >= 30 THEN 'COMPLETE' ELSE 'PARTIAL' END AS status, round(avg(n_chars), 6) AS score FROM documents GROUP BY source)
SELECT model, status, score, CASE WHEN status = 'COMPLETE' THEN rank() OVER (PARTITION BY status = 'COMPLETE' ORDER BY score) END AS rank FROM b""")
def leaderboard(spark, sf_dir):
    b = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("model")).agg(F.when(F.count("*") >= 30, "COMPLETE").otherwise("PARTIAL").alias("status"), F.round(F.avg("n_chars"), 6).alias("score"))
    return evaluate.leaderboard(b).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT s.source AS source, count(DISTINCT s.doc_id) AS pages, count(l.doc_id) AS predictions, CASE WHEN count(l.doc_id) = 0 THEN 'EMPTY' WHEN count(l.doc_id) < count(DISTINCT s.doc_id) THEN 'PARTIAL' ELSE 'COMPLETE' END AS status FROM documents s LEFT JOIN labels l USING (doc_id) GROUP BY s.source")
def run_status(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return evaluate.finalize_run(d, d.join(table(spark, sf_dir, "labels"), "doc_id"), "source")


@query()
def alignment_errors(spark, sf_dir):
    x = recognized(spark, sf_dir).select(edit.alignment()("reference", "prediction").alias("edits"))
    e = x.select(F.explode("edits").alias("e"))
    return e.groupBy("e.op", edit.character_error(F.col("e.ref"), F.col("e.hyp")).alias("category")).agg(F.count("*").alias("count"))


@query()
def top_substitutions(spark, sf_dir):
    x = recognized(spark, sf_dir).select(edit.alignment()("reference", "prediction").alias("edits"))
    return evaluate.top_substitutions(x, "edits")


@query(f"WITH {RECOGNIZED} SELECT page_id, round(100.0 * levenshtein(reference, prediction) / greatest(1, length(reference)), 6) AS cer, round(greatest(0.0, 100.0 - 100.0 * levenshtein(reference, prediction) / greatest(1, length(reference))), 6) AS character_accuracy FROM e")
def percent_metrics(spark, sf_dir):
    x = recognized(spark, sf_dir).select("page_id", edit.percent_metrics(F.col("reference"), F.col("prediction")).alias("m"))
    return rounded(x.select("page_id", "m.cer", "m.character_accuracy"), "cer", "character_accuracy")


# ---- comparison, ranking, recommendation ----

_CHANGE = """CASE WHEN a.cer < 0.5 AND b.cer >= 0.5 THEN 'newly_failed' WHEN a.cer >= 0.5 AND b.cer < 0.5 THEN 'recovered' WHEN b.cer < a.cer - 0.05 THEN 'improved' WHEN b.cer > a.cer + 0.05 THEN 'regressed' ELSE 'unchanged' END"""
_COMPARED = f"WITH {analysed_sql('a')}, {analysed_sql('b', 1)}, c AS (SELECT sample_id, {_CHANGE} AS classification, b.cer - a.cer AS cer_delta, a.cer >= 0.5 AND b.cer >= 0.5 AS persistent FROM a JOIN b USING (sample_id))"


def _compared(spark, sf_dir):
    return compare.compare_runs(analysed(spark, sf_dir), analysed(spark, sf_dir, 1))


@query(f"{_COMPARED} SELECT sample_id, classification, round(cer_delta, 6) AS cer_delta, persistent FROM c")
def compare_runs(spark, sf_dir):
    return rounded(_compared(spark, sf_dir).select("sample_id", "classification", "cer_delta", "persistent"), "cer_delta")


@query(f"{_COMPARED} SELECT classification, count(*) AS samples, round(avg(cer_delta), 6) AS mean_cer_delta FROM c GROUP BY 1")
def comparison_counts(spark, sf_dir):
    return rounded(compare.comparison_counts(_compared(spark, sf_dir)), "mean_cer_delta")


@query(f"""{_COMPARED}, r AS (SELECT 'regression' AS kind, row_number() OVER (ORDER BY round(cer_delta, 6) DESC, sample_id) AS place, sample_id, round(cer_delta, 6) AS cer_delta FROM c WHERE classification IN ('regressed', 'newly_failed')
  UNION ALL SELECT 'improvement', row_number() OVER (ORDER BY round(cer_delta, 6), sample_id), sample_id, round(cer_delta, 6) FROM c WHERE classification IN ('improved', 'recovered')) SELECT * FROM r WHERE place <= 10""")
def comparison_extremes(spark, sf_dir):
    return compare.extremes(rounded(_compared(spark, sf_dir), "cer_delta")).withColumn("place", F.col("place").cast("long"))


@query(f"""WITH {analysed_sql('a')}, {analysed_sql('b', 1)}, d AS (SELECT 'whitespace' AS category, b.n1 - a.n1 AS delta FROM a JOIN b USING (sample_id) UNION ALL SELECT 'diacritic', b.n2 - a.n2 FROM a JOIN b USING (sample_id) UNION ALL SELECT 'missing_word', b.n3 - a.n3 FROM a JOIN b USING (sample_id))
SELECT category, CAST(sum(delta) AS BIGINT) AS delta, count(*) AS samples FROM d WHERE delta <> 0 GROUP BY category""")
def error_delta_full_outer(spark, sf_dir):
    return compare.error_deltas(analysed(spark, sf_dir), analysed(spark, sf_dir, 1))


_HARD = f"""WITH {analysed_sql('a')}, m AS (SELECT max((n1 > 0)::INT + (n2 > 0)::INT + (n3 > 0)::INT) AS cats, nullif(max(pers), 0) AS mp, nullif(max(regr), 0) AS mr, sum(n1) AS s1, sum(n2) AS s2, sum(n3) AS s3, sum(n1 + n2 + n3) AS sa FROM a),
q AS (SELECT a.*, (n1 > 0)::INT + (n2 > 0)::INT + (n3 > 0)::INT AS k, m.cats, mp, mr, (n1 > 0)::INT * s1::DOUBLE / sa + (n2 > 0)::INT * s2::DOUBLE / sa + (n3 > 0)::INT * s3::DOUBLE / sa AS share FROM a, m),
h AS (SELECT *, round(0.30 * cer + 0.15 * wer + 0.15 * ncer + 0.10 * least(1, regr / mr) + 0.10 * k / cats + 0.10 * least(1, pers / mp) + 0.05 * sev + 0.05 * CASE WHEN k > 0 THEN greatest(0, least(1, 1.0 - share / k)) ELSE 0 END, 9) AS score FROM q),
x AS (SELECT *, row_number() OVER (ORDER BY score DESC, sample_id) AS rank FROM h)"""


def _hard(spark, sf_dir):
    """Scores to nine places, so that two engines agree on ties."""
    return compare.hard_examples(analysed(spark, sf_dir), digits=9)


@query(f"{_HARD} SELECT sample_id, score, rank FROM x")
def hard_rank(spark, sf_dir):
    return _hard(spark, sf_dir).select("sample_id", "score", "rank")


@query(f"{_HARD} SELECT sample_id, rank FROM x WHERE rank <= greatest(1, round_even((SELECT count(*) FROM x) * 10 / 100.0, 0)) AND score >= 0.5 ORDER BY rank LIMIT 50")
def hard_selection(spark, sf_dir):
    return compare.select_hard(_hard(spark, sf_dir), percentile=10, least=0.5, top=50).select("sample_id", "rank")


@query(f"{_HARD} SELECT sample_id, rank, row_number() OVER (ORDER BY rank) AS place FROM x ORDER BY rank LIMIT 30")
def recommend_hardest(spark, sf_dir):
    return compare.recommend(_hard(spark, sf_dir), "hardest_only", 30).withColumn("place", F.col("place").cast("long"))


@query(f"{_HARD} SELECT sample_id, rank, row_number() OVER (ORDER BY sha256('lab-recommend:20260723:' || sample_id), sample_id) AS place FROM x ORDER BY place LIMIT 30")
def recommend_random(spark, sf_dir):
    return compare.recommend(_hard(spark, sf_dir), "deterministic_random", 30).withColumn("place", F.col("place").cast("long"))


@query(f"{_HARD}, t AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY rank) AS turn FROM x) SELECT sample_id, rank, row_number() OVER (ORDER BY turn, grp) AS place FROM t ORDER BY place LIMIT 30")
def recommend_balanced(spark, sf_dir):
    return compare.recommend(_hard(spark, sf_dir), "balanced_hard", 30).withColumn("place", F.col("place").cast("long"))


@query(f"{_HARD}, t AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY rank) AS turn FROM x) SELECT sample_id, rank, row_number() OVER (ORDER BY turn > 1, rank) AS place FROM t ORDER BY place LIMIT 30")
def recommend_diverse(spark, sf_dir):
    return compare.recommend(_hard(spark, sf_dir), "diversity_first", 30).withColumn("place", F.col("place").cast("long"))


@query(f"{_HARD}, t AS (SELECT sample_id, rank, rank <= 20 AS hard, (SELECT count(*) FROM x) AS n FROM x) SELECT sample_id, rank, row_number() OVER (ORDER BY NOT hard, CASE WHEN hard THEN rank ELSE -rank END) AS place FROM t WHERE hard OR rank > n - 30 ORDER BY place LIMIT 30")
def recommend_curriculum(spark, sf_dir):
    return compare.recommend(_hard(spark, sf_dir), "mixed_curriculum", 30).withColumn("place", F.col("place").cast("long"))


@query(f"""WITH {analysed_sql('a')}, b AS (SELECT sample_id, list_filter([CASE WHEN cer >= 0.4 THEN 'high_cer' END, CASE WHEN wer >= 0.5 THEN 'high_wer' END, CASE WHEN n1 + n2 + n3 > 0 AND n1 / (n1 + n2 + n3)::DOUBLE >= 0.4 THEN 'whitespace_heavy' END,
  CASE WHEN n1 + n2 + n3 > 0 AND n2 / (n1 + n2 + n3)::DOUBLE >= 0.4 THEN 'diacritics_heavy' END, CASE WHEN n1 + n2 + n3 > 0 AND n3 / (n1 + n2 + n3)::DOUBLE >= 0.4 THEN 'deletion_heavy' END, CASE WHEN doc_id % 8 = 0 THEN 'distorted_blur' END,
  CASE WHEN doc_id % 8 = 1 THEN 'distorted_skew' END, CASE WHEN doc_id % 8 = 1 THEN 'distorted_compression' END, CASE WHEN mlang = 'ar+en' THEN 'mixed_arabic_english' END, CASE WHEN form THEN 'table_form' END], lambda x: x IS NOT NULL) AS l FROM a)
SELECT sample_id, CASE WHEN len(l) = 0 THEN 'unknown' ELSE array_to_string(l, ',') END AS buckets, CASE WHEN len(l) = 0 THEN 'unknown' ELSE l[1] END AS primary_bucket FROM b""")
def failure_buckets(spark, sf_dir):
    return compare.failure_buckets(analysed(spark, sf_dir)).select("sample_id", csv("buckets").alias("buckets"), "primary_bucket")


@query(f"WITH {analysed_sql('a')} SELECT sample_id FROM a WHERE language IN ('en', 'de') AND cer >= 0.3 AND cer <= 0.6 AND doc_id % 8 = 1 AND n2 > 0")
def select_by_criteria(spark, sf_dir):
    x = analysed(spark, sf_dir)
    return compare.select_rows(x, F.lit(False), {"language": ["en", "de"], "min_cer": 0.3, "max_cer": 0.6, "distortion": "skew", "error_type": "diacritic"}).select("sample_id")


@query(f"WITH {analysed_sql('a')}, q AS (SELECT quantile_cont(cer, 0.25) AS lo, quantile_cont(cer, 0.5) AS hi FROM a) SELECT sample_id FROM a, q WHERE cer BETWEEN lo AND hi ORDER BY sample_id LIMIT 100")
def percentile_window(spark, sf_dir):
    return compare.sample_rows(analysed(spark, sf_dir), "cer", window=(25, 50), limit=100).select("sample_id")


@query(f"WITH {analysed_sql('a')} SELECT language, count(*) AS count FROM a GROUP BY 1")
def balance_counts(spark, sf_dir):
    return compare.balance_counts(analysed(spark, sf_dir), "language")


# ---- quality gate ----

_PART = """prt AS (SELECT *, CASE WHEN source_split = 'Protected_Holdout' THEN 'PROTECTED' WHEN source_split = 'train' THEN 'TRAIN' WHEN source_split = 'test' THEN 'EVAL' ELSE 'UNPARTITIONED' END AS part FROM gk)"""


def _finding_sql(kind: str, key: str, severity: str, extra: str = "") -> str:
    return f"""SELECT 'LKG_' || substr(sha256('{kind}|' || k || '|' || array_to_string(ids, '|')), 1, 12) AS finding_id, '{kind}' AS kind, severity, k AS canonical_key, array_to_string(ps, ',') AS partitions, ids FROM (
      SELECT k, ids, ps, {severity} AS severity FROM (SELECT {key} AS k, list_sort(list(sample_id)) AS ids, list_sort(list(DISTINCT part)) AS ps, bool_or(derived) AS dv FROM prt WHERE {key} IS NOT NULL GROUP BY 1)) WHERE severity IS NOT NULL {extra}"""


_CROSS = "list_contains(ps, 'TRAIN') AND (list_contains(ps, 'EVAL') OR list_contains(ps, 'PROTECTED'))"
_WARN = f"CASE WHEN {_CROSS} THEN 'critical' WHEN len(list_filter(ps, lambda x: x <> 'UNPARTITIONED')) > 1 THEN 'warning' END"
_LEAKS = f"""WITH RECURSIVE {SAMPLES}, {_PART}, lk AS ({_finding_sql('exact_hash_cross_split', 'file_sha256', _WARN)} UNION ALL {_finding_sql('page_identity_cross_split', "source_id || '|' || document_id || '|' || page_id", _WARN)}
  UNION ALL {_finding_sql('derived_page_cross_boundary', 'normalized_text_sha256', f"CASE WHEN {_CROSS} AND dv THEN 'critical' END")} UNION ALL {_finding_sql('gt_text_cross_split', 'normalized_text_sha256', f"CASE WHEN {_CROSS} AND NOT dv THEN 'warning' END")}
  UNION ALL {_finding_sql('group_straddle', 'group_key', f"CASE WHEN {_CROSS} THEN 'critical' END")})"""


def _partitioned(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("group_key", splits.group_key()).withColumn("malformed", F.lit(False))
    x = s.withColumn("partition", protection.partition_of(F.col("target_split"), F.col("source_split"), F.lit(False)))
    # the group key of these samples ignores records, which are signals of duplicates
    return x


@query(f"{_LEAKS} SELECT finding_id, kind, severity, canonical_key, partitions, len(ids) AS samples FROM lk")
def leakage_findings(spark, sf_dir):
    x = quality.detect_leakage(_partitioned(spark, sf_dir))
    return x.select("finding_id", "kind", "severity", "canonical_key", csv("partitions").alias("partitions"), F.size("sample_ids").cast("long").alias("samples"))


@query(f"WITH {SAMPLES}, {_PART} SELECT part AS partition, count(*) AS samples FROM prt GROUP BY 1")
def partition_counts(spark, sf_dir):
    return _partitioned(spark, sf_dir).groupBy("partition").agg(F.count("*").alias("samples"))


_DECISIONS = f"""{_LEAKS}, cl AS (SELECT file_sha256 AS cluster_id, sample_id FROM s WHERE file_sha256 IN (SELECT file_sha256 FROM s GROUP BY 1 HAVING count(*) > 1)),
own AS (SELECT cl.cluster_id, p.sample_id, row_number() OVER (PARTITION BY cl.cluster_id ORDER BY (part <> 'PROTECTED')::INT, (validation_status = 'error')::INT, derived::INT, p.sample_id) AS n, first_value(p.sample_id) OVER (PARTITION BY cl.cluster_id ORDER BY (part <> 'PROTECTED')::INT, (validation_status = 'error')::INT, derived::INT, p.sample_id) AS keep_id FROM cl JOIN prt p USING (sample_id)),
dec AS (SELECT sample_id, 0 AS prio, 'quarantine' AS decision, 'protected' AS reason, 'split' AS reason_source FROM prt WHERE part = 'PROTECTED'
  UNION ALL SELECT sample_id, 1, 'exclude', 'LOW_QUALITY', 'artifact' FROM s WHERE validation_status = 'error'
  UNION ALL SELECT sample_id, 2, 'exclude', 'duplicate_of:' || keep_id, 'cluster' FROM own WHERE n > 1
  UNION ALL SELECT l.sample_id, 3, 'exclude', min(kind), 'leakage' FROM (SELECT unnest(ids) AS sample_id, kind FROM lk WHERE severity = 'critical') l JOIN prt USING (sample_id) WHERE part = 'TRAIN' GROUP BY 1),
fin AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY prio, reason) AS n FROM dec) WHERE n = 1)"""


def _decisions(spark, sf_dir):
    s = _partitioned(spark, sf_dir).withColumn("protected", F.col("partition") == "PROTECTED").withColumn("canonical", F.lit(True))
    s = s.withColumn("transformations", F.size("transformations"))
    copies = s.groupBy("file_sha256").agg(F.count("*").alias("n")).where("n > 1")
    clusters = s.join(copies, "file_sha256").select(F.col("file_sha256").alias("cluster_id"), "sample_id")
    issues = s.where("validation_status = 'error'").select("sample_id", F.lit("LOW_QUALITY").alias("code"))
    return s, quality.exclusions(s, clusters, issues, quality.detect_leakage(_partitioned(spark, sf_dir)))


@query(f"{_DECISIONS} SELECT sample_id, decision, reason, reason_source FROM fin")
def exclusion_policy(spark, sf_dir):
    return _decisions(spark, sf_dir)[1]


@query(f"{_DECISIONS} SELECT reason_source, decision, count(*) AS samples FROM fin GROUP BY ALL UNION ALL SELECT 'all', 'all', count(*) FROM fin")
def exclusion_report(spark, sf_dir):
    return quality.exclusion_report(_decisions(spark, sf_dir)[1])


@query(f"{_DECISIONS} SELECT sample_id FROM s WHERE sample_id NOT IN (SELECT sample_id FROM fin)")
def clean_rows(spark, sf_dir):
    return quality.clean_rows(*_decisions(spark, sf_dir)).select("sample_id")


@query(f"{_DECISIONS} SELECT sample_id FROM fin WHERE decision = 'quarantine'")
def quarantine_rows(spark, sf_dir):
    return quality.quarantine_rows(*_decisions(spark, sf_dir)).select("sample_id")


@query(f"{_LEAKS} SELECT CASE WHEN count(*) FILTER (WHERE severity IN ('error', 'critical')) > 0 THEN 'FAIL' WHEN count(*) > 0 THEN 'WARN' ELSE 'PASS' END AS verdict, count(*) FILTER (WHERE severity IN ('error', 'critical')) AS failures, count(*) AS issues FROM lk")
def verdict(spark, sf_dir):
    return quality.verdict(quality.issues_of(quality.detect_leakage(_partitioned(spark, sf_dir))))


@query("""SELECT doc_id, CASE WHEN length(trim(text, ' ')) < 1 THEN 'error' WHEN length(trim(text, ' ')) < 60 OR contains(text, chr(65533)) THEN 'warning' ELSE 'ok' END AS validation_status,
  array_to_string(list_filter([CASE WHEN length(trim(text, ' ')) < 1 THEN 'text_empty' END, CASE WHEN contains(text, chr(65533)) THEN 'text_replacement' END, CASE WHEN length(trim(text, ' ')) BETWEEN 1 AND 59 THEN 'text_short' END], lambda x: x IS NOT NULL), ',') AS quality_flags FROM documents""")
def validation_findings(spark, sf_dir):
    x = quality.validate(table(spark, sf_dir, "documents"), quality.text_findings(F.col("text"), quality.LIMITS | {"short_text": 60}))
    return x.select("doc_id", "validation_status", csv("quality_flags").alias("quality_flags"))


_LENGTH = "CASE WHEN n_chars <= 0 THEN '0' WHEN n_chars <= 50 THEN '1-50' WHEN n_chars <= 200 THEN '51-200' WHEN n_chars <= 1000 THEN '201-1000' WHEN n_chars <= 10000 THEN '1001-10000' ELSE '>10000' END"


@query(f"""WITH {SAMPLES} SELECT 'language' AS dimension, language AS key, count(*) AS count FROM s GROUP BY 2 UNION ALL SELECT 'length', {_LENGTH}, count(*) FROM s GROUP BY 2 UNION ALL SELECT 'status', validation_status, count(*) FROM s GROUP BY 2
  UNION ALL SELECT 'source_split', coalesce(source_split, 'unknown'), count(*) FROM s GROUP BY 2 UNION ALL SELECT 'transformation', 'blur', count(*) FROM s WHERE derived""")
def health_histograms(spark, sf_dir):
    s = samples(spark, sf_dir)
    return quality.histograms(s, {"language": F.col("language"), "length": quality.length_bucket(F.col("n_chars")), "status": F.col("validation_status"), "source_split": F.col("source_split")}, {"transformation": F.col("transformations")})


@query(f"WITH {SAMPLES} SELECT language, validation_status, count(*) AS count FROM s GROUP BY ALL")
def health_crosstab(spark, sf_dir):
    return quality.cross_table(samples(spark, sf_dir), "language", "validation_status")


@query("WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT sum(n) AS a FROM n) SELECT round(-sum(n / a * log2(n / a)), 6) AS bits FROM n, t")
def source_entropy(spark, sf_dir):
    return rounded(quality.entropy(table(spark, sf_dir, "documents"), "source"), "bits")


@query("SELECT source, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS characters, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(DISTINCT sha256(text)) AS distinct_texts, count(DISTINCT lang) AS languages FROM documents GROUP BY source")
def corpus_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("characters"), F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.count_distinct(F.sha2("text", 256)).alias("distinct_texts"), F.count_distinct("lang").alias("languages"))


#: Texts of a block of short items, and short items that are broadcast.
_SHORT, _FEW = 256, 100_000


@query("SELECT i.item_id, count(d.doc_id) AS documents FROM benchmark i LEFT JOIN documents d ON contains(d.text, i.text) GROUP BY 1")
def benchmark_contamination(spark, sf_dir):
    """Documents that hold an item's whole text. A document holds an item only if it holds all the item's inner words (those
    between two separators, which no neighbour can extend); the rarest of them is joined, and the texts are compared. Items
    without an inner word are compared with every document, in blocks."""
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    inner = F.explode(F.array_distinct(F.slice(F.split("text", "[ \\n]"), F.lit(2), F.greatest(F.size(F.split("text", "[ \\n]")) - 2, F.lit(0)))))
    words = d.select("doc_id", F.explode(F.array_distinct(F.split("text", "[ \\n]"))).alias("word"))
    wanted = b.select("item_id", inner.alias("word")).where("word <> ''")
    counted = wanted.join(words.join(wanted.select("word").distinct(), "word").groupBy("word").agg(F.count("*").alias("n")), "word")
    anchor = counted.groupBy("item_id").agg(F.min_by("word", F.struct("n", "word")).alias("word"))
    pairs = words.join(anchor, "word").select("doc_id", "item_id").join(b.select("item_id", F.col("text").alias("item")), "item_id")
    pairs = pairs.join(d.select("doc_id", "text"), "doc_id").where(F.contains("text", "item"))
    n = pairs.groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"))
    short = b.where("text IS NOT NULL").join(wanted.select("item_id").distinct(), "item_id", "left_anti")
    texts = short.select("text").distinct()
    if many := texts.count():
        blocks = texts.groupBy(F.pmod(F.xxhash64("text"), F.lit(-(-many // _SHORT)))).agg(F.collect_list("text").alias("items")).select("items")
        held = d.crossJoin(F.broadcast(blocks) if many <= _FEW else blocks).select("doc_id", F.explode(F.filter("items", lambda i: F.contains("text", i))).alias("text"))
        n = n.union(short.select("item_id", "text").join(held.groupBy("text").agg(F.count("doc_id").alias("documents")), "text").select("item_id", "documents"))
    return b.select("item_id").join(n, "item_id", "left").select("item_id", F.coalesce("documents", F.lit(0)).alias("documents"))


# ---- records ----

_AS_OF = "2024-01-20"


@query(f"""WITH {JOBS} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE created_at::DATE = DATE '{_AS_OF}') AS today,
  count(*) FILTER (WHERE created_at::DATE BETWEEN DATE '{_AS_OF}' - 6 AND DATE '{_AS_OF}') AS last_7_days, count(*) FILTER (WHERE created_at::DATE BETWEEN DATE '2024-01-01' AND DATE '{_AS_OF}') AS this_month, round(sum(cost), 6) AS cost,
  round(coalesce(sum(cost) FILTER (WHERE created_at::DATE = DATE '{_AS_OF}'), 0), 6) AS cost_today, round(avg(quality) FILTER (WHERE status = 'done'), 6) AS mean_quality, round(avg(seconds) FILTER (WHERE status = 'done'), 6) AS mean_seconds,
  round(count(*) FILTER (WHERE status = 'done') / count(*) FILTER (WHERE status IN ('done', 'failed')), 6) AS success_rate FROM j""")
def stats_dashboard(spark, sf_dir):
    return rounded(records.statistics(jobs(spark, sf_dir), _AS_OF), "cost", "cost_today", "mean_quality", "mean_seconds", "success_rate")


@query(f"WITH {JOBS} SELECT failure, count(*) AS count FROM j WHERE failure IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def top_failure(spark, sf_dir):
    return records.most_frequent(jobs(spark, sf_dir), "failure")


@query(f"WITH {JOBS} SELECT engine, count(*) AS runs, count(*) FILTER (WHERE status <> 'done') AS failures, round(avg(seconds), 6) AS mean_seconds, round(avg(quality), 6) AS mean_quality FROM j GROUP BY 1")
def engine_performance(spark, sf_dir):
    return rounded(records.performance(jobs(spark, sf_dir), "engine", F.col("status") == "done"), "mean_seconds", "mean_quality")


@query(f"WITH {JOBS}, g AS (SELECT engine, user_id, avg(quality) AS mean, count(*) AS n FROM j GROUP BY ALL HAVING count(*) >= 2) SELECT engine, user_id, round(mean, 6) AS mean, n, round(mean + least(6.0, 0.4 * n), 6) AS value FROM g ORDER BY mean + least(6.0, 0.4 * n) DESC, engine, user_id LIMIT 1")
def preferred_attempt(spark, sf_dir):
    return rounded(records.preferred(jobs(spark, sf_dir), ["engine", "user_id"], "quality"), "mean", "value")


def _examples(spark, sf_dir):
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(F.concat(F.lit("p"), (i % 40).cast("string")).alias("pattern"), F.col("event_type").alias("replacement"), F.col("user_id").alias("job_id"), (i % 3 > 0).alias("accepted"))


_EXAMPLES = "x AS (SELECT 'p' || (event_id % 40) AS pattern, event_type AS replacement, user_id AS job_id, event_id % 3 > 0 AS accepted FROM events)"
_RULES = f"WITH {_EXAMPLES}, g AS (SELECT pattern, replacement, count(*) FILTER (WHERE accepted) AS accepted, count(*) FILTER (WHERE NOT accepted) AS rejected, count(DISTINCT job_id) AS sources FROM x GROUP BY ALL), c AS (SELECT *, least(0.99, accepted / greatest(1, accepted + rejected)::DOUBLE * least(1.0, sources / 3.0)) AS confidence FROM g)"


@query(f"{_RULES} SELECT pattern, replacement, accepted, rejected, sources, round(confidence, 6) AS confidence FROM c")
def correction_rules(spark, sf_dir):
    return rounded(records.rules_of(_examples(spark, sf_dir)), "confidence")


@query(f"{_RULES} SELECT pattern, replacement FROM c WHERE sources >= 3 AND confidence >= 0.6 AND right(pattern, 1) <> '3' AND replacement <> 'click' AND right(pattern, 1) <> '7'")
def active_correction_rules(spark, sf_dir):
    r = records.rules_of(_examples(spark, sf_dir)).withColumn("id", F.concat_ws(":", "pattern", "replacement")).withColumn("approved", ~F.col("pattern").endswith("3"))
    r = r.withColumn("enabled", F.col("replacement") != "click").withColumn("is_sensitive", F.col("pattern").endswith("7"))
    return records.active_rules(r, confidence=0.6).select("pattern", "replacement")


@query(f"WITH {_EXAMPLES} SELECT count(*) AS examples, count(*) FILTER (WHERE accepted) AS accepted, count(DISTINCT job_id) AS jobs, count(DISTINCT pattern) AS patterns, CASE WHEN count(*) FILTER (WHERE accepted) = 0 THEN 'empty' WHEN count(DISTINCT job_id) >= 3 AND count(*) FILTER (WHERE accepted) >= 10 THEN 'ready' ELSE 'collecting' END AS label FROM x")
def correction_readiness(spark, sf_dir):
    return records.readiness(_examples(spark, sf_dir))


@query("SELECT count(*) AS evaluations, round(avg(value), 6) AS mean_before, round(avg(value + event_id % 5), 6) AS mean_after, round(avg(event_id % 5), 6) AS improvement FROM events")
def correction_improvement(spark, sf_dir):
    x = table(spark, sf_dir, "events").select(F.col("value").alias("before"), (F.col("value") + F.col("event_id") % 5).alias("after"))
    return rounded(records.improvement(x), "mean_before", "mean_after", "improvement")


@query("""SELECT user_id AS run_id, event_type AS metric_name, round(max_by(value, event_id), 6) AS last, round(CASE WHEN event_type = 'click' THEN max(value) ELSE min(value) END, 6) AS best, count(*) AS points FROM events GROUP BY user_id, event_type""")
def metric_last_best(spark, sf_dir):
    m = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("metric_name"), F.col("event_id").alias("step"), "value")
    return rounded(records.last_and_best(m, ["click"]), "last", "best")


@query("SELECT o_orderkey, o_orderpriority, place FROM (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= CASE o_orderpriority WHEN '1-URGENT' THEN 20 ELSE 5 END")
def ranked_by_class(spark, sf_dir):
    x = records.by_class_top(table(spark, sf_dir, "orders"), "o_orderpriority", [F.col("o_totalprice").desc(), F.col("o_orderkey")], {"1-URGENT": 20}, 5)
    return x.select("o_orderkey", "o_orderpriority", F.col("place").cast("long").alias("place"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) <= 2 AS admitted FROM events")
def daily_quota(spark, sf_dir):
    return records.daily_quota(table(spark, sf_dir, "events"), "user_id", "ts", 2, "event_id").select("event_id", "admitted")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 21600 SECOND PRECEDING AND CURRENT ROW) AS load FROM events")
def sliding_quota(spark, sf_dir):
    return records.sliding_load(table(spark, sf_dir, "events"), "user_id", "ts", 21_600).select("event_id", "load")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS events FROM s GROUP BY user_id, n""")
def sessions(spark, sf_dir):
    return records.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "6 hours")


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS used_value FROM events")
def running_usage(spark, sf_dir):
    x = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return rounded(records.running_usage(x, ["user_id", "day"], "ts", "event_id", ["value"]).select("event_id", "used_value"), "used_value")


@query("""SELECT o_orderkey AS k, o_orderstatus AS content, 1 AS version FROM orders UNION ALL SELECT o_orderkey, 'Z', 2 FROM orders WHERE o_orderpriority = '1-URGENT'""")
def manifest_upsert(spark, sf_dir):
    """Every order is written twice; urgent ones have other content the second time."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "k")
    store = o.select("k", F.col("o_orderstatus").alias("content"), F.lit(1).alias("version"))
    entries = o.select("k", F.when(F.col("o_orderpriority") == "1-URGENT", "Z").otherwise(F.col("o_orderstatus")).alias("content"))
    return records.upsert(store, entries, "k", "version_new")


@query(f"WITH {JOBS} SELECT id, CASE WHEN status = 'pending' AND id % 4 = 0 THEN 'done' ELSE status END AS status, CASE WHEN id % 4 <> 0 THEN 'kept' WHEN status = 'pending' THEN 'moved' ELSE 'refused' END AS outcome FROM j")
def job_transitions(spark, sf_dir):
    j = jobs(spark, sf_dir).select("id", "status")
    wanted = j.where("id % 4 = 0").select("id", F.lit("done").alias("target"))
    return records.transition(j, wanted, [("pending", "done")], "id")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version FROM orders")
def next_versions(spark, sf_dir):
    return records.next_version(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey").select("o_orderkey", F.col("version").cast("long").alias("version"))


@query(f"WITH {JOBS} SELECT id FROM j WHERE status = 'failed' ORDER BY created_at DESC, id DESC LIMIT 100")
def newest_failures(spark, sf_dir):
    return records.newest(jobs(spark, sf_dir), "created_at", "id", 100, F.col("status") == "failed").select("id")


@query(f"WITH {JOBS} SELECT (SELECT failure FROM j WHERE failure IS NOT NULL ORDER BY created_at DESC, id DESC LIMIT 1) AS failure, (SELECT engine FROM j ORDER BY created_at DESC, id DESC LIMIT 1) AS engine")
def latest_known(spark, sf_dir):
    return records.latest(jobs(spark, sf_dir), "created_at", "id", "failure", "engine")


@query("SELECT c_custkey, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def cost_rollup(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    x = records.rollup(o, table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", "o_totalprice", "total")
    return x.withColumn("total", F.round("total", 2))


@query(f"WITH {JOBS} SELECT id, CASE WHEN status = 'pending' AND created_at < TIMESTAMP '2024-01-29 23:00:00' THEN CASE WHEN id % 2 = 1 THEN 'queued' ELSE 'failed' END WHEN status = 'pending' THEN 'processing' ELSE status END AS status FROM j")
def stale_recovery(spark, sf_dir):
    j = jobs(spark, sf_dir).select("id", F.when(F.col("status") == "pending", "processing").otherwise(F.col("status")).alias("status"), F.col("created_at").cast("timestamp").alias("heartbeat"), (F.col("id") % 2).alias("retries_left"))
    return records.recover_stale(j, F.lit("2024-01-30 00:00:00").cast("timestamp"), 3600).select("id", "status")


@query("SELECT o_custkey, count(*) AS rows FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY 1")
def fk_violations(spark, sf_dir):
    return quality.foreign_key_violations(table(spark, sf_dir, "orders"), "o_custkey", table(spark, sf_dir, "customer"), "c_custkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def pk_violations(spark, sf_dir):
    return quality.primary_key_violations(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("""WITH d AS (SELECT conv_id AS document_id FROM conversations WHERE conv_id % 7 <> 0), p AS (SELECT conv_id AS document_id, conv_id || ':' || turn AS page_id, turn AS page_number FROM conversations)
SELECT 'repeated_document' AS rule, document_id::VARCHAR AS key FROM d GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'unknown_document', page_id FROM p WHERE document_id NOT IN (SELECT document_id FROM d) UNION ALL SELECT 'bad_page_number', page_id FROM p WHERE page_number < 1""")
def manifest_violations(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    pages = c.select(F.col("conv_id").alias("document_id"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("page_id"), F.col("turn").alias("page_number"))
    return quality.manifest_violations(c.where("conv_id % 7 <> 0").select(F.col("conv_id").alias("document_id")), pages)


@query("SELECT o_custkey, count(DISTINCT o_orderstatus) AS splits, count(*) AS rows FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def straddling_keys(spark, sf_dir):
    return quality.straddling(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus")


@query("""WITH c AS (SELECT source AS dataset_id, CASE WHEN min(doc_id) % 3 = 0 THEN 'verified' WHEN min(doc_id) % 3 = 1 THEN 'unverified' ELSE 'forbidden' END AS status FROM documents WHERE doc_id % 20 <> 19 GROUP BY 1)
SELECT doc_id, CASE WHEN status IS NULL THEN 'unknown data set' WHEN status = 'forbidden' THEN 'licence forbids use' WHEN status = 'unverified' THEN 'licence is not verified' END AS reason, coalesce(status = 'verified', false) AS allowed FROM documents LEFT JOIN c ON dataset_id = source""")
def licence_decisions(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("dataset_id"))
    n = F.min("doc_id") % 3
    catalog = d.where("doc_id % 20 <> 19").groupBy("dataset_id").agg(F.when(n == 0, "verified").when(n == 1, "unverified").otherwise("forbidden").alias("status")).withColumn("allows", F.array(F.lit("training")))
    return quality.licence_decisions(d, catalog, "training").select("doc_id", "reason", "allowed")


@query("""SELECT l.k::VARCHAR AS path, CASE WHEN r.k IS NULL THEN 'planned' WHEN l.s <> r.s THEN 'size_mismatch' WHEN l.h <> r.h THEN 'checksum_mismatch' ELSE 'verified' END AS status FROM (SELECT doc_id AS k, n_chars AS s, sha256(text) AS h FROM documents) l
LEFT JOIN (SELECT doc_id AS k, n_chars + (doc_id % 5 = 0)::INT AS s, sha256(CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE text END) AS h FROM documents WHERE doc_id % 3 <> 0) r USING (k)""")
def reconcile_assets(spark, sf_dir):
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents")
    source = d.select(i.cast("string").alias("path"), F.col("n_chars").alias("size"), F.sha2("text", 256).alias("digest"))
    copy = d.where("doc_id % 3 <> 0").select(i.cast("string").alias("path"), (F.col("n_chars") + (i % 5 == 0).cast("int")).alias("size"), F.sha2(F.when(i % 7 == 0, "x").otherwise(F.col("text")), 256).alias("digest"))
    return records.reconcile(source, copy).select("path", "status")


@query("SELECT a.doc_id::VARCHAR AS name, a.lang AS expected, CASE WHEN a.doc_id % 4 <> 0 THEN CASE WHEN a.doc_id % 6 = 1 THEN 'xx' ELSE a.lang END END AS observed, CASE WHEN a.doc_id % 4 = 0 THEN 'missing' ELSE 'changed' END AS kind FROM documents a WHERE a.doc_id % 4 = 0 OR a.doc_id % 6 = 1")
def config_drift(spark, sf_dir):
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents")
    return records.drift(d.where("doc_id % 4 <> 0").select(i.cast("string").alias("name"), F.when(i % 6 == 1, "xx").otherwise(F.col("lang")).alias("value")), d.select(i.cast("string").alias("name"), F.col("lang").alias("value")))


# ---- shards and orders ----


@query("SELECT doc_id, (row_number() OVER (ORDER BY source, doc_id) - 1) // 100 AS shard, (row_number() OVER (ORDER BY source, doc_id) - 1) % 100 AS place FROM documents")
def shard_assign(spark, sf_dir):
    return records.count_shards(table(spark, sf_dir, "documents").select("doc_id", "source"), [F.col("source"), F.col("doc_id")], 100).select("doc_id", "shard", "place")


@query("SELECT doc_id, CAST(coalesce(sum(n_chars) OVER (ORDER BY source, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 100000 AS BIGINT) AS shard FROM documents")
def size_shards(spark, sf_dir):
    return records.size_shards(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), [F.col("source"), F.col("doc_id")], "n_chars", 100_000).select("doc_id", "shard")


@query(f"SELECT doc_id, floor({_U.format(seed='slot:0', id='doc_id')} * 16)::INT AS slot FROM documents")
def topology_slots(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", records.owned_by(F.col("doc_id"), 16).alias("slot"))


@query("SELECT doc_id, row_number() OVER (ORDER BY sha256('1:2:' || doc_id)) AS place FROM documents")
def epoch_order(spark, sf_dir):
    x = records.epoch_order(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 1, 2)
    return compare.ranked(x, [F.col("order_key")], "place").select("doc_id", "place")


@query("WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('1:0:' || doc_id)) - 1 AS n FROM documents) SELECT n // 32 AS batch, array_to_string(list(doc_id ORDER BY n), ',') AS ids FROM o GROUP BY 1 HAVING count(*) = 32")
def training_batches(spark, sf_dir):
    x = records.epoch_order(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id")), "sample_id", 1, 0)
    return records.batches(x, [F.col("order_key")], 32, drop_last=True).select("batch", F.array_join(F.col("sample_ids").cast("array<string>"), ",").alias("ids"))


@query("SELECT item_id, kind, level, v::INT AS variant, ('0x' || substr(sha256('8:' || item_id || ':' || kind || ':' || level || ':' || v), 1, 8))::UBIGINT::BIGINT AS seed FROM benchmark, (VALUES ('blur'), ('skew')) k(kind), (VALUES ('low'), ('high')) l(level), unnest(range(2)) u(v)")
def experiment_rows(spark, sf_dir):
    return records.experiment_rows(table(spark, sf_dir, "benchmark"), "item_id", ["blur", "skew"], ["low", "high"], 2, 8)


@query("SELECT doc_id, true AS has_more FROM documents ORDER BY doc_id LIMIT 20")
def catalog_preview(spark, sf_dir):
    return records.preview(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 20)


# ---- streams ----


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS events, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def windowed_counts(spark, sf_dir):
    from corpuslens.streaming.state import windowed_counts as run

    x = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    x = run(x, "1 hour")
    return rounded(x.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "events", "total"), "total")


@query()
def quota_admission(spark, sf_dir):
    from corpuslens.streaming import state

    x = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return state.batch(x, "user_id", state.quota_fold(3, 21_600)).select("event_id", "admitted")


@query()
def circuit_states(spark, sf_dir):
    from corpuslens.streaming import state

    x = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("failed"))
    return state.batch(x, "user_id", state.breaker_fold(2, 86_400, 3_600)).select("event_id", "circuit")
