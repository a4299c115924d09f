"""The queries of this subpackage, each over the whole of its tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuslens.llm.licenses import license_scan

    x = license_scan(_table(spark, sf_dir, "documents"))
    return x.withColumn("base_labels", F.array_join("base_labels", ",")).withColumn("labels", F.array_join("labels", ","))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuslens.llm.media import feature, read_media, store_media

    x = feature(read_media(store_media(_table(spark, sf_dir, "documents"))))
    return x.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from corpuslens.llm.bpe import encode_documents

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    x = encode_documents(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, stored=True, decoded="decoded")
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return x.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuslens.llm.decontam import decontaminate

    x = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return x.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op5_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuslens.llm.chat import rotate

    x = rotate(_table(spark, sf_dir, "conversations")).withColumn("segment_sha256", F.sha2("segment", 256))
    return x.select("conv_id", "perspective", "seq", "turn", "speaker", "chat_role", "segment_sha256", "start", "end", "learn_start", "learn_end")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuslens.llm.toxicity import held_out, score_documents, train_on

    docs = _table(spark, sf_dir, "documents")
    x = score_documents(docs.select("doc_id", "text"), train_on(docs, _table(spark, sf_dir, "labels")))
    return x.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuslens.llm.neardup import Link, near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), Link(k=3, per_cent=85))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuslens.llm.pii import KINDS, find_pii, span_list

    base, every = [f"s_{k.name}" for k in KINDS if k.base], [f"s_{k.name}" for k in KINDS]
    counts = [F.size(c).cast("long").alias(f"n_{c[2:]}") for c in base]
    score = F.coalesce(F.array_max(F.transform(F.concat(*every), lambda s: s["score"])), F.lit(0.0))
    return find_pii(_table(spark, sf_dir, "documents")).select("doc_id", *counts, F.sha2(span_list(base), 256).alias("base_sha256"), span_list(every).alias("spans"), score.alias("max_score"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuslens.llm.sharding import shuffle

    text = F.coalesce("text", F.lit(""))
    light = _table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    x = shuffle(light, shards=40)
    return x.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuslens.llm.html_extract import extract_pages

    return extract_pages(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_media_columns, op3_bpe, op4_decontaminate, op5_chat_rotation, op6_toxicity, op7_minhash_near_dedup, op8_pii, op9_sharding, op10_html_extraction)}


# ---- the same in DuckDB ----

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _license_sql() -> str:
    from corpuslens.llm import licenses as L

    rows = [(label, words, L.PHRASE_K, True, 1.0) for label, words in L.PHRASES] + [(label, words, L.NOTICE_K, False, share) for label, words, share in L.NOTICES]
    values = ", ".join(f"({i}, '{label}', '{words}', {k}, {exact}, {share})" for i, (label, words, k, exact, share) in enumerate(rows))
    return f"""
WITH t AS (SELECT tid, label, string_split(words, ' ') AS tw, k, exact, share FROM (VALUES {values}) v(tid, label, words, k, exact, share)),
g AS (SELECT tid, k, i AS tpos, array_to_string(tw[i + 1:i + k], ' ') AS gram FROM t, unnest(range(len(tw) - k + 1)) u(i)),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT rid, k, i AS pos, array_to_string(w[i + 1:i + k], ' ') AS gram FROM d, (VALUES ({L.PHRASE_K}), ({L.NOTICE_K})) ks(k), unnest(range(len(w) - k + 1)) u(i) WHERE len(w) >= k),
h AS (SELECT DISTINCT rid, tid, tpos, pos - tpos AS diag FROM p JOIN g USING (k, gram)),
n AS (SELECT *, CASE WHEN diag - lag(diag) OVER (PARTITION BY rid, tid ORDER BY diag) > CASE WHEN tid < {len(L.PHRASES)} THEN -1 ELSE greatest({L.SLACK}, len(tw) // {L.SLACK_SHARE}) END THEN 1 ELSE 0 END AS new
      FROM (SELECT rid, tid, diag, list(tpos) AS tset FROM h GROUP BY ALL) JOIN t USING (tid)),
c AS (SELECT *, sum(new) OVER (PARTITION BY rid, tid ORDER BY diag) AS cluster FROM n),
s AS (SELECT rid, tid, cluster, len(list_distinct(flatten(list(tset)))) AS votes, min(diag + list_min(tset)) AS first, max(diag + list_max(tset)) AS last FROM c GROUP BY ALL),
v AS (SELECT rid, label, exact, first, CAST(votes AS DOUBLE) / (len(tw) - k + 1) AS coverage FROM s JOIN t USING (tid)
      WHERE CAST(votes AS DOUBLE) / (len(tw) - k + 1) >= share AND last + k - first <= {L.STRETCH} * len(tw))
SELECT doc_id, CAST(any_value(len(w)) AS BIGINT) AS n_words, count(CASE WHEN exact THEN 1 END) AS n_base, CAST(min(CASE WHEN exact THEN first END) AS BIGINT) AS first_word,
  CAST(max(CASE WHEN exact THEN first END) AS BIGINT) AS last_word, coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE exact)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE label IS NOT NULL)), ','), '') AS labels, coalesce(max(coverage), 0.0) AS score
FROM d LEFT JOIN v USING (rid) GROUP BY rid, doc_id
"""


_LEAK_SQL = f"""
WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
wins AS (SELECT DISTINCT item, array_to_string(w[i + 1:i + 10], ' ') AS win, len(w[i + 1:i + 10]) AS n FROM b, unnest(range(greatest(len(w) - 10, 0) + 1)) u(i) WHERE len(w) > 0),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
places AS (SELECT rid, i, n, array_to_string(w[i + 1:i + n], ' ') AS win FROM d, (SELECT DISTINCT n FROM wins) k, unnest(range(len(w) - n + 1)) u(i) WHERE len(w) >= n),
hits AS (SELECT rid, i, p.n, item FROM places p JOIN wins USING (win)),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM hits)) GROUP BY rid),
items AS (SELECT rid, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid)
"""

_NEAR_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 3], ' ') AS g FROM d, unnest(range(greatest(len(w) - 3, 0) + 1)) u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN both_ways ON r = a)
SELECT reach.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id, reach.doc_id = min(r) AS kept FROM reach LEFT JOIN n USING (doc_id) GROUP BY reach.doc_id
"""


def _chat_sql() -> str:
    from corpuslens.llm.chat import SQL

    return SQL


SQL: dict[str, str] = {"op1_license_scan": _license_sql(), "op4_decontaminate": _LEAK_SQL, "op5_chat_rotation": _chat_sql(), "op7_minhash_near_dedup": _NEAR_SQL}
