import pytest

import corpus_pipeline
from corpuslens.llm import queries
from tests.llm import brute
from tests.oracle import spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, sf, name):
    assert spark_rows(queries.QUERIES[name](spark, sf)) == sql_rows(queries.SQL[name], sf)


def test_there_is_a_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_pii_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op8_pii(spark, sf).collect():
        spans = brute.pii(texts[r.doc_id])
        assert r.base_sha256 == brute.sha(",".join("%s:%d:%d" % s for s in spans))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone"))


def test_sharding_query(spark, sf):
    rows = queries.op9_sharding(spark, sf).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts) and all((r.size, r.text_crc32) == (len(texts[r.doc_id].encode()) + 16, brute.crc(texts[r.doc_id].encode())) for r in rows)
    assert {r.law for r in rows} == {"rows"} and {r.shard for r in rows} == set(range(40))


def test_toxicity_query_on_held_out_rows(spark, sf):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op6_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in rows) >= 0.8 * len(rows)


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == corpus_pipeline.COLUMNS
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0.6 * seen[0]
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = [(r.doc_id, r.text) for r in docs.collect()]
    assert not any(x[5] for x in brute.contamination(kept, bench))
    want = brute.near_duplicates(kept, 5, 80)
    assert sum(d == root for d, (_, root) in want.items()) >= 0.99 * len(kept)
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert sorted(r.doc_id for r in ids) == sorted(d for d, _ in kept) and all(r.n_tokens == len(r.ids) for r in ids)


def test_pipeline_on_rows_without_anything(spark, sf):
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
        assert docs.count() in (0, 2)
