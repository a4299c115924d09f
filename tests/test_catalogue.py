import unicodedata

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import text
from corpuslens.plans import catalogue, exchange, more  # noqa: F401  (they add to the catalogue)
from corpuslens.plans.views import recognized, samples
from tests.oracle import spark_rows, sql_rows
from tests.test_functions import distance, plain_corruption


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_its_sql(spark, sf, name):
    assert spark_rows(catalogue.QUERIES[name](spark, sf)) == sql_rows(catalogue.SQL[name], sf)


#: Each query without SQL, with its plain version below.
PLAIN = {"near_text_pairs", "normalized_hash_groups", "corruption_score", "alignment_errors", "top_substitutions", "word_error_totals", "turn_wer", "quota_admission", "circuit_states", "edit_counts", "paragraph_edits"}


def test_every_query_without_sql_has_a_plain_version():
    assert set(catalogue.QUERIES) - set(catalogue.SQL) == PLAIN


def turns(spark, sf):
    """The reference and the prediction of each page."""
    return {r.page_id: (r.reference, r.prediction) for r in recognized(spark, sf).select("page_id", "reference", "prediction").collect()}


def test_alignment_queries_against_plain_distances(spark, sf):
    pages = turns(spark, sf)
    counts = {r.page_id: (r.substitutions, r.insertions, r.deletions) for r in catalogue.QUERIES["edit_counts"](spark, sf).collect()}
    assert set(counts) == set(pages)
    for page, (a, b) in pages.items():
        s, i, d = counts[page]
        assert s + i + d == distance(a, b) and i - d == len(b) - len(a)
    total = {}
    for r in catalogue.QUERIES["alignment_errors"](spark, sf).collect():
        total[r.op] = total.get(r.op, 0) + r["count"]
    sums = [sum(c[k] for c in counts.values()) for k in range(3)]
    assert [total.get(op, 0) for op in ("substitution", "insertion", "deletion")] == sums
    for r in catalogue.QUERIES["turn_wer"](spark, sf).collect():
        a, b = (x.split() for x in pages[r.page_id])
        assert r.wer == pytest.approx(distance(a, b) / len(a) if a else float(bool(b)), abs=1e-6)
    words = {}
    for r in catalogue.QUERIES["word_error_totals"](spark, sf).collect():
        words[r.op] = words.get(r.op, 0) + r["count"]
    assert sum(words.values()) == sum(distance(a.split(), b.split()) for a, b in pages.values())
    top = catalogue.QUERIES["top_substitutions"](spark, sf).collect()
    assert [r["count"] for r in top] == sorted((r["count"] for r in top), reverse=True) and top[0].ref == "e" and top[0].hyp == "a" and sum(r["count"] for r in top) <= sums[0]


def test_corruption_query_against_a_plain_version(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = catalogue.QUERIES["corruption_score"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        flags, q, *_ = plain_corruption(unicodedata.normalize("NFC", texts[r.doc_id] or ""), float(50 + r.doc_id % 60))
        assert r.flags == ",".join(flags) and r.quality == pytest.approx(max(0, min(100, q)), abs=0.006), r.doc_id


def test_normalized_groups_and_near_pairs_against_plain_sets(spark, sf):
    values = {r.sample_id: (r.doc_id, r.v) for r in samples(spark, sf).select("sample_id", "doc_id", text.normalize(text.DEDUPE)("text")["value"].alias("v")).collect()}
    groups = {}
    for d, v in values.values():
        groups.setdefault(v, []).append(d)
    got = {(r.copies, r.first_id) for r in catalogue.QUERIES["normalized_hash_groups"](spark, sf).collect()}
    assert got == {(len(g), min(g)) for g in groups.values() if len(g) > 1}
    grams = {s: {v[i : i + 4] for i in range(len(v) - 3)} for s, (_, v) in values.items() if len(v) >= 40}
    first = {}
    for s in sorted(grams):
        first.setdefault(frozenset(grams[s]), s)
    reps, found = sorted(first.values()), catalogue.QUERIES["near_text_pairs"](spark, sf).collect()
    near = {(a, b) for i, a in enumerate(reps) for b in reps[i + 1 :] if len(grams[a] & grams[b]) >= 0.85 * len(grams[a] | grams[b])}
    assert {(r.a, r.b) for r in found if r.level == "near"} == near
    assert {(r.a, r.b) for r in found if r.level == "copy"} == {(first[frozenset(g)], s) for s, g in grams.items() if first[frozenset(g)] != s}
    assert all(r.jaccard == pytest.approx(len(grams[r.a] & grams[r.b]) / len(grams[r.a] | grams[r.b]), abs=1e-6) for r in found)


def test_folds_of_events_against_plain_loops(spark, sf):
    by_user = {}
    for r in spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").cast("double").alias("t"), "event_type").collect():
        by_user.setdefault(r.user_id, []).append((r.t, r.event_id, r.event_type))
    quota, circuit = {}, {}
    for events in by_user.values():
        taken, state, fails, since, until = [], "CLOSED", 0, 0.0, 0.0
        for t, i, kind in sorted(events):
            quota[i] = sum(x > t - 21_600 for x in taken) < 3
            taken += [t] if quota[i] else []
            bad = kind == "error"
            if state == "OPEN" and t >= until:
                state, fails = ("OPEN" if bad else "CLOSED"), (fails if bad else 0)
                until = t + 3600 if bad else until
            elif state == "CLOSED":
                if not bad:
                    fails = 0
                elif fails and t - since <= 86_400:
                    fails += 1
                else:
                    fails, since = 1, t
                if fails >= 2:
                    state, until = "OPEN", t + 3600
            circuit[i] = state
    assert {r.event_id: r.admitted for r in catalogue.QUERIES["quota_admission"](spark, sf).collect()} == quota
    assert {r.event_id: r.circuit for r in catalogue.QUERIES["circuit_states"](spark, sf).collect()} == circuit


def test_folds_carry_their_state_over_batches(spark, monkeypatch):
    from corpuslens.streaming import state

    rows = [(i, None if i % 3 == 0 else i % 2, 1_700_000_000 + 60 * i) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, t long").select("event_id", "user_id", F.timestamp_seconds("t").alias("ts"))
    want = {r.event_id: r.admitted for r in state.batch(df, "user_id", state.quota_fold(3, 1800)).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert {r.event_id: r.admitted for r in state.batch(df, "user_id", state.quota_fold(3, 1800)).collect()} == want and len(want) == 60 and set(want.values()) == {True, False}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_paragraph_edits_against_a_plain_comparison(spark, sf):
    changed = {(r.conv_id, r.turn) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect() if r.text and "the" in r.text}
    rows = catalogue.QUERIES["paragraph_edits"](spark, sf).collect()
    assert {(r.conv_id, r.turn) for r in rows} == changed and {r.op for r in rows} <= {"replace"}


def test_contamination_by_short_items(spark, tmp_path):
    texts = ["one two three four", "two", "x two  three y", "", "twos", None, "a\nb", "three four five six"]
    items = ["", "two", "o three", "two three", "two three four", "none", "no no", "two  three", None, "a\nb", "four", " two", "ten of these words"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.item_id: r.documents for r in catalogue.benchmark_contamination(spark, str(tmp_path)).collect()}
    assert got == {i: sum(item is not None and t is not None and item in t for t in texts) for i, item in enumerate(items)} and got[0] == 7 and got[1] == 4
