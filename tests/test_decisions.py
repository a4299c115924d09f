import pytest
from pyspark.sql import functions as F

from corpuslens.operators import decisions, records
from corpuslens.plans import pipelines, views


def test_digital_text_gate_and_route(spark):
    names = "i long, text string, characters long, words long, alphanumerics long, coverage double, distributed boolean, arabic long, isolated_ratio double, spacing_faults long, corrupt long, fragmented boolean, hybrid boolean, image_density double, vertical_parts long, order_risk boolean, columns_risk boolean, warnings long, blank boolean, near_blank boolean"
    good = ("t", 100, 20, 80, 0.1, True, 0, None, 0, 0, False, False, None, 4, False, False, 0, False, False)
    rows = [(0, *good), (1, *good[:9], 3, *good[10:]), (2, *good[:14], True, *good[15:]), (3, "", 0, 0, 0, 0.0, False, *good[6:]), (4, *good[:11], True, 0.5, 1, *good[14:]), (5, *good[:17], True, False)]
    got = decisions.page_route(decisions.digital_text_gate(spark.createDataFrame(rows, names)), ocr_available=False).orderBy("i").collect()
    assert [r.verdict for r in got] == ["TRUSTED", "UNTRUSTED", "UNCERTAIN", "UNTRUSTED", "UNTRUSTED", "TRUSTED"]
    assert [(r.next_path, r.review_required) for r in got] == [("DIRECT_PDF_TEXT", False), ("PENDING_OCR_MODEL", True), ("MANUAL_REVIEW", True), ("PENDING_OCR_MODEL", True), ("PENDING_OCR_MODEL", True), ("NO_EXTRACTION", False)]


def test_dataset_tiers(spark):
    base = dict(holdout=False, rights_verified=True, input_usable=True, hallucination_indicators=0, provenance_complete=True, human_verified=False, trusted_reference=False, **{n: 1.0 for n in decisions.AGREEMENT}, **{n: 0.0 for n in decisions.CEILINGS}, **{n: 1.0 for n in decisions.COMPLETE}, missing_line_indicators=0, duplicate_text_indicators=0, reading_order_disagreement=0)
    rows = [base, base | {"holdout": True}, base | {"rights_verified": False}, base | {"human_verified": True}, base | {"margin_coverage": 0.5}]
    got = decisions.dataset_tier(spark.createDataFrame([{"i": i} | r for i, r in enumerate(rows)])).orderBy("i").collect()
    assert [r.tier for r in got] == ["SILVER", "HOLDOUT", "REJECTED", "GOLD", "REVIEW"] and got[4].reasons == ["margin_coverage_incomplete"]


def test_issues_and_states(spark):
    df = spark.createDataFrame([(0, "a\na\na\nlonger text", True), (1, " ", True), (2, None, False), (3, "fine text", True)], "i long, t string, ok boolean")
    got = df.select("i", decisions.text_issues(F.col("t"), F.col("ok")).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == [["duplicate_line_sequence", "repeated_text_block"], ["empty_ocr_output"], ["engine_error"], []]
    order = df.select("i", decisions.text_issues(F.lit("و ا ب ت fine"), F.lit(True), F.array(F.lit(2), F.lit(1)), F.lit(0.4)).alias("x")).first()
    assert order.x == ["arabic_fragmentation", "arabic_pathological_spacing", "reading_order_risk", "low_engine_confidence"]
    good = "readable words in a text that is long enough " * 8
    pages = [(0, "", "blank_page", None, True), (1, "x", "review_required", 99.0, False), (2, "", "accepted_first_pass", 1.0, True), (3, good, None, 95.0, False), (4, good, None, None, False), (5, "", None, 95.0, False), (6, good, None, 95.0, True)]
    got = decisions.page_state(spark.createDataFrame(pages, "i long, text string, page_state string, score double, manual_review boolean")).orderBy("i").collect()
    assert [(r.accepted, r.manual_review) for r in got] == [(False, False), (False, True), (True, False), (True, False), (True, False), (False, True), (False, True)]
    assert got[1].review_reason == "review_required" and got[5].review_reason == "critical_text_corruption: empty_output_from_non_empty_page"
    passes = spark.createDataFrame([(0, 1, True, 99.0, 99.0), (1, 0, True, 95.0, None), (2, 0, True, 95.0, 91.0), (3, None, False, 1.0, 1.0)], "i long, p long, v boolean, c double, w double")
    assert [r.x for r in passes.select("i", decisions.text_acceptance(F.col("p"), F.col("v"), F.col("c"), F.col("w")).alias("x")).orderBy("i").collect()] == [False, False, True, True]


def test_choose_and_escalate(spark):
    df = spark.createDataFrame([("g", "a", 5.0, 1.0, True), ("g", "b", 9.0, 3.0, False), ("g", "c", 7.0, 2.0, True)], "g string, name string, score double, cost double, open boolean")
    got = {r.name: (r.rejection, r.chosen) for r in decisions.choose(df, ["g"], [("closed", ~F.col("open"))], F.col("score"), ["name"]).collect()}
    assert got == {"a": (None, False), "b": ("closed", False), "c": (None, True)}
    assert decisions.escalation(df, ["g"], F.lit(6.0)).first().attempts == ["c", "b", "a"]


def test_paragraph_edits_and_reread(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", "a\nB\nc\nd")], "i long, x string, y string")
    assert sorted((r.op, r.old, r.new) for r in decisions.paragraph_edits(df, "x", "y").collect()) == [("insert", "", "d"), ("replace", "b", "B")]
    regions = spark.createDataFrame([(1, 0, "a", "A", 0.1, 0.9), (1, 1, "b", "", 0.1, 0.9)], "page_id long, region long, first string, second string, confidence double, second_confidence double")
    assert tuple(decisions.reread(regions).first()) == (1, "A\nb", 1)


def test_manifest_items(spark):
    df = spark.createDataFrame([(1, "p1", "d1", "train", 0, True), (2, "p1", "d2", "test", 1 << 40, False), (3, "p3", "d3", "holdout", 7, True)], "item_id long, page_id string, document_id string, split string, code long, candidate boolean")
    assert {(r.rule, r.key) for r in decisions.manifest_item_problems(df).collect()} == {("page_id_in_splits", "p1"), ("close_across_splits", "1|2"), ("close_across_splits", "1|3"), ("close_across_splits", "2|3"), ("candidate_in_holdout", "3")}


def test_paths_and_inventory(spark):
    df = spark.createDataFrame([("/r/a", 1, "x"), ("/q/b", 1, "x"), ("/r/c", 1, "x")], "path string, size long, digest string")
    stored = spark.createDataFrame([("asset://a", 1, "x")], "uri string, size long, digest string")
    assert {r.path: r.status for r in decisions.migrate_paths(df, "/r", stored).collect()} == {"/r/a": "verified", "/q/b": "outside_root", "/r/c": "missing"}
    assert tuple(decisions.inventory({"t": df}).select("table", "rows", "absolute_paths").first()) == ("t", 3, 3)


def test_contract(spark):
    df = spark.createDataFrame([("a", "train", "ok", "unique", False), ("b", "test", "ok", "unique", False), ("a", "train", "error", "unique", True)], "sample_id string, target_split string, validation_status string, duplicate_state string, protected boolean")
    assert sorted((r.rule, r.sample_id) for r in decisions.training_contract(df, 3).collect()) == [("protected", "a"), ("repeated_id", "a"), ("split", "b"), ("status", "a")]


def test_pipelines_compose(spark, sf):
    samples = views.samples(spark, sf)
    prepared = pipelines.prepare(samples, 13)
    assert prepared.count() == samples.count()
    reports = pipelines.prepare_reports(prepared)
    assert reports["leaks"].where("key = 'group_key' AND NOT passed").count() == 0
    result = pipelines.gate(prepared)
    clean, quarantine, n = result["clean"].count(), result["quarantine"].count(), prepared.count()
    assert clean + result["decisions"].count() == n and quarantine > 0 and result["verdict"].first().verdict in ("FAIL", "WARN", "PASS")
    catalog = samples.select(F.col("source_id").alias("dataset_id")).distinct().withColumn("status", F.lit("verified")).withColumn("allows", F.array(F.lit("training")))
    export = pipelines.training_export(samples, catalog, "training", 1, per_source=3, balance=F.col("language"))
    assert export.groupBy("source_id").count().agg(F.max("count")).first()[0] <= 3
    analysis = pipelines.analyse_run(views.analysed(spark, sf), views.analysed(spark, sf, 1), size=10)
    assert analysis["next"].count() == 10 and analysis["changes"].count() == samples.count()
    assert pipelines.evaluate_run(views.measured(spark, sf), ["model_id"])["summary"].count() >= 3


@pytest.mark.parametrize("policy", ["reject", "skip_identical", "overwrite", "version_new"])
def test_upsert_keeps_new_keys(spark, policy):
    store, new = spark.createDataFrame([("a", "x", 1)], "k string, content string, version int"), spark.createDataFrame([("b", "y")], "k string, content string")
    assert {r.k for r in records.upsert(store, new, "k", policy).collect()} == {"a", "b"}
