"""Ordered decisions over record columns: trust gates, routes, dataset tiers, review flags, selection among candidates."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpuslens.functions import textquality
from corpuslens.operators.records import first_reason

#: Evidence limits of the digital-text gate, and minima of the agreement gates.
SMALL_IMAGE, COVERAGE, ISOLATED = 0.02, 0.002, 0.60
AGREEMENT = {"character_agreement": 0.98, "word_agreement": 0.95, "teacher_confidence": 0.9, "judge_confidence": 0.9, "source_image_coverage": 0.98}
CEILINGS = {"line_disagreement": 0.05, "uncertain_span_ratio": 0.02}
COMPLETE = ["region_coverage", "main_text_coverage", "margin_coverage", "footnote_coverage"]
ABSENT = {"missing_lines": "missing_line_indicators", "duplicate_text": "duplicate_text_indicators", "reading_order_disagreement": "reading_order_disagreement"}


#: Page states whose decision stands, the accepted ones first.
DECIDED_PAGES = ["accepted_first_pass", "accepted_after_selective_reread", "review_required", "pending_ocr_model", "ocr_failed"]


def _no(c: Column) -> Column:
    return ~F.coalesce(c, F.lit(False))


def digital_text_gate(df: DataFrame) -> DataFrame:
    """Adds checks (array of name, passed) and verdict: TRUSTED, UNTRUSTED or UNCERTAIN.

    Page columns: text, characters, words, alphanumerics, coverage, distributed (text in some horizontal part), arabic,
    isolated_ratio, spacing_faults, corrupt, fragmented, hybrid, image_density, vertical_parts (with text, of four), order_risk,
    columns_risk, warnings (number).
    """
    c = F.col
    has = F.coalesce(F.length("text") > 0, F.lit(False))
    spread = F.coalesce((c("coverage") >= COVERAGE) & c("distributed"), F.lit(False))
    enough = lambda n, a: (c("characters") >= n) & (c("words") >= 6) & (c("alphanumerics") >= a)
    usable = F.coalesce(enough(40, 30) | (enough(30, 25) & spread), F.lit(False))
    isolated = (c("arabic") > 0) & (c("isolated_ratio") >= ISOLATED)
    spacing = (c("arabic") > 0) & (c("spacing_faults") > 0)
    dominant = c("hybrid") & (c("image_density") > SMALL_IMAGE)
    partial = dominant & ~(usable & (c("vertical_parts") >= 3))
    incomplete = c("hybrid") & (~usable | F.coalesce(partial, F.lit(False)))
    evidence = c("warnings") == 0
    named = [
        ("embedded_text", has), ("usable_text", usable), ("text_distribution", spread), ("fragmentation", _no(c("fragmented"))), ("arabic_isolation", _no(isolated)), ("arabic_spacing", _no(spacing)),
        ("unicode_integrity", _no(c("corrupt") > 0)), ("image_dominance", _no(partial)), ("hybrid_completeness", _no(incomplete)), ("reading_order", _no(c("order_risk"))), ("layout_complexity", _no(c("columns_risk"))), ("required_evidence", F.coalesce(evidence, F.lit(False))),
    ]
    x = df.withColumn("checks", F.array(*[F.struct(F.lit(n).alias("name"), p.alias("passed")) for n, p in named]))
    failed = lambda *names: F.exists("checks", lambda k: k["name"].isin(*names) & ~k["passed"])
    bad = failed("fragmentation", "arabic_isolation", "arabic_spacing", "unicode_integrity", "image_dominance", "hybrid_completeness") | (failed("embedded_text") & ~failed("required_evidence"))
    verdict = F.when(bad, "UNTRUSTED").when(F.forall("checks", lambda k: k["passed"]), "TRUSTED").otherwise("UNCERTAIN")
    return x.withColumn("verdict", verdict)


def page_route(df: DataFrame, ocr_available: bool) -> DataFrame:
    """Of gated pages with blank and near_blank: decision, next_path and review_required."""
    blank = F.coalesce(F.col("blank"), F.lit(False)) | F.coalesce(F.col("near_blank"), F.lit(False))
    decision = F.when(blank, "BLANK_OR_NEAR_BLANK").when(F.col("verdict") == "TRUSTED", "TRUSTED_DIGITAL_TEXT").when(F.col("verdict") == "UNTRUSTED", "OCR_REQUIRED").otherwise("REVIEW_REQUIRED")
    path = {"BLANK_OR_NEAR_BLANK": "NO_EXTRACTION", "TRUSTED_DIGITAL_TEXT": "DIRECT_PDF_TEXT", "OCR_REQUIRED": "LOCAL_OCR" if ocr_available else "PENDING_OCR_MODEL", "REVIEW_REQUIRED": "MANUAL_REVIEW"}
    x = df.withColumn("decision", decision).withColumn("next_path", F.element_at(F.create_map(*[F.lit(v) for kv in path.items() for v in kv]), F.col("decision")))
    review = F.when(F.col("decision") == "BLANK_OR_NEAR_BLANK", F.coalesce("near_blank", F.lit(False))).when(F.col("decision") == "OCR_REQUIRED", F.lit(not ocr_available)).otherwise(F.col("decision") == "REVIEW_REQUIRED")
    return x.withColumn("review_required", review)


def dataset_tier(df: DataFrame) -> DataFrame:
    """HOLDOUT, REJECTED, GOLD, REVIEW or SILVER, and the reasons."""
    c = lambda n: F.col(n)
    rejected = F.array_compact(F.array(F.when(_no(c("rights_verified")), F.lit("rights_not_verified")), F.when(_no(c("input_usable")), F.lit("input_unusable")), F.when(c("hallucination_indicators") > 0, F.lit("hallucination_detected")), F.when(_no(c("provenance_complete")), F.lit("provenance_incomplete"))))
    gates = [(f"{n}_low", c(n) < v) for n, v in AGREEMENT.items()] + [(f"{n}_high", c(n) > v) for n, v in CEILINGS.items()] + [(f"{n}_incomplete", c(n) < 1.0) for n in COMPLETE] + [(n, c(col) > 0) for n, col in ABSENT.items()]
    open_ = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(True)), F.lit(name)) for name, test in gates]))
    gold = F.when(c("human_verified"), "human_verified").when(c("trusted_reference"), "trusted_reference")
    tier = F.when(c("holdout"), "HOLDOUT").when(F.size(rejected) > 0, "REJECTED").when(gold.isNotNull(), "GOLD").when(F.size(open_) > 0, "REVIEW").otherwise("SILVER")
    x = df.withColumn("tier", tier)
    reasons = F.when(F.col("tier") == "HOLDOUT", F.array(F.lit("manually_designated_holdout"))).when(F.col("tier") == "REJECTED", rejected).when(F.col("tier") == "GOLD", F.array(gold)).when(F.col("tier") == "REVIEW", open_).otherwise(F.array(F.lit("silver_policy_satisfied")))
    return x.withColumn("reasons", reasons)


def quality_decision(accuracy: Column, has_truth: Column, estimated: Column, exhausted: Column, least: float = 90.0) -> Column:
    """struct(decision, reason): accepted by accuracy or estimate, else retry, else manual review."""
    good = F.when(has_truth, accuracy >= least).otherwise(estimated >= least)
    return F.when(F.coalesce(good, F.lit(False)), F.struct(F.lit("accepted").alias("decision"), F.lit(None).cast("string").alias("reason"))).when(_no(exhausted), F.struct(F.lit("retry").alias("decision"), F.lit("below_threshold").alias("reason"))).otherwise(F.struct(F.lit("manual_review").alias("decision"), F.lit("routes_exhausted").alias("reason")))


def page_state(df: DataFrame, threshold: float = 90.0) -> DataFrame:
    """Of text (NFC), page_state, score and the flag manual_review: adds accepted, manual_review and review_reason. Blank pages are neither
    accepted nor reviewed, states that are decided keep their decision, the others go by the acceptance of their text; a page without a
    score is judged by the one that its text gets."""
    state, before = F.col("page_state"), F.coalesce(F.col("manual_review"), F.lit(False))
    names = [c for c in df.columns if c != "manual_review"]
    x = textquality.with_corruption(df.withColumn("_before", before), "text", "score", F.lit(True))
    x = x.withColumn("_estimate", F.coalesce("score", F.col("corruption.quality")))
    x = x.withColumn("_a", textquality.acceptance(F.col("corruption"), F.col("_estimate"), threshold))
    review = F.when(state == "blank_page", False).when(state.isin(DECIDED_PAGES), ~state.isin(DECIDED_PAGES[:2])).otherwise(F.col("_before") | ~F.col("_a.accepted"))
    x = x.withColumn("_review", review)
    reason = F.when(F.col("_review"), F.when(state.isin(DECIDED_PAGES), state).otherwise(F.col("_a.reason")))
    return x.select(*names, (~F.col("_review") & (F.coalesce(state, F.lit("")) != "blank_page")).alias("accepted"), F.col("_review").alias("manual_review"), reason.alias("review_reason"))


def text_issues(t: Column, success: Column, reading_order: Column | None = None, confidence: Column | None = None) -> Column:
    """Names of observable defects of a recognized text. reading_order: an array of places; confidence: a validated one, else null."""
    body = textquality.stripped(t)
    lines = textquality.lines_of(F.regexp_replace(body, r"[^\S\n]+", " "))
    ordered = F.array_sort(lines)
    thrice = F.exists(F.zip_with(ordered, F.slice(ordered, 3, F.greatest(F.size(lines), F.lit(1))), lambda x, y: x == y), lambda e: F.coalesce(e, F.lit(False)))
    single = F.size(F.filter(textquality.words_of(body), lambda w: w.rlike(f"^[{textquality.ARABIC}]$")))
    live = success & (body != "")
    rules = [
        ("engine_error", _no(success)), ("empty_ocr_output", success & (body == "")), ("suspiciously_sparse_output", live & (F.regexp_count(body, F.lit(r"[\p{L}\p{N}]")) < 2)), ("unicode_corruption", live & (textquality.unicode_corruption_count(body) > 0)),
        ("duplicate_line_sequence", live & thrice), ("repeated_text_block", live & thrice), ("arabic_fragmentation", live & (single >= 4)), ("arabic_pathological_spacing", live & (single >= 4)),
    ]
    if reading_order is not None:
        rules.append(("reading_order_risk", live & (F.size(reading_order) > 0) & ((F.size(F.array_distinct(reading_order)) != F.size(reading_order)) | (F.array_sort(reading_order) != reading_order))))
    if confidence is not None:
        rules.append(("low_engine_confidence", live & (confidence < 0.5)))
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]))


def text_acceptance(pages_below: Column, reference_valid: Column, characters: Column, words: Column, least: float = 90.0) -> Column:
    """Whether a document's text passes: no page below the limit and, with a valid reference, both accuracies known and high enough."""
    enough = F.coalesce((characters >= least) & (words >= least), F.lit(False))
    return F.when(F.coalesce(pages_below, F.lit(0)) > 0, False).when(F.coalesce(reference_valid, F.lit(False)), enough).otherwise(True)


def choose(df: DataFrame, by: list[str], rules: list[tuple[str, Column]], score: Column, tie: list[str]) -> DataFrame:
    """Adds rejection (name of the first rule that holds), score, and chosen: the best that is not rejected in each group, ties by columns."""
    x = df.withColumn("rejection", first_reason(rules)).withColumn("score", score)
    w = Window.partitionBy(*by, F.col("rejection").isNull()).orderBy(F.col("score").desc(), *tie)
    return x.withColumn("chosen", F.col("rejection").isNull() & (F.row_number().over(w) == 1))


def escalation(df: DataFrame, by: list[str], target: Column, most: int = 4) -> DataFrame:
    """Candidates (score, cost) as a chain of attempts per group: cheapest that reaches the target first, then by falling score."""
    w = Window.partitionBy(*by).orderBy((F.col("score") < target).cast("int"), F.when(F.col("score") >= target, F.col("cost")), F.col("score").desc(), "name")
    x = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    return x.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "name"))), lambda r: r["name"]).alias("attempts"))


def required_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """Adds missing: names of required columns without a value."""
    empty = lambda f: F.col(f).isNull() | (F.trim(F.col(f).cast("string")) == "") if f in df.columns else F.lit(True)
    return df.withColumn("missing", F.array_compact(F.array(*[F.when(empty(f), F.lit(f)) for f in fields])))


def training_contract(df: DataFrame, said: int | None = None) -> DataFrame:
    """What breaks the contract of a training table: rule, sample_id. Rows must be of the split train, not failed or duplicate, unprotected, with unique ids."""
    row = lambda rule, name: df.where(F.coalesce(rule, F.lit(True))).select(F.lit(name).alias("rule"), "sample_id")
    out = row(F.lower(F.trim("target_split")) != "train", "split").unionByName(row(~F.col("validation_status").isin("ok", "warning"), "status")).unionByName(row(~F.col("duplicate_state").isin("unique", "canonical"), "duplicate")).unionByName(row(F.col("protected"), "protected"))
    out = out.unionByName(df.groupBy("sample_id").count().where("count > 1").select(F.lit("repeated_id").alias("rule"), "sample_id"))
    if said is not None:
        out = out.unionByName(df.agg(F.count("*").alias("n")).where(F.col("n") != said).select(F.lit("row_count").alias("rule"), F.lit(None).cast("string").alias("sample_id")))
    return out


def manifest_item_problems(items: DataFrame) -> DataFrame:
    """Items (item_id, page_id, document_id, split, code: 64-bit hash, candidate): pages or documents in several splits, close hashes across splits, candidates in holdout."""
    from corpuslens.operators.dedupe import close_codes
    from corpuslens.operators.quality import straddling

    out = None
    for key in ("page_id", "document_id"):
        x = straddling(items, key).select(F.lit(f"{key}_in_splits").alias("rule"), F.col(key).cast("string").alias("key"))
        out = x if out is None else out.unionByName(x)
    side = lambda s: items.select(F.col("item_id").alias(s), F.col("split").alias(f"s{s}"))
    close = close_codes(items.select(F.col("item_id").alias("id"), "code"), 5).join(side("a"), "a").join(side("b"), "b").where("sa <> sb")
    out = out.unionByName(close.select(F.lit("close_across_splits").alias("rule"), F.concat_ws("|", F.col("a").cast("string"), F.col("b").cast("string")).alias("key")))
    return out.unionByName(items.where("split = 'holdout' AND candidate").select(F.lit("candidate_in_holdout").alias("rule"), F.col("item_id").cast("string").alias("key")))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("op", "before", "after")])))
def _paragraph_edits(before: pd.Series, after: pd.Series) -> pd.Series:
    out = []
    for a, b in zip(before, after):
        x, y = ((s or "").split("\n") for s in (a, b))
        out.append([{"op": op, "before": "\n".join(x[i:j]), "after": "\n".join(y[k:m])} for op, i, j, k, m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes() if op != "equal"])
    return pd.Series(out)


def paragraph_edits(df: DataFrame, before: str, after: str) -> DataFrame:
    """Rows per changed run of paragraphs: op, before, after, change_type."""
    x = df.withColumn("_e", F.explode(_paragraph_edits(before, after)))
    return x.select(*df.columns, F.col("_e.op").alias("op"), F.col("_e.before").alias("old"), F.col("_e.after").alias("new")).withColumn("change_type", textquality.change_type(F.col("old"), F.col("new")))


def reread(df: DataFrame) -> DataFrame:
    """Regions (page_id, region, first, second, confidence, second_confidence): the better reading; an empty or corrupt second never wins; the page's text."""
    fine = (F.trim("second") != "") & (textquality.unicode_corruption_count(F.col("second")) == 0) & (F.col("second_confidence") > F.col("confidence"))
    x = df.withColumn("value", F.when(F.coalesce(fine, F.lit(False)), F.col("second")).otherwise(F.col("first")))
    return x.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("region", "value"))), lambda r: r["value"]), "\n").alias("text"), F.count_if(F.coalesce(fine, F.lit(False))).alias("replaced"))


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """Per table: rows and how many text values are absolute paths."""
    out = None
    for name, df in tables.items():
        texts = [f for f, kind in df.dtypes if kind == "string"]
        path = sum((F.count_if(F.col(f).rlike(r"^(?:/|[A-Za-z]:\\)")) for f in texts), F.lit(0).cast("long"))
        x = df.agg(F.count("*").alias("rows"), path.alias("absolute_paths")).withColumn("table", F.lit(name))
        out = x if out is None else out.unionByName(x)
    return out


def migrate_paths(df: DataFrame, root: str, stored: DataFrame) -> DataFrame:
    """Rows (path, size, digest) under a root as URIs with a status: outside_root, missing, size_mismatch, checksum_mismatch or verified."""
    base = root.rstrip("/") + "/"
    x = df.withColumn("uri", F.when(F.col("path").startswith(base), F.concat(F.lit("asset://"), F.substring(F.col("path"), len(base) + 1, F.length("path")))))
    x = x.join(stored.select("uri", F.col("size").alias("_s"), F.col("digest").alias("_d")), "uri", "left")
    status = F.when(F.col("uri").isNull(), "outside_root").when(F.col("_s").isNull(), "missing").when(F.col("_s") != F.col("size"), "size_mismatch").when(F.col("_d") != F.col("digest"), "checksum_mismatch").otherwise("verified")
    return x.withColumn("status", status).drop("_s", "_d")


def chat_record(image: Column, prompt: str, answer: Column) -> Column:
    """A training record of one exchange."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("user", F.concat(F.lit("<image:"), image, F.lit(f">\n{prompt}"))), turn("assistant", answer))
