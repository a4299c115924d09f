"""The quality gate: findings per sample, leakage between partitions, exclusion policy, verdict, clean and quarantined rows, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.functions import identity

#: Limits of the validation, and edges of the histograms.
LIMITS = {"min_side": 32, "max_side": 20_000, "max_pixels": 178_956_970, "max_aspect": 20.0, "min_text": 1, "short_text": 3}
RESOLUTION_EDGES = [500, 1000, 2000, 4000]
LENGTH_EDGES = [0, 50, 200, 1000, 10_000]
SEVERITIES = ["info", "warning", "error", "critical"]
LEAK_CODES = {
    "malformed_protection": "MALFORMED_PROTECTION", "exact_hash_cross_split": "LEAK_EXACT", "page_identity_cross_split": "LEAK_PAGE", "near_image_cross_split": "LEAK_NEAR_IMAGE",
    "near_text_cross_split": "LEAK_NEAR_TEXT", "derived_page_cross_boundary": "LEAK_DERIVED", "gt_text_cross_split": "LEAK_TEXT", "group_straddle": "LEAK_GROUP",
}


# ---- validation ----


def finding(when: Column, code: str, severity: str, message: str) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(message).alias("message")))


def dimension_findings(width: Column, height: Column, limits: dict = LIMITS) -> list[Column]:
    aspect = F.greatest(width, height) / F.greatest(F.least(width, height), F.lit(1))
    return [
        finding(F.least(width, height) < limits["min_side"], "image_too_small", "warning", "a side is very short"),
        finding(F.greatest(width, height) > limits["max_side"], "image_too_large", "error", "a side is very long"),
        finding(width.cast("long") * height.cast("long") > limits["max_pixels"], "too_many_pixels", "error", "the image has too many pixels"),
        finding(aspect > limits["max_aspect"], "extreme_aspect", "warning", "the sides differ extremely"),
    ]


def hash_finding(stored: Column, actual: Column) -> list[Column]:
    valid = stored.rlike("^[0-9a-f]{64}$")
    return [finding(stored.isNull(), "hash_missing", "info", "no stored digest"), finding(stored.isNotNull() & ~valid, "hash_malformed", "critical", "the stored digest is no SHA-256"), finding(valid & (stored != actual), "hash_mismatch", "error", "the stored digest differs from the content's")]


def text_findings(text: Column, limits: dict = LIMITS) -> list[Column]:
    n = F.length(F.trim(F.coalesce(text, F.lit(""))))
    return [
        finding(text.isNull(), "text_missing", "error", "no text"), finding(text.isNotNull() & (n < limits["min_text"]), "text_empty", "error", "the text is blank"),
        finding((n >= limits["min_text"]) & (n < limits["short_text"]), "text_short", "warning", "the text is very short"), finding(text.contains("�"), "text_replacement", "warning", "the text has replacement characters"),
    ]


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)


def validate(df: DataFrame, findings: list[Column]) -> DataFrame:
    """Adds validation_findings, validation_status (error, warning or ok: the worst), exclusion_reason (of the first error) and quality_flags."""
    x = df.withColumn("validation_findings", F.array_compact(F.array(*findings)))
    worst = F.array_max(F.transform("validation_findings", lambda f: severity_rank(f["severity"])))
    x = x.withColumn("validation_status", F.when(worst >= 3, "error").when(worst == 2, "warning").otherwise("ok"))
    x = x.withColumn("exclusion_reason", F.get(F.filter("validation_findings", lambda f: f["severity"].isin("error", "critical")), F.lit(0))["code"])
    return x.withColumn("quality_flags", F.array_sort(F.array_distinct(F.transform("validation_findings", lambda f: f["code"]))))


def issue_codes(df: DataFrame, id_: str = "sample_id") -> DataFrame:
    """Issues (id, code) as sorted distinct codes of each id."""
    return df.groupBy(id_).agg(F.array_sort(F.collect_set("code")).alias("codes"))


def manifest_violations(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Rules of a source manifest: unique ids, pages of known documents, page numbers from 1, texts: rule, key."""
    repeated = lambda df, c, rule: df.groupBy(c).count().where("count > 1").select(F.lit(rule).alias("rule"), F.col(c).cast("string").alias("key"))
    orphan = pages.join(documents.select("document_id"), "document_id", "left_anti").select(F.lit("unknown_document").alias("rule"), F.col("page_id").cast("string").alias("key"))
    number = pages.where("page_number < 1 OR page_number IS NULL").select(F.lit("bad_page_number").alias("rule"), F.col("page_id").cast("string").alias("key"))
    return repeated(documents, "document_id", "repeated_document").unionByName(repeated(pages, "page_id", "repeated_page")).unionByName(orphan).unionByName(number)


def foreign_key_violations(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows per key value that no parent row has."""
    return child.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti").groupBy(key).agg(F.count("*").alias("rows"))


def primary_key_violations(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1")


def overlap(left: Column, right: Column) -> Column:
    """Intersection over union of two boxes (array of left, top, right, bottom)."""
    at = lambda b, i: F.get(b, F.lit(i)).cast("double")
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(at(left, hi), at(right, hi)) - F.greatest(at(left, lo), at(right, lo)))
    area = lambda b: (at(b, 2) - at(b, 0)) * (at(b, 3) - at(b, 1))
    both = side(0, 2) * side(1, 3)
    return F.when(area(left) + area(right) - both > 0, both / (area(left) + area(right) - both)).otherwise(0.0)


def region_problems(regions: Column, width: Column, height: Column) -> Column:
    """Names of what is wrong with regions (array of struct id, bbox)."""
    outside = F.exists(regions, lambda r: (F.get(r["bbox"], F.lit(0)) < 0) | (F.get(r["bbox"], F.lit(1)) < 0) | (F.get(r["bbox"], F.lit(2)) > width) | (F.get(r["bbox"], F.lit(3)) > height))
    flat = F.exists(regions, lambda r: (F.get(r["bbox"], F.lit(2)) <= F.get(r["bbox"], F.lit(0))) | (F.get(r["bbox"], F.lit(3)) <= F.get(r["bbox"], F.lit(1))))
    ids = F.transform(regions, lambda r: r["id"])
    return F.array_compact(F.array(F.when(outside, F.lit("outside")), F.when(flat, F.lit("empty")), F.when(F.size(F.array_distinct(ids)) < F.size(ids), F.lit("repeated_id"))))


def select_regions(regions: Column, kinds: list[str], least: int) -> Column:
    return F.filter(regions, lambda r: r["kind"].isin(kinds) & (r["priority"] >= least))


def reading_order(regions: Column) -> Column:
    """Regions (struct reading_order, bbox, id) by order, top, left, id."""
    key = lambda r: F.struct(r["reading_order"], F.get(r["bbox"], F.lit(1)), F.get(r["bbox"], F.lit(0)), r["id"])
    return F.array_sort(regions, lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0))


# ---- leakage ----


def leaks_by(df: DataFrame, key: Column, kind: str, warn: bool = True, critical: Column | None = None) -> DataFrame:
    """Groups of a key that are in TRAIN and in EVAL or PROTECTED (critical), or else in several known partitions (warning, if warn).

    critical: an aggregate that decides between critical and warning for the crossing groups. df: sample_id, partition.
    """
    keyed = df.withColumn("_key", key).where("_key IS NOT NULL")
    x = keyed.groupBy("_key").agg(F.array_sort(F.collect_set("partition")).alias("partitions"), *([critical.alias("_critical")] if critical is not None else []))
    crosses = F.array_contains("partitions", "TRAIN") & F.arrays_overlap("partitions", F.array(F.lit("EVAL"), F.lit("PROTECTED")))
    severity = F.when(crosses, F.when(F.col("_critical"), "critical").otherwise("warning") if critical is not None else F.lit("critical"))
    if warn:
        severity = severity.when(F.size(F.array_remove("partitions", "UNPARTITIONED")) > 1, "warning")
    x = x.withColumn("severity", severity).where("severity IS NOT NULL")
    # ids are gathered of the groups that are findings only, whose id is a digest of them in order
    ids = keyed.join(x.select("_key"), "_key", "left_semi").groupBy("_key").agg(F.array_sort(F.collect_list("sample_id")).alias("sample_ids"))
    x = x.join(ids, "_key")
    return x.select(identity.finding_id(F.lit(kind), F.col("_key"), F.col("sample_ids")).alias("finding_id"), F.lit(kind).alias("kind"), "severity", F.col("_key").alias("canonical_key"), "partitions", "sample_ids")


def leaks_of_pairs(df: DataFrame, pairs: DataFrame, kind: str) -> DataFrame:
    """Pairs (a, b of sample_id) across the boundary of training; pairs with an unknown side are left out."""
    side = lambda s: df.select(F.col("sample_id").alias(s), F.col("partition").alias(f"p{s}"))
    x = pairs.join(side("a"), "a").join(side("b"), "b")
    other = lambda c: F.col(c).isin("EVAL", "PROTECTED")
    x = x.where(((F.col("pa") == "TRAIN") & other("pb")) | ((F.col("pb") == "TRAIN") & other("pa")))
    key, ids = F.concat(F.lit(f"{kind.split('_cross')[0]}:"), "a", F.lit("|"), "b"), F.array_sort(F.array("a", "b"))
    return x.select(identity.finding_id(F.lit(kind), key, ids).alias("finding_id"), F.lit(kind).alias("kind"), F.lit("critical").alias("severity"), key.alias("canonical_key"), F.array_sort(F.array_distinct(F.array("pa", "pb"))).alias("partitions"), ids.alias("sample_ids"))


def detect_leakage(df: DataFrame, near_images: DataFrame | None = None, near_texts: DataFrame | None = None) -> DataFrame:
    """All findings of samples with partition, malformed, file_sha256, document_id, page_id, normalized_text_sha256, transformations and group_key."""
    one = df.select("sample_id", "partition", F.explode(F.array_compact(F.array(
        F.when(F.col("malformed"), F.col("sample_id")), F.when(F.col("file_sha256").isNotNull() & ~F.col("file_sha256").rlike("^[0-9a-f]{64}$"), F.concat(F.lit("file_sha256:"), "sample_id")),
    ))).alias("_key"))
    ids = F.array("sample_id")
    out = one.select(identity.finding_id(F.lit("malformed_protection"), F.col("_key"), ids).alias("finding_id"), F.lit("malformed_protection").alias("kind"), F.lit("critical").alias("severity"), F.col("_key").alias("canonical_key"), F.array("partition").alias("partitions"), ids.alias("sample_ids"))
    out = out.unionByName(leaks_by(df, F.when(F.col("file_sha256").rlike("^[0-9a-f]{64}$"), F.col("file_sha256")), "exact_hash_cross_split"))
    page = F.when((F.col("document_id") != "") & (F.col("page_id") != ""), F.concat_ws("|", "source_id", "document_id", "page_id"))
    out = out.unionByName(leaks_by(df, page, "page_identity_cross_split"))
    text = df.withColumn("_derived", F.size(F.coalesce("transformations", F.array().cast("array<string>"))) > 0)
    found = leaks_by(text, F.col("normalized_text_sha256"), "derived_page_cross_boundary", warn=False, critical=F.bool_or("_derived"))
    kind = F.when(F.col("severity") == "critical", F.col("kind")).otherwise("gt_text_cross_split")
    found = found.withColumn("kind", kind).withColumn("finding_id", identity.finding_id(F.col("kind"), F.col("canonical_key"), F.col("sample_ids")))
    out = out.unionByName(found).unionByName(leaks_by(df, F.col("group_key"), "group_straddle", warn=False))
    for pairs, name in ((near_images, "near_image_cross_split"), (near_texts, "near_text_cross_split")):
        if pairs is not None:
            out = out.unionByName(leaks_of_pairs(df, pairs, name))
    return out


def issues_of(findings: DataFrame) -> DataFrame:
    """Findings as issues: code, severity, sample_ids, canonical_key."""
    return findings.select(F.element_at(F.create_map(*[F.lit(x) for kv in LEAK_CODES.items() for x in kv]), F.col("kind")).alias("code"), "severity", "sample_ids", "canonical_key")


def straddling(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys with more than one split."""
    return df.groupBy(key).agg(F.count_distinct(split).alias("splits"), F.count("*").alias("rows")).where("splits > 1")


# ---- licences ----


def licence_decisions(df: DataFrame, catalog: DataFrame, purpose: str) -> DataFrame:
    """Rows with dataset_id against a catalog (dataset_id, status, allows: array of purposes): decision and reason. Unknown data sets are denied."""
    x = df.join(catalog.select("dataset_id", "status", "allows"), "dataset_id", "left")
    reason = (
        F.when(F.col("status").isNull(), "unknown data set").when(F.col("status") == "forbidden", "licence forbids use").when(F.col("status") == "unverified", "licence is not verified")
        .when(~F.array_contains("allows", purpose), "purpose is not allowed")
    )
    return x.withColumn("reason", reason).withColumn("allowed", F.col("reason").isNull())


# ---- policy ----


def keep_of_cluster(members: DataFrame) -> DataFrame:
    """Of rows (cluster_id, sample_id, protected, canonical, valid, transformations: number): the one to keep of each cluster."""
    order = F.struct((~F.col("protected")).cast("int"), (~(F.col("canonical") & F.col("valid"))).cast("int"), F.col("transformations"), F.col("sample_id"))
    return members.groupBy("cluster_id").agg(F.min_by("sample_id", order).alias("keep_id"))


def exclusions(samples: DataFrame, clusters: DataFrame, issues: DataFrame, leaks: DataFrame) -> DataFrame:
    """One decision per sample: sample_id, decision, reason, reason_source. The first of: protected rows are quarantined; failed rows go with
    their first code; members of a cluster that are not kept go; the training side of a critical leak goes.

    samples: sample_id, protected, validation_status, partition, canonical, transformations (number); clusters: cluster_id, sample_id.
    """
    row = lambda df, prio, decision, reason, source: df.select("sample_id", F.lit(prio).alias("prio"), F.lit(decision).alias("decision"), reason.alias("reason"), F.lit(source).alias("reason_source"))
    first = issues.groupBy("sample_id").agg(F.min("code").alias("code"))
    bad = samples.where("validation_status = 'error'").join(first, "sample_id")
    own = clusters.join(samples.select("sample_id", "protected", "canonical", (F.col("validation_status") != "error").alias("valid"), "transformations"), "sample_id")
    extra = own.join(keep_of_cluster(own), "cluster_id").where("sample_id <> keep_id")
    leaked = leaks.where("severity = 'critical'").select(F.explode("sample_ids").alias("sample_id"), "kind").groupBy("sample_id").agg(F.min("kind").alias("kind"))
    leaked = leaked.join(samples.where("partition = 'TRAIN'").select("sample_id"), "sample_id")
    every = row(samples.where("protected"), 0, "quarantine", F.lit("protected"), "split").unionByName(row(bad, 1, "exclude", F.col("code"), "artifact"))
    every = every.unionByName(row(extra, 2, "exclude", F.concat(F.lit("duplicate_of:"), "keep_id"), "cluster")).unionByName(row(leaked, 3, "exclude", F.col("kind"), "leakage"))
    w = Window.partitionBy("sample_id").orderBy("prio", "reason")
    return every.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("sample_id", "decision", "reason", "reason_source")


def exclusion_report(decisions: DataFrame) -> DataFrame:
    """Counts by source and decision, and over all."""
    return decisions.groupingSets([[F.col("reason_source"), F.col("decision")], []], F.col("reason_source"), F.col("decision")).agg(F.count("*").alias("samples")).select(F.coalesce("reason_source", F.lit("all")).alias("reason_source"), F.coalesce("decision", F.lit("all")).alias("decision"), "samples")


def verdict(issues: DataFrame) -> DataFrame:
    """FAIL with an error or critical issue, WARN with any other, else PASS; and the numbers."""
    bad = F.count_if(F.col("severity").isin("error", "critical"))
    return issues.agg(bad.alias("failures"), F.count("*").alias("issues")).select(F.when(F.col("failures") > 0, "FAIL").when(F.col("issues") > 0, "WARN").otherwise("PASS").alias("verdict"), "failures", "issues")


def clean_rows(samples: DataFrame, decisions: DataFrame) -> DataFrame:
    """Samples without a decision. Quarantined rows are decisions too, so no protected row is left."""
    return samples.join(decisions.select("sample_id"), "sample_id", "left_anti")


def quarantine_rows(samples: DataFrame, decisions: DataFrame) -> DataFrame:
    return samples.join(decisions.where("decision = 'quarantine'").select("sample_id"), "sample_id", "left_semi")


def revalidate(clean: DataFrame, decisions: DataFrame) -> DataFrame:
    """What a clean table must not hold: rule, sample_id."""
    rule = lambda df, name: df.select(F.lit(name).alias("rule"), "sample_id")
    return rule(clean.where("protected"), "protected").unionByName(rule(clean.join(decisions.select("sample_id"), "sample_id", "left_semi"), "excluded")).unionByName(rule(clean.groupBy("sample_id").count().where("count > 1"), "repeated"))


def redact_protected(df: DataFrame, protected: Column, columns: list[str]) -> DataFrame:
    """Nulls in the columns of protected rows."""
    for c in columns:
        df = df.withColumn(c, F.when(~F.coalesce(protected, F.lit(True)), F.col(c)))
    return df


# ---- health ----


def resolution_bucket(side: Column) -> Column:
    out, low = None, 0
    for edge in RESOLUTION_EDGES:
        label = f"{low}-{edge}" if low else f"<{edge}"
        out = F.when(side < edge, label) if out is None else out.when(side < edge, label)
        low = edge
    return F.when(side.isNull(), "unknown").otherwise(out.otherwise(f">={low}"))


def length_bucket(n: Column) -> Column:
    """Closed above: 0, 1-50, 51-200, 201-1000, 1001-10000, >10000."""
    out, low = None, None
    for edge in LENGTH_EDGES:
        label = "0" if low is None else f"{low + 1}-{edge}"
        out = F.when(n <= edge, label) if out is None else out.when(n <= edge, label)
        low = edge
    return F.when(n.isNull(), "unknown").otherwise(out.otherwise(f">{low}"))


def histograms(df: DataFrame, dimensions: dict[str, Column], arrays: dict[str, Column] | None = None) -> DataFrame:
    """dimension, key, count of several columns in one pass; elements of array columns count each."""
    pairs = [F.array(F.struct(F.lit(name).alias("dimension"), F.coalesce(c.cast("string"), F.lit("unknown")).alias("key"))) for name, c in dimensions.items()]

    def each(name: str, c: Column) -> Column:
        return F.transform(c, lambda k: F.struct(F.lit(name).alias("dimension"), k.alias("key")))

    pairs += [each(name, c) for name, c in (arrays or {}).items()]
    x = df.select(F.explode(F.concat(*pairs)).alias("p"))
    return x.groupBy("p.dimension", "p.key").agg(F.count("*").alias("count"))


def cross_table(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(a).cast("string"), F.lit("unknown")).alias(a), F.coalesce(F.col(b).cast("string"), F.lit("unknown")).alias(b)).agg(F.count("*").alias("count"))


def entropy(df: DataFrame, column: str) -> DataFrame:
    """Shannon entropy in bits of a column's values."""
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("all"))
    p = F.col("n") / F.col("all")
    return n.join(F.broadcast(total)).agg((-F.sum(p * F.log2(p))).alias("bits"))
