"""How readable a text is: corruption counters, flags and scores, acceptance, layout, scripts, sensitive content.

Everything is native. Rules are tables (patterns, limits, capped penalties) over counters, so that a text is scanned once
for each counter. Texts are expected in NFC, up to text.unicode_form(); white space and digits are Unicode's. A null text
is an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: character classes and patterns ----
ARABIC = r"\u0600-\u06FF"
BLANK = r"\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
BLANKS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
LINE_END = r"\r\n|[\n\x0B\x0C\r\x1C-\x1E\x85\u2028\u2029]"
STOPS = ".,;:!?؟،؛"
COUNTED = {
    "replacement": r"\uFFFD",
    "private_use": r"[\uE000-\uF8FF]",
    "control": r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]",
    "combining": r"[\u064B-\u065F\u0670\u06D6-\u06ED]",
    "symbols": rf"[^\p{{L}}\p{{N}}_{BLANK}{ARABIC}.,;:!?؟،؛ـ()\[\]{{}}\"'«»/@+\-=%]",
    "detached_marks": r"(?<![\u0621-\u064A])[\u064B-\u065F]",
    "arabic": rf"[{ARABIC}]",
    "tah_zah": "[طظ]",
    "tah_zah_runs": rf"[طظ][^{BLANK}]{{1,3}}",
    "stop_runs": rf"[{STOPS}]{{3,}}",
    "repeats": r"([^\n]{1,8})\1{4,}",
}
NOISE_WORD = rf"[{ARABIC}][A-Za-z0-9_@#$%^&*+=<>\\|~]+[{ARABIC}]"
FOREIGN_IN_WORD = rf"[^{ARABIC}0-9.,:;!?؟،؛()\[\]{{}}«»\"'\-/]"
#: Limits of the flags, in the order in which flags are listed.
SYMBOL_SHARE, COMBINING_SHARE, DETACHED, DUPLICATE_SHARE = 0.12, 0.22, 5, 0.35
GARBLED = {"letters": 20, "share": 0.34, "runs": 5}
#: Scores: 100 less penalties; each is a weight times a counter, at most the cap.
PENALTIES = {
    "unicode_integrity": [("replacement", 18.0, 55.0), ("private_use", 14.0, 55.0), ("control", 8.0, 30.0), ("combining_share", 120.0, 35.0)],
    "arabic_integrity": [("noise_words", 18.0, 45.0), ("malformed_words", 8.0, 35.0), ("garbled_weight", 1.0, 35.0), ("isolated_share", 80.0, 25.0)],
    "structure": [("duplicate_share", 100.0, 45.0), ("stop_runs", 10.0, 30.0), ("repeats", 12.0, 30.0)],
}
READABILITY = {"unicode_integrity": 0.35, "arabic_integrity": 0.45, "structure": 0.20}
QUALITY = {"readability": 0.45, "unicode_integrity": 0.20, "arabic_integrity": 0.20, "structure": 0.10, "coverage": 0.05}
ACCEPT = {"quality": 90.0, "readability": 88.0, "coverage": 20.0}
COMPONENTS = {"text_quality": 0.70, "completeness": 0.15, "direction_quality": 0.10, "layout_quality": 0.05}
SENSITIVE = [
    r"(?U)\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b",
    r"(?i)https?://[^\s]+|www\.[^\s]+",
    r"(?U)(?:\+?\d[\s-]?){8,15}",
    r"(?U)\b\d{1,4}[/.-]\d{1,2}[/.-]\d{1,4}\b",
    r"(?iU)\b(?:EGP|USD|EUR|جنيه|دولار|ريال)\s*\d+(?:[.,]\d+)?\b",
    r"(?U)\b\d{8,18}\b",
    r"(?U)\b[A-Z]{2,}[-_/]?\d{2,}\b",
]
FIGURE, CAPTION = r"(?iU)\b(?:figure|شكل|img|image)\b", r"(?iU)\b(?:جدول|table|caption)\b"
SECRET_NAME = r"(?i)(?:api[_-]?key|(?:^|[_-])key(?:$|[_-])|token|secret|password|passwd|cookie|authorization|credential|service[_-]?account|session|redis_url)"
LONGEST_DOCUMENT = 5_000_000
FORBIDDEN = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\u202A-\u202E\u2066-\u2069]"


def stripped(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{BLANK}]+"), lambda w: w != "")


def lines_of(text: Column) -> Column:
    """The lines that are not blank, trimmed."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), LINE_END), stripped), lambda x: x != "")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _some(n: Column) -> Column:
    return F.greatest(n, F.lit(1))


def percent(x: Column) -> Column:
    return F.bround(F.least(F.lit(100.0), F.greatest(F.lit(0.0), x)), 2)


def duplicate_line_ratio(text: Column) -> Column:
    """1 - distinct / total of the lines that are not blank, white space inside them as one blank; 0 for fewer than three."""
    lines = F.transform(lines_of(text), lambda x: F.regexp_replace(x, f"[{BLANK}]+", " "))
    n = F.size(lines)
    return F.when(n < 3, 0.0).otherwise((n - F.size(F.array_distinct(lines))) / n)


def unicode_corruption_count(text: Column) -> Column:
    """Replacement characters, private use, control and format characters other than line feed and tab."""
    return _count(F.coalesce(text, F.lit("")), r"[\uFFFD\uE000-\uF8FF\p{Cc}\p{Cf}&&[^\n\t]]")


def isolated_arabic_ratio(text: Column, letters: str = ARABIC) -> Column:
    """Share of the words with Arabic that have one Arabic letter; null without such words."""
    found = F.filter(words_of(F.coalesce(text, F.lit(""))), lambda w: w.rlike(f"[{letters}]"))
    return F.when(F.size(found) > 0, F.size(F.filter(found, lambda w: _count(w, f"[{letters}]") == 1)) / F.size(found))


def with_corruption(df: DataFrame, text: str = "text", estimate: str | None = None, expected: Column | None = None, out: str = "corruption") -> DataFrame:
    """df with column <out>: struct(flags, counters, scores, samples, route, accepted).

    text: a column in NFC. estimate: a column with a quality in per cent, null if unknown, that bounds the scores. expected: whether
    the page must have text. Counters are a column of their own, so each is computed once.
    """
    t, expected = "_t", F.lit(False) if expected is None else expected
    names = df.columns
    x = df.withColumn(t, stripped(F.regexp_replace(F.col(text), r"\r\n?", "\n"))).withColumn("_words", words_of(F.col(t))).withColumn("_arabic", F.filter("_words", lambda w: w.rlike(f"[{ARABIC}]")))
    noise = F.filter("_arabic", lambda w: w.rlike(NOISE_WORD))
    malformed = F.filter("_arabic", lambda w: _count(w, FOREIGN_IN_WORD) > _some(F.floor(F.length(w) / 3)))
    x = x.withColumn("_noise", noise).withColumn("_bad", malformed)
    alone = F.size(F.filter("_arabic", lambda w: F.length(w) == 1))
    counters = [_count(F.col(t), p).alias(n) for n, p in COUNTED.items()]
    x = x.withColumn("_c", F.struct(
        *counters, F.length(t).alias("length"), F.length(F.regexp_replace(t, f"[{BLANK}]+", "")).alias("visible"), F.size("_noise").alias("noise_words"), F.size("_bad").alias("malformed_words"),
        (alone / _some(F.size("_arabic"))).alias("isolated_share"), duplicate_line_ratio(F.col(t)).alias("duplicate_share"), expected.alias("expected"), (F.col(estimate) if estimate else F.lit(None)).cast("double").alias("estimate"),
    ))
    c = F.col("_c")
    share = c["tah_zah"] / _some(c["arabic"])
    x = x.withColumn("_m", F.struct(
        (c["symbols"] / _some(c["visible"])).alias("symbol_share"), (c["combining"] / _some(c["visible"])).alias("combining_share"), share.alias("garbled_share"),
        ((c["arabic"] >= GARBLED["letters"]) & (share >= GARBLED["share"]) & (c["tah_zah_runs"] >= GARBLED["runs"])).alias("garbled"),
    ))
    m = F.col("_m")
    value = lambda n: m[n] if n == "combining_share" else F.when(m["garbled"], 80.0).otherwise(15.0) * m["garbled_share"] if n == "garbled_weight" else c[n]
    lost = lambda rules: sum((F.least(F.lit(cap), weight * value(n)) for n, weight, cap in rules), F.lit(0.0))
    x = x.withColumn("_s", F.struct(*[(100.0 - lost(rules)).alias(n) for n, rules in PENALTIES.items()]))
    s = F.col("_s")
    nothing = c["expected"] & (c["length"] == 0)
    readable = sum(s[n] * w for n, w in READABILITY.items())
    readable = F.when(c["estimate"].isNull(), readable).otherwise(F.least(readable, F.greatest(F.lit(0.0), c["estimate"]) + 8.0))
    covered = F.when(nothing, 0.0).otherwise(F.least(F.lit(100.0), 35.0 + F.least(F.lit(65.0), c["length"] / 4.0)))
    x = x.withColumn("_r", F.struct(readable.alias("readability"), covered.alias("coverage"), *[s[n].alias(n) for n in PENALTIES]))
    r = F.col("_r")
    quality = sum(r[n] * w for n, w in QUALITY.items())
    quality = F.when(c["estimate"].isNull(), quality).otherwise(F.least(c["estimate"], quality))
    rules = [
        ("empty_output_from_non_empty_page", nothing), ("replacement_characters", c["replacement"] > 0), ("private_use_glyphs", c["private_use"] > 0), ("control_characters", c["control"] > 0), ("noise_inside_arabic_words", c["noise_words"] > 0),
        ("mojibake_like_arabic", m["garbled"]), ("symbol_dominated_text", m["symbol_share"] > SYMBOL_SHARE), ("abnormal_combining_marks", (m["combining_share"] > COMBINING_SHARE) | (c["detached_marks"] > DETACHED)),
        ("repeated_garbage", c["repeats"] > 0), ("large_duplicate_sections", c["duplicate_share"] >= DUPLICATE_SHARE),
    ]
    x = x.withColumn("_flags", F.array_compact(F.array(*[F.when(rule, F.lit(n)) for n, rule in rules]))).withColumn("_q", quality)
    good = (F.size("_flags") == 0) & (F.col("_q") >= ACCEPT["quality"]) & (r["readability"] >= ACCEPT["readability"]) & (r["coverage"] >= ACCEPT["coverage"])
    garbled_words = F.when(m["garbled"], F.slice(F.filter("_words", lambda w: w.rlike("[طظ]")), 1, 3)).otherwise(F.array().cast("array<string>"))
    samples = F.slice(F.concat(F.slice("_noise", 1, 3), F.slice("_bad", 1, 3), garbled_words), 1, 8)
    risk = F.when((c["repeats"] > 0) | (m["symbol_share"] > 0.08), 65.0).when(c["length"] > 0, 20.0).otherwise(0.0)
    report = F.struct(
        F.col("_flags").alias("flags"), percent(F.col("_q")).alias("quality"), *[percent(r[n]).alias(n) for n in ("readability", *PENALTIES, "coverage")], percent(c["duplicate_share"] * 100).alias("duplication_risk"),
        percent(100.0 - r["coverage"]).alias("missing_text_risk"), risk.alias("hallucination_risk"), samples.alias("samples"), F.when(good, "accept").when(c["length"] > 0, "ocr_or_cloud").otherwise("manual_review").alias("route"), good.alias("accepted"),
    )
    return x.select(*names, report.alias(out))


def acceptance(corruption: Column, estimate: Column, threshold: float = 90.0) -> Column:
    """struct(accepted, reason) of a page by with_corruption()'s column and its estimate; the threshold is 90 at least."""
    least = max(90.0, threshold)
    found = F.size(corruption["flags"]) > 0
    good = estimate.isNotNull() & (corruption["quality"] >= least) & corruption["accepted"]
    reason = F.when(good, None).when(estimate.isNull(), "indeterminate_quality_score").when(found, F.concat(F.lit("critical_text_corruption: "), F.array_join(corruption["flags"], ", "))).otherwise(f"estimated_text_quality below {least:.2f}%")
    return F.struct(F.coalesce(good, F.lit(False)).alias("accepted"), reason.alias("reason"))


def quality_components(text: Column, expected_pages: Column, converted_pages: Column, base: Column | None = None) -> Column:
    """struct of estimated scores in per cent: text, completeness, direction, layout and their weighted sum. base: a known text score, or null."""
    t = stripped(text)
    visible = F.length(F.regexp_replace(t, f"[{BLANK}]+", ""))
    useful = _count(t, rf"[\p{{L}}\p{{N}}{ARABIC}]") / _some(visible)
    guess = 70.0 * useful + 30.0 * F.least(F.lit(1.0), F.length(t) / F.greatest(F.lit(40.0), converted_pages * 250.0)) - F.least(F.lit(25.0), 5.0 * _count(t, COUNTED["replacement"]))
    within = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))
    score = within(guess if base is None else F.coalesce(base, guess))
    some = t != ""
    paragraphs = F.size(F.filter(F.split(t, rf"\n[{BLANK}]*\n"), lambda p: stripped(p) != ""))
    part = {
        "text_quality": score, "completeness": within(100.0 * converted_pages / _some(expected_pages)), "direction_quality": F.when(t.rlike(f"[A-Za-z{ARABIC}]"), 95.0).when(some, 60.0).otherwise(0.0),
        "layout_quality": F.when(some, F.least(F.lit(100.0), 55.0 + F.least(F.lit(30.0), 5.0 * paragraphs) + F.when(t.contains("\n"), 15.0).otherwise(0.0))).otherwise(0.0),
    }
    return F.struct(*[F.bround(v, 2).alias(n) for n, v in part.items()], F.bround(within(sum(part[n] * w for n, w in COMPONENTS.items())), 2).alias("final_quality"))


def script_ratios(text: Column) -> Column:
    """struct(arabic, latin): shares of the Arabic and basic Latin letters of a text."""
    t = F.coalesce(text, F.lit(""))
    both = _some(_count(t, f"[A-Za-z{ARABIC}]"))
    return F.struct((_count(t, f"[{ARABIC}]") / both).alias("arabic"), (_count(t, "[A-Za-z]") / both).alias("latin"))


def layout_profile(text: Column) -> Column:
    """struct of counts of a page's lines by what they look like."""
    lines = lines_of(text)
    n, some = F.size(lines), lambda rule: F.size(F.filter(lines, rule))
    capitals = lambda x: x.rlike(r"\p{Lu}") & ~x.rlike(r"\p{Ll}")
    titles = some(lambda x: (F.length(x) < 90) & (x.endswith(":") | capitals(x)))
    tables, notes = some(lambda x: x.contains("|")), some(lambda x: (F.length(x) < 35) & ~x.rlike("[.!؟]$"))
    return F.struct(
        titles.alias("titles"), F.greatest(F.lit(0), n - titles - tables - notes).alias("paragraphs"), tables.alias("tables"), some(lambda x: x.rlike(FIGURE)).alias("figures"), some(lambda x: x.rlike(CAPTION)).alias("captions"),
        F.when((n > 0) & (F.length(F.get(lines, F.lit(0))) < 80), 1).otherwise(0).alias("headers"), F.when((n > 1) & (F.length(F.get(lines, n - 1)) < 80), 1).otherwise(0).alias("footers"), notes.alias("side_notes"),
    )


def is_sensitive(text: Column) -> Column:
    """Whether a replacement holds what must not be learned: digits only, an address, number, date, amount or code, or up to three words that may be a name."""
    t = stripped(text)
    found = t.rlike(r"^\p{Nd}+$")
    for pattern in SENSITIVE:
        found = found | t.rlike(pattern)
    words = words_of(t)
    name = F.size(words).between(1, 3) & F.forall(words, lambda w: w.rlike(r"^[^\p{L}]") | w.rlike(r"^\p{Lu}"))
    return (t != "") & (found | name)


def change_type(before: Column, after: Column) -> Column:
    """The kind of a replacement; an empty side is an insertion or a deletion."""
    a, b = F.coalesce(before, F.lit("")), F.coalesce(after, F.lit(""))
    bare = lambda c, p: F.regexp_replace(c, p, "")
    blanks = lambda c: F.length(c) - F.length(bare(c, " "))
    marks = rf"[^\p{{L}}\p{{N}}_{BLANK}]"
    return (
        F.when(a == "", "insertion").when(b == "", "deletion").when(bare(a, " ") == bare(b, " "), F.when(blanks(a) != blanks(b), "word_split_merge").otherwise("spacing"))
        .when(bare(a, marks) == bare(b, marks), "punctuation").when(F.concat(a, b).rlike(f"[{ARABIC}]"), "arabic_character").otherwise("replacement")
    )


def document_text(value: Column, most: int = LONGEST_DOCUMENT) -> Column:
    """A text (in NFC) without characters that XML forbids and marks that override its direction. A longer one than most is an error, never cut."""
    t = F.coalesce(value, F.lit(""))
    return F.when(F.length(t) > most, F.raise_error(F.lit("a document's text exceeds the limit of characters"))).otherwise(F.regexp_replace(t, FORBIDDEN, ""))


def secrets_of(settings: dict[str, str]) -> list[str]:
    """The values of settings whose names speak of secrets, of four characters or more, on the driver."""
    import re

    return [v for k, v in settings.items() if isinstance(v, str) and len(v) >= 4 and re.search(SECRET_NAME, k)]


def redact(text: Column, settings: dict[str, str]) -> Column:
    """A text without the secret values of settings (a bounded map), literally."""
    for secret in secrets_of(settings):
        text = F.replace(text, F.lit(secret), F.lit("<redacted>"))
    return text


def redact_map(values: Column, settings: dict[str, str]) -> Column:
    """A map of strings: values of secret names hidden, the others as by redact()."""
    return F.transform_values(values, lambda k, v: F.when(k.rlike(SECRET_NAME), F.lit("[REDACTED]")).otherwise(redact(v, settings)))
