import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuslens.functions import edit, protection, text, textquality


def column(spark, values, name="t"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, {name} string")


def values(df, expr):
    return [r.v for r in df.select("i", expr.alias("v")).orderBy("i").collect()]


def test_normalize_reports_its_steps(spark):
    df = column(spark, ["كِتاب", "كتــاب", "a\r\nb", "أحمد", None, "﻿x"])
    out = df.select("i", text.normalize(text.DEDUPE)("t").alias("r")).orderBy("i").collect()
    assert [r.r["value"] for r in out] == ["كتاب", "كتاب", "a\nb", "احمد", None, "x"]
    assert "remove_arabic_diacritics" in out[0].r["applied"] and "remove_tatweel" in out[1].r["applied"]
    assert out[4].r["applied"] == []


def test_policy_is_checked():
    with pytest.raises(ValueError):
        text.Policy(unicode_form="NFKC")
    with pytest.raises(TypeError):
        text.Policy(strip_bom=1)
    assert text.Policy().fingerprint() == text.Policy().fingerprint() != text.DEDUPE.fingerprint()


def test_comparison_folding(spark):
    df = column(spark, ["كِتاب", "إلى", "a  b \n c ", "٣"])
    assert values(df, text.fold_for_comparison(F.col("t"), digits=True)) == ["كتاب", "الي", "a b\nc", "3"]


def test_scalars(spark):
    df = column(spark, ["=1+1", " plain", "key secret-value x", "a/../b", "./a//b", None, ""])
    assert values(df, text.spreadsheet_cell(F.col("t")))[:2] == ["'=1+1", " plain"]
    assert values(df, textquality.redact(F.col("t"), {"API_KEY": "secret-value", "name": "plain", "token": "key"}))[1:3] == [" plain", "key <redacted> x"]
    assert values(df, text.relative_path(F.col("t")))[3:] == [None, "a/b", None, None]
    hidden = df.select(textquality.redact_map(F.create_map(F.lit("db_password"), F.lit("x"), F.lit("note"), F.lit("has secret-value")), {"API_KEY": "secret-value"}).alias("m")).first().m
    assert hidden == {"db_password": "[REDACTED]", "note": "has <redacted>"}


def test_sensitive_texts(spark):
    rows = ["12345", "a@b.co", "see www.x.org now please", "call +20 100 200 3000 now ok", "on 12/05/2024 it was so", "paid USD 30.5 for the thing", "code AB-12 is in the text", "Ahmed Ali", "one small word", "كلمة واحدة", "", None, "two words here now"]
    assert values(column(spark, rows), textquality.is_sensitive(F.col("t"))) == [True] * 8 + [False] * 5


def test_change_types(spark):
    pairs = [("", "x"), ("x", ""), ("in to", "into"), ("a b", "a b"), ("a  b c", "a b  c"), ("a, b", "a b"), ("كتاب", "كتب"), ("cat", "dog")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i long, a string, b string")
    assert values(df, textquality.change_type(F.col("a"), F.col("b"))) == ["insertion", "deletion", "word_split_merge", "spacing", "spacing", "punctuation", "arabic_character", "replacement"]


def test_document_texts_are_never_cut(spark):
    df = column(spark, ["a\x00b\x9f‮c\n", None, "x" * 1_200_000])
    assert list(map(len, values(df, textquality.document_text(F.col("t"))))) == [4, 0, 1_200_000]
    with pytest.raises(Exception, match="limit"):
        values(df, textquality.document_text(F.col("t"), 1_000_000))


def test_first_difference(spark):
    df = spark.createDataFrame([(0, "abc", "abd"), (1, "abc", "abc"), (2, "", "x"), (3, "ab", "abc")], "i long, a string, b string")
    assert values(df, text.first_difference(F.col("a"), F.col("b"))) == [2, None, 0, 2]


NOISY = [
    ("plain words that read well and go on for long enough to be covered " * 5, 95.0), ("", None), ("bad �� text � here", 80.0), ("pua \ue000 glyph", None), ("ctrl \x01 here", 90.0), ("كل1مة و كت@اب", 70.0), ("طاظا طبظ طسظ ططظظ ظطظ طظطظ ظظطط طظ", None),
    ("### $$$ ^^^ ~~~ ||| a", None), ("ً ٌ ٍ َ ُ ِ ّ x", 99.0), ("abab" * 30, None), ("same line\n same  line\nsame line \nother", 92.0), ("نص عربي سليم يمكن قراءته بسهولة " * 12, 97.0), ("و ا ب ت كلمة", 91.0), ("a...,,,;;; b!!!", None), (None, 50.0),
]


def plain_corruption(t, estimate):
    """The report of one text from loops over its characters and words, apart from the operator."""
    t = (t or "").replace("\r\n", "\n").replace("\r", "\n").strip()
    ar = lambda c: "\u0600" <= c <= "\u06ff"
    visible = max(1, sum(not c.isspace() for c in t))
    words = t.split()
    arabic = [w for w in words if any(map(ar, w))]
    n = {"rep": t.count("\ufffd"), "pua": sum("\ue000" <= c <= "\uf8ff" for c in t), "ctl": sum(ord(c) < 9 or 10 < ord(c) < 13 or 13 < ord(c) < 32 or 126 < ord(c) < 160 for c in t)}
    combining = sum("\u064b" <= c <= "\u065f" or c == "\u0670" or "\u06d6" <= c <= "\u06ed" for c in t) / visible
    detached = sum("\u064b" <= c <= "\u065f" and not (i and "\u0621" <= t[i - 1] <= "\u064a") for i, c in enumerate(t))
    symbols = sum(not (c.isalnum() or c.isspace() or ar(c) or c in "_.,;:!?()[]{}\"'«»/@+-=%") for c in t) / visible
    noise = [w for w in arabic if any(ar(w[i]) and any(ar(c) for c in w[i + 2 :]) and re.match(r"[A-Za-z0-9_@#$%^&*+=<>\\|~]+[\u0600-\u06FF]", w[i + 1 :]) for i in range(len(w)))]
    bad = [w for w in arabic if sum(not (ar(c) or c in "0123456789.,:;!?()[]{}«»\"'-/") for c in w) > max(1, len(w) // 3)]
    alone = sum(len(w) == 1 for w in arabic) / max(1, len(arabic))
    letters = [c for c in t if ar(c)]
    tz = sum(c in "طظ" for c in letters) / max(1, len(letters))
    garbled = len(letters) >= 20 and tz >= 0.34 and len(re.findall(r"[طظ]\S{1,3}", t)) >= 5
    lines = [" ".join(x.split()) for x in t.split("\n") if x.strip()]
    dup = 1 - len(set(lines)) / len(lines) if len(lines) >= 3 else 0.0
    stops, repeats = len(re.findall(r"[.,;:!?؟،؛]{3,}", t)), len(re.findall(r"(.{1,8})\1{4,}", t))
    flags = [name for name, on in [
        ("empty_output_from_non_empty_page", not t), ("replacement_characters", n["rep"]), ("private_use_glyphs", n["pua"]), ("control_characters", n["ctl"]), ("noise_inside_arabic_words", noise), ("mojibake_like_arabic", garbled),
        ("symbol_dominated_text", symbols > 0.12), ("abnormal_combining_marks", combining > 0.22 or detached > 5), ("repeated_garbage", repeats), ("large_duplicate_sections", dup >= 0.35)] if on]
    u = 100 - min(55, 18 * n["rep"]) - min(55, 14 * n["pua"]) - min(30, 8 * n["ctl"]) - min(35, 120 * combining)
    a = 100 - min(45, 18 * len(noise)) - min(35, 8 * len(bad)) - min(35, tz * (80 if garbled else 15)) - min(25, 80 * alone)
    s = 100 - min(45, 100 * dup) - min(30, 10 * stops) - min(30, 12 * repeats)
    readable = 0.35 * u + 0.45 * a + 0.2 * s
    covered = min(100, 35 + min(65, len(t) / 4)) if t else 0
    if estimate is not None:
        readable = min(readable, estimate + 8)
    q = 0.45 * readable + 0.2 * u + 0.2 * a + 0.1 * s + 0.05 * covered
    q = q if estimate is None else min(estimate, q)
    return flags, q, readable, u, a, s, covered


def test_corruption_report(spark):
    rng = random.Random(4)
    pieces = ["كلمة", "طظ", "ab", "a1", "ك1ل", "ـ", "\ufffd", "\u064b", "!!!", "\n", "x\n", " ", "  ", "#", "\ue000", "\x02", "و"]
    rows = NOISY + [("".join(rng.choices(pieces, k=rng.randint(1, 40))), rng.choice([None, 60.0, 95.0])) for _ in range(150)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, text string, e double").withColumn("_t", F.lit("clash"))
    got = textquality.with_corruption(df.drop("_t"), "text", "e", F.lit(True)).orderBy("i").collect()
    for r, (t, e) in zip(got, rows):
        flags, *scores = plain_corruption(t, e)
        c = r.corruption
        assert c.flags == flags, (t, c.flags, flags)
        assert [c.quality, c.readability, c.unicode_integrity, c.arabic_integrity, c.structure, c.coverage] == pytest.approx([max(0, min(100, x)) for x in scores], abs=0.006), t
    a = {r.i: r.a for r in textquality.with_corruption(df.drop("_t"), "text", "e", F.lit(True)).select("i", textquality.acceptance(F.col("corruption"), F.col("e"), 50.0).alias("a")).collect()}
    assert a[0].accepted and a[0].reason is None and a[1].reason == "indeterminate_quality_score" and a[2].reason == "critical_text_corruption: replacement_characters, symbol_dominated_text" and a[14].reason.startswith("critical") and a[11].accepted


def test_ratios_and_layout(spark):
    df = column(spark, ["ab كل", "", "INTRO:\n| a | b |\nA long line that ends with a mark and has more than thirty five letters.\nFigure 1\nTable of things\nend"])
    assert values(df, textquality.script_ratios(F.col("t")))[:2] == [(0.5, 0.5), (0.0, 0.0)]
    assert tuple(values(df, textquality.layout_profile(F.col("t")))[2]) == (1, 0, 1, 1, 1, 1, 1, 5)
    assert values(df, textquality.duplicate_line_ratio(F.col("t")))[2] == 0.0
    assert values(column(spark, ["و كلمة ب", "x", None]), textquality.isolated_arabic_ratio(F.col("t"))) == [pytest.approx(2 / 3), None, None]
    assert values(column(spark, ["a\rb\tc\n", "\ufffd\ue000", ""]), textquality.unicode_corruption_count(F.col("t"))) == [1, 2, 0]
    q = values(column(spark, ["word one.\n\nword two", ""]), textquality.quality_components(F.col("t"), F.lit(4), F.lit(3)))
    assert q[0].completeness == 75.0 and q[0].direction_quality == 95.0 and q[0].layout_quality == 80.0 and q[1].final_quality == 11.25


def test_page_ranges():
    assert text.page_ranges("1-3, 7") == ([(1, 3), (7, 7)], [1, 2, 3, 7])
    with pytest.raises(ValueError):
        text.page_ranges("3-1")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_error_rates_against_plain_distance(spark):
    rng = random.Random(1)
    pairs = [("", ""), ("", "x"), ("a b c", ""), ("كتاب جديد", "كتب جديد")] + [(" ".join(rng.choices(["ab", "c", "dé"], k=rng.randint(0, 9))), " ".join(rng.choices(["ab", "c", "dé"], k=rng.randint(0, 9)))) for _ in range(40)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i long, a string, b string")
    rate = lambda d, n, m: d / n if n else float(bool(m))
    assert values(df, edit.cer(F.col("a"), F.col("b"))) == pytest.approx([rate(distance(a, b), len(a), len(b)) for a, b in pairs])
    assert values(df, edit.wer(F.col("a"), F.col("b"))) == pytest.approx([rate(distance(a.split(), b.split()), len(a.split()), len(b.split())) for a, b in pairs])


@settings(max_examples=60, deadline=None)
@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_alignment_is_cheapest_and_complete(a, b):
    ops = edit.align(a, b)
    assert sum(op != "match" for op, _, _ in ops) == distance(a, b)
    assert [i for _, i, _ in ops if i >= 0] == list(range(len(a))) and [j for _, _, j in ops if j >= 0] == list(range(len(b)))


@pytest.mark.parametrize("cells", [0, 50, 500, 10_000])
def test_alignments_do_not_depend_on_the_cells_that_are_kept(monkeypatch, cells):
    rng = random.Random(9)
    for n in (0, 1, 7, 120):
        a = "".join(rng.choices("abcd", k=n))
        b = "".join(c for c in a if rng.random() > 0.1) + "xyz"
        want = edit.align(a, b)
        monkeypatch.setattr(edit, "CELLS", cells)
        assert edit.align(a, b) == want and sum(op != "match" for op, _, _ in want) == distance(a, b)
        monkeypatch.undo()


def test_word_distance_of_more_words_than_characters(spark):
    words = [f"w{i}" for i in range(7000)]
    df = spark.createDataFrame([(0, " ".join(words), " ".join(words[5:] + ["x"])), (1, "a b", "a c"), (2, None, "a"), (3, " ".join(words), None)], "i long, a string, b string")
    assert values(df, edit.word_distance(F.col("a"), F.col("b"))) == [6, 1, 1, 7000]
    assert values(df, edit.wer(F.col("a"), F.col("b")))[0] == pytest.approx(6 / 7000)


def test_error_classes(spark):
    rows = [
        ("a", "a", "match"), ("ا", "أ", "hamza_alef_variant"), ("إ", "آ", "hamza_alef_variant"), ("ي", "ى", "ya_alef_maqsura"), ("ه", "ة", "ta_marbuta_ha"), ("1", "١", "digit_system_confusion"), ("1", "2", "arabic_digit"), ("٣", "۴", "arabic_digit"), ("ب", "", "missing_arabic_character"),
        ("", "x", "extra_latin_character"), (" ", "", "whitespace"), ("", ".", "punctuation"), ("", "٣", "arabic_digit"), ("3", "", "latin_digit"), ("\u064b", "", "diacritic"), ("", "\u0640", "tatweel"), ("é", "", "missing_character"), ("", "é", "extra_character"), (".", ",", "punctuation"),
        (".", "a", "character_substitution"), ("\u064b", ".", "diacritic"), ("\u0640", "ب", "tatweel"), ("ء", "ب", "hamza"), ("ا", "a", "arabic_latin_script"), ("a", "A", "character_substitution"), ("ب", "ت", "character_substitution"), ("a", " ", "whitespace"), ("ab", "c", "unknown"), ("", "", "unknown"), (None, "a", "extra_latin_character"),
    ]
    df = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "i long, a string, b string")
    assert values(df, edit.character_error(F.col("a"), F.col("b"))) == [r[2] for r in rows]
    rows = [("كتاب", "كتاب", "match"), ("", "x", "extra_word"), ("x", None, "missing_word"), ("كِتاب", "كتاب", "diacritic"), ("p2", "px", "digit_word"), ("...", "x", "punctuation"), ("Python", "بايثون", "mixed_script_word"), ("cat", "dog", "word_substitution"), ("كتاب", "كتب", "word_substitution")]
    df = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "i long, a string, b string")
    assert values(df, edit.word_error(F.col("a"), F.col("b"))) == [r[2] for r in rows]


def test_protection(spark):
    df = column(spark, ["holdout", "False", "train", "my_benchmark", "YES", None])
    assert values(df, protection.marks_protected(F.col("t"))) == [True, False, False, True, True, False]
    records = column(spark, ['{"split": "train"}', '{"split": 3}', '{"a": {"b": [{"role": "holdout"}]}}', "no json", '{"metadata": "x"}', '{"protected": "maybe"}', None, '{"split": null}'])
    assert values(records, protection.record_protected(F.col("t"))) == [False, True, True, True, True, True, True, False]
    assert values(records, protection.record_malformed(F.col("t"))) == [False, True, False, True, True, True, True, False]
    hidden = column(spark, ["h\u200doldout", "h\u043eldout", "hold-out", "train", None, "my h\uff4fldout set", "Evaluation.Only", "no", "\u039fther", ""])
    assert values(hidden, protection.obfuscated_marker(F.col("t"))) == [True, True, True, False, False, True, True, False, False, False]
    blocks = column(spark, ['{"note": "benchmarks/x/benchmark_manifest"}', '{"data_split": "my holdout part"}', '{"x": {"y": "bench mark"}}', '{"x": {"y": {"z": "holdout"}}}', "", None, "no json", '{"role": 3}', '{"note": "h\u043eld/out"}', '{"My Role": "protected by x"}'])
    assert values(blocks, protection.provenance_hides_marker(F.col("t"))) == [False, True, True, False, False, False, True, False, True, True]


def test_partitions(spark):
    df = spark.createDataFrame([(0, "unassigned", "train", False), (1, "holdout", None, False), (2, "test", "train", False), (3, None, "Benchmark_holdout", False), (4, None, None, False), (5, "train", None, True)], "i long, t string, s string, p boolean")
    assert values(df, protection.partition_of(F.col("t"), F.col("s"), F.col("p"))) == ["TRAIN", "PROTECTED", "EVAL", "PROTECTED", "UNPARTITIONED", "PROTECTED"]


def test_unicode_form(spark):
    t = unicodedata.normalize("NFD", "é")
    assert values(column(spark, [t, None]), text.unicode_form("NFC")("t")) == ["é", None]
