"""Edit distances, error rates and alignments of a reference and a hypothesis."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.functions.text import ARABIC, tokens

#: Characters that stand for words: the private use area of the basic plane.
ALPHABET = "".join(map(chr, range(0xE000, 0xF900)))


@F.pandas_udf(T.IntegerType())
def _long_distance(references: pd.Series, hypotheses: pd.Series) -> pd.Series:
    """Edit distance of lists of words, row of the cost table by row; null for null lists."""
    return pd.Series([None if r is None else int(_costs(*_codes(r, h))[-1]) for r, h in zip(references, hypotheses)], dtype="Int32")


def word_distance(reference: Column, hypothesis: Column) -> Column:
    """Edit distance over words. Each distinct word of a pair becomes one character, so that the native distance applies; where a pair
    has more distinct words than there are such characters, its words become numbers and the table of costs is computed."""
    r, h = tokens(reference), tokens(hypothesis)
    known = F.array_distinct(F.concat(r, h))
    few = F.size(known) <= len(ALPHABET)
    code = lambda words: F.array_join(F.transform(words, lambda w: F.substring(F.lit(ALPHABET), F.array_position(known, w).cast("int"), F.lit(1))), "")
    return F.when(few, F.levenshtein(code(r), code(h))).otherwise(_long_distance(F.when(~few, r), F.when(~few, h)))


def _rate(distance: Column, length: Column, other: Column) -> Column:
    return F.when(length == 0, F.when(other == 0, 0.0).otherwise(1.0)).otherwise(distance / length)


def cer(reference: Column, hypothesis: Column) -> Column:
    """Character errors by reference length, may exceed 1; of an empty reference 0 or 1."""
    return F.when(reference == hypothesis, 0.0).otherwise(_rate(F.levenshtein(reference, hypothesis), F.length(reference), F.length(hypothesis)))


def wer(reference: Column, hypothesis: Column) -> Column:
    return F.when(reference == hypothesis, 0.0).otherwise(_rate(word_distance(reference, hypothesis), F.size(tokens(reference)), F.size(tokens(hypothesis))))


def percent_metrics(reference: Column, hypothesis: Column, empty_is_clean: bool = False) -> Column:
    """struct(cer, wer, character_accuracy) in per cent, with max(1, length) below. empty_is_clean: an empty reference has no errors."""
    d, n, m = F.levenshtein(reference, hypothesis), F.greatest(F.lit(1), F.length(reference)), F.greatest(F.lit(1), F.size(tokens(reference)))
    w = word_distance(reference, hypothesis)
    clean = (F.length(reference) == 0) & F.lit(empty_is_clean)
    c = F.when(clean, 0.0).otherwise(100.0 * d / n)
    return F.struct(c.alias("cer"), F.when(clean, 0.0).otherwise(100.0 * w / m).alias("wer"), F.greatest(F.lit(0.0), 100.0 - c).alias("character_accuracy"))


def agreement(left: Column, right: Column) -> Column:
    """struct(characters, words): 1 - distance / longer length; 1 for two empty texts."""
    longer = lambda a, b: F.greatest(a, b)
    one = lambda d, n: F.when(n == 0, 1.0).otherwise(1.0 - d / n)
    return F.struct(one(F.levenshtein(left, right), longer(F.length(left), F.length(right))).alias("characters"), one(word_distance(left, right), longer(F.size(tokens(left)), F.size(tokens(right)))).alias("words"))


def with_page_metrics(df: DataFrame, reference: str = "reference", prediction: str = "prediction", folded: tuple[Column, Column] | None = None) -> DataFrame:
    """Adds the measures of a page: cer, wer, ncer (of the folded texts, if given), exact, normalized_exact, accuracies, missing, hallucination, empty.

    The distances are columns of their own, so each is computed once.
    """
    r, p = F.col(reference), F.col(prediction)
    a, b = folded or (r, p)
    x = df.withColumn("cer", cer(r, p)).withColumn("wer", wer(r, p))
    x = x.withColumn("ncer", cer(a, b) if folded else F.col("cer"))
    empty = F.trim(p) == ""
    return x.select(
        "*", (r == p).cast("int").alias("exact"), (a == b).cast("int").alias("normalized_exact"), F.greatest(F.lit(0.0), 1.0 - F.col("cer")).alias("character_accuracy"), F.greatest(F.lit(0.0), 1.0 - F.col("wer")).alias("word_accuracy"),
        (empty & (F.trim(r) != "")).cast("int").alias("missing"), (~empty & (F.trim(r) == "")).cast("int").alias("hallucination"), empty.cast("int").alias("empty"),
    )


def spread(df: DataFrame, *keys: str, source: DataFrame | None = None) -> DataFrame:
    """The rows dealt over the cores by keys before heavy work on each, if they are in fewer partitions than there are cores.
    source: the scanned table behind df, if df has a shuffle, which counting its partitions would run."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if (source or df).rdd.getNumPartitions() >= cores else df.repartition(4 * cores, *keys)


def convert_error(value: Column, source: str, target: str) -> Column:
    """Between 'ratio' and 'percent'."""
    if {source, target} - {"ratio", "percent"}:
        raise ValueError("ratio or percent")
    return value if source == target else value * 100.0 if target == "percent" else value / 100.0


# ---- alignments ----


#: Cells of a cost table that is kept whole; of larger ones some rows are kept and those between computed again. The alignment is the same.
CELLS = 25_000_000


def _codes(reference, hypothesis) -> tuple[np.ndarray, np.ndarray]:
    known: dict = {}
    return tuple(np.fromiter((known.setdefault(x, len(known)) for x in s), np.int64, len(s)) for s in (reference, hypothesis))


def _row(above: np.ndarray, same: np.ndarray, first: int, steps: np.ndarray) -> np.ndarray:
    """The next row of the cost table: the cheapest of substitution, deletion and, as a running minimum, insertion."""
    row = np.empty_like(above)
    row[0] = first
    row[1:] = np.minimum(above[:-1] + ~same, above[1:] + 1)
    return np.minimum.accumulate(row - steps) + steps


def _costs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Costs of aligning all of a with each beginning of b."""
    steps = np.arange(len(b) + 1)
    row = steps
    for i, x in enumerate(a, 1):
        row = _row(row, b == x, i, steps)
    return row


def align(reference, hypothesis) -> list[tuple[str, int, int]]:
    """(op, reference place, hypothesis place) of a cheapest alignment of two sequences; -1: none. Of equal costs, from the end,
    substitution before deletion before insertion. Holds about sqrt(CELLS) rows of costs at most, or two times the root of the rows."""
    a, b = _codes(reference, hypothesis)
    n, m = len(a), len(b)
    steps = np.arange(m + 1, dtype=np.int32)
    every = n if n * m <= CELLS else math.isqrt(n)
    kept, row = [steps], steps
    for i in range(1, n + 1 if every < n else 0):
        row = _row(row, b == a[i - 1], i, steps)
        if i % every == 0:
            kept.append(row)
    out, i, j = [], n, m
    for start in range((n - 1) // every * every, -1, -every) if n else [0]:
        cost = [kept[start // every] if every else steps]
        for k in range(start + 1, i + 1):
            cost.append(_row(cost[-1], b == a[k - 1], k, steps))
        while i > start or (start == 0 and j):
            here = cost[i - start][j]
            if i and j and here == cost[i - start - 1][j - 1] + (a[i - 1] != b[j - 1]):
                i, j = i - 1, j - 1
                out.append(("match" if a[i] == b[j] else "substitution", i, j))
            elif i and here == cost[i - start - 1][j] + 1:
                i -= 1
                out.append(("deletion", i, -1))
            else:
                j -= 1
                out.append(("insertion", -1, j))
    return out[::-1]


ALIGNMENT = "array<struct<op:string,ref:string,hyp:string,ref_at:int,hyp_at:int,before:string,after:string>>"


def alignment(words: bool = False, context: int = 12):
    """Arrow UDF (reference, hypothesis) -> edits (no matches) with their places and the reference around them."""

    @F.pandas_udf(ALIGNMENT)
    def run(references: pd.Series, hypotheses: pd.Series) -> pd.Series:
        out = []
        for r, h in zip(references, hypotheses):
            a, b = (r or "", h or "")
            a, b = (a.split(), b.split()) if words else (a, b)
            rows, at = [], 0
            for op, i, j in align(a, b):
                at = i + 1 if i >= 0 else at
                if op != "match":
                    here = i if i >= 0 else at
                    join = " ".join if words else "".join
                    rows.append({"op": op, "ref": a[i] if i >= 0 else "", "hyp": b[j] if j >= 0 else "", "ref_at": i, "hyp_at": j, "before": join(a[max(0, here - context) : here]), "after": join(a[here + (i >= 0) : here + (i >= 0) + context])})
            out.append(rows)
        return pd.Series(out)

    return run


def edit_counts(edits: Column) -> Column:
    """struct(substitutions, insertions, deletions) of an alignment."""
    n = lambda op: F.size(F.filter(edits, lambda e: e["op"] == op))
    return F.struct(n("substitution").alias("substitutions"), n("insertion").alias("insertions"), n("deletion").alias("deletions"))


#: What an edited character is, the first class that holds it; and pairs of letters that are often confused.
CLASSES = [
    ("whitespace", r"[\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"),
    ("punctuation", r"[\u060C\u061B\u061F\u066A-\u066D\u06D4.,;:!?\"'()\[\]{}«»…\-–—/\\|@#&*%$+=<>~^_]"),
    ("arabic_digit", "[٠-٩۰-۹]"),
    ("latin_digit", "[0-9]"),
    ("diacritic", r"[\u0610-\u061A\u064B-\u065F\u0670\u06D6-\u06ED]"),
    ("tatweel", r"\u0640"),
    ("arabic", ARABIC),
    ("latin", "[A-Za-z]"),
]
ALEFS = ["ا", "أ", "إ", "آ", "ٱ"]
CONFUSED = [("ya_alef_maqsura", ["ي", "ى"]), ("ta_marbuta_ha", ["ة", "ه"])]
HAMZA = "ء"
_PATTERN = dict(CLASSES)


def _class_of(c: Column) -> Column:
    out = F.lit("other")
    for name, pattern in reversed(CLASSES):
        out = F.when(c.rlike(f"^{pattern}$"), name).otherwise(out)
    return out


def character_error(ref: Column, hyp: Column) -> Column:
    """The class of one character edit; an empty or null side is an insertion or deletion. 'unknown' if a side has more than one character, or both have none."""
    r, h = F.coalesce(ref, F.lit("")), F.coalesce(hyp, F.lit(""))
    a, b = _class_of(r), _class_of(h)
    letters = lambda c, kind: F.when(c.isin("arabic", "latin"), F.concat(F.lit(kind), F.lit("_"), c, F.lit("_character"))).when(c == "other", f"{kind}_character").otherwise(c)
    either = lambda name: (a == name) | (b == name)
    digits = a.endswith("_digit") & b.endswith("_digit")
    rules = [
        ("match", r == h), ("whitespace", either("whitespace")), ("punctuation", (a == "punctuation") & (b == "punctuation")), ("digit_system_confusion", digits & (a != b)), ("arabic_digit", digits), ("diacritic", either("diacritic")),
        ("tatweel", either("tatweel")), ("hamza_alef_variant", r.isin(ALEFS) & h.isin(ALEFS)), *[(name, r.isin(pair) & h.isin(pair)) for name, pair in CONFUSED], ("hamza", (r == HAMZA) | (h == HAMZA)),
        ("arabic_latin_script", a.isin("arabic", "latin") & b.isin("arabic", "latin") & (a != b)),
    ]
    swap = F.lit("character_substitution")
    for name, rule in reversed(rules):
        swap = F.when(rule, name).otherwise(swap)
    n, m = F.length(r), F.length(h)
    return F.when((n == 1) & (m == 1), swap).when((n == 0) & (m == 1), letters(b, "extra")).when((n == 1) & (m == 0), letters(a, "missing")).otherwise("unknown")


def word_error(ref: Column, hyp: Column) -> Column:
    """The class of one word edit of texts in NFC; an empty or null side is an extra or a missing word."""
    r, h = F.coalesce(ref, F.lit("")), F.coalesce(hyp, F.lit(""))
    bare = lambda c: F.regexp_replace(c, _PATTERN["diacritic"], "")
    some = lambda c, *names: c.rlike("|".join(_PATTERN[n] for n in names))
    marks = lambda c: c.rlike(f"^(?:{_PATTERN['punctuation']})+$")
    latin = lambda c: some(c, "latin") & ~some(c, "arabic")
    return (
        F.when(r == "", "extra_word").when(h == "", "missing_word").when(r == h, "match").when(bare(r) == bare(h), "diacritic").when(some(r, "arabic_digit", "latin_digit") | some(h, "arabic_digit", "latin_digit"), "digit_word")
        .when(marks(r) | marks(h), "punctuation").when(latin(r) != latin(h), "mixed_script_word").otherwise("word_substitution")
    )
