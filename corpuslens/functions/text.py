"""Text functions: normalization, folding, scripts, paths, ranges. Native expressions wherever Spark has them; quality is in textquality.

Unicode normal forms are not among Spark's functions; normalize() is an Arrow UDF, everything else runs on the JVM.
"""

from __future__ import annotations

import dataclasses
import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens.functions.identity import settings_fingerprint

#: The character classes of the normalization policy.
TATWEEL = "ـ"
BOM = "﻿"
DIACRITICS = "[ؐ-ًؚ-ٰٟۖ-ۭ]"
ALEF, ALEF_PLAIN = "أإآٱ", "اااا"
YA, YA_PLAIN = "ى", "ي"
TA_MARBUTA, HA = "ة", "ه"
DIGITS, DIGITS_PLAIN = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789"
ZERO_WIDTH = "​‌‍‎‏‪‫‬‭‮⁦⁧⁨⁩﻿"
CONTROL = "[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x80-\x9f]"
ARABIC = r"[؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿]"


@dataclass(frozen=True)
class Policy:
    """Which steps normalize() takes."""

    unicode_form: str = "NFC"
    strip_bom: bool = True
    normalize_line_endings: bool = True
    preserve_line_breaks: bool = True
    collapse_whitespace: bool = False
    remove_zero_width: bool = False
    remove_control_characters: bool = False
    remove_tatweel: bool = False
    remove_diacritics: bool = False
    fold_alef: bool = False
    fold_ya: bool = False
    fold_digits: bool = False
    presentation_forms: str = "preserve"

    def __post_init__(self):
        for f in dataclasses.fields(self):
            if f.type == "bool" and not isinstance(getattr(self, f.name), bool):
                raise TypeError(f"{f.name} must be a boolean")
        if self.unicode_form not in ("NFC", "NFD", "NFKC", "NFKD"):
            raise ValueError(f"unknown normal form {self.unicode_form}")
        if self.presentation_forms not in ("preserve", "compose"):
            raise ValueError("presentation_forms is 'preserve' or 'compose'")
        compatible = self.unicode_form in ("NFKC", "NFKD")
        if compatible != (self.presentation_forms == "compose") or self.unicode_form == "NFKD":
            raise ValueError("NFKC goes with presentation_forms='compose', and only with it")

    def fingerprint(self) -> str:
        return settings_fingerprint(dataclasses.asdict(self))


#: The policy under which texts count as equal for deduplication.
DEDUPE = Policy(unicode_form="NFKC", presentation_forms="compose", collapse_whitespace=True, remove_zero_width=True, remove_control_characters=True, remove_tatweel=True, remove_diacritics=True, fold_alef=True, fold_ya=True)


def _steps(policy: Policy):
    """(name, function) of each step; a step is reported if it changed the text, collapsing always."""
    has = lambda t, chars: not t.isascii() and any(c in t for c in chars)  # noqa: E731  (far cheaper than a translation of all characters)
    drop = lambda chars: lambda t, m=str.maketrans("", "", chars): t.translate(m) if has(t, chars) else t
    fold = lambda a, b: lambda t, m=str.maketrans(a, b): t.translate(m) if has(t, a) else t
    gone = lambda pattern: lambda t, p=re.compile(pattern): p.sub("", t)
    wide, edges = re.compile(r"[^\S\n ]|  "), re.compile(r" *\n *")

    def collapse(t):
        t = re.sub(r"[^\S\n]+", " ", t) if wide.search(t) else t
        return (edges.sub("\n", t) if " \n" in t or "\n " in t else t).strip()

    steps = [
        (policy.strip_bom, "strip_bom", lambda t: t.lstrip(BOM)),
        (policy.normalize_line_endings, "normalize_line_endings", lambda t: t.replace("\r\n", "\n").replace("\r", "\n")),
        (True, f"unicode_{policy.unicode_form.lower()}", lambda t: unicodedata.normalize(policy.unicode_form, t)),
        (policy.remove_zero_width, "remove_zero_width_and_bidi_marks", drop(ZERO_WIDTH)),
        (policy.remove_control_characters, "remove_control_characters", gone(CONTROL)),
        (policy.remove_tatweel, "remove_tatweel", drop(TATWEEL)),
        (policy.remove_diacritics, "remove_arabic_diacritics", gone(DIACRITICS)),
        (policy.fold_alef, "fold_alef_variants", fold(ALEF, ALEF_PLAIN)),
        (policy.fold_ya, "fold_alef_maqsura_to_ya", fold(YA, YA_PLAIN)),
        (policy.fold_digits, "fold_arabic_indic_digits", fold(DIGITS, DIGITS_PLAIN)),
        (policy.collapse_whitespace, "collapse_whitespace", collapse),
        (not policy.preserve_line_breaks, "flatten_line_breaks", lambda t: re.sub(r" +", " ", t.replace("\n", " ")).strip() if "\n" in t else t),
    ]
    return [(name, step) for on, name, step in steps if on]


def normalize(policy: Policy = Policy()):
    """Arrow UDF: text -> struct(value, applied: the steps that changed it)."""
    steps = _steps(policy)

    @F.pandas_udf("value string, applied array<string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        values, applied = [], []
        for text in texts:
            done = []
            if text is not None:
                for name, step in steps:
                    new = step(text)
                    if new != text or name == "collapse_whitespace":
                        done.append(name)
                    text = new
            values.append(text)
            applied.append(done)
        return pd.DataFrame({"value": values, "applied": applied})

    return run


def unicode_form(form: str = "NFC"):
    """Arrow UDF: text -> its normal form."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return run


def fold_for_comparison(text: Column, alef: bool = True, ya: bool = True, ta_marbuta: bool = False, tatweel: bool = True, diacritics: bool = True, digits: bool = False, spaces: bool = True) -> Column:
    """The comparison folding of a text that is in NFC already (see unicode_form): native."""
    if diacritics:
        text = F.regexp_replace(text, DIACRITICS, "")
    table = [("", "")] + [(a, b) for on, a, b in ((alef, ALEF, ALEF_PLAIN), (ya, YA, YA_PLAIN), (ta_marbuta, TA_MARBUTA, HA), (digits, DIGITS, DIGITS_PLAIN), (tatweel, TATWEEL, "")) if on]
    matching, replace = "".join(a for a, _ in table), "".join(b for _, b in table)  # tatweel is last: no counterpart, so it goes
    if matching:
        text = F.translate(text, matching, replace)
    if spaces:
        text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"(?U)\s*\n\s*", "\n"), r"(?U)^\s+|\s+$", "")
    return text


def collapse_whitespace(text: Column, keep_lines: bool = True) -> Column:
    text = F.regexp_replace(F.regexp_replace(text, r"(?U)[^\S\n]+", " "), r" *\n *", "\n")
    if not keep_lines:
        text = F.regexp_replace(text, r"\n+| +", " ")
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Words between Unicode white space; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def script(text: Column) -> Column:
    """arabic, latin, mixed or unknown, by which letters occur."""
    a, b = F.coalesce(text.rlike(ARABIC), F.lit(False)), F.coalesce(text.rlike(r"[A-Za-zÀ-ɏ]"), F.lit(False))
    return F.when(a & b, "mixed").when(a, "arabic").when(b, "latin").otherwise("unknown")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern))


def _share(n: Column, of: Column) -> Column:
    return F.when(of > 0, n / of).otherwise(0.0)


def spreadsheet_cell(value: Column) -> Column:
    """A quote before what a spreadsheet would run as a formula."""
    return F.when(value.rlike(r"^\s*[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)


def first_integer(text: Column, lo: int = 0, hi: int = 100) -> Column:
    """The first integer in a text, clamped; null without one."""
    found = F.regexp_extract(text, r"(\d{1,9})", 1)
    return F.when(found != "", F.least(F.lit(hi), F.greatest(F.lit(lo), found.try_cast("int"))))


def text_class(text: Column) -> Column:
    """vocalized, long_words or plain: density of diacritics, then mean word length."""
    letters, words = _count(text, r"\p{L}"), tokens(text)
    mean = F.when(F.size(words) > 0, F.length(F.array_join(words, "")) / F.size(words)).otherwise(0.0)
    return F.when(_share(_count(text, DIACRITICS), letters) > 0.2, "vocalized").when(mean > 7, "long_words").otherwise("plain")


def first_difference(a: Column, b: Column) -> Column:
    """Place of the first differing character of two texts, null if equal. By halving prefixes, so log steps of native compares."""
    n = F.least(F.length(a), F.length(b))
    steps = F.sequence(F.lit(0), F.lit(30))
    state = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), n.alias("hi")), lambda s, _: _halve(a, b, s))
    return F.when(a == b, None).otherwise(state["lo"])


def _halve(a: Column, b: Column, s: Column) -> Column:
    mid = F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
    same = F.substring(a, F.lit(1), mid) == F.substring(b, F.lit(1), mid)
    return F.when(s["lo"] >= s["hi"], s).otherwise(F.struct(F.when(same, mid).otherwise(s["lo"]).alias("lo"), F.when(same, s["hi"]).otherwise(mid - 1).alias("hi")))


def relative_path(value: Column) -> Column:
    """A lexically clean relative path with '/', or null if it is empty, absolute, has a drive, a NUL or climbs out."""
    v = F.replace(value, F.lit("\\"), F.lit("/"))
    bad = v.rlike(r"^/|^[A-Za-z]:|\x00|(?:^|/)\.\.(?:/|$)") | (F.trim(v) == "")
    parts = F.filter(F.split(v, "/"), lambda p: (p != "") & (p != "."))
    return F.when(~bad & (F.size(parts) > 0), F.array_join(parts, "/"))


def apply_rules(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Literal replacements in the order of the rules (a bounded list, by falling confidence)."""
    for before, after in rules:
        text = F.replace(text, F.lit(before), F.lit(after))
    return text


def page_ranges(text: str) -> tuple[list[tuple[int, int]], list[int]]:
    """'1-3,7' to ranges and pages, on the driver."""
    ranges = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        m = re.fullmatch(r"(\d+)(?:\s*-\s*(\d+))?", part)
        if not m or not 1 <= int(m[1]) <= int(m[2] or m[1]):
            raise ValueError(f"not a page range: {part!r}")
        ranges.append((int(m[1]), int(m[2] or m[1])))
    return ranges, sorted({p for a, b in ranges for p in range(a, b + 1)})


def selected_pages(mode: str, total: Column, start: int = 1, end: int | None = None) -> Column:
    """Pages 1..total that a mode takes: all, range, odd, even."""
    every = F.when(total > 0, F.sequence(F.lit(1), total)).otherwise(F.array().cast("array<int>"))
    if mode == "all":
        return every
    if mode == "range":
        return F.filter(every, lambda p: (p >= start) & (p <= (end if end is not None else total)))
    if mode in ("odd", "even"):
        return F.filter(every, lambda p: p % 2 == (1 if mode == "odd" else 0))
    raise ValueError(f"unknown mode {mode}")
