"""Personal data in texts, in DataFrame operations only.

Regular expressions propose spans; validators confirm them (octets of an address, Luhn for card numbers, digit counts
for phones, mod-97 for bank accounts); context words next to a span, not beyond another match of the kind, adjust its score. The base kinds follow the
contract and stay whatever their score; the added kinds need a score of ACCEPT.

Matches and the parts between them come from regexp_extract_all and split with the same pattern, so a match's place is
a sum of lengths. The patterns are possessive and anchored at the start of a run, which makes them linear on long
texts without changing what they match.

Defined results: null and empty texts have no spans. Each row of the input gives one row; null doc_ids and repeated
rows are kept. Offsets are code points, end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Score that an added span needs; characters before and after a span that are searched for context words.
ACCEPT, BEFORE, AFTER = 0.6, 40, 20


def _octets(x: Column) -> Column:
    def small(part: Column) -> Column:
        digits = F.ltrim(part, F.lit("0"))
        return F.when(F.length(digits) > 3, False).otherwise(F.coalesce(digits.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(x, r"\."), small)


def _card(x: Column) -> Column:
    digits = F.translate(x, " -", "")
    return F.when(F.length(digits).between(16, 19), F.call_function("luhn_check", digits)).otherwise(False)


def _phone(x: Column) -> Column:
    return F.length(F.translate(x, "+ ().-", "")).between(8, 15)


def mod97(x: Column) -> Column:
    """The check number of an account: its first four characters moved to the end, letters as 10 to 35, modulo 97."""
    account = F.translate(x, " ", "")
    moved = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))
    def step(a: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 65, (a * 10 + code - 48) % 97).otherwise((a * 100 + code - 55) % 97)
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step)


def _iban(x: Column) -> Column:
    return F.when(F.length(F.translate(x, " ", "")).between(15, 34), mod97(x) == 1).otherwise(False)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    valid: Callable[[Column], Column] | None
    needs: str  # a text without it has no match; '' if nothing is sure
    score: float
    context: str  # pattern of context words
    bonus: float
    base: bool


_LOCAL = "[A-Za-z0-9._%+-]"
KINDS = [
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", None, "@", 0.9, r"(?i)mail|contact", 0.1, True),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", _octets, ".", 0.6, r"(?i)\bip\b|host|server|addr", 0.3, True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", _card, "", 0.8, r"(?i)card|visa|credit|karte|carte|tarjeta", 0.2, True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _phone, "+", 0.7, r"(?i)tel|phone|call|fax|mobil", 0.2, True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban, "", 0.8, r"(?i)iban|account|konto|cuenta|compte", 0.2, False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", None, "-", 0.3, r"(?i)ssn|social security", 0.5, False),
]
_BLOCK, _PIECE = 256, 1024


def _starts(before: Column, match: Column, i: Column) -> Column:
    """Place of match i: what stands before it. before, match: lengths. Sums of blocks keep it near-linear in the matches."""
    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda s, v: s + v)
    first = i - i % _BLOCK
    return F.get("blocks", F.floor(i / _BLOCK).cast("int")) + total(F.slice(before, first + 1, i - first + 1)) + total(F.slice(match, first + 1, i - first))


def _find(df: DataFrame, kind: Kind, text: str) -> DataFrame:
    """Adds column s_<kind>: array of (kind, start, end, score)."""
    able = F.col(text).contains(kind.needs) if kind.needs else F.lit(True)
    none = F.array().cast("array<string>")
    df = df.withColumn("m", F.when(able, F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))).otherwise(none))
    df = df.withColumn("good", F.filter(F.transform("m", lambda x, i: F.when(kind.valid(x) if kind.valid else F.lit(True), i)), lambda i: i.isNotNull()))
    some = F.size("good") > 0
    df = df.withColumn("p", F.when(some, F.split(text, kind.pattern, -1)).otherwise(none))
    df = df.withColumn("pl", F.transform("p", lambda x: F.length(x))).withColumn("ml", F.when(some, F.transform("m", lambda x: F.length(x))).otherwise(F.array().cast("array<int>")))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, v: s + v)
    df = df.withColumn("sums", F.transform(F.sequence(F.lit(0), F.floor(F.size("ml") / _BLOCK).cast("int")), lambda b: total(F.slice("pl", b * _BLOCK + 1, _BLOCK)) + total(F.slice("ml", b * _BLOCK + 1, _BLOCK))))
    df = df.withColumn("blocks", F.transform("sums", lambda x, b: total(F.slice("sums", F.lit(1), b))))

    def span(i: Column) -> Column:
        start = _starts(F.col("pl"), F.col("ml"), i)
        around = F.concat_ws(" ", F.right(F.get("p", i), F.lit(BEFORE)), F.left(F.get("p", i + 1), F.lit(AFTER)))
        score = F.least(F.lit(1.0), F.lit(kind.score) + F.when(F.rlike(around, F.lit(kind.context)), kind.bonus).otherwise(0.0))
        return F.struct(F.lit(kind.name).alias("kind"), start.cast("long").alias("start"), (start + F.get("ml", i)).cast("long").alias("end"), score.alias("score"))

    df = df.withColumn(f"s_{kind.name}", F.transform("good", span))
    if not kind.base:
        df = df.withColumn(f"s_{kind.name}", F.filter(f"s_{kind.name}", lambda s: s["score"] >= ACCEPT))
    return df.drop("m", "good", "p", "pl", "ml", "sums", "blocks")


def find_pii(docs: DataFrame, kinds: list[Kind] = KINDS) -> DataFrame:
    """doc_id and, for each kind, s_<kind>: array of (kind, start, end, score), in order of start."""
    x = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for kind in kinds:
        x = _find(x, kind, "text")
    return x.drop("text")


def span_list(columns: list[str]) -> Column:
    """kind:start:end of all spans of the columns, comma-joined."""
    return F.array_join(F.transform(F.concat(*columns), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _regions(df: DataFrame, kinds: list[Kind]) -> DataFrame:
    """Adds column regions: array of (start, end, tag), the merged union of the spans of all kinds, in order of start. Spans that only
    touch stay apart. A region is named for the span that starts it: the longest of those, then the first in kinds."""
    def ranked(rank: int, kind: Kind) -> Column:
        tag = F.lit(f"[{kind.name.upper()}]")
        return F.transform(f"s_{kind.name}", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus_end"), F.lit(rank).alias("rank"), tag.alias("tag")))

    df = df.withColumn("spans", F.sort_array(F.concat(*[ranked(i, k) for i, k in enumerate(kinds)]))).drop(*[f"s_{k.name}" for k in kinds])
    df = df.withColumn("ends", F.transform("spans", lambda s: -s["minus_end"]))
    df = df.withColumn("most", F.transform(F.sequence(F.lit(0), F.floor(F.size("ends") / _BLOCK).cast("int")), lambda b: F.array_max(F.slice("ends", b * _BLOCK + 1, _BLOCK))))
    df = df.withColumn("blocks", F.transform("most", lambda x, b: F.array_max(F.slice("most", F.lit(1), b))))

    def reach(i: Column) -> Column:  # the largest end before span i, null for the first
        first = i - i % _BLOCK
        return F.greatest(F.get("blocks", F.floor(i / _BLOCK).cast("int")), F.array_max(F.slice("ends", first + 1, i - first)))

    df = df.withColumn("reach", F.transform("ends", lambda x, i: reach(i)))  # blocks is read below too, else it is computed for each i
    df = df.withColumn("heads", F.filter(F.transform("spans", lambda s, i: F.when(s["start"] >= F.coalesce(F.get("reach", i), F.lit(0)), i)), lambda i: i.isNotNull()))

    def region(h: Column, j: Column) -> Column:
        head = F.get("spans", h)
        end = F.coalesce(F.get("reach", F.get("heads", j + 1)), F.greatest(F.element_at("blocks", -1), F.element_at("most", -1)))
        return F.struct(head["start"].cast("int").alias("start"), end.cast("int").alias("end"), head["tag"].alias("tag"))

    return df.withColumn("regions", F.transform("heads", region)).drop("spans", "ends", "most", "blocks", "reach", "heads")


def _cut(a: Column, b: Column) -> Column:
    """Characters a to b, exclusive, of the text whose pieces of _PIECE characters are in column pieces."""
    at = lambda x: F.floor(x / _PIECE).cast("int")
    part = lambda i, *of: F.coalesce(F.substr(F.get("pieces", i), *of), F.lit(""))
    over = F.concat(part(at(a), a % _PIECE + 1), F.array_join(F.slice("pieces", at(a) + 2, at(b) - at(a) - 1), ""), part(at(b), F.lit(1), b % _PIECE))
    return F.when(at(a) == at(b), part(at(a), a % _PIECE + 1, b - a)).otherwise(over)


def mask_pii(docs: DataFrame, kinds: list[Kind] = KINDS) -> DataFrame:
    """docs with each span that find_pii() accepts in column text replaced by [KIND]; spans that overlap are one, see _regions().
    Null texts stay null; other columns are kept. Near-linear in the text and its spans."""
    names = docs.columns
    own = [c if c == "text" else f"_{i}" for i, c in enumerate(names)]  # helper columns cannot clash
    x = docs.toDF(*own)
    for kind in kinds:
        x = _find(x, kind, "text")
    x = _regions(x, kinds)
    x = x.withColumn("pieces", F.when(F.size("regions") > 0, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))))
    hidden = F.transform("regions", lambda r, j: F.concat(_cut(F.coalesce(F.get("regions", j - 1)["end"], F.lit(0)), r["start"]), r["tag"]))
    rest = _cut(F.get("regions", F.size("regions") - 1)["end"], F.length("text"))
    return x.withColumn("text", F.when(F.size("regions") > 0, F.concat(F.array_join(hidden, ""), rest)).otherwise(F.col("text"))).select(*own).toDF(*names)
