"""The masking stage against spans found and merged by plain Python."""

import random
import re
import time

import corpus_pipeline
from pyspark.sql import functions as F

from corpuslens.llm import pii
from tests.llm import brute
from tests.llm.test_operators import TEXTS, documents

ORDER = ["email", "ip", "card", "phone", "iban", "ssn"]


def spans_of(text):
    found = brute.pii(text)
    for kind, pattern, score, words, bonus in (
        ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", 0.8, "iban|account|konto|cuenta|compte", 0.2),
        ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, "ssn|social security", 0.5),
    ):
        places = [(m.start(), m.end()) for m in re.finditer(pattern, text)]
        for i, (a, b) in enumerate(places):
            if kind == "iban":
                s = text[a:b].replace(" ", "")
                if not (15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1):
                    continue
            before, after = text[places[i - 1][1] if i else 0 : a][-40:], text[b : places[i + 1][0] if i + 1 < len(places) else None][:20]
            if score + bonus * bool(re.search(words, before + " " + after, re.I)) >= 0.6:
                found.append((kind, a, b))
    return found


def masked(text):
    if text is None:
        return None
    out, at, end, tag = [], 0, 0, None
    for a, b, kind in sorted(((a, b, k) for k, a, b in spans_of(text)), key=lambda s: (s[0], -s[1], ORDER.index(s[2]))):
        if tag is None or a >= end:
            if tag is not None:
                out.append(tag)
                at = end
            out.append(text[at:a])
            tag, end = f"[{kind.upper()}]", b
        end = max(end, b)
    return "".join(out) + (tag or "") + text[end:]


SSN = "my ssn 123-45-6789, thanks"
LAPPED = "call +1.20.30.40.5678 now"


def test_stage_masks_what_the_operator_finds(spark):
    assert masked(SSN) == "my ssn [SSN], thanks" and masked(LAPPED) == "call [PHONE] now"
    rng = random.Random(11)
    pieces = ["ssn 123-45-6789", "987-65-4321", "+1.20.30.40.5678", "+1 4111 1111 1111 1111", "4111111111111111", "a@1.2.3.4", "1.2.3.4@b.c", "+10.0.0.1", "DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "social security", "x" * 700, "é😀", "+", " ", ".", "-", "12", "\n"]
    texts = TEXTS + [(100, SSN), (101, LAPPED)] + [(200 + i, rng.choice(["", " "]).join(rng.choices(pieces, k=rng.randint(1, 30)))) for i in range(150)]
    texts += [(900, "y" * 1024), (901, "y" * 1019 + "a@b.c"), (902, "a@b.c" + "y" * 1024), (903, "é" * 2048 + "+1.20.30.40.5678" + "😀" * 5000 + " ssn 123-45-6789")]
    docs = documents(spark, texts).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    got = corpus_pipeline.mask_personal_data(spark, docs, "")
    assert got.columns == corpus_pipeline.COLUMNS
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in got.collect()), key=str) == sorted(((d, masked(t), None if t is None else len(masked(t))) for d, t in texts), key=str)
    kept = pii.mask_pii(docs)
    assert kept.columns == docs.columns and {r.hit for r in kept.collect()} == {"clash"}


def test_many_spans_of_one_text(spark):
    text = "a@1.2.3.4 +1.20.30.40.5678 é " * 15_000
    began = time.time()
    assert pii.mask_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text == masked(text)
    assert time.time() - began < 30
