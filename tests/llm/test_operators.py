"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing column names."""

import base64
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import bpe, chat, decontam, license_texts, licenses, media, neardup, pii, sharding, toxicity
from corpuslens.llm.common import hash_words, lower_ascii
from corpuslens.llm.components import connected_components
from corpuslens.llm.common import Scratch
from tests.llm import brute

LONG = " ".join(f"w{i % 977}" for i in range(40_000))
TEXTS = [
    (1, "Licensed under the Apache License, Version 2.0."), (2, None), (3, ""), (4, " \n\t "), (5, "GNU General\nPublic LICENSE mit license MIT License cc-by"), (6, "É GNU general public licens"), (7, LONG),
    (8, "one two three four five six seven eight nine ten eleven"), (9, "zero one two three four five six seven eight nine ten"), (9, "zero one two three four five six seven eight nine ten"), (None, "cc by nc 4.0 short item"),
    (10, "mail a.b@c.de x@y and 4111 1111 1111 1111, +1 (663) 555-6869, 10.0.0.256 10.0.0.1 1.2.3.4.5"), (11, "K kelvin ſ 日本語 İstanbul don't 'S 's  x"), (12, "Permission is hereby granted, free of charge, to any person obtaining one copy of this software and associated documentation files, to deal in the software without restriction"),
    (13, "DE89 3704 0044 0532 0130 00 iban and DE88 3704 0044 0532 0130 00"), (14, "ssn 123-45-6789 and 123-45-6780" + " x" * 60 + " 987-65-4321"),
]
BENCH = [(1, "one two three four five six seven eight nine ten"), (2, "short ITEM"), (3, None), (4, ""), (None, "seven eight nine ten eleven twelve x y z"), (5, "two three four five six seven eight nine ten eleven"), (5, "short item")]


def documents(spark, rows=TEXTS):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("h", "th", "w", "pos", "hit", "score", "shard", "key", "n", "regs", "lang"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def empty(spark):
    return documents(spark).limit(0)


def test_license_scan(spark):
    got = sorted((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, ",".join(r.base_labels)) for r in licenses.license_scan(documents(spark)).collect())
    assert got == sorted((str(d), *brute.licenses(t)) for d, t in TEXTS)
    labels = {r.doc_id: r.labels for r in licenses.license_scan(documents(spark)).collect()}
    assert "mit-text" in labels[12] and "apache-2.0" in labels[1] and "gpl-3" not in labels[5] and labels[6] == []
    assert licenses.license_scan(empty(spark)).count() == 0


def test_decontamination(spark):
    bench = spark.createDataFrame(BENCH, "item_id long, text string").withColumn("win", F.lit(1))
    got = sorted(((r.doc_id, r.n_words, r.n_hit, len(r["items"]), brute.sha(",".join(r["items"])), r.contaminated) for r in decontam.decontaminate(documents(spark), bench).collect()), key=str)
    assert got == sorted(brute.contamination(TEXTS, BENCH), key=str)
    kept = decontam.drop_contaminated(documents(spark), bench)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(x[0]) for x in brute.contamination(TEXTS, BENCH) if not x[5])
    assert decontam.decontaminate(empty(spark), bench).count() == 0
    assert decontam.decontaminate(documents(spark), bench.limit(0)).filter("contaminated").count() == 0


def test_decontamination_on_random_words(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choices("abc", k=rng.randint(0, 60)))) for i in range(60)]
    bench = [(i, " ".join(rng.choices("abc", k=rng.randint(0, 14)))) for i in range(12)]
    got = [(r.doc_id, r.n_words, r.n_hit, len(r["items"]), brute.sha(",".join(r["items"])), r.contaminated) for r in decontam.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()]
    assert sorted(got) == sorted(brute.contamination(docs, bench))


def test_pii(spark):
    rng = random.Random(2)
    pieces = ["a@b.c", "@", "a.b@c-d.e_f@g.h", "1.2.3.4", "256.1.1.1", "0001.2.3.04", "4111111111111111", "4111-1111 1111 1111", "+1 (2) 345-678", "+12", "x", "é", "12 34", ".", "4111111111111112", "+1 663 555 6869.", "😀"]
    texts = TEXTS + [(100 + i, rng.choice(["", " ", "\n"]).join(rng.choices(pieces, k=rng.randint(1, 40)))) for i in range(60)] + [(999, "1 2 " * 20_000 + "4111111111111111 " + "9" * 50_000 + " " + "a" * 50_000)]
    found = pii.find_pii(documents(spark, texts)).select("doc_id", pii.span_list(["s_email", "s_ip", "s_card", "s_phone"]).alias("spans"), "s_iban", "s_ssn").collect()
    want = sorted((str(d), ",".join("%s:%d:%d" % s for s in brute.pii(t))) for d, t in texts)
    assert sorted((str(r.doc_id), r.spans) for r in found) == want
    extra = {r.doc_id: (len(r.s_iban), len(r.s_ssn)) for r in found}
    assert extra[13] == (1, 0) and extra[14] == (0, 1)  # context does not reach over another match
    assert extra[7] == (0, 0)
    masked = {r.doc_id: r.text for r in pii.mask_pii(documents(spark)).collect()}
    assert masked[10] == "mail [EMAIL] x@y and [CARD], [PHONE], 10.0.0.256 [IP] [IP].5" and masked[2] is None and masked[13].startswith("[IBAN] iban and DE88")
    assert pii.find_pii(empty(spark)).count() == 0


def test_hash_of_words_is_a_hash_of_words():
    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(33, 255, rng.integers(1, 12)).astype(np.uint8)) for _ in range(3000)]
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    start, h = hash_words(data, data != 32)
    seen = {}
    for s, x in zip(start, h):
        w = bytes(data[s:]).split(b" ", 1)[0]
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    assert bytes(lower_ascii(np.frombuffer("AÉz".encode(), np.uint8))) == "aÉz".encode()


NEAR = [(500 + i, " ".join(f"t{j}" for j in range(300)) + (f" tail{i}" if i % 3 else "")) for i in range(40)] + [(500 + i, " ".join(f"t{j}" for j in range(i, 300 + i))) for i in range(40, 60)]


def near_texts():
    rng = random.Random(7)
    rows = list(TEXTS) + NEAR
    base = [f"b{rng.randint(0, 400)}" for _ in range(200)]
    for i in range(80):
        w = list(base)
        for _ in range(rng.randint(0, 14)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 9)}"
        rows.append((1000 + i, (" " if i % 2 else "\n").join(w).upper() if i % 5 == 0 else " ".join(w)))
    rows += [(2000, "a b"), (2001, "A  B"), (2002, "a b c"), (2003, "a")]
    return rows


@pytest.mark.parametrize("k, per_cent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, k, per_cent):
    rows = near_texts()
    want = brute.near_duplicates([r for r in rows if r[0] is not None], k, per_cent)
    got = neardup.near_duplicates(documents(spark, rows), neardup.Link(k, per_cent)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == ((want[r.doc_id]) if r.doc_id is not None else (r.n_shingles, None)), r
        assert r.kept == (r.doc_id == r.component_id if r.doc_id is not None else True)
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_sketches_estimate_and_merge():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    for share in (0.2, 0.5, 0.85, 0.95):
        n = round(3000 * 2 * share / (1 + share))
        b = np.concatenate([a[:n], rng.integers(0, 1 << 63, 3000 - n).astype(np.uint64)])
        j = n / (6000 - n)
        got = neardup.estimate(neardup.sketch(a)[None], neardup.sketch(b)[None], np.array([3000.0]), np.array([3000.0]))[0]
        assert abs(got - j) < 0.12
    assert (np.maximum(neardup.sketch(a[:1000]), neardup.sketch(a[1000:])) == neardup.sketch(a)).all()


def test_components(spark):
    rng = random.Random(1)
    edges = {tuple(sorted(rng.sample(range(300), 2))) for _ in range(200)} | {(1000 + i, 1001 + i) for i in range(50)}
    root = {}
    find = lambda x: x if root.get(x, x) == x else find(root[x])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = connected_components(spark.createDataFrame(sorted(edges), "a long, b long"), Scratch(spark)).collect()
    assert {(r.node, r.root) for r in got} == {(x, find(x)) for e in edges for x in e} and len(got) == len({x for e in edges for x in e})


def tokenizer():
    import public_tokenizers as p
    import tiktoken

    path = p.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return path, p.PATTERN, tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(spark):
    path, pattern, enc = tokenizer()
    texts = TEXTS + [(50, "it's  two\n\n spaces　\u0085x  y ١٢ ½ don'T"), (51, "\U00031350 ext h \U0001f600\U0001fae8 "), (52, "a" * 30_000), (53, "᠎​ x y"), (54, "<|endoftext|>")]
    df = bpe.decode_ids(bpe.encode_documents(documents(spark, texts), path, pattern), path)
    got = sorted((str(r.doc_id), list(r.ids), bytes(r.decoded)) for r in df.collect())
    assert got == sorted((str(d), enc.encode_ordinary(t or ""), (t or "").encode()) for d, t in texts)
    at_once = bpe.encode_documents(documents(spark, texts), path, pattern, decoded="bytes")
    assert sorted((str(r.doc_id), list(r.ids), bytes(r["bytes"])) for r in at_once.collect()) == got
    assert bpe.encode_documents(empty(spark), path, pattern).count() == 0
    bad = spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="vocabulary"):
        bpe.decode_ids(bad, path).collect()


def test_media(spark):
    df = media.feature(media.read_media(media.store_media(documents(spark))))
    got = sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in df.collect())
    want = [(str(d), len((t or "").encode()), len(p := media.payload_of((t or "").encode())), brute.sha(p), brute.crc(p[-64:])) for d, t in TEXTS]
    assert got == sorted(want)
    assert media.store_media(empty(spark)).count() == 0


def test_media_tables_and_broken_boxes():
    rng = random.Random(1)
    for frames in (1, 16, 17, 255, 256, 257, 512, 700):
        payload = rng.randbytes(64 * frames)
        data = media.store(payload)
        (t,) = media.inspect(data)
        assert media.read_back(data, t) == payload and t["codec"] == "raw " and t["duration"] == 64 * frames and t["samples"] == frames
        assert [data[a:b] for a, b in t["keyframes"].tolist()] == [payload[64 * i : 64 * i + 64] for i in range(0, frames, 16)]
    for cut in (5, len(data) - 3, len(data) // 2):
        with pytest.raises(ValueError):
            media.inspect(data[:cut])
    with pytest.raises(ValueError):
        media.store(b"x")
    wide = struct.pack(">I4sQ", 1, b"free", 24) + bytes(8) + struct.pack(">I4s", 0, b"free") + b"rest"
    assert [(p[-1], lo, hi) for p, lo, hi in media.walk(wide)] == [(b"free", 16, 24), (b"free", 32, 36)]


def test_sharding(spark):
    rows = documents(spark).select("doc_id", "text", F.col("shard").alias("slot"))
    x = sharding.shuffle(rows, 5, prefix="own_").collect()
    assert sorted((str(r.doc_id), str(r.text)[:20]) for r in x) == sorted((str(d), str(t)[:20]) for d, t in TEXTS)
    sizes = {}
    for r in x:
        sizes.setdefault(r.own_shard, []).append(r.own_slot)
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values()) and max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    assert sharding.shuffle(rows.limit(0), 5).count() == 0
    many = spark.range(20_000).repartition(7)
    got = sharding.shuffle(many, 8, seed=3)
    assert {r["count"] for r in got.groupBy("shard").count().collect()} == {2500}
    assert got.agg(F.corr("id", F.col("shard") * 2500 + F.col("slot"))).first()[0] == pytest.approx(0, abs=0.05)


def test_communication_matrix_has_its_margins():
    for counts, shards in (([5, 0, 12], 4), ([7] * 9, 3), ([1], 2)):
        before, sizes = np.cumsum([0, *counts]), sharding.shard_sizes(sum(counts), shards)
        m = [sharding.matrix_row(before, p, sizes, 1) for p in range(len(counts))]
        assert [int(v.sum()) for v in m] == counts and sum(m).tolist() == sizes.tolist() and min(map(min, m)) >= 0


@pytest.mark.parametrize("good, bad, n", [(30, 50, 20), (5, 400, 100), (1, 3, 2), (600, 2, 300)])
def test_large_hypergeometric_draws_follow_the_law(monkeypatch, good, bad, n):
    monkeypatch.setattr(sharding, "NUMPY_MOST", 0)
    rng = np.random.default_rng(9)
    got = np.bincount([sharding._hypergeometric(rng, good, bad, n) for _ in range(20_000)], minlength=n + 1) / 20_000
    want = np.array([math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) for k in range(n + 1)])
    assert np.abs(got - want).max() < 5 * 0.5 / 20_000**0.5
    monkeypatch.undo()
    draws = np.array([sharding._hypergeometric(rng, 10**11, 3 * 10**11, 4000) for _ in range(400)])
    assert abs(draws.mean() - 1000) < 5 * (750 / 400) ** 0.5 and abs(draws.var() / 750 - 1) < 0.4


def test_toxicity_learns_pairs_and_ignores_other_columns(spark):
    rng = random.Random(4)
    words = [f"n{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        w = rng.choices(words, k=30)
        a, b = rng.random() < 0.5, rng.random() < 0.5
        w += ["insultword"] * a + ["groupword"] * b
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(a and b)))  # neither word alone is toxic
    labels += [(None, 1), (5000, 1), (1, None)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train_on(docs, known)
    scored = toxicity.score_documents(docs.withColumn("score", F.lit("clash")), model).join(known, "doc_id").filter(toxicity.held_out(F.col("doc_id")))
    right, n = scored.agg(F.avg(((F.col("score") >= 0.5) == (F.col("toxic") == 1)).cast("int")), F.count("*")).first()
    assert right > 0.95 and n > 100
    got = toxicity.score_documents(documents(spark), model).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 for r in got)
    same = {r.score for r in got if not (r.text or "").strip()}
    assert len(same) == 1
    assert toxicity.score_documents(empty(spark), model).count() == 0
    nothing = toxicity.train_on(docs, known.limit(0))
    assert toxicity.score_documents(docs, nothing).agg(F.max("score")).first()[0] < 0.5


def test_chat_rotation(spark):
    turns = [(1, 0, "user", "hi <|end|>"), (1, 1, "assistant", "yo"), (1, 2, "system", None), (1, 1, "bob", ""), (1, 1, "bob", ""), (None, None, None, "x"), (2, 0, "system", "alone"), (3, 5, "user", "a"), (3, 200, "user", "b"), (3, 100, "bob", "c")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(1))
    got = chat.rotate(df).collect()
    assert len(got) == 3 * 5 + 1 + 2 * 3
    whole = {(r.conv_id, r.perspective): r for r in chat.render(chat.rotate(df)).collect()}
    text = whole[(1, "bob")].rendering
    assert text == "<|user name=user|>\nhi <\\|end|><|end|>\n<|user name=assistant|>\nyo<|end|>\n<|assistant|>\n<|end|>\n<|assistant|>\n<|end|>\n<|system|>\n<|end|>\n"
    for r in got:
        rendering = whole[(r.conv_id, r.perspective)].rendering
        assert rendering[r.start : r.end] == r.segment
        if r.chat_role == "assistant":
            assert rendering[r.learn_start : r.learn_end].endswith("<|end|>") and r.speaker == r.perspective
    assert [rendering.rendering for k, rendering in whole.items() if k == (3, "user")] == ["<|assistant|>\na<|end|>\n<|user name=bob|>\nc<|end|>\n<|assistant|>\nb<|end|>\n"]
    assert chat.rotate(df.limit(0)).count() == 0


def test_altered_copies_of_license_texts(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for i, (label, text) in enumerate(license_texts.TEXTS):
        w = text.split()
        kept = [x for x in w if rng.random() > 0.04] if len(w) > 60 else w  # lost words
        at = rng.randrange(len(kept))
        altered = kept[:at] + ["ACME", "Corp."] * (len(w) > 60) + kept[at:]  # and inserted ones
        rows += [(2 * i, "some file\n" * 30 + " ".join(altered) + " int main() {} " * 30), (2 * i + 1, " ".join(rng.sample(w, len(w))))]
        want[2 * i] = label
    got = {r.doc_id: r.labels for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = {x for x, _ in license_texts.TEXTS}
    assert all(label in got[i] for i, label in want.items()), [(x, got[i]) for i, x in want.items() if x not in got[i]]
    assert not any(texts & set(got[i]) for i in got if i % 2)  # the same words in another order
