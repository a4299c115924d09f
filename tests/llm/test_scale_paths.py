"""The paths that only large inputs take, entered by small constants: blocks, pieces, chunks, slices, shuffled instead of broadcast sides."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import bpe, decontam, media, neardup, sharding, toxicity
from corpuslens.llm.common import hash_slices, mix
from tests.llm import brute
from tests.llm.test_operators import BENCH, TEXTS, documents, near_texts, tokenizer


@pytest.mark.parametrize("bits, most", [(1 << 26, 0), (64, 500_000), (1 << 10, 0)])
def test_decontamination_without_broadcasts_and_with_a_coarse_sieve(spark, monkeypatch, bits, most):
    monkeypatch.setattr(decontam, "SIEVE_BITS", bits)
    monkeypatch.setattr(decontam, "BROADCAST_DOCS", most)
    rng = random.Random(bits + most)
    docs = TEXTS + [(100 + i, " ".join(rng.choices("abcd", k=rng.randint(0, 60)))) for i in range(40)]
    bench = BENCH + [(100 + i, " ".join(rng.choices("abcd", k=rng.randint(0, 14)))) for i in range(12)]
    got = sorted(((r.doc_id, r.n_words, r.n_hit, len(r["items"]), brute.sha(",".join(r["items"])), r.contaminated) for r in decontam.decontaminate(documents(spark, docs), spark.createDataFrame(bench, "item_id long, text string")).collect()), key=str)
    assert got == sorted(brute.contamination(docs, bench), key=str)


@pytest.mark.parametrize("block, fan, shingles, ids, piece", [(7, 3, 900, 0, 64), (2, 1, 10**9, 10**6, 1 << 18)])
def test_near_duplicates_in_small_blocks(spark, monkeypatch, block, fan, shingles, ids, piece):
    for name, value in {"BLOCK": block, "CLUSTER": block, "FAN": fan, "SHINGLES": shingles, "IDS": ids, "PIECE": piece}.items():
        monkeypatch.setattr(neardup, name, value)
    rows = [r for r in near_texts() if r[0] is not None]
    want = brute.near_duplicates(rows, 5, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(documents(spark, rows)).collect()}
    assert got == want


@pytest.mark.parametrize("chunk, piece", [(1, 1), (400, 50)])
def test_bpe_in_many_chunks(spark, monkeypatch, chunk, piece):
    monkeypatch.setattr(bpe, "CHUNK", chunk)
    monkeypatch.setattr(bpe, "PIECE", piece)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        path, pattern, enc = tokenizer()
        texts = TEXTS + [(50 + i, "the same words in every chunk") for i in range(9)] + [(None, "")] * 5
        for stored in (False, True):
            got = sorted((str(r.doc_id), list(r.ids)) for r in bpe.encode_documents(documents(spark, texts), path, pattern, stored=stored).collect())
            assert got == sorted((str(d), enc.encode_ordinary(t or "")) for d, t in texts)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("slice_", [1, 13])
def test_sharding_in_many_slices(spark, monkeypatch, slice_):
    monkeypatch.setattr(sharding, "SLICE", slice_)
    rows = [(i, None if i % 7 == 0 else "x" * (i % 5)) for i in range(300)] + [(None, None)] * 3
    got = sharding.shuffle(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 7).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(a), str(b)) for a, b in rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(map(len, slots.values())) == sorted(sharding.shard_sizes(303, 7).tolist())


def test_wide_boxes_of_payloads_over_four_gigabytes(monkeypatch):
    """The head of a container whose payload passes 2**32 bytes, with a payload that claims its length and holds nothing."""

    class Claimed(bytes):
        size = 0

        def __len__(self):
            return self.size

    payload = Claimed(b"")
    payload.size = (1 << 32) + 64
    real = media._box

    def box(kind, *body):  # mdat is too large to be built
        return struct.pack(">I4sQ", 1, kind, payload.size + 16) if kind == b"mdat" else real(kind, *body)

    monkeypatch.setattr(media, "_box", box)
    data = media.store(payload)
    head = data.index(b"mdat") + 12
    movie = data[head:]
    (t,) = [x for x in media.inspect(movie)]
    frames = payload.size // media.FRAME
    assert t["samples"] == frames and t["duration"] == payload.size and b"co64" in movie and b"stco" not in movie
    first, last = t["keyframes"][0].tolist(), t["keyframes"][-1].tolist()
    key = (frames - 1) // media.KEY * media.KEY
    assert first == [head, head + media.FRAME] and last == [head + key * media.FRAME, head + (key + 1) * media.FRAME]


def plain_terms(text):
    """The places of a text's terms, from words and sets."""
    words, out = [w.encode() for w in brute.words(text)], set()
    size = min(int(np.floor(np.log2(len(words) + 1))), toxicity.SIZES)
    out.add(int(toxicity._place(mix(np.array([size + 1], np.uint64)), 0)[0]))
    for kind, cut in enumerate((None, *toxicity.PREFIXES)):
        for w in {w[:cut] for w in words}:
            n = sum(x[:cut] == w for x in words)
            h = mix(hash_slices(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)])) + np.uint64(1 + kind))
            out |= {int(toxicity._place(h, level)[0]) for level in toxicity.LEVELS if n >= level}
    return out


def test_toxicity_score_is_that_of_the_text_alone(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = ["clown", "you", "bad", "idiotic", "ünïcode", "x", "aaaaaaaaaaaaaaaaaaaaaaaa", "groupwordlong", "groupword", "insult"]
    rows = [(i, rng.choice([" ", "\n", "-"]).join(rng.choices(vocabulary, k=rng.randint(0, 12)))) for i in range(400)]
    labels = [(i, int("insult" in t and "group" in t)) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train_on(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    monkeypatch.setattr(toxicity, "PIECE", 16)
    place = {int(t): i for i, t in enumerate(model.terms)}
    assert len(place) > 5
    for r in toxicity.score_documents(docs, model).collect():
        mine = [place[t] for t in sorted(plain_terms(r.text)) if t in place]
        score = model.bias + sum(model.weights[i] for i in mine) + sum(float(model.factors[i] @ model.factors[j]) for a, i in enumerate(mine) for j in mine[a + 1 :])
        assert r.score == pytest.approx(1 / (1 + np.exp(-score)), abs=1e-9), r.text


def test_labels_of_repeated_rows_teach_once(spark):
    docs = spark.createDataFrame([(i % 10, f"w{i % 10} good" if i % 2 else f"w{i % 10} bad") for i in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, toxic int")
    once = toxicity.train_on(docs.dropDuplicates(["doc_id"]), labels)
    many = toxicity.train_on(docs, labels)
    assert (once.terms == many.terms).all() and once.bias == many.bias and (once.weights == many.weights).all()


def test_scratch_tables_are_on_the_list_of_what_the_driver_deletes(spark):
    from corpuslens.llm.common import Scratch

    scratch = Scratch(spark)
    table = scratch.table(spark.range(10))
    assert table.count() == 10
    root, fs = scratch._place(scratch.root)
    assert fs.exists(root) and fs.cancelDeleteOnExit(root)  # true: it was on the list
    fs.delete(root, True)


def test_hot_conversation_rows(spark):
    from corpuslens.llm import chat

    rows = [(None, 0, f"p{i % 40}", f"t{i}") for i in range(200)]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).groupBy("perspective").agg(F.count("*").alias("n"), F.max("end").alias("e")).collect()
    assert {(r.n) for r in got} == {200} and len(got) == 40
