"""Queries without SQL against plain recomputation: the pipeline from end to end, stored media, slots of shards."""

import struct

import numpy as np
import pytest

import corpus_pipeline
from corpuslens.llm import media, queries, toxicity
from tests.llm import brute
from tests.llm.test_masking import masked
from tests.llm.test_operators import tokenizer
from tests.llm.test_scale_paths import plain_terms


def documents(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def plain_scores(spark, sf, texts):
    model = toxicity.train_on(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    place, out = {int(t): i for i, t in enumerate(model.terms)}, {}
    for doc, text in texts.items():
        mine = np.array([place[t] for t in sorted(plain_terms(text)) if t in place], int)
        pairs = sum(float(model.factors[i] @ model.factors[j]) for a, i in enumerate(mine) for j in mine[a + 1 :])
        out[doc] = 1 / (1 + np.exp(-(model.bias + model.weights[mine].sum() + pairs)))
    return out


def test_pipeline_equals_its_stages_in_plain_python(spark, sf):
    texts = documents(spark, sf)
    scores = plain_scores(spark, sf, texts)
    kept = {d: t for d, t in texts.items() if scores[d] < 0.5}
    near = brute.near_duplicates(sorted(kept.items()), 5, 80)
    kept = {d: t for d, t in kept.items() if near[d][1] == d}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = {x[0] for x in brute.contamination(sorted(kept.items()), bench) if x[5]}
    _, _, enc = tokenizer()
    want = {d: enc.encode_ordinary(masked(t) or "") for d, t in kept.items() if d not in hit}
    got = {r.doc_id: (r.n_tokens, list(r.ids)) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == {d: (len(x), x) for d, x in want.items()} and 0 < len(got) < len(texts)


def test_toxicity_query_equals_plain_scores(spark, sf):
    texts = documents(spark, sf)
    want = plain_scores(spark, sf, texts)
    for r in queries.op6_toxicity(spark, sf).collect():
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-9) and r.predicted == int(r.score >= 0.5) and r.held_out == (brute.crc(str(r.doc_id).encode()) % 5 == 0)


def boxes(data):
    """The top boxes of a container: kind -> body."""
    out, at = {}, 0
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        out[kind] = data[at + 8 : at + size]
        at += size
    return out


def test_media_query_against_the_stored_bytes(spark, sf):
    texts = documents(spark, sf)
    stored = {r.doc_id: bytes(r.media) for r in media.store_media(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    rows = queries.op2_media_columns(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw, data = (texts[r.doc_id] or "").encode(), stored[r.doc_id]
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        top = boxes(data)
        assert list(top) == [b"ftyp", b"mdat", b"moov"] and top[b"mdat"] == payload
        first, n = data.index(payload), len(payload) // 64
        last = (n - 1) // 16 * 16
        assert r.feature == f"codec=raw;rate=8000;duration={64 * n};samples={n};keys={-(-n // 16)};first={first}-{first + 64};last={first + 64 * last}-{first + 64 * last + 64}"
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), brute.sha(payload), brute.crc(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(data), brute.sha(data))


def test_sharding_query_has_gapless_slots_and_repeats_itself(spark, sf):
    rows = queries.op9_sharding(spark, sf).collect()
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert sorted(map(len, shards.values())) == sorted(len(rows) // 40 + (i < len(rows) % 40) for i in range(40))
    again = {r.doc_id: (r.shard, r.slot) for r in queries.op9_sharding(spark, sf).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in rows}  # one seed, one partitioning: one assignment
    by_id = sorted((r.doc_id, r.shard) for r in rows)
    assert abs(np.corrcoef(np.array(by_id).T)[0, 1]) < 0.3
