import json

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import compare, dedupe, evaluate, quality, records, splits
from corpuslens.operators.components import connected_components
from corpuslens.sources import files
from corpuslens.streaming import state


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_components_of_chains_and_loops(spark):
    pairs = [("a", 1), ("b", 1), ("b", 2), ("c", 2), ("d", 3), (None, 3), ("e", None)] + [(f"n{i:03}", i // 2 + 10) for i in range(40)] + [(f"n{i:03}", (i + 1) // 2 + 10) for i in range(40)]
    got = dict(rows(connected_components(spark.createDataFrame(pairs, "node string, signal long")), "node"))
    assert got["a"] == got["b"] == got["c"] == "a" and got["d"] == "d" and {got[f"n{i:03}"] for i in range(40)} == {"n000"}


def sample_frame(spark, data):
    names = "row long, sample_id string, source_id string, source_path string, source_record_id string, file_sha256 string, normalized_text_sha256 string, text string, validation_status string"
    return spark.createDataFrame(data, names)


def test_families_by_different_signals(spark):
    df = sample_frame(spark, [
        (0, "s0", "a", "p0", "r1", "h0", "t0", "x", "ok"), (1, "s1", "a", "p1", "r1", "h1", "t1", "y", "ok"), (2, "s2", "b", "p2", None, "h1", "t2", "z", "ok"),
        (3, "s3", "b", "p3", None, "h3", "t9", "q", "ok"), (4, "s4", "b", "p4", None, None, "t9", "q", "ok"), (5, "s5", "c", "p5", "", "h5", None, None, "ok"),
    ])
    got = {r.row: (r.duplicate_state, r.duplicate_of, r.reason) for r in dedupe.classify_duplicates(df).collect()}
    assert got == {0: ("canonical", None, None), 1: ("duplicate", "s0", "duplicate_source_record"), 2: ("duplicate", "s0", "duplicate_file_hash"), 3: ("unique", None, None), 4: ("conflicting_duplicate", "s3", None), 5: ("unique", None, None)}
    raw = {r.row: r.duplicate_state for r in dedupe.raw_text_conflicts(dedupe.classify_duplicates(df)).collect()}
    assert raw[3] == "unique"  # one known hash only
    near = dedupe.apply_near_pairs(dedupe.classify_duplicates(df), spark.createDataFrame([("s3", "s5")], "a string, b string"))
    assert {r.row: (r.duplicate_state, r.duplicate_of) for r in near.collect()}[5] == ("duplicate", "s3")


def test_minhash_equals_plain_arithmetic(spark):
    texts = ["the quick brown fox jumps over the lazy dog and runs", "the quick brown fox jumps over the lazy dog and ran!", "short"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "sample_id string, value string")
    got = {r.id: r.signature for r in dedupe.minhash_signatures(df).collect()}
    assert set(got) == {"0", "1"}
    for i in ("0", "1"):
        grams = {dedupe._u64(texts[int(i)][k : k + 4]) for k in range(len(texts[int(i)]) - 3)}
        assert got[i] == [min((a * x + b) % dedupe.MERSENNE for x in grams) for a, b in dedupe._permutations()]


def test_near_text_pairs_of_large_groups(spark, monkeypatch):
    import random

    monkeypatch.setattr(dedupe, "BLOCK", 8)
    monkeypatch.setattr(dedupe, "GRAM_BLOCK", 16)
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    copy, base, other = (" ".join(word() for _ in range(60)) for _ in range(3))
    texts = [copy] * 25 + [base + f" {word()}" for _ in range(40)] + [copy + f" {word()}" for _ in range(3)] + [other, other, other + " end"] + [" ".join(word() for _ in range(40)) for _ in range(10)]
    texts += [" ".join(w if rng.random() > 0.04 else word() for w in base.split()) for _ in range(30)]
    rng.shuffle(texts)
    df = spark.createDataFrame([(f"s{i:03}", t) for i, t in enumerate(texts)], "sample_id string, value string")
    have = sorted((r.id, r.signature, {t[k : k + 4] for t in [texts[int(r.id[1:])]] for k in range(len(t) - 3)}) for r in dedupe.minhash_signatures(df).collect())
    width, want = dedupe.PERMUTATIONS // dedupe.BANDS, []
    for i, (a, x, g) in enumerate(have):
        for b, y, h in have[i + 1 :]:
            if any(x[k : k + width] == y[k : k + width] for k in range(0, len(x), width)) and len(g & h) / len(g | h) >= dedupe.REVIEW:
                want.append((a, b, round(len(g & h) / len(g | h), 9), "near" if len(g & h) / len(g | h) >= dedupe.NEAR else "review"))
    found = dedupe.near_text_pairs(df)
    assert sorted(r.b for r in found.where("level = 'copy'").collect()) == sorted(f"s{i:03}" for i, t in enumerate(texts) if t in texts[:i])
    got = [(r.a, r.b, round(r.jaccard, 9), r.level) for r in dedupe.expand_copies(found).orderBy("a", "b").collect()]
    assert got == want and len(want) > 300 + 40 * 39 // 2 and {x[3] for x in want} == {"near", "review"}
    assert dedupe.near_text_pairs(df.limit(0)).count() == 0


def test_near_text_pairs_store_less_than_a_copy_of_the_texts_per_pair(spark, monkeypatch):
    """60 unlike texts that share all buckets: what is stored grows with the texts, not with their 1770 candidates."""
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    alike = [word() for _ in range(300)]
    texts = [" ".join(word() for _ in range(300)) for _ in range(58)] + [" ".join(alike), " ".join(alike[:299] + [word()])]
    df = spark.createDataFrame([(f"s{i:03}", t) for i, t in enumerate(texts)], "sample_id string, value string")
    real, checkpoint, stored = dedupe.keyed_texts, type(df).checkpoint, []
    monkeypatch.setattr(dedupe, "keyed_texts", lambda *a: real(*a).withColumn("keys", F.array(*[F.lit(7).cast("long")] * dedupe.BANDS)))

    def counted(self, *a, **b):
        stored.append((out := checkpoint(self, *a, **b)).count())
        return out

    monkeypatch.setattr(type(df), "checkpoint", counted)
    grams = [{t[k : k + 4] for k in range(len(t) - 3)} for t in texts]
    assert [(r.a, r.b, round(r.jaccard, 9), r.level) for r in dedupe.near_text_pairs(df).collect()] == [("s058", "s059", round(len(grams[58] & grams[59]) / len(grams[58] | grams[59]), 9), "near")]
    assert max(stored) <= 60 * dedupe.BANDS and stored[-1] == 2


def test_forgotten_grams_change_no_signature(monkeypatch):
    import random

    rng = random.Random(6)
    texts = ["".join(rng.choices("abcdefgh\u4e00\u0644", k=80)) for _ in range(40)]
    known = dedupe._Grams(dedupe.SEED)
    monkeypatch.setattr(dedupe, "KNOWN_GRAMS", 100)
    for t in texts:
        codes = dedupe.gram_set(t)
        at = {int(c): t[k : k + 4] for k, c in enumerate(dedupe._gram_codes(dedupe._points(t)).tolist())}
        got = known.signature(known.rows(codes, codes % 2 == 0, lambda i: at[int(codes[i])]))
        assert got.tolist() == [min((a * dedupe._u64(g) + b) % dedupe.MERSENNE for g in at.values()) for a, b in dedupe._permutations()] and len(known.at) <= 100


def test_fingerprints_of_large_buckets(spark):
    df = spark.range(30).selectExpr("id", "id AS phash", "id * 7 AS dhash", "0L AS ahash", "'1:1' AS aspect")
    got = [(r.a, r.b) for r in dedupe.fingerprint_pairs(df, cap=4).orderBy("a", "b").collect()]
    assert got == [(a, b) for a in range(30) for b in range(a + 1, 30)]


def test_hamming_pairs_miss_nothing(spark):
    import random

    rng = random.Random(3)
    base = [rng.getrandbits(63) for _ in range(20)]
    codes = base + [b ^ sum(1 << i for i in rng.sample(range(63), 4)) for b in base]
    df = spark.createDataFrame(list(enumerate(codes)), "id long, code long")
    expected = sorted((i, j, (a ^ b).bit_count()) for i, a in enumerate(codes) for j, b in enumerate(codes) if i < j and (a ^ b).bit_count() <= 5)
    assert rows(dedupe.close_codes(df, 5), "a", "b") == expected and len(expected) >= 20


def test_fingerprints(spark):
    df = spark.createDataFrame([("a", 0, 0, 0, "1:1"), ("b", 7, 7, 7, "1:1"), ("c", 0, 0, 0, "4:3"), ("d", (1 << 14) - 1, 0, 0, "1:1")], "id string, phash long, dhash long, ahash long, aspect string")
    assert [(r.a, r.b, r.level) for r in dedupe.fingerprint_pairs(df).orderBy("a", "b").collect()] == [("a", "b", "CONFIRMED"), ("a", "d", "CANDIDATE"), ("b", "d", "LIKELY")]


def test_splits_are_stable_and_sticky(spark):
    names = "sample_id string, source_id string, group_id string, document_id string, source_record_id string, file_sha256 string, normalized_text_sha256 string, duplicate_of string, validation_status string, target_split string"
    data = [("a", "s", None, "d1", None, "h1", "t1", None, "ok", "test"), ("b", "s", None, "d2", None, "h1", "t2", None, "ok", "unassigned"), ("c", "s", None, "d3", None, "h3", "t3", "b", "ok", "unassigned"), ("d", "s", None, "d9", None, "h9", "t9", None, "error", "train")]
    got = {r.sample_id: r.target_split for r in splits.assign_splits(spark.createDataFrame(data, names), 1).collect()}
    assert got == {"a": "test", "b": "test", "c": "test", "d": "unassigned"}
    with pytest.raises(ValueError):
        splits.boundaries({"train": 0.9, "validation": 0.2, "test": 0.0, "holdout": 0.0})


def test_leakage_and_policy(spark):
    names = "sample_id string, source_id string, partition string, malformed boolean, file_sha256 string, document_id string, page_id string, normalized_text_sha256 string, transformations array<string>, group_key string"
    h = "a" * 64
    data = [("a", "s", "TRAIN", False, h, "d", "1", "t", ["blur"], "g"), ("b", "s", "EVAL", False, h, "d", "2", "t", [], "g2"), ("c", "s", "PROTECTED", True, "bad", "e", "1", None, [], "g")]
    found = {(r.kind, r.severity, tuple(r.sample_ids)) for r in quality.detect_leakage(spark.createDataFrame(data, names), near_texts=spark.createDataFrame([("a", "b"), ("a", "zz")], "a string, b string")).collect()}
    assert found == {
        ("malformed_protection", "critical", ("c",)), ("exact_hash_cross_split", "critical", ("a", "b")), ("derived_page_cross_boundary", "critical", ("a", "b")), ("group_straddle", "critical", ("a", "c")), ("near_text_cross_split", "critical", ("a", "b")),
    }


def test_compare_and_recommend(spark):
    mk = lambda cers: spark.createDataFrame([(f"s{i}", c, 0.0, 0.0) for i, c in enumerate(cers)], "sample_id string, cer double, wer double, ncer double")
    got = [r.classification for r in compare.compare_runs(mk([0.4, 0.2, 0.3, 0.3, 0.9]), mk([0.2, 0.4, 0.32, 0.55, 0.1])).orderBy("sample_id").collect()]
    assert got == ["improved", "regressed", "unchanged", "newly_failed", "recovered"]
    ranked = spark.createDataFrame([(f"s{i}", i + 1, "xy"[i % 2]) for i in range(9)], "sample_id string, rank long, group string")
    place = lambda s, **k: [r.sample_id for r in compare.recommend(ranked, s, 4, **k).orderBy("place").collect()]
    assert place("hardest_only") == ["s0", "s1", "s2", "s3"] and place("balanced_hard") == ["s0", "s1", "s2", "s3"]
    assert place("mixed_curriculum") == ["s0", "s1", "s2", "s3"] and place("hardest_only", history=ranked.limit(0)) == ["s0", "s1", "s2", "s3"]
    with pytest.raises(ValueError):
        compare.recommend(ranked, "other", 1)


def test_ranked_is_a_total_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    for n in (1, 4, 17):
        got = compare.ranked(df.repartition(n), [F.col("v")])
        assert sorted((r.v, r.rank) for r in got.collect()) == [(i, i + 1) for i in range(1000)]


def test_batches_and_shards(spark):
    df = spark.createDataFrame([(f"s{i:02}", 10) for i in range(25)], "sample_id string, size long")
    assert [len(r.sample_ids) for r in records.batches(df, [F.col("sample_id")], 10).orderBy("batch").collect()] == [10, 10, 5]
    assert [r["count"] for r in records.size_shards(df, [F.col("sample_id")], "size", 100).groupBy("shard").count().orderBy("shard").collect()] == [10, 10, 5]
    shuffled = records.bounded_shuffle(df.coalesce(1), 5, 1)
    assert sorted(r.sample_id for r in shuffled.collect()) == [f"s{i:02}" for i in range(25)]


def test_append_once_and_upsert(spark):
    store = spark.createDataFrame([("a", "x", 1)], "k string, v string, at long")
    fresh, clash = records.append_once(store, spark.createDataFrame([("a", "x", 9), ("b", "y", 9), ("a", "z", 9)], "k string, v string, at long"), ["k"], ["at"])
    assert rows(fresh, "k") == [("b", "y", 9)] and rows(clash, "k") == [("a", "z", 9)]
    have = spark.createDataFrame([("a", "x", 1)], "k string, content string, version int")
    new = spark.createDataFrame([("a", "y"), ("b", "z")], "k string, content string")
    assert rows(records.upsert(have, new, "k", "version_new"), "k", "version") == [("a", "x", 1), ("a", "y", 2), ("b", "z", 1)]
    assert rows(records.upsert(have, new, "k", "overwrite"), "k") == [("a", "y", 1), ("b", "z", 1)]
    with pytest.raises(Exception, match="taken"):
        records.upsert(have, new, "k", "reject").collect()


def test_sources(spark, tmp_path):
    for name, body in {"a/x-p1.png": "1", "a/x-p1.txt": "text", "a/lonely.txt": "t", "a/.hidden/y.png": "2", "b/Thumbs.db": "3"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    found = files.scan(spark, str(tmp_path))
    assert rows(found.select("rel_path", "kind"), "rel_path") == [("a/lonely.txt", "text"), ("a/x-p1.png", "image"), ("a/x-p1.txt", "text")]
    got = files.pair_sidecars(found, orphans=True).select("document", "page", "image_path", "text_path")
    assert rows(got, "document") == [("lonely", None, None, "a/lonely.txt"), ("x", 1, "a/x-p1.png", "a/x-p1.txt")]
    lines = ['{"text": "a", "id": "1"}', "{broken", '{"a": 1, "a": 2}', ""]
    (tmp_path / "r.jsonl").write_text("\n".join(lines))
    drafts = files.record_drafts(files.read_records(spark, str(tmp_path / "r.jsonl")))
    assert {(r.text, r.record_id, r.problem) for r in drafts.collect()} == {("a", "1", None), (None, None, "malformed"), (None, None, "repeated_key")}


def test_manifest_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("s", "p2", "b", 2), ("s", "p1", "a", 1)], "source_id string, source_path string, sample_id string, n long")
    files.write_manifest(df, str(tmp_path / "m"), "d", "1")
    head, body = files.read_manifest(spark, str(tmp_path / "m"), df.schema)
    assert rows(head, "row_count") == [(2, "d", "1")] and rows(body, "sample_id") == [("s", "p1", "a", 1), ("s", "p2", "b", 2)]
    assert files.manifest_problems(head, body).count() == 0 and files.manifest_problems(head, body.limit(1)).count() == 1


def test_strict_json(spark):
    df = spark.createDataFrame([(0, '{"a": {"b": 1, "b": 2}}'), (1, '{"a": 1}'), (2, "[1]")], "i long, t string")
    assert [r.v for r in df.select("i", files.strict_json("t").alias("v")).orderBy("i").collect()] == [False, True, False]


def test_quota_and_breaker_folds():
    admitted, held = state.admit([0, 1, 2, 10, 11], [], 2, 5)
    assert admitted == [True, True, False, True, True] and held == [10, 11]
    states, end = state.breaker([(0, True), (1, True), (2, False), (20, False), (21, True)], ("CLOSED", 0, 0, 0), 2, 10, 15)
    assert states == ["CLOSED", "OPEN", "OPEN", "CLOSED", "CLOSED"] and end[:2] == ("CLOSED", 1)


def test_stream_equals_batch(spark, sf, tmp_path):
    one = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    one.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(one.schema).parquet(str(tmp_path / "in"))
    fold = state.quota_fold(2, 86_400)
    got = state.run_once(state.stream(source, "user_id", fold), str(tmp_path / "c1"), "quota")
    assert rows(got.select("event_id", "admitted"), "event_id") == rows(state.batch(one, "user_id", fold).select("event_id", "admitted"), "event_id")
    counts = state.run_once(state.windowed_counts(source, "1 day"), str(tmp_path / "c2"), "counts", "complete")
    assert counts.agg(F.sum("events")).first()[0] == one.count()
    query = state.append_stream(source, str(tmp_path / "out"), str(tmp_path / "c3"), ["event_id"], []).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == one.count()


def test_evaluation_dimensions_agree(spark):
    df = spark.createDataFrame([("a", "x", 0.1, 0.2, 0.1, 1, 0), ("b", None, 0.5, 0.4, 0.5, 0, 0)], "m string, p string, cer double, wer double, ncer double, exact int, empty int")
    got = {(r.dimension, r.value): r.pages for r in evaluate.by_each_dimension(df, ["m", "p"]).collect()}
    assert got == {("overall", "all"): 2, ("m", "a"): 1, ("m", "b"): 1, ("p", "x"): 1, ("p", "unspecified"): 1}


def test_export_rows(spark):
    x = files.union_of_keys(spark.createDataFrame([(1, [1, 2])], "a long, b array<int>"), spark.createDataFrame([("z",)], "c string"))
    assert sorted(json.dumps(r.asDict(), sort_keys=True) for r in x.collect()) == ['{"a": "1", "b": "[1,2]", "c": null}', '{"a": null, "b": null, "c": "z"}']


def test_more_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "1", "label": "x"}, {"id": "2", "text": "y"}]')
    (tmp_path / "b.jsonl").write_text('{"id": "3", "transcription": "z"}\n{bad\n')
    got = {(r.record_id, r.text, r.problem) for r in files.read_samples(spark, str(tmp_path)).collect()}
    assert got == {("1", "x", None), ("2", "y", None), ("3", "z", None), (None, None, "malformed")}
    new, known = spark.createDataFrame([("f1", "c1"), ("f2", "c2"), ("f3", "c2")], "id string, checksum string"), spark.createDataFrame([("k", "c1")], "id string, checksum string")
    assert {r.id: r.duplicate_of for r in files.register(new, known).collect()} == {"f1": "k", "f2": None, "f3": "f2"}
    runs = spark.createDataFrame([("r", '{"model": {"id": "m", "base": "b"}, "status": "done"}')], "run_id string, raw string")
    assert files.model_records(runs).first()["base_model"] == "b"
    with pytest.raises(ValueError):
        files.only_split(new, "Holdout ")
    with pytest.raises(Exception, match="protected"):
        files.assert_safe(new, F.col("id") == "f1").collect()
    safe, counts = files.split_protected(new, F.col("id") == "f1")
    assert safe.count() == 2 and tuple(counts.first()) == (2, 1)
    prev = spark.createDataFrame([("a", 1, 5, "h1")], "rel_path string, size long, modified long, sha256 string")
    cache = spark.createDataFrame([("b", 1, 5, "c" * 64, 1), ("b", 1, 5, "d" * 64, 2), ("b", 1, 5, "junk", 3)], "rel_path string, size long, modified long, sha256 string, seq long")
    listed = spark.createDataFrame([("a", 1, 5), ("b", 1, 5), ("a2", 1, 5)], "rel_path string, size long, modified long")
    assert {r.rel_path: (r.sha256, r.origin) for r in files.reuse_digests(listed, prev, cache).collect()} == {"a": ("h1", "index"), "b": ("d" * 64, "cache"), "a2": (None, "hash")}
