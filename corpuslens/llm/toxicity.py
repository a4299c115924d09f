"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its words and their beginnings of PREFIXES bytes, hashed to 2**BITS places, once for each of
LEVELS that their count reaches, and the size of the text. The machine adds to a linear score the inner products of
the terms' factors, so it learns what two terms mean together (two insults, an insult and a group) as well.

Learning takes a bounded sample of labelled rows: at most SAMPLE[label] of each label, those of the smallest hash of
doc_id, weighted to the labels' true numbers, which are counted over all rows. Rows whose crc32(doc_id) mod FOLDS is 0
are held out. Scoring reads every whole text; labels, lang, source and doc_id are no inputs of a score.

Defined results: null and empty texts get the score of a text without words. Rows with null labels or doc_ids teach
nothing; of several labels of a doc_id the largest counts, of its several texts the smallest one teaches. Without any
labelled row of one kind, the score is the smoothed share of toxic rows. Each row of the input gives one row, and equal
texts have equal scores, whatever stands beside them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.llm.common import bound_batches, hash_slices, lower_ascii, mix, slices, text_buffer

BITS, PREFIXES, LEVELS, SIZES = 20, (5, 7), (1, 2, 4), 24
SAMPLE, FOLDS = {0: 4000, 1: 2000}, 5
#: Terms that are kept (those that tell most), factors of each, passes over the sample, step and decay of learning.
TERMS, FACTORS, PASSES, RATE, DECAY, BATCH = 2048, 8, 12, 0.05, 2e-4, 64
#: Least log likelihood ratio of a term that is kept, so that a small sample does not fill the machine with chance.
LEAST_TOLD = 6.0
PIECE = 1 << 18


@dataclass(frozen=True)
class Model:
    terms: np.ndarray  # sorted places of the kept terms
    bias: float
    weights: np.ndarray
    factors: np.ndarray


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def _place(base: np.ndarray, level: int) -> np.ndarray:
    return ((base * np.uint64(2 * level + 1)) >> np.uint64(64 - BITS)).astype(np.int64)


def _terms(column, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the distinct terms of each text of an Arrow column, by row; with keep, a mask of places, only of those."""
    sizes = np.asarray(pa.compute.binary_length(column).fill_null(0), np.int64)
    rows, places = [], []
    for lo, hi in slices(sizes, PIECE):
        data, starts = text_buffer(column.slice(lo, hi - lo))
        data = lower_ascii(data)
        is_word = ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57)) | (data >= 128)
        edge = np.flatnonzero(np.diff(np.concatenate(([False], is_word, [False])).view(np.int8)))
        start, end = edge[::2], edge[1::2]
        row = np.searchsorted(starts, start, side="right") - 1
        count = np.bincount(row, minlength=hi - lo)
        rows.append(np.arange(hi - lo) + lo)
        places.append(_place(mix(np.floor(np.log2(count + 1)).clip(0, SIZES).astype(np.uint64) + np.uint64(1)), 0))
        for kind, end_ in enumerate((end, *(np.minimum(start + p, end) for p in PREFIXES))):
            if not len(start):
                continue
            # sorted by row and hash, runs are the terms and their lengths the counts
            h = mix(hash_slices(data, start, end_) + np.uint64(1 + kind))
            r = row
            if keep is not None:
                some = np.zeros(len(h), bool)
                for level in LEVELS:
                    some |= keep[_place(h, level)]
                h, r = h[some], row[some]
            order = np.lexsort((h, r))
            h, r = h[order], r[order]
            first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])))) if len(h) else np.empty(0, np.int64)
            n = np.diff(np.append(first, len(h)))
            for level in LEVELS:
                at = first[n >= level]
                rows.append(r[at] + lo)
                places.append(_place(h[at], level))
    row, place = np.concatenate(rows or [np.empty(0, np.int64)]), np.concatenate(places or [np.empty(0, np.int64)])
    if keep is not None:
        row, place = row[keep[place]], place[keep[place]]
    both = np.unique(row << BITS | place)
    return both >> BITS, both & ((1 << BITS) - 1)


def _sample_terms(batches):
    for batch in batches:
        row, place = _terms(batch.column("text"))
        cut = np.searchsorted(row, np.arange(len(batch) + 1))
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([place[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())], ["toxic", "terms"])


def train_on(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> Model:
    """Learns from the rows of labels (doc_id, toxic) that are not held out, and their texts in docs."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    count = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    taken = [known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in sample.items()]
    taken = taken[0].unionByName(taken[1]).withColumnRenamed("doc_id", "label_id")
    texts = docs.select("doc_id", "text").join(F.broadcast(taken), F.col("doc_id") == F.col("label_id"))
    texts = texts.groupBy("label_id").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text")).select("toxic", "text")  # a row per label, so sum(sample) at most
    got = texts.mapInArrow(_sample_terms, "toxic int, terms binary").toArrow().to_pydict()
    # sorted, for the same model whatever the order of the rows
    pairs = sorted(zip(got["toxic"], got["terms"]))
    return _learn(np.array([y for y, _ in pairs], np.int64), [np.frombuffer(x, np.int32) for _, x in pairs], count)


def _learn(y: np.ndarray, examples: list[np.ndarray], count: dict[int, int]) -> Model:
    ones, zeros = count.get(1, 0), count.get(0, 0)
    prior = math.log((ones + 0.5) / (zeros + 0.5)) if ones + zeros else math.log(0.01)
    none = Model(np.empty(0, np.int64), prior, np.empty(0), np.empty((0, FACTORS)))
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    if not n1 or not n0:
        return none
    # terms that tell most: the likelihood ratio of their document frequencies
    d1, d0 = (np.bincount(np.concatenate([x for x, z in zip(examples, y) if z == k]), minlength=1 << BITS).astype(float) for k in (1, 0))
    both = d1 + d0
    p, p1, p0 = both / (n1 + n0), d1 / n1, d0 / n0

    def part(d, n, q):
        return d * np.log(np.maximum(q, 1e-12)) + (n - d) * np.log(np.maximum(1 - q, 1e-12))

    tells = np.where(both >= 3, part(d1, n1, p1) + part(d0, n0, p0) - part(d1, n1, p) - part(d0, n0, p), 0)
    terms = np.sort(np.argsort(-tells, kind="stable")[:TERMS])
    terms = terms[tells[terms] >= LEAST_TOLD]
    if not len(terms):
        return none
    place = np.full(1 << BITS, -1, np.int64)
    place[terms] = np.arange(len(terms))
    rows = [place[x][place[x] >= 0] for x in examples]
    weight = np.where(y == 1, ones / n1, zeros / n0)
    weight = weight / weight.mean()
    rng = np.random.Generator(np.random.PCG64(5))
    w, v, bias = np.zeros(len(terms)), rng.normal(0, 0.02, (len(terms), FACTORS)), prior
    gw, gv, gb = np.full(len(terms), 1e-6), np.full(v.shape, 1e-6), 1e-6
    for _ in range(PASSES):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            flat = np.concatenate([rows[i] for i in pick])
            owner = np.repeat(np.arange(len(pick)), [len(rows[i]) for i in pick])
            score, total = _scores(flat, owner, len(pick), bias, w, v)
            error = weight[pick] * (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y[pick]) / len(pick)
            dw = np.bincount(flat, error[owner], len(terms)) + DECAY * w
            each = error[owner, None] * (total[owner] - v[flat])
            dv = np.stack([np.bincount(flat, each[:, f], len(terms)) for f in range(FACTORS)], axis=1) + DECAY * v
            gw, gv, gb = gw + dw**2, gv + dv**2, gb + error.sum() ** 2
            w, v, bias = w - RATE * dw / np.sqrt(gw), v - RATE * dv / np.sqrt(gv), bias - RATE * error.sum() / math.sqrt(gb)
    return Model(terms, bias, w, v)


def _scores(flat, owner, n, bias, w, v):
    """Linear part and half of (sum of factors)**2 - sum of squares, for each of n texts; and the sums of factors."""
    total, squares = np.zeros((n, v.shape[1])), np.zeros(n)
    for f in range(v.shape[1]):
        total[:, f] = np.bincount(owner, v[flat, f], n)
    squares = np.bincount(owner, (v**2).sum(axis=1)[flat], n)
    return bias + np.bincount(owner, w[flat], n) + ((total**2).sum(axis=1) - squares) / 2, total


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """docs with column score, the estimated probability of a toxic label; a column of that name is replaced."""
    bound_batches(docs.sparkSession)
    docs = docs.drop("score")
    names = docs.columns

    def run(batches):
        keep = np.zeros(1 << BITS, bool)
        keep[model.terms] = True
        for batch in batches:
            row, place = _terms(batch.column(names.index("text")), keep)
            score, _ = _scores(np.searchsorted(model.terms, place), row, len(batch), model.bias, model.weights, model.factors)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(score, -30, 30))), pa.float64())], [*names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
