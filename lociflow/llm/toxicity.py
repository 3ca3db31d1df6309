"""Toxicity: a factorization machine over hashed terms.

A document's terms are its distinct lower-cased words without ASCII punctuation at their ends, and their first five
letters. Terms are hashed to 2 ** bits buckets. Those whose presence depends on the label in the training sample (chi
squared of at least `least_chi`, the `terms` highest) are the model's inputs; to the linear weights it adds, for each
pair of terms in a text, the product of their learned vectors, so that an insult counts more beside the mention of a
group than each weighs alone.

It is fitted on at most about `most_rows` labelled rows (a documented bound: those of the lowest hash of their
doc_id), which are read, hashed and counted as Spark jobs; what comes to the driver is bounded by most_rows * terms
places. Every document is scored, whole.

Edge cases: a null or empty text has no terms and scores the model's bias. Of several labels of one doc_id the highest
counts; null labels, and any but 0 and 1, don't. Of several rows of one doc_id the one of least text hash is fitted on. Without training rows, or with one class only, every score is the share of label 1 (0 if
none). Rows with a null doc_id have no label and are scored. Repeated rows score alike. Extra columns are kept; toxicity()
replaces those with the name of a result column, clean() hands them on. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored
from .words import CACHE, blocks, texts

EDGE = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
RESULT = ("held_out", "score", "predicted")


@dataclass(frozen=True)
class Settings:
    most_rows: int = 40_000
    bits: int = 20
    terms: int = 4096
    least_chi: float = 25.0
    factors: int = 8
    epochs: int = 30
    rate: float = 0.1
    decay: float = 1e-5
    threshold: float = 0.3
    seed: int = 7


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def word_terms(word: bytes, bits: int) -> tuple[int, ...]:
    """The buckets of a word: its own, and that of its first five letters."""
    word = word.strip(EDGE)
    if not word:
        return ()
    shift = 64 - bits
    head = word.decode("utf-8", "ignore")[:5].encode()
    return xxhash.xxh3_64_intdigest(word) >> shift, xxhash.xxh3_64_intdigest(head, 1) >> shift


class Terms(dict):
    """Buckets by word, or places in a table of buckets; forgets all when full."""

    def __init__(self, bits: int, places: dict[int, int] | None = None):
        super().__init__()
        self.bits, self.places = bits, places

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        found = word_terms(word, self.bits)
        if self.places is not None:
            found = tuple(self.places[x] for x in found if x in self.places)
        self[word] = found
        return found


def _of_text(text: bytes, terms: Terms) -> set[int]:
    found: set[int] = set()
    for x in map(terms.__getitem__, set(text.lower().split())):
        if x:
            found.update(x)
    return found


def _count(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    terms = Terms(bits)
    counts = np.zeros((2, 1 << bits), np.int32)
    for block in blocks(batches):
        for text, label in zip(texts(block), block.column("label").to_pylist()):
            found = _of_text(text, terms)
            counts[label, np.fromiter(found, np.int64, len(found))] += 1
    at = np.flatnonzero(counts.any(axis=0))
    yield pa.record_batch({"term": at.astype(np.int64), "n0": counts[0, at].astype(np.int64), "n1": counts[1, at].astype(np.int64)})


def _places(batches: Iterator[pa.RecordBatch], bits: int, places: dict[int, int]) -> Iterator[pa.RecordBatch]:
    terms = Terms(bits, places)
    for block in blocks(batches):
        yield pa.record_batch([pa.array([sorted(_of_text(t, terms)) for t in texts(block)], pa.list_(pa.int32())), block.column("label"), block.column("turn")], names=["terms", "label", "turn"])


@dataclass
class Machine:
    places: dict[int, int]
    bits: int
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def logit(self, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        """at: where each text's terms begin in flat, and the end."""
        n = len(at) - 1
        doc = np.repeat(np.arange(n), np.diff(at))
        v = self.vectors[flat]
        sums = np.stack([np.bincount(doc, v[:, f], n) for f in range(v.shape[1])], axis=1) if len(flat) else np.zeros((n, self.vectors.shape[1]))
        squares = np.bincount(doc, (v**2).sum(axis=1), n)
        return self.bias + np.bincount(doc, self.weights[flat], n) + 0.5 * ((sums**2).sum(axis=1) - squares)


def fit(rows: list[list[int]], labels: np.ndarray, places: dict[int, int], how: Settings) -> Machine:
    """Log loss, AdaGrad, mini-batches in an order drawn from the seed."""
    rng = np.random.default_rng(how.seed)
    n, m = len(rows), len(places)
    share = float(labels.mean()) if n else 0.0
    if not n or share in (0.0, 1.0) or not m:
        bias = np.log(share / (1 - share)) if 0 < share < 1 else (40.0 if share else -40.0)
        return Machine({}, how.bits, float(bias), np.zeros(1), np.zeros((1, how.factors)))
    model = Machine(places, how.bits, float(np.log(share / (1 - share))), np.zeros(m), rng.normal(0, 0.01, (m, how.factors)))
    seen_b, seen_w, seen_v = 1e-8, np.full(m, 1e-8), np.full((m, how.factors), 1e-8)
    lengths = np.array([len(r) for r in rows])
    for _ in range(how.epochs):
        order = rng.permutation(n)
        for start in range(0, n, 256):
            pick = order[start : start + 256]
            flat = np.array([x for i in pick for x in rows[i]], np.int64)
            at = np.concatenate(([0], np.cumsum(lengths[pick])))
            doc = np.repeat(np.arange(len(pick)), lengths[pick])
            p = 1 / (1 + np.exp(-model.logit(flat, at)))
            error = (p - labels[pick]) / len(pick)
            g = error.sum()
            seen_b += g * g
            model.bias -= how.rate * g / np.sqrt(seen_b)
            if not len(flat):
                continue
            v = model.vectors[flat]
            sums = np.stack([np.bincount(doc, v[:, f], len(pick)) for f in range(how.factors)], axis=1)
            terms, where = np.unique(flat, return_inverse=True)
            gw = np.bincount(where, error[doc], len(terms)) + how.decay * model.weights[terms]
            gv = (sums[doc] - v) * error[doc][:, None]
            gv = np.stack([np.bincount(where, gv[:, f], len(terms)) for f in range(how.factors)], axis=1) + how.decay * model.vectors[terms]
            seen_w[terms] += gw**2
            seen_v[terms] += gv**2
            model.weights[terms] -= how.rate * gw / np.sqrt(seen_w[terms])
            model.vectors[terms] -= 0.3 * how.rate * gv / np.sqrt(seen_v[terms])
    return model


def train(docs: DataFrame, labels: DataFrame, how: Settings = Settings()) -> Machine:
    marks = labels.where("toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")).where(~held_out(F.col("doc_id")))
    marks = marks.withColumn("turn", F.crc32(F.concat(F.lit("sample"), F.col("doc_id").cast("string"))))
    n = marks.count()
    sample = marks.where(F.col("turn") < 2.0**32 * min(1.0, how.most_rows / max(n, 1)))
    # at most about most_rows narrow rows, so the texts stay where they are
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    # one row a label, however often its doc_id occurs, so that the sample stays within its bound; the ids that occur
    # more than once are found without the texts, and are at most as many as the sample
    often = docs.select("doc_id").join(F.broadcast(sample.select("doc_id")), "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    often = F.broadcast(stored(often.where("n > 1").select("doc_id"), "often"))
    least = rows.join(often, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text", "label", "turn")).alias("r"))
    once = rows.join(often, "doc_id", "left_anti").select("text", "label", "turn")
    rows = stored(once.unionByName(least.select("r.text", "r.label", "r.turn")), "sample")
    counts = rows.mapInArrow(lambda b: _count(b, how.bits), "term long, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    zero, one = rows.agg(F.coalesce(F.sum(1 - F.col("label")), F.lit(0)), F.coalesce(F.sum("label"), F.lit(0))).first()
    a, b = F.col("n1"), F.col("n0")
    c, d = F.lit(float(one)) - a, F.lit(float(zero)) - b
    chi = (zero + one) * (a * d - b * c) ** 2 / F.greatest((a + b) * (c + d) * one * zero, F.lit(1e-9))
    best = counts.withColumn("chi", chi).where(F.col("chi") >= how.least_chi).orderBy(F.desc("chi"), "term").limit(how.terms)
    places = {r.term: k for k, r in enumerate(best.collect())}
    inputs = rows.mapInArrow(lambda x: _places(x, how.bits, places), "terms array<int>, label int, turn long").collect()
    inputs.sort(key=lambda r: (r.turn, r.terms))
    return fit([r.terms for r in inputs], np.array([r.label for r in inputs], float), places, how)


def _score(batches: Iterator[pa.RecordBatch], model: Machine, name: str) -> Iterator[pa.RecordBatch]:
    terms = Terms(model.bits, model.places)
    for block in blocks(batches):
        rows = [sorted(_of_text(t, terms)) for t in texts(block)]
        at = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)
        flat = np.array([x for r in rows for x in r], np.int64)
        score = 1 / (1 + np.exp(-np.clip(model.logit(flat, at), -700, 700)))
        yield pa.RecordBatch.from_arrays([*block.columns, pa.array(score)], names=[*block.schema.names, name])


def _scored(docs: DataFrame, labels: DataFrame, how: Settings, name: str) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, how))
    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in docs.schema.fields], T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(lambda b: _score(b, model.value, name), schema)


def toxicity(docs: DataFrame, labels: DataFrame, how: Settings = Settings()) -> DataFrame:
    """docs with held_out, score (0 to 1) and predicted (1 where score >= threshold)."""
    scored = _scored(docs.drop(*RESULT), labels, how, "score")
    return scored.withColumns({"held_out": held_out(F.col("doc_id")), "predicted": (F.col("score") >= how.threshold).cast("int")})


def clean(docs: DataFrame, labels: DataFrame, how: Settings = Settings()) -> DataFrame:
    """docs without those predicted toxic."""
    return _scored(docs, labels, how, "__lf_score").where(F.col("__lf_score") < how.threshold).drop("__lf_score")
