"""Quality classification by nearest-neighbour voting on latent-semantic vectors.

A text is a bag of terms: the shape of each word (runs of upper-case letters, lower-case letters and
digits become one letter each, other characters stay), whether the word repeats the one before it,
and the hashed word itself. Log counts, weighted by inverse document frequency, of at most ``SAMPLE``
labelled texts are reduced to ``DIMENSIONS`` latent dimensions. The labelled vectors (at most
``SAMPLE`` x ``DIMENSIONS`` floats) are broadcast; every text is compared with all of them in exact
blocked products, and its ``NEIGHBOURS`` nearest vote, weighted by a power of their cosine.

The sample are the different labels with the least hash of doc_id, each with one text (of rows that
repeat a doc_id, that of the least terms), so it does not depend on the order of rows. It bounds the
fit alone; every text is scored whole.

Cases: a text without terms, and any text where no neighbour is similar, gets the share of label 1
in the sample, or 0.5 without labels; labels other than 0 and 1 are ignored; rows with a null doc_id
are scored but never learnt from; repeated rows are scored each; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import in_arrow, slices

SAMPLE, DIMENSIONS, NEIGHBOURS, POWER = 6000, 64, 15, 8
#: Buckets of shapes (the first one is for repeats) and of words.
SHAPES, WORDS = 512, 1536
WORD_WEIGHT = 0.25
THRESHOLD = 0.7
#: Words that a worker remembers, and the length from which it does not.
_MEMO, _LONG = 300_000, 64
_RUNS = re.compile(r"([Aa0])\1+")
_memo: dict[str, int] = {}


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def shape(word: str) -> str:
    """``word`` with runs of letters and digits made one A, a or 0."""
    kinds = "".join(["A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word])
    return _RUNS.sub(r"\1", kinds)


def _code(word: str) -> int:
    """Word identity (40 bits), word bucket and shape bucket in one number."""
    h = xxhash.xxh3_64_intdigest(word.lower())
    s = 1 + xxhash.xxh3_64_intdigest(shape(word)) % (SHAPES - 1)
    return (h >> 24) << 22 | h % WORDS << 10 | s


def terms(text: str | None) -> np.ndarray:
    """Counts of the terms of ``text`` by bucket."""
    words = (text or "").split()
    if missing := set(words).difference(_memo):
        if len(_memo) > _MEMO:
            _memo.clear()
            missing = set(words)
        _memo.update((w, _code(w)) for w in missing)
    codes = np.array([_memo[w] for w in words], dtype=np.int64)
    for w in missing:
        if len(w) > _LONG:
            del _memo[w]  # not worth its room
    out = np.bincount(codes & 1023, minlength=SHAPES + WORDS)
    out[SHAPES:] += np.bincount(codes >> 10 & 4095, minlength=WORDS)
    out[0] = int((codes[1:] >> 22 == codes[:-1] >> 22).sum())
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of log counts times ``idf``; shapes and words are each of length one, words weigh less."""
    x = (np.log1p(counts) * idf).astype(np.float32)
    for part, weight in ((x[:, :SHAPES], 1.0), (x[:, SHAPES:], WORD_WEIGHT)):
        part *= weight / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


class NeighbourVote:
    """Fitted weights, latent axes and labelled vectors."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS):
        self.labels, self.neighbours = labels.astype(np.float32), min(neighbours, len(labels))
        self.prior = float(labels.mean()) if len(labels) else 0.5
        if not len(labels):
            return
        found = (counts > 0).sum(axis=0)
        self.idf = np.log((1 + len(counts)) / (1 + found)) + 1
        x = weighted(counts, self.idf)
        # Randomised range finder with power iterations; the seed is fixed.
        q = np.random.default_rng(7).standard_normal((x.shape[1], min(dimensions + 16, *x.shape))).astype(np.float32)
        for _ in range(5):
            q = np.linalg.qr(x.T @ (x @ q))[0]
        axes = np.linalg.svd(x @ q, full_matrices=False)[2]
        self.axes = np.ascontiguousarray((q @ axes.T)[:, :dimensions])
        self.vectors = _unit(x @ self.axes)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Weighted share of label 1 among the nearest labelled vectors of each row."""
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        near = _unit(weighted(counts, self.idf) @ self.axes) @ self.vectors.T
        k = self.neighbours
        best = np.argpartition(near, len(self.labels) - k, axis=1)[:, -k:]
        similar = np.maximum(np.take_along_axis(near, best, axis=1), 0).astype(np.float64) ** POWER
        total = similar.sum(axis=1)
        vote = (similar * self.labels[best]).sum(axis=1)
        return np.clip(np.where(total > 1e-9, vote / np.maximum(total, 1e-9), self.prior), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> NeighbourVote:
    """A model of at most ``sample`` labelled rows that are not held out."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(~held_out()).distinct()
    ids = ids.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id", "quality").limit(sample).drop("h")

    def run(batches):
        for batch in batches:
            packed = []
            for text in batch.column(2).to_pylist():
                counts = terms(text)
                at = np.flatnonzero(counts)
                packed.append(np.concatenate([at, counts[at]]).astype(np.int32).tobytes())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["doc_id", "quality", "packed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(ids), "doc_id").select("doc_id", "quality", "text").transform(in_arrow(run, "doc_id long, quality int, packed binary"))
    # A row for each label: rows that repeat with one doc_id count once, that of the least terms.
    rows = rows.groupBy("doc_id", "quality").agg(F.min("packed").alias("packed")).collect()
    rows = sorted((r["quality"], bytes(r["packed"])) for r in rows)
    counts = np.zeros((len(rows), SHAPES + WORDS), dtype=np.float32)
    for i, (_, packed) in enumerate(rows):
        at, n = np.frombuffer(packed, dtype=np.int32).reshape(2, -1)
        counts[i, at] = n
    return NeighbourVote(counts, np.array([r[0] for r in rows], dtype=np.float64))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        vote = model.value
        for whole in batches:
            for batch in slices(whole, 2, 256):
                score = vote.score(np.stack([terms(t) for t in batch.column(2).to_pylist()]))
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string"))
    return rows.transform(in_arrow(run, "doc_id long, held_out boolean, score double, predicted int"))
