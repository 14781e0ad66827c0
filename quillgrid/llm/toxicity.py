"""Toxicity scores: FTRL-proximal logistic regression over hashed terms.

Terms of a document are its lower-cased words (runs of letters), the first four
and five bytes of longer words, word bigrams and skip-grams (one word left
out), each once, hashed into ``2**bits`` slots.  Training is per-coordinate
FTRL-proximal (McMahan et al. 2013): L1 leaves a few thousand weights, which are
all that is sent to executors (bounded by the slots, not by the data).

Learning reads a bounded sample: at most ``sample`` labelled rows (repeated ones
count) of at most ``sample_bytes`` of text, those with the least hash of id and text.
Scoring reads every row, whole texts.

Defined cases: null or empty text scores by the bias alone; rows with null
labels or ids are not learnt from; with no labelled row, or labels of one kind,
every score is the smoothed share of label 1; repeated rows score alike; a very long
text is scored in one piece, about 60 bytes of memory a byte; an empty table gives no
row; other columns take no part, and one named like the score is replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

_TAG = [c.mix_int(i + 1) | 1 for i in range(5)]


@dataclass(frozen=True)
class Model:
    """Sparse weights: slot numbers, their weights, bias, log2 of the slots."""

    slots: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.slots] = self.weights
        return out


def terms(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slot and row of each term, with repeats."""
    start, end, upto = c.words(data, offsets, c.IS_GAP)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(upto))
    prefix = c.prefix_hash(c.LOWER_CODE[data])
    word = c.span_hash(prefix, start, end)
    parts, rows = [word * c.U64(_TAG[0])], [row]
    for k, tag in ((4, _TAG[1]), (5, _TAG[2])):
        long = np.flatnonzero(end - start > k)
        parts.append(c.span_hash(prefix, start[long], start[long] + k) * c.U64(tag))
        rows.append(row[long])
    for gap, tag in ((1, _TAG[3]), (2, _TAG[4])):
        if len(word) > gap:
            same = np.flatnonzero(row[:-gap] == row[gap:])
            parts.append((c.mix(word[same]) + word[same + gap]) * c.U64(tag))
            rows.append(row[same])
    key = np.concatenate(parts)
    key ^= key >> c.U64(32)
    return (key * c.U64(0xBF58476D1CE4E5B9) >> c.U64(64 - bits)).astype(np.int32), np.concatenate(rows)


def featurised(docs: DataFrame, bits: int, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``terms``, the sorted distinct slots as int32 bytes."""
    schema = docs.select(*keep).schema.add("terms", "binary")

    def run(batches):
        for batch in c.pieces(batches):
            data, off = c.column_bytes(batch.column("text"))
            slot, row = terms(data, off, bits)
            key = np.unique(row.astype(np.int64) << 32 | slot)
            cut = np.searchsorted(key >> 32, np.arange(batch.num_rows + 1))
            low = (key & 0xFFFFFFFF).astype("<i4")
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array([low[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())], names=[*keep, "terms"])

    return docs.select(*keep, "text").mapInArrow(run, schema)


def train(rows: list[tuple[int, bytes]], bits: int = 20, alpha: float = 0.5, beta: float = 1.0, l1: float = 4.0, l2: float = 1.0, epochs: int = 3, seed: int = 7) -> Model:
    """FTRL-proximal over (label, slots) rows in seeded orders."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    positive = sum(y for y, _ in rows)
    bias = float(np.log((positive + 0.5) / (len(rows) - positive + 0.5)))
    if not 0 < positive < len(rows):
        return Model(np.zeros(0, np.int32), np.zeros(0, np.float32), bias, bits)
    sparse = [np.frombuffer(t, "<i4") for _, t in rows]
    zb, nb = 0.0, 0.0
    rng = np.random.Generator(np.random.PCG64(seed))
    at = bias
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ix, y = sparse[i], rows[i][0]
            zi, ni = z[ix], n[ix]
            live = np.abs(zi) > l1
            w = np.zeros(len(ix))
            w[live] = (np.sign(zi[live]) * l1 - zi[live]) / ((beta + np.sqrt(ni[live])) / alpha + l2)
            p = 1 / (1 + np.exp(-np.clip(at + w.sum(), -35, 35)))
            g = p - y
            grown = np.sqrt(ni + g * g)
            z[ix] = zi + g - (grown - np.sqrt(ni)) / alpha * w
            n[ix] = ni + g * g
            step = (np.sqrt(nb + g * g) - np.sqrt(nb)) / 0.1
            zb, nb = zb + g - step * (at - bias), nb + g * g
            at = bias - zb / ((1 + np.sqrt(nb)) / 0.1)
    slots = np.flatnonzero(np.abs(z) > l1)
    w = (np.sign(z[slots]) * l1 - z[slots]) / ((beta + np.sqrt(n[slots])) / alpha + l2)
    return Model(slots.astype(np.int32), w.astype(np.float32), float(at), bits)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = 12_000, sample_bytes: int = 64 << 20, bits: int = 20) -> Model:
    """Learn from at most ``sample`` labelled rows that are not held out, of at most
    ``sample_bytes`` of text."""
    # written first, then read a part at a time: the driver's JVM never holds the sample
    some = c.learning_rows(docs, labels, label, sample, sample_bytes)
    rows = c.staged(featurised(some, bits, ["doc_id", "y"]), "toxicity-sample")
    held = sorted((r.doc_id, r.y, bytes(r.terms)) for r in rows.coalesce(8).toLocalIterator())
    c.discard(rows)
    return train([(y, terms) for _, y, terms in held], bits)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """``keep`` columns (default: all) of every row and its score in [0, 1]."""
    keep = [k for k in keep or docs.columns if k.lower() != out.lower()]
    schema = docs.select(*keep).schema.add(out, "double")

    def run(batches):
        dense = model.dense()
        for batch in c.pieces(batches):
            data, off = c.column_bytes(batch.column("text"))
            slot, row = terms(data, off, model.bits)
            hit = np.flatnonzero(dense[slot])
            key = np.unique(row[hit].astype(np.int64) << 32 | slot[hit])
            total = model.bias + np.bincount(key >> 32, dense[key & 0xFFFFFFFF], batch.num_rows).astype(float)
            p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(p)], names=[*keep, out])

    read = docs.select(*dict.fromkeys([*keep, "text"]))
    return read.mapInArrow(run, schema)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    model = fit(docs, c.table(spark, sf_dir, "labels"))
    found = score(docs.select("doc_id", "text"), model, ["doc_id"])
    return found.select("doc_id", c.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
