"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad.  Emissions are linear in the features of the line
and of both neighbours (shape, character classes, repetition of words and
lines), transitions link consecutive lines.  The document's quality is the mean
forward-backward marginal of "good", weighted by line length, and a two-
parameter logistic curve fitted with the model turns it into a probability.

Learning maximises the conditional likelihood of the lines' labels, a document's lines
weighing 1 together, with a small L2 penalty.  Labels are those of documents: each line
gets its document's, so a bad line beside a good one is never seen in learning, and
transitions learn to stay.  It reads at most ``sample`` labelled rows of at most
``sample_bytes`` of text (least hash of id and text), in chains of at most 64 lines;
scoring reads every row and runs whole chains.  The weights (about 150 numbers)
are all that executors receive.

Long texts are scored in windows of about a megabyte: what is kept of a window is an
emission, a length and a hash for each line, and messages are carried from window
to window by products of transfer matrices.

Defined cases: null or empty text, or only line breaks, scores as the share of
label 1 among the rows learnt from; null labels or ids are not learnt from;
without rows of both labels every score is that (smoothed) share; repeated rows
score alike; a document of one line is a chain of one; a line beyond 64 KB is scored as
lines of that size; an empty table gives no row; other columns take no part, and one
named like the score is replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

_CHAIN, _LONGEST, _PIECE = 64, 1 << 16, 256
_CLASS = np.zeros(256, np.uint8)  # 0: other symbols
for _k, _set in enumerate((range(65, 91), [*range(97, 123), *range(128, 256)], range(48, 58), (32, 9, 11, 12, 13), b".,;:?'-\"", b"!", b"|", b"*&$%#@~^"), 1):
    _CLASS[list(_set)] = _k
_N_CLASS = 9


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of good against bad; the last one is the bias
    moves: np.ndarray  # 2 x 2 log potentials
    curve: tuple[float, float]
    share: float


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every non-empty line, and lines before each row; lines of more
    than ``_LONGEST`` bytes are several."""
    gap = np.zeros(256, bool)
    gap[10] = True
    start, end, upto = c.words(data, offsets, gap)
    parts = -(-(end - start) // _LONGEST)
    if (parts > 1).any():
        upto = np.append(0, np.cumsum(parts))[upto]
        nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        start = np.repeat(start, parts) + nth * _LONGEST
        end = np.minimum(np.repeat(end, parts), start + _LONGEST)
    return start, end, upto


def features(data: np.ndarray, offsets: np.ndarray, seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A feature row for every line, lines before each document, line lengths and hashes.
    ``seen``: sorted hashes of the lines before, where there is one document."""
    start, end, upto = lines(data, offsets)
    n = len(start)
    size = (end - start).astype(np.float64)
    if not n:
        return np.zeros((0, 20)), upto, size, np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(upto))
    kind = _CLASS[data]
    capital = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3)) + 1
    kind[capital] = 1
    line_of = np.repeat(np.arange(n), end - start)
    inside = np.ones(len(data), bool)
    inside[data == 10] = False
    share = np.bincount(line_of * _N_CLASS + kind[inside], minlength=n * _N_CLASS).reshape(n, _N_CLASS) / size[:, None]
    prefix = c.prefix_hash(c.BYTE_CODE[data])
    w_start, w_end, _ = c.words(data, offsets)
    w_line = np.maximum(np.searchsorted(start, w_start, side="right") - 1, 0)
    word = c.span_hash(prefix, w_start, w_end)
    count = np.bincount(w_line, minlength=n).astype(float)
    one = np.maximum(count, 1)
    by_line = np.argsort((w_line.astype(np.uint64) << c.U64(40)) | (c.mix(word) >> c.U64(24)), kind="stable")
    same = (word[by_line][1:] == word[by_line][:-1]) & (w_line[by_line][1:] == w_line[by_line][:-1])
    repeated = np.bincount(w_line[by_line][1:][same], minlength=n)
    beside = (word[1:] == word[:-1]) & (w_line[1:] == w_line[:-1])
    stutter = np.bincount(w_line[1:][beside], minlength=n)
    length = w_end - w_start
    brief = np.bincount(w_line, length <= 3, n)
    capitals = np.bincount(w_line, kind[w_start] == 1, n)
    text = c.span_hash(prefix, start, end)
    by_doc = np.lexsort((np.arange(n), text, doc))
    again = np.zeros(n)
    again[by_doc[1:]] = (text[by_doc][1:] == text[by_doc][:-1]) & (doc[by_doc][1:] == doc[by_doc][:-1])
    if seen is not None and len(seen):
        again[seen[np.minimum(np.searchsorted(seen, text), len(seen) - 1)] == text] = 1
    out = np.column_stack([share, repeated / one, stutter / one, brief / one, capitals / one, size / one / 8, np.log1p(size) / 5, np.log1p(count) / 4, again, count <= 2, data[end - 1] == 46, (share[:, 0] + share[:, 6] + share[:, 7] + share[:, 8]) > 0.05])
    return out, upto, size, text


def windowed(own: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Features of the line, of the one before and of the one after (zeros at
    the ends of a document), and ones for the bias."""
    n, d = own.shape
    out = np.zeros((n, 3 * d + 1))
    out[:, :d] = own
    out[:, -1] = 1
    if n > 1:
        doc = np.repeat(np.arange(len(upto) - 1), np.diff(upto))
        same = (doc[1:] == doc[:-1])[:, None]
        out[1:, d : 2 * d] = own[:-1] * same
        out[:-1, 2 * d : 3 * d] = own[1:] * same
    return out


def _steps(first: np.ndarray, length: np.ndarray):
    """For each place in the chains, the lines there, longest chains first."""
    order = np.argsort(-length, kind="stable")
    at, size = first[order], length[order]
    live = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
    return order, [at[:n] + t for t, n in enumerate(live.tolist())]


def _potentials(emit: np.ndarray) -> np.ndarray:
    psi = np.stack([np.zeros(len(emit)), np.clip(emit, -30, 30)], 1)
    return np.exp(psi - psi.max(1, keepdims=True))


def forward_backward(emit: np.ndarray, first: np.ndarray, length: np.ndarray, moves: np.ndarray, weight: np.ndarray | None = None, before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of "good" per line, and summed pair marginals, of many chains at
    once.  emit: log odds of good; chains start at ``first`` and have ``length``
    lines each; all chains step together, longest first.  ``weight`` of each chain's
    pairs; messages ``before`` its first line and ``after`` its last, where it is part of
    a longer one."""
    n = len(emit)
    psi, move = _potentials(emit), np.exp(moves)
    order, steps = _steps(first, length)
    alpha, beta, pairs = np.zeros((n, 2)), np.ones((n, 2)), np.zeros((2, 2))
    if after is not None:
        beta[first + length - 1] = after
    weigh = np.ones(len(order)) if weight is None else weight[order]
    for t, i in enumerate(steps):
        a = (psi[i] if before is None else psi[i] * before[order]) if t == 0 else (alpha[i - 1] @ move) * psi[i]
        alpha[i] = a / a.sum(1, keepdims=True)
    for onward_at in reversed(steps[1:]):
        i = onward_at - 1
        onward = psi[onward_at] * beta[onward_at]
        b = onward @ move.T
        beta[i] = b / b.sum(1, keepdims=True)
        joint = alpha[i][:, :, None] * move[None] * onward[:, None, :]
        pairs += (joint / joint.sum((1, 2), keepdims=True) * weigh[: len(i), None, None]).sum(0)
    both = alpha * beta
    return both[:, 1] / both.sum(1), pairs


def long_chain(emit: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Marginals of one long chain: its pieces step together, twice: once for their
    transfer matrices, which carry messages over them, once for the marginals."""
    n = len(emit)
    first = np.arange(0, n, _PIECE)
    length = np.minimum(_PIECE, n - first)
    move = np.exp(moves)
    transfer = np.tile(np.eye(2), (len(first), 1, 1))  # from the state before a piece to its last line
    order, steps = _steps(first, length)
    for i in steps:
        here = order[: len(i)]
        m = (transfer[here] @ move) * _potentials(emit[i])[:, None, :]
        transfer[here] = m / m.sum((1, 2), keepdims=True)
    before, after = np.ones((len(first), 2)), np.ones((len(first), 2))
    # into the first piece there is no transition
    m = np.array([1.0, 1.0])
    for t, p in enumerate(_potentials(emit[: length[0]])):
        m = (m @ move if t else m) * p
        m /= m.sum()
    for k in range(1, len(first)):
        before[k] = m @ move
        m = m @ transfer[k]
        m /= m.sum()
    m = np.ones(2)
    for k in range(len(first) - 1, 0, -1):
        m = transfer[k] @ m
        m /= m.sum()
        after[k - 1] = m
    out = np.empty(n)
    for a in range(0, len(first), 256):  # in bounded runs of pieces
        some = slice(a, min(len(first), a + 256))
        lo, hi = first[some][0], first[some][-1] + length[some][-1]
        out[lo:hi] = forward_backward(emit[lo:hi], first[some] - lo, length[some], moves, None, before[some], after[some])[0]
    return out


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _quality(good: np.ndarray, size: np.ndarray, upto: np.ndarray) -> np.ndarray:
    doc = np.repeat(np.arange(len(upto) - 1), np.diff(upto))
    weight = np.bincount(doc, size, len(upto) - 1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.bincount(doc, size * good, len(upto) - 1) / weight  # nan where there is no line


def train(texts: list[str], label: np.ndarray, steps: int = 150, rate: float = 0.08, l2: float = 1e-3) -> Model:
    """Maximum conditional likelihood, a document's lines weighing 1 together, by Adam."""
    share = float((label.sum() + 0.5) / (len(label) + 1))
    parts = [features(*c.column_bytes(batch.column(0))) for batch in c.pieces([pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], names=["text"])], limit=1 << 19)]
    own, size = np.concatenate([np.zeros((0, 20)), *(p[0] for p in parts)]), np.concatenate([np.zeros(0), *(p[2] for p in parts)])
    upto = np.cumsum([0, *(n for p in parts for n in np.diff(p[1]))])
    d = own.shape[1]
    mean, scale = (own.mean(0), own.std(0) + 1e-3) if len(own) else (np.zeros(d), np.ones(d))
    model = Model(mean, scale, np.zeros(3 * d + 1), np.zeros((2, 2)), (float(_logit(share)), 0.0), share)
    if not len(own) or not 0 < label.sum() < len(label):
        return model
    x = windowed((own - mean) / scale, upto)
    y = np.repeat(label, np.diff(upto)).astype(float)
    first = np.concatenate([np.arange(a, b, _CHAIN) for a, b in zip(upto, upto[1:], strict=False)]).astype(np.int64)
    length = np.diff(np.append(first, len(x)))
    # every document weighs as much as any other, in emissions and transitions alike
    weigh = 1 / np.repeat(np.diff(upto), np.diff(upto)) / len(label)
    w, moves = model.weights.copy(), model.moves.copy()
    m1, m2 = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    inner = np.ones(len(x), bool)
    inner[first] = False
    held = np.array([[(weigh[1:] * ((y[1:] == a) & (y[:-1] == b) & inner[1:])).sum() for b in (0, 1)] for a in (0, 1)]).T
    for k in range(1, steps + 1):
        good, pairs = forward_backward(x @ w, first, length, moves, weigh[first])
        g = np.append(x.T @ ((good - y) * weigh) + l2 * w, (pairs - held + l2 * moves).ravel())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        step = rate * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-8)
        w, moves = w - step[:-4], moves - step[-4:].reshape(2, 2)
    at = np.column_stack([upto[:-1], np.diff(upto)])
    good, _ = forward_backward(x @ w, at[:, 0], at[:, 1], moves)
    q = _quality(good, size, upto)
    there = ~np.isnan(q)
    z, t = _logit(q[there]), label[there].astype(float)
    a, b = float(_logit(share)), 0.5
    for _ in range(30):  # Newton, lightly damped
        p = 1 / (1 + np.exp(-np.clip(a + b * z, -30, 30)))
        r = p * (1 - p) + 1e-6
        h = np.array([[r.sum(), (r * z).sum()], [(r * z).sum(), (r * z * z).sum()]]) + np.eye(2) * 0.5
        da, db = np.linalg.solve(h, [(p - t).sum() + 0.5 * (a - _logit(share)), (p * z - t * z).sum() + 0.5 * (b - 0.5)])
        a, b = a - da, b - db
    return Model(mean, scale, w, moves, (float(a), float(b)), share)


def predict(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Scores of whole texts; one of more than two megabytes goes by windows."""
    if not model.curve[1]:
        return np.full(len(offsets) - 1, model.share)
    out = np.empty(len(offsets) - 1)
    large = np.diff(offsets) > 2 * _WINDOW
    for k in np.flatnonzero(large):
        out[k] = _long_quality(model, data[offsets[k] : offsets[k + 1]])
    rows = np.flatnonzero(~large)
    if len(rows):
        if large.any():
            size = np.diff(offsets)[rows]
            data, offsets = np.concatenate([data[offsets[k] : offsets[k + 1]] for k in rows]), np.append(0, np.cumsum(size))
        own, upto, size, _ = features(data, offsets)
        good, _ = forward_backward(windowed((own - model.mean) / model.scale, upto) @ model.weights, upto[:-1], np.diff(upto), model.moves) if len(own) else (np.zeros(0), None)
        out[rows] = _quality(good, size, upto)
    return np.where(np.isnan(out), model.share, 1 / (1 + np.exp(-(model.curve[0] + model.curve[1] * _logit(np.nan_to_num(out, nan=0.5))))))


_WINDOW = 1 << 20


def _long_quality(model: Model, data: np.ndarray) -> float:
    """Quality of one long text: emissions window by window, then the whole chain."""
    parts = np.split(model.weights[:-1], 3)
    seen, sizes, shares = np.zeros(0, np.uint64), [], []
    at = 0
    while at < len(data):
        to = min(len(data), at + _WINDOW)
        if to < len(data):  # whole lines, or whole parts of a long one
            feed = np.flatnonzero(data[at:to] == 10)
            to = at + int(feed[-1]) + 1 if len(feed) else to
        own, _, size, text = features(data[at:to], np.array([0, to - at]), seen)
        at = to
        if len(size):
            seen = np.union1d(seen, text)
            x = (own - model.mean) / model.scale
            shares.append(np.stack([x @ w for w in parts], 1))
            sizes.append(size)
    if not sizes:
        return float("nan")
    own, size = np.concatenate(shares), np.concatenate(sizes)
    emit = own[:, 0] + model.weights[-1]
    emit[1:] += own[:-1, 1]
    emit[:-1] += own[1:, 2]
    return float((long_chain(emit, model.moves) * size).sum() / size.sum())


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 4_000, sample_bytes: int = 32 << 20) -> Model:
    """Learn from at most ``sample`` labelled rows that are not held out, of at most
    ``sample_bytes`` of text."""
    rows = c.learning_rows(docs, labels, label, sample, sample_bytes).collect()
    rows.sort(key=lambda r: (r.doc_id, r.text or ""))
    return train([r.text or "" for r in rows], np.array([r.y for r in rows], int))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """``keep`` columns (default: all) of every row and its score in [0, 1]."""
    keep = [k for k in keep or docs.columns if k.lower() != out.lower()]
    schema = docs.select(*keep).schema.add(out, "double")

    def run(batches):
        for batch in c.pieces(batches):
            data, off = c.column_bytes(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(predict(model, data, off))], names=[*keep, out])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    model = fit(docs, c.table(spark, sf_dir, "labels"))
    found = score(docs.select("doc_id", "text"), model, ["doc_id"])
    return found.select("doc_id", c.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
