"""Document fingerprints: SimHash of 128 bits and search within a Hamming radius.

Terms are runs of three words (fewer where the text has fewer), each weighted by
how often it stands in the text; every term's hash votes on every bit.  Votes are
summed in packed byte lanes, so a bit costs no loop.  Equal texts have equal
fingerprints.  :func:`near` finds every pair of distinct fingerprints within a
radius, by permuted tables led by one block of bits each.

``RADIUS`` is 20 of 128 bits, an estimated cosine of 0.88: near copies (5-word
shingle sets with a Jaccard similarity of 0.8 or more) mostly lie 10 to 20 bits
apart.  No exact index is selective at such a radius: the tables spare all but
about 1 in 200 comparisons where bits are evenly spread, and these still grow with
the square of the fingerprints.

Defined cases: null and empty texts have the fingerprint of no term (all zero
bits, as no bit has a positive vote); texts without words too; equal texts are one
fingerprint with a class of members; a null id comes after all others, rows that share
an id follow each other in text order; a very long text is held whole, with about 100
bytes of working memory a byte; an empty table gives no row; extra columns do not take
part.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

BITS = 128
RADIUS, TABLES, BLOCK_ROWS = 20, 7, 1 << 20
_LANES = np.array([sum(((b >> (7 - k)) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def fingerprints(data: np.ndarray, offsets: np.ndarray, width: int = 3) -> np.ndarray:
    """(rows, 16) bytes."""
    n = len(offsets) - 1
    key, first = c.shingles(data, offsets, width)
    terms = np.diff(first)
    total = int(first[-1])
    out = np.zeros((n, BITS // 8), np.uint8)
    if not total:
        return out
    row = np.repeat(np.arange(n), terms)
    # sum 0/1 votes over at most 255 terms at a time in eight byte lanes of a word
    cuts = np.concatenate([np.arange(a, b, 255) for a, b in zip(first[:-1], first[1:], strict=True) if b > a])
    owner = row[cuts]
    starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    there = owner[starts]
    need = terms[there]
    for half in range(2):
        h = key if half == 0 else c.mix(key ^ c.U64(0xD6E8FEB86659FD93))
        octets = h.astype("<u8").view(np.uint8).reshape(-1, 8)
        for k in range(8):
            lanes = np.add.reduceat(_LANES[octets[:, k]], cuts).astype("<u8").view(np.uint8).reshape(-1, 8)
            votes = np.add.reduceat(lanes.astype(np.int64), starts, axis=0)
            out[there, half * 8 + k] = np.packbits(votes * 2 > need[:, None], axis=1)[:, 0]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated cosine of the term vectors, from the share of unequal bits; 0 to 1."""
    apart = np.unpackbits(a ^ b, axis=1).sum(1) / (8 * a.shape[1])
    return np.where(apart >= 0.5, 0.0, np.cos(np.pi * apart))


def fingerprint(docs: DataFrame, keep: list[str] | None = None, out: str = "fingerprint") -> DataFrame:
    """``keep`` columns (default: all) and the fingerprint as 32 hex digits."""
    keep = keep or [k for k in docs.columns if k != out]

    def run(batches):
        for batch in c.pieces(batches):
            data, off = c.column_bytes(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array([x.tobytes().hex() for x in fingerprints(data, off)], pa.string())], names=[*keep, out])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, docs.select(*keep).schema.add(out, "string"))


def _close(a: np.ndarray, b: np.ndarray, radius: int, chunk: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of a, rows of b, distance) of every pair within ``radius`` bits, each
    once: ``TABLES`` tables, each sorted by its own block of bits as the lead.  Of
    so many blocks one at least differs in radius // TABLES bits or fewer, so a
    table is looked up at every lead that near to a row's own."""
    slack = radius // TABLES
    bounds = [BITS * k // TABLES for k in range(TABLES + 1)]
    leads = []
    for x in (a, b):
        bits = np.unpackbits(x, axis=1)
        leads.append([bits[:, p:q] @ (1 << np.arange(q - p, dtype=np.int64)) for p, q in zip(bounds, bounds[1:], strict=False)])
    wa, wb = (np.ascontiguousarray(x).view(np.uint64) for x in (a, b))
    for k, (p, q) in enumerate(zip(bounds, bounds[1:], strict=False)):
        by_a, by_b = (np.argsort(x[k], kind="stable") for x in leads)
        own, table, vb = leads[0][k][by_a], leads[1][k][by_b], wb[by_b]
        va = wa[by_a]
        first = np.searchsorted(table, np.arange((1 << (q - p)) + 1))
        for n in range(slack + 1):
            for some in itertools.combinations(range(q - p), n):
                at = own ^ sum(1 << i for i in some)
                low, count = first[at], first[at + 1] - first[at]
                there = np.flatnonzero(count)
                low, count = low[there], count[there]
                ends = np.cumsum(count)
                done = 0
                while done < len(there):
                    base = int(ends[done - 1]) if done else 0
                    to = max(done + 1, int(np.searchsorted(ends, base + chunk, side="right")))
                    c_ = count[done:to]
                    i = np.repeat(there[done:to], c_)
                    j = np.arange(len(i)) + np.repeat(low[done:to] - (ends[done:to] - c_ - base), c_)
                    done = to
                    apart = np.bitwise_count(va[i, 0] ^ vb[j, 0]) + np.bitwise_count(va[i, 1] ^ vb[j, 1])
                    hit = np.flatnonzero(apart <= radius)
                    i, j, apart = by_a[i[hit]], by_b[j[hit]], apart[hit]
                    # a pair is reported by its first table only
                    new = np.ones(len(i), bool)
                    for e in range(k):
                        new &= np.bitwise_count(leads[0][e][i] ^ leads[1][e][j]) > slack
                    if new.any():
                        yield i[new], j[new], apart[new]


def _in_blocks(prints: DataFrame, column: str, radius: int, found, schema: str) -> DataFrame:
    """``found(a, b, pairs)`` for every pair of blocks of distinct fingerprints, one
    task each.  A fingerprint travels once for each block, in 16 bytes."""
    n = prints.count()
    blocks = max(-(-n // BLOCK_ROWS), min(8, -(-n // 2_048)), 1)
    one = prints.select(F.unhex(column).alias("p")).distinct().select("p", F.pmod(F.xxhash64("p"), F.lit(blocks)).cast("int").alias("own"))
    dealt = one.select("p", "own", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")).select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"), "p")

    def run(key, table):
        p = np.frombuffer(b"".join(table.column("p").to_pylist()), np.uint8).reshape(-1, BITS // 8)
        second = table.column("second").to_numpy(zero_copy_only=False).astype(bool)
        if key[0].as_py() == key[1].as_py():  # a block with itself: each pair once
            return found(p, p, ((i[i < j], j[i < j], d[i < j]) for i, j, d in _close(p, p, radius)))
        return found(p[~second], p[second], _close(p[~second], p[second], radius))

    return dealt.groupBy("i", "j").applyInArrow(run, schema)


def _hex(prints: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes().hex() for x in prints], pa.string())


def near(prints: DataFrame, radius: int = RADIUS, column: str = "fingerprint") -> DataFrame:
    """(a, b, distance) for every pair a < b of distinct fingerprints within
    ``radius`` bits."""

    def found(a, b, pairs):
        i, j, d = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*pairs, strict=True)) if (pairs := list(pairs)) else (np.zeros(0, np.int64),) * 3
        return pa.table([_hex(a[i]), _hex(b[j]), pa.array(d, pa.int32())], names=["a", "b", "distance"])

    return _in_blocks(prints, column, radius, found, "a string, b string, distance int").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance")


def near_counts(prints: DataFrame, radius: int = RADIUS, column: str = "fingerprint") -> DataFrame:
    """(fingerprint, near_count): how many other distinct fingerprints lie within
    ``radius`` bits, of those that have any; a task sends counts, not pairs."""

    def found(a, b, pairs):
        n = [np.zeros(len(x), np.int64) for x in (a, b)]
        for i, j, _ in pairs:
            np.add.at(n[0], i, 1)
            np.add.at(n[1], j, 1)
        return pa.table([pa.concat_arrays([_hex(x[m > 0]) for x, m in zip((a, b), n, strict=True)]), pa.array(np.concatenate([m[m > 0] for m in n]))], names=["p", "n"])

    return _in_blocks(prints, column, radius, found, "p string, n long").groupBy(F.col("p").alias("fingerprint")).agg(F.sum("n").alias("near_count"))


_FOUND = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_EDGE = f"{_FOUND}, part int, first boolean, text string"


def _judged(ids: list, texts: list[str]) -> list[pa.Array]:
    """The columns of all rows but the last, which only lends its start."""
    edits = [t[: len(t) - len(t) // 3] + after[: len(t) // 3] for t, after in zip(texts, texts[1:], strict=False)]
    own, new = _prints(texts), _prints(edits)
    k = len(edits)
    return [
        pa.array(ids[:k], pa.int64()),
        pa.array([len(t) for t in texts[:k]], pa.int64()),
        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits], pa.string()),
        _hex(own[:k]),
        _hex(new),
        pa.array(likeness(own[:k], new), pa.float64()),
        pa.array(likeness(own[:k], own[1:]), pa.float64()),
    ]


def edited(docs: DataFrame, range_bytes: int = 32 << 20) -> DataFrame:
    """Fingerprints of every text and of its edited text (op6's contract).

    Documents are dealt to ranges of about ``range_bytes`` of text, sorted, by descending
    doc_id, and streamed through with the next row in hand, so each text is shuffled
    once and a task holds a megabyte of it, whatever the range.  The first and last
    rows of the ranges meet in a second, small step.  Equal ids follow each other in
    text order; null ids come last.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    # ids that share a range's bound are parted by the start of their text
    order = [F.desc("key"), F.col("doc_id").isNull(), F.substring("text", 1, 32)]
    ranged = docs.repartitionByRange(max(1, -(-total // range_bytes)), *order).sortWithinPartitions(F.desc("key"), F.col("doc_id").isNull(), "text")

    def run(batches, limit: int = 1 << 20):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        ids, texts, size, first = [], [], 0, True
        names = [x.split()[0] for x in _EDGE.split(", ")]
        null = lambda n: [pa.nulls(n, t) for t in (pa.int32(), pa.bool_(), pa.string())]

        def edge(at: bool):
            held = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
            row = 0 if at else -1
            held[0] = pa.array([ids[row]], pa.int64())
            return pa.RecordBatch.from_arrays([*held, pa.array([part], pa.int32()), pa.array([at]), pa.array([texts[row]], pa.string())], names=names)

        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids.append(i)
                texts.append(t)
                size += len(t)
                if first:
                    yield edge(True)
                    first = False
                if size > limit and len(ids) > 1:
                    cols = _judged(ids, texts)
                    yield pa.RecordBatch.from_arrays([*cols, *null(len(cols[0]))], names=names)
                    ids, texts = ids[-1:], texts[-1:]
                    size = len(texts[0])
        if ids:
            if len(ids) > 1:
                cols = _judged(ids, texts)
                yield pa.RecordBatch.from_arrays([*cols, *null(len(cols[0]))], names=names)
            yield edge(False)
        c.release()

    kept = [x.split()[0] for x in _FOUND.split(", ")]
    found = c.staged(ranged.select("doc_id", "text").mapInArrow(run, _EDGE), "edited")
    edges = found.where("part is not null")
    # a row for each range, without texts: what comes after it, round from the last to the first
    parts = edges.where("first").select("part")
    by = Window.orderBy("part")
    after = parts.select("part", F.coalesce(F.lead("part").over(by), F.min("part").over(Window.partitionBy())).alias("next"))
    lends = edges.where("first").select(F.col("part").alias("next"), F.col("text").alias("lent"))
    last = edges.where("not first").select("part", "doc_id", "text").join(after, "part").join(lends, "next").select("doc_id", "text", "lent")

    def close(batches):
        for batch in batches:
            rows = [_judged([i, None], [t, lent]) for i, t, lent in zip(*(x.to_pylist() for x in batch.columns), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*rows, strict=True)], names=kept)

    return found.where("part is null").select(kept).union(last.mapInArrow(close, _FOUND))


def _prints(texts: list[str]) -> np.ndarray:
    return fingerprints(*c.column_bytes(pa.array(texts, pa.large_string())))


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    """The contract's columns and ``near_count``: how many other fingerprints lie
    within ``RADIUS`` bits of the document's."""
    found = c.staged(edited(c.table(spark, sf_dir, "documents")), "fingerprints")
    return with_counts(found)


def with_counts(found: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``found`` (staged), with the near_count of its ``fingerprint``; one that many rows
    share is no task of its own."""
    counts = found.groupBy("fingerprint").agg(F.count("*").alias("_n"))
    near = near_counts(found, radius).withColumnRenamed("fingerprint", "_of")
    counts = counts.join(near, F.col("fingerprint") == F.col("_of"), "left").select("fingerprint", "_n", F.coalesce("near_count", F.lit(0)).alias("near_count"))
    return c.join_counted(found, counts, ["fingerprint"], "_n", found.count()).select(*found.columns, "near_count")
