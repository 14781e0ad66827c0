"""Best-fit packing of tokenised documents, certified by lower bounds.

A document is its token ids and one separator id.  Only those longer than a
sequence are cut, into whole sequences and a rest.  Pieces are dealt to
partitions of about ``rows_per_part`` at random (by hash) and packed best-fit
decreasing.  Dual-feasible functions give each partition a lower bound on its
number of sequences; where that equals the number used, the partition is
certified best.  Partitions with a gap release the documents of their emptiest
sequences, and every partition those of sequences under nine tenths full, which are
best for it but not for all; released documents are pooled, dealt anew and packed
again, until no gap closes (``rounds`` at most).  ``certified`` tells of each piece
whether the partition that placed it used as few sequences as its bound.

Tokenising splits at white space, which the tokenizer drops and never joins over,
and keeps the ids of chunks it has met in a bounded table (emptied when full and at a
task's end), so memory does not follow the corpus.  The tokenizer file's path is a parameter; the
file must be at that path on every executor.

Defined cases: null and empty texts are the separator alone, one piece of length
1; repeated rows are pieces of their own; a very long text is many pieces, its ids held
once in memory; pieces of one length are placed in the order of their ids; an empty table
gives no row; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

SEQUENCE = 2048
_ODD = re.compile("[\x1c-\x1f]")  # white space to Python only
_LATIN = "ß-öø-ÿā-įı-ŷź-ž"
_SIMPLE = re.compile("[\x21-\x7eÀ-ÖØ-öø-įı-ķĹ-ňŊ-ŷŹ-ž]+")
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^\\sa-z0-9{_LATIN}]+")
#: Byte-level BPE shows the bytes that don't print as characters from U+0100 on.
_SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}


class Tokens:
    """Ids of texts as little-endian 32-bit bytes; the same as the tokenizer's.

    A chunk between white space is looked up, or met for the first time and kept;
    ``most`` bounds what is kept."""

    def __init__(self, path: str, most: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.most = self.tokenizer.model, most
        # words go to the model one by one only if the file is of the kind meant here
        self.lower = self._splits_alike()
        self.chunks, self.words = _Table(self._chunk), _Table(self._word)

    def _splits_alike(self) -> bool:
        probe = ["don't", "RE-do,", "a1b22.", "Été***", "x's'", "!!", "'ve"]
        return all(b"".join(map(self._word, _PARTS.findall(w.lower()))) == self._direct(w) for w in probe)

    def _direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        # the model takes bytes in the printable form of byte-level BPE
        return array("I", [t.id for t in self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(_SHOWN))]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if not self.lower or not _SIMPLE.fullmatch(chunk) or "<|" in chunk:
            return self._direct(chunk)
        if chunk.isalpha():
            return self._word(chunk) if chunk.islower() else self.words[chunk.lower()]
        parts = _PARTS.findall(chunk.lower())
        return self.words[parts[0]] if len(parts) == 1 else b"".join(map(self.words.__getitem__, parts))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.chunks) > self.most or len(self.words) > self.most // 2:
            self.forget()
        get = self.chunks.__getitem__
        return [self._direct(t) if _ODD.search(t) else b"".join(map(get, t.split())) for t in texts]

    def forget(self) -> None:
        self.chunks.clear()
        self.words.clear()


class _Table(dict):
    """Ids by chunk; one of more than ``longest`` characters is not kept, so that entries
    bound bytes."""

    def __init__(self, make, longest: int = 48):
        self.make, self.longest = make, longest

    def __missing__(self, key):
        found = self.make(key)
        if len(key) <= self.longest:
            self[key] = found
        return found


_held: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    """One for each worker process."""
    if path not in _held:
        _held[path] = Tokens(path)
    return _held[path]


def pieces(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, separator: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    end = np.array([separator], "<u4").tobytes()

    def run(batches):
        # not by Arrow's text parallelism: a task is one core
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder = tokens(tokenizer)
        for batch in c.pieces(batches):
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), coder.encode([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        coder.forget()  # the worker may go on to another operator
        c.release()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def best_fit(length: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin and offset of each item, and the bins' fill.

    A bit set of the room that bins have left finds the fullest bin that fits."""
    bins, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    fill: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0
    for i, n in zip((order := np.argsort(-length, kind="stable")).tolist(), length[order].tolist(), strict=True):
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = size, len(fill)
            fill.append(0)
        bins[i], offset[i] = b, size - room
        fill[b] += n
        left = room - n
        by_room[left].append(b)
        rooms |= 1 << left
    return bins, offset, np.array(fill, np.int64)


def lower_bound(length: np.ndarray, size: int) -> int:
    """Bins needed at least: dual-feasible functions (Fekete and Schepers 2001).

    Sums are of integers, scaled by the function's denominator."""
    if not len(length):
        return 0
    up = lambda total, per: -(-int(total) // int(per))
    best = up(length.sum(), size)
    count = np.bincount(length, minlength=size + 1)
    x = np.arange(size + 1)
    for e in np.unique(length[length <= size // 2]):  # long ones count whole, those below e not at all
        best = max(best, up((count * np.where(x > size - e, size, np.where(x < e, 0, x))).sum(), size))
    for k in range(1, 33):  # u_k: x if (k + 1) x is whole, else floor((k + 1) x) / k
        whole = (k + 1) * x % size == 0
        best = max(best, up((count * np.where(whole, k * x, (k + 1) * x // size * size)).sum(), k * size))
    return best


_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, free boolean, bins long, bound long, certified boolean"


def _packer(size: int, level: int, alone: bool):
    names = [x.split()[0] for x in _PACKED.split(", ")]

    def run(key, table):
        part = key[0].as_py()
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        length = table.column("length").to_numpy()
        bins, offset, fill = best_fit(length, size)
        bound = lower_bound(length, size)
        gap = len(fill) - bound
        # with a gap, the emptiest bins give up their documents; with others to
        # exchange with, so do bins whose room is only best for this partition
        free = np.zeros(len(fill), bool) if alone else fill < 0.9 * size
        if gap:
            free[np.argsort(fill, kind="stable")[: max(8 * gap, len(fill) // 20)]] = True
            free &= fill < size
        lead = (part << 34) | (level << 30)
        out = [table.column(k).combine_chunks() for k in names[:5]]
        n = len(length)
        made = [pa.array(lead + bins), pa.array(offset), pa.array(free[bins] if n else np.zeros(0, bool)), pa.array(np.full(n, int(free.sum()))), pa.array(np.full(n, bound)), pa.array(np.full(n, gap == 0))]
        return pa.table([*out, *made], names=names)

    return run


def pack(parts: DataFrame, size: int = SEQUENCE, rows_per_part: int = 50_000, rounds: int = 3) -> DataFrame:
    """Adds sequence_id, offset and certified to pieces of at most ``size`` tokens."""
    parts = c.staged(parts, "pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified"]
    done, todo, before = [], parts, None
    for level in range(rounds + 1):
        n = todo.count()
        if before is not None and n == 0:
            break
        groups = max(1, -(-n // rows_per_part))
        dealt = todo.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(level)), F.lit(groups)))
        packed = c.staged(dealt.groupBy("_part").applyInArrow(_packer(size, level, groups == 1), _PACKED), "packed")
        used = packed.agg(F.count_distinct("sequence_id")).first()[0]
        if before is not None and used >= before:
            done.append(kept)  # the pool packed no better: its old places stand
            break
        done.append(packed.where(~F.col("free")).select(columns))
        kept = packed.where("free").select(columns)
        before = packed.where("free").agg(F.count_distinct("sequence_id")).first()[0]
        todo = kept.select(parts.columns)
        if groups == 1 or level == rounds:  # one partition has nobody to exchange with
            done.append(kept)
            break
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return out


def op10_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = c.table(spark, sf_dir, "documents")
    return pack(pieces(docs, public_tokenizers.path("word_bpe_49k.json")))
