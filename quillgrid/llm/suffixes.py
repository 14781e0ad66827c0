"""Exact substring deduplication by bucket-pointer refinement of suffixes.

Removes every byte covered by a ``LENGTH``-byte string that also starts earlier
(smaller doc_id, or the same document at an earlier place).

Suffixes are refined as in a suffix array: initial buckets are those of the eight
bytes at each place; a bucket of depth d is refined by sorting on the identifiers of the
buckets that its suffixes point to at offset d, and the new identifiers, of depth 2d,
are what all other buckets point to next.  Suffixes alone in their bucket drop out.
Depths 8, 16, 32 and 64 lead to ``LENGTH`` (64 bytes at both ends).  All is
done on bytes: hashes only bring together what may be equal.

To keep the shuffle below the text's own size, suffixes travel by their anchor:
the least-named 50-gram among the first 51 places of the string (a minimiser).
Equal strings have the same anchor at the same offset.  One anchor stands for all
consecutive suffixes that share it, about 25.  Where a text has a period of up to 50
bytes, anchors would follow each other closely: strings that equal the one a period
before are found in place, and only the first period's suffixes travel.

1. Every task names its anchors and sends each name to its bucket once, packed
   with document, place and count; names met twice in a task are known at once.  A bucket
   answers which of its anchors occur again, to the parts of the documents, and which
   are held by more than ``HOT`` places.
2. Documents, dealt by a hash of the id into parts of about ``PART`` bytes, meet
   the answers.  Only suffixes at repeated anchors go on, as packed contexts; of
   equal contexts within a part only the earliest does, the rest are covered.  Contexts
   of hot anchors go on as single strings, each to the bucket of its own hash, so that
   a header before a million different texts is no bucket's own.
3. Each bucket keeps the earliest of equal contexts and refines the
   suffixes of those that differ.  Covered spans return to the parts, where the
   documents are still shuffled (the exchange is reused), and are cut out.

Exact copies of whole texts (by SHA-256) are found first and are only cut.  A name that
a third of all documents hold arrives once per task or part, not once per document.
Parts and buckets are sized from the total of bytes, without a ceiling; beyond ``FAN``
of them packets travel to ``FAN`` lanes first and are cut anew there, so packets
do not get small.  Texts are read in windows of a megabyte.

Defined cases: null and empty texts, and texts under 100 bytes, lose nothing; rows
that share a doc_id stand at the same place, so neither is earlier than the other, and
each loses what its own text repeats; null ids come after all others and share one
place; long and repetitive texts are as others, about 30 bytes of memory a byte of the
longest; kept columns named like an added one are left out; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

LENGTH, GRAM = 100, 50
PART, BUCKET, FAN = 16 << 20, 24 << 20, 2_048
#: Places of one anchor from which its strings go on singly; at most so many anchors do.
HOT, MOST_HOT = 50_000, 1 << 20
_WIDE = LENGTH - GRAM + 1
_LAST = (1 << 63) - 1
_NAME = np.uint64((1 << 56) - 1)
_ROW = "g long, kind int, blob binary"
#: Kinds of packets: columns, and which of them are stored as differences.
_FORMS = {
    0: (("<i8", "<i4", "<i4", "V7"), (0, 1)),  # names: id, place, count, name
    1: (("<i8", "<i4"), (0, 1)),  # answers: id, place
    2: (("<i8", "<i8", "<i4", "<i4"), (0, 2)),  # spans: id, tie, start, size
    5: (("<u8", "<u8", "<i8", "<i8", "<i4", "<i2"), ()),  # contexts: name, sum, id, tie, start, count; bytes
}
_LANE = 16  # added to the kind of a packet for a lane


def _pack(kind: int, cols: list[np.ndarray], text: bytes = b"") -> bytes:
    """The number of items, then each column's bytes, compressed."""
    kinds, stepped = _FORMS[kind]
    head = np.array([len(cols[0])], "<i8").tobytes()
    made = (np.ascontiguousarray(np.diff(x, prepend=x.dtype.type(0)) if k in stepped else x) for k, x in enumerate(np.asarray(x).astype(t, copy=False) if t != "V7" else x for x, t in zip(cols, kinds, strict=True)))
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(x.tobytes() for x in made) + text)


def _unpack(kind: int, blob: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    kinds, stepped = _FORMS[kind]
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(raw, "<i8", 1)[0]), 8, []
    for k, t in enumerate(kinds):
        x = np.frombuffer(raw, t, n, at)
        out.append(np.cumsum(x, dtype=x.dtype) if k in stepped else x)
        at += n * x.dtype.itemsize
    return out, np.frombuffer(raw, np.uint8, offset=at)


def _short(name: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(name.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).view("V7").ravel()


def _long(short: np.ndarray) -> np.ndarray:
    out = np.zeros((len(short), 8), np.uint8)
    out[:, :7] = np.frombuffer(short.tobytes(), np.uint8).reshape(-1, 7)
    return out.view("<u8")[:, 0]


def _spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places of runs of ``n`` from ``begin`` on, one after the other."""
    return np.repeat(begin - np.cumsum(np.append(0, n))[:-1], n) + np.arange(int(n.sum()))


def windows(batches: Iterable[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """(bytes, offsets, row numbers, place of the first byte, lead) of about ``limit``
    bytes of text; a longer text comes in windows that overlap, with ``lead`` bytes before
    the first suffix meant."""
    passed = 0
    for batch in batches:
        data, off = c.column_bytes(batch.column("text"))
        at = 0
        while at < batch.num_rows:
            n = int(off[at + 1] - off[at])
            if n > 2 * limit:
                for a in range(0, n - LENGTH + 1, limit):
                    lead = min(a, GRAM)
                    lo, hi = a - lead, min(n, a + limit + LENGTH - 1)
                    yield data[off[at] + lo : off[at] + hi], np.array([0, hi - lo]), np.array([passed + at]), lo, lead
                at += 1
                continue
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
            yield data[off[at] : off[to]], off[at : to + 1] - off[at], np.arange(passed + at, passed + to), 0, 0
            at = to
        passed += batch.num_rows
    c.release()


def _runs(place: np.ndarray, inside: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of the runs of suffixes that share a place; none goes on beyond a
    row's start or a suffix that is not inside."""
    new = inside.copy()
    new[1:] &= (place[1:] != place[:-1]) | ~inside[:-1]
    new[starts] = inside[starts]
    first = np.flatnonzero(new)
    stop = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True)) + 1
    return first, stop


def _periodic(data: np.ndarray, place: np.ndarray, name: np.ndarray, row_start: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Suffixes whose LENGTH bytes equal those a period before, in the same row.  Periods
    are told by anchors of one name that follow each other within GRAM bytes."""
    covered = np.zeros(len(place), bool)
    if len(first) < 2:
        return covered
    at = place[first]
    period = np.append(0, np.diff(at))
    tie = np.append(False, (name[at[1:]] == name[at[:-1]]) & (first[1:] == stop[:-1]) & (row_start[1:] == row_start[:-1])) & (period > 0) & (period <= GRAM)
    k = np.flatnonzero(tie)
    if not len(k):
        return covered
    lead = np.append(True, (k[1:] != k[:-1] + 1) | (period[k[1:]] != period[k[:-1]]))
    head, tail = k[lead], k[np.append(lead[1:], True)]
    begin, n = first[head], stop[tail] - first[head]
    wide = n + LENGTH - 1
    here = _spread(begin, wide)
    back = here - np.repeat(period[head], wide)
    differ = (back < np.repeat(row_start[head], wide)) | (data[here] != data[np.maximum(back, 0)])
    sums = np.append(0, np.cumsum(differ))
    local = _spread(np.cumsum(np.append(0, wide))[:-1], n)
    same = sums[local + LENGTH] == sums[local]
    covered[_spread(begin, n)[same]] = True
    return covered


def anchors(data: np.ndarray, offsets: np.ndarray, lead: int = 0):
    """Runs of suffixes that share an anchor: (row, first suffix, number of
    suffixes, anchor place, anchor name), places within the batch; the (row, start, end)
    that strings of these rows cover by a period; and the prefix hashes of the batch."""
    n = len(data)
    prefix = c.prefix_hash(c.BYTE_CODE[data])
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return (none, none, none, none, np.zeros(0, np.uint64)), (none, none, none), prefix
    name = c.mix((prefix[GRAM:] - prefix[:-GRAM]) * c.powers(n + 1, "down")[: n + 1 - GRAM]) & _NAME
    low = (name << c.U64(8) & c.U64(0xFFFFFFFF00000000)) | np.arange(len(name), dtype=np.uint64)
    width = 1
    while width * 2 <= _WIDE:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < _WIDE:
        low = np.minimum(low[: -(_WIDE - width)], low[_WIDE - width :])
    place = (low & c.U64(0xFFFFFFFF)).astype(np.int64)  # of the suffix at 0 .. n - LENGTH
    size = np.diff(offsets)
    rows = np.flatnonzero(size >= LENGTH)
    mark = np.zeros(len(place) + 1, np.int8)
    mark[offsets[rows]] += 1
    np.add.at(mark, offsets[rows] + size[rows] - LENGTH + 1, -1)
    inside = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
    starts = offsets[rows]
    first, stop = _runs(place, inside, starts)
    row = np.searchsorted(offsets, first, side="right") - 1
    covered = _periodic(data, place, name, offsets[row], first, stop)
    inside[:lead] = False
    covered &= inside
    spans = none, none, none
    if covered.any():
        s_first, s_stop = _runs(np.zeros(len(place), np.int64), covered, starts)
        spans = np.searchsorted(offsets, s_first, side="right") - 1, s_first, s_stop + LENGTH - 1
    if lead or covered.any():
        first, stop = _runs(place, inside & ~covered, starts)
        row = np.searchsorted(offsets, first, side="right") - 1
    return (row, first, stop - first, place[first], name[place[first]]), spans, prefix


def _ids(batch) -> np.ndarray:
    col = batch.column("doc_id")
    return np.array([_LAST if x is None else x for x in col.to_pylist()], np.int64) if col.null_count else col.to_numpy(zero_copy_only=False).astype(np.int64)


def _ties(docs) -> tuple[np.ndarray, np.ndarray]:
    """(id, tie) of each row of a part, which has all rows of its ids: rows that share
    an id are told apart by the digest of their text; the tie of any other row is 0."""
    own = np.concatenate([np.zeros(0, np.int64), *(_ids(b) for b in docs.to_batches() if b.num_rows)])
    tie = np.zeros(len(own), np.int64)
    _, at, count = np.unique(own, return_inverse=True, return_counts=True)
    texts = docs.column("text")
    for k in np.flatnonzero(count[at] > 1):
        tie[k] = _digest(hashlib.sha256(texts[k].as_buffer() or b"").digest())
    return own, tie


def _digest(sha: bytes) -> int:
    return int.from_bytes(sha[:8], "little", signed=True)


def _numbers(*keys: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """A number for each (id, tie) of several lists, equal for equal pairs only."""
    ids, tie = (np.concatenate(x) for x in zip(*keys, strict=True))
    order = np.lexsort((tie, ids))
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(np.append(0, (ids[order][1:] != ids[order][:-1]) | (tie[order][1:] != tie[order][:-1])))[: len(order)]
    return np.split(out, np.cumsum([len(x[0]) for x in keys])[:-1])


def _earliest(name, sums, ids, tie, start) -> tuple[np.ndarray, np.ndarray]:
    """Of equal contexts: those at the earliest place, each row's once, and those
    that start later, whose bytes are covered."""
    order = np.lexsort((tie, start, ids, sums, name))
    if not len(order):
        return order, order
    differ = lambda *cols: np.append(True, np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in cols]))
    group = differ(name, sums)
    place = np.cumsum(differ(name, sums, ids, start))
    later = place > place[group][np.cumsum(group) - 1]
    return order[~later & differ(name, sums, ids, start, tie)], order[later]


def _part_of(ids: np.ndarray, parts: int) -> np.ndarray:
    return (c.mix(ids.astype(np.uint64)) % c.U64(parts)).astype(np.int64)


def _by(key: np.ndarray):
    """(value, indexes) of each distinct value."""
    order = np.argsort(key, kind="stable")
    cut = np.flatnonzero(np.diff(key[order])) + 1
    for some in np.split(order, cut):
        if len(some):
            yield int(key[some[0]]), some


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    g, kind, blob = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], names=["g", "kind", "blob"])


class _Deal:
    """Where packets go: names and contexts to buckets (g >= 0), answers and spans to
    parts (g < 0); beyond FAN of these, to lanes that cut them anew."""

    def __init__(self, parts: int, buckets: int):
        self.parts, self.buckets = parts, buckets

    def key(self, kind: int, cols: list[np.ndarray]) -> np.ndarray:
        if kind in (1, 2):
            return _part_of(cols[0], self.parts)
        name = _long(cols[3]) if kind == 0 else cols[0]
        return ((name >> c.U64(16)) % c.U64(self.buckets)).astype(np.int64)

    def put(self, kind: int, cols: list[np.ndarray], out: list, text: np.ndarray | None = None, begin: np.ndarray | None = None, size: np.ndarray | None = None, final: bool = False) -> None:
        """Append the packets of a table; of contexts with the bytes at ``begin``."""
        if not len(cols[0]):
            return
        key = self.key(kind, cols)
        groups = self.parts if kind in (1, 2) else self.buckets
        lanes = groups > FAN and not final
        for g, some in _by(key % FAN if lanes else key):
            stepped = _FORMS[kind][1]
            if stepped:
                some = some[np.lexsort((cols[stepped[1]][some], cols[stepped[0]][some]))]
            blob = _pack(kind, [x[some] for x in cols], b"" if text is None else text[_spread(begin[some], size[some])].tobytes())
            out.append((-1 - g if kind in (1, 2) else g, kind | _LANE * lanes, blob))

    def gathered(self, rows: DataFrame) -> DataFrame:
        """Packets by their last group."""
        if max(self.parts, self.buckets) <= FAN:
            return rows
        deal = self

        def run(batches, flush: int = 64 << 20):
            held: dict[int, list] = {}
            size, lane, out = 0, None, []

            def cut():
                for kind, blobs in held.items():
                    cols, text = _tables(kind, blobs)
                    length = cols[5].astype(np.int64) + LENGTH - 1 if kind == 5 else None
                    deal.put(kind, cols, out, text if kind == 5 else None, None if length is None else np.cumsum(np.append(0, length))[:-1], length, final=True)

            for batch in batches:
                for g, kind, blob in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    if not kind & _LANE:
                        out.append((g, kind, blob))
                        continue
                    if size > flush or g != lane:
                        cut()
                        held, size, lane = {}, 0, g
                    held.setdefault(kind - _LANE, []).append(blob)
                    size += zstandard.frame_content_size(blob)
                if out:
                    yield _batch(out)
                    out = []
            cut()
            yield _batch(out)

        return rows.repartition("g").sortWithinPartitions("g").mapInArrow(run, _ROW)


def _tables(kind: int, blobs: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """Packets of one kind as one table, and the bytes of contexts."""
    got = [_unpack(kind, b) for b in blobs]
    if not got:
        return [np.zeros(0, t) for t in _FORMS[kind][0]], np.zeros(0, np.uint8)
    return [np.concatenate(x) for x in zip(*(g[0] for g in got), strict=True)], np.concatenate([g[1] for g in got])


def _blobs(table, kind: int) -> list[bytes]:
    return [b for k, b in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist(), strict=True) if k == kind]


def _name_anchors(deal: _Deal, flush: int = 1 << 20):
    """Step 1, map side."""

    def emit(held):
        name, ids, place = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((place, ids, name))
        name, ids, place = name[order], ids[order], place[order]
        first = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
        count = np.diff(np.append(first, len(name)))
        again = np.repeat(count > 1, count)
        out: list = []
        deal.put(1, [ids[again], place[again].astype(np.int32)], out)
        deal.put(0, [ids[first], place[first].astype(np.int32), np.minimum(count, 1 << 30).astype(np.int32), _short(name[first])], out)
        return _batch(out)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            every = _ids(batch)
            for data, off, rows, base, lead in windows([batch]):
                (row, _, _, place, name), _, _ = anchors(data, off, lead)
                held.append((name, every[rows[row]], place - off[row] + base))
                n += len(row)
                if n >= flush:
                    yield emit(held)
                    held, n = [], 0
        if n:
            yield emit(held)

    return run


def _repeated(deal: _Deal, hot: int):
    """Step 1, bucket side: which anchors occur again, and which often."""

    def run(key, table):
        if key[0].as_py() < 0:
            return table
        (ids, place, count, short), _ = _tables(0, _blobs(table, 0))
        name = _long(short)
        order = np.argsort(name, kind="stable")
        first = np.flatnonzero(np.append(True, name[order][1:] != name[order][:-1]))
        total = np.add.reduceat(count[order].astype(np.int64), first)
        # names met twice in a task are answered already
        hit = order[np.repeat(total > 1, np.diff(np.append(first, len(order))))]
        hit = hit[count[hit] == 1]
        out: list = []
        deal.put(1, [ids[hit], place[hit]], out)
        often = np.flatnonzero(total > hot)
        out += [(int(n), 4, int(t).to_bytes(8, "big")) for n, t in zip(name[order][first[often]], total[often], strict=True)]
        return pa.Table.from_batches([_batch(out)])

    return run


def _spans(deal: _Deal, ids, tie, start, end, out) -> None:
    """Covered bytes, to their parts."""
    deal.put(2, [ids, tie, start.astype(np.int32), (end - start).astype(np.int32)], out)


def _same_bytes(order: np.ndarray, name, sums, text: np.ndarray, begin, length) -> np.ndarray:
    """``sums`` with a value of its own for each context whose bytes are not those of the
    first with its name and sum."""
    raw, sums = text.tobytes(), sums.copy()
    lead = -1
    for i in order.tolist():
        if lead < 0 or name[i] != name[lead] or was != sums[i]:
            lead, was = i, sums[i]
        elif length[i] != length[lead] or raw[begin[i] : begin[i] + length[i]] != raw[begin[lead] : begin[lead] + length[lead]]:
            sums[i] = c.U64(c.mix_int(int(sums[i]) + i + 1))
    return sums


def _contexts(deal: _Deal, hot: np.ndarray, flush: int = 64 << 20):
    """Step 2: the suffixes at repeated anchors, with what follows them."""

    def run(docs, known):
        (ids, at), _ = _tables(1, _blobs(known, 1))
        order = np.lexsort((at, ids))
        ids, at = ids[order], at[order].astype(np.int64)
        copies = [(g, _digest(blob)) for kind, blob, g in zip(known.column("kind").to_pylist(), known.column("blob").to_pylist(), known.column("g").to_pylist(), strict=True) if kind == 3]
        every, ties = _ties(docs)
        copy_id, copy_tie = np.array(copies, np.int64).reshape(-1, 2).T
        shared = np.unique(every[ties != 0])
        row_key, copy_key = _numbers((every, ties), (copy_id, np.where(np.isin(copy_id, shared), copy_tie, 0)))
        copied = np.isin(row_key, copy_key)
        held: list = []
        out: list = []
        size_of = np.concatenate([np.zeros(0, np.int64), *(np.diff(c.column_bytes(b.column("text"))[1]) for b in docs.to_batches() if b.num_rows)])
        whole = np.flatnonzero(copied & (size_of >= LENGTH))
        _spans(deal, every[whole], ties[whole], np.zeros(len(whole), np.int64), size_of[whole], out)

        def put():
            name, sums, own, tie, start, count, length, text = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            begin = np.cumsum(np.append(0, length))[:-1]
            sums = _same_bytes(np.lexsort((sums, name)), name, sums, text, begin, length)
            order, rest = _earliest(name, sums, own, tie, start)
            _spans(deal, own[rest], tie[rest], start[rest], start[rest] + length[rest], out)
            if len(hot):  # strings of their own
                often = np.isin(name[order], hot)
                some, order = order[often], order[~often]
                n = count[some]
                which = np.repeat(some, n)
                step = _spread(np.zeros(len(some), np.int64), n)
                prefix = c.prefix_hash(c.BYTE_CODE[text])
                place = begin[which] + step
                one = c.mix(c.span_hash(prefix, place, place + LENGTH)) & _NAME
                deal.put(5, [one, one, own[which], tie[which], start[which] + step, np.ones(len(which), np.int16)], out, text, place, np.full(len(which), LENGTH))
            deal.put(5, [x[order] for x in (name, sums, own, tie, start, count)], out, text, begin[order], length[order])

        total = 0
        for data, off, rows, base, lead in windows(docs.to_batches()):
            own, tie, is_copy = every[rows], ties[rows], copied[rows]
            (row, first, count, place, name), (s_row, s_start, s_end), prefix = anchors(data, off, lead)
            covered = ~is_copy[s_row]
            s_row, s_start, s_end = s_row[covered], s_start[covered], s_end[covered]
            _spans(deal, own[s_row], tie[s_row], s_start - off[s_row] + base, s_end - off[s_row] + base, out)
            # the documents' own answers, as (row, place) numbers
            one = np.unique(own)
            a, b = np.searchsorted(ids, one), np.searchsorted(ids, one, side="right")
            wanted = np.unique((np.repeat(np.arange(len(one)), b - a) << 40) | at[_spread(a, b - a)])
            mine = (np.searchsorted(one, own)[row] << 40) | (place - off[row] + base)
            found = np.searchsorted(wanted, mine)
            keep = (found < len(wanted)) & ~is_copy[row]
            keep[keep] = wanted[found[keep]] == mine[keep]
            row, first, count, place, name = (x[keep] for x in (row, first, count, place, name))
            last = first + count + LENGTH - 1
            sums = c.mix(c.span_hash(prefix, first, last) + c.mix(((place - first) << 8 | count).astype(np.uint64)))
            held.append((name, sums, own[row], tie[row], first - off[row] + base, count, last - first, data[_spread(first, last - first)]))
            total += int((last - first).sum())
            if total > flush:
                put()
                total = 0
        if held:
            put()
        return pa.Table.from_batches([_batch(out)])

    return run


def refine(text: np.ndarray, suffix: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which suffixes equal, over LENGTH bytes, one of lower rank.

    ``suffix`` are places in ``text``.  ``bucket`` holds the identifier of the bucket that
    each place is in, at the present depth; -1 where it is alone."""

    def buckets(key):
        order = np.argsort(key, kind="stable")
        run = key[order]
        new = np.append(True, run[1:] != run[:-1])
        out = np.empty(len(key), np.int64)
        out[order] = np.where(new & np.append(new[1:], True), -1, np.cumsum(new))
        return out

    size = len(text) - 7
    grams = np.ndarray((size,), "<u8", text.tobytes(), strides=(1,))
    bucket, depth = buckets(grams.copy()), 8
    while depth < 64:
        at = np.flatnonzero((bucket[:-depth] >= 0) & (bucket[depth:] >= 0))
        finer = np.full(size, -1)
        finer[at] = buckets(bucket[at] * (size + 1) + bucket[at + depth])
        bucket, depth = finer, 2 * depth
    out = np.zeros(len(suffix), bool)
    far = bucket[suffix + LENGTH - depth]
    live = np.flatnonzero((bucket[suffix] >= 0) & (far >= 0))
    if len(live):
        key = bucket[suffix[live]] * (size + 1) + far[live]
        order = np.lexsort((rank[live], key))
        first = np.append(True, key[order][1:] != key[order][:-1])
        low = rank[live[order]]
        out[live[order[low > low[first][np.cumsum(first) - 1]]]] = True
    return out


def _refined(deal: _Deal, chunk: int = 2 << 20):
    """Step 3: covered spans among the contexts of an anchor bucket."""

    def run(key, table):
        if key[0].as_py() < 0:
            return table
        (name, sums, ids, tie, start, count), text = _tables(5, _blobs(table, 5))
        start, count = start.astype(np.int64), count.astype(np.int64)
        length = count + LENGTH - 1
        begin = np.cumsum(np.append(0, length))[:-1]
        out: list = []
        sums = _same_bytes(np.lexsort((sums, name)), name, sums, text, begin, length)
        order, rest = _earliest(name, sums, ids, tie, start)
        _spans(deal, ids[rest], tie[rest], start[rest], start[rest] + length[rest], out)
        run_of = name[order]
        first = np.flatnonzero(np.append(True, run_of[1:] != run_of[:-1]))
        sizes = np.diff(np.append(first, len(order)))
        order = order[np.repeat(sizes > 1, sizes)]  # a single context repeats nothing else
        found = []
        at = 0
        total = np.cumsum(length[order])
        ends = np.flatnonzero(np.append(name[order][1:] != name[order][:-1], True)) + 1 if len(order) else np.zeros(0, np.int64)
        while at < len(order):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + chunk, side="right")))
            to = int(ends[np.searchsorted(ends, to)])  # with all contexts of the last name
            some = order[at:to]
            n = length[some]
            place = np.cumsum(np.append(0, n))[:-1]
            m = count[some]
            which = np.repeat(np.arange(len(some)), m)
            step = _spread(np.zeros(len(some), np.int64), m)
            where = start[some][which] + step
            rank = np.empty(len(which), np.int64)
            by = np.lexsort((where, ids[some][which]))
            i, w = ids[some][which][by], where[by]
            rank[by] = np.cumsum(np.append(0, (i[1:] != i[:-1]) | (w[1:] != w[:-1])))  # rows that share an id have equal ranks
            hit = refine(text[_spread(begin[some], n)], place[which] + step, rank)
            on = np.flatnonzero(hit)
            if len(on):
                lead = np.append(True, (which[on][1:] != which[on][:-1]) | (on[1:] != on[:-1] + 1))
                tail = np.append(lead[1:], True)
                found.append((ids[some][which[on[lead]]], tie[some][which[on[lead]]], where[on[lead]], where[on[tail]] + LENGTH))
            at = to
        if found:
            _spans(deal, *(np.concatenate(x) for x in zip(*found, strict=True)), out)
        return pa.Table.from_batches([_batch(out)])

    return run


def _cut(keep: list[str], with_text: bool):
    """The last step: what is left of each document."""

    def run(docs, known):
        ids, tie, start, size = (x.astype(np.int64) for x in _tables(2, known.column("blob").to_pylist())[0])
        rows, ids = _numbers(_ties(docs), (ids, tie))
        order = np.argsort(ids, kind="stable")
        ids, start, size = ids[order], start[order], size[order]
        done, passed = [], 0
        for batch in c.pieces(docs.to_batches(), limit=1 << 20):
            data, off = c.column_bytes(batch.column("text"))
            own = rows[passed : passed + batch.num_rows]
            passed += batch.num_rows
            a, b = np.searchsorted(ids, own), np.searchsorted(ids, own, side="right")
            take = _spread(a, b - a)
            base = np.repeat(off[:-1], b - a)
            s, e = base + start[take], base + start[take] + size[take]
            depth = np.zeros(len(data) + 1, np.int32)
            np.add.at(depth, s, 1)
            np.add.at(depth, e, -1)
            gone = np.cumsum(depth[:-1]) > 0
            lost = np.concatenate([[0], np.cumsum(gone)])
            edge = gone.copy()
            edge[1:] &= ~gone[:-1]
            heads = off[:-1][np.diff(off) > 0]
            edge[heads] = gone[heads]
            runs = np.concatenate([[0], np.cumsum(edge)])
            kept = data[~gone].tobytes()
            cut = (off - lost[off]).tolist()
            parts = [kept[x:y] for x, y in zip(cut, cut[1:], strict=False)]
            cols = [*(batch.column(k) for k in keep), pa.array(np.diff(off)), pa.array(lost[off[1:]] - lost[off[:-1]]), pa.array(runs[off[1:]] - runs[off[:-1]]), pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string())]
            names = [*keep, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                cols.append(pa.array([x.decode("utf-8", "ignore") for x in parts], pa.string()))
                names.append("kept_text")
            done.append(pa.RecordBatch.from_arrays(cols, names=names))
        return pa.Table.from_batches(done) if done else None

    return run


_ADDED = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")


def cut_repeats(docs: DataFrame, keep: list[str] | None = None, with_text: bool = False) -> DataFrame:
    """``keep`` columns (default: doc_id) of every row, n_bytes, n_removed, n_spans,
    kept_sha256 and, if asked for, kept_text (characters cut in part are dropped)."""
    added = _ADDED if with_text else _ADDED[:-1]
    keep = [k for k in keep or ["doc_id"] if k.lower() not in added]
    found = _cut_rows(docs, keep, with_text)
    return found.select(*(F.col(f"row.`{k}`").alias(k) for k in keep), *added)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the texts that are left; ``n_chars``, where there, is theirs."""
    other = [k for k in docs.columns if k != "text"]
    found = _cut_rows(docs, other, True)
    kind = docs.schema
    shown = [F.col("kept_text").alias(k) if k == "text" else F.length("kept_text").cast(kind[k].dataType).alias(k) if k == "n_chars" else F.col(f"row.`{k}`").alias(k) for k in docs.columns]
    return found.select(*shown)


def _cut_rows(docs: DataFrame, keep: list[str], with_text: bool) -> DataFrame:
    """``row``, the columns to keep as a struct, and the added columns."""
    id_of = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    sums = c.staged(docs.select(id_of.alias("id"), F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("sum"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n")), "sums")
    total, rows = sums.agg(F.sum("n"), F.count("*")).first()
    parts, buckets = (max(1, -(-(total or 0) // x)) for x in (PART, BUCKET))
    deal = _Deal(parts, buckets)
    groups = sums.where(F.col("n") >= LENGTH).groupBy("sum").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("_n")).where("least < most")
    copies = c.join_counted(sums, groups, ["sum"], "_n", rows).where("id > least").select("id", "sum").distinct()

    one = F.pandas_udf(lambda s: _series(_part_of(s.to_numpy().astype(np.int64), parts)), "long")
    row = F.struct(*(F.col(f"`{k}`") for k in keep)) if keep else F.struct(F.lit(None).cast("int").alias("none"))
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row.alias("row"), "text").withColumn("part", one(id_of))
    named = deal.gathered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_name_anchors(deal), _ROW)).groupBy("g").applyInArrow(_repeated(deal, HOT), _ROW)
    answers = c.staged(deal.gathered(named), "answers")
    often = answers.where("kind = 4").orderBy(F.desc("blob"), "g").limit(MOST_HOT).select("g").collect()
    hot = np.sort(np.array([r.g for r in often], np.int64).astype(np.uint64))
    told = answers.where("kind = 1").select((-1 - F.col("g")).alias("part"), "g", "kind", "blob").union(copies.select(one("id").alias("part"), F.col("id").alias("g"), F.lit(3).alias("kind"), F.col("sum").alias("blob")))
    contexts = deal.gathered(placed.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(_contexts(deal, hot), _ROW))
    spans = deal.gathered(contexts.groupBy("g").applyInArrow(_refined(deal), _ROW))
    spans = spans.select((-1 - F.col("g")).alias("part"), "blob")
    schema = f"row {_quoted(placed)}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return placed.groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(_cut(["row"], with_text), schema)


def _quoted(placed: DataFrame) -> str:
    return "struct<" + ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in placed.schema["row"].dataType.fields) + ">"


def _series(x):
    import pandas as pd

    return pd.Series(x)


def op4_suffixes(spark, sf_dir: str) -> DataFrame:
    return cut_repeats(c.table(spark, sf_dir, "documents"))


#: Every string of 100 bytes, by its MD5, and where it starts first.
OP4_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t, hex(encode(coalesce(text, ''))) AS h FROM documents),
m AS (SELECT doc_id, list_transform(range(0, greatest(octet_length(t) - 99, 0)), lambda i: md5(t[i + 1:i + 100])) AS x FROM d),
p AS (SELECT doc_id, unnest(x) AS k, unnest(range(0, len(x))) AS s FROM m),
w AS (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS nth FROM p),
g AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS new FROM w WHERE nth > 1),
i AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM g),
r AS (SELECT doc_id, span, min(s) AS a, max(s) + 100 AS b FROM i GROUP BY doc_id, span),
o AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
t AS (SELECT o.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) AS head, max(b) AS last FROM o JOIN d ON d.doc_id = o.doc_id GROUP BY o.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM d LEFT JOIN t ON t.doc_id = d.doc_id
"""
