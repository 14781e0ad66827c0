"""Documents that arrive in chunks, judged while they grow.

Input: a stream of (doc_id, seq, chunk, eof).  The state of a document is the text from
its last block on, what was found before that, and the chunks that came before their
turn: a batch judges what is new, and blocks that no text can change are dropped.  With
``fast_fail`` a document that
can no longer become valid is reported and closed before its end; the report of a
document that ended equals that of the whole text.  Chunks for a closed document are
reported as late, with their number.  A document that stops growing for ``ttl`` is judged as it is, with
status ``timeout``, and its state is dropped.

Defined cases: a chunk that comes twice counts once; null chunks are empty; a missing
chunk keeps the document open; what is beyond the last chunk is ignored.
"""

from __future__ import annotations

import json
import pickle
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from quillgrid.operators.api import failure, json_of
from quillgrid.operators.compare import Growing

OUTPUT = "doc_id string, status string, is_valid boolean, value string, n_errors int, errors string"
_NAMES = [x.split()[0] for x in OUTPUT.split(", ")]
_STATE = "growing string, pending map<int,string>, next int, last int, closed boolean"
#: Open text below so many characters is not judged before its end, unless by ``fast_fail``.
SHORT = 4096
#: Groups that documents share in :func:`run_to_end`: one has few even among many millions.
BUCKETS = 4096


def _report(key: str, status: str, growing: Growing, complete: bool) -> tuple:
    try:
        found = growing.judge(complete)
        valid, value, errors = not found.errors, json_of(found.value), found.errors
    except Exception as wrong:  # one odd document must not end the stream
        valid, value, errors = failure(wrong)
    return key, status, valid, value, len(errors), json.dumps(errors, ensure_ascii=False) if errors else "[]"


def _advance(schema: str, fast_fail: bool, key: str, held: tuple | None, rows: list[tuple]) -> tuple[tuple, tuple | None]:
    """A document's next state, and what is to report, from new (seq, chunk, eof)."""
    text, pending, at, last, closed = held or (None, {}, 0, -1, False)
    if closed:
        return (None, {}, at, last, True), (key, "late", None, None, len(rows), None) if rows else None
    pending = dict(pending or {})
    for seq, chunk, eof in rows:
        if eof:
            last = seq
        if seq >= at:
            pending.setdefault(seq, chunk if isinstance(chunk, str) else "")
    growing = Growing.of(schema, text) if text else Growing(schema)
    fresh = []
    while at in pending and (last < 0 or at <= last):
        fresh.append(pending.pop(at))
        at += 1
    growing.read("".join(fresh))
    out = None
    if 0 <= last < at:
        closed, out = True, _report(key, "complete", growing, True)
    elif fresh and (fast_fail or len(growing.text) > SHORT):
        found = _report(key, "failed", growing, False)
        if fast_fail and found[2] is False:  # None where our own code failed
            closed, out = True, found
    return ((None, {}, at, last, True) if closed else (growing.state(), pending, at, last, False)), out


def _stepper(schema: str, fast_fail: bool, ttl_ms: int | None):
    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        if state.hasTimedOut:
            state.remove()
            if not held[4]:
                growing = Growing.of(schema, held[0]) if held[0] else Growing(schema)
                yield pd.DataFrame([_report(key[0], "timeout", growing, True)], columns=_NAMES)
            return
        rows = [row for frame in frames for row in zip(*(frame[k].tolist() for k in ("seq", "chunk", "eof")), strict=True)]
        held, out = _advance(schema, fast_fail, key[0], held, rows)
        if out:
            yield pd.DataFrame([out], columns=_NAMES)
        state.update(held)
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)

    return step


def _bucket_stepper(schema: str, fast_fail: bool):
    """Many documents in one group: what a group costs in Spark is far more than what a
    short document costs.  Of closed documents the state holds the ids."""

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, closed = pickle.loads(zlib.decompress(state.get[0])) if state.exists else ({}, set())
        fresh: dict[str, list] = {}
        for frame in frames:
            for doc, *row in zip(*(frame[k].tolist() for k in ("doc_id", "seq", "chunk", "eof")), strict=True):
                fresh.setdefault(doc, []).append(row)
        out = []
        for doc, rows in fresh.items():
            own, found = _advance(schema, fast_fail, doc, (None, {}, 0, -1, True) if doc in closed else held.get(doc), rows)
            if found:
                out.append(found)
            if own[4]:
                closed.add(doc)
                held.pop(doc, None)
            else:
                held[doc] = own
        state.update((zlib.compress(pickle.dumps((held, closed), pickle.HIGHEST_PROTOCOL), 1),))
        if out:
            yield pd.DataFrame(out, columns=_NAMES)

    return step


def validate_stream(chunks: DataFrame, schema: str, fast_fail: bool = False, ttl_ms: int | None = 3_600_000, buckets: int | None = None) -> DataFrame:
    """A streaming DataFrame of reports (append mode).  Without ``ttl_ms`` states stay.

    With ``buckets`` documents share so many states: for batches that touch most of the
    documents.  A bucket's state is written anew by every batch that touches it."""
    given = chunks.selectExpr("cast(doc_id as string) as doc_id", "cast(seq as int) as seq", "chunk", "coalesce(eof, false) as eof")
    if buckets:
        if ttl_ms is not None:
            raise ValueError("documents that share a state have no time limit of their own")
        given = given.withColumn("bucket", F.expr(f"pmod(xxhash64(doc_id), {buckets}L)"))
        return given.groupBy("bucket").applyInPandasWithState(_bucket_stepper(schema, fast_fail), OUTPUT, "held binary", "append", GroupStateTimeout.NoTimeout)
    limit = GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return given.groupBy("doc_id").applyInPandasWithState(_stepper(schema, fast_fail, ttl_ms), OUTPUT, _STATE, "append", limit)


def run_to_end(chunks: DataFrame, schema: str, folder: str, **options) -> DataFrame:
    """Judge what a stream has now, through checkpoint and sink under ``folder``.

    States do not time out here: a processing-time limit would keep a run that ends
    with its input going."""
    sink = f"{folder}/reports"
    query = validate_stream(chunks, schema, ttl_ms=None, **{"buckets": BUCKETS} | options).writeStream.format("parquet").option("path", sink).option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return chunks.sparkSession.read.schema(OUTPUT).parquet(sink)
