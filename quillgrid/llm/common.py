"""Shared pieces: shared-storage staging, vectorised text scanning, components.

All text kernels work on whole Arrow batches: one contiguous byte buffer with
row offsets, never a Python loop over characters.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow table that one task may well hold.
PLAIN = 1_000_000
U64 = np.uint64
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
#: Random 64-bit value of each byte, and the same with A-Z read as a-z.
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
LOWER_CODE = BYTE_CODE.copy()
LOWER_CODE[65:91] = BYTE_CODE[97:123]
#: The separators of a word: space and \t \n \v \f \r.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: For features of words: whatever is ASCII and no letter separates.
IS_GAP = np.zeros(256, dtype=bool)
IS_GAP[:128] = True
IS_GAP[65:91] = IS_GAP[97:123] = False
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only a local session that has none, as in tests, gets a temporary one: on a cluster
    every executor would write to its own disk, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: it names the folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillgrid-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def work_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; Spark's JVM deletes it at its end."""
    path = f"{shared_dir(spark)}/quillgrid/{spark.sparkContext.applicationId}"
    at, system = _hadoop(spark, path)
    system.mkdirs(at)  # only what is there can be marked
    system.deleteOnExit(at)
    return path


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: cuts the lineage,
    survives lost executors, and keeps later scans columnar."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        at, system = _hadoop(df.sparkSession, df._staged_at)
        system.delete(at, True)


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores before it until no column of ``taken`` has it."""
    taken = {x.lower() for x in taken}
    while name.lower() in taken:
        name = "_" + name
    return name


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], copies: str, total: int, share: int = 5_000, plain: int = PLAIN) -> DataFrame:
    """Inner join on ``keys``, unique in ``right``, whose column ``copies`` counts the
    rows of ``left`` with that key, of ``total``.  Keys of more than one row in ``share``
    (fewer than ``share`` of them) are broadcast, so no key's rows meet in one task.
    A table of up to ``plain`` narrow rows is no more than a task anyway, and joined plainly.

    A larger ``left`` is read twice: it should be a staged table."""
    if total <= plain:
        return left.join(right, keys)
    hot = F.broadcast(right.where(F.col(copies) * share > total))
    met = left.join(hot, keys)
    rest = left.join(F.broadcast(right.where(F.col(copies) * share > total).select(*keys)), keys, "left_anti")
    return met.unionByName(rest.join(right.where(F.col(copies) * share <= total), keys))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def mix_int(x: int) -> int:
    x &= _MASK
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & _MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & _MASK
    return x ^ (x >> 31)


_powers = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def powers(n: int, which: str, most_kept: int = 1 << 21) -> np.ndarray:
    """``base**i`` (up) or its inverse (down) for i < n, kept between batches up to
    ``most_kept``: one very long text does not stay in the worker's memory."""
    have = _powers[which]
    while len(have) < n:
        step = pow(_BASE if which == "up" else _BASE_INV, len(have), 1 << 64)
        have = np.concatenate([have, have * U64(step)])
        if len(have) <= most_kept:
            _powers[which] = have
    return have[:n]


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """P with P[j]-P[i] = sum of codes[i:j] times the powers of their places."""
    out = np.zeros(len(codes) + 1, U64)
    np.cumsum(codes * powers(len(codes), "up"), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span, the same for equal bytes wherever they stand."""
    return (prefix[end] - prefix[start]) * powers(len(prefix), "down")[start]


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as (bytes, offsets); nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if not len(col) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def release() -> None:
    """Give freed memory back: workers are kept between tasks, what they held once
    would count from then on."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of ``column`` (one
    row at least): the kernels' memory does not follow Spark's batch size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = column_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    release()


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of words before each row.

    ``between`` marks the bytes that separate words; rows separate them too."""
    n = len(data)
    flags = np.ones(n + 2, bool)
    flags[1:-1] = between[data]
    space = flags[1:-1]
    first = ~space & flags[:-2]
    last = ~space & flags[2:]
    cut = offsets[(offsets > 0) & (offsets < n)]
    first[cut] = ~space[cut]
    last[cut - 1] = ~space[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``width`` lower-cased (A-Z) words, in order, and the
    number of runs before each row.  A row of fewer words is one run of them all."""
    start, end, upto = words(data, offsets)
    word = mix(span_hash(prefix_hash(LOWER_CODE[data]), start, end)) if len(start) else np.zeros(0, U64)
    have = np.diff(upto)
    runs = np.where(have >= width, have - width + 1, (have > 0).astype(np.int64))
    first = np.zeros(len(offsets), np.int64)
    np.cumsum(runs, out=first[1:])
    total = int(first[-1])
    key = np.zeros(total, U64)
    if total:
        row = np.repeat(np.arange(len(runs)), runs)
        at = np.arange(total) - first[row] + upto[row]
        limit = upto[row + 1]
        for k in range(width):
            key = key * U64(_BASE) + np.where(at + k < limit, word[np.minimum(at + k, len(word) - 1)], U64(0))
        key = mix(key)
    return key, first


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) with component the least node reachable; from (src, dst).

    Alternating large-star and small-star steps on distributed edges (Kiveris
    et al. 2014): every step maps each edge end to the least neighbour, by a partial
    aggregation and a join in which the nodes with most edges are broadcast, so a hub's
    edges are in no step gathered in one task.
    """
    pairs = staged(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), name)
    while not _stars(pairs):
        total = pairs.count()
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n")).select("u", F.least("u", "m").alias("m"), "_n")
        large = join_counted(both, least, ["u"], "_n", 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        size = total
        if total > PLAIN:
            large = staged(large, name)
            size = large.count()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))
        moved = join_counted(large, least, ["u"], "_n", size).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        after = staged(moved, name)
        discard(pairs, *([large] if total > PLAIN else []))
        pairs = after
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stars(pairs: DataFrame) -> bool:
    """Whether every node points to one other at most, and none to a node that points on."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("out")), F.struct(F.col("v").alias("x"), F.lit(0).alias("out")))).alias("e")).select("e.*")
    return ends.groupBy("x").agg(F.sum("out").alias("n"), F.count("*").alias("all")).where("n > 1 or (n = 1 and all > 1)").isEmpty()


def held_out(doc_id: str = "doc_id"):
    """Rows never learnt from: crc32 of the id's text, mod 4, is 2."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def learning_rows(docs: DataFrame, labels: DataFrame, label: str, sample: int, sample_bytes: int) -> DataFrame:
    """(doc_id, text, y): at most ``sample`` labelled rows that are not held out, of
    ``sample_bytes`` of text in all, in the order of a hash of id and text; rows of more
    than a sixteenth of that are passed over.  Ids labelled twice count as 1 if any
    label is.  The ids, the ``sample`` with the least hash, are broadcast."""
    given = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    given = given.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    met = docs.select("doc_id", "text").join(F.broadcast(given), F.col("doc_id") == F.col("_id"))
    met = met.select("doc_id", "text", "y", F.xxhash64("doc_id", "text").alias("_at"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("_n"))
    met = met.where(F.col("_n") * 16 <= sample_bytes)
    # narrow rows first: as many as the bounds allow
    first = met.select("_at", "_n").orderBy("_at", "_n").limit(sample).collect()
    total, most = 0, 0
    for r in first:
        total += r._n
        if total > sample_bytes:
            break
        most += 1
    last = first[most - 1]._at if most else 0
    return met.where((F.col("_at") <= last) & F.lit(most > 0)).orderBy("_at", "_n").limit(most).select("doc_id", "text", "y")
