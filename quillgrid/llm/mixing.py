"""Mix sources to target weights by Sainte-Lague apportionment of equal blocks.

Sources get weights; each source's target is its share of the whole by weight,
stopped at ``cap`` times its size, with the excess reshared.  The whole is cut
into blocks of ``block`` words; Sainte-Lague (the highest quotients
``target / (2k - 1)``) gives every source an integer number of blocks, and again
every shard of the source its part by the shard's words.  A shard lays its
documents end to end in a seeded order and cuts them into blocks; a quota of
``q`` over ``n`` blocks takes every block ``q div n`` times, and ``q mod n`` of
them, chosen by a seeded stride, once more.

All of it is DataFrame expressions.  A shard holds about ``shard_words`` words at any
size, so a source with a third of all rows is many tasks; only one narrow row per source
or shard is ever ranked in one place, and apportionment is linear in these rows.

Defined cases: null or empty texts have size 0 and are taken 0 times; a null
source is a source of its own, last in order; equal rows are told apart only by
their order and each counts; a very long text lies over many blocks, of which each is
taken or not; an empty table gives an empty result; other columns pass through
:func:`mix` unless they are named like one it adds, and all pass through
:func:`mixed_texts`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

BLOCK, SHARD_WORDS, CAP, SEED = 128, 1 << 18, 3, "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(c.WORD)), F.lit(0)).cast("long")


def apportion(votes: DataFrame, seats: str, weight: str, order: list[Column], within: list[str] | None = None) -> DataFrame:
    """Adds ``quota``: Sainte-Lague seats of each row, of ``seats`` (a column equal
    within each group) by ``weight``.  Rounding weight/divisor is right but for
    at most half a seat a row; the highest (or lowest) quotients settle the rest.  Of
    these a row has at most its share of half the rows, and two more: the right divisor
    moves the seats of n rows by n / 2 at most, and a row's by its share of that and
    the rounding at either end.  So all rows together try 2.5 n quotients.
    """
    within = within or []
    group = Window.partitionBy(*within)
    share = F.when(F.sum(weight).over(group) > 0, F.col(weight) * F.col(seats) / F.sum(weight).over(group)).otherwise(0.0)
    ranked = votes.withColumn("_base", F.floor(share + 0.5).cast("long"))
    ranked = ranked.withColumn("_lack", F.col(seats) - F.sum("_base").over(group)).withColumn("_row", F.row_number().over(group.orderBy(*order)))
    # the next |lack| seats each row could win, or the last |lack| it could lose
    most = F.ceil(F.when(F.sum(weight).over(group) > 0, F.col(weight) / F.sum(weight).over(group)).otherwise(0.0) * F.count("*").over(group) / 2) + 2
    ranked = ranked.withColumn("_most", F.least(F.abs("_lack"), most.cast("long")))
    step = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_most"))).alias("_k")
    key = [*within, "_row"]
    tries = ranked.where("_lack <> 0").select(*key, "_lack", "_base", weight, step)
    gain = F.col(weight) / (2 * (F.col("_base") + F.col("_k")) - 1)
    loss = F.col(weight) / (2 * (F.col("_base") - F.col("_k")) + 1)
    tries = tries.where((F.col("_lack") > 0) | (F.col("_base") >= F.col("_k"))).withColumn("_q", F.when(F.col("_lack") > 0, -gain).otherwise(loss))
    first = Window.partitionBy(*within).orderBy("_q", F.when(F.col("_lack") > 0, F.col("_row")).otherwise(-F.col("_row")), "_k")
    won = tries.withColumn("_at", F.row_number().over(first)).where(F.col("_at") <= F.abs("_lack")).groupBy(*(F.col(k).alias(f"_won{k}") for k in key)).agg(F.sum(F.signum("_lack").cast("long")).alias("_more"))
    match = [F.col(k).eqNullSafe(F.col(f"_won{k}")) for k in key]
    return ranked.join(won, match, "left").select(*votes.columns, (F.col("_base") + F.coalesce("_more", F.lit(0))).alias("quota"))


def targets(sizes: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, source_size, weight) to targets: weight shares of the whole, stopped
    at ``cap`` times the size.  Sources stop in the order of size / weight, so one
    running sum finds which ones do."""
    by = Window.orderBy(F.col("source_size") / F.col("weight"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    rest = (F.sum("source_size").over(every) - cap * F.coalesce(F.sum("source_size").over(by), F.lit(0))).alias("_rest")
    left = (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by), F.lit(0))).alias("_left")
    out = sizes.select("*", rest, left).withColumn("_full", F.col("source_size") * cap * F.col("_left") <= F.col("_rest") * F.col("weight"))
    stopped = F.sum(F.when(F.col("_full"), cap * F.col("source_size")).otherwise(0)).over(every)
    open_weight = F.sum(F.when(F.col("_full"), 0).otherwise(F.col("weight"))).over(every)
    target = F.when(F.col("_full"), (cap * F.col("source_size")).cast("double")).otherwise((F.col("weight") * (F.sum("source_size").over(every) - stopped)).cast("double") / open_weight)
    return out.withColumn("target", target).drop("_rest", "_left", "_full")


_PLAN = ("_begin", "_n", "_each", "_extra", "_stride", "_shift")
_ADDED = ("size", "source_size", "target", "taken")


def mix(docs: DataFrame, block: int = BLOCK, shard_words: int = SHARD_WORDS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """Every row, but its text, with ``size``, ``source_size``, ``target`` and ``taken``."""
    other = [k for k in docs.columns if k.lower() not in ("text", *_ADDED)]
    return plan(docs, other, block, shard_words, cap, seed).select(*(F.col(f"_row.`{k}`").alias(k) for k in other), *_ADDED)


def plan(docs: DataFrame, keep: list[str], block: int = BLOCK, shard_words: int = SHARD_WORDS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """doc_id, the columns to keep as ``_row``, size, source_size, target, taken, and where
    the row lies in its shard and which blocks the shard takes: ``_begin``, ``_n``,
    ``_each``, ``_extra``, ``_stride``, ``_shift``."""
    spread = F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 15)
    row = F.struct(*(F.col(f"`{k}`") for k in keep)) if keep else F.struct(F.lit(None).cast("int").alias("none"))
    sized = c.staged(docs.select("doc_id", "source", row.alias("_row"), word_count(F.col("text")).alias("size"), F.conv(spread, 16, 10).cast("long").alias("_order")), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = sources.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long")).withColumn("weight", (F.col("_rank") - 1) % 3 + 1)
    quotas = targets(sources, cap).withColumn("_seats", F.floor(F.sum("source_size").over(Window.partitionBy()) / block))
    quotas = apportion(quotas, "_seats", "target", [F.col("_rank")]).withColumnRenamed("quota", "_seats_here").withColumn("_shards", F.ceil(F.col("source_size") / shard_words).cast("long"))
    quotas = c.staged(quotas.select("source", "_rank", "source_size", "target", "_seats_here", "_shards"), "sources")
    # one row per source; broadcast only where that is few
    quotas = quotas.withColumnRenamed("source", "_of")
    few = F.broadcast(quotas) if quotas.count() <= 100_000 else quotas
    placed = sized.join(few, F.col("source").eqNullSafe(F.col("_of"))).drop("_of").withColumn("_shard", F.when(F.col("_shards") > 0, F.col("_order") % F.col("_shards")).otherwise(0))
    shards = placed.groupBy("_rank", "_shard").agg(F.sum("size").alias("_words"), F.first("_seats_here").alias("_seats_here"))
    shards = apportion(shards, "_seats_here", "_words", [F.col("_shard")], ["_rank"])
    count = F.ceil(F.col("_words") / block).cast("long")
    quota = F.least(F.col("quota"), cap * count)
    stride = F.when(count > 2, F.greatest(F.lit(1), F.floor(count * 0.381966))).otherwise(1).cast("long")
    # a stride without a common divisor: consecutive candidates, the first that fits
    fits = F.filter(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda d: stride + d), lambda s: _coprime(s, count))
    shards = shards.select("_rank", "_shard", count.alias("_n"), F.when(count > 0, F.floor(quota / count)).otherwise(0).alias("_each"), F.when(count > 0, quota % count).otherwise(0).alias("_extra"), F.coalesce(F.element_at(fits, 1), F.lit(1)).alias("_stride"), F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), "_rank", "_shard"), 256), 1, 7), 16, 10).cast("long").alias("_shift"))
    run = Window.partitionBy("_rank", "_shard").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = placed.withColumn("_begin", F.sum("size").over(run) - F.col("size")).join(shards, ["_rank", "_shard"])
    first, last = F.floor(F.col("_begin") / block), F.floor((F.col("_begin") + F.col("size") - 1) / block)
    over = F.aggregate(
        F.sequence(first, last),
        F.lit(0).cast("long"),
        lambda total, i: total + F.when((i * F.col("_stride") + F.col("_shift")) % F.col("_n") < F.col("_extra"), F.least(F.col("_begin") + F.col("size"), (i + 1) * block) - F.greatest(F.col("_begin"), i * block)).otherwise(0),
    )
    taken = F.when(F.col("size") > 0, F.col("size") * F.col("_each") + over).otherwise(0).cast("long")
    return laid.withColumn("taken", taken)


def _coprime(a: Column, b: Column) -> Column:
    """gcd(a, b) = 1, by sixteen-odd Euclid steps unrolled in one fold."""
    pair = F.struct(a.cast("long").alias("x"), b.cast("long").alias("y"))
    step = lambda p, _: F.when(p.y == 0, p).otherwise(F.struct(p.y.alias("x"), (p.x % F.when(p.y == 0, 1).otherwise(p.y)).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(90)), pair, step, lambda p: p.x == 1)


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return plan(docs, []).select("doc_id", *_ADDED)


def mixed_texts(docs: DataFrame, block: int = BLOCK, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each whole time that a
    document is taken and one more for the words of its blocks taken once more.
    ``n_chars``, where there, is that of the new text.  Rows that share a doc_id and
    a size are taken as the first of them is."""
    columns = docs.columns
    of = plan(docs.select("doc_id", "text", "source"), [], block, **options).where("taken > 0")
    of = of.groupBy(F.col("doc_id").alias("_id"), F.col("size").alias("_size")).agg(F.min(F.struct(*_PLAN)).alias("_x"))
    # the rows' own columns travel as one, whatever they are called
    given = docs.select(F.col("doc_id").alias("_doc"), word_count(F.col("text")).alias("_words"), F.col("text").alias("_text"), F.struct(*(F.col(f"`{k}`") for k in columns if k != "text")).alias("_row"))
    joined = given.join(of, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_words") == F.col("_size"))).select(F.col("_text").alias("text"), "_row", *(f"_x.{k}" for k in _PLAN))

    def run(batches):
        for batch in c.pieces(batches):
            data, off = c.column_bytes(batch.column("text"))
            start, end, upto = c.words(data, off)
            begin, n, each, extra, stride, shift = (batch.column(2 + k).to_numpy().astype(np.int64) for k in range(6))
            row = np.repeat(np.arange(batch.num_rows), np.diff(upto))
            place = (begin[row] + np.arange(len(start)) - upto[row]) // block
            more = (place * stride[row] + shift[row]) % np.maximum(n[row], 1) < extra[row]
            texts, take = [], []
            raw = data.tobytes()
            for i in range(batch.num_rows):
                a, b = upto[i], upto[i + 1]
                whole = raw[off[i] : off[i + 1]].decode()
                texts += [whole] * int(each[i])
                take += [i] * int(each[i])
                on = np.flatnonzero(more[a:b])
                if len(on):
                    runs = np.split(on, np.flatnonzero(np.diff(on) > 1) + 1)
                    texts.append(whole if len(on) == b - a else "\n".join(raw[start[a + r[0]] : end[a + r[-1]]].decode() for r in runs))
                    take.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column("_row").take(pa.array(take, pa.int64()))], names=["text", "_row"])

    made = joined.mapInArrow(run, joined.select("text", "_row").schema)
    kind = docs.schema
    return made.select(*(F.col("text").alias(k) if k == "text" else F.length("text").cast(kind[k].dataType).alias(k) if k == "n_chars" else F.col(f"_row.`{k}`").alias(k) for k in columns))
