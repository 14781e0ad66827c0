"""Near-duplicate documents: chosen-path set similarity join on MinHash tokens.

A document is the set of its distinct five-word shingles.  Documents with equal
sets are one class; only the class with its least doc_id goes on, so thousands of
copies are one node.  Classes are then branched by minwise tokens (Christiani,
Pagh and Sivertsen 2018): each of ``trees`` independent trees sends a class to the
node named by its minwise token at that tree's position; a node of few classes is
compared exhaustively, a larger one branches on by tokens at positions drawn
from the node's own seed, 1.25 times a level in the mean, the reciprocal of the
similarity sought, so that what travels does not grow with the depth.

Documents are linked at a similarity of ``near`` hundredths or more (0.8 unless
told otherwise).  Two classes of a node are candidates when their signatures agree
in 64 places up to 4.5 deviations below the threshold.

1. A node finds its candidate groups and sends, for each row of a group of n, one
   candidate pair: n - 1 pairs, stars about rows met early.  Pairs are confirmed on
   full sets; a text travels once for each of its pairs, a hub's once more for each
   ``GROUP_SHINGLES`` of its partners.
2. Groups whose pairs were all confirmed are done: no pair of theirs can join anything
   new.  The rows of the others are compared once more, exactly, on full sets, group by
   group; a comparison is skipped only between documents that are already linked, by
   the pairs confirmed before or through others.

A group lies within one node, so both steps are bounded by nodes of ``node_rows``
classes, whatever the number of copies.  What is still larger after ``levels``
(classes that agree in as many tokens) is dealt to sub-nodes of that size, each of
which also gets the node's ``LEADERS`` least classes; where after step 1 such a
node has classes outside its largest component, these visit every sub-node in step 2:
that is exact, and all that grows with a node's size squared.

Defined cases: null, empty and blank texts have no shingle and are linked with
nothing; fewer than five words are one shingle; rows that share a doc_id are one
document, linked with whatever any of them is linked with; a null doc_id is linked with
nothing and kept; a very long text is one set, held whole by the task that compares
it; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

PLACES = 64
_TIMES = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 31, PLACES).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = np.random.Generator(np.random.PCG64(6)).integers(0, 1 << 32, PLACES).astype(np.uint32)
WIDTH, NEAR, TREES, NODE_ROWS, LEVELS, GROUP_SHINGLES = 5, 80, 8, 16_000, 6, 2 << 20
LEADERS = 8


def agreement(near: int, deviations: float) -> float:
    """Least number of places in which the signatures of a pair at the threshold agree."""
    share = near / 100
    return PLACES * (share - deviations * (share * (1 - share) / PLACES) ** 0.5)


def sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    key, first = c.shingles(data, offsets, width)
    return [np.unique(key[a:b]) for a, b in zip(first, first[1:], strict=False)]


def signature(one: np.ndarray) -> np.ndarray:
    """Sixteen bits of the minwise token at each place."""
    x = (one ^ (one >> c.U64(32))).astype(np.uint32)
    least = np.full(PLACES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        least = np.minimum(least, ((x[at : at + 4096, None] ^ _PLUS) * _TIMES).min(0))
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def sketched(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, set_key, sig): set_key is equal for equal sets."""

    def run(batches):
        for batch in c.pieces(batches):
            found = sets(*c.column_bytes(batch.column("text")), width)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in found], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in found], pa.binary()), pa.array([signature(s).tobytes() if len(s) else None for s in found], pa.binary())],
                names=["doc_id", "n_shingles", "set_key", "sig"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sig binary")


def groups_of(sig: np.ndarray, size: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """Label of each row, connected by signatures that agree and sizes that allow; and
    the row that met it (itself for a group's first)."""
    n = len(sig)
    label, by = np.full(n, -1), np.arange(n)
    rest = np.arange(n)
    least = agreement(near, 4.5)
    for root in range(n):
        if label[root] >= 0:
            continue
        label[root] = root
        rest = rest[rest != root]
        todo = [root]
        while todo and len(rest):
            u = todo.pop(0)
            alike = ((sig[rest] == sig[u]).sum(1) >= least) & (np.minimum(size[rest], size[u]) * 100 >= near * np.maximum(size[rest], size[u]))
            hit = rest[alike]
            if len(hit):
                label[hit], by[hit] = root, u
                rest = rest[~alike]
                todo += hit.tolist()
    return label, by


def _branches(seed: int, many: int = 2) -> list[int]:
    return [c.mix_int(seed * 131 + b) % PLACES for b in range(many)]


def _node(sig, size, ids, seed, near, out, depth=0, small=8_192, deepest=3) -> None:
    """Branch a node in memory; append (id, id, size, group) candidate pairs."""
    if len(ids) <= small or depth >= deepest:
        label, by = groups_of(sig, size, near)
        more = by != np.arange(len(ids))
        if more.any():
            # a group is known by its rows: that of the same rows in another tree is the same
            group = np.zeros(len(ids), np.uint64)
            np.add.at(group, label, c.mix(ids.astype(np.uint64)))
            group = c.mix(group).astype(np.int64)
            a, b = ids[more], ids[by[more]]
            out.append((np.maximum(a, b), np.minimum(a, b), size[more], group[label[more]]))
        return
    for place in _branches(seed):
        order = np.argsort(sig[:, place], kind="stable")
        cut = np.flatnonzero(np.diff(sig[order, place].astype(np.int64))) + 1
        for part in np.split(order, cut):
            if len(part) > 1:
                _node(sig[part], size[part], ids[part], c.mix_int(seed ^ (place << 20) ^ int(sig[part[0], place])), near, out, depth + 1, small, deepest)


def _node_pairs(near: int):
    """Candidate pairs of all nodes of a bucket; nodes of two rows all at once."""

    def run(key, table):
        table = table.sort_by([("node", "ascending"), ("rep", "ascending")])
        node, ids, size = (table.column(k).to_numpy() for k in ("node", "rep", "n"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, PLACES)
        cut = np.append(np.flatnonzero(np.append(True, node[1:] != node[:-1])), len(node))
        out: list = []
        two = cut[:-1][np.diff(cut) == 2]
        alike = ((sig[two] == sig[two + 1]).sum(1) >= agreement(near, 4.5)) & (np.minimum(size[two], size[two + 1]) * 100 >= near * np.maximum(size[two], size[two + 1]))
        two = two[alike]
        group = c.mix(c.mix(ids[two].astype(np.uint64)) + c.mix(ids[two + 1].astype(np.uint64))).astype(np.int64)
        out.append((np.maximum(ids[two], ids[two + 1]), np.minimum(ids[two], ids[two + 1]), size[two], group))
        for k in np.flatnonzero(np.diff(cut) > 2):
            a, b = cut[k], cut[k + 1]
            _node(sig[a:b], size[a:b], ids[a:b], int(node[a]) & (2**64 - 1), near, out)
        return pa.table([pa.array(np.concatenate([x[k] for x in out]), pa.int64()) for k in range(4)], names=["src", "dst", "n", "group"])

    return run


def _token(place) -> F.Column:
    """The sixteen bits of ``sig`` at a place (a Column of an int)."""
    return F.substring(F.hex("sig"), place * 4 + 1, F.lit(4))


def node_tables(classes: DataFrame, trees: int = TREES, node_rows: int = NODE_ROWS, levels: int = LEVELS) -> tuple[DataFrame, DataFrame | None]:
    """(node, rep) of nodes of 2 to ``node_rows`` classes, and (node, rep, blocks) of
    those still larger after ``levels``.  classes: rep, n, sig."""
    roots = F.explode(F.array(*(F.xxhash64(F.lit(t), _token(F.lit((11 + 7 * t) % PLACES))) for t in range(trees))))
    nodes, total = classes.select(roots.alias("node"), "rep"), trees * classes.count()
    small, deep = None, None
    for level in range(levels + 1):
        if total > c.PLAIN:
            nodes = c.staged(nodes, "nodes")
        sizes = c.staged(nodes.groupBy("node").agg(F.count("*").alias("here")).where("here > 1"), "sizes")
        placed = c.join_counted(nodes, sizes, ["node"], "here", total)
        here = placed.where(F.col("here") <= node_rows).select("node", "rep")
        small = here if small is None else small.union(here)
        stay = placed.where(F.col("here") > node_rows)
        total = sizes.where(F.col("here") > node_rows).agg(F.sum("here")).first()[0]
        if not total:
            break
        if level == levels:
            deep = c.staged(stay.select("node", "rep", F.ceil(F.col("here") / node_rows).cast("long").alias("blocks")), "deep")
            break
        # one branch, and a second from every fourth node
        spread = F.explode(F.filter(F.array(*(F.struct(F.pmod(F.xxhash64("node", F.lit(b)), F.lit(PLACES)).cast("int").alias("place"), F.lit(b).alias("b"), ((F.lit(b) == 0) | (F.pmod(F.xxhash64("node", F.lit("second")), F.lit(4)) == 0)).alias("on")) for b in (0, 1))), lambda x: x.on))
        onward = stay.join(classes, "rep").select("node", "rep", "sig", spread.alias("s"))
        nodes = c.staged(onward.select(F.xxhash64("node", "s.b", _token(F.col("s.place"))).alias("node"), "rep"), "branches")
        total = 2 * total
    return c.staged(small, "nodes"), deep


def _sub_nodes(deep: DataFrame) -> DataFrame:
    """(node, rep): sub-nodes, each with the leaders of its node."""
    sub = lambda k: F.xxhash64("node", F.lit("sub"), k)
    own = deep.select(sub(F.pmod(F.xxhash64("rep"), F.col("blocks"))).alias("node"), "rep")
    least = deep.withColumn("salt", F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(256))).groupBy("node", "salt").agg(F.min("rep").alias("rep"), F.first("blocks").alias("blocks"))
    first = least.groupBy("node").agg(F.slice(F.array_sort(F.collect_list("rep")), 1, LEADERS).alias("reps"), F.first("blocks").alias("blocks"))  # of 256 a node
    lead = first.select("node", F.explode("reps").alias("rep"), "blocks").select(F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), sub)).alias("node"), "rep")
    return own.union(lead).distinct()


def _outsiders(deep: DataFrame, label: DataFrame) -> DataFrame | None:
    """(node, rep): sub-nodes of the nodes with classes outside their largest component,
    with those classes in each."""
    named = c.staged(deep.join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")), "deep")
    counts = named.groupBy("node", "component").agg(F.count("*").alias("n"))
    top = counts.groupBy("node").agg(F.max(F.struct("n", "component")).alias("x"), F.sum("n").alias("_here")).select("node", F.col("x.component").alias("top"), "_here")
    out = c.staged(c.join_counted(named, top, ["node"], "_here", max(1, named.count())).where("component <> top").select("node", "rep", "blocks"), "outsiders")
    if out.isEmpty():
        return None
    sub = lambda k: F.xxhash64("node", F.lit("sub"), k)
    some = deep.join(F.broadcast(out.select("node").distinct()) if out.count() <= 100_000 else out.select("node").distinct(), "node", "left_semi")
    own = some.select(sub(F.pmod(F.xxhash64("rep"), F.col("blocks"))).alias("node"), "rep")
    visit = out.select(F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), sub)).alias("node"), "rep")
    return own.union(visit).distinct()


def candidates(nodes: DataFrame, classes: DataFrame, near: int = NEAR, bucket_rows: int = 50_000) -> DataFrame:
    """(src, dst, n, group): candidate pairs, src > dst, that connect each node's candidate
    groups, and the size of one of them."""
    buckets = max(1, -(-nodes.count() // bucket_rows))
    dealt = nodes.join(classes, "rep").withColumn("bucket", F.pmod(F.xxhash64("node"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(_node_pairs(near), "src long, dst long, n long, group long").where("src <> dst").distinct()


def exact_groups(found: list[np.ndarray], near: int, linked: list[tuple[int, int]] = ()) -> np.ndarray:
    """Label (least index) of each set: connected by 100 |A and B| >= near |A or B|.
    ``linked``: pairs that are known to be; only sets not linked yet are compared."""
    n = len(found)
    size = np.array([len(s) for s in found], np.int64)
    # where each token stands: one set meets all others by the rows of its own tokens
    token = np.concatenate([np.zeros(0, np.uint64), *found])
    order = np.argsort(token, kind="stable")
    first = np.flatnonzero(np.append(True, token[order][1:] != token[order][:-1])) if len(token) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(token)))
    number = np.empty(len(token), np.int64)
    number[order] = np.repeat(np.arange(len(first)), count)
    rows = np.repeat(np.arange(n), size)[order]
    begin = np.cumsum(size) - size
    held = np.arange(n)  # the component of each by the known pairs
    for a, b in linked:
        while held[a] != a:
            a = held[a] = held[held[a]]
        while held[b] != b:
            b = held[b] = held[held[b]]
        held[max(a, b)] = min(a, b)
    for k in range(n):
        held[k] = held[held[k]]
    members: dict[int, list[int]] = {}
    for k, h in enumerate(held.tolist()):
        members.setdefault(h, []).append(k)
    label = np.full(n, -1)
    rest = np.arange(n)
    for root in range(n):
        if label[root] >= 0:
            continue
        todo = list(members[int(held[root])])
        label[todo] = root
        rest = rest[label[rest] < 0]
        while todo and len(rest):
            u = todo.pop()
            own = number[begin[u] : begin[u] + size[u]]
            own = own[count[own] > 1]
            at = np.repeat(first[own] - np.cumsum(count[own]) + count[own], count[own]) + np.arange(int(count[own].sum()))
            both = np.bincount(rows[at], minlength=n)[rest]
            hit = rest[(both > 0) & (100 * both >= near * (size[rest] + size[u] - both))]
            if len(hit):
                more = [k for h in np.unique(held[hit]).tolist() for k in members[h]]
                label[more] = root
                rest = rest[label[rest] < 0]
                todo += more
    return label


def _sets_of(table, width: int) -> list[np.ndarray]:
    return [s for b in c.pieces(table.select(["text"]).to_batches(), limit=1 << 20) for s in sets(*c.column_bytes(b.column(0)), width)]


def _similar(a: np.ndarray, b: np.ndarray, near: int) -> bool:
    if not len(a) or min(len(a), len(b)) * 100 < near * max(len(a), len(b)):
        return False
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    both = int((a[at] == b).sum())
    return 100 * both >= near * (len(a) + len(b) - both)


def confirmed_pairs(texts: DataFrame, pairs: DataFrame, width: int = WIDTH, near: int = NEAR, load: int = GROUP_SHINGLES) -> DataFrame:
    """The (src, dst) of ``pairs`` that are similar on full sets.  texts: rep, text."""
    stars = pairs.groupBy("dst").agg(F.count("*").alias("_n"), F.sum("n").alias("load"))
    total = max(1, pairs.count())
    dealt = c.staged(c.join_counted(pairs, stars, ["dst"], "_n", total).select("src", "dst", "n", F.pmod(F.xxhash64("src"), F.ceil(F.col("load") / load)).alias("salt")), "stars")
    whole = dealt.agg(F.sum("n")).first()[0] or 0
    # a bucket holds whole stars (or a hub's parts), about ``load`` shingles, hubs included
    bucket = F.pmod(F.xxhash64("dst", "salt"), F.lit(max(1, -(-2 * whole // load))))
    ends = dealt.select(bucket.alias("bucket"), "dst", "salt", F.col("src").alias("rep")).union(dealt.select(bucket, "dst", "salt", "dst").distinct())

    def run(key, table):
        table = table.sort_by([("dst", "ascending"), ("salt", "ascending")])
        ids, found = table.column("rep").to_numpy(), _sets_of(table, width)
        star = np.stack([table.column(k).to_numpy() for k in ("dst", "salt")])
        cut = [0, *(np.flatnonzero((star[:, 1:] != star[:, :-1]).any(0)) + 1).tolist(), table.num_rows]
        src, dst = [], []
        for a, b in zip(cut, cut[1:], strict=False):
            hub = star[0, a]
            at = [found[k] for k in range(a, b) if ids[k] == hub]
            for k in range(a, b):
                if ids[k] != hub and any(_similar(own, found[k], near) for own in at):
                    src.append(int(ids[k]))
                    dst.append(int(hub))
        return pa.table([pa.array(x, pa.int64()) for x in (src, dst)], names=["src", "dst"])

    return ends.join(texts, "rep").groupBy("bucket").applyInArrow(run, "src long, dst long").distinct()


def confirmed(texts: DataFrame, members: DataFrame, width: int = WIDTH, near: int = NEAR, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """(src, dst) links over full sets that connect what is similar within each group.

    members: rep, n, group, and ``links``, the reps that it is known to be similar to; a
    group is part of one node, so the pairs of blocks that one of more than
    ``group_shingles`` takes do not grow with the table."""
    load = members.groupBy("group").agg(F.sum("n").alias("load"))
    load = load.select("group", F.ceil(F.col("load") / group_shingles).cast("long").alias("blocks"), "load")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, own).alias("i"), F.greatest(x, own).alias("j"))))
    placed = members.join(load, "group").select("rep", "group", "links", pairs.alias("pair"))
    # small groups share a task
    whole = load.agg(F.sum(F.col("load") * F.col("blocks"))).first()[0] or 0
    bucket = F.pmod(F.xxhash64("group", "i", "j"), F.lit(max(1, -(-whole // group_shingles))))
    dealt = texts.join(placed, "rep").select("group", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "rep", "links", "text").withColumn("bucket", bucket)

    def run(key, table):
        src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if table.num_rows:
            table = table.sort_by([("group", "ascending"), ("i", "ascending"), ("j", "ascending"), ("rep", "ascending")])
            ids, found = table.column("rep").to_numpy(), _sets_of(table, width)
            of = np.stack([table.column(k).to_numpy() for k in ("group", "i", "j")])
            cut = np.append(np.flatnonzero(np.append(True, (of[:, 1:] != of[:, :-1]).any(0))), len(ids))
            known = table.column("links").to_pylist()
            for a, b in zip(cut, cut[1:], strict=False):
                at = {i: k for k, i in enumerate(ids[a:b].tolist())}
                linked = [(k, at[o]) for k in range(b - a) for o in known[a + k] if o in at]
                src.append(ids[a:b])
                dst.append(ids[a:b][exact_groups(found[a:b], near, linked)])
        return pa.table([pa.array(np.concatenate(x), pa.int64()) for x in (src, dst)], names=["src", "dst"])

    return dealt.groupBy("bucket").applyInArrow(run, "src long, dst long").where("src <> dst").distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, near: int = NEAR, node_rows: int = NODE_ROWS, levels: int = LEVELS, trees: int = TREES, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    rows = c.staged(sketched(docs, width), "sketches")
    there = rows.where("n_shingles > 0 and doc_id is not null")
    # classes are known by their least doc_id; the classes of one id are one document
    classes = c.staged(there.groupBy("set_key").agg(F.min(F.struct("doc_id", F.col("n_shingles").alias("n"), "sig")).alias("x"), F.count("*").alias("copies")).select("set_key", F.col("x.doc_id").alias("rep"), "x.n", "x.sig", "copies"), "classes")
    repeated = c.staged(rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("set_key").alias("a"), F.max("set_key").alias("b")).where("n > 1").select("doc_id", (F.col("a") < F.col("b")).alias("several")), "repeated-ids")
    some_repeat = not repeated.isEmpty()
    several = repeated.where("several").select("doc_id")
    edges = there.join(several, "doc_id").select("doc_id", "set_key").distinct().join(classes, "set_key").select(F.col("rep").alias("src"), F.col("doc_id").alias("dst")).where("src <> dst") if some_repeat else None

    one = classes.select("rep", "n", "sig")
    nodes, deep = node_tables(one, trees, node_rows, levels)
    met = c.staged(candidates(nodes if deep is None else nodes.union(_sub_nodes(deep)), one, near), "met")
    pairs = c.staged(met.groupBy("src", "dst").agg(F.max("n").alias("n")), "pairs")
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("rep")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(ends, "rep", "left_semi")
    texts = c.staged(texts.distinct() if some_repeat else texts, "candidate-texts")
    sure = c.staged(confirmed_pairs(texts, pairs, width, near, load=group_shingles), "links")
    links = sure if edges is None else sure.union(edges)

    met = c.staged(met.join(sure.withColumn("ok", F.lit(True)), ["src", "dst"], "left"), "met")
    failed = met.where("ok is null")
    open_groups = failed.select("group").distinct()
    if deep is not None:
        label = c.connected_components(links, "first-components")
        if (outside := _outsiders(deep, label)) is not None:
            late = c.staged(candidates(outside, one, near).withColumn("ok", F.lit(None).cast("boolean")), "met")
            open_groups, met = open_groups.union(_apart(late, label).select("group").distinct()).distinct(), met.union(late.select(met.columns))
            ends = late.select(F.explode(F.array("src", "dst")).alias("rep")).distinct()
            texts = texts.union(docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(ends, "rep", "left_semi")).distinct()
    members = c.staged(_members(met, open_groups), "members")
    again = c.staged(confirmed(texts, members, width, near, group_shingles), "links")
    label = c.connected_components(links.union(again))

    named = classes.select("set_key", "rep", "copies").join(label, F.col("rep") == F.col("node"), "left").select("set_key", F.coalesce("component", "rep").alias("component"), "copies")
    in_class = c.join_counted(there.drop("sig"), named, ["set_key"], "copies", max(1, there.count())).select("doc_id", "n_shingles", "component")
    # without words: the component of their id, where it has other rows
    bare = rows.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles")
    bare = bare.join(label, (F.col("doc_id") == F.col("node")) & F.col("doc_id").isNotNull(), "left").select("doc_id", "n_shingles", "component") if some_repeat else bare.withColumn("component", F.lit(None).cast("long"))
    every = in_class.union(bare)
    return every.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _members(met: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, rep, n, links) of the rows of some groups; a row's links are those of its
    pairs, one or so each in a group, that were confirmed."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("rep"), F.when(F.col("ok"), F.col("dst")).alias("to")), F.struct(F.col("dst").alias("rep"), F.lit(None).cast("long").alias("to")))).alias("e")
    return met.join(groups, "group").select("group", "n", ends).groupBy("group", "e.rep").agg(F.max("n").alias("n"), F.collect_list("e.to").alias("links"))


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (staged) whose ends are of two components."""
    pairs_n = pairs.count()
    for k in ("src", "dst"):
        ends = pairs.groupBy(k).agg(F.count("*").alias("_n")).join(label, F.col(k) == F.col("node"), "left").select(k, F.coalesce("component", k).alias(f"{k}_in"), "_n")
        pairs = c.join_counted(pairs, ends, [k], "_n", pairs_n).drop("_n")
        if k == "src" and pairs_n > c.PLAIN:
            pairs = c.staged(pairs, "ends")
    return pairs.where("src_in <> dst_in")


def op1_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(c.table(spark, sf_dir, "documents"), near=85)


#: Every pair that shares a shingle, then the components by a recursive closure.
OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
k AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(least(least, w.doc_id), w.doc_id) AS component_id, coalesce(least(least, w.doc_id), w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN k ON k.a = w.doc_id
"""
