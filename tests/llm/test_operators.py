"""Each operator against brute force, and its defined cases, on small fixtures."""

import hashlib
import io
import itertools
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgrid.llm import common, covertree, licences, minhash, mixing, packing, quality, simhash, suffixes, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, size string"
WORDS = [f"w{i}" for i in range(400)]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus():
    """Copies, near copies, shared passages, nulls, empties, one long text, ties."""
    base, passage = prose(1, 200), prose(2, 40)
    rows = [(0, base), (1, base), (2, base + " more"), (3, None), (4, ""), (5, " \t\n"), (6, "one two"), (7, "ONE two"), (8, prose(3, 6000))]
    rows += [(10 + i, f"{prose(20 + i, 30)} {passage} {prose(60 + i, 30)}") for i in range(8)]
    rows += [(30 + i, " ".join([*base.split()[: 190 - i], *prose(90 + i, i).split()])) for i in range(12)]
    rows += [(50, "ä" * 150), (51, "é " + "ä" * 150), (52, "a" * 300), (53, base), (54, passage.upper())]
    return [(i, t, "en", None if i % 5 == 0 else f"src{i % 4}", len(t or ""), "x", "y") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    spark.createDataFrame(corpus(), SCHEMA).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark, docs):
    return docs.limit(0)


@pytest.fixture(params=[True, False], ids=["coalesced", "apart"])
def coalesced(spark, request):
    """Whether small shuffle partitions are merged, which hides keys dealt apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", request.param)
    yield request.param
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


# -- words and components ----------------------------------------------------


def test_words_and_hashes():
    texts = ["a  b\tc", "", None, "x", " \n", "é ü", "tail"]
    data, off = common.column_bytes(pa.array(texts).slice(0))
    start, end, upto = common.words(data, off)
    got = [[bytes(data[a:b]).decode() for a, b in zip(start[x:y], end[x:y], strict=True)] for x, y in itertools.pairwise(upto)]
    assert got == [re.findall(common.WORD, t or "") for t in texts]
    prefix = common.prefix_hash(common.BYTE_CODE[data])
    assert len({*common.span_hash(prefix, start, end)}) == len({bytes(data[a:b]) for a, b in zip(start, end, strict=True)})


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + i, 201 + i) for i in range(12)]
    label = {n: n for p in pairs for n in p if p[0] != p[1]}
    for _ in label:
        for a, b in pairs:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = common.connected_components(spark.createDataFrame(pairs, "src long, dst long"))
    assert {r.node: r.component for r in got.collect()} == label


# -- op1 ---------------------------------------------------------------------


def brute_components(rows, near=80):
    lower = {i: i + 32 for i in range(65, 91)}
    sets = {}
    for i, t in rows:
        w = re.findall(common.WORD, (t or "").translate(lower))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= near * len(sets[a] | sets[b])]
    for _ in range(len(sets)):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return sets, label


@pytest.mark.parametrize("near", [80, 85])
def test_minhash_is_exact(spark, docs, none, near):
    sets, label = brute_components([(r[0], r[1]) for r in corpus()], near)
    want = [(i, len(sets[i]), label[i], label[i] == i) for i in sorted(sets)]
    assert sorted(rows_of(minhash.near_duplicates(docs, near=near), "doc_id", "n_shingles", "component_id", "kept")) == want
    assert len({*label.values()}) < len(label) - 10
    assert minhash.near_duplicates(none, near=near).count() == 0


@pytest.mark.parametrize("options", [{"node_rows": 4}, {"node_rows": 4, "levels": 0}, {"group_shingles": 300}])
def test_minhash_large_nodes(spark, docs, options):
    """The distributed levels, sub-nodes with their outsiders and blocks lose no link."""
    want = brute_components([(r[0], r[1]) for r in corpus()])[1]
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, **options).collect()} == want


@pytest.mark.parametrize("options", [{}, {"node_rows": 10, "levels": 1}])
def test_minhash_chains(spark, options):
    """Candidates that are not links beside chains of links, in one large group."""
    base = prose(1, 120).split()
    rows = [(k, " ".join([*base[k:], *prose(500 + k, k).split()])) for k in range(0, 40)]
    rows += [(100 + k, " ".join([*base[:60], *prose(600 + k, 12 + k % 9).split(), *base[60:]])) for k in range(30)]
    want = brute_components(rows)[1]
    assert len({*want.values()}) > 5
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df, **options).collect()} == want


def test_minhash_nulls_and_repeats(spark):
    t = prose(5, 50)
    df = spark.createDataFrame([(None, t), (1, t), (1, t), (2, t)], "doc_id long, text string")
    got = rows_of(minhash.near_duplicates(df), "doc_id", "component_id", "kept")
    assert got == sorted([(None, None, True), (1, 1, True), (1, 1, True), (2, 1, False)], key=str)


def test_minhash_ids_of_several_texts(spark):
    """Rows that share an id are one document, linked through any of them."""
    x, y, z = (prose(k, 60) for k in (5, 6, 7))
    rows = [(1, x), (2, x), (2, y), (2, None), (3, y + " more"), (4, z), (4, z), (5, z + " more"), (6, ""), (6, z), (7, None)]
    got = rows_of(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "component_id", "kept")
    assert got == sorted([(1, 1, True), *[(2, 1, False)] * 3, (3, 1, False), *[(4, 4, True)] * 2, (5, 4, False), *[(6, 4, False)] * 2, (7, 7, True)], key=str)


# -- op2 ---------------------------------------------------------------------


def brute_quotas(seats, votes):
    won = [0] * len(votes)
    for _ in range(seats):
        k = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[k] += 1
    return won


@pytest.mark.parametrize("seed", range(4))
def test_sainte_lague(spark, seed):
    rng = random.Random(seed)
    votes = [float(rng.choice([0, 3, 10, 10, 977, rng.randrange(1, 5000)])) for _ in range(9)] + [1.0]
    seats = rng.randrange(0, 60)
    df = spark.createDataFrame([(i, v, seats) for i, v in enumerate(votes)], "i int, v double, s int")
    got = {r.i: r.quota for r in mixing.apportion(df, "s", "v", [F.col("i")]).collect()}
    assert [got[i] for i in range(len(votes))] == brute_quotas(seats, votes)


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        left = sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and weight[s] * rest / left > 3 * sizes[s]} if left else set()
        if not over:
            return {s: 3.0 * sizes[s] if s in full else weight[s] * rest / left for s in names}
        full |= over


def test_mixing(spark, docs, none):
    got = mixing.mix(docs, block=16).collect()
    size = {r[0]: len(re.findall(common.WORD, r[1] or "")) for r in corpus()}
    assert {r.doc_id: r["size"] for r in got} == size and len(got) == len(size)
    sources = defaultdict(int)
    for r in corpus():
        sources[r[3]] += size[r[0]]
    want, taken = brute_targets(sources), defaultdict(int)
    for r in got:
        assert r.source_size == sources[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s in sources:
        assert abs(taken[s] - want[s]) <= max(40, 0.05 * want[s]), (s, taken[s], want[s])
    assert sorted((r.doc_id, r.taken) for r in mixing.mix(docs.repartition(3), block=16).collect()) == sorted((r.doc_id, r.taken) for r in got)
    assert mixing.mix(none).count() == 0


def test_mixing_stops_small_sources(spark):
    rows = [(i, "w " * 1000, "a") for i in range(9)] + [(9, "w " * 50, "b"), (10, "w " * 10, "c")]
    got = {r.source: r.target for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=8).collect()}
    assert got == {"a": 9060.0 - 180, "b": 150.0, "c": 30.0}


@pytest.mark.parametrize("seed", range(3))
def test_sainte_lague_of_many_rows(spark, seed):
    """Far-off roundings: many small rows beside a few that hold almost all."""
    rng = random.Random(seed)
    votes = [float(rng.randrange(1, 4)) for _ in range(150)] + [float(rng.randrange(2_000, 9_000)) for _ in range(rng.randrange(1, 4))]
    seats = rng.choice([151, 700, 3_000])
    df = spark.createDataFrame([(i, v, seats) for i, v in enumerate(votes)], "i int, v double, s int")
    got = {r.i: r.quota for r in mixing.apportion(df, "s", "v", [F.col("i")]).collect()}
    assert [got[i] for i in range(len(votes))] == brute_quotas(seats, votes)


def test_mixing_with_clashing_names(spark, docs):
    """Columns named like those at work inside come out as they went in."""
    odd = docs.withColumn("_words", F.col("doc_id") * 2).withColumn("_begin", F.lit("b")).withColumn("part", F.lit(1)).withColumn("_row", F.lit(None).cast("int"))
    got = mixing.mixed_texts(odd, block=16)
    assert got.columns == odd.columns
    assert rows_of(got.drop("_words", "_begin", "part", "_row"), *docs.columns) == rows_of(mixing.mixed_texts(docs, block=16), *docs.columns)
    assert all(r["_words"] == 2 * r.doc_id and r["_begin"] == "b" for r in got.collect())
    assert mixing.mix(odd, block=16).columns == ["doc_id", "lang", "source", "n_chars", "score", "_words", "_begin", "part", "_row", "size", "source_size", "target", "taken"]


def test_mixed_texts(spark, docs):
    plan = {r.doc_id: r.taken for r in mixing.mix(docs, block=16).collect()}
    got = defaultdict(int)
    mixed = mixing.mixed_texts(docs, block=16)
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        got[r.doc_id] += len(re.findall(common.WORD, r.text))
        assert r.n_chars == len(r.text)
    assert got == {k: v for k, v in plan.items() if v}


# -- op3 and op8 -------------------------------------------------------------


def test_crf_marginals():
    """Forward-backward against every labelling, several chains at once."""
    rng = np.random.default_rng(0)
    length = np.array([3, 1, 4])
    first, emit, moves = np.array([0, 3, 4]), rng.normal(size=8), rng.normal(size=(2, 2))
    good, pairs = quality.forward_backward(emit, first, length, moves)
    want, both = np.zeros(8), np.zeros((2, 2))
    for a, n in zip(first, length, strict=True):
        total, mine, move = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            p = math.exp(sum(emit[a + t] * y[t] for t in range(n)) + sum(moves[y[t], y[t + 1]] for t in range(n - 1)))
            total += p
            mine += p * np.array(y)
            for t in range(n - 1):
                move[y[t], y[t + 1]] += p
        want[a : a + n] = mine / total
        both += move / total
    assert np.allclose(good, want) and np.allclose(pairs, both)


def test_long_chains_are_chains(monkeypatch):
    """Pieces with carried messages give the marginals of one chain."""
    monkeypatch.setattr(quality, "_PIECE", 5)
    rng = np.random.default_rng(1)
    for n in (1, 4, 5, 6, 23, 2000):
        emit, moves = rng.normal(size=n) * 3, rng.normal(size=(2, 2))
        want, _ = quality.forward_backward(emit, np.array([0]), np.array([n]), moves)
        assert np.allclose(quality.long_chain(emit, moves), want)


def test_the_gradient_is_that_of_the_likelihood():
    """Weighted pair and line marginals against differences of the log likelihood."""
    rng = np.random.default_rng(2)
    first, length, weight = np.array([0, 3]), np.array([3, 2]), np.array([0.7, 0.2])
    emit, moves, y = rng.normal(size=5), rng.normal(size=(2, 2)), np.array([1, 0, 0, 1, 1])

    def value(e, m):
        total = 0.0
        for a, n, w in zip(first, length, weight, strict=True):
            score = lambda z: sum(e[a + t] * z[t] for t in range(n)) + sum(m[z[t], z[t + 1]] for t in range(n - 1))
            total += w * (score(y[a : a + n]) - math.log(sum(math.exp(score(z)) for z in itertools.product((0, 1), repeat=int(n)))))
        return total

    good, pairs = quality.forward_backward(emit, first, length, moves, weight)
    held = np.zeros((2, 2))
    for a, n, w in zip(first, length, weight, strict=True):
        for t in range(n - 1):
            held[y[a + t], y[a + t + 1]] += w
    for k in range(5):
        step = np.eye(5)[k] * 1e-6
        assert (value(emit + step, moves) - value(emit - step, moves)) / 2e-6 == pytest.approx((y[k] - good[k]) * np.repeat(weight, length)[k], abs=1e-6)
    for a, b in itertools.product((0, 1), repeat=2):
        step = np.zeros((2, 2))
        step[a, b] = 1e-6
        assert (value(emit, moves + step) - value(emit, moves - step)) / 2e-6 == pytest.approx(held[a, b] - pairs[a, b], abs=1e-6)


def test_long_texts_score_as_whole_ones(spark, monkeypatch):
    docs, labels = labelled(spark, "quality")
    model = quality.fit(docs, labels)
    rng = random.Random(6)
    line = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 9)))
    some = [line() for _ in range(40)]
    texts = ["\n".join(rng.choice(some) if rng.random() < 0.5 else line() for _ in range(300)), "\n\n\n", "x" * 400, "\n".join("a" * 90 for _ in range(9))]
    args = common.column_bytes(pa.array(texts, pa.large_string()))
    monkeypatch.setattr(quality, "_LONGEST", 80)
    want = quality.predict(model, *args)
    monkeypatch.setattr(quality, "_WINDOW", 160)
    assert np.allclose(quality.predict(model, *args), want)


@pytest.mark.parametrize(("module", "kind"), [(toxicity, "toxic"), (quality, "quality")])
def test_samples_bound_rows_and_bytes(spark, module, kind):
    """Repeated rows count each, and long ones by their bytes."""
    docs = spark.createDataFrame([(1, "same words")] * 500 + [(2, "w " * 600), (3, None)] + [(k, prose(k, 20)) for k in range(10, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(1, 1)], f"doc_id long, {kind} int")
    some = common.learning_rows(docs, labels, kind, 10, 1 << 20).collect()
    assert len(some) == 10
    some = common.learning_rows(docs, labels, kind, 10_000, 4_000).collect()
    assert 0 < sum(len(r.text or "") for r in some) <= 4_000 and all(len(r.text or "") <= 250 for r in some)
    assert rows_of(common.learning_rows(docs, labels, kind, 20, 4_000), "doc_id", "y") == rows_of(common.learning_rows(docs.repartition(7), labels, kind, 20, 4_000), "doc_id", "y")
    assert module.score(docs.withColumn("score", F.lit("clash")).withColumn("y", F.lit(1)), module.fit(docs, labels, sample=50)).columns == ["doc_id", "text", "y", "score"]


def labelled(spark, kind):
    rng, rows, labels = random.Random(4), [], []
    for i in range(400):
        bad = rng.random() < 0.3
        text = "\n".join(" ".join(rng.choice(WORDS) for _ in range(12)) for _ in range(4))
        if bad and kind == "toxic":
            text = text.replace(" ", " nastyword ", 2)
        elif bad:
            text = text.upper().replace(" ", "!! ")
        rows.append((i, text))
        labels.append((i, int(bad) if kind == "toxic" else int(not bad)))
    rows += [(1000, None), (1001, ""), (None, "null id")]
    labels += [(1000, None), (None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, f"doc_id long, {kind} int")


@pytest.mark.parametrize(("module", "kind"), [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers(spark, module, kind):
    docs, labels = labelled(spark, kind)
    model = module.fit(docs, labels)
    got = {r.doc_id: r.score for r in module.score(docs, model).collect()}
    assert len(got) == docs.count() and all(0 <= s <= 1 for s in got.values())
    truth = {r.doc_id: r[kind] for r in labels.collect() if r.doc_id is not None and r.doc_id < 1000}
    away = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(away) > 50 and sum((got[i] > 0.5) == truth[i] for i in away) / len(away) > 0.97
    assert {r.score for r in module.score(docs, model).collect()} == {*got.values()}


@pytest.mark.parametrize(("module", "kind"), [(toxicity, "toxic"), (quality, "quality")])
def test_held_out_labels_do_not_matter(spark, module, kind):
    docs, labels = labelled(spark, kind)
    flipped = labels.withColumn(kind, F.when(common.held_out(), 1 - F.col(kind)).otherwise(F.col(kind)))
    a, b = (rows_of(module.score(docs, module.fit(docs, x)), "doc_id", "score") for x in (labels, flipped))
    assert a == b


@pytest.mark.parametrize(("module", "kind"), [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_without_labels(spark, module, kind):
    docs, labels = labelled(spark, kind)
    for some in (labels.limit(0), labels.where(f"{kind} = 1")):
        assert len({round(r.score, 9) for r in module.score(docs, module.fit(docs, some)).collect()}) == 1
    assert module.score(docs.limit(0), module.fit(docs, labels)).count() == 0


# -- op4 ---------------------------------------------------------------------


def brute_cuts(rows):
    first, out = {}, {}
    texts = sorted(((i, (t or "").encode()) for i, t in rows))
    for i, b in texts:
        for s in range(len(b) - 99):
            first.setdefault(b[s : s + 100], (i, s))
    for i, b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if first[b[s : s + 100]] < (i, s):
                gone[s : s + 100] = b"\1" * 100
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("part", [16 << 20, 4000])
def test_suffixes(spark, docs, none, monkeypatch, part, coalesced):
    monkeypatch.setattr(suffixes, "PART", part)
    monkeypatch.setattr(suffixes, "BUCKET", part)
    want = brute_cuts([(r[0], r[1]) for r in corpus()])
    got = suffixes.cut_repeats(docs, ["doc_id", "size"]).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert sum(x[1] for x in want.values()) > 5000
    assert suffixes.cut_repeats(none).count() == 0


def test_suffixes_random(spark):
    rng = random.Random(9)
    parts = ["".join(rng.choice("ab") for _ in range(rng.randrange(60, 180))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 7)))) for i in range(80)]
    got = suffixes.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_cuts(rows)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)


@pytest.mark.parametrize("part", [16 << 20, 2000])
def test_suffixes_rows_that_share_an_id(spark, monkeypatch, part):
    """Repeated rows, several texts of one id and null ids: strings count by (id, place)
    and are cut from their own row only."""
    monkeypatch.setattr(suffixes, "PART", part)
    monkeypatch.setattr(suffixes, "BUCKET", part)
    rng = random.Random(4)
    parts = [prose(100 + i, 30) for i in range(8)]
    rows = [(7, prose(1, 60)), (7, prose(1, 60)), (1, prose(2, 40)), (3, prose(2, 40)), (3, prose(3, 80)), (3, prose(2, 40)), (None, prose(2, 40)), (None, prose(4, 90)), (None, prose(4, 90)), (None, "short"), (None, None)]
    rows += [(rng.choice([None, 10, 11, 12, 13]), "".join(rng.choice(parts) for _ in range(rng.randrange(1, 5)))) for _ in range(30)]
    least, want = {}, []
    for k, (i, t) in enumerate(rows):
        b = (t or "").encode()
        for p in range(len(b) - 99):
            least[b[p : p + 100]] = min(least.get(b[p : p + 100], (math.inf, math.inf)), (math.inf if i is None else i, p))
    for k, (i, t) in enumerate(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if least[b[p : p + 100]] < (math.inf if i is None else i, p):
                gone[p : p + 100] = b"x" * 100
        want.append((k, len(b), sum(map(bool, gone)), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, k long").repartition(3)
    assert rows_of(suffixes.cut_repeats(df, ["k"]), "k", "n_bytes", "n_removed", "kept_sha256") == sorted(want, key=str)
    assert [w[2] for w in want[:6]] == [0, 0, 0, want[3][1], 0, want[5][1]] and want[7][2] == want[8][2] == 0


def test_suffixes_in_lanes_and_windows(spark, monkeypatch):
    """Packets cut anew in lanes, long texts in windows, hot anchors as single strings."""
    real = suffixes.windows
    monkeypatch.setattr(suffixes, "PART", 3000)
    monkeypatch.setattr(suffixes, "BUCKET", 2000)
    monkeypatch.setattr(suffixes, "FAN", 3)
    monkeypatch.setattr(suffixes, "HOT", 3)
    header = prose(1, 40)
    rows = [(i, f"{header} {prose(200 + i, 60)}") for i in range(40)] + [(100 + i, prose(200 + i, 60) + header) for i in range(0, 40, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffixes.cut_repeats(df).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_cuts(rows)
    assert real is suffixes.windows


def test_windows_give_the_same_anchors():
    text = (prose(1, 300) + "x" * 500 + "ab " * 150 + prose(1, 300) + prose(2, 100)).encode()
    batch = pa.RecordBatch.from_arrays([pa.array(["", text.decode(), "short"])], names=["text"])

    def found(limit):
        suffix, covered = {}, set()
        for data, off, rows, base, lead in suffixes.windows([batch], limit):
            (row, first, count, place, name), (s_row, s, e), _ = suffixes.anchors(data, off, lead)
            for k in range(len(row)):
                for x in range(first[k], first[k] + count[k]):
                    assert rows[row[k]] == 1
                    suffix[x - off[row[k]] + base] = (place[k] - off[row[k]] + base, name[k])
            for k in range(len(s)):
                covered |= {*range(s[k] - off[s_row[k]] + base, e[k] - off[s_row[k]] + base)}
        return suffix, covered

    whole, covered = found(1 << 20)
    assert len({p for p, _ in whole.values()}) < len(whole) / 10 and len(covered) > 800
    for limit in (97, 300, 1000):
        some, more = found(limit)
        assert all(whole[k] == some[k] for k in whole) and more <= covered


@pytest.mark.parametrize("unit", ["a", "ab ", "0123456789" * 4, "é"])
def test_repetitive_texts(spark, unit):
    rows = [(1, unit * (2600 // len(unit))), (2, prose(1, 40) + unit * 300), (3, unit * 60 + prose(2, 30) + unit * 90), (4, "b" + unit * 150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffixes.cut_repeats(df).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_cuts(rows)


def test_suffixes_with_clashing_names(spark):
    rows = [(1, prose(1, 60), 5, "p", "g"), (2, prose(1, 60), 6, None, "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, part long, n_bytes string, row string")
    got = suffixes.cut_repeats(df, ["doc_id", "part", "n_bytes", "row"])
    assert got.columns == ["doc_id", "part", "row", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert rows_of(got, "doc_id", "part", "row") == [(1, 5, "g"), (2, 6, "h")]
    left = suffixes.without_repeats(df)
    assert left.columns == df.columns and rows_of(left, *df.columns) == [rows[0], (2, "", 6, None, "h")]


def test_refine():
    text = np.frombuffer(b"x" * 30 + prose(1, 60).encode()[:200] + b"--" + prose(1, 60).encode()[:200], np.uint8)
    places = np.arange(len(text) - 99)
    got = suffixes.refine(text, places, places)
    seen, want = set(), []
    for p in places:
        want.append(bytes(text[p : p + 100]) in seen)
        seen.add(bytes(text[p : p + 100]))
    assert got.tolist() == want and any(want)


# -- op5 ---------------------------------------------------------------------


def test_licences(spark, none):
    rows = [(1, "prose\nReleased under the MIT License.\nmore"), (2, "Licensed under the Apache License, Version 2.0."), (3, "This work is licensed under the GNU General Public License, version 3."), (4, "Licensed under CC BY-NC 4.0."), (5, "the driver license was lost"), (6, None), (7, ""), (8, "licence " * 3000), (1, "prose\nReleased under the MIT License.\nmore"), (None, "Released under the MIT License.")]
    rows += [(9, "x\nReleased under the MIT License.\nLicensed under the Apache License, Version 2.0.\n"), (10, "affero\n" * 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit("clash")).withColumn("run", F.lit(1))
    found = {(r.doc_id, r.paragraph, *r.families) for r in licences.notices(docs).collect() if r.families}
    assert found == {(1, 1, "mit"), (2, 0, "apache"), (3, 0, "gpl"), (4, 0, "cc-by-nc"), (None, 0, "mit"), (9, 1, "apache", "mit")}
    assert licences.scan(none).count() == 0


#: Notices as they stand in files, and lines that only share their words.
NOTICES = [
    ("gpl", "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."),
    ("lgpl", "# This library is free software; you can redistribute it and/or\n# modify it under the terms of the GNU Lesser General Public\n# License as published by the Free Software Foundation; either\n# version 2.1 of the License, or (at your option) any later version."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it\nunder the terms of the GNU Affero General Public License as published\nby the Free Software Foundation"),
    ("mit", "MIT License\n\nCopyright (c) 2020 Someone\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights"),
    ("apache", " * Licensed under the Apache License,\n * Version 2.0 (the \"License\");\n * you may not use this file except in compliance with the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"),
    ("mpl", "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed with this\n// file, You can obtain one at"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted"),
    ("cc-by-sa", "This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License."),
    ("mit", "# SPDX-License-Identifier: MIT"), ("apache", "SPDX-License-Identifier: Apache-2.0"), ("mit", "The MIT License"), ("cc0", "// SPDX-License-Identifier: CC0-1.0"),
    ("", "the committee discussed the mit license and rejected it"), ("", "She studied at MIT before the license was granted"), ("", "The Apache people lived on the plains"), ("", "All rights reserved."),
    ("", "A general public debate about free software"), ("", "The terms of the license\nwere never published"), ("", "you may use this copy of the file"), ("", "the mozilla foundation published a version of its software"), ("", "permission to copy this letter was refused by any person"),
]


def test_licences_by_hand(spark):
    """Wrapped notices, titles and identifiers, against labels given by hand."""
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(NOTICES)], "doc_id long, text string")
    got = defaultdict(set)
    for r in licences.notices(docs).collect():
        got[r.doc_id] |= {*r.families}
    wrong = [(t, got[i]) for i, (f, t) in enumerate(NOTICES) if got[i] != ({f} if f else set())]
    assert len(wrong) <= 1, wrong


def test_licence_templates_are_their_family(spark):
    rows = [(i, t) for i, ts in enumerate(licences.TEMPLATES.values()) for t in ts]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    names = list(licences.TEMPLATES)
    assert sum(r.family == names[r.doc_id] for r in got) >= 0.9 * len(got) and len(got) == len(rows)


def test_licences_stay_native(spark, docs):
    lines = docs.select(F.col("text").alias("line"))
    for df in (licences.paragraphs(docs), licences.classified(lines), licences.notices(docs)):
        shown = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in shown and "Arrow" not in shown and "Cartesian" not in shown


def test_licences_take_words_once(spark, tmp_path):
    """A line's words are taken once in each pass, not again for each of its pairs; lines
    without a pair stay."""
    title = "the mit license"
    rows = [("affero",), (title,), (f"{title} " + " ".join(f"w{i}" for i in range(3000)),)]
    spark.createDataFrame(rows, "line string").write.parquet(str(tmp_path / "lines"))
    found = licences.classified(spark.read.parquet(str(tmp_path / "lines")))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 2
    got = {r.line: (r.overlap, r.confirmed) for r in found.collect()}
    assert len(got) == 3 and got["affero"] == (0, False) and got[title] == (1000, True) and not got[rows[2][0]][1]


# -- op6 ---------------------------------------------------------------------


def brute_simhash(text):
    """The votes of every term on every bit, without lanes."""
    data, off = common.column_bytes(pa.array([text], pa.large_string()))
    key, _ = common.shingles(data, off, 3)
    halves = [key, common.mix(key ^ common.U64(0xD6E8FEB86659FD93))]
    bits = np.concatenate([np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1) for h in halves], axis=1)
    return np.packbits(bits.sum(0) * 2 > len(key)).tobytes()


def test_simhash_votes():
    for text in ("", "a", "a b c d", prose(1, 300), prose(2, 2000)):
        got = simhash.fingerprints(*common.column_bytes(pa.array([text], pa.large_string())))[0].tobytes()
        assert got == brute_simhash(text)


@pytest.mark.parametrize("size", [32 << 20, 4_000, 1])
def test_edited(spark, docs, none, size):
    got = {r.doc_id: r for r in simhash.edited(docs, range_bytes=size).collect()}
    texts = sorted(((r[0], r[1] or "") for r in corpus()), reverse=True)
    assert len(got) == len(texts)
    for k, (i, t) in enumerate(texts):
        after, m = texts[(k + 1) % len(texts)][1], len(t) // 3
        new = t[: len(t) - m] + after[:m]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert got[i].fingerprint == brute_simhash(t).hex() and got[i].edited_fingerprint == brute_simhash(new).hex()
    assert got[0].fingerprint == got[1].fingerprint and got[8].near_edited > got[8].near_next
    assert simhash.edited(none).count() == 0


def test_edited_ties_and_nulls(spark):
    """Equal ids follow each other in text order, null ids come last; the last row is
    followed by the first."""
    rows = [(5, prose(1, 20)), (5, prose(2, 20)), (5, prose(2, 20)), (9, prose(3, 20)), (None, prose(4, 20)), (None, None), (-(1 << 63), prose(5, 20))]
    texts = sorted(((-(1 << 63) if i is None else i, i is None, t or "") for i, t in rows), key=lambda r: (-r[0], r[1], r[2]))
    want = sorted((hashlib.sha256((t[: len(t) - len(t) // 3] + texts[(k + 1) % len(texts)][2][: len(t) // 3]).encode()).hexdigest(), None if none else i) for k, (i, none, t) in enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for size in (1 << 20, 60, 1):
        got = simhash.edited(df, range_bytes=size).collect()
        assert sorted(((r.edited_sha256, r.doc_id) for r in got), key=str) == sorted(want, key=str)
    assert [r.near_next for r in simhash.edited(df.limit(1)).collect()] == [1.0]


def test_near_finds_every_pair(spark):
    rng = random.Random(2)
    prints = [rng.getrandbits(128) for _ in range(30)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(128), k)) for p in prints[:20] for k in (1, 3, 4)]
    shown = [f"{p:032x}" for p in prints]
    want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(sorted({*shown}), 2) if (int(a, 16) ^ int(b, 16)).bit_count() <= 3}
    df = spark.createDataFrame([(x,) for x in [*shown, shown[0]]], "fingerprint string")
    got = [(r.a, r.b) for r in simhash.near(df, 3).collect()]
    assert len(got) == len({*got}) and {*got} == want and len(want) >= 40


def test_near_copies_are_counted(spark, tmp_path):
    """op6 counts every fingerprint within its radius, and that radius holds near copies."""
    texts = []
    for k in range(12):
        words = prose(300 + k, 150).split()
        texts += [" ".join(words), " ".join([*words[:70], "other", *words[71:]]), " ".join(words[3:])]
    texts += [prose(400 + k, 3) for k in range(40)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    prints = [int(brute_simhash(t).hex(), 16) for t in texts]
    want = [sum(0 < (a ^ b).bit_count() <= 20 for b in {*prints}) for a in prints]
    got = {r.doc_id: r.near_count for r in simhash.op6_simhash(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(texts))] == want and sum(x > 0 for x in want[:36]) >= 34


@pytest.mark.parametrize("radius", [0, 6, 20, 30])
def test_near_at_any_radius(spark, monkeypatch, radius):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 60)
    rng = random.Random(3)
    prints = [rng.getrandbits(128) for _ in range(25)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(128), k)) for p in prints for k in (1, 6, 7, 19, 20, 21, 30, 31)]
    want = {(f"{a:032x}", f"{b:032x}", (a ^ b).bit_count()) for a, b in itertools.combinations(sorted({*prints}), 2) if (a ^ b).bit_count() <= radius}
    got = rows_of(simhash.near(spark.createDataFrame([(f"{x:032x}",) for x in prints], "fingerprint string"), radius), "a", "b", "distance")
    assert len(got) == len(want) and {*got} == want and bool(want) == (radius > 0)


# -- op7 ---------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    html = "<p>" + prose(1, 400) + "</p>"
    rows = [(1, "http://a/", html), (5, "http://b/", html), (3, None, html), (2, "u", "short"), (4, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", "<é>" * 9000), (9, "u", "x\r\n\r\ny WARC/1.1")]
    rows += [(100 + i, f"http://c/{i}", f"<html>{prose(i, 300)}</html>") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.url) for r in warc.archive(spark, pages, f"file://{tmp_path}/w", archive_bytes=40_000).collect()}
    for i, url, h in rows:
        raw = (h or "").encode()
        refers = 5 if i in (1, 3) else None
        assert got[i] == (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if refers else "response", refers, url)
    archives = [*(tmp_path / "w").glob("*.warc.zst")]
    assert len(archives) > 1 and not [*(tmp_path / "w").glob("_attempt*")]
    payload = {}
    for path in archives:
        with path.open("rb") as f:
            for raw in warc.read(f):
                head, body = warc.parse(raw)
                payload[head["WARC-Record-ID"]] = body
    assert payload["<urn:x-page:8>"] == ("<é>" * 9000).encode() and payload["<urn:x-page:1>"] == b""
    assert warc.archive(spark, pages.limit(0), f"file://{tmp_path}/e").count() == 0


def test_warc_keeps_every_payload_of_an_id(spark, tmp_path):
    """Of an id's rows only those are revisits whose own payload a larger id has."""
    a, b = "A" * 2000, "B" * 2000
    rows = [(1, "u", a), (1, "u", b), (2, "u", a), (2, "u", a), (None, "u", a), (None, "u", b)]
    got = warc.archive(spark, spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/w").collect()
    sha = {x: hashlib.sha1(x.encode()).hexdigest() for x in (a, b)}
    want = [(1, sha[a], "revisit", 2), (1, sha[b], "response", None), *[(2, sha[a], "response", None)] * 2, (None, sha[a], "response", None), (None, sha[b], "response", None)]
    assert sorted(((r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    bodies = [warc.parse(raw)[1] for path in (tmp_path / "w").glob("*.warc.zst") for raw in warc.read(path.open("rb"))]
    assert bodies.count(b.encode()) == 2 and bodies.count(a.encode()) == 3 and bodies.count(b"") == 1


def test_join_with_hot_keys(spark):
    rows = [(k % 7 if k % 3 else 99, k) for k in range(300)]
    left = spark.createDataFrame(rows, "k long, x long")
    right = left.groupBy("k").agg(F.count("*").alias("n"))
    for share in (1, 5, 10, 1000):
        got = common.join_counted(left, right, ["k"], "n", 300, share)
        assert sorted((r.k, r.x) for r in got.collect()) == sorted(rows)


def test_clusters_need_a_shared_folder(spark, monkeypatch):
    class Held:
        def isDefined(self):
            return False

    class Sc:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: Held()})()})()

    class Session:
        conf = type("C", (), {"get": lambda self, *a: None})()
        sparkContext = Sc()

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session())


def test_warc_frames_stand_alone():
    out = io.BytesIO()
    out.close = lambda: None
    writer = warc.Writer(out, sample_bytes=3000)
    raws = [warc.record(i, "u", prose(i, 40).encode(), None) for i in range(60)]
    for r in raws:
        writer.add(r)
    writer.close()
    assert out.getvalue()[:4] == b"\x5d\x2a\x4d\x18"
    assert list(warc.read(io.BytesIO(out.getvalue()), step=7)) == raws
    with pytest.raises(ValueError, match="cut short"):
        list(warc.read(io.BytesIO(out.getvalue()[:-5])))


# -- op9 ---------------------------------------------------------------------


def brute_top(queries, rows, k):
    out = []
    for i, q in queries:
        best = sorted((-int(np.dot(q, v)), j) for j, v in rows if j != i and len(v) == len(q))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return out


@pytest.mark.parametrize("kind", ["plain", "ties", "copies", "large", "few"])
def test_top_k(spark, kind, coalesced):
    rng = np.random.default_rng(3)
    n = {"few": 6}.get(kind, 700)
    v = rng.integers(-3, 3, (n, 8)) if kind == "ties" else rng.normal(size=(n, 8)) * (1e8 if kind == "large" else 100)  # scores have to fit 64 bits
    v = v.astype(np.int64)
    if kind == "copies":
        v[::3] = v[0]
    rows = [(i, v[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    queries = [r for r in rows if r[0] % (3 if kind == "few" else 50) == 0]
    got = covertree.top_k(df, df.where(F.col("vec_id").isin([q[0] for q in queries])), 10, block_rows=200, group_rows=8)
    want = brute_top([(i, np.array(x, object)) for i, x in queries], [(i, np.array(x, object)) for i, x in rows], 10)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("kind", ["11", "12", "40", "64", "clusters", "shared id"])
def test_own_row_takes_no_place(kind):
    """Unit vectors: each is its own best match, in a leaf that holds its ten best."""
    rng = np.random.default_rng(5)
    v = np.repeat(rng.normal(size=(9, 16)), 30, axis=0) + rng.normal(size=(270, 16)) / 50 if kind == "clusters" else rng.normal(size=(int(kind) if kind.isdigit() else 50, 16))
    v = np.floor(1024 * v / np.linalg.norm(v, axis=1)[:, None]).astype(np.int64)
    ids = np.arange(len(v)) // (4 if kind == "shared id" else 1)
    got = [(i, s) for _, i, s in covertree.search(v, ids, covertree.Points(v, ids, 10))[0]]
    for n, q in enumerate(v):
        best = sorted((-int(x @ q), int(i)) for x, i in zip(v, ids, strict=True) if i != ids[n])[:10]
        assert got[10 * n : 10 * n + 10] == [(i, -s) for s, i in best]


def test_clusters_are_pruned(spark):
    """Blocks that no query's floor allows are not visited; the result is that of all pairs."""
    rng = np.random.default_rng(8)
    v = (np.repeat(rng.normal(size=(20, 8)) * 1000, 60, axis=0) + rng.normal(size=(1200, 8)) * 9).astype(np.int64)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<long>")
    got, done, every = covertree.search_report(df, df.where("vec_id % 100 = 0"), 10, block_rows=100)
    want = brute_top([(i, x) for i, x in enumerate(v) if i % 100 == 0], list(enumerate(v)), 10)
    assert rows_of(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=str) and done < every / 3


def test_scores_beyond_64_bits_stop_there(spark):
    big = (1 << 63) - 1
    rows = [(0, [big, 1]), (1, [big, 5]), (2, [-big, 0]), (3, [0, 2]), (4, [big, 5]), (4, [big, 5])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = rows_of(covertree.top_k(df, df.where("vec_id = 0"), 10), "rank", "vec_id", "score")
    assert got == [(1, 1, big), (2, 4, big), (3, 3, 2), (4, 2, -big - 1)]
    far = covertree.whole_numbers(spark.createDataFrame([(0, [1e300, -1e300])], "vec_id long, embedding array<double>"))
    assert far.first().v == [big, -big - 1]


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.0001]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0]), (6, [1.0, 1.0]), (None, [1.0, 1.0])]
    df = covertree.whole_numbers(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert rows_of(df, "vec_id", "v") == [(0, [512, -1]), (5, [1024]), (6, [1024, 1024])]
    assert rows_of(covertree.top_k(df, df), "query_id", "vec_id") == [(0, 6), (6, 0)]
    assert covertree.top_k(df.limit(0), df.limit(0)).count() == 0


# -- op10 --------------------------------------------------------------------


def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_tokens_are_the_tokenizers():
    coder = packing.Tokens(tokenizer_path(), most=50)
    coder.encode(["x" * 5000 + " ab"])
    assert all(len(k) <= 48 for k in coder.chunks) and "ab" in coder.chunks
    texts = [r[1] or "" for r in corpus()] + ["a\x1cb", "İ ΣΑΣ x’s 12３", "<|endoftext|>x don't DON'T'S", "é́ é", "a b", "🙂🙂a1", "ŉ ſ K", "Été***, ÉTÉ!! it's"]
    got = [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)]
    assert got == [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("rows", [50_000, 40])
def test_packing(spark, docs, none, rows):
    path = tokenizer_path()
    coder = packing.Tokens(path)
    long = spark.createDataFrame([(200 + i, prose(i, 30 + 37 * i % 900)) for i in range(150)] + [(8, "repeated"), (8, "repeated")], "doc_id long, text string")
    some = docs.select("doc_id", "text").union(long)
    got = packing.pack(packing.pieces(some, path), rows_per_part=rows).collect()
    want = []
    for r in some.collect():
        ids = [*coder.tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        want += [(r.doc_id, k, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        held.sort()
        assert [o for o, _ in held] == [0, *np.cumsum([n for _, n in held])[:-1]] and sum(n for _, n in held) <= 2048
    bound = packing.lower_bound(np.array([x[3] for x in want]), 2048)
    if len(bins) == bound and rows > 1000:
        assert all(r.certified for r in got)
    assert bound <= len(bins) <= bound + (1 if rows > 1000 else 3)
    assert packing.pack(packing.pieces(none, path)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_bounds_never_exceed_the_best(seed):
    rng = random.Random(seed)
    sizes = [rng.randrange(1, 11) for _ in range(9)]

    def fewest(rest, rooms):
        if not rest:
            return len(rooms)
        n, best = rest[0], fewest(rest[1:], [*rooms, 10 - rest[0]])
        for room in {r for r in rooms if r >= n}:
            other = rooms.copy()
            other.remove(room)
            best = min(best, fewest(rest[1:], [*other, room - n]))
        return best

    _, _, fill = packing.best_fit(np.array(sizes), 10)
    assert packing.lower_bound(np.array(sizes), 10) <= fewest(sorted(sizes, reverse=True), []) <= len(fill)
