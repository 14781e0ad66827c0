"""The pipeline's stages against brute force, each on what the one before kept."""

import random
import re
from collections import defaultdict

import duckdb
import pytest
from test_operators import WORDS, brute_components, brute_cuts, prose

import __spark_entry__ as entry
import corpus_pipeline
from quillgrid.llm import common, mixing, packing, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng, rows, labels = random.Random(8), [], []
    shared = prose(77, 60)
    for i in range(260):
        toxic = i % 4 == 1
        text = prose(1000 + i, 80) + ("\n" + shared if i % 6 == 0 else "")
        rows.append([i, text.replace(" ", " nastyword ", 3) if toxic else text])
        labels.append((i, 1, int(toxic)))
    for i in range(260, 300):
        words = rows[(i - 260) * 4][1].split()
        if i % 2:
            words[5] = rng.choice(WORDS)
        rows.append([i, " ".join(words)])
    rows += [[300, None], [301, ""], [302, "clean and short"]]
    base = tmp_path_factory.mktemp("sf")
    full = [(i, t, "en", None if i % 9 == 0 else f"s{i % 4}", len(t or "")) for i, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return str(base)


def test_stages(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    columns, had = docs.columns, {r.doc_id: r for r in docs.collect()}
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.staged(stage(spark, docs, sf_dir), name)
        kept[name] = docs
        if name != "best_fit_packing":
            assert docs.columns == columns
        held = [(r.doc_id, r.text) for r in before.collect()]
        if name == "toxicity":
            score = {r.doc_id: r.score for r in toxicity.score(before, toxicity.fit(before, common.table(spark, sf_dir, "labels"))).collect()}
            assert {r.doc_id for r in docs.collect()} == {i for i in score if score[i] < 0.3}
            assert not any("nastyword" in (r.text or "") for r in docs.collect()) and {0, 300, 301, 302} <= {r.doc_id for r in docs.collect()}
        elif name == "minhash_near_dedup":
            label = brute_components(held)[1]
            assert {r.doc_id for r in docs.collect()} == {i for i in label if label[i] == i} and len({*label.values()}) < len(label) - 10
        elif name == "suffix_array_dedup":
            want = brute_cuts(held)
            assert {r.doc_id: len((r.text or "").encode()) for r in docs.collect()} == {i: n - gone for i, (n, gone, _, _) in want.items()}
            assert sum(x[1] for x in want.values()) > 3000 and all(r.n_chars == len(r.text) and r.source == had[r.doc_id].source for r in docs.collect())
        elif name == "source_mixing":
            plan, got = {r.doc_id: r.taken for r in mixing.mix(before).collect()}, defaultdict(int)
            for r in docs.collect():
                got[r.doc_id] += len(re.findall(common.WORD, r.text))
            assert dict(got) == {i: n for i, n in plan.items() if n}
        else:
            path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
            coder = packing.Tokens(path)
            assert sum(r.length for r in docs.collect()) == sum(len(x) // 4 + 1 for x in coder.encode([t or "" for _, t in held]))
    same = lambda df: sorted(map(tuple, df.select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
    assert same(corpus_pipeline.run(spark, sf_dir)) == same(kept["best_fit_packing"])


def test_pipeline_of_nothing(spark, sf_dir, tmp_path):
    common.table(spark, sf_dir, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    common.table(spark, sf_dir, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("kind", ["empty", "not in common", "one class"])
def test_no_usable_label_drops_no_document(spark, sf_dir, tmp_path, kind):
    docs, labels = (common.table(spark, sf_dir, k) for k in ("documents", "labels"))
    labels = {"empty": labels.limit(0), "not in common": labels.selectExpr("doc_id + 1000 as doc_id", "quality", "toxic"), "one class": labels.where("toxic = 1")}[kind]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
    if kind == "empty":
        assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if k.startswith("op")))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, answer = entry.queries()[name](spark, SF), con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(answer.columns)
    place = [answer.columns.index(c) for c in sorted(df.columns)]
    assert sorted(str([r[c] for c in sorted(df.columns)]) for r in df.collect()) == sorted(str([r[k] for k in place]) for r in answer.fetchall())


def test_every_operator_has_a_query():
    assert {int(re.match(r"op(\d+)_", k)[1]) for k in entry.queries() if k.startswith("op")} == {*range(1, 11)} and "pipeline" in entry.queries()


def test_stages_pass_clashing_names_on(spark, sf_dir):
    """Columns named like those at work inside the stages, and null ids, go through."""
    names = {"_score": "x", "toxicity": "y", "part": "p", "_words": "w", "row": "r", "kept_text": "k", "_begin": "b", "node": "n"}
    docs = common.table(spark, sf_dir, "documents")
    docs = docs.union(docs.limit(1).selectExpr("cast(null as long) doc_id", "text", "lang", "source", "n_chars"))
    for k, v in names.items():
        docs = docs.selectExpr("*", f"'{v}' as {k}")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.staged(stage(spark, docs, sf_dir), name)
        assert after.columns == docs.columns and after.count() > 0
        assert {tuple(r[k] for k in names) for r in after.collect()} == {tuple(names.values())}
        docs = after
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() > 0
