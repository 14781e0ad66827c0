"""From raw documents to packed sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes
each as Parquet into the shared folder and reads it again as the next one's docs.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm import common, minhash, mixing, packing, suffixes, toxicity

TOXIC_FROM = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold.  The model learns
    from the labelled rows of ``docs`` that are not held out; if these teach it no
    term, all documents have one score, which tells none apart, and all stay."""
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    if not len(model.slots):
        return docs
    score = common.fresh("toxicity", docs.columns)
    return toxicity.score(docs, model, docs.columns, score).where(F.col(score) < TOXIC_FROM).select(*(F.col(f"`{k}`") for k in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each near-duplicate group, linked at a
    similarity of 0.8, as near-duplicate stages are unless a contract says otherwise.
    Rows that share an id are one document; rows without an id stay."""
    gone = minhash.near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the bytes of strings that also start earlier."""
    return suffixes.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mix of sources takes them."""
    return mixing.mixed_texts(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeated_passages),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: A trained classifier and a tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if held is not None:  # written anew: nothing reads the one before
            common.discard(held)
        held = docs
    return docs
