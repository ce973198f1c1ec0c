"""A training corpus from `documents`, in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is
written to Parquet and read again as the next one's docs. All but the last return the columns of docs,
whatever further ones those have.

Nulls: a null text counts as an empty one; it stays as it is up to packing, where its end token alone
makes a piece. Null ids pass every stage; of a group of near duplicates an id that is not null stays
before one that is. Repeated rows: all of them or none are drawn by quality, one is kept of those with a
word, and those without a word are linked with nothing and all stay; mixing treats each row by itself.
Ties: the smaller id is drawn, kept and taken first. Long texts are read whole, in pieces. An empty
table, here or after any stage, gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from petroloom.llm import jaccard, mixing, packing, quality, secretscan, shared


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling; the documents it rejects go."""
    return quality.keep(docs, shared.table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join on five words at 0.8; of each group the document with the smallest id stays."""
    return jaccard.keep_one(docs, percent=80, width=5)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced; all documents stay."""
    return secretscan.redact(docs, secretscan.train(secretscan.labelled(docs)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens, by the weights of domains."""
    return mixing.select(docs, share=0.9)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens: a row for each piece of a document."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", select_quality),
    ("n-gram jaccard join", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The models of several stages cannot be written in SQL: tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each written and read again. A stage's working tables go when it is
    written, its result when the next one is; the last result reads the tables that are left."""
    docs, last = shared.table(spark, sf_dir, "documents"), None
    for _, step in STAGES[:-1]:
        with shared.working(spark):
            now = shared.materialize(step(spark, docs, sf_dir), "stage", hold=True)
        if last is not None:
            shared.release(spark, [shared.path_of(last)])
        docs = last = now
    return STAGES[-1][1](spark, docs, sf_dir)
