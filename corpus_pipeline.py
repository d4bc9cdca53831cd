"""The corpus pipeline: five stages over documents, each written as Parquet and reread as the next one's input.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last
return the columns of documents.

1. toxicity: documents scored 0.7 or more go.  The model is learned from the stage's own input and the labels table.
2. near_duplicates: of each group that the n-gram Jaccard join links, the document with the least doc_id stays;
   documents without words stay.
3. secrets: every secret found is replaced by a marker; no document goes.
4. mixing: documents are repeated by Poisson draws towards the target shares of sources and shuffled.
5. packing: power-of-two pieces with their token ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.llm import jaccard_join, mixing, packing, secrets, toxicity
from loamwork.llm.common import bounded_batches, documents, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows that score 0.7 or more.  A null text is scored as the empty one; repeated rows are judged alike, one by
    one; an empty table stays empty; columns beyond those of documents go."""
    model = toxicity.fit(docs, documents(spark, sf_dir, "labels"))
    bounded_batches(spark)
    return docs.select(*COLUMNS).withColumn("_score", toxicity.score(F.col("text"), model)).filter("_score < 0.7").drop("_score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each group of linked rows, the least doc_id's (null counts above all).  Null and empty texts, and texts
    without words, all stay; an empty table stays empty; columns beyond those of documents go."""
    return jaccard_join.drop_near_duplicates(docs.select(*COLUMNS))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows of docs, with secrets in text replaced and n_chars as the text then has.  A null text stays null; repeated rows all
    stay; an empty table stays empty; columns beyond those of documents go."""
    return secrets.redact(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs as often as their draws say.  A null source belongs to the rest, a null doc_id draws as the text "null", null
    texts are carried along; repeated rows draw alike; an empty table stays empty; columns beyond those of documents go."""
    return mixing.replicate(docs.select(*COLUMNS)).drop("copy")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each row of docs, with its token ids.  A null or empty text gives one piece, the end id; repeated rows
    are packed each for itself; an empty table gives no rows; other columns go."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The first stage's learned model cannot be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each result but the last written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    return docs
