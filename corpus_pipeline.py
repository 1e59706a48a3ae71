"""The corpus pipeline: documents to packed training sequences.

Every stage is ``function(spark, docs, sf_dir) -> DataFrame``; its result is
written as Parquet and read again as the next one's ``docs``.  All but the
last return the columns of documents.

1. toxicity: documents that the classifier rejects (score at or above the
   threshold of their language) go.
2. near-duplicates: of each class one document stays.
3. secrets: found spans are replaced by a mask; all documents stay.
4. mixing: a row for each time a document is taken.
5. packing: pieces of sequences.

Cases: what the operators state; empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evstat.llm import mixing, neardup, packing, secret_ledger, toxicity
from evstat.llm.common import fresh, materialise, table
from evstat.llm.queries import held_out, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    score = fresh(docs, "_toxic")
    scored = toxicity.score(docs, model, out=score)
    return scored.where(F.col(score) < F.col(f"{score}_limit")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secret_ledger.found_in(docs)
    spans = fresh(docs, "_secrets")
    rows = secret_ledger.join_back(docs, secret_ledger.blob_col("text"), found, out=spans)
    hit = F.size(spans) > 0
    text = F.when(hit, secret_ledger.redact(F.col("text"), F.col(spans))).otherwise(F.col("text"))
    rows = rows.withColumn("text", text)
    rows = rows.withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prefix = fresh(docs, "mix_")
    return mixing.repeat_rows(mixing.mix(docs, prefix=prefix), docs.columns, prefix=prefix)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_documents),
]

#: Learnt weights and a tokenizer have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{i}-{name}")
    return docs
