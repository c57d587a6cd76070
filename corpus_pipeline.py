"""Corpus cleaning as stages of the training-data operators, each over all that its predecessor kept.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame with
the columns of documents, the last one packed pieces. Between stages the rows are written as Parquet
in the shared folder and read again, so a lost executor costs its own tasks only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import decontaminate, packing, pii, simhash, toxicity
from ridgeline.llm.common import drop_table, materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised model scores under one half, columns as they are.

    Null and empty texts score like texts without any feature. Rows without a doc_id are scored and train
    nothing. Repeated rows are each judged alike. An empty table stays empty.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, "__toxic").where("__toxic < 0.5").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: the one with the least doc_id (see simhash.deduplicate)."""
    return simhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with a benchmark item (see decontaminate.clean).

    Null and empty texts and rows without a doc_id share none, and stay. Of rows that share a doc_id all go
    if one does. An empty table, or an empty benchmark, changes nothing.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind in brackets (see pii.redact).

    Null texts stay null, empty ones empty; rows without a doc_id and repeated rows are redacted alike.
    """
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences (see packing.pack): null and empty texts are one end id each,

    repeated rows and rows without a doc_id are packed each. An empty table gives no pieces.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: Fingerprints, boosted trees and tokenizers are beyond SQL; tests hold the rows against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        after = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            after = materialise(after, name)
            if i:
                drop_table(docs)
        docs = after
    return docs
