"""The training-corpus pipeline: documents in, a mixed corpus out.

Five stages, each a function of (spark, docs, sf_dir) over everything its predecessor kept. All but the last return the columns
of ``documents``:

1. toxicity: documents that the non-negative PU model scores at 0.7 or more go;
2. near_duplicates: one document of each ProbMinHash class stays, the one with the smallest doc_id, in one row;
3. decontaminate: documents that hold a benchmark item go;
4. secrets: every secret span is replaced by a mark, so the document stays and the secret does not; n_chars follows;
5. mix: each document is emitted as often as its source's target asks (0 to 2 times), with the figures of the mix and copy_no.

The result of each stage is written as Parquet in the shared folder (``spark.checkpoint.dir``) and read again, so a lost
executor costs the running stage at most. Nulls, empty tables and repeated rows follow the definitions of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackloom.llm import entropy_scan, mixing, prob_minhash, templates, toxicity
from trackloom.llm.common import documents, materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return prob_minhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return templates.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return entropy_scan.redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plan = mixing.source_plan(mixing.sized_documents(docs))
    return mixing.emit_copies(mixing.mix_sources(docs, plan))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontaminate", decontaminate),
          ("secrets", redact_secrets), ("mix", mix)]

# the first stage fits a classifier, which SQL cannot state; tests/llm compares the pipeline with a plain version instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
