"""What the text operators share: registration, the word definition, stored stages, row-wise numpy columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import ORACLES, QUERIES
from trackloom.session import lookup, materialize, shared_dir

WORD = r"[^\x20\x09-\x0D]+"

__all__ = ["WORD", "documents", "lookup", "materialize", "n_words", "oracle", "pack", "query", "shared_dir", "unpack", "words"]


def query(name: str):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        return fn
    return register


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; ``bytes.split`` cuts at exactly the six ASCII blanks of ``WORD``."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def n_words(text: Column) -> Column:
    """Words of a text, counted natively; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def pack(df: DataFrame, **keys: Column) -> DataFrame:
    """All columns as one struct ``packed_row`` beside the named keys, so that no name of the input can clash in a join."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("packed_row"), *[c.alias(name) for name, c in keys.items()])


def unpack(df: DataFrame) -> DataFrame:
    return df.select("packed_row.*")
