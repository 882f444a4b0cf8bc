"""Frame-ordered computation that never puts a whole source into one task.

A source may hold a third of all rows, so no window is partitioned by source alone. Rows are cut
into chunks of consecutive frames and windows run per (source, chunk):

* a bounded window copies the few neighbour rows it needs into the chunk (``spread``);
* an unbounded look-back (streaks, last known value, running sum) is the chunk's own running value
  plus a carry computed over one summary row per chunk (``carry``);
* a state machine is folded per chunk and re-run only where the assumed entry state was wrong
  (``trackloom.folds``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.session import chunk_frames

CHUNK = "chunk_no"
OWN = "chunk_own"


def chunk_of(frame: Column | str, size: int) -> Column:
    frame = F.col(frame) if isinstance(frame, str) else frame
    return F.floor(frame / F.lit(size)).cast("long")


def with_chunk(df: DataFrame, frame: str = "frame") -> DataFrame:
    return df.withColumn(CHUNK, chunk_of(frame, chunk_frames(df.sparkSession)))


def spread(df: DataFrame, back: int, ahead: int, frame: str = "frame") -> DataFrame:
    """Put every row in its own chunk and in each chunk that looks back/ahead far enough to see it."""
    size = chunk_frames(df.sparkSession)
    first = F.greatest(F.lit(0), chunk_of(F.col(frame) - F.lit(ahead), size))
    last = chunk_of(F.col(frame) + F.lit(back), size)
    return (df.withColumn(CHUNK, F.explode(F.sequence(first, last)))
              .withColumn(OWN, F.col(CHUNK) == chunk_of(frame, size)))


def own_rows(df: DataFrame, chunk: bool = False) -> DataFrame:
    """The rows in their own chunk; with ``chunk`` they keep its number, so that they need not be dealt by it again."""
    return df.filter(OWN).drop(OWN) if chunk else df.filter(OWN).drop(OWN, CHUNK)


def by_chunk(keys: Sequence[str] = ("source_id",), order: Sequence = ("frame",)):
    return Window.partitionBy(*keys, CHUNK).orderBy(*order)


def running(window):
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def carry(df: DataFrame, last: Mapping[str, Column] | None = None,
          total: Mapping[str, Column] | None = None, least: Mapping[str, Column] | None = None,
          greatest: Mapping[str, Column] | None = None, following: Mapping[str, Column] | None = None,
          keys: Sequence[str] = ("source_id",), frame: str = "frame") -> DataFrame:
    """Add, per row, what the source's earlier chunks leave behind.

    ``last``: last non-null value before this chunk; ``total``: sum before this chunk;
    ``following``: first non-null value after this chunk; ``least``/``greatest``: over the whole
    source. Only one row per chunk crosses the per-source window.
    """
    return df.join(left_behind(df, last, total, least, greatest, following, keys, frame), [*keys, CHUNK], "left")


def left_behind(df: DataFrame, last: Mapping[str, Column] | None = None,
                total: Mapping[str, Column] | None = None, least: Mapping[str, Column] | None = None,
                greatest: Mapping[str, Column] | None = None, following: Mapping[str, Column] | None = None,
                keys: Sequence[str] = ("source_id",), frame: str = "frame") -> DataFrame:
    """What ``carry`` adds, one row per chunk."""
    last, total, following = last or {}, total or {}, following or {}
    least, greatest = least or {}, greatest or {}
    known = lambda c: F.when(c.isNotNull(), F.col(frame))
    aggregates = (
        [F.max_by(c, known(c)).alias(f"s_{n}") for n, c in last.items()]
        + [F.sum(c).alias(f"s_{n}") for n, c in total.items()]
        + [F.min_by(c, known(c)).alias(f"s_{n}") for n, c in following.items()]
        + [F.min(c).alias(f"s_{n}") for n, c in least.items()]
        + [F.max(c).alias(f"s_{n}") for n, c in greatest.items()])
    ordered = Window.partitionBy(*keys).orderBy(CHUNK)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    # a descending order keeps "next known value" a running frame, linear in the chunk count
    after = Window.partitionBy(*keys).orderBy(F.desc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    return df.groupBy(*keys, CHUNK).agg(*aggregates).select(
        *keys, CHUNK,
        *[F.last(f"s_{n}", ignorenulls=True).over(before).alias(n) for n in last],
        *[F.coalesce(F.sum(f"s_{n}").over(before), F.lit(0)).alias(n) for n in total],
        *[F.last(f"s_{n}", ignorenulls=True).over(after).alias(n) for n in following],
        *[F.min(f"s_{n}").over(whole).alias(n) for n in least],
        *[F.max(f"s_{n}").over(whole).alias(n) for n in greatest])


def numbered(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence, name: str) -> DataFrame:
    """1-based row number per key that sorts only one bucket at a time.

    ``bucket`` must be monotone in ``order``; one count per (key, bucket) gives each bucket's offset.
    """
    rows = df.withColumn("n_bucket", bucket)
    counts = rows.groupBy(*keys, "n_bucket").agg(F.count(F.lit(1)).alias("n_rows"))
    before = Window.partitionBy(*keys).orderBy("n_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "n_bucket",
                            F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("n_offset"))
    inside = Window.partitionBy(*keys, "n_bucket").orderBy(*order)
    return (rows.join(offsets, [*keys, "n_bucket"])
                .withColumn(name, (F.row_number().over(inside) + F.col("n_offset")).cast("long"))
                .drop("n_bucket", "n_offset"))
