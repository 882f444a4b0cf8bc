"""Exact state machines over sources of any length, one chunk per task.

Each chunk is folded from a guessed entry state: the state reached by folding the ``warmup`` rows
before it. One row per chunk then tells whether the guess equals what the previous chunk really ended
in; only chunks that guessed wrong are folded again, until none is left. Decoders return to rest often,
so one pass nearly always suffices, and the result never depends on the chunk size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.chunks import CHUNK, OWN, spread
from trackloom.session import chunk_frames, materialize

# machine(rows of one chunk in frame order, entry state) -> (output columns, exit state)
Machine = Callable[[pd.DataFrame, str], tuple[dict[str, list], str]]


ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def _changes(table: pa.Table, key: Sequence[str]) -> np.ndarray:
    """Rows whose key differs from the row before; a null equals a null."""
    out = np.zeros(max(table.num_rows - 1, 0), bool)
    for name in key:
        column = table[name].combine_chunks()
        a, b = column.slice(0, len(out)), column.slice(1)
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        if column.null_count:
            differ = differ | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
        out |= differ
    return np.flatnonzero(out) + 1


def whole_blocks(batches: Iterable[pa.RecordBatch], key: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by ``key`` as tables of whole groups, with the bounds of their groups; no group is split between two tables."""
    held: list[pa.Table] = []

    def block() -> tuple[pa.Table, np.ndarray]:
        table = pa.concat_tables(held).combine_chunks()
        held.clear()
        return table, np.concatenate([[0], _changes(table, key), [table.num_rows]])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held and len(_changes(pa.concat_tables([held[-1].slice(held[-1].num_rows - 1), table.slice(0, 1)]), key)):
            yield block()
        cuts = _changes(table, key)
        if len(cuts):
            held.append(table.slice(0, cuts[-1]))
            yield block()
            table = table.slice(cuts[-1])
        held.append(table)
    if held:
        yield block()


def group_frames(table: pa.Table, bounds: np.ndarray, columns: Sequence[str]) -> Iterator[pd.DataFrame]:
    """The groups of a block as pandas frames; whole numbers stay whole in a group that has no nulls."""
    table = table.select(list(columns))
    mixed = any(c.null_count and not pa.types.is_floating(c.type) for c in table.columns)
    whole = None if mixed else table.to_pandas()
    for a, b in zip(bounds, bounds[1:]):
        yield table.slice(a, b - a).to_pandas() if mixed else whole.iloc[a:b]


def _runner(machine: Machine, start: str, fields: Mapping[str, str]):
    """Runs the machine over chunks that follow each other in a partition, rows sorted; a task pays per batch, not per chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_blocks(batches, ["source_id", CHUNK]):
            names = [c for c in table.column_names if c not in ("source_id", CHUNK, OWN, "entry_state")]
            own = table[OWN].to_numpy()
            told = table["entry_state"] if "entry_state" in table.column_names else None
            out: dict[str, list] = {c: [] for c in fields}
            entries, exits, at = [], [], []
            for a, b, pdf in zip(bounds.tolist(), bounds[1:].tolist(), group_frames(table, bounds, names)):
                first = int(np.argmax(own[a:b]))  # the rows before a chunk's own are its context
                if not own[a + first]:
                    continue
                if told is not None:
                    entry = told[a].as_py()
                else:
                    entry = machine(pdf.iloc[:first], start)[1] if first else start
                rows, last = machine(pdf.iloc[first:], entry)
                size = len(next(iter(rows.values())))
                # the extra last row carries the chunk's entry and exit states
                for c in fields:
                    out[c] += rows[c]
                    out[c].append(None)
                entries += [None] * size + [entry]
                exits += [None] * size + [last]
                at += [a] * (size + 1)
            if at:
                yield from pa.table({
                    "source_id": table["source_id"].take(pa.array(at)), CHUNK: table[CHUNK].take(pa.array(at)), "entry_state": pa.array(entries, pa.string()),
                    "exit_state": pa.array(exits, pa.string()), **{c: pa.array(out[c], ARROW[t], from_pandas=True) for c, t in fields.items()}}).to_batches()
    return run


def fold(evidence: DataFrame, machine: Machine, start: str, schema: str, warmup: int,
         frame: str = "frame", within: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Run ``machine`` over each source in frame order, rows of one frame ordered by ``within``.

    Returns its output rows (columns of ``schema``) and one (source_id, exit_state) row per source.
    """
    spark = evidence.sparkSession
    fields = dict(part.split() for part in schema.split(", "))
    id_type = dict(evidence.dtypes)["source_id"]
    full = f"source_id {id_type}, {CHUNK} long, entry_state string, exit_state string, {schema}"
    run = _runner(machine, start, fields)
    key = ["source_id", CHUNK]
    # chunks are dealt out and sorted, and a task runs over those it got
    sorted_chunks = lambda df: df.repartition(*key).sortWithinPartitions(*key, frame, *[F.asc_nulls_last(c) for c in within])

    rows = spread(evidence, min(warmup, chunk_frames(spark)), 0, frame)
    # rows only copied into a chunk the source never reaches have nothing to decide
    done = materialize(sorted_chunks(rows).mapInArrow(run, full))
    base = None
    while True:
        states = done.filter("exit_state IS NOT NULL").select(*key, "entry_state", "exit_state")
        real = F.lag("exit_state").over(Window.partitionBy("source_id").orderBy(CHUNK))
        wrong = (states.withColumn("real", real).filter("real <> entry_state")
                       .select(*key, F.col("real").alias("entry_state")))
        if wrong.isEmpty():
            break
        if base is None:
            base = materialize(rows.filter(OWN))
        wrong = materialize(wrong)
        again = sorted_chunks(base.join(wrong, key)).mapInArrow(run, full)
        done = materialize(done.join(wrong.select(*key), key, "left_anti").unionByName(again))
    exits = (done.filter("exit_state IS NOT NULL").groupBy("source_id")
                 .agg(F.max_by("exit_state", CHUNK).alias("exit_state")))
    return done.filter("exit_state IS NULL").select("source_id", *fields), exits
