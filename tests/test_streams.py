"""Streams over files that arrive in any order, with lost frames and silent ends."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest

import __spark_entry__  # noqa: F401  (loads all plans in their order)
from trackloom.operators.rallies import START_STATE, rally_machine
from trackloom.plans.streams import drained
from trackloom.settings import RallySettings
from trackloom.streaming import segments

SCHEMA = "source_id long, frame long, bits int, ts timestamp"


def evidence_bits(n, seed):
    """Long runs of equal evidence, so that intervals start and end."""
    rng, bits = random.Random(seed), []
    while len(bits) < n:
        bits += [rng.choice([1 | 128, 1 | 128, 2, 4, 16 | 2, 32, 64 | 1])] * rng.randint(1, 90)
    return bits[:n]


def at(frame):
    return datetime(2024, 1, 1) + timedelta(milliseconds=frame * 1000 // 30)


def replay(spark, folder, batches, name, **options):
    """One file per trigger, in the order of ``batches``."""
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    return [tuple(r) for r in drained(spark, segments.stream_segment(stream, **options), name).collect()]


def expected(rows, last):
    done, state = rally_machine(RallySettings(), "spans")(pd.DataFrame(rows, columns=["frame", "bits"]), START_STATE)
    out = {(max(0, s), e, a, "ended") for s, e, a in zip(done["start_frame"], done["end_frame"], done["at_frame"])}
    start = segments.open_start(state)
    return out | ({(max(0, start), last, last + 1, "open")} if start is not None else set())


@pytest.mark.parametrize("seed", [1, 5])
def test_segments_with_lost_frames_equal_the_machine_on_what_came(spark, tmp_path, seed):
    """Frames mixed over three files, some lost for good: gaps are told, and the machine goes on behind them."""
    rng, n = random.Random(seed), 3000
    lost = {1: {700, 701, 702, 1900}, 2: set(), 3: {0, 1, 2999}}
    batches, came = [[], [], []], {}
    for source in lost:
        bits = evidence_bits(n, 10 * seed + source)
        came[source] = [(f, bits[f]) for f in range(n) if f not in lost[source]]
        for f, b in came[source]:
            batches[rng.randrange(3)].append((source, f, b, at(f)))
    for b in batches:
        rng.shuffle(b)
    batches[1] += batches[0][:50]   # frames that come twice
    batches.append([(-1, 0, 0, at(10 ** 6))])
    rows = replay(spark, str(tmp_path / "in"), batches, f"lost{seed}", late="1 hour")
    gaps = {1: {(700, 702, 703, "gap"), (1900, 1900, 1901, "gap")}, 2: set(), 3: {(0, 1, 2, "gap")}}
    for source in lost:
        got = [r[1:] for r in rows if r[0] == source]
        assert len(got) == len(set(got))
        assert set(got) == gaps[source] | expected(came[source], came[source][-1][0]), source
    assert any(r[4] == "open" for r in rows) and any(r[4] == "ended" for r in rows)
    assert {r[0] for r in rows} <= {1, 2, 3}


def test_a_gap_holds_back_until_its_deadline_and_a_late_frame_closes_it(spark, tmp_path):
    bits = evidence_bits(2000, 3)
    row = lambda f: (1, f, bits[f], at(f))
    first, rest = [row(f) for f in range(2000) if f != 900], [row(900)]
    rows = replay(spark, str(tmp_path / "in"), [first, rest, [(-1, 0, 0, at(10 ** 6))]], "closed", late="1 hour")
    assert "gap" not in {r[4] for r in rows} and {r[1:] for r in rows} == expected(list(enumerate(bits)), 1999)
    # patience beyond the closing row: the gap stays open, nothing behind it is decided
    rows = replay(spark, str(tmp_path / "in2"), [first, [(-1, 0, 0, at(10 ** 6))]], "held", late="1 hour", patience_seconds=1e7, idle_seconds=1e8)
    assert {r[1:] for r in rows} == {s for s in expected(list(enumerate(bits[:900])), 899) if s[3] == "ended"}


@pytest.mark.parametrize("shards", [1, 3])
def test_sources_of_a_shard_keep_their_own_frames_gaps_and_ends(spark, tmp_path, shards):
    """Sources of different lengths and lost frames share keys of the state; one has no id, one id needs all 64 bits."""
    ids, n = {None: 700, 0: 1500, 2 ** 53 + 1: 900, 2 ** 53: 40, 7: 1100}, 0
    rng, batches, came = random.Random(shards), [[], [], []], {}
    for k, (source, n) in enumerate(ids.items()):
        bits = evidence_bits(n, 50 + k)
        came[source] = [(f, bits[f]) for f in range(n) if f != 300 + k]
        for f, b in came[source]:
            batches[rng.randrange(3)].append((source, f, b, at(f)))
    for b in batches:
        rng.shuffle(b)
    batches[2].append((7, None, 1, at(0)))
    rows = replay(spark, str(tmp_path / "in"), [*batches, [(-1, 0, 0, at(10 ** 6))]], f"shards{shards}", late="1 hour", shards=shards)
    for k, (source, n) in enumerate(ids.items()):
        gap = {(300 + k, 300 + k, 301 + k, "gap")} if n > 300 + k else set()
        got = [r[1:] for r in rows if r[0] == source]
        assert len(got) == len(set(got)) and set(got) == gap | expected(came[source], came[source][-1][0]), source
    assert {r[0] for r in rows} <= set(ids)


class Kept(dict):
    """A value or map of the state in memory, with the number of its calls."""
    calls, value = 0, None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value


def test_a_trigger_calls_the_state_once_per_shard_and_keeps_one_timer():
    """200 sources of a shard, none with a frame that waits: one update of the value, one timer, one frame of rows."""
    timers, value = set(), Kept()

    class Handle:
        getValueState = staticmethod(lambda *a: value)
        getMapState = staticmethod(lambda *a: Kept())
        registerTimer, deleteTimer = timers.add, timers.remove

    class Now:
        getCurrentWatermarkInMs = staticmethod(lambda: 0)

    machine = segments.Segmenter(RallySettings(), 0, 0, 60000)
    machine.init(Handle)
    bits = evidence_bits(600, 4)
    rows = pd.DataFrame([(s, f, bits[f], pd.Timestamp(at(f + s))) for f in range(600) for s in range(200)], columns=["source_id", "frame", "bits", "ts"])
    out = list(machine.handleInputRows((5,), iter([rows[:50000], rows[50000:]]), Now))
    ended = {r for r in expected(list(enumerate(bits)), 599) if r[3] == "ended"}
    assert value.calls == 1 and len(timers) == 1 and 1 <= len(out) <= 2
    assert sorted(map(tuple, pd.concat(out).to_numpy().tolist())) == sorted((s, *r) for s in range(200) for r in ended)
