"""Frames that wait share entries of the state, and come back whole; no stream runs here."""

import random

import numpy as np
import pandas as pd
import pytest
from trackloom.operators.rallies import START_STATE, rally_machine
from trackloom.settings import RallySettings
from trackloom.streaming import segments


class Store(dict):
    """A value or map of the state in memory, which counts its calls."""

    def __init__(self):
        super().__init__()
        self.calls, self.most = 0, 0

    def exists(self):
        return "value" in self

    def get(self):
        return self["value"]

    def update(self, value):
        self["value"] = value

    def getValue(self, key):
        self.calls += 1
        return self[key]

    def updateValue(self, key, value):
        self.calls, self[key] = self.calls + 1, value
        self.most = max(self.most, len(value[0]))

    def removeKey(self, key):
        self.calls += 1
        del self[key]


def run(triggers, watermarks):
    """Outputs of a shard over triggers of (source, frame, bits, ms) rows; a new processor each time, as after a restart."""
    value, waiting, timers, out = Store(), Store(), set(), []

    class Handle:
        getValueState = staticmethod(lambda *a: value)
        getMapState = staticmethod(lambda *a: waiting)
        registerTimer, deleteTimer = timers.add, timers.remove

    for rows, now in zip(triggers, watermarks):
        machine = segments.Segmenter(RallySettings(), 0, 0, 10 ** 12)
        machine.init(Handle)
        clock = type("Now", (), {"getCurrentWatermarkInMs": staticmethod(lambda: now)})
        pdf = pd.DataFrame(rows, columns=["source_id", "frame", "bits", "ts"]).assign(ts=lambda d: pd.to_datetime(d["ts"], unit="ms"))
        cut = len(pdf) // 2
        out += [tuple(r) for part in machine.handleInputRows((5,), iter([pdf[:cut], pdf[cut:]]), clock) for r in part.to_numpy().tolist()]
    return out, waiting


def bits_of(source, n):
    pick, bits = random.Random(source), []
    while len(bits) < n:
        bits += [pick.choice([1 | 128, 1 | 128, 2, 4, 16 | 2, 32, 64 | 1])] * pick.randint(1, 90)
    return bits[:n]


def test_many_sources_that_wait_cost_few_calls():
    """200 sources of 600 frames, every second one late: two blocks of 13 groups are written, read and removed once."""
    n, bits = 600, {s: bits_of(s, 600) for s in range(200)}
    out, waiting = run([[(s, f, bits[s][f], f * 33) for f in range(first, n, 2) for s in range(200)] for first in (1, 0)], [0, 0])
    assert waiting.calls <= 3 * 2 * -(-200 // segments.GROUP) and not waiting
    want = []
    for s in range(200):
        done, _ = rally_machine(RallySettings(), "spans")({"frame": np.arange(n), "bits": np.array(bits[s])}, START_STATE)
        want += [(s, max(0, a), b, c, "ended") for a, b, c in zip(done["start_frame"], done["end_frame"], done["at_frame"])]
    assert sorted(out) == sorted(want)


@pytest.mark.parametrize("held", [1 << 16, 900])
def test_long_sources_beside_short_ones_keep_their_frames(monkeypatch, held):
    """Frames of long and short sources in any order over four triggers, some twice and some lost, with little at hand at a time."""
    monkeypatch.setattr(segments, "HELD_ROWS", held)
    pick = random.Random(8)
    sizes = {s: pick.choice([30, 700, 4000]) for s in range(40)} | {2 ** 60 + 1: 2500}
    bits, lost, triggers = {s: bits_of(s, n) for s, n in sizes.items()}, {3: {5, 6}, 7: {0}}, [[], [], [], []]
    for s, n in sizes.items():
        for f in range(n):
            if f not in lost.get(s, ()):
                for _ in range(1 + (pick.random() < 0.05)):
                    triggers[pick.randrange(3)].append((s, f, bits[s][f], f * 33))
    for rows in triggers:
        pick.shuffle(rows)
    triggers[3] = [(s, -1, 0, 0) for s in sizes]  # tells nothing, but the watermark is past all frames
    out, waiting = run(triggers, [0, 0, 0, 10 ** 9])
    want = []
    for s, n in sizes.items():
        frames = [f for f in range(n) if f not in lost.get(s, ())]
        done, _ = rally_machine(RallySettings(), "spans")({"frame": np.array(frames), "bits": np.array([bits[s][f] for f in frames])}, START_STATE)
        want += [(s, max(0, a), b, c, "ended") for a, b, c in zip(done["start_frame"], done["end_frame"], done["at_frame"])]
        want += [(3, 5, 6, 7, "gap")] if s == 3 else [(7, 0, 0, 1, "gap")] if s == 7 else []
    assert sorted(out) == sorted(want) and not waiting
    assert waiting.most <= segments.GROUP * segments.BLOCK * segments.WIDTH.itemsize
