"""Label keys dealt to shards of the state; rows are built here."""

import json

import pandas as pd

from trackloom.streaming import labels


class Kept:
    exists = False

    def update(self, value):
        self.exists, self.get = True, value


def test_a_shard_of_many_keys_replays_each_chain():
    """One call serves all keys of a shard; a revision waits until its parent has come, also over triggers."""
    big = 2 ** 53 + 1
    key = lambda s: json.dumps({"task": "t", "source_id": s, "frame": 0})
    rows = [(key(1), 11, "undo", "10"), (key(2), 20, "selected", None), (key(1), 10, "selected", None), (key(big), big + 2, "unsure", str(big)), (key(1), 12, "unsure", "11")]
    frame = lambda r: pd.DataFrame(r, columns=["label_key", "revision_id", "label_kind", "superseded_revision"])
    state = Kept()
    out = pd.concat(labels.advance_labels((0,), iter([frame(rows[:2]), frame(rows[2:])]), state))
    got = [tuple(None if pd.isna(v) else v for v in r) for r in out.itertuples(index=False)]
    assert sorted(got, key=lambda r: r[3]) == [("t", 1, 0, 10, 10, "selected", 10, "selected"), ("t", 1, 0, 11, 11, "undo", None, None), ("t", 1, 0, 12, 12, "unsure", 12, "unsure"),
                                             ("t", 2, 0, 20, 20, "selected", 20, "selected")]
    late = pd.concat(labels.advance_labels((0,), iter([frame([(key(big), big, "selected", None), rows[1]])]), state))
    assert [(r.source_id, r.revision_id) for r in late.itertuples()] == [(big, big), (big, big + 2)]
