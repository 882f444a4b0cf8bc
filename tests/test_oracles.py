"""Registered queries against their SQL. A spread of queries by default; all of them with TEST_ALL=1."""

import os

import oracle
import pytest
from conftest import SF
from trackloom import plans

plans.load()
QUICK = ["clean_tracks", "smooth_tracks", "kinematics", "visibility_streaks", "project_to_court", "players_on_court", "foot_anchor_series",
         "segment_rallies", "segment_binary", "validate_corrections", "match_intervals", "frame_metrics", "threshold_sweep", "replay_active",
         "replay_violations", "audit_queue", "adaptive_queue", "frame_bursts", "rank_candidates", "recall_at_k", "tracklet_edges", "choose_slots",
         "assign_slots", "player_activity", "player_evidence", "decode_rallies_v2", "fill_pose_gaps", "build_sequences", "group_split",
         "read_tracks", "read_candidates", "read_label_events"]
NAMES = sorted(plans.ORACLES) if os.environ.get("TEST_ALL") else QUICK


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    problem = oracle.compare(spark, duck, plans.QUERIES[name](spark, SF), plans.ORACLES[name])
    assert problem is None, problem


# the same results must come out when sources are cut into many chunks
CHUNKED = ["visibility_streaks", "clean_tracks", "kinematics", "segment_binary", "player_activity", "choose_slots", "fill_pose_gaps", "eligible_runs",
           "shuttle_evidence", "decode_rallies_v2", "player_activity_guard"]


@pytest.mark.parametrize("name", CHUNKED)
def test_chunk_size_does_not_matter(spark, duck, small_chunks, name):
    problem = oracle.compare(spark, duck, plans.QUERIES[name](spark, SF), plans.ORACLES[name])
    assert problem is None, problem


def test_every_query_reads_the_tables():
    assert set(plans.ORACLES) <= set(plans.QUERIES)
    without = set(plans.QUERIES) - set(plans.ORACLES)
    assert without == {"fit_calibrations", "link_candidates", "decode_hypotheses", "track_handoff", "train_frame_classifier"}
