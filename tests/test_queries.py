"""Registered queries against their SQL on the smallest data.

Set FULL=1 to run every query; the default takes a spread over all modules.
"""
import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
import check  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SPREAD = ("select_window hot_pixel_mask refractory_filter baf_filter staring_foreground rotation_foreground world_azimuth "
          "event_rate accumulate_frames polarity_divergence mti mask_sweep in_box_events composite_canvas stitch_clips "
          "target_rollup kpi_report ingest_event_words ingest_evt3_words strip_preroll coverage_spans flicker_map "
          "autocorrelation convergence label_blobs stream_event_rate stream_sessions user_metrics").split()
names = list(entry.oracle_sql()) if os.environ.get("FULL") else SPREAD


@pytest.fixture(scope="module")
def con():
    return check.duck(FOLDER)


@pytest.mark.parametrize("name", names)
def test_matches_sql(spark, con, name):
    ok, msg = check.compare(spark, con, FOLDER, name, entry.oracle_sql()[name])
    assert ok, msg


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
