"""Registered queries against their SQL on the smallest tables. WAYSIDE_ALL=1 checks every query."""

import os

import pytest
from check import connect, difference

import __spark_entry__ as entry

FOLDER = f"/root/testdata/sf{os.environ.get('WAYSIDE_SF', '0.001')}"
SAMPLE = """native_ts_roundtrip gap_segments segment_features excess_features first_transition turning_points lead10_delta
iou_f1 macro_f1 threshold_sweep nested_blocks fold_audit acv_melt car_features rank_cars scorer_borda nested_loo_weights
side_aggregates paired_channels welch_small spectral_cosine temporal_bands rainflow_cycles damage_sum weighted_median
contract_violations latest_results selected_export trace_downsample ridge_2feature stream_gap_segments
stream_rainflow_residue""".split()
NAMES = sorted(entry.oracle_sql()) if os.environ.get("WAYSIDE_ALL") else SAMPLE


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    assert difference(spark, duck, FOLDER, entry.queries()[name], entry.oracle_sql()[name]) is None


def test_catalogue_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_runs(spark):
    result = entry.entry(spark)
    assert result.columns == ["stream_id", "start_time", "end_time", "prediction"]
    assert set(r.prediction for r in result.select("prediction").distinct().collect()) <= {"Normal", "Abnormal resistance"}
