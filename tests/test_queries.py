"""Contract of the entry module, and oracles at the smallest scale.

Set BARLUME_ALL=1 to compare every query; by default a spread of them runs.
``python -m tests.oracle`` compares everything at sf0.01.
"""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import DATA, compare, connect

SOME = (
    "j01_resample_h1", "w02_ema", "w22_developing_state", "w24_short_horizon_context", "j03_asof_completed_h4", "j08_event_window", "j09_position_exits", "j13_fold_membership",
    "l08_l09_triple_barrier", "r03_emapullback", "r12_r14_ensemble_cooldown", "r19_hysteresis_side", "b02_exit_resolution", "b05_fifo_trades", "m03_purged_splits", "m12_session_thresholds",
    "e07_slice_metrics", "e18_tail_dependence", "e28_risk_allocation", "k02_circuit_breaker", "s03_csv_import", "t01_t02_stream_candles", "t07_stream_tick_quality",
)
NAMES = sorted(queries()) if os.environ.get("BARLUME_ALL") else SOME


@pytest.fixture(scope="module")
def con():
    return connect("0.001")


@pytest.mark.parametrize("name", NAMES)
def test_against_oracle(spark, con, name):
    df = queries()[name](spark, f"{DATA}/sf0.001")
    if name in oracle_sql():
        diff, _ = compare(df, con, oracle_sql()[name])
        assert diff is None, diff
    else:
        df.collect()


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries()) and len(queries()) > 200
