"""Run logs with losses of zero, against their SQL twins."""

from __future__ import annotations

import datetime

import pytest
from oracle_check import compare

import __spark_entry__ as driver

# user, day, event type, value; a day whose losses are at most zero has no finite ratio.
LOSSES = [
    (1, 1, "view", 0.5), (1, 1, "purchase", 1.0), (1, 2, "view", 0.0), (1, 3, "purchase", 2.0),
    (2, 1, "view", 0.0), (2, 1, "purchase", 0.0), (2, 2, "purchase", 3.0),
    (3, 1, "view", -1.0), (3, 1, "purchase", 0.0), (3, 2, "view", 1.0), (3, 3, "view", 0.0),
    (3, 4, "view", 1.0), (3, 5, "view", 0.0), (3, 6, "purchase", 4.0),
    (4, 1, "purchase", 0.0), (4, 2, "purchase", 5.0), (4, 2, "view", 0.0),
    (5, 1, "view", None), (5, 2, "view", 1.0), (5, 3, "view", None),
]


@pytest.fixture
def zero_losses(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1, 12)
    rows = [
        (n, start + datetime.timedelta(days=day), user, kind, value)
        for n, (user, day, kind, value) in enumerate(LOSSES)
    ]
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def _same(spark, folder, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
    same, n, _, _, _, detail, _ = compare(spark, con, folder, name, driver.queries()[name], driver.oracle_sql()[name])
    assert same, detail
    assert n == 5


def test_best_checkpoint_with_losses_of_zero(spark, zero_losses):
    _same(spark, zero_losses, "best_checkpoint")


def test_early_stop_epoch_with_losses_of_zero(spark, zero_losses):
    _same(spark, zero_losses, "early_stop_epoch")
