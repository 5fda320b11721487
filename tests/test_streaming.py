import datetime as dt

import pytest

from histograin.streaming import ingest as S


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=17 * i), i % 5, "ab"[i % 2]) for i in range(300)]
    root = str(tmp_path_factory.mktemp("events"))
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string").coalesce(1).write.parquet(f"{root}/events.parquet")
    return root, rows


def collect(spark, df, name, mode):
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).collect()


def test_windows_like_a_batch(spark, folder):
    root, rows = folder
    got = {(r.start.date(), r.event_type): r.n for r in collect(spark, S.windowed(S.event_stream(spark, root)), "daily", "complete")}
    expected = {}
    for _, ts, _, kind in rows:
        expected[ts.date(), kind] = expected.get((ts.date(), kind), 0) + 1
    assert got == expected
    sliding = collect(spark, S.windowed(S.event_stream(spark, root), "2 days", "1 day"), "sliding", "complete")
    assert sum(r.n for r in sliding) == 2 * len(rows)


def test_sessions_end_at_gaps(spark, folder):
    root, rows = folder
    got = collect(spark, S.sessions(S.event_stream(spark, root), "80 minutes"), "short", "append")
    assert got and {r.n for r in got} == {1}  # a user's events are 85 minutes apart


def test_deduplication_and_available_now(spark, folder, tmp_path):
    root, rows = folder
    own = S.deduplicated(S.event_stream(spark, root)).select("event_id")
    for _ in range(2):  # the second run has nothing new
        S.available_now(own, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(len(rows)))
