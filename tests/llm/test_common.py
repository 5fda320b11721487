import pyarrow as pa
import pytest

from histograin.llm.common import BATCH_ROWS, chunks, small_batches


@pytest.mark.parametrize("limit", [1, 7, 50, 10_000])
def test_chunks_keep_all_rows_in_order(limit):
    texts = ["x" * (i * 7 % 23) if i % 5 else None for i in range(200)]
    batches = [pa.RecordBatch.from_pydict({"text": texts[a : a + 30], "n": list(range(a, min(a + 30, 200)))}) for a in range(0, 200, 30)]
    out = list(chunks(iter([*batches, batches[0].slice(0, 0)]), limit=limit))
    assert [n for b in out for n in b.column("n").to_pylist()] == list(range(200))
    for b in out:
        assert b.num_rows == 1 or sum(len(t or "") for t in b.column("text").to_pylist()) <= limit
    assert len(out) <= 1 + 2 * sum(len(t or "") for t in texts) // limit or limit < 23


def test_small_batches_leave_other_settings(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        small_batches(spark)
        assert spark.conf.get(key) == str(BATCH_ROWS)
        spark.conf.set(key, "77")
        small_batches(spark)
        assert spark.conf.get(key) == "77"
    finally:
        spark.conf.set(key, was)
