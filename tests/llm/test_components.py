import pyarrow as pa
import pytest

from tokenloom.llm import components


def batches():
    return [pa.RecordBatch.from_pydict({"k": [1] * n, "t": [f"{n}-{i}" for i in range(n)], "b": [bytes([i]) for i in range(n)]}) for n in (2, 1, 3)]


@pytest.mark.parametrize("most", [None, 1, 2, 4])
def test_no_row_of_a_group_is_lost(most):
    """Groups that do not combine into one batch (text of over 2 GB; here a lowered limit) keep all rows."""
    got = components.whole(batches(), most)
    assert got.num_rows == 6
    assert got.column("t").to_pylist() == [x for b in batches() for x in b.column("t").to_pylist()]
    assert got.column("b").to_pylist() == [x for b in batches() for x in b.column("b").to_pylist()]
    back = components.plain(got)
    assert back.schema == batches()[0].schema and back.to_pylist() == got.to_pylist()


def test_map_groups_hands_over_whole_groups(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("id % 7 AS k", "cast(id AS string) AS t")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = components.map_groups(rows, ["k"], lambda b: pa.RecordBatch.from_pydict({"k": [b.column(0)[0].as_py()], "n": [b.num_rows], "d": [len(set(b.column(1).to_pylist()))]}), "k long, n long, d long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got) == [(k, (3000 - k + 6) // 7, (3000 - k + 6) // 7) for k in range(7)]
