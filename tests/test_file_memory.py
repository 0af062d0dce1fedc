"""What tasks hold in Python while files are made and written."""

import pyarrow as pa
import pytest

from cellweave.plans import fixtures
from cellweave.sources import datasource as D
from test_oracles import SF


@pytest.mark.parametrize("form", sorted(fixtures.ENCODERS))
def test_files_are_encoded_one_at_a_time(spark, form):
    """By groups, not by batches of arrays, which would turn the rows of all files of a batch into Python objects at once."""
    plan = fixtures.binary_docs(spark, SF, form)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInArrow" in plan
    assert "ArrowEvalPython" not in plan


def test_rows_of_a_file_in_order(spark):
    rows = spark.createDataFrame([(d, k, f"{k}") for d in (1, 2) for k in (3, 1, 2)], "doc_id long, k long, name string")
    got = fixtures.encoded(rows, lambda r: repr(r).encode()).collect()
    assert sorted((r.doc_id, bytes(r.content)) for r in got) == [(d, repr([(1, "1"), (2, "2"), (3, "3")]).encode()) for d in (1, 2)]


def test_batches_are_written_as_they_come(tmp_path):
    """A batch's files are there before the next batch is asked for; a value is written from the batch itself."""
    writer = D.FileWriter(str(tmp_path), None, False)

    def batches():
        for i in range(3):
            assert sum(p.is_file() for p in tmp_path.rglob("*")) == 2 * i
            yield pa.record_batch({"name": [f"x{i}", f"a{i}", f"b{i}"], "content": pa.array([b"x", b"abc", None], pa.binary())}).slice(1)

    writer.commit([writer.write(batches())])
    assert {p.name: p.read_bytes() for p in tmp_path.iterdir()} == {f"{c}{i}": b"abc" if c == "a" else b"" for c in "ab" for i in range(3)}
