"""op3_mixing integrates its schedule: every taken document has its training positions."""

import pytest

pytest.importorskip("wayloom.llm")
from wayloom.llm import mixing


def test_positions(spark, tmp_path):
    frame = spark.createDataFrame([(i, "a b c", "s%d" % (i % 3)) for i in range(90)], "doc_id long, text string, source string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op3_mixing(spark, str(tmp_path)).collect()
    assert len(got) == 90 and all((r["taken"] > 0) == bool(r["positions"]) for r in got)
