"""The stateless stages give the same rows on a stream as in batch."""

import tempfile

from studyframe.spec import ColumnSpec, TaskSpec
from studyframe.streaming import stateless

SPECS = (
    ColumnSpec(name="diag", kind="categorical"),
    ColumnSpec(name="diag2", kind="categorical"),
    ColumnSpec(name="call", kind="datetime"),
    ColumnSpec(name="tia", kind="match", derive_from=("diag", "diag2"), match_by=("G45",)),
    ColumnSpec(name="call_hour", kind="datetime", derive_from=("call",), datetime_units="hour"),
)
TASK = TaskSpec(name="tia", target_column="tia", positive_class=True, inclusion_criteria={"tia": "non-NaN"})


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.csv").write_text("diag,diag2,call\nG45.1,G45,2024-01-01 10:00:00\nG45,I63,01.02.2024 11:30\nI64,G45,x\n")
    sink, ckpt = str(tmp_path / "out"), tempfile.mkdtemp(dir=str(tmp_path))
    q = stateless.start(spark, str(src), sink, ckpt, SPECS, TASK)
    q.awaitTermination(120)
    got = spark.read.parquet(sink).select("diag", "tia", "call_hour", "included_in_cohort").collect()
    batch_in = spark.read.option("header", True).csv(str(src))
    want = stateless.clean_rows(batch_in, SPECS, TASK).select("diag", "tia", "call_hour", "included_in_cohort").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)
