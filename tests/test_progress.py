"""Lines about a running job, and counters without a pass of their own."""

import time

import pytest
from pyspark.sql import functions as F

from verdance.progress import Counted, watched


def test_lines_while_a_job_of_several_tasks_runs(spark):
    lines = []

    def slow(batches):
        for b in batches:
            time.sleep(1)
            yield b

    with watched(spark, "step", every=0.3, say=lines.append):
        spark.range(0, 12, 1, 12).mapInArrow(slow, "id long").write.format("noop").mode("overwrite").save()
    assert lines[0] == "step: begins" and lines[-1].startswith("step: done after")
    assert any("of 12 tasks, 0 failed" in x for x in lines)


def test_the_last_line_of_a_failed_block_says_so(spark):
    lines = []
    with pytest.raises(KeyError), watched(spark, "step", say=lines.append):
        raise KeyError("x")
    assert lines[-1].startswith("step: failed after")


@pytest.mark.parametrize("n", [0, 1000])
def test_counters_of_the_pass_that_writes(spark, tmp_path, n):
    met = Counted()
    met.of(spark.range(0, n, 1, 7), rows=F.count(F.lit(1)), even=F.count_if(F.col("id") % 2 == 0), total=F.sum("id")).where("id > 900").write.parquet(str(tmp_path / "t"))
    assert (met["rows"], met["even"], met["total"]) == (n, n // 2, n * (n - 1) // 2)
