import os

import pytest
from pyspark.sql import functions as F

from lattica.sources import records, runs


def below(folder, what):
    return [os.path.join(d, x) for d, names, _ in os.walk(folder) for x in names if x.startswith(what)]


def build(run, spark, fail=None):
    """Three stages, of which the middle one has parts and uses scratch tables."""

    def slow(rows):
        part = records.written(rows, records.scratch(spark))
        if fail is not None and fail == len([x for x in run.computed if x.startswith("slow")]):
            raise RuntimeError("killed")
        return part.withColumn("y", F.col("id") * 2)

    run.stage("rows", lambda: spark.range(100), n=100)
    run.parted("slow", slow, "rows", "id", 4)
    return run.stage("sum", lambda *parts: sum_of(parts), *(f"slow/part={i}" for i in range(4)))


def sum_of(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.agg(F.count("*").alias("n"), F.sum("y").alias("s"))


def test_a_killed_run_goes_on(spark, tmp_path):
    whole = runs.Run(spark, f"file://{tmp_path}/whole")
    want = build(whole, spark).collect()
    assert tuple(want[0]) == (100, 9900) and len(whole.computed) == 6
    first = runs.Run(spark, f"file://{tmp_path}/run")
    with pytest.raises(RuntimeError):
        build(first, spark, fail=2)
    assert first.computed == ["rows", "slow/part=0", "slow/part=1"]
    second = runs.Run(spark, f"file://{tmp_path}/run")
    assert build(second, spark).collect() == want
    assert second.reused == first.computed and second.computed == ["slow/part=2", "slow/part=3", "sum"]
    assert not below(tmp_path, "lattica-") and not os.listdir(f"{tmp_path}/run/_aside")
    assert spark.conf.get(records.SCRATCH_SETTING, None) is None
    listed = {r.name: r for r in second.manifest().collect()}
    assert len(listed) == 6 and listed["rows"].n_rows == 100 and listed["sum"].inputs == [f"slow/part={i}" for i in range(4)]


def test_settings_and_inputs_tell_stages_apart(spark, tmp_path):
    run = runs.Run(spark, f"file://{tmp_path}")
    assert [run.stage("rows", lambda n=n: spark.range(n), n=n).count() for n in (3, 4, 3)] == [3, 4, 3]
    assert run.computed == ["rows", "rows"] and run.reused == ["rows"]
    run.stage("next", lambda t: t, "rows")
    run.stage("rows", lambda: spark.range(4), n=4)
    run.stage("next", lambda t: t, "rows")
    assert run.computed.count("next") == 2
    os.makedirs(tmp_path / "_aside" / "left" / "scratch")
    run.clean()
    assert not (tmp_path / "_aside").exists()


def test_other_errors_of_reading_are_raised(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)scheme|filesystem"):
        records.computed_or_read(spark, "nothing://x/y", lambda: spark.range(1))
    assert records.computed_or_read(spark, str(tmp_path / "t"), lambda: spark.range(1)).count() == 1
