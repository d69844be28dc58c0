import pytest

from attestor.session import Scratch, scratch_dir, spread


def test_scratch_tables(spark):
    s = Scratch(spark, "t")
    a = s.save(spark.range(10).selectExpr("id", "cast(null as string) as x"))
    assert a.count() == 10 and s.bytes(a) > 0 and a.columns == ["id", "x"]
    s.drop(a)
    with pytest.raises(Exception):
        spark.read.parquet(a._attestor_path).count()
    assert s.root.startswith(scratch_dir(spark)) and scratch_dir(spark) == scratch_dir(spark)


def test_spread(spark):
    one = spark.range(0, 100, 1, 1)
    assert spread(one).rdd.getNumPartitions() == 4 and spread(spark.range(0, 100, 1, 9)).rdd.getNumPartitions() == 9
    assert spread(one.groupBy("id").count()).count() == 100


def test_scratch_is_cleaned(spark):
    from pathlib import Path

    from attestor.session import Scratch, clean_scratch

    scratch = Scratch(spark, "cleaned")
    table = scratch.save(spark.range(3).toDF("id"))
    folder = Path(scratch.root.removeprefix("file:"))
    assert table.count() == 3 and folder.is_dir()
    assert clean_scratch(spark) >= 1 and not folder.exists() and clean_scratch(spark) == 0
