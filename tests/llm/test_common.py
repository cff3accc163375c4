from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from termforge import shared
from termforge.llm.common import Scratch, remove, spread_join


def test_a_hot_key_joins_like_any_other(spark):
    work = Scratch(spark)
    many = work.write(spark.range(2000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("key"), F.col("id").alias("x")), "many")
    one = spark.range(1500).select(F.col("id").alias("key"), (F.col("id") * 2).alias("y"))
    joined = spread_join(many, one, "key")
    plain = many.join(one, "key")
    assert sorted(joined.columns) == ["key", "x", "y"]
    assert Counter((r["key"], r["x"], r["y"]) for r in joined.collect()) == Counter((r["key"], r["x"], r["y"]) for r in plain.collect())
    assert spread_join(work.write(many.limit(0), "none"), one, "key").count() == 0
    path = work.paths["many"]
    work.clear()
    assert not work.paths
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    remove(spark, path)  # what is gone already is no error


def test_a_cluster_must_name_its_shared_folder():
    def session(master):
        conf = SimpleNamespace(get=lambda *_: None)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(session("spark://host:7077"), "x")
    assert shared.shared_dir(session("local[4]"), "x").startswith("file:///")
