import os
import zipfile

import pytest
from pyspark.sql import functions as F

from skein import session


def test_small_scans_are_spread_and_shuffles_left_alone(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/Exchange")  # a name that isn't a plan node
    df = spark.read.parquet(f"{tmp_path}/Exchange")
    assert session.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = df.repartition(2, "id")
    assert session.spread(many) is many


def test_cut_and_written_keep_rows_in_the_shared_folder(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    for kept in (session.cut(df), session.written(df), session.written(df, ["id"])):
        assert sorted(r.x for r in kept.collect()) == [2 * i for i in range(10)]
    assert session.shared_dir(spark).removeprefix("file://") in session.written(df).inputFiles()[0]


def test_package_is_shipped_once(monkeypatch):
    sent = []

    class Context:
        applicationId = "app"
        addPyFile = staticmethod(sent.append)

    class Session:
        sparkContext = Context

    monkeypatch.setenv("PYTHONPATH", "")
    monkeypatch.setattr(session, "_shipped", set())
    session.ship(Session)
    session.ship(Session)
    assert len(sent) == 1 and "skein/operators/fold.pyc" in zipfile.ZipFile(sent[0]).namelist() and os.path.basename(sent[0]) == "skein.zip"


def test_no_temporary_folder_off_local_masters():
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        Session.sparkContext.master = master
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.shared_dir(Session)
