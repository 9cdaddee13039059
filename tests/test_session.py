"""Session helpers: the shared folder is read, never replaced; code ships once."""

from __future__ import annotations

from sqlgauge import session as S


def test_checkpoint_dir_is_kept(spark):
    before = spark.sparkContext.getCheckpointDir()
    assert before
    assert S.ensure_checkpoint_dir(spark) == before
    p = S.work_path(spark, "x", "y")
    assert p.startswith(before.rstrip("/")) and p.endswith("/x/y")
    assert S.work_path(spark, "x") != S.work_path(spark, "x")      # fresh folder per call


def test_ship_package_once(spark):
    S.ship_package(spark)
    S.ship_package(spark)
    assert getattr(spark.sparkContext, "_sqlgauge_shipped", False)


def test_a_cluster_without_a_shared_folder_is_refused():
    import pytest

    from sqlgauge import session as S

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        S.ensure_checkpoint_dir(Session())
    for master, local in (("local", True), ("local[4]", True), ("local-cluster[2,1,1024]", False), ("yarn", False)):
        assert S.is_local(master) == local
