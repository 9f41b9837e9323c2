import pytest

from graphloom.plans import session


class _Elsewhere:
    """A session on a cluster that names no shared folder."""

    class conf:
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:
        master, applicationId = "spark://host:7077", "app"


def test_no_local_folder_off_a_local_master():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.work_dir(_Elsewhere)


def test_tables_are_deleted(spark):
    from pathlib import Path

    ws = session.Workspace(spark, "t")
    a, b = ws.cut(spark.range(3)), ws.cut(spark.range(4))
    ws.drop(a)
    ws.drop(a.select("id"))  # not a table of its own
    assert not Path(ws.root, "0").exists() and b.count() == 4
    session.clear(spark)
    assert not Path(ws.root).exists()
