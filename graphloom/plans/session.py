"""Session settings and the shared work folder used to cut lineage.

Intermediate results of multi-step operators are written as Parquet tables below the folder that
``spark.checkpoint.dir`` names, so they survive the loss of an executor. Only a session whose master is local
(tests, a laptop) may do without the setting; it gets a local folder. :func:`clear` deletes the tables of
queries whose results are no longer needed; what is left goes when the application ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: Folders of workspaces that are not deleted yet, by application.
_OPEN: dict[str, list[str]] = {}
#: Names under which bucketed tables stand in the catalogue of the session, by application.
_TABLES: dict[str, list[str]] = {}


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("graphloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only on a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
    key = spark.sparkContext.applicationId
    if key not in _LOCAL:
        _LOCAL[key] = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(_forget, _LOCAL[key])
    return _LOCAL[key]


def _forget(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Delete the tables of all workspaces so far. DataFrames that operators returned earlier cannot be read
    any more, so call it once their rows are written or collected."""
    for name in _TABLES.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    for root in _OPEN.pop(spark.sparkContext.applicationId, []):
        _delete(spark, root)


def _clear_at_end(spark: SparkSession) -> None:
    try:
        clear(spark)
    except Exception:  # the session has gone already; a local folder is deleted anyway
        pass


class Workspace:
    """Tables an operator writes to cut its lineage.

    ``cut(df)`` runs the plan once, writes it and reads it back; ``drop(df)`` deletes a table that no later
    step needs. What the final result still reads stays until :func:`clear` or the end of the application.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        key = spark.sparkContext.applicationId
        if key not in _OPEN:
            _OPEN[key] = []
            atexit.register(_clear_at_end, spark)
        _OPEN[key].append(self.root)
        self._n = 0
        self._paths: dict[int, tuple[DataFrame, str]] = {}  # the frame is held, so that its number is not given anew

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self._n}"
        self._n += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = out, path
        return out

    def cut_by(self, df: DataFrame, key: str, buckets: int) -> DataFrame:
        """Like :meth:`cut`, in buckets of a key: joins and aggregations by that key over as many partitions read
        the table as it lies, without a shuffle."""
        path, name = f"{self.root}/{self._n}", f"graphloom_{uuid.uuid4().hex}"
        self._n += 1
        df.write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
        out = self.spark.table(name)
        self._paths[id(out)] = out, path
        _TABLES.setdefault(self.spark.sparkContext.applicationId, []).append(name)
        return out

    def drop(self, df: DataFrame) -> None:
        _, path = self._paths.pop(id(df), (None, None))
        if path:
            _delete(self.spark, path)
