"""Session helpers shared by all operators: column picking, lineage cuts, bounded broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FOLDERS: list[tuple[SparkSession, str]] = []


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Select ``new_name="existing"`` columns by position.

    An exact match of the name wins over a match that differs in case, so tables with extra columns whose
    names clash with the wanted ones (also in case only) are read without ambiguity.
    """
    names = df.columns
    flat = df.toDF(*[f"_in{i}" for i in range(len(names))])
    out = []
    for new, old in columns.items():
        hits = [i for i, n in enumerate(names) if n == old] or [i for i, n in enumerate(names) if n.lower() == old.lower()]
        if not hits:
            raise ValueError(f"column {old!r} not found; the table has {', '.join(names)}")
        out.append(F.col(f"_in{hits[0]}").alias(new))
    return flat.select(*out)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir, or a temporary one for a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="timberline-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def close_workspaces() -> None:
    """Delete the tables of all workspaces so far, once their results are written; results not yet computed
    that read them can't be computed any more. Happens at exit by itself."""
    while _FOLDERS:
        spark, path = _FOLDERS.pop()
        try:
            drop_path(spark, path)
        except Exception:  # the session may be gone already
            pass


atexit.register(close_workspaces)


class Workspace:
    """Intermediate tables of one run of an iterative operator, written as Parquet to the shared folder.

    Writing a table and reading it back cuts the lineage with copies that survive the loss of executors.
    ``put(name, df)`` writes a version and deletes the one before, ``drop(name)`` deletes all; what remains
    goes with ``close_workspaces`` or at exit.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/timberline-{label}-{uuid.uuid4().hex[:12]}"
        self.versions: dict[str, list[str]] = {}
        _FOLDERS.append((spark, self.root))

    def put(self, name: str, df: DataFrame) -> DataFrame:
        old = self.versions.get(name, [])
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:6]}"
        df.write.parquet(path)
        for p in old:
            drop_path(self.spark, p)
        self.versions[name] = [path]
        return self.spark.read.schema(df.schema).parquet(path)

    def child(self, label: str) -> Workspace:
        """A workspace inside this one, whose names don't meet those of others."""
        inner = object.__new__(Workspace)
        inner.spark, inner.root, inner.versions = self.spark, f"{self.root}/{label}-{uuid.uuid4().hex[:6]}", {}
        return inner

    def drop(self, *names: str) -> None:
        for name in names:
            for p in self.versions.pop(name, []):
                drop_path(self.spark, p)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Partitioned by the keys into as many parts as shuffles have, also where the rows are few: for groups
    that cost much more than their rows weigh, which adaptive coalescing would put into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark ``df`` for a broadcast only when a count proves that it has at most ``max_rows`` rows."""
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df
