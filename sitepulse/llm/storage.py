"""Shared folder for intermediate tables, read back by every executor."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's switch for removing the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the setting is absent (a local test session) a temporary folder is
    made once and set; on a cluster its absence is an error, because a
    machine-local folder would not be seen by other machines.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="sitepulse-shared-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_LOCK, _USERS = threading.Lock(), {}


@contextlib.contextmanager
def cleaning(spark: SparkSession):
    """Shuffle files go when a query ends.  The setting is the session's: the
    first of several writes at a time sets it, the last one puts it back."""
    key = id(spark._jsparkSession) if hasattr(spark, "_jsparkSession") else id(spark)
    with _LOCK:
        users, before = _USERS.get(key, (0, None))
        if not users:
            before = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        _USERS[key] = users + 1, before
    try:
        yield
    finally:
        with _LOCK:
            users, before = _USERS.pop(key)
            if users > 1:
                _USERS[key] = users - 1, before
            else:
                spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


class Scratch:
    """Tables of one operator run under the shared folder.

    ``table`` writes a DataFrame and reads it back: the lineage is cut at a
    file that outlives any executor, and a reader always sees one complete
    version, because the folder name is new for every run.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Writes ``df`` and reads it back; the write's shuffle files go as soon as it is done."""
        path = f"{self.path}/{name}"
        with cleaning(self.spark):
            df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *names: str) -> dict[str, str]:
    """name -> a column name of that kind which ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = {}
    for name in names:
        free = f"__{name}"
        while free.lower() in taken:
            free += "_"
        taken.add(free.lower())
        out[name] = free
    return out


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker process, for
    objects that are dear to build (vocabularies, automata)."""
    import sys
    import types

    return sys.modules.setdefault("_sitepulse_worker_cache", types.ModuleType("_sitepulse_worker_cache")).__dict__


def forget(cache: dict) -> None:
    """Lets the objects of earlier operators go before a worker builds those of the next."""
    for name in [n for n in cache if not n.startswith("__")]:
        del cache[name]
