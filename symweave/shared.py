"""Written tables in the folder that all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import functools
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_scopes = threading.local()


def shared_root(spark: SparkSession) -> str:
    """The folder every executor sees, as spark.checkpoint.dir names it.

    Where the setting is missing, as in tests, a local master gets a temporary folder and
    any other master is refused: a machine-local folder would lose data on a cluster.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="symweave-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_root(spark)}/symweave/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, file_rows: int = 0) -> DataFrame:
    """The rows of df as a written table, which is read by column; in files of file_rows rows at most, if given."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    schema = df.schema
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    if getattr(_scopes, "open", None):
        _scopes.open[-1].append((spark, path))
    return spark.read.schema(schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _roots(df: DataFrame) -> set[str] | None:
    """The folders that df reads, as they were given and not file by file; None if that cannot be told, as of something persisted."""
    leaves, out = df._jdf.queryExecution().optimizedPlan().collectLeaves(), set()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        kind = leaf.getClass().getSimpleName()
        if kind == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            paths = leaf.relation().location().rootPaths()
            out |= {paths.apply(k).toString() for k in range(paths.size())}
        elif kind not in ("LocalRelation", "LogicalRDD", "Range", "OneRowRelation"):
            return None
    return out


def tidy[**P, R](f: Callable[P, R]) -> Callable[P, R]:
    """f, after which the tables that it wrote are deleted, but for those that its result reads.

    The result may be a DataFrame, a tuple or list of some, or nothing that reads. What stays counts as
    written by whichever such function called this one.
    """

    @functools.wraps(f)
    def run(*args: P.args, **kwargs: P.kwargs) -> R:
        open_ = _scopes.open = getattr(_scopes, "open", None) or []
        open_.append([])
        out = None
        try:
            out = f(*args, **kwargs)
            return out
        finally:
            made = open_.pop()
            roots = [_roots(x) for x in (out if isinstance(out, tuple | list) else [out]) if isinstance(x, DataFrame)] if made else []
            read = {r.rstrip("/").rsplit("/", 1)[-1] for r in set().union(*(x or () for x in roots))}
            for spark, path in made:
                if None not in roots and path.rsplit("/", 1)[-1] not in read:
                    _delete(spark, path)
                elif open_:
                    open_[-1].append((spark, path))

    return run


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by written(), once nothing reads it any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, path)
