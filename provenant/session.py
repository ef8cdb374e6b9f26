"""Session construction and lineage cutting.

Iterative operators never keep intermediate state on one executor: they write
it as Parquet below the folder that the cluster names in
``spark.checkpoint.dir`` and read it back, so a lost executor costs a re-read.
"""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "provenant", master: str | None = None, **conf: str) -> SparkSession:
    """Session in UTC with adaptive execution; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (_LOCAL_DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder.

    Only a local master, whose tasks all see this machine's disk, may go without
    the setting: it gets a temporary folder.  Elsewhere that would lose results
    silently, so it is an error.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="provenant-checkpoint-")
        context.setCheckpointDir(configured)
        configured = context.getCheckpointDir()
    return configured.rstrip("/")


#: Set while a table is written.  Its shuffle files go when the write ends; Arrow batches for Python are bounded by
#: bytes, not only by rows, so a batch of very long texts stays small.
_WHILE_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}
#: Paths that :func:`materialize` has written and nothing has deleted, in order.
_WRITTEN: dict[str, SparkSession] = {}


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here.

    Nothing reads the write's shuffle files again, so they go with it instead
    of staying until the driver collects garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in _WHILE_WRITING}
    for k, v in _WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._materialized_path = path
    _WRITTEN[path] = spark
    return out


def _delete(path: str) -> None:
    spark = _WRITTEN.pop(path, None)
    if spark is None:
        return
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(*tables: DataFrame | None) -> None:
    """Delete what :func:`materialize` wrote once nothing reads it any more."""
    for df in tables:
        if (path := getattr(df, "_materialized_path", None)) is not None:
            _delete(path)


def read_by(df: DataFrame) -> set[str]:
    """Names of the folders of files that ``df`` reads, in scalar subqueries too."""
    plan, names = df._jdf.queryExecution().optimizedPlan(), set()
    inner = plan.subqueriesAll()
    for p in [plan, *[inner.apply(i) for i in range(inner.size())]]:
        leaves = p.collectLeaves()
        for leaf in [leaves.apply(i) for i in range(leaves.size())]:
            if leaf.nodeName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
                roots = leaf.relation().location().rootPaths()
                names |= {roots.apply(i).getName() for i in range(roots.size())}
    return names


def tidy(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``fn``, after which only those of the tables it wrote are left that its result reads."""

    @functools.wraps(fn)
    def run(*args, **kwargs) -> DataFrame:
        before = set(_WRITTEN)
        df = fn(*args, **kwargs)
        used = read_by(df)
        for path in [p for p in _WRITTEN if p not in before and p.rsplit("/", 1)[1] not in used]:
            _delete(path)
        return df

    return run


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside the block are deleted when it ends, but for those passed to the function that it yields."""
    before, kept = set(_WRITTEN), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._materialized_path)
        return df

    try:
        yield keep
    finally:
        for path in [p for p in _WRITTEN if p not in before and p not in kept]:
            _delete(path)
