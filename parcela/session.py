"""Session helpers and the few places where size decides the plan."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

# A side is broadcast only after it was seen to hold at most this many rows.
MAX_SMALL_ROWS = 20_000


def local_session(cores: int | str = 8, app: str = "parcela", memory: str = "8g", **conf: str) -> SparkSession:
    """Session for tests and the bench. On a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder the cluster names in spark.checkpoint.dir. Only
    a local session without that setting gets a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="parcela-")
    return _local_dirs[context.applicationId]


_scopes = threading.local()


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the copies that ``materialize`` makes inside, in this thread, at the
    end. For jobs whose result is written, not handed back as a plan."""
    stack = _scopes.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        yield
    finally:
        for path in stack.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, name: str = "part", lasting: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a result feeds several jobs. The copy survives lost executors,
    and its measured size lets Catalyst choose joins. A ``lasting`` copy outlives
    the scratch scope it is made in. Columns ``by`` become partition columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/parcela-{name}-{uuid.uuid4().hex}"
    if not lasting:
        for scope in _scopes.__dict__.get("stack", [])[-1:]:
            scope.append(path)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_or_stored(df: DataFrame, max_rows: int = MAX_SMALL_ROWS) -> DataFrame:
    """Return ``df`` ready to be joined to a large table.

    Up to ``max_rows`` rows come back as a broadcast local relation, so the
    large side is not shuffled. A bigger result is written to the shared folder
    and joined without a hint, where AQE handles size and skew.
    """
    return looked_at(df, max_rows)[0]


def looked_at(df: DataFrame, max_rows: int = MAX_SMALL_ROWS) -> tuple[DataFrame, pa.Table | None]:
    """``small_or_stored``, and the rows themselves if they are few."""
    head = df.limit(max_rows + 1).toArrow()
    if head.num_rows <= max_rows:
        return F.broadcast(df.sparkSession.createDataFrame(head, df.schema)), head
    return materialize(df, "side"), None


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of ``df`` (no job is run), None if not offered."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except AttributeError:
        return None


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few known rows as a local relation, whose size Catalyst sees."""
    names = [f.split()[0] for f in schema.split(",")]
    table = pa.table({n: [r[i] for r in rows] for i, n in enumerate(names)})
    return spark.createDataFrame(table).to(spark.createDataFrame([], schema).schema)


# Input estimate up to which spreading rows over the cores is cheap.
SPREAD_LIMIT_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """Share a small input among all cores before costly work per row.

    A table in one small file is read by one task. Larger inputs arrive in many
    partitions anyway and are left alone: shuffling them would cost more.
    """
    size = None if df.isStreaming else estimated_bytes(df)
    if size is None or size > SPREAD_LIMIT_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
