"""Session settings and the shared scratch space."""

from __future__ import annotations

import mmap
import pickle
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes a table may take in memory and still be broadcast.
BROADCAST_BYTES = 32 << 20
# Arrays of fewer bytes go with the function that uses them.
LEAST_MAPPED = 1 << 16
_MARK = b"mailscreen-array"


def build_session(app: str = "mailscreen", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are written for; `conf` wins."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by `spark.checkpoint.dir`.

    Where a session names none, a local one gets a temporary folder and a cluster a folder
    under the warehouse; a cluster whose warehouse is on a local disk is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            folder = current.get()
        elif context.master.startswith("local[") or context.master == "local":
            folder = tempfile.mkdtemp(prefix="mailscreen-")
        else:
            folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
            if folder.startswith(("file:", "/")):
                raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A new path in the shared folder, dropped by Hadoop when the session's JVM ends."""
    target = f"{shared_folder(spark)}/mailscreen/{purpose}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
    return target


def settle(df: DataFrame) -> DataFrame:
    """Checkpoint a summary table so that later steps re-read it instead of recomputing it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write `df` as parquet in the shared folder and read it back.

    Used before a table is scanned several times: unlike a cache it survives lost
    executors and keeps column pruning and filter pushdown.
    """
    path = scratch_path(df.sparkSession, purpose)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` plus columns that are evaluated once per row.

    Catalyst copies the expression of a plain projected column into every filter it
    pushes below it, so an expensive one is run again for each mention.  A generator's
    output is not taken apart, hence the one-element `inline`.
    """
    packed = F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))
    return df.select("*", F.inline(packed))


def parallelism(spark: SparkSession) -> int:
    """Tasks for steps that blow up their input and must not be merged into fewer (AQE)."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal out a table that comes in fewer pieces than there are cores.

    Large tables come in many pieces and pass unchanged, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def plain_unions(spark: SparkSession) -> None:
    """Treat a union as unpartitioned.

    Spark 4.1 lets a union keep the partitioning its inputs share; under adaptive
    execution an input can change after that was relied on, and the job then fails with
    "Can't zip RDDs with unequal numbers of partitions".
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs started in here send `rows` rows at once to Python; for rows of many bytes, of which thousands would fill the memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Shared:
    """A value that tasks need, sent out once; `value` is it again, in a task or here.

    Its large arrays (NumPy, Arrow) are broadcast one by one and read where they lie on the
    executor's disk: all Python workers of an executor share the pages, where the value of
    a plain broadcast is a copy of its own in each.  They cannot be written to.
    """

    def __init__(self, spark: SparkSession, value: object) -> None:
        context, apart = spark.sparkContext, []

        def small(buffer: pickle.PickleBuffer) -> bool:
            if buffer.raw().nbytes < LEAST_MAPPED:
                return True
            apart.append(context.broadcast(_framed(buffer.raw())))
            return False

        self._head = pickle.dumps(value, protocol=5, buffer_callback=small)
        self._apart: list[Broadcast] = apart

    @property
    def value(self) -> object:
        if not hasattr(self, "_value"):
            self._value = pickle.loads(self._head, buffers=[_mapped(b) for b in self._apart])
        return self._value

    def __getstate__(self) -> dict:
        return {"_head": self._head, "_apart": self._apart}

    def destroy(self) -> None:
        """Drop it everywhere; nothing may use it any more."""
        for broadcast in self._apart:
            broadcast.destroy()


def _framed(raw: memoryview) -> bytes:
    """The bytes behind a mark, and where they start and how many they are; so laid out that in the broadcast's file they start at a multiple of 64."""
    head = len(_MARK) + 16
    before = pickle.dumps(_MARK + bytes(LEAST_MAPPED), protocol=pickle.HIGHEST_PROTOCOL).index(_MARK) + head
    start = head + -before % 64
    return b"".join((_MARK, start.to_bytes(8, "little"), raw.nbytes.to_bytes(8, "little"), bytes(start - head), raw))


def _mapped(broadcast: Broadcast) -> memoryview:
    """What `_framed` was given, mapped from the broadcast's file where that lies open."""
    path = getattr(broadcast, "_path", None)
    if path is not None:
        with open(path, "rb") as file:
            at = file.read(64).find(_MARK)
            if at >= 0:
                return _unframed(memoryview(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))[at:])
    return _unframed(memoryview(broadcast.value))


def _unframed(told: memoryview) -> memoryview:
    start, size = (int.from_bytes(told[at : at + 8], "little") for at in (len(_MARK), len(_MARK) + 8))
    return told[start : start + size]


def join_summary(big: DataFrame, summary: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join a large table with a summary of it.

    The summary is written and measured.  Up to BROADCAST_BYTES it is broadcast, so the
    large side does not move at all; beyond that the join is left to Spark, which shuffles
    both sides and splits skewed partitions (AQE).
    """
    return big.join(sized(written(summary, "summary")), on, how)


def sized(df: DataFrame) -> DataFrame:
    """`df` with a broadcast hint if it is small enough.  It is scanned for that, so hand over a stored table."""
    return F.broadcast(df) if memory_bytes(df) <= BROADCAST_BYTES else df


def memory_bytes(df: DataFrame) -> int:
    """About what the rows take in a hash table: 40 bytes a row, 16 a column, and all text."""
    text = [F.octet_length(F.col(c).cast("string")) for c, kind in df.dtypes if kind.startswith(("string", "array", "map", "struct", "binary"))]
    longer = sum((F.coalesce(t, F.lit(0)) for t in text), F.lit(0)) + (40 + 16 * len(df.columns))
    return df.agg(F.coalesce(F.sum(longer.cast("bigint")), F.lit(0))).first()[0]


def seeded_hash(seed: int, *columns: str | Column) -> Column:
    """32 hex digits that order rows at random, repeatably: md5("seed|c1|c2|...")."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(_col(c).cast("string"), F.lit("")) for c in columns]))


def _col(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column
