"""Shared working folder: where intermediate tables are written.

Tables that several stages read (dictionaries, vocabularies, prefix summaries)
are written once as Parquet instead of being recomputed or cached on executors,
so a lost executor costs a re-read and the optimiser knows their true size. Writing
is a job: an operator that stores a table runs it when the operator is called, not
when its result is read. ``clear`` removes all that an application has stored.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CONF = "spark.checkpoint.dir"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_LOCAL: dict[str, str] = {}
_STORED: dict[str, list[str]] = {}
_BUILT: dict[tuple, object] = {}

# Largest table, in rows and in estimated bytes, that is ever sent whole to every executor.
BROADCAST_ROWS = 250_000
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder the cluster names in ``spark.checkpoint.dir``; a local one only in local mode."""
    named = spark.conf.get(_CONF, None) or spark.sparkContext.getConf().get(_CONF)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError(f"set {_CONF} to a folder every executor can reach")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="tagloom-")
    return _LOCAL[context.applicationId]


def store(df: DataFrame, name: str, narrow: bool = False, records: int | None = None) -> DataFrame:
    """Write ``df`` under the shared folder and return the written table.

    The shuffle files of the write are deleted when it is done: its stages are never run again.
    ``narrow`` says that no Arrow batch of the job can be large: its bytes, else measured
    again after every row, are not measured. ``records`` is the number of rows of such a batch.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    wanted = {_CLEAN: "true"} | ({_BATCH: str(2**31 - 1)} if narrow else {}) | ({_RECORDS: str(records)} if records else {})
    before = {key: spark.conf.getAll.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
    return spark.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession, name: str, build: Callable[[], DataFrame], **how) -> DataFrame:
    """Write what ``build`` gives, and delete the tables that it stored on the way.

    The written table stands on its own, so a lost executor needs none of them. ``how`` is that of :func:`store`.
    """
    held = _STORED.setdefault(spark.sparkContext.applicationId, [])
    before = len(held)
    made = store(build(), name, **how)
    for path in held[before:-1]:
        place, files = _file_system(spark, path)
        files.delete(place, True)
    del held[before:-1]
    return made


def new_path(spark: SparkSession, name: str) -> str:
    """An unused place under the shared folder, which ``clear`` will remove."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _STORED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, files = _file_system(spark, path)
    return files.exists(place)


def clear(spark: SparkSession) -> int:
    """Delete every table that this application has stored; the number of them.

    Frames that read them can be used no longer. What ``once`` has built is forgotten.
    """
    app = spark.sparkContext.applicationId
    paths = _STORED.pop(app, [])
    for path in paths:
        place, files = _file_system(spark, path)
        files.delete(place, True)
    for key in [k for k in _BUILT if k[0] == app]:
        del _BUILT[key]
    return len(paths)


def once(spark: SparkSession, inputs: Sequence[str], name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` gives, built once for each application and state of the input paths.

    The state is the length and modification time of the paths, which change when a
    table is written anew.
    """
    state = []
    for path in inputs:
        place, files = _file_system(spark, path)
        found = files.listStatus(place)
        state.append((path, sum(x.getLen() for x in found), max((x.getModificationTime() for x in found), default=0)))
    key = (spark.sparkContext.applicationId, name, *state)
    if key not in _BUILT:
        _BUILT[key] = build()
    return _BUILT[key]


def is_small(table: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """True when ``table`` has at most ``rows`` rows and an estimated ``size`` bytes.

    Meant for written tables, where counting reads no columns. Bytes are the number of
    rows times the mean width of up to a thousand rows.
    """
    count = table.count()
    if count > rows:
        return False
    if all(isinstance(f.dataType, (T.NumericType, T.BooleanType)) for f in table.schema):
        return count * 8 * len(table.columns) <= size
    width = table.limit(1000).agg(F.avg(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return count * width <= size


def broadcast_if_small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(table) if is_small(table, rows) else table


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Re-distribute a scan only when its files make fewer splits than there are cores.

    Decided from the lengths of the files alone; nothing is planned or run for it. A
    scan of many or large files is left alone.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    paths = df.inputFiles()
    if len(paths) >= cores:
        return df
    most = _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    splits = 0
    for path in paths:
        place, files = _file_system(spark, path)
        splits += -(-files.getFileStatus(place).getLen() // most)
    return df if splits >= cores else df.repartition(cores, *keys)


def _bytes(text: str) -> int:
    """A size in Spark's notation: 134217728b, 128m, 1g."""
    units = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    low = text.strip().lower().removesuffix("b") if text.strip()[-2:-1].isalpha() else text.strip().lower()
    return int(low) if low.isdigit() else int(low[:-1]) * units[low[-1]]


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-distribute rows by ``keys`` over the configured number of partitions."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys)
