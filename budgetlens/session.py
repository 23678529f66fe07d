"""Session helpers: defaults that matter at scale, and the shared scratch folder.

On a cluster the session is built by the platform; these helpers only fill in
settings that are unset. Tests and the bench build a local session through
``local_session``.
"""

from __future__ import annotations

import contextlib
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable

from pyspark.sql import SparkSession

# Settings every job here relies on. AQE re-plans joins from runtime sizes
# (broadcast only when the measured side is under the threshold), coalesces
# tiny shuffle partitions and splits skewed ones.
SCALE_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Bound Arrow batches fed to pandas UDFs so a hot group never needs one
    # huge batch in a Python worker.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "budgetlens") -> SparkSession:
    """A local session for tests and the bench (UI off, no extra ports)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BUDGETLENS_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SCALE_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Set SCALE_DEFAULTS on a running session where the key is unset."""
    for key, value in SCALE_DEFAULTS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def size_shuffle_partitions(spark: SparkSession, input_bytes: int,
                            target_bytes: int = 128 << 20, minimum: int | None = None) -> int:
    """Set ``spark.sql.shuffle.partitions`` so a full shuffle of ``input_bytes``
    lands near ``target_bytes`` per partition (AQE then coalesces what is
    smaller and splits skew). Returns the value set."""
    cores = spark.sparkContext.defaultParallelism
    n = max(minimum or 2 * cores, -(-int(input_bytes) // int(target_bytes)))
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    return n


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the jobs of the block, as they were after it."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


#: For jobs that sort wide rows: a task gets about 16 MB of compressed rows at any
#: size of the input (its sorts hold some twenty times as much).
SMALL_TASKS = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m", "spark.sql.files.maxPartitionBytes": "16m"}
#: For long expressions: the JVM does not compile methods beyond this size, so
#: such plans run as smaller methods instead of one per stage.
SMALL_METHODS = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application (a zip
    through ``addPyFile``), so that functions that run there can import it
    even where only the driver's ``sys.path`` names it."""
    sc = spark.sparkContext
    if getattr(sc, "_budgetlens_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    # in the shared folder, written through its own file system
    target = f"{checkpoint_dir(spark).rstrip('/')}/budgetlens-src-{uuid.uuid4().hex}.zip"
    path = sc._jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(data.getvalue()))
    out.close()
    sc.addPyFile(target)
    sc._budgetlens_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Read from the session. Where it is unset, a ``local[...]`` master (tests)
    gets a fresh local folder; any other master raises, because a machine-local
    folder is not shared between driver and executors.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all "
                               "executors share")
        conf_dir = tempfile.mkdtemp(prefix="budgetlens-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir()


#: Scratch tables made and not yet removed, in order.
_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the shared checkpoint folder."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


@contextlib.contextmanager
def scratch_scope(spark: SparkSession, keep: Iterable[str] = ()):
    """Remove, at the end of the block, the scratch tables made inside it (but
    those whose name starts with one of ``keep``). A report is lazy and reads
    its scratch tables when it runs, so run or write it inside the block."""
    before = len(_SCRATCH)
    try:
        yield
    finally:
        made = _SCRATCH[before:]
        stay = [p for p in made if any(p.rsplit("/", 1)[1].startswith(k) for k in keep)]
        _SCRATCH[before:] = stay
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for name in made:
            if name not in stay:
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(conf).delete(path, True)


def materialize(df, name: str):
    """Cut lineage by writing ``df`` as Parquet under the shared checkpoint
    folder and reading it back: one job (``checkpoint()`` on an unpersisted
    plan computes it twice), executor loss after this point never recomputes
    the inputs, and later reads get Parquet statistics and column pruning."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop_scratch(df) -> None:
    """Delete the table that ``materialize`` returned as ``df``: for loops whose
    next table is written from the last one. Nothing may read it afterwards."""
    spark, path = df.sparkSession, df._scratch_path
    if path in _SCRATCH:
        _SCRATCH.remove(path)
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(name, True)


def broadcast_if_small(df, max_rows: int = 100_000):
    """``broadcast(df)`` only when a count proves it has at most ``max_rows``
    rows; otherwise ``df`` unchanged, and the planner picks the join (a
    sort-merge or shuffled hash join beyond the broadcast threshold)."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
