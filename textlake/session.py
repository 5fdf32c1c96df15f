"""Session helpers.

The library never creates its own cluster settings beyond what a local test run needs: on a cluster the
session, its shuffle sizing and its checkpoint folder come from the job submission.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "textlake") -> SparkSession:
    """A local session for tests and the bench: AQE on, UI off, loopback driver, UTC."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", os.environ.get("TEXTLAKE_DRIVER_MEMORY", "16g"))
    )
    event_dir = os.environ.get("TEXTLAKE_EVENT_LOG_DIR")
    if event_dir:  # stage and task times for later study, written to a scratch folder (the UI stays off)
        os.makedirs(event_dir, exist_ok=True)
        builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", event_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting one only where the session has none.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as is. Only a local-mode session
    without the setting (tests, the bench) gets a fresh folder under the system temp directory.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; a cluster job needs a shared checkpoint folder")
    folder = tempfile.mkdtemp(prefix="textlake-ckpt-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def ship_package(spark: SparkSession) -> None:
    """Make ``textlake`` importable in Python workers (``addPyFile`` of a zip of this package), once per context.

    Functions used inside ``mapInPandas``/``applyInPandas`` are pickled by reference to this package, so the
    executors need it; this is the same mechanism as ``--py-files`` on a cluster.
    """
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_textlake_shipped", None):
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out_dir = tempfile.mkdtemp(prefix="textlake-pyfiles-")
    zpath = os.path.join(out_dir, "textlake.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _dirs, files in os.walk(pkg_dir):
            if "__pycache__" in root:
                continue
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(root, name)
                    zf.write(full, os.path.join("textlake", os.path.relpath(full, pkg_dir)))
    sc.addPyFile(zpath)
    sc._textlake_shipped = zpath


#: most bytes of rows that travel to a Python worker at once (a single longer row travels alone)
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of Python steps by bytes: ten thousand whole texts or prompts, as the row bound allows, are
    more than a worker needs at once. The bound is only lowered, never raised, so a cluster's own smaller setting holds."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if now > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def give_back() -> None:
    """Returns freed memory to the system. A worker process lives on after its task, beside those of later stages; the C
    library and Arrow's pool would keep what was freed. Does nothing where the library has no such call."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def spread(df, *keys):
    """Hash-repartition ``df`` on ``keys`` only when its scan gives fewer partitions than the cluster's
    parallelism (a few large files, as in the test tables). At scale the scan already has thousands of
    partitions and nothing is added."""
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, *keys) if keys else df.repartition(target)


_noted: ContextVar[list[str] | None] = ContextVar("noted", default=None)


@contextmanager
def noting_tables():
    """A list that gathers the paths of the tables written in the block, for :func:`drop_tables` later."""
    paths: list[str] = []
    token = _noted.set(paths)
    try:
        yield paths
    finally:
        _noted.reset(token)


def materialize(df, name: str = "stage"):
    """Write ``df`` as a parquet table under the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()`` but computes the plan once (an RDD checkpoint recomputes it to write
    the files unless it was cached), and the table survives the loss of any executor.
    """
    import uuid

    base = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    path = f"{base}/tables/{name}-{uuid.uuid4().hex}"
    if (noted := _noted.get()) is not None:
        noted.append(path)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def drop_tables(spark: SparkSession, paths, keep: DataFrame | None = None) -> list[str]:
    """Delete tables written by :func:`materialize` whose consumers are done; returns those left because ``keep`` (a
    DataFrame still in use) reads them."""
    used = [f.split(":", 1)[-1] for f in keep.inputFiles()] if keep is not None else []
    left = []
    for path in paths:
        where = path.split(":", 1)[-1].rstrip("/") + "/"
        if any(where in f for f in used):
            left.append(path)
            continue
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return left


def broadcast_if_small(df, max_rows: int = 100_000):
    """``broadcast(df)`` when a count proves it has at most ``max_rows`` rows, else ``df`` unchanged (a shuffle
    join, with AQE splitting skewed keys). For small sides joined on keys that may be hot."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def broadcast_if_light(df, weight, max_bytes: int = 16 << 20):
    """``broadcast(df)`` when a sum proves that its rows of ``weight`` bytes (a column; 64 are added to each) hold at most
    ``max_bytes``, else never broadcast. For rows that carry texts, whose count says little."""
    from pyspark.sql import functions as F

    held = df.agg(F.sum(F.coalesce(weight, F.lit(0)).cast("bigint") + 64)).first()[0] or 0
    return F.broadcast(df) if held <= max_bytes else never_broadcast(df)


def never_broadcast(df):
    """``df`` joined by sorted shuffle, unless the other side is broadcast by name. For sides that carry texts: Spark would
    broadcast one by the size of its files, and a table of repeated texts is far smaller there than in memory."""
    return df.hint("merge")
