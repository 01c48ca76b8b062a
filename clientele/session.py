"""Session set-up and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


# The shared folders made inside each open ``scratch`` block, the innermost last; every thread has its own.
_BLOCKS: ContextVar[tuple[list[str], ...]] = ContextVar("blocks", default=())

# Split skewed joins even where the next step then needs an exchange of its own: the join of lines
# and orders feeds an aggregation by order, and one order may hold very many lines.
SKEW_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def build_session(master: str | None = None, partitions: int | None = None,
                  app: str = "clientele") -> SparkSession:
    """A session with the settings the operators rely on.

    Cluster deployments pass neither ``master`` nor ``partitions``: both then come
    from spark-submit, and AQE coalesces the shuffle to the data.
    """
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if master:
        b = (b.master(master)
             .config("spark.ui.enabled", "false")
             .config("spark.driver.bindAddress", "127.0.0.1")
             .config("spark.driver.host", "127.0.0.1")
             .config("spark.driver.memory", "12g"))
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return prepare(b.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Make any session ready: skew handling on, package known to the worker processes."""
    given = spark.sparkContext.getConf()
    for key, value in SKEW_SETTINGS.items():
        if not given.contains(key):  # what the caller chose stays
            spark.conf.set(key, value)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the worker processes this package, wherever the session was started from."""
    sc = spark.sparkContext
    name = f"{Path(__file__).parent.name}.zip"
    if any(Path(p).name == name for p in sc.listFiles):
        return
    archive = Path(tempfile.mkdtemp(prefix="clientele-zip-")) / name
    root = Path(__file__).resolve().parents[1]
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(Path(__file__).parent.rglob("*.py")):
            z.write(f, f.resolve().relative_to(root))
    sc.addPyFile(str(archive))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The reliable folder for ``checkpoint()``.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without that
    setting gets a temporary folder; on a cluster a missing folder is an error, because
    machine-local files vanish with their executor.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="clientele-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    return sc.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str, outlive: bool = False) -> str:
    """A fresh folder below the checkpoint folder, which every executor can reach.

    It belongs to the innermost ``scratch`` block, or with ``outlive`` to the one around that.
    """
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    blocks = _BLOCKS.get()[:-1] if outlive else _BLOCKS.get()
    if blocks:
        blocks[-1].append(folder)
    return folder


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the shared folders made inside the block, by this thread, when it ends.

    What is computed inside must be written or collected there: a DataFrame that still reads a stage
    fails afterwards. What goes on being read is staged with ``outlive``.
    """
    mine: list[str] = []
    token = _BLOCKS.set((*_BLOCKS.get(), mine))
    try:
        yield
    finally:
        _BLOCKS.reset(token)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for folder in mine:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def stage(df: DataFrame, name: str = "stage", outlive: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and continue from that table.

    For results that later steps read several times: they are computed once, survive the loss of
    executors, and keep the plans that follow short.
    """
    path = shared_folder(df.sparkSession, name, outlive)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._is_stage = True
    return out


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` itself if it is what ``stage`` returned, else a stage of it."""
    return df if getattr(df, "_is_stage", False) else stage(df, name)
