"""Session set-up and the places where a plan is cut."""

from __future__ import annotations

import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "*", shuffle_partitions: int = 8, app: str = "userbaseline") -> SparkSession:
    """A session for tests and the bench; on a cluster, pass in the session you have."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # call sites of columns are only for debugging, and slow down building wide plans
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python tasks, wherever the driver found it.

    A zip of the package's sources goes with the job, once per Spark context.
    """
    context = spark.sparkContext
    if getattr(context, "_userbaseline_shipped", False):
        return
    package = pathlib.Path(__file__).resolve().parent
    with tempfile.NamedTemporaryFile(prefix=f"{package.name}-", suffix=".zip", delete=False) as held:
        with zipfile.ZipFile(held, "w") as packed:
            for source in sorted(package.rglob("*.py")):
                packed.write(source, source.relative_to(package.parent))
    context.addPyFile(held.name)
    context._userbaseline_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster such a folder
    would exist on one machine and vanish with it.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current is None:
        if named is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="userbaseline-")
        sc.setCheckpointDir(named)
        current = sc.getCheckpointDir()
    return current


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A new folder name below the shared folder, one per call."""
    return f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def cut(df: DataFrame, session: SparkSession | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there, in another session if one is named.

    One pass over the plan, whereas ``checkpoint`` runs its last stage twice; later readers
    get column pruning and filters pushed down.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return (session or df.sparkSession).read.schema(df.schema).parquet(path)
