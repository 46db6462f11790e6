"""Session construction and cluster-safe helpers (checkpoint folder, broadcast guard)."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "tessera", extra: dict | None = None) -> SparkSession:
    """Session for tests and the bench. On a cluster the launcher's settings win
    (``getOrCreate`` keeps an existing session)."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
         .config("spark.driver.memory", "16g"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_SHIPPED: set = set()
_CHECKPOINTED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers (once per application):
    the package is zipped in the driver's scratch folder and registered with ``addPyFile``,
    which is how Spark distributes Python code to executors."""
    import zipfile
    from pathlib import Path
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = Path(__file__).resolve().parent
    # the driver's own scratch folder: the source tree may be read-only, and Spark
    # copies the file to the executors itself
    out = Path(tempfile.mkdtemp(prefix="tessera-ship-")) / f"tessera-{app}.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(pkg.rglob("*.py")):
            z.write(f, f.relative_to(pkg.parent).as_posix())
    sc.addPyFile(str(out))
    _SHIPPED.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir`` (a shared folder). A ``local[...]``
    master without that setting (tests) gets a fresh scratch folder; on a cluster the
    setting is required, because a machine-local folder is not shared. Also ships the
    package to the Python workers."""
    ship_package(spark)
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not is_local(spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="tessera-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.applicationId not in _CHECKPOINTED:
        spark.sparkContext.setCheckpointDir(d)
        _CHECKPOINTED.add(spark.sparkContext.applicationId)
    return d


def is_local(master: str) -> bool:
    """Driver and executors are one process (``local``, ``local[n]``), not a cluster."""
    return master == "local" or master.startswith("local[")


def stored(df: DataFrame, tag: str, **options) -> DataFrame:
    """``df`` written as a table into the shared folder and read back: nothing upstream is
    computed again, also after a lost executor, and later reads keep column pruning."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
