"""Session helpers: building a session, shipping the package, the shared
checkpoint folder.

Nothing here changes how Spark plans a query; these are the few knobs a
job needs to run the same on ``local[8]`` and on a large cluster.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tabforge", master: str | None = None,
                shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session or build one with sane defaults.

    On a cluster the submitter owns master/memory; here we only set SQL
    options that every job in this package relies on (UTC, AQE on).
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (b.config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         # checkpoint files of frames no longer referenced are removed by
         # Spark's cleaner instead of piling up in the shared folder
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tabforge`` importable in the Python workers (what
    ``--py-files`` does at submit time): zip the package once per
    SparkContext and ``addPyFile`` it.  Pandas UDFs and ``mapInPandas``
    functions refer to package code by module name."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    sc.addPyFile(build_zip(os.path.join(tempfile.mkdtemp(prefix="tabforge-pkg-"), "tabforge.zip")))
    _SHIPPED.add(key)


def build_zip(out: str) -> str:
    """Write the package to the zip file ``out``."""
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.join("tabforge", os.path.relpath(full, pkg)))
    return out


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make sure reliable checkpoints have a home.

    The cluster names the shared folder in ``spark.checkpoint.dir``; we read
    it from the session.  Only when nothing is configured *and* the master is
    local (tests, laptops) do we pick a fresh temporary folder ourselves.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; on a cluster it must name a shared folder")
    local_dir = tempfile.mkdtemp(prefix="tabforge-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local_dir)
    return sc.getCheckpointDir()


def clear_staging(spark: SparkSession) -> None:
    """Remove this application's folder below the shared checkpoint folder:
    checkpoints, written layers, scratch tables, code tables of models that
    were not saved.  The last call of a job, once its results are written;
    DataFrames that still read such tables cannot be used any more."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        path = spark._jvm.org.apache.hadoop.fs.Path(current)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable, eager checkpoint into the shared checkpoint folder.

    Used to cut lineage and to pin partition contents when later steps
    depend on ``spark_partition_id`` (global ordinals).  Survives executor
    loss, unlike a local checkpoint.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Materialise a layer as Parquet in the shared checkpoint folder and
    read it back: cuts lineage like a checkpoint, survives executor loss,
    and - unlike a checkpoint - later reads get column pruning and filter
    pushdown."""
    import uuid
    base = ensure_checkpoint_dir(df.sparkSession)
    path = f"{base.rstrip('/')}/tables/{name}_{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
