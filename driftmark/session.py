"""Session helpers.

Files that queries write on purpose (rendered text inputs, pane files,
streaming checkpoints) go under the shared folder the cluster names in
``spark.checkpoint.dir``.  Only when that setting is absent (local tests,
benches) do we pick a folder of our own and register it.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app: str = "driftmark") -> SparkSession:
    """Session for tests and benches; on a cluster use the provided one."""
    master = master or os.environ.get("DRIFTMARK_MASTER", "local[8]")
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder; a private one is set only when the
    session has none (tests).  ``setCheckpointDir`` appends a fresh folder
    on every call, so it is called at most once per context."""
    sc = spark.sparkContext
    cur = sc.getCheckpointDir()
    if cur:
        return cur
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="driftmark-ckpt-")
    sc.setCheckpointDir(root)
    return sc.getCheckpointDir() or root


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh, never reused folder below the checkpoint root."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage where a result fans out to several consumers.

    Branches of one DataFrame are pruned to different columns by Catalyst, so
    their exchanges stop being identical and AQE cannot reuse them; nested
    fan-out then recomputes (and rescans) the upstream once per path.  The
    result is written once below the shared checkpoint folder (columnar and
    compressed: a checkpoint of rows takes several times the space, and as
    much again while it is cached) and survives executor loss."""
    path = scratch_dir(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``driftmark`` importable in Python workers (the ordered folds
    and the stateful processors unpickle its classes there): zip the package
    once per application and hand it to ``addPyFile``, which distributes it
    like ``--py-files``.  A no-op when already shipped."""
    import os
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    base = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="driftmark-pyfiles-"), "driftmark.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, base))
    sc.addPyFile(out)
    # the driver-side runner of stateful streaming processors takes its
    # PYTHONPATH from the function environment, not from addPyFile
    cur = sc.environment.get("PYTHONPATH", "")
    sc.environment["PYTHONPATH"] = out + (os.pathsep + cur if cur else "")
    _SHIPPED.add(sc.applicationId)
