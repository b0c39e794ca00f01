"""Session helpers.

Everything in the package takes a ``SparkSession`` from the caller; these helpers only build a
sensible local one for tests and the benchmark, and resolve the shared checkpoint folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on: UTC session zone (inventory times are compared as instants),
# adaptive execution for runtime coalescing and skew splitting.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Generated functions above 8000 bytes of bytecode are never JIT-compiled by HotSpot; past
    # this size Spark falls back to split functions instead (long rule lists hit this).
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "8g",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "lakerules", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the package defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


_local_ckpt: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    On a cluster ``spark.checkpoint.dir`` names a shared, durable folder and is used as is. Only
    when it is unset (local tests) is a scratch folder created, once per session.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    if not spark.conf.get("spark.master", "local").startswith("local[") and spark.conf.get("spark.master", "local") != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = str(id(spark))
    if key not in _local_ckpt:
        _local_ckpt[key] = tempfile.mkdtemp(prefix="lakerules-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", _local_ckpt[key])
        except Exception:  # some deployments refuse to change it at run time; the folder still works
            pass
    return _local_ckpt[key]


def cut_lineage(df):
    """Cut the lineage by writing ``df`` once as a Parquet table under the shared checkpoint
    folder and reading it back (never a local checkpoint, so it survives executor loss).

    Unlike ``Dataset.checkpoint``, which computes its input twice when not cached, this computes
    it once and stores it columnar and compressed; later readers get pruning and pushdown.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"cut-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.parquet(path)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers (as ``--py-files`` would).

    Pandas UDFs, ``mapInPandas`` and ``applyInPandas`` refer to functions of this package by
    module name, so the workers must be able to import it. A zip of the package is built once per
    driver process and registered with the session.
    """
    key = str(id(spark))
    if key in _shipped:
        return
    import shutil

    pkg = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="lakerules-pkg-")
    zpath = shutil.make_archive(os.path.join(out, "lakerules"), "zip", os.path.dirname(pkg), os.path.basename(pkg))
    try:
        spark.sparkContext.addPyFile(zpath)
    except Exception:  # Spark Connect: no SparkContext on the client
        spark.addArtifacts(zpath, pyfile=True)
    _shipped.add(key)


def sf_path(sf_dir: str, table: str) -> str:
    return os.path.join(sf_dir, f"{table}.parquet")
