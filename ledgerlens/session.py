"""SparkSession helpers.

On a cluster the session comes from the platform; ``ensure_defaults`` only
fills in settings that are unset (tests / local runs).  The checkpoint folder
is read from ``spark.checkpoint.dir``; a local one is chosen only when the
session has none (never on a cluster, where the setting names shared storage).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_LOCAL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "ledgerlens") -> SparkSession:
    """Local session for tests and the bench (not used on a cluster)."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", os.environ.get("LEDGERLENS_DRIVER_MEM", "8g")))
    for k, v in _LOCAL_DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_defaults(spark)
    return spark


def ensure_defaults(spark: SparkSession) -> SparkSession:
    """Set UTC + AQE only where the session leaves them unset."""
    conf = spark.conf
    for k, v in _LOCAL_DEFAULTS.items():
        if k == "spark.ui.enabled":
            continue
        if conf.get(k, None) is None:
            conf.set(k, v)
    ship_package(spark)
    # Timestamps in the oracle are naive UTC; all date logic assumes UTC.
    conf.set("spark.sql.session.timeZone", "UTC")
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, so that
    functions pickled by module reference load on every executor wherever the
    driver found the package."""
    import atexit
    import shutil
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    tmp = tempfile.mkdtemp(prefix="ledgerlens-ship-")
    atexit.register(shutil.rmtree, tmp, ignore_errors=True)      # the driver serves the file while it lives
    path = os.path.join(tmp, f"ledgerlens-{code_fingerprint()}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, files in sorted(os.walk(home)):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    out.write(full, os.path.join("ledgerlens", os.path.relpath(full, home)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder: the cluster's ``spark.checkpoint.dir`` when set;
    otherwise, on a local master only, a fresh scratch folder under /tmp.  Without a
    shared folder a cluster's stage tables would be lost, so that raises."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext._jsc.sc().getCheckpointDir()
        d = d.get() if d.isDefined() else None
    if not d:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="ledgerlens-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint into the shared checkpoint folder (survives executor
    loss; never ``localCheckpoint``)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def _fingerprint(spark: SparkSession, paths) -> str:
    """Hash of every file below ``paths`` (name, size, modification time), listed through
    the Hadoop FileSystem of the path; what cannot be listed raises."""
    import hashlib
    h = hashlib.sha1()
    conf = spark._jsc.hadoopConfiguration()
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(str(p))
        files = path.getFileSystem(conf).listFiles(path, True)
        found = []
        while files.hasNext():
            f = files.next()
            found.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
        for line in [str(p), *sorted(found)]:
            h.update(line.encode())
    return h.hexdigest()[:16]


_CODE_FP: str | None = None


def code_fingerprint() -> str:
    """Hash of this package's source, so persisted stage tables are rebuilt
    whenever the code that derives them changes."""
    global _CODE_FP
    if _CODE_FP is None:
        import hashlib
        root = os.path.dirname(os.path.abspath(__file__))
        h = hashlib.sha1()
        for dirpath, _, files in sorted(os.walk(root)):
            for f in sorted(files):
                if f.endswith(".py"):
                    with open(os.path.join(dirpath, f), "rb") as fh:
                        h.update(fh.read())
        _CODE_FP = h.hexdigest()[:12]
    return _CODE_FP


def materialized(spark: SparkSession, name: str, inputs, build, key_extra: str = ""):
    """Persist a derived table once as Parquet under the shared checkpoint
    folder and read it back (lineage cut, executor-loss safe, scans get
    pushdown).  The key covers every input file (name, size, modification time),
    the parameters and the code, so a changed input is rebuilt."""
    import hashlib
    own = hashlib.sha1(f"{key_extra}|{code_fingerprint()}".encode()).hexdigest()[:8]
    key = f"{name}-{_fingerprint(spark, list(inputs))}-{own}"
    path = os.path.join(checkpoint_dir(spark), "ledgerlens-tables", key)
    if not _exists(spark, path.rstrip("/") + "/_SUCCESS"):
        build().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop FileSystem of the path (works for
    local, HDFS and object-store checkpoint folders)."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(p))
