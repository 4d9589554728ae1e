"""Session builder. Queries never rely on it: they also run in a session made elsewhere."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import SparkSession


def build(master: str = "local[*]", shuffle_partitions: int = 8, memory: str = "4g") -> SparkSession:
    return (
        SparkSession.builder.master(master)
        .appName("quern")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


@contextlib.contextmanager
def setting(spark: SparkSession, **confs):
    """Set runtime confs (dots written as two underscores) and put the old ones back."""
    names = {k.replace("__", "."): v for k, v in confs.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield spark
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. One is made only
    where none is set and the master is local, as in tests."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quern-shared-"))
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found or sc.getCheckpointDir()


def trim_driver(spark: SparkSession) -> bool:
    """Have the driver's JVM give back to the system what its native code (compiler, codecs, buffers) has
    freed: the C library keeps it in an arena for each of many threads. Nothing in use is touched. False
    where a JVM has no such command."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway

    def array(kind: str, *items):
        out = gateway.new_array(getattr(jvm.java.lang, kind), len(items))
        for k, x in enumerate(items):
            out[k] = x
        return out

    of = jvm.java.lang.Class.forName
    kinds = array("Class", *map(of, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")))
    try:
        # the server's own class is closed to calls from outside, its interface isn't
        call = of("javax.management.MBeanServer").getMethod("invoke", kinds)
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), array("Object", name, "systemTrimNativeHeap", array("Object"), array("String")))
    except Py4JError:
        return False
    return True


_written: dict[str, list[str]] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, for a table that cuts lineage; `clear_shared` removes it."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def is_kept(spark: SparkSession, path: str) -> bool:
    """Whether a path of `shared_path` has not been cleared."""
    return path in _written.get(spark.sparkContext.applicationId, [])


def clear_shared(spark: SparkSession) -> int:
    """Remove what this application wrote by `shared_path`, once no result that reads it is wanted any more."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    return len(paths)
