"""Tables written in the shared folder, and global ranks without a single-task window."""

from __future__ import annotations

import tempfile
import time
import uuid

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: spark.checkpoint.dir.

    Only a single-machine session (tests) may lack it; it then gets a temporary one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """Where a session's intermediate tables lie."""
    return f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back.

    Cuts lineage so that a lost executor costs a reread, and gives later joins
    two plain exchanges, which AQE can split where a key is hot.
    """
    path = f"{session_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    release(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def bucketed(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """As stored, with all rows of the keys' values in one bucket: what groups by all of the keys reads it without a shuffle, however often."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # with fewer, Spark would deal both sides anew
    path, name = f"{session_dir(spark)}/{label}-{uuid.uuid4().hex}", f"spark_catalog.default.tessera_{uuid.uuid4().hex}"
    df.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).option("path", path).saveAsTable(name)
    release(spark)
    out = spark.table(name)
    out.stored_at, out.named = path, name
    return out


def drop(df: DataFrame) -> None:
    """Delete a table as stored or bucketed returned it. What still reads from it fails afterwards."""
    if named := vars(df).get("named"):
        df.sparkSession.sql(f"DROP TABLE {named}")
    path, files = hadoop_path(df.sparkSession, df.stored_at)
    files.delete(path, True)


#: Seconds from one release to the next.
RELEASE_S = 4
_released = {}


def _managed(sc: SparkContext, bean: str, operation: str, *given: str) -> bool:
    """An operation of a bean of the driver's JVM with strings. False where Java has none."""
    jvm, array = sc._jvm, sc._gateway.new_array
    of = jvm.java.lang.Class.forName

    def filled(kind, *values):
        out = array(kind, len(values))
        for k, x in enumerate(values):
            out[k] = x
        return out

    try:
        kinds = filled(jvm.java.lang.Class, of("javax.management.ObjectName"), of("java.lang.String"), of("[Ljava.lang.Object;"), of("[Ljava.lang.String;"))
        name = jvm.javax.management.ObjectName(f"com.sun.management:type={bean}")
        values = filled(jvm.Object, *given)
        asked = filled(jvm.Object, name, operation, values, filled(jvm.String, *["java.lang.String"] * len(given)))
        of("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), asked)
    except Py4JError:
        return False
    return True


def _trim(sc: SparkContext) -> bool:
    """malloc_trim in the driver's JVM, by its diagnostic command; False where Java has none (before 17.0.9, or not on Linux)."""
    return _managed(sc, "DiagnosticCommand", "systemTrimNativeHeap")


#: Percent of the driver's heap that stays free after a collection, at least and at most, and milliseconds without one until the JVM collects by itself, also amid a long stage.
HEAP = {"MinHeapFreeRatio": 10, "MaxHeapFreeRatio": 30, "G1PeriodicGCInterval": 5_000}


def _shrink(sc: SparkContext) -> bool:
    """Let the driver's heap follow what it holds, where its collector can be told while it runs."""
    return all([_managed(sc, "HotSpotDiagnostic", "setVMOption", name, str(x)) for name, x in HEAP.items()])


def release(spark: SparkSession) -> None:
    """Give the memory that the driver's JVM no longer uses back to the system, RELEASE_S apart at least.

    A query of many tables starts some hundred threads and jobs, whose freed blocks glibc keeps, beside a
    heap that is grown before it is collected. Collecting also lets go of shuffles and broadcasts of before.
    """
    app, now = spark.sparkContext.applicationId, time.monotonic()
    if now - _released.get(app, -RELEASE_S) < RELEASE_S:
        return
    if app not in _released:
        _shrink(spark.sparkContext)
    spark.sparkContext._jvm.System.gc()
    _trim(spark.sparkContext)
    _released[app] = time.monotonic()


def hadoop_path(spark: SparkSession, path: str):
    """The path and its file system, as Spark itself reaches it."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def clear(spark: SparkSession) -> None:
    """Delete the session's intermediate tables. DataFrames that still read from them fail afterwards."""
    path, files = hadoop_path(spark, session_dir(spark))
    files.delete(path, True)


def running(df: DataFrame, order: list, sums: dict[str, str], keys: list[str] = (), label: str = "ranges") -> DataFrame:
    """df with running sums, the row's own included, over (keys, order), in tasks of even size.

    Rows are split into ranges of (keys, order), which are written once, so that the
    ranges are the same whenever they are read; a range adds the totals of those before it.
    Only these totals, one row for each range and key, meet in one window a key.
    """
    split = df.repartitionByRange(*keys, *order).withColumn("pid", F.spark_partition_id())
    split = stored(split, label)
    group, run = [*keys, "pid"], Window.partitionBy(*keys).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = split.groupBy(*group).agg(*[F.sum(F.expr(x)).alias(f"{n}_all") for n, x in sums.items()])
    before = totals.select(*group, *[F.coalesce(F.sum(f"{n}_all").over(run), F.lit(0)).alias(f"{n}_before") for n in sums])
    own = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = split.select("*", *[F.sum(F.expr(x)).over(own).alias(f"{n}_own") for n, x in sums.items()])
    out = local.join(before, group)
    return out.select(*df.columns, *[(F.col(f"{n}_before") + F.col(f"{n}_own")).cast("long").alias(n) for n in sums])


def ranked(df: DataFrame, order: list, name: str = "r", label: str = "rank") -> DataFrame:
    """df with ranks from 0 by a total order."""
    out = running(df, order, {name: "1L"}, label=label)
    return out.withColumn(name, F.col(name) - 1)
