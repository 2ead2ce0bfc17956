"""Session settings and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "posegrid", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only where the session names none (tests on one machine) a temporary folder is set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        path = tempfile.mkdtemp(prefix="posegrid-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path


def materialize(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write once to the shared folder and read back, so loops carry no growing lineage
    and a lost executor costs a re-read instead of a re-run."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    (df if files is None else df.coalesce(files)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_folders(df: DataFrame, path: str, keys, order=()) -> None:
    """A text file in a folder for each value of ``keys``, its lines (the other column) in order of ``order``.

    Files take time each however short they are, so the number of tasks is named: the session would join small partitions, down to a
    single task. Tasks put their files in place themselves; by default the driver would move every one at the end. In a file system that
    the tasks can open, they write without Hadoop, which without its native library starts a process for each file's mode.
    """
    spark, keys, order = df.sparkSession, list(keys), list(order)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = df.repartition(tasks, *keys).sortWithinPartitions(*keys, *order).drop(*order)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.getScheme() != "file":
        dealt.write.mode("overwrite").option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(*keys).text(path)
        return
    system.delete(place, True)
    system.mkdirs(place)
    line = next(c for c in dealt.columns if c not in keys)
    named = [F.when(F.col(k).cast("string") != "", F.col(k).cast("string")).otherwise(NO_VALUE).alias(f"_{i}") for i, k in enumerate(keys)]
    text = dealt.select(*named, F.coalesce(F.col(line), F.lit("")).alias("_line"))
    text.mapInArrow(_folder_writer(system.makeQualified(place).toUri().getPath(), keys), "files long").agg(F.sum("files")).collect()
    system.create(spark._jvm.org.apache.hadoop.fs.Path(place, "_SUCCESS")).close()


NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def _folder_writer(path: str, keys: list[str]):
    """Writes runs of rows with the same keys as files of lines; each comes under its name when it is whole."""
    escaped = {ord(c): f"%{ord(c):02X}" for c in [*map(chr, range(1, 32)), *"\"#%'*/:=?\\{[]^", "\x7f"]}

    def write(batches):
        part = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.txt"
        own, out, files = None, None, 0

        def close() -> None:
            if out is not None:
                out.close()
                os.replace(out.name, os.path.join(os.path.dirname(out.name), part))

        for batch in batches:
            for *key, line in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != own:
                    close()
                    own, files = key, files + 1
                    folder = os.path.join(path, *[f"{k.translate(escaped)}={v.translate(escaped)}" for k, v in zip(keys, key, strict=True)])
                    os.makedirs(folder, exist_ok=True)
                    out = open(os.path.join(folder, f"_{part}"), "wb")
                out.write(line.encode() + b"\n")
        close()
        yield pa.RecordBatch.from_pydict({"files": [files]})

    return write


def ship(spark: SparkSession) -> None:
    """Send this package to the workers once for each application, so they need no installed copy nor the driver's folder."""
    import zipfile

    context = spark.sparkContext
    if getattr(context, "_posegrid_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    # executors fetch the file when they start, so it stays as long as the driver
    path = os.path.join(tempfile.mkdtemp(prefix="posegrid-code-"), f"posegrid-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(top):
            for full in (os.path.join(at, n) for n in names if n.endswith(".py")):
                z.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(path)
    context._posegrid_shipped = True
