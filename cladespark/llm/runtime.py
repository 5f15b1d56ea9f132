"""What the operators share: where tables and files go, how Python workers find the package, and keys of rows."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import workers_see_package

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000
BROADCAST_ROWS = 1 << 20  #: sides of at most so many narrow rows (counted) are broadcast; larger ones are shuffled
TASKS_A_CORE = 4
TASK_ROWS = 1 << 16  #: narrow rows that a task gets at least, where their number is known


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, and bound the rows of an Arrow batch: rows here hold whole texts, and a batch is in memory twice, in the JVM and in its worker."""
    workers_see_package(spark)
    rows = int(spark.conf.get(BATCH))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set(BATCH, str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. In local mode, and only there, an unset one becomes a temporary folder."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def cut(frame: DataFrame) -> DataFrame:
    """Write ``frame`` to the shared folder and go on from there: lost executors then cost nothing made before."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def dealt(frame: DataFrame, rows: int) -> DataFrame:
    """``frame``, of at most ``rows`` narrow rows, in no more partitions than these need: few rows in many partitions cost a task, its files and its shuffle files each."""
    return frame.coalesce(max(1, -(-rows // TASK_ROWS)))


def counted(made: DataFrame) -> int:
    """Rows of what ``cut`` made: by one task a core, however many files it has."""
    return made.coalesce(made.sparkSession.sparkContext.defaultParallelism).count()


def tidy(spark: SparkSession) -> None:
    """Let Spark delete shuffle files and checkpoints that nothing reads any more. It does so when the driver collects garbage, which else may be long after."""
    gc.collect()
    spark._jvm.System.gc()


def few_files(frame: DataFrame) -> DataFrame:
    """``frame`` of narrow rows in a few partitions for each core, for tables of an unknown number of rows; each part of a shuffle is still summed or joined by itself."""
    return frame.coalesce(TASKS_A_CORE * frame.sparkSession.sparkContext.defaultParallelism)


def packed(frame: DataFrame) -> DataFrame:
    """``frame`` of narrow rows, cut, in as few partitions as its rows need."""
    made = cut(few_files(frame))
    return dealt(made, counted(made))


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses. A folder without a scheme is one of the default file system."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` as a URI with scheme, as readers outside Spark need it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return uri if "://" in uri else uri.replace("file:", "file://", 1)


def stored(frame: DataFrame, path: str) -> DataFrame:
    """``frame`` as a Parquet table at ``path``, read again: as ``cut``, but compressed and by columns."""
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table of ``stored`` that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_side(frame: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``frame``, cut and counted: marked for a broadcast if it has at most ``most`` rows, else as it is."""
    made = cut(few_files(frame))
    rows = counted(made)
    return F.broadcast(dealt(made, rows)) if rows <= most else made


def keyed(docs: DataFrame, id_col: str, nulls_last: bool = False) -> tuple[DataFrame, str]:
    """``docs`` with a unique key of type long that ascends with the id, and the key's name.

    Ids that are unique and not null are the key (one pass over the ids tells). Otherwise the rows are sorted by id, nulls
    first or last and rows of one id in any order, numbered, and stored in the shared folder.
    """
    own = F.col(id_col).cast("long")
    bad = docs.groupBy(own.alias("id")).agg(F.count("*").alias("many")).where("id is null or many > 1")
    if bad.isEmpty():
        return docs, id_col
    name = "row_key"
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    placed = docs.withColumn(name, F.monotonically_increasing_id())
    ordered = placed.orderBy(own.asc_nulls_last() if nulls_last else own.asc_nulls_first(), name)
    return stored(ordered.withColumn(name, F.monotonically_increasing_id()), new_path(docs.sparkSession, "keyed")), name


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@contextlib.contextmanager
def smaller_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, Arrow batches have at most ``rows`` rows, so wide rows keep the memory of workers bounded."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)
