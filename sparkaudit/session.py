"""Session settings, jobs side by side, and the one way this library cuts lineage."""
import contextvars
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build_session(app_name="sparkaudit", master=None, **conf):
    """A session with the settings the jobs are written for; ``conf`` entries override them."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # jobs of several threads share the executors evenly
        "spark.scheduler.mode": "FAIR",
        # exact percentiles of many small groups stay hash-based; the tables they run on are of checked size
        "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "100000",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark):
    """The shared folder for materialised tables: the session's ``spark.checkpoint.dir``.

    Only a local-mode session may run without one; it gets a fresh scratch folder.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")
        folder = tempfile.mkdtemp(prefix="sparkaudit-")
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


# Folders of the scratch blocks that are open, the innermost last.
_SCRATCH = contextvars.ContextVar("scratch", default=())


@contextmanager
def scratch(spark):
    """Tables that are materialised inside the block are deleted when it ends, also by an error; those that are ``kept``
    belong to the block around it, or stay where there is none."""
    folder = f"{checkpoint_dir(spark)}/tables/scratch-{uuid.uuid4().hex}"
    token = _SCRATCH.set((*_SCRATCH.get(), folder))
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, kept=False) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    The result survives the loss of executors, is computed once however often it is read, and carries its
    true size, so Spark itself decides by that size whether a join may broadcast it. Its number of rows, counted
    while writing, is kept for ``stored_rows``. Inside a ``scratch`` block it lasts as long as the block, or, if
    ``kept``, as the block around it.
    """
    spark = df.sparkSession
    open_blocks = _SCRATCH.get()[:-1] if kept else _SCRATCH.get()
    folder = open_blocks[-1] if open_blocks else f"{checkpoint_dir(spark)}/tables"
    path = f"{folder}/{uuid.uuid4().hex}"
    written = Observation()
    df.observe(written, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_rows = written.get.get("rows")
    return stored


def stored_rows(df: DataFrame) -> int:
    """Rows of a stored table; counted from the file footers when it was not written here."""
    known = df.__dict__.get("_stored_rows")
    return df.count() if known is None else known


def side_by_side(spark, jobs, limit):
    """The results of the functions ``jobs``, in their order. At most ``limit`` run at a time, each as Spark jobs in a
    scheduler pool of its own; they inherit the caller's local properties and scratch block. After a failure no further one
    starts."""
    checkpoint_dir(spark)       # set up once, before threads ask for it
    failed = []

    def run(at, job):
        if failed:
            return None
        try:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"side-{at % limit}")
            return job()
        except BaseException:
            failed.append(at)
            raise

    with ThreadPoolExecutor(max(1, limit)) as threads:
        running = [threads.submit(contextvars.copy_context().run, inheritable_thread_target(spark)(run), at, job)
                   for at, job in enumerate(jobs)]
    # the first failure in the order of the jobs, once all have stopped
    return [r.result() for r in running]
