"""Results stored as versions: a run writes new folders, and a small manifest, put in place last, names them.

A run that breaks off leaves folders that no manifest names, so readers go on seeing the version before it, and never
tables of different runs side by side.
"""
import uuid


def manifests(spark, folder):
    """{number: path} of the finished manifests; Spark moves a manifest's file into its folder when it is complete."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifests/*/part-*")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return {int(s.getPath().getParent().getName()): s.getPath().getParent().toString() for s in found}


def latest(spark, folder):
    """{name: table} of the newest version; empty when there is none."""
    known = manifests(spark, folder)
    if not known:
        return {}
    rows = spark.read.schema("name string, path string").json(known[max(known)]).collect()      # one row per table
    return {r["name"]: spark.read.parquet(r["path"]) for r in rows}


def publish(tables, folder):
    """Stores the tables {name: DataFrame} as the newest version under ``folder``; fails if another run was faster."""
    spark = next(iter(tables.values())).sparkSession
    number = max(manifests(spark, folder), default=0) + 1
    paths = {name: f"{folder}/versions/{uuid.uuid4().hex}/{name}" for name in tables}
    for name, table in tables.items():
        table.write.parquet(paths[name])
    spark.createDataFrame(list(paths.items()), "name string, path string").coalesce(1).write.json(f"{folder}/manifests/{number:08d}")


def replaced(old, new, by="model"):
    """Results of the groups in ``new`` replace those of ``old``; the others stay. The groups are few."""
    names = new.select(by).distinct()
    return old.join(names, by, "left_anti").unionByName(new.select(old.columns))


def publish_over(tables, folder, derived=None, by="model"):
    """Publishes ``tables`` with the groups of the newest version that they do not hold, and the tables that the function
    ``derived`` makes of them all."""
    spark = next(iter(tables.values())).sparkSession
    before = latest(spark, folder)
    whole = {name: replaced(before[name], table, by) if name in before else table for name, table in tables.items()}
    publish(whole | (derived(whole) if derived else {}), folder)
