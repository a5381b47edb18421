"""Shared plumbing: scratch tables, components, code shipping."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder under the shared one that ``spark.checkpoint.dir``
    names. Where the setting is absent a local master (tests on one machine)
    gets a temporary folder; a cluster has none that all can see, so it fails."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = getattr(sc, "_skygrid_scratch", None)
        if where is None:
            where = sc._skygrid_scratch = tempfile.mkdtemp(prefix="skygrid-scratch")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    mine = f"{where.rstrip('/')}/skygrid-{sc.applicationId}"
    if getattr(sc, "_skygrid_tables", None) is None:
        sc._skygrid_tables = [[]]
        atexit.register(_remove, sc._jvm, sc._jsc.hadoopConfiguration(), [mine])
    return mine


def _remove(jvm, conf, paths: list[str]) -> None:
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


@contextmanager
def scratch(spark: SparkSession):
    """Tables that ``materialise`` writes inside are deleted at the end: use it
    around work whose result has been written elsewhere by then. All others go
    when the driver's Python ends."""
    scratch_dir(spark)
    sc = spark.sparkContext
    sc._skygrid_tables.append([])
    try:
        yield
    finally:
        _remove(sc._jvm, sc._jsc.hadoopConfiguration(), sc._skygrid_tables.pop())


def materialise(df: DataFrame, outer: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later passes
    see the very same rows even if an executor is lost meanwhile. ``outer``: the
    table outlives the innermost ``scratch``."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    tables = spark.sparkContext._skygrid_tables
    tables[max(0, len(tables) - 1 - outer)].append(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._skygrid_table = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table of a ``materialise``d frame that nothing reads any more."""
    sc = df.sparkSession.sparkContext
    path = getattr(df, "_skygrid_table", None)
    if path is not None:
        _remove(sc._jvm, sc._jsc.hadoopConfiguration(), [path])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def checkpoint(df: DataFrame) -> DataFrame:
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def all_columns(df: DataFrame) -> list:
    """The columns of ``df`` as they are, dots and quotes in names included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def map_rows(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` for columns of any name (its own lookup fails on dots):
    ``run`` gets them by position."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(run, schema)


def docs_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of a documents table; null texts become empty. Other
    columns, whatever their names, are left out of the plan."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    ``edges`` has long columns u, v (self links and repeats are allowed).
    Returns (node, root), root being the smallest node reachable, for every
    node with a link to another node. A round costs two grouped minima and two
    joins over the edge list, which never grows; rounds follow the logarithm
    of the longest chain. No component is gathered in one task.
    """
    e = checkpoint(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )

    def sign(df):
        r = df.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("s")).first()
        return (r["n"], r["s"])

    last = sign(e)
    if last[0] == 0:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: larger neighbours of u hang on the smallest of u's neighbourhood
        big = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        big = big.distinct()
        # small star: u and its smaller neighbours hang on the smallest of them
        low2 = big.groupBy("u").agg(F.min("v").alias("m"))
        joined = big.join(low2, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpoint(small.union(low2.select("u", F.col("m").alias("v"))).distinct())
        now = sign(e)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


__all__ = ["all_columns", "checkpoint", "components", "discard", "docs_of", "free_name", "map_rows", "materialise", "scratch", "scratch_dir", "ship", "table"]
