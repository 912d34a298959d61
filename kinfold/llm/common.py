"""Tables in the shared folder, and connected components of a link table."""

from __future__ import annotations

import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``, deleted when the application ends.

    Only a local master may do without the setting; there the folder is a temporary one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_folder()
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a shared table: later readers and lost executors need not redo it.

    The shuffle files of what was written serve nobody any more; Spark deletes them once the
    driver's collector has run, so it is asked to.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def spread_join(rows: DataFrame, one: DataFrame, key: str, copies: int = 16) -> DataFrame:
    """``rows`` with the columns of ``one`` (a row per ``key``); the rows of a frequent key go to several tasks."""
    salt = free_name(rows, free_name(one, "salt"))
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(*rows.columns), F.lit(copies)).cast("int"))
    return salted.join(one.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))), [key, salt]).drop(salt)


def to_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)],
        schema=schema,
    )


def numbered(df: DataFrame, within: list[str], order: list[str]) -> DataFrame:
    """``df`` in the order of ``within``, then ``order`` (nulls first), with group_no, group_n and pos from 0.

    Rows equal in all these columns take any order among them.
    The sort cuts ranges, also between equal rows; positions come from a table of one row per group
    and range, so no group meets in one task.
    """
    keys = [F.col(c).asc_nulls_first() for c in (*within, *order)]
    rows = df.withColumn("row_", F.monotonically_increasing_id()).orderBy(*keys, "row_").drop("row_")
    rows = stored(rows.withColumn("row_", F.monotonically_increasing_id()), "sorted").withColumn(
        "part_", F.shiftright("row_", 33))
    group = F.struct(F.lit(0).alias("all_"), *within)
    cuts = stored(rows.groupBy(group.alias("group_"), "part_").agg(F.count("*").alias("n_"), F.min("row_").alias("lead_")), "cuts")
    firsts = cuts.groupBy("group_").agg(F.sum("n_").alias("group_n"), F.min("lead_").alias("first_")).withColumn(
        "home_", F.shiftright("first_", 33))
    homes = firsts.groupBy("home_").count()  # one row per range: the running sums below are over ranges
    earlier = Window.partitionBy(F.lit(0)).orderBy("home_").rowsBetween(Window.unboundedPreceding, -1)
    homes = homes.select("home_", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("earlier_"))
    firsts = firsts.withColumn("nth_", F.row_number().over(Window.partitionBy("home_").orderBy("first_"))).join(
        homes, "home_").select("group_", "group_n", (F.col("earlier_") + F.col("nth_") - 1).alias("group_no"))
    above = Window.partitionBy("group_").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    cuts = cuts.withColumn("above_", F.coalesce(F.sum("n_").over(above), F.lit(0))).join(firsts, "group_").select(
        F.col("group_").alias("cut_"), F.col("part_").alias("in_"), "group_n", "group_no",
        (F.col("above_") - F.col("lead_")).alias("shift_"))
    cuts = stored(cuts, "cuts")  # its size is known then, and a small one is broadcast
    return rows.join(cuts, (group == F.col("cut_")) & (F.col("part_") == F.col("in_"))).select(
        *df.columns, "group_no", "group_n", (F.col("row_") + F.col("shift_")).alias("pos"))


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _contract(batches):
    """Union-find over the links of one task: each node once, pointing to the least of its set."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def forest():
        rows = [(x, find(x)) for x in list(parent)]
        rows = [r for r in rows if r[0] != r[1]]
        parent.clear()
        a = np.array(rows, dtype=np.int64).reshape(-1, 2)
        return to_batch(LINKS, a[:, 0], a[:, 1])

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = find(x), find(y)
            if x != y:
                lo, hi = min(x, y), max(x, y)
                parent[hi] = lo
                parent.setdefault(lo, lo)
        if len(parent) > 500_000:  # a task never holds more; the forest so far is as good as its links
            yield forest()
    if parent:
        yield forest()


def _print_of(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())


def components(links: DataFrame) -> DataFrame:
    """(key, comp) of every node that has a link: ``comp`` is the least node reachable.

    Union-find inside each task first, then large-star and small-star rounds between tasks, until
    nothing changes.  Minima combine before the shuffle; no component is gathered.
    """
    a, b = links.columns[:2]
    pairs = links.where(F.col(a) != F.col(b)).select(F.col(a).alias("a"), F.col(b).alias("b"))
    now = stored(pairs.mapInArrow(_contract, "a long, b long"), "forest")
    seen = _print_of(now)
    while seen[0]:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("x"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("x")).select(
            F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), "m")
        small = large.join(low, F.col("a") == F.col("x")).select(
            F.explode(F.array(
                F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                F.struct(F.col("a"), F.col("m").alias("b")),
            )).alias("p")).select("p.a", "p.b").where("a != b").distinct()
        now = stored(small, "forest")
        before, seen = seen, _print_of(now)
        if before == seen:
            break
    roots = now.select(F.col("b").alias("key"), F.col("b").alias("comp")).distinct()
    return now.select(F.col("a").alias("key"), F.col("b").alias("comp")).union(roots)
