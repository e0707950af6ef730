"""Helpers shared by all operators: tables, scratch tables, skew-safe joins, text normalisation."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Trims Unicode white space, not only blanks.
OUTER_SPACE = r"(?U)^\s+|\s+$"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def trimmed(c: Column | str) -> Column:
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, OUTER_SPACE, "")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir). Only a local session without that setting gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def cut(df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """df as a written table of the shared folder: its lineage ends here, it survives lost executors, and its size is known to the planner."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/factloom-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Deletes the files of a table made by cut() that no later step reads."""
    jvm, files = df.sparkSession._jvm, df.inputFiles()
    if files:
        folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        while "=" in folder.getName():  # a table in parts
            folder = folder.getParent()
        if folder.getName().startswith("factloom-"):
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(counts: DataFrame, key: str) -> DataFrame | None:
    """The keys of (key, count) that a join has to spread: the most frequent with over 10,000 rows, at most 8 x partitions of them.

    Whatever is not among those holds at most an eighth of an average partition, so the list is bounded and safe to broadcast.
    None if no key is hot.
    """
    n = 8 * parts(counts.sparkSession)
    top = counts.where((F.col("count") > 10_000) & F.col(key).isNotNull()).orderBy(F.desc("count")).limit(n).select(F.col(key).alias("_hot"))
    rows = top.collect()
    return counts.sparkSession.createDataFrame(rows, top.schema) if rows else None


def skew_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner", hot: DataFrame | None | str = "find") -> DataFrame:
    """big join small on `key` (how: inner, left or left_semi), where any key may hold a large share of `big` and `small` has few rows a key.

    The rows of hot keys are spread over as many salts as there are partitions and their rows of `small` are repeated for each. A row's salt is a hash of
    the row, so a task that runs again gives every row the salt it had before.
    NULL keys of `big` match nothing; how="left" keeps them. hot: what hot_keys() gave for `big`, if known.
    """
    n = max(2, parts(big.sparkSession))
    if isinstance(hot, str):
        hot = hot_keys(big.groupBy(key).count(), key)
    if hot is None:
        return big.join(small, key, how)
    hot = F.broadcast(hot)
    spread = F.pmod(F.xxhash64(*[F.col(f"`{f.name}`") for f in big.schema.fields if "map<" not in f.dataType.simpleString()]), F.lit(n)).cast("int")
    left = big.join(hot, big[key] == F.col("_hot"), "left")
    left = left.withColumn("_salt", F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), F.lit(0)).otherwise(spread)).drop("_hot")
    right = small.join(hot, small[key] == F.col("_hot"), "left")
    salts = F.when(F.col("_hot").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(n - 1)))
    right = right.withColumn("_salt", F.explode(salts)).drop("_hot")
    return left.join(right, [key, "_salt"], how).drop("_salt")
