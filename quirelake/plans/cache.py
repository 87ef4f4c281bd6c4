"""Content-addressed results: compute what isn't there, keep it, read the rest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hits(work: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Work with its cached results; results of work that has none are null."""
    return work.join(cache.dropDuplicates([key]), key, "left")


def misses(work: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Work without a cached result, once a key."""
    return work.dropDuplicates([key]).join(cache, key, "left_anti")


def through_cache(work: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame], schema: str, stage: str = "ocr", key: str = "key", force: bool = False) -> DataFrame:
    """Results of all work, and whether each was cached; what is missing at ``path`` is computed and written there first.

    compute maps rows of work to rows of schema, which has the key and may have
    an error. Finished parts of a run that broke off are found again by their
    keys. Rows with an error are given, but the next run tries them again. force
    computes all work anew; of several results of one key the last run's counts.
    """
    spark = work.sparkSession
    folder = f"{path}/stage={stage}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(folder)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    runs = sorted(int(x.getPath().getName().split("=")[1]) for x in files.listStatus(target) if x.getPath().getName().startswith("run=")) if files.exists(target) else []
    now = runs[-1] + 1 if runs else 0

    def read() -> DataFrame:
        return spark.read.schema(f"{schema}, run int").parquet(folder)

    if runs:
        good = read()
        if "error" in good.columns:
            good = good.where("error IS NULL")
        todo = work.dropDuplicates([key]) if force else misses(work, good.select(key).distinct(), key)
    else:
        todo = work.dropDuplicates([key])
    compute(todo).write.mode("overwrite").parquet(f"{folder}/run={now}")
    every = read()
    # an error gives way to any result, an older result to a later one
    order = [F.col("error").isNull().desc(), F.col("run").desc()] if "error" in every.columns else [F.col("run").desc()]
    last = every.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_nth = 1").drop("_nth")
    return hits(work, last.withColumn("cached", F.col("run") < now).drop("run"), key)
