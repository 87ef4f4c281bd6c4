"""Pages that land in a folder, taken up incrementally.

Only operators that look at one page at a time are used; finding the running
lines of a book needs all of its pages and isn't done on a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quirelake.functions import metrics, text

PAGES = "book string, index int, text string"


def landed(spark: SparkSession, path: str, schema: str = PAGES) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).parquet(path)


def screened(pages: DataFrame) -> DataFrame:
    """Pages with repetition_ratio, degenerate and the cleaned text, which is empty if the page is degenerate."""
    ratio = metrics.repetition_ratio(F.col("text"))
    marked = pages.withColumn("repetition_ratio", ratio).withColumn("degenerate", metrics.is_degenerate(F.col("repetition_ratio")))
    return marked.withColumn("text", F.when(F.col("degenerate"), F.lit("")).otherwise(text.clean_page(F.col("text"))))


def take_up(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Screen everything that has landed since the last call and append it."""
    return screened(landed(spark, source)).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
