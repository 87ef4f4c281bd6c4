"""Summaries: pages by type, engines by error, variants of preparation, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.operators.routing import CONF_FLOOR, PAGE_TYPES

AGREE_FLOOR = 0.85


def type_counts(pages: DataFrame, by: str = "book") -> DataFrame:
    """A column a page type, zero where there are none."""
    return pages.groupBy(by).agg(*(F.count_if(F.col("type") == t).alias(t) for t in PAGE_TYPES))


def sparse_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("type").agg(F.count("*").alias("n")).orderBy("type")


def routing_summary(docs: DataFrame, by: str = "book") -> DataFrame:
    """docs, reflowable, facsimile, preserved and held; held pages are reflowable ones too."""
    modes = [F.count_if(F.col("mode") == m).alias(m) for m in ("reflowable", "facsimile", "preserved")]
    held = F.count_if(F.col("held")) if "held" in docs.columns else F.lit(0).cast("long")
    return docs.groupBy(by).agg(F.count("*").alias("docs"), *modes, held.alias("held"))


def mean_confidence(words: Column) -> Column:
    """Mean of the known confidences of an array of words; null if none is known."""
    known = F.filter(F.transform(words, lambda w: w["conf"]), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known))


def means(rows: DataFrame, column: str, by: str) -> DataFrame:
    """Mean of the known values, mean with unknown ones as zero, and how many are unknown: the first alone flatters an engine that gives up."""
    c = F.col(column)
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(c).alias("mean"), F.avg(F.coalesce(c, F.lit(0.0))).alias("mean_all"), F.count_if(c.isNull()).alias("unknown"))


def engine_report(scores: DataFrame) -> DataFrame:
    """n and mean errors by engine; best marks every engine of the least mean cer."""
    own = scores.groupBy("engine").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in ("cer", "wer", "insertion_rate")))
    best = F.col("cer") == F.min("cer").over(Window.partitionBy())
    return own.withColumn("best", F.coalesce(best, F.lit(False)))


def trusted(confidence: Column, has_challenger: Column, agreement: Column) -> Column:
    sure = F.coalesce(confidence >= CONF_FLOOR, F.lit(False))
    return sure | (has_challenger & (F.coalesce(agreement, F.lit(0.0)) >= AGREE_FLOOR))


def variant_report(rows: DataFrame, variants: tuple[str, ...] = ("raw", "contrast", "binarize")) -> DataFrame:
    """By variant: mean confidence, pages at the floor, mean agreement, trusted pages.

    rows have <variant>_conf, <variant>_agree and has_challenger.
    """
    each = F.array(*(F.struct(F.lit(v).alias("variant"), F.col(f"{v}_conf").alias("conf"), F.col(f"{v}_agree").alias("agree")) for v in variants))
    long = rows.select("has_challenger", F.explode(each).alias("v")).select("has_challenger", "v.*")
    sure = F.count_if(trusted(F.col("conf"), F.col("has_challenger"), F.col("agree")))
    return long.groupBy("variant").agg(
        F.count("*").alias("n"), F.avg("conf").alias("mean_conf"), F.count_if(F.col("conf") >= CONF_FLOOR).alias("at_floor"), F.avg("agree").alias("mean_agree"), sure.alias("trusted")
    )


def recognition_summary(ocr: DataFrame, by: str = "book") -> DataFrame:
    return ocr.groupBy(by).agg(F.count("*").alias("total"), F.count_if("cached").alias("cached"), F.count_if("degenerate").alias("degenerate"))


def first_pages(pages: DataFrame, n: int) -> DataFrame:
    """The first n pages of each book in reading order."""
    order = Window.partitionBy("book").orderBy("index")
    return pages.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= n).drop("_nth")


def stride_sample(pages: DataFrame, n: int, by: str = "book", order: str = "index") -> DataFrame:
    """n rows of each group, evenly spread: those at floor(i * (rows / n)) for i < n, in double arithmetic; all if there are no more."""
    own = Window.partitionBy(by)
    rows = F.count("*").over(own)
    at = F.row_number().over(own.orderBy(order)) - 1
    numbered = pages.withColumn("_rows", rows).withColumn("_at", at)
    spots = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.col("_rows") / F.lit(float(n)))))
    return numbered.where((F.col("_rows") <= n) | F.array_contains(spots, F.col("_at").cast("long"))).drop("_rows", "_at")


def sub_stride(sample: DataFrame, n: int, by: str = "book", order: str = "index") -> DataFrame:
    """Every max(1, rows // n)-th row of each group; may be more than n."""
    own = Window.partitionBy(by)
    numbered = sample.withColumn("_step", F.greatest(F.lit(1), F.floor(F.count("*").over(own) / n))).withColumn("_at", F.row_number().over(own.orderBy(order)) - 1)
    return numbered.where("_at % _step = 0").drop("_step", "_at")


def first_of_name(pages: DataFrame, name: str, order: str = "index") -> DataFrame:
    """Of rows with one name, the first."""
    return pages.withColumn("_nth", F.row_number().over(Window.partitionBy(name).orderBy(order))).where("_nth = 1").drop("_nth")


def report_table(rows: list[dict]) -> str:
    """Engines (engine, n, cer, wer, insertion_rate, best or error) as lines of fixed width, on the driver."""
    shown = lambda x: " n/a " if x is None else f"{x:.3f}"
    out = [f"{'engine':11s} |  n | {'CER':5s} | {'WER':5s} | insert | note", "-+-".join("-" * n for n in (11, 2, 5, 5, 6, 4))]
    for r in rows:
        note = r.get("error") or ("best" if r.get("best") else "")
        out.append(f"{r['engine']:11s} | {r.get('n', 0):>2} | {shown(r.get('cer'))} | {shown(r.get('wer'))} | {shown(r.get('insertion_rate')):6s} | {note}")
    return "\n".join(out)
