"""Command line: python -m quirelake.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import quirelake
from quirelake.functions import metrics, text
from quirelake.operators import client, engines, report, routing
from quirelake.operators import images as pictures
from quirelake.plans import book, cache
from quirelake.sources import config, epub, pdf, sinks

OCR_VERSION = "2"


def session() -> SparkSession:
    return SparkSession.builder.appName("quirelake").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def ingest(args: argparse.Namespace) -> None:
    """Read EPUB or PDF files into a page manifest and their pictures."""
    if not args.path.lower().endswith((".pdf", ".epub")):
        sys.exit("only .epub and .pdf files can be read")
    spark = session()
    files = epub.files(spark, args.path)
    if args.path.lower().endswith(".pdf"):
        pdf.pages(files, force_ocr=args.force_ocr).write.mode("overwrite").parquet(f"{args.out}/read")
        read = spark.read.parquet(f"{args.out}/read")
        pages, images = pdf.manifest(read, args.force_ocr), pdf.images(read)
    else:
        if args.force_ocr:
            print("--force-ocr is for PDF files and has no effect here")
        pages, images = epub.manifest(epub.documents(files), epub.covers(files)), epub.images(files)
    pages.write.mode("overwrite").partitionBy("book").parquet(f"{args.out}/pages")
    images.write.mode("overwrite").parquet(f"{args.out}/images")
    files.select("book", "path").write.mode("overwrite").parquet(f"{args.out}/sources")
    report.sparse_counts(spark.read.parquet(f"{args.out}/pages")).show()


def shown(spark: SparkSession, out: str, pages: DataFrame) -> DataFrame:
    """Pages joined with their pictures."""
    own = pages.withColumn("image", F.try_element_at("images", F.lit(1)))
    return own.join(spark.read.parquet(f"{out}/images"), ["book", "image"])


def recognised(work: DataFrame, name: str, cfg: config.Config, key: list[str], prepare: bool) -> DataFrame:
    """key columns and results of an engine, whose images are prepared first if asked for."""
    if prepare:
        work = engines.preprocess_images(work, lambda: pictures.prepared(cfg.preprocess))
    return engines.run_engine(work, lambda: engines.get_engine(name, cfg), key)


def ocr(args: argparse.Namespace) -> None:
    """Recognise the images of a manifest; what was recognised before is taken from the cache. Failures aren't kept there."""
    spark, cfg = session(), config.load(args.config)
    name = args.engine or cfg.engine
    pages = routing.recognised(spark.read.parquet(f"{args.out}/pages"))
    if args.limit:
        pages = report.first_pages(pages, args.limit)
    own = engines.get_engine(name, cfg)
    prepare = own.wants_preprocess and name not in ("fake", "fake-noisy") if args.preprocess is None else args.preprocess
    params = {"engine": own.identity(), "preprocess": cfg.preprocess if prepare else None}
    work = shown(spark, args.out, pages).withColumn("key", text.cache_key(F.col("content"), params, own.identity(), OCR_VERSION)).select("book", "index", "key", "content")
    found = cache.through_cache(work, f"{args.out}/cache", lambda w: recognised(w, name, cfg, ["key"], prepare), f"key string, {engines.RESULT}", force=args.force)
    sinks.write_ocr(sinks.screened(found.drop("content")), f"{args.out}/ocr")
    done = spark.read.parquet(f"{args.out}/ocr")
    report.recognition_summary(done).show()
    for r in done.where("error IS NOT NULL").select("book", "index", "error").orderBy("book", "index").limit(20).collect():
        print(f"{r.book}, page {r['index']}: {r.error}")


def ocr_page(args: argparse.Namespace) -> None:
    """Recognise one image file."""
    cfg = config.load(args.config)
    with open(args.path, "rb") as f:
        found = engines.get_engine(args.engine or cfg.engine, cfg).recognise(f.read())
    print(found.text, f"\nconfidence: {'n/a' if found.mean_conf is None else format(found.mean_conf, '.2f')}")


def evaluate(args: argparse.Namespace) -> None:
    """Score engines against gold texts of pages; one that can't start or fails on all pages is told with its error."""
    spark, cfg = session(), config.load(args.config)
    gold = config.read_gold(spark, args.gold)
    work = shown(spark, args.out, spark.read.parquet(f"{args.out}/pages")).join(gold, "index").select("book", "index", "gold_text", "content")
    scored, faults = None, []
    for name in filter(None, (x.strip() for x in args.engines.split(","))):
        try:
            prepare = engines.get_engine(name, cfg).wants_preprocess and not name.startswith("fake")
        except Exception as e:  # noqa: BLE001 - an engine that isn't there is part of the report
            faults.append({"engine": name, "error": f"init: {e}"})
            continue
        recognised(work, name, cfg, ["book", "index", "gold_text"], prepare).write.mode("overwrite").parquet(f"{args.out}/eval/engine={name}")
        read = spark.read.parquet(f"{args.out}/eval/engine={name}")
        failed = read.where("error IS NOT NULL").select("error").first()
        if failed and read.where("error IS NULL").isEmpty():
            faults.append({"engine": name, "error": f"run: {failed.error}"})
            continue
        one = read.where("error IS NULL").select(F.lit(name).alias("engine"), metrics.scores(F.col("gold_text"), F.col("text")).alias("s")).select("engine", "s.*")
        scored = one if scored is None else scored.unionAll(one)
    rows = [r.asDict() for r in report.engine_report(scored).orderBy("engine").collect()] if scored is not None else []
    print(report.report_table(rows + faults))


def rewritten(docs: DataFrame, cfg: config.Config, out: str, endpoint: str | None, model: str | None) -> DataFrame:
    """Rewrites of reflowable pages by a language model; those made before, by the same model and instructions, are taken from the cache."""
    end = cfg.endpoint(endpoint) if endpoint else cfg.role_endpoint("text_cleanup")
    model = model or cfg.model("text_xhtml")
    key = text.cache_key(F.col("text"), {"endpoint": end.name}, model, client.CLEANUP_VERSION)
    work = docs.where("mode = 'reflowable'").select("book", "index", "text", key.alias("key"))

    def ask() -> object:
        chat = client.Chat(end)
        return lambda page: chat.cleanup(model, page)

    return book.rewrites(cache.through_cache(work, f"{out}/cache", lambda w: engines.rewrite(w, ask, ["key"]), "key string, candidate string, error string", "cleanup"))


def build(args: argparse.Namespace) -> None:
    """Route pages, clean their text and write a book of each."""
    spark, cfg = session(), config.load(args.config)
    pages, ocr = spark.read.parquet(f"{args.out}/pages"), spark.read.parquet(f"{args.out}/ocr")
    docs = book.reading(pages, ocr)
    if args.llm:
        docs = book.judged(docs, rewritten(docs, cfg, args.out, args.cleanup_endpoint, args.cleanup_model), cfg.fidelity)
    docs.write.mode("overwrite").parquet(f"{args.out}/docs")
    docs = spark.read.parquet(f"{args.out}/docs")
    names = pages.where("size(extracted_images) > 0").select("book", F.col("images")[0].alias("image"), F.col("extracted_images")[0].alias("name"))
    images = spark.read.parquet(f"{args.out}/images").join(names, ["book", "image"]).select("book", "name", "content")
    sources = spark.read.parquet(f"{args.out}/sources")
    sinks.save(book.written(docs, images, book.titles(pages, sources, args.title), args.language), f"{args.out}/output")
    routing.structural_checks(pages, sources).show(truncate=False)
    report.routing_summary(docs).show()


def endpoints(cfg: config.Config) -> None:
    """The models that each endpoint names, or why it can't be reached."""
    for e in cfg.endpoints.values():
        print(f"[{e.name}] {e.url}")
        try:
            print(*(f"  {x}" for x in client.Chat(e).models()), sep="\n")
        except Exception as x:  # noqa: BLE001 - whatever keeps it from answering is the answer
            print(f"  not reached: {type(x).__name__}: {x}")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quirelake", description=quirelake.__doc__)
    parser.add_argument("--config")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("version")
    commands.add_parser("show-config")
    commands.add_parser("endpoints")
    one = commands.add_parser("ocr-page")
    one.add_argument("path")
    one.add_argument("--engine")
    for name in ("ingest", "ocr", "eval", "build"):
        sub = commands.add_parser(name)
        sub.add_argument("--out", required=True, help="folder of the tables of the books")
        if name == "ingest":
            sub.add_argument("path")
            sub.add_argument("--force-ocr", action="store_true")
        if name == "ocr":
            sub.add_argument("--engine")
            sub.add_argument("--limit", type=int)
            sub.add_argument("--force", action="store_true", help="recognise all pages again")
            sub.add_argument("--preprocess", action=argparse.BooleanOptionalAction, help="prepare images, else as the engine wants it")
        if name == "eval":
            sub.add_argument("--gold", required=True)
            sub.add_argument("--engines", default="vlm")
        if name == "build":
            sub.add_argument("--llm", action=argparse.BooleanOptionalAction, default=False, help="rewrite pages by a language model, behind the check of fidelity")
            sub.add_argument("--title")
            sub.add_argument("--language", default="en")
            sub.add_argument("--cleanup-endpoint")
            sub.add_argument("--cleanup-model")
    args = parser.parse_args(argv)
    if args.command == "version":
        print(quirelake.__version__)
    elif args.command == "show-config":
        print(json.dumps(asdict(config.load(args.config)), indent=2, ensure_ascii=False))
    elif args.command == "endpoints":
        endpoints(config.load(args.config))
    else:
        {"ingest": ingest, "ocr": ocr, "ocr-page": ocr_page, "eval": evaluate, "build": build}[args.command](args)


if __name__ == "__main__":
    main()
