"""All queries of the engine over the driver's tables, and the SQL that they are held against.

Pages are made of documents: a source is a book, doc_id the reading order. Type,
confidence and the like, which no table has, are derived from doc_id by
expressions that mean the same to Spark and DuckDB.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelake.functions import metrics, text
from quirelake.functions.unicode import ALNUM, DIGITS, WORD, WS
from quirelake.operators import engines, layout, markup, render, report, routing, structure
from quirelake.plans import book, cache, durable
from quirelake.sources import config, epub, sinks

FLAGSHIP = "n7_repetition"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

KIND = "CASE WHEN doc_id % 97 = 0 THEN 'cover' WHEN doc_id % 35 = 3 THEN 'empty' WHEN doc_id % 5 = 1 THEN 'text' WHEN doc_id % 5 = 2 THEN 'mixed' ELSE 'image' END"
CONF = "CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(doc_id % 101 AS DOUBLE) / 100 END"
SAID = "CASE WHEN doc_id % 13 = 0 THEN '  ' WHEN doc_id % 13 = 1 THEN ' ' || text || chr(10) ELSE text END"
PAGES_SQL = f"""pages_ AS (
  SELECT doc_id, source AS book, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS index,
    {KIND} AS type, {CONF} AS conf, {SAID} AS said, text FROM documents)"""
#: Documents with paragraphs, line breaks and divided words of the kinds that pages have.
BROKEN = "replace(replace(text, '. ', '.' || chr(10) || chr(10)), 'tion', 'ti-' || chr(10) || 'on')"
TRIMMED = lambda x: f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"
NORM = lambda x: f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"
TOKENS = lambda x: f"list_transform(regexp_extract_all({x}, '{ALNUM}+'), lambda t: lower(t))"


def query(name: str, sql: str | None = None):
    """Registers a query and its SQL, in which count_if may nest at one level of brackets and counts as BIGINT."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = re.sub(r"count_if\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)", r"count(*) FILTER (WHERE \1)", sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("source").orderBy("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("book"), (F.row_number().over(order) - 1).alias("index"), F.expr(KIND).alias("type"), F.expr(CONF).alias("conf"), F.expr(SAID).alias("said"), "text"
    )


def ascii_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items with the next one, where both are ASCII: there DuckDB's edit distance is Spark's."""
    b = table(spark, sf_dir, "benchmark").where(~F.col("text").rlike("[^\\x00-\\x7f]"))
    return b.select("item_id", F.col("text").alias("a"), F.lead("text").over(Window.orderBy("item_id")).alias("b")).where("b IS NOT NULL")


ASCII_SQL = "pairs AS (SELECT * FROM (SELECT item_id, text AS a, lead(text) OVER (ORDER BY item_id) AS b FROM benchmark WHERE NOT regexp_matches(text, '[^\\x00-\\x7f]')) WHERE b IS NOT NULL)"


def each(name: str, source: str, key: str, column: str, f: Callable[[Column], Column], sql: Callable[[str], str], given: str = "text") -> None:
    """A query that maps one text column, and its SQL."""
    query(name, f"SELECT {key}, {sql(given)} AS {column} FROM {source}")(lambda spark, sf_dir: table(spark, sf_dir, source).select(key, f(F.expr(given)).alias(column)))


def sql_lines(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda l: {TRIMMED('l')}), lambda l: l <> '')"


def sql_rejoin(x: str) -> str:
    """Without look-behind: blank lines become chr(1), a break not after a stop becomes a space."""
    x = f"regexp_replace({x}, '(?m)^[ \\t]+|[ \\t]+$', '', 'g')"
    x = f"trim(regexp_replace({x}, '\\n{{2,}}', chr(1), 'g'), chr(1) || chr(10))"
    x = f"regexp_replace({x}, '([^.!?\"''’”)\\]\\x01\\n])\\n', '\\1 ', 'g')"
    return f"replace({x}, chr(1), chr(10) || chr(10))"


def sql_dehyphenate(x: str) -> str:
    return f"regexp_replace({x}, '({WORD}+)-\\n({WORD}+)', '\\1\\2', 'g')"


def sql_escape(x: str) -> str:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{char}', '{entity}')"
    return x


def sql_markup_text(x: str) -> str:
    x = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for entity, char in text.ENTITIES:
        x = f"replace({x}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return NORM(x)


#: Texts of which every ninth repeats its first word.
STUCK = "CASE WHEN doc_id % 9 = 4 THEN repeat(substr(text, 1, 6) || ' ', 40) ELSE text END"


def sql_rate(edits: str, a: str, b: str) -> str:
    return f"CASE WHEN {a} = 0 THEN CASE WHEN {b} = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END ELSE ({edits})::DOUBLE / {a} END"


def sql_cer(a: str, b: str) -> str:
    a, b = NORM(a), NORM(b)
    return sql_rate(f"levenshtein({a}, {b})", f"length({a})", f"length({b})")


def sql_delta(a: str, b: str) -> str:
    a, b = f"length({NORM(a)})", f"length({NORM(b)})"
    return sql_rate(f"abs({b} - {a})", a, b)


def sql_insertion(a: str, b: str) -> str:
    x, y = TOKENS(a), TOKENS(b)
    each_token = f"list_transform(list_distinct({y}), lambda t: greatest(0, len(list_filter({y}, lambda u: u = t)) - len(list_filter({x}, lambda u: u = t))))"
    return f"CASE WHEN len({y}) = 0 THEN 0.0::DOUBLE ELSE list_sum({each_token})::DOUBLE / len({y}) END"


# ---- text functions

each("n1_norm_ws", "documents", "doc_id", "norm", text.norm_ws, NORM)
each("n2_tokens", "documents", "doc_id", "tokens", lambda c: F.array_join(text.tokens(c), " "), lambda x: f"array_to_string({TOKENS(x)}, ' ')")
each("n10_dehyphenate", "documents", "doc_id", "joined", text.dehyphenate, sql_dehyphenate, BROKEN)
each("n11_rejoin_paragraphs", "documents", "doc_id", "joined", text.rejoin_paragraphs, sql_rejoin, BROKEN)
each("n12_clean_page", "documents", "doc_id", "clean", text.clean_page, lambda x: sql_rejoin(sql_dehyphenate(x)), BROKEN)
each("n13_digits_as_hash", "documents", "doc_id", "masked", text.digits_as_hash, lambda x: f"regexp_replace({x}, '{DIGITS}', '#', 'g')")
each("n14_lines", "documents", "doc_id", "lines", lambda c: F.array_join(text.lines(c), "|"), lambda x: f"array_to_string({sql_lines(x)}, '|')")
each("n15_without_inline_tags", "pages", "page_id", "plain", text.without_inline_tags, lambda x: TRIMMED(f"regexp_replace({x}, '</?[a-zA-Z][^>]*>', '', 'g')"), "html")
each("n16_markup_text", "pages", "page_id", "plain", text.markup_text, sql_markup_text, "html")
each("n16_markup_text_all", "pages", "page_id", "plain", text.markup_text_all, lambda x: sql_markup_text(f"replace(replace({x}, '&copy;', '©'), '&middot;', '·')"), "html")
each("n17_escape", "pages", "page_id", "escaped", text.escape, sql_escape, "html")
each("n19_content_hash", "documents", "doc_id", "hash", text.content_hash, lambda x: f"substr(sha256({x}), 1, 16)")
each("n20_cache_key", "documents", "doc_id", "key", lambda c: text.cache_key(c, {"dpi": 300, "b": [1]}, "m", "v2"), lambda x: "substr(sha256(" + x + """ || '{"b": [1], "dpi": 300}mv2'), 1, 16)""")
each("n21_format_score", "events", "event_id", "shown", text.format_score, lambda x: f"coalesce(format('{{:.2f}}', {x}), 'n/a')", "CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id % 4001 - 1000 AS DOUBLE) / 1000 END")
each("n22_media_type", "pages", "page_id", "kind", text.media_type, lambda x: f"CASE page_id % 4 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/svg+xml' WHEN 2 THEN 'image/png' ELSE 'image/gif' END", "url || '/a.b/c' || CASE page_id % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN '.svg' WHEN 2 THEN '' ELSE '.x.gif' END")
each("n23_data_url", "documents", "doc_id", "url", lambda c: text.data_url(c, F.lit("a.jpg")), lambda x: f"'data:image/jpeg;base64,' || to_base64(encode({x}))", "substr(text, 1, 300)")
each("s11_text_length", "documents", "doc_id", "n", lambda c: F.length(text.norm_ws(c)), lambda x: f"CAST(length({NORM(x)}) AS INTEGER)")
each("s20_slug", "pages", "page_id", "slug", text.slug, lambda x: f"coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_extract({x}, '[^/]*$'), '^(.+)\\.[^.]*$', '\\1'), '[^a-zA-Z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'book')", "url || '.book (2).epub'")
each("r3_output_name", "pages", "page_id", "name", lambda c: routing.output_name(F.col("page_id").cast("int"), c), lambda x: f"'page_' || lpad(CAST(page_id + 1 AS VARCHAR), CAST(greatest(4, length(CAST(page_id + 1 AS VARCHAR))) AS INTEGER), '0') || '_' || regexp_extract({x}, '[^/]*$')", "url")
each("c7_paragraphs_to_xhtml", "documents", "doc_id", "xhtml", structure.paragraphs_to_xhtml, lambda x: f"coalesce(nullif(array_to_string(list_transform(list_filter(list_transform(string_split({x}, chr(10) || chr(10)), lambda p: {TRIMMED('p')}), lambda p: p <> ''), lambda p: '<p>' || {sql_escape('p')} || '</p>'), chr(10)), ''), '<p></p>')", BROKEN)
each("w5_edge_lines", "documents", "doc_id", "edges", lambda c: F.concat(text.first_line(c), F.lit("|"), text.last_line(c)), lambda x: f"array_to_string([list_extract({sql_lines(x)}, 1), list_extract({sql_lines(x)}, -1)], '|')")
each("t1_edge_candidates", "documents", "doc_id", "edges", lambda c: F.array_join(layout.edge_lines(c), "|"), lambda x: f"array_to_string(list_transform(CASE WHEN len({sql_lines(x)}) = 0 THEN [] WHEN list_extract({sql_lines(x)}, 1) = list_extract({sql_lines(x)}, -1) THEN [list_extract({sql_lines(x)}, 1)] ELSE [list_extract({sql_lines(x)}, 1), list_extract({sql_lines(x)}, -1)] END, lambda l: regexp_replace(l, '{DIGITS}', '#', 'g')), '|')")


# ---- measures and verdicts

@query("n3_cer", f"WITH {ASCII_SQL} SELECT item_id, {sql_cer('a', 'b')} AS cer FROM pairs")
def n3_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ascii_pairs(spark, sf_dir).select("item_id", metrics.cer(F.col("a"), F.col("b")).alias("cer"))


def sql_wer(x: str, y: str, v: str) -> str:
    """Of word lists x and y, whose words are at most 90 and in the list v: each as an ASCII character."""
    coded = lambda w: f"array_to_string(list_transform({w}, lambda w: chr(CAST(31 + list_position({v}, w) AS INTEGER))), '')"
    return sql_rate(f"levenshtein({coded(x)}, {coded(y)})", f"len({x})", f"len({y})")


def few_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of at most 90 distinct words, which DuckDB can write as ASCII."""
    a, b = text.split_ws(F.col("a")), text.split_ws(F.col("b"))
    return ascii_pairs(spark, sf_dir).where(F.size(F.array_distinct(F.concat(a, b))) <= 90)


@query(
    "n4_wer",
    f"""WITH {ASCII_SQL}, split AS (SELECT item_id, string_split({NORM('a')}, ' ') AS x, string_split({NORM('b')}, ' ') AS y FROM pairs),
    coded AS (SELECT item_id, list_distinct(list_concat(x, y)) AS v, x, y FROM split) SELECT item_id, {sql_wer('x', 'y', 'v')} AS wer FROM coded WHERE len(v) <= 90""",
)
def n4_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return few_words(spark, sf_dir).select("item_id", metrics.wer(F.col("a"), F.col("b")).alias("wer"))


PAIRED_SQL = "paired AS (SELECT * FROM (SELECT doc_id, text AS a, lead(text) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM documents) WHERE b IS NOT NULL)"


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the next one of their source, spread again after that, since a source may have a third of them."""
    order = Window.partitionBy("source").orderBy("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("a"), F.lead("text").over(order).alias("b")).where("b IS NOT NULL").repartition("doc_id")


INSERTION_SQL = f"""WITH {PAIRED_SQL}, have AS (SELECT doc_id, t, count(*) AS k FROM (SELECT doc_id, unnest({TOKENS('b')}) AS t FROM paired) GROUP BY doc_id, t),
    had AS (SELECT doc_id, t, count(*) AS k FROM (SELECT doc_id, unnest({TOKENS('a')}) AS t FROM paired) GROUP BY doc_id, t),
    rates AS (SELECT doc_id, sum(greatest(0, have.k - coalesce(had.k, 0)))::DOUBLE / sum(have.k)::DOUBLE AS r FROM have LEFT JOIN had USING (doc_id, t) GROUP BY doc_id)
    SELECT doc_id, coalesce(r, 0.0::DOUBLE) AS insertion_rate FROM paired LEFT JOIN rates USING (doc_id)"""


@query("n5_insertion_rate", INSERTION_SQL)
def n5_insertion_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired(spark, sf_dir).select("doc_id", metrics.insertion_rate(F.col("a"), F.col("b")).alias("insertion_rate"))


@query("n5_insertion_rate_grouped", INSERTION_SQL)
def n5_insertion_rate_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For texts too long to compare within a row."""
    return metrics.insertion_rates(paired(spark, sf_dir), "doc_id", "a", "b")


@query("n6_length_delta", f"WITH {PAIRED_SQL} SELECT doc_id, {sql_delta('a', 'b')} AS length_delta FROM paired")
def n6_length_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired(spark, sf_dir).select("doc_id", metrics.length_delta(F.col("a"), F.col("b")).alias("length_delta"))


REPETITION_SQL = f"""tok AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest({TOKENS('text')}) AS t FROM documents) GROUP BY doc_id, t),
    rep AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_tokens, max(n) AS top FROM tok GROUP BY doc_id),
    ratios AS (SELECT doc_id, source, coalesce(n_tokens, 0) AS n_tokens, CASE WHEN n_tokens >= 20 THEN top::DOUBLE / n_tokens ELSE 0.0::DOUBLE END AS repetition_ratio
      FROM documents LEFT JOIN rep USING (doc_id))"""


@query("n7_repetition", f"WITH {REPETITION_SQL} SELECT doc_id, n_tokens, repetition_ratio, repetition_ratio > 0.35 AS degenerate FROM ratios")
def n7_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", metrics.repetition(F.col("text")).alias("r"))
    return own.select("doc_id", "r.n_tokens", F.col("r.ratio").alias("repetition_ratio"), metrics.is_degenerate(F.col("r.ratio")).alias("degenerate"))


@query("n7_repetition_grouped", f"WITH {REPETITION_SQL} SELECT doc_id, n_tokens, repetition_ratio, repetition_ratio > 0.35 AS degenerate FROM ratios")
def n7_repetition_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For texts too long to sort within a row."""
    own = metrics.repetition_ratios(table(spark, sf_dir, "documents"), "doc_id", "text")
    return own.withColumn("degenerate", metrics.is_degenerate(F.col("repetition_ratio")))


STUCK_SQL = f"""said AS (SELECT doc_id, source, {STUCK} AS text FROM documents), {REPETITION_SQL.replace("FROM documents LEFT", "FROM said LEFT").replace("t FROM documents)", "t FROM said)")}"""


@query(
    "r5_degeneracy_gate",
    f"""WITH {STUCK_SQL} SELECT source, count(*) AS docs, count_if(repetition_ratio > 0.35) AS degenerate, CAST(sum(CASE WHEN repetition_ratio > 0.35 THEN 0 ELSE length(text) END) AS BIGINT) AS kept_chars
    FROM ratios JOIN said USING (doc_id, source) GROUP BY source""",
)
def r5_degeneracy_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.expr(STUCK)
    own = table(spark, sf_dir, "documents").select("source", said.alias("text"), metrics.repetition_ratio(said).alias("ratio"))
    return own.groupBy("source").agg(
        F.count("*").alias("docs"), F.count_if(metrics.is_degenerate(F.col("ratio"))).alias("degenerate"), F.sum(F.length(metrics.gated(F.col("text"), F.col("ratio")))).alias("kept_chars")
    )


@query(
    "n8_scores",
    f"""WITH {ASCII_SQL}, coded AS (SELECT item_id, a, b, string_split({NORM('a')}, ' ') AS x, string_split({NORM('b')}, ' ') AS y, list_distinct(list_concat(string_split({NORM('a')}, ' '), string_split({NORM('b')}, ' '))) AS v FROM pairs)
    SELECT item_id, {sql_cer('a', 'b')} AS cer, {sql_wer('x', 'y', 'v')} AS wer, {sql_insertion('a', 'b')} AS insertion_rate FROM coded WHERE len(v) <= 90""",
)
def n8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of at most 90 distinct words, as in n4_wer."""
    s = metrics.scores(F.col("a"), F.col("b"))
    return few_words(spark, sf_dir).select("item_id", s["cer"].alias("cer"), s["wer"].alias("wer"), s["insertion_rate"].alias("insertion_rate"))


@query(
    "n9_agreement",
    f"""WITH own AS (SELECT item_id, list_sort({TOKENS('text')}) AS x, list_sort(list_slice({TOKENS('text')}, 1, len({TOKENS('text')}) // 2)) AS y FROM benchmark),
    said AS (SELECT item_id, length(array_to_string(x, ' ')) AS n, length(array_to_string(y, ' ')) AS m FROM own)
    SELECT item_id, CASE WHEN n = m THEN 1.0::DOUBLE WHEN n = 0 OR m = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * m / (n + m) END AS agreement FROM said""",
)
def n9_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With half of a text's tokens, in reverse: in order, they are a subsequence of all of them, whose length SQL knows."""
    own = text.tokens(F.col("text"))
    half = F.array_join(F.reverse(F.slice(own, F.lit(1), (F.size(own) / 2).cast("int"))), " ! ")
    return table(spark, sf_dir, "benchmark").select("item_id", metrics.agreement(F.col("text"), half).alias("agreement"))


@query(
    "r8_fidelity_verdict",
    f"""WITH {ASCII_SQL}, own AS (SELECT item_id, a, CASE WHEN item_id % 3 = 0 THEN a ELSE substr(a, 1, 150) || ' ' || substr(b, 1, 20) END AS c FROM pairs),
    m AS (SELECT item_id, {sql_cer('a', 'c')} AS cer, {sql_insertion('a', 'c')} AS insertion, {sql_delta('a', 'c')} AS length_delta FROM own)
    SELECT *, cer <= 0.15 AND insertion <= 0.05 AND length_delta <= 0.2 AS ok, concat_ws(',', CASE WHEN cer > 0.15 THEN 'cer' END, CASE WHEN insertion > 0.05 THEN 'insertion' END, CASE WHEN length_delta > 0.2 THEN 'length_delta' END) AS reasons FROM m""",
)
def r8_fidelity_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates are markup with named and numeric entities."""
    own = ascii_pairs(spark, sf_dir).withColumn("c", F.expr("CASE WHEN item_id % 3 = 0 THEN a ELSE substr(a, 1, 150) || ' ' || substr(b, 1, 20) END"))
    marked = F.replace(F.replace(F.col("c"), F.lit(" "), F.lit("&nbsp;")), F.lit("a"), F.lit("&#97;"))
    v = own.select("item_id", metrics.verdict(F.col("a"), F.concat(F.lit("<p>"), marked, F.lit("</p>"))).alias("v"))
    return v.select("item_id", "v.cer", "v.insertion", "v.length_delta", "v.ok", F.array_join("v.reasons", ",").alias("reasons"))


AGREE = "CASE WHEN doc_id % 6 = 0 THEN NULL ELSE CAST(doc_id % 64 AS DOUBLE) / 64 END"
SURE = "CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(doc_id % 32 AS DOUBLE) / 32 END"


@query(
    "r9_consensus",
    f"""WITH s AS (SELECT doc_id, {AGREE} AS g, {SURE} AS c FROM documents)
    SELECT doc_id, coalesce(g >= 0.85, false) OR coalesce(c >= 0.8, false) AS trusted,
      CASE WHEN g >= 0.85 THEN 'agreement ' || format('{{:.2f}}', g) WHEN c >= 0.8 THEN 'confidence ' || format('{{:.2f}}', c)
      ELSE 'agreement ' || coalesce(format('{{:.2f}}', g), 'n/a') || ', confidence ' || coalesce(format('{{:.2f}}', c), 'n/a') END AS reason FROM s""",
)
def r9_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "documents").select("doc_id", metrics.consensus(F.expr(AGREE), F.expr(SURE)).alias("v"))
    return v.select("doc_id", "v.trusted", "v.reason")


# ---- routing

@query("r4_recognised", f"WITH {PAGES_SQL} SELECT book, index, type FROM pages_ WHERE type IN ('image', 'cover')")
def r4_recognised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.recognised(page_table(spark, sf_dir)).select("book", "index", "type")


ROUTED_SQL = f"""{PAGES_SQL}, routed_ AS (
  SELECT book, index, type, CASE WHEN type = 'cover' THEN 'facsimile' WHEN type = 'image' THEN CASE WHEN {TRIMMED('said')} <> '' AND (conf IS NULL OR conf >= 0.8) THEN 'reflowable' ELSE 'facsimile' END ELSE 'preserved' END AS mode,
    CASE WHEN type <> 'cover' THEN CAST(sum(CASE WHEN type IN ('empty', 'cover') THEN 0 ELSE 1 END) OVER (PARTITION BY book ORDER BY index) AS BIGINT) ELSE -1 END AS page_number, said, conf
  FROM pages_)"""


def routed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = page_table(spark, sf_dir)
    ocr = own.where("type = 'image'").select("book", "index", F.col("said").alias("text"), F.col("conf").alias("mean_conf"))
    return routing.routed(own, ocr)


@query("r6_build_routing", f"WITH {ROUTED_SQL} SELECT book, index, type, mode, CASE WHEN type = 'cover' THEN 'Cover' ELSE 'Page ' || page_number END AS title, CASE WHEN type = 'image' AND mode = 'facsimile' AND {TRIMMED('said')} <> '' THEN {TRIMMED('said')} END AS ocr_text FROM routed_ WHERE type <> 'empty'")
def r6_build_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed_pages(spark, sf_dir).select("book", "index", "type", "mode", "title", "ocr_text")


@query("w2_page_numbers", f"WITH {ROUTED_SQL} SELECT book, index, CASE WHEN type IN ('empty', 'cover') THEN 0 ELSE page_number END AS page_number FROM routed_")
def w2_page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.page_numbers(page_table(spark, sf_dir)).select("book", "index", F.coalesce("page_number", F.lit(0)).alias("page_number"))


@query("r7_choose_mode", f"WITH {PAGES_SQL} SELECT doc_id, CASE WHEN type = 'cover' OR doc_id % 4 = 0 OR coalesce(conf < 0.8, false) THEN 'facsimile' ELSE 'reflowable' END AS mode FROM pages_")
def r7_choose_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_table(spark, sf_dir).select("doc_id", routing.choose_mode(F.col("type"), F.col("conf"), F.expr("doc_id % 4 = 0")).alias("mode"))


@query("r10_trusted", f"SELECT doc_id, coalesce({CONF} >= 0.8, false) OR (doc_id % 3 > 0 AND coalesce({AGREE}, 0) >= 0.85) AS trusted FROM documents")
def r10_trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", report.trusted(F.expr(CONF), F.expr("doc_id % 3 > 0"), F.expr(AGREE)).alias("trusted"))


@query("r11_fallback", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN upper(lang) ELSE source END AS body FROM documents")
def r11_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", routing.fallback(F.expr("CASE WHEN doc_id % 3 < 2 THEN doc_id % 3 = 0 END"), F.upper("lang"), F.col("source")).alias("body"))


@query("r12_body_source", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN lang WHEN 2 THEN lang ELSE '<p></p>' END AS body FROM documents")
def r12_body_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.expr("CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN '' END")
    return table(spark, sf_dir, "documents").select("doc_id", routing.body_source(given, F.expr("CASE WHEN doc_id % 4 < 3 THEN lang END")).alias("body"))


@query("r13_title", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'given' WHEN 1 THEN 'my.book' WHEN 2 THEN 'scan' ELSE 'book' END AS title FROM pages")
def r13_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda k, x: F.expr(f"CASE WHEN page_id % 4 = {k} THEN '{x}' ELSE '' END")
    return table(spark, sf_dir, "pages").select("page_id", routing.title(at(0, "given"), at(1, "a/my.book.epub"), at(2, "b/scan.pdf")).alias("title"))


IMAGES = "CASE page_id % 4 WHEN 0 THEN array() WHEN 1 THEN array('img/cover.jpg') WHEN 2 THEN array('img/a.png', 'img/b.png') ELSE array('img/z.gif') END"
THERE = "CASE page_id % 4 WHEN 0 THEN array() WHEN 2 THEN array(page_id % 3 > 0, page_id % 5 > 0) ELSE array(page_id % 11 > 0) END"
IMAGES_SQL, THERE_SQL = (re.sub(r"array\(([^()]*)\)", r"[\1]", x).replace("[]", f"CAST([] AS {kind}[])") for x, kind in ((IMAGES, "VARCHAR"), (THERE, "BOOLEAN")))
HREF = "CASE page_id % 3 WHEN 0 THEN 'text/Cover.xhtml' WHEN 1 THEN 'text/p' || page_id || '.xhtml' ELSE 'TitlePage.xhtml' END"
LENGTH = "CAST(CASE page_id % 5 WHEN 0 THEN 5 WHEN 1 THEN 12 WHEN 2 THEN 199 WHEN 3 THEN 400 ELSE 11 END AS INT)"
#: The class counts every reference; rows are made of those that are there. Covers are told by the name of the document.
MANIFEST_SQL = f"""spine AS (SELECT 'book' || (page_id % 31) AS book, page_id, {LENGTH} AS text_len, {HREF} AS href, {IMAGES_SQL} AS images, {THERE_SQL} AS there FROM pages),
    flat AS (SELECT *, len(images) > 0 AND text_len < 200 * len(images) AS pictured, unnest(CASE WHEN len(images) > 0 AND text_len < 200 * len(images) THEN range(0, len(images)) ELSE [0] END) AS j FROM spine),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY page_id, j) - 1 AS index FROM flat WHERE NOT pictured OR there[j + 1]),
    manifest AS (SELECT book, CAST(index AS INTEGER) AS index, CASE
        WHEN pictured THEN CASE WHEN images[j + 1] = 'img/z.gif' AND book = 'book3' OR (index = 0 AND len(images) = 1 AND text_len < 12 AND (contains(lower(href), 'cover') OR contains(lower(href), 'title'))) THEN 'cover' ELSE 'image' END
        WHEN text_len >= 12 THEN CASE WHEN len(images) > 0 THEN 'mixed' ELSE 'text' END ELSE 'empty' END AS type,
      CAST(CASE WHEN pictured AND j > 0 THEN 0 ELSE text_len END AS INTEGER) AS text_len,
      CASE WHEN pictured THEN images[j + 1] WHEN text_len >= 12 THEN array_to_string(images, ',') ELSE '' END AS kept,
      CASE WHEN pictured THEN 'page_' || lpad(CAST(index + 1 AS VARCHAR), CAST(greatest(4, length(CAST(index + 1 AS VARCHAR))) AS INTEGER), '0') || '_' || regexp_extract(images[j + 1], '[^/]*$') ELSE '' END AS extracted FROM numbered)"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    spine = table(spark, sf_dir, "pages").select(
        F.expr("'book' || (page_id % 31)").alias("book"), F.col("page_id").alias("spine_pos"), F.lit("i").alias("idref"), F.expr(HREF).alias("href"), F.expr(LENGTH).alias("text_len"), F.expr(IMAGES).alias("images"), F.expr(THERE).alias("present")
    )
    covers = spark.createDataFrame([("book3", "img/z.gif")], "book string, image string")
    return routing.classify(spine, covers)


@query("r1_classify", f"WITH {MANIFEST_SQL} SELECT * FROM manifest")
def r1_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also the test for covers (R2), the names of stored images (R3), reading order (W1) and the join with declared covers (J3)."""
    return manifest(spark, sf_dir).select("book", "index", "type", "text_len", F.array_join("images", ",").alias("kept"), F.array_join("extracted_images", ",").alias("extracted"))


@query("r14_page_image", f"WITH {MANIFEST_SQL} SELECT book, index, nullif(extracted, '') AS image FROM manifest")
def r14_page_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark, sf_dir).select("book", "index", routing.page_image(F.col("extracted_images")).alias("image"))


@query("r15_preprocess", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id % 2 = 0 ELSE true END AS preprocess FROM documents")
def r15_preprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", routing.preprocess(F.expr("CASE WHEN doc_id % 3 = 0 THEN doc_id % 2 = 0 END"), F.lit(True)).alias("preprocess"))


BARE = "type IN ('image', 'cover') AND doc_id % 10 = 0"


@query(
    "r16_structural_checks",
    f"""WITH {PAGES_SQL}, c AS (SELECT book, count_if(type = 'empty') AS e, count_if({BARE}) AS b, list_slice(list_sort(list(doc_id) FILTER (type = 'empty')), 1, 10) AS et, list_slice(list_sort(list(doc_id) FILTER ({BARE})), 1, 10) AS bt FROM pages_ GROUP BY book
      UNION ALL SELECT 'bare', -1, -1, NULL, NULL)
    SELECT book, b = 0 AS ok, CASE WHEN b < 0 THEN 'no pages' WHEN b > 0 THEN b || ' pages without image: ' || array_to_string(bt, ', ') ELSE '' END AS errors, CASE WHEN e > 0 THEN e || ' empty pages: ' || array_to_string(et, ', ') ELSE '' END AS warnings FROM c""",
)
def r16_structural_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One book has no page."""
    own = page_table(spark, sf_dir).select("book", F.col("doc_id").alias("index"), "type", F.expr("CASE WHEN doc_id % 10 = 0 THEN array() ELSE array('x') END").alias("extracted_images"))
    books = own.select("book").unionAll(spark.createDataFrame([("bare",)], "book string"))
    return routing.structural_checks(own, books).select("book", "ok", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"))


@query("s10_pdf_classify", f"SELECT doc_id, CASE WHEN length({NORM('text')}) >= 24 THEN 'text' ELSE 'image' END AS type, doc_id % 4 = 0 AND doc_id % 3 = 1 AND doc_id % 10 > 8 AS keeps_bitmap FROM documents")
def s10_pdf_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also S13, the choice of the bitmap."""
    keeps = routing.keeps_bitmap(F.expr("doc_id % 4"), F.expr("doc_id % 3"), F.expr("CAST(doc_id % 10 AS DOUBLE) / 10"))
    return table(spark, sf_dir, "documents").select("doc_id", routing.classify_pdf(F.length(text.norm_ws(F.col("text")))).alias("type"), keeps.alias("keeps_bitmap"))


# ---- markup

def marked(*parts: str) -> Column:
    return F.concat(*(F.lit(x) if x.startswith("<") else text.escape(F.col(x)) for x in parts))


@query("s4_visible_text", f"SELECT doc_id, {NORM('text || source')} || ' ' || lang AS visible FROM documents WHERE {NORM('text')} <> ''")
def s4_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Styles and scripts aside, with and without namespaces, and what comes after them."""
    page = marked("<html><head><title>t</title><style>s</style></head><body><script>x &lt; y</script><div>", "text", "<script>z</script>", "source", "<x:style>c</x:style>\n <b>", "lang", "</b></div></body></html>")
    own = table(spark, sf_dir, "documents").where(text.strip(F.col("text")) != "")
    return own.select("doc_id", markup.visible_text(page).alias("visible"))


@query("s5_image_refs", "SELECT page_id, 'a/' || page_id || '.png,' || CASE WHEN page_id % 3 = 0 THEN '' ELSE 'b' || page_id || '.svg,' END || 'c.gif' AS images FROM pages")
def s5_image_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, svg = F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 == 0, F.lit("href=''")).otherwise(F.concat(F.lit("xlink:href='b"), F.col("page_id").cast("string"), F.lit(".svg'")))
    own = F.concat(F.lit("<html><body><img src='a/"), n, F.lit(".png'><img alt='none'><svg><image "), svg, F.lit("/></svg><p><IMG SRC=c.gif></p></body></html>"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(markup.image_refs(own), ",").alias("images"))


@query("s6_resolve_href", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'OEBPS/images/' || page_id || '.png#x' WHEN 1 THEN 'OEBPS/text/a%20b.png' WHEN 2 THEN '/root.png' ELSE '../up.png' END AS path FROM pages")
def s6_resolve_href(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escapes and fragments stay as they are; paths from the root and beyond it."""
    href = F.expr("CASE page_id % 4 WHEN 0 THEN './../images/' || page_id || '.png#x' WHEN 1 THEN 'x//../a%20b.png' WHEN 2 THEN '/root.png' ELSE '../../../up.png' END")
    return table(spark, sf_dir, "pages").select("page_id", markup.resolve_href(F.lit("OEBPS/text/p.xhtml"), href).alias("path"))


TOP = "CAST(doc_id % 400 AS DOUBLE) / 100"


@query(
    "s12_pdf_html",
    f"""WITH b AS (SELECT doc_id, {TOP} AS y, {TOP} + 0.01 AS z, source AS s, {NORM('substr(text, 1, 60)')} AS t FROM documents)
    SELECT doc_id, CASE WHEN t = '' THEN '<p>' || {sql_escape(NORM('s'))} || '</p>' WHEN CAST(format('{{:.1f}}', z) AS DOUBLE) <= CAST(format('{{:.1f}}', y) AS DOUBLE) THEN '<p>' || {sql_escape('t')} || '</p>' || chr(10) || '<p>' || {sql_escape(NORM('s'))} || '</p>'
      ELSE '<p>' || {sql_escape(NORM('s'))} || '</p>' || chr(10) || '<p>' || {sql_escape('t')} || '</p>' END AS html FROM b""",
)
def s12_pdf_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two blocks a hundredth apart, the lower one further left: it comes first where both round to one tenth."""
    b = lambda x, y, k, t: F.struct(F.lit(x).alias("x0"), y.alias("y0"), F.lit(k).alias("kind"), t.alias("text"))
    y = F.expr(TOP)
    blocks = F.array(b(5.0, y, 0, F.col("source")), b(0.0, F.lit(0.0), 1, F.col("lang")), b(1.0, y + F.lit(0.01), 0, F.substring("text", 1, 60)))
    return table(spark, sf_dir, "documents").select("doc_id", markup.pdf_html(blocks).alias("html"))


@query("s14_preserved_body", f"SELECT doc_id, '<h1>' || source || '</h1>' || chr(10) || '<p>' || lang || '</p>' || chr(10) || CASE WHEN {NORM('text')} = '' THEN '' ELSE '<p>' || {sql_escape(NORM('text'))} || '</p>' || chr(10) END || '<p>' || lang || ' ' || source || '</p>' || chr(10) || '<p>' || source || '</p>' AS body FROM documents")
def s14_preserved_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings below the third and list items become paragraphs, a nested block repeats its text, what is in no block is lost."""
    page = marked("<html><body><h1>", "source", "</h1><div>lost<h4>", "lang", "</h4></div><p>", "text", "</p><ul><li>", "lang", "<p> ", "source", "</p></li></ul></body></html>")
    return table(spark, sf_dir, "documents").select("doc_id", markup.preserved_body(page).alias("body"))


@query("s16_gold_set", "SELECT conv_id, CAST(turn AS INTEGER) AS index, text AS gold_text FROM conversations")
def s16_gold_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("turn").cast("string"), "text")))).alias("raw"))
    return raw.select("conv_id", F.explode(config.gold_set(F.col("raw"))).alias("e")).select("conv_id", "e.*")


@query("n18_well_formed", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '<p> </p>' ELSE '<p>' || lang || '<br/>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '<b class=\"x\">' || source || '</b></p>' END AS xhtml FROM documents")
def n18_well_formed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements left open, a bare line break, an attribute without quotes, quotes as entities; markup without text stays."""
    own = F.when(F.col("doc_id") % 5 == 0, F.lit(" <p> </p></i>")).otherwise(marked("<p>", "lang", "<br>", "text", "<b class=x>", "source", "</p>"))
    return table(spark, sf_dir, "documents").select("doc_id", markup.well_formed(own).alias("xhtml"))


# ---- running lines and blocks

FRACTION = 0.1
RUNNING_SQL = f"""ls AS (SELECT source, doc_id, {sql_lines('text')} AS l FROM documents),
    cand AS (SELECT source, unnest(CASE WHEN len(l) = 0 THEN [] WHEN l[1] = l[-1] THEN [l[1]] ELSE [l[1], l[-1]] END) AS line FROM ls),
    counted AS (SELECT source, regexp_replace(line, '{DIGITS}', '#', 'g') AS line, count(*) AS n FROM cand GROUP BY ALL),
    need AS (SELECT source, greatest(2, floor(count(*) * {FRACTION}::DOUBLE)) AS k FROM documents GROUP BY source),
    running AS (SELECT source, line FROM counted JOIN need USING (source) WHERE n >= k)"""


@query("c1_running_lines", f"WITH {RUNNING_SQL} SELECT * FROM running")
def c1_running_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.running_lines(table(spark, sf_dir, "documents"), "source", "text", FRACTION)


@query(
    "c3_without_running_lines",
    f"""WITH {RUNNING_SQL}, lists AS (SELECT source, list(line) AS r FROM running GROUP BY source)
    SELECT doc_id, array_to_string(list_filter(string_split(regexp_replace(text, '\\n\\z', ''), chr(10)), lambda l: {TRIMMED('l')} = '' OR NOT list_contains(coalesce(r, []), regexp_replace({TRIMMED('l')}, '{DIGITS}', '#', 'g'))), chr(10)) AS text
    FROM documents LEFT JOIN lists USING (source)""",
)
def c3_without_running_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also C2 and the join of lines with the running ones (J9)."""
    return layout.without_running_lines(table(spark, sf_dir, "documents"), "source", "text", FRACTION).select("doc_id", "text")


LABEL = "CASE line % 9 WHEN 0 THEN 'Title' WHEN 1 THEN 'Text' WHEN 2 THEN 'Text' WHEN 3 THEN 'PageHeader' WHEN 4 THEN 'Text' WHEN 5 THEN 'Figure' WHEN 6 THEN 'ListItem' WHEN 7 THEN 'ListItem' ELSE 'Footnote' END"
LINES_SQL = f"""lined AS (SELECT doc_id, ' ' || unnest(string_split(text, chr(10))) || chr(9) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
    labelled AS (SELECT doc_id, line, text, {LABEL} AS label FROM lined)"""
ISLANDS_SQL = f"""{LINES_SQL}, own AS (SELECT doc_id, line, text, CASE WHEN label = 'Figure' THEN 'Text' ELSE label END AS label FROM labelled WHERE {TRIMMED('text')} <> ''),
    marked AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY doc_id ORDER BY line) IS NOT DISTINCT FROM label THEN 0 ELSE 1 END AS new FROM own),
    numbered AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line) AS block_no FROM marked),
    merged AS (SELECT doc_id, CAST(block_no AS BIGINT) AS block_no, label, {TRIMMED("regexp_replace(string_agg(text, ' ' ORDER BY line), '</?[a-zA-Z][^>]*>', '', 'g')")} AS text FROM numbered WHERE label <> 'PageHeader' GROUP BY doc_id, block_no, label),
    islands AS (SELECT * FROM merged WHERE text <> '')"""


def labelled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).select("doc_id", "line", F.concat(F.lit(" "), "text", F.lit("\t")).alias("text"), F.expr(LABEL).alias("label"))


@query("w3_block_islands", f"WITH {ISLANDS_SQL} SELECT * FROM islands")
def w3_block_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.islands(labelled_lines(spark, sf_dir), ["doc_id"], "line")


XHTML_SQL = f"""{ISLANDS_SQL}, tagged AS (SELECT doc_id, block_no, label, CASE label WHEN 'Title' THEN '<h2>' || {sql_escape('text')} || '</h2>' WHEN 'ListItem' THEN '<ul><li>' || {sql_escape('text')} || '</li></ul>' WHEN 'Footnote' THEN '<aside epub:type="footnote"><p>' || {sql_escape('text')} || '</p></aside>' ELSE '<p>' || {sql_escape('text')} || '</p>' END AS x FROM islands)"""


@query("c5_blocks_xhtml", f"WITH {XHTML_SQL} SELECT doc_id, replace(string_agg(x, chr(10) ORDER BY block_no), '</ul>' || chr(10) || '<ul>', '') AS xhtml FROM tagged GROUP BY doc_id")
def c5_blocks_xhtml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also C4 and C8 with W4: labels to blocks, blocks to markup."""
    return structure.build_blocks(labelled_lines(spark, sf_dir), ["doc_id"], "line").select("doc_id", structure.blocks_to_xhtml(F.col("blocks")).alias("xhtml"))


@query("c9_cleaned_body", f"WITH {XHTML_SQL}, bodies AS (SELECT doc_id, replace(string_agg(x, chr(10) ORDER BY block_no), '</ul>' || chr(10) || '<ul>', '') AS xhtml FROM tagged WHERE doc_id % 2 = 0 GROUP BY doc_id) SELECT doc_id, coalesce(xhtml, '<p>' || {sql_escape(TRIMMED(sql_rejoin(sql_dehyphenate('text'))))} || '</p>') AS body FROM documents LEFT JOIN bodies USING (doc_id)")
def c9_cleaned_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = structure.build_blocks(labelled_lines(spark, sf_dir).where("doc_id % 2 = 0"), ["doc_id"], "line")
    return table(spark, sf_dir, "documents").join(blocks, "doc_id", "left").select("doc_id", structure.cleaned_body(F.col("blocks"), F.col("text")).alias("body"))


@query("c6_served_blocks", "SELECT doc_id, 'heading:' || source || ':|table:x:<table><b>x</b></table>|paragraph:' || lang || ':|paragraph:in a picture:' AS blocks FROM documents")
def c6_served_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text comes from the markup, that of a picture is prose, a table keeps its markup, one without text is left out."""
    item = lambda label, html, order, skipped: F.struct(F.lit(label).cast("string").alias("label"), html.alias("html"), F.lit(order).cast("int").alias("reading_order"), F.lit(skipped).alias("skipped"))
    own = lambda c: F.concat(F.lit(" <b>"), F.col(c), F.lit("</b> "))
    items = F.array(
        item("Picture", F.lit("in a <i>picture</i>"), 10, False), item(None, own("lang"), 9, False), item("Table", F.lit("<table><b>x</b></table>"), 2, False), item("Text", F.lit("no"), 3, True),
        item("PageFooter", F.lit("no"), 4, False), item("Table", F.lit(None).cast("string"), 5, False), item("SectionHeader", own("source"), None, None),
    )
    made = F.transform(structure.served_blocks(items), lambda b: F.concat_ws(":", b["type"], b["text"], F.coalesce(b["html"], F.lit(""))))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(made, "|").alias("blocks"))


@query("c5_blocks_in_row", f"WITH {XHTML_SQL} SELECT doc_id, replace(string_agg(x, chr(10) ORDER BY block_no), '</ul>' || chr(10) || '<ul>', '') AS xhtml FROM tagged GROUP BY doc_id")
def c5_blocks_in_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same blocks from the lines and regions of a page in one row, as an engine gives them (J10 within a row)."""
    labels = ["Title", "Text", "Text", "PageHeader", None, "Figure", "ListItem", "ListItem", "Footnote"]
    box = lambda y, d: F.array(*((F.lit(x) if isinstance(x, float) else x).cast("double") for x in (0.0, y, 1.0, y + d)))
    regions = F.array(*(F.struct(box(F.lit(float(k)), 0.5).alias("box"), F.lit(x).alias("label")) for k, x in enumerate(labels) if x))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.concat(F.lit(" "), x, F.lit("\t")).alias("text"), box((i % 9).cast("double"), 0.25).alias("box")))
    own = table(spark, sf_dir, "documents").select("doc_id", structure.blocks_to_xhtml(structure.line_blocks(lines, regions)).alias("xhtml"))
    return own.where("xhtml <> '<p></p>'")


@query("c10_pagebreak", "SELECT page_id, '<span epub:type=\"pagebreak\" role=\"doc-pagebreak\" id=\"page-' || page_id || '\" aria-label=\"' || page_id || '\"></span>' AS mark FROM pages")
def c10_pagebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", render.pagebreak(F.col("page_id")).alias("mark"))


HEAD_SQL = f"""'<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<!DOCTYPE html>' || chr(10) || '<html xmlns:epub="http://www.idpf.org/2007/ops" xmlns="http://www.w3.org/1999/xhtml" xml:lang="en" lang="en"><head><title>'"""
PARAGRAPHS = lambda x: f"coalesce(nullif(array_to_string(list_transform(list_filter(list_transform(string_split({x}, chr(10) || chr(10)), lambda p: {TRIMMED('p')}), lambda p: p <> ''), lambda p: '<p>' || {sql_escape('p')} || '</p>'), chr(10)), ''), '<p></p>')"


@query(
    "c11_page_document",
    f"""WITH d AS (SELECT doc_id, {HEAD_SQL} || source || '</title></head><body>' || CASE WHEN doc_id % 7 = 0 THEN '' ELSE '<span epub:type="pagebreak" role="doc-pagebreak" id="page-' || doc_id || '" aria-label="' || doc_id || '"></span>' END AS head,
      '<section epub:type="page"><img style="max-width:100%;" src="images/i.png" alt="' || source || '"/>' AS picture, text AS t, lang FROM documents)
    SELECT doc_id, head || CASE doc_id % 6 WHEN 0 THEN '<section><p>' || lang || '</p></section>' WHEN 2 THEN '<section>' || {PARAGRAPHS('t')} || '</section>' WHEN 4 THEN '<section><p></p></section>' WHEN 5 THEN '<section><p>' || lang || '</p></section>'
      WHEN 1 THEN picture || '</section>' ELSE picture || '<div class="ocr-text" aria-hidden="false" style="{render.ASIDE}">' || {sql_escape('t')} || '</div></section>' END || '</body></html>' AS xhtml FROM d WHERE t <> ''""",
)
def c11_page_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A body, an image with and without text under it, prose in place of an image, neither, and the body in place of both."""
    own, k = table(spark, sf_dir, "documents").where("text <> ''"), F.col("doc_id") % 6
    mode = F.when(k.isin(0, 4), F.lit("reflowable")).otherwise(F.lit("facsimile"))
    body = F.when(k.isin(0, 5), F.concat(F.lit("<p>"), F.col("lang"), F.lit("</p>")))
    number = F.when(F.col("doc_id") % 7 > 0, F.col("doc_id"))
    return own.select("doc_id", render.page_document(mode, F.col("source"), body, number, F.when(k.isin(1, 3), F.lit("i.png")), F.when(k.isin(0, 2, 3), F.col("text"))).alias("xhtml"))


@query(
    "c12_nav",
    f"""WITH {ROUTED_SQL}, d AS (SELECT book, index, CASE WHEN type = 'cover' THEN 'Cover' ELSE 'Page ' || page_number END AS title, type, page_number FROM routed_ WHERE type <> 'empty')
    SELECT book, {HEAD_SQL} || 'Navigation</title></head><body><nav id="toc" epub:type="toc"><h1>Contents</h1><ol>' || string_agg('<li><a href="p' || index || '">' || title || '</a></li>', '' ORDER BY index) || '</ol></nav><nav hidden="" epub:type="page-list"><ol>'
      || string_agg(CASE WHEN type <> 'cover' THEN '<li><a href="p' || index || '#page-' || page_number || '">' || page_number || '</a></li>' ELSE '' END, '' ORDER BY index) || '</ol></nav></body></html>' AS nav FROM d GROUP BY book""",
)
def c12_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = routed_pages(spark, sf_dir).withColumn("file", F.concat(F.lit("p"), F.col("index").cast("string")))
    return render.nav_documents(docs)


@query("c13_int_box", "SELECT vec_id, CAST(trunc(100 * least(embedding[1]::DOUBLE, embedding[3]::DOUBLE)) AS INTEGER) AS x0, CAST(trunc(100 * greatest(embedding[2]::DOUBLE, embedding[4]::DOUBLE)) AS INTEGER) AS y1 FROM embeddings")
def c13_int_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = lambda k: 100 * F.col("embedding")[k].cast("double")
    b = structure.int_box(F.array(F.array(v(0), v(1)), F.array(v(2), v(3))))
    return table(spark, sf_dir, "embeddings").select("vec_id", b[0].alias("x0"), b[3].alias("y1"))


@query(
    "j10_line_labels",
    """WITH lines AS (SELECT vec_id // 10 AS page, vec_id % 10 AS line, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
    regions AS (SELECT vec_id // 10 AS page, vec_id % 10 AS region, embedding[3]::DOUBLE - 0.2 AS x0, embedding[4]::DOUBLE - 0.2 AS y0, embedding[3]::DOUBLE + 0.1 AS x1, embedding[4]::DOUBLE + 0.1 AS y1, 'L' || label AS label FROM embeddings)
    SELECT l.page, l.line, coalesce(arg_min(label, region), 'Text') AS label FROM lines l LEFT JOIN regions r ON l.page = r.page AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY l.page, l.line""",
)
def j10_line_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    v = lambda k, d=0.0: F.col("embedding")[k].cast("double") + F.lit(d)
    page = F.expr("vec_id div 10").alias("page")
    lines = e.select(page, (F.col("vec_id") % 10).alias("line"), F.array(v(0), v(1), v(0), v(1)).alias("box"))
    regions = e.select(page, (F.col("vec_id") % 10).alias("region"), F.array(v(2, -0.2), v(3, -0.2), v(2, 0.1), v(3, 0.1)).alias("box"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("label"))
    return structure.labelled(lines, regions, ["page"], "line", "region").select("page", "line", "label")


# ---- reports

TYPES = ", ".join(f"count_if(type = '{t}') AS {t}" for t in routing.PAGE_TYPES)


@query("a1_type_counts", f"WITH {PAGES_SQL} SELECT book, {TYPES} FROM pages_ GROUP BY book")
def a1_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.type_counts(page_table(spark, sf_dir))


@query("a2_sparse_counts", f"WITH {PAGES_SQL} SELECT type, count(*) AS n FROM pages_ GROUP BY type ORDER BY type")
def a2_sparse_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sparse_counts(page_table(spark, sf_dir))


@query("a3_routing_summary", f"WITH {ROUTED_SQL} SELECT book, count(*) AS docs, count_if(mode = 'reflowable') AS reflowable, count_if(mode = 'facsimile') AS facsimile, count_if(mode = 'preserved') AS preserved, CAST(0 AS BIGINT) AS held FROM routed_ WHERE type <> 'empty' GROUP BY book")
def a3_routing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.routing_summary(routed_pages(spark, sf_dir))


HALF = "CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(doc_id % 64 AS DOUBLE) / 64 END"


@query("a5_means", f"SELECT source, count(*) AS n, avg({HALF}) AS mean, avg(coalesce({HALF}, 0)) AS mean_all, count_if(({HALF}) IS NULL) AS unknown FROM documents GROUP BY source")
def a5_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also A4."""
    return report.means(table(spark, sf_dir, "documents").withColumn("c", F.expr(HALF)), "c", "source")


@query("a6_page_confidence", "SELECT vec_id, CASE WHEN vec_id % 5 > 0 THEN (vec_id % 5 + 1)::DOUBLE / 4 END AS conf FROM embeddings")
def a6_page_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = lambda e: F.struct(F.expr(e).cast("double").alias("conf"))
    words = F.array(w("CASE WHEN vec_id % 5 > 0 THEN CAST(vec_id % 5 AS DOUBLE) / 2 END"), w("CASE WHEN vec_id % 5 > 0 THEN 0.5 END"), w("NULL"))
    return table(spark, sf_dir, "embeddings").select("vec_id", report.mean_confidence(words).alias("conf"))


@query(
    "a9_engine_report",
    f"""WITH g AS (SELECT item_id, text AS a FROM benchmark WHERE NOT regexp_matches(text, '[^\\x00-\\x7f]')), e AS (SELECT * FROM (VALUES ('clean', 0), ('cut', 20), ('copy', 0)) t(engine, cut)),
    s AS (SELECT engine, a, substr(a, cut + 1, 1000) AS b FROM g CROSS JOIN e),
    w AS (SELECT *, string_split({NORM('a')}, ' ') AS x, string_split({NORM('b')}, ' ') AS y, list_distinct(list_concat(string_split({NORM('a')}, ' '), string_split({NORM('b')}, ' '))) AS v FROM s),
    m AS (SELECT engine, count(*) AS n, avg({sql_cer('a', 'b')}) AS cer, avg({sql_wer('x', 'y', 'v')}) AS wer, avg({sql_insertion('a', 'b')}) AS insertion_rate FROM w WHERE len(v) <= 90 GROUP BY engine)
    SELECT *, cer = min(cer) OVER () AS best FROM m""",
)
def a9_engine_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also J6, J7 and A12: gold pages (of at most 90 distinct words) by engines, mean errors, all of the best."""
    gold = table(spark, sf_dir, "benchmark").where(~F.col("text").rlike("[^\\x00-\\x7f]"))
    names = spark.createDataFrame([("clean", 0), ("cut", 20), ("copy", 0)], "engine string, cut int")
    read = gold.crossJoin(F.broadcast(names)).withColumn("b", F.expr("substr(text, cut + 1, 1000)"))
    read = read.where(F.size(F.array_distinct(F.concat(text.split_ws(F.col("text")), text.split_ws(F.col("b"))))) <= 90)
    return report.engine_report(read.select("engine", metrics.scores(F.col("text"), F.col("b")).alias("s")).select("engine", "s.*"))


VARIANTS = ("raw", "contrast", "binarize")


def variant_column(k: int, what: str, div: int) -> str:
    return f"CASE WHEN doc_id % {5 + k} = 0 THEN NULL ELSE CAST((doc_id * {k + 3}) % 64 AS DOUBLE) / {div} END"


@query(
    "a10_variant_report",
    " UNION ALL ".join(
        f"SELECT '{v}' AS variant, count(*) AS n, avg(c) AS mean_conf, count_if(c >= 0.8) AS at_floor, avg(a) AS mean_agree, count_if(coalesce(c >= 0.8, false) OR (h AND coalesce(a, 0) >= 0.85)) AS trusted FROM (SELECT {variant_column(k, 'conf', 64)} AS c, {variant_column(k + 3, 'agree', 64)} AS a, doc_id % 3 > 0 AS h FROM documents)"
        for k, v in enumerate(VARIANTS)
    ),
)
def a10_variant_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [F.expr(variant_column(k + 3 * j, what, 64)).alias(f"{v}_{what}") for k, v in enumerate(VARIANTS) for j, what in enumerate(("conf", "agree"))]
    return report.variant_report(table(spark, sf_dir, "documents").select(F.expr("doc_id % 3 > 0").alias("has_challenger"), *columns), VARIANTS)


@query("a11_recognition_summary", "SELECT source AS book, count(*) AS total, count_if(doc_id % 2 = 0) AS cached, count_if(doc_id % 9 = 0) AS degenerate FROM documents GROUP BY source")
def a11_recognition_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.recognition_summary(table(spark, sf_dir, "documents").select(F.col("source").alias("book"), F.expr("doc_id % 2 = 0").alias("cached"), F.expr("doc_id % 9 = 0").alias("degenerate")))


@query("l1_first_pages", f"WITH {PAGES_SQL} SELECT book, index FROM pages_ WHERE type IN ('image', 'cover') QUALIFY row_number() OVER (PARTITION BY book ORDER BY index) <= 12")
def l1_first_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.first_pages(routing.recognised(page_table(spark, sf_dir)), 12).select("book", "index")


STRIDE_SQL = f"""{PAGES_SQL}, placed AS (SELECT book, index, count(*) OVER (PARTITION BY book) AS n, row_number() OVER (PARTITION BY book ORDER BY index) - 1 AS pos FROM pages_),
    spots AS (SELECT DISTINCT book, CAST(floor(i * (n / 12.0::DOUBLE)) AS BIGINT) AS pos FROM placed, range(0, 12) t(i)),
    sample AS (SELECT book, index, pos FROM placed WHERE n <= 12 OR EXISTS (SELECT 1 FROM spots s WHERE s.book = placed.book AND s.pos = placed.pos))"""


@query("l2_stride_sample", f"WITH {STRIDE_SQL} SELECT book, index FROM sample")
def l2_stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.stride_sample(page_table(spark, sf_dir), 12).select("book", "index")


@query("l3_sub_stride", f"WITH {STRIDE_SQL}, s AS (SELECT book, index, greatest(1, count(*) OVER (PARTITION BY book) // 5) AS step, row_number() OVER (PARTITION BY book ORDER BY index) - 1 AS k FROM sample) SELECT book, index FROM s WHERE k % step = 0")
def l3_sub_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sub_stride(report.stride_sample(page_table(spark, sf_dir), 12), 5).select("book", "index")


@query("t3_first_of_name", "SELECT lang AS name, min(doc_id) AS index FROM documents GROUP BY lang")
def t3_first_of_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.first_of_name(table(spark, sf_dir, "documents").select(F.col("lang").alias("name"), F.col("doc_id").alias("index")), "name")


@query("t2_token_surplus", f"WITH b AS (SELECT item_id, unnest({TOKENS('text')}) AS t FROM benchmark) SELECT t AS token, count(*) AS n FROM (SELECT t FROM b WHERE item_id % 2 = 0 EXCEPT ALL SELECT t FROM b WHERE item_id % 2 = 1) GROUP BY t")
def t2_token_surplus(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "benchmark").select("item_id", F.explode(text.tokens(F.col("text"))).alias("token"))
    return own.where("item_id % 2 = 0").select("token").exceptAll(own.where("item_id % 2 = 1").select("token")).groupBy("token").agg(F.count("*").alias("n"))


# ---- joins and the cache

@query("j1_spine_items", "SELECT d.doc_id, p.url AS href FROM documents d JOIN pages p ON d.doc_id = p.page_id")
def j1_spine_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("href"))
    return table(spark, sf_dir, "documents").select("doc_id").join(items, "doc_id")


@query("j2_images_in_archive", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT page_id FROM pages)")
def j2_images_in_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id").join(names, "doc_id", "left_semi")


KEY_SQL = "substr(sha256(text || '{}fakev1'), 1, 16)"


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", text.cache_key(F.col("text"), {}, "fake", "v1").alias("key"))


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed(spark, sf_dir).where("doc_id % 3 = 0").groupBy("key").agg(F.min("doc_id").alias("cached_by"))


@query("j4_cache_hits", f"WITH k AS (SELECT doc_id, {KEY_SQL} AS key FROM documents), c AS (SELECT key, min(doc_id) AS cached_by FROM k WHERE doc_id % 3 = 0 GROUP BY key) SELECT doc_id, k.key, coalesce(cached_by, -1) AS cached_by FROM k LEFT JOIN c ON k.key = c.key")
def j4_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.hits(keyed(spark, sf_dir), kept(spark, sf_dir)).select("doc_id", "key", F.coalesce("cached_by", F.lit(-1)).alias("cached_by"))


@query("k1_cache_misses", f"WITH k AS (SELECT doc_id, {KEY_SQL} AS key FROM documents) SELECT DISTINCT key FROM k WHERE key NOT IN (SELECT key FROM k WHERE doc_id % 3 = 0)")
def k1_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.misses(keyed(spark, sf_dir), kept(spark, sf_dir)).select("key")


@query("j5_pages_with_ocr", f"WITH {PAGES_SQL} SELECT p.book, p.index, coalesce(o.said, '') AS said FROM pages_ p LEFT JOIN (SELECT * FROM pages_ WHERE type = 'image') o ON p.doc_id = o.doc_id")
def j5_pages_with_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = page_table(spark, sf_dir)
    ocr = own.where("type = 'image'").select("book", "index", "said")
    return own.select("book", "index").join(ocr, ["book", "index"], "left").select("book", "index", F.coalesce("said", F.lit("")).alias("said"))


@query("j8_challengers", "SELECT a.conv_id, a.turn, a.text AS primary_text, coalesce(b.text, '') AS challenger_text FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant' WHERE a.role = 'user'")
def j8_challengers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    b = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    return c.where("role = 'user'").join(b, ["conv_id", "turn"], "left").select("conv_id", "turn", F.col("text").alias("primary_text"), F.coalesce("b", F.lit("")).alias("challenger_text"))


@query("e1_fake_engine", "SELECT doc_id, text, 'fake-0' AS engine, text IS NULL AS failed FROM documents")
def e1_fake_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.col("text"), "UTF-8").alias("content"))
    return engines.run_engine(images, engines.FakeEngine, ["doc_id"]).select("doc_id", "text", "engine", F.col("error").isNotNull().alias("failed"))


# ---- books there and back

@query("s1_epub_round_trip", f"WITH {PAGES_SQL} SELECT book, index AS spine_pos, CAST(length({NORM('text')}) AS INTEGER) AS text_len, CASE WHEN length({NORM('text')}) < 12 THEN 'empty' ELSE 'text' END AS type FROM pages_")
def s1_epub_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources written as EPUB files (K3, C12) and read again (S1 to S9, J1, J2), all where their rows are."""
    own = page_table(spark, sf_dir)
    body = F.concat(F.lit("<html><body><p>"), text.escape(F.col("text")), F.lit("</p></body></html>"))
    docs = own.select("book", "index", F.concat(F.lit("p"), F.col("index").cast("string"), F.lit(".xhtml")).alias("file"), F.col("book").alias("title"), F.lit(None).cast("int").alias("page_number"), body.alias("xhtml"))
    read = durable.written(epub.documents(sinks.epubs(docs, render.nav_documents(docs))).where("error IS NULL").drop("page_html"), "spine")
    kinds = routing.classify(read).select("book", F.col("index").alias("spine_pos"), "type")
    return read.select("book", "spine_pos", "text_len").join(kinds, ["book", "spine_pos"])


@query(
    "k7_book_to_book",
    f"""WITH {PAGES_SQL}, own AS (SELECT book, index, doc_id % 5 = 3 AS pictured, {NORM('text')} AS t, lang || ' ' || {NORM('text')} AS whole, text, ('0x' || substr(sha256(text), 1, 4))::INTEGER / 65535::DOUBLE >= 0.8 AS sure FROM pages_ JOIN documents USING (doc_id, text)),
    kept AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY index) - 1 AS pos FROM own WHERE pictured OR length(trim(whole)) >= 12)
    SELECT book, CAST(pos AS INTEGER) AS spine_pos, CASE WHEN pictured THEN t ELSE trim(whole) END AS said, CASE WHEN pictured AND NOT (sure AND t <> '') THEN 1 ELSE 0 END AS images FROM kept""",
)
def k7_book_to_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EPUB files with text pages and scans are read, recognised, built anew and read once more (S1 to S9, S14, R5, R6, R12, C3, C9, C11, E1, K3)."""
    own = table(spark, sf_dir, "documents").select("doc_id", "lang").join(page_table(spark, sf_dir), "doc_id")
    n, scan = F.col("index").cast("string"), F.col("doc_id") % 5 == 3
    page = F.when(scan, F.concat(F.lit('<html><body><img src="images/'), n, F.lit('.png"/></body></html>'))).otherwise(marked("<html><body><h2>", "lang", "</h2>\n<p>", "text", "</p></body></html>"))
    docs = own.select("book", "index", F.concat(F.lit("p"), n, F.lit(".xhtml")).alias("file"), F.col("book").alias("title"), F.lit(None).cast("int").alias("page_number"), page.alias("xhtml"))
    scans = own.where(scan).select("book", F.concat(n, F.lit(".png")).alias("name"), F.encode("text", "UTF-8").alias("content"))
    source = durable.written(sinks.epubs(docs, render.nav_documents(docs), scans), "books")
    pages = durable.written(epub.manifest(epub.documents(source), epub.covers(source)), "manifest")
    named = pages.where("size(extracted_images) > 0").select("book", "index", F.col("images")[0].alias("image"), F.col("extracted_images")[0].alias("name"))
    shown = named.join(epub.images(source), ["book", "image"])
    ocr = durable.written(sinks.screened(engines.run_engine(shown, engines.FakeEngine, ["book", "index"])), "ocr")
    made = book.written(book.reading(pages, ocr), shown.select("book", "name", "content"), book.titles(pages))
    read = epub.documents(made).where("error IS NULL")
    said = markup.visible_text(F.col("page_html"))
    return read.select("book", "spine_pos", said.alias("said"), F.size("images").alias("images"))


@query("e9_rewrite_or_fallback", "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'rewritten' ELSE 'plain' END AS body FROM benchmark WHERE NOT regexp_matches(text, '[^\\x00-\\x7f]')")
def e9_rewrite_or_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's rewrites that are faithful replace the plain text (R8, R11); every other one here loses half of its text."""
    b = table(spark, sf_dir, "benchmark").where(~F.col("text").rlike("[^\\x00-\\x7f]"))
    asked = b.withColumn("prompt", F.when(F.col("item_id") % 2 == 0, F.col("text")).otherwise(F.expr("substr(text, 1, length(text) div 2)")))
    made = engines.rewrite(asked, lambda: lambda t: f"<p>{t}</p>", ["item_id", "text"], "prompt")
    ok = metrics.verdict(F.col("text"), F.col("candidate"))["ok"]
    return made.select("item_id", routing.fallback(ok, F.lit("rewritten"), F.lit("plain")).alias("body"))
