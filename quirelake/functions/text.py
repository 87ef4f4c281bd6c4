"""Text as column expressions: blanks, tokens, lines, paragraphs, markup, keys."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quirelake.functions.unicode import ALNUM, BLANK, BLANKS, BREAKS, CUTS, DIGITS, NL, STOPS, WORD, WS

ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&apos;", "'"), ("&amp;", "&"))
#: Noncharacters, which no text holds.
_STOP, _GAP = "\ufdd0", "\ufdd1"
MEDIA = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp"}


def strip(c: Column) -> Column:
    """Without the blanks at both ends."""
    return F.btrim(c, F.lit(BLANKS))


def norm_ws(c: Column) -> Column:
    """Runs of blanks as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def split_ws(c: Column) -> Column:
    """Pieces between blanks; none for a blank text."""
    own = norm_ws(c)
    return F.when(own == "", F.array().cast("array<string>")).otherwise(F.split(own, " "))


def tokens(c: Column) -> Column:
    """Runs of letters and numbers, lower-cased after they are cut out."""
    return F.transform(F.regexp_extract_all(c, F.lit(f"{ALNUM}+"), F.lit(0)), F.lower)


def dehyphenate(c: Column) -> Column:
    """Words that a hyphen and a line break divide, rejoined; matches don't overlap."""
    return F.regexp_replace(c, f"({WORD}+)-\\n({WORD}+)", "$1$2")


def unix_lines(c: Column) -> Column:
    """Every line boundary as a line feed."""
    return F.regexp_replace(c, NL, "\n")


def rejoin_paragraphs(c: Column) -> Column:
    """Lines run on by a space unless the text before ends a sentence; paragraphs are kept apart by one blank line.

    Lines are cut once and trimmed; a blank line only counts between two others,
    so every line that follows one goes after a blank line of its own.
    """
    trimmed = F.transform(F.split(unix_lines(c), "\n"), strip)
    # a line that ends a sentence is marked before lines are joined; the marks tell which breaks stay
    marked = F.transform(trimmed, lambda x: F.when(F.right(x, F.lit(1)).isin(*STOPS), F.concat(x, F.lit(_STOP))).otherwise(x))
    joined = F.btrim(F.regexp_replace(F.array_join(marked, "\n"), "\n{2,}", _GAP), F.lit("\n" + _GAP))
    shown = F.replace(F.replace(F.replace(F.replace(joined, F.lit(_STOP + "\n"), F.lit(_STOP)), F.lit("\n"), F.lit(" ")), F.lit(_STOP + _GAP), F.lit(_GAP)), F.lit(_GAP), F.lit("\n\n"))
    return F.replace(F.regexp_replace(shown, _STOP + "\\z", ""), F.lit(_STOP), F.lit("\n"))


def clean_page(c: Column) -> Column:
    return rejoin_paragraphs(dehyphenate(c))


def digits_as_hash(c: Column) -> Column:
    return F.regexp_replace(c, DIGITS, "#")


def lines(c: Column) -> Column:
    """Stripped lines that aren't blank."""
    return F.filter(F.transform(F.split(unix_lines(c), "\n"), strip), lambda x: x != "")


_SOLID = f"[^{BLANK}]"
#: From a solid character to the last one of its line.
_RUN = f"{_SOLID}(?:[^{BREAKS}]*{_SOLID})?"


def first_line(c: Column) -> Column:
    """The first line that isn't blank, stripped; null if there is none."""
    return F.nullif(F.regexp_extract(c, _RUN, 0), F.lit(""))


def last_line(c: Column) -> Column:
    """The last line that isn't blank, stripped; null if there is none."""
    own = F.substring_index(F.translate(strip(c), CUTS, "\n" * len(CUTS)), "\n", -1)
    return F.nullif(strip(own), F.lit(""))


def plain_text(markup: str) -> str:
    """Like :func:`without_inline_tags`, of one text in Python."""
    return re.sub(r"</?[a-zA-Z][^>]*>", "", markup).strip()


def without_inline_tags(c: Column) -> Column:
    return strip(F.regexp_replace(c, "</?[a-zA-Z][^>]*>", ""))


def markup_text(c: Column) -> Column:
    """Text of markup: tags as spaces, then the five XML entities, then blanks collapsed."""
    out = F.regexp_replace(c, "<[^>]+>", " ")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return norm_ws(out)


@F.arrow_udf(StringType())
def _unescape(column: pa.Array) -> pa.Array:
    from html import unescape

    return pa.array([None if x is None else unescape(x) for x in column.to_pylist()], pa.string())


def markup_text_all(c: Column) -> Column:
    """Like :func:`markup_text`, with the whole table of HTML entities (in Python, where a text has any)."""
    bare = F.regexp_replace(c, "<[^>]+>", " ")
    return norm_ws(F.coalesce(_unescape(F.when(bare.contains("&"), bare)), bare))


def escape(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def content_hash(content: Column) -> Column:
    """First 16 hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(content.cast("binary"), 256), 1, 16)


def params_json(params: Mapping[str, object]) -> str:
    """Parameters as text with sorted keys, made on the driver."""
    return json.dumps(dict(params), sort_keys=True, ensure_ascii=True)


def cache_key(content: Column, params: Mapping[str, object], model: str, version: str) -> Column:
    """Key of a computation by all that it depends on."""
    rest = F.encode(F.lit(params_json(params) + model + version), "UTF-8")
    return content_hash(F.concat(content.cast("binary"), rest))


def rounded(c: Column, digits: int) -> Column:
    """The whole number next to |c| * 10 ** digits, ties of the binary value to even.

    c is split in two halves whose products are exact, so what the product loses
    by rounding is known and decides where it seems to lie on a tie.
    """
    v, ten = F.abs(c), F.lit(float(10**digits))
    split = v * F.lit(134217729.0)
    high = split - (split - v)
    a, b = high * ten, (v - high) * ten
    whole = a + b
    lost = b - (whole - a)
    down = F.floor(whole)
    rest = whole - down
    up = (rest > 0.5) | ((rest == 0.5) & ((lost > 0) | ((lost == 0) & (down % 2 == 1))))
    return down + F.when(up, F.lit(1)).otherwise(F.lit(0))


def format_score(c: Column) -> Column:
    """Two decimals as the binary value rounds, ties to even, or n/a; for values under 10 ** 13."""
    n = rounded(c.cast("double"), 2)
    sign = F.when(c < 0, F.lit("-")).otherwise(F.lit(""))
    shown = F.concat(sign, F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))
    return F.when(c.isNull(), F.lit("n/a")).when(F.isnan(c), F.lit("nan")).otherwise(shown)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """In lower case, empty if there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]+)$", 1))


def media_type(path: Column, default: str = "image/png") -> Column:
    known = F.lit(default)
    for ext, kind in MEDIA.items():
        known = F.when(extension(path) == ext, F.lit(kind)).otherwise(known)
    return known


def data_url(content: Column, path: Column) -> Column:
    return F.concat(F.lit("data:"), media_type(path), F.lit(";base64,"), F.replace(F.base64(content.cast("binary")), F.lit("\r\n"), F.lit("")))


def page_stem(index: Column) -> Column:
    """Names count from one, with four digits at least."""
    return F.format_string("page_%04d", index + 1)


def slug(path: Column) -> Column:
    """Name of a project: the stem of a file with odd characters as underscores."""
    stem = F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")
    own = F.regexp_replace(F.regexp_replace(stem, "[^a-zA-Z0-9._-]+", "_"), "^_+|_+$", "")
    return F.when(own == "", F.lit("book")).otherwise(own)
