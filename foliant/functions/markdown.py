"""Markdown expressions, native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, col, lines, rstrip, strip, word_count

HEADING = rf"(?dm)^(#{{1,6}}){SPACE}+(.+?)$"
INLINE_IMAGE = rf'!\[([^\]]*)\]\(([^\x1c-\x1f\p{{IsWhite_Space}}\)]+)(?:{SPACE}+"([^"]*)")?\)'
REFERENCE_IMAGE = r"!\[([^\]]*)\]\[([^\]]+)\]"
REFERENCE = rf'(?dm)^\[([^\]]+)\]:{SPACE}+([^\x1c-\x1f\p{{IsWhite_Space}}]+)(?:{SPACE}+"([^"]*)")?'


def atx_headings(c: Column | str) -> Column:
    """Underlined headings as # headings: ``=`` of any length; ``-`` of 3 or more, no more than half of the title longer or
    shorter. White space after the underline goes up to the line end before the next text, as the pattern takes it."""
    body = F.regexp_replace(col(c), rf"(?dm)^(.+)\n=+{SPACE}*$", r"# $1")
    pattern = rf"(?dm)^(.+)\n(-{{3,}}){SPACE}*$"
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def put(acc: Column, m: Column) -> Column:
        title, under = F.regexp_extract(m["match"], pattern, 1), F.regexp_extract(m["match"], pattern, 2)
        fits = F.abs(F.length(title) - F.length(under)) <= 0.5 * F.length(title)
        before = F.substring(body, (acc["at"] + 1).cast("int"), (m["position"] - acc["at"]).cast("int"))
        return F.struct((m["position"] + F.length(m["match"])).cast("bigint").alias("at"), F.concat(acc["out"], before, F.when(fits, F.concat(F.lit("## "), title)).otherwise(m["match"])).alias("out"))

    done = F.aggregate(found_with_places(body, pattern), start, put)
    return F.concat(done["out"], F.substring(body, (done["at"] + 1).cast("int"), F.length(body)))


def normalised(c: Column | str) -> Column:
    """# headings, ``-`` bullets, at most one blank line in a row. Empty stays empty."""
    out = F.regexp_replace(atx_headings(c), rf"(?dm)^({SPACE}*)\*{SPACE}+", "$1- ")
    out = F.regexp_replace(out, "\n{3,}", "\n\n")
    return F.when(col(c) == "", col(c)).otherwise(out)


def trimmed_lines(c: Column | str) -> Column:
    """Line ends stripped, at most one blank line in a row, the whole stripped."""
    return strip(F.regexp_replace(F.array_join(F.transform(lines(c), rstrip), "\n"), "\n{3,}", "\n\n"))


def plain(c: Column | str) -> Column:
    """Markdown without code, addresses, link and image syntax, heading marks and emphasis."""
    out = F.regexp_replace(col(c), r"(?s)```.*?```", "")
    out = F.regexp_replace(out, r"`[^`]+`", "")
    out = F.regexp_replace(out, r"https?://[^\x1c-\x1f\p{IsWhite_Space}]+", "")
    out = F.regexp_replace(out, r"!\[([^\]]*)\]\([^\)]+\)", "$1")
    out = F.regexp_replace(out, r"\[([^\]]+)\]\([^\)]+\)", "$1")
    out = F.regexp_replace(out, rf"(?dm)^#{{1,6}}{SPACE}+", "")
    out = F.regexp_replace(out, r"(?d)(\*\*|__)(.*?)\1", "$2")
    return F.regexp_replace(out, r"(?d)(\*|_)(.*?)\1", "$2")


def markdown_word_count(c: Column | str) -> Column:
    return word_count(plain(c))


def office_plain(c: Column | str) -> Column:
    """Markdown of an office document without heading marks, emphasis, table bars and rules."""
    out = F.regexp_replace(col(c), rf"(?dm)^#{{1,6}}{SPACE}+", "")
    for mark in (r"\*\*\*(.+?)\*\*\*", r"\*\*(.+?)\*\*", r"\*(.+?)\*"):
        out = F.regexp_replace(out, "(?d)" + mark, "$1")
    out = F.regexp_replace(out, r"\|", " ")
    out = F.regexp_replace(out, rf"(?dm)^{SPACE}*-{{3,}}{SPACE}*$", "")
    return F.regexp_replace(out, r"\\(.)", "$1")


def found_with_places(text: Column, pattern: str) -> Column:
    """array<struct<match, position>> of a pattern whose matches begin a line; position from 0, in characters.

    Spark has no search that returns places, so each match is located after the one before.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<match:string,position:bigint>>").alias("found"))
    padded = F.concat(F.lit("\n"), text)

    def step(acc: Column, m: Column) -> Column:
        at = F.call_function("locate", F.concat(F.lit("\n"), m), padded, acc["next"])
        return F.struct((at + F.length(m)).cast("int").alias("next"), F.concat(acc["found"], F.array(F.struct(m.alias("match"), (at - 1).cast("long").alias("position")))).alias("found"))

    return F.aggregate(matches, start, step)["found"]


def table(rows: Column, escape: bool = True) -> Column:
    """array<array<string>> as a Markdown table: the first row is the head; null cells are empty."""

    def cell(x: Column) -> Column:
        out = F.replace(strip(F.coalesce(x, F.lit(""))), F.lit("\n"), F.lit(" "))
        return F.replace(out, F.lit("|"), F.lit("\\|")) if escape else out

    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, cell), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(F.element_at(rows, 1), lambda _: F.lit("---")), " | "), F.lit(" |"))
    body = F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), line)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(line(F.element_at(rows, 1)), rule), body), "\n")).otherwise(F.lit(""))


def link(text: Column | str, url: Column | str) -> Column:
    """[text](url) with brackets of the text and parentheses of the address escaped."""
    return F.concat(F.lit("["), F.regexp_replace(col(text), r"([\[\]])", r"\\$1"), F.lit("]("), F.regexp_replace(col(url), r"([()])", r"\\$1"), F.lit(")"))


def image_format(path: Column | str) -> Column:
    """Of a data address, else of a ``format`` or ``fmt`` parameter, else the extension; ``unknown`` without one."""
    p = col(path)
    data = F.lower(F.regexp_extract(p, r"(?i)\Adata:image/([\p{L}\p{N}_]+)", 1))
    query = F.lower(F.regexp_extract(p, r"(?i)\A[^?]*\?.*?(?:format|fmt)=([\p{L}\p{N}_]+)", 1))
    name = F.element_at(F.split(F.element_at(F.split(p, r"\?", -1), 1), "/", -1), -1)
    extension = F.when(F.contains(name, F.lit(".")), F.lower(F.element_at(F.split(name, r"\.", -1), -1)))
    return F.coalesce(F.nullif(data, F.lit("")), F.nullif(query, F.lit("")), extension, F.lit("unknown"))


__all__ = ["atx_headings", "found_with_places", "image_format", "link", "markdown_word_count", "normalised", "office_plain", "plain", "table", "trimmed_lines"]
