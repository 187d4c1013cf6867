"""Text expressions. All are native: they stay inside whole-stage code generation.

White space is what Unicode calls so, and the four separators 0x1C-0x1F. Lines end with a line feed only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters; as a class of regular expressions, in ranges, they are matched faster than by their property.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
SPACE = r"[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

# The removal rules of the cleaner, in their order.
REMOVALS = (
    r"\[\p{Nd}+\]",
    rf"(?dm)^{SPACE}*Page \p{{Nd}}+.*$",
    rf"(?dm)^{SPACE}*Chapter \p{{Nd}}+{SPACE}*$",
    r"<[^>]+>",
    r"\*{3,}",
    r"_{3,}",
    rf"(?dm)^{SPACE}*[-–—]{{3,}}{SPACE}*$",
    rf"(?dmiu)^{SPACE}*Table of Contents{SPACE}*$",
)
# The replacement rules of the cleaner, in their order.
REPLACEMENTS = (
    ("—", " -- "),
    ("–", "-"),
    ("…", "..."),
    ("[“”\"]", '"'),
    ("[‘’']", "'"),
    (" ", " "),
    (" {2,}", " "),
    ("\t", " "),
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(SPACES))


def rstrip(c: Column | str) -> Column:
    return F.rtrim(col(c), F.lit(SPACES))


def is_blank(c: Column | str) -> Column:
    return F.length(strip(c)) == 0


def lines(c: Column | str) -> Column:
    return F.split(col(c), "\n", -1)


def words(c: Column | str) -> Column:
    return F.filter(F.split(col(c), SPACE + "+"), lambda x: x != "")


def word_count(c: Column | str) -> Column:
    """Words of a text; null is null."""
    return F.size(words(c)).cast("long")


def minutes_up(n: Column, per_minute: int = 200) -> Column:
    """Reading time of plain text and Markdown: rounded up, 1 at least."""
    return F.greatest(F.lit(1), F.ceil(n / per_minute)).cast("long")


def minutes_even(n: Column, per_minute: int = 225) -> Column:
    """Reading time of web pages, e-books and office documents: rounded half to even, 1 at least."""
    return F.greatest(F.lit(1), F.bround(n / per_minute)).cast("long")


def minutes_down(n: Column, per_minute: int = 250) -> Column:
    """Reading time of page-described documents (250) and after scanned codes are merged (200): rounded down, 1 at least."""
    return F.greatest(F.lit(1), F.floor(n / per_minute)).cast("long")


def unix_lines(c: Column | str) -> Column:
    """CRLF and CR become LF."""
    return F.replace(F.replace(col(c), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def decoded(content: Column | str) -> Column:
    """Bytes as UTF-8 where they are valid, else as Latin-1; line ends become LF."""
    c = col(content)
    return unix_lines(F.coalesce(F.try_validate_utf8(c.cast("string")), F.decode(c, "ISO-8859-1")))


def _let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.transform(F.array(c), f)[0]


def _where(c: Column, marks: tuple[str, ...], pattern: str, new: str) -> Column:
    """A replacement for texts that hold one of ``marks``, without which the pattern can't match; others are not searched."""

    def step(t: Column) -> Column:
        some = F.contains(t, F.lit(marks[0]))
        for m in marks[1:]:
            some = some | F.contains(t, F.lit(m))
        return F.when(some, F.regexp_replace(t, pattern, new)).otherwise(t)

    return _let(c, step)


#: What a text must hold for each rule to match: for each removal, and for each replacement.
_MARKS = (("[",), ("Page ",), ("Chapter ",), ("<",), ("***",), ("___",), ("---", "–", "—"))
_REPLACED = (("—",), ("–",), ("…",), ("“", "”"), ("‘", "’"), ("\u00a0",), ("  ",), ("\t",))


def removals(c: Column | str) -> Column:
    out = col(c)
    for pattern, marks in zip(REMOVALS[:-1], _MARKS, strict=True):
        out = _where(out, marks, pattern, "")
    return F.regexp_replace(out, REMOVALS[-1], "")  # in any case of letters


def replacements(c: Column | str) -> Column:
    out = col(c)
    for (pattern, new), marks in zip(REPLACEMENTS, _REPLACED, strict=True):
        out = _where(out, marks, pattern, new)
    return out


def tidy_lines(c: Column | str, blank_lines: int = 1) -> Column:
    """Each line stripped, at most so many blank lines in a row, the whole stripped."""
    joined = F.array_join(F.transform(lines(c), strip), "\n")
    return strip(F.regexp_replace(joined, "\n{%d,}" % (blank_lines + 2), "\n" * (blank_lines + 1)))


def tidy_space(c: Column | str, spaces: str = SPACES) -> Column:
    """Lines stripped, runs of spaces one, at most one blank line in a row, the whole stripped."""
    joined = F.regexp_replace(F.array_join(F.transform(lines(c), lambda x: F.btrim(x, F.lit(spaces))), "\n"), " {2,}", " ")
    return F.btrim(F.regexp_replace(joined, "\n{3,}", "\n\n"), F.lit(spaces))


def cleaned(c: Column | str, rules: bool = True) -> Column:
    """The cleaner: removals, replacements, white space. Empty and null stay as they are."""
    text = col(c)
    return F.when(text == "", text).otherwise(tidy_space(replacements(removals(text)) if rules else text))


def first_line_title(c: Column | str, otherwise: Column | str) -> Column:
    """The stripped text's first line, stripped, if it has 1 to 99 characters."""
    line = strip(F.element_at(lines(strip(c)), 1))
    return F.when(F.length(line).between(1, 99), line).otherwise(F.lit(otherwise) if isinstance(otherwise, str) else otherwise)


def text_range(c: Column | str, start: int, end: int | None = None) -> Column:
    """Characters from start up to end; numbers below 0 count from the end, as in Python slices."""
    text = col(c)
    n = F.length(text)
    at = lambda i: F.greatest(n + i, F.lit(0)) if i < 0 else F.least(F.lit(i), n)
    a, b = at(start), n if end is None else at(end)
    return F.substring(text, a + 1, F.greatest(b - a, F.lit(0)))


def byte_size(c: Column | str) -> Column:
    """A number of bytes for people: B to TB of 1024, one decimal."""
    n = col(c).cast("double")
    out = F.format_string("%.1f TB", n / 1024**4)
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(n < 1024 ** (power + 1), F.format_string(f"%.1f {unit}", n / 1024**power)).otherwise(out)
    return out


def file_name(c: Column | str) -> Column:
    """A name that is safe on file systems: reserved and control characters go, white space becomes ``_``; empty is ``unnamed``."""
    out = strip(F.regexp_replace(col(c), r'[<>:"/\\|?*\x00-\x1f\x7f]', ""))
    out = F.regexp_replace(out, SPACE + "+", "_")
    return F.when(F.length(out) == 0, F.lit("unnamed")).otherwise(out)
