"""Classifications by ordered rules: addresses, code payloads, dates, tags. All native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, strip

# Networks that no fetch may reach.
BLOCKED_NETWORKS = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "0.0.0.0/8", "::1/128", "fc00::/7", "fe80::/10")
# Date formats of Markdown front matter and of e-books, in their order.
FRONT_MATTER_DATES = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "yyyy", "yyyy-MM", "MMMM d, yyyy", "MMM d, yyyy")
EBOOK_DATES = ("yyyy-MM-dd", "yyyy-MM", "yyyy", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "MMMM d, yyyy")
# Misspelt metadata keys.
TYPOS = {
    "titel": "title", "tittle": "title", "autor": "author", "auteur": "author", "auther": "author", "publiser": "publisher",
    "languaje": "language", "langue": "language", "descripton": "description", "discription": "description", "desciption": "description",
}


def payload_type(data: Column | str) -> Column:
    """URL, EMAIL, PHONE, WIFI, VCARD, GEO, SMS or TEXT: the first rule that holds."""
    d = strip(data)
    return (
        F.when(d.rlike(r"(?i)\A(?:https?://|www\.|ftp://)"), "URL")
        .when(d.rlike(r"(?i)\Amailto:") | d.rlike(r"\A[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\z"), "EMAIL")
        .when(d.rlike(r"(?i)\Atel:"), "PHONE")
        .when(d.rlike(r"(?i)\Awifi:"), "WIFI")
        .when(d.rlike(r"(?i)\Abegin:vcard"), "VCARD")
        .when(d.rlike(r"(?i)\Ageo:"), "GEO")
        .when(d.rlike(r"(?i)\Asms(?:to)?:"), "SMS")
        .otherwise("TEXT")
    )


def scheme(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(url), r"\A([A-Za-z][A-Za-z0-9+.-]*):", 1))


def host(url: Column | str) -> Column:
    """Lower-case host without user and port; empty if the address has none."""
    place = F.regexp_extract(col(url), r"\A[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    bare = F.regexp_replace(place, r"\A.*@", "")
    return F.lower(F.when(bare.startswith("["), F.regexp_extract(bare, r"\A\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(bare, r"\A([^:]*)", 1)))


def is_url(source: Column | str) -> Column:
    return scheme(source).isin("http", "https") & (F.regexp_extract(col(source), r"\A[A-Za-z]+://([^/?#]*)", 1) != "")


def suffix(path: Column | str) -> Column:
    """Lower-case extension with its dot; empty without one, and for names that only begin with a dot."""
    name = F.element_at(F.split(F.regexp_replace(col(path), r"/+\z", ""), "/", -1), -1)
    return F.lower(F.regexp_extract(name, r"(?s)\A.+(\.[^.]+)\z", 1))


def stem(path: Column | str) -> Column:
    name = F.element_at(F.split(F.regexp_replace(col(path), r"/+\z", ""), "/", -1), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+\z", "")


def with_scheme(url: Column | str) -> Column:
    """Stripped, with https:// where the address has neither http nor https."""
    u = strip(url)
    return F.when(u.rlike(r"(?i)\Ahttps?://"), u).otherwise(F.concat(F.lit("https://"), u))


def url_variations(url: Column | str) -> Column:
    """Other addresses that may hold the same page: a print view, without its query, the mobile host, an AMP view."""
    u = col(url)
    bare = F.regexp_replace(u, r"\?.*\z", "")
    base = F.regexp_replace(bare, r"/+\z", "")
    h = host(u)
    mobile = F.when(~h.startswith("m."), F.concat(scheme(u), F.lit("://m."), F.regexp_replace(F.regexp_replace(u, r"\A[A-Za-z]+://", ""), r"\Awww\.", "")))
    return F.array_compact(F.array(F.concat(base, F.lit("/print")), F.when(bare != u, bare), mobile, F.concat(base, F.lit("/amp"))))


def resolved_url(src: Column | str, base: Column | str) -> Column:
    """An address as a page at ``base`` means it; data and absolute addresses stay, null without a base where one is needed."""
    s, b = strip(src), col(base)
    origin = F.concat(scheme(b), F.lit("://"), F.regexp_extract(b, r"\A[A-Za-z]+://([^/?#]*)", 1))
    folder = F.regexp_extract(F.regexp_replace(b, r"[?#].*\z", ""), r"\A([A-Za-z]+://[^/]*(?:/.*)?)/[^/]*\z", 1)
    folder = F.when((folder == "") | folder.rlike(r"\A[A-Za-z]+:/?\z"), origin).otherwise(folder)
    return (
        F.when(s.rlike(r"(?i)\A(?:data:|https?://)"), s)
        .when(s.startswith("//"), F.concat(F.coalesce(F.nullif(scheme(b), F.lit("")), F.lit("https")), F.lit(":"), s))
        .when(b.isNull() | (b == ""), s)
        .when(s.startswith("/"), F.concat(origin, s))
        .otherwise(F.concat(folder, F.lit("/"), s))
    )


def date_of(text: Column | str, formats: tuple[str, ...] = FRONT_MATTER_DATES) -> Column:
    """The first format that the stripped text has; null if none. Naive times are UTC."""
    t = strip(text)
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in formats])


def iso_date(text: Column | str) -> Column:
    """ISO 8601 with or without a zone; null otherwise."""
    t = strip(text)
    return F.when(t.rlike(r"\A\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?\z"), F.try_to_timestamp(t))


def page_date(text: Column | str) -> Column:
    """``D:YYYYMMDDHHMMSS`` of page-described documents, zone unread; without the mark null; a part is filled up."""
    t = col(text)
    digits = F.regexp_extract(t, r"\AD:(\d{4,14})", 1)
    full = F.rpad(digits, 14, "00000101000000")
    whole = F.concat(digits, F.substring(F.lit("00000101000000"), F.length(digits) + 1, F.lit(14)))
    return F.when((digits != "") & full.isNotNull(), F.try_to_timestamp(whole, F.lit("yyyyMMddHHmmss")))


def tag_list(text: Column | str, separators: str = "[,;]") -> Column:
    """Parts between separators, stripped, without empty ones."""
    return F.filter(F.transform(F.split(col(text), separators, -1), strip), lambda x: x != "")


def model_tags(response: Column | str, most: int = 10) -> Column:
    """A model's reply as tags: parts between commas and lines, without list marks, quotes and brackets, lower-case,
    each once, of 50 characters at most, the first ``most``."""
    parts = F.split(col(response), "[,\n]", -1)
    bare = F.transform(parts, lambda x: F.lower(strip(F.regexp_replace(F.regexp_replace(strip(x), r"\A(?:[-*•]|\d+[.)])\s*", ""), r"[\"'\[\]]", ""))))
    return F.slice(F.array_distinct(F.filter(bare, lambda x: (x != "") & (F.length(x) <= 50))), 1, most)


def isbn(identifiers: Column) -> Column:
    """The first identifier that says ISBN, without the prefix."""
    first = F.try_element_at(F.filter(identifiers, lambda x: F.contains(F.lower(x), F.lit("isbn"))), F.lit(1))
    return strip(F.regexp_replace(first, r"(?i)(?:urn:)?isbn:?", ""))


def ipv4_number(ip: Column | str) -> Column:
    """Dotted address as a number; null if it isn't one."""
    p = F.split(col(ip), r"\.", -1)
    ok = col(ip).rlike(r"\A(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\z")
    at = lambda i: F.try_element_at(p, F.lit(i)).cast("long")
    return F.when(ok, at(1) * 16777216 + at(2) * 65536 + at(3) * 256 + at(4))
