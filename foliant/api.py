"""The calls for one document or one folder, over the plans of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .config import parsing_options
from .errors import FileReadError, NetworkError, ParsingError, UnsupportedFormatError
from .functions.classify import is_url as _is_url
from .plans import documents as plans
from .plans.registry import Registry, builtin
from .sources import files
from .sources.web import Web

REGISTRY: Registry = builtin()


def supported_formats() -> list[str]:
    return sorted({r[2] for r in REGISTRY.rows if r[2]})


def suffix_of(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[1].lower() if "." in name[1:] else ""


def is_supported(path: str) -> bool:
    """Whether ``parse_document`` has a parser for a path or web address."""
    return path.lower().startswith(("http://", "https://")) or REGISTRY.parser_of(suffix_of(path)) is not None


def parse_folder(spark: SparkSession, path: str, options: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, errors) of all files below a folder."""
    return plans.parse(spark, path, options)


def parse_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html", options: dict | None = None) -> DataFrame:
    """Documents of fetched pages (address, markup)."""
    found = pages.select(
        F.col(url_col).alias("path"), F.lit("html").alias("parser"), F.regexp_replace(F.regexp_replace(F.col(url_col), r"[?#].*$", ""), r"\A.*/", "").alias("file_stem"), F.length(html_col).cast("bigint").alias("length"),
        F.lit(None).cast("string").alias("error"), F.array().cast("array<string>").alias("warnings"), F.col(html_col).cast("binary").alias("content"),
    )
    return plans.parse_files(found, options, ["html"])[0]


def parse_document(spark: SparkSession, source: str, options: dict | None = None, fetch: Callable[[str], tuple[int, str, str]] | None = None) -> Row:
    """One file, or one web address, as a document row; ``fetch`` stands in for the network.

    Raises UnsupportedFormatError, FileReadError, NetworkError or ParsingError.
    """
    if source.lower().startswith(("http://", "https://")):
        if not spark.range(1).select(_is_url(F.lit(source))).first()[0]:
            raise UnsupportedFormatError(f"no web address: {source}")
        if fetch is None:
            chosen = parsing_options("html", user=options)
            fetch = Web(chosen["timeout"], chosen["rate_limit"], chosen["verify_ssl"]).get
        try:
            status, _, body = fetch(source)
        except Exception as e:
            raise NetworkError(f"{source}: {e}") from e
        if status != 200:
            raise NetworkError(f"{source}: status {status}")
        rows = parse_pages(spark.createDataFrame([(source, body)], "url string, html string"), options=options).collect()
        return rows[0]
    if not is_supported(source):
        raise UnsupportedFormatError(f"no parser for {suffix_of(source) or source}")
    try:
        found = files.validated(files.identified(files.scan(spark, source, max_bytes=None)))
        name = REGISTRY.parser_of(suffix_of(source))
        rows = plans.parse_files(found.withColumn("parser", F.lit(name)), options, [name])[0].collect()
    except Exception as e:
        raise FileReadError(f"{source}: {str(e).splitlines()[0]}") from e
    if not rows:
        raise FileReadError(f"{source} is empty or no file")
    d = rows[0]
    if not d.content and any(":" in w for w in d.processing_info.warnings):
        raise ParsingError(d.processing_info.warnings[-1], parser=name)
    return d


class Parser:
    """A format's parser with its own options."""

    def __init__(self, name: str, options: dict | None = None):
        if name not in plans.BRANCHES:
            raise UnsupportedFormatError(f"no parser {name}")
        self.name, self.options = name, options

    def supports(self, path: str) -> bool:
        return REGISTRY.parser_of(suffix_of(path)) == self.name

    def parse(self, spark: SparkSession, path: str) -> DataFrame:
        """Documents of this format at or below ``path``."""
        return plans.parse(spark, path, self.options, [self.name])[0]
