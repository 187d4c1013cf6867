"""Which parser takes which suffix: a small dimension, resolved by priority."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify

SCHEMA = "reg_order int, name string, ext string, priority int, version string, description string"


@dataclass
class Registry:
    """Parsers by name. Of several that take a suffix the one with the highest priority has it, of equals the first."""

    rows: list[tuple] = field(default_factory=list)

    def register(self, extensions: list[str], name: str, priority: int = 0, version: str = "1.0.0", description: str = "") -> None:
        if any(r[1] == name for r in self.rows):
            self.unregister(name)
        order = max((r[0] for r in self.rows), default=0)
        for e in extensions:
            e = e.lower()
            self.rows.append((order := order + 1, name, e if not e or e.startswith(".") else f".{e}", priority, version, description))

    def unregister(self, name: str) -> bool:
        before = len(self.rows)
        self.rows = [r for r in self.rows if r[1] != name]
        return len(self.rows) < before

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, SCHEMA)

    def parser_of(self, ext: str) -> str | None:
        found = sorted((-r[3], r[0], r[1]) for r in self.rows if r[2] == ext.lower())
        return found[0][2] if found else None


def builtin() -> Registry:
    """The parsers of this package. Files without a suffix are text."""
    r = Registry()
    r.register([".epub"], "epub", description="E-books")
    r.register([".pdf"], "pdf", description="Page-described documents")
    r.register([".docx"], "docx", description="Office documents")
    r.register([".html", ".htm"], "html", description="Web pages")
    r.register([".md", ".markdown"], "markdown", description="Markdown")
    r.register([".txt", ""], "text", description="Plain text")
    r.register([".jpg", ".jpeg", ".png", ".gif", ".webp", ".tiff", ".tif", ".heic"], "photo", description="Photos")
    return r


def resolved(parsers: DataFrame) -> DataFrame:
    """One row for each suffix: the parser that has it."""
    w = Window.partitionBy("ext").orderBy(F.desc("priority"), "reg_order")
    return parsers.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def supported_formats(parsers: DataFrame) -> DataFrame:
    return parsers.select("ext").where("ext <> ''").distinct().orderBy("ext")


def format_of(path: Column | str, content: Column | None = None) -> Column:
    """Format by the first bytes where they tell, else by the suffix; null if neither does."""
    by_suffix = F.lit(None).cast("string")
    for _, name, ext, *_ in builtin().rows:
        by_suffix = F.when(classify.suffix(path) == ext, name).otherwise(by_suffix)
    by_suffix = F.when(F.col(path).isNotNull() if isinstance(path, str) else path.isNotNull(), by_suffix)
    if content is None:
        return by_suffix
    head = F.hex(F.substring(content, 1, 8))
    return (
        F.when(head.startswith("25504446"), "pdf").when(head.startswith("FFD8FF") | head.startswith("89504E47") | head.startswith("47494638"), "photo")
        .when(head.startswith("504B0304") & by_suffix.isin("epub", "docx"), by_suffix).otherwise(by_suffix)
    )


def routed(files: DataFrame, parsers: DataFrame, path_col: str = "path") -> DataFrame:
    """``files`` with the name of their parser, null if none takes them; web addresses go to ``html``."""
    ext = classify.suffix(F.regexp_replace(path_col, "[?#].*$", ""))
    rows = resolved(parsers).select(F.col("ext").alias("__ext"), F.col("name").alias("parser"))
    out = files.withColumn("__suffix", ext).join(F.broadcast(rows), F.col("__suffix") == F.col("__ext"), "left").drop("__ext", "__suffix")
    return out.withColumn("parser", F.when(classify.is_url(path_col), "html").otherwise(F.col("parser")))
