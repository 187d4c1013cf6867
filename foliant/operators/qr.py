"""Codes found in images and pages: checks of addresses, fetching, summaries, and merging into documents.

Fetching goes through a function that the caller gives (address -> status, type, body); the plan around it is
native: candidates in order, safety of each, first success, notes.
"""

from __future__ import annotations

import ipaddress
import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import classify
from ..functions.text import minutes_down, strip, word_count

#: Least characters of a page for its fetch to count; most that are kept (a note says so).
LEAST_CONTENT, MOST_CONTENT = 50, 500_000


def in_domains(rows: DataFrame, host_col: str, allowed: list[str] | None = None, blocked: list[str] | None = None) -> DataFrame:
    """Rows whose host is, or is below, an allowed domain (any, if None) and no blocked one. Null hosts are no one's."""
    host = F.col(host_col)
    below = lambda domains: F.coalesce(F.concat(F.lit("."), host).rlike(r"(?:" + "|".join(r"\." + d.replace(".", r"\.") for d in domains) + r")\z"), F.lit(False)) if domains else F.lit(False)
    return rows.where((below(allowed) if allowed is not None else host.isNotNull()) & ~below(blocked or []))


def networks(spark, version: int = 4) -> DataFrame:
    """(cidr, lo, hi) of the blocked networks: numbers for version 4, 32 hexadecimal digits for version 6."""
    nets = [n for n in map(ipaddress.ip_network, classify.BLOCKED_NETWORKS) if n.version == version]
    if version == 4:
        return spark.createDataFrame([(str(n), int(n[0]), int(n[-1])) for n in nets], "cidr string, lo long, hi long")
    return spark.createDataFrame([(str(n), f"{int(n[0]):032x}", f"{int(n[-1]):032x}") for n in nets], "cidr string, lo string, hi string")


def blocked(rows: DataFrame, ip_col: str) -> DataFrame:
    """Rows whose version 4 address lies in a blocked network (a range join with a handful of rows, so broadcast)."""
    n = classify.ipv4_number(ip_col)
    nets = networks(rows.sparkSession)
    return rows.withColumn("__n", n).join(F.broadcast(nets), F.col("__n").between(nets.lo, nets.hi), "left_semi").drop("__n")


def safe(urls: DataFrame, url_col: str, addresses: DataFrame | None = None, allowed: list[str] | None = None, blocked_domains: list[str] | None = None) -> DataFrame:
    """``urls`` with ``safe`` and ``reason``: scheme, host, domain lists, and, where ``addresses`` (host, ip) knows the host, blocked networks."""
    host = classify.host(url_col)
    ok_domain = lambda df: in_domains(df, "__host", allowed, blocked_domains)
    base = urls.withColumn("__host", host)
    hosts = base.select("__host").distinct()
    listed = ok_domain(hosts).select("__host", F.lit(True).alias("__listed"))
    out = base.join(listed, "__host", "left")
    if addresses is not None:
        bad = blocked(addresses, "ip").select(F.col("host").alias("__host"), F.lit(True).alias("__inside")).distinct()
        out = out.join(bad, "__host", "left")
    else:
        out = out.withColumn("__inside", F.lit(None).cast("boolean"))
    reason = (
        F.when(~classify.scheme(url_col).isin("http", "https"), F.concat(F.lit("blocked scheme: "), classify.scheme(url_col)))
        .when(F.col("__host") == "", "no host")
        .when(F.col("__listed").isNull(), "domain not allowed")
        .when(F.col("__host").isin("localhost") | F.coalesce("__inside", F.lit(False)), "address in a blocked network")
    )
    return out.withColumn("reason", reason).withColumn("safe", F.col("reason").isNull()).drop("__host", "__listed", "__inside")


def candidates(codes: DataFrame, url_col: str = "raw_data", archive: str | None = "https://web.archive.org/web/2/") -> DataFrame:
    """A row for each address to try, in order: the address, its variations, an archive's copy. ``ftp`` addresses have none."""
    url = classify.with_scheme(url_col)
    tries = F.concat(F.array(url), classify.url_variations(url), *([F.array(F.concat(F.lit(archive), url))] if archive else []))
    usable = ~F.coalesce(strip(url_col).rlike(r"(?i)\Aftp://"), F.lit(True))
    return codes.where(usable).select("*", F.posexplode(tries).alias("try_no", "try_url"))


def first_success(tries: DataFrame, key: list[str]) -> DataFrame:
    """(key, status, content, notes): the first try of each key whose status is 200 and whose content has over LEAST_CONTENT characters."""
    good = (F.col("status") == 200) & (F.length(strip("content")) > LEAST_CONTENT)
    best = F.min_by(F.when(good, F.struct("try_url", "content")), F.when(good, F.col("try_no")))
    notes = F.transform(F.array_sort(F.collect_list(F.struct("try_no", F.concat_ws(" ", "try_url", F.col("status").cast("string")).alias("note")))), lambda x: x["note"])
    out = tries.groupBy(*key).agg(best.alias("best"), notes.alias("fetch_notes"))
    return out.select(*key, F.when(F.col("best").isNotNull(), "success").otherwise("failed").alias("fetch_status"), F.substring("best.content", 1, MOST_CONTENT).alias("fetched_content"), F.col("best.try_url").alias("final_url"), F.when(F.length("best.content") > MOST_CONTENT, F.concat("fetch_notes", F.array(F.lit(f"content cut at {MOST_CONTENT} characters")))).otherwise(F.col("fetch_notes")).alias("fetch_notes"))


def fetched(tries: DataFrame, fetch: Callable[[str], tuple[int, str, str]] | None = None, url_col: str = "try_url", delay: float = 0.0, tasks: int | None = None) -> DataFrame:
    """``tries`` with status and content from ``fetch``; without one, from the network (``web.Web``). A call that fails is a row with status 0.

    A partition waits ``delay`` seconds between calls. With ``tasks``, calls go through so many partitions and each waits
    so many times the delay, so all together keep to one call in ``delay`` seconds.
    """
    if fetch is None:
        from ..sources.web import Web

        fetch = Web().get
    if tasks:
        tries, delay = tries.coalesce(tasks), delay * tasks
    schema = tries.schema.simpleString()[7:-1] + ",status:int,content:string"

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = 0.0
        for pdf in frames:
            status, content = [], []
            for url in pdf[url_col]:
                if (wait := last + delay - time.monotonic()) > 0:
                    time.sleep(wait)
                last = time.monotonic()
                try:
                    s, _, body = fetch(url)
                except Exception:  # the network's errors become a row
                    s, body = 0, None
                status.append(s)
                content.append(body)
            yield pdf.assign(status=status, content=content)

    return tries.mapInPandas(run, schema)


def summary(codes: DataFrame) -> DataFrame:
    """(kind, value, n): codes by type and by fetch status, from one pass of grouping sets."""
    sets = codes.groupingSets([[F.col("data_type")], [F.col("fetch_status")]], F.col("data_type"), F.col("fetch_status")).agg(F.count("*").alias("n"), F.grouping("data_type").alias("g"))
    return sets.select(F.when(F.col("g") == 0, "type").otherwise("status").alias("kind"), F.coalesce("data_type", "fetch_status").alias("value"), "n")


def processed(codes: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Codes with status and notes: those that are no address are skipped; addresses take their fetch result, or stay pending."""
    is_url = F.col("data_type") == "URL"
    if results is None:
        none = codes.withColumns({"fetched_content": F.lit(None).cast("string"), "fetch_notes": F.when(~is_url, F.array(F.concat(F.lit("no fetch for type "), "data_type"))).otherwise(F.array().cast("array<string>"))})
        return none.withColumn("fetch_status", F.when(is_url, "pending").otherwise("skipped"))
    r = results.select("doc_id", "qr_id", F.col("fetch_status").alias("__s"), F.col("fetched_content").alias("__c"), F.col("fetch_notes").alias("__n"))
    out = codes.drop("fetch_status", "fetched_content", "fetch_notes").join(r, ["doc_id", "qr_id"], "left")
    status = F.when(is_url, F.coalesce("__s", F.lit("pending"))).otherwise("skipped")
    notes = F.when(is_url, F.coalesce("__n", F.array().cast("array<string>"))).otherwise(F.array(F.concat(F.lit("no fetch for type "), "data_type")))
    return out.withColumns({"fetch_status": status, "fetched_content": F.when(is_url & (F.col("__s") == "success"), F.col("__c")), "fetch_notes": notes}).drop("__s", "__c", "__n")


def section(code_id: Column, data_type: Column, raw: Column, content: Column) -> Column:
    """A code's Markdown section."""
    return F.concat(F.lit("\n\n---\n\n## QR Code: "), code_id, F.lit("\n\n**Type:** "), data_type, F.lit("\n\n**Data:** "), raw, F.when(content.isNotNull(), F.concat(F.lit("\n\n### Fetched Content\n\n"), content)).otherwise(F.lit("")))


def merged(docs: DataFrame, codes: DataFrame) -> DataFrame:
    """Documents (doc_id, content, word_count) with their codes' sections appended in order; fetched words are counted, headers are not."""
    order = F.array_sort(F.collect_list(F.struct("qr_id", section(F.col("qr_id"), F.col("data_type"), F.col("raw_data"), F.col("fetched_content")).alias("s"))))
    added = codes.groupBy("doc_id").agg(F.array_join(F.transform(order, lambda x: x["s"]), "").alias("__added"), F.sum(F.coalesce(word_count("fetched_content"), F.lit(0))).alias("__words"), F.count("*").alias("qr_codes"))
    out = docs.join(added, "doc_id", "left")
    n = F.col("word_count") + F.coalesce("__words", F.lit(0))
    minutes = F.when(F.col("__words").isNotNull(), minutes_down(n, 200)).otherwise(F.col("estimated_reading_time")) if "estimated_reading_time" in docs.columns else minutes_down(n, 200)
    return out.withColumns({"content": F.concat("content", F.coalesce("__added", F.lit(""))), "word_count": n, "estimated_reading_time": minutes, "qr_codes": F.coalesce("qr_codes", F.lit(0))}).drop("__added", "__words")


def decoded(images: DataFrame, decode: Callable[[bytes], list[dict]], id_cols: tuple[str, ...] = ("doc_id", "page_number"), content_col: str = "content") -> DataFrame:
    """Codes in images as ``numbered`` takes them: the id columns, decoder_idx, symbology, raw_data, x, y, width, height, warning.

    ``decode`` (image bytes -> dictionaries with type, data, and x, y, width, height) is the caller's; data that is no UTF-8 is
    read as Latin-1 with a warning, and an image that it fails on is a row without a code and with a warning.
    """
    fields = "decoder_idx int, symbology string, raw_data string, x int, y int, width int, height int, warning string"
    source = images.select(*id_cols, F.col(content_col).alias("__content"))
    schema = T.StructType([*[source.schema[c] for c in id_cols], *T.StructType.fromDDL(fields)])
    names = schema.fieldNames()[len(id_cols) :]

    def rows_of(data: bytes) -> Iterator[dict]:
        try:
            found = list(decode(data))
        except Exception as e:  # one image that can't be decoded is no failed job
            yield {"warning": f"{type(e).__name__}: {e}"}
            return
        for i, code in enumerate(found):
            raw, note = code["data"], None
            if isinstance(raw, bytes):
                try:
                    raw = raw.decode()
                except UnicodeDecodeError:
                    raw, note = raw.decode("latin-1"), f"code {i} is not UTF-8, read as Latin-1"
            yield {"decoder_idx": i, "symbology": code.get("type", "QRCODE"), "raw_data": raw, "warning": note, **{k: code.get(k) for k in ("x", "y", "width", "height")}}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(schema)
        for batch in batches:
            at, rows = [], []
            for i, data in enumerate(batch.column(len(id_cols)).to_pylist()):
                for row in rows_of(data) if data else ():
                    at.append(i)
                    rows.append(row)
            picks = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*[c.take(picks) for c in batch.columns[: len(id_cols)]], *[pa.array([r.get(n) for r in rows], kinds.field(n).type) for n in names]], schema=kinds)

    return source.mapInArrow(run, schema)


def numbered(raw: DataFrame) -> DataFrame:
    """Decoder results (doc_id, page_number, decoder_idx, symbology, raw_data, ...) as codes: QR only, but ids count every barcode of the image."""
    w = Window.partitionBy("doc_id").orderBy("page_number", "decoder_idx")
    out = raw.withColumn("__n", F.row_number().over(w) - 1).where("symbology = 'QRCODE'")
    kind = classify.payload_type("raw_data")
    return out.withColumns({"qr_id": F.format_string("qr_%03d", "__n"), "data_type": kind, "fetch_status": F.when(kind == "URL", "pending").otherwise("skipped")}).drop("__n", "symbology")


def code_chapters(codes: DataFrame, start_position: int = 0) -> DataFrame:
    """A level 2 chapter for each code with fetched content, numbered by code."""
    w = Window.partitionBy("doc_id").orderBy("qr_id")
    rows = codes.where("fetched_content is not null").withColumn("chapter_id", F.row_number().over(w).cast("long"))
    s = section(F.col("qr_id"), F.col("data_type"), F.col("raw_data"), F.col("fetched_content"))
    return rows.select("doc_id", "chapter_id", F.concat(F.lit("QR Code: "), "qr_id").alias("title"), s.alias("content"), F.lit(start_position).cast("long").alias("start_position"), (F.lit(start_position) + F.length(s)).cast("long").alias("end_position"), word_count("fetched_content").alias("word_count"), F.lit(2).alias("level"))


def archived(replies: DataFrame, reply_col: str = "content") -> DataFrame:
    """``replies`` of an archive's availability service with ``snapshot``: the address of the closest copy, null without one."""
    found = F.from_json(reply_col, "archived_snapshots struct<closest struct<available boolean, url string, status string>>")["archived_snapshots"]["closest"]
    return replies.withColumn("snapshot", F.when(found["available"], F.regexp_replace(found["url"], r"\Ahttp://", "https://")))


def from_archive(urls: DataFrame, fetch: Callable[[str], tuple[int, str, str]] | None = None, url_col: str = "url", service: str = "https://archive.org/wayback/available?url=") -> DataFrame:
    """``urls`` with ``snapshot`` (null without a copy), ``status`` and ``content`` of an archive's closest copy."""
    asked = fetched(urls.withColumn("__ask", F.concat(F.lit(service), F.url_encode(url_col))), fetch, "__ask")
    found = archived(asked).drop("__ask", "status", "content")
    copies = fetched(found.where("snapshot is not null"), fetch, "snapshot")
    return copies.unionByName(found.where("snapshot is null").withColumns({"status": F.lit(0), "content": F.lit(None).cast("string")}))
