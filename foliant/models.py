"""Schemas of the tables, the document row, and its JSON form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHAPTER = "struct<chapter_id:bigint,title:string,content:string,start_position:bigint,end_position:bigint,word_count:bigint,level:int,metadata:map<string,string>>"
IMAGE = "struct<image_id:string,position:bigint,file_path:string,alt_text:string,size:struct<width:int,height:int>,format:string>"
QR_CODE = "struct<qr_id:string,raw_data:string,data_type:string,source_image:string,position:struct<x:int,y:int,width:int,height:int>,page_number:int,fetched_content:string,fetch_status:string,fetch_notes:array<string>>"
METADATA = "struct<title:string,author:string,authors:array<string>,publisher:string,publication_date:timestamp,language:string,isbn:string,description:string,tags:array<string>,original_format:string,file_size:bigint,custom_fields:map<string,string>>"
PROCESSING = "struct<parser_used:string,parser_version:string,processing_time:double,timestamp:timestamp,warnings:array<string>,options_used:map<string,string>>"
DOCUMENT = f"document_id string, content string, chapters array<{CHAPTER}>, images array<{IMAGE}>, metadata {METADATA}, processing_info {PROCESSING}, word_count bigint, estimated_reading_time bigint, qr_codes array<{QR_CODE}>"
_META_FIELDS = {
    "title": "string", "author": "string", "authors": "array<string>", "publisher": "string", "publication_date": "timestamp", "language": "string", "isbn": "string", "description": "string", "tags": "array<string>",
    "original_format": "string", "file_size": "bigint", "custom_fields": "map<string,string>",
}


def metadata_struct(**fields: Column) -> Column:
    """A metadata value; fields that aren't given are null, file_size is 0."""
    if unknown := set(fields) - set(_META_FIELDS):
        raise ValueError(f"no metadata fields: {sorted(unknown)}")
    absent = lambda n, t: (F.lit(0) if n == "file_size" else F.lit(None)).cast(t)
    return F.struct(*[(fields[n].cast(t) if n in fields else absent(n, t)).alias(n) for n, t in _META_FIELDS.items()])


def chapters_of(documents: DataFrame) -> DataFrame:
    return documents.select("document_id", F.inline("chapters"))


def images_of(documents: DataFrame) -> DataFrame:
    return documents.select("document_id", F.inline("images"))


def chapter(documents: DataFrame, chapter_id: int) -> DataFrame:
    """The first chapter with the number, for each document; null if there is none."""
    found = F.try_element_at(F.filter("chapters", lambda c: c["chapter_id"] == chapter_id), F.lit(1))
    return documents.select("document_id", found.alias("chapter"))


def with_chapters(documents: DataFrame, chapters: DataFrame, id_col: str = "document_id") -> DataFrame:
    """``documents`` with their chapter rows as one array in order. A document's chapters meet in one row, as its content does."""
    fields = ("chapter_id", "title", "content", "start_position", "end_position", "word_count", "level", "metadata")
    rows = chapters if "metadata" in chapters.columns else chapters.withColumn("metadata", F.create_map().cast("map<string,string>"))
    grouped = rows.groupBy(id_col).agg(F.collect_list(F.struct(*fields)).alias("chapters"))
    ordered = F.array_sort("chapters", lambda a, b: F.when(a["chapter_id"] < b["chapter_id"], -1).when(a["chapter_id"] > b["chapter_id"], 1).otherwise(0))
    return documents.join(grouped.select(id_col, ordered.alias("chapters")), id_col, "left").withColumn("chapters", F.coalesce("chapters", F.array().cast(f"array<{CHAPTER}>")))


def write_json(documents: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON object a line; times as ISO 8601."""
    documents.write.mode(mode).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").option("ignoreNullFields", "false").json(path)


def read_json(spark, path: str) -> DataFrame:
    """What ``write_json`` wrote, with all nested types, codes and sizes too."""
    return spark.read.schema(DOCUMENT).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").json(path)
