"""Image references of Markdown and image bytes: rows, sizes, checks."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.classify import suffix
from ..functions.markdown import INLINE_IMAGE, REFERENCE, REFERENCE_IMAGE, image_format
from ..functions.text import strip

LEAST_PIXELS, MOST_BYTES = 100, 50 * 1024 * 1024


def _places(text: Column, pattern: str) -> Column:
    """array<struct<match, position>> of matches anywhere in a line: each is located after the one before."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<match:string,position:bigint>>").alias("found"))

    def step(acc: Column, m: Column) -> Column:
        at = F.call_function("locate", m, text, acc["next"])
        return F.struct((at + F.length(m)).cast("int").alias("next"), F.concat(acc["found"], F.array(F.struct(m.alias("match"), (at - 1).cast("long").alias("position")))).alias("found"))

    return F.aggregate(matches, start, step)["found"]


def resolved_path(path: Column, folder: Column) -> Column:
    """Addresses, data and absolute paths stay; others are below the file's folder, with ``.`` and ``..`` taken out."""
    joined = F.split(F.concat(folder, F.lit("/"), path), "/", -1)
    parts = F.aggregate(
        joined, F.array().cast("array<string>"),
        lambda acc, x: F.when((x == ".") | ((x == "") & (F.size(acc) > 0)), acc).when((x == "..") & (F.size(acc) > 1), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
    )
    return F.when(path.rlike(r"(?i)\A(?:https?://|data:)") | path.startswith("/"), path).otherwise(F.array_join(parts, "/"))


def references(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ref, url, title) of reference definitions; of several with a name (in any case) the last counts."""
    rows = docs.select(id_col, F.posexplode(F.regexp_extract_all(text_col, F.lit(REFERENCE), F.lit(0))).alias("i", "m"))
    part = lambda n: F.regexp_extract("m", REFERENCE, n)
    named = rows.select(id_col, "i", F.lower(strip(part(1))).alias("ref"), strip(part(2)).alias("url"), F.nullif(strip(part(3)), F.lit("")).alias("title"))
    return named.groupBy(id_col, "ref").agg(F.max_by(F.struct("url", "title"), "i").alias("d")).select(id_col, "ref", "d.url", "d.title")


def markdown_images(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder_col: str | None = None) -> DataFrame:
    """A row for each image of each document: inline ones by place, then those by reference; the first of a resolved path counts."""
    folder = F.col(folder_col) if folder_col else F.lit("")
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), folder.alias("folder"))
    found = lambda pattern: base.select("id", "folder", F.explode(_places(F.col("text"), pattern)).alias("m")).select("id", "folder", "m.match", "m.position")
    inline = found(INLINE_IMAGE).select("id", "folder", F.lit(0).alias("kind"), "position", F.regexp_extract("match", INLINE_IMAGE, 1).alias("alt"), F.regexp_extract("match", INLINE_IMAGE, 2).alias("path"))
    named = found(REFERENCE_IMAGE).select("id", "folder", "position", F.regexp_extract("match", REFERENCE_IMAGE, 1).alias("alt"), F.lower(strip(F.regexp_extract("match", REFERENCE_IMAGE, 2))).alias("ref"))
    defined = references(base, "id", "text")
    by_name = named.join(defined, ["id", "ref"]).select("id", "folder", F.lit(1).alias("kind"), "position", "alt", F.col("url").alias("path"))
    rows = inline.unionByName(by_name).withColumn("file_path", resolved_path(F.col("path"), F.col("folder")) if folder_col else F.col("path"))
    first = Window.partitionBy("id", "file_path").orderBy("kind", "position")
    order = Window.partitionBy("id").orderBy("kind", "position")
    kept = rows.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    return kept.select(
        F.col("id").alias(id_col), F.format_string("img_%03d", F.row_number().over(order)).alias("image_id"), "position", "file_path", F.nullif("alt", F.lit("")).alias("alt_text"), image_format("path").alias("format")
    )


def image_size(data: bytes | None) -> tuple[int | None, int | None, str]:
    """(width, height, format) from the header of PNG, GIF, JPEG, BMP and WebP; (None, None, "unknown") otherwise."""
    d = data or b""
    try:
        if d[:8] == b"\x89PNG\r\n\x1a\n":
            return (*struct.unpack(">II", d[16:24]), "png")
        if d[:6] in (b"GIF87a", b"GIF89a"):
            return (*struct.unpack("<HH", d[6:10]), "gif")
        if d[:2] == b"BM":
            w, h = struct.unpack("<ii", d[18:26])
            return w, abs(h), "bmp"
        if d[:4] == b"RIFF" and d[8:12] == b"WEBP":
            if d[12:16] == b"VP8X":
                return 1 + int.from_bytes(d[24:27], "little"), 1 + int.from_bytes(d[27:30], "little"), "webp"
            if d[12:16] == b"VP8L":
                bits = int.from_bytes(d[21:25], "little")
                return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF), "webp"
            w, h = struct.unpack("<HH", d[26:30])
            return w & 0x3FFF, h & 0x3FFF, "webp"
        if d[:2] == b"\xff\xd8":
            at = 2
            while at + 9 < len(d):
                if d[at] != 0xFF:
                    at += 1
                    continue
                kind = d[at + 1]
                if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", d[at + 5 : at + 9])
                    return w, h, "jpeg"
                at += 2 if kind == 0xFF or 0xD0 <= kind <= 0xD9 else 2 + struct.unpack(">H", d[at + 2 : at + 4])[0]
    except struct.error:
        pass
    return None, None, "unknown"


def sized(rows: DataFrame, content_col: str = "content") -> DataFrame:
    """``rows`` with width, height and format read from image bytes."""
    schema = T.StructType([*rows.schema.fields, T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("format", T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [image_size(x) for x in batch.column(batch.schema.get_field_index(content_col)).to_pylist()]
            cols = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def checked(rows: DataFrame, content_col: str = "content", least: int = LEAST_PIXELS) -> DataFrame:
    """Sized rows with ``problem``: empty, too large, no image, too small; null if the image may be kept."""
    problem = (
        F.when(F.col(content_col).isNull() | (F.length(content_col) == 0), "empty").when(F.length(content_col) > MOST_BYTES, "too large")
        .when(F.col("width").isNull(), "no image").when((F.col("width") < least) | (F.col("height") < least), "too small")
    )
    return rows.withColumn("problem", problem)


def extension_of_type(content_type: Column | str) -> Column:
    """Extension for a MIME type, png if it isn't known."""
    c = F.lower(F.col(content_type) if isinstance(content_type, str) else content_type)
    out = F.lit("png")
    for part, ext in (("icon", "ico"), ("tiff", "tiff"), ("bmp", "bmp"), ("svg", "svg"), ("webp", "webp"), ("gif", "gif"), ("png", "png"), ("jpg", "jpg"), ("jpeg", "jpg")):
        out = F.when(F.contains(c, F.lit(part)), ext).otherwise(out)
    return out


def extracted(read: DataFrame, id_col: str, least: int = 1, most: int = MOST_BYTES, base: str | None = None) -> DataFrame:
    """A row for each image that a reader gave (``images``: idx, file_name, content): image_id img_<nnn> by its number, position 0, width, height,
    format, ``file_name`` to save it by (below its folder as in the container, or <base>_<nnn>.<format>), content, and ``problem`` if it
    should be left out."""
    rows = sized(read.select(id_col, F.inline("images")))
    kind = F.when(F.col("format") == "unknown", F.lit("png")).otherwise(F.col("format"))
    number = F.format_string("%03d", "idx")
    name = F.concat(F.lit(f"{base}_"), number, F.lit("."), kind) if base else F.regexp_replace("file_name", r"\A(?:\.?\.?/)+", "")
    out = rows.withColumns({"image_id": F.concat(F.lit("img_"), number), "position": F.lit(0).cast("long"), "file_name": name})
    return checked(out, least=least)


def dominant_colours(pixels, count: int = 5) -> list[str]:
    """``#rrggbb`` of at most ``count`` colours by median cut: the box of pixels that spreads most is cut at the median of its longest side,
    and each box gives its mean. ``pixels``: n x 3 numbers of 0 to 255."""
    import numpy as np

    p = np.asarray(pixels, np.int64).reshape(-1, 3)
    if not len(p):
        return []
    boxes = [p]
    while len(boxes) < count:
        spread = [int((np.ptp(b, axis=0)).max()) if len(b) > 1 else 0 for b in boxes]
        k = max(range(len(boxes)), key=lambda i: (spread[i], len(boxes[i])))
        if not spread[k]:
            break
        box = boxes.pop(k)
        side = int(np.ptp(box, axis=0).argmax())
        values = box[:, side]
        cut = np.median(values)
        low = values <= cut if (values > cut).any() else values < cut
        boxes += [box[low], box[~low]]
    boxes.sort(key=lambda b: (-len(b), b.mean(0).tolist()))
    return ["#{:02x}{:02x}{:02x}".format(*(int(x + 0.5) for x in b.mean(0))) for b in boxes]


def png_pixels(data: bytes, step_to: int = 150):
    """Pixels (n x 3) of an 8-bit PNG without interlacing (grey, RGB, palette, with or without alpha), about every k-th so that no more than ``step_to``
    are left on a side; None for others."""
    import numpy as np

    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, body, palette, head = 8, b"", None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += part
        at += 12 + size
    w, h, bits, colour, _, _, interlace = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if bits != 8 or interlace or not channels:
        return None
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * channels)
    rows = np.zeros((h, w * channels), np.uint8)
    before = np.zeros(w * channels, np.int64)
    for y in range(h):
        f, x = raw[y, 0], raw[y, 1:].astype(np.int64)
        if f == 1:
            x = np.cumsum(x.reshape(w, channels), axis=0).ravel() & 255
        elif f == 2:
            x = x + before & 255
        elif f in (3, 4):
            for i in range(len(x)):
                a, b = (x[i - channels] if i >= channels else 0), before[i]
                if f == 3:
                    x[i] = x[i] + (a + b) // 2 & 255
                else:
                    c = before[i - channels] if i >= channels else 0
                    x[i] = x[i] + min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2] & 255
        rows[y] = before = x
    cut = rows.reshape(h, w, channels)[:: max(1, h // step_to), :: max(1, w // step_to)].reshape(-1, channels)
    if colour == 3:
        return palette[cut[:, 0]]
    return np.repeat(cut[:, :1], 3, axis=1) if channels < 3 else cut[:, :3]


def coloured(rows: DataFrame, content_col: str = "content", count: int = 5, pixels=png_pixels) -> DataFrame:
    """``rows`` with ``colours``: ``dominant_colours`` of every image that ``pixels`` (bytes -> n x 3, or None) reads; empty for others."""
    schema = T.StructType([*rows.schema.fields, T.StructField("colours", T.ArrayType(T.StringType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column(batch.schema.get_field_index(content_col)).to_pylist():
                try:
                    seen = pixels(data) if data else None
                except Exception:  # an image that can't be read has no colours
                    seen = None
                out.append([] if seen is None else dominant_colours(seen, count))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.string()))], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


__all__ = ["coloured", "dominant_colours", "extracted", "png_pixels", "checked", "extension_of_type", "image_size", "markdown_images", "references", "resolved_path", "sized", "suffix"]


def named(rows: DataFrame, id_col: str, order_col: str, base: str = "image", original_col: str | None = None) -> DataFrame:
    """``rows`` with ``file_name``: <base>_<nnn>.<format> by place, or the original path below its folder."""
    w = Window.partitionBy(id_col).orderBy(order_col)
    plain = F.concat(F.format_string(f"{base}_%03d.", F.row_number().over(w)), F.when(F.col("format") == "unknown", "png").otherwise(F.col("format")))
    return rows.withColumn("file_name", F.coalesce(F.regexp_replace(F.col(original_col), r"\A(?:\.?\.?/)+", ""), plain) if original_col else plain)


def downloaded(rows: DataFrame, fetch=None, url_col: str = "file_path") -> DataFrame:
    """``rows`` with the bytes that ``fetch`` (address -> bytes) gives, or the network (``web.Web``); null where it fails, so ids keep their gaps."""
    if fetch is None:
        from ..sources.web import Web

        fetch = Web().bytes
    schema = T.StructType([*rows.schema.fields, T.StructField("content", T.BinaryType())])
    at = rows.columns.index(url_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for url in batch.column(at).to_pylist():
                try:
                    out.append(fetch(url))
                except Exception:  # a failed download is a null
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)
