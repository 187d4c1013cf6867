"""Photos: EXIF of JPEG and TIFF as maps, decoded to camera, exposure and place columns by native expressions."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import byte_size, strip
from ..operators.images import image_size

SCHEMA = "photo_id string, width int, height int, format string, exif map<string,string>, warnings array<string>"
# EXIF tags by number.
TAGS = {
    0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist", 0x8298: "Copyright", 0x829A: "ExposureTime", 0x829D: "FNumber",
    0x8822: "ExposureProgram", 0x8827: "ISOSpeedRatings", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0x9204: "ExposureBiasValue", 0x9207: "MeteringMode", 0x9209: "Flash", 0x920A: "FocalLength", 0x9286: "UserComment",
    0xA001: "ColorSpace", 0xA402: "ExposureMode", 0xA403: "WhiteBalance", 0xA405: "FocalLengthIn35mmFilm", 0xA433: "LensMake", 0xA434: "LensModel",
}
GPS_TAGS = {1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude", 5: "GPSAltitudeRef", 6: "GPSAltitude", 29: "GPSDateStamp", 18: "GPSMapDatum"}
# Code tables of EXIF.
ORIENTATION = {
    1: "Normal", 2: "Mirrored horizontal", 3: "Rotated 180°", 4: "Mirrored vertical", 5: "Mirrored horizontal, rotated 270° CW", 6: "Rotated 90° CW", 7: "Mirrored horizontal, rotated 90° CW", 8: "Rotated 270° CW",
}
FLASH = {
    0x0: "No flash",
    0x1: "Flash fired",
    0x5: "Flash fired, strobe return not detected",
    0x7: "Flash fired, strobe return detected",
    0x9: "Flash fired, compulsory",
    0xD: "Flash fired, compulsory, return not detected",
    0xF: "Flash fired, compulsory, return detected",
    0x10: "Flash did not fire, compulsory",
    0x18: "Flash did not fire, auto",
    0x19: "Flash fired, auto",
    0x1D: "Flash fired, auto, return not detected",
    0x1F: "Flash fired, auto, return detected",
    0x20: "No flash function",
    0x41: "Flash fired, red-eye reduction",
    0x45: "Flash fired, red-eye reduction, return not detected",
    0x47: "Flash fired, red-eye reduction, return detected",
    0x49: "Flash fired, compulsory, red-eye reduction",
    0x4D: "Flash fired, compulsory, red-eye reduction, return not detected",
    0x4F: "Flash fired, compulsory, red-eye reduction, return detected",
    0x59: "Flash fired, auto, red-eye reduction",
    0x5D: "Flash fired, auto, red-eye reduction, return not detected",
    0x5F: "Flash fired, auto, red-eye reduction, return detected",
}
METERING = {0: "Unknown", 1: "Average", 2: "Center-weighted average", 3: "Spot", 4: "Multi-spot", 5: "Pattern", 6: "Partial", 255: "Other"}
EXPOSURE_MODE = {0: "Auto", 1: "Manual", 2: "Auto bracket"}
EXPOSURE_PROGRAM = {0: "Not defined", 1: "Manual", 2: "Normal program", 3: "Aperture priority", 4: "Shutter priority", 5: "Creative program", 6: "Action program", 7: "Portrait mode", 8: "Landscape mode"}
WHITE_BALANCE = {0: "Auto", 1: "Manual"}
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def _values(d: bytes, e: str, kind: int, n: int, at: int):
    if kind in (2, 7):
        raw = d[at : at + n]
        return raw.split(b"\0")[0].decode("utf-8", "replace") if kind == 2 else raw.decode("latin-1")
    if kind in (5, 10):
        return [struct.unpack_from(e + ("II" if kind == 5 else "ii"), d, at + 8 * i) for i in range(n)]
    code = {1: "B", 3: "H", 4: "I", 9: "i"}[kind]
    return list(struct.unpack_from(f"{e}{n}{code}", d, at))


def read_exif(data: bytes) -> dict[str, str]:
    """Tags as text: numbers plain, rationals as a/b, several values separated by spaces."""
    if data[:2] == b"\xff\xd8":
        at = data.find(b"Exif\0\0")
        if at < 0:
            return {}
        d = data[at + 6 :]
    elif data[:4] in (b"II*\0", b"MM\0*"):
        d = data
    else:
        return {}
    e, out = "<" if d[:2] == b"II" else ">", {}

    def directory(at: int, names: dict) -> None:
        for i in range(struct.unpack_from(e + "H", d, at)[0]):
            tag, kind, n = struct.unpack_from(e + "HHI", d, at + 2 + 12 * i)
            place = at + 10 + 12 * i
            if kind not in _SIZES:
                continue
            if _SIZES[kind] * n > 4:
                place = struct.unpack_from(e + "I", d, place)[0]
            if tag in (0x8769, 0x8825):
                directory(struct.unpack_from(e + "I", d, at + 10 + 12 * i)[0], TAGS if tag == 0x8769 else GPS_TAGS)
            elif tag in names:
                v = _values(d, e, kind, n, place)
                out[names[tag]] = v if isinstance(v, str) else " ".join(f"{x[0]}/{x[1]}" if isinstance(x, tuple) else str(x) for x in v)

    directory(struct.unpack_from(e + "I", d, 4)[0], TAGS)
    return out


def read_photos(files: DataFrame, id_col: str = "path", content_col: str = "content") -> DataFrame:
    """(photo_id, width, height, format, exif, warnings); EXIF that can't be read is a warning."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(1).to_pylist():
                w, h, kind = image_size(data)
                notes = [] if w else ["no image"]
                try:
                    exif = read_exif(data or b"")
                except (struct.error, IndexError, RecursionError) as e:
                    exif, notes = {}, [*notes, f"EXIF: {e}"]
                rows.append((w, h, kind, list(exif.items()), notes))
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]], names=["photo_id", "width", "height", "format", "exif", "warnings"])

    return files.select(F.col(id_col).cast("string"), content_col).mapInArrow(run, SCHEMA)


def ratio(c: Column) -> Column:
    """``a/b`` or a number as a double; null for a zero denominator or no number."""
    a, b = F.regexp_extract(c, r"\A(-?[\d.]+)", 1), F.regexp_extract(c, r"/(-?\d+)\z", 1)
    return F.try_divide(a.try_cast("double"), F.when(b == "", F.lit(1.0)).otherwise(b.try_cast("double")))


def _decoded(c: Column, table: dict[int, str], other: Column | None = None) -> Column:
    """A code's name; ``other``, or null, for one that the table does not have."""
    names = F.create_map(*[F.lit(x) for code, name in table.items() for x in (str(code), name)])
    return F.coalesce(F.try_element_at(names, c), F.when(c.isNotNull(), other) if other is not None else F.lit(None).cast("string"))


def flash(c: Column) -> Column:
    return _decoded(c, FLASH, F.concat(F.lit("Unknown ("), c, F.lit(")")))


def orientation(c: Column) -> Column:
    """Photos without the tag, or with 0, stand as they are."""
    return _decoded(F.coalesce(F.nullif(c, F.lit("0")), F.lit("1")), ORIENTATION, F.lit("Unknown"))


def shutter(c: Column) -> Column:
    """``1/N`` below a second, ``Ns`` from one on."""
    v = ratio(c)
    return F.when(v >= 1, F.concat(F.regexp_replace(F.format_string("%.1f", v), r"\.0\z", ""), F.lit("s"))).when(v > 0, F.concat(F.lit("1/"), F.bround(1 / v).cast("long")))


def degrees(coords: Column, ref: Column) -> Column:
    """Degrees, minutes, seconds as decimal degrees; south and west are negative."""
    p = F.split(coords, " ")
    value = ratio(F.get(p, 0)) + F.coalesce(ratio(F.get(p, 1)), F.lit(0.0)) / 60 + F.coalesce(ratio(F.get(p, 2)), F.lit(0.0)) / 3600
    return F.when(F.upper(ref).isin("S", "W"), -value).otherwise(value)


def dms(value: Column, positive: str, negative: str) -> Column:
    a = F.abs(value)
    d = F.floor(a)
    m = F.floor((a - d) * 60)
    s = ((a - d) * 60 - m) * 60
    return F.format_string("%d°%d'%.2f\"%s", d.cast("int"), m.cast("int"), s, F.when(value >= 0, positive).otherwise(negative))


def described(photos: DataFrame) -> DataFrame:
    """Photos with camera, exposure, time and place columns."""
    t = lambda k: F.nullif(strip(F.translate(F.try_element_at("exif", F.lit(k)), "\x00", "")), F.lit(""))
    when = lambda k: F.coalesce(F.try_to_timestamp(t(k), F.lit("yyyy:MM:dd HH:mm:ss")), F.try_to_timestamp(F.substring(t(k), 1, 10), F.lit("yyyy:MM:dd")))
    comment = F.try_element_at("exif", F.lit("UserComment"))
    lat, lon = degrees(t("GPSLatitude"), t("GPSLatitudeRef")), degrees(t("GPSLongitude"), t("GPSLongitudeRef"))
    return photos.select(
        "photo_id", "width", "height", "format", "warnings", "exif",
        F.when(F.col("height") > 0, F.col("width") / F.col("height")).otherwise(F.lit(0.0)).alias("aspect_ratio"), (F.col("width").cast("double") * F.col("height") / 1e6).alias("megapixels"), orientation(t("Orientation")).alias("orientation"),
        t("Make").alias("make"), t("Model").alias("model"), t("LensMake").alias("lens_make"), t("LensModel").alias("lens_model"), t("Software").alias("software"), t("Artist").alias("artist"), t("Copyright").alias("copyright"), t("ImageDescription").alias("description"),
        F.nullif(strip(F.translate(F.when(comment.rlike(r"(?s)\A(?:ASCII|UNICODE|JIS)\x00"), F.substring(comment, F.lit(9), F.length(comment))).otherwise(comment), "\x00", "")), F.lit("")).alias("user_comment"),
        shutter(t("ExposureTime")).alias("shutter_speed"), ratio(t("FNumber")).alias("aperture"), t("ISOSpeedRatings").try_cast("int").alias("iso"), ratio(t("FocalLength")).alias("focal_length"), t("FocalLengthIn35mmFilm").try_cast("int").alias("focal_length_35mm"), ratio(t("ExposureBiasValue")).alias("exposure_bias"),
        _decoded(t("MeteringMode"), METERING).alias("metering_mode"), _decoded(t("ExposureMode"), EXPOSURE_MODE).alias("exposure_mode"), _decoded(t("ExposureProgram"), EXPOSURE_PROGRAM).alias("exposure_program"), _decoded(t("WhiteBalance"), WHITE_BALANCE).alias("white_balance"), flash(t("Flash")).alias("flash"),
        F.coalesce(when("DateTimeOriginal"), when("DateTimeDigitized"), when("DateTime")).alias("taken"), lat.alias("latitude"), lon.alias("longitude"), F.when(t("GPSAltitudeRef") == "1", -ratio(t("GPSAltitude"))).otherwise(ratio(t("GPSAltitude"))).alias("altitude"),
        F.when(lat.isNotNull() & lon.isNotNull(), F.format_string("%.6f, %.6f", lat, lon)).alias("coordinates"), F.when(lat.isNotNull() & lon.isNotNull(), F.concat_ws(" ", dms(lat, "N", "S"), dms(lon, "E", "W"))).alias("coordinates_dms"),
    )


def markdown(described_photos: DataFrame, size_col: str | None = None) -> DataFrame:
    """(photo_id, content): what is known of a photo as sectioned Markdown."""
    line = lambda label, c: F.when(c.isNotNull(), F.concat(F.lit(f"- **{label}:** "), c.cast("string")))
    section = lambda title, *ls: F.when(F.size(F.array_compact(F.array(*ls))) > 0, F.concat(F.lit(f"## {title}\n\n"), F.array_join(F.array_compact(F.array(*ls)), "\n")))
    c = F.col
    name = F.element_at(F.split("photo_id", "/"), -1)
    parts = F.array_compact(F.array(
        F.concat(F.lit("# "), name), c("description"),
        section("Image", line("Dimensions", F.concat_ws(" x ", c("width").cast("string"), c("height").cast("string"))), line("Format", c("format")), line("Taken", F.date_format("taken", "yyyy-MM-dd HH:mm:ss")), *([line("Size", byte_size(size_col))] if size_col else [])),
        section("Camera", line("Make", c("make")), line("Model", c("model")), line("Lens", c("lens_model"))),
        section("Exposure", line("Shutter", c("shutter_speed")), line("Aperture", F.when(c("aperture").isNotNull(), F.format_string("f/%.1f", "aperture"))), line("ISO", c("iso")), line("Flash", c("flash"))),
        section("Place", line("Coordinates", c("coordinates"))),
    ))
    return described_photos.select("photo_id", F.array_join(parts, "\n\n").alias("content"))
