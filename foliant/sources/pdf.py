"""Page-described documents: text spans with font size and weight, ruled tables, images, the information dictionary.

A small reader over the standard library: it finds objects without the cross-reference table (also those in object
streams), follows the page tree, inflates streams and runs the text operators. Fonts are read by their ToUnicode
maps or as Latin-1. Encrypted files and scanned pages give no text (see ``chapters.is_scanned``); text recognition is a
function that the caller gives.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import classify, markdown
from ..operators import qr
from .files import time_limit

SCHEMA = """doc_id string, pages int, spans array<struct<page_num:int,span_idx:int,text:string,font_size:double,is_bold:boolean>>,
images array<struct<page_num:int,idx:int,width:int,height:int,content:binary>>, tables array<struct<page_num:int,idx:int,rows:array<array<string>>>>,
info map<string,string>, version string, warnings array<string>"""
#: How near lines of a table must come to each other to meet, in units of the page.
TOUCH = 2.0
_OBJ = re.compile(rb"(\d+)\s+(\d+)\s+obj\b")
_TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|\[|\]|/[^\s<>\[\](){}/%]*|\d+\s+\d+\s+R\b|[+-]?(?:\d+\.?\d*|\.\d+)|<[0-9A-Fa-f\s]*>|\(|[^\s<>\[\](){}/%]+")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Ref(int):
    """Number of an object."""


class Name(str):
    """A name, without its slash."""


def _string(d: bytes, at: int) -> tuple[bytes, int]:
    out, depth, i = bytearray(), 1, at
    while i < len(d):
        c = d[i : i + 1]
        if c == b"\\":
            n = d[i + 1 : i + 2]
            if m := re.match(rb"[0-7]{1,3}", d[i + 1 : i + 4]):
                out.append(int(m[0], 8) & 255)
                i += 1 + len(m[0])
                continue
            out += _ESCAPES.get(n, b"" if n in b"\r\n" else n)
            i += 2
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            return bytes(out), i + 1
        out += c
        i += 1
    return bytes(out), i


def tokens(d: bytes, at: int = 0) -> Iterator[tuple[object, int]]:
    """(value, place after it): numbers, names, strings as bytes, references, and marks and operators as text."""
    while m := _TOKEN.search(d, at):
        t, at = m[0], m.end()
        if t[:1] == b"%":
            continue
        if t == b"(":
            value, at = _string(d, at)
        elif t[:1] == b"/":
            value = Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), t[1:]).decode("latin-1"))
        elif t[:1] == b"<" and t != b"<<":
            digits = re.sub(rb"\s", b"", t[1:-1])
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif t[-1:] == b"R" and t[:1].isdigit():
            value = Ref(t.split()[0])
        else:
            try:
                value = float(t) if b"." in t else int(t)
            except ValueError:
                value = "op:" + t.decode("latin-1")
        yield value, at


def value_at(d: bytes, at: int = 0) -> tuple[object, int]:
    """The first value (dictionary, array, number, name, string, reference) and the place after it."""
    stack: list[list] = []
    for v, end in tokens(d, at):
        if v in ("op:<<", "op:["):
            stack.append([v])
            continue
        if v in ("op:>>", "op:]"):
            if not stack:
                return None, end
            items = stack.pop()[1:]
            v = dict(zip(items[::2], items[1::2])) if v == "op:>>" else items
        elif isinstance(v, str) and v.startswith("op:"):
            v = {"op:true": True, "op:false": False, "op:null": None}.get(v, v)
            if isinstance(v, str):
                return None, end
        if not stack:
            return v, end
        stack[-1].append(v)
    return None, len(d)


class File:
    def __init__(self, data: bytes):
        self.raw: dict[int, bytes] = {}
        places = [(int(m[1]), m.end()) for m in _OBJ.finditer(data)]
        for (n, a), b in zip(places, [p for _, p in places[1:]] + [len(data)]):
            self.raw[n] = data[a:b]
        self.cache: dict[int, object] = {}
        self.trailers = [value_at(data, m.end())[0] for m in re.finditer(rb"trailer\b", data)]
        for n in list(self.raw):
            head = self.get(Ref(n))
            if isinstance(head, dict) and head.get("Type") == "ObjStm":
                body = self.stream(Ref(n)) or b""
                first, pairs = self.get(head.get("First", 0)), [v for v, _ in tokens(body[: self.get(head.get("First", 0))])]
                starts = pairs[1::2]
                for k, (num, s) in enumerate(zip(pairs[::2], starts)):
                    end = starts[k + 1] if k + 1 < len(starts) else len(body) - first
                    self.raw.setdefault(num, body[first + s : first + end])
            elif isinstance(head, dict) and head.get("Type") == "XRef":
                self.trailers.append(head)

    def get(self, v):
        for _ in range(50):
            if not isinstance(v, Ref):
                return v
            if int(v) not in self.cache:
                self.cache[int(v)] = value_at(self.raw.get(int(v), b""))[0]
            v = self.cache[int(v)]
        return None

    def stream(self, ref, coded: tuple[str, ...] = ()) -> bytes | None:
        """A stream's bytes, inflated; those of a filter in ``coded`` as they are, of any other null."""
        raw = self.raw.get(int(ref), b"") if isinstance(ref, Ref) else b""
        head, at = value_at(raw)
        m = re.compile(rb"stream\r?\n").search(raw, at)
        if not isinstance(head, dict) or not m:
            return None
        size = self.get(head.get("Length"))
        end = m.end() + size if isinstance(size, int) and raw[m.end() + size : m.end() + size + 20].lstrip().startswith(b"endstream") else raw.rfind(b"endstream")
        body = raw[m.end() : end if end >= 0 else len(raw)]
        filters = self.get(head.get("Filter"))
        for f in filters if isinstance(filters, list) else [filters]:
            if f in ("FlateDecode", "Fl"):
                body = zlib.decompressobj().decompress(body)
            elif f is not None and f not in coded:
                return None
        return body

    def image(self, ref) -> bytes | None:
        """An image as a file: JPEG as it is stored, 8-bit grey and RGB as PNG; of other kinds null."""
        head = self.get(ref)
        filters = self.get(head.get("Filter"))
        if "DCTDecode" in (filters if isinstance(filters, list) else [filters]):
            return self.stream(ref, ("DCTDecode",))
        parms, space, bits, w, h = (self.get(head.get(k)) for k in ("DecodeParms", "ColorSpace", "BitsPerComponent", "Width", "Height"))
        channels = {"DeviceGray": 1, "DeviceRGB": 3}.get(space if isinstance(space, str) else "")
        if parms or bits != 8 or not channels or not (body := self.stream(ref)) or len(body) < w * h * channels:
            return None
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        lines = b"".join(b"\0" + body[channels * w * y : channels * w * (y + 1)] for y in range(h))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if channels == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, 1)) + chunk(b"IEND", b"")

    def pages(self) -> list[dict]:
        roots = [self.get(t.get("Root")) for t in self.trailers if isinstance(t, dict) and "Root" in t] or [self.get(Ref(n)) for n in self.raw]
        root = next((r for r in reversed(roots) if isinstance(r, dict) and "Pages" in r), {})
        out: list[dict] = []
        seen: set[int] = set()

        def go(ref, inherited):
            node = self.get(ref)
            if not isinstance(node, dict) or int(ref) in seen:
                return
            seen.add(int(ref))
            here = inherited | {k: node[k] for k in ("Resources",) if k in node}
            if "Kids" in node:
                for kid in self.get(node["Kids"]) or []:
                    go(kid, here)
            else:
                out.append(here | node)

        if isinstance(root.get("Pages"), Ref):
            go(root["Pages"], {})
        return out


def unicode_map(cmap: bytes) -> tuple[dict[int, str], int]:
    """Code -> text of a ToUnicode map, and the bytes of a code."""
    out, width = {}, 1
    text = lambda b: b.decode("utf-16-be", "replace")
    for body in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        v = [x for x, _ in tokens(body)]
        for a, b in zip(v[::2], v[1::2]):
            width = max(width, len(a))
            out[int.from_bytes(a, "big")] = text(b)
    for body in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(<[0-9A-Fa-f]+>|\[[^\]]*\])", body):
            low, high = int(a, 16), int(b, 16)
            width = max(width, len(a) // 2)
            if c.startswith(b"<"):
                base = bytes.fromhex(c[1:-1].decode())
                for k in range(min(high - low + 1, 65536)):
                    out[low + k] = text((int.from_bytes(base, "big") + k).to_bytes(len(base), "big"))
            else:
                for k, x in enumerate(re.findall(rb"<([0-9A-Fa-f]+)>", c)):
                    out[low + k] = text(bytes.fromhex(x.decode()))
    return out, width


def _near(values: list[float]) -> list[float]:
    """Sorted values, of those nearer than TOUCH to the one before only the first."""
    out: list[float] = []
    for v in sorted(values):
        if not out or v - out[-1] > TOUCH:
            out.append(v)
    return out


def ruled_tables(lines: list[tuple[float, float, float, float]], words: list[tuple[float, float, str]]) -> list[list[list[str]]]:
    """Cells of every ruled grid of a page, from its straight lines (x1, y1, x2, y2) and texts with their places. Lines that meet are
    one grid; it is a table with two rows or more, and texts without a cell are left out. Grids come from top to bottom."""
    level = sorted((y1, min(x1, x2), max(x1, x2)) for x1, y1, x2, y2 in lines if abs(y1 - y2) <= TOUCH < abs(x1 - x2))
    steep = [(x1, min(y1, y2), max(y1, y2)) for x1, y1, x2, y2 in lines if abs(x1 - x2) <= TOUCH < abs(y1 - y2)]
    parent = list(range(len(level) + len(steep)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    heights = [y for y, _, _ in level]
    for k, (x, low, high) in enumerate(steep):
        for i in range(bisect_left(heights, low - TOUCH), bisect_right(heights, high + TOUCH)):
            if level[i][1] - TOUCH <= x <= level[i][2] + TOUCH:
                parent[find(i)] = find(len(level) + k)
    grids: dict[int, tuple[list[float], list[float]]] = {}
    for i, (y, _, _) in enumerate(level):
        grids.setdefault(find(i), ([], []))[1].append(y)
    for k, (x, _, _) in enumerate(steep):
        grids.setdefault(find(len(level) + k), ([], []))[0].append(x)
    out = []
    for xs, ys in grids.values():
        xs, ys = _near(xs), _near(ys)[::-1]
        if len(xs) < 2 or len(ys) < 3:
            continue
        cells: list[list[list[str]]] = [[[] for _ in xs[1:]] for _ in ys[1:]]
        for x, y, t in words:
            c, r = bisect_right(xs, x) - 1, sum(y <= e for e in ys) - 1
            if 0 <= c < len(xs) - 1 and 0 <= r < len(ys) - 1:
                cells[r][c].append(t)
        out.append((-ys[0], [[" ".join(c) for c in r] for r in cells]))
    return [rows for _, rows in sorted(out, key=lambda x: x[0])]


def read_pdf(data: bytes, max_pages: int | None = None, images: bool = True) -> dict:
    """Pages, spans, images, ruled tables and information of one file. A span is a run of text of one font, up to a change of line or font."""
    if b"%PDF-" not in data[:1024]:
        raise ValueError("no PDF header")
    f = File(data)
    if any(isinstance(t, dict) and "Encrypt" in t for t in f.trailers):
        raise ValueError("encrypted")
    pages = f.pages()
    spans, pictures, tables, warnings = [], [], [], []
    for number, page in enumerate(pages if max_pages is None else pages[:max_pages], 1):
        resources = f.get(page.get("Resources")) or {}
        fonts = {}
        for name, ref in (f.get(resources.get("Font")) or {}).items():
            font = f.get(ref) or {}
            cmap = f.stream(font["ToUnicode"]) if isinstance(font.get("ToUnicode"), Ref) else None
            base = str(f.get(font.get("BaseFont")) or "")
            fonts[name] = (*(unicode_map(cmap) if cmap else (None, 1)), "bold" in base.lower() or "black" in base.lower())
        for i, (_, ref) in enumerate((f.get(resources.get("XObject")) or {}).items(), 1):
            x = f.get(ref)
            if isinstance(x, dict) and x.get("Subtype") == "Image":
                try:
                    content = f.image(ref) if images else None
                except (zlib.error, TypeError) as e:
                    content = None
                    warnings.append(f"page {number}, image {i}: {e}")
                pictures.append({"page_num": number, "idx": i, "width": f.get(x.get("Width")), "height": f.get(x.get("Height")), "content": content})
        contents = page.get("Contents")
        parts = contents if isinstance(contents, list) else f.get(contents) if isinstance(f.get(contents), list) else [contents]
        try:
            body = b"\n".join(f.stream(c) or b"" for c in parts if c is not None)
        except zlib.error as e:
            warnings.append(f"page {number}: {e}")
            continue
        font, size, scale, run, count = (None, 1, False), 0.0, 1.0, [], 0
        matrix, kept, leading = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), [], 0.0
        line, began = [1.0, 1.0, 0.0, 0.0], (0.0, 0.0)  # the text line's scales and place; where the run began
        path, ruled, words = [], [], []

        def placed(x, y):
            a, b, c, d, e, g = matrix
            return a * x + c * y + e, b * x + d * y + g

        def flush():
            nonlocal run, count
            t = "".join(run).strip()
            if t:
                words.append((*began, t))
                spans.append({"page_num": number, "span_idx": count, "text": t, "font_size": round(abs(size * scale), 3), "is_bold": font[2]})
                count += 1
            run = []

        def show(b):
            nonlocal began
            if not run:
                began = placed(line[2], line[3])
            table, width, _ = font
            if table is None:
                run.append(b.decode("latin-1"))
            else:
                run.append("".join(table.get(int.from_bytes(b[i : i + width], "big"), "") for i in range(0, len(b), width)))

        stack: list = []
        for v, _ in tokens(body):
            if not (isinstance(v, str) and not isinstance(v, Name)):
                stack.append(v)
                continue
            op = v[3:]
            numbers = [x for x in stack if isinstance(x, (int, float)) and not isinstance(x, Ref)]
            if op == "Tf" and len(stack) > 1:
                flush()
                font, size = fonts.get(stack[-2], (None, 1, False)), float(numbers[-1] if numbers else 0)
            elif op == "q":
                kept.append(matrix)
            elif op == "Q" and kept:
                matrix = kept.pop()
            elif op == "cm" and len(numbers) >= 6:
                a, b, c, d, e, g = numbers[-6:]
                m = matrix
                matrix = (a * m[0] + b * m[2], a * m[1] + b * m[3], c * m[0] + d * m[2], c * m[1] + d * m[3], e * m[0] + g * m[2] + m[4], e * m[1] + g * m[3] + m[5])
            elif op in ("m", "l") and len(numbers) >= 2:
                at = placed(*numbers[-2:])
                if op == "l" and path:
                    path[-1].append(at)
                else:
                    path.append([at])
            elif op == "re" and len(numbers) >= 4:
                x, y, w, h = numbers[-4:]
                path.append([placed(*p) for p in ((x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y))])
            elif op in ("S", "s", "f", "F", "f*", "B", "B*", "b", "b*", "n"):
                ruled += [(*p, *q) for part in path if op != "n" for p, q in zip(part, part[1:])]
                path = []
            elif op == "TL" and numbers:
                leading = numbers[-1]
            elif op == "Tm" and len(numbers) >= 6:
                flush()
                scale = numbers[-3] or 1.0
                line = [numbers[-6] or 1.0, scale, numbers[-2], numbers[-1]]
            elif op in ("Td", "TD", "T*", "BT", "ET"):
                if op == "BT":
                    scale, line = 1.0, [1.0, 1.0, 0.0, 0.0]
                elif op == "T*":
                    flush()
                    line[3] -= leading * line[1]
                elif op != "ET" and len(numbers) > 1:
                    if numbers[-1]:
                        flush()
                    if op == "TD":
                        leading = -numbers[-1]
                    line[2] += numbers[-2] * line[0]
                    line[3] += numbers[-1] * line[1]
                if op not in ("Td", "TD") or not numbers or numbers[-1]:
                    flush()
                else:
                    run.append(" ")
            elif op in ("Tj", "'", '"'):
                if op != "Tj":
                    flush()
                    line[3] -= leading * line[1]
                for b in stack[-1:]:
                    if isinstance(b, bytes):
                        show(b)
            elif op == "[":
                stack.append("array")
                continue
            elif op == "]":
                continue
            elif op == "TJ":
                at = max((i for i, x in enumerate(stack) if x == "array"), default=-1)
                for x in stack[at + 1 :]:
                    if isinstance(x, bytes):
                        show(x)
                    elif isinstance(x, (int, float)) and x < -200:
                        run.append(" ")
            stack = []
        flush()
        tables += [{"page_num": number, "idx": i, "rows": rows} for i, rows in enumerate(ruled_tables(ruled, words), 1)]
    info = next((f.get(t["Info"]) for t in reversed(f.trailers) if isinstance(t, dict) and "Info" in t), None) or {}
    as_text = lambda b: b[2:].decode("utf-16-be", "replace") if b[:2] == b"\xfe\xff" else b.decode("latin-1")
    version = re.search(rb"%PDF-(\d\.\d)", data[:1024])
    return {"pages": len(pages), "spans": spans, "images": pictures, "tables": tables, "info": {str(k): as_text(v) for k, v in ((k, f.get(v)) for k, v in info.items()) if isinstance(v, bytes)}, "version": version[1].decode() if version else None, "warnings": warnings}


def read_pdfs(files: DataFrame, id_col: str = "path", content_col: str = "content", max_pages: int | None = None, ocr: Callable[[bytes], list[str]] | None = None, images: bool = True, seconds: float | None = None, ocr_seconds: float | None = None) -> DataFrame:
    """A row for each file; one that can't be read, or not within ``seconds``, has a warning. ``ocr`` (bytes -> text of each page) steps in
    where no text is found, for ``ocr_seconds`` at most."""
    kinds, names = to_arrow_schema(StructType.fromDDL(SCHEMA)), ["pages", "spans", "images", "tables", "info", "version", "warnings"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    with time_limit(seconds):
                        row = read_pdf(data or b"", max_pages, images)
                    if ocr is not None and not row["spans"]:
                        try:
                            with time_limit(ocr_seconds):
                                row["spans"] = [{"page_num": i, "span_idx": 0, "text": t, "font_size": 0.0, "is_bold": False} for i, t in enumerate(ocr(data), 1) if t.strip()]
                            row["warnings"].append("text recognised")
                        except Exception as e:  # the file stays, without text
                            row["warnings"].append(f"text recognition: {type(e).__name__}: {e}")
                except Exception as e:  # a bad file is a row with a warning
                    row = {"pages": 0, "spans": [], "images": [], "tables": [], "info": {}, "version": None, "warnings": [f"{type(e).__name__}: {e}"]}
                row["info"] = list(row["info"].items())
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.string()), *[pa.array([row[n]], kinds.field(n).type) for n in names]], names=["doc_id", *names])

    return files.select(F.col(id_col).cast("string"), content_col).mapInArrow(run, SCHEMA)


def spans(read: DataFrame) -> DataFrame:
    return read.select("doc_id", F.inline("spans"))


def images(read: DataFrame, least: int = 100) -> DataFrame:
    """Images of ``least`` pixels or more on either side; ids count the kept ones. Places are 1000 for each page before, and the image's on its page."""
    kept = F.filter("images", lambda x: (x["width"] >= least) & (x["height"] >= least))
    rows = read.select("doc_id", F.posexplode(kept).alias("i", "x"))
    return rows.select(
        "doc_id", F.format_string("img_%04d", F.col("i") + 1).alias("image_id"), ((F.col("x.page_num") - 1) * 1000 + F.col("x.idx") - 1).cast("long").alias("position"), F.concat(F.lit("Image on page "), F.col("x.page_num")).alias("alt_text"),
        F.col("x.width").alias("width"), F.col("x.height").alias("height"), F.col("x.content").alias("content"),
    )


def tables(read: DataFrame) -> DataFrame:
    """(doc_id, page_num, idx, markdown) of every table."""
    rows = read.select("doc_id", F.inline("tables"))
    return rows.select("doc_id", "page_num", "idx", markdown.table(F.col("rows"), escape=False).alias("markdown"))


def tables_text(c: Column | str = "tables") -> Column:
    """All tables of a file as Markdown, each below its page's number; empty without any."""
    one = lambda t: F.concat(F.lit("**Table from page "), t["page_num"].cast("string"), F.lit("**\n\n"), markdown.table(t["rows"], escape=False))
    return F.array_join(F.transform(c, one), "\n\n")


def scanned_codes(read: DataFrame, decode: Callable[[bytes], list[dict]]) -> DataFrame:
    """Codes in the images of every page, as ``qr.numbered`` gives them; ``decode`` as in ``qr.decoded``."""
    pictures = read.select("doc_id", F.inline("images")).where("content is not null").select("doc_id", F.col("page_num").alias("page_number"), F.col("idx").alias("image_no"), "content")
    found = qr.decoded(pictures, decode, ("doc_id", "page_number", "image_no")).where("raw_data is not null")
    return qr.numbered(found.withColumns({"source_image": F.concat(F.lit("page_"), "page_number"), "decoder_idx": F.col("image_no") * 1000 + F.col("decoder_idx")})).drop("image_no")


def metadata(read: DataFrame) -> DataFrame:
    """(doc_id, title, author, description, tags, publication_date, custom_fields) from the information dictionary."""
    t = lambda k: F.nullif(F.trim(F.try_element_at("info", F.lit(k))), F.lit(""))
    custom = F.map_filter(F.create_map(F.lit("page_count"), F.col("pages").cast("string"), F.lit("creator"), t("Creator"), F.lit("producer"), t("Producer"), F.lit("pdf_version"), F.col("version")), lambda _, v: v.isNotNull())
    return read.select("doc_id", t("Title").alias("title"), t("Author").alias("author"), t("Subject").alias("description"), classify.tag_list(t("Keywords"), ",").alias("tags"), classify.page_date(t("CreationDate")).alias("publication_date"), custom.alias("custom_fields"))
