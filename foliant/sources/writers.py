"""Files made from rows: office documents, e-books, page-described documents and photos with EXIF.

The counterpart of the readers of this folder, for what they read: a file that is written here comes back the same.
Containers are deterministic, so equal rows make equal bytes.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .photo import GPS_TAGS, TAGS

_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _zipped(parts: dict[str, bytes | str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def png(width: int, height: int, rows: bytes | None = None) -> bytes:
    """An RGB image of the size; black without ``rows`` (3 bytes a pixel)."""
    rows = rows if rows is not None else bytes(3 * width * height)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + rows[3 * width * y : 3 * width * (y + 1)] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, 1)) + chunk(b"IEND", b"")


def docx(blocks: list[dict], properties: dict[str, str] | None = None, images: list[bytes] | None = None) -> bytes:
    """Blocks are paragraphs {"style", "numbered", "level", "runs": [{"text", "bold", "italic", "url"}]} or tables {"rows": [[text]]}."""
    links: dict[str, str] = {}
    styles = sorted({b["style"] for b in blocks if b.get("style")})

    def run(r: dict) -> str:
        marks = "".join(f"<w:{tag}/>" for tag, name in (("b", "bold"), ("i", "italic")) if r.get(name))
        return f'<w:r>{f"<w:rPr>{marks}</w:rPr>" if marks else ""}<w:t xml:space="preserve">{escape(r["text"])}</w:t></w:r>'

    def runs(rs: list[dict]) -> str:
        out = []
        for r in rs:
            if r.get("url"):
                key = links.setdefault(r["url"], f"l{len(links) + 1}")
                out.append(f'<w:hyperlink r:id="{key}">{run(r)}</w:hyperlink>')
            else:
                out.append(run(r))
        return "".join(out)

    def block(b: dict) -> str:
        if "rows" in b:
            cells = lambda row: "".join(f"<w:tc><w:p>{run({'text': c})}</w:p></w:tc>" for c in row)
            return "<w:tbl>" + "".join(f"<w:tr>{cells(r)}</w:tr>" for r in b["rows"]) + "</w:tbl>"
        about = f'<w:pStyle w:val="s{styles.index(b["style"])}"/>' if b.get("style") else ""
        if b.get("numbered"):
            about += f'<w:numPr><w:ilvl w:val="{b.get("level", 0)}"/><w:numId w:val="1"/></w:numPr>'
        return f'<w:p>{f"<w:pPr>{about}</w:pPr>" if about else ""}{runs(b.get("runs", []))}</w:p>'

    body = "".join(map(block, blocks))
    relations = [f'<Relationship Id="{k}" Target={quoteattr(u)}/>' for u, k in links.items()] + [f'<Relationship Id="i{i}" Target="media/image{i}.png"/>' for i, _ in enumerate(images or [], 1)]
    names = {"title": "dc:title", "creator": "dc:creator", "subject": "dc:subject", "description": "dc:description", "keywords": "cp:keywords", "lastModifiedBy": "cp:lastModifiedBy", "created": "dcterms:created", "modified": "dcterms:modified"}
    core = "".join(f"<{names[k]}>{escape(v)}</{names[k]}>" for k, v in (properties or {}).items() if v is not None)
    return _zipped({
        "word/document.xml": f'<w:document xmlns:w="{_WORD}" xmlns:r="{_RELS}"><w:body>{body}</w:body></w:document>',
        "word/styles.xml": f'<w:styles xmlns:w="{_WORD}">' + "".join(f'<w:style w:styleId="s{i}"><w:name w:val={quoteattr(s)}/></w:style>' for i, s in enumerate(styles)) + "</w:styles>",
        "word/_rels/document.xml.rels": f"<Relationships>{''.join(relations)}</Relationships>",
        "docProps/core.xml": f'<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:dcterms="http://purl.org/dc/terms/">{core}</cp:coreProperties>',
        **{f"word/media/image{i}.png": x for i, x in enumerate(images or [], 1)},
    })


def epub(metadata: list[tuple[str, str]], pages: list[tuple[str, str]], contents: list[tuple[int, str, str]] | None = None, images: dict[str, bytes] | None = None) -> bytes:
    """metadata: Dublin Core (name, value) in order. pages: (file name, body markup). contents: (level from 1, title, href) in order."""

    def points(entries: list[tuple[int, str, str]], level: int) -> str:
        out, i = "", 0
        while i < len(entries):
            j = i + 1
            while j < len(entries) and entries[j][0] > level:
                j += 1
            out += f"<navPoint><navLabel><text>{escape(entries[i][1])}</text></navLabel><content src={quoteattr(entries[i][2])}/>{points(entries[i + 1 : j], level + 1)}</navPoint>"
            i = j
        return out

    items = [f'<item id="p{i}" href={quoteattr(n)} media-type="application/xhtml+xml"/>' for i, (n, _) in enumerate(pages)]
    items += [f'<item id="i{i}" href={quoteattr(n)} media-type="image/png"/>' for i, n in enumerate(images or {})]
    if contents:
        items.append('<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>')
    about = "".join(f"<dc:{n}>{escape(v)}</dc:{n}>" for n, v in metadata if v is not None)
    return _zipped({
        "mimetype": "application/epub+zip",
        "META-INF/container.xml": '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>',
        "OEBPS/content.opf": f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata>{about}</metadata><manifest>{"".join(items)}</manifest><spine toc="ncx">{"".join(f"<itemref idref={chr(34)}p{i}{chr(34)}/>" for i in range(len(pages)))}</spine></package>',
        **{f"OEBPS/{n}": f"<html><body>{body}</body></html>" for n, body in pages},
        **({"OEBPS/toc.ncx": f'<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap>{points(contents, 1)}</navMap></ncx>'} if contents else {}),
        **{f"OEBPS/{n}": x for n, x in (images or {}).items()},
    })


def pdf(pages: list[list[tuple[str, float, bool]]], info: dict[str, str] | None = None, tables: dict[int, list[list[str]]] | None = None, images: dict[int, list[tuple[int, int]]] | None = None) -> bytes:
    """pages: lines (text, size, bold) of each page. tables, images: by number of the page, from 0: cells of a ruled table below
    the lines, and sizes of black images."""
    letters = sorted({c for page in pages for t, _, _ in page for c in t} | {c for t in (tables or {}).values() for r in t for x in r for c in x})
    code = {c: f"{i + 1:04x}" for i, c in enumerate(letters)}
    shown = lambda t: "<" + "".join(code[c] for c in t) + ">"
    objects: dict[int, bytes] = {}

    def stream(number: int, head: str, data: bytes) -> None:
        packed = zlib.compress(data, 1)
        objects[number] = b"<< %s /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (head.encode(), len(packed), packed)

    cmap = "".join(f"beginbfchar {''.join(f'<{k}> <{c.encode('utf-16-be').hex()}> ' for c, k in list(code.items())[i : i + 100])}endbfchar\n" for i in range(0, len(code), 100))
    stream(3, "", cmap.encode())
    for number, name in ((4, "Helvetica"), (5, "Helvetica-Bold")):
        objects[number] = f"<< /Type /Font /Subtype /Type0 /BaseFont /{name} /ToUnicode 3 0 R >>".encode()
    at, kids = 7, []
    for k, lines in enumerate(pages):
        body, y = [], 800.0
        for t, size, bold in lines:
            y -= size + 2
            body.append(f"BT /F{1 + bold} {size:g} Tf 1 0 0 1 40 {y:g} Tm {shown(t)} Tj ET")
        for rows in [tables[k]] if tables and k in tables else []:
            top, high, wide, n = y - 10, 20, 120, max(map(len, rows))
            for r in range(len(rows) + 1):
                body.append(f"40 {top - r * high:g} m {40 + n * wide} {top - r * high:g} l S")
            for c in range(n + 1):
                body.append(f"{40 + c * wide} {top:g} m {40 + c * wide} {top - len(rows) * high:g} l S")
            for r, row in enumerate(rows):
                for c, t in enumerate(row):
                    body.append(f"BT /F1 9 Tf 1 0 0 1 {45 + c * wide} {top - r * high - 14:g} Tm {shown(t)} Tj ET")
        pictures = []
        for w, h in (images or {}).get(k, []):
            stream(at, f"/Type /XObject /Subtype /Image /Width {w} /Height {h} /ColorSpace /DeviceGray /BitsPerComponent 8", bytes(w * h))
            pictures.append(at)
            at += 1
        stream(at, "", "\n".join(body).encode())
        forms = "".join(f"/I{i} {p} 0 R " for i, p in enumerate(pictures, 1))
        objects[at + 1] = f"<< /Type /Page /Parent 2 0 R /Contents {at} 0 R /Resources << /Font << /F1 4 0 R /F2 5 0 R >> /XObject << {forms}>> >> >>".encode()
        kids.append(at + 1)
        at += 2
    objects[1] = b"<< /Type /Catalog /Pages 2 0 R >>"
    objects[2] = f"<< /Type /Pages /Kids [{' '.join(f'{x} 0 R' for x in kids)}] /Count {len(kids)} >>".encode()
    objects[6] = ("<< " + " ".join(f"/{k} <FEFF{v.encode('utf-16-be').hex()}>" for k, v in (info or {}).items() if v is not None) + " >>").encode()
    out = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in sorted(objects.items()))
    return out + b"trailer << /Root 1 0 R /Info 6 0 R >>\n%%EOF"


def jpeg(width: int, height: int, exif: dict[str, object] | None = None, gps: dict[str, object] | None = None) -> bytes:
    """A file of the size without pixels. Values by tag name: text, bytes (undefined), whole numbers, (a, b) ratios or lists of these."""
    number = {n: t for t, n in TAGS.items()} | {n: t for t, n in GPS_TAGS.items()}

    def packed(v) -> tuple[int, int, bytes]:
        if isinstance(v, str):
            return 2, len(data := v.encode() + b"\0"), data
        if isinstance(v, bytes):
            return 7, len(v), v
        values = v if isinstance(v, list) else [v]
        if isinstance(values[0], tuple):
            kind = 10 if any(a < 0 for a, _ in values) else 5
            return kind, len(values), b"".join(struct.pack("<ii" if kind == 10 else "<II", *x) for x in values)
        return 3, len(values), b"".join(struct.pack("<H", x) for x in values)

    def directory(tags: dict[str, object], at: int, more: list[tuple[int, int]]) -> bytes:
        entries = [(number[n], *packed(v)) for n, v in tags.items() if v is not None] + [(t, 4, 1, struct.pack("<I", x)) for t, x in more]
        head, data, place = b"", b"", at + 2 + 12 * len(entries) + 4
        for tag, kind, n, value in sorted(entries):
            if len(value) > 4:
                head += struct.pack("<HHII", tag, kind, n, place + len(data))
                data += value
            else:
                head += struct.pack("<HHI", tag, kind, n) + value.ljust(4, b"\0")
        return struct.pack("<H", len(entries)) + head + bytes(4) + data

    size = len(directory(exif or {}, 8, [(0x8825, 0)] if gps else []))
    first = directory(exif or {}, 8, [(0x8825, 8 + size)] if gps else [])
    tiff = b"II*\0" + struct.pack("<I", 8) + first + (directory(gps, 8 + size, []) if gps else b"")
    app = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app) + 2) + app + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, height, width) + bytes(10) + b"\xff\xd9"


def files(rows: DataFrame, make: Callable[[dict], bytes], path_col: str = "path") -> DataFrame:
    """(path, content, length): a file for each row, by ``make`` (row as a dictionary -> bytes)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):  # a few files at a time
                part = batch.slice(i, 64)
                made = [make(r) for r in part.to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(path_col).cast(pa.string()), pa.array(made, pa.binary()), pa.array([len(x) for x in made], pa.int64())], names=["path", "content", "length"])

    return rows.withColumn(path_col, F.col(path_col).cast("string")).mapInArrow(run, "path string, content binary, length bigint")


def save(rows: DataFrame, folder: str, name_col: str = "file_name", content_col: str = "content", mode: str = "error") -> DataFrame:
    """Writes every row's bytes to folder/<name> and returns the rows with ``saved_path`` (null where there are no bytes).

    ``folder`` is an address that all executors reach. A file takes its name at once when it is whole, so a task that runs
    twice does no harm. ``mode``: "error" if a file is there already, or "overwrite". Names may not lead out of the folder.
    The result is lazy: files are written when it is evaluated.
    """
    import pyspark.sql.types as T

    schema = T.StructType([*rows.schema.fields, T.StructField("saved_path", T.StringType())])
    at, data_at = rows.columns.index(name_col), rows.columns.index(content_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import posixpath
        import uuid

        from pyarrow import fs as pafs

        store, root = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        for batch in batches:
            out = []
            for name, data in zip(batch.column(at).to_pylist(), batch.column(data_at).to_pylist(), strict=True):
                inside = posixpath.normpath(f"/{name}").lstrip("/") if name else ""
                if not data or not inside:
                    out.append(None)
                    continue
                path = f"{root}/{inside}"
                if mode == "error" and store.get_file_info(path).type != pafs.FileType.NotFound:
                    with store.open_input_stream(path) as f:
                        if f.read() != data:  # the same bytes: this task, run again
                            raise FileExistsError(path)
                store.create_dir(posixpath.dirname(path), recursive=True)
                with store.open_output_stream(part := f"{path}.{uuid.uuid4().hex}") as f:
                    f.write(data)
                store.move(part, path)
                out.append(f"{folder.rstrip('/')}/{inside}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)
