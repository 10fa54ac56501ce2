"""Files to text: one row of text for each file of a ``binaryFile`` scan.

Archives are unpacked to rows first (``unpacked``), messages have columns of their
own (``mails``), and Parquet files are read by ``spark.read.parquet``.

A file that cannot be read gives a row with its error; the others go on.  PDF,
OCR and speech need libraries or models that are not here: pass ``plug_ins``.
"""

from __future__ import annotations

import csv
import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import markup

MAX_MEMBERS = 10_000
MAX_BYTES = 500 << 20
SCHEMA = "path string, text string, error string"


def plain(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def table_text(raw: bytes, mark: str) -> str:
    """Cells joined by tabs, rows by line feeds."""
    return "\n".join("\t".join(r) for r in csv.reader(io.StringIO(plain(raw)), delimiter=mark))


def json_text(raw: bytes) -> str:
    return json.dumps(json.loads(plain(raw)), indent=2, ensure_ascii=False)


def xml_text(raw: bytes) -> str:
    return "\n".join(x.strip() for x in ET.fromstring(raw).itertext() if x.strip())


def subtitle_text(raw: bytes) -> str:
    lines = (x.strip() for x in plain(raw).splitlines())
    return "\n".join(x for x in lines if x and x != "WEBVTT" and not x.isdigit() and "-->" not in x)


def rtf_text(raw: bytes) -> str:
    """Plain text of RTF: control words dropped, paragraphs as lines, \\'xx and \\u escapes decoded, destinations skipped."""
    out: list[str] = []
    skip: list[bool] = [False]
    after = 0
    for m in re.finditer(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-f]{2})|\\([^a-z])|([{}])|([^\\{}]+)", plain(raw), re.I):
        word, number, code, sign, brace, text = m.groups()
        if brace:
            skip.append(skip[-1]) if brace == "{" else (len(skip) > 1 and skip.pop())
        elif sign == "*" or word in ("fonttbl", "colortbl", "stylesheet", "info", "pict"):
            skip[-1] = True
        elif not skip[-1]:
            if word in ("par", "line"):
                out.append("\n")
            elif word == "tab":
                out.append("\t")
            elif word == "u" and number:
                out.append(chr(int(number) % 65536))
                after = 1
            elif code:
                out.append("" if after else bytes.fromhex(code).decode("cp1252", "replace"))
                after = 0
            elif sign in ("\\", "{", "}"):
                out.append(sign)
            elif text:
                text = text.replace("\r", "").replace("\n", "")
                out.append(text[after:])
                after = 0
    return "".join(out)


def opened(raw: bytes) -> zipfile.ZipFile:
    """An archive within the limits on members and declared bytes."""
    archive = zipfile.ZipFile(io.BytesIO(raw))
    sizes = [x.file_size for x in archive.infolist()]
    if len(sizes) > MAX_MEMBERS or sum(sizes) > MAX_BYTES:
        raise ValueError(f"archive has {len(sizes)} members of {sum(sizes)} bytes")
    return archive


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def inner(node: ET.Element, names: tuple[str, ...]) -> str:
    """Text of the elements of these names below a node; tabs and breaks as such."""
    marks = {"tab": "\t", "br": "\n", "line-break": "\n"}
    return "".join(marks.get(local(x.tag), x.text or "" if local(x.tag) in names else "") for x in node.iter())


def docx_text(raw: bytes) -> str:
    with opened(raw) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    paragraphs = [inner(p, ("t",)) for p in root.iter() if local(p.tag) == "p"]
    return "\n\n".join(p for p in paragraphs if p.strip())


def xlsx_text(raw: bytes) -> str:
    with opened(raw) as z:
        names = set(z.namelist())
        shared = [inner(x, ("t",)) for x in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        targets = {x.get("Id"): x.get("Target") for x in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in (x for x in ET.fromstring(z.read("xl/workbook.xml")).iter() if local(x.tag) == "sheet"):
            out.append(f"[Sheet: {sheet.get('name')}]")
            target = targets[next(v for k, v in sheet.attrib.items() if local(k) == "id")]
            for row in (x for x in ET.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")).iter() if local(x.tag) == "row"):
                cells = []
                for c in row:
                    value = "".join(x.text or "" for x in c.iter() if local(x.tag) in ("v", "t"))
                    if value:
                        cells.append(shared[int(value)] if c.get("t") == "s" else value)
                if "".join(cells).strip():
                    out.append("\t".join(cells))
    return "\n".join(out)


def pptx_text(raw: bytes) -> str:
    with opened(raw) as z:
        slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        out = []
        for place, (_, name) in enumerate(slides, 1):
            lines = [inner(p, ("t",)) for p in ET.fromstring(z.read(name)).iter() if local(p.tag) == "p"]
            if lines := [x for x in lines if x.strip()]:
                out.append(f"[Slide {place}]\n" + "\n".join(lines))
    return "\n\n".join(out)


def open_document_text(raw: bytes) -> str:
    with opened(raw) as z:
        root = ET.fromstring(z.read("content.xml"))
    rows = [x for x in root.iter() if local(x.tag) == "table-row"]
    if rows:
        return "\n".join(t for r in rows if (t := "\t".join("".join(c.itertext()) for c in r)).strip())
    return "\n".join("".join(p.itertext()) for p in root.iter() if local(p.tag) in ("p", "h"))


def epub_text(raw: bytes) -> str:
    with opened(raw) as z:
        parts = [markup.strings(plain(z.read(n))) for n in z.namelist() if re.search(r"\.x?html?$", n)]
    return "\n\n".join(p for p in parts if p.strip())


READERS: dict[str, Callable[[bytes], str]] = (
    dict.fromkeys(("txt", "md", "sql"), plain)
    | dict.fromkeys(("html", "htm"), lambda raw: markup.strings(plain(raw)))
    | dict.fromkeys(("xml", "xsl"), xml_text)
    | dict.fromkeys(("vtt", "srt"), subtitle_text)
    | dict.fromkeys(("odt", "ods", "odp"), open_document_text)
    | {"csv": lambda raw: table_text(raw, ","), "tsv": lambda raw: table_text(raw, "\t"), "json": json_text, "rtf": rtf_text}
    | {"docx": docx_text, "xlsx": xlsx_text, "pptx": pptx_text, "epub": epub_text}
)


def extension(name: str) -> str:
    return name.lower().rsplit(".", 1)[1] if "." in name else ""


def extract(name: str, raw: bytes, plug_ins: dict[str, Callable[[bytes], str]] | None = None) -> str:
    """Text of a file by its last extension; ValueError for kinds without a reader."""
    readers, kind = READERS | (plug_ins or {}), extension(name)
    if kind in ("doc", "ppt"):
        raise ValueError(f".{kind} is not supported: save it as .{kind}x")
    if kind not in readers:
        raise ValueError(f"unsupported file type: .{kind}")
    return readers[kind](raw)


def read_texts(files: DataFrame, plug_ins: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(path, text, error) of files (path, content), as the ``binaryFile`` source gives them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, raw in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows.append((path, extract(path, raw or b"", plug_ins), None))
                except Exception as e:  # noqa: BLE001  one bad file must not end the scan
                    rows.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def unpacked(files: DataFrame) -> DataFrame:
    """(path, content) with a row for each file inside a zip archive in place of the archive, at ``archive!/member``.

    Members are read one after the other; archives inside archives stay as they
    are.  An archive that is broken, has too many members or declares too many bytes
    stays as one row, for which ``read_texts`` gives the error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from (pa.RecordBatch.from_arrays([pa.array([p], pa.string()), pa.array([c], pa.binary())], ["path", "content"]) for p, c in _inside(path, raw.as_py() or b""))

    archive = F.lower("path").endswith(".zip")
    inside = files.filter(archive).select("path", "content").mapInArrow(run, "path string, content binary")
    return files.filter(~archive).select("path", "content").unionByName(inside)


def _inside(path: str, raw: bytes) -> Iterator[tuple[str, bytes]]:
    try:
        archive = opened(raw)
    except (zipfile.BadZipFile, ValueError):
        yield path, raw
        return
    with archive:
        for entry in archive.infolist():
            if not entry.is_dir():
                with archive.open(entry) as f:
                    content = f.read(entry.file_size + 1)
                if len(content) <= entry.file_size:  # no more than it declares, which ``opened`` has bounded
                    yield f"{path}!/{entry.filename}", content


def mails(files: DataFrame) -> DataFrame:
    """(path, sender, receiver, subject, body) of messages (path, content).  The body is the first plain part of a message in parts, or else the whole; base64 is decoded; a missing field is an empty string."""
    whole = F.regexp_replace(F.coalesce(decoded(F.col("content")), F.lit("")), "\r\n", "\n")
    cut = files.select("path", F.split(F.concat(whole, F.lit("\n\n")), "\n\n", 2).alias("x"))
    rows = cut.select("path", F.regexp_replace(F.col("x")[0], "\n[ \t]+", " ").alias("head"), F.regexp_replace(F.col("x")[1], "\n\n$", "").alias("body"))
    mark = F.regexp_extract("head", '(?i)boundary="?([^";\\s]+)', 1)
    parts = F.when(mark != "", F.split(F.replace("body", F.concat(F.lit("--"), mark), F.lit("\x00")), "\x00")).otherwise(F.array(F.concat("head", F.lit("\n\n"), "body")))
    plain = F.coalesce(F.get(F.filter(parts, lambda p: p.rlike("(?i)content-type:\\s*text/plain")), F.lit(0)), F.get(F.filter(parts, lambda p: F.trim(p) != ""), F.lit(0)), F.lit(""))
    rows = rows.select("*", plain.alias("part"))
    inner = F.get(F.split("part", "\n\n", 2), F.lit(1))
    text = F.when(F.col("part").rlike("(?i)content-transfer-encoding:\\s*base64"), decoded(F.try_to_binary(F.regexp_replace(inner, "\\s", ""), F.lit("base64")))).otherwise(inner)

    def field(name: str) -> Column:
        return F.trim(F.regexp_extract("head", f"(?im)^{name}:(.*)$", 1))

    return rows.select("path", field("From").alias("sender"), field("To").alias("receiver"), field("Subject").alias("subject"), F.rtrim(F.coalesce(text, F.lit("")), F.lit("\n")).alias("body"))


def folder(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path, content, size and hash of the files of a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path", "content", F.col("length").alias("size"), F.sha2("content", 256).alias("hash"))


#: Bounds of a manifest's entries: characters of a path, bytes of a file.
LONGEST_PATH, LARGEST_FILE = 300, 25 * 1024 * 1024
_MANIFEST = "struct<grant: string, generated_at: long, truncated: boolean, pending: long, files: array<struct<path: string, size: string, sha256: string>>>"


def _entry_ok(e: Column) -> Column:
    """A relative path without empty, ``.`` or ``..`` parts, a size within bounds, and a digest in small hex digits."""
    path = e["path"]
    parts = F.exists(F.split(path, "/", -1), lambda p: p.isin("", ".", ".."))
    size = F.when(e["size"].rlike("^[0-9]{1,18}$"), e["size"].cast("long"))
    fine = (F.length(path) <= LONGEST_PATH) & ~path.contains("\\") & ~path.contains("\0") & ~parts & (size <= LARGEST_FILE) & e["sha256"].rlike("^[0-9a-f]{64}$")
    return F.coalesce(fine, F.lit(False))


def manifests(listings: DataFrame) -> DataFrame:
    """grant, files (path, size, hash), invalid, complete of listings (grant, body: JSON with grant, files, truncated, pending).

    A listing is untrusted: one that is no JSON, has no list of files or names
    another grant gives no row; entries that are not in order are left out and
    counted.  ``complete`` is false for a listing that was cut or has files pending.
    """
    rows = listings.select("grant", F.from_json("body", _MANIFEST).alias("m")).filter((F.col("m.grant") == F.col("grant")) & F.col("m.files").isNotNull())
    good = F.filter("m.files", _entry_ok)
    files = F.transform(good, lambda e: F.struct(e["path"].alias("path"), e["size"].cast("long").alias("size"), e["sha256"].alias("hash")))
    complete = ~F.coalesce("m.truncated", F.lit(False)) & (F.coalesce("m.pending", F.lit(0)) <= 0)
    return rows.select("grant", files.alias("files"), (F.size("m.files") - F.size(good)).alias("invalid"), complete.alias("complete"))


def listed(read: DataFrame) -> DataFrame:
    """grant, path, size, hash: a row for each file of ``manifests``; of a path that a listing has twice the last entry holds."""
    rows = read.select("grant", F.posexplode("files").alias("place", "f")).select("grant", "place", "f.*")
    return rows.groupBy("grant", "path").agg(F.max_by(F.struct("size", "hash"), "place").alias("f")).select("grant", "path", "f.size", "f.hash")


def decoded(content: Column) -> Column:
    """UTF-8, or Latin-1 where it is not valid."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def parse_csv(text: Column, most: int = 500_000) -> Column:
    """Rows of a CSV text as lists of cells (null above ``most`` characters); cells in double quotes may hold commas and doubled quotes."""
    lines = F.filter(F.split(text, r"\r\n|\n|\r"), lambda x: x != "")
    cell = r',(?:"((?:[^"]|"")*)"|([^,]*))'

    def row(line: Column) -> Column:
        line = F.concat(F.lit(","), line)  # a comma before each cell
        quoted, bare = F.regexp_extract_all(line, F.lit(cell), F.lit(1)), F.regexp_extract_all(line, F.lit(cell), F.lit(2))
        return F.zip_with(quoted, bare, lambda q, b: F.when(q != "", F.replace(q, F.lit('""'), F.lit('"'))).otherwise(b))

    return F.when(F.length(text) <= most, F.transform(lines, row))


def parse_json(text: Column, most: int = 500_000) -> Column:
    """A variant, null for invalid or too long texts."""
    return F.when(F.length(text) <= most, F.try_parse_json(text))

