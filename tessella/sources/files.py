"""Raw files to parsed documents: JSON envelopes, HTML, Markdown, text, DOCX, PDF, ZIP."""

from __future__ import annotations

import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..conf import DEFAULT, EXTENSIONS, EngineConf
from ..functions import text as X
from . import pdf
from .html import html_to_markdown

#: markdown, title, source_url, content_type
Parsed = tuple[str, str, str | None, str]
Loader = Callable[[bytes, str], Parsed]
H1 = re.compile(r"^#\s+(.+)$", re.M)


def load_text(data: bytes, name: str) -> Parsed:
    body = data.decode("utf-8", "replace")
    md = name.lower().endswith(".md")
    stem = re.sub(r"\.(md|txt)$", "", name, flags=re.I)
    h1 = H1.search(body)
    return body if md and h1 else f"# {stem}\n\n{body}", h1[1].strip() if h1 else stem, None, "text/markdown" if md else "text/plain"


def load_html(data: bytes, name: str) -> Parsed:
    html = data.decode("utf-8", "replace")
    m = re.search(r"<title>([^<]*)</title>", html, re.I)
    title = (m[1].strip() if m else "") or name
    md = html_to_markdown(html)
    return md if md.startswith("#") else f"# {title}\n\n{md}", title, None, "text/html"


def load_json(data: bytes, name: str) -> Parsed:
    raw = json.loads(data.decode("utf-8"))
    md = raw.get("markdown") if raw.get("markdown") is not None else raw.get("content")
    if not isinstance(md, str) or not md.strip():
        raise ValueError(f"{name}: no markdown in the JSON")
    meta = raw.get("metadata") or {}
    status = meta.get("statusCode")
    if isinstance(status, (int, float)) and not isinstance(status, bool) and status >= 400:
        raise ValueError(f"{name}: HTTP {status:g}, an error page")
    url = meta.get("sourceURL") if meta.get("sourceURL") is not None else meta.get("url")
    return md, title_of(md, str(meta.get("title") or ""), url, name), url, "application/json"


def title_of(md: str, title: str, url: str | None, name: str, conf: EngineConf = DEFAULT) -> str:
    h1 = H1.search(md)
    if h1 and h1[1].strip():
        return h1[1].strip()
    page = re.sub(conf.site_suffix.replace(r"\z", r"\Z"), "", title, flags=re.I).strip()
    if page and not (conf.site_default_title and re.fullmatch(conf.site_default_title, page, re.I)):
        return page
    slug = re.sub(r"/$", "", (url or "").split("?")[0]).split("/")[-1]
    return re.sub(r"\b\w", lambda m: m[0].upper(), re.sub(r"[-_]+", " ", slug)) if slug else name


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def load_docx(data: bytes, name: str) -> Parsed:
    """Paragraphs, heading styles, list items and tables of a word-processor file."""
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    body = root.find(f"{_W}body")
    text = lambda n: "".join(x.text or "" for x in n.iter(f"{_W}t"))
    out = []
    for n in body if body is not None else ():
        if n.tag == f"{_W}tbl":
            rows = [[text(c).strip() for c in r.iter(f"{_W}tc")] for r in n.iter(f"{_W}tr")]
            lines = [f"| {' | '.join(r)} |" for r in rows if r]
            if lines:
                lines.insert(1, f"| {' | '.join('---' for _ in rows[0])} |")
            out.append("\n".join(lines))
        elif n.tag == f"{_W}p" and text(n).strip():
            style = n.find(f"{_W}pPr/{_W}pStyle")
            m = re.match(r"(?i)heading\s*([1-6])", style.get(f"{_W}val", "") if style is not None else "")
            item = n.find(f"{_W}pPr/{_W}numPr") is not None
            out.append(f"{'#' * int(m[1]) + ' ' if m else '- ' if item else ''}{text(n).strip()}")
    md = "\n\n".join(x for x in out if x)
    title = re.sub(r"\.docx$", "", name, flags=re.I)
    return md if md.startswith("#") else f"# {title}\n\n{md}", title, None, "application/vnd.openxmlformats-officedocument.wordprocessingml.document"


def pdf_loader(extract: Callable[[bytes], tuple[str, str | None]]) -> Loader:
    """A loader around a text extractor (bytes -> text, title): page separators and blank runs go, too little text raises."""

    def load(data: bytes, name: str) -> Parsed:
        try:
            text, title = extract(data)
        except ValueError as error:
            raise ValueError(f"{name}: {error}") from error
        text = re.sub(r"\n{3,}", "\n\n", re.sub(r"(?m)^\s*-+ ?\d+ of \d+ ?-+\s*$", "", text)).strip()
        if len(text) < 40:
            raise ValueError(f"{name}: no extractable text")
        title = title or re.sub(r"\.pdf$", "", name, flags=re.I)
        return f"# {title}\n\n{text}", title, None, "application/pdf"

    return load


LOADERS: dict[str, Loader] = {".json": load_json, ".html": load_html, ".htm": load_html, ".md": load_text, ".txt": load_text, ".docx": load_docx, ".pdf": pdf_loader(pdf.extract)}


def _ext(name: str) -> str:
    m = re.search(r"\.[^./]+$", name)
    return m[0].lower() if m else ""


def shown_member(info: zipfile.ZipInfo) -> bool:
    """A regular member that is neither hidden nor a resource fork."""
    *folders, base = info.filename.split("/")
    return not info.is_dir() and bool(base) and not base.startswith((".", "__MACOSX")) and "__MACOSX" not in folders


def expand_zip(data: bytes) -> Iterator[tuple[str, bytes]]:
    """Regular members by base name; hidden files and resource forks are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in z.infolist():
            if shown_member(info):
                yield info.filename.rsplit("/", 1)[-1], z.read(info)


def parse_file(data: bytes, name: str, loaders: dict[str, Loader]) -> list[tuple]:
    """(filename, markdown, title, source_url, content_type, error) of a file or of each archive member."""

    def one(body: bytes, n: str) -> tuple:
        load = loaders.get(_ext(n))
        if load is None:
            return n, None, None, None, None, f"{n}: unsupported file type; supported are {', '.join(EXTENSIONS)}"
        try:
            return n, *load(body, n), None
        except Exception as error:
            return n, None, None, None, None, str(error)

    if _ext(name) != ".zip":
        return [one(data, name)]
    try:
        rows = [one(body, n) for n, body in expand_zip(data) if _ext(n) in loaders and _ext(n) != ".zip"]
    except zipfile.BadZipFile as error:
        return [(name, None, None, None, None, f"{name}: {error}")]
    good = [r for r in rows if r[5] is None]
    return good or [(name, None, None, None, None, f"{name}: no document in the archive")]


_PARSED = ("filename", "markdown", "title", "source_url", "content_type", "error")
#: Parsed documents, and characters of them, that are handed on together.
PARSED_ROWS, PARSED_CHARS = 128, 1 << 21


def _parsed_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(7)], names=["doc_id", *_PARSED])


def parse_files(files: DataFrame, loaders: dict[str, Loader] | None = None, conf: EngineConf = DEFAULT) -> DataFrame:
    """binaryFile rows (path, length, content) -> one row per document: doc_id, filename, markdown, title, source_url, content_type, error.

    Files beyond the upload limit or of another type give an error row and are not read.  doc_id
    is the path and, within an archive, the member.
    """
    table = LOADERS | (loaders or {})
    limit = conf.max_upload_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size_held = [], 0
        for batch in batches:
            for path, size, content in zip(batch["path"].to_pylist(), batch["length"].to_pylist(), batch["content"], strict=True):
                name = path.rsplit("/", 1)[-1]
                rows = [(name, None, None, None, None, f"{name}: larger than {limit / 1e6:g} MB")] if size > limit else parse_file(content.as_py() or b"", name, table)
                held += [(path if len(rows) == 1 and r[0] == name else f"{path}!{r[0]}", *r) for r in rows]
                size_held += sum(len(r[1] or "") for r in rows)
                if len(held) >= PARSED_ROWS or size_held >= PARSED_CHARS:
                    yield _parsed_batch(held)
                    held, size_held = [], 0
        if held:
            yield _parsed_batch(held)

    return files.select("path", "length", "content").mapInArrow(run, "doc_id string, " + ", ".join(f"{c} string" for c in _PARSED))


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files of a folder (or one file) as binaryFile rows, those with a loader only."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return rows.where(X.extension(F.col("path")).isin(*EXTENSIONS))


RAW = "digest string, name string, path string, length long, content binary"


def archive_raw(files: DataFrame, folder: str) -> DataFrame:
    """Raw uploads (path, length, content) kept as they came, under a safe name and by the digest of their bytes.

    A file that is uploaded again with the same name and bytes is kept once.  Returns the archive.
    """
    spark = files.sparkSession
    rows = files.select(F.sha2("content", 256).alias("digest"), X.safe_upload_name(F.element_at(F.split("path", "/"), -1)).alias("name"), "path", F.col("length").cast("long").alias("length"), "content")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        rows = rows.join(read_raw(spark, folder).select("digest", "name"), ["digest", "name"], "left_anti")
    rows.dropDuplicates(["digest", "name"]).write.mode("append").parquet(folder)
    return read_raw(spark, folder)


def read_raw(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(RAW).parquet(folder)


def read_envelopes(spark: SparkSession, path: str, conf: EngineConf = DEFAULT) -> DataFrame:
    """JSON envelopes by Spark's own reader: parsed columns and an error for refused ones."""
    schema = "markdown string, content string, metadata struct<title string, sourceURL string, url string, statusCode int>"
    raw = spark.read.schema(schema).option("multiLine", "true").json(path).withColumn("filename", F.element_at(F.split(F.input_file_name(), "/"), -1))
    md = F.coalesce("markdown", "content")
    url = F.coalesce("metadata.sourceURL", "metadata.url")
    error = (
        F.when(F.coalesce(X.trimmed(md), F.lit("")) == "", F.concat("filename", F.lit(": no markdown in the JSON")))
        .when(F.coalesce(F.col("metadata.statusCode") >= 400, F.lit(False)), F.concat(F.col("filename"), F.lit(": HTTP "), F.col("metadata.statusCode").cast("string"), F.lit(", an error page")))
    )
    title = X.derive_title(md, F.coalesce("metadata.title", F.lit("")), url, F.col("filename"), conf)
    return raw.select(F.col("filename").alias("doc_id"), "filename", md.alias("markdown"), title.alias("title"), url.alias("source_url"), F.lit("application/json").alias("content_type"), error.alias("error"))


def write_envelopes(pages: DataFrame, path: str) -> None:
    """(markdown, title, url, status) -> one JSON envelope per row."""
    meta = F.struct("title", F.col("url").alias("sourceURL"), "url", F.col("status").alias("statusCode"))
    pages.select(F.to_json(F.struct("markdown", meta.alias("metadata"))).alias("value")).write.text(path)


def refuse_pages(pages: DataFrame, marker: str = "404 - Page not found", least: int = 200) -> DataFrame:
    """(html, markdown, ...) with `skipped`: why a fetched page is no document, null for one that is."""
    soft = F.lower("html").contains(marker.lower())
    n = F.length("markdown")
    return pages.withColumn("skipped", F.when(soft, F.lit("soft 404 body")).when(n < least, F.concat(F.lit("only "), n.cast("string"), F.lit(" chars of body"))))
