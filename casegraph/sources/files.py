"""Document files: listing, checks, form data, pages. Reading PDF files and images needs a library; see `Reader`."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ElementTree
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from casegraph.sources.shared import located

# Suffixes and types of image files, the largest file in megabytes.
IMAGES = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".tiff": "image/tiff", ".tif": "image/tiff"}
SUFFIXES = (".pdf", *IMAGES)
MOST_MEGABYTES = 50
ACROFORM_ERROR, XFA_ERROR = "__acroform_extraction_error__", "__xfa_extraction_error__"


class EmptyFolder(ValueError):
    """A folder without documents."""


class DuplicateDocument(ValueError):
    """Two files of one document id."""


class Unreadable(RuntimeError):
    """A file that can't be taken for a document."""


def suffix_of(path: Column) -> Column:
    """The lower-case suffix with its point, empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def listed(paths: DataFrame) -> DataFrame:
    """document_id, path of supported files of `paths` (path); hidden files are left out."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = paths.where(~name.startswith(".") & suffix_of(F.col("path")).isin(*SUFFIXES))
    return rows.select(F.regexp_replace(name, r"\.[^.]+$", "").alias("document_id"), "path")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, length of the files right in `folder`, empty ones too (which Spark's readers leave out); no content is read."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    return spark.createDataFrame([(f.getPath().toString(), f.getLen()) for f in found if f.isFile()], "path string, length long")


def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    """document_id, path of the supported files right in `folder`, by path.

    No such file, or two of one document id, is an error.
    """
    found = listed(list_files(spark, folder))
    twice = found.groupBy("document_id").agg(F.min("path").alias("a"), F.max("path").alias("b"), F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise DuplicateDocument(f"{twice[0]['a']} and {twice[0]['b']} are both document {twice[0]['document_id']!r}")
    if found.isEmpty():
        raise EmptyFolder(f"{folder} holds no document ({', '.join(SUFFIXES)})")
    return found.orderBy("path")


def file_problem(path: Column, length: Column) -> Column:
    """Why a file is no document, null if it may be one: its suffix, no content, or more than the most."""
    return (
        F.when(~suffix_of(path).isin(*SUFFIXES), F.concat(F.lit("unsupported file type "), suffix_of(path)))
        .when(length > MOST_MEGABYTES * 1024 * 1024, f"larger than {MOST_MEGABYTES} MB")
        .when(length == 0, "empty file")
    )


def _any_case(suffix: str) -> str:
    return "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, content, problem of the files right in `folder`; the content of one with a problem isn't read.

    Contents stay in the partitions that read them: suffixes and sizes are told by the listing, and files with a problem,
    which a listing on the driver finds, are added without content. Hidden files have no row.
    """
    readers = spark.read.format("binaryFile").option("pathGlobFilter", f"{{{','.join(map(_any_case, SUFFIXES))}}}")
    good = readers.load(folder).where(F.col("length").between(1, MOST_MEGABYTES << 20))
    known = list_files(spark, folder).where(~F.element_at(F.split("path", "/"), -1).startswith("."))
    known = known.withColumn("problem", file_problem(F.col("path"), F.col("length")))
    bad = known.where(F.col("problem").isNotNull()).select("path", "length", F.lit(None).cast("binary").alias("content"), "problem")
    out = good.select("path", "length", "content", F.lit(None).cast("string").alias("problem")).unionByName(bad)
    # Spark's reader leaves out names that begin with an underscore
    marked = known.where(F.col("problem").isNull() & F.element_at(F.split("path", "/"), -1).startswith("_")).select("path", "length")
    return out.unionByName(marked.mapInArrow(_contents, "path string, length long, content binary").withColumn("problem", F.lit(None).cast("string")))


def _contents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The content of files by path, a file at a time."""
    for batch in batches:
        for path, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            store, name = located(path)
            with store.open_input_file(name) as source:
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([length], pa.int64()), pa.array([source.read()], pa.binary())], ["path", "length", "content"])


class Page(Protocol):
    """One page of a document: its text layer, its form fields as (name, value), and its picture."""

    def text(self) -> str: ...

    def widgets(self) -> Iterable[tuple[str | None, object]]: ...

    def png(self, dpi: int) -> bytes: ...


class Reader(Protocol):
    """Opens a PDF file's content: its pages, and the bytes of its XFA data, if it has some."""

    def __call__(self, content: bytes) -> tuple[list[Page], bytes | None]: ...


def installed_reader() -> Reader:
    """The reader over the PDF library, where that is installed."""
    try:
        import pymupdf
    except ImportError as e:
        raise Unreadable("reading PDF files needs the package pymupdf, or a reader of your own") from e

    class _Page:
        def __init__(self, page):
            self.page = page

        def text(self) -> str:
            return self.page.get_text() or ""

        def widgets(self):
            return [(w.field_name, w.field_value) for w in self.page.widgets()]

        def png(self, dpi: int) -> bytes:
            return self.page.get_pixmap(dpi=dpi, alpha=False).tobytes("png")

    def read(content: bytes):
        doc = pymupdf.open(stream=content, filetype="pdf")
        form = doc.xref_get_key(doc.pdf_catalog(), "AcroForm/XFA")
        number = re.match(r"(\d+) \d+ R", form[1]) if form[0] == "xref" else None
        return [_Page(p) for p in doc], doc.xref_stream(int(number[1])) if number else None

    return read


def form_fields(pages: list[Page]) -> dict[str, str]:
    """Name and trimmed value of the form fields that are filled in; a repeated name gets its page's number."""
    out: dict[str, str] = {}
    try:
        for number, page in enumerate(pages, 1):
            for k, (name, value) in enumerate(page.widgets()):
                text = "" if value is None else str(value).strip()
                if text:
                    name = name or f"unnamed_field_page{number - 1}_{k}"
                    out[name if name not in out else f"{name}_p{number}"] = text
    except Exception as e:  # a broken form doesn't keep a document from being read
        out[ACROFORM_ERROR] = str(e)
    return out


def page_text(page: Page) -> str:
    """The trimmed text layer of a page; none where it can't be read."""
    try:
        return page.text().strip()
    except Exception:
        return ""


@dataclass(frozen=True)
class _Data:
    """Filled elements below a root that holds form data."""

    fields: dict[str, str]

    @classmethod
    def of(cls, xml: bytes) -> _Data:
        try:
            root = ElementTree.fromstring(xml)
        except ElementTree.ParseError:
            return cls({})
        if "data" not in root.tag.lower():
            return cls({})
        filled = ((e.tag, (e.text or "").strip()) for e in root.iter() if isinstance(e.tag, str))
        return cls({tag.rsplit("}", 1)[-1]: text for tag, text in filled if text})


def xfa_fields(xml: bytes | None) -> dict[str, str]:
    """Element and text of XFA data; of several elements of a name the last counts.

    The data are a whole document, or packets one after the other: then the first piece, from one element's beginning to
    the next, that is well-formed and holds data by itself.
    """
    if not xml:
        return {}
    begins = [m.start() for m in re.finditer(rb"<\w", xml)]
    pieces = [(0, len(xml)), *zip(begins, [*begins[1:], len(xml)], strict=True)] if len(begins) > 1 else [(0, len(xml))]
    return next((d for a, b in pieces if (d := _Data.of(xml[a:b]).fields)), {})


@F.pandas_udf(MapType(StringType(), StringType()))
def parse_xfa(xml: pd.Series) -> pd.Series:
    """See xfa_fields; a broken stream gives the error's text under its sentinel."""

    def one(x):
        try:
            return xfa_fields(None if x is None else bytes(x))
        except Exception as e:
            return {XFA_ERROR: str(e)}

    return pd.Series([one(x) for x in xml], dtype=object)
