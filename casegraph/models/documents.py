"""Reading, classifying and taking fields of documents as one plan: pages, model replies, extraction records.

A file becomes a row for each page in one pass that opens it once: pages with a text layer need no model, of the others
several are asked about at a time, and their pictures don't leave the task. A document's pages meet again by one shuffle
of their texts; contents and pictures are never shuffled. Errors stay with their document, as `error_detail`.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegraph.functions.text import form_block
from casegraph.models.client import Asker, Calls, in_order
from casegraph.models.vision import Reading, read_picture
from casegraph.operators.replies import classify, extract_fields
from casegraph.sources.files import file_problem, form_fields, installed_reader, page_text, suffix_of, xfa_fields
from casegraph.sources.payloads import envelope
from casegraph.sources.results import failures, successes
from casegraph.sources.shared import stash

_MAP = "map<string,string>"
_PAGES = f"case_id string, document_id string, path string, number int, pages int, text string, picture binary, is_png boolean, acroform {_MAP}, xfa {_MAP}, seconds double, error_detail string"
_NAMES = ("case_id", "document_id", "path", "number", "pages", "text", "picture", "is_png", "acroform", "xfa", "seconds", "error_detail")


def _error(e: BaseException) -> str:
    return f"{type(e).__name__}: {e}"


def _arrow(rows: list[dict]) -> pa.RecordBatch:
    text, pairs = pa.string(), pa.map_(pa.string(), pa.string())
    kinds = (text, text, text, pa.int32(), pa.int32(), text, pa.binary(), pa.bool_(), pairs, pairs, pa.float64(), text)
    columns = [pa.array([list(r[n].items()) if isinstance(r.get(n), dict) else r.get(n) for r in rows], k) for n, k in zip(_NAMES, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, list(_NAMES))


def _pages_of(file: tuple, how: Reading, reader: Callable | None) -> Iterator[dict]:
    """The pages of a file (case_id, document_id, path, content, problem), one with number 0 and an error if it can't be taken."""
    case_id, document_id, path, content, problem = file
    own = {"case_id": case_id, "document_id": document_id, "path": path}
    begin = time.monotonic()
    try:
        if problem:
            raise ValueError(problem)
        if not path.lower().endswith(".pdf"):
            yield own | {"number": 1, "pages": 1, "picture": content, "is_png": path.lower().endswith(".png"), "seconds": time.monotonic() - begin}
            return
        pages, xml = (reader or installed_reader())(content)
        if not pages:
            raise ValueError("the PDF has no pages")
        forms = {"acroform": form_fields(pages), "xfa": xfa_fields(xml)}
        for number, page in enumerate(pages, 1):
            text = page_text(page)
            enough = how.use_text_layer and len(text) >= how.min_text
            seen = {"text": text} if enough else {"picture": page.png(how.dpi), "is_png": True}
            yield own | (forms if number == 1 else {}) | seen | {"number": number, "pages": len(pages), "seconds": time.monotonic() - begin}
            begin = time.monotonic()
    except Exception as e:
        yield own | {"number": 0, "seconds": time.monotonic() - begin, "error_detail": _error(e)}


def read_pages(files: DataFrame, make_client: Callable[[], Callable[..., str]] | None, how: Reading | None = None, reader: Callable | None = None, calls: Calls | None = None) -> DataFrame:
    """A row for each page of `files` (case_id, document_id, path, length, content): its text, the form data with the first
    page, and `rotation` of pages that the model read. A file that can't be taken has one row with number 0 and an error;
    an error of a page stays with it. Without `make_client` pictures are given as they are, unread.

    Order of pages is that of the file; no more pictures than `calls.width` are in memory, whatever a file's pages.
    """
    how, calls = how or Reading(), calls or Calls()

    def run(batches):
        asker = Asker(make_client, calls) if make_client else None

        def seen(page: dict) -> dict:
            if asker is None or page.get("picture") is None:
                return page
            begin = time.monotonic()
            told, error = asker.ask(lambda client: read_picture(client, page["picture"], page["is_png"], how))
            text, rotation = told or (None, None)
            return page | {"picture": None, "text": text, "rotation": rotation, "error_detail": error, "seconds": page["seconds"] + time.monotonic() - begin}

        files_ = (row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True))
        for page in in_order((p for f in files_ for p in _pages_of(f, how, reader)), seen, calls.width if asker else 1):
            plain = _arrow([page])
            yield pa.RecordBatch.from_arrays([*plain.columns, pa.array([page.get("rotation")], pa.string())], [*_NAMES, "rotation"])

    problem = file_problem(F.col("path"), F.col("length"))
    return files.select("case_id", "document_id", "path", "content", problem.alias("problem")).mapInArrow(run, f"{_PAGES}, rotation string")


def _headed(number: Column, text: Column, rotation: Column, by_model: Column) -> Column:
    turned = F.when(rotation != "NONE", F.concat(F.lit(" [orientation corrected: "), rotation, F.lit("]"))).otherwise("")
    head = F.when(by_model, turned).otherwise(" [text layer]")
    return F.concat(F.lit("--- Page "), number.cast("string"), head, F.lit(" ---\n"), text)


def assemble(pages: DataFrame) -> DataFrame:
    """Extractions from pages: case_id, document_id, path, extraction, processing_seconds, error_detail (null for good ones).

    The pages of a PDF follow by number, each below a header, after the block of form values; a picture's text stands by itself. A document without any
    text, or with a page that failed, has an error and no extraction.
    """
    by_model = F.col("rotation").isNotNull()
    is_pdf = suffix_of(F.col("path")) == ".pdf"
    text = F.when(is_pdf, _headed(F.col("number"), F.col("text"), F.col("rotation"), by_model)).otherwise(F.col("text"))
    told = pages.groupBy("case_id", "document_id", "path").agg(
        F.sort_array(F.collect_list(F.struct("number", text.alias("text")))).alias("texts"), F.max("pages").alias("page_count"),
        F.count_if(~by_model & F.col("text").isNotNull()).cast("int").alias("by_layer"), F.count_if(by_model).cast("int").alias("by_model"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("rotation") != "NONE", F.struct(F.col("number").cast("string").alias("k"), F.col("rotation").alias("v")))))).alias("turned"),
        F.any_value("acroform", True).alias("acroform"), F.any_value("xfa", True).alias("xfa"), F.sum("seconds").alias("processing_seconds"),
        F.min_by("error_detail", F.when(F.col("error_detail").isNotNull(), F.col("number"))).alias("error_detail"),
    )
    none = F.create_map().cast(_MAP)
    acroform, xfa = F.coalesce("acroform", none), F.coalesce("xfa", none)
    told = told.withColumn("whole", F.concat(form_block(acroform, xfa), F.array_join(F.transform("texts", lambda t: t["text"]), "\n\n")))
    blank = F.regexp_replace(F.col("whole"), r"(?U)\s+", "") == ""
    error = F.coalesce(F.col("error_detail"), F.when(blank, "EmptyExtraction: the model returned no text"))
    one = F.struct(
        F.when(suffix_of(F.col("path")) == ".pdf", "pdf").otherwise("image").alias("file_type"), F.col("whole").alias("extracted_text"), "page_count",
        F.col("by_layer").alias("pages_via_text_layer"), F.col("by_model").alias("pages_via_vlm"), F.col("turned").alias("orientation_corrections"),
        acroform.alias("acroform_fields"), xfa.alias("xfa_fields"),
    )
    return told.select("case_id", "document_id", "path", F.when(error.isNull(), one).alias("extraction"), "processing_seconds", error.alias("error_detail"))


def process_documents(files: DataFrame, make_client, classifier, extractor, model_name: str, how: Reading | None = None, reader=None, moment: Column | None = None, calls: Calls | None = None) -> DataFrame:
    """Result records (see sources.results) of `files`: an extraction record, or the error, of each.

    `classifier` and `extractor` are models as replies.classify and replies.extract_fields take them. What a model has
    said is written before anything looks at it, so no call is made twice for the branches that follow. A call that
    fails is its document's error.
    """
    read = stash(assemble(read_pages(files, make_client, how, reader, calls)), "documents-read")
    good = read.where(F.col("error_detail").isNull()).withColumn("extracted_text", F.col("extraction.extracted_text"))
    kinds = stash(classify(good, classifier), "documents-classified")
    asked = kinds.where(F.col("model_error").isNull()).drop("model_error")
    told = stash(extract_fields(asked, extractor), "documents-told")
    done = told.where(F.col("model_error").isNull()).drop("extracted_text", "error_detail", "model_error").withColumn("model_name", F.lit(model_name))
    failed = (df.select("case_id", "document_id", F.concat(F.lit(what), F.col(error)).alias("error_detail")).where(F.col("error_detail").isNotNull()) for df, what, error in ((read, "", "error_detail"), (kinds, "classification: ", "model_error"), (told, "field extraction: ", "model_error")))
    return reduce(DataFrame.unionByName, (successes(envelope(done, moment)), *map(failures, failed)))
