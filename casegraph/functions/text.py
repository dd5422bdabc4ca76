"""Text hygiene, folding and label functions over columns.

Everything Spark has a built-in for is an expression; Unicode normalisation, case folding and graded similarity have
none and are Arrow-batched pandas functions, meant to run once for each value and be kept as columns.
"""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType, StructType

# What models leave in transcriptions, and page headers. Java's $ takes only \n for a line end under (?d).
IMAGE_LINK = r"!\[[^\]]*\]\([^)]*\)"
FENCE = r"(?md)^[ \t]*```[^\n]*\n?|\n?[ \t]*```[ \t]*$"
PAGE_HEADER = r"(?md)^--- Page \d+.*?---$"

# Nationality codes that stand for an adjective.
NATIONALITY_CODES = {"ESP": "Española", "ES": "Española"}

WHITE = r"(?U)\s+"


def strip_artifacts(text: Column) -> Column:
    """Without invented image links, then without code fence markers; what a fence holds stays."""
    return F.regexp_replace(F.regexp_replace(text, IMAGE_LINK, ""), FENCE, "")


def strip_page_headers(text: Column) -> Column:
    """Without page header lines, trimmed of any white space."""
    return F.regexp_replace(F.regexp_replace(text, PAGE_HEADER, ""), r"(?U)^\s+|\s+$", "")


def strip_white(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_label(label: Column) -> Column:
    """Key of a printed label: trimmed, lower case, single spaces."""
    return F.lower(strip_white(F.regexp_replace(label, WHITE, " ")))


def slug(value: Column, limit: int = 20) -> Column:
    """ASCII letters, digits and dashes; `x` where nothing is left."""
    dashed = F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9-]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(dashed, 1, limit), F.lit("")), F.lit("x"))


def join_present(*parts: Column) -> Column:
    """Non-empty parts joined by spaces, null if there is none."""
    return F.nullif(F.concat_ws(" ", *(F.nullif(p, F.lit("")) for p in parts)), F.lit(""))


def truthy(text: Column) -> Column:
    """Neither null nor empty; blanks count."""
    return F.coalesce(text != "", F.lit(False))


@pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def clean_text(text: Column) -> Column:
    """The one hygiene pass before text is matched: artifacts stripped, then NFKC; only text that isn't ASCII goes to Python."""
    text = strip_artifacts(text)
    odd = text.rlike(r"[^\x00-\x7F]")
    return F.when(odd, nfkc(F.when(odd, text))).otherwise(text)


def fold(name: str | None) -> str:
    """Comparison form of a name: NFKC, case folded, without marks, single spaces; "" for nothing."""
    if not name:
        return ""
    if name.isascii():
        return " ".join(name.lower().split())
    plain = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", name).casefold())
    return " ".join("".join(c for c in plain if unicodedata.category(c) != "Mn").split())


def fold_number(number: str | None) -> str:
    return re.sub(r"[\s\-.]+", "", unicodedata.normalize("NFKC", number)).upper() if number else ""


def fold_nation(value: str | None) -> str:
    if not value:
        return ""
    return fold(NATIONALITY_CODES.get(unicodedata.normalize("NFKC", value).strip().upper(), value))


@pandas_udf(StringType())
def fold_name(name: pd.Series) -> pd.Series:
    """See fold; null gives ""."""
    return name.map(fold)


@pandas_udf(StringType())
def fold_doc_number(number: pd.Series) -> pd.Series:
    """NFKC, upper case, without white space, hyphens and periods; null gives ""."""
    return number.map(fold_number)


@pandas_udf(StringType())
def fold_nationality(value: pd.Series) -> pd.Series:
    """A code's adjective, or the value, as a folded name; null gives ""."""
    return value.map(fold_nation)


@pandas_udf(StructType().add("fname", StringType()).add("fnum", StringType()).add("fnac", StringType()))
def fold_person(name: pd.Series, number: pd.Series, nationality: pd.Series) -> pd.DataFrame:
    """All three foldings in one pass."""
    return pd.DataFrame({"fname": name.map(fold), "fnum": number.map(fold_number), "fnac": nationality.map(fold_nation)})


def similarity(a: str | None, b: str | None) -> float:
    """Ratio of matching blocks of two folded names; depends on the order of its arguments."""
    return difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0


@pandas_udf(DoubleType())
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two names after folding; 0 where one is absent."""
    return pd.Series([similarity(fold(x), fold(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


def same_folded(a: Column, b: Column) -> Column:
    """Equal and not empty."""
    return F.coalesce((a != "") & (a == b), F.lit(False))


def fuzzy_folded(a: Column, b: Column) -> Column:
    """Equal, or the words of one are all among the other's; both not empty."""
    x, y = F.split(a, " "), F.split(b, " ")
    within = (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)
    return F.coalesce((a != "") & (b != "") & ((a == b) | within), F.lit(False))


def names_match(a: Column, b: Column) -> Column:
    return same_folded(fold_name(a), fold_name(b))


def names_fuzzy_match(a: Column, b: Column) -> Column:
    return fuzzy_folded(fold_name(a), fold_name(b))


def doc_numbers_match(a: Column, b: Column) -> Column:
    return same_folded(fold_doc_number(a), fold_doc_number(b))


def resolve_label(candidate: Column, labels: tuple[str, ...]) -> Column:
    """The label that `candidate` is, else the first in the given order that it contains, else null."""
    out = F.when(candidate.isin(*labels), candidate)
    for label in labels:
        out = out.when(F.contains(candidate, F.lit(label)), F.lit(label))
    return out


def orientation(reply: Column) -> Column:
    """Rotation label of a model's reply; NONE where it can't be told."""
    bare = F.regexp_replace(F.upper(reply), "[^A-Z0-9_]", "")
    return F.coalesce(resolve_label(bare, ("NONE", "ROTATE_90", "ROTATE_180", "ROTATE_270")), F.lit("NONE"))


def is_safe_name(value: Column, most: int = 200) -> Column:
    """Whether a case or file name may be stored: trimmed, not hidden, not too long, no separators or control characters."""
    return F.coalesce(
        (value != "") & (value == strip_white(value)) & ~value.startswith(".") & (F.char_length(value) <= most) & ~value.rlike(r"[/\\\x00-\x1f\x7f]"),
        F.lit(False),
    )


def is_safe_id(value: Column) -> Column:
    """Whether an id can be one part of a path."""
    return F.coalesce((value != "") & ~value.isin(".", "..") & ~value.rlike(r"[/\\]"), F.lit(False))


def form_block(acroform: Column, xfa: Column) -> Column:
    """The block of form values that goes before a document's text; "" without any. Marked keys become warnings."""

    def lines(fields: Column, title: str) -> Column:
        entries = F.transform(
            F.map_entries(fields),
            lambda e: F.when(e["key"].startswith("__") & e["key"].endswith("__"), F.concat(F.lit("> ⚠️ **Extraction warning:** "), e["value"], F.lit("\n")))
            .otherwise(F.concat(F.lit("- **"), e["key"], F.lit("**: "), e["value"])),
        )
        head = F.array(F.lit(f"## Programmatically Extracted Form Fields ({title})\n"))
        return F.when(F.coalesce(F.size(fields), F.lit(0)) > 0, F.concat(head, entries, F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))

    # Fixed value: the block's introduction.
    intro = (
        "# Fillable Form Fields (Programmatic Extraction)\n\n"
        "> The following values were extracted directly from the PDF's form field "
        "data structures (AcroForm /V entries and/or XFA datasets). "
        "They are guaranteed accurate regardless of whether the appearance stream "
        "was rendered correctly in the visual OCR pass below.\n\n"
    )
    both = F.concat(lines(acroform, "AcroForm"), lines(xfa, "XFA"))
    return F.when(F.size(both) == 0, F.lit("")).otherwise(F.concat(F.lit(intro), F.array_join(both, "\n"), F.lit("\n\n---\n\n")))


def redact(arguments: list[str], flag: str = "--fake-token", mask: str = "***") -> list[str]:
    """Arguments for a log line: values of `flag` masked, whether given by `=` or as the next argument."""
    out: list[str] = []
    hide = False
    for a in arguments:
        if hide:
            out.append(mask)
            hide = False
        elif a == flag:
            out.append(a)
            hide = True
        else:
            out.append(f"{flag}={mask}" if a.startswith(f"{flag}=") else a)
    return out
