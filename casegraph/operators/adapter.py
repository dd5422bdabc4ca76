"""Extraction records as canonical documents: typed structs, missing attributes, and the bundle of a case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegraph.functions.text import clean_text
from casegraph.functions import sql
from casegraph.functions.pins import pin
from casegraph.schemas import CERTIFICADO, FORM_MAPS, IDENTIDAD, SOLICITUD, struct_ddl


class MissingExtraction(RuntimeError):
    """A registered document has no extraction."""


def anexo_variant(text: Column) -> Column:
    """Which form template a text names, its letters perhaps spaced apart; IV and III before I."""
    bare = F.regexp_replace(F.upper(text), r"(?U)\s+", "")
    has = lambda x: F.contains(bare, F.lit(x))
    return F.when(has("ANEXOIV") | has("ANEXOIII"), "ANEXO_III_IV").when(has("ANEXOI"), "ANEXO_I")


def with_form_attributes(docs: DataFrame, acroform: str, xfa: str, variant: str, name: str, when: str) -> DataFrame:
    """`docs` with map `name` of attribute → text of form fields, null where the condition `when` isn't met.

    Fields are named by the template's places, else by printed label; later fields win, and XFA fields come after
    AcroForm ones of other names and replace those of the same.
    """
    put = lambda df, **columns: pin(df, **{n: F.expr(text) for n, text in columns.items()})
    empty = "cast(map() as map<string,string>)"
    docs = put(docs, _forms=f"if({when}, named_struct('a', coalesce({acroform}, {empty}), 'x', coalesce({xfa}, {empty})), null)")
    # the order of one dictionary: AcroForm's keys with XFA's values where it has them, then XFA's other keys
    of_a = "transform(map_entries(_forms.a), e -> named_struct('k', e.key, 'v', if(map_contains_key(_forms.x, e.key), _forms.x[e.key], e.value)))"
    of_x = "transform(filter(map_entries(_forms.x), e -> not map_contains_key(_forms.a, e.key)), e -> named_struct('k', e.key, 'v', e.value))"
    by_label = sql.text_map({" ".join(v.lower().split()): k for k, v in SOLICITUD.items()})
    label = f"lower({sql.stripped(r"regexp_replace(e.k, r'(?U)\s+', ' ')")})"
    by_place = sql.case(*((f"{variant} = {sql.quoted(form)}", f"{sql.text_map(places)}[e.k]") for form, places in FORM_MAPS.items()))
    docs = put(docs, _named=f"filter(transform(concat({of_a}, {of_x}), e -> named_struct('k', coalesce({by_place}, {by_label}[{label}]), 'v', e.v)), e -> e.k is not null)")
    field = lambda k: f"coalesce(_forms.x[{sql.quoted(k)}], _forms.a[{sql.quoted(k)}])"
    entry = lambda k, condition, v: f"if({variant} = 'ANEXO_III_IV' and {condition}, array(named_struct('k', '{k}', 'v', {v})), array())"
    place = entry("lugar_presentacion", sql.filled(field("En")), field("En"))
    days = [field(k) for k in ("a", "de", "de-0")]
    dated = entry("fecha_presentacion", " and ".join(map(sql.filled, days)), f"concat_ws('/', {', '.join(days)})")
    # backwards, so that the first entry of an attribute is its last
    docs = put(docs, _every=f"reverse(concat(_named, {place}, {dated}))")
    docs = put(docs, _all="transform(_every, e -> e.k)", _keys="array_distinct(transform(_every, e -> e.k))")
    found = "map_from_arrays(reverse(_keys), reverse(transform(_keys, k -> _every[int(array_position(_all, k)) - 1].v)))"
    return put(docs, **{name: found}).drop("_forms", "_named", "_every", "_keys", "_all")


def _struct(found: str, attributes: dict[str, str], flags: dict[str, str]) -> str:
    return f"cast({sql.struct({a: flags.get(a, f'{found}[{sql.quoted(a)}]') for a in attributes})} as {struct_ddl(attributes)})"


def canonical_documents(extractions: DataFrame) -> DataFrame:
    """One row for each extraction record: case_id, document_id, source_file, document_type, generation, solicitud,
    identidad, certificado, missing_fields, normalized_text.

    A record without classification is OTHER, and type and generation are what it misses. Structured attributes are
    those of its kind, the missing ones listed in the kind's order; a false signature or apostille is missing.
    """
    text = clean_text(F.coalesce(F.col("extraction.extracted_text"), F.lit("")))
    docs = extractions.withColumn("normalized_text", text).selectExpr(
        "case_id", "document_id", "source_file", "coalesce(classification.document_type, 'OTHER') as document_type", "classification.generation as generation", "normalized_text",
        "classification is null as _unknown", "extraction.acroform_fields as _a", "extraction.xfa_fields as _x", "field_extraction.fields as _f",
    )
    docs = pin(docs, _variant=F.when(F.col("document_type") == "APPLICATION", anexo_variant(F.col("normalized_text"))))
    docs = with_form_attributes(docs, "_a", "_x", "_variant", "_form", "document_type = 'APPLICATION'")
    signed, sealed = sql.filled("_form['firma']"), sql.truthy("_f['apostillado']")
    is_ = lambda k: f"document_type = '{k}'"
    absent = lambda attributes, has: f"array_except({sql.texts(attributes)}, coalesce({has}, array()))"
    without = lambda keys, flag, good: f"if({good}, {keys}, array_remove({keys}, '{flag}'))"
    missing = sql.case(
        ("_unknown", sql.texts(("document_type", "generation"))),
        (is_("APPLICATION"), absent(SOLICITUD, without("map_keys(_form)", "firma", signed))),
        (is_("ID_DOCUMENT"), absent(IDENTIDAD, "map_keys(_f)")),
        (is_("BIRTH_CERT"), absent(CERTIFICADO, without("map_keys(_f)", "apostillado", sealed))),
        other=sql.texts(()),
    )
    kinds = {
        "solicitud": (is_("APPLICATION"), _struct("_form", SOLICITUD, {"firma": signed})),
        "identidad": (f"{is_('ID_DOCUMENT')} and _f is not null", _struct("_f", IDENTIDAD, {})),
        "certificado": (f"{is_('BIRTH_CERT')} and _f is not null", _struct("_f", CERTIFICADO, {"apostillado": sealed})),
    }
    told = (f"{sql.case(pair)} as {name}" for name, pair in kinds.items())
    return docs.selectExpr("case_id", "document_id", "source_file", "document_type", "generation", *told, f"{missing} as missing_fields", "normalized_text")


def missing_extractions(status: DataFrame, extractions: DataFrame) -> DataFrame:
    """Registered documents without an extraction."""
    return status.select("case_id", "document_id", "stage").join(extractions.select("case_id", "document_id"), ["case_id", "document_id"], "left_anti")


def case_documents(status: DataFrame, extractions: DataFrame, check: bool = True) -> DataFrame:
    """Canonical documents of all registered documents; a missing extraction is an error, never skipped."""
    if check and (gap := missing_extractions(status, extractions).limit(1).collect()):
        raise MissingExtraction(f"no extraction for case {gap[0]['case_id']!r} document {gap[0]['document_id']!r} (stage {gap[0]['stage']})")
    known = status.select("case_id", "document_id")
    return canonical_documents(extractions.join(known, ["case_id", "document_id"], "left_semi"))


def populated_fields(docs: DataFrame) -> DataFrame:
    """case_id, document_id, fields: attributes that are neither null nor empty; a false flag counts."""
    kinds = {"solicitud": SOLICITUD, "identidad": IDENTIDAD, "certificado": CERTIFICADO}
    of = lambda s, attributes: f"array_compact(array({', '.join(f"if(string({s}.{a}) <> '', '{a}', null)" for a in attributes)}))"
    fields = sql.case(*((f"{s} is not null", of(s, attributes)) for s, attributes in kinds.items()), other=sql.texts(()))
    return docs.selectExpr("case_id", "document_id", f"{fields} as fields")


def first_application(docs: DataFrame) -> DataFrame:
    """The APPLICATION with the smallest document_id of each case."""
    rows = docs.where(F.col("document_type") == "APPLICATION")
    return rows.groupBy("case_id").agg(F.min_by(F.struct(*(c for c in docs.columns if c != "case_id")), "document_id").alias("d")).select("case_id", "d.*")
