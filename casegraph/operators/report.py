"""Reports of verdicts: the snapshot of a case, its issues, and the views that a service answers with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegraph.config import ROLES, Rules
from casegraph.operators.adapter import populated_fields
from casegraph.operators.decision import JUSTIFICATIONS
from casegraph.operators.status import case_table

UNKNOWN = "No determinado"
# English texts for Spanish ones.
CHECKLIST_EN = {
    "Solicitud Principal": "Main Application",
    "Identificación del Solicitante": "Applicant's ID",
    "Certificado de Nacimiento del Solicitante": "Applicant's Birth Certificate",
    "Certificado de Nacimiento del Progenitor": "Parent's Birth Certificate",
    "Certificado de Nacimiento Español de origen": "Spanish-origin Birth Certificate",
}
ROLES_EN = {"Solicitante": "Applicant", "Progenitor": "Parent", "Abuelo/a": "Grandparent"}
JUSTIFICATIONS_EN = dict(
    zip(
        (JUSTIFICATIONS[k] for k in ("ROJO", "AMARILLO", "VERDE")),
        (
            "Conflicts were found that prevent automatic validation of the case.",
            "The case needs manual review: documents are missing or there are minor remarks.",
            "The case passes all automatic checks with no remarks.",
        ),
        strict=True,
    )
)


def english(text: Column, table: dict[str, str]) -> Column:
    """The table's English for a Spanish text, or the text."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in table.items() for x in p)), text), text)


def _present(text: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(UNKNOWN))


def _person(generation: str) -> Column:
    """Row of one generation: its number, full name, birth and place, relation."""
    p = F.col(generation.lower())["person"]
    birth = F.concat(F.coalesce(p["born"].cast("string"), F.lit(UNKNOWN)), F.lit(" / "), _present(p["place"]))
    return F.struct(
        F.lit(generation).alias("generacion"), _present(p["name"]).alias("nombre_completo"),
        F.when(p.isNull(), UNKNOWN).otherwise(birth).alias("fecha_lugar_nacimiento"), F.lit(ROLES[generation]).alias("relacion"),
    )


def snapshots(verdicts: DataFrame) -> DataFrame:
    """case_id, estado, justificacion, problemas (`Ninguno` if none), s1_rows, s2_rows, s3_rows, s3_footnote."""
    s1 = F.transform(
        "checks",
        lambda c: F.struct(
            c["label"].alias("tipo"),
            F.concat(c["document_type"], F.when(c["generation"].isNotNull(), F.concat(F.lit(" ("), c["generation"], F.lit(")"))).otherwise("")).alias("descripcion"),
            F.when(c["present"], "Presente").otherwise("Faltante").alias("estado"),
        ),
    )
    remarks = lambda d: F.size(d["flags"]) > 0
    s2 = F.transform(
        "documents",
        lambda d: F.struct(
            d["document_id"].alias("documento"),
            F.when(remarks(d), "Con observaciones").otherwise("Sin observaciones").alias("evaluacion_credencial"),
            d["missing_fields"].alias("campos_faltantes"),
            F.when(remarks(d), "Con conflictos").otherwise("Consistente").alias("consistencia"),
            d["flags"].alias("conflictos"),
        ),
    )
    notes = [
        F.when(F.col(g.lower())["ambiguous"], f"{g}: nombre ambiguo, no se pudo resolver a una única persona.")
        .when(F.col(g.lower())["rejected"], f"{g}: rechazado por brecha generacional fuera de rango.")
        for g in ROLES
    ]
    none = F.array(F.lit("Ninguno"))
    return verdicts.select(
        "case_id", "estado", "justificacion", F.when(F.size("problemas") == 0, none).otherwise(F.col("problemas")).alias("problemas"),
        s1.alias("s1_rows"), s2.alias("s2_rows"), F.array(*map(_person, ROLES)).alias("s3_rows"),
        F.nullif(F.concat_ws(" ", *notes), F.lit("")).alias("s3_footnote"),
    )


def checklist_rows(snapshot: DataFrame) -> DataFrame:
    """case_id, position, es, en, present."""
    rows = snapshot.select("case_id", F.posexplode("s1_rows").alias("position", "r"))
    return rows.select("case_id", "position", F.col("r.tipo").alias("es"), english(F.col("r.tipo"), CHECKLIST_EN).alias("en"), (F.col("r.estado") == "Presente").alias("present"))


def issues(snapshot: DataFrame, rules: Rules | None = None) -> DataFrame:
    """One row for each problem of cases that aren't green: case_id, position, code, severity, es, en, docs.

    Only flags of documents name documents; missing documents are amber whatever the case is.
    """
    rules = rules or Rules()
    rows = snapshot.where(F.col("estado") != "VERDE").select("case_id", "s1_rows", "s2_rows", F.posexplode("problemas").alias("position", "p"))
    p = F.col("p")
    missing = F.exists("s1_rows", lambda r: (r["tipo"] == p) & (r["estado"] == "Faltante"))
    weak = p.startswith("Corroboración insuficiente")
    docs = F.transform(F.filter("s2_rows", lambda r: F.array_contains(r["conflictos"], p)), lambda r: r["documento"])
    nothing = F.array().cast("array<string>")
    return rows.select(
        "case_id", "position",
        F.when(missing, F.concat(F.lit("FALTANTE: "), p)).when(weak, "CORROBORACION_INSUFICIENTE").otherwise(p).alias("code"),
        F.when(~missing & ~weak & p.isin(*rules.severity.rojo), "ROJO").otherwise("AMARILLO").alias("severity"),
        F.when(missing, F.concat(F.lit("Falta: "), p)).otherwise(p).alias("es"),
        F.when(missing, F.concat(F.lit("Missing: "), english(p, CHECKLIST_EN))).otherwise(p).alias("en"),
        F.when(missing | weak, nothing).otherwise(docs).alias("docs"),
    )


def lineage_rows(snapshot: DataFrame) -> DataFrame:
    """case_id, gen, es, en, name, birth, place; what isn't known is null. The date ends at the first separator."""
    rows = snapshot.select("case_id", F.explode("s3_rows").alias("r"))
    both = F.split("r.fecha_lugar_nacimiento", " / ", 2)
    known = lambda c: F.nullif(F.nullif(c, F.lit(UNKNOWN)), F.lit(""))
    return rows.select(
        "case_id", F.col("r.generacion").alias("gen"), F.col("r.relacion").alias("es"), english(F.col("r.relacion"), ROLES_EN).alias("en"),
        F.nullif("r.nombre_completo", F.lit(UNKNOWN)).alias("name"), known(F.get(both, F.lit(0))).alias("birth"), known(F.get(both, F.lit(1))).alias("place"),
    )


def inventory(snapshot: DataFrame) -> DataFrame:
    """case_id, present, total, percent of the checklist."""
    present = F.size(F.filter("s1_rows", lambda r: r["estado"] == "Presente"))
    rows = snapshot.select("case_id", present.alias("present"), F.size("s1_rows").alias("total"))
    return rows.withColumn("percent", F.round(F.col("present") * 100 / F.col("total")).cast("int"))


def case_verdicts(status: DataFrame, snapshot: DataFrame, default_error: str = "FAILED without error_detail") -> DataFrame:
    """One row a case: case_id, result, case_status, failed, pending, and estado, justification of those that have a verdict.

    Any failed document makes the case `failed`, one not yet done `pending`; else it is `verdict`.
    """
    rows = status.groupBy("case_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("stage") == "FAILED", F.struct(F.col("document_id").alias("name"), F.col("attempt_count").alias("tries"), F.coalesce(F.nullif("error_detail", F.lit("")), F.lit(default_error)).alias("error_detail"))))).alias("failed"),
        F.sort_array(F.collect_list(F.when(F.col("stage") != "OCR_DONE", F.col("document_id")))).alias("pending"),
    )
    known = snapshot.select("case_id", "estado", "justificacion")
    cases = rows.join(case_table(status, snapshot).select("case_id", "case_status"), "case_id").join(known, "case_id", "left")
    result = F.when(F.size("failed") > 0, "failed").when(F.size("pending") > 0, "pending").otherwise("verdict")
    cases = cases.withColumn("result", result)
    only = lambda kind, c: F.when(F.col("result") == kind, F.col(c))
    return cases.select(
        "case_id", "result", "case_status", only("failed", "failed").alias("failed"), only("pending", "pending").alias("pending"),
        only("verdict", "estado").alias("estado"), only("verdict", "justificacion").alias("justification_es"),
        english(only("verdict", "justificacion"), JUSTIFICATIONS_EN).alias("justification_en"),
    )


def document_report(status: DataFrame, extractions: DataFrame, docs: DataFrame, snapshot: DataFrame) -> DataFrame:
    """A row a document: stage, tries, type, pages, seconds, its filled and missing attributes, and its flags."""
    keys = ["case_id", "document_id"]
    flags = snapshot.select("case_id", F.explode("s2_rows").alias("r")).select("case_id", F.col("r.documento").alias("document_id"), F.col("r.conflictos").alias("flags"))
    told = extractions.select(*keys, F.col("extraction.pages_via_text_layer").alias("pages_text"), F.col("extraction.pages_via_vlm").alias("pages_vlm"), F.col("processing_seconds").alias("seconds"), "model_name")
    kinds = docs.select(*keys, F.col("document_type").alias("type"), F.col("missing_fields").alias("missing"))
    rows = status.select(*keys, "stage", F.col("attempt_count").alias("tries")).join(told, keys).join(kinds, keys).join(populated_fields(docs), keys).join(flags, keys, "left")
    return rows.withColumn("flags", F.coalesce("flags", F.array().cast("array<string>"))).withColumn("ok", (F.size("missing") == 0) & (F.size("flags") == 0))


def case_meta(report: DataFrame) -> DataFrame:
    """case_id, model of the first document, total seconds to one decimal, and counts of documents."""
    return report.groupBy("case_id").agg(
        F.min_by("model_name", "document_id").alias("model"), F.round(F.sum("seconds"), 1).alias("total_seconds"), F.count("*").alias("documents"),
        F.count_if(F.col("stage") == "OCR_DONE").alias("done"), F.count_if(F.col("ok")).alias("ok"), F.count_if(F.col("type").isin("ID_DOCUMENT", "BIRTH_CERT")).alias("with_fields"),
    )
