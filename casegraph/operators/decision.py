"""The verdict of each case: checklist, flags of documents, corroboration, traffic light."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegraph.config import Expected, Rules
from casegraph.functions.dates import expired
from casegraph.functions.pins import pin
from casegraph.operators.lineage import collect_cases, resolve_cases
from casegraph.operators.records import person_rows

MIN_DOCUMENTS = 2
# The sentences that go with a verdict.
JUSTIFICATIONS = {
    "ROJO": "Se detectaron conflictos que impiden validar el caso automáticamente.",
    "AMARILLO": "El caso requiere revisión manual: faltan documentos o hay observaciones menores.",
    "VERDE": "El caso cumple todos los controles automáticos sin observaciones.",
}
WEAK = "Corroboración insuficiente (<2 documentos) para: "

_STRINGS = "array<string>"


def _flags(*pairs: tuple[str, Column]) -> Column:
    return F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in pairs)), lambda x: x.isNotNull())


def document_flags(missing: Column, expiry: Column, reference: Column) -> Column:
    """Flags of one document: something missing; expired, if there is a day to judge by."""
    return _flags(("DOCUMENT_INCOMPLETE", F.size(missing) > 0), ("DOCUMENTO_VENCIDO", expired(expiry, reference)))


def estado(rojo: Column, missing: Column, amarillo: Column, weak: Column) -> Column:
    """Traffic light of arrays: conflicts, missing documents, remarks, and roles with too few documents."""
    return F.when(F.size(rojo) > 0, "ROJO").when((F.size(missing) > 0) | (F.size(amarillo) > 0) | (F.size(weak) > 0), "AMARILLO").otherwise("VERDE")


def flag_severity(flag: Column, rules: Rules) -> Column:
    return F.when(flag.isin(*rules.severity.rojo), "ROJO").when(flag.isin(*rules.severity.amarillo), "AMARILLO")


def checklist(docs: Column, inferred: Column, rules: Rules) -> Column:
    """array<struct(label, document_type, generation, present, documents)> in the checklist's order; `docs` is an array
    of documents with id, type and generation, and `inferred` a map of what untagged certificates were found to be."""

    def entry(e: Expected) -> Column:
        def fits(d: Column) -> Column:
            same = d["document_type"] == e.document_type
            if e.generation is not None:
                same = same & ((d["generation"] == e.generation) | F.coalesce(F.element_at(inferred, d["document_id"]) == e.generation, F.lit(False)))
            return F.coalesce(same, F.lit(False))

        found = F.transform(F.filter(docs, fits), lambda d: d["document_id"])
        return F.struct(
            F.lit(e.label).alias("label"), F.lit(e.document_type).alias("document_type"), F.lit(e.generation).cast("string").alias("generation"),
            (F.size(found) > 0).alias("present"), found.alias("documents"),
        )

    return F.array(*map(entry, rules.expected_documents))


def verdicts(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """One row a case of the canonical documents `docs`: case_id, estado, justificacion, problemas, checks, documents,
    missing_documents, rojo_flags, amarillo_flags, weak_roles, g1, g2, g3, crossed, inferred.

    Documents are read once: they and their person records come together in one shuffle on case_id, and pass through the
    lineage beside it. Cases that name nobody have roles of nobody.
    """
    rules = rules or Rules()
    rows = person_rows(docs, "document_type", "missing_fields", expiry="identidad.fecha_vencimiento", filed="solicitud.fecha_presentacion")
    cases = resolve_cases(collect_cases(rows, "document_id", "document_type", "generation", "missing_fields", "expiry", "filed"), rules)
    application = F.get(F.filter(F.col("docs"), lambda d: d["document_type"] == "APPLICATION"), F.lit(0))
    cases = pin(cases, application=application)
    cases = pin(cases, reference=F.add_months(F.col("application.filed"), rules.document_validity_months_past_application))
    judged = F.transform(
        F.col("docs"),
        lambda d: F.struct(
            d["document_id"].alias("document_id"), d["document_type"].alias("document_type"), d["generation"].alias("generation"),
            d["missing_fields"].alias("missing_fields"), document_flags(d["missing_fields"], d["expiry"], F.col("reference")).alias("flags"),
        ),
    )
    cases = pin(cases, documents=judged, checks=checklist(F.col("docs"), F.col("inferred"), rules))
    undated = _flags(("FECHA_PRESENTACION_FALTANTE", F.col("application").isNotNull() & F.col("reference").isNull()))
    flags = F.array_distinct(F.concat(F.flatten(F.transform("documents", lambda d: d["flags"])), undated, F.col("flags")))
    cases = pin(cases, flags=F.array_sort(flags), missing_documents=F.transform(F.filter("checks", lambda c: ~c["present"]), lambda c: c["label"]))
    of = lambda names: F.array_intersect(F.col("flags"), F.array(*map(F.lit, names)).cast(_STRINGS))
    weak = _flags(*((g.upper(), F.col(g)["person"].isNotNull() & (F.size(F.col(g)["documents"]) < MIN_DOCUMENTS)) for g in ("g1", "g2", "g3")))
    cases = pin(cases, rojo_flags=of(rules.severity.rojo), amarillo_flags=of(rules.severity.amarillo), weak_roles=weak)
    cases = pin(cases, estado=estado(F.col("rojo_flags"), F.col("missing_documents"), F.col("amarillo_flags"), F.col("weak_roles")))
    listed = F.concat("missing_documents", "rojo_flags", "amarillo_flags")
    only_weak = (F.col("estado") == "AMARILLO") & (F.size(listed) == 0)
    problems = F.when(only_weak, F.array(F.concat(F.lit(WEAK), F.array_join("weak_roles", ", ")))).otherwise(listed)
    reason = F.element_at(F.create_map(*(F.lit(x) for p in JUSTIFICATIONS.items() for x in p)), F.col("estado"))
    return cases.select(
        "case_id", "estado", reason.alias("justificacion"), problems.alias("problemas"), "checks", "documents", "missing_documents",
        "rojo_flags", "amarillo_flags", "weak_roles", "g1", "g2", "g3", "crossed", "inferred",
    )
