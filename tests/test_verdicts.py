"""Verdicts and lineage over small case files, each scenario a case of one run."""

import datetime as dt

import pytest

from casegraph.operators import decision, report
from casegraph.schemas import CERTIFICADO, IDENTIDAD, SOLICITUD, struct_ddl
from pyspark.sql import functions as F
from casegraph.functions.text import clean_text
from casegraph.operators import lineage

DDL = (
    f"case_id string, document_id string, source_file string, document_type string, generation string, solicitud {struct_ddl(SOLICITUD)}, "
    f"identidad {struct_ddl(IDENTIDAD)}, certificado {struct_ddl(CERTIFICADO)}, missing_fields array<string>, normalized_text string"
)


def _row(doc, kind, gen=None, s=None, i=None, c=None, missing=()):
    full = lambda names, given: None if given is None else tuple(given.get(n) for n in names)
    return (doc, f"{doc}.pdf", kind, gen, full(SOLICITUD, s), full(IDENTIDAD, i), full(CERTIFICADO, c), list(missing), "")


def app(doc="a", date="01/10/2025", nombre="Ana", padre="Garcia", numero="1", nation=None):
    return _row(doc, "APPLICATION", s=dict(nombre_solicitante=nombre, apellido_padre=padre, numero_id=numero, fecha_presentacion=date, nacionalidad=nation))


def ident(doc="b", nombres="Ana", apellidos="Garcia", numero="1", born="01/01/1990", expiry=None, nation=None, missing=()):
    return _row(doc, "ID_DOCUMENT", i=dict(nombres=nombres, apellidos=apellidos, numero_id=numero, fecha_nacimiento=born, fecha_vencimiento=expiry, nacionalidad=nation), missing=missing)


def cert(doc, gen, name, born=None, p1=None, n1=None, p2=None, place=None):
    return _row(doc, "BIRTH_CERT", gen, c=dict(nombre=name, fecha_nacimiento=born, progenitor1_nombre=p1, progenitor1_num_doc=n1, progenitor2_nombre=p2, lugar_inscripcion=place))


G1, G2, G3 = cert("c1", "G1", "Ana Garcia", "01/01/1990"), cert("c2", "G2", "Pedro Ruiz", "01/01/1960"), cert("c3", "G3", "Carlos Ruiz", "01/01/1930")
BASE = [app(), ident(), G1, G2, G3]
DOUBLE = [cert("d1", "G1", "Ana Garcia", "01/01/1990"), cert("d2", "G2", "Pedro Ruiz", "01/01/1960"), cert("d3", "G3", "Carlos Ruiz", "01/01/1930")]

# case: documents, verdict, flags or problems that must be there
DECISIONS = {
    "base": (BASE, "AMARILLO", {decision.WEAK + "G2, G3"}),
    "double": (BASE + DOUBLE, "VERDE", set()),
    "expired": ([app(), ident(expiry="01/01/2020"), G1, G2, G3], "ROJO", {"DOCUMENTO_VENCIDO"}),
    "within validity": ([app(date="01/10/2025"), ident(expiry="01/01/2027"), G1, G2, G3] + DOUBLE, "VERDE", set()),
    "undated": ([app(date=None), ident(expiry="01/01/2000"), G1, G2, G3], "AMARILLO", {"FECHA_PRESENTACION_FALTANTE"}),
    "ambiguous": (BASE + [cert("x", "G1", "Luis Perez", "01/01/1970")], "ROJO", {"NOMBRE_AMBIGUO"}),
    "two dates": (BASE + [ident("x", born="05/05/1995")], "ROJO", {"FECHA_CONFLICTO"}),
    "gap": ([app(), ident(), G1, cert("c2", "G2", "Pedro Ruiz", "01/01/1985"), G3], "ROJO", {"BRECHA_GENERACIONAL"}),
    "crossed": ([app(), ident(), cert("c1", "G1", "Ana Garcia", "01/01/1990", p1="Luis Perez", n1="1"), G2, G3], "ROJO", {"DOCUMENTO_CRUZADO"}),
    "incomplete": (BASE + [ident("x", missing=["sexo"])], "AMARILLO", {"DOCUMENT_INCOMPLETE"}),
    "nations": ([app(nation="Boliviana"), ident(nation="Española"), G1, G2, G3], "AMARILLO", {"NACIONALIDAD_INCONSISTENTE"}),
    "same nation": ([app(nation="ESP"), ident(nation="Española"), G1, G2, G3] + DOUBLE, "VERDE", set()),
    "application only": ([app()], "AMARILLO", {"Identificación del Solicitante", "Certificado de Nacimiento del Solicitante"}),
    "nobody": ([_row("o", "OTHER")], "AMARILLO", {"Solicitud Principal"}),
}

# case: documents, generation, expected (name, documents, ambiguous, rejected), flags of the role, inferred
LINEAGES = {
    "two parents": ([app(), cert("c1", "G1", "Ana Garcia", p1="Pedro Ruiz", p2="Maria Diaz"), cert("c2", "G2", "Jose Torres", "01/01/1960")], "g2", ("Pedro Ruiz", 1, False, False), set(), {}),
    "disagree": ([cert("c1", "G1", "Ana Garcia", "01/01/1990"), cert("c2", "G1", "Ana Garcia", "05/05/1990")], "g1", ("Ana Garcia", 2, False, False), {"FECHA_CONFLICTO"}, {}),
    "untagged applicant": ([ident(), cert("u", None, "Ana Garcia", "01/01/1990")], "g1", ("Ana Garcia", 2, False, False), set(), {"u": "G1"}),
    "cascade": ([ident(), cert("u", None, "Ana Garcia", "01/01/1990", p1="Pedro Ruiz")], "g2", ("Pedro Ruiz", 1, False, False), set(), {"u": "G1"}),
    "cascade of parents": ([ident(), cert("u", None, "Ana Garcia", "01/01/1990", p1="Pedro Ruiz", p2="Maria Diaz"), cert("v", None, "Pedro Ruiz", "01/01/1960"), cert("w", None, "Maria Diaz", "01/01/1961")], "g2", ("Pedro Ruiz", 2, False, False), set(), {"u": "G1", "v": "G2", "w": "G2"}),
    "longer name wins": ([ident(), cert("c1", "G1", "Ana Garcia", "01/01/1990", p1="Maria Garcia", p2="Maria Garcia Lopez"), cert("c2", "G2", "Maria Garcia Lopez", "01/01/1960")], "g2", ("Maria Garcia Lopez", 2, False, False), set(), {}),
    "exact tie": ([ident(), cert("c1", "G1", "Ana Garcia", "01/01/1990", p1="Maria Lopez", p2="Maria Perez"), cert("c2", "G2", "Maria", "01/01/1960")], "g2", ("Maria Lopez", 1, False, False), set(), {}),
    "gap": ([ident(), cert("c2", "G2", "Pedro Ruiz", "01/01/1985")], "g2", ("Pedro Ruiz", 1, False, True), {"BRECHA_GENERACIONAL"}, {}),
    "weak": ([cert("c1", "G3", "Carlos Ruiz", "01/01/1930"), cert("c2", "G3", "Carlos Ruiz")], "g3", ("Carlos Ruiz", 2, False, False), {"GENERACION_INFERIDA_BAJA_CONFIANZA"}, {}),
    "not weak": ([cert("c1", "G3", "Carlos Ruiz", "01/01/1930"), cert("c2", "G3", "Carlos Ruiz", "01/01/1950")], "g3", (None, 0, True, False), {"NOMBRE_AMBIGUO"}, {}),
    "chain": ([ident("b", "Ana", ""), ident("b2", "Ana", "García"), ident("b3", "Ana", "Lopez")], "g1", ("Ana", 3, False, False), {"NOMBRE_INCONSISTENTE"}, {}),
    "tolerance": ([ident("b", numero="1", born="01/01/1990"), ident("b2", numero="2", born="31/12/1991")], "g1", ("Ana Garcia", 2, False, False), {"FECHA_CONFLICTO", "ID_INCONSISTENTE"}, {}),
}


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(f"d:{k}", *r) for k, (docs, *_) in DECISIONS.items() for r in docs] + [(f"l:{k}", *r) for k, (docs, *_) in LINEAGES.items() for r in docs]
    table = decision.verdicts(spark.createDataFrame(rows, DDL)).cache()
    return {r["case_id"]: r for r in table.collect()}, table


@pytest.mark.parametrize("name", DECISIONS)
def test_decision(judged, name):
    _, estado, there = DECISIONS[name]
    row = judged[0][f"d:{name}"]
    assert row["estado"] == estado, row
    assert there <= set(row["problemas"])
    assert row["justificacion"] == decision.JUSTIFICATIONS[estado]
    if estado == "VERDE":
        assert row["problemas"] == []


@pytest.mark.parametrize("name", LINEAGES)
def test_lineage(judged, name):
    _, generation, (person, n, ambiguous, rejected), flags, inferred = LINEAGES[name]
    row = judged[0][f"l:{name}"]
    role = row[generation]
    assert (role["person"] and role["person"]["name"], len(role["documents"]), role["ambiguous"], role["rejected"]) == (person, n, ambiguous, rejected)
    assert set(role["flags"]) == flags
    assert row["inferred"] == inferred


def test_snapshot_and_views(judged):
    snap = report.snapshots(judged[1]).cache()
    rows = {r["case_id"]: r for r in snap.collect()}
    assert rows["d:double"]["problemas"] == ["Ninguno"] and rows["d:double"]["s3_footnote"] is None
    assert [r["estado"] for r in rows["d:application only"]["s1_rows"]] == ["Presente"] + ["Faltante"] * 4
    assert rows["d:ambiguous"]["s3_footnote"].startswith("G1: nombre ambiguo")
    assert [r["nombre_completo"] for r in rows["d:nobody"]["s3_rows"]] == ["No determinado"] * 3
    lineage = {(r["case_id"], r["gen"]): r for r in report.lineage_rows(snap).collect()}
    assert lineage["d:base", "G1"]["birth"] == "1990-01-01" and lineage["d:base", "G1"]["place"] is None
    found = {(r["case_id"], r["code"]): r for r in report.issues(snap).collect()}
    assert found["d:expired", "DOCUMENTO_VENCIDO"]["docs"] == ["b"] and found["d:expired", "DOCUMENTO_VENCIDO"]["severity"] == "ROJO"
    assert found["d:nobody", "FALTANTE: Solicitud Principal"]["en"] == "Missing: Main Application"
    assert found["d:base", "CORROBORACION_INSUFICIENTE"]["severity"] == "AMARILLO"
    assert not any(c == "d:double" for c, _ in found)
    assert {r["case_id"]: r["percent"] for r in report.inventory(snap).collect()}["d:application only"] == 20
    assert isinstance(judged[0]["d:base"]["g1"]["person"]["born"], dt.date)


def test_verdicts_deal_documents_once_in_small_batches(spark, monkeypatch):
    """No join brings documents and lineage together again, and pools reach Python in batches that don't grow with the task."""
    seen = []
    stash = lineage.stash

    def watched(df, name):
        seen.append(int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))
        return stash(df, name)

    monkeypatch.setattr(lineage, "stash", watched)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = decision.verdicts(spark.createDataFrame([], DDL))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert seen and max(seen) <= 512 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_only_text_beyond_ascii_goes_to_python(spark):
    rows = spark.createDataFrame([("plain",), ("ﬁn ```",), (None,), ("![x](a.png)",)], "t string").select(clean_text(F.col("t")).alias("t"))
    assert [r["t"] for r in rows.collect()] == ["plain", "fin", None, ""]
