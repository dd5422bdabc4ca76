"""Person records of canonical documents: who a document is of, and the parents that a certificate names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegraph.functions.dates import with_dates
from casegraph.functions.text import fold_person, join_present

#: What is known of a person by one document. `blank` if nothing is, `named` if there is a name; words are sorted, each once.
RECORD = (
    "struct<doc:string,name:string,number:string,nation:string,born:date,sex:string,place:string,fname:string,fnum:string,fnac:string,"
    "words:array<string>,named:boolean,blank:boolean>"
)


def _full(text: str) -> str:
    return f"coalesce({text} <> '', false)"


_ANY = "solicitud is not null or identidad is not null or certificado is not null"


def person_records(docs: DataFrame) -> DataFrame:
    """case_id, document_id, generation, kind (0 application, 1 identity document, 2 birth certificate), own, p1, p2.

    `own` is the record (RECORD) of the applicant, the holder or the certificate's subject; p1 and p2 are those of the
    parents, null where a certificate names none. Names are folded once here; later steps compare plain columns. Other
    documents have no row. No shuffle.
    """
    return person_rows(docs.where(_ANY))


def person_rows(docs: DataFrame, *beside: str, **dates: str) -> DataFrame:
    """person_records with a row for every document, `kind` null for those of other kinds, with the columns `beside` and
    for each of `dates` the date of the text that the expression gives."""
    rows = docs.withColumn("_applicant", join_present(*(F.col(f"solicitud.{a}") for a in ("nombre_solicitante", "apellido_padre", "apellido_madre"))))
    rows = rows.withColumn("_holder", join_present(F.col("identidad.nombres"), F.col("identidad.apellidos")))
    s, i, c = "solicitud is not null", "identidad is not null", "certificado is not null"
    of = lambda a, h, x: f"case when {s} then {a} when {i} then {h} when {c} then {x} end"
    own = {
        "name": of("_applicant", "_holder", "certificado.nombre"), "number": of("solicitud.numero_id", "identidad.numero_id", "null"),
        "nation": of("solicitud.nacionalidad", "identidad.nacionalidad", "null"), "birth": of("null", "identidad.fecha_nacimiento", "certificado.fecha_nacimiento"),
        "sex": of("null", "identidad.sexo", "certificado.sexo"), "place": of("null", "null", "certificado.lugar_inscripcion"),
    }
    parent = lambda k: {n: f"certificado.progenitor{k}_{a}" for n, a in (("name", "nombre"), ("number", "num_doc"), ("nation", "nacionalidad"))}
    told = {f"_{who}_{a}": F.expr(x) for who, values in (("own", own), ("p1", parent(1)), ("p2", parent(2))) for a, x in values.items()}
    texts = {f"_text_of_{n}": F.expr(x) for n, x in dates.items()}
    rows = rows.select("case_id", "document_id", "generation", F.expr(of("0", "1", "2")).alias("kind"), *beside, *(x.alias(n) for n, x in (told | texts).items()))
    rows = rows.withColumns({f"_{who}_f": fold_person(f"_{who}_name", f"_{who}_number", f"_{who}_nation") for who in ("own", "p1", "p2")})
    rows = with_dates(rows, _own_born="_own_birth", **{n: f"_text_of_{n}" for n in dates})

    def record(who: str) -> str:
        more = {a: f"_{who}_{a}" if who == "own" else "null" for a in ("born", "sex", "place")}
        parts = [f"_{who}_{a}" for a in ("name", "number", "nation")]
        there = [_full(x) for x in (*parts, more["sex"], more["place"]) if x != "null"] + ([f"{more['born']} is not null"] if who == "own" else [])
        values = {
            "doc": "document_id", "name": parts[0], "number": parts[1], "nation": parts[2], **more, "fname": f"_{who}_f.fname", "fnum": f"_{who}_f.fnum", "fnac": f"_{who}_f.fnac",
            "words": f"array_sort(array_distinct(split(_{who}_f.fname, ' ')))", "named": _full(parts[0]), "blank": f"not ({' or '.join(there)})",
        }
        return f"cast(named_struct({', '.join(f"'{k}', {v}" for k, v in values.items())}) as {RECORD})"

    known = lambda who: " or ".join(_full(f"_{who}_{a}") for a in ("name", "number", "nation"))
    parents = (F.expr(f"case when {known(p)} then {record(p)} end").alias(p) for p in ("p1", "p2"))
    return rows.select("case_id", "document_id", "generation", "kind", F.expr(record("own")).alias("own"), *parents, *beside, *dates)
