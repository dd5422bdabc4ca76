"""A family of three generations from the documents of each case.

One shuffle brings a case's person records together; what follows is a narrow projection over them, written as SQL text.
Who of a pool is one person is told in Arrow batches, by blocking (functions.people). An untagged certificate that turns out to be of a
generation may unlock the next one, so the projection is repeated, for the cases alone in which the pass before found one:
each pass is written to the shared folder, and passes end when no case has changed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegraph.config import Rules
from casegraph.functions import people
from casegraph.functions.dates import within_years
from casegraph.functions.pins import pin
from casegraph.functions.text import same_folded
from casegraph.operators.records import RECORD, person_records
from casegraph.sources.shared import small_batches, stash

#: At most one more generation becomes known in each pass.
PASSES = 3
#: person, rejected, ambiguous, flags, documents, and `persons`: how many the records were told to be; there is a person if one.
ROLE = people.ROLE.simpleString()
_CERTIFICATE = f"struct<doc:string,gen:string,tagged:boolean,own:{RECORD},p1:{RECORD},p2:{RECORD}>"
_NO_RECORDS = f"cast(array() as array<{RECORD}>)"
#: The role of nobody.
NOBODY = f"cast(named_struct('person', null, 'rejected', false, 'ambiguous', false, 'flags', array(), 'documents', array(), 'persons', 0) as {ROLE})"


def fuzzy(a: Column, b: Column) -> Column:
    """Names equal, or the words of one all among the other's; both there."""
    x, y = a["words"], b["words"]
    within = (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)
    return F.coalesce((a["fname"] != "") & (b["fname"] != "") & within, F.lit(False))


def match_score(a: Column, b: Column, tolerance: int) -> Column:
    """How many of name, birth date and document number two records agree on."""
    return fuzzy(a, b).cast("int") + within_years(a["born"], b["born"], tolerance).cast("int") + same_folded(a["fnum"], b["fnum"]).cast("int")


# --- SQL texts --------------------------------------------------------------------------------------------------------


def _fuzzy(a: str, b: str) -> str:
    return f"coalesce({a}.fname <> '' and {b}.fname <> '' and (size(array_except({a}.words, {b}.words)) = 0 or size(array_except({b}.words, {a}.words)) = 0), false)"


def _years(a: str, b: str) -> str:
    """Whole years between two dates, in either order."""
    early, late = f"least({a}, {b})", f"greatest({a}, {b})"
    return f"(year({late}) - year({early}) - if(month({late}) * 100 + day({late}) >= month({early}) * 100 + day({early}), 0, 1))"


def _strict(a: str, b: str, rules: Rules) -> str:
    er = rules.entity_resolution
    near = f"coalesce({a}.born is not null and {b}.born is not null and {_years(f'{a}.born', f'{b}.born')} <= {er.dob_tolerance_years}, false)"
    same = f"coalesce({a}.fnum <> '' and {a}.fnum = {b}.fnum, false)"
    return f"(int({_fuzzy(a, b)}) + int({near}) + int({same}) >= {er.min_criteria})"


def _there(pool: str) -> str:
    return f"filter({pool}, r -> not r.blank)"


def _own(generation: str) -> str:
    """Records of the subjects of a generation's certificates."""
    return f"transform(filter(certs, c -> c.gen = '{generation}'), c -> c.own)"


def _parents(generation: str, *which: str) -> str:
    """Records of the parents that a generation's certificates name."""
    both = ", ".join(f"c.{p}" for p in which)
    return f"filter(flatten(transform(filter(certs, c -> c.gen = '{generation}'), c -> array({both}))), r -> r is not null)"


def _unlike(pool: str, key: str = "''") -> str:
    """Whether two named records with the same `key` have names that don't match.

    Names that all match pairwise are a chain of sets of words, each within the next; in order of size it is enough to
    look at neighbours.
    """
    rows = f"array_sort(transform(filter({pool}, r -> r.named), r -> named_struct('k', {key}, 'n', size(r.words), 'words', r.words, 'fname', r.fname)))"
    start = "cast(named_struct('last', null, 'bad', false) as struct<last:struct<k:string,n:int,words:array<string>,fname:string>,bad:boolean>)"
    step = f"(s, x) -> named_struct('last', x, 'bad', s.bad or (s.last is not null and s.last.k = x.k and not {_fuzzy('s.last', 'x')}))"
    return f"aggregate({rows}, {start}, {step}, s -> s.bad)"


def _checked(parent: str, child: str, rules: Rules) -> str:
    """`child` rejected where the years between two known births are outside the band."""
    band, born = rules.gap_bands.hard, (f"{parent}.person.born", f"{child}.person.born")
    bad = f"coalesce({_years(*born)} not between {band.min_years} and {band.max_years}, false)"
    kept = ", ".join(f"'{f}', {child}.{f}" for f in ("documents", "persons"))
    out = f"named_struct('person', {child}.person, 'rejected', true, 'ambiguous', {child}.ambiguous, 'flags', array_append({child}.flags, 'BRECHA_GENERACIONAL'), {kept})"
    return f"case when {born[0]} is not null and {born[1]} is not null and {bad} then cast({out} as {ROLE}) else {child} end"


def _resolved(role: str) -> str:
    return f"({role}.person is not null and not {role}.ambiguous)"


def _collapsed(roles: str) -> str:
    """One of several candidates: the resolved one with most documents (the first of equals), else the first ambiguous,
    else the first rejected, else nobody."""
    clean = f"filter({roles}, r -> {_resolved('r')} and not r.rejected)"
    best = f"aggregate({clean}, cast(null as {ROLE}), (b, r) -> if(b is null or size(r.documents) > size(b.documents), r, b))"
    return f"coalesce({best}, get(filter({roles}, r -> r.ambiguous), 0), get(filter({roles}, r -> r.rejected), 0), {NOBODY})"


# --- passes -----------------------------------------------------------------------------------------------------------


def collect_cases(records: DataFrame, *beside: str) -> DataFrame:
    """case_id with `people` (the applicant of the first application and the holders) and `certs`, in the documents' order;
    with `beside` also `docs`, structs of these columns of all rows."""
    row = F.struct("kind", "document_id", F.col("generation").alias("gen"), "own", "p1", "p2")
    docs = [F.sort_array(F.collect_list(F.struct(*beside))).alias("docs")] if beside else []
    # dealt by case first: rows of a case stand in many tasks, so lists begun in these would only be sorted and sent as lists
    cases = records.repartition("case_id").groupBy("case_id").agg(F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), row))).alias("rows"), *docs)
    people = "transform(filter(rows, (x, i) -> x.kind = 1 or (x.kind = 0 and i = 0)), x -> x.own)"
    certs = "transform(filter(rows, x -> x.kind = 2), x -> named_struct('doc', x.document_id, 'gen', x.gen, 'tagged', x.gen is not null, 'own', x.own, 'p1', x.p1, 'p2', x.p2))"
    return pin(cases, people=F.expr(people), certs=F.expr(f"cast({certs} as array<{_CERTIFICATE}>)")).drop("rows")


def _one_pass(cases: DataFrame, rules: Rules) -> DataFrame:
    """case_id, people, certs (with what was inferred), g1, g2, g3, crossed, changed of (case_id, people, certs), and what
    else `cases` has."""
    kept = cases.columns
    role = people.roles(rules.entity_resolution.min_criteria, rules.entity_resolution.dob_tolerance_years)
    put = lambda df, **columns: pin(df, **{n: F.expr(text) for n, text in columns.items()})
    yes, no = F.lit(True), F.lit(False)
    cases = put(cases, pool1=_there(f"concat(people, {_own('G1')})"))
    cases = cases.withColumn("g1", role("pool1", yes))
    known = _resolved("g1")
    of_known = lambda text: f"if({known}, {text}, {_NO_RECORDS})"
    cases = put(cases, own2=_there(_own("G2")), slot1=of_known(_parents("G1", "p1")), slot2=of_known(_parents("G1", "p2")))
    names = lambda pool, which="r -> r.named": F.expr(f"transform(filter({pool}, {which}), r -> r.fname)")
    cases = cases.withColumn("slots", people.parent_slots(names(of_known("own2"), "r -> true"), names("slot1"), names("slot2")))
    taken = lambda k: f"filter(own2, (r, i) -> get(slots, i) = {k})"
    # subjects that fit no slot, or all of them where the applicant isn't known
    cases = put(cases, pool2a=f"concat(slot1, {taken(1)})", pool2b=f"concat(slot2, {taken(2)})", pool2c=f"if({known}, {taken(0)}, own2)")
    cases = cases.withColumns({"role2a": role("pool2a", no), "role2b": role("pool2b", no), "role2c": role("pool2c", F.expr(f"not {known}"))})
    candidates = f"if({known}, if(size(pool2c) > 0, array(role2a, role2b, role2c), array(role2a, role2b)), array(role2c))"
    cases = put(cases, candidates=f"transform({candidates}, r -> {_checked('g1', 'r', rules)})")
    cases = put(cases, g2=f"if({known}, {_collapsed('candidates')}, candidates[0])")
    cases = put(cases, pool3=_there(f"concat(if({_resolved('g2')}, {_parents('G2', 'p1', 'p2')}, {_NO_RECORDS}), {_own('G3')})"))
    cases = put(cases.withColumn("role3", role("pool3", yes)), g3=_checked("g2", "role3", rules))

    second = f"exists(candidates, k -> {_resolved('k')} and if({known}, {_fuzzy('c.own', 'k.person')}, {_strict('c.own', 'k.person', rules)}))"
    told = f"case when {known} and {_strict('c.own', 'g1.person', rules)} then 'G1' when {second} then 'G2' when {_resolved('g3')} and {_strict('c.own', 'g3.person', rules)} then 'G3' end"
    gen = f"if(c.tagged or c.own.blank, c.gen, coalesce({told}, c.gen))"
    cases = put(cases, gens=f"transform(certs, c -> {gen})")
    named = "filter(concat(pool1, pool2a, pool2b, pool2c, pool3), r -> r.fnum <> '')"
    fields = ", ".join(f"'{f}', {f'gens[i]' if f == 'gen' else f'c.{f}'}" for f in ("doc", "gen", "tagged", "own", "p1", "p2"))
    cases = put(cases, crossed=_unlike(named, "r.fnum"), changed="exists(arrays_zip(certs, gens), x -> not (x.certs.gen <=> x.gens))")
    return put(cases, certs=f"cast(transform(certs, (c, i) -> named_struct({fields})) as array<{_CERTIFICATE}>)").select(*kept, "g1", "g2", "g3", "crossed", "changed")


def resolve_lineage(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """One row for each case that names a person: case_id, g1, g2, g3 (see ROLE), crossed, inferred, flags.

    `inferred` maps untagged certificates to generations; `flags` are the sorted flags of the case. Cases of which no
    document names anybody have no row here; verdicts() fills them with unresolved roles. Runs a job for each pass.
    """
    return resolve_cases(collect_cases(person_records(docs)), rules)


def resolve_cases(cases: DataFrame, rules: Rules | None = None) -> DataFrame:
    """resolve_lineage of what collect_cases gives, with its `docs` if it has them."""
    rules = rules or Rules()
    now, kept = cases, cases.columns
    ended: list[DataFrame] = []
    for k in range(PASSES):
        with small_batches(cases.sparkSession):
            done = stash(_one_pass(now, rules), "lineage")
        last = k == PASSES - 1 or done.where("changed").isEmpty()
        ended.append(done if last else done.where("not changed"))
        if last:
            break
        now = done.where("changed").select(*kept)
    cases = reduce(DataFrame.unionByName, ended)
    inferred = "map_from_entries(transform(filter(certs, c -> not c.tagged and c.gen is not null), c -> struct(c.doc, c.gen)))"
    crossed = "if(crossed, array('DOCUMENTO_CRUZADO'), array())"
    return cases.selectExpr("case_id", "g1", "g2", "g3", "crossed", f"{inferred} as inferred", f"array_sort(array_distinct(concat(g1.flags, g2.flags, g3.flags, {crossed}))) as flags", *(c for c in kept if c == "docs"))
