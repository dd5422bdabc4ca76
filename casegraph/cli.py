"""Command line over the tables: `python -m casegraph.cli {status,ocr,rules,orchestrator} …`."""

from __future__ import annotations

import argparse
import json
import os
import shlex
import sys
from collections.abc import Mapping, Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from casegraph.config import Rules
from casegraph.functions.text import redact
from casegraph.operators.adapter import MissingExtraction
from casegraph.operators.engine import evaluate_cases
from casegraph.operators.orchestration import Drive, process_documents
from casegraph.operators.status import TRANSITIONS
from casegraph.sources.files import DuplicateDocument, EmptyFolder, scan_folder
from casegraph.sources.results import failures, successes, write_results
from casegraph.sources.store import DocumentExists, Store, StoreError

_DOCUMENT = "case_id string, document_id string"


def parse_documents(pairs: Sequence[str]) -> dict[str, str]:
    """Document id → path of values ID=PATH, cut at the first `=`."""
    out: dict[str, str] = {}
    for pair in pairs:
        name, sign, path = pair.partition("=")
        if not (name and sign and path):
            raise SystemExit(f"error: --doc has to be ID=PATH, not {pair!r}")
        if name in out:
            raise SystemExit(f"error: --doc {name!r} is given twice")
        out[name] = path
    return out


def job_arguments(env: Mapping[str, str], argv: Sequence[str], variable: str = "JOB_ARGUMENTS") -> list[str]:
    """Arguments of a job: those of the environment variable if it holds any, else of the command line, where a notebook
    kernel's own are none. A token among the arguments is refused, as they may be logged."""
    raw = env.get(variable, "")
    out = shlex.split(raw) if raw.strip() else [] if len(argv) > 1 and argv[1] == "-f" else list(argv[1:])
    if (shown := redact(out)) != out:
        raise SystemExit(f"error: tokens can't be given as arguments: {shown}")
    return out


def _print_status(rows) -> None:
    for r in rows:
        error = f"  error={r['error_detail']!r}" if r["error_detail"] else ""
        print(f"{r['case_id']}/{r['document_id']}: {r['stage']}  attempt={r['attempt_count']}  updated={r['last_updated']}{error}")


def _print_snapshot(row, whole: bool) -> None:
    print(f"case {row['case_id']!r}: {row['estado']}\n  {row['justificacion']}\n  problemas: {', '.join(row['problemas'])}")
    for name, fields in (("s1_rows", ("tipo", "estado")), ("s2_rows", ("documento", "evaluacion_credencial", "consistencia")), ("s3_rows", ("generacion", "relacion", "nombre_completo"))):
        for r in row[name]:
            print(f"  {name[:2]} {' / '.join(r[f] for f in fields)}")
    if row["s3_footnote"]:
        print(f"  {row['s3_footnote']}")
    if whole:
        print(json.dumps(row.asDict(recursive=True), ensure_ascii=False, indent=2, default=str))


def _print_record(row, whole: bool) -> None:
    e, c = row["extraction"], row["classification"]
    print(f"{row['case_id']}/{row['document_id']}: pages={e['page_count']} text={e['pages_via_text_layer']} model={e['pages_via_vlm']} seconds={row['processing_seconds']:.3f} by={row['model_name']}")
    if c is not None:
        print(f"  {c['document_type']} {c['generation'] or ''}".rstrip())
    if whole:
        print(json.dumps(row.asDict(recursive=True), ensure_ascii=False, indent=2))


def _status(store: Store, a) -> int:
    one = lambda *values: store.spark.createDataFrame([values], f"{_DOCUMENT}, target string, error_detail string")
    if a.what == "init-db":
        print(f"tables at {store.root}: version {store.version()}")
        return 0
    if a.what == "show-case":
        rows = store.case_documents(a.case).collect()
        print(f"case {a.case!r}: {store.case_status(a.case) or 'no documents'}")
        _print_status(rows)
        return 0
    if a.what == "add-doc":
        store.register(store.spark.createDataFrame([(a.case, a.doc)], _DOCUMENT))
    else:
        store.transition(one(a.case, a.doc, a.stage, a.error))
    _print_status(store.document(a.case, a.doc).collect())
    return 0


def _rules(store: Store, a) -> int:
    one = F.col("case_id") == a.case
    if a.what == "run-case":
        if store.case_status(a.case) is None:
            raise StoreError(f"no documents in case {a.case!r}")
        evaluate_cases(store, store.spark.createDataFrame([(a.case,)], "case_id string"), Rules.from_yaml(a.rules_config) if a.rules_config else None)
    row = store.snapshots(one).first()
    if row is None:
        print(f"error: case {a.case!r} isn't evaluated", file=sys.stderr)
        return 1
    _print_snapshot(row, a.json)
    return 0


def _record(store: Store, case_id: str, document_id: str):
    return store.extractions((F.col("case_id") == case_id) & (F.col("document_id") == document_id)).first()


def _ocr(store: Store, a, job) -> int:
    if a.what == "run":
        documents = store.spark.createDataFrame([(a.case, a.doc, a.file, 0)], f"{_DOCUMENT}, path string, position int")
        if a.auto_register:
            try:
                store.register(documents)
            except DocumentExists:
                pass
        summary = process_documents(store, documents, job, Drive(1, 1)).first()
        row = _record(store, a.case, a.doc) if summary["stage"] == "OCR_DONE" else None
        if a.result_out:
            told = successes(store.spark.createDataFrame([row], store.extractions().schema)) if row else failures(store.spark.createDataFrame([(a.case, a.doc, summary["error_detail"])], f"{_DOCUMENT}, error_detail string"))
            write_results(told, a.result_out).collect()
        if row is None:
            print(f"error: {summary['error_detail']}", file=sys.stderr)
            return 1
    elif (row := _record(store, a.case, a.doc)) is None:
        print(f"error: no extraction of document {a.doc!r} of case {a.case!r}", file=sys.stderr)
        return 1
    _print_record(row, a.json)
    return 0


def _orchestrator(store: Store, a, job) -> int:
    if a.what == "status":
        print(f"case {a.case!r}: {store.case_status(a.case) or 'no documents'}")
        _print_status(store.case_documents(a.case).collect())
        return 0
    if bool(a.doc) == bool(a.folder):
        raise SystemExit("error: give either --doc or --folder")
    paths = {r["document_id"]: r["path"] for r in scan_folder(store.spark, a.folder).collect()} if a.folder else parse_documents(a.doc)
    rows = [(a.case, d, p, k) for k, (d, p) in enumerate(paths.items())]
    documents = store.spark.createDataFrame(rows, f"{_DOCUMENT}, path string, position int")
    known, attempts = store.latest("status", F.col("case_id") == a.case), a.max_attempts
    if a.what == "retry-failed":
        failed = known.where(F.col("stage") == "FAILED")
        documents = documents.join(failed.select("case_id", "document_id"), ["case_id", "document_id"], "left_semi")
        attempts = max([attempts, *(r["attempt_count"] + 1 for r in failed.select("attempt_count").distinct().collect())])
        if documents.isEmpty():
            print(f"case {a.case!r}: nothing to try again")
            return 0
    else:
        store.register(documents.join(known.select("case_id", "document_id"), ["case_id", "document_id"], "left_anti"))
    summary = process_documents(store, documents, job, Drive(a.max_concurrency, attempts), a.evaluate_rules).collect()
    _print_status(summary)
    print(f"case {a.case!r}: {store.case_status(a.case)}  done={summary[0]['succeeded']} failed={summary[0]['failed']} of {summary[0]['total']}")
    return 0 if not summary[0]["failed"] else 1


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="casegraph")
    top.add_argument("--root", default="casegraph-tables", help="folder of the tables")
    groups = top.add_subparsers(dest="group", required=True)

    def command(group, name: str, *required: str, **more):
        p = group.add_parser(name)
        for r in required:
            p.add_argument(f"--{r}", required=True)
        for option, how in more.items():
            p.add_argument(f"--{option.replace('_', '-')}", **how)

    flag = {"action": "store_true"}
    s = groups.add_parser("status").add_subparsers(dest="what", required=True)
    command(s, "init-db")
    command(s, "add-doc", "case", "doc")
    command(s, "set-stage", "case", "doc", stage={"required": True, "choices": sorted(TRANSITIONS)}, error={"default": None})
    command(s, "show-case", "case")
    o = groups.add_parser("ocr").add_subparsers(dest="what", required=True)
    command(o, "run", "case", "doc", "file", auto_register=flag, result_out={"default": None, "help": "folder of result files"}, json=flag)
    command(o, "show", "case", "doc", json=flag)
    r = groups.add_parser("rules").add_subparsers(dest="what", required=True)
    command(r, "run-case", "case", rules_config={"default": None}, json=flag)
    command(r, "show-case", "case", json=flag)
    d = groups.add_parser("orchestrator").add_subparsers(dest="what", required=True)
    for name in ("run-case", "retry-failed"):
        command(
            d, name, "case", doc={"action": "append", "default": None, "metavar": "ID=PATH"}, folder={"default": None},
            max_concurrency={"type": int, "default": 3}, max_attempts={"type": int, "default": 3}, evaluate_rules=flag,
        )
    command(d, "status", "case")
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None, job=None, env: Mapping[str, str] | None = None) -> int:
    """Run a command. `job` (see orchestration.Job) is what works on documents; without one they can't be worked on."""
    a = parser().parse_args(job_arguments(os.environ if env is None else env, sys.argv) if argv is None else list(argv))
    if job is None and (a.group, a.what) in {("ocr", "run"), ("orchestrator", "run-case"), ("orchestrator", "retry-failed")}:
        print("error: no job is given that works on documents", file=sys.stderr)
        return 1
    try:
        store = Store(spark or SparkSession.builder.getOrCreate(), a.root)
        handlers = {"status": lambda: _status(store, a), "rules": lambda: _rules(store, a), "ocr": lambda: _ocr(store, a, job), "orchestrator": lambda: _orchestrator(store, a, job)}
        return handlers[a.group]()
    except (StoreError, MissingExtraction, EmptyFolder, DuplicateDocument) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    raise SystemExit(main())
