"""Document stages as keyed state of a stream.

Each document is one key; its events are requests for a stage (with the stage they expect, perhaps), and what is heard of
its job: `launched`, `polled`, `poll failed`, `ended`. A job that runs too long, whose polls fail too often in a row, or
that ended without its result in time makes its document FAILED. Times are processing times, as nothing in the events
says when a job ought to be heard of; timers are the state's time-outs, one for each key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from casegraph.operators.status import TRANSITIONS

REQUEST, LAUNCHED, POLLED, POLL_FAILED, ENDED = "request", "launched", "polled", "poll failed", "ended"
EVENTS = "case_id string, document_id string, seq long, kind string, target string, expected string, error_detail string, moment string"
STATE = "stage string, attempt_count int, last_updated string, error_detail string, rejected int, waiting string, detail string, poll_errors int, deadline long"
CHANGES = "case_id string, document_id string, seq long, stage string, attempt_count int, last_updated string, error_detail string, outcome string"


@dataclass(frozen=True)
class Patience:
    """Seconds that a job may run and that its result may be late, and failed polls in a row that are one too many."""

    run_seconds: int = 1800
    grace_seconds: int = 120
    poll_errors: int = 5


@dataclass
class Document:
    """A document's state. `waiting` is what its job is waited for: its end, its result, or nothing."""

    stage: str | None = None
    attempt_count: int = 0
    last_updated: str | None = None
    error_detail: str | None = None
    rejected: int = 0
    waiting: str | None = None
    detail: str | None = None
    poll_errors: int = 0
    #: When what is waited for is overdue, in milliseconds of processing time.
    deadline: int | None = None

    def move(self, target: str, error_detail: str | None, moment: str) -> None:
        self.attempt_count += self.stage == "FAILED"
        self.stage, self.last_updated = target, moment
        self.error_detail = error_detail if target == "FAILED" else None
        self.waiting, self.detail, self.poll_errors, self.deadline = None, None, 0, None

    def ask(self, target: str, expected: str | None, error_detail: str | None, moment: str) -> str:
        """Do what a request asks for, or not: ok, missing, conflict, or invalid."""
        if self.stage is None:
            if target != "RECEIVED":
                return "missing"
            self.stage, self.attempt_count, self.last_updated = target, 1, moment
            return "ok"
        outcome = "conflict" if expected is not None and expected != self.stage else "ok" if target in TRANSITIONS[self.stage] else "invalid"
        if outcome == "ok":
            self.move(target, error_detail, moment)
        else:
            self.rejected += 1
        return outcome

    def hear(self, kind: str, detail: str | None, patience: Patience, now: int = 0) -> str | None:
        """Take note of a document's job; the reason, if it has failed by this."""
        if self.stage != "RECEIVED":
            return None
        if kind == LAUNCHED:
            self.waiting, self.poll_errors, self.deadline = ENDED, 0, now + 1000 * patience.run_seconds
        elif kind == POLLED:
            self.poll_errors = 0
        elif kind == ENDED:
            self.waiting, self.detail, self.deadline = "result", detail, now + 1000 * patience.grace_seconds
        elif kind == POLL_FAILED:
            self.poll_errors += 1
            if self.poll_errors >= patience.poll_errors:
                return f"the job could not be polled {self.poll_errors} times in a row: {detail}"
        return None

    def overdue(self, patience: Patience) -> str:
        """The reason when the time for what is waited for is over."""
        if self.waiting == "result":
            return f"the job ended {self.detail or 'in some way'} without a result file"
        return f"the job still runs after {patience.run_seconds} s"


def _row(key: tuple[str, str], seq: int | None, d: Document, outcome: str) -> tuple:
    return (*key, seq, d.stage, d.attempt_count or None, d.last_updated, d.error_detail, outcome)


def follow(patience: Patience | None = None, clock: Callable[[], str] | None = None):
    """The state function: events of a document to its changes and refusals."""
    patience = patience or Patience()
    names = [x.split(" ")[0] for x in CHANGES.split(", ")]

    def now() -> str:
        from datetime import UTC, datetime

        return clock() if clock else datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(key, batches, state: GroupState):
        d = Document(*state.get) if state.exists else Document()
        rows: list[tuple] = []
        if state.hasTimedOut:
            if d.stage == "RECEIVED" and d.waiting:
                d.move("FAILED", d.overdue(patience), now())
                rows.append(_row(key, None, d, "overdue"))
        else:
            events = pd.concat(list(batches)).sort_values("seq", kind="stable")
            for e in events.astype(object).where(events.notna(), None).itertuples(index=False):
                if e.kind == REQUEST:
                    outcome = d.ask(e.target, e.expected, e.error_detail, e.moment)
                    rows.append(_row(key, e.seq, d, outcome))
                elif (reason := d.hear(e.kind, e.error_detail, patience, state.getCurrentProcessingTimeMs())) is not None:
                    d.move("FAILED", reason, e.moment)
                    rows.append(_row(key, e.seq, d, "ok"))
        if d.stage is not None:
            state.update(astuple(d))
            if d.deadline is not None:  # a time-out holds until the next events only
                state.setTimeoutDuration(max(1, d.deadline - state.getCurrentProcessingTimeMs()))
        yield pd.DataFrame(rows, columns=names)

    return run


def document_changes(events: DataFrame, patience: Patience | None = None, clock: Callable[[], str] | None = None) -> DataFrame:
    """The changes of documents' rows from a stream of EVENTS, and what came of each request.

    Events of a document within a batch are taken by seq. Documents are spread by key; one document's events are one
    task's work.
    """
    return events.groupBy("case_id", "document_id").applyInPandasWithState(follow(patience, clock), CHANGES, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
