"""The engine's tables: status, extractions and evaluations as logs of batches, the latest row of a key counting.

Parquet has no update in place, so each write is a batch in a folder of its own, with a number above all before it, and a
read takes of each key the row of the highest number: one aggregation by key, of the log dealt by key into parts of bounded
size, or, with a filter on a key, which is pushed down to the scan, partial first. A batch counts from when its marker, a
small file named by its number, is published; of several writers of one number one succeeds and the others get Conflict.
What the log holds is told by its markers, so the last number costs a listing, and a reader that begins before a batch is
published never sees a part of it. `compact` publishes all latest rows as a batch that replaces those before it.

Publishing needs a store in which making a name fails if it is there: a link in local and mounted folders, a rename in
HDFS. Object stores whose rename overwrites aren't fit for several writers.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casegraph.functions.dates import utc_stamp
from casegraph.operators.status import case_table, is_valid_transition
from casegraph.schemas import EVALUATION_ROW, EXTRACTION_ROW, STATUS
from casegraph.sources.payloads import extraction_records, extraction_rows, snapshot_records, snapshot_rows

KEYS = {"status": ("case_id", "document_id"), "extractions": ("case_id", "document_id"), "evaluations": ("case_id",)}
#: Versions of the schema, in order: what each creates.
MIGRATIONS = ((1, "status", STATUS), (2, "extractions", EXTRACTION_ROW), (3, "evaluations", EVALUATION_ROW))


class StoreError(RuntimeError):
    """A request that the tables don't allow."""


class DocumentExists(StoreError):
    """A document is registered already."""


class DocumentMissing(StoreError):
    """A document isn't registered."""


class InvalidTransition(StoreError):
    """A stage that may not follow."""


class Conflict(StoreError):
    """The stage isn't the expected one any more, or another writer came between."""


#: Ending of a marker; whether a batch adds to those before it or replaces them; attempts of an append that may follow any.
MARKER, PART, WHOLE, TRIES = ".batch", "part", "whole", 20


def _linked(spark: SparkSession, source, target) -> bool:
    """Give a local file a second name; False if that name is taken."""
    jvm = spark.sparkContext._jvm
    paths = [jvm.java.nio.file.Paths.get(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)) for p in (target, source)]
    try:
        jvm.java.nio.file.Files.createLink(*paths)
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise
    return True


#: Bytes of files of a part of a log (payloads take some 15 times the room in memory), and of the smallest part worth a task.
PART_BYTES, SMALL_BYTES = 32 << 20, 1 << 20

_PROBLEMS = {"missing": DocumentMissing, "invalid": InvalidTransition, "conflict": Conflict}


class Store:
    """Tables below `root`, a folder that driver and executors share. `clock` gives the moment that rows are stamped with."""

    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], Column] | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.clock = clock or (lambda: utc_stamp(F.current_timestamp()))
        self._markers: dict[str, dict[str, str]] = {}
        self.migrate()

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def version(self) -> int:
        """The schema's version; 0 for an empty root."""
        if not self._exists("schema_version"):
            return 0
        return self.spark.read.schema("version int").parquet(self._path("schema_version")).agg(F.max("version")).first()[0] or 0

    def migrate(self) -> int:
        """Create what later versions of the schema have, in order; nothing if all is there. Returns the version."""
        now = self.version()
        for number, table, _ in MIGRATIONS:
            if number > now:
                files, where = self._file(f"{table}/log")
                files.mkdirs(where)
                self.spark.createDataFrame([(number,)], "version int").coalesce(1).write.mode("append").parquet(self._path("schema_version"))
                now = number
        return now

    def _batches(self, table: str, to: int | None = None) -> list[tuple[int, str]]:
        """Number and folder of the batches that count, those up to `to` where it is given."""
        files, where = self._file(f"{table}/log")
        names = sorted(n for s in files.listStatus(where) if (n := s.getPath().getName()).endswith(MARKER))
        found = [(int(number), folder, kind == WHOLE) for number, folder, kind in (t.split("-") for t in self._told(table, names))]
        found = [f for f in found if to is None or f[0] <= to]
        begin = max((k for k, f in enumerate(found) if f[2]), default=0)
        return [f[:2] for f in found[begin:]]

    def log(self, table: str, to: int | None = None) -> DataFrame:
        """The rows of all batches that count, or of those up to `to`, with their `batch`."""
        ddl = next(d for _, t, d in MIGRATIONS if t == table)
        paths = [self._path(f"{table}/{folder}") for _, folder in self._batches(table, to)]
        schema = f"{ddl}, batch bigint"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def latest(self, table: str, when: Column | None = None, to: int | None = None) -> DataFrame:
        """The latest row of each key, as of batch `to` where it is given; `when` is a condition on key columns."""
        keys = KEYS[table]
        log = self.log(table, to).repartition(self._parts(table, to), *keys) if when is None else self.log(table, to).where(when)
        rest = [c for c in log.columns if c not in (*keys, "batch")]
        return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")

    def _parts(self, table: str, to: int | None = None) -> int:
        """Into how many parts the log is dealt by key: PART_BYTES of its files in one at most, so that what a task sorts
        doesn't grow with the log; of a smaller log as many as there are cores, of SMALL_BYTES at least."""
        size = 0
        for _, folder in self._batches(table, to):
            files, where = self._file(f"{table}/{folder}")
            size += files.getContentSummary(where).getLength()
        return max(1, -(-size // PART_BYTES), min(self.spark.sparkContext.defaultParallelism, -(-size // SMALL_BYTES)))

    def last_batch(self, table: str) -> int:
        return max((number for number, _ in self._batches(table)), default=0)

    def append(self, table: str, rows: DataFrame, after: int | None = None) -> int:
        """Append rows as one batch and return its number. With `after` given, only as the batch after that one, else
        after what there is, tried again where another writer comes between."""
        names = [f.split()[0] for f in next(d for _, t, d in MIGRATIONS if t == table).split(", ")]
        for _ in range(1 if after is not None else TRIES):
            number = (self.last_batch(table) if after is None else after) + 1
            if self._publish(table, rows.select(*names), number, PART):
                return number
        raise Conflict(f"another writer appended to {table} meanwhile")

    def compact(self, table: str) -> None:
        """Publish the latest row of each key as a batch that replaces those before it; Conflict if one comes between.
        Earlier folders stay for readers that have begun; `vacuum` deletes them."""
        last = self.last_batch(table)
        if last and not self._publish(table, self.latest(table, to=last), last + 1, WHOLE):
            raise Conflict(f"another writer appended to {table} meanwhile")

    def vacuum(self, table: str) -> None:
        """Delete folders that no batch that counts is in. No writer may be at work, nor a reader of an earlier state."""
        kept = {folder for _, folder in self._batches(table)} | {"log"}
        files, where = self._file(table)
        for found in files.listStatus(where):
            if found.getPath().getName() not in kept:
                files.delete(found.getPath(), True)

    def _publish(self, table: str, rows: DataFrame, number: int, kind: str) -> bool:
        """Write rows as batch `number`, unless there is one; whether they count now."""
        if self.last_batch(table) >= number:
            return False
        folder = uuid.uuid4().hex
        rows.withColumn("batch", F.lit(number).cast("bigint")).write.parquet(self._path(f"{table}/{folder}"))
        files, marker = self._file(f"{table}/log/{number:012d}{MARKER}")
        _, prepared = self._file(f"{table}/log/.{folder}")
        out = files.create(prepared, False)
        out.write(bytearray(f"{number}-{folder}-{kind}".encode()))
        out.close()
        if files.getScheme() == "file":
            made = _linked(self.spark, prepared, marker)
            files.delete(prepared, False)
        else:
            made = files.rename(prepared, marker)
        if not made:
            files.delete(self._file(f"{table}/{folder}")[1], True)
        return made

    def _told(self, table: str, names: list[str]) -> list[str]:
        """What the markers of these names say, each read once."""
        seen = self._markers.setdefault(table, {})
        for name in names:
            if name not in seen:
                files, where = self._file(f"{table}/log/{name}")
                source = files.open(where)
                seen[name] = bytes(source.readAllBytes()).decode()
                source.close()
        return [seen[n] for n in names]

    def _file(self, name: str):
        """The file system of a path below the root, and the path."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path(name))
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _exists(self, name: str) -> bool:
        files, where = self._file(name)
        return files.exists(where)

    # status

    def status(self) -> DataFrame:
        return self.latest("status")

    def document(self, case_id: str, document_id: str) -> DataFrame:
        """The status row of a document, none if it isn't registered."""
        return self.latest("status", (F.col("case_id") == case_id) & (F.col("document_id") == document_id))

    def case_documents(self, case_id: str) -> DataFrame:
        """The status rows of a case, by document_id."""
        return self.latest("status", F.col("case_id") == case_id).orderBy("document_id")

    def case_status(self, case_id: str) -> str | None:
        """The status of a case; null without documents."""
        one = F.col("case_id") == case_id
        row = case_table(self.latest("status", one), self.latest("evaluations", one)).first()
        return row["case_status"] if row else None

    def register(self, documents: DataFrame) -> None:
        """Add documents (case_id, document_id) as RECEIVED, attempt 1; all or none, as one that is there already, or twice, is an error."""
        after, keys = self.last_batch("status"), ["case_id", "document_id"]
        wanted = documents.select(*keys)
        twice = wanted.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)
        known = wanted.join(self.log("status", after).select(*keys), keys, "left_semi")
        if bad := twice.unionAll(known).limit(1).collect():
            raise DocumentExists(f"document already registered: case {bad[0]['case_id']!r} document {bad[0]['document_id']!r}")
        rows = wanted.select(*keys, F.lit("RECEIVED").alias("stage"), F.lit(1).alias("attempt_count"), self.clock().alias("last_updated"), F.lit(None).cast("string").alias("error_detail"))
        self.append("status", rows, after)

    def judge(self, requests: DataFrame, to: int | None = None) -> DataFrame:
        """As of batch `to`, or now, the requests (case_id, document_id, target, error_detail, perhaps expected) with the row that each leads to and
        `outcome`: ok, missing, invalid, or conflict, where the stage isn't `expected` or the document has several requests."""
        keys = ["case_id", "document_id"]
        asked = requests if "expected" in requests.columns else requests.withColumn("expected", F.lit(None).cast("string"))
        asked = asked.withColumn("_first", F.row_number().over(Window.partitionBy(*keys).orderBy("target", "error_detail")) == 1)
        now = self.latest("status", to=to).select(*keys, F.col("stage").alias("current"), F.col("attempt_count").alias("attempts"))
        both = asked.join(now, keys, "left")
        outcome = (
            F.when(F.col("current").isNull(), "missing")
            .when(~F.col("_first") | ~F.coalesce(F.col("expected") == F.col("current"), F.lit(True)), "conflict")
            .when(~is_valid_transition(F.col("current"), F.col("target")), "invalid")
            .otherwise("ok")
        )
        return both.select(
            *keys, F.col("target").alias("stage"), (F.col("attempts") + (F.col("current") == "FAILED").cast("int")).alias("attempt_count"),
            self.clock().alias("last_updated"), F.when(F.col("target") == "FAILED", F.col("error_detail")).alias("error_detail"), "current", outcome.alias("outcome"),
        )

    def transition(self, requests: DataFrame, strict: bool = True) -> None:
        """Move documents to new stages by `judge`; a request that isn't ok is an error and nothing is done, or, where not
        `strict`, it alone is left out. Judged and appended as of one batch: Conflict if another came between."""
        after = self.last_batch("status")
        judged = self.judge(requests, after)
        if strict and (bad := judged.where(F.col("outcome") != "ok").limit(1).collect()):
            b = bad[0]
            raise _PROBLEMS[b["outcome"]](f"{b['outcome']} transition {b['current']} -> {b['stage']} for case {b['case_id']!r} document {b['document_id']!r}")
        self.append("status", judged.where(F.col("outcome") == "ok"), after)

    # payloads

    def put_extractions(self, results: DataFrame) -> None:
        """Keep extraction records; a later one of a document replaces the earlier."""
        self.append("extractions", extraction_rows(results))

    def extractions(self, when: Column | None = None) -> DataFrame:
        """The extraction records, of each document the latest."""
        return extraction_records(self.latest("extractions", when))

    def put_snapshots(self, snapshots: DataFrame) -> None:
        """Keep snapshots; a later one of a case replaces the earlier."""
        self.append("evaluations", snapshot_rows(snapshots, self.clock()))

    def snapshots(self, when: Column | None = None) -> DataFrame:
        """The snapshots, of each case the latest."""
        return snapshot_records(self.latest("evaluations", when))
