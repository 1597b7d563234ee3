"""Append-only tables in a shared folder, with whole commits: the log of run events as a stream, and the ledger.

Tasks write part files; a commit is one small file that names them, made in one step that fails if it is there already. What no commit names
does not exist for readers, so a task or a job that fails leaves nothing behind, and a batch that is written twice counts once.

The folder has to be one that the driver and all executors see under one path (a shared mount), such as spark.checkpoint.dir.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

EVENT = "run_id string, seq long, stage string, status string, detail string, at timestamp"
EVENT_ARROW = pa.schema([("run_id", pa.string()), ("seq", pa.int64()), ("stage", pa.string()), ("status", pa.string()), ("detail", pa.string()), ("at", pa.timestamp("us", tz="UTC"))])
#: Rows of one batch that a reader hands on.
ROWS = 10_000


class Conflict(Exception):
    """Someone else has made the commit."""


def folder_of(options: dict) -> str:
    path = options["path"].removeprefix("file:")
    return "/" + path.lstrip("/")


def create(path: str, content: dict) -> bool:
    """Makes a file with its whole content in one step; False if there is one of that name."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    draft = f"{path}.{uuid.uuid4().hex}"
    with open(draft, "w") as f:
        json.dump(content, f)
        f.flush()
        os.fsync(f.fileno())
    try:
        os.link(draft, path)
        return True
    except FileExistsError:
        return False
    finally:
        os.unlink(draft)


def load(path: str) -> dict | None:
    try:
        with open(path) as f:
            return json.load(f)
    except FileNotFoundError:
        return None


@dataclass
class Parts(WriterCommitMessage):
    """The files of one task, and how many rows they have."""

    files: list
    rows: int


@dataclass
class Part(InputPartition):
    path: str

    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def write_part(folder: str, rows: Iterator) -> Parts:
    """One task's rows as one file of JSON lines; no rows, no file."""
    name, n = f"parts/{uuid.uuid4().hex}.jsonl", 0
    os.makedirs(f"{folder}/parts", exist_ok=True)
    try:
        with open(f"{folder}/{name}", "w") as f:
            for row in rows:
                f.write(json.dumps({k: v.timestamp() if isinstance(v, datetime) else v for k, v in row.asDict().items()}) + "\n")
                n += 1
            f.flush()
            os.fsync(f.fileno())
    except BaseException:
        os.unlink(f"{folder}/{name}")
        raise
    if not n:
        os.unlink(f"{folder}/{name}")
    return Parts([name] * bool(n), n)


def drop_parts(folder: str, messages: list) -> None:
    for m in messages:
        for name in m.files if m else []:
            if os.path.exists(f"{folder}/{name}"):
                os.unlink(f"{folder}/{name}")


def read_events(path: str) -> Iterator[pa.RecordBatch]:
    """The events of a part file, some rows at a time."""

    def batch(rows: list[dict]) -> pa.RecordBatch:
        for r in rows:
            r["at"] = None if r.get("at") is None else datetime.fromtimestamp(r["at"], timezone.utc)
        return pa.RecordBatch.from_pylist(rows, EVENT_ARROW)

    rows = []
    with open(path) as f:
        for line in f:
            rows.append(json.loads(line))
            if len(rows) == ROWS:
                yield batch(rows)
                rows = []
    if rows:
        yield batch(rows)


class Log:
    """The commits of a log: for each writer, its batches from 0 on."""

    def __init__(self, folder: str):
        self.folder = folder

    def writers(self) -> list[str]:
        top = f"{self.folder}/commits"
        return sorted(os.listdir(top)) if os.path.isdir(top) else []

    def path(self, writer: str, batch: int) -> str:
        return f"{self.folder}/commits/{writer}/{batch:012d}.json"

    def following(self, start: dict) -> dict:
        """Each writer's first batch that is not there, from `start` on: only what is new is looked at."""
        out = {}
        for w in self.writers():
            n = start.get(w, 0)
            while os.path.exists(self.path(w, n)):
                n += 1
            out[w] = n
        return out

    def parts(self, start: dict, end: dict) -> list[Part]:
        return [Part(f"{self.folder}/{name}") for w in sorted(end) for n in range(start.get(w, 0), end[w]) for name in load(self.path(w, n))["files"]]

    def commit(self, writer: str, batch: int, messages: list) -> bool:
        files = [name for m in messages if m for name in m.files]
        return create(self.path(writer, batch), {"files": files, "rows": sum(m.rows for m in messages if m)})


class RunLog(DataSource):
    """Format `run_log`, option `path`: events of runs. As a stream it is read from its beginning, whenever a reader comes, and then followed.

    Its offset is the number of batches that have been read of each writer. Option `writer` names who writes: a stream that writes a batch again
    after a failure finds its commit, and drops what it wrote. A batch job is a writer of its own, unless it has a name.
    """

    @classmethod
    def name(cls) -> str:
        return "run_log"

    def schema(self) -> str:
        return EVENT

    def reader(self, schema) -> "LogReader":
        return LogReader(folder_of(self.options))

    def writer(self, schema, overwrite: bool) -> "LogWriter":
        if overwrite:
            raise ValueError("a log is only appended to")
        return LogWriter(folder_of(self.options), self.options.get("writer") or uuid.uuid4().hex)

    def streamReader(self, schema) -> "LogStreamReader":
        return LogStreamReader(folder_of(self.options))

    def streamWriter(self, schema, overwrite: bool) -> "LogStreamWriter":
        return LogStreamWriter(folder_of(self.options), self.options["writer"])


class LogReader(DataSourceReader):
    def __init__(self, folder: str):
        self.log = Log(folder)

    def partitions(self) -> list[Part]:
        return self.log.parts({}, self.log.following({})) or [Part("")]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return read_events(partition.path) if partition.path else iter(())


class LogStreamReader(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.log = Log(folder)
        self.seen: dict = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        self.seen = self.log.following(self.seen)
        return self.seen

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return self.log.parts(start, end)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return read_events(partition.path)

    def commit(self, end: dict) -> None:
        pass  # the log stays as it is, for readers that come later


class LogWriter(DataSourceWriter):
    """One batch: the writer's next one."""

    def __init__(self, folder: str, writer: str):
        self.folder, self.name = folder, writer
        self.batch = Log(folder).following({}).get(writer, 0)

    def write(self, iterator: Iterator) -> Parts:
        return write_part(self.folder, iterator)

    def commit(self, messages: list) -> None:
        if not Log(self.folder).commit(self.name, self.batch, messages):
            drop_parts(self.folder, messages)
            raise Conflict(f"batch {self.batch} of {self.name} has been written by someone else")

    def abort(self, messages: list) -> None:
        drop_parts(self.folder, messages)


class LogStreamWriter(DataSourceStreamWriter):
    def __init__(self, folder: str, writer: str):
        self.folder, self.name = folder, writer

    def write(self, iterator: Iterator) -> Parts:
        return write_part(self.folder, iterator)

    def commit(self, messages: list, batchId: int) -> None:
        if not Log(self.folder).commit(self.name, batchId, messages):
            drop_parts(self.folder, messages)  # this batch counts already

    def abort(self, messages: list, batchId: int) -> None:
        drop_parts(self.folder, messages)


def swept(path: str, older: float = 86_400) -> int:
    """Deletes part files that no commit names and that are older than so many seconds: those of tasks that were still at work when their job was given up.
    Readers never see them. Returns how many there were."""
    folder = folder_of({"path": path})
    log, now, n = Log(folder), time.time(), 0
    named = {os.path.basename(p.path) for p in log.parts({}, log.following({}))}
    for name in os.listdir(f"{folder}/parts") if os.path.isdir(f"{folder}/parts") else []:
        at = f"{folder}/parts/{name}"
        if name not in named and os.path.exists(at) and now - os.path.getmtime(at) >= older:
            os.unlink(at)
            n += 1
    return n


def register(spark: SparkSession) -> None:
    for kind in (RunLog, Ledger, Cassettes):
        spark.dataSource.register(kind)


def log_events(events: DataFrame, path: str, writer: str | None = None) -> None:
    """Appends events to the log as one batch."""
    register(events.sparkSession)
    out = events.select("run_id", "seq", "stage", "status", "detail", "at").write.format("run_log").mode("append").option("path", path)
    (out.option("writer", writer) if writer else out).save()


def followed(spark: SparkSession, path: str) -> DataFrame:
    """The log's events as a stream, from the first one on."""
    register(spark)
    return spark.readStream.format("run_log").option("path", path).load()


SPEND = "day string, spent double, n long"


class Ledger(DataSource):
    """Format `ledger`, option `path`: the versions of a table of sums by day. A version is written as a whole, over the one that the writer has read
    (option `version`); if another one has come in between, the writer gets an error and nothing is changed. Read, it is its last version."""

    @classmethod
    def name(cls) -> str:
        return "ledger"

    def schema(self) -> str:
        return SPEND

    def reader(self, schema) -> "LedgerReader":
        return LedgerReader(folder_of(self.options), int(self.options.get("version", -1)))

    def writer(self, schema, overwrite: bool) -> "LedgerWriter":
        return LedgerWriter(folder_of(self.options), int(self.options["version"]))


def last_version(folder: str) -> int:
    return Log(folder).following({}).get("ledger", 0)


class LedgerReader(DataSourceReader):
    def __init__(self, folder: str, version: int):
        n = last_version(folder) if version < 0 else version
        self.parts = [Part(f"{folder}/{name}") for name in load(Log(folder).path("ledger", n - 1))["files"]] if n else []

    def partitions(self) -> list[Part]:
        return self.parts or [Part("")]

    def read(self, partition: Part) -> Iterator[tuple]:
        if partition.path:
            with open(partition.path) as f:
                for line in f:
                    r = json.loads(line)
                    yield r["day"], r["spent"], r["n"]


class LedgerWriter(DataSourceWriter):
    def __init__(self, folder: str, version: int):
        self.folder, self.version = folder, version

    def write(self, iterator: Iterator) -> Parts:
        return write_part(self.folder, iterator)

    def commit(self, messages: list) -> None:
        if not Log(self.folder).commit("ledger", self.version, messages):
            drop_parts(self.folder, messages)
            raise Conflict(f"version {self.version + 1} of the ledger has been written by someone else")

    def abort(self, messages: list) -> None:
        drop_parts(self.folder, messages)


def ledger(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """day, spent, n, of the last version or a named one; empty where none has been written."""
    register(spark)
    read = spark.read.format("ledger").option("path", path)
    return (read if version is None else read.option("version", version)).load()


def booked(before: DataFrame, spend: DataFrame) -> DataFrame:
    """The sums by day of a ledger and of further spend (day, spent)."""
    new = spend.groupBy("day").agg(F.sum("spent").alias("spent"), F.count("*").alias("n"))
    return before.unionByName(new).groupBy("day").agg(F.sum("spent").alias("spent"), F.sum("n").alias("n"))


def book(spend: DataFrame, path: str, tries: int = 5) -> int:
    """Adds spend (day, spent) to the ledger: reads a version and writes the next; where another writer was first, reads anew. Returns the version."""
    spark, folder = spend.sparkSession, folder_of({"path": path})
    for left in range(tries - 1, -1, -1):
        version = last_version(folder)
        try:
            booked(ledger(spark, path, version), spend).write.format("ledger").mode("append").option("path", path).option("version", version).save()
            return version + 1
        except Exception as e:
            if "Conflict" not in str(e) or not left:
                raise
    raise AssertionError


TAPE = "name string, digest string, payload string, kind string"


class Cassettes(DataSource):
    """Format `cassettes`, option `path`: recorded responses. A recording is one commit, whose manifest names its files and how many responses of each kind
    they have; it is made over what was there before (option `version`), so of two recorders at a time one gets an error. Read, it is all recordings."""

    @classmethod
    def name(cls) -> str:
        return "cassettes"

    def schema(self) -> str:
        return TAPE

    def reader(self, schema) -> "TapeReader":
        return TapeReader(folder_of(self.options))

    def writer(self, schema, overwrite: bool) -> "TapeWriter":
        return TapeWriter(folder_of(self.options), int(self.options["version"]))


@dataclass
class Tape(Parts):
    kinds: dict


class TapeReader(DataSourceReader):
    def __init__(self, folder: str):
        log = Log(folder)
        self.parts = log.parts({}, log.following({}))

    def partitions(self) -> list[Part]:
        return self.parts or [Part("")]

    def read(self, partition: Part) -> Iterator[tuple]:
        if partition.path:
            with open(partition.path) as f:
                for line in f:
                    r = json.loads(line)
                    yield r["name"], r["digest"], r["payload"], r["kind"]


class TapeWriter(DataSourceWriter):
    def __init__(self, folder: str, version: int):
        self.folder, self.version = folder, version

    def write(self, iterator: Iterator) -> Tape:
        kinds: dict = {}

        def counted() -> Iterator:
            for row in iterator:
                kinds[row["kind"]] = kinds.get(row["kind"], 0) + 1
                yield row

        part = write_part(self.folder, counted())
        return Tape(part.files, part.rows, kinds)

    def commit(self, messages: list) -> None:
        total: dict = {}
        for m in messages:
            for kind, n in (m.kinds if m else {}).items():
                total[kind] = total.get(kind, 0) + n
        content = {"files": [name for m in messages if m for name in m.files], "rows": sum(total.values()), "kinds": total}
        if not create(Log(self.folder).path("tapes", self.version), content):
            drop_parts(self.folder, messages)
            raise Conflict(f"recording {self.version + 1} has been made by someone else")

    def abort(self, messages: list) -> None:
        drop_parts(self.folder, messages)


def tape(responses: DataFrame, path: str, analysis: list[str], version: int | None = None) -> int:
    """Records responses (name, digest, payload) over a version (the last, if none is named), and returns the next; kinds by the first part of the name."""
    register(responses.sparkSession)
    at = Log(folder_of({"path": path})).following({}).get("tapes", 0) if version is None else version
    kind = F.when(F.split_part("name", F.lit("."), F.lit(1)).isin(analysis), "analysis").otherwise("generation")
    responses.select("name", "digest", "payload", kind.alias("kind")).write.format("cassettes").mode("append").option("path", path).option("version", at).save()
    return at + 1


def tapes(spark: SparkSession, path: str) -> DataFrame:
    """All recorded responses, with their kind."""
    register(spark)
    return spark.read.format("cassettes").option("path", path).load()


def manifests(path: str) -> list[dict]:
    """The manifests of all recordings, in order."""
    log = Log(folder_of({"path": path}))
    return [load(log.path("tapes", n)) for n in range(log.following({}).get("tapes", 0))]
