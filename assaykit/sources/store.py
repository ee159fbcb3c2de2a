"""Stored history: runs, findings, lineage and snapshots as Parquet below one root.

A job writes its rows as one batch: files below ``<table>/batch=<attempt>``, as few as their size needs. The batch becomes visible as a
whole when its commit marker is created, an empty file whose name says all about it: version, batch numbers and run numbers that
it covers, tables that it has, and its attempt. Rows of an attempt without a marker are never read. A marker of a later version hides those whose
batch numbers lie within its own: so ``compact`` puts many small batches together, and ``delete_runs`` replaces a batch by one without
the removed runs. Reading lists the markers, no data; a run is read from the batches whose run numbers include it.

Run numbers are the highest stored one plus one, which needs a single writer.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import datetime, timezone
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from assaykit.functions.dates import elapsed_seconds, parse_instant
from assaykit.operators import history
from assaykit.operators.transform import null_violations, to_snapshot
from assaykit.operators.validation import RESULTS, results
from assaykit.session import Staging, delete, files_of

RUNS = {
    "run_id": "bigint",
    "pipeline_name": "string",
    "started_at": "timestamp",
    "finished_at": "timestamp",
    "duration_seconds": "double",
    "status": "string",
    "rows_processed": "bigint",
    "health_score": "double",
    "created_at": "timestamp",
}
RESULT_ROWS = {
    "result_id": "bigint",
    "run_id": "bigint",
    "check_order": "int",
    "check_name": "string",
    "category": "string",
    "status": "string",
    "severity": "string",
    "affected_rows": "bigint",
    "affected_percentage": "double",
    "message": "string",
    "created_at": "timestamp",
}
LINEAGE = {
    "lineage_id": "string",
    "dataset_name": "string",
    "stage": "string",
    "recorded_at": "timestamp",
    "path": "string",
    "rows": "bigint",
    "audit": "map<string,string>",
}
SNAPSHOTS = {"run_id": "bigint", "path": "string", "rows": "bigint"}
TABLES = {"runs": RUNS, "results": RESULT_ROWS, "lineage": LINEAGE, "snapshots": SNAPSHOTS}
BY_RUN = ("runs", "results", "snapshots")
#: Runs of a batch from which on it is large enough to be left alone by ``compact``.
LARGE_BATCH = 10_000


def ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{n} {t}" for n, t in columns.items())


class IntegrityError(ValueError):
    """Rows that break a contract of the stored tables."""


def instant(value: datetime | str | Column | None, fallback: Column) -> Column:
    """A moment given as datetime, ISO text or column."""
    if value is None:
        return fallback
    if isinstance(value, Column):
        return F.coalesce(value, fallback)
    if isinstance(value, datetime):
        value = value.astimezone(timezone.utc).isoformat()
    return parse_instant(F.lit(value), fallback)


class Commit(NamedTuple):
    """What the name of a commit marker says. Without runs ``last`` is below ``first``."""

    version: int
    batches: tuple[int, int]
    first: int
    last: int
    tables: tuple[str, ...]
    attempt: str

    @property
    def name(self) -> str:
        (a, b), marks = self.batches, "".join(t[0:2] for t in self.tables)
        return f"{self.version}_{a}_{b}_{self.first}_{self.last}_{marks}_{self.attempt}"

    @classmethod
    def of(cls, name: str) -> Commit:
        *numbers, marks, attempt = name.split("_")
        version, a, b, first, last = map(int, numbers)
        return cls(version, (a, b), first, last, tuple(t for t in TABLES if t[0:2] in marks), attempt)

    def covers(self, other: Commit) -> bool:
        return self.batches[0] <= other.batches[0] and other.batches[1] <= self.batches[1]


class HistoryStore:
    """Tables below ``root``; ``create`` makes them, all reads return DataFrames."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.staging = Staging(spark, f"{self.root}/_staged")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    # Batches

    def _names(self, folder: str) -> list[str]:
        files, target = files_of(self.spark, folder)
        return sorted(f.getPath().getName() for f in files.listStatus(target)) if files.exists(target) else []

    def commits(self) -> list[Commit]:
        """Visible batches, oldest first: those that no later version covers."""
        kept: list[Commit] = []
        for commit in sorted(map(Commit.of, self._names(self.path("commits"))), reverse=True):
            if not any(k.covers(commit) for k in kept):
                kept.append(commit)
        return sorted(kept, key=lambda c: c.batches)

    def _write(self, rows: DataFrame, name: str, attempt: str, runs: int = 0) -> None:
        """Rows of a batch, ordered by run so that files tell which runs they have. Spark merges small partitions.

        A batch of one run is one file: it has as many findings as the run has checks.
        """
        if name in BY_RUN:
            rows = rows.coalesce(1) if runs == 1 else rows.repartitionByRange("run_id").sortWithinPartitions("run_id")
        rows.write.mode("overwrite").parquet(f"{self.path(name)}/batch={attempt}")

    def _commit(self, tables: dict[str, DataFrame], first: int, last: int, replaces: Sequence[Commit] = ()) -> Commit:
        """Write a batch and make it visible; a failure on the way leaves nothing of it."""
        every = [Commit.of(n) for n in self._names(self.path("commits"))]
        number = 1 + max((c.batches[1] for c in every), default=0)
        batches = (replaces[0].batches[0], replaces[-1].batches[1]) if replaces else (number, number)
        commit = Commit(1 + max((c.version for c in every), default=0), batches, first, last, tuple(t for t in TABLES if t in tables),
                        uuid.uuid4().hex)
        try:
            for name, rows in tables.items():
                self._write(rows, name, commit.attempt, last - first + 1)
            files, target = files_of(self.spark, f"{self.path('commits')}/{commit.name}")
            if not files.createNewFile(target):
                raise OSError(f"the commit marker {commit.name} exists already")
        except Exception:
            self._remove([commit.attempt])
            raise
        self._forget(replaces)
        return commit

    def _remove(self, attempts: Sequence[str]) -> None:
        for name in TABLES:
            for attempt in attempts:
                delete(self.spark, f"{self.path(name)}/batch={attempt}")

    def _forget(self, commits: Sequence[Commit]) -> None:
        """Delete batches that a later version hides: rows first, so that a stop in between leaves a hidden marker only."""
        self._remove([c.attempt for c in commits])
        for commit in commits:
            delete(self.spark, f"{self.path('commits')}/{commit.name}")

    def remove_leftovers(self) -> int:
        """Delete what stopped jobs left: hidden markers, rows without a visible marker, staged rows. Call it between jobs."""
        visible = self.commits()
        self._forget([c for c in map(Commit.of, self._names(self.path("commits"))) if c not in visible])
        known, found = {c.attempt for c in visible}, set()
        for name in TABLES:
            found |= {n.removeprefix("batch=") for n in self._names(self.path(name)) if n.startswith("batch=")} - known
        self._remove(sorted(found))
        delete(self.spark, f"{self.root}/_staged")
        return len(found)

    def compact(self, least: int = LARGE_BATCH) -> int:
        """Put neighbouring batches together until they have ``least`` runs; returns the number of batches that went.

        Readers see the old batches until the marker of the new one exists, and then that one alone.
        """
        groups: list[list[Commit]] = [[]]
        for commit in self.commits():
            groups[-1].append(commit)
            if sum(max(0, c.last - c.first + 1) for c in groups[-1]) >= least:
                groups.append([])
        gone = 0
        for group in (g for g in groups if len(g) > 1):
            tables = {n: self._read(n, group) for n in TABLES if any(n in c.tables for c in group)}
            numbered = [c for c in group if c.first <= c.last]
            self._commit(tables, min((c.first for c in numbered), default=0), max((c.last for c in numbered), default=-1), group)
            gone += len(group) - 1
        return gone

    def create(self) -> HistoryStore:
        """Make the folders that do not exist yet; a table without a batch is empty."""
        for name in (*TABLES, "commits"):
            files, target = files_of(self.spark, self.path(name))
            files.mkdirs(target)
        return self

    def ping(self) -> bool:
        """True if the store answers a query."""
        return self.runs().select(F.lit(1)).limit(1).count() >= 0

    # Reads

    def _read(self, name: str, commits: Sequence[Commit] | None = None) -> DataFrame:
        schema = TABLES[name]
        commits = self.commits() if commits is None else commits
        paths = [f"{self.path(name)}/batch={c.attempt}" for c in commits if name in c.tables]
        if not paths:
            return self.spark.createDataFrame([], ddl(schema))
        return self.spark.read.schema(ddl(schema)).parquet(*paths).select(*schema)

    def _holding(self, run_id: int | None) -> list[Commit] | None:
        return None if run_id is None else [c for c in self.commits() if c.first <= run_id <= c.last]

    def runs(self) -> DataFrame:
        return self._read("runs")

    def results(self, run_id: int | None = None) -> DataFrame:
        """Findings of all runs, or of one, for which only its batch is read."""
        found = self._read("results", self._holding(run_id))
        return found if run_id is None else history.results_of(found, run_id)

    def newest_run_id(self) -> int | None:
        """Highest run number, as the markers have it."""
        return max((c.last for c in self.commits() if c.first <= c.last), default=None)

    def latest_results(self) -> DataFrame:
        """Findings of the newest run; only its batch is read."""
        newest = self.newest_run_id()
        return self.results(0 if newest is None else newest)

    def lineage(self) -> DataFrame:
        return self._read("lineage")

    def _current_snapshot(self) -> str | None:
        return self._read("snapshots").agg(F.max_by("path", "run_id").alias("path")).first()["path"]

    def snapshot(self) -> DataFrame:
        """The snapshot of the newest committed run that has one."""
        newest = self._current_snapshot()
        if newest is None:
            raise FileNotFoundError(f"no snapshot has been published below {self.root}")
        return self.spark.read.parquet(newest)

    def remove_old_snapshots(self) -> int:
        """Delete snapshots that are not current, with the reports staged on the way; returns their number.

        Call it between runs: the snapshot of a run in progress is not current yet.
        """
        current = self._current_snapshot()
        old = [n for n in self._names(self.path("transactions"))
               if current is None or n.split(".")[0] != current.rsplit("/", 1)[-1]]
        for name in old:
            delete(self.spark, f"{self.path('transactions')}/{name}")
        self.remove_leftovers()
        return sum(not name.endswith(".json") for name in old)

    def next_run_id(self) -> int:
        return 1 + (self.newest_run_id() or 0)

    # Writes

    def stage(self, rows: DataFrame, name: str) -> DataFrame:
        """Rows written below the root and read back: evaluated once, safe against lost executors, until ``clear``."""
        return self.staging(rows, name)

    def clear(self) -> None:
        """Delete what was staged."""
        self.staging.__exit__()

    def discard_snapshot(self, path: str) -> None:
        """Delete a staged snapshot that was not published, with its sidecar."""
        delete(self.spark, path)
        delete(self.spark, f"{path}.lineage.json")

    def _check(self, rows: DataFrame, rules: dict[str, Column], what: str) -> None:
        found = {n: c for n, c in history.violations(rows, rules).first().asDict().items() if c}
        if found:
            raise IntegrityError(f"{what} break the stored contract: {found}")

    def snapshot_path(self, run_id: int) -> str:
        """A new place for the snapshot of a run."""
        return f"{self.path('transactions')}/run_id={run_id}-{uuid.uuid4().hex}"

    def stage_snapshot(self, transformed: DataFrame, path: str) -> dict[str, int]:
        """Write the next snapshot next to the current one, in one pass that also counts.

        Returns the counts. Readers see it when the run is saved with that path.
        """
        counted = Observation()
        rules = null_violations()
        columns = to_snapshot(transformed)
        observed = columns.observe(counted, F.count(F.lit(1)).alias("rows_loaded"),
                                   *[c.alias(n) for n, c in rules.items()])
        observed.select(
            F.monotonically_increasing_id().alias("transaction_id"), "*",
            F.lit(datetime.now(timezone.utc)).alias("loaded_at"),
        ).write.parquet(path)
        return counted.get

    def verify_snapshot(self, path: str, counts: dict[str, int]) -> DataFrame:
        """The staged table, if it has every row that was sent and no forbidden null."""
        staged = self.spark.read.parquet(path)
        loaded = staged.count()
        if loaded != counts["rows_loaded"]:
            raise IntegrityError(f"Row-count integrity failure: expected {counts['rows_loaded']}, loaded {loaded}.")
        nulls = {n.removeprefix("null_"): c for n, c in counts.items() if n.startswith("null_") and c}
        if nulls:
            raise IntegrityError(f"NOT NULL columns have missing values: {nulls}")
        return staged

    def save_runs(
        self,
        scored: DataFrame,
        pipeline_name: str = "online_retail_quality_pipeline",
        started_at: datetime | str | Column | None = None,
        finished_at: datetime | str | Column | None = None,
        status: str = "COMPLETED",
        snapshot: tuple[str, int] | None = None,
        lineage: DataFrame | None = None,
    ) -> DataFrame:
        """Store scored reports with their findings and return the run rows.

        ``scored`` has one row per run. Without a ``run_id`` column it must be a single report, which
        gets the next number.
        """
        if "run_id" not in scored.columns:
            scored = scored.withColumn("run_id", F.lit(self.next_run_id()).cast("bigint"))
        kept = self.stage(scored.select(
            "run_id", "total_rows", "health_score", RESULTS,
            *[c for c in ("started_at", "finished_at") if c in scored.columns]), "report")
        moment = datetime.now(timezone.utc)
        now = F.lit(moment)
        finished = instant(finished_at, now)
        started = instant(started_at, finished)
        runs = kept.select(
            "run_id", F.lit(pipeline_name).alias("pipeline_name"), started.alias("started_at"),
            finished.alias("finished_at"), elapsed_seconds(started, finished).alias("duration_seconds"),
            F.lit(status).alias("status"), F.col("total_rows").alias("rows_processed"), "health_score",
            now.alias("created_at"))
        found = results(kept, ["run_id"]).select(
            history.result_id(F.col("run_id"), F.col("check_order")).alias("result_id"), "run_id", "check_order",
            "check_name", "category", "status", "severity", "affected_rows", "affected_percentage", "message",
            now.alias("created_at"))
        commit = self.add(runs, found, snapshot, lineage)
        return self._read("runs", [commit])

    def add(self, runs: DataFrame, found: DataFrame, snapshot: tuple[str, int] | None = None,
            lineage: DataFrame | None = None) -> Commit:
        """Store run rows and findings as one batch after checking every rule of the two tables."""
        self._check(runs, history.run_violations(), "runs")
        self._check(found, history.result_violations(), "findings")
        known = self.runs().select("run_id")
        if not runs.join(known, "run_id", "left_semi").isEmpty():
            raise IntegrityError("a run with this number is already stored")
        parents = runs.select("run_id").unionByName(known)
        if not history.orphan_results(found, parents).isEmpty():
            raise IntegrityError("findings refer to a run that does not exist")
        first, last = runs.agg(F.min("run_id"), F.max("run_id")).first()
        tables = {"results": found, "runs": runs}
        if snapshot:
            path, rows = snapshot
            tables["snapshots"] = runs.select(
                "run_id", F.lit(path).alias("path"), F.lit(rows).cast("bigint").alias("rows"))
        if lineage is not None:
            tables["lineage"] = lineage.select(*LINEAGE)
        return self._commit(tables, *((0, -1) if first is None else (first, last)))

    def delete_runs(self, run_ids: Sequence[int]) -> None:
        """Remove runs with their findings: each batch that has any is replaced by one without them."""
        gone = sorted({int(i) for i in run_ids})
        for commit in self.commits():
            if not any(commit.first <= i <= commit.last for i in gone):
                continue
            tables = {n: self._read(n, [commit]) for n in commit.tables}
            left = {n: rows.filter(~F.col("run_id").isin(gone)) if n in BY_RUN else rows for n, rows in tables.items()}
            first, last = left["runs"].agg(F.min("run_id"), F.max("run_id")).first()
            self._commit(left, *((0, -1) if first is None else (first, last)), [commit])

    def record_lineage(self, rows: DataFrame) -> None:
        """Store lineage records as a batch of their own."""
        self._commit({"lineage": rows.select(*LINEAGE)}, 0, -1)
