from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from assaykit import HistoryStore
from assaykit.operators import history
from assaykit.operators.checks import FINDING_TYPE
from assaykit.operators.validation import RESULTS
from assaykit.sources.sinks import stamp, write_lineage_sidecar
from assaykit.sources.store import IntegrityError

FOUND = [("column_presence", "schema", "PASS", "INFO", "Schema matches.", 0, 0.0, {}),
         ("duplicate_rows", "uniqueness", "WARNING", "MEDIUM", "Duplicate found.", 1, 33.33, {}),
         ("unit_price_validity", "validity", "FAIL", "HIGH", "Negative price.", 1, 33.33, {})]
START = datetime(2026, 8, 25, 12, tzinfo=timezone.utc)


@pytest.fixture
def store(spark, tmp_path):
    return HistoryStore(spark, str(tmp_path / "store")).create()


@pytest.fixture
def scored(spark):
    def make(value=72.5, found=FOUND, rows=3):
        return spark.createDataFrame([(rows, value, found)],
                                     f"total_rows bigint, health_score double, {RESULTS} array<{FINDING_TYPE}>")
    return make


def test_create_is_idempotent(store, scored):
    assert store.ping() and store.runs().count() == 0 and store.results().count() == 0
    store.save_runs(scored())
    assert store.create().runs().count() == 1


def test_save_and_read(store, scored):
    run = store.save_runs(scored(), started_at="2026-08-25T12:00:00Z", finished_at=START + timedelta(seconds=1.5)).first()
    assert (run.run_id, run.health_score, run.rows_processed, run.status) == (1, 72.5, 3, "COMPLETED")
    assert run.duration_seconds == 1.5
    assert [r.check_name for r in history.results_of(store.results(), 1).collect()] == [f[0] for f in FOUND]
    assert history.latest_run(store.runs()).first().run_id == 1


def test_duration_is_never_negative(store, scored):
    assert store.save_runs(scored(), started_at=START, finished_at=START - timedelta(hours=1)).first().duration_seconds == 0.0


def test_order_of_runs(store, scored):
    store.save_runs(scored(72.5))
    store.save_runs(scored(88.0))
    assert [r.run_id for r in history.recent_runs(store.runs()).collect()] == [2, 1]
    assert [r.health_score for r in history.score_history(store.runs()).collect()] == [72.5, 88.0]
    assert [r.score_delta for r in history.score_delta(store.runs()).orderBy("run_id").collect()] == [None, 15.5]
    for limit in (0, -1):
        with pytest.raises(ValueError):
            history.recent_runs(store.runs(), limit)
    assert history.failed_checks(store.results(), 1).count() == 1
    assert history.warning_checks(store.results(), 1).count() == 1
    assert history.failed_checks(store.results()).count() == 2
    assert {r.run_id for r in store.latest_results().collect()} == {2}


def test_runs_carry_their_results(store, scored):
    store.save_runs(scored())
    store.save_runs(scored(found=[]))
    rows = {r.run_id: r for r in history.runs_with_results(store.runs(), store.results()).collect()}
    assert [q.check_name for q in rows[1].quality_results] == [f[0] for f in FOUND]
    assert rows[2].quality_results is None
    assert history.run_results(store.runs(), store.results()).count() == 3


def test_result_without_run_is_rejected(store, scored):
    store.save_runs(scored())
    orphan = store.results().limit(1).withColumn("run_id", F.lit(9999).cast("bigint"))
    with pytest.raises(IntegrityError, match="does not exist"):
        store.add(store.runs().filter("false"), orphan)


@pytest.mark.parametrize("value, found", [
    (101.0, FOUND), (-1.0, FOUND), (50.0, [("x", "c", "PASS", "INFO", "m", -1, 0.0, {})]),
    (50.0, [("x", "c", "PASS", "INFO", "m", 0, 100.5, {})]), (50.0, [("x", "c", "ODD", "INFO", "m", 0, 0.0, {})])])
def test_ranges_are_enforced(store, scored, value, found):
    with pytest.raises(IntegrityError):
        store.save_runs(scored(value, found))
    assert store.runs().count() == 0 and store.results().count() == 0


def test_uncommitted_findings_stay_invisible(store, scored):
    """Findings of a run that never got its run row, and the run that takes over its number."""
    store.save_runs(scored())
    left = store.results().withColumns({"run_id": F.lit(2).cast("bigint"), "status": F.lit("FAIL")})
    store._write(left, "results", "0" * 32)
    assert store.results().count() == 3
    store.save_runs(scored(found=FOUND[:1]))
    assert [r.status for r in history.results_of(store.results(), 2).collect()] == ["PASS"]


def test_numbers_are_not_reused(store, scored):
    store.save_runs(scored().withColumn("run_id", F.lit(5).cast("bigint")))
    assert store.next_run_id() == 6
    with pytest.raises(IntegrityError, match="already stored"):
        store.save_runs(scored().withColumn("run_id", F.lit(5).cast("bigint")))


def test_deleting_a_run_deletes_its_findings(store, scored):
    store.save_runs(scored())
    store.save_runs(scored())
    store.delete_runs([1])
    assert [r.run_id for r in store.runs().collect()] == [2]
    assert {r.run_id for r in store.results().collect()} == {2}
    assert store.spark.read.parquet(store.path("results")).filter("run_id = 1").count() == 0


def test_queries_with_parameters(store, scored):
    store.save_runs(scored())
    df = history.run_query(store.spark, "SELECT run_id FROM {runs} WHERE health_score > :least", {"least": 70}, runs=store.runs())
    assert df.count() == 1
    with pytest.raises(ValueError):
        history.run_query(store.spark, "DROP TABLE x")


def test_one_run_is_read_from_its_batch(store, scored):
    store.save_runs(scored())
    store.save_runs(scored())
    commits = store.commits()
    for found in (store.results(2), store.latest_results()):
        assert {c.attempt for c in commits if any(c.attempt in f for f in found.inputFiles())} == {commits[1].attempt}
        assert {r.run_id for r in found.collect()} == {2}
    assert store.results(7).count() == 0


def many(spark, ids):
    rows = spark.createDataFrame([(i, 3, 72.5, FOUND) for i in ids],
                                 f"run_id bigint, total_rows bigint, health_score double, {RESULTS} array<{FINDING_TYPE}>")
    return rows.repartition(7)


def test_a_batch_of_many_runs_is_few_files_and_one_marker(spark, store):
    store.save_runs(many(spark, range(1, 401)))
    assert len(store.runs().inputFiles()) == 1 and len(store.results().inputFiles()) == 1
    assert [(c.first, c.last, c.tables) for c in store.commits()] == [(1, 400, ("runs", "results"))]
    assert store.results(17).count() == 3


def test_compaction(spark, store, scored):
    for ids in ([1, 2], [3], [10, 11]):
        store.save_runs(many(spark, ids))
    rows = sorted(map(str, store.runs().collect() + store.results().collect()))
    assert store.compact(least=3) == 1 and len(store.commits()) == 2
    assert sorted(map(str, store.runs().collect() + store.results().collect())) == rows
    store.save_runs(scored())
    assert store.compact() == 2 and store.next_run_id() == 13 and store.compact() == 0
    assert len(store.runs().inputFiles()) == 1 and store.runs().count() == 6
    store.delete_runs([2, 12])
    assert sorted(r.run_id for r in store.runs().collect()) == [1, 3, 10, 11] and store.results().count() == 12
    store.delete_runs([1, 3, 10, 11])
    assert store.runs().count() == 0 and store.results().count() == 0 and store.newest_run_id() is None


def test_a_stop_within_a_compaction_loses_and_doubles_nothing(spark, store, monkeypatch):
    for i in (1, 2, 3):
        store.save_runs(many(spark, [i]))
    monkeypatch.setattr(type(store), "_forget", lambda self, commits: 1 / 0)
    with pytest.raises(ZeroDivisionError):  # the new marker exists, the old ones still do
        store.compact()
    monkeypatch.undo()
    assert sorted(r.run_id for r in store.runs().collect()) == [1, 2, 3] and store.results().count() == 9
    assert store.remove_leftovers() == 0 and len(store._names(store.path("commits"))) == 1
    store._write(store.runs(), "runs", "f" * 32)
    assert store.remove_leftovers() == 1 and store.runs().count() == 3


def test_lineage_needs_an_output(spark):
    with pytest.raises(ValueError, match="output_path"):
        write_lineage_sidecar(spark.range(1), None)
    assert len(stamp()) == 15
