"""Added spans of personal data: found where planted, equal for equal texts, and none in clean texts."""

import hashlib
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.llm import pii

WORDS = "alpha beta gamma delta epsilon zeta theta iota kappa lambda sigma tau omega".split()


def planted(seed, n=260):
    """(id, text, spans that must be added) with planted data, lookalikes and clean texts."""
    random, rows = np.random.default_rng(seed), []
    for i in range(n):
        prose = lambda k: " ".join(random.choice(WORDS, k))
        token = hashlib.sha1(f"{seed}-{i}".encode()).hexdigest()
        kind, value = [
            ("maybe_secret", token), ("maybe_email", f"{random.choice(WORDS)}.{i} at example dot com"),
            ("maybe_id", f"{random.integers(100, 600)}-{random.integers(10, 99)}-{random.integers(1000, 9999)}"),
            ("", f"item {random.integers(10, 99)}-{random.integers(1000, 9999)}"), ("", f"met at {random.choice(WORDS)}.{random.choice(WORDS)}"),
            ("", f"commit {token}"), ("", "")][i % 7]
        before = prose(12) + (' token = "' if kind == "maybe_secret" else " ")
        text = f"{before}{value}{chr(34) if kind == 'maybe_secret' else ''} {prose(9)}"
        rows.append((i, text, [(kind, len(before), len(before) + len(value))] if kind else []))
    return rows


@pytest.fixture(scope="module")
def rows():
    return planted(1)


@pytest.fixture(scope="module")
def model(spark, rows):
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return pii.fitted(docs, pii.MOST, pii.PRECISION)


def added(spark, rows, model):
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return {(r.doc_id, a.kind, a.start, a.end) for r in pii.spans_of(docs, *model).collect() for a in r.added}


def test_held_out_planted_spans_are_added_and_lookalikes_are_not(spark, model):
    unseen = planted(2, 140)
    wanted = {(i, *s) for i, _, spans in unseen for s in spans}
    found = added(spark, unseen, model)
    assert len(found & wanted) >= 0.9 * len(wanted) and len(found & wanted) >= 0.9 * len(found), (sorted(wanted - found)[:5], sorted(found - wanted)[:5], model[1])
    assert {k for _, k, *_ in found & wanted} == {"maybe_secret", "maybe_email", "maybe_id"}


def test_equal_texts_get_equal_spans_in_any_table(spark, rows, model):
    few = rows[:20]
    assert added(spark, few, model) == {s for s in added(spark, rows, model) if s[0] < 20}


def test_base_columns_do_not_depend_on_the_model(spark, rows):
    texts = [t + " x.y@mail.example.com 10.20.30.400 10.20.30.40 +1 (555) 123-4567 ; 4111 1111 1111 1111" for i, t, _ in rows if i % 7 in (1, 2, 3, 4, 6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in pii.digest(pii.find(docs)).collect()}
    for i, text in enumerate(texts):
        at = text.index(" x.y@") + 1
        spans = [("email", at, at + 20), ("ip", at + 34, at + 45), ("phone", at + 46, at + 63), ("card", at + 66, at + 85)]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: s[1]))
        r = found[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()


def test_awkward_tables(spark):
    schema = "doc_id long, text string, base string, added int, kind string"
    assert pii.find(spark.createDataFrame([], schema)).collect() == []
    odd = [(None, None, "b", 1, "k"), (1, "", "b", 1, "k"), (2, "a@b.cd", "b", 1, "k"), (2, "a@b.cd", "b", 1, "k"), (3, "x" * 40_000, "b", 1, "k")]
    found = pii.digest(pii.find(spark.createDataFrame(odd, schema))).select("doc_id", "n_email", "spans").collect()
    assert sorted(map(tuple, found), key=str) == sorted(
        [(None, 0, ""), (1, 0, ""), (2, 1, "email:0:6"), (2, 1, "email:0:6"), (3, 0, "")], key=str)


def test_redaction_replaces_base_and_added_spans(spark, rows):
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    for i, text, spans in rows:
        if spans and spans[0][0] == "maybe_secret":
            _, a, b = spans[0]
            assert clean[i] == f"{text[:a]}[maybe_secret]{text[b:]}"


def test_thresholds_are_isotonic():
    row = lambda step, good, n: SimpleNamespace(kind="maybe_id", step=step, good=good, n=n)
    assert pii.thresholds([row(10, 0, 5), row(50, 9, 10), row(70, 8, 10), row(90, 10, 10)], 0.9)["maybe_id"] == 0.9
    assert pii.thresholds([row(10, 0, 5), row(50, 9, 10), row(70, 9, 10), row(90, 10, 10)], 0.9)["maybe_id"] == 0.5
    assert pii.thresholds([row(10, 5, 5), row(90, 0, 50)], 0.9)["maybe_id"] == 2.0 and pii.thresholds([], 0.9)["maybe_id"] == 2.0


@pytest.mark.parametrize("text, right", [("GB82 WEST 1234 5698 7654 32", True), ("GB82 WEST 1234 5698 7654 33", False), ("DE89370400440532013000", True)])
def test_account_numbers(spark, text, right):
    assert spark.range(1).select(pii.account_number(F.lit(text)).alias("x")).first().x is right
