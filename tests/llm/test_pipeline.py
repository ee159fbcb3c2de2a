"""The corpus pipeline on the smallest supplied tables: each stage on what its predecessor kept, against brute force."""

import base64
import hashlib
import re
from pathlib import Path

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="supplied tables are absent")


@pytest.fixture(scope="module")
def kept(spark):
    """Rows before the first stage and after each."""
    from assaykit.session import stored

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER), name)
        out[name] = docs
    return out


def texts(rows):
    return {r.doc_id: r.text or "" for r in rows.collect()}


def test_stages_keep_the_columns_and_only_remove_rows(kept):
    names = ["documents", *(n for n, _ in corpus_pipeline.STAGES)]
    assert names[1:] == ["quality", "line_dedup", "ngram_join", "decontamination", "bpe"]
    for before, after in zip(names[:-1], names[1:-1]):
        assert kept[after].dtypes == kept["documents"].dtypes
        assert set(texts(kept[after])) <= set(texts(kept[before]))
    assert {r.doc_id for r in kept["bpe"].collect()} == set(texts(kept["decontamination"]))


def test_quality_follows_the_labels(spark, kept):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect() if r.quality is not None}
    left = set(texts(kept["quality"]))
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in left for i in good) >= 0.9 * len(good)


def test_line_dedup_only_removes_text(kept):
    before, after = texts(kept["quality"]), texts(kept["line_dedup"])
    for i, text in after.items():
        lines = iter(before[i].split("\n"))
        assert all(any(line == other for other in lines) for line in text.split("\n"))


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_one_document_of_each_group_stays(kept):
    sets = {i: shingles(t) for i, t in texts(kept["line_dedup"]).items()}
    group = {i: i for i in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i
    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((root(i), root(j)))
                group[high] = low
    assert set(texts(kept["ngram_join"])) == {root(i) for i in sets}


def test_no_benchmark_passage_stays(spark, kept):
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect() if r.text]
    before, after = texts(kept["ngram_join"]), texts(kept["decontamination"])
    holding = {i for i, t in before.items() if any(x in t for x in items)}
    assert holding and not holding & set(after)


def test_ids_are_those_of_the_library(kept):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    given = texts(kept["decontamination"])
    for r in kept["bpe"].collect():
        ids = library.encode_ordinary(given[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(given[r.doc_id].encode()).hexdigest()


def test_tables_of_an_earlier_operator_are_dropped_by_the_worker(spark):
    """Spark gives the same worker processes to the next operator; one that does not keep tables frees those it finds."""
    import pyarrow as pa

    from assaykit.llm.common import importable, mapped

    importable(spark)

    def fill(part):
        from assaykit.llm import common
        common.LOADED["tables"] = "x"
        return pa.RecordBatch.from_arrays([pa.array([len(common.LOADED)] * part.num_rows)], names=["n"])

    def look(part):
        from assaykit.llm import common
        return pa.RecordBatch.from_arrays([pa.array([len(common.LOADED)] * part.num_rows)], names=["n"])

    rows = spark.range(8).repartition(4).selectExpr("cast(id as string) AS text")
    assert {r.n for r in mapped(rows, fill, "n long", keeps=True).collect()} == {1}
    assert {r.n for r in mapped(rows, look, "n long").collect()} == {0}
