"""Ranked lexical search over a length-stratified index.

Documents are grouped by their length normaliser m. All documents of a stratum share it, so the impact of a term there
depends on its frequency alone: postings of a term are grouped by frequency and an impact is worked out once per
frequency. The largest frequency of each term bounds the score that an item can reach in a stratum; strata are visited by
falling bound and left out where the bound is below the tenth best score so far. That never loses a result.

``build`` writes the index of all documents as Parquet, ``search`` ranks them for each item:

* A term is a maximal run of digits, letters and characters beyond ASCII, with only A to Z lower-cased. n is the number of a
  document's terms, N of documents with any, L of all terms, df of documents holding a term, tf of its occurrences.
* m = 25 + (75 * n * N) div L, weight w = floor(1000 * ln((2 N + 2) / (2 df + 1))), score = sum over the item's terms, repeats
  included, of w * ((1000000000 * tf) div (1000 * tf + 8 * m)).

Rows of the index are blocks of one stratum with about ``POSTINGS`` postings, so a stratum that holds most documents is
many rows. Strata with more than a ten-thousandth of all terms (at most ten thousand of them) are salted before they
are shuffled. Items are the stated query set: they are read in blocks of at most ``PAIRS`` pairs of item and term (one larger item
is a block of its own), and a block goes to all tasks. Each task keeps ten documents an item.

Terms are kept as 64-bit hashes; two different ones coincide with probability 2^-64 a pair. Null and empty texts have no
terms and no rank. Each row of documents is a document and each row of items an item, also if it is a copy: copies of
an item each get the whole ranking. A null doc_id stays null and precedes the others among equal scores (as would the least long,
which is returned as null). Other columns are left out. An empty table or an item without a hit gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaykit.llm.common import NO_ID, flat, importable, mapped, slices, texts
from assaykit.session import stored

BEST = 10
#: Postings of a block of the index, pairs of item and term that go to the tasks at once, blocks ranked together (in postings).
POSTINGS, PAIRS, TOGETHER = 1 << 20, 1 << 18, 1 << 22
#: A stratum with more than this share of all terms is salted.
SHARE = 10_000
SALTS = 64
#: Bytes as terms have them: what parts terms is a space.
FOLDED = np.array([c if chr(c).isalnum() or c > 127 else 32 for c in range(128)] + list(range(128, 256)), np.uint8)
FOLDED[65:91] += 32

INDEX = ("m long, size int, docs binary, terms binary, term_ends binary, group_tfs binary, group_ends binary, places binary")


def terms_of(column: pa.Array) -> tuple[np.ndarray, pa.StringArray, np.ndarray]:
    """Document and term code of each occurrence in order, and the different terms."""
    column = flat(column)
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1).astype(np.int64)
    raw = FOLDED[np.frombuffer(column.buffers()[2] or b"", np.uint8)[:ends[-1]]]
    inside = raw != 32
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    borders = ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < len(raw))]  # a term ends where a text ends
    begins[borders] = inside[borders]
    stops[borders - 1] = inside[borders - 1]
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(stops) + 1 - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw[inside].tobytes()))
    encoded = words.dictionary_encode()
    return (np.searchsorted(ends, starts, side="right") - 1, encoded.dictionary,
            encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64))


def vectors_of(column: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each text: number of terms, hashes of the different terms, their frequencies."""
    doc, words, codes = terms_of(column)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words)).view(np.int64)
    keys, counts = np.unique(doc * max(1, len(words)) + codes, return_counts=True)
    which, terms = keys // max(1, len(words)), hashes[keys % max(1, len(words))] if len(words) else np.zeros(0, np.int64)
    bounds = np.searchsorted(which, np.arange(len(column) + 1))
    sizes = np.bincount(doc, minlength=len(column))
    return [(int(n), terms[a:b], counts[a:b].astype(np.int32)) for n, a, b in zip(sizes, bounds[:-1], bounds[1:])]


def lengths(docs: DataFrame) -> DataFrame:
    """n and the number of documents that have it."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        doc, _, _ = terms_of(batch.column("text"))
        n, counts = np.unique(np.bincount(doc, minlength=batch.num_rows), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(n.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["n", "docs"])
    return mapped(docs, work, "n long, docs long").where("n > 0").groupBy("n").agg(F.sum("docs").alias("docs"))


def build(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the index of every document below ``path``, with N and L beside it."""
    spark = docs.sparkSession
    docs = texts(docs, id_col, text_col).withColumn("spread", F.xxhash64("doc_id", "text"))
    counted = stored(lengths(docs), "lengths")
    total = counted.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n_docs"),
                        F.coalesce(F.sum(F.col("docs") * F.col("n")), F.lit(0)).alias("n_terms"))
    total.write.parquet(f"{path}/totals")
    n_docs, n_terms = spark.read.parquet(f"{path}/totals").first()
    m = F.expr(f"25L + (cast(75 as decimal(38,0)) * n * {n_docs}L) div {max(1, n_terms)}L")
    least = max(POSTINGS, n_terms // SHARE)
    large = {row.m: -(-row.size // least) for row in
             counted.groupBy(m.alias("m")).agg(F.sum(F.col("n") * F.col("docs")).alias("size"))
             .where(F.col("size") > least).collect()}  # at most SHARE rows, as each has more than 1 / SHARE of all terms

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        for doc_id, spread, (n, terms, tfs) in zip(batch.column("doc_id").to_pylist(), batch.column("spread").to_pylist(),
                                                  vectors_of(batch.column("text"))):
            if n:
                stratum = 25 + 75 * n * n_docs // n_terms
                out.append((stratum, spread % large.get(stratum, 1), doc_id, terms.tobytes(), tfs.tobytes()))
        if not out:
            return None
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)],
                                          names=["m", "salt", "doc_id", "terms", "tfs"])

    rows = mapped(docs, work, "m long, salt long, doc_id long, terms binary, tfs binary")
    rows.repartition("m", "salt").sortWithinPartitions("m", "doc_id").mapInArrow(blocks, INDEX).write.option(
        "compression", "zstd").parquet(f"{path}/blocks")


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the index from documents that come in the order of their strata."""
    held: list[tuple] = []
    size, stratum = 0, None

    def closed() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([block(stratum, held)], schema=pa.schema(
            [("m", pa.int64()), ("size", pa.int32())] + [(c.split()[0], pa.binary()) for c in INDEX.split(", ")[2:]]))

    for part in slices(batches, "terms"):
        for m, doc_id, terms, tfs in zip(*(part.column(c).to_pylist() for c in ("m", "doc_id", "terms", "tfs"))):
            if held and (m != stratum or size + len(terms) // 8 > POSTINGS):
                yield closed()
                held, size = [], 0
            held.append((doc_id, terms, tfs))
            size, stratum = size + len(terms) // 8, m
    if held:
        yield closed()


def block(m: int, docs: list[tuple[int | None, bytes, bytes]]) -> dict:
    """Postings by term and frequency: ends of each term's groups, frequency and end of each group, places of documents."""
    terms = np.frombuffer(b"".join(t for _, t, _ in docs), np.int64)
    tfs = np.frombuffer(b"".join(f for _, _, f in docs), np.int32)
    places = np.repeat(np.arange(len(docs), dtype=np.int32), [len(t) // 8 for _, t, _ in docs])
    order = np.lexsort((places, tfs, terms))
    terms, tfs, places = terms[order], tfs[order], places[order]
    last = np.append((terms[1:] != terms[:-1]) | (tfs[1:] != tfs[:-1]), True)
    group_ends = np.flatnonzero(last)
    of_group = terms[group_ends]
    term_ends = np.flatnonzero(np.append(of_group[1:] != of_group[:-1], True))
    return {"m": m, "size": len(docs), "docs": np.array([NO_ID if i is None else i for i, _, _ in docs], np.int64).tobytes(),
            "terms": of_group[term_ends].tobytes(), "term_ends": (term_ends + 1).astype(np.int32).tobytes(),
            "group_tfs": tfs[group_ends].tobytes(), "group_ends": (group_ends + 1).astype(np.int32).tobytes(),
            "places": places.tobytes()}


class Items:
    """A block of items: for each pair of item and term the number of the term and how often it occurs."""

    def __init__(self, rows: list):
        self.ids, self.copies = [r.item_id for r in rows], [r.copies for r in rows]
        sizes = [len(r.terms) // 8 for r in rows]
        every = np.concatenate([np.frombuffer(r.terms, np.int64) for r in rows])
        self.terms, self.term = np.unique(every, return_inverse=True)
        self.times = np.concatenate([np.frombuffer(r.tfs, np.int32) for r in rows]).astype(np.int64)
        self.begins = np.concatenate([[0], np.cumsum(sizes)])
        self.weights = np.zeros(len(every), np.int64)

    def weigh(self, df: dict[int, int], n_docs: int) -> None:
        w = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) if t in df else 0
                      for t in self.terms.tolist()], np.int64)
        self.weights = self.times * w[self.term]

    def found_in(self, terms: np.ndarray) -> np.ndarray:
        """Place of each term of the block among ``terms``, -1 where it is not."""
        if not len(terms):
            return np.full(len(self.terms), -1)
        at = np.minimum(np.searchsorted(terms, self.terms), len(terms) - 1)
        return np.where(terms[at] == self.terms, at, -1)


def item_rows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Different items with the number of their copies, their terms and how often each occurs."""
    importable(items.sparkSession)
    kind = items.schema[id_col].dataType.simpleString()
    rows = (items.select(F.col(id_col).alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
            .groupBy("item_id", "text").agg(F.count("*").alias("copies")))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = vectors_of(batch.column("text"))
        return pa.RecordBatch.from_arrays(
            [batch.column("item_id"), batch.column("copies"), pa.array([t.tobytes() for _, t, _ in found], pa.binary()),
             pa.array([f.tobytes() for _, _, f in found], pa.binary())], names=["item_id", "copies", "terms", "tfs"])
    return mapped(rows, work, f"item_id {kind}, copies long, terms binary, tfs binary").where(F.length("terms") > 0)


def document_counts(index: DataFrame, items: Items) -> dict[int, int]:
    """df of each term of the items that occurs; as many rows as the block has terms at most."""
    wanted = items.terms

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.int64)
        for part in slices(batches, "terms"):
            for terms, term_ends, group_ends in zip(*(part.column(c).to_pylist() for c in ("terms", "term_ends", "group_ends"))):
                at = items.found_in(np.frombuffer(terms, np.int64))
                ends = np.concatenate([[0], np.frombuffer(group_ends, np.int32)[np.frombuffer(term_ends, np.int32) - 1]])
                total += np.where(at >= 0, ends[at + 1] - ends[at], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(wanted[some]), pa.array(total[some])], names=["term", "df"])
    counts = index.select("terms", "term_ends", "group_ends").mapInArrow(work, "term long, df long")
    return {r.term: r.df for r in counts.groupBy("term").agg(F.sum("df").alias("df")).collect()}


class Stratum:
    """One block of the index as the items of a block of items see it."""

    def __init__(self, row: dict, items: Items):
        self.docs = np.frombuffer(row["docs"], np.int64)
        at = items.found_in(np.frombuffer(row["terms"], np.int64))
        term_ends = np.concatenate([[0], np.frombuffer(row["term_ends"], np.int32)])
        self.group_ends = np.concatenate([[0], np.frombuffer(row["group_ends"], np.int32)])
        self.places = np.frombuffer(row["places"], np.int32)
        tfs, of = np.unique(np.frombuffer(row["group_tfs"], np.int32).astype(np.int64), return_inverse=True)
        self.impacts = ((1_000_000_000 * tfs) // (1000 * tfs + 8 * row["m"]))[of]  # once per frequency
        self.first = np.where(at >= 0, term_ends[at], 0)
        self.last = np.where(at >= 0, term_ends[at + 1], 0)
        best = np.where(at >= 0, self.impacts[np.maximum(self.last - 1, 0)], 0)  # groups are by rising frequency
        self.bounds = np.add.reduceat(items.weights * best[items.term], items.begins[:-1])

    def scores(self, items: Items, item: int) -> np.ndarray:
        pairs = slice(items.begins[item], items.begins[item + 1])
        first, last = self.first[items.term[pairs]], self.last[items.term[pairs]]
        there = (last > first) & (items.weights[pairs] > 0)
        weights, first, last = items.weights[pairs][there], first[there], last[there]
        total = np.zeros(len(self.docs), np.int64)
        if not len(weights):
            return total
        groups = np.concatenate([np.arange(a, b) for a, b in zip(first, last)])
        values = np.repeat(weights, last - first) * self.impacts[groups]
        values = np.repeat(values, self.group_ends[groups + 1] - self.group_ends[groups])
        places = np.concatenate([self.places[a:b] for a, b in zip(self.group_ends[first], self.group_ends[last])])
        if self.bounds[item] < 1 << 53:  # sums of doubles are exact
            return np.bincount(places, values, len(total)).astype(np.int64)
        np.add.at(total, places, values)
        return total


def visit(strata: list[Stratum], items: Items, best: list[tuple[np.ndarray, np.ndarray]], most: int) -> None:
    """Improve each item's best documents, by falling bound of the strata until none can reach them."""
    bounds = np.stack([s.bounds for s in strata])
    for item in range(len(items.ids)):
        docs, scores = best[item]
        for k in np.argsort(-bounds[:, item], kind="stable"):
            least = scores[-1] if len(scores) == most else 1
            if bounds[k, item] < least:
                break
            found = strata[k].scores(items, item)
            some = np.flatnonzero(found >= least)
            docs, scores = np.concatenate([docs, strata[k].docs[some]]), np.concatenate([scores, found[some]])
            order = np.lexsort((docs, -scores))[:most]
            docs, scores = docs[order], scores[order]
        best[item] = docs, scores


def ranked(index: DataFrame, items: Items, begin: int, kind: str, most: int) -> DataFrame:
    """The best documents of each task for a block of items."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in items.ids]
        held, size = [], 0
        for part in slices(batches, "places"):
            for row in part.to_pylist():
                held.append(Stratum(row, items))
                size += len(row["places"]) // 4 + len(items.begins) + 2 * len(items.terms)
                if size > TOGETHER:
                    visit(held, items, best, most)
                    held, size = [], 0
        if held:
            visit(held, items, best, most)
        sizes = [len(d) for d, _ in best]
        if sum(sizes):
            which = np.repeat(np.arange(len(sizes)), sizes)
            docs = np.concatenate([d for d, _ in best])
            yield pa.RecordBatch.from_arrays(
                [pa.array(which + begin), pa.array([items.ids[i] for i in which], names.field("item_id").type),
                 pa.array(np.array(items.copies, np.int64)[which]),
                 pa.array(np.full(len(docs), TaskContext.get().partitionId() % SALTS, np.int32)),
                 pa.array(docs, mask=docs == NO_ID), pa.array(np.concatenate([s for _, s in best]))], schema=names)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = f"item long, item_id {kind}, copies long, salt int, doc_id long, score long"
    names = to_arrow_schema(index.sparkSession.createDataFrame([], schema).schema)
    return index.mapInArrow(work, schema)


def search(spark: SparkSession, path: str, items: DataFrame, most: int = BEST, id_col: str = "item_id",
           text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score of the ``most`` best documents of each item, equal scores by ascending doc_id."""
    index = spark.read.schema(INDEX).parquet(f"{path}/blocks")
    n_docs = spark.read.parquet(f"{path}/totals").first().n_docs
    kind = items.schema[id_col].dataType.simpleString()
    found = spark.createDataFrame([], f"item long, item_id {kind}, copies long, salt int, doc_id long, score long")
    begin = 0
    for rows in in_blocks(stored(item_rows(items, id_col, text_col), "items")):
        block_of_items = Items(rows)
        block_of_items.weigh(document_counts(index, block_of_items), n_docs)
        found = found.unionByName(ranked(index, block_of_items, begin, kind, most))
        begin += len(rows)
    by = [F.desc("score"), F.asc("doc_id")]
    for keys in (["item", "salt"], ["item"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col("rank") <= most)
    copies = F.explode(F.sequence(F.lit(1).cast("long"), "copies"))
    return found.select("item_id", "rank", "doc_id", "score", copies.alias("copy")).drop("copy")


def in_blocks(rows: DataFrame) -> Iterator[list]:
    held, size = [], 0
    for row in rows.toLocalIterator():
        if held and size + len(row.terms) // 8 > PAIRS:
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row.terms) // 8
    if held:
        yield held
