"""Removes runs of lines that stand earlier in the corpus: winnowing over line hashes.

The lines of a text are hashed; blank ones do not count. A window is a shortest run of lines with at least ``min_words``
words from some line on, or up to some line. Of each window the line of least hash is its fingerprint. A run of
``min_words`` words that two places share contains the same windows at both, so both select the same fingerprints: a line
hash selected at one place only proves that no repeated run passes there.

Fingerprints of at least two places are kept. From them matches are extended both ways: every window around a kept
fingerprint, forward and backward, is compared by its hash with all others, and the first place of each content (smallest
doc_id, null first, then text_key, then position) is where it stays. The windows of a repeated run cover it to its last line on
both sides, so all its lines go wherever they stand later, however many copies there are, without a row per pair of copies.

A window that overlaps its own first place does not count as later. Documents that repeat both id and text are one document,
whose lines do not repeat themselves. Null and empty texts, and texts of fewer words, stay as they are. A line is compared
without white space around it; words are runs of characters other than white space.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.llm.common import NO_ID, mapped, mix, text_key, texts
from assaykit.session import stored

MIN_WORDS = 50


def line_numbers(text: str) -> tuple[list[str], list[int]]:
    """Lines, and the numbers of those that are not blank."""
    lines = text.split("\n")
    return lines, [i for i, x in enumerate(lines) if x and not x.isspace()]


def lines(docs: DataFrame) -> DataFrame:
    """key, text_key, hashes and words of the lines of each text."""
    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        hashes, words, counts = [], [], [0]
        for text in part.column("text").to_pylist():
            every, full = line_numbers(text)
            hashes.extend(xxhash.xxh3_64_intdigest(every[i].strip()) for i in full)
            words.extend(len(every[i].split()) for i in full)
            counts.append(len(hashes))
        ends = np.array(counts, np.int32)
        return pa.RecordBatch.from_arrays(
            [part.column("key"), part.column("text_key"),
             pa.ListArray.from_arrays(ends, pa.array(np.array(hashes, np.uint64).view(np.int64))),
             pa.ListArray.from_arrays(ends, pa.array(words, pa.int32()))], names=["key", "text_key", "hashes", "words"])
    return mapped(docs, work, "key long, text_key long, hashes array<long>, words array<int>")


def windows(hashes: np.ndarray, words: np.ndarray, min_words: int) -> list[tuple[int, int, int]]:
    """First line, last line and fingerprint of each shortest run of enough words, forward and backward."""
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    n = len(hashes)
    if total[-1] < min_words:
        return []
    last = np.searchsorted(total, total[:-1] + min_words) - 1  # of the window that begins with each line
    first = np.searchsorted(total, total[1:] - min_words, side="right") - 1  # of the one that ends with it
    runs = {(i, int(e)) for i, e in enumerate(last) if e < n} | {(int(b), i) for i, b in enumerate(first) if b >= 0}
    unsigned = hashes.view(np.uint64)
    return [(b, e, int(hashes[b + int(np.argmin(unsigned[b:e + 1]))])) for b, e in sorted(runs)]


def fingerprints(held: DataFrame, min_words: int) -> DataFrame:
    """The selected line hashes, once for each line that a window selects."""
    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for hashes, words in zip(part.column("hashes"), part.column("words")):
            h = hashes.values.to_numpy()
            chosen = {b + int(np.argmin(h.view(np.uint64)[b:e + 1])) for b, e, _ in windows(h, words.values.to_numpy(), min_words)}
            out.extend(h[list(chosen)].tolist())
        return pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["fingerprint"])
    return mapped(held.select("hashes", "words"), work, "fingerprint long", by="hashes")


def extended(held: DataFrame, min_words: int) -> DataFrame:
    """Hash and place of each window whose fingerprint is kept. Takes lines with the kept hashes of their text."""
    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = [[], [], [], [], []]
        for key, of, hashes, words, kept in zip(*(part.column(c) for c in ("key", "text_key", "hashes", "words", "kept"))):
            h, known = hashes.values.to_numpy(), set(kept.as_py())
            for b, e, chosen in windows(h, words.values.to_numpy(), min_words):
                if chosen in known:
                    content = mix(np.array([e - b], np.uint64))
                    for x in h[b:e + 1].view(np.uint64):
                        content = mix(content * np.uint64(0x9E3779B97F4A7C15) + x)
                    for column, value in zip(rows, (int(content.view(np.int64)[0]), key.as_py(), of.as_py(), b, e)):
                        column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, [pa.int64()] * 3 + [pa.int32()] * 2)],
                                          names=["content", "key", "text_key", "begin", "end"])
    return mapped(held, work, "content long, key long, text_key long, begin int, end int", by="hashes")


def repeated(docs: DataFrame, min_words: int) -> DataFrame:
    """key, text_key and runs (first and last line, counted without blank lines) that stand earlier."""
    held = stored(lines(docs), "lines")
    twice = (fingerprints(held, min_words).groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1")
             .select("fingerprint"))
    at = held.select("key", "text_key", F.explode(F.array_distinct("hashes")).alias("fingerprint"))
    kept = (at.join(twice, "fingerprint", "left_semi").groupBy("key", "text_key")
            .agg(F.collect_set("fingerprint").alias("kept")))  # at most the lines of one text
    places = stored(extended(held.join(kept, ["key", "text_key"]), min_words), "places")
    firsts = (places.groupBy("content")
              .agg(F.min(F.struct("key", "text_key", "begin", "end")).alias("first"), F.count("*").alias("n")).where("n > 1"))
    elsewhere = "key <> first.key or text_key <> first.text_key or begin > first.end"
    return (places.join(firsts, "content").where(elsewhere).groupBy("key", "text_key")
            .agg(F.collect_set(F.struct("begin", "end")).alias("runs")))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns, the text without repeated runs, and removed_lines and n_lines (those that are not blank).

    Blank lines within a removed run go with it; other blank lines stay. Columns of the input that are named like the added
    ones, in whatever case, are replaced by them.
    """
    docs = docs.select(*(docs[c] for c in docs.columns if c.lower() not in ("removed_lines", "n_lines")))
    given = texts(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("key"),
                                                 text_key("text").alias("text_key"), "text")
    runs = repeated(given, min_words).toDF("_runs_key", "_runs_text", "_runs")
    same = ((F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)) == runs["_runs_key"])
            & (text_key(docs[text_col]) == runs["_runs_text"]))
    marked = docs.join(runs, same, "left").drop("_runs_key", "_runs_text")
    names = list(docs.columns)

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        new, removed, counts = [], [], []
        for text, found in zip(part.column(text_col).to_pylist(), part.column("_runs").to_pylist()):
            every, full = line_numbers(text or "")
            lost = {i for run in found or () for i in range(run["begin"], run["end"] + 1)}
            gone = {full[i] for i in lost} | {x for i in lost if i + 1 in lost for x in range(full[i] + 1, full[i + 1])}
            new.append("\n".join(x for i, x in enumerate(every) if i not in gone) if gone else text)
            removed.append(len(lost))
            counts.append(len(full))
        columns = [part.column(c) if c != text_col else pa.array(new, pa.string()) for c in names]
        return pa.RecordBatch.from_arrays([*columns, pa.array(removed, pa.int64()), pa.array(counts, pa.int64())],
                                          names=[*names, "removed_lines", "n_lines"])

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]).add("removed_lines", "long").add("n_lines", "long")
    return mapped(marked, work, schema, by=text_col)
