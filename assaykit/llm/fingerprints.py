"""Merkle trees over the sections, paragraphs and pieces of whole texts.

A paragraph is a line with its line break. A section ends with a blank paragraph, or with one whose hash is divisible by
four. A paragraph is cut into pieces after spaces and other bytes that the eight bytes before them select, and wherever a
piece would become too long, on borders of code points. Pieces are small where a paragraph begins and larger further on
(``RULES``), so that short paragraphs have several. An edit moves later cuts up to the next selected one. Hashes of pieces make that of the paragraph, those of paragraphs that of the
section, and those of sections the root, which is equal for equal texts only (128 bits).

A fingerprint is written as ``root:section;section``, a section as ``hash=paragraph/paragraph``, a paragraph as
``piece,piece`` and a piece as ``hash.bytes``. Equal branches are skipped, differing ones locate edits.

Null texts are empty ones and have a tree without sections. Ties of doc_id are ordered by text, a null doc_id comes first,
repeated rows follow each other, a single document is its own next one, and other columns are left out.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import in_ranges, partitions, slices, texts

SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


#: From which byte of a paragraph on, how long pieces are at most, and one of how many spaces and of how many bytes ends one.
RULES = ((0, 8, 4, 32), (64, 32, 4, 32), (256, 128, 8, 128), (1024, 256, 16, 256))
_FROM = [r[0] for r in RULES]


def cuts(raw: bytes) -> np.ndarray:
    """Where pieces end."""
    b = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(b == 10) + 1
    paragraphs = np.unique(np.concatenate([ends, [len(raw)]]))
    at = np.arange(8, len(raw))
    at = at[b[at] & 0xC0 != 0x80]
    begins = np.concatenate([[0], paragraphs])[np.searchsorted(paragraphs, at, side="left")]
    rule = np.array(RULES)[np.searchsorted(_FROM, at - begins, side="right") - 1]
    space = b[at - 1] == 32
    before = np.lib.stride_tricks.sliding_window_view(b, 8)[at - 8 - (space & (at > 8))] if len(at) else np.zeros((0, 8), np.uint8)
    hashed = (np.ascontiguousarray(before).view(np.uint64).ravel() * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
    chosen = at[hashed % np.where(space, rule[:, 2], rule[:, 3]).astype(np.uint64) == 0]
    wanted, last = set(paragraphs.tolist()), 0
    begin, out = 0, [x for x in (1, 2, 4) if x < len(raw) and b[x] & 0xC0 != 0x80 and x not in wanted]  # tiny texts too
    for end in np.union1d(paragraphs, chosen).tolist():
        while True:
            most = RULES[bisect_right(_FROM, last - begin) - 1][1]
            if end - last <= most:
                break
            last += most
            while raw[last] & 0xC0 == 0x80:
                last -= 1
            out.append(last)
        if end in wanted:
            begin = end
        elif 16 * (end - last) < most:  # repetitive text would be cut everywhere
            continue
        out.append(end)
        last = end
    return np.unique(np.array(out, np.int64))


def tree(raw: bytes) -> tuple[str, np.ndarray, np.ndarray]:
    """Fingerprint of a text, and the hashes and bytes of its pieces."""
    hashes, sizes, sections, section, paragraph, pieces, paragraphs = [], [], [], [], [], [], []
    root = xxhash.xxh3_128()
    begin = 0
    for end in cuts(raw).tolist() if raw else []:
        piece = raw[begin:end]
        digest = xxhash.xxh3_128_digest(piece)
        hashes.append(int.from_bytes(digest[:4], "big"))
        sizes.append(end - begin)
        pieces.append(f"{digest[:4].hex()}.{end - begin}")
        paragraph.append(digest)
        if raw[end - 1] == 10 or end == len(raw):
            digest = xxhash.xxh3_128_digest(b"".join(paragraph))
            section.append(digest)
            paragraphs.append(",".join(pieces))
            pieces, paragraph = [], []
            if digest[-1] % 4 == 0 or piece == b"\n" or end == len(raw):
                digest = xxhash.xxh3_128_digest(b"".join(section))
                root.update(digest)
                sections.append(f"{digest[:4].hex()}={'/'.join(paragraphs)}")
                paragraphs, section = [], []
        begin = end
    return f"{root.hexdigest()}:{';'.join(sections)}", np.array(hashes, np.uint64), np.array(sizes, np.int64)


def leaves(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and bytes of the pieces that a fingerprint names, in order."""
    branches = fingerprint.split(":", 1)[1]
    named = [x.split(".") for s in branches.split(";") if s for p in s.split("=", 1)[1].split("/") for x in p.split(",")]
    return np.array([int(h, 16) for h, _ in named], np.uint64), np.array([int(n) for _, n in named], np.int64)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Share of bytes in common pieces, each counted as often as both have it; 1 for two empty texts."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 1.0
    (x, m), (y, n) = (np.unique(h << np.uint64(32) | s.astype(np.uint64), return_counts=True) for h, s in (a, b))
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return float(2 * ((both & np.uint64(0xFFFFFFFF)).astype(np.int64) * np.minimum(m[i], n[j])).sum() / total)


def differences(a: str, b: str) -> list[tuple[int, int]]:
    """Byte ranges of the second text in pieces that the first has not got; equal roots and sections are not entered."""
    if a.split(":", 1)[0] == b.split(":", 1)[0]:
        return []
    known = set(a.split(":", 1)[1].split(";"))
    pieces = {x for s in known if s for p in s.split("=", 1)[1].split("/") for x in p.split(",")}
    found, begin = [], 0
    for section in filter(None, b.split(":", 1)[1].split(";")):
        for x in (x for p in section.split("=", 1)[1].split("/") for x in p.split(",")):
            end = begin + int(x.split(".")[1])
            if section not in known and x not in pieces:
                if found and found[-1][1] == begin:
                    found[-1] = (found[-1][0], end)
                else:
                    found.append((begin, end))
            begin = end
    return found


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how like they are to each other and to the next's.

    Texts are shuffled once, into ranges of ids. Each range also gets a copy of the first row of the next one, so that a
    task holds two texts at a time and meets each document's next one.
    """
    docs = texts(docs, id_col, text_col)
    count = partitions(docs.sparkSession)
    ranged = in_ranges(docs, count)
    least = sorted(ranged.groupBy("place").agg(F.min("key").alias("key")).collect())  # one row a range
    before = [(least[i - 1].place, x.key) for i, x in enumerate(least)]
    heads = (ranged.select("key", "text")
             .join(F.broadcast(docs.sparkSession.createDataFrame(before, "place int, key long")), "key")
             .groupBy("place", "key").agg(F.min("text").alias("text")))
    rows = (ranged.select("place", F.lit(0).alias("extra"), "key", "doc_id", "text")
            .unionByName(heads.select("place", F.lit(1).alias("extra"), "key", F.lit(None).cast("long").alias("doc_id"),
                                      "text"))
            .repartitionById(count, F.col("place")).sortWithinPartitions("place", "extra", "key", "text"))
    return rows.select("place", "extra", "doc_id", "text").mapInArrow(follow, SCHEMA)


def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = None
    for part in slices(batches, "text"):
        out = []
        for place, extra, doc_id, text in zip(*(part.column(x).to_pylist() for x in ("place", "extra", "doc_id", "text"))):
            now = tree(text.encode())
            if last is not None:
                out.append(row(*last, text, now))
            last = None if extra else (doc_id, text, now)
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(),
                                                           pa.float64(), pa.float64()))],
                names=[c.split()[0] for c in SCHEMA.split(", ")])


def row(doc_id: int | None, text: str, own: tuple, following: str, after: tuple) -> tuple:
    raw = edited(text, following).encode()
    changed = tree(raw)
    return (doc_id, len(text), hashlib.sha256(raw).hexdigest(), own[0], changed[0],
            likeness(own[1:], changed[1:]), likeness(own[1:], after[1:]))
