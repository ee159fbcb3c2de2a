"""Finds passages of benchmark items in whole texts: CGK embedding, bit-sampling LSH, exact edit distance.

CGK: a random walk reads a window; each step writes the present byte and then moves on or stays, as a random function of
step and byte says. Windows at edit distance k come out at Hamming distance O(k^2), whatever the edits are. Bit sampling:
some steps of a walk make one hash key; windows that agree in one of many such keys are candidates.

Windows have ``WIDTH`` bytes, or three fifths of the shortest item if that is less, however long items are: edits grow with the
length of a window, and keys find fewer of those with more edits. Texts are cut at every ``stride`` bytes, items at every
byte, so that every copy of an item holds three whole windows of the text or more. Keys of text windows are
sifted by a bitmap of fixed size made from the keys of the items, then joined with them. Each candidate is checked by
the exact edit distance of the whole item to the part of the text around it, of at most ``max_edit`` times the item's length.

Both are compared as UTF-8 bytes, A-Z in lower case and ASCII white space as spaces; distances are in bytes. Items that are
null or empty match nothing. Those of fewer than ``shortest`` bytes are too short for windows: cut into one part more than they
may have edits, one part at least stands unchanged in every copy, so that none is missed.
Equal items share their matches. A null or short text has no matches, rows that repeat id and text have the same ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import NO_ID, bitmap, flat, mapped, mix, passing, released, slices, text_key, texts
from assaykit.session import stored

#: Walks, keys of each walk, and steps sampled for a key; together they set the recall (see the tests).
WALKS, KEYS, SAMPLED = 4, 8, 14  # 16 sampled steps at most, as they are packed into two words
#: Most bytes of a window and most bytes between the begins of two.
WIDTH, STRIDE = 32, 16
#: Bytes of the n-grams that rule out parts of texts before distances.
GRAM = 5
#: Text whose windows are walked at once in a task, in bytes.
WALKED = 1 << 18
MAX_EDIT = 0.1
SHORTEST = 32
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[9, 10, 11, 12, 13]] = 32
_PLAIN[65:91] += 32


class Walks:
    """The random functions and sampled steps for windows of one width; the same in every task."""

    def __init__(self, width: int, seed: int = 7):
        rng = np.random.default_rng([seed, width])
        self.width, self.steps = width, 2 * width
        self.moves = rng.integers(0, 2, (WALKS, self.steps, 256), dtype=np.uint8)
        self.sampled = [[sorted(rng.choice(self.steps, SAMPLED, replace=False).tolist()) for _ in range(KEYS)]
                        for _ in range(WALKS)]

    def keys(self, buffer: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Keys of the windows that begin there, one row for each walk and sample.

        Windows are laid out one after the other with zeros behind, which a walk past the end of its window reads. The bytes of a
        key's steps are packed into two words.
        """
        count, room = len(begins), self.width + self.steps
        laid = np.zeros((count, room), np.uint8)
        if count:
            laid[:, :self.width] = np.lib.stride_tricks.sliding_window_view(buffer, self.width)[begins]
        laid, first = laid.ravel(), np.arange(count, dtype=np.int64) * room
        out = np.empty((WALKS * KEYS, count), np.uint64)
        for w in range(WALKS):
            read = np.zeros((KEYS, count, 16), np.uint8)
            of = {step: [(k, steps.index(step)) for k, steps in enumerate(self.sampled[w]) if step in steps]
                  for step in range(self.steps)}
            at = first.copy()
            for step in range(self.steps):
                seen = laid.take(at)
                for k, place in of[step]:
                    read[k, :, place] = seen
                at += self.moves[w, step].take(seen)
            for k, (low, high) in enumerate(np.moveaxis(read.view(np.uint64), 2, 1)):
                tag = np.uint64(w * KEYS + k + 1)
                out[w * KEYS + k] = mix(low * np.uint64(0x9E3779B97F4A7C15) + tag) + high
        return mix(out)


def plain(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, in the form that is compared, and where each begins."""
    column = flat(column)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[:len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return _PLAIN[raw[offsets[0]:offsets[-1]]], offsets - offsets[0]


def windows(shortest: int) -> tuple[int, int]:
    """Width and stride of windows for items of that many bytes and more."""
    width = min(WIDTH, shortest * 3 // 5)
    return width, max(1, min(STRIDE, (shortest - width) // 3))


def begins_of(offsets: np.ndarray, width: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and begin of each window."""
    counts = np.maximum(0, (np.diff(offsets) - width) // stride + 1)
    text = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    return text, offsets[text] + inside * stride


def distance(item: bytes, text: bytes) -> int:
    """Least edit distance of the whole item to any part of the text (bit-parallel dynamic programming)."""
    if not item:
        return 0
    masks: dict[int, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    ones, top = (1 << len(item)) - 1, 1 << len(item) - 1
    up, down, score = ones, 0, len(item)
    best = score
    for c in text:
        match = masks.get(c, 0)
        x = match | down
        d = ((((match & up) + up) ^ up) | match | down) & ones
        right = down | ~(d | up) & ones
        left = up & d
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        right = right << 1 & ones
        left = left << 1 & ones
        up = (left | ~(d | right)) & ones
        down = right & d
        best = min(best, score)
    return best


def grams(raw: bytes) -> list[bytes]:
    return [raw[i:i + GRAM] for i in range(len(raw) - GRAM + 1)]


def may_hold(region: set[bytes], item: list[bytes], most: int) -> bool:
    """Whether enough of the item's n-grams stand in the region: an edit changes at most ``GRAM`` of them."""
    return sum(x in region for x in item) >= len(item) - GRAM * most


def item_keys(items: DataFrame, width: int) -> DataFrame:
    """item, shift and lsh of every window of every item."""
    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        buffer, offsets = plain(part.column("item_text"))
        text, begins = begins_of(offsets, width, 1)
        keys = Walks(width).keys(buffer, begins)
        ids = part.column("item").to_numpy()
        return pa.RecordBatch.from_arrays(
            [pa.array(np.tile(ids[text], len(keys))), pa.array(np.tile((begins - offsets[text]).astype(np.int32), len(keys))),
             pa.array(keys.ravel().view(np.int64))], names=["item", "shift", "lsh"])
    return mapped(items, work, "item long, shift int, lsh long", by="item_text", limit=1 << 16)


def text_keys(docs: DataFrame, width: int, stride: int, sift: np.ndarray) -> DataFrame:
    """key, text_key, begin and lsh of the windows of texts whose keys pass the bitmap."""
    def run(batches):
        walks = Walks(width)
        for part in slices(batches, "text", WALKED):
            buffer, offsets = plain(part.column("text"))
            text, begins = begins_of(offsets, width, stride)
            keys = walks.keys(buffer, begins).view(np.int64)
            row, at = np.nonzero(passing(keys, sift))
            found = text[at]
            yield pa.RecordBatch.from_arrays(
                [part.column("key").take(pa.array(found)), part.column("text_key").take(pa.array(found)),
                 pa.array((begins[at] - offsets[found]).astype(np.int32)), pa.array(keys[row, at])],
                names=["key", "text_key", "begin", "lsh"])
    return docs.mapInArrow(released(run), "key long, text_key long, begin int, lsh long")


def leaks(docs: DataFrame, benchmark: DataFrame, max_edit: float = MAX_EDIT, shortest: int = SHORTEST,
          id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, text_key, item_id and distance of every text that holds a benchmark item."""
    docs = texts(docs, id_col, text_col).select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), text_key("text").alias("text_key"), "doc_id", "text")
    given = (benchmark.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).alias("item_text"))
             .where("item_text is not null and trim(item_text) <> ''").withColumn("item", F.xxhash64("item_text")))
    items = stored(given.select("item", "item_text").distinct(), "items")
    width = items.where(F.octet_length("item_text") >= shortest).agg(F.min(F.octet_length("item_text"))).first()[0]
    schema = "key long, text_key long, item long, distance int"
    hits = docs.sparkSession.createDataFrame([], schema)
    if width is not None:
        hits = by_windows(docs, items.where(F.octet_length("item_text") >= shortest), *windows(width), max_edit, schema)
    if items.where(F.octet_length("item_text") < shortest).limit(1).count():
        hits = hits.union(by_search(docs, items.where(F.octet_length("item_text") < shortest), max_edit, schema))
    found = hits.join(given.select("item", "item_id"), "item").withColumn(
        "doc_id", F.when(F.col("key") != NO_ID, F.col("key")))
    return found.select("doc_id", "text_key", "item_id", "distance").distinct()


def by_windows(docs: DataFrame, items: DataFrame, width: int, stride: int, max_edit: float, schema: str) -> DataFrame:
    keys = stored(item_keys(items, width).distinct(), "item-keys")
    sifted = text_keys(docs.select("key", "text_key", "text"), width, stride, bitmap(keys))
    return verified(docs, sifted, keys, items, width, max_edit, schema)


def verified(docs: DataFrame, sifted: DataFrame, keys: DataFrame, items: DataFrame, width: int, max_edit: float,
             schema: str) -> DataFrame:
    """Least distance of each item to the parts of texts around its candidates, if it is small enough."""
    # A passage has several windows with several keys; one candidate is enough for each 64 bytes of its begin.
    at = F.floor((F.col("begin") - F.col("shift")) / 64).cast("int").alias("at")
    candidates = stored(sifted.join(keys, "lsh").select("key", "text_key", "item", at).distinct()
                        .join(items, "item").groupBy("key", "text_key")
                        .agg(F.collect_list(F.struct("item", "item_text", "at")).alias("candidates")), "candidates")

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        rows, known = [], {}
        buffer, offsets = plain(part.column("text"))
        for i, (key, of, listed) in enumerate(zip(*(part.column(c).to_pylist() for c in ("key", "text_key", "candidates")))):
            raw = buffer[offsets[i]:offsets[i + 1]].tobytes()
            found: dict[int, int] = {}
            for c in listed:
                item = _PLAIN[np.frombuffer(c["item_text"].encode(), np.uint8)].tobytes()
                most = int(max_edit * len(item))
                if found.get(c["item"], most + 1) > 0:
                    if c["item"] not in known:
                        known[c["item"]] = grams(item)
                    region = raw[max(0, c["at"] * 64 - width - most):c["at"] * 64 + 64 + len(item) + width + most]
                    if not may_hold(set(grams(region)), known[c["item"]], most):
                        continue
                    found[c["item"]] = min(found.get(c["item"], most + 1), distance(item, region))
            rows.extend((key, of, item, d) for item, d in found.items()
                        if d <= int(max_edit * next(len(c["item_text"].encode()) for c in listed if c["item"] == item)))
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in
                                           enumerate([pa.int64()] * 3 + [pa.int32()])], names=["key", "text_key", "item", "distance"])

    return mapped(docs.join(candidates.hint("shuffle_hash"), ["key", "text_key"]), work, schema)


def parts(buffer: np.ndarray, length: int) -> np.ndarray:
    """Hash of the bytes of that length from each place on."""
    out = np.full(len(buffer) - length + 1, length, np.uint64)
    for i in range(length):
        out = out * np.uint64(0x100000001B3) + buffer[i:len(buffer) - length + 1 + i]
    return mix(out).view(np.int64)


def part_keys(items: DataFrame, max_edit: float) -> DataFrame:
    """item, shift, lsh and length of each of the parts of short items, one more than the edits that they may have."""
    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        buffer, offsets = plain(part.column("item_text"))
        for i, item in enumerate(part.column("item").to_pylist()):
            x = buffer[offsets[i]:offsets[i + 1]]
            count = int(max_edit * len(x)) + 1
            ends = [len(x) * j // count for j in range(count + 1)]
            rows.extend((item, at, int(parts(x[at:end], end - at)[0]), end - at) for at, end in zip(ends, ends[1:]))
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in
                                           enumerate([pa.int64(), pa.int32(), pa.int64(), pa.int32()])],
                                          names=["item", "shift", "lsh", "length"])
    return mapped(items.select("item", "item_text"), work, "item long, shift int, lsh long, length int", by="item_text")


def by_search(docs: DataFrame, items: DataFrame, max_edit: float, schema: str) -> DataFrame:
    """Short items by their parts: places of texts whose bytes pass a bitmap of the parts, joined with them."""
    keys = stored(part_keys(items, max_edit), "short-items")
    lengths = [r[0] for r in keys.select("length").distinct().collect()]  # all below the least length of windows
    sift = bitmap(keys)

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        buffer, offsets = plain(part.column("text"))
        text, begins, lsh = [], [], []
        for n in lengths:
            hashes = parts(buffer, n) if n <= len(buffer) else np.zeros(0, np.int64)
            at = np.flatnonzero(passing(hashes, sift))
            of = np.searchsorted(offsets, at, side="right") - 1
            inside = at + n <= offsets[of + 1]
            text.append(of[inside])
            begins.append((at - offsets[of])[inside])
            lsh.append(hashes[at[inside]])
        found = pa.array(np.concatenate(text))
        return pa.RecordBatch.from_arrays(
            [part.column("key").take(found), part.column("text_key").take(found),
             pa.array(np.concatenate(begins).astype(np.int32)), pa.array(np.concatenate(lsh))],
            names=["key", "text_key", "begin", "lsh"])

    sifted = mapped(docs.select("key", "text_key", "text"), work, "key long, text_key long, begin int, lsh long", limit=WALKED)
    return verified(docs, sifted, keys.drop("length"), items, 0, max_edit, schema)


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no benchmark item; all columns stay."""
    found = leaks(docs, benchmark, id_col=id_col, text_col=text_col, **options)
    gone = found.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_gone_key"), F.col("text_key").alias("_gone_text")).distinct()
    same = ((F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)) == gone["_gone_key"])
            & (text_key(docs[text_col]) == gone["_gone_text"]))
    return docs.join(gone, same, "left_anti")
