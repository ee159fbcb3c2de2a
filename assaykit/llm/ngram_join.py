"""Jaccard self-join on word n-grams by vertical partitioning, and the classes that its links make.

The global order of n-grams is that of their 64-bit hashes. It is cut into fragments twice:

* To find candidates, into as many fragments as two linked sets of a size class can differ in n-grams, and some more. Then
  at least one fragment that is not empty holds the same n-grams in both sets, so equal fragments find every link.
  Spare fragments make up for empty ones: a set with at most that many empty fragments need not offer them.
* To count, into ``PARTS`` fragments of fixed width. Partial overlaps are counted fragment by fragment and summed per pair.

Equal sets are one node (told apart by 64-bit digests). Groups of equal fragments are never paired out. All members of a group
are compared with one, the leader, which is the member that shares most fragments in all. What is left are pairs of members in
different components; blocks of a leader's members are held against each other within a task. Both times a sketch goes first:
a bit a slot that says whether an odd number of n-grams falls into it. Two sets differ by at least as many n-grams as
their sketches do in bits, so no link is ruled out, and only pairs that the sketches leave open are counted by fragments.

The percentage is at least 50. Words are runs of characters other than ASCII white space, with A-Z in lower case. A text of
fewer words is one n-gram,
a null text or one without words has none and is linked with nothing. Rows that repeat id and text are one document; rows
that share an id but not the text are separate nodes. Other columns are left out of the result.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import BITS, NO_ID, bitmap, flat, mapped, mix, passing, released, slices, text_key, texts
from assaykit.session import stored

PARTS = 8
#: Rows of one group held at a time in a task; a longer group is passed on as it comes.
HELD = 1 << 16
SEEN = 1 << 20
#: Text whose n-grams are laid out at once, in bytes.
TEXT_BYTES = 1 << 20
#: Sketches of a block, in bytes; a task holds two blocks of a ball.
BLOCK_BYTES = 2 << 20


def ngrams(column: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted different n-gram hashes of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(flat(column)))
    encoded = lists.flatten().dictionary_encode()
    named = encoded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in named), np.uint64, len(named))
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    full = np.fromiter((w != "" for w in named), bool, len(named))[codes] if len(named) else np.zeros(0, bool)
    ends = np.concatenate([[0], np.cumsum(full)])[offsets]  # splitting leaves empty words at the ends of a text
    w = hashes[codes][full] if len(named) else np.zeros(0, np.uint64)
    grams = chained([w[i:len(w) - words + 1 + i] for i in range(words)]) if len(w) >= words else w[:0]
    return [np.unique(grams[a:b - words + 1]) if b - a >= words else chained([w[i:i + 1] for i in range(a, b)])
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def chained(words: list[np.ndarray]) -> np.ndarray:
    """One hash of consecutive words, which also depends on their number."""
    if not words:
        return np.zeros(0, np.uint64)
    out = np.full(len(words[0]), len(words), np.uint64)
    for w in words:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + w)
    return out


@lru_cache(maxsize=None)
def size_classes(percent: int) -> list[int]:
    """Least size of each class; linked sets lie in the same class or in neighbouring ones."""
    least = [1]
    while least[-1] < 1 << 40:
        least.append(least[-1] * 100 // percent + 1)
    return least


@lru_cache(maxsize=None)
def fragments(percent: int, k: int) -> tuple[int, int]:
    """Number of fragments for sets of classes k - 1 and k, and how many of them are spare."""
    least = size_classes(percent)
    differ = 2 * (least[k + 1] - 1) * (100 - percent) // (100 + percent)
    if not differ:
        return 0, 0  # only equal sets are linked
    spare, low = 0, least[max(k - 1, 0)]
    for _ in range(4):
        empty = (differ + 1 + spare) * math.exp(-low / (differ + 1 + spare))
        spare = math.ceil(empty + 4 * math.sqrt(empty))
    return differ + 1 + spare, spare


def signatures(grams: np.ndarray, percent: int) -> np.ndarray:
    """A hash of each fragment of a set, for its own size class and the one above."""
    if not len(grams):
        return np.zeros(0, np.uint64)
    own = bisect_right(size_classes(percent), len(grams)) - 1
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(grams), dtype=np.uint64)])
    out = []
    for k in (own, own + 1):
        count, spare = fragments(percent, k)
        if not count:
            continue
        which = ((grams >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        ends = np.cumsum(np.bincount(which.astype(np.int64), minlength=count))
        begins = np.concatenate([[0], ends[:-1]])
        tags = mix(np.uint64(k) * np.uint64(1 << 40) + np.arange(count, dtype=np.uint64))
        hashed = mix(total[ends] - total[begins] + tags)
        full = ends > begins
        out.append(hashed[full] if count - int(full.sum()) <= spare else hashed)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sketch(grams: np.ndarray) -> bytes:
    """Parity of the number of n-grams in each slot, four to eight slots for an n-gram; the first slot is the lowest bit."""
    slots = 1 << max(6, (4 * len(grams) - 1).bit_length())
    counts = np.bincount((grams & np.uint64(slots - 1)).astype(np.int64), minlength=slots)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def narrowed(sketches: np.ndarray) -> np.ndarray:
    """Sketches (one a row) in half as many slots."""
    half = sketches.shape[1] // 2
    return sketches[:, :half] ^ sketches[:, half:]


def most_apart(n, other, percent: int):
    """How many n-grams two linked sets of these sizes can differ by."""
    return (n + other) * (100 - percent) // (100 + percent)


def sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, text_key, n, node (digest of the set, null without n-grams), signatures and sketch of each text.

    A task gives the signatures and the sketch of a set only once.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in slices(batches, "text", TEXT_BYTES):
            nodes, sizes, offered, sketches = [], [], [], []
            for grams in ngrams(part.column("text"), words):
                node = int(mix(np.array([mix(grams).sum(dtype=np.uint64) + np.uint64(len(grams))]))[0]) if len(grams) else None
                new = node is not None and node not in seen
                if new:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(node)
                nodes.append(node)
                sizes.append(len(grams))
                offered.append(signatures(grams, percent).view(np.int64) if new else np.zeros(0, np.int64))
                sketches.append(sketch(grams) if new else None)
            ends = np.cumsum([0, *map(len, offered)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_key"), pa.array(sizes, pa.int64()),
                 pa.array([None if x is None else x - (1 << 64) if x >> 63 else x for x in nodes], pa.int64()),
                 pa.ListArray.from_arrays(ends, pa.array(np.concatenate(offered))), pa.array(sketches, pa.binary())],
                names=["doc_id", "text_key", "n", "node", "signatures", "sketch"])
    return docs.mapInArrow(released(run), "doc_id long, text_key long, n long, node long, signatures array<long>, sketch binary")


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of groups of at least two from rows sorted by signature and node: group and node.

    Groups with the same members get the same number, unless they are longer than ``HELD``.
    """
    sig, node = np.zeros(0, np.int64), np.zeros(0, np.int64)
    passing = None  # signature of a long group that has begun

    def rows(group, members):
        return pa.RecordBatch.from_arrays([pa.array(group), pa.array(members)], names=["group", "node"])

    def closed(s, n):
        begins = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        counts = np.diff(np.concatenate([begins, [len(s)]]))
        total = np.add.reduceat(mix(n.view(np.uint64)), begins)
        number = mix(total + counts.astype(np.uint64)).view(np.int64)
        many = np.repeat(counts > 1, counts)
        return rows(np.repeat(number, counts)[many], n[many])

    for batch in batches:
        s, n = (batch.column(x).to_numpy() for x in ("signature", "node"))
        if passing is not None and len(s):
            same = s == passing
            if same.any():
                yield rows(s[same], n[same])
            s, n = s[~same], n[~same]
            if len(s):
                passing = None
        sig, node = np.concatenate([sig, s]), np.concatenate([node, n])
        if not len(sig):
            continue
        new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])])
        sig, node = sig[new], node[new]
        last = int(np.searchsorted(sig, sig[-1]))
        if last:
            yield closed(sig[:last], node[:last])
            sig, node = sig[last:], node[last:]
        if len(sig) > HELD:
            passing = sig[0]
            yield rows(sig, node)
            sig, node = sig[:0], node[:0]
    if len(sig):
        yield closed(sig, node)


def segments(docs: DataFrame, words: int) -> DataFrame:
    """node, part, n and n-grams of each counting fragment. Takes rows with node and text."""
    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        nodes, parts, sizes, held = [], [], [], []
        for node, grams in zip(part.column("node").to_pylist(), ngrams(part.column("text"), words)):
            ends = np.searchsorted(grams >> np.uint64(61), np.arange(PARTS + 1, dtype=np.uint64))
            for i in range(PARTS):
                nodes.append(node)
                parts.append(i)
                sizes.append(len(grams))
                held.append(grams[ends[i]:ends[i + 1]].view(np.int64))
        ends = np.cumsum([0, *map(len, held)]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.int64()), pa.array(parts, pa.int32()), pa.array(sizes, pa.int64()),
             pa.ListArray.from_arrays(ends, pa.array(np.concatenate(held) if held else np.zeros(0, np.int64)))],
            names=["node", "part", "n", "grams"])
    return mapped(docs, work, "node long, part int, n long, grams array<long>", limit=TEXT_BYTES).dropDuplicates(["node", "part"])


def open_pairs(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (node, leader) that sketches do not rule out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, other = (batch.column(c).to_numpy() for c in ("n", "n_leader"))
            room = most_apart(n, other, percent).tolist()
            fits = []
            for x, y, most in zip(batch.column("sketch").to_pylist(), batch.column("leader_sketch").to_pylist(), room):
                a, b = (int.from_bytes(z, "little") for z in (x, y))
                slots = 8 * min(len(x), len(y))
                while max(a, b) >> slots:
                    a, b = ((z & ((1 << slots) - 1)) ^ (z >> slots) for z in (a, b))
                fits.append((a ^ b).bit_count() <= most)
            yield batch.select(["node", "leader"]).filter(pa.array(fits, pa.bool_()))

    leaders = sketches.select(F.col("node").alias("leader"), F.col("n").alias("n_leader"), F.col("sketch").alias("leader_sketch"))
    sized = (pairs.join(sketches.select("node", "n"), "node").join(leaders.select("leader", "n_leader"), "leader")
             .where(100 * F.least("n", "n_leader") >= percent * F.greatest("n", "n_leader")))
    return (sized.select("node", "leader").join(sketches, "node").join(leaders, "leader")
            .select("node", "leader", "n", "n_leader", "sketch", "leader_sketch").mapInArrow(released(run), "node long, leader long"))


def among(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """key, text_key and text of the rows that are probably chosen, so that other texts are not shuffled.

    The bitmap has about 64 bits for a chosen row, ``BITS`` at most; with more rows it lets more others pass, and the join that
    follows rules them out.
    """
    bits = min(BITS, max(1 << 16, 64 * chosen.count()))
    place = F.xxhash64("key", "text_key").alias("lsh")
    sift = bitmap(chosen.select(place), bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["key", "text_key", "text"]).filter(pa.array(passing(batch.column("lsh").to_numpy(), sift, bits)))
    return docs.select("key", "text_key", "text", place).mapInArrow(released(run), "key long, text_key long, text string")


def linked(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (node, leader) whose overlaps, counted fragment by fragment and summed, make a link.

    ``nodes`` says which row of ``docs`` has the text of a node; only the texts of these pairs are taken apart.
    """
    wanted = pairs.select("node").union(pairs.select("leader")).distinct()
    chosen = stored(nodes.join(wanted, "node", "left_semi").select("node", "first.key", "first.text_key"), "chosen")
    held = stored(segments(among(docs, chosen).join(chosen, ["key", "text_key"]).select("node", "text"), words), "segments")
    left = held.select("node", "part", F.col("n").alias("n_node"), F.col("grams").alias("own"))
    right = held.select(F.col("node").alias("leader"), "part", F.col("n").alias("n_leader"), F.col("grams").alias("other"))
    parts = (pairs.join(right, "leader").join(left, ["node", "part"])
             .select("node", "leader", "n_node", "n_leader", F.size(F.array_intersect("own", "other")).alias("common")))
    total = parts.groupBy("node", "leader", "n_node", "n_leader").agg(F.sum("common").alias("common"))
    return total.where(100 * F.col("common") >= percent * (F.col("n_node") + F.col("n_leader") - F.col("common"))).select("node", "leader")


def balls(tried: DataFrame, sketches: DataFrame, labels: DataFrame) -> DataFrame:
    """Sketches of the members of balls that reach over several components, laid out in cells of two blocks of a ball.

    A ball is a leader and all that were compared with it. Blocks hold about ``BLOCK_BYTES`` of sketches; members of the
    leader's own component are in blocks of their own, which are not held against each other.
    """
    own = labels.select(F.col("node").alias("leader"), F.col("label").alias("home"))
    bytes_ = sketches.select("node", F.length("sketch").alias("bytes"))
    rated = (tried.join(bytes_, "node").join(labels, "node", "left").join(own, "leader", "left")
             .select("node", "leader", "bytes", F.coalesce("label", "node").alias("label"), F.coalesce("home", "leader").alias("home")))
    far = F.col("label") != F.col("home")
    blocks = lambda c: F.ceil(F.coalesce(F.sum(F.when(c, F.col("bytes"))), F.lit(0)) / BLOCK_BYTES).cast("int")
    counts = (rated.groupBy("leader").agg(blocks(far).alias("outer"), blocks(~far).alias("inner"),
                                          F.count_if(far).alias("strangers"), F.count("*").alias("all"))
              .where("strangers > 0 and all > 1").drop("strangers", "all"))
    block = lambda count: F.pmod(F.xxhash64("node"), F.greatest(F.col(count), F.lit(1))).cast("int")
    placed = rated.join(counts, "leader").withColumn(
        "block", F.when(far, block("outer")).otherwise(F.col("outer") + block("inner")))
    other = F.sequence(F.lit(0), F.when(far, F.col("outer") + F.col("inner") - 1).otherwise(F.col("outer") - 1))
    return (placed.select("node", "leader", "label", "block", F.explode(other).alias("other")).join(sketches, "node").select(
        "leader", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "label",
        "n", "sketch"))


def near(percent: int):
    """Pairs of one cell, of different labels, whose sketches differ by no more bits than linked sets of their sizes can.

    Sets of which one has more than twice as many slots as the other are not linked, so neighbouring widths are compared.
    """
    schema = pa.schema([("node", pa.int64()), ("leader", pa.int64())])

    def cell(table: pa.Table) -> pa.Table:
        node, label, n, block = (table.column(c).to_numpy() for c in ("node", "label", "n", "block"))
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        column = table.column("sketch").combine_chunks()
        widths = pc.binary_length(column).to_numpy()
        found = []

        def rows(width: int, of: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
            at = np.flatnonzero((widths == width) & (block == of))
            bits = np.frombuffer(b"".join(column.take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), width)
            bits = np.ascontiguousarray(bits if width == slots else narrowed(bits))
            return at, bits.view(np.uint64)

        def against(mine: int, width: int, other: int, wide: int) -> None:
            left, a = rows(width, mine, width)
            right, b = rows(wide, other, width)
            same = mine == other and width == wide
            for i, bits in zip(left, a):
                j, c = (right[right > i], b[right > i]) if same else (right, b)
                j, c = j[label[j] != label[i]], c[label[j] != label[i]]
                far = np.bitwise_count(c ^ bits).sum(axis=1, dtype=np.int64)
                j = j[far <= most_apart(n[j], n[i], percent)]
                found.append(np.stack([node[j], np.full(len(j), node[i])]))

        for width in np.unique(widths).tolist():
            against(low, width, high, width)
            against(low, width, high, 2 * width)
            if low != high:
                against(high, width, low, 2 * width)
        both = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return pa.table([pa.array(both.max(axis=0)), pa.array(both.min(axis=0))], schema=schema)

    return cell


def components(links: DataFrame) -> DataFrame:
    """node and label (least node of its component) of every node with a link: large and small stars in turn."""
    edges, before = stored(links.distinct(), "links"), None
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = stored(small.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
                       .union(least.select("u", "m")).distinct(), "stars")
        now = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == before:
            return edges.union(edges.select("b", "b").distinct()).toDF("node", "label")
        before = now


def join(docs: DataFrame, words: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, n_shingles, component_id and kept of every row.

    ``component_id`` is the smallest doc_id that links reach (null if they reach only null ids). ``kept`` marks the rows of
    one document of each component: the smallest id, then the smallest text_key (``text_key()`` of the text).
    """
    docs = texts(docs, id_col, text_col).withColumn("text_key", text_key("text"))
    found = stored(sets(docs, words, percent), "sets")
    offered = found.where(F.size("signatures") > 0).select("node", F.explode("signatures").alias("signature"))
    members = stored(
        offered.repartition("signature").sortWithinPartitions("signature", "node").select("signature", "node")
        .mapInArrow(released(groups), "group long, node long").distinct(), "groups")
    key = F.coalesce("doc_id", F.lit(NO_ID))
    place = F.struct(key.alias("key"), "text_key")
    nodes = stored(found.where("node is not null").groupBy("node")
                   .agg(F.min(place).alias("first"), F.min("doc_id").alias("doc_id")), "nodes")
    sketches = stored(found.where("sketch is not null").select("node", "n", "sketch")
                      .join(members.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "sketches")
    labels = resolve(members, sketches, lambda pairs: linked(pairs, docs.withColumn("key", key), nodes, words, percent), percent)
    labelled = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    of_label = labelled.groupBy("label").agg(F.min("first").alias("chosen"), F.min("doc_id").alias("component_id"))
    of_node = labelled.join(of_label, "label").select("node", "chosen", "component_id")
    return (found.select("doc_id", "text_key", "n", "node").join(of_node, "node", "left")
            .select("doc_id", "text_key", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
                    F.coalesce(F.col("chosen") == place, F.lit(True)).alias("kept")))


def resolve(members: DataFrame, sketches: DataFrame, links_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Labels of the nodes with links: each group against its leader, then the pairs of members that this leaves open."""
    sizes = members.groupBy("group").agg((F.count("*") - 1).alias("others"))
    weights = members.join(sizes, "group").groupBy("node").agg(F.sum("others").alias("weight"))
    leaders = (members.join(weights, "node").groupBy("group")
               .agg(F.min(F.struct((-F.col("weight")).alias("weight"), "node"))["node"].alias("leader")))
    tried = stored(members.join(leaders, "group").where("node <> leader").select("node", "leader").distinct(), "tried")
    first = stored(links_of(stored(open_pairs(tried, sketches, percent), "first")), "near_leader")
    labels = stored(components(first.toDF("a", "b")), "labels")
    more = (balls(tried, sketches, labels).groupBy("leader", "low", "high").applyInArrow(near(percent), "node long, leader long"))
    more = stored(links_of(stored(more.distinct(), "open")), "more")
    if more.isEmpty():
        return labels
    return components(first.union(more).toDF("a", "b"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that another one of their component stands for; all columns stay."""
    gone = (join(docs, words, percent, id_col, text_col).where("not kept")
            .select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_gone_key"), F.col("text_key").alias("_gone_text")).distinct())
    gone = stored(gone, "gone")  # its size is known then, and decides how the rows are joined
    same = ((F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)) == gone["_gone_key"])
            & (text_key(docs[text_col]) == gone["_gone_text"]))
    return docs.join(gone, same, "left_anti")
