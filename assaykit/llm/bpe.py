"""Byte-level BPE: recursive DuckDB queries inside each task turn words into ids, ordered aggregation turns ids back.

Every task loads the merge table into a DuckDB of its own. The state of the recursion is the tokens of each word, without those
that it had before. A step takes the words that changed last, lays their tokens out as token-position rows, joins neighbours with
the merge table and contracts each word's leftmost pair of least rank, until no word has one. Words are the matches of the
pre-tokenizer pattern.

Null and empty texts have no ids and decode to nothing. Repeated rows give repeated rows, a null id stays null, other
columns are left out. Words of more than ``LONGEST`` bytes would need as many steps of the recursion as they have bytes;
they are contracted by the same rule with a heap.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from assaykit.llm.common import LOADED, mapped, texts
from assaykit.llm.tokens import Pieces, ids_of

LONGEST = 128
#: Words per recursive query, ids per decoding query, and text worked on at once in bytes; they bound the memory of a task.
WORDS, IDS, TEXT_BYTES = 20_000, 1 << 17, 1 << 20

# A key is rank * 65536 + position, so that its minimum is the leftmost pair of least rank. Ranks are token ids.
ENCODE = """
WITH RECURSIVE state(word, tokens) USING KEY (word) AS (
    SELECT word, tokens FROM begin
    UNION ALL
    SELECT s.word, s.tokens[:best.key % 65536 - 1] || [(best.key // 65536)::INTEGER] || s.tokens[best.key % 65536 + 2:]
    FROM state s JOIN (
        SELECT pair.word, min(m.id::BIGINT * 65536 + pair.position) AS key
        FROM (SELECT word, unnest(range(1, len(tokens))) AS position, unnest(tokens[:-2]) AS l, unnest(tokens[2:]) AS r
              FROM state) pair
        JOIN merges m ON m.l = pair.l AND m.r = pair.r
        GROUP BY pair.word) best ON s.word = best.word
)
SELECT tokens FROM state ORDER BY word
"""
DECODE = """
SELECT unhex(string_agg(hex, '' ORDER BY position)) AS bytes, count(*) AS found
FROM (SELECT part, unnest(range(len(ids))) AS position, unnest(ids) AS id FROM given) JOIN vocabulary USING (id)
GROUP BY part ORDER BY part
"""
#: Pieces whose ids a worker remembers; it also holds the tables.
KEPT = 400_000


class Codec:
    """The tables of one rank file in a DuckDB of this process, and the ids of pieces seen before."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.pieces = Pieces(self.encode, KEPT)
        pairs = [(ranks[b[:k]], ranks[b[k:]], i) for b, i in ranks.items() for k in range(1, len(b))
                 if b[:k] in ranks and b[k:] in ranks]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})
        self.table("merges", dict(zip("l r id".split(), (pa.array(x, pa.int32()) for x in zip(*pairs)))) if pairs else
                   {x: pa.array([], pa.int32()) for x in ("l", "r", "id")})
        self.table("vocabulary", {"id": pa.array(list(ranks.values()), pa.int32()), "hex": pa.array([b.hex() for b in ranks])})

    def table(self, name: str, columns: dict[str, pa.Array]) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def query(self, sql: str, name: str, columns: dict[str, pa.Array]) -> pa.Table:
        self.db.register(name, pa.table(columns))
        try:
            return self.db.sql(sql).to_arrow_table()
        finally:
            self.db.unregister(name)

    def encode(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece; ``self.pieces`` remembers them, so words are contracted once for each new piece."""
        words = [self.pattern.findall(x) for x in pieces]
        new = list(dict.fromkeys(w for row in words for w in row))
        raw = [w.encode() for w in new]
        known = {}
        short = [i for i, w in enumerate(raw) if len(w) <= LONGEST]
        for k in range(0, len(short), WORDS):
            part = short[k:k + WORDS]
            ends = np.cumsum([0, *(len(raw[i]) for i in part)]).astype(np.int32)
            tokens = self.bytes[np.frombuffer(b"".join(raw[i] for i in part), np.uint8)]
            out = self.query(ENCODE, "begin", {"word": pa.array(np.arange(len(part), dtype=np.int32)),
                                               "tokens": pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens))})
            lists = out.column("tokens").combine_chunks()
            ends, ids = (lists.offsets.to_numpy() * 4).tolist(), lists.values.to_numpy(zero_copy_only=False).tobytes()
            known.update((new[i], ids[a:b]) for i, a, b in zip(part, ends[:-1], ends[1:]))
        known.update((new[i], np.array(contract([int(self.bytes[c]) for c in w], self.ranks, w), np.int32).tobytes())
                     for i, w in enumerate(raw) if len(w) > LONGEST)
        return [known[row[0]] if len(row) == 1 else b"".join(map(known.__getitem__, row)) for row in words]

    def decode(self, lists: list[np.ndarray]) -> list[bytes]:
        """Bytes of each list of ids, queried in parts of at most ``IDS`` ids."""
        out = [[] for _ in lists]
        parts = [(i, ids[k:k + IDS]) for i, ids in enumerate(lists) for k in range(0, len(ids), IDS)]
        while parts:
            taken = max(1, int(np.searchsorted(np.cumsum([len(x) for _, x in parts[:4096]]), IDS, side="right")))
            now, parts = parts[:taken], parts[taken:]
            ends = np.cumsum([0, *(len(x) for _, x in now)]).astype(np.int32)
            found = self.query(DECODE, "given", {
                "part": pa.array(range(len(now)), pa.int32()),
                "ids": pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x for _, x in now]), pa.int32()))})
            if sum(found.column("found").to_pylist()) != ends[-1]:
                raise ValueError("an id is not in the vocabulary")
            for (i, _), b in zip(now, found.column("bytes").to_pylist()):
                out[i].append(b)
        return [b"".join(x) for x in out]


def contract(tokens: list[int], ranks: dict[bytes, int], raw: bytes) -> list[int]:
    """The same contraction for one long word: a heap holds the pairs by rank and position."""
    n = len(raw)
    ends, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (rank := ranks.get(raw[i:ends[j]])) is not None:
            heapq.heappush(heap, (rank, i, ends[j]))

    for i in range(n - 1):
        offer(i)
    alive = [True] * n
    while heap:
        rank, i, end = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or ends[j] != end:
            continue
        alive[j], ends[i], after[i], tokens[i] = False, end, after[j], rank
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [t for t, x in zip(tokens, alive) if x]


def codec(path: str, pattern: str) -> Codec:
    """One per worker process and vocabulary, until the process works for another operator."""
    if (path, pattern) not in LOADED:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
        LOADED[path, pattern] = Codec(ranks, pattern)
    return LOADED[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) of every whole text. ``path`` is a rank file that every executor has."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = ids_of(batch.column("text"), codec(path, pattern).pieces)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])
    return mapped(texts(docs, id_col, text_col), work, "doc_id long, ids array<int>", limit=TEXT_BYTES, keeps=True)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids, bytes (binary): what the ids stand for. Null ids count as none; an unknown id is an error."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"),
                                           pa.array(codec(path, pattern).decode(arrays(batch.column("ids"))), pa.binary())],
                                          names=["doc_id", "ids", "bytes"])
    return mapped(encoded.select("doc_id", "ids"), work, "doc_id long, ids array<int>, bytes binary", by="ids", limit=TEXT_BYTES, keeps=True)


def digest(doc_id: pa.Array, lists: pa.ListArray, tables: Codec) -> pa.RecordBatch:
    back = tables.decode(arrays(lists))
    lists = pa.concat_arrays([lists])
    said = pc.binary_join(pa.ListArray.from_arrays(lists.offsets, lists.values.cast(pa.string())), " ").to_pylist()
    return pa.RecordBatch.from_arrays(
        [doc_id, pc.list_value_length(lists).cast(pa.int64()),
         pa.array([hashlib.sha256(x.encode()).hexdigest() for x in said]),
         pa.array([hashlib.sha256(x).hexdigest() for x in back])],
        names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by a space), decoded_sha256 (of the decoded bytes)."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return digest(batch.column("doc_id"), batch.column("ids"), codec(path, pattern))
    return mapped(encoded.select("doc_id", "ids"), work, DIGESTS, by="ids", limit=TEXT_BYTES, keeps=True)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``digests`` of ``encode`` in one pass, so that a task has one worker with one set of tables."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        tables = codec(path, pattern)
        return digest(batch.column("doc_id"), ids_of(batch.column("text"), tables.pieces), tables)
    return mapped(texts(docs, id_col, text_col), work, DIGESTS, limit=TEXT_BYTES, keeps=True)


def arrays(lists: pa.ListArray) -> list[np.ndarray]:
    lists = pa.concat_arrays([pc.if_else(lists.is_valid(), lists, pa.scalar([], lists.type))])
    ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:])]
