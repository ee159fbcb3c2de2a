"""Token ids in ORC files: integer run-length encoding, row indexes, Bloom filters on document ids.

Documents are dealt into ranges of ids, one file each, and written in ascending order of doc_id (null first, ties by text).
ORC packs the ids with its integer run-length encoding; the row index and the Bloom filter on doc_id let a search for some
documents skip stripes, and a large file is read by several tasks, stripe by stripe.

A null or empty text has only the end id. Repeated rows are repeated, other columns are left out, no rows give no files.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaykit.llm.bpe import arrays
from assaykit.llm.common import in_ranges, mapped, partitions, slices, texts
from assaykit.llm.tokens import LETTER, LISTS, Columns, ids_of, lists_of
from assaykit.session import stored

ROWS = "doc_id long, row long, ids array<int>"
#: A piece that may be joined with others, and how many are.
SINGLE, JOINED = re.compile(r" ?\S+"), 32
#: A piece that GPT-2's pattern does not divide.
WORD = f"^ ?{LETTER}+$"
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The character that stands for each byte in a byte-level vocabulary.
CHARACTERS = dict(zip([*_SHOWN, *(b for b in range(256) if b not in _SHOWN)], [*_SHOWN, *range(256, 324)]))
_LOADED: dict[str, tuple[Columns, bool]] = {}


def pieces(path: str) -> tuple[Columns, bool]:
    """The tokenizer of one file, once per worker process, and whether texts may be cut at line ends; strings of special tokens are ordinary text."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        encoder = Encoder(tokenizer)
        _LOADED[path] = Columns(encoder.columns), encoder.lines
    return _LOADED[path]


class Encoder:
    """Ids of each of some pieces. Those without white space inside are encoded ``JOINED`` at a time, with line ends between.

    A line end between them is a token of its own, so the ids are cut there. If there are not as many of these tokens as line ends, the
    tokenizer treats line ends in another way, and the pieces are encoded one by one.

    If the tokenizer divides texts by GPT-2's pattern (``lines``: then a line end between other characters is a piece of its own), words of
    letters go to its model as they are, without the pattern's search: by a tokenizer of the same model that only divides at line ends.
    """

    def __init__(self, tokenizer):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split

        self.tokenizer, pattern = tokenizer, tokenizer.pre_tokenizer
        self.end = self.ids(["\n"])[0]
        settings = json.loads(pattern.__getstate__()) if pattern else {}
        self.lines = (tokenizer.normalizer is None and settings.get("type") == "ByteLevel" and settings.get("use_regex", True)
                      and not settings.get("add_prefix_space", True)
                      and all(x.special for x in tokenizer.get_added_tokens_decoder().values()))
        self.model = Tokenizer(tokenizer.model)
        self.model.pre_tokenizer = Split(chr(CHARACTERS[ord("\n")]), "isolated")

    def ids(self, rows: list[str], tokenizer=None) -> list[array]:
        return [array("i", x.ids) for x in (tokenizer or self.tokenizer).encode_batch_fast(rows, add_special_tokens=False)]

    def columns(self, pieces: pa.Array) -> pa.ListArray:
        """Ids of each piece, from and to Arrow."""
        word = pc.match_substring_regex(pieces, WORD).to_numpy(zero_copy_only=False) & self.lines
        found = pa.concat_arrays([self.words(pieces.filter(pa.array(word))), lists_of(self(pieces.filter(pa.array(~word)).to_pylist()))])
        return found.take(pa.array(np.argsort(np.concatenate([np.flatnonzero(word), np.flatnonzero(~word)]))))

    def words(self, words: pa.Array) -> pa.ListArray:
        """Ids of words of letters, with line ends between."""
        if not len(words):
            return pa.array([], LISTS)
        groups = pa.ListArray.from_arrays(pa.array([*range(0, len(words), JOINED), len(words)], pa.int32()), words)
        rows = [f"{x}\n".encode().decode("latin-1").translate(CHARACTERS) for x in pc.binary_join(groups, "\n").to_pylist()]
        ids = np.frombuffer(b"".join(x.tobytes() for x in self.ids(rows, self.model)), np.int32)
        end = ids == self.end[0]
        ends = np.flatnonzero(end)
        if len(self.end) != 1 or len(ends) != len(words):
            return lists_of(self(words.to_pylist()))
        return pa.ListArray.from_arrays(np.concatenate([[0], ends - np.arange(len(ends))]).astype(np.int32), pa.array(ids[~end]))

    def __call__(self, pieces: list[str]) -> list[bytes]:
        single = [bool(SINGLE.fullmatch(x)) for x in pieces]
        joined = self.joined([x for x, s in zip(pieces, single) if s])
        if joined is None:
            return [x.tobytes() for x in self.ids(pieces)]
        others = iter([x.tobytes() for x in self.ids([x for x, s in zip(pieces, single) if not s])])
        found = iter(joined)
        return [next(found if s else others) for s in single]

    def joined(self, words: list[str]) -> list[bytes] | None:
        if not words:
            return []
        rows = self.ids(["\n".join(words[k:k + JOINED]) + "\n" for k in range(0, len(words), JOINED)])
        raw = b"".join(x.tobytes() for x in rows)
        ends = np.flatnonzero(np.frombuffer(raw, np.int32) == self.end[0])
        if len(self.end) != 1 or len(ends) != len(words):
            return None
        begins = np.concatenate([[0], ends[:-1] + 1])
        return [raw[a:b] for a, b in zip((4 * begins).tolist(), (4 * ends).tolist())]


def write(docs: DataFrame, to: str, path: str, end_id: int = 2, stripe_bytes: int = 8 << 20, index_rows: int = 1000,
          id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of every whole text, each with ``end_id`` behind, as ORC below ``to``.

    ``path`` is a file of the tokenizers library that every executor has. ``row`` numbers the rows of a file.
    """
    docs = texts(docs, id_col, text_col)
    count = partitions(docs.sparkSession)
    ranges = in_ranges(docs, count).repartitionById(count, F.col("place")).sortWithinPartitions("key", "text")

    def run(batches):
        row = 0
        for part in slices(batches, "text"):
            ids = ids_of(part.column("text"), *pieces(path))
            ends, values = ids.offsets.to_numpy().astype(np.int64), ids.values.to_numpy(zero_copy_only=False)
            ended = pa.ListArray.from_arrays((ends + np.arange(len(ends))).astype(np.int32),
                                             pa.array(np.insert(values, ends[1:], end_id).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.arange(row, row + len(ids))), ended],
                                             names=["doc_id", "row", "ids"])
            row += len(ids)

    (ranges.select("doc_id", "text").mapInArrow(run, ROWS).write
     .option("compression", "none").option("orc.stripe.size", stripe_bytes).option("orc.row.index.stride", index_rows)
     .option("orc.create.index", "true").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", 0.01)
     .orc(to))


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, row and ids of written files; filters on doc_id are pushed to their indexes."""
    return spark.read.schema(ROWS).orc(path)


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files.

    ``start`` counts the ids of all documents before it: those of earlier files (one number a file, added up on the
    driver) and those of earlier rows of the same file.
    """
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = arrays(batch.column("ids"))
        return pa.RecordBatch.from_arrays(
            [batch.column("file"), batch.column("doc_id"), batch.column("row"),
             pa.array([len(x) for x in lists], pa.int64()),
             pa.array([zlib.crc32(np.ascontiguousarray(x, "<u4")) for x in lists], pa.int64())],
            names=["file", "doc_id", "row", "n_tokens", "ids_crc32"])

    rows = read(spark, path).select(F.col("_metadata.file_name").alias("file"), "doc_id", "row", "ids")
    found = stored(mapped(rows, work, "file string, doc_id long, row long, n_tokens long, ids_crc32 long", by="ids"),
                   "token-rows")
    totals = sorted(found.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect())
    before = np.cumsum([0, *(x.n for x in totals)])
    starts = spark.createDataFrame([(x.file, int(b)) for x, b in zip(totals, before)], "file string, before long")
    earlier = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return (found.withColumn("inside", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))
            .join(F.broadcast(starts), "file")  # one row a file
            .select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"))
