"""Token ids of whole documents, worked out once per different piece between spaces.

A byte-level pre-tokenizer always begins a new piece at a space that follows a character other than white space. So a
text may be cut there, and equal pieces get equal ids. Texts in which white space stands before a space are encoded whole.
It also begins a new piece where a mark other than an apostrophe follows a letter (here: a Latin or Cyrillic one), so the marks that end a word are cut off, and a word
is met once whatever follows it. If a line end between two characters other than white space is a piece of its own (``lines``), as GPT-2's
pattern has it, texts are cut there too, and the first word of a line is met once whatever ends the line before it.
"""

from __future__ import annotations

from collections.abc import Callable
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from assaykit.llm.common import flat

#: White space (as in Unicode's property of that name) before a space, and on either side of a line end.
UNEVEN = r"[\s\x0b\x{85}\p{Z}] "
UNEVEN_LINES = r"\n[\s\x0b\x{85}\p{Z}]|[\s\x0b\x{85}\p{Z}]\n"
#: Pieces kept per worker process, in two generations: when the younger is full it becomes the older, and the older is dropped. A piece that
#: is met again moves to the younger one, so frequent pieces stay.
KEPT = 400_000
#: The same for pieces in Arrow columns, which take about 35 bytes each.
KEPT_COLUMNS = 1_000_000
LONGEST_KEPT = 64
MARKS = punctuation.replace("'", "")
#: Letters that every version of Unicode has as such; behind others nothing is cut off.
LETTER = r"[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2AF}\x{410}-\x{44F}]"
LETTER_LAST = LETTER + "$"
LISTS = pa.list_(pa.int32())
#: Stands for a line end that is cut off; texts of a slice in which it occurs are not cut at line ends.
LINE = "\x01"


class Pieces:
    """Remembers the ids of ``kept`` pieces; ``encode`` gives those of new ones."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], kept: int = KEPT):
        self.encode, self.kept, self.known, self.older = encode, kept, {}, {}

    def __call__(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece, all of them different, as 32-bit integers in a row."""
        found = list(map(self.known.get, pieces))
        missed = [i for i, ids in enumerate(found) if ids is None]
        if not missed:
            return found
        for i in missed:
            found[i] = self.older.get(pieces[i])
        new = [i for i in missed if found[i] is None]
        for i, ids in zip(new, self.encode([pieces[i] for i in new]) if new else ()):
            found[i] = ids
        if len(self.known) + len(missed) > self.kept // 2:
            self.known, self.older = {}, self.known
        self.known.update((pieces[i], found[i]) for i in missed if len(pieces[i]) <= LONGEST_KEPT)
        return found

    def lists(self, pieces: pa.Array) -> pa.ListArray:
        return lists_of(self(pieces.to_pylist()))


class Columns:
    """The same in Arrow columns, looked up a slice at a time without Python's work on each piece; ``encode`` takes and gives columns too."""

    def __init__(self, encode: Callable[[pa.Array], pa.ListArray], kept: int = KEPT_COLUMNS):
        self.encode, self.kept = encode, kept
        self.known = self.older = self.none = (pa.array([], pa.string()), pa.array([], LISTS))

    def lists(self, pieces: pa.Array) -> pa.ListArray:
        """Ids of each piece, all of them different."""
        (known, ids), (older, earlier) = self.known, self.older
        at = places(pieces, known)
        missed = np.flatnonzero(at < 0)
        if not len(missed):
            return ids.take(pa.array(at))
        rest = pieces.take(pa.array(missed))
        back = places(rest, older)
        new = np.flatnonzero(back < 0)
        back[new] = len(older) + np.arange(len(new))
        met = pa.concat_arrays([earlier, self.encode(rest.take(pa.array(new)))]).take(pa.array(back)) if len(new) else earlier.take(pa.array(back))
        at[missed] = len(known) + np.arange(len(missed))
        found = pa.concat_arrays([ids, met]).take(pa.array(at))
        short = pc.less_equal(pc.binary_length(rest), LONGEST_KEPT)
        rest, met = rest.filter(short), met.filter(short)
        if len(known) + len(rest) > self.kept // 2:
            (known, ids), self.older = self.none, self.known
        self.known = pa.concat_arrays([known, rest]), pa.concat_arrays([ids, met])
        return found


def places(pieces: pa.Array, among: pa.Array) -> np.ndarray:
    """Where each piece stands among others, -1 for those that don't; the hash table is one of the pieces, which are fewer."""
    of = pc.index_in(among, value_set=pieces)
    there = np.flatnonzero(of.is_valid())
    out = np.full(len(pieces), -1, np.int64)
    out[of.drop_null().to_numpy()] = there
    return out


def lists_of(rows: list[bytes]) -> pa.ListArray:
    """32-bit integers in a row, as a list each."""
    ends = np.cumsum([0, *map(len, rows)]) // 4
    return pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(np.frombuffer(b"".join(rows), np.int32)))


def ends_cut(pieces: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """The pieces without the marks that end a word, which ones had some, and those marks."""
    pieces = flat(pieces)
    words = pc.utf8_rtrim(pieces, MARKS)
    behind = (pc.binary_length(pieces).to_numpy() - pc.binary_length(words).to_numpy()).astype(np.int64)
    cut = (behind > 0) & pc.match_substring_regex(words, LETTER_LAST).to_numpy(zero_copy_only=False)
    ends, behind = np.frombuffer(pieces.buffers()[1], np.int32)[1:len(pieces) + 1][cut], behind[cut]
    total = np.cumsum(np.concatenate([[0], behind]))
    raw = np.frombuffer(pieces.buffers()[2], np.uint8)[np.repeat(ends - total[1:], behind) + np.arange(total[-1])] \
        if len(ends) else np.zeros(0, np.uint8)
    marks = pa.StringArray.from_buffers(len(ends), pa.py_buffer(total.astype(np.int32)), pa.py_buffer(raw))
    return pc.if_else(pa.array(cut), words, pieces), cut, marks


def ids_of(column: pa.Array, pieces: Pieces | Columns, lines: bool = False) -> pa.ListArray:
    """The ids of each text; with ``lines`` it is cut at line ends as well."""
    column = flat(column)
    uneven = pc.match_substring_regex(column, UNEVEN)
    lines = lines and not pc.any(pc.match_substring(column, LINE)).as_py()
    if lines:
        column = pc.if_else(pc.or_(uneven, pc.match_substring_regex(column, UNEVEN_LINES)), column, pc.replace_substring(column, "\n", " " + LINE))
    lists = pc.split_pattern(pc.if_else(uneven, "", column), " ")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    first = offsets[:-1]
    encoded = lists.flatten().dictionary_encode()
    later = pc.binary_join_element_wise("", encoded.dictionary, " ")
    begins = pc.if_else(uneven, column, encoded.dictionary.take(encoded.indices.take(pa.array(first))))
    if lines:
        opens = pc.starts_with(encoded.dictionary, LINE)
        later = pc.if_else(opens, pc.utf8_slice_codeunits(encoded.dictionary, 1), later)
    words, cut, marks = ends_cut(pa.concat_arrays([later, begins]))
    different = pa.concat_arrays([words, marks, pa.array(["\n"] if lines else [], pa.string())]).dictionary_encode()
    table = pa.concat_arrays([pa.array([[]], LISTS), pieces.lists(different.dictionary)])
    lengths = pc.list_value_length(table).to_numpy().astype(np.int64)
    rows = 1 + different.indices.to_numpy().astype(np.int64)
    parts = np.zeros((len(cut), 3), np.int64)  # row of the line end before each piece, of its word and of the marks behind it, 0 without any
    if lines:
        parts[:len(later), 0] = np.where(opens.to_numpy(zero_copy_only=False), rows[-1], 0)
    parts[:, 1] = rows[:len(cut)]
    parts[cut, 2] = rows[len(cut):len(cut) + len(marks)]
    which = encoded.indices.to_numpy().astype(np.int64)
    which[first] = len(later) + np.arange(len(column))
    sizes = lengths[parts].sum(axis=1)
    whole = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32),
                                     table.take(pa.array(parts.ravel())).flatten())
    ends = np.cumsum(np.concatenate([[0], np.add.reduceat(sizes[which], first)])).astype(np.int32)
    return pa.ListArray.from_arrays(ends, whole.take(pa.array(which)).flatten())
