"""Document operators against brute force, round trips and the libraries they follow, with awkward rows."""

import base64
import hashlib
import re
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from assaykit.llm import (bpe, decontamination, fingerprints, language, line_dedup, ngram_join, pii, quality, token_files, tokens, toxicity)
from assaykit.session import workspace

RANKS = P.path("byte_bpe_50k.tiktoken")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
ODD = ["", " ", "a", "It's  2\n \n ok\xa0 é 日本 😀 \x1c!", "x" * 3000 + " " * 200, "\n\n"]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, prose(120, i)) for i in range(12)] + [(20, prose(120, 0)), (21, prose(119, 3) + " end"), (None, None), (30, None)]
    rows += [(40 + i, t) for i, t in enumerate(ODD)] + [(50, "twice the same row"), (50, "twice the same row")]
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, text_key string")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def order(x):
    return sorted(x, key=str)


def test_bpe_equals_the_library_and_round_trips(docs, rows, empty):
    own = bpe.encode(docs, RANKS, P.PATTERN)
    tk = library()
    assert order((r.doc_id, list(r.ids)) for r in own.collect()) == order((i, tk.encode_ordinary(t or "")) for i, t in rows)
    back = bpe.decode(own, RANKS, P.PATTERN).collect()
    assert order((r.doc_id, bytes(r.bytes).decode()) for r in back) == order((i, t or "") for i, t in rows)
    at_once = bpe.round_trip(docs, RANKS, P.PATTERN).collect()
    assert order(at_once) == order(bpe.digests(own, RANKS, P.PATTERN).collect())
    assert order((r.doc_id, r.decoded_sha256) for r in at_once) == order(
        (i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert bpe.round_trip(empty, RANKS, P.PATTERN).count() == 0
    assert bpe.digests(bpe.encode(empty, RANKS, P.PATTERN), RANKS, P.PATTERN).count() == 0


def test_long_words_are_contracted_by_the_same_rule():
    tk, codec = library(), bpe.codec(RANKS, P.PATTERN)
    word = "".join(WORDS) * 9
    assert bpe.contract([codec.bytes[c] for c in word.encode()], codec.ranks, word.encode()) == tk.encode_ordinary(word)


def test_token_files(spark, docs, rows):
    path = workspace(spark, "orc")
    token_files.write(docs, path, P.path("byte_bpe_50k.json"))
    tk = library()
    start, expected = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tk.encode_ordinary(t or ""), 2]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert order(tuple(r) for r in token_files.catalogue(spark, path).collect()) == order(expected)
    plan = token_files.read(spark, path).where("doc_id = 7")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,7)" in plan


def test_fingerprints(docs, rows, empty):
    out = fingerprints.fingerprints(docs).collect()
    given = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    expected = []
    for k, (i, t) in enumerate(given):
        after = given[(k + 1) % len(given)][1]
        changed = t[:len(t) - len(t) // 2] + after[:len(t) // 2]
        expected.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest()))
    assert order((r.doc_id, r.n_chars, r.edited_sha256) for r in out) == order(expected)
    assert len({r.fingerprint for r in out}) == len({t for _, t in given})
    assert all(0 <= x <= 1 for r in out for x in (r.near_edited, r.near_next))
    assert fingerprints.fingerprints(empty).count() == 0
    a, b = "one line\n" * 3 + prose(200, 1), "one line\n" * 3 + prose(200, 1) + " more"
    (begin, end), = fingerprints.differences(fingerprints.tree(a.encode())[0], fingerprints.tree(b.encode())[0])
    assert begin > 0 and end == len(b)


@pytest.mark.parametrize("text", [
    "ab cd", "twice the same row", "日本語の短い文です", "x" * 5000, "ab " * 2000, "".join(map(chr, range(0x4E00, 0x5A00))), prose(12, 5),
    "".join(prose(900, 6).split()), prose(900, 7)], ids=range(9))
def test_fingerprints_of_short_unspaced_and_repetitive_texts(text):
    """The half that is left is found, an insertion is located, pieces are bounded and end on borders of code points."""
    raw = text.encode()
    own = fingerprints.tree(raw)
    changed = fingerprints.tree(fingerprints.edited(text, "QZ" * len(text)).encode())
    assert fingerprints.likeness(own[1:], changed[1:]) >= 0.25
    ends = fingerprints.cuts(raw).tolist()
    assert ends[-1] == len(raw) and all(len(raw[a:b].decode()) and b - a <= 256 for a, b in zip([0, *ends], ends))
    if len(raw) > 1000:
        middle = len(text) // 2
        other = fingerprints.tree((text[:middle] + "!?" + text[middle:]).encode())
        assert fingerprints.likeness(own[1:], other[1:]) >= 0.4
        found = fingerprints.differences(own[0], other[0])
        assert any(a <= len(text[:middle].encode()) < b for a, b in found)


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def test_ngram_join_against_all_pairs(spark, empty):
    base = prose(150, 99).split()
    given = [(i, " ".join(x if (j * 7 + i) % (9 + 5 * i) else "new" for j, x in enumerate(base))) for i in range(14)]
    given += [(20, " ".join(base)), (21, " ".join(base).upper()), (22, None), (23, ""), (24, "a b"), (25, "A  b"), (None, "a b c")]
    df = spark.createDataFrame(given, "doc_id long, text string")
    sets = [shingles(t, 3) for _, t in given]
    label = list(range(len(given)))
    for i in range(len(given)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    ids = [i for i, _ in given]
    expected = [(ids[i], len(sets[i]), min((ids[j] for j in range(len(given)) if label[j] == label[i] and ids[j] is not None),
                                           default=None)) for i in range(len(given))]
    out = ngram_join.join(df, 3, 90)
    assert order((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()) == order(expected)


@pytest.mark.parametrize("block_bytes", [2_000, 8 << 20])
def test_members_that_miss_their_leader_still_meet(spark, monkeypatch, block_bytes):
    """One group of a leader, four clusters too far from it, and members at all distances, in many blocks and in one."""
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", block_bytes)
    rng = np.random.default_rng(4)

    def text(edits):
        return " ".join(f"new{edits[i]}x{i}" if i in edits else f"w{i}" for i in range(300))

    far = [{int(p): 1 for p in rng.choice(300, 14, replace=False)} for _ in range(4)]
    given = {0: text({})}
    for i in range(1, 41):
        given[i] = text({**far[i % 4], int(rng.integers(300)): i})
    for i in range(41, 61):
        given[i] = text({int(p): i for p in rng.choice(300, i - 38, replace=False)})
    sets = {i: shingles(t, 3) for i, t in given.items()}
    label = {i: i for i in given}
    for i in given:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = {k: min(a, b) if x in (a, b) else x for k, x in label.items()}
    members = spark.createDataFrame([(1, i) for i in given], "group long, node long")
    docs = spark.createDataFrame([(i, 0, t) for i, t in given.items()], "key long, text_key long, text string")
    nodes = docs.select(F.col("key").alias("node"), F.struct("key", "text_key").alias("first"))
    grams = ngram_join.ngrams(pa.array(given.values()), 3)
    sketches = spark.createDataFrame([(i, len(g), ngram_join.sketch(g)) for i, g in zip(given, grams)], "node long, n long, sketch binary")
    links = lambda pairs: ngram_join.linked(pairs, docs, nodes, 3, 90)
    found = {r.node: r.label for r in ngram_join.resolve(members, sketches, links, 90).collect()}
    assert {i: found.get(i, i) for i in given} == label
    assert len({label[i] for i in range(1, 41)}) == 4


def test_only_chosen_texts_are_shuffled_for_counting(spark):
    """Every chosen row passes, few others do, and nothing passes where nothing is chosen."""
    docs = spark.range(3000).selectExpr("id AS key", "id * 7 AS text_key", "concat('text ', id) AS text")
    chosen = docs.where("key % 50 = 0").selectExpr("key AS node", "key", "text_key")
    found = {r.key: r.text for r in ngram_join.among(docs, chosen).collect()}
    assert {k: t for k, t in found.items() if k % 50 == 0} == {k: f"text {k}" for k in range(0, 3000, 50)}
    assert len(found) < 200
    assert ngram_join.among(docs, chosen.limit(0)).count() == 0
    assert ngram_join.among(docs.limit(0), chosen).count() == 0


def test_sketches_differ_by_no_more_than_the_sets():
    """Also those of sizes of two widths; the bound is close where sets differ as little as linked ones."""
    rng = np.random.default_rng(5)
    for size, more in ((1, 1), (60, 9), (500, 24), (1000, 60), (4000, 900)):
        grams = np.unique(rng.integers(0, 1 << 63, size + more).astype(np.uint64))
        some, other = grams[:size], grams[more // 3:]
        a, b = (np.frombuffer(ngram_join.sketch(x), np.uint8)[None] for x in (some, other))
        while a.shape != b.shape:
            a, b = (ngram_join.narrowed(x) if x.shape[1] == max(a.shape[1], b.shape[1]) else x for x in (a, b))
        apart = len(np.setxor1d(some, other))
        assert 0.8 * apart <= np.bitwise_count(a ^ b).sum() <= apart


def test_line_dedup_with_clashing_columns_repeats_and_no_rows(spark):
    """Names of added columns replace those of the input; rows with the same id and text are one document."""
    line = prose(60, 5).replace("\n", " ")
    given = [(1, line, "x", 9), (1, line, "x", 9), (2, f"a\n{line}", "y", 8), (3, f"{line}\nb\n{line}", None, 7), (4, None, "z", 6)]
    df = spark.createDataFrame(given, "doc_id long, text string, Removed_Lines string, n_lines int")
    out = line_dedup.dedup(df)
    assert out.columns == ["doc_id", "text", "removed_lines", "n_lines"]
    assert order(tuple(r) for r in out.collect()) == order(
        [(1, line, 0, 1), (1, line, 0, 1), (2, "a", 1, 2), (3, "b", 2, 3), (4, None, 0, 0)])
    assert line_dedup.dedup(df.limit(0)).collect() == []


def test_line_dedup(spark):
    passage = "\n".join(prose(30, s) for s in (1, 2))
    given = [(1, f"first\n{passage}\nlast"), (2, f"other\n\n{passage}\ntail"), (3, prose(49, 5)), (4, prose(49, 5)), (5, None), (6, "")]
    df = spark.createDataFrame([(*r, 7) for r in given], "doc_id long, text string, removed int")
    out = {r.doc_id: (r.text, r.removed_lines) for r in line_dedup.dedup(df).collect()}
    assert out == {1: (given[0][1], 0), 2: ("other\n\ntail", 2), 3: (given[2][1], 0), 4: (given[3][1], 0), 5: (None, 0), 6: ("", 0)}


def test_decontamination(spark):
    item = prose(30, 77)
    changed = item.replace("a", "o", 4)
    given = [(1, f"{prose(40, 1)} {item} {prose(40, 2)}"), (2, f"{prose(3, 3)}\n{changed.upper()}"), (3, prose(200, 4)), (4, None),
             (None, item), (6, "a short one b")]
    items = spark.createDataFrame([(1, item), (2, "Short one"), (3, None), (4, "")], "item_id long, text string")
    found = decontamination.leaks(spark.createDataFrame(given, "doc_id long, text string"), items).collect()
    assert order((r.doc_id, r.item_id) for r in found) == order([(1, 1), (2, 1), (None, 1), (6, 2)])


def test_decontamination_recall_at_a_twentieth_of_edits():
    rng, hit, walks = np.random.default_rng(5), 0, decontamination.Walks(48)
    for k in range(150):
        item = np.frombuffer(prose(22, 1000 + k).encode(), np.uint8)
        text = item.copy()
        text[rng.choice(len(text), len(text) // 20, replace=False)] = 120
        a, b = (walks.keys(x, np.arange(0, len(x) - 47, s)) for x, s in ((item, 1), (np.concatenate([item[:rng.integers(1, 60)], text]), 34)))
        hit += bool(np.isin(b, a).any())
    assert hit / 150 >= 0.95


def with_edits(item, count, rng):
    """As many random bytes inserted, removed or replaced."""
    out = list(item)
    for _ in range(count):
        at, new = int(rng.integers(len(out))), int(rng.integers(97, 123))
        out[at:at + 1] = ([new, out[at]], [], [new])[int(rng.integers(3))]
    return bytes(out)


@pytest.mark.parametrize("length", [32, 50, 81, 162, 324])
def test_decontamination_recall_at_the_most_edits(length):
    """Inserted, removed and replaced bytes, as many as are accepted, in items of all lengths."""
    width, stride = decontamination.windows(length)
    rng, hit, walks = np.random.default_rng(6), 0, decontamination.Walks(width)
    for k in range(100):
        item = prose(80, 2000 + k).encode()[:length]
        text = bytes(rng.integers(97, 123, int(rng.integers(stride)), dtype=np.uint8)) + with_edits(item, length // 10, rng) + b"x" * 60
        a, b = (walks.keys(np.frombuffer(x, np.uint8), np.arange(0, len(x) - width + 1, s)) for x, s in ((item, 1), (text, stride)))
        hit += any(np.isin(x, y).any() for x, y in zip(a, b))
    assert hit / 100 >= 0.9


def test_decontamination_of_short_and_long_items_with_edits(spark):
    """Short items miss no copy within the accepted distance, and copies with too many edits or parts of items are no match."""
    rng = np.random.default_rng(7)
    items = {i: prose(60, 3000 + i)[:n].strip() for i, n in enumerate((9, 10, 14, 19, 20, 25, 31, 400))}
    given = [(100 * i + k, f"{k} 0 " * 15 + with_edits(t.encode(), len(t) // 10, rng).decode() + " 1 0" * 9)
             for i, t in items.items() for k in range(12)]
    given += [(9000, items[6][:22] + " 0 0 0"), (9001, "".join(c + "0" * (j % 2) for j, c in enumerate(items[6])))]
    found = decontamination.leaks(spark.createDataFrame(given, "doc_id long, text string"),
                                  spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    expected = {(i, item) for i, t in given for item, x in items.items()
                if decontamination.distance(x.encode(), t.encode()) <= len(x) // 10}
    assert {(r.doc_id, r.item_id) for r in found} == expected and len(expected) >= 96


def test_pii_base_spans(spark):
    given = [(1, "é a@b.c 😀 +1 (234) 555-1234, 1.2.3.4.5.6.7.8 300.1.1.1"), (2, "4111 1111 1111 1111 and 4111 1111 1111 1112"),
             (3, None), (4, ""), (5, "x.y@a-b.c.d_e@f.g.h"), (6, "1" * 20000 + "a" * 20000 + "@")]
    out = {r.doc_id: r for r in pii.digest(pii.find(spark.createDataFrame(given, "doc_id long, text string"))).collect()}
    assert out[1].spans == "email:2:7,phone:10:27,ip:29:36,ip:37:44"
    assert (out[2].n_card, out[5].n_email, out[6].n_card, out[3].spans) == (1, 2, 0, "")
    assert out[4].base_sha256 == hashlib.sha256(b"").hexdigest()


def labelled(spark, bad):
    rows = [(i, prose(60, i) + (bad if i % 3 == 0 else ""), "s", "en") for i in range(150)] + [(900, None, None, None), (901, "", "s", "en")]
    return (spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"),
            spark.createDataFrame([(i, int(i % 3 == 0), int(i % 3 != 0)) for i in range(150)], "doc_id long, toxic int, quality int"))


def test_toxicity_held_out(spark):
    docs, labels = labelled(spark, " you stupid grumblewort idiot")
    out = toxicity.scores(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in out)
    held = [(r.predicted, int(r.doc_id % 3 == 0)) for r in out if r.held_out and r.doc_id < 150]
    assert len(out) == 152 and sum(a == b for a, b in held) / len(held) > 0.9


def test_quality(spark):
    docs, labels = labelled(spark, " &&&$$$" * 40)
    out = {r.doc_id: r.quality_kept for r in quality.scored(docs, labels).collect()}
    assert len(out) == 152 and sum(out[i] == (i % 3 != 0) for i in range(150)) > 140
    none = quality.scored(docs, labels.where("false")).collect()
    assert len(none) == 152 and all(r.quality_kept for r in none)


def test_language(spark):
    """Texts of two vocabularies; markup decides where the text says nothing, and rows without anything still get a row."""
    words = {"aa": "kaleni morut sivapo dareth", "bb": "quixo bremza fjolt gryndu"}
    rng = np.random.default_rng(8)
    known = [(i, " ".join(rng.choice(words[lang].split(), 30)), lang) for i, lang in enumerate(["aa", "bb"] * 40)]
    docs = spark.createDataFrame([*known, (100, None, None), (101, "", "aa"), (None, "quixo bremza", "bb"), (0, *known[0][1:])],
                                 "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "kind": F.lit("clash")})
    pages = spark.createDataFrame([(1, "http://a.example/x", f"<html lang='aa'><p>{known[0][1]}</p></html>"), (2, None, None),
                                   (3, "http://a.example/y", f"<html><p>{known[1][1]}</p></html>")],
                                  "page_id long, url string, html string")
    rows = language.of_documents(docs).unionByName(language.of_pages(pages))
    found = language.identify(rows, docs.select("doc_id", F.col("lang").alias("label"), "text")).collect()
    assert len(found) == docs.count() + 3 and all(0 <= r.posterior <= 1 for r in found)
    by = {r.id: r.lang for r in found if r.kind == "document"}
    assert all(by[i] == lang for i, _, lang in known) and by[None] == "bb"
    assert {r.id: r.lang for r in found if r.kind == "page" and r.id != 2} == {1: "aa", 3: "bb"}
    nothing = language.identify(rows.limit(0), docs.select("doc_id", F.col("lang").alias("label"), "text"))
    assert nothing.collect() == []
    unlabelled = language.identify(rows, docs.select("doc_id", F.lit(None).cast("string").alias("label"), "text")).collect()
    assert len(unlabelled) == len(found) and {(r.lang, r.posterior) for r in unlabelled} == {(None, None)}


def test_pieces_encoded_together_have_the_ids_of_each():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    pieces = ["", " ", " a", "a", "a\nb", " x\t", "\tx", " a b", " \x1cx", "'s", " 's", " )", ".\n", "\n", "\n\n", "<|endoftext|>", " été",
              " 12", " 中文", "́", *(f" word{i}" for i in range(100))]
    encode = token_files.Encoder(tokenizer)
    alone = [np.array(tokenizer.encode(x, add_special_tokens=False).ids, np.int32).tobytes() for x in pieces]
    assert encode(pieces) == alone
    encode.end = [-1]  # line ends that can't be found: one by one
    assert encode(pieces) == alone


def test_words_at_line_ends_are_encoded_once():
    known, lines = token_files.pieces(P.path("byte_bpe_50k.json"))
    asked = []

    def encode(pieces):
        asked.extend(pieces.to_pylist())
        return known.encode(pieces)

    memo, tk = tokens.Columns(encode), library()
    texts = [f"{a} {b}.\n{a}, {b}\n{b} {a}" for a in WORDS for b in WORDS]
    assert tokens.ids_of(pa.array(texts), memo, lines).to_pylist() == [tk.encode_ordinary(t) for t in texts]
    assert sorted(asked) == sorted([*WORDS, *(" " + w for w in WORDS), "\n", ".", ","])
    assert tokens.ids_of(pa.array(texts[::-1]), memo, lines).to_pylist() == [tk.encode_ordinary(t) for t in texts[::-1]]
    assert len(asked) == 2 * len(WORDS) + 3  # nothing new


@pytest.mark.parametrize("kept", [30, 10_000])
def test_ids_of_odd_texts_are_those_of_the_library(kept):
    known, lines = token_files.pieces(P.path("byte_bpe_50k.json"))
    memo, tk, draw = tokens.Columns(known.encode, kept), library(), np.random.default_rng(kept)
    atoms = ["a", "Word", "été", "ß", " ", "  ", "\n", "\n\n", " \n", "\n ", "\r\n", "\t", "\x85", "\xa0", "\u2028", "\x1c", ".", "...", "'", "'s", "12",
             "中文", "\u0301", "ʰ", "ª", "Привет", "<|endoftext|>", "\x00", "😀", "_", "x.\nY", "x" * 70]
    for k in range(60):
        some = atoms + ["\x01", "\x01\n"] * (k % 6 == 0)
        rows = ["".join(draw.choice(some) + draw.choice(["", " ", "\n"]) for _ in range(draw.integers(0, 14))) for _ in range(20)]
        assert tokens.ids_of(pa.array(["cut\noff", *rows]).slice(1), memo, lines).to_pylist() == [tk.encode_ordinary(t) for t in rows]
    assert len(memo.known[0]) + len(memo.older[0]) <= 2 * kept


def test_bpe_recursion_keeps_each_word_once():
    tables = bpe.codec(RANKS, P.PATTERN)
    words = [" therefore", "x", " Überraschung", "aaaaaaaaaaaaaaaa", " the"]
    raw = [w.encode() for w in words]
    begin = {"word": pa.array(range(len(words)), pa.int32()),
             "tokens": pa.array([[tables.ranks[bytes([b])] for b in w] for w in raw], pa.list_(pa.int32()))}
    held = tables.query(bpe.ENCODE.rstrip().replace("SELECT tokens FROM state ORDER BY word", "SELECT count(*) AS n FROM state"), "begin", begin)
    assert held.column_names == ["n"] and held.column("n").to_pylist() == [len(words)]
    found = tables.query(bpe.ENCODE, "begin", begin).column("tokens").to_pylist()
    assert found == [bpe.contract([tables.ranks[bytes([b])] for b in w], tables.ranks, w) for w in raw]


def test_texts_are_not_shuffled_to_meet_the_shares_of_their_sites(spark):
    folder = "/root/testdata/sf0.001"
    rows, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.good(rows, labels)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in found and "Exchange hashpartitioning" not in found


WAITING = """
import re
import pyarrow as pa
import pyarrow.compute
from assaykit.llm.common import mapped

class Rows:
    def mapInArrow(self, run, schema):
        return run

def anonymous():
    with open("/proc/self/smaps_rollup") as lines:
        return int(re.search(r"Pss_Anon:\\s+(\\d+)", lines.read())[1]) / 1024

def batches():
    for _ in range(3):
        yield pa.RecordBatch.from_arrays([pyarrow.compute.binary_repeat(pa.array(["word "] * 8000), 1000)], names=["text"])

left = []

def work(part):
    texts = part.column("text").to_pylist()
    left.append(bytearray(3000))  # above the texts, so that their room is not at the heap's end
    return pa.RecordBatch.from_arrays([pa.array([len(x) for x in texts])], names=["length"])

run = mapped(Rows(), work, "length long", limit=64 << 20)
for _ in run(iter([pa.RecordBatch.from_pydict({"text": ["x"]})])):
    pass
before = anonymous()
rows = sum(out.num_rows for out in run(batches()))
out = None
print(rows, anonymous() - before)
"""


def test_a_worker_that_waits_holds_no_memory_of_its_last_batches():
    found = subprocess.run([sys.executable, "-c", WAITING], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, check=True)
    rows, more = found.stdout.split()
    assert int(rows) == 24_000 and float(more) < 5  # MB
