"""Page extraction, whitening and ranked search against brute force and known results, with awkward rows."""

import math
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from assaykit.llm import html_extraction, html_layouts, lexical_search, whitening
from assaykit.llm.html_blocks import Page
from assaykit.session import workspace

# Pages ---------------------------------------------------------------------------------------------------------------


def texts_of(source):
    return [b.text for b in Page(source).blocks]


@pytest.mark.parametrize("source, blocks", [
    ("<p>a<p>b <b>c</b>d&amp;e &#x41;&nbsp;<br>z", ["a", "b cd&e A z"]),
    ("<ul><li>x<ul><li>y</ul><li>w</ul>tail", ["x", "y", "w", "tail"]),
    ("<table><tr><td>a<td>b<p>c</div><tr><td>d</table>e", ["a", "b", "c", "d", "e"]),
    ("x<script>var a='</p>';x<b</script>y<!-- <p>no --> j < k <", ["xy j < k <"]),
    ("<p title=\"a>b\" don't>q</p><head><title>t</title>zz</head><noscript>n</noscript>l", ["q", "l"]),
    ("a&am<p>&ampx &unknown; &copy", ["a&am", "&x &unknown; ©"]),
    ("<p>open <a href=x>link<p class='", ["open link"]), ("", []), ("<nav", []), ("< <<", ["< <<"]), ("\x00 \n", ["\x00"])])
def test_leaf_blocks(source, blocks):
    assert texts_of(source) == blocks


@pytest.mark.parametrize("piece", ["<", "<a ", "<p x=", "<!--", "<b><p>", "</ ", "<td>", "<p a='", "&", "<div>", "<p = ", "<ul><li>", "<script>"])
def test_odd_pages_take_time_in_proportion(piece):
    import time

    def seconds(n):
        best = []
        for _ in range(3):
            begin = time.process_time()
            Page(piece * n + "</section></td>" * (n // 2))
            best.append(time.process_time() - begin)
        return min(best)
    assert seconds(40_000) < 30 * max(seconds(4_000), 0.004)


def test_held_out_layouts():
    main, wrong, lines = html_extraction.Labeller(html_extraction.default_model()), 0, 0
    for source, text in html_layouts.pages(200, seed=1234):
        found, wanted = Counter(main(source).split("\n")), Counter(text.split("\n"))
        wrong, lines = wrong + sum((found - wanted).values()) + sum((wanted - found).values()), lines + sum(wanted.values())
    assert wrong <= 0.02 * lines


def test_marginals_and_viterbi_against_all_labellings():
    random = np.random.default_rng(5)
    model = html_extraction.Model(np.zeros(0), random.normal(size=(2, 2)), random.normal(size=2))
    scores = random.normal(size=7) * 2
    every = [[k >> i & 1 for i in range(7)] for k in range(128)]

    def value(x):
        return model.first[x[0]] + sum(s for s, y in zip(scores, x) if y) + sum(model.steps[a, b] for a, b in zip(x, x[1:]))
    weights = np.exp([value(x) for x in every])
    emission = np.zeros((2, 9, 2))
    emission[:, :7, 1] = scores
    there = np.array([[True] * 7 + [False] * 2] * 2)
    single, pairs = html_extraction.marginals(emission, model, there)
    assert np.allclose(single[1, :7, 1], [sum(w for w, x in zip(weights, every) if x[i]) / weights.sum() for i in range(7)])
    assert np.allclose(single[:, 7:], 0)
    wanted = np.zeros((2, 2))
    for w, x in zip(weights, every):
        for a, b in zip(x, x[1:]):
            wanted[a, b] += 2 * w / weights.sum()
    assert np.allclose(pairs, wanted)
    best = max(every, key=value)
    assert html_extraction.labelling(scores.tolist(), model) == [bool(y) for y in best]


PAGE = """<html><head><title>T</title><script>x("</p>")</script></head><body><header><nav><ul><li><a href=/a>Home</a></li></ul></nav></header>
<div class="cookie-notice">We use cookies, as everyone does.</div><article><h1>The   title</h1><p>First &amp; foremost<br>text.</p>
<div class="ad">Buy this now, it is cheap.</div><p>Short.</p><form><label>Mail</label><button>Go</button></form>
<section id="comments"><h2>Comments</h2><p>I do not agree with a word of this, sorry.</p></section></article>
<aside class="sidebar"><p>Other stories, of which there are many.</p></aside><footer>&copy; Us</footer></body></html>"""


def test_extract(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, None, ""), (3, "v", "<article>" + "<p>Word after word. " * 20_000)]
    pages = spark.createDataFrame([(*r, "x", 0) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    found = html_extraction.extract(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted(map(tuple, found.collect()), key=str)
    main = "The title\nFirst & foremost text.\nShort."
    long = "\n".join(["Word after word."] * 20_000)
    assert found == sorted([(1, "u", main, len(main))] * 2 + [(None, None, "", 0), (2, None, "", 0), (3, "v", long, len(long))], key=str)
    assert html_extraction.extract(pages.where("false")).collect() == []


def test_model_of_labelled_pages(spark):
    labelled = spark.createDataFrame(html_layouts.pages(80, seed=3) + [(None, None), ("", ""), ("<p>x", None)], "html string, text string")
    main = html_extraction.Labeller(html_extraction.trained(labelled, most=60))
    assert main("<nav><a href=/>Menu</a></nav><article><p>Some words here.</p></article>") == "Some words here."
    nothing = html_extraction.trained(labelled.where("false"))
    assert not nothing.weights.any()


# Vectors -------------------------------------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, -1) for i, v in rows], "vec_id long, embedding array<float>, n int")


def checked(found, rows):
    """Against integers in Python and numpy's eigenvectors; returns the rows by id and component."""
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in rows], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    cov = np.array(n * x.T.dot(x) - np.outer(sums, sums), float) / n ** 2
    values, basis = np.linalg.eigh(cov)
    by = {}
    for r in found:
        by.setdefault(r.component, []).append(r)
        assert r.n == n and abs(r.identity_error) < 1e-9
    for k, own in by.items():
        share = values[::-1][k - 1] / values.sum()
        assert all(abs(r.explained - share) < 1e-9 for r in own)
        assert sorted(r.deviation for r in own) == sorted(int(((n * y - sums) ** 2).sum()) for y in x)
    return by, (np.array(x - sums / n, float) @ basis[:, ::-1]) / np.sqrt(np.maximum(values[::-1], 1e-300))


def test_whitening_equals_numpy(spark):
    random = np.random.default_rng(2)
    rows = [(i, (random.normal(size=12) * np.arange(1, 13) / 20).tolist()) for i in range(300)]
    odd = [(900, None), (901, [None] + [0.0] * 11), (902, [math.nan] + [0.0] * 11), (903, [math.inf] * 12), (904, [1.0, 2.0]), (905, [])]
    found = whitening.whitened(vectors(spark, rows + odd)).collect()
    assert len(found) == 300 * 8
    by, wanted = checked(found, rows)
    for k, own in by.items():
        own = np.array([r.whitened for r in sorted(own, key=lambda r: r.vec_id)])
        assert min(abs(own - wanted[:, k - 1]).max(), abs(own + wanted[:, k - 1]).max()) < 1e-9


def test_equal_eigenvalues_repeated_rows_and_null_ids(spark):
    rows = [(None if i == 0 else i, [float(s) if j == i else 0.0 for j in range(3)]) for i in range(3) for s in (1, -1)] * 4
    found = whitening.whitened(vectors(spark, rows)).collect()
    assert len(found) == 24 * 3 and sum(r.vec_id is None for r in found) == 24
    checked(found, rows)


def test_components_without_variance(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0]) for i in range(6)]
    found = whitening.whitened(vectors(spark, rows)).collect()
    assert {(r.component, r.whitened is None, r.explained) for r in found} == {(1, False, 1.0), (2, True, 0.0), (3, True, 0.0)}
    one = whitening.whitened(vectors(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r.whitened, r.explained, r.deviation, r.identity_error) for r in one] == [(None, None, 0, None)] * 2
    assert whitening.whitened(vectors(spark, [(1, None)])).collect() == []
    assert whitening.whitened(vectors(spark, [])).collect() == []


def exact_polynomial(matrix):
    """Faddeev and LeVerrier's recurrence in fractions."""
    d = len(matrix)
    a, m, out = np.array(matrix, dtype=object), np.zeros((d, d), dtype=object), [1]
    for k in range(1, d + 1):
        m = a.dot(m) + np.array([[out[-1] if i == j else 0 for j in range(d)] for i in range(d)], dtype=object)
        out.append(Fraction(-sum(a.dot(m)[i, i] for i in range(d)), k))
    return out


@pytest.mark.parametrize("kind", ["any", "diagonal", "blocks"])
def test_characteristic_polynomial(spark, kind):
    y = np.random.default_rng(4).integers(-50, 50, (9, 7)).astype(object)
    matrix = y.T.dot(y)
    if kind == "diagonal":
        matrix = np.diag(np.array([5, 5, 5, 3, 0, 0, 2], dtype=object))
    elif kind == "blocks":
        matrix[:3, 3:] = matrix[3:, :3] = 0
    poly = whitening.characteristic_polynomial(spark.range(1), matrix.tolist())
    assert poly == exact_polynomial(matrix.tolist())
    roots = whitening.largest_roots(poly, 7)
    found = [r / 2 ** bits for r, bits, copies in roots for _ in range(copies)]
    assert np.allclose(found, np.linalg.eigvalsh(matrix.astype(float))[::-1], atol=1e-6)


def test_products_of_large_integers():
    y = np.array([[1 << 39, -3], [(1 << 39) - 1, 5]])
    assert whitening.products(y).tolist() == [[(1 << 78) + ((1 << 39) - 1) ** 2, -3 * (1 << 39) + 5 * ((1 << 39) - 1)],
                                             [-3 * (1 << 39) + 5 * ((1 << 39) - 1), 34]]


# Search --------------------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORDS = "Oak ash ELM fir yew box bay fig plum pear été Été 7 日本 x1".split()


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, most=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        weights = {t: q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t, q in Counter(terms(text)).items() if df[t]}
        scored = []
        for doc, c, n in counts:
            m = 100 - 75 + 75 * n * n_docs // n_terms
            score = sum(w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t, w in weights.items() if t in c)
            if score > 0:
                scored.append((-score, doc is not None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scored)[:most], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def library(spark):
    random = np.random.default_rng(8)
    docs = [(i, " ".join(random.choice(WORDS, random.integers(1, 40)))) for i in range(150)]
    docs += [(None, "oak ash"), (None, None), (500, ""), (501, " .,\x00\x7f"), (502, "oak" + "-oak" * 30_000), (503, "Oak_ash"), (503, "Oak_ash"),
             (-4, "yew,yew")] + [(600 + i, "plum pear fig") for i in range(40)]
    items = [(0, "oak Ash oak?"), (0, "oak Ash oak?"), (1, "été ÉTÉ 日本"), (None, "plum"), (2, ""), (3, None), (4, "nowhere"), (5, " ".join(WORDS * 2))]
    return docs, items


def frames(spark, docs, items):
    return (spark.createDataFrame([(*d, 1, "c") for d in docs], "doc_id long, text string, m int, terms string"),
            spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, rank int"))


def test_search_equals_brute_force(spark, library):
    docs, items = frames(spark, *library)
    path = workspace(spark, "search")
    lexical_search.build(docs, path)
    assert sorted(map(tuple, lexical_search.search(spark, path, items).collect()), key=str) == brute(*library)
    assert sorted(map(tuple, lexical_search.search(spark, path, items, most=3).collect()), key=str) == brute(*library, most=3)
    assert lexical_search.search(spark, path, items.where("false")).collect() == []


def test_salted_strata_and_blocks_of_items(spark, library, monkeypatch):
    monkeypatch.setattr(lexical_search, "POSTINGS", 4)
    monkeypatch.setattr(lexical_search, "PAIRS", 2)
    docs, items = frames(spark, *library)
    path = workspace(spark, "search")
    lexical_search.build(docs.repartition(3), path)
    assert sorted(map(tuple, lexical_search.search(spark, path, items).collect()), key=str) == brute(*library)


def test_search_of_nothing(spark, library):
    docs, items = frames(spark, *library)
    path = workspace(spark, "search")
    lexical_search.build(docs.where("text is null"), path)
    assert lexical_search.search(spark, path, items).collect() == []


def test_pruned_visits_lose_nothing(library, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lexical_search, "POSTINGS", 12)
    docs = [(i, t or "") for i, t in library[0]]
    found = lexical_search.vectors_of(pa.array([t for _, t in docs]))
    rows = [(25 + n % 7, i, t.tobytes(), f.tobytes()) for (i, _), (n, t, f) in zip(docs, found) if n]
    rows.sort(key=lambda r: (r[0], str(r[1])))
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["m", "doc_id", "terms", "tfs"])
    index = [b.to_pylist()[0] for b in lexical_search.blocks(iter([batch]))]
    assert len(index) > 20 and sum(b["size"] for b in index) == len(rows)

    class Row:
        item_id, copies = 1, 1
    row = Row()
    _, t, f = lexical_search.vectors_of(pa.array(["oak ash yew 7 plum"]))[0]
    row.terms, row.tfs = t.tobytes(), f.tobytes()
    items = lexical_search.Items([row])
    items.weights = np.arange(1, 6) * 1000
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    strata = [lexical_search.Stratum(b, items) for b in index]
    visited = []
    monkeypatch.setattr(lexical_search.Stratum, "scores", lambda s, *a, f=lexical_search.Stratum.scores: visited.append(s) or f(s, *a))
    lexical_search.visit(strata, items, best, 5)
    pruned = len(visited)
    every = sorted(((-int(x), int(d)) for s in strata for d, x in zip(s.docs, s.scores(items, 0)) if x))
    assert [(-int(x), int(d)) for d, x in zip(*best[0])] == every[:5]
    assert pruned < len(strata)
    assert all(s.scores(items, 0).max(initial=0) <= s.bounds[0] for s in strata)
