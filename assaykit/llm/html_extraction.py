"""Main text of web pages: a linear-chain conditional random field labels their leaf blocks as main text or not.

A page is read once into its leaf blocks (``html_blocks``). Features of a block are the elements and the words of class, id and role
around it, its own element, and its text: number of words, share of links, punctuation. Neighbours are joined by transition
weights, which keeps a short paragraph between long ones. Weights maximise the likelihood of labelled pages (forward-backward,
gradient ascent with a quadratic penalty); Viterbi finds each page's best labelling. Scripts, styles, comments and elements that are not
shown are no blocks.

``trained`` fits weights to labelled pages of a table (html and its main text, at most ``MOST`` of them, of at most
``LONGEST`` characters and ``MOST_BLOCKS`` blocks each); without
them ``html_layouts`` is used, which is the same everywhere. A model is a table of some hundred weights that goes to the tasks.

Character references are decoded, white space within a block becomes one space, ``br`` is white space. Main blocks are joined by line
breaks, nothing is cut. Null and empty pages have an empty text. Every row gives a row, also if repeated; null ids and urls stay null,
other columns are left out, an empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm import html_layouts
from assaykit.llm.common import importable, mapped
from assaykit.llm.html_blocks import BITS, HINTS, Block, Page

#: Labelled pages to train on, the longest of them in characters and in blocks; layouts made where none are given.
MOST, LONGEST, MOST_BLOCKS, LAYOUTS = 500, 100_000, 300, 400
STEPS, PENALTY, RATE = 300, 0.01, 0.1
CONTAINER = BITS["<article>"] | BITS["<main>"]
#: Surroundings that speak for main text, and those that say nothing; all others speak against it.
FOR = sum(BITS[h] for h in "<article> <main> article blog body content entry main post story text".split())
NEITHER = sum(BITS[h] for h in "<blockquote> <details> <dl> <figure> <header> <li> <ol> <section> <table> <ul> caption page".split())
AGAINST = sum(BITS.values()) - FOR - NEITHER
#: Names of features, by number.
OWN = tuple("""address aside blockquote body button dd div dt figcaption footer form h1 h2 h3 h4 h5 h6 header label legend li main nav
option p pre section article td th other""".split())
LENGTHS = (1, 2, 4, 8, 16, 32, 64)
NAMES = (*(f"within {h}" for h in HINTS), "outside the container", "only for main text", "for and against", "only against", *(f"is {t}" for t in OWN), *(f"words below {2 * n}" for n in LENGTHS),
         "many words", "no link", "some link", "mostly link", "all link", "ends a sentence", "has a comma", "has a sign of rights", "always")
NUMBER = {name: i for i, name in enumerate(NAMES)}


class Model(NamedTuple):
    weights: np.ndarray  # of features, for main text against the rest
    steps: np.ndarray  # [label before, label]
    first: np.ndarray


def surroundings(around: int, contained: bool) -> list[int]:
    found = [i for i in range(len(HINTS)) if around >> i & 1]
    if contained and not around & CONTAINER:
        found.append(NUMBER["outside the container"])
    if around & FOR:
        found.append(NUMBER["for and against" if around & AGAINST else "only for main text"])
    elif around & AGAINST:
        found.append(NUMBER["only against"])
    return found


def features(block: Block) -> list[int]:
    """Numbers of the features that do not depend on the surroundings."""
    text, words = block.text, block.text.count(" ") + 1
    k = next((i for i, n in enumerate(LENGTHS) if words < 2 * n), len(LENGTHS))
    share = block.linked / len(text)
    link = 0 if not share else 1 if share < 0.34 else 2 if share < 0.9 else 3
    found = [NUMBER["is other"] if block.tag not in OWN else NUMBER[f"is {block.tag}"], NUMBER["words below 2"] + k,
             NUMBER["no link"] + link, NUMBER["always"]]
    if text[-1] in ".!?…。！？":
        found.append(NUMBER["ends a sentence"])
    if "," in text:
        found.append(NUMBER["has a comma"])
    if "©" in text or "®" in text:
        found.append(NUMBER["has a sign of rights"])
    return found


def contained(blocks: list[Block]) -> bool:
    """Whether the page has an element for its main text at all."""
    return any(b.around & CONTAINER for b in blocks)


def fit(labelled: list[tuple[str, str]]) -> Model:
    """Weights of largest penalised likelihood for pages (html, main text). A block whose text is a line of the main text is main."""
    rows, owners, labels, sizes = [], [], [], []
    for source, text in labelled:
        blocks, lines = Page(source).blocks, set(text.split("\n"))
        if blocks and len(blocks) <= MOST_BLOCKS:
            inside = contained(blocks)
            for b in blocks:
                found = surroundings(b.around, inside) + features(b)
                rows += found
                owners += [len(labels)] * len(found)
                labels.append(b.text in lines)
            sizes.append(len(blocks))
    model = Model(np.zeros(len(NAMES)), np.zeros((2, 2)), np.zeros(2))
    if not sizes:
        return model
    rows, owners, sizes = np.array(rows), np.array(owners), np.array(sizes)
    page, at = np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes])
    gold = np.zeros((len(sizes), sizes.max()), np.int64)
    gold[page, at] = labels
    there = np.arange(sizes.max()) < sizes[:, None]
    values = np.zeros(len(NAMES) + 6)
    moment, square = np.zeros_like(values), np.zeros_like(values)
    for step in range(1, STEPS + 1):
        model = Model(values[:-6], values[-6:-2].reshape(2, 2), values[-2:])
        emission = np.zeros((*gold.shape, 2))
        emission[page, at, 1] = np.bincount(owners, model.weights[rows], len(page))
        single, pairs = marginals(emission, model, there)
        error = gold[page, at] - single[page, at, 1]
        both = there[:, 1:]
        seen = np.bincount((2 * gold[:, :-1] + gold[:, 1:])[both], minlength=4)
        slope = np.concatenate([np.bincount(rows, error[owners], len(NAMES)), seen - pairs.ravel(),
                                np.bincount(gold[:, 0], minlength=2) - single[:, 0].sum(axis=0)]) - PENALTY * values * len(sizes) ** 0.5
        moment, square = 0.9 * moment + 0.1 * slope, 0.999 * square + 0.001 * slope ** 2
        values = values + RATE * (moment / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)
    return Model(values[:-6], values[-6:-2].reshape(2, 2), values[-2:])


def marginals(emission: np.ndarray, model: Model, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over pages side by side: P(label) of each block, and expected numbers of each pair of neighbours."""
    def log_sum(x: np.ndarray) -> np.ndarray:
        top = x.max(axis=1, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=1, keepdims=True)))[:, 0]

    pages, longest, _ = emission.shape
    ahead, back = np.zeros_like(emission), np.zeros_like(emission)
    ahead[:, 0] = model.first + emission[:, 0]
    for k in range(1, longest):
        ahead[:, k] = np.where(there[:, k, None], log_sum(ahead[:, k - 1, :, None] + model.steps) + emission[:, k], ahead[:, k - 1])
    for k in range(longest - 2, -1, -1):
        after = (model.steps[None] + (emission[:, k + 1] + back[:, k + 1])[:, None]).swapaxes(1, 2)
        back[:, k] = np.where(there[:, k + 1, None], log_sum(after), 0)
    total = log_sum(ahead[:, -1][:, :, None])
    single = np.exp(ahead + back - total[:, None]) * there[..., None]
    joint = ahead[:, :-1, :, None] + model.steps + (emission + back)[:, 1:, None, :] - total[:, None, None]
    return single, (np.exp(np.where(there[:, 1:, None, None], joint, -np.inf))).sum(axis=(0, 1))


def labelling(scores: list[float], model: Model) -> list[bool]:
    """Viterbi: the best sequence of labels for the blocks' scores."""
    (rest_rest, rest_main), (main_rest, main_main) = model.steps.tolist()
    rest, main = model.first[0], model.first[1] + scores[0]
    came: list[tuple[bool, bool]] = []
    for s in scores[1:]:
        to_rest, to_main = main + main_rest > rest + rest_rest, main + main_main > rest + rest_main
        came.append((to_rest, to_main))
        rest, main = (main + main_rest if to_rest else rest + rest_rest), s + (main + main_main if to_main else rest + rest_main)
    out = [main > rest]
    for to_rest, to_main in reversed(came):
        out.append(to_main if out[-1] else to_rest)
    return out[::-1]


class Labeller:
    """Main text of pages by one model; scores of surroundings seen before are remembered."""

    def __init__(self, model: Model):
        self.model, self.weights, self.known = model, model.weights.tolist(), {}

    def around(self, bits: int, inside: bool) -> float:
        score = self.known.get((bits, inside))
        if score is None:
            if len(self.known) > 50_000:
                self.known.clear()
            score = self.known[bits, inside] = sum(self.weights[i] for i in surroundings(bits, inside))
        return score

    def __call__(self, source: str | None) -> str:
        blocks = Page(source).blocks if source else []
        if not blocks:
            return ""
        inside = contained(blocks)
        scores = [self.around(b.around, inside) + sum(self.weights[i] for i in features(b)) for b in blocks]
        return "\n".join(b.text for b, main in zip(blocks, labelling(scores, self.model)) if main)


@lru_cache(1)
def default_model() -> Model:
    return fit(html_layouts.pages(LAYOUTS))


def trained(labelled: DataFrame, most: int = MOST, html_col: str = "html", text_col: str = "text") -> Model:
    """A model of labelled pages: at most ``most`` different ones, chosen by their hash, reach the driver."""
    rows = (labelled.select(F.col(html_col).alias("html"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
            .where(F.length("html").between(1, LONGEST) & (F.length("text") <= LONGEST)).distinct()
            .orderBy(F.xxhash64("html", "text"), "html", "text").limit(most))
    return fit([(r.html, r.text) for r in rows.collect()])


def extract(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    importable(pages.sparkSession)
    model = model or default_model()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        main = Labeller(model)
        texts = [main(source) for source in batch.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                                           pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])
    return mapped(rows, work, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long", by="html")
