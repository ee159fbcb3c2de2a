"""Toxicity by boosted trees over dense features of whole texts, calibrated by isotonic regression.

Features are densities of a general lexicon and of one learned from labelled texts, hits near words of the second person,
capitals, punctuation, and rates of obfuscation. Labels are learned only from rows whose crc32(doc_id as text) is not
divisible by five, by that remainder: 1 and 2 give the learned lexicon (words and beginnings of words that stand in toxic
texts much more often), 3 the trees, 4 the calibration. So what a step learns is judged on texts that the step before has not
seen. At most ``most`` labelled rows are used. No id, label, language or source is a feature.

Null texts are empty ones and get a score too, rows that repeat get the same one, a null id is not held out, other columns
are left out. Without labels of both kinds in a fold the score is the share of toxic labels that are known, 0 if there are none.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm import boosted
from assaykit.llm.common import mapped, slices, sums, texts, words_of
from assaykit.session import stored

MOST = 12_000
LEXICON = ("asshole bastard bitch bullshit clown crap cretin cunt damn dick disgusting dumb dumbass fag failure filth fool "
           "freak fuck fucking garbage hate hell idiot ignorant imbecile jerk kill liar loser lunatic moron nazi parasite "
           "pathetic pig psycho rat retard scum shit slut stupid suck sucks trash ugly useless vermin vile whore worthless "
           "idiota imbécil estúpido basura asco perdedor mierda puta cabrón inútil payaso "
           "idiot dummkopf arschloch scheiße abschaum blöd verlierer widerlich nutzlos hure "
           "idiote imbécile stupide connard salope merde ordure raté nul débile clown pourriture").split()
SECOND_PERSON = ("you your yours yourself u ur you're youre du dich dir dein deine deiner ihr euch euer sie tu te toi ton ta tes "
                 "vous votre vos usted ustedes tú ti tus vosotros vuestro").split()
NEAR = 5
BEGINNINGS = (4, 5, 6)
FEATURES = ("words", "general", "learned", "weight", "strongest", "hits", "near", "capitals", "shouted", "bangs", "symbols",
            "obfuscated", "drawn")
AROUND = ".,;:!?\"'()[]{}<>*&%$#|/\\-_=+~`“”„«»¡¿…"


def plain_words(words: pa.Array) -> pa.Array:
    return pc.utf8_trim(pc.utf8_lower(words), characters=AROUND)


def weights(plain: pa.Array, lexicon: dict[str, float]) -> np.ndarray:
    """The largest weight of each word or of one of its beginnings (written with a trailing asterisk)."""
    out = np.zeros(len(plain))
    named, worth = pa.array(list(lexicon), pa.string()), np.append(np.array(list(lexicon.values()), float), 0.0)
    for n in (0, *BEGINNINGS):
        term = pc.binary_join_element_wise(pc.utf8_slice_codeunits(plain, 0, n), "*", "") if n else plain
        out = np.maximum(out, worth[pc.fill_null(pc.index_in(term, value_set=named), len(lexicon)).to_numpy(zero_copy_only=False)])
    return out


def features(column: pa.Array, lexicon: dict[str, float]) -> list[np.ndarray]:
    """Values of FEATURES of each text."""
    codes, words, offsets = words_of(column)
    plain = plain_words(words)
    as_float = lambda x: x.to_numpy(zero_copy_only=False).astype(float)
    full = as_float(pc.greater(pc.utf8_length(words), 0))
    leet = pc.utf8_lower(words)
    for sign, letter in ("0o", "1i", "3e", "4a", "5s", "7t", "@a", "$s"):
        leet = pc.replace_substring(leet, sign, letter)
    leet = pc.replace_substring_regex(leet, r"[^\p{L}]", "")
    general = pa.array(LEXICON)
    hit = as_float(pc.is_in(plain, value_set=general))
    hidden = np.maximum(0, as_float(pc.is_in(leet, value_set=general)) - hit)
    worth = weights(plain, lexicon)
    marked = as_float(pc.match_substring_regex(words, r"\p{L}[0-9@$*]+\p{L}"))
    drawn = as_float(pc.match_substring_regex(pc.utf8_lower(words), "|".join(3 * c for c in "abcdefghijklmnopqrstuvwxyz")))
    count = sums(full[codes], offsets)
    n = np.maximum(count, 1)
    bad = (np.maximum(hit, hidden) + (worth > 0))[codes] > 0
    you = np.flatnonzero(as_float(pc.is_in(plain, value_set=pa.array(SECOND_PERSON)))[codes] > 0)
    near = np.zeros(len(codes))
    at = np.flatnonzero(bad)
    if len(at) and len(you):
        text = np.searchsorted(offsets, np.arange(len(codes)), side="right")
        i = np.searchsorted(you, at)
        for other in (you[np.minimum(i, len(you) - 1)], you[np.maximum(i - 1, 0)]):
            near[at] = np.maximum(near[at], (np.abs(other - at) <= NEAR) & (text[other] == text[at]))
    strongest = np.zeros(len(count))
    has = offsets[1:] > offsets[:-1]
    if len(codes):
        strongest[has] = np.maximum.reduceat(worth[codes], offsets[:-1][has])
    rate = lambda x: sums(x[codes], offsets) / n
    return [np.log1p(count), 100 * rate(np.maximum(hit, hidden)), 100 * rate((worth > 0).astype(float)), 100 * rate(worth), strongest,
            sums(bad.astype(float), offsets), sums(near, offsets) / n * 100,
            rate(as_float(pc.utf8_is_upper(words))), rate(as_float(pc.match_substring(words, "!!"))),
            rate(as_float(pc.count_substring(words, "!"))), rate(as_float(pc.count_substring_regex(words, r"[^\p{L}\p{N}]"))),
            rate(np.maximum(marked, hidden)), rate(drawn)]


def with_features(docs: DataFrame, lexicon: dict[str, float], kept: str) -> DataFrame:
    """The columns of ``kept`` (a schema) and FEATURES."""
    names = [c.split()[0] for c in kept.split(", ")]

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        values = features(part.column("text"), lexicon)
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *(pa.array(v, pa.float64()) for v in values)],
                                          names=[*names, *FEATURES])
    return mapped(docs, work, f"{kept}, {', '.join(f'{f} double' for f in FEATURES)}")


def fold(doc_id: str | Column = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id), F.lit(5))


def learned(rows: DataFrame, most: int = 400) -> dict[str, float]:
    """Words and beginnings of words with their weights: the ``most`` surest signs of a toxic text."""
    def run(batches):
        counts = (Counter(), Counter())
        for part in slices(batches, "text"):
            codes, words, offsets = words_of(part.column("text"))
            plain = plain_words(words).to_pylist()
            for i, label in enumerate(part.column("label").to_pylist()):
                own = {plain[c] for c in np.unique(codes[offsets[i]:offsets[i + 1]]).tolist()}
                own = {w for w in own if len(w) > 2}
                counts[int(label > 0.5)].update(own | {f"{w[:n]}*" for w in own for n in BEGINNINGS if len(w) >= n})
        terms = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([counts[1][t] for t in terms], pa.int64()),
                                          pa.array([counts[0][t] for t in terms], pa.int64())], names=["term", "toxic", "clean"])
    totals = rows.agg(F.sum("label"), F.count("*")).first()
    toxic, clean = float(totals[0] or 0), float(totals[1] - (totals[0] or 0))
    if not toxic or not clean:
        return {}
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    sure = odds - 2 * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    found = (rows.select("label", "text").mapInArrow(run, "term string, toxic long, clean long").groupBy("term")
             .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("toxic >= 3")
             .select("term", odds.alias("odds"), sure.alias("sure")).where(F.col("sure") > 0.7)
             .orderBy(F.desc("sure"), "term").limit(most))
    return {r.term: r.odds for r in found.collect()}


def scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    docs = texts(docs, id_col, text_col)
    known = boosted.sampled(labels.where(fold(F.col(id_col).cast("string")) != 0), label, most, id_col)
    # at most ``most`` ids, so they may be sent everywhere
    rows = stored(docs.join(F.broadcast(known), "doc_id").withColumn("fold", fold()), "labelled")
    lexicon = learned(rows.where("fold in (1, 2)"))
    held = stored(with_features(rows.where("fold in (3, 4)").select("label", "fold", "text"), lexicon, "label double, fold long"),
                  "labelled-features")
    trees = boosted.fit(held.where("fold = 3"), FEATURES)
    raw = boosted.probability(trees, lambda i: F.col(FEATURES[i]))
    judged = held.where("fold = 4").select(raw.alias("raw"), "label")
    if trees and judged.agg(F.count_distinct("label")).first()[0] > 1:
        # a little of the raw score keeps the order within a step of the calibration
        score = 0.99 * boosted.calibrated(F.col("raw"), boosted.calibration(judged)) + 0.01 * F.col("raw")
    elif trees:
        score = F.col("raw")
    else:
        score = F.lit(float(rows.agg(F.avg("label")).first()[0] or 0.0))
    return (with_features(docs, lexicon, "doc_id long").select("doc_id", raw.alias("raw"))
            .select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), score.alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
