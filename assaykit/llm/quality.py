"""Quality of documents: a classifier's evidence combined with posteriors of their host and path.

The classifier (boosted trees over shape features of whole texts, fitted on at most ``most`` labelled rows) gives each document
a probability. Grouped aggregation over all documents gives each host, and each path of a host, the share of good documents.
Shares are shrunk as in empirical Bayes: a path towards its host, a host towards the corpus, with the strength of a beta prior that
the spread between sites suggests; a sparse site stays close to the prior, a large one speaks for itself. A document's posterior
odds are the odds of its path times the likelihood ratio of its own evidence.

Null and empty texts have the features of an empty text; null hosts and paths form sites of their own; rows that repeat get the
same score. Without labels of both kinds all documents are kept with the known share, or 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.llm import boosted
from assaykit.llm.common import importable, mapped, sums, texts, words_of
from assaykit.session import stored

MOST = 12_000
FEATURES = ("words", "length", "different", "again", "capitals", "symbols", "glued", "bars", "bangs", "digits", "stops", "lines",
            "repeated_lines", "short")
#: Text worked on at once, in bytes; it bounds the memory of a task.
TEXT_BYTES = 1 << 20
#: Probabilities are kept this far from 0 and 1.
EDGE = 1e-4


def features(column: pa.Array) -> list[np.ndarray]:
    """Values of FEATURES of each text."""
    codes, words, offsets = words_of(column)
    as_float = lambda x: x.to_numpy(zero_copy_only=False).astype(float)
    length = as_float(pc.utf8_length(words))
    count = sums((length > 0).astype(float)[codes], offsets)
    n = np.maximum(count, 1)
    rate = lambda x: sums(x[codes], offsets) / n
    again = np.zeros(len(codes))
    again[1:] = codes[1:] == codes[:-1]
    lines, repeated, different = [], [], []
    for i, text in enumerate(column.to_pylist()):
        own = [x for x in text.split("\n") if x]
        lines.append(len(own))
        repeated.append(1 - len(set(own)) / len(own) if own else 0.0)
        different.append(len(np.unique(codes[offsets[i]:offsets[i + 1]])))
    return [np.log1p(count), rate(length), np.array(different, float) / n ** 0.75, sums(again, offsets) / n,
            rate(as_float(pc.utf8_is_upper(words))), rate(as_float(pc.count_substring_regex(words, r"[^\p{L}\p{N}]"))),
            rate(as_float(pc.match_substring_regex(words, r"[\p{L}\p{N}][^\p{L}\p{N}\s]{2,}$"))),
            rate(as_float(pc.match_substring_regex(words, r"^[^\p{L}\p{N}]+$"))), rate(as_float(pc.count_substring(words, "!"))),
            rate(as_float(pc.count_substring_regex(words, "[0-9]"))), rate(as_float(pc.match_substring_regex(words, r"[.?!]$"))),
            np.array(lines, float) / n, np.array(repeated), rate((length <= 2).astype(float))]


def evidence(docs: DataFrame, trees: list, text_col: str) -> DataFrame:
    """All columns, and _p: the classifier's probability that the document is good."""
    names = list(docs.columns)

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        values = features(pc.fill_null(part.column(text_col), ""))
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.StructArray.from_arrays(
            [pa.array(v, pa.float64()) for v in values], list(FEATURES))], names=[*names, "_f"])

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]
                          + [T.StructField("_f", T.StructType([T.StructField(f, T.DoubleType()) for f in FEATURES]))])
    p = boosted.probability(trees, lambda i: F.col("_f")[FEATURES[i]])
    return (mapped(docs, work, schema, by=text_col, limit=TEXT_BYTES)
            .withColumn("_p", F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), p))).drop("_f"))


def classifier(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str, text_col: str) -> tuple[list, float | None]:
    """Trees, and the share of good documents among the sampled labels."""
    known = boosted.sampled(labels, label, most)

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column("label"), *(pa.array(v, pa.float64()) for v in features(part.column("text")))],
                                          names=["label", *FEATURES])

    rows = texts(docs, id_col, text_col).join(F.broadcast(known), "doc_id").select("label", "text")  # at most ``most`` ids
    held = stored(mapped(rows, work, f"label double, {', '.join(f'{f} double' for f in FEATURES)}", limit=TEXT_BYTES), "labelled-features")
    share = held.agg(F.avg("label")).first()[0]
    return boosted.fit(held, FEATURES, rounds=20), share


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def strength(share: float, spread: float) -> float:
    """Size of the beta prior that makes shares of sites spread by that variance, within reason."""
    return float(min(1e4, max(2.0, share * (1 - share) / max(spread, 1e-6) - 1)))


def sites(judged: DataFrame, host: Column, path: Column) -> DataFrame:
    """_host, _path and _site: the posterior share of good documents of each path."""
    paths = stored(judged.groupBy(host.alias("_host"), path.alias("_path"))
                   .agg(F.count("*").alias("n"), F.sum("_p").alias("good")), "paths")
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = hosts.agg(F.sum("good") / F.sum("n"), F.sum("n")).first()
    share = float(total[0] if total[0] is not None else 0.5)

    def spread(groups: DataFrame, centre: Column) -> float:
        """Variance between shares beyond what sampling explains."""
        rate = F.col("good") / F.col("n")
        got = groups.agg(F.sum(F.col("n") * (rate - centre) ** 2) / F.sum("n"), F.count("*") / F.sum("n")).first()
        return float((got[0] or 0.0) - share * (1 - share) * float(got[1] or 0.0))

    a = strength(share, spread(hosts, F.lit(share)))
    hosts = hosts.select("_host", ((F.col("good") + a * share) / (F.col("n") + a)).alias("host_share"))
    both = paths.join(hosts, paths["_host"].eqNullSafe(hosts["_host"])).drop(hosts["_host"])
    b = strength(share, spread(both, F.col("host_share")))
    return both.select("_host", "_path", ((F.col("good") + b * F.col("host_share")) / (F.col("n") + b)).alias("_site"))


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST, id_col: str = "doc_id", text_col: str = "text",
           host_col: str = "source", path_col: str = "lang", threshold: float = 0.5) -> DataFrame:
    """All columns, and quality_evidence, quality_site, quality_score and quality_kept."""
    importable(docs.sparkSession)
    trees, share = classifier(docs, labels, label, most, id_col, text_col)
    if not trees:
        known = F.lit(float(share if share is not None else 1.0))
        return docs.select("*", known.alias("quality_evidence"), known.alias("quality_site"), known.alias("quality_score"),
                           F.lit(True).alias("quality_kept"))
    judged = evidence(docs, trees, text_col)
    # its size is known then, so that few sites are broadcast and texts are not shuffled
    posterior = stored(sites(judged, judged[host_col], judged[path_col]), "sites")
    share = min(1 - EDGE, max(EDGE, share))
    joined = judged.join(posterior, judged[host_col].eqNullSafe(posterior["_host"]) & judged[path_col].eqNullSafe(posterior["_path"]))
    site = F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), F.col("_site")))
    score = 1 / (1 + F.exp(-(logit(F.col("_p")) - logit(F.lit(share)) + logit(site))))
    return (joined.withColumn("quality_evidence", F.col("_p")).withColumn("quality_site", F.col("_site"))
            .withColumn("quality_score", score).withColumn("quality_kept", F.col("quality_score") >= threshold)
            .drop("_p", "_host", "_path", "_site"))


def good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are kept; all columns stay."""
    return scored(docs, labels, **options).where("quality_kept").select(*docs.columns)
