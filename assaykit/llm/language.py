"""Language of texts and pages by Bayesian fusion of their text, declared language, address suffix and host.

* Text: log-likelihood of its hashed three-byte groups under each language, learned from at most ``most`` labelled documents and
  tempered, as neighbouring groups are not independent. The prior belongs to the sites, not to the text.
* Declared language (markup): P(declared | language), counted over all rows by the languages that the texts suggest, smoothed.
* Address: the host's share of each language, smoothed towards that of its suffix, and that towards the corpus. Shares are sums of
  the texts' probabilities by grouped aggregation over all rows.

A null text is an empty one: it has no likelihood of its own and follows its other evidence. A missing declaration is a value of
its own. A null host is a host of its own; a host without a dot is its own suffix. Repeated rows get the same result. Without labels
no language is known and there are no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import flat, importable, mapped, slices
from assaykit.session import stored

MOST = 4_000
#: Hash values of three-byte groups: the model has so many numbers a language, whatever the texts.
BUCKETS = 1 << 15
#: Weight of a group's log-likelihood.
TEMPER = 0.1
#: Rows that the prior of a host or suffix counts as, and smoothing of declarations.
HOST_PRIOR, SUFFIX_PRIOR, DECLARED_PRIOR = 20.0, 50.0, 1.0


def groups(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the three bytes from each byte on, and where each text's begin. The last two of a text reach into the next."""
    column = flat(column)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[:len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    b = (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[offsets[0]:offsets[-1]].astype(np.uint32)
    b = np.where((b >= 65) & (b <= 90), b + 32, b)
    padded = np.concatenate([b, np.full(2, 32, np.uint32)])
    codes = (padded[:-2] << 16 | padded[1:-1] << 8 | padded[2:]) * np.uint32(2654435761) >> np.uint32(17)
    return codes.astype(np.int64), offsets - offsets[0]


def model(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and log-probability of each group (row) in each of them (column). Takes label and text."""
    def run(batches):
        for part in slices(batches, "text"):
            codes, offsets = groups(part.column("text"))
            named = part.column("label").dictionary_encode()
            which = np.repeat(named.indices.to_numpy(), np.diff(offsets))
            counts = np.bincount(which * BUCKETS + codes, minlength=len(named.dictionary) * BUCKETS)
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([named.dictionary.take(pa.array(at // BUCKETS)), pa.array((at % BUCKETS).astype(np.int32)),
                                              pa.array(counts[at], pa.int64())], names=["label", "bucket", "n"])
    counted = (labelled.select("label", "text").mapInArrow(run, "label string, bucket int, n long")
               .groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas())  # at most BUCKETS rows a language
    languages = sorted(counted.label.unique())
    table = np.full((BUCKETS, len(languages)), 0.5)
    table[counted.bucket, [languages.index(x) for x in counted.label]] += counted.n
    return languages, np.log(table / table.sum(axis=0)).astype(np.float32)


def likelihoods(rows: DataFrame, table: np.ndarray, kept: str) -> DataFrame:
    """The columns of ``kept`` (a schema) and ``text_p``: the share of each language that the text alone suggests."""
    names = [c.split()[0] for c in kept.split(", ")]

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        codes, offsets = groups(part.column("text"))
        out = np.empty((len(offsets) - 1, table.shape[1]))
        for k in range(table.shape[1]):
            total = np.concatenate([[0.0], np.cumsum(table[codes, k], dtype=np.float64)])
            out[:, k] = TEMPER * (total[offsets[1:]] - total[offsets[:-1]])
        p = np.exp(np.maximum(out - out.max(axis=1, keepdims=True), -30))
        p /= p.sum(axis=1, keepdims=True)
        lists = pa.ListArray.from_arrays(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1], pa.array(p.ravel()))
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in names), lists], names=[*names, "text_p"])
    return mapped(rows, work, f"{kept}, text_p array<double>")


def total(of: str, count: int) -> Column:
    """Sum of a column of arrays, element by element."""
    return F.array(*(F.sum(F.col(of)[i]) for i in range(count)))


def shrunk(own: str, prior: Column, size: float) -> Column:
    """Shares of the sums ``own``, smoothed towards ``prior`` (shares)."""
    n = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(own, prior, lambda x, p: (x + size * p) / (n + size))


def identify(rows: DataFrame, labelled: DataFrame, most: int = MOST) -> DataFrame:
    """id columns, lang and posterior of every row of (kind, id, text, declared, host).

    ``labelled`` has doc_id, label and text. Where it has no label at all, lang and posterior are null.
    """
    importable(rows.sparkSession)
    known = labelled.where("label is not null").orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id").limit(most).distinct()
    sample = labelled.where("label is not null").join(F.broadcast(known), "doc_id")  # at most ``most`` ids
    languages, table = model(sample.select("label", F.coalesce("text", F.lit("")).alias("text")))
    count = len(languages)
    if not count:
        return rows.select("kind", "id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("posterior"))
    rows = rows.select("kind", "id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("declared", F.lit("")).alias("declared"),
                       F.coalesce("host", F.lit("")).alias("host"))
    judged = stored(likelihoods(rows, table, "kind string, id long, declared string, host string"), "judged")
    suffix = F.substring_index("host", ".", -1)
    hosts = stored(judged.groupBy("host").agg(total("text_p", count).alias("own")).withColumn("suffix", suffix), "hosts")
    suffixes = hosts.groupBy("suffix").agg(total("own", count).alias("of_suffix"))
    corpus = hosts.agg(total("own", count)).first()[0]
    known_rows = corpus is not None and corpus[0] is not None
    share = F.array(*(F.lit(float(x / sum(corpus)) if known_rows else 1.0 / count) for x in (corpus if known_rows else range(count))))
    hosts = (hosts.join(suffixes.select("suffix", shrunk("of_suffix", share, SUFFIX_PRIOR).alias("suffix_p")), "suffix")
             .select("host", shrunk("own", F.col("suffix_p"), HOST_PRIOR).alias("host_p")))
    said = judged.groupBy("declared").agg(total("text_p", count).alias("own"))
    said = stored(said, "declared")
    values = max(1, said.count())
    sums = said.agg(total("own", count)).first()[0]
    sums = [float(x or 0.0) for x in sums]
    said = said.select("declared", F.zip_with("own", F.array(*map(F.lit, sums)), lambda x, n: (x + DECLARED_PRIOR / values)
                                              / (n + DECLARED_PRIOR)).alias("declared_p"))
    fused = F.zip_with(F.zip_with("text_p", "host_p", lambda a, b: a * b), "declared_p", lambda a, b: a * b)
    best = F.array_max("fused")
    names = F.array(*map(F.lit, languages))
    return (judged.join(hosts, "host").join(said, "declared").withColumn("fused", fused)
            .select("kind", "id", names[(F.array_position("fused", best) - 1).cast("int")].alias("lang"),
                    (best / F.aggregate("fused", F.lit(0.0), lambda a, x: a + x)).alias("posterior")))


def of_documents(docs: DataFrame) -> DataFrame:
    """Rows for ``identify`` from documents: nothing is declared, the source is the host."""
    return docs.select(F.lit("document").alias("kind"), F.col("doc_id").cast("long").alias("id"), "text",
                       F.lit(None).cast("string").alias("declared"), F.col("source").alias("host"))


def of_pages(pages: DataFrame) -> DataFrame:
    """Rows for ``identify`` from raw pages: the lang attribute of the markup, the host of the address, text without markup."""
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*+>", " ")
    declared = F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1))
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return pages.select(F.lit("page").alias("kind"), F.col("page_id").cast("long").alias("id"), text.alias("text"),
                        declared.alias("declared"), host.alias("host"))
