"""One pass that counts rows, repeated rows and the rows of any number of predicates."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions.values import holds, ref
from assaykit.session import stored

ROWS = "total_rows"
REPEATS = "repeated_rows"
COPIES = "__copies"
MASK_BITS = 62

# How rows are told apart when repeated rows are counted.
ROW, EXACT, DIGEST, NONE = "row", "exact", "digest", "none"
DIGESTS = ["__digest_0", "__digest_1"]


def distinct_rows(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Each different row once with its number of copies. Nulls equal each other.

    Copies are merged before the shuffle, so one row with very many copies costs one record per
    task and not one task for all of them.
    """
    return df.groupBy(*[ref(c) for c in [*by, *columns]]).agg(F.count(F.lit(1)).alias(COPIES))


def _row_digest(columns: Sequence[str]) -> list[Column]:
    """Two 64-bit hashes. The hash skips nulls, so their positions are hashed as text first."""
    nulls = F.concat(*[F.when(ref(c).isNull(), "1").otherwise("0") for c in columns])
    return [
        F.xxhash64(F.lit(seed), nulls, *[ref(c) for c in columns]).alias(f"__digest_{i}")
        for i, seed in enumerate(("first", "second"))
    ]


def _distinct_digests(
    df: DataFrame, columns: Sequence[str], predicates: Mapping[str, Column], by: Sequence[str]
) -> tuple[DataFrame, dict[str, Column]]:
    """Rows reduced to a digest and their predicates as bits, grouped with the number of copies."""
    names = list(predicates)
    digests = _row_digest(columns)
    masks = []
    for start in range(0, len(names), MASK_BITS):
        bits = [
            F.shiftleft(predicates[n].cast("bigint"), i)
            for i, n in enumerate(names[start:start + MASK_BITS])
        ]
        mask = bits[0]
        for bit in bits[1:]:
            mask = mask + bit
        masks.append(mask.alias(f"__mask_{start // MASK_BITS}"))
    keys = [*[ref(c) for c in by], *digests, *masks]
    slim = df.select(*keys)
    grouped = slim.groupBy(*slim.columns).agg(F.count(F.lit(1)).alias(COPIES))
    flags = {
        n: F.col(f"__mask_{i // MASK_BITS}").bitwiseAND(F.lit(1 << (i % MASK_BITS)).cast("bigint")) != 0
        for i, n in enumerate(names)
    }
    return grouped, flags


def _weighted(grouped: DataFrame, predicates: Mapping[str, Column], keys: Sequence[Column], repeats: Column) -> DataFrame:
    """Counts over rows that stand for ``COPIES`` equal ones."""
    copies, zero = F.col(COPIES), F.lit(0).cast("bigint")
    return grouped.groupBy(*keys).agg(
        F.coalesce(F.sum(copies), zero).alias(ROWS),
        F.coalesce(F.sum(repeats), zero).alias(REPEATS),
        *[F.coalesce(F.sum(F.when(p, copies).otherwise(zero)), zero).alias(n) for n, p in predicates.items()],
    )


def _exactly(df: DataFrame, columns: Sequence[str], predicates: Mapping[str, Column], by: Sequence[str],
             stage: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Counts from digests; rows are compared in full only where a digest occurs more than once.

    The first pass shuffles digests and writes the counts together with the digests that repeat. Equal rows have equal
    digests, so the other rows are different from all rows. The second pass fetches the rows with a repeated digest by a semi join,
    which Spark broadcasts if its written size allows, and groups those by all columns. Without repeated digests there is none.
    """
    keys, names = [ref(c) for c in by], list(predicates)
    grouped, flags = _distinct_digests(df, columns, predicates, by)
    counts = _weighted(grouped, flags, keys, F.lit(0).cast("bigint"))
    repeated = grouped.filter(F.col(COPIES) > 1).select(*DIGESTS)
    both = stage(counts.unionByName(repeated, True), "digest-counts")
    counts = both.filter(F.col(ROWS).isNotNull()).select(*keys, ROWS, REPEATS, *map(ref, names))
    repeated = both.filter(F.col(DIGESTS[0]).isNotNull()).select(*DIGESTS)
    if repeated.isEmpty():
        return counts
    rows = df.select("*", *_row_digest(columns)).join(repeated, DIGESTS, "left_semi")
    found = distinct_rows(rows, columns, by).filter(F.col(COPIES) > 1).groupBy(*keys).agg(
        F.sum(F.col(COPIES) - 1).alias(REPEATS))
    merged = counts.unionByName(found, True).groupBy(*keys)
    return merged.agg(F.max(ROWS).alias(ROWS), F.sum(REPEATS).alias(REPEATS), *[F.max(ref(n)).alias(n) for n in names])


def measure(
    df: DataFrame,
    columns: Sequence[str],
    predicates: Mapping[str, Column],
    by: Sequence[str] = (),
    row_key: str = ROW,
    stage: Callable[[DataFrame, str], DataFrame] = stored,
) -> DataFrame:
    """One row per ``by`` group: total rows, repeated rows, and one count per predicate.

    ``row_key``:

    * ``exact``: exact, and the default of all jobs. One scan and one shuffle of about 40 bytes per different row; only rows whose
      digest occurs more than once are read again and shuffled whole. The first pass runs at once; ``stage`` writes its
      counts. For tables in files, where a second scan costs less than a shuffle of every column.
    * ``row``: exact and lazy, for frames that are expensive to work out twice. One scan and one shuffle of the different
      rows at their full width; predicates are evaluated on the different rows and weighted with the number of copies.
    * ``digest``: one scan and one shuffle of about 40 bytes per different row, whatever the width
      of the table. Predicate counts stay exact; two rows count as copies when 128 hash bits agree.
    * ``none``: no shuffle of rows at all, and no count of repeated rows.
    """
    predicates = {n: holds(p) for n, p in predicates.items()}
    keys = [ref(c) for c in by]
    if row_key == NONE:
        return df.groupBy(*keys).agg(
            F.count(F.lit(1)).alias(ROWS),
            F.lit(None).cast("bigint").alias(REPEATS),
            *[F.count_if(p).alias(n) for n, p in predicates.items()],
        )
    if row_key == EXACT:
        return _exactly(df, columns, predicates, by, stage)
    if row_key == ROW:
        grouped = distinct_rows(df, columns, by)
    elif row_key == DIGEST:
        grouped, predicates = _distinct_digests(df, columns, predicates, by)
    else:
        raise ValueError(f"unknown row_key {row_key!r}")
    return _weighted(grouped, predicates, keys, F.col(COPIES) - 1)
