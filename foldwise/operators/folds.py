"""Multilabel-stratified k-fold assignment, one-hot labels and fold balance.

Design (replaces the sequential iterative-stratification loop):

1. Order rows by (label vector, seeded hash of the id). Inside a label vector
   the order is a seeded shuffle.
2. The global rank ``r`` in that order is computed without a global window:
   counts per (seed, label vector, hash sub-bucket) give exclusive offsets
   (``exclusive_offsets``); a window partitioned by the same key numbers the
   rows inside it. The sub-bucket is a prefix of the hash, so it keeps the
   order and splits a hot label vector over up to 16**k keys.
3. Consecutive ranks form blocks of ``n_folds`` rows; block ``b`` sends its
   rows to folds ``(r + shift(seed, b)) mod n_folds`` -- a seeded rotation, so
   each block spreads over all folds and different seeds give different
   partitions.

Fold sizes differ by at most one; each label value is spread over the folds
like a systematic sample of the sorted labels.

Inputs: targets take few distinct values (scores on a grid, as the one-hot
stratification implies); bin continuous targets (``bin_width``) -- the offset windows
are bounded by the number of distinct values of one target and of label
vectors sharing a first target. The input is read more than once (counts and
rows), so pass a scan or a materialised table rather than an expensive
lineage such as a Python step. The payload columns travel
through the one row-level shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.config import N_FOLDS, TARGETS
from foldwise.functions.hashing import hex_prefix_int, seeded_key
from foldwise.operators.ranking import exclusive_offsets, positions

NULL_KEY = float("-inf")  # a null label sorts first, as NULLS FIRST does


def _with_seeds(df: DataFrame, seeds, seed_col: str) -> DataFrame:
    if seed_col in df.columns:
        return df
    seeds = [int(s) for s in seeds]
    if len(seeds) == 1:
        return df.withColumn(seed_col, F.lit(seeds[0]))
    return df.withColumn(seed_col, F.explode(F.array(*[F.lit(s) for s in seeds])))


def label_key(t: str, bin_width: float | None = None) -> Column:
    """A target's value as a non-null key (null sorts first), on a grid if asked."""
    v = F.col(t).cast("double")
    if bin_width:
        v = F.floor(v / F.lit(float(bin_width))).cast("double")
    return F.coalesce(v, F.lit(NULL_KEY))


def seeded_row_hash(df: DataFrame, seed_col: str, id_col: str) -> Column:
    """``md5(seed:id)``. Rows without an id come first; among themselves they
    are ordered by all columns of ``df``, so those that differ in any are
    spread over sub-buckets too (equal ones may change places)."""
    columns = F.xxhash64(*[F.col(c) for c in df.columns if c != seed_col])
    unnamed = F.concat(F.lit("!"), seeded_key(F.col(seed_col), F.lit("null"), columns))
    return F.coalesce(seeded_key(F.col(seed_col), F.col(id_col)), unnamed)


def assign_folds(df: DataFrame, seeds: Sequence[int] = (42,), n_folds: int = N_FOLDS,
                 targets: Sequence[str] = TARGETS, id_col: str = "text_id", seed_col: str = "seed",
                 fold_col: str = "fold", bucket_hex_digits: int = 3, bin_width: float | None = None,
                 quantile_bins: int | None = None) -> DataFrame:
    """Rows x seeds with ``seed`` and ``fold`` (INT, 0..n_folds-1) added.

    If ``df`` already has a ``seed`` column it is used instead of ``seeds``.
    Every row is kept, also without an id. An id that occurs twice under one
    seed with equal labels fails the job (its rows meet in the numbering
    window); callers with wide rows fold the narrow columns and join the
    rest. ``bin_width`` stratifies continuous targets
    on the grid ``floor(t / bin_width)`` (the target columns are unchanged);
    ``quantile_bins`` does so on that many bins of about equal size per target,
    for any number of distinct values (``quantile_folds``).
    """
    if quantile_bins:
        return quantile_folds(df, seeds, n_folds, targets, id_col, seed_col, fold_col, quantile_bins)
    targets = list(targets)
    x = _with_seeds(df, seeds, seed_col)
    kcols = [f"_k{i}" for i in range(len(targets))]
    x = x.withColumns({k: label_key(t, bin_width) for k, t in zip(kcols, targets)})
    # non-null keys: every level table then derives from one identical
    # coarse-count subtree, which Spark computes once and reuses
    x = x.withColumn("_h", seeded_row_hash(df, seed_col, id_col))
    x = x.withColumn("_b", F.coalesce(F.substring("_h", 1, bucket_hex_digits), F.lit("")))
    key = [seed_col, *kcols, "_b"]

    coarse = x.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    levels = [[kcols[0]]] + ([kcols[1:]] if len(kcols) > 1 else []) + [["_b"]]
    offsets = exclusive_offsets(coarse, [seed_col], levels, count_col="_n", out_col="_off").drop("_n")

    w = Window.partitionBy(*key).orderBy("_h", id_col)
    twice = F.col(id_col).isNotNull() & (F.lag(id_col).over(w) == F.col(id_col))
    said = F.concat(F.lit(f"duplicate {id_col}: "), F.col(id_col).cast("string"))
    number = F.when(twice, F.raise_error(said).cast("int")).otherwise(F.row_number().over(w))
    ranked = x.withColumn("_rn", number).join(offsets, key)
    r = F.col("_off") + F.col("_rn") - F.lit(1)
    return ranked.withColumn(fold_col, _dealt(r, seed_col, n_folds)).drop(*kcols, "_h", "_b", "_rn", "_off")


#: relative rank error of the quantile sketches is 1 / ACCURACY
ACCURACY = 10_000


def quantile_bounds(df: DataFrame, targets: Sequence[str] = TARGETS, bins: int = 32) -> dict[str, list[float]]:
    """Up to ``bins - 1`` ascending bounds per target from mergeable quantile
    sketches: every task sketches its rows, sketches of fixed size are merged,
    and only the bounds reach the driver. All targets in one pass."""
    shares = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(F.col(t).cast("double"), shares, ACCURACY).alias(t) for t in targets]).first()
    return {t: sorted(set(row[t] or [])) for t in targets}


def quantile_key(t: str, bounds: Sequence[float]) -> Column:
    """The bin of a value: how many bounds lie below it; -1 for a null."""
    v = F.col(t).cast("double")
    below = F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: b < v)) if bounds else F.lit(0)
    return F.when(v.isNull(), F.lit(-1)).otherwise(below)


def quantile_folds(df: DataFrame, seeds: Sequence[int] = (42,), n_folds: int = N_FOLDS,
                   targets: Sequence[str] = TARGETS, id_col: str = "text_id", seed_col: str = "seed",
                   fold_col: str = "fold", bins: int = 32) -> DataFrame:
    """``assign_folds`` for continuous targets: rows ordered by their bins and
    the seeded hash of the id, consecutive ranks dealt to the folds.

    Labels may be as many as rows, so nothing is numbered per label vector:
    ranks come from one range partitioning (``ranking.positions``), whose only
    window is over a row per range partition. Every row is kept, also without
    an id; an id that occurs twice under one seed counts as two rows.
    """
    targets = list(targets)
    bounds = quantile_bounds(df, targets, bins)
    x = _with_seeds(df, seeds, seed_col)
    keys = [f"_k{i}" for i in range(len(targets))]
    x = x.withColumns({k: quantile_key(t, bounds[t]) for k, t in zip(keys, targets)})
    x = x.withColumn("_h", seeded_row_hash(df, seed_col, id_col))
    ranked = positions(x, [seed_col], [*keys, "_h", id_col], name="_r")
    return ranked.withColumn(fold_col, _dealt(F.col("_r"), seed_col, n_folds)).drop(*keys, "_h", "_r")


def _dealt(r: Column, seed_col: str, n_folds: int) -> Column:
    """Fold of global rank ``r``: every block of ``n_folds`` ranks is dealt to
    all folds, rotated by a seeded amount."""
    blk = F.floor(r / F.lit(n_folds)).cast("bigint")
    shift = hex_prefix_int(seeded_key(F.col(seed_col), F.lit("blk"), blk))
    return F.pmod(r + shift, F.lit(n_folds)).cast("int")


#: one-hot labels make a column per value; beyond this many the target is no
#: label but a measurement
MAX_LABEL_VALUES = 1000


def label_domain(df: DataFrame, targets: Sequence[str] = TARGETS) -> dict[str, list[float]]:
    """Distinct non-null values of each target; an error if the targets have
    more than ``MAX_LABEL_VALUES`` together."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), F.col(t).cast("double").alias("v")) for t in targets])).alias("x"))
    rows = long.select("x.t", "x.v").where(F.col("v").isNotNull()).distinct().limit(MAX_LABEL_VALUES + 1).collect()
    if len(rows) > MAX_LABEL_VALUES:
        raise ValueError(f"the targets have more than {MAX_LABEL_VALUES} distinct values: bin them first")
    dom: dict[str, list[float]] = {t: [] for t in targets}
    for r in rows:
        dom[r["t"]].append(r["v"])
    return {t: sorted(v) for t, v in dom.items()}


def one_hot_name(target: str, value: float) -> str:
    """Column name of one one-hot value: ``cohesion_3_5`` for 3.5 (no dot, so
    the name needs no quoting in Spark)."""
    return f"{target}_{value!r}".replace(".", "_")


def one_hot_labels(df: DataFrame, targets: Sequence[str] = TARGETS, id_col: str = "text_id",
                   domain: dict[str, list[float]] | None = None) -> DataFrame:
    """One 0/1 INT column ``<target>_<value>`` (``cohesion_1_0``) per distinct value of each target.

    A null target gives zeros in all of its columns. The domain is read from
    the data when not given (a small aggregate, not the rows).
    """
    domain = domain or label_domain(df, targets)
    cols = [F.col(id_col)]
    for t in targets:
        for v in domain[t]:
            cols.append(F.when(F.col(t).cast("double") == F.lit(v), 1).otherwise(0).cast("int").alias(one_hot_name(t, v)))
    return df.select(*cols)


def label_dictionary(df: DataFrame, targets: Sequence[str] = TARGETS) -> DataFrame:
    """(target, value, place): every distinct non-null value of every target
    with its place, from 0, in the order of its rows (most first, smaller value
    first among equals). Distributed: counts by partial aggregation, places by
    range partitioning, nothing collected."""
    values = _long_labels(df, targets, []).where(F.col("value").isNotNull())
    counts = values.groupBy("target", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("_less", -F.col("n"))
    return positions(counts, ["target"], ["_less", "value"], name="place").drop("_less", "n")


def _long_labels(df: DataFrame, targets: Sequence[str], keep: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("value")) for t in targets])
    return df.select(*keep, F.explode(pairs).alias("_x")).select(*keep, "_x.target", "_x.value")


def sparse_labels(df: DataFrame, targets: Sequence[str] = TARGETS, id_col: str = "text_id",
                  dictionary: DataFrame | None = None) -> DataFrame:
    """(id, labels): one-hot labels of any domain as one array per row, with the
    place of each target's value in ``label_dictionary`` (null for a null).

    One join of narrow (id, target, value) rows with the dictionary, and one
    group-by of at most as many rows as targets per id. A value that holds a
    large share of all rows is split by AQE's skew join. Ids must be unique and
    not null.
    """
    targets = list(targets)
    dictionary = label_dictionary(df, targets) if dictionary is None else dictionary
    placed = _long_labels(df, targets, [id_col]).join(dictionary, ["target", "value"], "left")
    per = placed.groupBy(id_col).agg(*[F.max(F.when(F.col("target") == t, F.col("place"))).alias(f"_p{i}")
                                       for i, t in enumerate(targets)])
    return per.select(id_col, F.array(*[F.col(f"_p{i}") for i in range(len(targets))]).alias("labels"))


def fold_balance(folded: DataFrame, targets: Sequence[str] = TARGETS, seed_col: str = "seed",
                 fold_col: str = "fold") -> DataFrame:
    """Rows per (seed, target, value, fold): what stratification balances."""
    long = folded.select(seed_col, fold_col, *targets).unpivot(
        [seed_col, fold_col], list(targets), "target", "value")
    return (long.groupBy(seed_col, "target", "value", fold_col)
                .agg(F.count(F.lit(1)).alias("n_rows")))
