"""Exact stratified splits, folds, replication and class weights.

Rows are ordered inside their class by the md5 of seed and key.  Digests are
spread evenly, so their first digits cut a class into buckets of equal size
whatever the keys look like; counts per bucket locate any rank.  A cut is found by
radix selection: rounds of counts, each over the one bucket that holds it, until few rows are left.
Ranks of all rows take as many digits as keep a bucket small.  No task ever sorts a whole class.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clicktrail import schemas as S
from clicktrail.functions.text import copy_suffix, oversample_rate, seeded_digest
from clicktrail.operators.features import class_ratio

# Sizes, share, seed, number of folds and copy divisor.
TRAIN_SIZE, TEST_SIZE = 100_000, 50_000
VALIDATION_SHARE = 0.3
SEED = 42
FOLDS = 5
COPY_DIVISOR = 8

#: Hex digits that a round of counts goes on by: 4096 buckets per class and cut.
_DIGITS = 3
#: Rows of a bucket that are listed to find a cut, and rows that are ranked together, about.
_LISTED, _RANKED = 4096, 500_000


def _key_columns(key) -> list:
    return [F.col(k) for k in ([key] if isinstance(key, str) else key)]


def allocate(counts: dict, total: int) -> dict:
    """Share ``total`` over classes in proportion to their counts, largest remainders first."""
    everything = sum(counts.values())
    if total > everything:
        raise ValueError(f"{total} rows asked for, {everything} present")
    if total == 0:
        return dict.fromkeys(counts, 0)
    exact = {c: (n * total) // everything for c, n in counts.items()}
    remainder = sorted(counts, key=lambda c: (-((counts[c] * total) % everything), c))
    for c in remainder[: total - sum(exact.values())]:
        exact[c] += 1
    return exact


@dataclass(frozen=True)
class Split:
    """A fitted split: per class the last digest of each named part.

    ``assign`` is a plain expression on key and label, so any table that
    carries both - sessions or their events - is marked without a join.
    """

    key: tuple
    label: str
    seed: int
    parts: tuple
    cuts: dict

    def column(self) -> Column:
        digest = seeded_digest(self.seed, *map(F.col, self.key))
        out = F.lit(None).cast("string")
        for value, bounds in self.cuts.items():
            mine = F.lit(None).cast("string")
            for part, last in reversed(list(zip(self.parts, bounds))):
                if last is not None:
                    mine = F.when(digest <= last, part).otherwise(mine)
            out = F.when(F.col(self.label) == F.lit(value), mine).otherwise(out)
        return out

    def assign(self, df: DataFrame, name: str = "set") -> DataFrame:
        return df.withColumn(name, self.column())


def _in_buckets(buckets) -> Column:
    """Whether a row is in one of the ``(label, prefix)`` buckets."""
    out = F.lit(False)
    for value, prefix in sorted(set(buckets), key=str):
        mine = F.col("_label") == F.lit(value)
        out |= mine & F.col("_digest").startswith(prefix) if prefix else mine
    return out


def _bucket_counts(keyed: DataFrame, buckets, digits: int) -> dict:
    """Rows per ``(label, first digits)`` in some buckets: the driver sees 4096 numbers a bucket at most."""
    prefix = F.substring("_digest", 1, digits).alias("_prefix")
    rows = keyed.filter(_in_buckets(buckets)) if any(p for _, p in buckets) else keyed
    return {(r["_label"], r["_prefix"]): r["count"] for r in rows.groupBy("_label", prefix).count().collect()}


def select_digests(keyed: DataFrame, wanted: dict, counts: dict, digits: int) -> dict:
    """Digest of the row of a 1-based rank in its class: ``{name: digest}`` for ``wanted {name: (label, rank)}``.

    ``keyed`` has ``_label`` and ``_digest``; ``counts`` are those of the first ``digits`` digits.  Buckets that hold more than
    ``_LISTED`` rows are counted by further digits, so a round divides them by 4096 and classes of any size take a few rounds;
    then the digests of the bucket are sorted as one short list.
    """
    at = {name: (label, "", rank) for name, (label, rank) in wanted.items()}
    done = {}
    while at:
        sizes = {}
        for name, (label, prefix, rank) in at.items():
            for bucket in sorted(b for c, b in counts if c == label and b.startswith(prefix)):
                n = counts[label, bucket]
                if rank <= n:
                    at[name], sizes[name] = (label, bucket, rank), n
                    break
                rank -= n
        done.update({name: at[name] for name, n in sizes.items() if n <= _LISTED or digits >= 32})
        at = {name: where for name, where in at.items() if name in sizes and name not in done}
        if at:
            digits = min(32, digits + _DIGITS)
            counts = _bucket_counts(keyed, {w[:2] for w in at.values()}, digits)
    if not done:
        return {}
    numbers = {b: i for i, b in enumerate(sorted({w[:2] for w in done.values()}, key=str))}
    cases = F.coalesce(*[F.when(_in_buckets([b]), F.lit(i)) for b, i in numbers.items()])
    listed = keyed.select(cases.alias("_cut"), "_digest").filter("_cut IS NOT NULL").groupBy("_cut").agg(F.sort_array(F.collect_list("_digest")).alias("digests"))
    digests = {r["_cut"]: r["digests"] for r in listed.collect()}
    return {name: digests[numbers[label, prefix]][rank - 1] for name, (label, prefix, rank) in done.items()}


def fit_split(df: DataFrame, key, label: str, sizes, parts, seed: int) -> Split:
    """Find the digests that cut each class at the given cumulative sizes.

    ``df`` has one row per key.  ``sizes`` maps counts per class to the number of rows per part.  One job counts, a second lists
    the buckets that hold a cut; classes of over 16 million rows take a round of counts more.
    """
    digest = seeded_digest(seed, *_key_columns(key))
    keyed = df.select(F.col(label).alias("_label"), digest.alias("_digest")).filter(F.col("_label").isNotNull())
    counts = _bucket_counts(keyed, [], _DIGITS)
    totals: dict = {}
    for (value, _), n in counts.items():
        totals[value] = totals.get(value, 0) + n
    wanted = {}
    cuts = {value: [None] * len(parts) for value in sorted(totals)}
    for value, quota in sizes(totals).items():
        target = 0
        for i, size in enumerate(quota):
            target += size
            if target:
                wanted[value, i] = (value, target)
    for (value, i), found in select_digests(keyed, wanted, counts, _DIGITS).items():
        cuts[value][i] = found
    key = (key,) if isinstance(key, str) else tuple(key)
    return Split(key, label, seed, tuple(parts), cuts)


def stratified_split(
    df: DataFrame, key=tuple(S.SESSION_KEY), label: str = S.LABEL, train_n: int = TRAIN_SIZE, test_n: int = TEST_SIZE, seed: int = SEED
) -> Split:
    """Train and test parts of absolute size with equal class shares; the rest stays NULL."""

    def sizes(counts):
        train = allocate(counts, train_n)
        test = allocate({c: counts[c] - train[c] for c in counts}, test_n)
        return {c: (train[c], test[c]) for c in counts}

    return fit_split(df, key, label, sizes, ("train", "test"), seed)


def stratified_fraction_split(
    df: DataFrame, key=tuple(S.SESSION_KEY), label: str = S.LABEL, share: float = VALIDATION_SHARE, seed: int = SEED
) -> Split:
    """``train`` and ``validation`` parts; the validation size is rounded up."""

    def sizes(counts):
        total = sum(counts.values())
        train = allocate(counts, total - math.ceil(total * share))
        return {c: (train[c], counts[c] - train[c]) for c in counts}

    return fit_split(df, key, label, sizes, ("train", "validation"), seed)


def stratified_rank(df: DataFrame, key, label: str, seed: int = SEED, name: str = "rank") -> DataFrame:
    """0-based rank of each row in its class by digest.

    Offset of the bucket plus rank in the bucket.  A bucket has as many digits as the largest class needs for ``_RANKED`` rows
    or fewer in it; offsets are summed over the first half of the digits, then inside it, so those windows stay short too.
    """
    largest = df.groupBy(label).count().agg(F.max("count")).first()[0] or 0
    digits = max(0, math.ceil(math.log(max(1, largest / _RANKED), 16)))
    keyed = df.withColumn("_digest", seeded_digest(seed, *_key_columns(key)))
    inside = Window.orderBy("_digest", *_key_columns(key))
    if not digits:
        return keyed.withColumn(name, (F.row_number().over(inside.partitionBy(label)) - 1).cast("bigint")).select(*df.columns, name)
    keyed = keyed.withColumn("_bucket", F.substring("_digest", 1, digits))
    half = F.substring("_bucket", 1, (digits + 1) // 2)
    buckets = keyed.groupBy(label, "_bucket").count().withColumn("_half", half)
    before = lambda *by: Window.partitionBy(label, *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sum_before = lambda c, *by: F.coalesce(F.sum(c).over(before(*by)), F.lit(0))
    halves = buckets.groupBy(label, "_half").agg(F.sum("count").alias("n")).select(label, "_half", sum_before("n", "_half").alias("_far"))
    offsets = buckets.withColumn("_near", sum_before("count", "_half", "_bucket")).join(halves, [label, "_half"])
    offsets = offsets.select(label, "_bucket", (F.col("_far") + F.col("_near")).alias("_offset"))
    ranked = keyed.withColumn("_inside", F.row_number().over(inside.partitionBy(label, "_bucket"))).join(offsets, [label, "_bucket"])
    return ranked.withColumn(name, F.col("_offset") + F.col("_inside") - 1).select(*df.columns, name)


def assign_folds(df: DataFrame, key=tuple(S.SESSION_KEY), label: str = S.LABEL, k: int = FOLDS, seed: int = SEED, name: str = "fold") -> DataFrame:
    """Fold 0..k-1 of each row; class counts of two folds differ by one at most."""
    ranked = stratified_rank(df, key, label, seed, "_rank")
    return ranked.withColumn(name, F.pmod("_rank", F.lit(k)).cast("int")).drop("_rank")


def oversample_sessions(df: DataFrame, divisor: int = COPY_DIVISOR, label: str = S.LABEL) -> DataFrame:
    """Replicate the rows of purchase sessions, originals kept as ``copy_no`` 0.

    The number of copies follows from the class ratio, one row that reaches the
    plan as a scalar subquery.  Replicas get the suffix ``D0``, ``D1``, ... in
    their text id and share the session key with their original.
    """
    rate = class_ratio(df, label=label).select(oversample_rate(F.col("ratio"), divisor)).scalar()
    copies = F.when(F.col(label) == 1, F.sequence(F.lit(0), rate)).otherwise(F.array(F.lit(0)))
    out = df.withColumn("copy_no", F.explode(copies))
    if S.SESSION_TEXT in df.columns:
        out = out.withColumn(S.SESSION_TEXT, F.concat(F.col(S.SESSION_TEXT), copy_suffix(F.col("copy_no"))))
    return out


def class_weights(df: DataFrame, label: str = S.LABEL) -> DataFrame:
    """``balanced`` weight per class: rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    totals = counts.agg(F.sum("rows").alias("n"), F.count(F.lit(1)).alias("k"))
    n, k = totals.select("n").scalar(), totals.select("k").scalar()
    return counts.withColumn("weight", n / (k * F.col("rows")))


def weight_column(weights: dict, label: str = S.LABEL) -> Column:
    """Weights per class as an expression, e.g. ``{0: 1.0, 1: 5.0}``."""
    out = F.lit(None).cast("double")
    for value, weight in weights.items():
        out = F.when(F.col(label) == F.lit(value), F.lit(float(weight))).otherwise(out)
    return out


def with_balanced_weight(df: DataFrame, label: str = S.LABEL, name: str = "weight") -> DataFrame:
    weights = {r[label]: r["weight"] for r in class_weights(df, label).collect()}  # one row per class
    return df.withColumn(name, weight_column(weights, label))
