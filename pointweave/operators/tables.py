"""Filters, selections, orders, samples and set operations on plain tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointweave.sources.durable import durable, release

# filters ---------------------------------------------------------------------------------------


def filter_by_flags(df: DataFrame, true_keys: Sequence[str] = (), false_keys: Sequence[str] = ()) -> DataFrame:
    """Rows with all of ``true_keys`` true and all of ``false_keys`` false."""
    tests = [F.col(k) for k in true_keys] + [~F.col(k) for k in false_keys]
    return df.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def filter_by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among ``ids``; the planner broadcasts ``ids`` if their size allows."""
    return df.join(ids.select(key), key, "left_semi")


def missing_items(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def select_where(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Rows that meet every rule, given as column -> SQL comparison."""
    return df.where(reduce(lambda a, b: a & b, (F.expr(f"`{c}` {rule}") for c, rule in rules.items()), F.lit(True)))


def chain_masks(df: DataFrame, *masks: Column) -> DataFrame:
    """Each mask applies to what the one before it left."""
    for m in masks:
        df = df.where(m)
    return df


def concat_features(df: DataFrame, columns: Sequence[str], into: str) -> DataFrame:
    return df.withColumn(into, F.array(*columns)).drop(*columns)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def target_sharp(distance: Column, resolution: float) -> Column:
    return (distance < resolution).cast("double")


def fill_background(value: Column, mask: Column, fill: float = 1.0) -> Column:
    return F.when(mask, F.lit(fill)).otherwise(value)


def route(path: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """The name of the first rule whose substring the path holds."""
    out = None
    for part, name in rules:
        out = F.when(F.contains(path, F.lit(part)), name) if out is None else out.when(F.contains(path, F.lit(part)), name)
    return F.lit(default) if out is None else out.otherwise(default)


def melt(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "method", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)


# joins on keys ---------------------------------------------------------------------------------


def join_modalities(frames: dict[str, DataFrame], key: str) -> DataFrame:
    """Items that every modality has; payload columns get the modality's name in front."""
    named = [df.select(F.col(key), *(F.col(c).alias(f"{m}_{c}") for c in df.columns if c != key)) for m, df in frames.items()]
    return reduce(lambda a, b: a.join(b, key), named)


def apply_fixes(original: DataFrame, fixed: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``columns`` overwritten where a fixed row exists, everything else kept."""
    new = fixed.select(*key, F.lit(True).alias("has_fix"), *(F.col(c).alias(f"fix_{c}") for c in columns))
    out = original.join(new, list(key), "left")
    return out.withColumns({c: F.coalesce(f"fix_{c}", c) for c in columns}).select(*original.columns)


def diff_datasets(a: DataFrame, b: DataFrame, key: Sequence[str], columns: Sequence[str], tolerance: float) -> DataFrame:
    """Keys and columns that differ: one-sided rows, or values further apart than the tolerance."""
    right = b.select(*key, F.lit(True).alias("in_b"), *(F.col(c).alias(f"b_{c}") for c in columns))
    both = a.select(*key, F.lit(True).alias("in_a"), *columns).join(right, list(key), "full_outer")
    apart = lambda c: F.when(F.col("in_a").isNull() | F.col("in_b").isNull() | (F.abs(F.col(c) - F.col(f"b_{c}")) > tolerance), F.lit(c))
    return both.select(*key, F.explode(F.array_compact(F.array(*map(apart, columns)))).alias("differs"))


def view_pairs(views: DataFrame, item: str, view: str) -> DataFrame:
    """Ordered pairs of views of one item, a view with itself included."""
    one = views.select(item, F.col(view).alias("i")).distinct()
    return one.join(views.select(item, F.col(view).alias("j")).distinct(), item)


def gather(rows: DataFrame, features: DataFrame, index: str, key: str) -> DataFrame:
    """Rows with an array of indices, exploded, with the feature row of each index."""
    return rows.select("*", F.posexplode(index).alias("pos", key)).drop(index).join(features, key)


# windows ---------------------------------------------------------------------------------------


def global_index(df: DataFrame, group: Sequence[str], part: str, order: Sequence[str]) -> DataFrame:
    """Place of each row in its group: parts follow each other, and rows inside a part have the given order."""
    return numbered(df, part, *order, by=group, name="global_idx")


def numbered(df: DataFrame, *order: str, by: Sequence[str] = (), name: str = "ordinal") -> DataFrame:
    """Dense 0-based number of every row of a group in the given order, without a window over a group.

    Rows are cut at ranges of the whole key (group, order, place in the table), so a
    group, or a value that fills a third of the rows, goes to as many tasks as its rows
    need.  Each task sorts its range and counts on; the counts of the ranges,
    of which there are as many as shuffle partitions, shift the numbers.  Rows of equal
    keys get neighbouring numbers in any order; nulls come first.
    """
    keys = [*by, *order]
    # written before it is cut: ranges are sampled from these files, and a lost task finds the same places
    rows = durable(df.withColumn("row_place", F.monotonically_increasing_id()), "rows")
    ranged = rows.repartitionByRange(*keys, "row_place").sortWithinPartitions(*keys, "row_place").drop("row_place")
    placed = durable(ranged.withColumns({"row_range": F.spark_partition_id(), "row_nth": F.monotonically_increasing_id() % (1 << 33)}), "ranged")
    release(rows)
    counts = placed.groupBy("row_range", *by).agg(F.count(F.lit(1)).alias("n"), F.min("row_nth").alias("low"))
    before = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("row_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(F.col("row_range").alias("of_range"), *(F.col(c).alias(f"of_{c}") for c in by), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("shift"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in by), F.col("row_range") == F.col("of_range"))
    met = placed.join(shift if by else F.broadcast(shift), same)
    return met.select(*df.columns, (F.col("row_nth") + F.col("shift")).cast("long").alias(name))


def quantile(rows: DataFrame, by: Sequence[str], value: Column | str, q: float, name: str = "q", accuracy: int = 10_000) -> DataFrame:
    """The exact linear q-quantile of each group, whatever a group's size.

    An approximate quantile on either side brackets the wanted ranks; what lies
    under the bracket is counted, and only the few values inside it are ordered.
    Groups of up to 2 ``accuracy`` rows are their own bracket.  Nulls do not count.
    """
    names = list(by)
    v = rows.select(*names, (F.col(value) if isinstance(value, str) else value).cast("double").alias("v")).where("v IS NOT NULL")
    ends = F.percentile_approx("v", [max(0.0, q - 3 / accuracy), min(1.0, q + 3 / accuracy)], accuracy)
    cuts = v.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), ends.alias("ends"))
    small = F.col("n") <= 2 * accuracy
    cuts = cuts.select(*names, "n", F.when(small, F.col("low")).otherwise(F.col("ends")[0]).alias("low"), F.when(small, F.col("high")).otherwise(F.col("ends")[1]).alias("high"))
    near = v.join(cuts, names) if names else v.join(F.broadcast(cuts))
    # one row for each distinct value of the bracket, and one for all that lies under it
    place = F.when(F.col("v") < F.col("low"), F.lit(float("-inf"))).otherwise(F.col("v")).alias("v")
    counts = near.where("v <= high").groupBy(*names, "n", place).agg(F.count(F.lit(1)).alias("held"))
    upto = F.sum("held").over((Window.partitionBy(*names) if names else Window.partitionBy(F.lit(0))).orderBy("v"))
    rank = q * (F.col("n") - 1)
    at = lambda r: F.min(F.when(F.col("upto") > r, F.col("v")))
    both = counts.withColumn("upto", upto).groupBy(*names, "n").agg(at(F.floor(rank)).alias("lo"), at(F.ceil(rank)).alias("hi"))
    return both.select(*names, (F.col("lo") + (rank - F.floor(rank)) * (F.col("hi") - F.col("lo"))).alias(name))


def reindex_dense(df: DataFrame, group: Sequence[str], column: str, name: str = "dense") -> DataFrame:
    """Old id to 0-based dense id inside each group."""
    return df.join(numbered(df.select(*group, column).distinct(), column, by=group, name=name), [*group, column])


def locate_in_shards(ordinals: DataFrame, sizes: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Shard and place of global ordinals, from cumulative shard sizes.

    Both sides meet in stretches of the mean shard's length: a shard covers the
    stretches that it reaches into, fewer than two for each shard on average,
    so a row meets the shards of its own stretch only.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.where("n > 0").withColumn("start", F.coalesce(F.sum("n").over(w), F.lit(0)).cast("long"))
    width = sizes.where("n > 0").agg(F.greatest(F.lit(1), F.ceil(F.avg("n"))).cast("long").alias("width"))
    placed = starts.join(F.broadcast(width)).withColumn("stretch", F.explode(F.sequence(F.expr("start div width"), F.expr("(start + n - 1) div width"))))
    rows = ordinals.join(F.broadcast(width)).withColumn("stretch", F.expr(f"`{ordinal}` div width")).drop("width")
    met = rows.join(placed.drop("width"), "stretch").where((F.col(ordinal) >= F.col("start")) & (F.col(ordinal) < F.col("start") + F.col("n")))
    return met.select(*(F.col(c) for c in ordinals.columns), "shard", (F.col(ordinal) - F.col("start")).alias("place"))


def best_worst_typical(df: DataFrame, group: Sequence[str], value: str, key: str, n: int) -> DataFrame:
    """n lowest, n highest, and n around the median rank of each group."""
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("all"))
    ranked = numbered(df, value, key, by=group, name="rank").join(sizes, list(group)).withColumn("rank", F.col("rank") + 1)
    middle = F.floor(F.col("all") / 2) - n // 2
    kind = F.when(F.col("rank") <= n, "best").when(F.col("rank") > F.col("all") - n, "worst").when((F.col("rank") > middle) & (F.col("rank") <= middle + n), "typical")
    return ranked.withColumn("kind", kind).where("kind is not null").drop("all")


def split_by_fraction(df: DataFrame, order: Sequence[str], fraction: float, batch: int) -> DataFrame:
    """Train while the batch's first row lies within the fraction of all rows, else validation."""
    rows = numbered(df, *order)
    n = df.agg(F.count(F.lit(1)).alias("all"))
    start = F.floor(F.col("ordinal") / batch) * batch
    return rows.join(F.broadcast(n)).withColumn("split", F.when(start <= fraction * F.col("all"), "train").otherwise("val")).drop("all")


def slices(df: DataFrame, order: Sequence[str], jobs: int) -> DataFrame:
    """Contiguous slices of max(1, N // (10 jobs)) rows."""
    n = df.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / (10 * jobs))).alias("size"))
    return numbered(df, *order).join(F.broadcast(n)).withColumn("slice", F.floor(F.col("ordinal") / F.col("size")).cast("long")).drop("size")


def gap_profile(events: DataFrame, group: Sequence[str], ts: str, tie: str) -> DataFrame:
    """Elapsed milliseconds between successive events: 95 % quantile, mean, total hours.

    An event meets the one before it by its number, so a long group is no window.
    """
    own = events.select(*group, F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(tie).alias("tie"))
    nth = durable(numbered(own, "at", "tie", by=group, name="nth"), "gaps")
    prior = nth.select(*group, (F.col("nth") + 1).alias("nth"), F.col("at").alias("last"))
    gaps = nth.join(prior, [*group, "nth"], "left").withColumn("gap", (F.col("at") - F.col("last")) / 1000)
    sums = gaps.groupBy(*group).agg(F.avg("gap").alias("mean_ms"), (F.sum("gap") / 3.6e6).alias("hours"))
    return sums.join(quantile(gaps, group, "gap", 0.95, "p95_ms"), list(group), "left").select(*group, "p95_ms", "mean_ms", "hours")


# orders and samples ----------------------------------------------------------------------------


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def take_slice(df: DataFrame, order: Sequence[str], start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    """Python slice semantics in stored order; negative bounds count from the end."""
    if step < 1:
        raise ValueError("step is positive")
    rows = numbered(df, *order).join(F.broadcast(df.agg(F.count(F.lit(1)).alias("all"))))
    bound = lambda b, default: default if b is None else (F.lit(b) if b >= 0 else F.greatest(F.col("all") + b, F.lit(0)))
    low, high = bound(start, F.lit(0)), bound(stop, F.col("all"))
    o = F.col("ordinal")
    return rows.where((o >= low) & (o < high) & ((o - low) % step == 0)).drop("all")


def cap_items(df: DataFrame, order: Sequence[str], most: int) -> DataFrame:
    return df.orderBy(*order).limit(most)


def natural_key(name: Column) -> Column:
    """Sort key in which runs of digits compare as numbers."""
    parts = F.regexp_extract_all(name, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    return F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 20, "0")).otherwise(p))


def shuffle_key(seed: int, *key: str) -> Column:
    """Order of a reproducible permutation."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in key)))


def head_number(hexadecimal: Column) -> Column:
    """The first 48 bits of a hexadecimal text as a number; it grows with the text."""
    return F.conv(F.substring(hexadecimal, 1, 12), 16, 10).cast("double")


def uniform(seed: int, *key: str) -> Column:
    """A uniform number in (0, 1) that the key and the seed decide."""
    return (head_number(shuffle_key(seed, *key)) + 0.5) / float(16**12)


def block_shuffle(df: DataFrame, seed: int, shard: str, key: str, rank: int, world: int) -> DataFrame:
    """Shards permuted, rows permuted inside each; the rank-th of every ``world`` rows."""
    keyed = df.withColumns({"shard_key": shuffle_key(seed, shard), "row_key": shuffle_key(seed + 1, key)})
    out = numbered(keyed, "shard_key", "row_key")
    return out.where(F.col("ordinal") % world == rank).drop("shard_key", "row_key")


def weighted_subsample(df: DataFrame, group: Sequence[str], n: int, theta: float, distance: str, key: Sequence[str], seed: int) -> DataFrame:
    """n rows of each group without replacement, weight exp(-theta distance): least -ln(u) / weight."""
    cost = -F.ln(uniform(seed, *key)) / F.exp(-theta * F.col(distance))
    return top_k(df.withColumn("cost", cost), group, ["cost", *key], n).drop("cost")


#: Keys that :func:`looked_up` sends to every task; each other key has at most 1 in ``HOT`` of the rows.
HOT = 2_000


def looked_up(rows: DataFrame, found: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` with the columns that ``found`` has for their key (null where it has none).

    ``found`` has each key once, and in ``count`` how many of the ``total``
    rows have it.  Keys of more than 1 in ``HOT`` rows are fewer than ``HOT``,
    whatever the data: these alone are broadcast, so that a key that fills a
    third of the rows meets its value where its rows lie.  The others are
    joined by a shuffle in which none of them stands out.
    """
    often = found.where(F.col(count) * HOT > total).drop(count)
    rare = found.where(F.col(count) * HOT <= total).drop(count)
    own = [c for c in found.columns if c not in (key, count)]
    hot = rows.join(F.broadcast(often), key)
    cold = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(rare, key, "left")
    return hot.select(*rows.columns, *own).unionAll(cold.select(*rows.columns, *own))
