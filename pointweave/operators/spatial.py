"""Spatial joins on cell keys.

A point goes to the cell of its coordinates; the other side is copied to the
cells that its reach touches; an equi-join on the cell proposes pairs and the
exact predicate decides.  A crowded cell is an ordinary skewed join key, which
adaptive execution splits.  Nothing is broadcast unless the planner knows its
size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from pointweave.functions.geometry import aabb
from pointweave.sources.durable import durable, release

XYZ = ("x", "y", "z")
#: Most rounds of growing cells; each doubles the cell.
MAX_ROUNDS = 64


def _cell(c: Column, size: Column | float) -> Column:
    return F.floor(c / size).cast("long")


def _around(df: DataFrame, xyz: Sequence[str], size: Column | float, origin: Sequence[str] | None = None) -> DataFrame:
    """Each row once for every cell within one cell of its own."""
    for i, c in enumerate(xyz):
        own = _cell(F.col(c) - F.col(origin[i]) if origin else F.col(c), size)
        df = df.withColumn(f"cell{i}", F.explode(F.sequence(own - 1, own + 1)))
    return df


def _in_cells(df: DataFrame, xyz: Sequence[str], size: Column | float, origin: Sequence[str] | None = None) -> DataFrame:
    return df.withColumns({f"cell{i}": _cell(F.col(c) - F.col(origin[i]) if origin else F.col(c), size) for i, c in enumerate(xyz)})


def _d2(a: Sequence[str], b: Sequence[str]) -> Column:
    out = None
    for x, y in zip(a, b):
        term = (F.col(x) - F.col(y)) * (F.col(x) - F.col(y))
        out = term if out is None else out + term
    return out


def radius_join(queries: DataFrame, points: DataFrame, radius: float | str, by: Sequence[str] = (), xyz: Sequence[str] = XYZ, inclusive: bool = False) -> DataFrame:
    """Pairs of a query and a point under the radius, with ``d2``.

    Columns of ``points`` other than ``by`` get the prefix ``p_``.  A radius that
    groups have of their own is the name of a column of both sides.
    """
    cells = [f"cell{i}" for i in range(len(xyz))]
    own = isinstance(radius, str)
    right = points.select(*by, *(F.col(c).alias(f"p_{c}") for c in points.columns if c not in by))
    right = _in_cells(right, [f"p_{c}" for c in xyz], F.col(f"p_{radius}") if own else radius)
    left = _around(queries, xyz, F.col(radius) if own else radius)
    d2 = _d2(xyz, [f"p_{c}" for c in xyz])
    most = F.col(radius) * F.col(radius) if own else F.lit(radius * radius)
    out = left.join(right, [*by, *cells]).drop(*cells).withColumn("d2", d2)
    return out.where(F.col("d2") <= most if inclusive else F.col("d2") < most)


def close_pairs(points: DataFrame, radius: float, by: Sequence[str] = (), xyz: Sequence[str] = XYZ, wide: float = 16.0) -> DataFrame:
    """:func:`radius_join` (inclusive) of points with themselves for a radius under which few lie.

    Cells are ``wide`` times the radius, and a point is copied only to those that its reach touches: mostly to its own.
    """
    cells, size, reach = [f"cell{i}" for i in range(len(xyz))], wide * radius, radius * (1 + 1e-9)
    left = points
    for i, c in enumerate(xyz):
        left = left.withColumn(cells[i], _covered(F.col(c) - reach, F.col(c) + reach, size))
    right = _in_cells(points.select(*by, *(F.col(c).alias(f"p_{c}") for c in points.columns if c not in by)), [f"p_{c}" for c in xyz], size)
    return left.join(right, [*by, *cells]).drop(*cells).withColumn("d2", _d2(xyz, [f"p_{c}" for c in xyz])).where(F.col("d2") <= radius * radius)


#: Points (or shapes) of a group that are not put into cells.
WHOLE = 1024


def _knn_whole(queries: DataFrame, points: DataFrame, groups: DataFrame, k: int, by: list[str], key: str, query_key: str, xyz: list[str], tasks: int) -> DataFrame:
    """:func:`knn` in the small ``groups`` (by): a task gets many of them and compares each whole."""
    kinds = dict(queries.dtypes) | {"other": dict(points.dtypes)[key]}
    deal = F.pmod(F.xxhash64(F.lit(0), *by), F.lit(4 * tasks)).alias("deal")
    of = lambda df: df.join(groups, by, "left_semi") if by else df
    here = lambda df: df.where(" AND ".join(f"{c} IS NOT NULL" for c in (*by, *xyz)))
    asked = here(of(queries.select(*by, query_key, *xyz))).select(deal, "*")
    held = here(of(points.select(*by, F.col(key).alias("other"), *xyz))).select(deal, *(F.col(c).alias(c) for c in (*by, "other", *xyz)))
    names = [*by, query_key, "other"]
    block = ["deal", *by]

    def nearest(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("other", kind="stable")
        x, y = q[xyz].to_numpy(float), p[xyz].to_numpy(float)
        of = p.groupby(block, sort=False).indices if len(q) and len(p) else {}
        found = []
        for name, own in q.groupby(block, sort=False).indices.items() if of else ():
            other = np.sort(of.get(name, np.zeros(0, int)))  # by key, so that the first of equals has the least
            for lo in range(0, len(own), 512) if len(other) else ():
                asking = own[lo : lo + 512]
                d2 = np.zeros((len(asking), len(other)))
                for i in range(len(xyz)):
                    gap = x[asking, i][:, None] - y[other, i]
                    d2 += gap * gap
                last = min(k, len(other)) - 1
                row, at = np.nonzero(d2 <= np.partition(d2, last, axis=1)[:, last][:, None])
                order = np.lexsort((at, d2[row, at], row))
                row, at = row[order], at[order]
                rank = np.arange(len(row)) - np.searchsorted(row, np.arange(len(asking)))[row]
                row, at, rank = row[rank < k], at[rank < k], rank[rank < k]
                found.append((asking[row], other[at], d2[row, at], rank + 1))
        row, at, d2, rank = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int),) * 4
        return pd.DataFrame({c: q[c].to_numpy()[row] for c in (*by, query_key)} | {"other": p["other"].to_numpy()[at], "d2": d2.astype(float), "rank": rank.astype(np.int64)})

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "d2 double", "rank long"])
    dealt = [df.repartition(tasks, "deal").groupBy("deal") for df in (asked, held)]
    return dealt[0].cogroup(dealt[1]).applyInPandas(nearest, schema)


def knn(queries: DataFrame, points: DataFrame, k: int, by: Sequence[str] = (), key: str = "point_id", query_key: str = "point_id", xyz: Sequence[str] = XYZ) -> DataFrame:
    """The k nearest points of each query, ranked by (d2, point key); itself included if it is a point.

    Every group has cells of its own size: at first that which holds about k of
    its points, by the middle nine tenths of each axis, so that an outlier does
    not widen the cells of the others.  Cells double for the queries whose k-th
    neighbour may lie beyond the cells looked at.  What a round settles is
    written to the shared folder.  Rows of ``queries`` are known by ``by`` and
    ``query_key``.  Cells are counted from the low corner of a group, and are not
    smaller than 2^-40 of its extent; a group without extent is one cell.  Groups of up
    to ``WHOLE`` points need no cells: their queries are compared with all of them at once.
    """
    ids, axes = [*by, query_key], range(len(xyz))
    tails = [F.percentile_approx(c, [0.05, 0.95], 1000).alias(f"mid{i}") for i, c in enumerate(xyz)]
    named = lambda c, n: (F.count(c) == F.count(F.lit(1))).alias(n)
    low = points.groupBy(*by).agg(F.count(F.lit(1)).alias("held"), named(key, "keyed"), *tails, *(f(c).alias(f"{n}{i}") for i, c in enumerate(xyz) for n, f in (("lo", F.min), ("hi", F.max))))
    ends = queries.groupBy(*by).agg(F.count(F.lit(1)).alias("asked"), named(query_key, "known"), *(f(c).alias(f"q{n}{i}") for i, c in enumerate(xyz) for n, f in (("lo", F.min), ("hi", F.max))))
    wide = F.greatest(*(F.greatest(f"hi{i}", f"qhi{i}") - F.least(f"lo{i}", f"qlo{i}") for i in axes))
    middle = F.greatest(*((F.col(f"mid{i}")[1] - F.col(f"mid{i}")[0]) / 0.9 for i in axes))
    grids = low.join(ends, list(by)) if by else low.join(F.broadcast(ends))
    grids = grids.withColumn("cell_extent", wide).withColumn("cell_size", F.when(middle > 0, middle).otherwise(F.col("cell_extent")) * F.pow(k / F.col("held"), F.lit(1.0 / len(xyz))))
    corner = [f"corner{i}" for i in axes]
    size = F.greatest(F.least("cell_size", "cell_extent"), F.col("cell_extent") * 2.0**-40)
    lowest = [F.least(f"lo{i}", f"qlo{i}").alias(c) for i, c in enumerate(corner)]
    few = (F.col("held") <= WHOLE) & F.col("keyed") & F.col("known")
    grids = durable(grids.where("held > 0 and cell_extent is not null").select(*by, F.when(size > 0, size).otherwise(1.0).alias("cell_size"), "cell_extent", *lowest, "held", "asked", few.alias("few")), "grids")
    with_grid = lambda df: df.join(grids, list(by)) if by else df.join(F.broadcast(grids))
    whole, many = grids.where("few").select(*by, "held", "asked"), grids.where("not few").drop("few", "held", "asked")
    rows, pairs, left = grids.agg(F.sum(F.when(F.col("few"), F.col("held") + F.col("asked"))), F.sum(F.when(F.col("few"), F.col("held").cast("double") * F.col("asked"))), F.count_if(~F.col("few"))).first()
    done = []
    if rows is not None:
        tasks = max(1, min(10_000, int(max(rows / 20_000, pairs / 20_000_000))))
        done.append(durable(_knn_whole(queries, points, whole.select(*by), k, list(by), key, query_key, list(xyz), tasks), "knn"))
        if left == 0:
            release(grids)
            return done[0]
    grids = many
    pts = durable(with_grid(points.select(*by, F.col(key).alias("other"), *(F.col(c).alias(f"p_{c}") for c in xyz))).drop("cell_extent"), "points")
    pending = durable(with_grid(queries.select(*ids, *xyz)), "queries")
    cells = [f"cell{i}" for i in axes]
    w = Window.partitionBy(*ids).orderBy("d2", "other")
    for step in range(MAX_ROUNDS):
        size = F.col("cell_size") * float(2**step)
        near = _around(pending, xyz, size, corner).drop("cell_size").join(_in_cells(pts, [f"p_{c}" for c in xyz], size, corner).drop("cell_size", *corner), [*by, *cells]).withColumn("d2", _d2(xyz, [f"p_{c}" for c in xyz]))
        ranked = near.select(*ids, "other", "d2").withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
        full = ranked.withColumn("reach", F.max("d2").over(Window.partitionBy(*ids))).withColumn("have", F.count(F.lit(1)).over(Window.partitionBy(*ids)))
        # every point nearer than a cell's size lies in the cells around; cells as wide as the group hold all of it
        full = full.join(grids, list(by)) if by else full.join(F.broadcast(grids))
        settled = durable(full.where(((F.col("have") == k) & (F.col("reach") <= size * size)) | (size >= F.col("cell_extent"))).select(*ids, "other", "d2", "rank"), "knn")
        done.append(settled)
        before, pending = pending, durable(pending.join(settled.select(*ids).distinct(), ids, "left_anti").where(size < F.col("cell_extent")), "knn")
        release(before)
        if pending.isEmpty():
            break
    release(pts, grids, pending)
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out


#: Points of a group that :func:`ball_hits` looks at first (each round looks at four times as many), queries of a task,
#: and pairs of queries and points up to which a first round looks at more.
FIRST, TASK, PAIRS = 256, 20_000, 10_000_000


def placed(points: DataFrame, by: Sequence[str] = (), key: str = "point_id", xyz: Sequence[str] = XYZ) -> DataFrame:
    """Points with their ``place`` in the order of ids, as :func:`ball_hits` numbers them."""
    from pointweave.operators.tables import numbered

    return durable(numbered(points.select(*by, key, *xyz).where(F.col(key).isNotNull()), key, key, by=list(by), name="place"), "balls")


def ball_hits(queries: DataFrame, points: DataFrame, radius: float, nsample: int, by: Sequence[str] = (), key: str = "point_id", xyz: Sequence[str] = XYZ, inclusive: bool = False) -> DataFrame:
    """by, key and ``hit``: the first ``nsample`` points by id within the radius of each query, if there are any.

    A round looks at the first points of each group by id.  Queries with ``nsample`` hits among them are
    settled, the others see four times as many points, so few of the pairs of crowded places are made.
    Few queries see many points at once.  Points may be :func:`placed` already, where they are asked several times.
    """
    by = list(by)
    ids, w = [*by, key], Window.partitionBy(*by, key).orderBy(f"p_{key}")
    nth = points if "place" in points.columns else placed(points, by, key, xyz)
    most = nth.agg(F.max("place")).first()[0]
    pending, size, out = durable(queries.select(*ids, *xyz), "balls"), None, None
    while True:
        asking = pending.count()
        size = max(FIRST, PAIRS // max(1, asking)) if size is None else size
        seen = nth.where(F.col("place") < size)
        parts = 1 + asking // TASK
        # the smaller side is copied to the cells around
        if asking < seen.count():
            pairs = radius_join(pending, seen.drop("place"), radius, by, xyz, inclusive).select(*ids, f"p_{key}")
        else:
            pairs = radius_join(seen.drop("place"), pending, radius, by, xyz, inclusive).select(*by, F.col(f"p_{key}").alias(key), F.col(key).alias(f"p_{key}"))
        # dealt by queries, since the join may make all pairs in a few tasks
        found = durable(pairs.repartition(parts, *ids).withColumn("n", F.row_number().over(w)).where(F.col("n") <= nsample), "balls")
        last = most is None or size > most
        full = found.where(F.col("n") == nsample).select(*ids)
        settled = (found if last else found.join(full, ids, "left_semi")).select(*ids, F.col(f"p_{key}").alias("hit"))
        out = settled if out is None else out.unionAll(settled)
        if last:
            break
        before, pending = pending, durable(pending.join(full, ids, "left_anti"), "balls")
        release(before)
        if pending.isEmpty():
            break
        size *= 4
    release(pending, *([nth] if nth is not points else []))
    return out


def ball_query(queries: DataFrame, points: DataFrame, radius: float, nsample: int, by: Sequence[str] = (), key: str = "point_id", xyz: Sequence[str] = XYZ) -> DataFrame:
    """The first ``nsample`` points by id within the radius, as an array filled up with the first (0 if none)."""
    ids = [*by, key]
    hits = ball_hits(queries, points, radius, nsample, by, key, xyz).groupBy(*ids).agg(F.array_sort(F.collect_list("hit")).alias("hits"))
    filled = F.when(F.col("hits").isNull(), F.array_repeat(F.lit(0).cast("long"), nsample)).otherwise(F.concat("hits", F.array_repeat(F.element_at("hits", 1), nsample - F.size("hits"))))
    return queries.select(*ids).join(hits, ids, "left").withColumn("hits", filled)


def ball_patches(points: DataFrame, seeds: DataFrame, radius: float, size: int, by: Sequence[str] = (), key: str = "point_id", xyz: Sequence[str] = XYZ) -> DataFrame:
    """:func:`pointweave.operators.graph.bfs_patches` of the radius graph, whose edges are never listed.

    seeds: seed, node.  A level needs the least new nodes only, as many as a patch lacks, and each of
    these is among the first ``size`` points around a node of the level before: of those before it, the
    ones that are not new are in the patch.
    """
    by = list(by)
    at = placed(points, by, key, xyz)
    front = durable(seeds.select("seed", "node", F.lit(0).cast("long").alias("hop")).distinct(), "patches")
    reached, w = front, Window.partitionBy("seed").orderBy("node")
    for hop in range(1, size):
        around = ball_hits(at.join(front.select(F.col("node").alias(key)).distinct(), key, "left_semi"), at, radius, size, by, key, xyz, inclusive=True)
        new = front.join(around.select(F.col(key).alias("node"), "hit").where("node <> hit").distinct(), "node").select("seed", F.col("hit").alias("node")).distinct()
        new = new.join(reached.select("seed", "node"), ["seed", "node"], "left_anti").join(reached.groupBy("seed").agg(F.count(F.lit(1)).alias("have")), "seed")
        new = new.withColumn("n", F.row_number().over(w)).where(F.col("n") + F.col("have") <= size)
        front = durable(new.select("seed", "node", F.lit(hop).cast("long").alias("hop")), "patches")
        if front.isEmpty():
            break
        reached = durable(reached.unionAll(front), "patches")
    nth = Window.partitionBy("seed").orderBy("hop", "node")
    return reached.withColumn("nth", F.row_number().over(nth).cast("long")).where(F.col("nth") <= size)


def radius_pairs(points: DataFrame, radius: float | str, by: Sequence[str] = (), key: str = "point_id", xyz: Sequence[str] = XYZ) -> DataFrame:
    """Unordered pairs within the radius."""
    own = points.select(*by, key, *xyz, *([radius] if isinstance(radius, str) else []))
    pairs = radius_join(own, own, radius, by, xyz, inclusive=True)
    return pairs.where(F.col(key) < F.col(f"p_{key}")).select(*by, F.col(key).alias("a"), F.col(f"p_{key}").alias("b"), "d2")


def _touching(points: DataFrame, radius: float, by: Sequence[str], label: str | None, key: str, xyz: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Places (by, cell and label; ``low``: the least key) and links (by, ``a``, ``b``) of such with points within the radius of each other.

    Cells are so small that all points of one are linked.  Without a label links are between the
    least keys of places and join what is within reach, though not each pair of places; with a label, between labels, and all are told.  Up to six
    points of a place that lie outermost are compared first.  Only pairs of places that are not linked by then, nor in any
    other way, are compared in full, and only by points near the other's box.
    """
    from pointweave.operators.graph import connected_components

    by, axes = list(by), range(len(xyz))
    cells, side, most = [f"cell{i}" for i in axes], radius / len(xyz) ** 0.5 * (1 - 1e-6), radius * radius
    own = points.where(" AND ".join(f"{c} IS NOT NULL" for c in (*by, key, *xyz, *([label] if label else []))))
    own = durable(_in_cells(own.groupBy(*by, *([label] if label else []), *xyz).agg(F.min(key).alias(key)), xyz, side), "places")
    ends = [f(F.struct(*(F.col(c).cast("double").alias(c) for c in (*xyz[i:], *xyz[:i])))) for i in axes for f in (F.min, F.max)]
    outer = F.array_distinct(F.array(*(F.struct(*(e.getField(c).alias(f"c{j}") for j, c in enumerate(xyz))) for e in ends)))
    places = own.groupBy(*by, *cells, *([label] if label else [])).agg(F.min(key).alias("low"), (F.first(label) if label else F.min(key)).alias("name"), F.count(F.lit(1)).alias("n"), outer.alias("outer"), *(f(c).alias(f"{m}_{c}") for c in xyz for m, f in (("lo", F.min), ("hi", F.max))))
    places = durable(places, "places")
    told = [*by, *cells, "name", "n", "outer", *(f"{m}_{c}" for c in xyz for m in ("lo", "hi"))]
    left = places.select(*by, *(F.col(c).alias(f"a_{c}") for c in told if c not in by))
    steps = F.explode(F.sequence(F.lit(-2), F.lit(2)))
    for i, c in enumerate(cells):
        left = left.withColumn(f"step{i}", steps).withColumn(f"b_{c}", F.col(f"a_{c}") + F.col(f"step{i}"))
    ahead, same = F.struct(*(f"step{i}" for i in axes)), F.struct(*(F.lit(0).alias(f"step{i}") for i in axes))
    left = left.where(ahead >= same if label else ahead > same)
    met = left.join(places.select(*by, *(F.col(c).alias(f"b_{c}") for c in told if c not in by)), [*by, *(f"b_{c}" for c in cells)]).where("a_name <> b_name")
    gap = sum((F.pow(F.greatest(F.col(f"a_lo_{c}") - F.col(f"b_hi_{c}"), F.col(f"b_lo_{c}") - F.col(f"a_hi_{c}"), F.lit(0.0)), F.lit(2.0)) for c in xyz), F.lit(0.0))
    near = F.exists("a_outer", lambda p: F.exists("b_outer", lambda q: sum(((p[f"c{j}"] - q[f"c{j}"]) * (p[f"c{j}"] - q[f"c{j}"]) for j in axes[1:]), (p["c0"] - q["c0"]) * (p["c0"] - q["c0"])) <= most))
    whole = (F.col("a_n") <= F.size("a_outer")) & (F.col("b_n") <= F.size("b_outer"))
    met = met.where(gap <= most * (1 + 1e-9)).withColumns({"near": near, "whole": whole}).where("near OR NOT whole")
    met = durable(met.select(*by, "near", *(F.col(f"{s}_{c}") for s in "ab" for c in told if c not in (*by, "n", "outer"))), "touching")
    link = [F.least("a_name", "b_name").alias("a"), F.greatest("a_name", "b_name").alias("b")]
    sure = durable(met.where("near").select(*by, *link).distinct(), "touching")
    unsure = met.where("NOT near")
    if label:
        unsure = unsure.withColumns({"a": link[0], "b": link[1]}).join(sure, [*by, "a", "b"], "left_anti").drop("a", "b")
    elif not unsure.isEmpty():
        parts = connected_components(sure, "a", "b")
        part = lambda s: parts.select(F.col("node").alias(f"{s}_name"), F.col("component").alias(f"{s}_part"))
        unsure = unsure.join(part("a"), "a_name", "left").join(part("b"), "b_name", "left").where(~F.coalesce("a_part", "a_name").eqNullSafe(F.coalesce("b_part", "b_name")))
    for s, o in ("ab", "ba"):
        of = own.select(*by, *(F.col(c).alias(f"{s}_{c}") for c in (*cells, *xyz)), *([F.col(label).alias(f"{s}_name")] if label else []))
        off = sum((F.pow(F.greatest(F.col(f"{o}_lo_{c}") - F.col(f"{s}_{c}"), F.col(f"{s}_{c}") - F.col(f"{o}_hi_{c}"), F.lit(0.0)), F.lit(2.0)) for c in xyz), F.lit(0.0))
        unsure = unsure.join(of, [*by, *(f"{s}_{c}" for c in cells), *([f"{s}_name"] if label else [])]).where(off <= most * (1 + 1e-9))
    found = unsure.where(_d2([f"a_{c}" for c in xyz], [f"b_{c}" for c in xyz]) <= most).select(*by, *link).distinct()
    return places.select(*by, *cells, "low", "n"), durable(sure.unionAll(found), "touching")


def touching_labels(points: DataFrame, label: str, radius: float, by: Sequence[str] = (), key: str = "point_id", xyz: Sequence[str] = XYZ) -> DataFrame:
    """Pairs of labels (by, a, b; a < b) with points within the radius of each other, without listing pairs of points."""
    return _touching(points, radius, by, label, key, xyz)[1].distinct()


def radius_components(points: DataFrame, radius: float, by: Sequence[str] = (), key: str = "point_id", xyz: Sequence[str] = XYZ) -> DataFrame:
    """node, component (the least key reachable) of the graph of :func:`radius_pairs`, whose edges are never listed.

    Points are linked to the least of their cell and cells to each other, so there are about as many edges as points.
    """
    from pointweave.operators.graph import connected_components

    by, cells = list(by), [f"cell{i}" for i in range(len(xyz))]
    places, links = _touching(points, radius, by, None, key, xyz)
    own = _in_cells(points.select(*by, key, *xyz), xyz, radius / len(xyz) ** 0.5 * (1 - 1e-6)).join(places, [*by, *cells])
    return connected_components(own.select(F.col(key).alias("a"), F.col("low").alias("b")).unionAll(links.select("a", "b")), "a", "b")


def interpolate(neighbours: DataFrame, features: DataFrame, value: str, by: Sequence[str] = (), query_key: str = "point_id", key: str = "point_id") -> DataFrame:
    """Inverse-square-distance weighted mean of the neighbours' feature."""
    own = features.select(*by, F.col(key).alias("other"), F.col(value).alias("f"))
    w = 1 / (F.col("d2") + 1e-8)
    return neighbours.join(own, [*by, "other"]).groupBy(*by, query_key).agg((F.sum(w * F.col("f")) / F.sum(w)).alias(value))


def knn_mean(neighbours: DataFrame, features: DataFrame, value: str, by: Sequence[str] = (), query_key: str = "point_id", key: str = "point_id") -> DataFrame:
    own = features.select(*by, F.col(key).alias("other"), F.col(value).alias("f"))
    return neighbours.join(own, [*by, "other"]).groupBy(*by, query_key).agg(F.avg("f").alias(value))


def _covered(lo: Column, hi: Column, size: Column | float) -> Column:
    return F.explode(F.sequence(_cell(lo, size), _cell(hi, size)))


#: Points or shapes of a cell that a task compares at a time, and the points that it holds against them at once.
BLOCK, CHUNK = 4096, 32


class _Segments:
    """Segments of a block: distances to them from below, and exact ones."""

    fields = ("qx", "qy", "qz", "t")

    def __init__(self, corners: Sequence[np.ndarray], centre: np.ndarray) -> None:
        self.a, self.b = corners
        near, gap = self.a - centre, self.b - self.a
        length = np.sqrt((gap * gap).sum(axis=1))
        with np.errstate(all="ignore"):
            self.u = np.where((length > 0)[:, None], gap / length[:, None], 0.0)
        self.near, self.along, self.size, self.length = near, (near * self.u).sum(axis=1), (near * near).sum(axis=1), length

    def below(self, p: np.ndarray) -> np.ndarray:
        """Squared distances of points about the centre to the lines, and along these to the segments."""
        along, low = p @ self.u.T, p @ (-2 * self.near.T)
        along -= self.along
        low += self.size
        low += (p * p).sum(axis=1)[:, None]
        # the square of what lies along the line, less what lies beyond the ends
        inside = np.clip(along, 0.0, self.length)
        along -= inside
        inside *= inside + 2 * along
        low -= inside
        return low

    def exact(self, p: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        d, q, t = _on_segment(p, self.a[at], self.b[at])
        return d, [*q.T, t]


class _Triangles:
    """Triangles of a block: distances to them from below, and exact ones."""

    fields = ()

    def __init__(self, corners: Sequence[np.ndarray], centre: np.ndarray) -> None:
        self.a, self.b, self.c = corners
        ab, ac = self.b - self.a, self.c - self.a
        normal = np.cross(ab, ac)
        size, sides = np.sqrt((normal * normal).sum(axis=1)), np.sqrt((ab * ab).sum(axis=1) * (ac * ac).sum(axis=1))
        with np.errstate(all="ignore"):
            # the plane of a sliver is uncertain: all its distances are looked at
            self.u = np.where((size > 1e-8 * sides)[:, None], normal / size[:, None], 0.0)
            self.out = []  # in the plane, away from the triangle at each of its sides
            for start, end in ((self.a, self.b), (self.b, self.c), (self.c, self.a)):
                side = end - start
                length = np.sqrt((side * side).sum(axis=1))
                away = np.where((length > 0)[:, None], np.cross(side, self.u) / length[:, None], 0.0)
                self.out.append((away, ((start - centre) * away).sum(axis=1)))
        self.along = ((self.a - centre) * self.u).sum(axis=1)

    def below(self, p: np.ndarray) -> np.ndarray:
        """Squared distances of points about the centre to the planes, and in these to the lines of the sides they lie beyond."""
        past = np.zeros((len(p), len(self.u)))
        for away, offset in self.out:
            beyond = p @ away.T
            beyond -= offset
            np.maximum(past, beyond, out=past)
        past *= past
        low = p @ self.u.T
        low -= self.along
        low *= low
        low += past
        return low

    def exact(self, p: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """As :func:`pointweave.functions.geometry.point_triangle`."""
        a, b, c = self.a[at], self.b[at], self.c[at]
        ab, ac, ap = b - a, c - a, p - a
        n = _crossed(ab, ac)
        nn = _dotted(n, n)
        with np.errstate(all="ignore"):
            u, v = _dotted(_crossed(ab, ap), n) / nn, _dotted(_crossed(ap, ac), n) / nn
            inside = (nn > 0) & (u >= 0) & (v >= 0) & (u + v <= 1)
            height = _dotted(ap, n)
            least = np.fmin(np.fmin(_on_segment(p, a, b)[0], _on_segment(p, b, c)[0]), _on_segment(p, c, a)[0])
            return np.sqrt(np.where(inside, height * height / nn, least * least)), []


def _dotted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[:, 0] * b[:, 0] + a[:, 1] * b[:, 1] + a[:, 2] * b[:, 2]


def _crossed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([a[:, i] * b[:, j] - a[:, j] * b[:, i] for i, j in ((1, 2), (2, 0), (0, 1))], axis=1)


def _on_segment(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`pointweave.functions.geometry.segment_project`."""
    ab = b - a
    length2 = _dotted(ab, ab)
    with np.errstate(all="ignore"):
        t = np.where(length2 > 0, np.maximum(np.minimum(_dotted(p - a, ab) / length2, 1.0), 0.0), 0.0)
    q = a + t[:, None] * ab
    return np.sqrt(_dotted(p - q, p - q)), q, t


def _least(p: np.ndarray, corners: Sequence[np.ndarray], names: np.ndarray, part: np.ndarray, kind: type, bound: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of each point and part, the shape of least (distance to 12 digits, name): point, shape, distance, further fields.

    Without a bound the parts are one.  Products of matrices tell how far points lie from lines and planes and past their ends and sides, which bounds
    distances from below; the shapes that look nearest in 16 stretches bound the least one from above, and only what lies
    between is computed, by the formulas of the column expressions.
    """
    centre = (p.min(axis=0) + p.max(axis=0)) / 2
    shapes = kind(corners, centre)
    scale = max(np.abs(x - centre).max() for x in (p, *corners))
    slack = 1e-11 + 1e-7 * scale
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    stretches = np.unique(np.linspace(0, len(names), min(16, len(names)) + 1).astype(int))
    chunk = max(CHUNK, CHUNK * BLOCK // max(1, len(names)))
    for lo in range(0, len(p), chunk):
        own = p[lo : lo + chunk]
        low = shapes.below(own - centre)
        if bound is None:
            first = np.stack([low[:, x:y].argmin(axis=1) + x for x, y in zip(stretches, stretches[1:])], axis=1)
            upper = np.fmin.reduce(shapes.exact(np.repeat(own, first.shape[1], axis=0), first.ravel())[0].reshape(first.shape), axis=1)
        else:
            upper = np.full(len(own), bound)
        row, at = np.nonzero(~(low > ((upper + slack) ** 2)[:, None]))
        d = np.concatenate([shapes.exact(own[row[i : i + 65536]], at[i : i + 65536])[0] for i in range(0, len(row), 65536)] or [np.zeros(0)])
        if bound is not None:
            row, at, d = row[d < bound], at[d < bound], d[d < bound]
        order = np.lexsort((d, names[at], np.floor(d * 1e12 + 0.5), part[at], row))
        row, at, d = row[order], at[order], d[order]
        new = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(part[at], prepend=-1) != 0))
        found.append((row[new] + lo, at[new], d[new]))
    row, at, d = (np.concatenate(x) for x in zip(*found))
    return row, at, d, shapes.exact(p[row], at)[1]


def _dealt(asked: DataFrame, grown: DataFrame, place: Sequence[str], key: str, other: str, ask: Sequence[str], tell: Sequence[str]) -> list[GroupedData]:
    """Both sides of the cells (``place``) where they meet, with cell_id, one and two (their block), grouped by task.

    The rows of a cell are dealt to blocks of about ``BLOCK`` by the hashes of their
    keys, and each block of one side meets each of the other, so a full cell is shared by many tasks.
    A task gets many small cells at a time.  ``ask`` and ``tell`` are the columns that the sides bring.
    """
    place = list(place)
    counts = asked.groupBy(*place).agg(F.count(F.lit(1)).alias("pn")).join(grown.groupBy(*place).agg(F.count(F.lit(1)).alias("sn")), place)
    met = durable(counts.select(*place, "pn", "sn", F.monotonically_increasing_id().alias("cell_id"), *(F.ceil(F.col(n) / BLOCK).alias(b) for n, b in (("pn", "pb"), ("sn", "sb")))), "cells")
    rows, pairs = met.agg(F.coalesce(F.sum(F.col("pn") * F.col("sb") + F.col("sn") * F.col("pb")), F.lit(0)), F.coalesce(F.sum(F.col("pn").cast("double") * F.col("sn")), F.lit(0.0))).first()
    tasks = max(1, min(10_000, int(max(rows / 20_000, pairs / 20_000_000))))
    deal = F.pmod(F.xxhash64("cell_id", "one", "two"), F.lit(4 * tasks)).alias("deal")
    points = asked.join(met, place).select(F.col("cell_id").alias("cell_id"), F.pmod(F.xxhash64(key), "pb").alias("one"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("sb") - 1)).alias("two"), *ask)
    shapes = grown.join(met, place).select(F.col("cell_id").alias("cell_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("pb") - 1)).alias("one"), F.pmod(F.xxhash64(other), "sb").alias("two"), *tell)
    return [df.withColumn("deal", deal).repartition(tasks, "deal").groupBy("deal") for df in (points, shapes)]


def _compared(asked: DataFrame, grown: DataFrame, by: Sequence[str], cells: Sequence[str], key: str, shape_key: str, xyz: Sequence[str], corners: Sequence[Sequence[str]], kind: type, per: Sequence[str] = (), bound: float | None = None) -> DataFrame:
    """by, per, key, shape_key, distance and further fields: what :func:`_least` finds in each block of points and shapes that share a cell."""
    by, per = list(by), list(per)
    flat = [c for corner in corners for c in corner]
    kinds = dict(asked.dtypes) | {c: t for c, t in grown.dtypes if c in (*per, shape_key)}
    names = [*by, *per, key, shape_key]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "distance double", *(f"`{c}` double" for c in kind.fields)])
    block = ["cell_id", "one", "two"]

    def nearest(p: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        of = s.groupby(block, sort=False).indices if len(p) and len(s) else {}
        own, ends, ids = p[list(xyz)].to_numpy(float), [s[list(c)].to_numpy(float) for c in corners], s[shape_key].to_numpy()
        part = s.groupby(per, sort=False, dropna=False).ngroup().to_numpy() if per and len(s) else np.zeros(len(s), np.int64)
        out = []
        for name, at in p.groupby(block, sort=False).indices.items() if of else ():
            to = of.get(name)
            if to is not None:
                row, hit, d, more = _least(own[at], [c[to] for c in ends], ids[to], part[to], kind, bound)
                out.append((at[row], to[hit], d, *more))
        if not out:
            return pd.DataFrame({c: [] for c in (*names, "distance", *kind.fields)})
        row, to, *told = (np.concatenate(c) for c in zip(*out))
        got = {c: p[c].to_numpy()[row] for c in (*by, key)} | {c: s[c].to_numpy()[to] for c in (*per, shape_key)}
        return pd.DataFrame({c: got[c] for c in names} | dict(zip(("distance", *kind.fields), told)))

    dealt = _dealt(asked, grown, [*by, "shape_level", *cells], key, shape_key, [*by, key, *xyz], [*per, shape_key, *flat])
    return dealt[0].cogroup(dealt[1]).applyInPandas(nearest, schema)


def _reachable(asked: DataFrame, grown: DataFrame, radius: float, by: Sequence[str], key: str, xyz: Sequence[str], ask: Sequence[str], tell: Sequence[str]) -> tuple[GroupedData, GroupedData]:
    """:func:`_dealt` of points and of those around: ``by``, key, coordinates and the columns ``ask`` and ``tell``."""
    cells = [f"cell{i}" for i in range(len(xyz))]
    known = " AND ".join(f"{c} IS NOT NULL" for c in xyz)
    left = _in_cells(asked.where(known).select(*by, key, *xyz, *ask), xyz, 2 * radius)
    right = grown.where(known).select(*(F.col(c).alias(c) for c in (*by, key, *xyz, *tell)))
    for i, c in enumerate(xyz):
        right = right.withColumn(cells[i], _covered(F.col(c) - radius * (1 + 1e-9), F.col(c) + radius * (1 + 1e-9), 2 * radius))
    one, two = _dealt(left, right, [*by, *cells], key, key, [*by, key, *xyz, *ask], [key, *xyz, *tell])
    return one, two


def _blocks(q: pd.DataFrame, p: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of both sides in each block that they share."""
    block = ["cell_id", "one", "two"]
    of = p.groupby(block, sort=False).indices if len(q) and len(p) else {}
    for name, at in q.groupby(block, sort=False).indices.items() if of else ():
        if name in of:
            yield at, of[name]


def _square(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of both, summed as :func:`_d2` does."""
    out = (x[:, 0][:, None] - y[:, 0]) ** 2
    for i in range(1, x.shape[1]):
        gap = x[:, i][:, None] - y[:, i]
        gap *= gap
        out += gap
    return out


def within_reach(queries: DataFrame, points: DataFrame, radius: float, by: Sequence[str] = (), key: str = "point_id", xyz: Sequence[str] = XYZ, apart: str | None = None) -> DataFrame:
    """by and key of the queries with a point nearer than the radius, or, with ``apart``, one whose value of that column is another.

    No pairs are listed: a block of queries looks at points by stretches until each has found one.
    """
    more, names, kinds = [apart] if apart else [], [*by, key], dict(queries.dtypes)

    def near(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        x, y, found = q[list(xyz)].to_numpy(float), p[list(xyz)].to_numpy(float), [np.zeros(0, int)]
        for at, to in _blocks(q, p):
            for lo in range(0, len(to), 256):
                seen = to[lo : lo + 256]
                hit = _square(x[at], y[seen]) < radius * radius
                if apart:
                    hit &= q[apart].to_numpy()[at][:, None] != p[apart].to_numpy()[seen]
                any_ = hit.any(axis=1)
                found.append(at[any_])
                at = at[~any_]
                if not len(at):
                    break
        return q[names].iloc[np.concatenate(found)]

    known = [df.where(f"{apart} IS NOT NULL") if apart else df for df in (queries, points)]
    one, two = _reachable(*known, radius, by, key, xyz, more, more)
    return one.cogroup(two).applyInPandas(near, ", ".join(f"`{c}` {kinds[c]}" for c in names)).distinct()


#: Most words of 64 bits in which a row of :func:`ball_paths` notes seeds of its group.
WORDS = 8


def ball_paths(points: DataFrame, pairs: DataFrame, radius: float, every: int = 10, by: Sequence[str] = (), key: str = "point_id", xyz: Sequence[str] = XYZ) -> DataFrame:
    """:func:`pointweave.operators.graph.shortest_paths` of the radius graph, whose edges are never listed: seed, target, node, hop.

    pairs: seed, target; both are keys of points, which no two points share.  A group's seeds are numbered, and a point has one bit for
    each: those that have reached it.  A level is an or of the bits of the points within the radius, block by block.
    Seeds all of whose targets are reached go no further.  Predecessors are looked up only on the
    paths of targets farther than ``every``, from the last level back, as nearer ones show their ends only.
    """
    from pointweave.operators.tables import numbered

    by, kinds = list(by), dict(points.dtypes)
    at = [*by, "part"]
    ids = [*at, key]
    own = durable(points.where(" AND ".join(f"{c} IS NOT NULL" for c in (key, *xyz))).select(*by, key, *xyz), "paths")
    seeds = durable(numbered(own.join(pairs.select(F.col("seed").alias(key)).distinct(), key, "left_semi"), key, by=by, name="nth"), "paths")
    words = min(WORDS, (seeds.agg(F.max("nth")).first()[0] or 0) // 64 + 1)
    w, t, size = [f"w{i}" for i in range(words)], [f"t{i}" for i in range(words)], 64 * words
    word = lambda i: F.when(F.expr("bit div 64") == i, F.expr("shiftleft(1L, cast(bit % 64 AS int))")).otherwise(F.lit(0).cast("long"))
    either = lambda df, names, *more: df.groupBy(*names).agg(*(F.bit_or(c).alias(c) for c in w), *more)
    any_of = lambda f: F.expr(" OR ".join(f"{f(i)} <> 0" for i in range(words)))
    seeds = seeds.withColumns({"part": F.expr(f"nth div {size}"), "bit": F.expr(f"nth % {size}")}).withColumnRenamed(key, "seed").drop("nth")
    wanted = pairs.select("seed", "target").join(seeds.select(*at, "seed", "bit"), "seed").groupBy(*at, F.col("target").alias(key)).agg(*(F.bit_or(word(i)).alias(c) for i, c in enumerate(t)))
    parts = seeds.select(*at).distinct()
    every_one = own.join(parts, by) if by else own.crossJoin(parts)
    level = durable(seeds.select(*at, F.col("seed").alias(key), *xyz, *(word(i).alias(c) for i, c in enumerate(w))), "paths")
    # w: seeds that have reached the point, t: seeds whose target it is
    state = every_one.join(wanted, ids, "left").select(*ids, *xyz, *(F.lit(0).cast("long").alias(c) for c in w), *(F.coalesce(c, F.lit(0)).alias(c) for c in t))
    schema = ", ".join([*(f"`{c}` {kinds.get(c, 'long')}" for c in ids), *(f"`{c}` double" for c in xyz), *(f"{c} long" for c in w)])

    def spread(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        x, y, open_, bits = q[list(xyz)].to_numpy(float), p[list(xyz)].to_numpy(float), q[w].to_numpy(np.int64), p[w].to_numpy(np.int64)
        rows, told = [np.zeros(0, int)], [np.zeros((0, len(w)), np.int64)]
        for mine, to in _blocks(q, p):
            used = np.flatnonzero(bits[to].any(axis=0) & open_[mine].any(axis=0))
            held = np.ascontiguousarray(bits[to][:, used])
            for lo in range(0, len(mine) if len(used) else 0, CHUNK * 8):
                asking = mine[lo : lo + CHUNK * 8]
                row, near = np.nonzero(_square(x[asking], y[to]) <= radius * radius)
                if len(row):
                    start = np.flatnonzero(np.diff(row, prepend=-1))
                    got = np.zeros((len(start), len(w)), np.int64)
                    got[:, used] = np.bitwise_or.reduceat(held[near], start, axis=0)
                    got &= open_[asking[row[start]]]
                    new = got.any(axis=1)
                    rows.append(asking[row[start]][new])
                    told.append(got[new])
        out = q[[*ids, *xyz]].iloc[np.concatenate(rows)].reset_index(drop=True)
        return pd.concat([out, pd.DataFrame(np.concatenate(told), columns=w)], axis=1)

    levels, states, hits, hop = [], [], [], 0
    while True:
        new = level.select(*ids, *(F.col(c).alias(f"n{c}") for c in w))
        met = [F.coalesce(F.col(f"n{c}").bitwiseAND(F.col(d)), F.lit(0)).alias(f"h{i}") for i, (c, d) in enumerate(zip(w, t))]
        state = durable(state.join(new, ids, "left").select(*ids, *xyz, *(F.coalesce(F.col(c).bitwiseOR(F.col(f"n{c}")), c).alias(c) for c in w), *t, *met), "paths")
        hits.append(state.where(any_of(lambda i: f"h{i}")).select(*ids, *(F.col(f"h{i}").alias(c) for i, c in enumerate(w)), F.lit(hop).cast("long").alias("hop")))
        levels.append(level)
        states.append(state)
        left = state.groupBy(*at).agg(*(F.bit_or(F.expr(f"{b} & ~{a}")).alias(f"o{i}") for i, (a, b) in enumerate(zip(w, t))))
        left = durable(left.where(any_of(lambda i: f"o{i}")), "paths")
        if left.isEmpty():
            break
        going = level.join(left, at).select(*ids, *xyz, *(F.col(c).bitwiseAND(F.col(f"o{i}")).alias(c) for i, c in enumerate(w))).where(any_of(lambda i: w[i]))
        asked = state.join(left, at).select(*ids, *xyz, *(F.expr(f"o{i} & ~{c}").alias(c) for i, c in enumerate(w))).where(any_of(lambda i: w[i]))
        one, two = _reachable(asked, going, radius, at, key, xyz, w, w)
        found = one.cogroup(two).applyInPandas(spread, schema)
        level = durable(either(found, ids, *(F.first(c).alias(c) for c in xyz)).select(*ids, *xyz, *w), "paths")
        if level.isEmpty():
            break
        hop += 1
    told = hits[0]
    for more in hits[1:]:
        told = told.unionAll(more)
    # one row for each seed whose bit is set
    set_ = F.expr(f"getbit(element_at(array({', '.join(w)}), cast(bit div 64 AS int) + 1), cast(bit % 64 AS int)) = 1")
    ends = durable(told.join(seeds.select(*at, "seed", "bit"), at).where(set_).select(*at, "bit", "seed", F.col(key).alias("target"), "hop"), "paths")
    out = ends.select("seed", "target", F.col("target").alias("node"), "hop").unionAll(ends.where("hop > 0").select("seed", "target", F.col("seed").alias("node"), F.lit(0).cast("long").alias("hop")))

    def backs(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(key, kind="stable")
        x, y, names = q[list(xyz)].to_numpy(float), p[list(xyz)].to_numpy(float), p[key].to_numpy()
        open_, bits = np.ascontiguousarray(q[w].to_numpy(np.int64)), p[w].to_numpy(np.int64)
        rows, places, prior = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0, int)]
        for mine, to in _blocks(q, p):
            to = np.sort(to)  # by key: the first to know a seed is the least
            for lo in range(0, len(mine), 1024):
                asking = mine[lo : lo + 1024]
                near, pending = _square(x[asking], y[to]) <= radius * radius, open_[asking]
                for k in np.flatnonzero(near.any(axis=0)):
                    own_ = np.flatnonzero(near[:, k])
                    got = pending[own_] & bits[to[k]]
                    hit = got.any(axis=1)
                    if hit.any():
                        pending[own_[hit]] ^= got[hit]
                        r, b = np.nonzero(np.unpackbits(got[hit].astype("<i8").view(np.uint8), axis=1, bitorder="little"))
                        rows.append(asking[own_[hit][r]])
                        places.append(b)
                        prior.append(np.full(len(r), to[k]))
                        if not pending.any():
                            break
        got = q[[*at, key]].iloc[np.concatenate(rows)].reset_index(drop=True).rename(columns={key: "node"})
        return got.assign(bit=np.concatenate(places), back=names[np.concatenate(prior)])

    step = ", ".join([*(f"`{c}` {kinds.get(c, 'long')}" for c in at), f"node {kinds[key]}", "bit long", f"back {kinds[key]}"])
    here = None
    for h in range(hop, every, -1):
        # nodes of the paths at this level, and the least node before each
        walking = ends.where(F.col("hop") == h).select(*at, "bit", "seed", "target", F.col("target").alias("node"))
        here = walking if here is None else walking.unionAll(here)
        asked = here.select(*at, F.col("node").alias(key), "bit").groupBy(*at, key).agg(*(F.bit_or(word(i)).alias(c) for i, c in enumerate(w))).join(own, [*by, key])
        one, two = _reachable(asked, levels[h - 1], radius, at, key, xyz, w, w)
        least = one.cogroup(two).applyInPandas(backs, step).groupBy(*at, "node", "bit").agg(F.min("back").alias("back"))
        here = durable(here.join(least, [*at, "node", "bit"]).select(*at, "bit", "seed", "target", F.col("back").alias("node")), "paths")
        if (h - 1) % every == 0:
            out = out.unionAll(here.select("seed", "target", "node", F.lit(h - 1).cast("long").alias("hop")))
    release(*levels, *states, own)
    return out


def _nearest(points: DataFrame, shapes: DataFrame, by: Sequence[str], key: str, shape_key: str, corners: Sequence[Sequence[str]], kind: type, size: float | None, xyz: Sequence[str]) -> DataFrame:
    """The shape of least (distance to 12 digits, id) of each point, by growing reach.

    Every group has a first reach of its own, about the spacing of the middle nine tenths
    of its shapes, so groups far apart or of other sizes do not widen each other's cells.
    Shapes have levels by size, and each level cells of its own size, so that a large shape
    covers few cells however fine the others are; a point looks into its cell of
    every level that its group has.  A round copies the shapes of groups with open
    points to the cells that their boxes, grown by the reach, cover; points whose nearest
    shape is within the reach are settled, and all of a group once the reach is its extent.
    Groups of up to ``WHOLE`` shapes are one cell, and settled in the first round.
    """
    axes = range(3)
    cells, corner = [f"cell{i}" for i in axes], [f"corner{i}" for i in axes]
    ids = [*by, key]
    low, high = aabb(corners)
    tails = [F.percentile_approx(l, [0.05, 0.95], 1000).alias(f"mid{i}") for i, l in enumerate(low)]
    spans = shapes.groupBy(*by).agg(F.count(F.lit(1)).alias("held"), *tails, *(F.min(l).alias(f"lo{i}") for i, l in enumerate(low)), *(F.max(h).alias(f"hi{i}") for i, h in enumerate(high)))
    own = points.groupBy(*by).agg(*(f(c).alias(f"q{n}{i}") for i, c in enumerate(xyz) for n, f in (("lo", F.min), ("hi", F.max))))
    grids = spans.join(own, list(by)) if by else spans.join(F.broadcast(own))
    middle = F.greatest(*((F.col(f"mid{i}")[1] - F.col(f"mid{i}")[0]) / 0.9 for i in axes))
    spread = F.when(middle > 0, middle).otherwise(F.greatest(*(F.col(f"hi{i}") - F.col(f"lo{i}") for i in axes))) * F.pow(F.col("held"), F.lit(-1 / 3)) if size is None else F.lit(float(size))
    extent = sum((F.greatest(f"hi{i}", f"qhi{i}") - F.least(f"lo{i}", f"qlo{i}") for i in axes), F.lit(0.0))
    grids = grids.where("held > 0").withColumn("extent", extent).where("extent IS NOT NULL").withColumn("base", F.when(F.col("held") <= WHOLE, 2 * F.col("extent")).otherwise(F.greatest(spread, F.col("extent") * 2.0**-40)))
    grids = durable(grids.select(*by, "extent", (F.col("held") <= WHOLE).alias("whole"), F.when(F.col("base") > 0, F.col("base")).otherwise(1.0).alias("base"), *(F.least(f"lo{i}", f"qlo{i}").alias(c) for i, c in enumerate(corner))), "grids")
    with_grid = lambda df: df.join(grids, list(by)) if by else df.join(F.broadcast(grids))
    side = F.greatest(*(h - l for l, h in zip(low, high)), F.col("base"))
    shapes = durable(with_grid(shapes).withColumn("shape_level", F.least(F.greatest(F.ceil(F.log2(side / F.col("base"))), F.lit(0)), F.lit(60)).cast("int")), "shapes")
    levels = shapes.groupBy(*by).agg(F.collect_set("shape_level").alias("levels"))  # at most 61 in a group
    placed = with_grid(points.select(*ids, *xyz))
    pending = durable(placed.join(levels, list(by)) if by else placed.join(F.broadcast(levels)), "points")
    asking, done = shapes, []
    for step in range(MAX_ROUNDS):
        reach = F.col("base") * float(2**step)
        cell = F.greatest(reach, F.col("base") * F.pow(F.lit(2.0), F.col("shape_level")))
        grown = asking
        for i in axes:
            # no cells beyond the group, which has no points there
            lo, hi = F.greatest(low[i] - reach - F.col(corner[i]), F.lit(0.0)), F.least(high[i] + reach - F.col(corner[i]), F.col("extent"))
            grown = grown.withColumn(cells[i], _covered(F.when(low[i].isNotNull(), lo), F.when(high[i].isNotNull(), hi), cell))
        asked = pending.withColumn("shape_level", F.explode("levels")).drop("levels")
        near = _compared(_in_cells(asked, xyz, cell, corner), grown, by, cells, key, shape_key, xyz, corners, kind)
        best = near.groupBy(*ids).agg(F.min(F.struct(F.round("distance", 12).alias("rounded"), F.col(shape_key), "distance", *kind.fields)).alias("best"))
        found = with_grid(best).where((F.col("best.distance") <= reach) | (reach >= F.col("extent")))
        settled = durable(found.select(*ids, F.col("best.distance").alias("distance"), F.col(f"best.{shape_key}").alias(shape_key), *(F.col(f"best.{n}").alias(n) for n in kind.fields)), "nearest")
        done.append(settled)
        if step == 0 and grids.where("NOT whole").isEmpty():
            break
        before, pending = pending, durable(pending.where(reach < F.col("extent")).join(settled.select(*ids), ids, "left_anti"), "nearest")
        release(before)
        if pending.isEmpty():
            break
        asking = shapes.join(pending.select(*by).distinct(), list(by), "left_semi") if by else shapes
    release(shapes, grids, pending)
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out


#: Points times parts of the faces near them that a block of :func:`faces_within` has; points of a task of :func:`nearest_of_few`, and segments of a group up to which it serves.
MEETINGS, ROWS, SEGMENTS = 1_000_000, 200_000, 64


def faces_within(points: DataFrame, faces: DataFrame, bound: float, by: Sequence[str], per: Sequence[str], key: str = "point_id", face_key: str = "fid", corners: Sequence[Sequence[str]] = (("ax", "ay", "az"), ("bx", "by_", "bz"), ("cx", "cy", "cz")), xyz: Sequence[str] = XYZ) -> DataFrame:
    """The nearest triangle of each point in every part (``per``) of the faces that comes nearer than ``bound``: by, per, key, coordinates, face_key, distance.

    The points of a group lie in cells of about ``BLOCK`` by the density of its middle; parts, and of these the faces, whose boxes
    reach the points of a cell go there.  All faces that a part has near a cell are in one task, so what is found there is the
    result and not sent on, unless a part has more than ``BLOCK`` of them.
    """
    by, per, axes = list(by), list(per), range(len(xyz))
    cells, flat = [f"cell{i}" for i in axes], [c for corner in corners for c in corner]
    low, high = aabb(corners)
    known = points.where(" AND ".join(f"{c} IS NOT NULL" for c in xyz)).select(*by, key, *xyz)
    tails = [F.percentile_approx(c, [0.05, 0.95], 1000).alias(f"mid{i}") for i, c in enumerate(xyz)]
    middle = F.greatest(*((F.col(f"mid{i}")[1] - F.col(f"mid{i}")[0]) / 0.9 for i in axes))
    grids = known.groupBy(*by).agg(F.count(F.lit(1)).alias("held"), *tails).select(*by, F.greatest(F.lit(2.0 * bound), middle * F.pow(BLOCK / 2 / F.col("held"), F.lit(1 / 3))).alias("side"))
    asked = _in_cells(known.join(durable(grids, "grids"), by), xyz, F.col("side")).drop("side")
    box = [f(c).alias(f"{m}{i}") for i, c in enumerate(xyz) for m, f in (("from", F.min), ("to", F.max))]
    held = durable(asked.groupBy(*by, *cells).agg(F.count(F.lit(1)).alias("pn"), *box).withColumn("cell_id", F.monotonically_increasing_id()), "cells")
    reach = [c for i in axes for c in ((low[i] - bound * (1 + 1e-9)).alias(f"lo{i}"), (high[i] + bound * (1 + 1e-9)).alias(f"hi{i}"))]
    boxed = faces.select(*by, *per, face_key, *flat, *reach)
    parts = boxed.groupBy(*by, *per).agg(*(f(f"{m}{i}").alias(f"{m}{i}") for i in axes for m, f in (("lo", F.min), ("hi", F.max))))
    touch = " AND ".join(f"lo{i} <= to{i} AND hi{i} >= from{i}" for i in axes)
    sides = [f"{m}{i}" for i in axes for m in ("from", "to")]
    grown = held.join(parts, by).where(touch).select("cell_id", *by, *per, *sides).join(boxed, [*by, *per]).where(touch).select("cell_id", *per, face_key, *flat)
    each = grown.groupBy("cell_id", *per).agg(F.count(F.lit(1)).alias("n")).groupBy("cell_id").agg(F.sum("n").alias("sn"), F.count(F.lit(1)).alias("parts"), F.max("n").alias("most"))
    dealt = each.join(held, "cell_id").withColumn("sb", F.ceil(F.col("sn") / BLOCK))
    room = F.greatest(F.lit(1.0), F.least(F.lit(float(BLOCK)), MEETINGS / F.ceil(F.col("parts") / F.col("sb"))))
    met = durable(dealt.select("cell_id", *by, *cells, "pn", "sn", "parts", "most", "sb", F.ceil(F.col("pn") / room).alias("pb")), "cells")
    meetings, pairs, most = met.agg(F.sum(F.col("pn").cast("double") * F.col("parts")), F.sum(F.col("pn").cast("double") * F.col("sn")), F.max("most")).first()
    tasks, split = max(1, min(10_000, int(max((meetings or 0) / MEETINGS, (pairs or 0) / 20_000_000)))), (most or 0) > BLOCK
    deal = F.pmod(F.xxhash64("cell_id", "one", "two"), F.lit(4 * tasks)).alias("deal")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = asked.join(met, [*by, *cells]).select("cell_id", F.pmod(F.xxhash64(key), "pb").alias("one"), every("sb").alias("two"), *by, key, *xyz)
    own = F.pmod(F.xxhash64(face_key) if split else F.xxhash64(*per), "sb")
    right = grown.join(met.select("cell_id", "pb", "sb"), "cell_id").select("cell_id", every("pb").alias("one"), own.alias("two"), *per, face_key, *flat)
    kinds = dict(points.dtypes) | {c: t for c, t in faces.dtypes if c in (*per, face_key)}
    names = [*by, *per, key, face_key]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "distance double", *(f"`{c}` double" for c in xyz)])

    def nearest(p: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        at, ends, ids = p[list(xyz)].to_numpy(float), [s[list(c)].to_numpy(float) for c in corners], s[face_key].to_numpy()
        part = s.groupby(per, sort=False, dropna=False).ngroup().to_numpy() if len(s) else np.zeros(0, np.int64)
        out = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        for mine, to in _blocks(p, s):
            row, hit, d, _ = _least(at[mine], [c[to] for c in ends], ids[to], part[to], _Triangles, bound)
            out.append((mine[row], to[hit], d))
        row, hit, d = (np.concatenate(c) for c in zip(*out))
        got = {c: p[c].to_numpy()[row] for c in (*by, key)} | {c: s[c].to_numpy()[hit] for c in (*per, face_key)}
        return pd.DataFrame({c: got[c] for c in names} | {"distance": d} | {c: at[row, i] for i, c in enumerate(xyz)})

    one, two = (df.withColumn("deal", deal).repartition(tasks, "deal").groupBy("deal") for df in (left, right))
    near = one.cogroup(two).applyInPandas(nearest, schema)
    if not split:
        return near.select(*by, *per, key, *xyz, face_key, "distance")
    best = near.groupBy(*by, *per, key, *xyz).agg(F.min(F.struct(F.round("distance", 12).alias("rounded"), F.col(face_key), "distance")).alias("best"))
    return best.select(*by, *per, key, *xyz, F.col(f"best.{face_key}").alias(face_key), F.col("best.distance").alias("distance"))


def nearest_of_few(points: DataFrame, segments: DataFrame, by: Sequence[str], key: str = "point_id", segment_key: str = "seg_id", a: Sequence[str] = ("ax", "ay", "az"), b: Sequence[str] = ("bx", "by_", "bz"), xyz: Sequence[str] = XYZ) -> DataFrame:
    """by, key, distance and segment_key as :func:`nearest_segment`, for groups of few segments each; nulls where a group has none.

    Points are sent once and results not at all: a task gets the points of many groups, or some of those of a large one, with all segments of these.
    """
    by, flat = list(by), [*a, *b]
    tasks = max(1, min(10_000, points.count() // ROWS))
    deal = lambda turn: F.pmod(F.xxhash64(*by, turn), F.lit(4 * tasks)).alias("deal")
    left = points.select(deal(F.pmod(F.xxhash64(key), F.lit(16))), *by, key, *xyz)
    held = segments.where(" AND ".join(f"{c} IS NOT NULL" for c in flat)).withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
    right = held.select(deal(F.col("turn")), *(F.col(c).alias(c) for c in (*by, segment_key, *flat))).distinct()
    kinds = dict(points.dtypes) | {segment_key: dict(segments.dtypes)[segment_key]}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (*by, key)), "distance double", f"`{segment_key}` {kinds[segment_key]}"])

    def nearest(p: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        group = pd.concat([s[by], p[by]], ignore_index=True).groupby(by, sort=False, dropna=False).ngroup().to_numpy()
        order = np.lexsort((s[segment_key].to_numpy(), group[: len(s)])) if len(s) else np.zeros(0, int)
        s, of = s.iloc[order], group[: len(s)][order]
        at, ends = p[list(xyz)].to_numpy(float), [s[list(c)].to_numpy(float) for c in (a, b)]
        first, n = (np.searchsorted(of, group[len(s) :], side) for side in ("left", "right"))
        n = np.where(np.isnan(at).any(axis=1), 0, n - first)
        d, hit = np.full(len(p), np.nan), np.full(len(p), -1)
        asking = np.flatnonzero(n)
        upto = np.cumsum(n[asking])
        for own in np.split(asking, np.searchsorted(upto, np.arange(500_000, upto[-1], 500_000))) if len(asking) else ():
            if not len(own):
                continue
            start = np.cumsum(n[own]) - n[own]
            to = np.arange(n[own].sum()) + np.repeat(first[own] - start, n[own])
            row = np.repeat(own, n[own])
            far = _on_segment(at[row], ends[0][to], ends[1][to])[0]
            digits = np.floor(far * 1e12 + 0.5)
            tied = digits == np.repeat(np.minimum.reduceat(digits, start), n[own])
            best = np.minimum.reduceat(np.where(tied, np.arange(len(to)), len(to)), start)  # of ties the least id
            d[own], hit[own] = far[best], to[best]
        names = pd.Series(s[segment_key].to_numpy()[hit] if len(s) else np.zeros(len(p), np.int64))
        if (hit < 0).any():
            names = (names.astype("Int64") if names.dtype.kind in "iu" else names.astype(object)).mask(hit < 0)
        return pd.DataFrame({c: p[c].to_numpy() for c in (*by, key)} | {"distance": d, segment_key: names})

    one, two = (df.repartition(tasks, "deal").groupBy("deal") for df in (left, right))
    return one.cogroup(two).applyInPandas(nearest, schema)


def nearest_segment(points: DataFrame, segments: DataFrame, by: Sequence[str] = (), key: str = "point_id", segment_key: str = "seg_id", a: Sequence[str] = ("ax", "ay", "az"), b: Sequence[str] = ("bx", "by_", "bz"), reach: float | None = None, xyz: Sequence[str] = XYZ) -> DataFrame:
    """Distance, nearest segment and projection of each point; a tie goes to the least segment id."""
    return _nearest(points, segments, by, key, segment_key, [a, b], _Segments, reach, xyz)


def nearest_face(points: DataFrame, faces: DataFrame, by: Sequence[str] = (), key: str = "point_id", face_key: str = "fid", corners: Sequence[Sequence[str]] = (("ax", "ay", "az"), ("bx", "by_", "bz"), ("cx", "cy", "cz")), reach: float | None = None, xyz: Sequence[str] = XYZ) -> DataFrame:
    """Distance and nearest triangle of each point; a tie goes to the least face id."""
    return _nearest(points, faces, by, key, face_key, corners, _Triangles, reach, xyz)


#: Vectors of a tile; a task compares two tiles at a time.
VECTORS = 4096


def knn_feature(rows: DataFrame, k: int, group: str, key: str, vector: str) -> DataFrame:
    """k nearest in feature space inside each group, ranked by (d2 to 9 digits, key): group, key, other, d2, rank.

    Exact in any dimension.  A group is dealt to tiles of ``VECTORS`` rows by the hash of the key;
    a task multiplies two tiles and keeps k for each row, so what is sent on grows with
    rows x tiles and never with pairs.
    """
    from pointweave.operators.tables import numbered

    own = rows.select(group, key, F.transform(vector, lambda x: x.cast("double")).alias("u"), F.xxhash64(key).alias("turn"))
    nth = durable(numbered(own, "turn", key, by=[group], name="nth"), "vectors")
    sizes = nth.groupBy(group).agg(F.expr(f"(count(1) - 1) div {VECTORS}").alias("last"))
    tiled = nth.join(sizes, group).select(group, key, "u", F.expr(f"nth div {VECTORS}").alias("own"), F.sequence(F.lit(0).cast("long"), "last").alias("all"))
    left = tiled.select(group, F.col("own").alias("one"), F.explode("all").alias("two"), key, "u")
    right = tiled.select(F.col(group).alias(group), F.explode("all").alias("one"), F.col("own").alias("two"), F.col(key).alias("other"), F.col("u").alias("v"))
    kinds = dict(rows.dtypes)

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("other")
        y, names = np.stack(b["v"].to_numpy()) if len(b) else np.zeros((0, 1)), b["other"].to_numpy()
        parts = []
        for lo in range(0, len(a), 512) if len(b) else ():
            x, ids = np.stack(a["u"].to_numpy()[lo : lo + 512]), a[key].to_numpy()[lo : lo + 512]
            d2 = np.round((x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1), 9)
            # all that tie with the k-th, then the first k by (d2, key): names are in order
            most = np.partition(d2, min(k, len(y)) - 1, axis=1)[:, min(k, len(y)) - 1]
            row, at = np.nonzero(d2 <= most[:, None])
            order = np.lexsort((at, d2[row, at], row))
            row, at = row[order], at[order]
            start = np.searchsorted(row, np.arange(len(x)))
            kept = np.arange(len(row)) - start[row] < k
            parts.append(pd.DataFrame({group: a[group].iloc[0], key: ids[row[kept]], "other": names[at[kept]], "d2": d2[row[kept], at[kept]]}))
        return pd.concat(parts) if parts else pd.DataFrame({group: [], key: [], "other": [], "d2": []})

    pair = [group, "one", "two"]
    near = left.groupBy(*pair).cogroup(right.groupBy(*pair)).applyInPandas(nearest, f"`{group}` {kinds[group]}, `{key}` {kinds[key]}, other {kinds[key]}, d2 double")
    first = Window.partitionBy(group, key).orderBy("d2", "other")
    return near.withColumn("rank", F.row_number().over(first).cast("long")).where(F.col("rank") <= k)


def chamfer(a: DataFrame, b: DataFrame, by: Sequence[str], key: str = "point_id") -> DataFrame:
    """Mean squared nearest-neighbour distance each way, per group."""
    one = knn(a, b, 1, by, key, key).groupBy(*by).agg(F.avg("d2").alias("a_to_b"))
    two = knn(b, a, 1, by, key, key).groupBy(*by).agg(F.avg("d2").alias("b_to_a"))
    return one.join(two, list(by)).withColumn("chamfer", F.col("a_to_b") + F.col("b_to_a"))


def fbeta(a: DataFrame, b: DataFrame, by: Sequence[str], threshold: float, beta: float = 0.5, key: str = "point_id") -> DataFrame:
    """F-beta of a (prediction) against b (truth) from nearest-neighbour distances; 0 where undefined."""
    hit = F.avg((F.col("d2") < threshold * threshold).cast("double"))
    p = knn(a, b, 1, by, key, key).groupBy(*by).agg(hit.alias("precision"))
    r = knn(b, a, 1, by, key, key).groupBy(*by).agg(hit.alias("recall"))
    b2 = beta * beta
    f = (1 + b2) * F.col("precision") * F.col("recall") / F.nullif(b2 * F.col("precision") + F.col("recall"), F.lit(0.0))
    return p.join(r, list(by)).withColumn("fbeta", F.coalesce(f, F.lit(0.0)))


#: Points of a cell that :func:`farthest_pair` compares one by one, and the most halvings of its cells.
FEW, HALVINGS = 32, 16


def farthest_pair(points: DataFrame, by: Sequence[str], key: str = "point_id", xyz: Sequence[str] = XYZ, directions: int = 13) -> DataFrame:
    """The two most distant members of each group, ties by ids.

    The ends along fixed directions give a length that the longest pair has at least.
    Only points that can end such a pair are looked at, and of equal places the two least
    ids.  Cells of them form pairs whose boxes bound the distance from above; pairs
    under the length known go, cells of the others are halved along each axis and their
    members raise the length, until cells hold few points, which are compared.
    """
    by, axes = list(by), range(len(xyz))
    centre = points.groupBy(*by).agg(*(F.avg(c).alias(f"c_{c}") for c in xyz))
    steps = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) > (0, 0, 0)][:directions]
    along = lambda s: s[0] * F.col(xyz[0]) + s[1] * F.col(xyz[1]) + s[2] * F.col(xyz[2])
    # the span along a direction is at most sqrt(|s|^2) times a distance: a lower bound of the longest pair
    spans = points.groupBy(*by).agg(F.greatest(*((F.max(along(s)) - F.min(along(s))) / float(sum(x * x for x in s)) ** 0.5 for s in steps)).alias("span"), *(F.min(c).alias(f"lo_{c}") for c in xyz), F.greatest(*(F.max(c) - F.min(c) for c in xyz)).alias("side"))
    far = points.join(centre, by).withColumn("r", F.sqrt(_d2(xyz, [f"c_{c}" for c in xyz])))
    most = far.groupBy(*by).agg(F.max("r").alias("most"))
    ends = far.join(spans, by).join(most, by).where(F.col("r") + F.col("most") >= F.col("span") - 1e-9)
    two = ends.groupBy(*by, *xyz, "span", "side", *(f"lo_{c}" for c in xyz)).agg(F.min(key).alias("one"), F.max(key).alias("last"), F.count(F.lit(1)).alias("copies"))
    second = ends.join(two.where("copies > 1").select(*by, *xyz, "one"), [*by, *xyz]).where(F.col(key) > F.col("one")).groupBy(*by, *xyz).agg(F.min(key).alias("other"))
    kept = two.join(second, [*by, *xyz], "left").withColumn(key, F.explode(F.array_compact(F.array("one", "other"))))
    kept = durable(kept.select(*by, key, *xyz, "span", F.when(F.col("side") > 0, F.col("side")).otherwise(1.0).alias("side"), *(f"lo_{c}" for c in xyz)), "ends")

    def cut(level: int) -> list[Column]:
        return [F.least(F.floor((F.col(c) - F.col(f"lo_{c}")) / F.col("side") * float(2**level)), F.lit(2**level - 1)).cast("long").alias(f"cell{i}") for i, c in enumerate(xyz)]

    cells = [f"cell{i}" for i in axes]
    boxes_of = lambda level: kept.select("*", *cut(level)).groupBy(*by, *cells).agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{m}{i}") for i, c in enumerate(xyz) for m, f in (("min", F.min), ("max", F.max))), F.min(F.struct(key, *xyz)).alias("member"), F.first("span").alias("span"))
    sided = lambda df, s: df.select(*by, *(F.col(c).alias(f"{s}_{c}") for c in df.columns if c not in by))
    level, pairs, length = 2, None, None
    while True:
        boxes = durable(boxes_of(level), "boxes")
        a, b = sided(boxes, "a"), sided(boxes, "b").drop("b_span")
        if pairs is None:
            met = a.join(b, by)
        else:  # children of the pairs that are left
            parents = lambda s: [(F.expr(f"{s}_{c} div 2")).alias(f"{s}_up{i}") for i, c in enumerate(cells)]
            ups = lambda s: [f"{s}_up{i}" for i in axes]
            up = pairs.select(*by, *(F.col(f"{s}_{c}").alias(f"{s}_up{i}") for s in "ab" for i, c in enumerate(cells)))
            met = up.join(a.select("*", *parents("a")), [*by, *ups("a")]).join(b.select("*", *parents("b")), [*by, *ups("b")]).drop(*ups("a"), *ups("b"))
        met = met.where(F.struct(*(f"a_{c}" for c in cells)) <= F.struct(*(f"b_{c}" for c in cells)))
        widest = sum((F.pow(F.greatest(F.col(f"a_max{i}") - F.col(f"b_min{i}"), F.col(f"b_max{i}") - F.col(f"a_min{i}")), F.lit(2.0)) for i in axes), F.lit(0.0))
        gap = sum((F.pow(F.col(f"a_member.{c}") - F.col(f"b_member.{c}"), F.lit(2.0)) for c in xyz), F.lit(0.0))
        met = met.withColumns({"widest": F.sqrt(widest), "gap": F.sqrt(gap)}).where(F.col("widest") >= F.col("a_span") - 1e-9)
        met = durable(met.select(*by, *(f"{s}_{c}" for s in "ab" for c in cells), "a_n", "b_n", "a_span", "widest", "gap"), "pairs")
        length = met.groupBy(*by).agg(F.greatest(F.max("gap"), F.max("a_span")).alias("length"))
        before, pairs = pairs, durable(met.join(length, by).where(F.col("widest") >= F.col("length") - 1e-9), "pairs")
        release(met, boxes, *([before] if before is not None else []))
        if level == HALVINGS or (pairs.agg(F.max(F.greatest("a_n", "b_n"))).first()[0] or 0) <= FEW:
            break
        level += 1
    own = kept.select(*by, key, *xyz, *cut(level))
    one = own.select(*by, key, *xyz, *(F.col(c).alias(f"a_{c}") for c in cells))
    two = own.select(*by, *(F.col(c).alias(f"o_{c}") for c in (key, *xyz)), *(F.col(c).alias(f"b_{c}") for c in cells))
    found = pairs.select(*by, *(f"{s}_{c}" for s in "ab" for c in cells)).join(one, [*by, *(f"a_{c}" for c in cells)]).join(two, [*by, *(f"b_{c}" for c in cells)]).where(F.col(key) != F.col(f"o_{key}"))
    best = found.groupBy(*by).agg(F.min(F.struct((-F.round(_d2(xyz, [f"o_{c}" for c in xyz]), 9)).alias("far"), F.least(key, f"o_{key}").alias("a"), F.greatest(key, f"o_{key}").alias("b"))).alias("best"))
    return best.select(*by, F.col("best.a").alias("a"), F.col("best.b").alias("b"), F.sqrt(-F.col("best.far")).alias("length"))


#: Candidates of a group that :func:`farthest_points` looks at in a round.
CANDIDATES = 512


def farthest_points(points: DataFrame, k: int, by: Sequence[str], key: str = "point_id", xyz: Sequence[str] = XYZ) -> DataFrame:
    """Farthest-point sampling of every group at once, several winners a round: by, key, rank.

    Starts at the least id; ties go to the least id.  Rank 1 is the start.  A round takes
    the ``CANDIDATES`` points of a group that are farthest from all winners.  Among these
    the next winners are exact while their gaps exceed the least of the candidates', as no other point
    has a greater one.  Then the gaps of points are renewed, each by the winners that are nearer than
    the greatest gap.
    """
    by = list(by)
    start = points.groupBy(*by).agg(F.min(key).alias(key)).join(points.select(*by, key, *xyz), [*by, key])
    out = durable(start.select(*by, key, F.lit(1).cast("long").alias("rank")), "farthest")
    new = start.select(*by, F.col(key).alias("new_key"), *(F.col(c).alias(f"n_{c}") for c in xyz))
    gap = F.when(F.col(key) == F.col("new_key"), -1.0).otherwise(F.round(_d2(xyz, [f"n_{c}" for c in xyz]), 12))
    state = durable(points.select(*by, key, *xyz).join(new, by).select(*by, key, *xyz, gap.alias("gap")), "gaps")
    kinds = dict(points.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), f"{key} {kinds[key]}", *(f"{c} double" for c in xyz), "rank long"])

    def winners(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key, kind="stable").reset_index(drop=True)
        at, gaps, ids = rows[list(xyz)].to_numpy(float), rows["gap"].to_numpy(float).copy(), rows[key].to_numpy()
        # outside the candidates no gap exceeds the least of theirs; where all are candidates there is none outside
        floor = gaps.min() if len(rows) == CANDIDATES else -1.0
        rank, picked = int(rows["rank"].iloc[0]), []
        while rank < k and len(ids):
            best = int(gaps.argmax())  # the first of equals has the least id
            if gaps[best] < 0 or (picked and gaps[best] <= floor):
                break
            rank += 1
            picked.append((best, rank))
            gaps = np.minimum(gaps, np.round(((at - at[best]) ** 2).sum(axis=1), 12))
            gaps[best] = -1.0
        own = rows.iloc[[i for i, _ in picked]]
        return own[[*by, key, *xyz]].assign(**{c: own[c].astype(float) for c in xyz}, rank=np.array([r for _, r in picked], np.int64))

    while True:
        have = out.groupBy(*by).agg(F.max("rank").alias("rank")).where(F.col("rank") < k)
        first = Window.partitionBy(*by).orderBy(F.desc("gap"), key)
        candidates = state.where("gap >= 0").join(have, by).withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= CANDIDATES)
        won = durable(candidates.groupBy(*by).applyInPandas(winners, schema), "farthest")
        if won.isEmpty():
            break
        out = out.unionAll(won.select(*by, key, "rank"))
        # a winner changes the gaps of points that are nearer to it than the group's greatest gap
        open_ = state.where("gap >= 0").groupBy(*by).agg(F.sqrt(F.max("gap")).alias("reach")).join(have.select(*by), by)
        live = state.where("gap >= 0").join(open_, by)
        near = radius_join(live.withColumn("reach", F.col("reach") * (1 + 1e-9)).where("reach > 0"), won.join(open_, by).select(*by, key, *xyz, (F.col("reach") * (1 + 1e-9)).alias("reach")).where("reach > 0"), "reach", by, xyz, inclusive=True)
        moved = near.groupBy(*by, key).agg(F.min(F.when(F.col(key) == F.col(f"p_{key}"), -1.0).otherwise(F.round("d2", 12))).alias("less"))
        same = live.where("reach <= 0").join(won.select(*by, key, F.lit(-1.0).alias("less")), [*by, key]).select(*by, key, "less")
        renewed = live.drop("reach").join(moved.unionAll(same), [*by, key], "left").withColumn("gap", F.least("gap", F.coalesce("less", "gap"))).drop("less")
        before, state = state, durable(renewed, "gaps")
        release(before)
    return out


def voxel_downsample(points: DataFrame, size: float, by: Sequence[str], values: Sequence[str], xyz: Sequence[str] = XYZ) -> DataFrame:
    """One averaged point per occupied voxel."""
    placed = _in_cells(points, xyz, size)
    return placed.groupBy(*by, *(f"cell{i}" for i in range(3))).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in (*xyz, *values)))


def _spaced(links: DataFrame, by: Sequence[str]) -> DataFrame:
    """The points that a maximal independent set leaves out: by, key.

    links: by, first, second, where ``first`` goes before ``second``.  A round keeps the points
    that come after nobody, drops their neighbours and forgets both, until no link is left:
    what a walk through the points in that order would keep.
    """
    rows = list(by)
    dropped = None
    links = durable(links, "links")
    while not links.isEmpty():
        kept = links.select(*rows, F.col("first").alias("k")).distinct().join(links.select(*rows, F.col("second").alias("k")).distinct(), [*rows, "k"], "left_anti")
        kept = durable(kept, "kept")
        gone = durable(links.join(kept.withColumnRenamed("k", "first"), [*rows, "first"], "left_semi").select(*rows, F.col("second").alias("k")).distinct(), "gone")
        dropped = gone if dropped is None else dropped.unionAll(gone)
        # links of a kept point lead to dropped ones, so only these need to be forgotten
        rest = links.join(gone.withColumnRenamed("k", "first"), [*rows, "first"], "left_anti").join(gone.withColumnRenamed("k", "second"), [*rows, "second"], "left_anti")
        before, links = links, durable(rest.select(*rows, "first", "second"), "links")
        release(before, kept)
    return links.select(*rows, F.col("first").alias("k")) if dropped is None else dropped


def thin(points: DataFrame, radius: float | str, by: Sequence[str], seed: int, key: str = "point_id") -> DataFrame:
    """A maximal subset without two points within the radius, by hashed priority.

    No two kept points are within the radius, and every dropped one is within it of a
    kept one.  A radius that groups have of their own is the name of a column.
    """
    from pointweave.operators.tables import shuffle_key

    pairs = radius_pairs(points, radius, by, key)
    ahead = F.struct(shuffle_key(seed, "a"), "a") < F.struct(shuffle_key(seed, "b"), "b")
    links = pairs.select(*by, F.when(ahead, F.col("a")).otherwise(F.col("b")).alias("first"), F.when(ahead, F.col("b")).otherwise(F.col("a")).alias("second"))
    return points.join(_spaced(links, by).withColumnRenamed("k", key), [*by, key], "left_anti")


def spaced_sample(points: DataFrame, wanted: int, by: Sequence[str], seed: int, key: str = "point_id", xyz: Sequence[str] = XYZ) -> DataFrame:
    """``wanted`` points of each group (all of a smaller one) as far apart as halving radii give: by, key, spacing.

    The radius of a group starts at its extent.  Each level keeps a maximal set of points
    that are farther than the radius from each other and from those kept before, then halves it.  The
    level that would exceed the wanted number gives its first points by hash, so levels are walked in that order
    and only as far as points are wanted: no level lists its pairs.
    ``spacing`` is the radius at which a point came in; points that lie on kept ones come last, at 0.
    """
    from pointweave.operators.tables import shuffle_key

    by = list(by)
    side = F.greatest(*(F.max(c) - F.min(c) for c in xyz))
    floor = F.greatest(*(F.max(F.abs(c)) for c in xyz)) * 2.0**-40
    sizes = durable(points.groupBy(*by).agg(side.alias("reach"), floor.alias("floor"), F.least(F.lit(wanted), F.count(F.lit(1))).alias("need")), "sizes")
    open_ = durable(points.select(*by, key, *xyz, shuffle_key(seed, key).alias("turn")).join(sizes, by), "open")
    kinds = dict(open_.dtypes)
    names = [*by, key, *xyz, "turn", "reach"]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names)

    def walked(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["turn", key], kind="stable").reset_index(drop=True)
        at, reach, left = rows[list(xyz)].to_numpy(float), float(rows["reach"].iloc[0]), int(rows["need"].iloc[0] - rows["have"].iloc[0])
        free, picked = np.ones(len(rows), bool), []
        for i in range(len(rows)):
            if len(picked) < left and free[i]:
                picked.append(i)
                if reach > 0:
                    gap = at - at[i]
                    free &= ~(gap[:, 0] * gap[:, 0] + gap[:, 1] * gap[:, 1] + gap[:, 2] * gap[:, 2] <= reach * reach)
        return rows.iloc[picked][names]

    kept, first = None, Window.partitionBy(*by).orderBy("turn", key)
    for _ in range(MAX_ROUNDS):
        free, new = open_, kept
        while True:
            # off what lies within the radius of the points kept last; these few are copied, not the others
            if new is not None:
                reaches = free.groupBy(*by).agg(F.max("reach").alias("reach")).where("reach > 0")
                near = radius_join(new.select(*by, *xyz).join(reaches, by), free.where("reach > 0"), "reach", by, xyz, inclusive=True)
                gone = near.select(*by, F.col(f"p_{key}").alias(key)).unionAll(new.select(*by, key)).distinct()
                free = free.join(gone, [*by, key], "left_anti")
            have = None if kept is None else kept.groupBy(*by).agg(F.count(F.lit(1)).alias("have"))
            counted = free.withColumn("have", F.lit(0).cast("long")) if have is None else free.join(have, by, "left").fillna(0, ["have"])
            free = durable(counted.where("have < need"), "free")
            # a walk through the first by hash keeps what one through all of them would
            front = free.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= CANDIDATES).drop("nth")
            new = durable(front.groupBy(*by).applyInPandas(walked, schema), "kept")
            free = free.drop("have")
            if new.isEmpty():
                break
            picked = new.select(*by, key, *xyz, F.col("reach").alias("spacing"))
            kept = durable(picked if kept is None else kept.unionAll(picked), "kept")
        if kept is None:
            return open_.select(*by, key, F.col("reach").alias("spacing"))
        have = kept.groupBy(*by).agg(F.count(F.lit(1)).alias("have"))
        rest = open_.join(have, by).where("have < need").drop("have").join(kept.select(*by, key), [*by, key], "left_anti")
        before, open_ = open_, durable(rest.withColumn("reach", F.when(F.col("reach") / 2 > F.col("floor"), F.col("reach") / 2).otherwise(0.0)), "open")
        release(before)
        if open_.isEmpty():
            break
    return kept.select(*by, key, "spacing")


def moments(points: DataFrame, radius: float, by: Sequence[str], key: str = "point_id", xyz: Sequence[str] = XYZ) -> DataFrame:
    """Size ``n`` and covariance (xx, yy, zz, xy, xz, yz) of each point's neighbourhood."""
    pairs = radius_join(points.select(*by, key, *xyz), points.select(*by, key, *xyz), radius, by, xyz)
    x, y, z = (f"p_{c}" for c in xyz)
    return pairs.groupBy(*by, key).agg(
        F.count(F.lit(1)).alias("n"),
        F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy"), F.var_pop(z).alias("zz"),
        F.covar_pop(x, y).alias("xy"), F.covar_pop(x, z).alias("xz"), F.covar_pop(y, z).alias("yz"),
    )


def explained(m: DataFrame) -> DataFrame:
    """:func:`moments` with the explained-variance ratios r1, r2, r3, largest first.

    Closed-form eigenvalues of the symmetric 3 x 3 matrix; five or fewer neighbours give (1, 0, 0).
    """
    m = m.withColumn("q", F.expr("(xx + yy + zz) / 3"))
    m = m.withColumn("p", F.expr("sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6)"))
    det = F.expr("(xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)")
    m = m.withColumn("phi", F.when(F.col("p") > 0, F.acos(F.greatest(F.least(det / (2 * F.col("p") * F.col("p") * F.col("p")), F.lit(1.0)), F.lit(-1.0))) / 3).otherwise(0.0))
    m = m.withColumns({"l1": F.expr("q + 2 * p * cos(phi)"), "l3": F.expr("q + 2 * p * cos(phi + 2 * pi() / 3)")}).withColumn("l2", F.expr("3 * q - l1 - l3"))
    few = (F.col("n") <= 5) | (F.col("q") <= 0)
    ratio = lambda c, alone: F.when(few, alone).otherwise(F.greatest(F.col(c), F.lit(0.0)) / (3 * F.col("q")))
    return m.withColumns({"r1": ratio("l1", 1.0), "r2": ratio("l2", 0.0), "r3": ratio("l3", 0.0)}).drop("q", "p", "phi", "l1", "l2", "l3")


def pca_ratio(points: DataFrame, radius: float, by: Sequence[str], key: str = "point_id", xyz: Sequence[str] = XYZ) -> DataFrame:
    """Explained-variance ratios of each neighbourhood's covariance (:func:`explained`)."""
    return explained(moments(points, radius, by, key, xyz)).select(*by, key, "n", "r1", "r2", "r3")


def variance_dynamics(values: DataFrame, neighbours: DataFrame, by: Sequence[str], value: str, key: str = "point_id") -> DataFrame:
    """Sum over neighbours of ((value_j - value_i) / distance)^2."""
    own = values.select(*by, key, F.col(value).alias("vi"))
    other = values.select(*by, F.col(key).alias("other"), F.col(value).alias("vj"))
    pairs = neighbours.where("d2 > 0").join(own, [*by, key]).join(other, [*by, "other"])
    return pairs.groupBy(*by, key).agg(F.sum((F.col("vj") - F.col("vi")) * (F.col("vj") - F.col("vi")) / F.col("d2")).alias("dynamics"))


def corner_probability(dynamics: DataFrame, thresholds: Sequence[float], by: Sequence[str], key: str = "point_id") -> DataFrame:
    """Share of parameter settings under which a point fires."""
    fired = sum(((F.col("dynamics") > t).cast("double") for t in thresholds), F.lit(0.0))
    return dynamics.select(*by, key, (fired / len(thresholds)).alias("corner"))
