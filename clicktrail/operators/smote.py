"""Nearest neighbours, by hashed projections or exact, and synthetic minority rows.

Neither search pairs all rows.  Copies are collapsed first.

``projected``, which ``smote`` uses, cuts the vectors into buckets of bounded size by random projections, ``TREES`` times over: a
bucket is halved at the median of a random direction until it has ``BUCKET`` vectors or fewer, and each vector looks for its neighbours
in its own buckets.  A row is compared with ``TREES * BUCKET`` others at most, whatever the size and the number of columns.
The first cuts come from a bounded sample, the others from all vectors of a group; up to ``BUCKET`` distinct vectors the result is exact.

The exact search (``nearest_neighbours`` by default) works on distinct vectors that are grouped around pivots and each group is cut into blocks of bounded
size by hash, so that a dense region fills more blocks instead of one.  A row first searches its own
block, which bounds the distance to its k-th neighbour.  It then visits only
blocks of groups that the triangle inequality cannot rule out, and keeps k
candidates per block.  The result is exact.

In many dimensions the triangle inequality rules out little, and every block is visited.  The work then grows with
rows times blocks, so the search is for labelled minorities of up to ``MAX_ROWS`` distinct vectors and raises beyond.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clicktrail.functions.text import seeded_digest
from clicktrail.operators.sampling import SEED, stratified_rank
from clicktrail.spark import materialize

#: Buckets that a vector is in, and distinct vectors of a bucket at most.
TREES, BUCKET = 20, 512
#: Vectors that a task cuts into buckets, about; vectors of the sample for each such group, and how many groups a sample makes at most.
_GROUP, _SAMPLED, _DEPTH = 16_384, 16, 12

# Fixed value: neighbours a synthetic row may be drawn towards.
NEIGHBOURS = 5
# Minority to majority ratios after adding synthetic rows.
RATIOS = (0.2, 0.3, 0.5)

#: Distinct vectors that the exact search takes at most.
MAX_ROWS = 2_000_000
_MAX_PIVOTS = 256
_BLOCK_ROWS = 2048
_VISITORS = 32_768
_SLACK = 1e-9  # keeps ties at the bound in spite of rounding

_PAIR = "id {0}, nn {0}, distance double"


def _objects(values) -> pd.Series:
    """Keys as plain objects; Arrow conversion then follows the declared type."""
    return pd.Series(list(values), dtype=object)


def _nearest(query: pd.DataFrame, block: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest block rows of each query row, itself excluded, ties by id."""
    block = block.sort_values("id", kind="stable")
    ids = block["id"].to_numpy(dtype=object)
    points = np.stack(block["x"].to_numpy()) if len(block) else None
    found, near, far = [], [], []
    asking = query["id"].to_numpy(dtype=object)
    vectors = np.stack(query["x"].to_numpy()) if len(query) and len(block) else np.zeros((0, 0))
    step = max(1, 4_000_000 // max(1, len(block) * (vectors.shape[1] if vectors.size else 1)))
    for at in range(0, len(vectors), step):
        some, keys = vectors[at:at + step], asking[at:at + step]
        # differences, not products: equal distances stay equal
        distance = np.sqrt(((points[None, :, :] - some[:, None, :]) ** 2).sum(axis=2))
        distance[ids[None, :] == keys[:, None]] = np.inf
        best = np.argsort(distance, axis=1, kind="stable")[:, :k]
        value = np.take_along_axis(distance, best, axis=1)
        use = np.isfinite(value)
        found += list(np.repeat(keys, use.sum(axis=1)))
        near += list(ids[best[use]])
        far += list(value[use])
    return pd.DataFrame({"id": _objects(found), "nn": _objects(near), "distance": pd.Series(far, dtype="float64")})


def _nearest_vectors(rows: DataFrame, k: int, seed: int) -> DataFrame:
    """``(id, nn, distance)``: the k nearest others of distinct vectors ``(id, x)``, ties by id."""
    kind = rows.schema["id"].dataType.simpleString()
    total = rows.count()
    if total > MAX_ROWS:
        raise ValueError(f"{total} distinct vectors; the exact neighbour search takes {MAX_ROWS}")
    if total <= _BLOCK_ROWS:  # one block holds everything
        return rows.groupBy().applyInPandas(lambda b: _nearest(b, b, k), _PAIR.format(kind))
    wanted = min(_MAX_PIVOTS, total // _BLOCK_ROWS)
    # Bounded: at most 256 vectors reach the driver and the tasks.
    sample = rows.orderBy(seeded_digest(seed, F.col("id")), "id").limit(wanted).select("x").collect()
    pivots = np.array([r["x"] for r in sample], dtype=float)

    def place(batches):
        for batch in batches:
            if len(batch) == 0:
                continue
            points = np.stack(batch["x"].to_numpy())
            away = np.sqrt(((pivots[None, :, :] - points[:, None, :]) ** 2).sum(axis=2))
            group = away.argmin(axis=1)
            nearest = pd.Series(away[np.arange(len(batch)), group])
            yield pd.DataFrame({"id": _objects(batch["id"]), "x": _objects(batch["x"]), "group": group, "away": nearest})

    placed = rows.mapInPandas(place, f"id {kind}, x array<double>, group int, away double")
    extent = placed.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("low"), F.max("away").alias("high"))
    groups = {r["group"]: (r["n"], r["low"], r["high"]) for r in extent.collect()}  # one row per pivot
    blocks = {g: -(-n // _BLOCK_ROWS) for g, (n, _, _) in groups.items()}
    count = F.element_at(F.create_map(*[F.lit(v) for g, b in blocks.items() for v in (g, b)]), F.col("group"))
    blocked = placed.withColumn("block", F.pmod(F.xxhash64("id", F.lit(seed)), count.cast("bigint")).cast("int"))

    own = blocked.groupBy("group", "block").applyInPandas(lambda b: _nearest(b, b, k), _PAIR.format(kind))
    bound = own.groupBy("id").agg(
        F.when(F.count(F.lit(1)) >= k, F.max("distance")).otherwise(F.lit(float("inf"))).alias("bound")
    )
    between = np.sqrt(((pivots[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2))

    def visit(batches):
        for batch in batches:
            if len(batch) == 0:
                continue
            points, own = np.stack(batch["x"].to_numpy()), batch["group"].to_numpy()
            away = np.sqrt(((pivots[None, :, :] - points[:, None, :]) ** 2).sum(axis=2))
            limit = batch["bound"].to_numpy() * (1 + _SLACK) + _SLACK
            home = away[np.arange(len(points)), own]
            plan = []
            for g, (_, low, high) in groups.items():
                apart = between[own, g]
                border = np.where(apart > 0, (away[:, g] ** 2 - home**2) / (2 * np.where(apart > 0, apart, 1.0)), 0.0)
                least = np.maximum(np.maximum(away[:, g] - high, low - away[:, g]), border - _SLACK)
                for i in np.flatnonzero(least <= limit):
                    plan += [(int(i), g, b) for b in range(blocks[g]) if (g, b) != (own[i], batch["block"].iloc[i])]
            if plan:
                index, to_group, to_block = map(list, zip(*plan))
                moved = {c: _objects(batch[c].iloc[index]) for c in ("id", "x")}
                yield pd.DataFrame({**moved, "group": to_group, "block": to_block})

    visits = materialize(
        blocked.join(bound, "id", "left")
        .withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        .select("id", "x", "group", "block", "bound")
        .mapInPandas(visit, f"id {kind}, x array<double>, group int, block int")
    )
    # A block may have any number of visitors; they come in parts and the block is sent to each part.
    parts = visits.groupBy("group", "block").agg(F.ceil(F.count(F.lit(1)) / _VISITORS).cast("int").alias("parts"))
    visitor_part = F.pmod(F.xxhash64("id"), F.col("parts").cast("bigint")).cast("int").alias("part")
    block_part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    where = ("group", "block", "part")
    visitors = visits.join(parts, ["group", "block"]).select("id", "x", "group", "block", visitor_part)
    targets = blocked.join(parts, ["group", "block"]).select("id", "x", "group", "block", block_part)
    found = visitors.groupBy(*where).cogroup(targets.groupBy(*where))
    elsewhere = found.applyInPandas(lambda visitors, block: _nearest(visitors, block, k), _PAIR.format(kind))
    order = Window.partitionBy("id").orderBy("distance", "nn")
    ranked = own.unionByName(elsewhere).withColumn("_rank", F.row_number().over(order))
    return ranked.filter(F.col("_rank") <= k).drop("_rank")


def _directions(seed: int, tree: int, node: int, width: int) -> np.ndarray:
    return np.random.default_rng([seed & 0xFFFFFFFF, tree, node]).normal(size=width)


def _cuts(sample: np.ndarray, depth: int, tree: int, seed: int) -> np.ndarray:
    """Medians of the projections of a sample, for the ``2 ** depth - 1`` nodes from the root on."""
    out, at = np.zeros((1 << depth) - 1), np.zeros(len(sample), np.int64)
    for node in range(len(out)):
        own = at == node
        away = sample[own] @ _directions(seed, tree, node, sample.shape[1])
        out[node] = np.median(away) if own.any() else 0.0
        at[own] = 2 * node + 1 + (away > out[node])
    return out


def _leaf(points: np.ndarray, cuts: np.ndarray, depth: int, tree: int, seed: int) -> np.ndarray:
    at = np.zeros(len(points), np.int64)
    for _ in range(depth):
        for node in np.unique(at):
            own = at == node
            at[own] = 2 * node + 1 + (points[own] @ _directions(seed, tree, int(node), points.shape[1]) > cuts[node])
    return at


def _in_buckets(group: pd.DataFrame, k: int, seed: int) -> pd.DataFrame:
    """The k nearest of each row in its bucket: the group halved at medians until there are ``BUCKET`` rows or fewer."""
    tree, leaf = int(group["tree"].iloc[0]), int(group["leaf"].iloc[0])
    group = group.sort_values("id", kind="stable").reset_index(drop=True)
    points = np.stack(group["x"].to_numpy())
    out, todo, node = [], [np.arange(len(group))], leaf + 1
    while todo:
        rows = todo.pop()
        if len(rows) <= BUCKET:
            part = group.iloc[rows]
            out.append(_nearest(part, part, k))
            continue
        node += 1 << 32  # a number of its own for the direction
        order = np.argsort(points[rows] @ _directions(seed, tree, node, points.shape[1]), kind="stable")
        todo += [np.sort(rows[order[:len(rows) // 2]]), np.sort(rows[order[len(rows) // 2:]])]
    return pd.concat(out, ignore_index=True)


def projected(rows: DataFrame, k: int, seed: int) -> DataFrame:
    """``(id, nn, distance)``: for distinct vectors ``(id, x)`` the k nearest that share a bucket, ties by id."""
    kind = rows.schema["id"].dataType.simpleString()
    total = rows.count()
    if total <= BUCKET:  # one bucket holds everything
        return rows.groupBy().applyInPandas(lambda b: _nearest(b, b, k), _PAIR.format(kind))
    depth = min(_DEPTH, max(0, (total // _GROUP).bit_length()))
    # Bounded: _SAMPLED * 2 ** _DEPTH vectors at most.
    sample = rows.orderBy(seeded_digest(seed, F.col("id")), "id").limit(_SAMPLED << depth).select("x").collect() if depth else []
    sample = np.array([r["x"] for r in sample], dtype=float)
    cuts = [_cuts(sample, depth, tree, seed) for tree in range(TREES)] if depth else None

    def place(batches):
        for batch in batches:
            points = np.stack(batch["x"].to_numpy()) if len(batch) else np.zeros((0, 1))
            for tree in range(TREES if len(batch) else 0):
                leaf = _leaf(points, cuts[tree], depth, tree, seed) if depth else np.zeros(len(batch), np.int64)
                yield pd.DataFrame({"tree": tree, "leaf": leaf, "id": _objects(batch["id"]), "x": _objects(batch["x"])})

    placed = rows.mapInPandas(place, f"tree int, leaf long, id {kind}, x array<double>")
    pairs = placed.groupBy("tree", "leaf").applyInPandas(lambda group: _in_buckets(group, k, seed), _PAIR.format(kind))
    found = F.array_sort(F.array_distinct(F.collect_list(F.struct("distance", "nn"))))  # TREES * k at most
    near = pairs.groupBy("id").agg(F.slice(found, 1, k).alias("near"))
    return near.select("id", F.explode("near").alias("n")).select("id", "n.nn", "n.distance")


def nearest_neighbours(df: DataFrame, key: str, features: str, k: int = NEIGHBOURS, seed: int = SEED, exact: bool = True) -> DataFrame:
    """``(id, nn, distance, rank)``: k nearest other rows by Euclidean distance, exact or by ``projected``.

    ``features`` is an array of doubles; ties are ordered by id.  Copies are
    searched for once: each distinct vector stands for its k+1 smallest ids,
    which is all that any list of k neighbours can contain of it.
    """
    rows = df.select(F.col(key).alias("id"), F.col(features).alias("x"))
    place = F.row_number().over(Window.partitionBy("x").orderBy("id"))  # limited before the shuffle
    heads = rows.withColumn("_place", place).filter(F.col("_place") <= k + 1)
    vectors = materialize(heads.groupBy("x").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    search = _nearest_vectors if exact else projected
    pairs = search(vectors.select(F.col("ids")[0].alias("id"), "x"), k, seed)
    others = vectors.select(F.col("ids")[0].alias("nn"), F.col("ids").alias("_theirs"))
    lists = pairs.join(others, "nn").groupBy("id").agg(
        F.flatten(
            F.collect_list(F.transform("_theirs", lambda i: F.struct(F.col("distance"), i.alias("nn"))))
        ).alias("_others")
    )
    own = F.transform("ids", lambda i: F.struct(F.lit(0.0).alias("distance"), i.alias("nn")))
    known = vectors.join(lists, vectors["ids"][0] == lists["id"], "left").select(
        "x", F.array_sort(F.concat(own, F.coalesce("_others", F.filter(own, lambda e: F.lit(False))))).alias("_known")
    )
    listed = rows.join(known, "x").withColumn(
        "_near", F.slice(F.filter("_known", lambda e: e["nn"] != F.col("id")), 1, k)
    )
    return listed.select("id", F.posexplode("_near").alias("_at", "_n")).select(
        "id", F.col("_n.nn").alias("nn"), F.col("_n.distance").alias("distance"), (F.col("_at") + 1).alias("rank")
    )


def smote(
    df: DataFrame, key: str, features: str, label: str, ratio: float, k: int = NEIGHBOURS, seed: int = SEED,
    neighbours: DataFrame | None = None,
) -> DataFrame:
    """Synthetic minority rows that lift minority : majority to ``ratio``.

    Returns only the new rows: ``key`` (id of the base row and a running
    number), ``features`` and ``label``.  Each base row gets an equal share, the
    remainder goes to base rows in digest order; neighbour and position on the
    line to it come from md5 digests, so a repeated run gives the same rows.  Several
    ratios can share the ``neighbours`` of the minority.
    """
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}  # one row per class
    few, many = counts.get(1, 0), counts.get(0, 0)
    new = max(0, int(many * ratio - few))
    minority = df.filter(F.col(label) == 1).select(F.col(key), F.col(features), F.col(label))
    if not new or few < 2:
        return minority.limit(0)
    share = F.lit(new // few) + (F.col("_rank") < new % few).cast("int")
    base = stratified_rank(minority, key, label, seed, "_rank").withColumn("_share", share).filter("_share > 0")
    if neighbours is None:
        neighbours = nearest_neighbours(minority, key, features, k, seed, exact=False)
    near = neighbours.groupBy(F.col("id").alias(key)).agg(
        F.array_sort(F.collect_list(F.struct("rank", "nn", "distance"))).alias("_near")
    )
    drawn = base.join(near, key).withColumn("_no", F.explode(F.sequence(F.lit(1), F.col("_share"))))
    drawn = drawn.withColumn("_draw", seeded_digest(seed, F.col(key), F.col("_no")))
    number = lambda first, digits: F.conv(F.substring("_draw", first, digits), 16, 10).cast("bigint")
    pick = F.pmod(number(1, 8), F.size("_near").cast("bigint")).cast("int")
    drawn = drawn.withColumns({"_to": F.get("_near", pick), "_u": number(9, 13) / F.lit(float(1 << 52))})
    # A copy of the base row at distance 0 needs no lookup, which keeps groups of copies out of the join.
    target = F.when(F.col("_to.distance") > 0, F.col("_to.nn"))
    ends = minority.select(F.col(key).alias("_nn"), F.col(features).alias("_end"))
    joined = drawn.withColumn("_nn", target).join(ends, "_nn", "left")
    moved = F.zip_with(features, F.coalesce("_end", features), lambda a, b: a + (b - a) * F.col("_u"))
    return joined.select(
        F.concat_ws("S", F.col(key).cast("string"), F.col("_no").cast("string")).alias(key),
        moved.alias(features),
        F.col(label),
    )
