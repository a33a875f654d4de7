"""Session graphs as node and edge tables, neighbourhood aggregation, readout.

A graph is one copy of one session, keyed ``(user_id, session, copy_no)``.
Sessions are bounded by the size filter, so a graph never spans tasks; every
step partitions by the graph key and all of them share that partitioning.
Graphs beyond ``MAX_EVENTS`` are an error there; ``propagate_by_join`` takes graphs of any size.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clicktrail import schemas as S
from clicktrail.operators.features import attach_graph_features
from clicktrail.operators.rows import drop_event_types
from clicktrail.operators.sessions import consecutive_pairs, event_gaps, event_position, factorize
from clicktrail.spark import materialize

GRAPH_KEY = [*S.SESSION_KEY, "copy_no"]
EVENT_FEATURES = ["is_view", "is_cart", "price", "session_time"]
ITEM_FEATURES = ["n_views", "n_carts", "price"]
# Fixed value: rounds of neighbourhood aggregation.
HOPS = 6
#: Events or nodes of a graph that is worked on as one row; ``propagate_by_join`` has no such bound.
MAX_EVENTS = 10_000


def graph_events(events: DataFrame) -> DataFrame:
    """Events a graph is made of: no purchases, a copy number, type flags and the pause before each."""
    kept = drop_event_types(events, ["purchase"])
    if "copy_no" not in kept.columns:
        # This is 0.  A literal would be folded out of some partitionings
        # and stay in others, and every step would shuffle again.
        kept = kept.withColumn("copy_no", F.least(F.abs(F.col(S.SESSION)), F.lit(0)).cast("int"))
    kept = event_gaps(kept, "_gap", GRAPH_KEY)
    return kept.withColumns(
        {
            "is_view": (F.col(S.TYPE) == "view").cast("int"),
            "is_cart": (F.col(S.TYPE) == "cart").cast("int"),
            "price": F.col("price").cast("double"),
            "session_time": F.floor(F.col("_gap") / 1_000_000).cast("double"),
        }
    ).drop("_gap")


def _both_ways(pairs: DataFrame) -> DataFrame:
    """Each pair as two directed edges, forward ones first."""
    ends = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return pairs.select(*GRAPH_KEY, "seq", F.posexplode(ends).alias("way", "edge")).select(*GRAPH_KEY, "edge.*", "seq", "way")


def event_graph(events: DataFrame):
    """``(nodes, edges)`` with one node per event in time order, neighbours linked both ways."""
    placed = event_position(events, "node", GRAPH_KEY)
    nodes = placed.select(*GRAPH_KEY, "node", *EVENT_FEATURES)
    return nodes, _both_ways(consecutive_pairs(placed, "node", GRAPH_KEY))


def item_graph(events: DataFrame):
    """``(nodes, edges)`` with one node per product by first appearance.

    Every step from one event to the next is an edge both ways; parallel edges
    and self-loops stay.  Node features are view and cart counts and the price
    of the first appearance.
    """
    coded = factorize(events, "product_id", "node", GRAPH_KEY)
    nodes = coded.groupBy(*GRAPH_KEY, "node").agg(
        F.sum("is_view").alias("n_views"),
        F.sum("is_cart").alias("n_carts"),
        F.min_by("price", F.struct(S.TIME, S.EVENT_ID)).alias("price"),
    )
    return nodes, _both_ways(consecutive_pairs(coded, "node", GRAPH_KEY))


def graph_table(events: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """One row per graph with its label and, given sessions, the raw session length."""
    graphs = events.groupBy(*GRAPH_KEY).agg(F.max(S.LABEL).alias("label"))
    return graphs if sessions is None else attach_graph_features(graphs, sessions)


def _incoming(edges: DataFrame) -> DataFrame:
    """Per graph a map from node to its incoming edges with weight 1/sqrt(out-degree * in-degree)."""
    out_degree = F.count(F.lit(1)).over(Window.partitionBy(*GRAPH_KEY, "src"))
    in_degree = F.count(F.lit(1)).over(Window.partitionBy(*GRAPH_KEY, "dst"))
    weight = F.lit(1.0) / F.sqrt((out_degree * in_degree).cast("double"))
    # One exchange on the graph key serves both windows and both aggregates.
    weighted = edges.repartition(*GRAPH_KEY).select(*GRAPH_KEY, "src", "dst", weight.alias("weight"))
    per_node = weighted.groupBy(*GRAPH_KEY, "dst").agg(
        F.array_sort(F.collect_list(F.struct("src", "weight"))).alias("edges")
    )
    return per_node.groupBy(*GRAPH_KEY).agg(F.map_from_entries(F.collect_list(F.struct("dst", "edges"))).alias("incoming"))


def _bounded(items: Column) -> Column:
    """The array, if it is within ``MAX_EVENTS``; an error otherwise."""
    return F.when(F.size(items) <= MAX_EVENTS, items).otherwise(F.raise_error(F.lit(f"a graph of more than {MAX_EVENTS} events; use propagate_by_join")))


def _listed(events: DataFrame) -> DataFrame:
    """One row per graph: its events in order, bounded by the size filter, and its label.  The only exchange of a graph flow."""
    event = F.struct(S.TIME, S.EVENT_ID, "product_id", *EVENT_FEATURES)
    return events.groupBy(*GRAPH_KEY).agg(F.array_sort(_bounded(F.collect_list(event))).alias("_events"), F.max(S.LABEL).alias("label"))


def _in_place(listed: DataFrame, kind: str) -> DataFrame:
    """Add ``g``, the node vectors, and ``_in``, the incoming edges of each node, from the events in the row."""
    events = F.col("_events")
    if kind == "event":
        codes = F.transform(events, lambda _, i: i)
        vectors = F.transform(events, lambda e: F.array(*[e[f].cast("double") for f in EVENT_FEATURES]))
        coded = listed.select("*", codes.alias("_codes"), vectors.alias("_x"))
    else:
        products = F.array_distinct(F.transform(events, lambda e: e["product_id"]))  # by first appearance
        coded = listed.withColumn("_products", products)
        codes = F.transform(events, lambda e: (F.array_position(F.col("_products"), e["product_id"]) - 1).cast("int"))

        def item(product):
            own = F.filter(events, lambda e: e["product_id"] == product)
            total = lambda f: F.aggregate(own, F.lit(0.0), lambda t, e: t + e[f])
            return F.array(total("is_view"), total("is_cart"), own[0]["price"].cast("double"))

        coded = coded.select("*", codes.alias("_codes"), F.transform("_products", item).alias("_x"))
    # every step is an edge both ways, so in- and out-degree are both the number of steps that touch a node
    steps = F.filter(F.transform("_codes", lambda c, i: F.struct(c.alias("a"), F.get("_codes", i + 1).alias("b"))), lambda p: p["b"].isNotNull())
    back = F.transform("_steps", lambda p: F.struct(p["b"].alias("a"), p["a"].alias("b")))
    coded = coded.withColumn("_steps", steps).withColumn("_ways", F.concat("_steps", back))
    coded = coded.withColumn("_degree", F.transform("_x", lambda _, v: F.size(F.filter("_ways", lambda p: p["a"] == v)).cast("double")))

    def incoming(_, v):
        weight = lambda p: F.lit(1.0) / F.sqrt(F.get("_degree", p["a"]) * F.get("_degree", v))
        return F.transform(F.filter("_ways", lambda p: p["b"] == v), lambda p: F.struct(p["a"].alias("src"), weight(p).alias("weight")))

    return coded.select(
        *GRAPH_KEY, "label", F.transform("_x", lambda x, v: F.struct(v.alias("node"), x.alias("x"))).alias("g"), F.transform("_x", incoming).alias("_in"))


def _standardised(rows: DataFrame, width: int) -> DataFrame:
    """Node vectors less their means, over their deviations (1 where there is none); the rows are written, so that they are made once."""
    rows = materialize(rows, "graphs")
    parts = [f(F.col("x")[i]) for i in range(width) for f in (F.avg, F.stddev_pop)]
    fitted = list(rows.select(F.explode("g").alias("n")).select("n.x").agg(*parts).first())
    scaled = lambda x: F.array(*[(x[i] - F.lit(fitted[2 * i])) / F.lit(fitted[2 * i + 1] or 1.0) for i in range(width)])
    return rows.withColumn("g", F.transform("g", lambda n: F.struct(n["node"].alias("node"), scaled(n["x"]).alias("x"))))


def spread(events: DataFrame, kind: str, hops: int = HOPS, standard: bool = False) -> DataFrame:
    """A row per node with its features after 0..hops rounds, and the label of its graph, of bounded sessions.

    Events are shuffled once, by the graph key.  Equal to ``event_graph`` or ``item_graph`` with ``propagate``; ``standard`` standardises the features of
    all nodes first.
    """
    features = {"event": EVENT_FEATURES, "item": ITEM_FEATURES}[kind]
    rows = _in_place(_listed(events), kind)
    return _rounds(_standardised(rows, len(features)) if standard else rows, features, hops, "label")


def readouts(events: DataFrame, kind: str, hops: int = HOPS, standard: bool = False) -> DataFrame:
    """Graphs, rounds and readout of bounded sessions in one pass (``spread``).

    Equal to ``event_graph`` or ``item_graph`` with ``propagate``, ``graph_readout`` and the labels of ``graph_table``.
    """
    names = hop_names({"event": EVENT_FEATURES, "item": ITEM_FEATURES}[kind], hops)
    return spread(events, kind, hops, standard).groupBy(*GRAPH_KEY).agg(*_readout(names), F.max("label").alias("label"))


def _hop(state: Column, incoming: Column, width: int) -> Column:
    """One round: each node's weighted sum over its incoming edges."""
    zero = F.array(*[F.lit(0.0)] * width)

    def gather(edges):
        return F.aggregate(
            edges,
            zero,
            lambda total, e: F.zip_with(total, F.get(state, e["src"]), lambda t, x: t + x * e["weight"]),
        )

    return F.transform(incoming, lambda edges: F.coalesce(gather(edges), zero))


def propagate(nodes: DataFrame, edges: DataFrame, features, hops: int = HOPS) -> DataFrame:
    """Features of each node after 0..hops rounds of normalised neighbour sums.

    Nodes of a graph are numbered from 0.  Round h of feature f is column
    ``f_h``; a node without edges gets zeros from round 1 on.  Each graph is one
    row of small arrays while the rounds run, so they need no shuffle however
    many there are.
    """
    features = list(features)
    vector = F.array(*[F.col(f).cast("double") for f in features])
    listed = nodes.groupBy(*GRAPH_KEY).agg(F.array_sort(_bounded(F.collect_list(F.struct("node", vector.alias("x"))))).alias("g"))
    graphs = listed.join(_incoming(edges), GRAPH_KEY, "left").withColumn(
        "_in", F.transform("g", lambda n: F.try_element_at("incoming", n["node"]))
    )
    return _rounds(graphs, features, hops)


def propagate_by_join(nodes: DataFrame, edges: DataFrame, features, hops: int = HOPS) -> DataFrame:
    """``propagate`` for graphs of any size: a join of edges with the nodes they leave, and a sum per node they enter, each round.

    Parallel edges are counted into one row first.  No graph and no node is gathered anywhere: sums are combined before the shuffle, and an end that
    many edges share is a key that adaptive execution splits.  Each round is written.
    """
    features = list(features)
    weight = F.col("n") / F.sqrt((F.col("_out") * F.col("_in")).cast("double"))
    links = materialize(edges.groupBy(*GRAPH_KEY, "src", "dst").agg(F.count(F.lit(1)).alias("n")), "links")
    degrees = {end: materialize(links.groupBy(*GRAPH_KEY, end).agg(F.sum("n").alias(name)), "degrees") for end, name in (("src", "_out"), ("dst", "_in"))}
    for end, degree in degrees.items():
        links = links.join(degree, [*GRAPH_KEY, end])
    links = materialize(links.select(*GRAPH_KEY, "src", "dst", weight.alias("_weight")), "links")
    state = materialize(nodes.select(*GRAPH_KEY, "node", *[F.col(f).cast("double").alias(f"{f}_0") for f in features]), "round")
    for h in range(1, hops + 1):
        before = state.select(*GRAPH_KEY, F.col("node").alias("src"), *[F.col(f"{f}_{h - 1}").alias(f) for f in features])
        sums = links.join(before, [*GRAPH_KEY, "src"]).groupBy(*GRAPH_KEY, F.col("dst").alias("node")).agg(
            *[F.sum(F.col(f) * F.col("_weight")).alias(f"{f}_{h}") for f in features])
        state = state.join(sums, [*GRAPH_KEY, "node"], "left").fillna(0.0, [f"{f}_{h}" for f in features])
        state = materialize(state, "round")
    return state


def _rounds(graphs: DataFrame, features, hops: int, *keep) -> DataFrame:
    """A row per node with its features after each round, from rows of node vectors and incoming edges."""
    start = F.transform("g", lambda n: n["x"])
    rounds = F.aggregate(
        F.sequence(F.lit(1), F.lit(hops)) if hops else F.array().cast("array<int>"),
        F.array(start),
        lambda done, _: F.concat(done, F.array(_hop(F.element_at(done, -1), F.col("_in"), len(features)))),
    )
    rows = graphs.withColumn("_rounds", rounds).select(*GRAPH_KEY, *keep, "_rounds", F.posexplode("g").alias("_i", "_n"))
    columns = [
        F.col("_rounds")[h][F.col("_i")][i].alias(f"{f}_{h}") for h in range(hops + 1) for i, f in enumerate(features)
    ]
    return rows.select(*GRAPH_KEY, *keep, F.col("_n.node").alias("node"), *columns)


def graph_readout(nodes: DataFrame, features) -> DataFrame:
    """Mean, maximum and sum of each node feature per graph."""
    return nodes.groupBy(*GRAPH_KEY).agg(*_readout(features))


def _readout(features) -> list:
    return [g(f).alias(f"{f}_{name}") for f in features for name, g in (("mean", F.avg), ("max", F.max), ("sum", F.sum))]


def hop_names(features, hops: int = HOPS) -> list:
    return [f"{f}_{h}" for h in range(hops + 1) for f in features]


def readout_names(features, hops: int = HOPS) -> list:
    return [f"{c}_{kind}" for c in hop_names(features, hops) for kind in ("mean", "max", "sum")]
