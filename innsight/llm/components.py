"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.llm.tables import materialize

HUBS = 256  # a node with over 1 / HUBS of all links is broadcast; fewer than HUBS can be


def _stars(edges: DataFrame, large: bool, most: int) -> DataFrame:
    """One star step over (a, b) with a > b: link the neighbours of each node to the smallest of them.

    A large step does so with the neighbours above the node, a small step with
    those below and the node itself. The smallest neighbours are folded on the map
    side. A node with over 1 / ``HUBS`` of ``most`` neighbours to be linked is a
    hub; ``most`` is at least the number of edges, so there are fewer than HUBS
    hubs. They are named by a job of its own, as most graphs have none and then
    neither broadcast nor split is planned. They are broadcast and their neighbours
    stay where they are; only neighbours of other nodes meet by key.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count_if(F.expr("b > a")).alias("n"))
        pairs = both.filter("b > a")
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        pairs = edges
    smallest = least.select("a", "m")
    hubs = [r["a"] for r in least.filter(F.col("n") > max(most / HUBS, 1)).select("a").collect()]
    if hubs:
        is_hub = F.col("a").isin(hubs)
        starred = pairs.filter(~is_hub).join(smallest.filter(~is_hub), "a")
        starred = starred.unionByName(pairs.filter(is_hub).join(F.broadcast(smallest.filter(is_hub)), "a"))
    else:
        starred = pairs.join(smallest, "a")
    starred = starred.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        starred = starred.unionByName(least.select("a", F.col("m").alias("b")))
    return starred.filter("a > b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); component is the smallest node reached.

    Links may repeat, point either way and join a node to itself. The number of
    rounds grows with the logarithm of the longest chain; each round is written
    to the shared folder. An empty table gives an empty result.
    """
    nodes = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
    edges = materialize(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(),
        "links",
    )
    mark = lambda e: e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    before, now = None, mark(edges)
    while now != before and now[0]:
        most = now[0]  # a large step adds no edges
        # written in between: the small step reads its edges several times, each with the large step's whole plan
        edges = materialize(_stars(edges, True, most), "large-stars")
        edges = materialize(_stars(edges, False, most), "stars")
        before, now = now, mark(edges)
    return (
        nodes.distinct()
        .join(edges.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left")
        .select("node", F.coalesce("component", "node").alias("component"))
    )
