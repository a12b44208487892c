"""Components of nodes that share keys, without comparing all pairs of a key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from wattline.llm.graphs import components
from wattline.session import settle


#: Nodes of an element that the others are compared with in each round, before all that are still apart.
HUBS = (4, 16)


def prefixes_of(elements: DataFrame, early: str) -> DataFrame:
    """element, node, component, n, at: the early elements of all nodes, of those that several nodes have.

    ``elements`` holds (node, component, n, element), each element once for a node. With the elements
    of all nodes in one order, rarest first, the first common element of a link stands early in both:
    ``early`` says how early by n, place ``at`` and ``smallest``, the least n of the element's nodes. Nodes around a common original
    differ from it by rare elements, which come first: a node too far from the original has no frequent element so early, and meets
    only those that share its own changes.
    """
    often = elements.groupBy("element").agg(F.count(F.lit(1)).alias("often"), F.min("n").alias("smallest"))
    ordered = (
        elements.join(often, "element")
        .groupBy("node", "component", "n")
        .agg(F.array_sort(F.collect_list(F.struct("often", "element", "smallest"))).alias("elements"))
        .select("node", "component", "n", F.posexplode("elements").alias("at", "e"))
        .select("node", "component", "n", "at", "e.*")
    )
    return settle(
        elements.sparkSession,
        ordered.where("often > 1").where(early).select("element", "node", "component", "n", "at"),
        "prefixes",
    )


def joined_components(
    prefixes: DataFrame, allowed: str, verify: Callable[[DataFrame], DataFrame], order: tuple[str, ...], hubs: tuple[int, ...] = HUBS
) -> DataFrame:
    """node, component of the components of ``prefixes`` that links join: each component with the smallest it reaches.

    Each round compares the nodes of an element with a few of them, the first by ``order``, unless their components are one
    by then; the last compares all that are still apart (``pairs_apart``). So a group around one original, most of which some of its members
    reach, costs a few comparisons for each node, and only nodes that no hub reaches meet all others.
    """
    spark = prefixes.sparkSession
    labels = settle(spark, prefixes.select("node", "component").distinct(), "prefix-nodes")
    edges = joined = None
    for count in (*hubs, None):
        now = prefixes
        if joined is not None:
            now = prefixes.join(joined.toDF("component", "joined"), "component", "left")
            now = now.withColumn("component", F.coalesce("joined", "component")).drop("joined")
            now = settle(spark, now.select(*prefixes.columns), "relabelled")
        pairs = _hub_pairs(now, allowed, order, count) if count else pairs_apart(now, allowed)
        links = verify(settle(spark, pairs, "pairs"))
        if joined is not None and not links.limit(1).count():
            continue
        ends = links.join(labels.toDF("a", "from"), "a").join(labels.toDF("b", "to"), "b")
        more = ends.select(F.col("from").alias("a"), F.col("to").alias("b")).where("a != b").distinct()
        edges = more if edges is None else edges.union(more)
        joined = components(edges)
    return joined


def _hub_pairs(prefixes: DataFrame, allowed: str, order: tuple[str, ...], count: int) -> DataFrame:
    """Pairs (a, b) of each element's nodes with its first ``count`` by ``order``, of different components."""
    first = Window.partitionBy("element").orderBy(*order, "node")
    split = prefixes.groupBy("element").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
    hubs = (
        prefixes.join(split.select("element"), "element", "left_semi")
        .withColumn("place", F.row_number().over(first))
        .where(F.col("place") <= count)
        .drop("place")
    )
    others = hubs.toDF(*["element" if c == "element" else f"other_{c}" for c in hubs.columns])
    pairs = prefixes.join(others, "element").where("component != other_component").where(allowed)
    return pairs.select(F.least("node", "other_node").alias("a"), F.greatest("node", "other_node").alias("b")).distinct()


def pairs_apart(prefixes: DataFrame, allowed: str, needed: str = "1") -> DataFrame:
    """Pairs (a, b) of nodes of different components that share an element of ``prefixes`` (element, node, component, n).

    The component that has an element most often is not compared with itself; ``allowed`` is a condition on the
    columns of one row and those of the other, which have ``other_`` in front, and ``needed`` the number of elements that a pair
    must share at least.
    """
    main = (
        prefixes.groupBy("element", "component")
        .agg(F.count(F.lit(1)).alias("rows"))
        .groupBy("element")
        .agg(F.max(F.struct("rows", "component")).alias("main"), F.count(F.lit(1)).alias("components"))
        .where("components > 1")
        .select("element", F.col("main.component").alias("main"))
    )
    minor = prefixes.join(main, "element").where("component != main").drop("main")
    others = prefixes.toDF(*["element" if c == "element" else f"other_{c}" for c in prefixes.columns])
    return (
        minor.join(others, "element")
        .where("component != other_component")
        .where(allowed)
        .groupBy(F.least("node", "other_node").alias("a"), F.greatest("node", "other_node").alias("b"))
        .agg(F.count(F.lit(1)).alias("shared"), F.min(F.expr(needed)).alias("needed"))
        .where("shared >= needed")
        .select("a", "b")
    )


#: Nodes of a key that are all compared with each other.
SMALL = 6


def linked_components(
    shared: DataFrame,
    alike: str,
    verify: Callable[[DataFrame], DataFrame],
    apart: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """node, component for every node that is linked with another; component is the smallest node it reaches.

    Keys of at most ``SMALL`` nodes are compared in all pairs, a bounded number for each node. ``shared`` holds (key, node, n) of the keys that several nodes have. ``alike`` is a condition on the
    sizes ``n`` and ``other_n`` that every link meets, and ``verify`` returns those of the pairs
    (a, b), a < b, that are links.

    First every key's nodes are compared with the smallest of them. For the keys whose nodes are not yet in
    one component, ``apart`` gets (leader, node, component, n) of these nodes, with one leader for the nodes of a key, and
    returns the links between different components of a leader's nodes. Every pair that shares a key is thus compared, known to be
    connected or excluded, and a key with thousands of nodes costs about one comparison for each.
    """
    spark = shared.sparkSession
    leaders = shared.groupBy("key").agg(F.min(F.struct("node", "n")).alias("first"), F.count(F.lit(1)).alias("many"))
    led = settle(
        spark,
        shared.join(leaders, "key").select(
            "key", "node", "n", "many", F.col("first.node").alias("leader"), F.col("first.n").alias("other_n")
        ),
        "shared",
    )
    stars = (
        led.where("node != leader")
        .where(alike)
        .select(F.col("leader").alias("a"), F.col("node").alias("b"))
        .distinct()
    )
    few = led.where((F.col("many") > 2) & (F.col("many") <= SMALL) & (F.col("node") != F.col("leader"))).select("key", "node", "n")
    pairs = (
        few.join(few.toDF("key", "other", "other_n"), "key")
        .where("node < other")
        .where(alike)
        .select(F.col("node").alias("a"), F.col("other").alias("b"))
    )
    links = verify(stars.union(pairs).distinct())
    labels = components(links)
    labelled = led.where(F.col("many") > SMALL).join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = settle(spark, labelled.select("key", "node", "n", "leader", "component"), "labelled")
    open_keys = (
        labelled.groupBy("key")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low != high")
        .select("key")
    )
    # Keys of one family get one leader, the smallest that a node of the key has under any key: nodes then
    # belong to few groups, and the nodes of a key to one.
    open_rows = settle(spark, labelled.join(open_keys, "key", "left_semi"), "open-keys")
    families = open_rows.groupBy("node").agg(F.min("leader").alias("family"))
    groups = open_rows.join(families, "node").groupBy("key").agg(F.min("family").alias("group"))
    rest = settle(
        spark,
        open_rows.where("node != leader")
        .join(groups, "key")
        .select(F.col("group").alias("leader"), "node", "component", "n")
        .distinct(),
        "open",
    )
    more = apart(rest)
    return components(links.union(more)) if more.limit(1).count() else labels
