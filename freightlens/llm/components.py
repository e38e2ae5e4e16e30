"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightlens.llm.shared import table


def _are_stars(pairs: DataFrame) -> bool:
    """Whether each node has one link (a, b) down, or only links from above."""
    up = F.col("up")
    ends = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))))
    return ends.groupBy("node").agg(F.sum(up).alias("up"), F.min(up).alias("least")).where("up > 1 OR (up = 1 AND least = 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node that has a link (a, b); comp is the least node of its component.

    Each round is two group-bys with map-side minima and a join; the links of a round
    are a table in the shared folder.  Null ends and self-links are left out.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = table(pairs, "links")
    while not _are_stars(pairs):
        both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a AND b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = table(large, "large-star")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.inline(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))).where("a <> b").distinct()
        pairs = table(small, "small-star")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionAll(pairs.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``comps`` after further links (a, b): only links between components are gone through again."""
    of = lambda end: comps.select(F.col("node").alias(end), F.col("comp").alias(f"{end}_comp"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    between = table(ends.select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b")).where("a <> b").distinct(), "component-links")
    if between.isEmpty():
        return comps
    whole = table(components(between), "joined-components")
    known = comps.join(whole.select(F.col("node").alias("comp"), F.col("comp").alias("whole")), "comp", "left").select("node", F.coalesce("whole", "comp").alias("comp"))
    return table(known.unionAll(whole.join(comps, "node", "left_anti")), "components")


MIX, SHARE = 8, 8


def _open(entries: DataFrame, comps: DataFrame) -> DataFrame:
    """The entries, with their nodes' components, of tokens that several components have."""
    own = table(entries.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "entries")
    several = own.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
    return own.join(several, "token")


def _pairs(a: DataFrame, b: DataFrame, on: list[str], carried: list[str], near) -> DataFrame:
    others = b.select(*on, F.col("node").alias("_node"), F.col("comp").alias("_comp"), *[F.col(c).alias(f"_{c}") for c in carried])
    pairs = a.join(others, on).where("comp <> _comp").where(near(lambda c: F.col(f"_{c}")))
    return pairs.select(F.greatest("node", "_node").alias("a"), F.least("node", "_node").alias("b")).distinct()


def merged(entries: DataFrame, links: DataFrame, carried: list[str], near, verify, of_node: DataFrame | None = None, mixes: int = 3) -> DataFrame:
    """Components of all links between nodes that share a token and are near, given some of them.

    ``entries`` has token, node and the carried columns; ``near`` gets a function from
    a carried column to the other entry's and gives a condition; ``verify`` gives the
    links among pairs (a, b).  Carried columns that are in ``of_node`` (node and
    columns) are joined to the tokens that remain.

    Only pairs of different components are looked at.  First, ``mixes`` times, one in
    SHARE of each token's entries, picked by hash, are dealt into small parts of about
    MIX entries, and the pairs inside the parts are verified: a dense group becomes one
    component by a few pairs for each node.  What that leaves out is found next.  Then, for completeness, nodes outside their token's most
    frequent component are joined with all of another component.  A token that one
    component holds alone gives nothing, so no group is expanded into all its pairs.
    """
    comps = components(links)
    for seed in range(mixes):
        some = _open(entries, comps)
        if of_node is not None:
            some, of_node = some.join(of_node, "node"), None
        some = table(some, "open-entries")
        if some.isEmpty():
            return comps
        few = some.where(F.pmod(F.xxhash64(F.lit(seed), "node", "token"), F.lit(SHARE)) == 0)
        sizes = few.groupBy("token").agg(F.ceil(F.count("*") / MIX).alias("parts"))
        dealt = few.join(sizes, "token").withColumn("part", F.pmod(F.xxhash64("node", "token", F.lit(seed)), F.col("parts"))).drop("parts")
        comps = joined(comps, verify(_pairs(dealt, dealt, ["token", "part"], carried, near)))
        entries = some.drop("comp")
    some = table(_open(entries, comps), "open-entries")
    sizes = some.groupBy("token", "comp").agg(F.count("*").alias("c"))
    main = sizes.groupBy("token").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"))
    outside = some.join(main, "token").where("comp <> main").drop("main")
    return joined(comps, verify(_pairs(outside, some, ["token"], carried, near)))
