"""A crawl over a table of pages: seeds of the front page, links breadth first, bounded in depth and in pages, then details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import html
from ..session import stage

#: Depth and size at which a crawl ends.
MOST_DEPTH, MOST_PAGES = 2, 160


def reachable(seeds: DataFrame, edges: DataFrame, depth: int = MOST_DEPTH, most: int | None = MOST_PAGES, order: Column | None = None) -> DataFrame:
    """(node, depth) from seeds (node) along edges (src, dst): each node at its least depth.

    A step is a join of the frontier with the edges and an anti join with what is known. ``most``
    keeps the first nodes by depth and id, or ``order`` (the crawl's own limit; None for no limit).
    """
    known = stage(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "frontier")
    frontier = known
    for step in range(1, depth + 1):
        found = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = stage(found.join(known.select("node"), "node", "left_anti").withColumn("depth", F.lit(step)), "frontier")
        known = known.unionByName(frontier)
    return known if most is None else known.orderBy("depth", F.col("node") if order is None else order).limit(most)


def scan(front: DataFrame, pages: DataFrame, depth: int = MOST_DEPTH, most: int | None = MOST_PAGES, order: Column | None = None) -> DataFrame:
    """(id, depth, and the detail record's fields) of the pages that a crawl reaches.

    ``front`` (html) is the front page, whose data-job-id attributes and links are the seeds;
    ``pages`` (id, html) are the detail pages, whose links lead on. Pages that aren't there are skipped.
    """
    ids = lambda df, page: df.select(F.explode(F.array_union(html.seed_ids(F.col(page)), html.link_ids(F.col(page)))).alias("node"))
    edges = pages.select(F.col("id").alias("src"), F.explode(html.link_ids(F.col("html"))).alias("dst"))
    reached = reachable(ids(front, "html"), edges, depth, most, order)
    found = reached.join(pages, F.col("node") == F.col("id"))
    return html.details(found, "html", ("id", "depth"))
