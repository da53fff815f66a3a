"""Connected components of a link table, by contraction; nothing is gathered in one place."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobstrata.session import Stages


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of the links (a, b).

    In each round every node points to its neighbour, or itself, of lowest priority; pointers are followed to their roots
    by doubling, and links are redrawn between roots. Priorities are hashes that change with the round, so about half of
    the nodes or more go in each one. A hub is one key of a partial aggregate, and of joins that can be split. Links that
    repeat, point both ways or to themselves change nothing; links with a null end are left out."""
    stages = Stages(edges.sparkSession)
    links = stages.keep(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    maps: list[DataFrame] = []
    while not links.isEmpty():
        place = lambda c: F.struct(F.xxhash64(c, F.lit(len(maps))).alias("h"), F.col(c).alias("node"))
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min(place("b")).alias("low"))
        up = stages.keep(lowest.select(F.col("a").alias("node"), F.least(F.col("low"), place("a"))["node"].alias("root")), "pointers")
        while True:
            above = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = stages.keep(up.join(above, "root").select("node", F.col("next").alias("root"), (F.col("root") != F.col("next")).alias("moved")), "pointers")
            stages.drop(up)
            up = jumped
            if up.where("moved").isEmpty():
                break
        maps.append(up.select("node", "root"))
        to = lambda end: maps[-1].select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))  # noqa: E731,B023
        redrawn = links.join(to("a"), "a").join(to("b"), "b").where("a_root <> b_root")
        fewer = stages.keep(redrawn.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), "links")
        stages.drop(links)
        links = fewer
    if not maps:
        return links.select(F.col("a").alias("node"), F.col("a").alias("component"))
    out = maps[0]
    for m in maps[1:]:
        nxt = m.select(F.col("node").alias("root"), F.col("root").alias("next"))
        out = out.join(nxt, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    out = stages.keep(out, "roots")
    return out.join(out.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component")
