"""Connected components of a link table, as joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize

def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h"),
    ).first()
    return int(row["n"]), int(row["h"])

def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label each linked vertex with the least vertex of its component.

    ``edges`` has long columns ``u`` and ``v`` (any direction, repeats and loops allowed).
    Returns ``v``, ``component`` for every vertex that has a link to another one and is not
    itself the least of its component; all other vertices are their own label.

    Large-star and small-star rounds (Kiveris et al. 2014) alternate until the links stop
    changing: every round is two grouped minima and joins, no vertex's neighbours are ever
    gathered, and each round's links are a table in the shared folder.  Loops and nulls are
    ignored; an empty table gives an empty result.
    """
    links = edges.select(
        F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")
    ).where("u <> v").distinct()
    links = materialize(links, "links")
    state = _state(links)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        # large-star: each vertex ties its larger neighbours to its least neighbour (or itself)
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            links.select(F.col("v").alias("u"), F.col("u").alias("v"))
            .join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        # small-star: each vertex ties its smaller neighbours and itself to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        links = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        links = materialize(links, "links")
        now = _state(links)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return links.select(F.col("u").alias("v"), F.col("v").alias("component"))
