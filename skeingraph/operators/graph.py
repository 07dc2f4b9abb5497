"""Graph metrics over an edge list (src, dst): iterative joins, every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeingraph.session import written


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct unordered pairs, loops removed."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def degree(edges: DataFrame) -> DataFrame:
    """node, degree: endpoints, a loop counting twice."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node). Least-neighbour hooking with pointer jumping: rounds grow with the logarithm of the diameter."""
    pairs = undirected(edges)
    both = written(pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "both")
    loops = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    labels = written(loops.select("node", F.col("node").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("dst"), "component"), "dst").groupBy("src").agg(F.min("component").alias("near"))
        hooked = labels.join(near, F.col("node") == F.col("src"), "left").select("node", "component", F.least("component", F.coalesce("near", "component")).alias("next"))
        jump = hooked.select(F.col("node").alias("next"), F.col("next").alias("far"))
        moved = written(hooked.join(jump, "next").select("node", F.least("next", "far").alias("component"), (F.least("next", "far") != F.col("component")).alias("changed")), "labels")
        labels = moved.select("node", "component")
        if moved.where("changed").isEmpty():
            return labels


def giant(labels: DataFrame) -> DataFrame:
    """The largest component; the least of equal ones."""
    return labels.groupBy("component").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "component").limit(1)


def communities(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """node, community by label propagation: the most frequent label among neighbours, the least of equal ones. It stands in for modularity optimisation, which has
    no Spark form; labels of two nodes that would swap for ever are kept from it by moving only to smaller labels in odd rounds."""
    pairs = undirected(edges)
    both = written(pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "both")
    labels = written(both.select(F.col("src").alias("node")).distinct().select("node", F.col("node").alias("community")), "labels")
    for turn in range(rounds):
        votes = both.join(labels.select(F.col("node").alias("dst"), "community"), "dst").groupBy("src", "community").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("src").agg(F.min(F.struct((-F.col("n")).alias("n"), "community")).alias("b")).select("src", F.col("b.community").alias("best"))
        moves = F.col("best").isNotNull() if turn % 2 == 0 else F.col("best") < F.col("community")
        labels = written(labels.join(best, F.col("node") == F.col("src"), "left").select("node", F.when(moves, F.col("best")).otherwise(F.col("community")).alias("community")), "labels")
    return labels


def supergraph(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edge counts between different communities."""
    a = labels.select(F.col("node").alias("src"), F.col("community").alias("_a"))
    b = labels.select(F.col("node").alias("dst"), F.col("community").alias("_b"))
    both = edges.join(a, "src").join(b, "dst").where("_a <> _b")
    return both.groupBy(F.least("_a", "_b").alias("low"), F.greatest("_a", "_b").alias("high")).agg(F.count(F.lit(1)).alias("edges"))


def skeleton(edges: DataFrame, heat: DataFrame, target: int = 500_000) -> DataFrame:
    """src, dst, weight: every node's best edge, even beyond ``target``, then the best of the rest up to it. Weight (ca + cb) / sqrt(da db), NaN the greatest and null the
    least; heat: node, heat. Of the rows of one pair, which a repeated node of heat brings, only the best can be a node's best edge."""
    pairs = written(undirected(edges), "pairs")
    deg = degree(pairs)
    of = lambda end, tag: heat.join(deg, "node").select(F.col("node").alias(end), F.col("heat").alias(f"c{tag}"), F.col("degree").alias(f"d{tag}"))
    weighed = pairs.join(of("src", "a"), "src").join(of("dst", "b"), "dst").select("src", "dst", ((F.col("ca") + F.col("cb")) / F.sqrt(F.col("da") * F.col("db"))).alias("weight"))
    weighed = written(weighed, "weighed")
    ends = weighed.select("src", "dst", "weight", F.explode(F.array("src", "dst")).alias("node"))
    falling = F.struct(F.col("weight").isNull().alias("none"), (~F.isnan("weight")).alias("number"), (-F.col("weight")).alias("w"), "src", "dst")
    best = ends.groupBy("node").agg(F.min(falling).alias("b")).select("b.src", "b.dst", F.lit(1).alias("copy")).distinct()
    copies = weighed.withColumn("copy", F.row_number().over(Window.partitionBy("src", "dst").orderBy(F.desc("weight"))))
    marked = written(copies.join(best.withColumn("first", F.lit(1)), ["src", "dst", "copy"], "left"), "marked")
    covering = marked.where("first = 1")
    fill = marked.where("first is null").orderBy(F.desc("weight"), "src", "dst").limit(max(0, target - covering.count()))
    return covering.unionAll(fill).orderBy(F.col("first").desc_nulls_last(), F.desc("weight"), "src", "dst").select("src", "dst", "weight")


def centroids(nodes: DataFrame) -> DataFrame:
    """community, x, y, z, label: means, and the name of the member of least rank. nodes: community, x, y, z, rank, name."""
    return nodes.groupBy("community").agg(*[F.avg(c).alias(c) for c in "xyz"], F.min_by("name", "rank").alias("label"), F.count(F.lit(1)).alias("size"))


def compactness(edges: DataFrame, positions: DataFrame, fraction: float = 1.0, seed: int = 7) -> DataFrame:
    """Mean edge length over the mean length between paired random nodes. positions: node, x, y, z."""
    p = lambda tag: positions.select(F.col("node").alias(tag), *[F.col(c).alias(f"{tag}_{c}") for c in "xyz"])
    length = F.sqrt(sum(((F.col(f"src_{c}") - F.col(f"dst_{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    own = edges.sample(fraction=fraction, seed=seed).join(p("src"), "src").join(p("dst"), "dst").agg(F.avg(length).alias("edge"))
    # random pairs: both ends shuffled by hash and numbered by it, so that no cross join is needed
    numbered = lambda tag, salt: positions.select(F.col("node"), *"xyz").withColumn("k", F.row_number().over(Window.orderBy(F.xxhash64("node", F.lit(salt))))).select("k", *[F.col(c).alias(f"{tag}_{c}") for c in "xyz"])
    rest = numbered("src", seed).join(numbered("dst", seed + 1), "k").agg(F.avg(length).alias("random"))
    return own.withColumn("one", F.lit(1)).join(rest.withColumn("one", F.lit(1)), "one").select((F.col("edge") / F.col("random")).alias("compactness"))


def ranks(nodes: DataFrame, by: str, tie: str) -> DataFrame:
    """Adds ``rank``: the place in descending order of ``by``. The order is found by ranges: rows are range-partitioned, numbered inside
    their partition and shifted by the counts of those before, so that no single task sorts everything."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(by).desc_nulls_last(), F.col(tie)]
    ranged = written(nodes.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranged")  # read twice: the ranges must be the same
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1).join(F.broadcast(before), "_part").withColumn("rank", F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def cell_ordinal(positions: DataFrame, side: float, *order: str) -> DataFrame:
    """Adds the lattice cell (cx, cy) of ``side`` and the ``ordinal`` of a node among those of its cell."""
    cells = positions.withColumns({f"c{a}": F.floor(F.col(a) / side).cast("long") for a in "xy"})
    return cells.withColumn("ordinal", F.row_number().over(Window.partitionBy("cx", "cy").orderBy(*order)) - 1)


#: Fixed value: the span that a layout is scaled to.
SPAN = 1200.0


def scaled(positions: DataFrame, span: float = SPAN) -> DataFrame:
    """Positions (node, x, y, z) moved to their middle and scaled so that the widest axis spans ``span``; a layout of no extent is only moved."""
    bounds = positions.agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("low", F.min), ("high", F.max))])
    widest = F.greatest(*[F.col(f"high_{c}") - F.col(f"low_{c}") for c in "xyz"])
    bounds = bounds.withColumn("factor", F.when(widest > 0, F.lit(span) / widest).otherwise(1.0))  # one row
    middle = lambda c: (F.col(f"low_{c}") + F.col(f"high_{c}")) / 2
    return positions.join(F.broadcast(bounds)).select("node", *[((F.col(c) - middle(c)) * F.col("factor")).alias(c) for c in "xyz"])


def nearest(positions: DataFrame, point: tuple[float, float, float], radius: float, count: int) -> DataFrame:
    """The ``count`` nodes nearest to a point, at most ``radius`` away; a box test on plain columns comes first, so that it reaches the scan."""
    box = [F.col(c).between(p - radius, p + radius) for c, p in zip("xyz", point)]
    distance = F.sqrt(sum(((F.col(c) - p) ** 2 for c, p in zip("xyz", point)), F.lit(0.0)))
    return positions.where(box[0] & box[1] & box[2]).withColumn("distance", distance).where(F.col("distance") <= radius).orderBy("distance", "node").limit(count)


def coarsened(supers: DataFrame, sizes: DataFrame, anchors: int = 64) -> DataFrame:
    """community, anchor, distance: the largest communities are anchors, any other goes to the nearest over edges of length 1 / ln(1 + weight); the least anchor of
    equally near ones, none if it is out of reach. supers: low, high, edges; sizes: community, size. Rounds of relaxation until nothing changes."""
    both = supers.select(F.col("low").alias("a"), F.col("high").alias("b"), (1 / F.log1p(F.col("edges"))).alias("length"))
    both = written(both.unionAll(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "length")), "lengths")
    chosen = sizes.orderBy(F.desc("size"), "community").limit(anchors).select("community")
    near = written(chosen.select("community", F.col("community").alias("anchor"), F.lit(0.0).alias("distance")), "near")
    while True:
        step = near.join(both, F.col("community") == F.col("a")).select(F.col("b").alias("community"), "anchor", (F.col("distance") + F.col("length")).alias("distance"))
        best = near.unionByName(step).groupBy("community").agg(F.min(F.struct("distance", "anchor")).alias("m")).select("community", "m.anchor", "m.distance")
        after = written(best, "near")
        if after.exceptAll(near).isEmpty():
            return sizes.select("community").join(after, "community", "left")
        near = after


def tag_bits(rows: DataFrame, most: int = 32) -> DataFrame:
    """id, bits: a bit for each of the ``most`` frequent tags (of rows: id, tag, pos), numbered by falling frequency, then by first appearance."""
    frequent = rows.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first")).orderBy(F.desc("n"), "first").limit(most)
    codes = frequent.withColumn("bit", F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1)  # at most ``most`` rows
    coded = rows.join(F.broadcast(codes.select("tag", "bit")), "tag", "left")
    return coded.groupBy("id").agg(F.coalesce(F.bit_or(F.when(F.col("bit").isNotNull(), F.expr("shiftleft(1L, bit)"))), F.lit(0).cast("long")).alias("bits"))
