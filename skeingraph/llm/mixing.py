"""Mix sources to target weights with a multivariate-hypergeometric splitting tree, in DataFrame expressions only.

Every source's documents are dealt by hash into ``blocks`` blocks. A source that is to give ``target`` of its ``size``
words gives every block ``floor(target / size)`` times and, once more, the documents that come first in hash order, up
to the missing words; the last block of those is cut between documents. The drawn blocks are then spread over ``2 **
levels`` output shards: at each node of a binary tree a uniform half of the node's draws goes left, so that the split
of every source's quota follows the multivariate hypergeometric law. A leaf holds a count for each source and takes that
many blocks from the source's permuted blocks, ranges of different leaves being disjoint. Within its shard a row's
``place`` gives the local shuffle.

Documents' sizes and keys are hashed, merged where rows are equal, and summed with partial aggregates, so a source with a
third of all rows is spread over its blocks; only the block table (sources times ``blocks``) is joined back to them. No
single task orders more than one source's blocks, the parts of one block, or the documents of one part: the document that
a source's last draw is cut at is found by the leading bits of the key, then the next ones, then the key itself; the
middle of a tree node's draws by their hashes' leading bits, then the hashes; the sources' order by ranges.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own, last in order; a null
doc_id is an ordinary value; of rows equal in doc_id, source and text as many are taken once more as the cut falls on; an
empty table gives an empty result; all columns are carried by ``mixed``, whatever their names, but for those that are
named shard or place in any case of letters, which are replaced; ``plan`` ignores further columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeingraph.llm.textbuf import others, whole_row
from skeingraph.session import written
from skeingraph.sources.tables import table

#: A word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Up to so many sources the block table is broadcast (some 80 bytes for each of a source's blocks); beyond, it is joined by shuffle.
BROADCAST_SOURCES = 500
#: A key that every key lies before.
_ALL = "g"
#: Equal rows that are spelled out at once.
_TWINS = 4096


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)  # by rank of the source, repeating
    most: float = 3.0  # times a source's size
    blocks: int = 512  # of each source, a power of two
    levels: int = 4  # of the splitting tree
    seed: int = 7


def _source() -> Column:
    return F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))


def _bits(key: Column, first: int, count: int) -> Column:
    """``count`` of the first 32 bits of a key in hex, after ``first`` bits."""
    return F.shiftright(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), 32 - first - count).bitwiseAND(F.lit((1 << count) - 1)).cast("int")


def _key(mix: Mix) -> Column:
    """The order of a source's documents: an MD5 of doc_id, source and text, in hex."""
    parts = [F.coalesce(F.concat(F.lit(tag), F.col(name).cast("string")), F.lit("-")) for tag, name in (("d", "doc_id"), ("s", "source"), ("t", "text"))]
    return F.md5(F.concat(F.lit(f"{mix.seed}:"), F.concat_ws("\x1f", *parts)).cast("binary"))


def _numbered(df: DataFrame, by: str) -> DataFrame:
    """Adds ``_rank`` from 0 in the order of ``by``: range-partitioned, numbered inside partitions and shifted by the counts of those before."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(parts, by).withColumn("_part", F.spark_partition_id()), "ranged")
    before = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(by)) - 1
    return ranged.withColumn("_at", place).join(F.broadcast(before), "_part").withColumn("_rank", F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """(_source, source_size) -> with weight and target: shares by weight, those above ``most`` times the size stopped there and the excess shared again until
    none is above. A round is one sum over the sources; the driver sees three numbers."""
    cycle = F.array(*[F.lit(float(w)) for w in mix.weights])
    ranked = _numbered(sizes, "_source")
    weighed = written(ranked.select("_source", "source_size", F.element_at(cycle, (F.col("_rank") % len(mix.weights)).cast("int") + 1).alias("weight"), (F.lit(mix.most) * F.col("source_size")).alias("_cap")), "weights")
    total = float(weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level, stopped = float("inf"), -1
    above = F.lit(False)
    while True:
        n, caps, weight = weighed.agg(F.coalesce(F.sum(above.cast("int")), F.lit(0)), F.coalesce(F.sum(F.when(above, F.col("_cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))).first()
        if n == stopped:
            break
        level, stopped = (total - caps) / weight if weight else 0.0, n
        above = F.col("_cap") <= F.lit(level) * F.col("weight")
    return weighed.select("_source", "source_size", "weight", F.when(above, F.col("_cap")).otherwise(F.lit(level) * F.col("weight")).alias("target"))


def _sized(docs: DataFrame, mix: Mix) -> DataFrame:
    """doc_id, source, size, _source, _key and the number ``_twins`` of equal rows."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", "source", size.alias("size"), _source().alias("_source"), _key(mix).alias("_key"))
    return rows.groupBy("_key", "doc_id", "source", "_source", "size").agg(F.count(F.lit(1)).alias("_twins"))


def _cuts(near: DataFrame, mix: Mix) -> DataFrame:
    """``near``: the documents of the block that each source's last draw is cut in, with ``_before`` (words of the blocks before) and ``_rest`` (words that the
    draw still gives). Of a block, the documents up to ``cut_key`` are taken whose middle comes before the missing words end; of the last ones, equal
    rows, ``cut_twins`` of ``cut_of``."""
    deep = mix.blocks.bit_length() - 1
    words = F.col("size") * F.col("_twins")
    near = near.withColumn("_fine", _bits(F.col("_key"), deep, 9))
    fine = near.groupBy("_source", "_block", "_fine").agg(F.sum(words).alias("_words"), F.max(F.struct("_key", F.col("_twins").alias("m"), F.col("_twins").alias("n"))).alias("_last"), F.first("_before").alias("_before"), F.first("_rest").alias("_rest"))
    fine = fine.withColumn("_to", F.col("_before") + F.sum("_words").over(Window.partitionBy("_source", "_block").orderBy("_fine"))).withColumn("_from", F.col("_to") - F.col("_words"))
    whole = fine.where("_to <= _rest").select("_source", "_block", "_last")
    split = near.drop("_before", "_rest").join(fine.where("_from < _rest and _to > _rest").select("_source", "_block", "_fine", "_from", "_rest"), ["_source", "_block", "_fine"])
    upto = F.sum(words).over(Window.partitionBy("_source", "_block", "_fine").orderBy("_key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    split = split.withColumn("_begin", F.col("_from") + upto - words)
    fits = F.when(F.col("size") == 0, F.when(F.col("_begin") <= F.col("_rest"), F.col("_twins"))).otherwise(F.floor((F.col("_rest") - F.col("_begin") - F.col("size") / 2) / F.col("size")) + 1)
    taken = split.withColumn("m", F.least(fits, F.col("_twins")).cast("long")).where("m > 0").select("_source", "_block", F.struct("_key", "m", F.col("_twins").alias("n")).alias("_last"))
    last = whole.unionAll(taken).groupBy("_source", "_block").agg(F.max("_last").alias("_last"))
    return last.select("_source", "_block", F.col("_last._key").alias("cut_key"), F.col("_last.m").alias("cut_twins"), F.col("_last.n").alias("cut_of"))


def plan(docs: DataFrame, mix: Mix = Mix()) -> tuple[DataFrame, DataFrame]:
    """(documents' sizes, block table). The sizes have doc_id, source, size, _source, _key, _block and _twins, one row for equal rows. The block table has, for
    each source and block, the shards of its whole draws (``shards``), and of the draw that is cut (``extra_shard``, taken by documents whose key comes
    before ``cut_key``, and by ``cut_twins`` of the ``cut_of`` rows with that key)."""
    sized = written(_sized(docs, mix).withColumn("_block", _bits(F.col("_key"), 0, mix.blocks.bit_length() - 1)), "sizes")
    blocks = written(sized.groupBy("_source", "_block").agg(F.sum(F.col("size") * F.col("_twins")).alias("words")), "blocks")
    goal = targets(blocks.groupBy("_source").agg(F.sum("words").alias("source_size")), mix)
    goal = goal.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int"))
    goal = written(goal.withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size")), "targets")
    order = Window.partitionBy("_source").orderBy("_block")
    placed = blocks.join(goal, "_source").withColumn("_after", F.sum("words").over(order)).withColumn("_before", F.col("_after") - F.col("words"))
    placed = written(placed.withColumn("_state", F.when(F.col("_after") <= F.col("_rest"), 1).when(F.col("_before") < F.col("_rest"), 2).otherwise(0)), "states")
    cut = _cuts(sized.join(placed.where("_state = 2").select("_source", "_block", "_before", "_rest"), ["_source", "_block"]), mix)
    placed = placed.join(cut, ["_source", "_block"], "left").withColumn("cut_key", F.when(F.col("_state") == 1, F.lit(_ALL)).otherwise(F.col("cut_key")))
    placed = placed.withColumn("_draws", F.col("_whole") + F.when(F.col("cut_key").isNotNull(), 1).otherwise(0))
    return sized, written(_dealt(written(placed, "placed"), mix), "plan")


def _hash(*parts) -> Column:
    return F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


#: Leading bits of a draw's hash that its node is halved by first.
_HALVING = 12


def _halved(tokens: DataFrame, level: int, mix: Mix) -> DataFrame:
    """Send half of every node's draws left: those whose hashes come first, so that each half is a uniform subset and the split of the quotas follows the
    multivariate hypergeometric law. A node's bins of hashes are ranked, then the draws of the one bin that the middle falls in."""
    hashed = tokens.withColumn("_h", _hash(mix.seed, level, F.col("_source"), F.col("_token"))).withColumn("_bin", F.shiftrightunsigned("_h", 64 - _HALVING).cast("int"))
    bins = hashed.groupBy("shard", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    node = Window.partitionBy("shard")
    upto = F.sum("_n").over(node.orderBy("_bin"))
    # an odd node's middle draw goes left or right by the node's own hash
    half = F.floor((F.sum("_n").over(node) + F.pmod(_hash(mix.seed, level, F.col("shard")), F.lit(2))) / 2)
    bins = bins.select("shard", "_bin", (half - upto + F.col("_n")).alias("_room"), "_n")
    met = hashed.join(bins, ["shard", "_bin"])
    sure = met.where("_room <= 0 or _room >= _n").withColumn("_left", F.col("_room") > 0)
    rank = F.row_number().over(Window.partitionBy("shard", "_bin").orderBy("_h", "_source", "_token"))
    middle = met.where("_room > 0 and _room < _n").withColumn("_left", rank <= F.col("_room"))
    return sure.unionByName(middle).select("_source", "_token", (F.col("shard") * 2 + F.when(F.col("_left"), 0).otherwise(1)).alias("shard"))


def _dealt(placed: DataFrame, mix: Mix) -> DataFrame:
    """Deal the drawn blocks out to shards."""
    quotas = placed.groupBy("_source").agg(F.sum("_draws").alias("_quota")).where("_quota > 0")
    tokens = quotas.select("_source", F.explode(F.sequence(F.lit(1), F.col("_quota").cast("int"))).alias("_token")).withColumn("shard", F.lit(0))
    for level in range(mix.levels):
        tokens = written(_halved(tokens, level, mix), "draws")
    leaf = tokens.groupBy("_source", "shard").agg(F.count(F.lit(1)).alias("_count"))
    leaf = leaf.withColumn("_to", F.sum("_count").over(Window.partitionBy("_source").orderBy("shard"))).withColumn("_from", F.col("_to") - F.col("_count"))
    draws = placed.where("_draws > 0").select("_source", "_block", "_whole", F.explode(F.sequence(F.lit(1), F.col("_draws"))).alias("_copy"))
    draws = draws.withColumn("_at", F.row_number().over(Window.partitionBy("_source").orderBy(_hash(mix.seed, F.col("_source"), F.col("_block"), F.col("_copy")), "_block", "_copy")))
    draws = draws.alias("d").join(leaf.alias("l"), (F.col("d._source") == F.col("l._source")) & (F.col("_at") > F.col("_from")) & (F.col("_at") <= F.col("_to"))).select("d._source", "_block", "_copy", "_whole", "shard")
    whole = F.transform(F.array_sort(F.collect_list(F.when(F.col("_copy") <= F.col("_whole"), F.struct("_copy", "shard")))), lambda x: x["shard"])
    dealt = draws.groupBy("_source", "_block").agg(whole.alias("shards"), F.max(F.when(F.col("_copy") > F.col("_whole"), F.col("shard"))).alias("extra_shard"))
    return placed.select("_source", "_block", "source_size", "target", "cut_key", "cut_twins", "cut_of").join(dealt, ["_source", "_block"], "left")


def _with_blocks(keyed: DataFrame, blocks: DataFrame) -> DataFrame:
    few = blocks.agg(F.count_distinct("_source")).first()[0] <= BROADCAST_SOURCES
    joined = keyed.join(F.broadcast(blocks) if few else blocks, ["_source", "_block"], "left")
    return joined.withColumn("shards", F.coalesce("shards", F.array().cast("array<int>")))


def mix_report(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words), copies and shards of every document."""
    sized, blocks = plan(docs, mix)
    met = _with_blocks(sized, blocks)
    more = F.when(F.col("extra_shard").isNull() | (F.col("_key") > F.col("cut_key")), F.lit(0)).when(F.col("_key") < F.col("cut_key"), F.col("_twins")).otherwise(F.col("cut_twins"))
    # equal rows are spelled out again, the first of them with the further draw
    met = met.withColumn("_more", more).withColumn("_base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_twins") - 1, F.lit(_TWINS).cast("long"))))
    met = met.withColumn("_at", F.explode(F.sequence(F.col("_base"), F.least(F.col("_base") + _TWINS, F.col("_twins")) - 1)))
    met = met.withColumn("shards", F.when(F.col("_at") < F.col("_more"), F.concat("shards", F.array("extra_shard"))).otherwise(F.col("shards")))
    met = met.withColumn("copies", F.when(F.col("size") > 0, F.size("shards")).otherwise(0))
    return met.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "shards")


def _twin_number(rows: DataFrame) -> DataFrame:
    """Adds ``_at``, numbering rows of one (_source, _key) from 0, inside the partitions they were read in and shifted by the counts of those before."""
    placed = written(rows.withColumns({"_part": F.spark_partition_id(), "_id": F.monotonically_increasing_id()}), "twins")
    counts = placed.groupBy("_source", "_key", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_shift", F.sum("_n").over(Window.partitionBy("_source", "_key").orderBy("_part")) - F.col("_n")).drop("_n")
    own = F.row_number().over(Window.partitionBy("_source", "_key", "_part").orderBy("_id")) - 1
    return placed.withColumn("_own", own).join(before, ["_source", "_key", "_part"]).withColumn("_at", F.col("_own") + F.col("_shift")).drop("_part", "_id", "_own", "_shift")


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mixture: every column of ``docs``, a row for each time that a document is taken, with its shard and ``place`` in the shard's local order.
    Documents without a word are not taken."""
    _, blocks = plan(docs, mix)
    own = docs.where(F.col("text").rlike(WORD)).select(whole_row(docs).alias("row"), _source().alias("_source"), _key(mix).alias("_key")).withColumn("_block", _bits(F.col("_key"), 0, mix.blocks.bit_length() - 1))
    met = _with_blocks(own, blocks.drop("source_size", "target"))
    split = (F.col("_key") == F.col("cut_key")) & (F.col("cut_twins") < F.col("cut_of"))
    further = F.col("extra_shard").isNotNull() & (F.col("_key") <= F.col("cut_key"))
    if blocks.where("cut_twins < cut_of").isEmpty():
        met = met.withColumn("_further", further)
    else:  # the cut falls between equal rows
        numbered = _twin_number(met.where(split)).withColumn("_further", F.col("_at") < F.col("cut_twins")).drop("_at")
        met = met.where(~F.coalesce(split, F.lit(False))).withColumn("_further", further).unionByName(numbered)
    met = met.withColumn("shards", F.when(F.col("_further"), F.concat("shards", F.array("extra_shard"))).otherwise(F.col("shards")))
    drawn = met.select("row", "_key", F.posexplode("shards").alias("_copy", "shard"))
    carried = [F.col("row").getField(x.name).alias(x.name) for x in others(docs, "shard", "place")]
    return drawn.select(*carried, "shard", F.xxhash64(F.col("_key"), F.col("_copy"), F.lit(mix.seed)).alias("place"))


def write_shards(mixture: DataFrame, path: str, mix: Mix = Mix()) -> None:
    """Write the mixture, one folder for each shard, rows in the order of the local shuffle; a shard's rows are dealt to several files by place."""
    parts = max(1, int(mixture.sparkSession.conf.get("spark.sql.shuffle.partitions")) >> mix.levels)
    dealt = mixture.withColumn("_part", F.pmod(F.col("place"), F.lit(parts)))
    dealt.repartition("shard", "_part").sortWithinPartitions("shard", "place").drop("_part").write.partitionBy("shard").parquet(path)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def _sql(mix: Mix = Mix()) -> str:
    """The targets in closed form, by sources in order of the level at which they stop, and the draws from running sums in key order."""
    tagged = [f"coalesce('{tag}' || CAST({name} AS VARCHAR), '-')" for tag, name in (("d", "doc_id"), ("s", "source"), ("t", "text"))]
    key = f"md5('{mix.seed}:' || {' || chr(31) || '.join(tagged)})"
    cycle = "CASE rank % " + str(len(mix.weights)) + " " + " ".join(f"WHEN {k} THEN {w}::DOUBLE" for k, w in enumerate(mix.weights)) + " END"
    return f"""
    WITH d AS (SELECT doc_id, coalesce('0' || source, '1') AS src, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size, {key} AS key FROM documents),
    r AS (SELECT src, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY src) - 1 AS rank FROM d GROUP BY src),
    w AS (SELECT *, {cycle} AS weight, {mix.most}::DOUBLE * source_size AS cap FROM r),
    l AS (SELECT *, ((SELECT sum(source_size) FROM r)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER (ORDER BY cap / weight, rank) AS i FROM w),
    t AS (SELECT src, source_size, CASE WHEN cap > level * weight THEN (SELECT arg_min(level, i) FROM l WHERE cap > level * weight) * weight ELSE cap END AS target FROM l),
    g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
    o AS (SELECT d.doc_id, size, source_size, target, whole, target - whole * source_size AS rest, sum(size) OVER (PARTITION BY src ORDER BY key ROWS UNBOUNDED PRECEDING) - size / 2 AS middle FROM d JOIN g USING (src))
    SELECT doc_id, size, source_size, target, (size * (whole + (middle <= rest)::INT))::BIGINT AS taken, CASE WHEN size > 0 THEN whole + (middle <= rest)::INT ELSE 0 END::INT AS copies FROM o"""


OP4_SQL = _sql()
