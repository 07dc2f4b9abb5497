"""Near-duplicates: ProbMinHash sketches, banding, exact verification, and classes of linked documents.

Two different texts are linked when the Jaccard similarity of their five-word shingle sets is 0.8 or more; candidates
share one of the bands of their ProbMinHash sketches, of which a text has two: one with weights 1 + ln of a shingle's
count, and one with all weights 1. The registers of the latter agree with the Jaccard similarity of the sets itself, so
that 36 bands of 5 miss a pair of similarity 0.8 with probability (1 - 0.8 ** 5) ** 36 = 6.3e-7, however often its
shingles repeat. A class is a connected component of links; equal texts are always of one class.

Equal texts are one node, found by partial aggregates. The nodes of a bucket (a band's key) are never paired with one
another wholesale. In each round one node of each bucket, the hub, is compared with those of the bucket that are of
another class by now, then leaves the bucket: its pairs are settled. As classes merge, buckets of one class end. What is
left after ``rounds`` rounds - buckets that hold dissimilar texts - is settled by an exact prefix-filtered join: texts of
similarity 0.8 share one of the rarest fifth (and one) of their shingles, and where in that order they first do bounds
what they can have in common; only pairs of different classes that pass are compared. So no candidate pair goes
unsettled.

Buckets, hubs and shingles with more than ``spread`` rows are dealt to several tasks, by a hash of the node, and what
these meet is repeated for each; shingle arrays move only for pairs that are compared, never for whole buckets. Labels
merge by joins whose large side AQE may split. Before texts, buckets or shingle arrays are shuffled for a join, a bitmap
of the hashes of the keys that they may meet, of 8 MiB at most, drops nearly all rows that would meet none; the join
itself still decides, so that a bitmap that is too full only costs shuffle. Every round's tables are written to the
shared folder, which also cuts lineage, and go when the operator has its classes.

Defined cases: a null text is empty; an empty text or one without a word is linked to nothing, but equal ones are one
class; a text of fewer than five words has one shingle of all its words; a class is named by its least doc_id (null
only if all are null); repeated rows get a row each; an empty table gives an empty result; ``deduplicated`` carries all
columns, whatever their names, and keeps of every class one row, with the least doc_id, then the least MD5 of the text
(of rows equal in both, the one of least hash of all columns).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeingraph.llm.probminhash import document_bands, shingle_sets
from skeingraph.llm.textbuf import encoded, runs, whole_row
from skeingraph.session import bound_arrow_batches, scratch, written
from skeingraph.sources.tables import table


@dataclass(frozen=True)
class Settings:
    width: int = 5  # words of a shingle
    similarity: tuple[int, int] = (4, 5)  # least Jaccard similarity, as a fraction
    bands: int = 36  # of each sketch
    rows: int = 5
    rounds: int = 4
    spread: int = 512  # rows of one key that a task joins
    together: int = 1 << 20  # bytes of text that are sketched at once
    bits: int = 1 << 26  # of a bitmap of keys, at most


def node_of(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _sketches(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, node, n (distinct shingles) and buckets of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int64())
        for batch in batches:
            texts = encoded(batch.column(1))
            nodes = [hashlib.md5(t).digest() for t in texts]
            place: dict[bytes, int] = {}
            for k, node in enumerate(nodes):
                place.setdefault(node, k)
            own = sorted(place.values())
            n, keys = {}, {}
            for a, b in runs([len(texts[k]) for k in own], s.together):
                counts, found = document_bands([texts[k] for k in own[a:b]], s.width, s.bands * s.rows, s.rows)
                for k, c, x in zip(own[a:b], counts, found):
                    n[k], keys[k] = int(c), x.view(np.int64) if c else np.zeros(0, np.int64)
            at = [place[x] for x in nodes]
            yield pa.record_batch([batch.column(0), pa.array(nodes, pa.binary()), pa.array([n[k] for k in at], pa.int32()), pa.array([keys[k] for k in at], kind)], names=["doc_id", "node", "n", "buckets"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, node binary, n int, buckets array<long>")


def _likely(rows: DataFrame, of: list[str], keys: DataFrame, s: Settings) -> DataFrame:
    """``rows`` without most of those whose columns ``of`` are no row of ``keys`` (as many columns, read from a table): none that is one is lost. A bit is set for
    the hash of each key, about 64 bits a key up to ``bits``; the bitmap is broadcast in pieces of 4 KiB."""
    width = max(1 << 15, min(s.bits, 1 << (64 * keys.count()).bit_length()))
    place = lambda columns: F.pmod(F.xxhash64(*columns), F.lit(width))
    at = keys.select(place(keys.columns).alias("_at")).distinct()
    pieces = at.groupBy(F.shiftright("_at", 15).alias("_piece")).agg(F.bitmap_construct_agg(F.col("_at").bitwiseAND(32767)).alias("_bits"))
    met = rows.withColumn("_at", place(of)).join(F.broadcast(pieces), F.shiftright("_at", 15) == F.col("_piece"))
    byte = F.conv(F.hex(F.expr("substring(_bits, cast((_at & 32767) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return met.where(byte.bitwiseAND(F.expr("shiftleft(1, cast(_at & 7 as int))")) != 0).select(*rows.columns)


def _sets(docs: DataFrame, wanted: DataFrame, s: Settings) -> DataFrame:
    """node and its sorted shingle hashes, of the nodes in ``wanted`` (node, first_id; read from a table), each read from one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = encoded(batch.column(1))
            for a, b in runs([len(t) for t in texts], s.together):
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(shingle_sets(texts[a:b], s.width), pa.list_(pa.int64()))], names=["node", "grams"])

    # ids by their hashes: rows of one node have one text, so that it does not matter which of them is read
    rows = docs.select("text", node_of(F.col("text")).alias("node"), F.xxhash64("doc_id").alias("id"))
    own = wanted.select("node", F.xxhash64("first_id").alias("id"))
    found = _likely(rows, ["node", "id"], own, s).join(own.hint("shuffle_hash"), ["node", "id"])  # Spark would move a semi join before the bitmap
    once = found.groupBy("node", "id").agg(F.first("text").alias("text"))  # dealt by these columns already; rows may repeat an id with its text
    return once.select("node", "text").mapInArrow(run, "node binary, grams array<long>")


def _similar(s: Settings, common: Column, a: Column, b: Column) -> Column:
    num, den = s.similarity
    return common * den >= (a + b - common) * num


def _sizes_fit(s: Settings, a: Column, b: Column) -> Column:
    num, den = s.similarity
    return F.least(a, b) * den >= F.greatest(a, b) * num


def _met(left: DataFrame, right: DataFrame, key: str, by: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` joined with the rows of ``right``, by a sort-merge join whatever the sizes. ``hot`` (key, _salts): keys with many rows in ``left``, which are dealt
    to that many parts by a hash of ``by``, and met in each; Spark broadcasts this list where its size allows."""
    own = left.join(hot, key, "left").withColumn("_salt", F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(by), F.col("_salts")).cast("int"))).drop("_salts")
    met = right.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return own.join(met.hint("merge"), [key, "_salt"], how).drop("_salt")


def _hot(sizes: DataFrame, key: str, s: Settings) -> DataFrame:
    """``sizes``: key, c."""
    return written(sizes.where(F.col("c") > s.spread).select(key, F.ceil(F.col("c") / s.spread).cast("int").alias("_salts")), "hot")


def _verified(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Those of (a, b, label_a, label_b) that are similar, as links between labels; ``b`` may be in many pairs."""
    pairs = written(pairs, "pairs")
    hot = _hot(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("c")), "b", s)
    left, right = (_likely(sets.select(F.col("node").alias(x), F.col("grams").alias(f"_{x}")), [x], pairs.select(x), s) for x in "ab")
    both = _met(pairs.join(left, "a"), right, "b", "a", hot)
    return both.where(_similar(s, F.size(F.array_intersect("_a", "_b")), F.size("_a"), F.size("_b"))).select("label_a", "label_b")


def _merged(labels: DataFrame, links: DataFrame, s: Settings) -> DataFrame:
    """``labels`` (node, label) after merging linked labels: least-neighbour hooking and pointer jumping until nothing changes."""
    links = written(links.distinct(), "links")
    if links.isEmpty():
        return labels
    count = F.count(F.lit(1)).alias("c")
    both = links.unionAll(links.select(F.col("label_b").alias("label_a"), F.col("label_a").alias("label_b")))
    edges = written(both.select(F.col("label_a").alias("u"), F.col("label_b").alias("v")).distinct(), "edges")
    hubs = _hot(edges.groupBy("v").agg(count), "v", s)
    roots = written(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")), "roots")
    while True:
        neighbour = _met(edges, roots.select(F.col("u").alias("v"), F.col("root").alias("r")), "v", "u", hubs).groupBy("u").agg(F.min("r").alias("r"))
        hooked = written(roots.join(neighbour, "u").select("u", F.least("root", "r").alias("next"), "root"), "hooked")
        jump = hooked.select(F.col("u").alias("next"), F.col("next").alias("far"))
        far = _met(hooked, jump, "next", "u", _hot(hooked.groupBy("next").agg(count), "next", s))
        moved = written(far.select("u", F.least("next", "far").alias("root"), (F.least("next", "far") != F.col("root")).alias("changed")), "roots")
        roots = moved.select("u", "root")
        if moved.where("changed").isEmpty():
            break
    common = _hot(labels.groupBy("label").agg(count), "label", s)
    renamed = _met(labels, roots.withColumnRenamed("u", "label"), "label", "node", common, "left")
    return written(renamed.select("node", F.coalesce("root", "label").alias("label")), "labels")


def _rest(members: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Links between all nodes of ``members`` (node, label): an exact join on the rarest shingles."""
    num, den = s.similarity
    known = written(members.select("node", "label").distinct(), "known")
    grams = sets.join(known, "node").select("node", "label", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    grams = written(grams, "grams")
    shared = written(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "shared")  # a shingle of one node links nothing
    hot = _hot(shared, "gram", s)
    common = _met(grams, shared, "gram", "node", hot)
    # places in the order by rarity; shingles of one node come first and are not listed
    listed = common.groupBy("node", "label", "n").agg(F.array_sort(F.collect_list(F.struct("c", "gram"))).alias("list"))
    alone = F.col("n") - F.size("list")
    prefix = F.col("n") - F.ceil(F.col("n") * num / den) + 1
    placed = listed.select("node", "label", "n", alone.alias("alone"), F.posexplode(F.slice("list", F.lit(1), F.greatest(prefix - alone, F.lit(0)).cast("int"))).alias("at", "x"))
    placed = written(placed.select(F.col("x.gram").alias("gram"), "node", "label", "n", (F.col("n") - F.col("alone") - F.col("at")).alias("left")), "placed")
    one, two = placed.alias("one"), placed.select(F.col("gram"), *[F.col(c).alias(f"{c}_b") for c in ("node", "label", "n", "left")])
    sizes = placed.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    hot = _hot(sizes, "gram", s)
    # what both have in common is at most what either has from their first common shingle on
    most = F.least("left", "left_b")
    fits = (F.col("label") != F.col("label_b")) & (F.col("node") < F.col("node_b")) & (most * (num + den) >= (F.col("n") + F.col("n_b")) * num)
    pairs = _met(one, two, "gram", "node", hot).where(fits)
    return _verified(pairs.select(F.col("node").alias("a"), F.col("node_b").alias("b"), F.col("label").alias("label_a"), F.col("label_b")).distinct(), sets, s)


def _classes(docs: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, node; classes: node, first_id, label)."""
    bound_arrow_batches(docs.sparkSession)
    with scratch():
        rows = written(_sketches(docs, s), "rows")
        nodes = written(rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("buckets").alias("buckets")), "nodes")
        placed = nodes.select("node", "n", F.explode("buckets").alias("bucket"))
        shared = written(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "buckets")
        hot = _hot(shared, "bucket", s)
        members = written(_met(_likely(placed, ["bucket"], shared.select("bucket"), s), shared.select("bucket"), "bucket", "node", hot), "members")
        wanted = written(nodes.select("node", "first_id").join(members.select("node").distinct(), "node", "left_semi"), "wanted")
        sets = written(_sets(docs, wanted, s), "sets")
        labels = written(wanted.select("node", F.col("node").alias("label")), "labels")
        for turn in range(s.rounds):
            labelled = written(members.join(labels, "node"), "labelled")
            key = F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node").alias("hub"), F.col("label").alias("label_b"), F.col("n").alias("n_b"))
            hubs = labelled.groupBy("bucket").agg(F.min(key).alias("k"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("bucket", "k.hub", "k.label_b", "k.n_b")
            round_ = written(_met(labelled, hubs, "bucket", "node", hot).where("node <> hub"), "round")  # the hub leaves; buckets of one label end
            members = round_.select("bucket", "node", "n")
            pairs = round_.where(F.col("label") != F.col("label_b")).where(_sizes_fit(s, F.col("n"), F.col("n_b")))
            pairs = pairs.select(F.col("node").alias("a"), F.col("hub").alias("b"), F.col("label").alias("label_a"), "label_b").distinct()
            labels = _merged(labels, _verified(pairs, sets, s), s)
        labelled = written(members.join(labels, "node"), "labelled")
        alive = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("bucket")
        rest = written(_met(labelled, alive, "bucket", "node", hot).select("node", "label"), "rest")
        if not rest.isEmpty():
            labels = _merged(labels, _rest(rest, sets, s), s)
        classes = nodes.select("node", "first_id").join(labels, "node", "left").select("node", "first_id", F.coalesce("label", "node").alias("label"))
        return written(rows.select("doc_id", "node"), "rows", keep=True), written(classes, "classes", keep=True)


def _representatives(classes: DataFrame) -> DataFrame:
    """label -> class_id and the node that stands for it."""
    first = F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "node")).alias("k")
    return classes.groupBy("label").agg(first).select("label", F.col("k.first_id").alias("class_id"), F.col("k.node").alias("representative"))


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id and class_id of every row."""
    rows, classes = _classes(docs, settings)
    named = classes.join(_representatives(classes), "label").select("node", "class_id")
    return rows.join(named, "node").select("doc_id", "class_id")


def deduplicated(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row of every class, with all columns."""
    rows, classes = _classes(docs, settings)
    chosen = _representatives(classes).select(F.col("representative").alias("_node"), F.col("class_id").alias("_id"))
    own = docs.select("doc_id", node_of(F.col("text")).alias("node"), whole_row(docs).alias("row"))
    kept = own.join(chosen.hint("shuffle_hash"), (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    if not rows.groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty():
        order = F.xxhash64(*[F.col("row").getField(x.name) for x in docs.schema.fields if not isinstance(x.dataType, T.MapType)])
        kept = kept.groupBy("doc_id", "node").agg(F.min_by("row", order).alias("row"))  # rows that repeat an id with its text
    return kept.select("row.*")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def _sql(s: Settings = Settings()) -> str:
    """Shingles of every text, an exact join of texts that share one, and the least doc_id that is reached over links."""
    num, den = s.similarity
    grams = " || chr(31) || ".join(f"ws[k + {k}]" for k in range(s.width))
    return f"""
    WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    nodes AS (SELECT text, min(doc_id) AS id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d GROUP BY text),
    shingles AS (SELECT id, unnest(list_distinct(CASE WHEN len(ws) >= {s.width} THEN list_transform(range(1, len(ws) - {s.width - 2}), lambda k: {grams}) WHEN len(ws) > 0 THEN ['<' || array_to_string(ws, chr(31))] ELSE [] END)) AS g FROM nodes),
    sized AS (SELECT id, g, count(*) OVER (PARTITION BY id) AS n FROM shingles),
    common AS (SELECT a.id AS u, b.id AS v, count(*) AS c, any_value(a.n) AS n, any_value(b.n) AS m FROM sized a JOIN sized b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
    links AS (SELECT u, v FROM common WHERE c * {den} >= (n + m - c) * {num}),
    both_ways AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
    reached AS (SELECT id AS u, id AS v FROM nodes UNION SELECT r.u, e.v FROM reached r JOIN both_ways e ON r.v = e.u),
    classes AS (SELECT u AS id, min(v) AS class_id FROM reached GROUP BY 1)
    SELECT d.doc_id, class_id FROM d JOIN nodes USING (text) JOIN classes USING (id)"""


OP3_SQL = _sql()
