"""Source rows to typed tables: projections, enum labels, first-occurrence keys, foreign keys and row accounting."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeingraph.functions.fingerprint import fingerprint
from skeingraph.functions.scalars import MAX_ID, histogram
from skeingraph.plans.catalog import QueryError


def first_by_key(df: DataFrame, key: str = "id", pos: str = "_pos") -> DataFrame:
    """The first row of each key in source order; partial aggregation, so a repeated key costs a task one row."""
    names = [c for c in df.columns if c not in (key, pos)]
    return df.groupBy(key).agg(F.min_by(F.struct(*names), pos).alias("_r")).select(key, *[F.col(f"_r.{n}").alias(n) for n in names])


def _text(*names: str) -> list:
    return [F.coalesce(n, F.lit("")).alias(n) for n in names]


def _or_zero(*names: str) -> list:
    return [F.coalesce(n, F.lit(0)).alias(n) for n in names]


def _label(df: DataFrame, labels: DataFrame, namespace, code: str, name: str) -> DataFrame:
    """Left joins to a small table (namespace, code, label) of enum labels, falling back to namespace ``*``, then to empty."""
    own = labels.select(F.col("namespace").alias("_ns"), F.col("code").alias("_code"), F.col("label").alias("_own"))
    rest = labels.where("namespace = '*'").select(F.col("code").alias("_code2"), F.col("label").alias("_rest"))
    out = df.withColumn("_key", namespace).join(own, (F.col("_key") == F.col("_ns")) & (F.col(code) == F.col("_code")), "left").join(rest, F.col(code) == F.col("_code2"), "left")
    return out.withColumn(name, F.coalesce("_own", "_rest", F.lit(""))).drop("_ns", "_code", "_own", "_code2", "_rest", "_key")


#: Media types.
TYPES = {1: "book", 2: "anime", 3: "music", 4: "game", 6: "real"}


def subjects(raw: DataFrame, platforms: DataFrame) -> DataFrame:
    fav = [F.coalesce(F.col(f"favorite.{n}"), F.lit(0)).alias(n) for n in ("wish", "done", "doing", "on_hold", "dropped")]
    names = F.create_map(*[x for k, v in TYPES.items() for x in (F.lit(k), F.lit(v))])
    df = _label(first_by_key(raw), platforms, F.col("type").cast("string"), "platform", "platform_label")
    return df.select("id", "type", F.coalesce(F.try_element_at(names, F.col("type").cast("int")), F.lit("")).alias("type_name"), *_text("name", "name_cn"), F.col("platform").alias("platform_code"), F.col("platform_label").alias("platform"), *_text("date"), F.col("score").cast("double").alias("score"), "rank", F.coalesce("nsfw", F.lit(False)).alias("nsfw"), *fav, F.coalesce("series", F.lit(False)).alias("series"), histogram(F.coalesce("score_details", F.create_map().cast("map<string,bigint>"))).alias("score_details"), F.coalesce("meta_tags", F.array().cast("array<string>")).alias("meta_tags"), F.coalesce("tags", F.array().cast("array<struct<name:string,count:bigint>>")).alias("tags"), *_text("summary", "infobox"))


def persons(raw: DataFrame) -> DataFrame:
    return first_by_key(raw).select("id", *_text("name"), "type", F.coalesce("career", F.array().cast("array<string>")).alias("career"), *_or_zero("comments", "collects"), *_text("summary", "infobox"))


def characters(raw: DataFrame) -> DataFrame:
    return first_by_key(raw).select("id", *_text("name"), "role", *_or_zero("comments", "collects"), *_text("summary", "infobox"))


def episodes(raw: DataFrame) -> DataFrame:
    return first_by_key(raw).select("id", *_text("name", "name_cn", "description", "airdate"), "disc", *_text("duration"), F.col("sort").cast("double").alias("sort"), "type", "subject_id")


def checked_ids(df: DataFrame, key: str = "id") -> DataFrame:
    """Ids that do not fit a key are an error."""
    ok = F.col(key).between(0, MAX_ID - 1)
    return df.withColumn(key, F.when(ok, F.col(key)).otherwise(F.raise_error(F.lit("id out of range")).cast("long")))


@dataclass
class Edges:
    kept: DataFrame
    dangling: DataFrame  # rows with an end that does not exist


def with_ends(edges: DataFrame, ends: dict[str, DataFrame]) -> Edges:
    """Edges whose ends exist (column -> table with ``id``), and the others."""
    kept = edges
    for column, nodes in ends.items():
        kept = kept.join(nodes.select(F.col("id").alias(column)).distinct(), column, "left_semi")
    names = edges.columns
    flags = edges
    for k, (column, nodes) in enumerate(ends.items()):
        known = nodes.select(F.col("id").alias(column)).distinct().withColumn(f"_k{k}", F.lit(True))
        flags = flags.join(known, column, "left")
    lost = None
    for k in range(len(ends)):
        c = F.col(f"_k{k}").isNull()
        lost = c if lost is None else lost | c
    return Edges(kept.select(*names), flags.where(lost).select(*names))


def edge_tables(raw: dict[str, DataFrame], nodes: dict[str, DataFrame], labels: dict[str, DataFrame]) -> dict[str, Edges]:
    """The seven edge tables. ``voiced`` keeps a subject context that does not exist; episodes without a subject lose their edge only."""
    subject, person, character = nodes["subject"], nodes["person"], nodes["character"]
    kind = subject.select(F.col("id").alias("_sid"), F.col("type").cast("string").alias("_stype"))
    typed = lambda df, key: df.join(kind, df[key] == F.col("_sid"), "left").drop("_sid")
    relates = _label(typed(raw["subject-relations"], "subject_id"), labels["subject_relations"], F.col("_stype"), "relation_type", "relation")
    worked = _label(typed(raw["subject-persons"], "subject_id"), labels["subject_staffs"], F.col("_stype"), "position", "position_cn")
    roles = {1: "main", 2: "supporting", 3: "guest"}
    role = F.create_map(*[x for k, v in roles.items() for x in (F.lit(k), F.lit(v))])
    out = {
        "episode_of": with_ends(nodes["episode"].select(F.col("id").alias("from_id"), F.col("subject_id").alias("to_id")), {"to_id": subject}),
        "relates_to": with_ends(relates.select(F.col("subject_id").alias("from_id"), F.col("related_subject_id").alias("to_id"), "relation_type", "relation", F.col("order").alias("sort_order")), {"from_id": subject, "to_id": subject}),
        "worked_on": with_ends(worked.select(F.col("person_id").alias("from_id"), F.col("subject_id").alias("to_id"), "position", "position_cn", *_text("appear_eps")), {"from_id": person, "to_id": subject}),
        "appears_in": with_ends(raw["subject-characters"].select(F.col("character_id").alias("from_id"), F.col("subject_id").alias("to_id"), "type", F.coalesce(F.try_element_at(role, F.col("type").cast("int")), F.lit("")).alias("role_cn"), F.col("order").alias("sort_order")), {"from_id": character, "to_id": subject}),
        "voiced": with_ends(raw["person-characters"].select(F.col("person_id").alias("from_id"), F.col("character_id").alias("to_id"), "subject_id", "type", *_text("summary")), {"from_id": person, "to_id": character}),
    }
    for table, tag, node in (("person_rel", "prsn", person), ("character_rel", "crt", character)):
        known = F.col("person_type").isin("prsn", "crt")
        rows = raw["person-relations"].withColumn("person_type", F.when(known, F.col("person_type")).otherwise(F.raise_error(F.lit("unknown person relation type")).cast("string"))).where(F.col("person_type") == tag)
        rows = _label(rows, labels["person_relations"], F.lit(tag), "relation_type", "relation")
        out[table] = with_ends(rows.select(F.col("person_id").alias("from_id"), F.col("related_person_id").alias("to_id"), "relation_type", "relation", F.coalesce("spoiler", F.lit(False)).alias("spoiler"), F.coalesce("ended", F.lit(False)).alias("ended")), {"from_id": node, "to_id": node})
    return out


def accounting(raw: DataFrame, kept: DataFrame, key: str | None = None) -> dict[str, int]:
    """Raw rows, duplicates (of a key), filtered and kept rows; anything negative is an error."""
    total, n = raw.count(), kept.count()
    duplicates = total - raw.select(key).distinct().count() if key else 0
    out = {"raw": total, "duplicates": duplicates, "filtered": total - duplicates - n, "kept": n}
    if min(out.values()) < 0:
        raise QueryError(f"rows do not add up: {out}")
    return out


def unknown_codes(df: DataFrame, namespace, code: str, labels: DataFrame) -> DataFrame:
    """Codes outside the contract, with counts."""
    rows = df.where(F.col(code).isNotNull()).withColumn("namespace", namespace)
    known = labels.select("namespace", F.col("code").alias(code))
    return rows.join(known, ["namespace", code], "left_anti").join(labels.where("namespace = '*'").select(F.col("code").alias(code)), code, "left_anti").groupBy("namespace", code).agg(F.count(F.lit(1)).alias("n"))


def anomalies(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """Codes that occur more often than an audited baseline (namespace, code, n) allows."""
    code = [c for c in found.columns if c not in ("namespace", "n")][0]
    audited = baseline.select("namespace", F.col("code").alias(code), F.col("n").alias("allowed"))
    return found.join(audited, ["namespace", code], "left").where(F.col("n") > F.coalesce("allowed", F.lit(0)))


def label_conflicts(df: DataFrame, code: str, label: str) -> DataFrame:
    """Codes that have several labels."""
    return df.groupBy(code).agg(F.count_distinct(label).alias("labels")).where("labels > 1")


def same_content(a: DataFrame, b: DataFrame) -> bool:
    """Equal as multisets of rows, by fingerprint."""
    return a.columns == b.columns and fingerprint(a).first() == fingerprint(b).first()
