"""Strict JSON Lines: every field, nested ones too, must be in the declared schema, or the read fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_L, _S, _B, _D = T.LongType(), T.StringType(), T.BooleanType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


#: The fields of the nine source files.
SCHEMAS = {
    "subject": _struct(id=_L, type=_L, name=_S, name_cn=_S, platform=_L, date=_S, score=_D, score_details=T.MapType(_S, _L), rank=_L, nsfw=_B, favorite=_struct(wish=_L, done=_L, doing=_L, on_hold=_L, dropped=_L), series=_B, tags=T.ArrayType(_struct(name=_S, count=_L)), meta_tags=T.ArrayType(_S), summary=_S, infobox=_S),
    "person": _struct(id=_L, name=_S, type=_L, career=T.ArrayType(_S), comments=_L, collects=_L, summary=_S, infobox=_S),
    "character": _struct(id=_L, name=_S, role=_L, comments=_L, collects=_L, summary=_S, infobox=_S),
    "episode": _struct(id=_L, name=_S, name_cn=_S, airdate=_S, disc=_L, duration=_S, sort=_D, type=_L, subject_id=_L, description=_S),
    "subject-relations": _struct(subject_id=_L, relation_type=_L, related_subject_id=_L, order=_L),
    "subject-persons": _struct(person_id=_L, subject_id=_L, position=_L, appear_eps=_S),
    "subject-characters": _struct(character_id=_L, subject_id=_L, type=_L, order=_L),
    "person-characters": _struct(person_id=_L, subject_id=_L, character_id=_L, type=_L, summary=_S),
    "person-relations": _struct(person_type=_S, person_id=_L, related_person_id=_L, relation_type=_L, spoiler=_B, ended=_B),
}


def _has_other(keys: Column, schema: T.StructType) -> Column:
    """True where an object has a key that the schema lacks."""
    known = [f.name for f in schema.fields]
    return F.exists(F.coalesce(keys, F.array().cast("array<string>")), lambda k: ~k.isin(known))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows with ``_pos`` (order within the files); a malformed line or an unknown field is an error when the rows are used."""
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("_pos"))
    lines = lines.where(F.trim("value") != "")
    parsed = F.from_json("value", schema, {"mode": "FAILFAST"})
    bad = [_has_other(F.json_object_keys("value"), schema)]
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType):
            bad.append(_has_other(F.json_object_keys(F.get_json_object("value", f"$.{f.name}")), f.dataType))
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            inner = F.from_json(F.get_json_object("value", f"$.{f.name}"), "array<map<string,string>>")
            bad.append(_has_other(F.flatten(F.transform(inner, lambda m: F.map_keys(m))), f.dataType.elementType))
    unknown = bad[0]
    for b in bad[1:]:
        unknown = unknown | b
    row = F.when(unknown, F.raise_error(F.concat(F.lit("unknown source field: "), F.col("value"))).cast(schema)).otherwise(parsed)
    return lines.select(row.alias("r"), "_pos").select("r.*", "_pos")
