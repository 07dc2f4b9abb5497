"""Releases: a folder of Parquet tables with a manifest of schemas, rows and fingerprints; verified on reading."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession

from skeingraph.functions.fingerprint import fingerprint
from skeingraph.plans.catalog import QueryError
from skeingraph.plans.normalize import canonical_json


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, False)
    out.write(bytearray(text.encode()))
    out.close()


def manifest_of(tables: dict[str, DataFrame]) -> dict:
    """Schema and fingerprint of each table, and the release id, which is their hash."""
    entries = {}
    for name, df in sorted(tables.items()):
        rows, total, xor = fingerprint(df).first()
        entries[name] = {"schema": df.schema.simpleString(), "rows": rows, "sum128": total, "xor128": xor}
    return {"tables": entries, "release": hashlib.sha256(canonical_json(entries).encode()).hexdigest()}


def write_release(spark: SparkSession, path: str, tables: dict[str, DataFrame], buckets: dict[str, str] | None = None) -> dict:
    """Tables first, the manifest last: a folder without a manifest is no release. ``buckets``: table -> column to cluster its files by."""
    for name, df in tables.items():
        key = (buckets or {}).get(name)
        (df.repartition(key).sortWithinPartitions(key) if key else df).write.parquet(f"{path}/{name}.parquet")
    manifest = manifest_of({n: spark.read.parquet(f"{path}/{n}.parquet") for n in tables})
    _write_text(spark, f"{path}/manifest.json", canonical_json(manifest))
    return manifest


def read_release(spark: SparkSession, path: str, verify: bool = True) -> tuple[dict[str, DataFrame], dict]:
    """Tables and manifest; with ``verify`` every table's fingerprint is computed anew."""
    manifest = json.loads("".join(r[0] for r in spark.read.text(f"{path}/manifest.json", wholetext=True).collect()))
    tables = {n: spark.read.parquet(f"{path}/{n}.parquet") for n in manifest["tables"]}
    if verify and manifest_of(tables) != manifest:
        raise QueryError("the release differs from its manifest")
    return tables, manifest
