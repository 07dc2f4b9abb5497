"""Enum labels from pinned mapping files: namespaces of ``code: label`` lines, read only if their digests are those of a manifest."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession

from skeingraph.plans.catalog import QueryError

_NAMESPACE = re.compile(r"^(\s*)([^\s:#][^:]*):\s*$")
_LABEL = re.compile(r"^(\s*)([^\s:#][^:]*):\s+(.*?)\s*$")


def _text(spark: SparkSession, path: str) -> str:
    return "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def _plain(word: str) -> str:
    """A scalar without its quotes."""
    word = word.strip()
    return word[1:-1] if len(word) > 1 and word[0] == word[-1] and word[0] in "'\"" else word


def parsed(text: str) -> dict[str, dict[int, str]]:
    """namespace -> code -> label, of a file of two levels of mappings; a third level is read by its ``cn`` or first entry, a top level above is passed over."""
    out: dict[str, dict[int, str]] = {}
    path: list[tuple[int, str]] = []
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        head, label = _NAMESPACE.match(line), _LABEL.match(line)
        if not head and not label:
            raise QueryError(f"not a mapping line: {line!r}")
        indent = len((head or label)[1])
        path = [x for x in path if x[0] < indent]
        key = _plain((head or label)[2])
        if head:
            path.append((indent, key))
            continue
        codes = [k for k, (_, name) in enumerate(path) if name.lstrip("-").isdigit()]
        if key.lstrip("-").isdigit() and path:
            out.setdefault(path[-1][1], {})[int(key)] = _plain(label[3])
        elif codes and codes[-1] > 0:
            own = out.setdefault(path[codes[-1] - 1][1], {})
            if key == "cn" or int(path[codes[-1]][1]) not in own:
                own[int(path[codes[-1]][1])] = _plain(label[3])
    return out


def with_fallback(labels: dict[str, dict[int, str]]) -> dict[str, dict[int, str]]:
    """Adds the namespace ``*``: every code of any namespace; of several labels the last namespace's."""
    return labels | {"*": {code: label for own in labels.values() for code, label in own.items()}}


def read_enums(spark: SparkSession, folder: str, fallback: tuple[str, ...] = ()) -> tuple[dict[str, DataFrame], str]:
    """name -> (namespace, code, label) of every file that ``manifest.json`` lists with its SHA-256, and the manifest's revision. A file that differs, is missing or
    is not listed in full is an error. Files in ``fallback`` get the namespace ``*``."""
    manifest = json.loads(_text(spark, f"{folder}/manifest.json"))
    if not re.fullmatch(r"[0-9a-f]{40}", str(manifest.get("revision"))) or not isinstance(manifest.get("files"), dict):
        raise QueryError("the mapping manifest has no revision or files")
    out = {}
    for name, digest in sorted(manifest["files"].items()):
        text = _text(spark, f"{folder}/{name}")
        if hashlib.sha256(text.encode()).hexdigest() != digest:
            raise QueryError(f"{name} differs from its digest")
        key = name.rsplit(".", 1)[0]
        labels = with_fallback(parsed(text)) if key in fallback else parsed(text)
        out[key] = spark.createDataFrame([(n, c, v) for n, own in labels.items() for c, v in own.items()], "namespace string, code long, label string")
    return out, manifest["revision"]
