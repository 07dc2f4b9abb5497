"""Secret scanning with an incremental ledger of content-addressed blobs.

Every version of every path is addressed by its content's SHA-256. The ledger is a folder of Parquet files: ``scanned``
(blob, rules) says which blob was scanned under which version of the rules, ``findings`` holds what was found. A scan
takes the distinct blobs of its input, drops pairs the ledger has, scans the rest, adds them to the ledger, and joins
the findings back to every path of each blob. Against a ledger that has pairs under these rules, hashes are compared
first and only texts of unseen blobs move: ``few`` unseen blobs go to the texts, by a broadcast whose size is counted;
more of them meet the merged texts in a shuffle. A scan with nothing new moves hashes only.

A text is scanned whole. Base kinds (``assign``, ``access``, ``hex``) are leftmost, non-overlapping matches per kind,
from which too short ones are dropped. The further kinds of ``EXTRA`` add spans and change no base one. Spans are code
points, end exclusive.

Copies meet in partial aggregates first, so a blob with a third of all paths costs each task one row; the join back to
paths is an ordinary equi-join whose large side AQE may split.

Defined cases: a null text is scanned as empty; null or repeated paths keep a row each; an empty table gives an empty
result and leaves the ledger as it is; all columns are carried by ``scan_paths``, but for one that is named _spans in any
case of letters, which is replaced. No pattern's time grows with the square of a text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeingraph.llm.textbuf import others, whole_row
from skeingraph.session import bound_arrow_batches, fresh_path, written
from skeingraph.sources.tables import table

#: Kind, pattern, group, least length of that group.
BASE = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: Further kinds: well-known shapes of credentials.
EXTRA = (
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    ("prefixed", r"(?:gh[pousr]_|xox[abprs]-|sk_live_|glpat-)[A-Za-z0-9_-]+", 0, 16),
    ("userinfo", r"[a-z][a-z0-9+.-]{1,16}://[^\s:/@]{1,64}:[^\s:/@]{1,64}@", 0, 1),
)
KINDS = tuple(r[0] for r in (*BASE, *EXTRA))
RULES_VERSION = hashlib.sha256(repr((BASE, EXTRA)).encode()).hexdigest()[:16]

_assign = re.compile(BASE[0][1], re.ASCII | re.IGNORECASE)
_access = re.compile(BASE[1][1])
_hex = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so these are the long ones among all runs
_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
_extra = tuple((kind, re.compile(p), least) for kind, p, _, least in EXTRA)
_token = re.compile(r"[A-Za-z0-9_-]+")


def _jwts(text: str) -> Iterator[tuple[int, int]]:
    """What the pattern of ``jwt`` matches, leftmost and non-overlapping, in one pass over the runs of token characters: trying the pattern at every
    ``eyJ`` of one long run would read that run to its end each time."""
    runs = [(m.start(), m.end()) for m in _token.finditer(text)]
    k = 0
    while k + 2 < len(runs):
        (a, b), (c, d), (e, f) = runs[k : k + 3]
        at = text.find("eyJ", a, b - 1)
        if at >= 0 and text[b:c] == "." and text.startswith("eyJ", c) and d - c > 3 and text[d:e] == ".":
            yield at, f
            k += 3
        else:
            k += 1


#: A literal that a text must hold for a kind to be possible.
_needs = {"pem": ("PRIVATE KEY",), "jwt": (".eyJ",), "prefixed": ("_", "xox", "glpat-"), "userinfo": ("://",)}
_SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text, by start, then by kind as listed."""
    found: list[tuple[int, int, str, int]] = []
    low = text.lower()
    if any(word in low for word in _WORDS):
        found += [(m.start(), 0, "assign", m.end()) for m in _assign.finditer(text) if m.end(2) - m.start(2) >= BASE[0][3]]
    if "AKIA" in text:
        found += [(m.start(), 1, "access", m.end()) for m in _access.finditer(text) if m.end() - m.start() >= BASE[1][3]]
    found += [(m.start(), 2, "hex", m.end()) for m in _hex.finditer(text)]
    for k, (kind, pattern, least) in enumerate(_extra):
        if any(x in text for x in _needs[kind]):
            at = _jwts(text) if kind == "jwt" else (m.span() for m in pattern.finditer(text))
            found += [(a, 3 + k, kind, z) for a, z in at if z - a >= least]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        found = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(t or "")] for t in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("blob"), pa.array(found, kind)], names=["blob", "spans"])


class Ledger:
    """A folder in a store that all executors reach. ``few``: up to so many unseen blobs (some 50 bytes each) are broadcast."""

    def __init__(self, spark: SparkSession, path: str, rules: str = RULES_VERSION, few: int = 100_000):
        self.spark, self.path, self.rules, self.few = spark, path, rules, few

    def _read(self, name: str, schema: str) -> DataFrame:
        jvm, where = self.spark.sparkContext._jvm, f"{self.path}/{name}"
        there = jvm.org.apache.hadoop.fs.Path(where)
        if there.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
            return self.spark.read.schema(schema).parquet(where)
        return self.spark.createDataFrame([], schema)

    def scanned(self) -> DataFrame:
        return self._read("scanned", "blob binary, rules string").where(F.col("rules") == self.rules)

    def findings(self) -> DataFrame:
        """blob and spans, of blobs that have any."""
        return self._read("findings", "blob binary, rules string, spans array<struct<kind:string,start:int,end:int>>").where(F.col("rules") == self.rules).drop("rules")

    def add(self, blobs: DataFrame) -> None:
        """Scan those of (blob, text) that are unseen under these rules and record them. ``findings`` is written first: a pair counts as scanned
        only once its findings are there, and findings that a broken run left are the same as those of its repetition."""
        bound_arrow_batches(self.spark)
        known = self.scanned().select("blob").distinct()
        merge = lambda texts: texts.groupBy("blob").agg(F.first("text").alias("text"))  # noqa: E731  copies meet in their own task first
        if known.isEmpty():
            unseen = merge(blobs)
        else:
            new = written(blobs.select("blob").distinct().join(known, "blob", "left_anti"), "unseen")
            n = new.count()
            if not n:
                return
            unseen = merge(blobs.join(F.broadcast(new), "blob", "left_semi")) if n <= self.few else merge(blobs).join(new, "blob", "left_semi")
        results = unseen.mapInArrow(_scan, T.StructType([T.StructField("blob", T.BinaryType()), T.StructField("spans", _SPAN)]))
        batch = fresh_path(self.spark, "scan")
        results.withColumn("rules", F.lit(self.rules)).write.parquet(batch)
        results = self.spark.read.schema("blob binary, spans array<struct<kind:string,start:int,end:int>>, rules string").parquet(batch)
        results.where(F.size("spans") > 0).select("blob", "rules", "spans").write.mode("append").parquet(f"{self.path}/findings")
        results.select("blob", "rules").write.mode("append").parquet(f"{self.path}/scanned")


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def scan_paths(paths: DataFrame, ledger: Ledger, text: str = "text") -> DataFrame:
    """Adds ``_spans`` (array of kind, start, end) to every row of ``paths``, scanning only blobs that the ledger lacks."""
    ledger.add(paths.select(blob_of(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    kept = paths.select(blob_of(F.col(text)).alias("blob"), whole_row(paths).alias("row"))
    found = ledger.findings().groupBy("blob").agg(F.first("spans").alias("spans"))
    both = kept.join(found, "blob", "left")
    carried = [F.col("row").getField(x.name).alias(x.name) for x in others(paths, "_spans")]
    return both.select(*carried, F.coalesce("spans", F.array().cast(_SPAN)).alias("_spans"))


def joined(which: Column) -> Column:
    return F.array_join(F.transform(which, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(scanned: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("_spans", lambda s: s["kind"].isin(*[r[0] for r in BASE]))
    return scanned.select("doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("_spans")).alias("spans"))


def cleaned(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with every span, in order of starts, replaced by ``<kind>``; spans that overlap are replaced as one, named after the first."""
    out, at, k = [], 0, 0
    while k < len(found):
        kind, start, end = found[k]
        while k + 1 < len(found) and found[k + 1][1] < end:
            k += 1
            end = max(end, found[k][2])
        out += [text[at:start], f"<{kind}>"]
        at, k = end, k + 1
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, ledger: Ledger) -> DataFrame:
    """``docs`` with found secrets replaced in ``text``; where a row changes, ``n_chars`` (if it is a column of whole numbers) is the new length. All columns
    are carried, whatever their names; null texts stay null."""
    found = scan_paths(docs.select("text", whole_row(docs).alias("row")), ledger)
    at = docs.columns.index("text")
    number = next((k for k, x in enumerate(docs.schema.fields) if x.name == "n_chars" and isinstance(x.dataType, T.IntegralType)), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column(batch.schema.names.index("row")).flatten()
            marked = batch.column(batch.schema.names.index("_spans")).to_pylist()
            changed = [k for k, s in enumerate(marked) if s]
            if changed:
                texts = columns[at].to_pylist()
                numbers = columns[number].to_pylist() if number is not None else None
                for k in changed:
                    texts[k] = cleaned(texts[k], [(x["kind"], x["start"], x["end"]) for x in marked[k]])
                    if numbers:
                        numbers[k] = len(texts[k])
                columns[at] = pa.array(texts, columns[at].type)
                if numbers:
                    columns[number] = pa.array(numbers, columns[number].type)
            yield pa.RecordBatch.from_arrays(columns, names=docs_names)

    docs_names = docs.columns
    bound_arrow_batches(docs.sparkSession)
    return found.select("row", "_spans").mapInArrow(run, docs.schema)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first scan: the ledger is new, so every distinct text is scanned once."""
    ledger = Ledger(spark, fresh_path(spark, "ledger"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(scan_paths(docs, ledger))


def _sql() -> str:
    """Positions from the lengths of matches and of what lies between them."""
    patterns = {"assign": "(?i:" + BASE[0][1].partition(")")[0][1:] + ")" + BASE[0][1].partition(")")[2], "access": BASE[1][1], "hex": BASE[2][1]} | {k: p for k, p, _, _ in EXTRA}
    least = {k: n for k, _, _, n in (*BASE, *EXTRA)}
    quoted = {k: p.replace("'", "''") for k, p in patterns.items()}
    body = BASE[0][1].rpartition("(")[2][:-1].rstrip(")")
    parts = []
    for n, kind in enumerate(KINDS):
        p = quoted[kind]
        length = f"length(regexp_extract(m, '({body})$', 1))" if kind == "assign" else "length(m)"
        parts.append(
            f"SELECT doc_id, row, {n} AS k, '{kind}' AS kind, start, start + length(m) AS stop FROM (SELECT doc_id, row, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda i: "
            f"list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda g: length(g))), 0))) AS start "
            f"FROM (SELECT doc_id, row, regexp_extract_all(t, '{p}') AS ms, regexp_split_to_array(t, '{p}') AS gaps FROM d)) WHERE {length} >= {least[kind]}"
        )
    found = " UNION ALL ".join(parts)
    of = lambda kinds: f"coalesce(string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, k) FILTER (k < {kinds}), '')"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("assign", "access", "hex"))
    return f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS row FROM documents), s AS ({found}) SELECT d.doc_id, {counts}, sha256({of(3)}) AS base_sha256, {of(99)} AS spans FROM d LEFT JOIN s ON d.row = s.row GROUP BY d.doc_id, d.row"


OP1_SQL = _sql()
