"""Sources, ingest, graph metrics, text and scalar functions on small fixtures."""

import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from skeingraph.functions import scalars as sc
from skeingraph.functions import search as se
from skeingraph.functions import text as tx
from skeingraph.functions.canonical import adjacency, canonical, hashed, incidence
from skeingraph.functions.fingerprint import fingerprint
from skeingraph.operators import graph, ingest, verify
from skeingraph.plans.catalog import QueryError
from skeingraph.session import fresh_path, scratch, shared_dir, written
from skeingraph.sources import enums
from skeingraph.sources.jsonl import SCHEMAS, read_jsonl
from skeingraph.sources.release import read_release, write_release

def works(n):
    """Three works of their own kinds and one that repeats the first one's id; the names of the fields are given by the format."""
    for k, (kind, name, place) in enumerate(((4, "Tin Rivers", 21), (6, "Salt", 7), (2, "Kites over Faro", 3))):
        yield {"id": 500 + k, "type": kind, "name": name, "name_cn": f"w{k}", "platform": place, "date": f"19{80 + k}", "score": 6.5 + k, "score_details": {str(2 + k): 5, "9": n}, "rank": 40 - k, "nsfw": k == 1, "favorite": {"done": 10 * k, "on_hold": 2}, "series": False, "tags": [{"name": "x", "count": k}, {"name": "y", "count": 3}], "meta_tags": ["p", "q"][: k + 1], "summary": "s" * k, "infobox": "{{}}"}
    yield {"id": 500, "type": 1, "name": "a later row of one id"}


PEOPLE = [{"id": 61 + k, "name": n, "type": 1 + k, "career": ["pen", "ink"][: k + 1], "comments": None, "collects": 4 * k, "summary": None, "infobox": ""} for k, n in enumerate(("Odile", "Tomas"))]
ROLES = [{"id": 81 + k, "name": n, "role": 2, "comments": 1, "collects": 0, "summary": "", "infobox": ""} for k, n in enumerate(("The Ferryman", "Wren", "Miller"))]
PARTS = [{"id": 900 + k, "name": f"part {k}", "name_cn": "", "airdate": "", "disc": 1, "duration": "9m", "sort": 2.5 - k, "type": k, "subject_id": s, "description": None} for k, s in enumerate((500, 502, 733, 500))]
SOURCES = {
    "subject": list(works(6)),
    "person": PEOPLE,
    "character": ROLES,
    "episode": PARTS,
    "subject-relations": [{"subject_id": a, "relation_type": t, "related_subject_id": b, "order": t} for a, t, b in ((500, 12, 501), (501, 13, 502), (502, 12, 640), (640, 12, 500))],
    "subject-persons": [{"person_id": p, "subject_id": w, "position": j, "appear_eps": None} for p, w, j in ((61, 500, 5), (62, 500, 6), (62, 502, 5), (99, 501, 5))],
    "subject-characters": [{"character_id": c, "subject_id": w, "type": t, "order": 1} for c, w, t in ((81, 500, 1), (82, 501, 3), (83, 501, 8))],
    "person-characters": [{"person_id": p, "subject_id": w, "character_id": c, "type": 2, "summary": None} for p, w, c in ((61, 500, 81), (62, 808, 82), (61, 500, 99))],
    "person-relations": [{"person_type": t, "person_id": a, "related_person_id": b, "relation_type": 21, "spoiler": None, "ended": True} for t, a, b in (("prsn", 61, 62), ("crt", 82, 81), ("crt", 81, 83))],
}


def sources(spark, tmp_path):
    out = {}
    for name, rows in SOURCES.items():
        (tmp_path / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n")
        out[name] = read_jsonl(spark, str(tmp_path / f"{name}.jsonl"), SCHEMAS[name])
    return out


def labels(spark, rows):
    return spark.createDataFrame(rows, "namespace string, code long, label string")


def test_ingest(spark, tmp_path):
    raw = sources(spark, tmp_path)
    platforms = labels(spark, [("4", 21, "handheld"), ("6", 8, "stage"), ("*", 7, "anywhere")])
    nodes = {"subject": ingest.subjects(raw["subject"], platforms), "person": ingest.persons(raw["person"]), "character": ingest.characters(raw["character"]), "episode": ingest.episodes(raw["episode"])}
    first, second, third = nodes["subject"].orderBy("id").collect()
    assert (first["name"], first["type_name"], first["platform"], first["score"], first["done"], first["on_hold"], first["wish"], first["summary"]) == ("Tin Rivers", "game", "handheld", 6.5, 0, 2, 0, "")
    assert first["score_details"] == [0, 5, 0, 0, 0, 0, 0, 0, 6, 0]
    assert (second["platform"], second["type_name"], second["nsfw"], third["platform"], third["type_name"]) == ("anywhere", "real", True, "", "anime")
    assert [(r["comments"], r["collects"], r["summary"]) for r in nodes["person"].orderBy("id").collect()] == [(0, 0, ""), (0, 4, "")]
    some = labels(spark, [("4", 12, "spin-off"), ("*", 13, "remake"), ("4", 5, "lyrics"), ("prsn", 21, "teacher of")])
    edges = ingest.edge_tables(raw, nodes, {"subject_relations": some, "subject_staffs": some, "person_relations": some})
    assert {n: (e.kept.count(), e.dangling.count()) for n, e in edges.items()} == {"episode_of": (3, 1), "relates_to": (2, 2), "worked_on": (3, 1), "appears_in": (3, 0), "voiced": (2, 1), "person_rel": (1, 0), "character_rel": (2, 0)}
    assert {r["subject_id"] for r in edges["voiced"].kept.collect()} == {500, 808}  # a context that does not exist is kept
    assert {(r["from_id"], r["relation"]) for r in edges["relates_to"].kept.collect()} == {(500, "spin-off"), (501, "remake")}
    assert {(r["to_id"], r["position"], r["position_cn"]) for r in edges["worked_on"].kept.collect()} == {(500, 5, "lyrics"), (500, 6, ""), (502, 5, "")}
    assert {r["role_cn"] for r in edges["appears_in"].kept.collect()} == {"main", "guest", ""}
    assert edges["person_rel"].kept.first()["relation"] == "teacher of" and edges["character_rel"].kept.first()["relation"] == ""
    assert ingest.accounting(raw["subject"], nodes["subject"], "id") == {"raw": 4, "duplicates": 1, "filtered": 0, "kept": 3}
    with pytest.raises(QueryError):
        ingest.accounting(nodes["subject"], raw["subject"])
    found = ingest.unknown_codes(raw["subject-persons"], F.lit("4"), "position", labels(spark, [("4", 6, "x")]))
    assert [(r["position"], r["n"]) for r in found.collect()] == [(5, 3)]
    assert ingest.anomalies(found, spark.createDataFrame([("4", 5, 3)], "namespace string, code long, n long")).count() == 0
    assert ingest.anomalies(found, spark.createDataFrame([("4", 5, 2)], "namespace string, code long, n long")).count() == 1
    with pytest.raises(Exception, match="out of range"):
        ingest.checked_ids(spark.createDataFrame([(1 << 24,)], "id long")).collect()


def test_unknown_source_fields_fail(spark, tmp_path):
    for name, row in (("person", {"id": 1, "extra": 1}), ("subject", {"id": 1, "favorite": {"wish": 1, "odd": 2}}), ("subject", {"id": 1, "tags": [{"name": "a", "weight": 2}]})):
        (tmp_path / "x.jsonl").write_text(json.dumps(row) + "\n")
        with pytest.raises(Exception, match="unknown source field"):
            read_jsonl(spark, str(tmp_path / "x.jsonl"), SCHEMAS[name]).collect()


def test_release_round_trip(spark):
    path = fresh_path(spark, "release")
    df = spark.createDataFrame([(1, "a"), (2, None), (1, "a")], "id long, name string")
    manifest = write_release(spark, path, {"t": df}, {"t": "id"})
    tables, again = read_release(spark, path)
    assert again == manifest and manifest["tables"]["t"]["rows"] == 3
    df.limit(1).write.mode("append").parquet(f"{path}/t.parquet")
    with pytest.raises(QueryError):
        read_release(spark, path)


def test_fingerprints(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id long, name string")
    assert fingerprint(df).first() == fingerprint(df.orderBy(F.desc("id")).repartition(3)).first()
    assert fingerprint(df).first() != fingerprint(df.unionAll(df.limit(1))).first()
    assert fingerprint(df.limit(0)).first()["rows"] == 0
    assert ingest.same_content(df, df.repartition(2)) and not ingest.same_content(df, df.limit(2))


def test_display_text_and_fold(spark):
    one = lambda f, s: spark.createDataFrame([(s,)], "s string").select(f(F.col("s")).alias("r")).first()[0]
    for s, want in (("a &amp;amp;amp; b", "a & b"), ("a &amp;amp;amp;amp; b", "a &amp; b"), ("&#65;&#x4e2d;&bogus;&#0;&#xD800;&#x110000;&Eacute;&", "A中&bogus;&#0;&#xD800;&#x110000;É&"), (None, "")):
        assert one(tx.display_text, s) == want
    for s in ("  Straße ΣΑΣ ", "ﬁǰ İx", "ABC", "\t\u3000Öl\u2028", "\x1cMaß µ\x85"):
        assert one(tx.fold, s) == s.strip().casefold()
    assert one(lambda c: tx.highlight(c, "RIVER"), "Tin Rivers, river") == "Tin <mark>River</mark>s, river"
    assert one(lambda c: tx.highlight(c, "in"), "groß in") == "groß in"


def test_match_range_snippet_and_grams(spark):
    df = spark.createDataFrame([("é" * 60 + " Needle " + "ü" * 60,), ("nothing",)], "s string")
    rows = df.select("s", tx.match_range(F.col("s"), "needle").alias("r"), tx.snippet(F.col("s"), F.col("r.start"), F.col("r.end")).alias("t")).collect()
    assert tuple(rows[0]["r"]) == (121, 127) and rows[1]["r"] is None
    assert "Needle" in rows[0]["t"] and rows[0]["t"].startswith("…é") and rows[0]["t"].endswith("ü…")

    # places behind characters that fold to several, as many as there are
    odd = ["ß" * 40 + "ﬃ plain Öl ende", "İ" * 30 + "xÖL", "ßa ÖL"]
    ranges = spark.createDataFrame([(x,) for x in odd], "s string").select("s", tx.match_range(F.col("s"), "öl").alias("r")).collect()
    for r in ranges:
        at = len(r["s"][: r["s"].lower().replace("i̇", "i").index("öl")].encode())
        assert tuple(r["r"]) == (at, at + 3)
    assert spark.createDataFrame([("aß",)], "s string").select(tx.match_range(F.col("s"), "as").alias("r")).first()["r"] is None  # ends inside one character

    def fnv(gram):
        v = 2166136261 ^ len(gram)
        for c in gram:
            v = ((v ^ ord(c)) * 16777619) & 0xFFFFFFFF
        return v & 65535

    for g in ("ab", "中文", "𝄞x"):
        assert spark.range(1).select(tx.gram_bucket(F.lit(g), 2)).first()[0] == fnv(g)


def test_search(spark):
    names = spark.createDataFrame([(1, "Alpha", "阿"), (2, "alpha beta", ""), (3, "Beta alpha", "alpha beta")], "key long, name string, cn string")
    rows = se.aliases(names, "key", ["name", "cn"]).withColumn("rank", F.col("key") - 1)
    assert [(r["key"], r["score"]) for r in se.suggestions(rows, "ALPHA").collect()] == [(1, 0), (2, 2), (3, 3)]
    index = se.postings(names, "key", F.col("name"), 2)
    found = {r["key"] for r in se.candidates(index, "Alpha b", 2).collect()}
    assert 2 in found
    assert [r["key"] for r in se.verified(names.join(se.candidates(index, "Alpha b", 2), "key", "left_semi"), "key", F.col("name"), "Alpha b").collect()] == [2]


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (5, 5), (2, 1)], "src long, dst long")
    labels_ = {r["node"]: r["component"] for r in graph.components(edges).collect()}
    assert labels_ == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8, 5: 5}
    assert graph.giant(graph.components(edges)).first()["size"] == 4
    assert {r["node"]: r["degree"] for r in graph.degree(edges).collect()}[5] == 2
    chain = spark.range(200).selectExpr("id as src", "id + 1 as dst")
    assert graph.components(chain).select("component").distinct().count() == 1
    heat = spark.createDataFrame([(k, float(k)) for k in range(10)], "node long, heat double")
    assert graph.skeleton(edges, heat, 2).count() == graph.skeleton(edges, heat, 100).count() == 4  # each edge is the best of a node
    positions = spark.createDataFrame([(k, float(k), 0.0, 0.0) for k in range(10)], "node long, x double, y double, z double")
    assert graph.compactness(edges, positions).first()[0] > 0
    ranked = {r["node"]: r["rank"] for r in graph.ranks(heat, "heat", "node").collect()}
    assert ranked == {k: 9 - k for k in range(10)}
    assert graph.communities(edges).select("node").distinct().count() == 6
    words = edges.selectExpr("concat('n', src) as src", "concat('n', dst) as dst")
    found = [{(r["node"], r["community"]) for r in graph.communities(words.repartition(k)).collect()} for k in (1, 3, 7)]
    assert found[0] == found[1] == found[2]


def test_layout_parts(spark):
    spots = spark.createDataFrame([(k, float(k % 3), float(k // 3), 0.0) for k in range(9)], "node long, x double, y double, z double")
    cells = graph.cell_ordinal(spots, 2.0, "node").collect()
    assert {(r["node"], r["ordinal"]) for r in cells if (r["cx"], r["cy"]) == (0, 0)} == {(0, 0), (1, 1), (3, 2), (4, 3)}
    wide = graph.scaled(spots).agg(F.max("x") - F.min("x"), F.max("y") + F.min("y")).first()
    assert tuple(wide) == (1200.0, 0.0) and graph.scaled(spots.limit(1)).first()["x"] == 0.0
    assert [r["node"] for r in graph.nearest(spots, (2.0, 2.0, 0.0), 1.2, 5).collect()] == [8, 5, 7]
    supers = spark.createDataFrame([(1, 2, 9), (2, 3, 1), (3, 4, 2)], "low long, high long, edges long")
    sizes = spark.createDataFrame([(1, 50), (2, 3), (3, 4), (4, 60), (5, 1)], "community long, size long")
    near = {r["community"]: (r["anchor"], r["distance"]) for r in graph.coarsened(supers, sizes, 2).collect()}
    assert near[2] == (1, pytest.approx(1 / math.log(10))) and near[3] == (4, pytest.approx(1 / math.log(3))) and near[5] == (None, None) and near[1] == (1, 0.0)
    tags = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (2, "a", 2), (3, "b", 3), (4, "c", 4), (5, "d", 5)], "id long, tag string, pos long")
    assert {r["id"]: r["bits"] for r in graph.tag_bits(tags, 3).collect()} == {1: 3, 2: 2, 3: 1, 4: 4, 5: 0}


def test_skeleton_covers_every_node_beyond_its_target(spark):
    edges = spark.createDataFrame([(a, b) for a in range(12) for b in range(12, 18)], "src long, dst long")
    heat = spark.createDataFrame([(k, float(k)) for k in range(18)], "node long, heat double")
    pairs = sorted(((a + b) / math.sqrt(6 * 12), a, b) for a in range(12) for b in range(12, 18))
    best = {max((p for p in pairs if node in p[1:]), key=lambda p: p[0])[1:] for node in range(18)}
    rest = [p[1:] for p in reversed(pairs) if p[1:] not in best]
    got = lambda target: {(r["src"], r["dst"]) for r in graph.skeleton(edges, heat, target).collect()}
    assert got(3) == got(len(best)) == best and {n for pair in best for n in pair} == set(range(18))
    more = got(len(best) + 1) - best
    assert len(more) == 1 and sum(more.pop()) == sum(rest[0])
    assert len(got(1000)) == len(pairs)


def test_facts(spark):
    rows = spark.createDataFrame([("a:1", "b:1", "x"), ("a:1", "b:1", "x"), ("a:1", None, "y"), ("a:2", "a:2", "x")], "p string, q string, t string")
    facts = canonical(rows, ["p", "q"], ["t"])
    assert sorted(r["multiplicity"] for r in facts.collect()) == [1, 1, 2] and {r["ref"] for r in facts.collect()} == {"fact:0", "fact:1", "fact:2"}
    incident = {(r["entity"], r["roles"]) for r in incidence(facts, ["p", "q"], "K").collect()}
    assert ("a:2", 3) in incident and ("b:1", 2) in incident
    many = spark.range(900).selectExpr("'h' as entity", "concat('fact:', id) as ref", "'K' as kind", "array(concat('a:', id)) as others")
    heat = spark.range(900).selectExpr("concat('a:', id) as ref", "id as rank")
    pages = {r["page"]: r["n"] for r in adjacency(many, heat).groupBy("page").agg(F.count("*").alias("n")).collect()}
    assert pages == {0: 200, 1: 500, 2: 200}


def test_fact_references_tell_nulls_apart(spark):
    rows = spark.createDataFrame([("x", None), (None, "x"), (None, None), ("x", "x")], "a string, b string")
    refs = hashed(rows, ["a", "b"], []).select("ref").distinct()
    assert refs.count() == 4 and len(refs.first()[0]) == len("fact:") + 32


def test_enums(spark, tmp_path):
    text = "# labels\nkinds:\n  4:\n    1:\n      en: river\n      cn: 'fleuve'\n    2: lake\n  6:\n    2: pond\n"
    (tmp_path / "waters.yml").write_text(text)
    revision = "0f" * 20
    write = lambda digest: (tmp_path / "manifest.json").write_text(json.dumps({"revision": revision, "files": {"waters.yml": digest}}))
    write(hashlib.sha256(text.encode()).hexdigest())
    tables, pinned = enums.read_enums(spark, str(tmp_path), ("waters",))
    assert pinned == revision and {tuple(r) for r in tables["waters"].collect()} == {("4", 1, "fleuve"), ("4", 2, "lake"), ("6", 2, "pond"), ("*", 1, "fleuve"), ("*", 2, "pond")}
    write("00" * 32)
    with pytest.raises(QueryError, match="differs"):
        enums.read_enums(spark, str(tmp_path))


def test_verification(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 6, None), (2, 9, "z")], "id long, up long, code string")
    parents = spark.createDataFrame([(5,), (6,)], "id long")
    known = spark.createDataFrame([("a", "A")], "code string, label string")
    checks = verify.report(verify.unique("u", df, "id"), verify.refers("r", df, "up", parents, "id"), verify.present("p", df, "code"), verify.holds("h", df, F.col("code") < "m"), verify.same_count("c", df, parents), verify.decoded("d", df, "code", known))
    assert {r["check"]: r["failures"] for r in checks.collect()} == {"u": 1, "r": 1, "p": 1, "h": 2, "c": 1, "d": 1}
    with pytest.raises(QueryError, match="r: 1 failures"):
        verify.require(checks)
    verify.require(verify.unique("fine", parents, "id"))
    with pytest.raises(Exception, match="is repeated"):
        verify.unique_index(df, "id", "up").collect()
    assert verify.unique_index(df.where("up <> 6"), "id", "up").count() == 2
    shared = verify.two_hops(df.selectExpr("up as who", "id as what"), F.col("who") == 5).collect()
    assert [tuple(r) for r in shared] == [(5, 6, 1)]


def test_rank_sets(spark):
    for ranks, encoding in (([3], "ranks"), ([0, 9, 31, 9], "bits"), ([], "ranks"), (list(range(32)), "bits")):
        s = spark.range(1).select(F.array(*[F.lit(k) for k in ranks]).cast("array<int>").alias("r")).select(sc.rank_set(F.col("r"), 32).alias("s"))
        row = s.select("s.encoding", "s.count", sc.rank_members(F.col("s")).alias("m")).first()
        assert (row["encoding"], row["count"], row["m"]) == (encoding, len(set(ranks)), sorted(set(ranks)))


def test_scratch_and_shared_folder(spark):
    with scratch():
        gone, kept = written(spark.range(3), "gone"), written(spark.range(4), "kept", keep=True)
        assert gone.count() == 3
    assert kept.count() == 4
    with pytest.raises(Exception):
        written(gone, "again")

    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://there:7077"})

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_dir(Elsewhere())


def test_scalars(spark):
    r = spark.range(1).select(
        sc.year(F.lit("2001")), sc.year(F.lit("20011")), sc.year(F.lit("20011"), strict=False), sc.zero_as_null(F.lit(0)), sc.size_code(F.lit(0)), sc.size_code(F.lit(10**9)), sc.score_code(F.lit(8.1)), sc.flags(F.lit(True), F.lit(None).cast("boolean"), F.lit(True)),
        sc.key_id(sc.entity_key("person", F.lit(7))), sc.key_kind(sc.entity_key("person", F.lit(7))), sc.ref_id(F.lit("a:07")), sc.ref_id(F.lit("a:70")), sc.enum_label(F.lit(0), {1: "x"}), sc.enum_label(F.lit(5), {1: "x"}), sc.array_sum(F.array(F.lit(1), F.lit(2))), sc.quantized(F.lit(1.0), F.lit(0.0), F.lit(2.0)), sc.clamped_year(F.lit(1500)),
        sc.histogram_mean(F.array(F.lit(1), F.lit(0), F.lit(1))),
    ).first()
    assert list(r) == [2001, None, 2001, None, 0, 255, 81, 5, 7, 2, None, 70, None, "unknown (5)", 3, 32768, 1900, 2.0]
    with pytest.raises(Exception, match="one decimal"):
        spark.range(1).select(sc.score_code(F.lit(8.15))).collect()
