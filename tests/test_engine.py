"""The compiler on a small library of books: three-valued logic, MISSING, order, facts, sets, aggregates, paths."""

import pytest

from skeingraph.operators.compiler import Compiler
from skeingraph.operators.paths import fan, neighbours
from skeingraph.operators.results import evidence, hydrated, joined_pages, result_entities, run, wire_rows
from skeingraph.plans.builder import Query, compare, fact_lookup, full_text, is_missing, is_null, lookup, metric_name, negate, scan, values
from skeingraph.plans.catalog import Catalog, Fact, Owner, QueryError, long_text, number, reference, text
from skeingraph.plans.normalize import MISSING
from skeingraph.plans.recipes import relation_options, scoped_union


def rows_of(schema, rows):
    return lambda spark, folder: spark.createDataFrame(rows, schema).repartition(3)


BOOKS = [
    # id, title, genre, rating, rating is missing, pages, blurb, shelf
    (16, "Violet", 7, 4.0, False, 120, "Night &amp; tide", 2),
    (11, "Harbor", 3, 4.5, False, 310, "tide tables", 6),
    (14, "Meadow", 7, None, True, 95, None, 1),
    (13, "Lantern", 7, 2.25, False, 240, "a STRASSE by night", 5),
    (12, "Quartz", 3, None, False, 505, "", 4),
    (15, "Orchard", 3, 3.75, False, 180, "eine Straße", 3),
]
LOANS = [(41, "book:13", 2.0), (42, "book:11", None), (43, "book:13", 1.0), (44, "book:90", 5.0), (45, "book:11", 3.0)]
LAUNCHES = [("fact:2", 1, "writer:22", "city:31", "book:12", "rain and speeches"), ("fact:10", 4, "writer:21", "city:32", "book:77", "no edition"), ("fact:9", 1, "writer:21", "city:31", "book:15", "sun, speeches")]
CATALOG = Catalog(
    {
        "book": Owner({"title": text("lookup"), "genre": number("integer"), "rating": number(optional=True), "pages": number("integer"), "blurb": long_text()}, rows_of("id long, title string, genre long, rating double, rating__missing boolean, pages long, blurb string, shelf long", BOOKS), rank="shelf"),
        "writer": Owner({"name": text("lookup")}, rows_of("id long, name string", [(21, "Ines"), (22, "Bram")])),
        "city": Owner({"name": text("lookup")}, rows_of("id long, name string", [(31, "Porto"), (32, "Turku")])),
        "loan": Owner({"bookRef": reference("book"), "week": number()}, rows_of("id long, bookRef string, week double", LOANS), traversable=False, order=("bookRef", "week")),
    },
    {
        "LAUNCH": Fact({"writer": "writer", "place": "city", "edition": "book"}, rows_of("ref string, multiplicity long, writer string, place string, edition string, notes string", LAUNCHES), {"notes": long_text()}),
        "SET_IN": Fact({"book": "book", "city": "city"}, rows_of("ref string, multiplicity long, book string, city string", [("fact:30", 1, "book:16", "city:31"), ("fact:31", 1, "book:11", "city:32")])),
        "WROTE": Fact({"writer": "writer", "book": "book"}, rows_of("ref string, multiplicity long, writer string, book string, form long", [("fact:40", 1, "writer:21", "book:16", 1), ("fact:41", 1, "writer:22", "book:11", 2), ("fact:42", 1, "writer:21", "book:12", 1)]), {"form": number("integer", enum="form")}),
        "SEQUEL": Fact({"before": "book", "after": "book"}, rows_of("ref string, multiplicity long, before string, after string", [("fact:50", 1, "book:12", "book:15"), ("fact:51", 1, "book:14", "book:14")])),
    },
)


def got(spark, query: Query, **values_):
    result = run(spark, "", CATALOG, query.document(), values_ or None)
    return [tuple(r) for r in result.ordered.select(*[c["name"] for c in result.columns]).collect()]


def test_sorting_places_nulls_and_missing(spark):
    listed = lambda d, n: [r[0] for r in got(spark, scan("book", "b").project(title="$b.title", rating="$b.rating").order(("rating", d, n)))]
    known = ["Harbor", "Violet", "Orchard", "Lantern"]
    assert listed("desc", "last") == [*known, "Quartz", "Meadow"]
    assert listed("asc", "last") == [*reversed(known), "Quartz", "Meadow"]
    assert listed("desc", "first") == ["Quartz", "Meadow", *known]


def test_unknown_is_neither_true_nor_false(spark):
    good = compare("gte", "$b.rating", 4)
    titles = lambda p: {r[0] for r in got(spark, scan("book", "b").filter(p).project(t="$b.title"))}
    assert titles(good) == {"Harbor", "Violet"} and titles(negate(good)) == {"Lantern", "Orchard"}
    assert titles(is_null("$b.rating")) == {"Quartz"}
    cells = values(["c"], [[None], ["z"], [MISSING]])
    assert got(spark, cells.filter(is_missing("$c"))) == [(None,)]
    assert len(got(spark, cells.filter(is_null("$c")))) == 1
    assert got(spark, cells.filter(compare("ne", "$c", None))) == []
    shown = scan("book", "b").filter(compare("eq", "$b.title", "Meadow")).project(e={"kind": "isNull", "term": {"kind": "field", "binding": "b", "field": "rating"}})
    assert got(spark, shown) == [(False,)]


def test_contains_and_strict_types(spark):
    one = values(["word", "list", "tags"], [["oak7", ["p", "q"], [{"name": "N", "count": 5}]]])
    for column, part, n in (("$word", "k7", 1), ("$list", "q", 1), ("$list", "pq", 0), ("$tags", "N", 1), ("$tags", "n", 0)):
        assert len(got(spark, one.filter(compare("contains", column, part)))) == n
    with pytest.raises(QueryError):
        got(spark, one.filter(compare("lt", "$word", 3)))


def test_aggregates(spark):
    found = got(spark, scan("book", "b").aggregate({"genre": "$b.genre"}, rows="count", rated=("count", "$b.rating"), unique=("countDistinct", "$b"), pages=("sum", "$b.pages"), low=("min", "$b.rating"), mean=("avg", "$b.rating")).order(("genre", "desc", "last")))
    assert found == [(7, 3, 2, 3, 455.0, 2.25, 3.125), (3, 3, 2, 3, 995.0, 3.75, 4.125)]
    assert got(spark, scan("book", "b").filter(compare("lt", "$b.pages", 0)).aggregate(n="count", s=("sum", "$b.pages"))) == [(0, None)]
    assert len(got(spark, scan("book", "b").aggregate({"rating": "$b.rating"}, n="count"))) == 6  # null and MISSING are groups of their own
    odd = Catalog({"item": Owner({"x": number()}, rows_of("id long, x double", [(1, 1.5), (2, float("inf")), (3, float("nan"))]))}, {})
    for fn in ("sum", "avg"):
        with pytest.raises(Exception, match="not finite"):
            run(spark, "", odd, scan("item", "i").aggregate(t=(fn, "$i.x")).document()).df.collect()


def test_metrics_without_a_name(spark):
    assert [metric_name(m) for m in ("count", ("sum", "$b.pages"), ("max", {"kind": "literal", "value": 1}))] == ["count", "sum_pages", "max"]
    result = run(spark, "", CATALOG, scan("book", "b").aggregate({}, "count", ("max", "$b.pages")).document())
    assert [c["name"] for c in result.columns] == ["count", "max_pages"] and tuple(result.df.first()) == (6, 505)


def test_groups_and_sets_are_in_order_of_their_text(spark):
    assert [r[0] for r in got(spark, values(["k"], [[30], [4], [100]]).aggregate({"k": "$k"}, n="count"))] == [100, 30, 4]
    assert [r[0] for r in got(spark, values(["k"], [["b"], ["a"]]).union(values(["k"], [["c"], ["a"]]), columns=["k"]))] == ["a", "b", "c"]


def test_sets_and_distinct(spark):
    a, b = values(["k"], [[8], [None], [8], [6]]), values(["k"], [[None], [5], [8]])
    keys = lambda q: {r[0] for r in got(spark, q)}
    assert keys(a.union(b, columns=["k"])) == {8, 6, 5, None}
    assert keys(a.intersect(b, columns=["k"])) == {8, None}
    assert keys(a.except_(b, columns=["k"])) == {6}
    with pytest.raises(Exception, match="missing"):
        got(spark, values(["k"], [[2], [MISSING]]).union(b, columns=["k"]))
    assert len(got(spark, values(["k", "h"], [[9, 1], [9, 2]]).project(("h",), k="$k", h="$h").distinct())) == 1
    repeated = values(["k"], [[7], [2], [7], [9], [2]]).distinct()
    assert [r[0] for r in got(spark, repeated)] == [7, 2, 9] and [r[0] for r in got(spark, repeated.limit(2))] == [7, 2]


def test_exists_is_null_safe(spark):
    outer, inner = values(["k"], [["u"], [None], [MISSING], ["v"]]), values(["j"], [["v"], [None], ["v"]])
    assert sorted(str(r[0]) for r in got(spark, outer.exists(inner, k="j"))) == ["None", "v"]
    assert sorted(str(r[0]) for r in got(spark, outer.exists(inner, negated=True, k="j"))) == ["None", "u"]
    assert len(got(spark, outer.exists(values(["j"], [["w"], [MISSING]]), k="j"))) == 1


def test_match_fact(spark):
    q = scan("writer", "w").match("LAUNCH", "f", writer="w", place="p", edition="e").project(f="$f", place="$p.name", e="$e", n="$f.multiplicity", title="$e.title")
    # by writer, then by fact, numbers counting up; an edition that does not exist is missing
    assert got(spark, q) == [("fact:9", "Porto", "book:15", 1, "Orchard"), ("fact:10", "Turku", None, 4, None), ("fact:2", "Porto", "book:12", 1, "Quartz")]
    both = scan("writer", "w").match("WROTE", "x", writer="w", book="b").match("LAUNCH", "f", writer="w", edition="b", place="p").project(f="$f")
    assert got(spark, both) == []
    loops = scan("book", "a").match("SEQUEL", "s", before="a", after="b").project(a="$a", b="$b")
    assert got(spark, loops) == [("book:12", "book:15"), ("book:14", "book:14")]


def test_missing_binding_is_resolved_again(spark):
    q = scan("writer", "w").match("LAUNCH", "f", writer="w", place="p", edition="b").match("WROTE", "x", writer="w", book="b").project(f="$f", b="$b")
    assert got(spark, q) == [("fact:10", "book:16"), ("fact:10", "book:12")]  # by the second fact


def test_references_both_ways_in_order(spark):
    forward = scan("loan", "l").follow("loan", "bookRef", "l", "b").project(l="$l", t="$b.title")
    scanned = [("loan:45", "Harbor"), ("loan:42", "Harbor"), ("loan:43", "Lantern"), ("loan:41", "Lantern")]  # by book, week (nulls last), id; a lost target drops its row
    assert got(spark, forward) == scanned
    back = scan("book", "b").follow("loan", "bookRef", "b", "l", "reverse").project(l="$l", t="$b.title")
    assert got(spark, back) == scanned
    assert [r[0] for r in got(spark, scan("loan", "l").project(l="$l"))] == ["loan:45", "loan:42", "loan:43", "loan:41", "loan:44"]
    # a source row that does not exist is an error, not a row less
    from dataclasses import replace

    loans = CATALOG.owners["loan"]
    calls = []

    def reader(s, folder):
        calls.append(1)
        return loans.reader(s, folder).where("id <> 43") if len(calls) > 1 else loans.reader(s, folder)

    changing = replace(CATALOG, owners=CATALOG.owners | {"loan": replace(loans, reader=reader)})
    compiler_cache = Compiler.entities
    try:
        Compiler.entities = lambda self, owner: compiler_cache(self, owner) if owner != "loan" else (self._entities.pop("loan", None), compiler_cache(self, owner))[1]
        with pytest.raises(Exception, match="there is no loan:43"):
            run(spark, "", changing, forward.document()).df.collect()
    finally:
        Compiler.entities = compiler_cache


def test_order_holds_whatever_the_partitions(spark):
    """The same order in pages, wire rows and collections, of shuffled input."""
    doc = scan("loan", "l").project(l="$l").document()
    for _ in range(5):
        result = run(spark, "", CATALOG, doc)
        wanted = ["loan:45", "loan:42", "loan:43", "loan:41", "loan:44"]
        assert [r["l"] for r in wire_rows(result)] == wanted
        assert [r["l"] for p in (result.page(0, 2), result.page(2, 2), result.page(4, 2)) for r in p["rows"]] == wanted


def test_pages_of_a_long_answer_join_to_the_whole(spark):
    many = Catalog({"item": Owner({"size": number("integer")}, lambda s, f: s.range(10_000).selectExpr("id", "id % 7 as size").repartition(5), order=("size",))}, {})
    result = run(spark, "", many, scan("item", "i").project(i="$i").document())
    pages = [result.page(k, 500) for k in range(0, 10_000, 500)]
    assert [r["i"] for r in joined_pages(pages)] == [f"item:{k}" for k in sorted(range(10_000), key=lambda k: (k % 7, k))]
    assert [p["hasMore"] for p in pages] == [True] * 19 + [False] and result.total_matches == 10_000
    assert result.page(9_990, 100)["visibleMatches"] == 10 and result.page(20_000, 5)["rows"] == []


def test_lookups_and_full_text(spark):
    assert got(spark, fact_lookup("LAUNCH", "f", "fact:10", writer="w", place="p", edition="e").project(n="$f.multiplicity", p="$p.name", e="$e")) == [(4, "Turku", None)]
    assert got(spark, fact_lookup("SET_IN", "f", "fact:10", book="b", city="c")) == []
    titles = lambda phrase: [r[0] for r in got(spark, full_text("book", "b", phrase, "blurb").project(t="$b.title"))]
    assert titles("\tTIDE ") == ["Harbor", "Violet"] and titles("night & t") == ["Violet"] and titles("strasse") == ["Lantern", "Orchard"]
    assert [r[0] for r in got(spark, lookup("book", "b", "AR").project(t="$b.title"))] == ["Orchard", "Quartz", "Harbor"]  # by shelf
    with pytest.raises(QueryError):
        got(spark, lookup("book", "b", "q"))


def test_values_entities_points_and_candidates(spark):
    q = lambda r: values(["b"], r, {"b": "entity:book"}).project(t="$b.title")
    assert got(spark, q([["book:15"], ["book:12"], ["book:15"]])) == [("Orchard",), ("Quartz",), ("Orchard",)]
    with pytest.raises(Exception, match="there is no"):
        got(spark, q([["book:4040"]]))
    compiler = Compiler(spark, "", CATALOG)
    assert compiler.get("book:13").first()["title"] == "Lantern" and compiler.get("book:99").count() == 0
    for bad in ("book:013", "shelf:1", "book"):
        with pytest.raises(QueryError):
            compiler.get(bad)
    refs = spark.createDataFrame([("book:12",), ("book:12",), ("book:99",)], "ref string")
    assert [r["title"] for r in compiler.candidates("book", refs).collect()] == ["Quartz"]


WALKS = [("LAUNCH", [("writer", "place")]), ("SET_IN", [("city", "book"), ("book", "city")]), ("WROTE", [("writer", "book")]), ("SEQUEL", [("before", "after")])]


def test_paths(spark):
    path = lambda a, b, walks=WALKS, hops=4, most=10: got(spark, values(["a", "b"], [[a, b]], {"a": f"entity:{a.split(':')[0]}", "b": f"entity:{b.split(':')[0]}"}).path("$a", "$b", "w", walks, hops, most).project(w="$w"))
    found = path("writer:21", "city:31")
    assert [(r[0]["cost"], r[0]["nodes"]) for r in found] == [(1, ["writer:21", "city:31"])]
    found = path("writer:21", "book:11")
    assert [r[0]["nodes"] for r in found] == [["writer:21", "city:32", "book:11"]]
    longer = path("writer:21", "city:31", [w for w in WALKS if w[0] != "LAUNCH"])
    assert [r[0]["nodes"] for r in longer] == [["writer:21", "book:16", "city:31"]]
    assert path("writer:22", "book:15", hops=1) == [] and path("writer:21", "book:13") == []
    parallel = [("LAUNCH", [("writer", "place"), ("writer", "edition")]), ("SET_IN", [("book", "city")]), ("WROTE", [("writer", "book")])]
    assert [r[0]["steps"][0]["fact_ref"] for r in path("writer:21", "city:31", parallel, most=1)] == ["fact:9"]
    assert path("book:12", "book:12")[0][0]["cost"] == 0
    with pytest.raises(QueryError, match="cannot end"):
        got(spark, scan("loan", "l").path("$l", "$l", "w", WALKS))


def test_evidence_entities_and_hydration(spark):
    doc = scan("book", "b").project(b="$b", title="$b.title").order(("title", "asc", "last")).document()
    result = run(spark, "", CATALOG, doc)
    pages = [result.page(0, 4), result.page(4, 4)]
    assert [r["title"] for r in joined_pages(pages)] == sorted(r[1] for r in BOOKS) and pages[0]["totalMatches"] == 6
    with pytest.raises(QueryError):
        joined_pages([pages[0], pages[1] | {"digest": "other"}])
    with pytest.raises(QueryError):
        result.page(0, 501)
    assert run(spark, "", CATALOG, scan("book", "b").limit(3).document()).page(0, 1)["totalMatches"] == 3
    first = evidence(spark, "", CATALOG, doc).orderBy("title").first()
    assert [tuple(x) for x in first["title_evidence"]] == [("entity-field", "book:11", "title")]
    compiler = Compiler(spark, "", CATALOG)
    loans = run(spark, "", CATALOG, scan("loan", "l").project(l="$l").document())
    assert {r[0] for r in result_entities(loans, compiler, {"loan": "bookRef"}).collect()} == {"book:11", "book:13", "book:90"}
    more = hydrated(result.df, "b", compiler, {"book": ["pages"]})
    assert more.where("title = 'Lantern'").first()["book_pages"] == 240


def test_neighbour_fan(spark):
    around = neighbours(Compiler(spark, "", CATALOG), ["WROTE", "SET_IN"])
    heat = spark.createDataFrame([("book:12", 1), ("book:16", 2), ("writer:21", 9)], "ref string, rank long")
    rows = [tuple(r) for r in fan(around, heat, {"WROTE": "author of"}).where("ref in ('writer:21', 'book:16')").orderBy("ref", "place").collect()]
    assert rows == [("book:16", "writer:21", "author of", "out", 0), ("book:16", "city:31", "SET_IN", "out", 1), ("writer:21", "book:12", "author of", "in", 0), ("writer:21", "book:16", "author of", "in", 1)]
    assert fan(around, heat, most=1).where("ref = 'writer:21'").count() == 1


def test_recipes(spark):
    listed = scoped_union({"writer": {"name": "name"}, "book": {"name": "title"}}, ("book", "pages", "desc"))
    assert [r[2] for r in got(spark, listed)][:6] == ["Quartz", "Harbor", "Lantern", "Orchard", "Violet", "Meadow"]
    assert ("WROTE", "writer", "book") in relation_options(CATALOG, "writer")
    split = relation_options(CATALOG, "writer", {"form": {1: "novel", 2: "essay", 3: "novel"}})
    assert ("WROTE", "writer", "book", "form", "novel", (1, 3)) in split and ("LAUNCH", "writer", "place") in split


def test_limit_zero_and_pruned_plan(spark):
    assert got(spark, scan("book", "b").limit(0)) == []
    from skeingraph.sources.commerce import CATALOG as COMMERCE

    q = scan("customer", "c").filter(compare("gt", "$c.acctbal", 9000)).project(name="$c.name", acctbal="$c.acctbal").order(("acctbal", "desc", "last")).limit(5)
    df = run(spark, "/root/testdata/sf0.001", COMMERCE, q.document()).df
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "GreaterThan(c_acctbal,9000.0)" in plan and "c_mktsegment" not in plan
    semi = scan("customer", "c").project(c="$c").exists(scan("order", "o").project(w="$o.customerRef"), c="w")
    assert "LeftSemi" in run(spark, "/root/testdata/sf0.001", COMMERCE, semi.document()).df._jdf.queryExecution().executedPlan().toString()


def test_entry_gives_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
