"""Static parts: normal form, digests, type checks, limits, coverage, recipes, bundles. No Spark."""

import pytest

from skeingraph.plans.builder import all_of, any_of, column, compare, conditions, is_missing, lookup, one_of, parameter, scan, values
from skeingraph.plans.catalog import Catalog, Fact, Field, Owner, QueryError, number, reference, text
from skeingraph.plans.coverage import coverage
from skeingraph.plans.normalize import MISSING, canonical_json, digest, folded, literal_type, ref_parts, safe_name
from skeingraph.plans.recipes import Bundle, Section, all_text, comparison, relation_options, scoped_union, shortest_path
from skeingraph.plans.typecheck import check
from skeingraph.sources.commerce import CATALOG

SMALL = Catalog({"a": Owner({"name": text("lookup"), "score": number(), "tags": Field("tag[]", "tagList"), "next": reference("a"), "flag": Field("boolean", "boolean"), "secret": Field("string", "text", frozenset({"filter"}))}, None)}, {"LINK": Fact({"x": "a", "y": "a"}, None)})


def fails(query, match=""):
    with pytest.raises(QueryError, match=match):
        check(folded(query.document()), SMALL)


def test_digest_ignores_ids_bindings_and_term_order():
    a = scan("a", "p").filter(all_of(compare("gt", "$p.score", 1), compare("eq", "$p.name", "x"))).project(n="$p.name")
    b = scan("a", "q").filter(all_of(compare("eq", "$q.name", "x"), compare("gt", "$q.score", 1.0))).project(n="$q.name")
    assert digest(a.document()) == digest(b.document())
    renamed = {"schema": "x-query-document-v1", "root": "z", "parameters": {}, "operators": {"z": a.operators[a.root] | {"input": "m"}, "m": a.operators["s1"] | {"input": "k"}, "k": a.operators["s0"], "dead": a.operators["s0"]}}
    assert digest(renamed) == digest(a.document())
    assert digest(a.limit(3).document()) != digest(a.document())


def test_digest_and_branch_order():
    p, q = scan("a", "x").project(n="$x.name"), scan("a", "x").filter(compare("gt", "$x.score", 1)).project(n="$x.name")
    assert digest(p.union(q, columns=["n"]).document()) == digest(q.union(p, columns=["n"]).document())
    assert digest(p.except_(q, columns=["n"]).document()) != digest(q.except_(p, columns=["n"]).document())


def test_parameters():
    doc = scan("a", "p").filter(compare("gt", "$p.score", parameter("low"))).document(low="number")
    assert folded(doc, {"low": 2})["operators"]["s1"]["predicate"]["right"] == {"kind": "literal", "value": 2}
    for wrong in ({}, {"low": "2"}, {"low": 2, "more": 1}):
        with pytest.raises(QueryError):
            folded(doc, wrong)
    assert digest(doc, {"low": 2}) == digest(scan("a", "p").filter(compare("gt", "$p.score", 2)).document())


def test_cycles_and_limits():
    doc = scan("a", "p").filter(compare("gt", "$p.score", 1)).document()
    doc["operators"]["s0"] = {"kind": "filter", "input": "s1", "predicate": doc["operators"]["s1"]["predicate"]}
    with pytest.raises(QueryError, match="cycle"):
        folded(doc)
    with pytest.raises(QueryError, match="limit"):
        folded(scan("a", "p").limit(-1).document())
    with pytest.raises(QueryError, match="cells"):
        folded(values(["x"], [[1]] * 10_001).document())
    with pytest.raises(QueryError):
        safe_name("__proto__")


def test_type_errors_before_data():
    fails(scan("b", "p"), "unknown owner")
    fails(scan("a", "p").filter(compare("gt", "$p.name", "x")), "not an operator")
    fails(scan("a", "p").filter(compare("contains", "$p.name", "x")), "not an operator")
    fails(scan("a", "p").filter(compare("eq", "$p.flag", 1)), "compares")
    fails(scan("a", "p").filter(is_missing("$p.score")), "not an operator")
    fails(scan("a", "p").project(s="$p.secret"), "does not allow project")
    fails(scan("a", "p").project(n="$p.name").filter(compare("gt", column("zz"), 1)), "unknown column")
    fails(scan("a", "p").aggregate(s=("sum", "$p.name")), "needs numbers")
    fails(scan("a", "p").aggregate(s=("min", "$p.flag")), "needs numbers or strings")
    fails(scan("a", "p").project(t="$p.tags").order(("t", "asc", "last")), "cannot be sorted")
    fails(scan("a", "p").match("LINK", "f", x="q", y="r"), "bound already")
    fails(scan("a", "p").filter(compare("eq", "$p.next", "b:1")), "is no a")
    fails(scan("a", "p").project(n="$p.name").union(scan("a", "p").project(n="$p.score"), columns=["n"]), "is string and number")


def test_capabilities_pass_through_projection():
    fails(scan("a", "p").filter(compare("eq", "$p.secret", "x")).project(n="$p.name").aggregate(s=("sum", "$n")), "needs numbers")
    found = check(folded(scan("a", "p").project(n="$p.name").document()), SMALL)["s1"]["n"]
    assert found.semantic == "a.name" and "aggregate" not in found.capabilities


def test_literals_and_refs():
    assert [literal_type(x) for x in (None, True, 1, 1.5, 2.0, "s", ["a"], [1], [{"name": "t"}], MISSING)] == ["null", "boolean", "integer", "number", "integer", "string", "string[]", "number[]", "tag[]", "unknown"]
    with pytest.raises(QueryError):
        literal_type(float("nan"))
    assert ref_parts("fact:10") == ("fact", 10)
    for bad in ("fact:01", "fact", "x:-1", 3):
        with pytest.raises(QueryError):
            ref_parts(bad)
    assert canonical_json({"b": 1.0, "a": [None, MISSING]}) == '{"a":[null,{"$missing":true}],"b":1}'


def test_conditions():
    assert conditions({"not": [("$p.name", "in", ["a"])]})["kind"] == "not"
    assert conditions(("$p.name", "notIn", ["a", "b"]))["term"]["kind"] == "or"
    with pytest.raises(ValueError):
        one_of("$p.name", [])
    assert any_of(compare("eq", 1, 1))["kind"] == "or"


def test_coverage():
    atoms, _ = coverage(lookup("a", "p", "xx").match("LINK", "f", x="p", y="q").project(n="$q.name", m="$f.multiplicity").order(("n", "asc", "last")).document(), SMALL)
    assert atoms == ["entity:a", "fact-field:LINK.multiplicity", "fact:LINK", "field:a.name", "lookup:a.name", "order:a.name"]


def test_recipes_and_bundles():
    CATALOG.check()
    for q in (scoped_union({"customer": {"name": "name"}, "supplier": {"name": "name", "acctbal": "acctbal"}}), comparison("SUPPLIED", "supplier", "part", "supplier:1", "supplier:2", "rightOnly"), shortest_path(CATALOG, "customer:1", "part:2", 3), *all_text(CATALOG, "phrase").values()):
        check(folded(q.document()), CATALOG)
    assert ("LINE_ITEM", "part", "order") in relation_options(CATALOG, "part")
    bundle = Bundle({"main": Section(scan("customer", "c").project(n="$c.name").document(), "Customers", "table")}, "r1")
    again = Bundle.decode(bundle.encode())
    assert again == bundle and again.check(CATALOG) == bundle.check(CATALOG)
    with pytest.raises(QueryError):
        Bundle({"main": Section({}, "", "table")}).check()
    with pytest.raises(QueryError):
        Bundle.decode("%%%")
