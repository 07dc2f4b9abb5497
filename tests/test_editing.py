"""Drafts, literals and columns of an editor. No Spark."""

import itertools

import pytest

from skeingraph.plans.catalog import QueryError
from skeingraph.plans.editing import Draft, default_columns, lift, parse_literal, parse_literals, selectable_columns, shared_sort_fields
from skeingraph.plans.normalize import digest, folded
from skeingraph.plans.typecheck import check
from skeingraph.sources.commerce import CATALOG

SAMPLES = {"string": "x", "number": 1.5, "integer": 3, "boolean": True, "string[]": "x", "tag[]": "x"}


def sample(kind):
    return f"{kind[7:]}:1" if kind.startswith("entity:") else SAMPLES[kind]


def test_every_field_and_operator_round_trips():
    from skeingraph.plans.catalog import OPERATOR_SETS

    for name, owner in CATALOG.owners.items():
        for f, spec in owner.fields.items():
            if not spec.operators or "filter" not in spec.capabilities:
                continue
            for op in sorted(OPERATOR_SETS[spec.operators]) + ["isNotNull"] + (["notIn"] if "in" in OPERATOR_SETS[spec.operators] else ["notContains"] if "contains" in OPERATOR_SETS[spec.operators] else []):
                value = () if op in ("isNull", "isNotNull") else ([sample(spec.type)],) if op in ("in", "notIn") else (sample(spec.type),)
                draft = Draft(name, ((f, op, *value),), ("ref",))
                document = draft.lower(CATALOG).document()
                check(folded(document), CATALOG)
                again = lift(document)
                assert digest(again.lower(CATALOG).document()) == digest(document)


def test_history():
    a = Draft("customer")
    b = a.change(limit=5)
    c = b.change(where=(("acctbal", "gt", 1),))
    assert c.undo() == b and c.undo().undo() == a and a.undo() == a
    assert c.undo().redo() == c and c.redo() == c
    assert c.undo().change(limit=9).redo().limit == 9


def test_literals():
    assert parse_literals("1, 2、3\n4", "integer") == [1, 2, 3, 4]
    assert parse_literal(" open ", "integer", {"open": 7}) == 7
    assert parse_literal("true", "boolean") is True and parse_literal("customer:3", "entity:customer") == "customer:3"
    for text, kind in itertools.product(["x", "1.5"], ["integer", "boolean", "entity:customer"]):
        with pytest.raises(QueryError):
            parse_literal(text, kind)


def test_columns():
    assert "name" in default_columns(CATALOG, ["customer", "supplier"])
    assert "text" not in selectable_columns(CATALOG, "document")
    assert shared_sort_fields(CATALOG, ["customer", "supplier"]) == ["name", "nationRef", "acctbal"]
