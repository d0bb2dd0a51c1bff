import pytest

from lemmary.plans import rules
from lemmary.plans.rules import Atom, Node


@pytest.fixture(scope="module")
def triples(spark):
    rows = [("a", "p", "b"), ("b", "q", "c"), ("a", "r", "c"), ("x", "p", "x"), ("x", "q", "y"), ("d", "p", "b")]
    return spark.createDataFrame(rows, "s string, p string, o string")


def rows(frame):
    return sorted(tuple(r[c] for c in sorted(frame.columns)) for r in frame.collect())


def test_horn_parser():
    r = rules.parse_horn("?h  P2817  ?b  ?a  P361  ?h   => ?a  P2817  ?b")
    assert r.body == (Atom("?h", "P2817", "?b"), Atom("?a", "P361", "?h")) and r.head == Atom("?a", "P2817", "?b")
    assert rules.parse_horn("?a P1 ?b ?c P2 => ?a P3 ?b").body == (Atom("?a", "P1", "?b"),)  # an incomplete rest is dropped
    for bad in ("?a P1 ?b", "=> ?a P1 ?b", "?a P1 ?b => ?a P1"):
        with pytest.raises(ValueError):
            rules.parse_horn(bad)


def test_logic_parser():
    r = rules.parse_rule("?a P1 ?b OR NOT ?a P2 ?b AND (?a P3 ?b OR ?b P4 ?a) => ?a P5 ?b")
    assert r.body.kind == "OR"
    left, right = r.body.parts
    assert left == Atom("?a", "P1", "?b") and right.kind == "AND" and right.parts[0] == Node("NOT", (Atom("?a", "P2", "?b"),))
    assert rules.describe(r.body.parts[1].parts[1]) == "either ?a P3 ?b, or ?b P4 ?a"
    with pytest.raises(ValueError):
        rules.flatten(r.body)
    with pytest.raises(ValueError):
        rules.parse_rule("(?a P1 ?b => ?a P2 ?b")


def test_match(triples):
    body = list(rules.parse_horn("?a p ?b ?b q ?c => ?a r ?c").body)
    assert rows(rules.match(triples, body)) == [("a", "b", "c"), ("d", "b", "c"), ("x", "x", "y")]
    counts = {"p": 3, "q": 2, "r": 1}
    assert rows(rules.match(triples, body, counts)) == rows(rules.match(triples, body))
    rule = rules.parse_horn("?a p ?b ?b q ?c => ?a r ?c")
    found = rules.match(triples, body)
    good, bad = rules.verified(found, triples, rule), rules.violations(found, triples, rule)
    assert rows(good) == [("a", "b", "c")] and sorted(rows(good) + rows(bad)) == rows(found)


def test_repeated_variable(triples):
    assert rows(rules.match(triples, [Atom("?a", "p", "?a")])) == [("x",)]
    assert rows(rules.match(triples, [Atom("?a", "p", "b")])) == [("a",), ("d",)]


def test_negation_and_alternatives(triples):
    body = rules.parse_rule("?a p ?b AND NOT ?a r ?c => ?a r ?b").body
    assert rows(rules.evaluate(triples, body)) == [("d", "b"), ("x", "x")]
    body = rules.parse_rule("(?a p ?b OR ?a q ?b) => ?a r ?b").body
    assert rows(rules.evaluate(triples, body)) == [("a", "b"), ("b", "c"), ("d", "b"), ("x", "x"), ("x", "y")]
    with pytest.raises(ValueError):
        rules.evaluate(triples, Node("NOT", (Atom("?a", "p", "?b"),)))


def test_order_stays_connected():
    atoms = [Atom("?a", "big", "?b"), Atom("?c", "small", "?d"), Atom("?b", "mid", "?c")]
    order = rules.join_order(atoms, {"big": 100, "small": 1, "mid": 50})
    assert [a.p for a in order] == ["small", "mid", "big"]


def test_quality(triples):
    r = rules.quality(triples, rules.parse_horn("?a p ?b ?b q ?c => ?a r ?c")).first()
    assert (r.body, r.support, r.std_confidence, r.head_coverage) == (3, 1, pytest.approx(1 / 3), 1.0)


def test_atoms_without_a_common_variable(triples):
    atoms = [Atom("?a", "q", "?b"), Atom("?c", "r", "?d")]
    with pytest.raises(ValueError):
        rules.match(triples, atoms)
    assert rows(rules.match(triples, atoms, product=True)) == [("b", "c", "a", "c"), ("x", "y", "a", "c")]
    free = rules.parse_horn("?a q ?b => ?c r ?d")
    found = rules.match(triples, list(free.body))
    assert rules.verified(found, triples, free).count() == 2 and rules.violations(found, triples, free).count() == 0
