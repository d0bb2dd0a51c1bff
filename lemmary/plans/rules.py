"""Rules as text, as a small syntax tree on the driver, and as DataFrame plans.

A body is a conjunction of triple patterns, or a tree of AND, OR and NOT over
them. Conjunctions become equi-joins on shared variables in an order that keeps
joined atoms connected; OR becomes a union over shared variables, NOT a
left-anti join.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Atom:
    s: str
    p: str
    o: str

    def __str__(self) -> str:
        return f"{self.s} {self.p} {self.o}"

    @property
    def variables(self) -> list[str]:
        return list(dict.fromkeys(t for t in (self.s, self.p, self.o) if t.startswith("?")))


@dataclass(frozen=True)
class Node:
    """AND, OR or NOT over atoms and nodes."""

    kind: str
    parts: tuple

    @property
    def variables(self) -> list[str]:
        return list(dict.fromkeys(v for p in self.parts for v in p.variables))


@dataclass(frozen=True)
class Rule:
    body: tuple[Atom, ...] | Node
    head: Atom

    @property
    def variables(self) -> list[str]:
        body = self.body if isinstance(self.body, tuple) else (self.body,)
        return list(dict.fromkeys([v for p in body for v in p.variables] + self.head.variables))


def parse_horn(text: str) -> Rule:
    """Split once at "=>"; the body is words in threes and an incomplete rest is dropped; the head is exactly three words."""
    body_text, arrow, head_text = text.partition("=>")
    if not arrow:
        raise ValueError("a rule needs '=>'")
    words, head = body_text.split(), head_text.split()
    if len(head) != 3:
        raise ValueError("a head has three words")
    body = tuple(Atom(*words[i : i + 3]) for i in range(0, len(words) - 2, 3))
    if not body:
        raise ValueError("a body has at least one atom")
    return Rule(body, Atom(*head))


_TOKEN = re.compile(r"=>|\bAND\b|\bOR\b|\bNOT\b|[()]|[QP?\w]+")


def parse_rule(text: str) -> Rule:
    """A Horn rule, or a rule whose body has AND, OR, NOT or parentheses (NOT binds before AND, AND before OR)."""
    if not any(x in text for x in (" OR ", " AND ", " NOT ", "(", ")")):
        return parse_horn(text)
    body_text, arrow, head_text = text.partition("=>")
    if not arrow:
        raise ValueError("a rule needs '=>'")
    head = head_text.split()
    if len(head) != 3:
        raise ValueError("a head has three words")
    tokens = _TOKEN.findall(body_text)
    tree, rest = _either(tokens)
    if rest:
        raise ValueError(f"left over: {' '.join(rest)}")
    return Rule(tree if isinstance(tree, Node) else (tree,), Atom(*head))


def _either(tokens: list[str]) -> tuple:
    parts, tokens = _chain(tokens, "OR", lambda t: _chain_node(t, "AND", _negated))
    return (parts[0] if len(parts) == 1 else Node("OR", tuple(parts))), tokens


def _chain_node(tokens: list[str], word: str, inner) -> tuple:
    parts, tokens = _chain(tokens, word, inner)
    return (parts[0] if len(parts) == 1 else Node(word, tuple(parts))), tokens


def _chain(tokens: list[str], word: str, inner) -> tuple[list, list[str]]:
    first, tokens = inner(tokens)
    parts = [first]
    while tokens and tokens[0] == word:
        part, tokens = inner(tokens[1:])
        parts.append(part)
    return parts, tokens


def _negated(tokens: list[str]) -> tuple:
    if not tokens:
        raise ValueError("the body ends too early")
    if tokens[0] == "NOT":
        part, rest = _negated(tokens[1:])
        return Node("NOT", (part,)), rest
    if tokens[0] == "(":
        part, rest = _either(tokens[1:])
        if not rest or rest[0] != ")":
            raise ValueError("a parenthesis is open")
        return part, rest[1:]
    if len(tokens) < 3 or any(t in ("AND", "OR", "NOT", "(", ")") for t in tokens[:3]):
        raise ValueError(f"not a triple: {' '.join(tokens[:3])}")
    return Atom(*tokens[:3]), tokens[3:]


def flatten(body: tuple[Atom, ...] | Node) -> list[Atom]:
    """Atoms of a body without OR and NOT; others raise."""
    if isinstance(body, tuple):
        return list(body)
    if body.kind != "AND":
        raise ValueError(f"{body.kind} cannot be flattened")
    return [a for p in body.parts for a in ([p] if isinstance(p, Atom) else flatten(p))]


def describe(part, statement=str) -> str:
    """A body in words: alternatives as "either ..., or ...", negation as "it is not the case that ..."."""
    if isinstance(part, Atom):
        return statement(part)
    if isinstance(part, tuple):
        return " and ".join(statement(a) for a in part)
    said = [describe(p, statement) for p in part.parts]
    if part.kind == "NOT":
        return f"it is not the case that {said[0]}"
    return f"either {', or '.join(said)}" if part.kind == "OR" else " and ".join(said)


def estimate(atom: Atom, counts: dict[str, int]) -> int:
    """Rows that a pattern may match: its predicate's, a hundredth of that for each constant end."""
    n = sum(counts.values()) if atom.p.startswith("?") else counts.get(atom.p, 0)
    for t in (atom.s, atom.o):
        if not t.startswith("?"):
            n = (n + 99) // 100
    return n


def join_order(atoms: list[Atom], counts: dict[str, int] | None) -> list[Atom]:
    """Smallest first, then always the smallest atom that shares a variable with those before it; a product only if none does."""
    left = list(atoms)
    size = (lambda a: estimate(a, counts)) if counts else (lambda a: 0)
    out: list[Atom] = []
    known: set[str] = set()
    while left:
        linked = [a for a in left if known & set(a.variables)] or left
        best = min(linked, key=lambda a: (size(a), left.index(a)))
        left.remove(best)
        out.append(best)
        known |= set(best.variables)
    return out


def _name(variable: str) -> str:
    return variable[1:]


def pattern(triples: DataFrame, atom: Atom) -> DataFrame:
    """One column for each variable of an atom; constants are filters, a repeated variable is an equality."""
    frame, first = triples, {}
    for position, term in zip(("s", "p", "o"), (atom.s, atom.p, atom.o), strict=True):
        if not term.startswith("?"):
            frame = frame.filter(F.col(position) == term)
        elif term in first:
            frame = frame.filter(F.col(position) == F.col(first[term]))
        else:
            first[term] = position
    return frame.select(*[F.col(c).alias(_name(v)) for v, c in first.items()])


def _joined(frame: DataFrame, part: DataFrame, product: bool) -> DataFrame:
    shared = [c for c in part.columns if c in frame.columns]
    if shared:
        return frame.join(part, shared)
    if not product:
        raise ValueError(f"{part.columns} share no variable with {frame.columns}; every combination would be a binding (product=True)")
    return frame.crossJoin(part)


def match(triples: DataFrame, atoms: list[Atom], counts: dict[str, int] | None = None, product: bool = False) -> DataFrame:
    """All bindings of a conjunction, a column for each variable. Two atoms may bind the same triple.

    Atoms that share no variable are refused unless ``product`` asks for all their combinations.
    """
    frame = None
    for atom in join_order(atoms, counts):
        part = pattern(triples, atom)
        frame = part if frame is None else _joined(frame, part, product)
    return frame


def evaluate(triples: DataFrame, part, counts: dict[str, int] | None = None, product: bool = False) -> DataFrame:
    """Distinct bindings of a body with OR and NOT. A negation must share its variables with the positive parts beside it; ``product`` as in match."""
    if isinstance(part, tuple):
        return match(triples, list(part), counts, product)
    if isinstance(part, Atom):
        return pattern(triples, part)
    if part.kind == "OR":
        frames = [evaluate(triples, p, counts, product) for p in part.parts]
        shared = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
        if not shared:
            raise ValueError("alternatives share no variable")
        return reduce(DataFrame.unionByName, [f.select(*shared) for f in frames]).distinct()
    if part.kind == "NOT":
        raise ValueError("a negation needs a positive part beside it")
    plain = [p for p in part.parts if isinstance(p, Atom)]
    others = [p for p in part.parts if not isinstance(p, Atom) and p.kind != "NOT"]
    frames = ([match(triples, plain, counts, product)] if plain else []) + [evaluate(triples, p, counts, product) for p in others]
    if not frames:
        raise ValueError("a negation needs a positive part beside it")
    frame = frames[0]
    for f in frames[1:]:
        frame = _joined(frame, f, product)
    for p in part.parts:
        if isinstance(p, Node) and p.kind == "NOT":
            inner = evaluate(triples, p.parts[0], counts, product)
            shared = [c for c in inner.columns if c in frame.columns]
            if not shared:
                raise ValueError("a negation shares no variable with its positive part")
            frame = frame.join(inner.select(*shared).distinct(), shared, "left_anti")
    return frame


def head_keys(rule: Rule) -> list[tuple[str, str]]:
    """(position, variable column) of the head's variables."""
    return [(c, _name(t)) for c, t in zip(("s", "p", "o"), (rule.head.s, rule.head.p, rule.head.o), strict=True) if t.startswith("?")]


def _heads(triples: DataFrame, rule: Rule) -> DataFrame:
    return pattern(triples, rule.head).distinct()


def _on_head(bindings: DataFrame, triples: DataFrame, rule: Rule, how: str) -> DataFrame:
    heads = _heads(triples, rule)
    keys = [c for c in heads.columns if c in bindings.columns]
    # A head that shares no variable holds for all bindings or for none: one row decides.
    return bindings.join(heads, keys, how) if keys else bindings.join(heads.limit(1), F.lit(True), how)


def verified(bindings: DataFrame, triples: DataFrame, rule: Rule) -> DataFrame:
    """Bindings whose head is a triple."""
    return _on_head(bindings, triples, rule, "left_semi")


def violations(bindings: DataFrame, triples: DataFrame, rule: Rule) -> DataFrame:
    """Bindings whose head is not a triple."""
    return _on_head(bindings, triples, rule, "left_anti")


def quality(triples: DataFrame, rule: Rule, counts: dict[str, int] | None = None) -> DataFrame:
    """One row: bindings of the body, of body and head, standard confidence, head coverage.

    The body is matched once; whether the head holds is a left join's flag, so
    both counts come from one aggregation.
    """
    body = evaluate(triples, rule.body, counts)
    heads = _heads(triples, rule).withColumn("_holds", F.lit(1))
    keys = [c for c in heads.columns if c in body.columns]
    flagged = body.join(heads, keys, "left")
    heads_n = pattern(triples, rule.head).agg(F.count(F.lit(1)).alias("heads"))
    covered = flagged.filter("_holds = 1").select(*keys).distinct().agg(F.count(F.lit(1)).alias("covered"))
    sums = flagged.agg(F.count(F.lit(1)).alias("body"), F.coalesce(F.sum("_holds"), F.lit(0)).alias("support"))
    return sums.crossJoin(heads_n).crossJoin(covered).select(
        "body", "support",
        F.when(F.col("body") > 0, F.col("support") / F.col("body")).alias("std_confidence"),
        F.when(F.col("heads") > 0, F.col("covered") / F.col("heads")).alias("head_coverage"),
    )


def _term(term: str) -> Column:
    return F.col(_name(term)) if term.startswith("?") else F.lit(term)


def atom_text(atom: Atom) -> Column:
    return F.concat_ws(" ", _term(atom.s), _term(atom.p), _term(atom.o))


def instances(bindings: DataFrame, rule: Rule, text: str) -> DataFrame:
    """Bindings as output rows: the rule, its instance (atoms joined by two spaces, " => ", head) and the mapping as JSON."""
    body = F.concat_ws("  ", *[atom_text(a) for a in flatten(rule.body)])
    pairs = F.struct(*[F.col(_name(v)).alias(v) for v in rule.variables if _name(v) in bindings.columns])
    return bindings.select(
        F.lit(text).alias("original_rule"),
        F.concat(body, F.lit(" => "), atom_text(rule.head)).alias("instance"),
        F.to_json(pairs).alias("instantiation_mapping"),
    )


def atoms_of(text: str | Column) -> Column:
    """Column form of the Horn body: an array of (s, p, o) from words in threes; an incomplete rest is dropped."""
    text = F.col(text) if isinstance(text, str) else text
    words = F.filter(F.split(F.trim(F.get(F.split(text, "=>", 2), F.lit(0))), r"\s+"), lambda w: w != "")
    starts = F.expr("int(0)")
    n = (F.size(words) / 3).cast("int")
    return F.when(
        n > 0,
        F.transform(
            F.sequence(starts, n - 1),
            lambda i: F.struct(F.get(words, i * 3).alias("s"), F.get(words, i * 3 + 1).alias("p"), F.get(words, i * 3 + 2).alias("o")),
        ),
    ).otherwise(F.array().cast("array<struct<s:string,p:string,o:string>>"))


def head_of(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.trim(F.get(F.split(text, "=>", 2), F.lit(1)))


def variables_of(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\?\w+)"), F.lit(1)))
