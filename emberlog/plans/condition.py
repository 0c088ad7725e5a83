"""Conditions: from text to a tree, and from a tree to any boolean algebra.

Trees are tuples: ("name", n), ("and", a, b), ("or", a, b), ("not", a), ("any", pattern | None),
("every", pattern | None), ("count", n, pattern).  Keywords are lower case only; what follows a complete
expression is ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from .ir import Rule

_TOKEN = re.compile(r"[ \t\r\n]*(?:(?P<paren>[()])|(?P<number>[0-9]+)|(?P<word>(?:[A-Za-z_]|[^\W\d_])[\w*]*)|(?P<bad>\S))")
KEYWORDS = {"and", "or", "not", "of", "them", "all"}


class ConditionError(ValueError):
    pass


def tokenize(text: str) -> list[tuple[str, str]]:
    """(kind, text): kind is a keyword, a parenthesis, "number", "pattern" (has a star) or "name"."""
    out = []
    for m in _TOKEN.finditer(text):
        if m["bad"]:
            raise ConditionError(f"unexpected character {m['bad']!r}")
        if m["paren"]:
            out.append((m["paren"], m["paren"]))
        elif m["number"]:
            out.append(("number", m["number"]))
        elif m["word"]:
            w = m["word"]
            out.append((w if w in KEYWORDS else "pattern" if "*" in w else "name", w))
    return out


def parse(text: str, names: set[str]) -> tuple:
    tokens = tokenize(text)
    if not tokens:
        raise ConditionError("empty condition")
    tree, _ = _level(tokens, 0, names, ("or", "and"))
    return tree


def _kind(tokens: list, at: int) -> str:
    return tokens[at][0] if at < len(tokens) else ""


def _level(tokens: list, at: int, names: set[str], operators: tuple[str, ...]) -> tuple[tuple, int]:
    """Left-associative chains, loosest operator first."""
    if not operators:
        return _negation(tokens, at, names)
    left, at = _level(tokens, at, names, operators[1:])
    while _kind(tokens, at) == operators[0]:
        right, at = _level(tokens, at + 1, names, operators[1:])
        left = (operators[0], left, right)
    return left, at


def _negation(tokens: list, at: int, names: set[str]) -> tuple[tuple, int]:
    if _kind(tokens, at) != "not":
        return _operand(tokens, at, names)
    inner, at = _operand(tokens, at + 1, names)
    return ("not", inner), at


def _operand(tokens: list, at: int, names: set[str]) -> tuple[tuple, int]:
    kind = _kind(tokens, at)
    if kind == "(":
        tree, at = _level(tokens, at + 1, names, ("or", "and"))
        if _kind(tokens, at) != ")":
            raise ConditionError("expected a closing parenthesis")
        return tree, at + 1
    if kind == "name":
        if tokens[at][1] not in names:
            raise ConditionError(f"unknown selection {tokens[at][1]}")
        return ("name", tokens[at][1]), at + 1
    if kind in ("number", "all"):
        if _kind(tokens, at + 1) != "of":
            raise ConditionError(f"expected 'of' after {tokens[at][1]}")
        target = _kind(tokens, at + 2)
        if target not in ("them", "pattern"):
            raise ConditionError("expected 'them' or a pattern after 'of'")
        pattern = None if target == "them" else tokens[at + 2][1]
        if kind == "all":
            return ("every", pattern), at + 3
        n = int(tokens[at][1])
        if n == 1:
            return ("any", pattern), at + 3
        if pattern is None:
            raise ConditionError("only '1 of them' is supported")
        return ("count", n, pattern), at + 3
    raise ConditionError("unexpected token")


def name_matches(name: str, pattern: str | None) -> bool:
    """A pattern without its stars has to be part of the name."""
    return pattern is None or pattern.replace("*", "") in name


def clauses(rule: Rule, name: str, merge: bool) -> list[list[int]]:
    """A selection as alternatives of primitives that must all hold."""
    groups = rule.disjunctions.get(name, [])
    own = rule.selections.get(name, [])
    if groups and not merge:
        return groups
    return [*groups, *([own] if own else [])]


def fold(tree: tuple, rule: Rule, leaf: Callable[[int], object], both: Callable, either: Callable, negate: Callable, at_least: Callable | None = None):
    """Evaluates a tree over any algebra of booleans.

    ``at_least(n, [selections])`` gives counts their standard meaning; without it a count is any primitive
    of the matching selections, whatever the number.
    """

    def selection(groups: list[list[int]]):
        return either([both([leaf(p) for p in g]) for g in groups])

    def named(pattern: str | None) -> list:
        found = [clauses(rule, n, False) for n in sorted({*rule.selections, *rule.disjunctions}) if name_matches(n, pattern)]
        found = [g for g in found if g]
        if not found:
            raise ConditionError(f"no selection matches {pattern or 'them'}")
        return [selection(g) for g in found]

    kind = tree[0]
    if kind == "name":
        groups = clauses(rule, tree[1], True)
        if not groups:
            raise ConditionError(f"empty selection {tree[1]}")
        return selection(groups)
    if kind == "not":
        return negate(fold(tree[1], rule, leaf, both, either, negate, at_least))
    if kind in ("and", "or"):
        sides = [fold(t, rule, leaf, both, either, negate, at_least) for t in tree[1:]]
        return (both if kind == "and" else either)(sides)
    if kind == "any":
        return either(named(tree[1]))
    if kind == "every":
        return both(named(tree[1]))
    if at_least is not None:
        return at_least(tree[1], named(tree[2]))
    pids = [p for n, own in sorted(rule.selections.items()) if name_matches(n, tree[2]) for p in own]
    if not pids:
        raise ConditionError(f"no selection matches {tree[2]}")
    return either([leaf(p) for p in pids])


def shape(tree: tuple, rule: Rule) -> dict[str, int]:
    """Operations, depth and distinct primitives of a rule, for choosing a strategy."""
    seen: set[int] = set()
    ops = 0

    def leaf(p: int) -> int:
        seen.add(p)
        return 1

    def join(parts: list[int]) -> int:
        nonlocal ops
        if len(parts) == 1:
            return parts[0]
        ops += 1
        return 1 + max(parts, default=0)

    def negate(x: int) -> int:
        nonlocal ops
        ops += 1
        return x + 1

    depth = fold(tree, rule, leaf, join, join, negate)
    return {"operations": ops + len(seen), "depth": depth, "primitives": len(seen)}
