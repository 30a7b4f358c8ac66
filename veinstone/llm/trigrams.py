"""Boolean trigram queries of regular expressions: what a text must contain, in lower case, to match.

A query is a set of alternatives, each a set of trigrams that must all occur; ``ANY`` holds the empty alternative and
says nothing. Queries may be too weak but never too strong.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as op
from re import _parser

Query = frozenset[frozenset[str]]
ANY: Query = frozenset({frozenset()})
#: Most strings of an exact set, most letters of a class that are spelled out, and most alternatives of a query.
MAX_STRINGS, MAX_CLASS, MAX_TERMS = 64, 8, 64


@dataclass(frozen=True)
class Found:
    """Of a part of a pattern: all strings that it matches (None if they are too many), and what every match contains."""

    exact: frozenset[str] | None
    query: Query = ANY


EMPTY = Found(frozenset({""}))


def least(terms: set[frozenset[str]] | Query) -> Query:
    """Without alternatives that another one implies."""
    return frozenset(t for t in terms if not any(u < t for u in terms))


def both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > MAX_TERMS:
        return a if b == ANY or (a != ANY and len(a) <= len(b)) else b
    return least({x | y for x, y in product(a, b)})


def of_strings(strings: frozenset[str]) -> Query:
    return least({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def forget(f: Found) -> Found:
    """Only the query, to which the strings are turned."""
    return f if f.exact is None else Found(None, both(f.query, of_strings(f.exact)))


def _letters(items) -> frozenset[str] | None:
    out: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            out.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < 2 * MAX_CLASS:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return frozenset(out) if len(out) <= MAX_CLASS else None


def _sequence(nodes) -> Found:
    query, run, whole = ANY, EMPTY, True
    for node in nodes:
        part = _node(node)
        joined = None
        if part.exact is not None and run.exact is not None and len(part.exact) * len(run.exact) <= MAX_STRINGS:
            joined = frozenset(a + b for a, b in product(run.exact, part.exact))
        if joined is not None:
            run = Found(joined, both(run.query, part.query))
            continue
        whole = False
        query = both(query, forget(run).query)
        run = part if part.exact is not None else EMPTY
        query = both(query, part.query)
    run = Found(run.exact, both(query, run.query))
    return run if whole else forget(run)


def _node(node) -> Found:
    kind, value = node
    if kind is op.LITERAL:
        return Found(frozenset({chr(value).lower()}))
    if kind is op.IN:
        return Found(_letters(value))
    if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
        return EMPTY
    if kind is op.SUBPATTERN:
        return _sequence(value[-1])
    if kind is op.BRANCH:
        parts = [_sequence(p) for p in value[1]]
        if all(p.exact is not None for p in parts) and len(strings := frozenset().union(*(p.exact for p in parts))) <= MAX_STRINGS:
            return Found(strings)
        terms = frozenset().union(*(forget(p).query for p in parts))
        return Found(None, ANY if len(terms) > MAX_TERMS else least(terms))
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        low, high, body = value
        inner = _sequence(body)
        if (low, high) == (0, 1) and inner.exact is not None:
            return Found(inner.exact | {""})
        if low == 0:
            return Found(None)
        if inner.exact is not None and low == high and len(inner.exact) ** low <= MAX_STRINGS:
            return Found(frozenset("".join(p) for p in product(inner.exact, repeat=low)))
        return Found(None, forget(inner).query)
    return Found(None)  # any character, back references and the like


def trigram_query(pattern: str) -> Query:
    """The query of a pattern; ``ANY`` where no trigram is mandatory."""
    return forget(_sequence(_parser.parse(pattern))).query
