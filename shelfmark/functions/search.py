"""Boolean search expressions as one Column: |AND| binds before |OR|, parentheses, quoted terms, no regard to case."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""(?P<op>\|and\||\|or\|)|(?P<paren>[()])|(?P<term>(?:"[^"]*"|'[^']*'|(?!\|and\||\|or\|)[^()"'])+)|(?P<bad>.)""", re.IGNORECASE | re.DOTALL)


T = TypeVar("T")


class SearchError(ValueError):
    """The expression can't be read."""


def _tokens(expression: str) -> list[tuple[str, str]]:
    out = []
    for m in _TOKEN.finditer(expression):
        if m.lastgroup == "bad":
            raise SearchError("missing closing quote")
        if m[0].strip():
            out.append((m.lastgroup, m[0].strip()))
    return out


def _term(token: str) -> str:
    if len(token) > 1 and token[0] == token[-1] and token[0] in "\"'":
        token = token[1:-1]
    if not token.strip():
        raise SearchError("empty term")
    return token


def matches(expression: str, haystack: Column) -> Column:
    """Condition for the expression over a text column; a blank expression holds for all rows."""
    if not expression.strip():
        return F.lit(True)
    haystack = F.lower(haystack)
    return fold(expression, lambda term: haystack.contains(F.lower(F.lit(term))), Column.__and__, Column.__or__)


def fold(expression: str, leaf: Callable[[str], T], both: Callable[[T, T], T], either: Callable[[T, T], T]) -> T:
    """Value of an expression that is not blank, from what leaf gives for its terms."""
    values: list[T] = []
    waiting: list[str] = []

    def reduce_while(strength: int) -> None:
        while waiting and waiting[-1] != "(" and (2 if waiting[-1] == "&" else 1) >= strength:
            right, left = values.pop(), values.pop()
            values.append(both(left, right) if waiting.pop() == "&" else either(left, right))

    want_term = True
    for kind, token in _tokens(expression):
        if kind == "term" or token == "(":
            if not want_term:
                raise SearchError(f"operator expected before {token!r}")
            if token == "(":
                waiting.append("(")
            else:
                values.append(leaf(_term(token)))
                want_term = False
        elif want_term:
            raise SearchError(f"term expected before {token!r}")
        elif token == ")":
            reduce_while(0)
            if not waiting:
                raise SearchError("unexpected closing parenthesis")
            waiting.pop()
        else:
            op = "&" if token.lower() == "|and|" else "|"
            reduce_while(2 if op == "&" else 1)
            waiting.append(op)
            want_term = True
    if want_term:
        raise SearchError("incomplete expression")
    reduce_while(0)
    if waiting:
        raise SearchError("missing closing parenthesis")
    return values[0]
