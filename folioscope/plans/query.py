"""Search strings as a small tree that turns into one Column predicate."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.text import LOWER, UPPER

OPERATORS = "&|!()"
LEXEMES = re.compile(r"&&|\|\||[!()]|[&|]|[^\s&|!()]+")
FOLD = str.maketrans(UPPER + "ё", LOWER[:-1] + "ее")
TOKEN = re.compile("[0-9A-Za-zЀ-ԯ]+(?:[-_][0-9A-Za-zЀ-ԯ]+)*")


@dataclass(frozen=True)
class Term:
    """A term; the empty one is in no document."""

    text: str


@dataclass(frozen=True)
class Not:
    of: Node


@dataclass(frozen=True)
class Both:
    left: Node
    right: Node


@dataclass(frozen=True)
class Either:
    left: Node
    right: Node


Node = Term | Not | Both | Either


def has_operators(query: str) -> bool:
    return any(c in OPERATORS for c in query)


def cap(term: str, most: int = 256) -> str:
    """``term`` without the characters that do not fit into ``most`` bytes."""
    kept, size = [], 0
    for c in term:
        if size + (n := len(c.encode())) <= most:
            kept.append(c)
            size += n
    return "".join(kept)


def free_terms(query: str) -> list[str]:
    """The tokens of a query without operators, each once."""
    return list(dict.fromkeys(cap(t).rstrip("-_") for t in TOKEN.findall(query.translate(FOLD))))


def lexemes(query: str) -> list[str]:
    """Operators and folded terms, up to a single & or |, which ends a query; terms of joiners alone are skipped."""
    out = []
    for x in LEXEMES.findall(query):
        if x in ("&", "|"):
            break
        if x in ("&&", "||", "!", "(", ")"):
            out.append(x)
        elif term := cap(x.translate(FOLD).strip("-_")):
            out.append(term)
    return out


def parse(query: str) -> Node:
    """The tree of a boolean query: ! binds closest, then &&, then ||, from the left.

    A missing operand is the empty term, a missing ) is as if it were there, and what follows a
    complete expression does not count.
    """
    rest = lexemes(query)[::-1]

    def operand() -> Node:
        if rest and rest[-1] == "!":
            rest.pop()
            return Not(operand())
        if rest and rest[-1] == "(":
            rest.pop()
            inner = chain("||")
            if rest and rest[-1] == ")":
                rest.pop()
            return inner
        if rest and rest[-1] not in ("&&", "||", ")"):
            return Term(rest.pop())
        return Term("")

    def chain(operator: str) -> Node:
        kind, part = (Either, lambda: chain("&&")) if operator == "||" else (Both, operand)
        node = part()
        while rest and rest[-1] == operator:
            rest.pop()
            node = kind(node, part())
        return node

    return chain("||")


def tree(query: str) -> Node:
    """The tree of any query; one without operators asks for any of its tokens."""
    if has_operators(query):
        return parse(query)
    terms = free_terms(query) or [""]
    node: Node = Term(terms[0])
    for t in terms[1:]:
        node = Either(node, Term(t))
    return node


def all_terms(node: Node) -> list[str]:
    """The distinct terms, in order."""
    if isinstance(node, Term):
        return [node.text] if node.text else []
    parts = [node.of] if isinstance(node, Not) else [node.left, node.right]
    return list(dict.fromkeys(t for p in parts for t in all_terms(p)))


def scoring_terms(node: Node, negated: bool = False) -> list[str]:
    """The distinct terms under an even number of negations."""
    if isinstance(node, Term):
        return [node.text] if node.text and not negated else []
    parts = [(node.of, not negated)] if isinstance(node, Not) else [(node.left, negated), (node.right, negated)]
    return list(dict.fromkeys(t for p, n in parts for t in scoring_terms(p, n)))


def predicate(node: Node, flag: Callable[[str], Column]) -> Column:
    """The tree as a Column over each term's flag."""
    if isinstance(node, Term):
        return flag(node.text) if node.text else F.lit(False)
    if isinstance(node, Not):
        return ~predicate(node.of, flag)
    left, right = predicate(node.left, flag), predicate(node.right, flag)
    return left & right if isinstance(node, Both) else left | right


def holds_without_terms(node: Node) -> bool:
    """Whether a document with none of the terms is a hit, so that all documents must be looked at."""
    if isinstance(node, Term):
        return False
    if isinstance(node, Not):
        return not holds_without_terms(node.of)
    left, right = holds_without_terms(node.left), holds_without_terms(node.right)
    return left and right if isinstance(node, Both) else left or right
