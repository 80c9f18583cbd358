"""The search box's small boolean language, and its translation to column expressions.

!a, a && b, a || b, (a), "a phrase"; terms side by side are alternatives; ! binds tighter than && than ||.
A parsed query is a nested tuple: ("term", text), ("not", node), ("and", nodes...) or ("or", nodes...).
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.functions.text import trigram_similarity, trigrams

_SCAN = re.compile(r'"(?P<quoted>[^"]*)"?|(?P<op>&&|\|\||[()])|(?P<space>\s+)|(?P<char>.)', re.S)
_ASCII_NAME = re.compile(r"[A-Za-z0-9_#-]+")


class SearchSyntaxError(ValueError):
    pass


def tokens(query: str) -> list[tuple[str, str]]:
    """("op", one of ! && || ( )) and ("term", text). Nothing is an error here: what is no operator is text."""
    out: list[tuple[str, str]] = []
    word: list[str] | None = None

    def close() -> None:
        nonlocal word
        if word is not None and (text := " ".join("".join(word).split())):
            out.append(("term", text))
        word = None

    for found in _SCAN.finditer(query):
        kind, text = found.lastgroup, found[found.lastgroup]
        if kind == "char" and text == "!" and word is None:
            out.append(("op", "!"))
        elif kind in ("char", "quoted"):
            word = [*(word or []), text]
        else:
            close()
            if kind == "op":
                out.append(("op", text))
    close()
    return out


def parse(query: str) -> tuple:
    left = tokens(query)[::-1]
    if not left:
        raise SearchSyntaxError("empty query")

    def flat(kind: str, nodes: list[tuple]) -> tuple:
        if len(nodes) == 1:
            return nodes[0]
        return (kind, *(inner for node in nodes for inner in (node[1:] if node[0] == kind else (node,))))

    def alternatives() -> tuple:
        nodes = [joint()]
        while left and left[-1] not in (("op", ")"), ("op", "&&")):
            if left[-1] == ("op", "||"):
                left.pop()
            nodes.append(joint())
        return flat("or", nodes)

    def joint() -> tuple:
        nodes = [single()]
        while left and left[-1] == ("op", "&&"):
            left.pop()
            nodes.append(single())
        return flat("and", nodes)

    def single() -> tuple:
        if not left:
            raise SearchSyntaxError("a term is missing at the end")
        kind, text = left.pop()
        if kind == "term":
            return ("term", text)
        if text == "!":
            return ("not", single())
        if text != "(":
            raise SearchSyntaxError(f"a term is missing before {text}")
        inner = alternatives()
        if not left or left.pop() != ("op", ")"):
            raise SearchSyntaxError("a closing bracket is missing")
        return inner

    node = alternatives()
    if left:
        raise SearchSyntaxError(f"unexpected {left[-1][1]}")
    return node


def literal(text: str) -> tuple | None:
    """All of the text as one term; None for blank text."""
    return ("term", tidy) if (tidy := " ".join(text.split())) else None


def shown(node: tuple) -> str:
    if node[0] == "term":
        return node[1] if _ASCII_NAME.fullmatch(node[1]) else json.dumps(node[1], ensure_ascii=False)
    return f"{node[0].upper()}({', '.join(map(shown, node[1:]))})"


def eligible(term: str) -> bool:
    """Whether all words have three characters, so that the term is looked up in the joined text and counts for the rank."""
    return all(len(word) >= 3 for word in term.split())


def pattern(term: str) -> str:
    """LIKE pattern of a literal substring."""
    return "%" + re.sub(r"([\\%_])", r"\\\1", term) + "%"


def predicate(node: tuple) -> Column:
    """Over title, filename, creator and alltext, which are never null."""
    if node[0] == "not":
        return ~predicate(node[1])
    if node[0] == "term":
        fields = ("alltext",) if eligible(node[1]) else ("title", "filename", "creator")
        return reduce(Column.__or__, [F.col(f).ilike(pattern(node[1])) for f in fields])
    return reduce(Column.__and__ if node[0] == "and" else Column.__or__, map(predicate, node[1:]))


def ranked_terms(node: tuple, wanted: bool = True) -> list[str]:
    """Eligible terms that are not negated, each once."""
    if node[0] == "term":
        return [node[1]] if wanted and eligible(node[1]) else []
    found = [t for child in node[1:] for t in ranked_terms(child, wanted != (node[0] == "not"))]
    return list(dict.fromkeys(found))


#: What a whole-word match is worth in each field, and a similarity.
WEIGHTS = {"title": 1.0, "filename": 0.4, "creator": 0.2}
SIMILARITY = {"title": 2.0, "filename": 1.0, "creator": 1.0}


def score(terms: list[Column]) -> Column:
    """Smaller is better: whole-word matches by field, over 1 + ln of the words in all fields, plus half the weighted trigram similarity to the nearest term."""
    spaced = lambda c: F.concat(F.lit(" "), F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    words = [reduce(Column.__add__, [F.when(F.contains(spaced(F.col(f)), spaced(t)), w).otherwise(0.0) for f, w in WEIGHTS.items()]) for t in terms]
    length = F.size(F.filter(F.split(spaced(F.col("alltext")), " "), lambda w: w != ""))
    near = []
    for field, weight in SIMILARITY.items():
        each = [trigram_similarity(trigrams(F.col(field)), trigrams(t)) for t in terms]
        near.append(F.lit(weight) * (F.greatest(*each) if len(each) > 1 else each[0]))
    return F.round(-(reduce(Column.__add__, words) / (1 + F.log(length)) + 0.5 * reduce(Column.__add__, near)), 6)


def rank(node: tuple) -> Column | None:
    """The score of the terms that count; null where none matches; None if there is no such term. A formula of our own with the weights that users see in the order."""
    terms = ranked_terms(node)
    if not terms:
        return None
    return F.when(reduce(Column.__or__, [F.col("alltext").ilike(pattern(t)) for t in terms]), score([F.lit(t) for t in terms]))
