import pytest

from shelfwise.functions.query_language import SearchSyntaxError, eligible, literal, parse, pattern, ranked_terms, shown

from .tables import Tables, video


@pytest.mark.parametrize(
    ("text", "tree"),
    [
        ("newton apple && plank", "OR(newton, AND(apple, plank))"), ("!newton && apple || plank", "OR(AND(NOT(newton), apple), plank)"), ("a || b c", "OR(a, b, c)"), ("a && b && c", "AND(a, b, c)"),
        ("!!newton", "NOT(NOT(newton))"), ("(newton || plank) && apple", "AND(OR(newton, plank), apple)"), ('"eating  apple"', '"eating apple"'), ('pre"mid dle"post', '"premid dlepost"'), ("Wow!", '"Wow!"'), ("R&D", '"R&D"'),
        ("Galaxy (Tour)", "OR(Galaxy, Tour)"), ('"open', "open"), ('a "" b', "OR(a, b)"), ("a|b", '"a|b"'), ("!(a b)", "NOT(OR(a, b))"),
    ],
)
def test_trees(text, tree):
    assert shown(parse(text)) == tree


@pytest.mark.parametrize("text", ["", "   ", "&&", "a &&", "|| a", "a || || b", "!", "a && !", "(", ")", "(a", "a)", "()", "a && && b", "! && a", '""', "(a || )"])
def test_malformed(text):
    with pytest.raises(SearchSyntaxError):
        parse(text)


def test_terms():
    assert pattern("100%_\\") == r"%100\%\_\\%" and eligible("the cat") and not eligible("a cat")
    assert ranked_terms(parse("apple !(plank || !pear) ab apple")) == ["apple", "pear"]
    assert literal(" a && b ") == ("term", "a && b") and literal("  ") is None


CORPUS = [
    video(1, "Newton invented gravity while eating apple", 1, day=1), video(2, "Plank was a great scientist but he hated apple", 1, day=32),
    video(3, "Einstein was a great scientist", 1, day=60), video(4, "Bee secret apple vault project", 2, day=91),
]


@pytest.mark.parametrize(
    ("text", "ids", "ordered"),
    [
        ("apple", {1, 2}, False), ("newton apple", [1, 2], True), ("newton || apple", [1, 2], True), ("newton && apple", {1}, False), ("!plank", {1, 3}, False), ("apple && !plank", {1}, False),
        ("apple || newton && !plank", [1, 2], True), ("(newton || plank) && apple", {1, 2}, False), ('"eating apple"', {1}, False), ("APPLE Newton", [1, 2], True), ("!!newton", {1}, False), ("ap && apple", {1, 2}, False),
        ("'; DROP TABLE video; --", set(), False), ("%", set(), False), ("_", set(), False), ("ventin", set(), False), ("vent", {1}, False),
    ],
)
def test_search(spark, text, ids, ordered):
    from shelfwise.plans.search import search

    rows = search(Tables(spark, video=CORPUS), text, 1).orderBy("pos").collect()
    got = [r["id"] for r in rows]
    assert got == ids if ordered else set(got) == ids
