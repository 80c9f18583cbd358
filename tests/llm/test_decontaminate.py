import random
from itertools import count, groupby

from shelfwise.llm import decontaminate
from shelfwise.llm.decontaminate import clean, contaminated, undecidable

from .conftest import frame


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def test_finds_verbatim_partial_and_reparameterised(spark):
    rng = random.Random(2)
    long, short = words(rng, 40), words(rng, 6)
    sum_ = "A farmer named Alice sells 12 kg of apples at the market for 30 dollars and then Alice gives 12 apples away to a friend"
    same = "A farmer named Robert sells 55 g of apples at the market for 71 euros and then Robert gives 55 apples away to a friend"
    broken = "A farmer named Robert sells 55 g of apples at the market for 71 euros and then Robert gives 99 apples away to a friend"
    docs = [(1, words(rng, 50) + " " + long.upper() + " " + words(rng, 50)), (2, words(rng, 30) + ". " + " ".join(long.split()[5:22]) + " " + words(rng, 9)), (3, "So " + same), (4, words(rng, 200)), (5, words(rng, 9) + " " + short + " " + words(rng, 9)), (6, " ".join(long.split()[:9]) + " " + words(rng, 60)), (None, long), (7, None), (8, ""), (1, "more text")]
    bench = spark.createDataFrame([(10, long), (11, short), (12, sum_), (13, None), (14, ""), (None, long), (15, long)], "item_id long, text string")
    out = {(r["doc_id"], r["item_id"]): r for r in contaminated(frame(spark, docs), bench).collect()}
    assert set(out) == {(1, 10), (1, 15), (2, 10), (2, 15), (3, 12), (5, 11)}
    assert out[3, 12]["longest"] >= 20 and out[1, 10]["covered"] == 40
    partly = contaminated(frame(spark, [(1, broken)]), bench).collect()
    assert not partly or partly[0]["longest"] < out[3, 12]["longest"]  # one slot with two values ends the run
    left = clean(frame(spark, docs), bench)
    assert sorted(r["doc_id"] or 0 for r in left.collect()) == [1, 4, 6, 7, 8] and left.columns == frame(spark, []).columns


def test_finds_verbatim_copies_of_any_words(spark):
    rng = random.Random(4)
    names = " ".join(words(rng, 1).capitalize() for _ in range(20))
    mixed = "First we meet Anna and Boris. Then Clara asks Doris. After that Emil calls Franz. Later Gerda helps Hans. Soon Ida thanks Jonas."
    items = [(1, "12 7 19 5"), (2, "3 14 15 92 65 35 89 79 32 38"), (3, "so " + names), (4, mixed)]
    texts = [items[0][1], items[1][1], names, mixed.lower(), mixed.replace(".", ""), names.lower()]
    docs = [(i, words(rng, 30) + " " + text + " " + words(rng, 30)) for i, text in enumerate(texts)] + [(9, "7 12 19 5 and 3 14 92 15 65 89 35")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = {(r["doc_id"], r["item_id"]) for r in contaminated(frame(spark, docs), bench).collect()}
    assert out == {(0, 1), (1, 2), (2, 3), (3, 4), (4, 4), (5, 3)}


def test_verbatim_windows_take_nothing_from_templates(spark):
    item = "a b c d e f g 1 Ann Bob Cid Dan Eva Fay Gus Hal Ian 1 h i j k l"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    (found,) = contaminated(frame(spark, [(1, item.replace("g 1", "g 2"))]), bench).collect()
    assert found["covered"] == 23


def test_odd_rows(spark, odd):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(odd, bench).count() == 0 and clean(odd, bench).count() == 12
    same = odd.where("doc_id = 6").selectExpr("doc_id as item_id", "text")
    assert [r["doc_id"] for r in contaminated(odd, same).collect()] == [6]


def test_short_items_say_too_little(spark):
    bench = spark.createDataFrame([(1, "Yes"), (2, "the"), (3, "a b c"), (4, "one two three four"), (5, None)], "item_id long, text string")
    docs = frame(spark, [(1, "Yes the a b c is here"), (2, "or one two three four")])
    assert [(r["doc_id"], r["item_id"]) for r in contaminated(docs, bench).collect()] == [(2, 4)]
    assert sorted(r["item_id"] for r in undecidable(bench).collect()) == [1, 2, 3, 5]


def test_scripts_without_spaces(spark):
    rng = random.Random(5)
    text = lambda n: "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(n))
    item = text(30)
    docs = frame(spark, [(1, text(50) + item + text(50)), (2, text(130)), (3, text(20) + item[:10] + text(20))])
    assert [r["doc_id"] for r in contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()] == [1]


def asked_again(rng, words):
    """A question with numbers, names and units, and the same with others."""
    names, units, numbers = rng.sample(["Anna", "Boris", "Clara", "Doris", "Emil", "Franz", "Gerda", "Hans"], 4), rng.sample(["kg", "km", "hours", "euros"], 4), rng.sample(range(10, 99), 6)
    body = [rng.choice(words) for _ in range(40)]
    places = sorted(rng.sample(range(1, 40, 4), 6))

    def made(name, unit, number):
        own = list(body)
        for k, at in enumerate(places):
            own[at] = name[k // 3] if k % 3 == 0 else f"{number[k]}" + (f" {unit[k // 3]}" if k % 3 == 1 else "")
        return "the " + " ".join(own)

    return made(names[:2], units[:2], numbers[:6]), made(names[2:], units[2:], [n + 100 for n in numbers])


def test_recall_of_reparameterised_items_and_both_indexes(spark, monkeypatch):
    rng = random.Random(11)
    pool = words(rng, 400).split()
    pairs = [asked_again(rng, pool) for _ in range(120)]
    bench = spark.createDataFrame(list(enumerate(a for a, _ in pairs)), "item_id long, text string")
    rows = [(i, words(rng, 60) + " " + b + " " + words(rng, 60)) for i, (_, b) in enumerate(pairs)] + [(1000 + i, " ".join(rng.choices(pool, k=200))) for i in range(60)]
    found = {tuple(r) for r in contaminated(frame(spark, rows), bench).collect()}
    hits = {(d, i) for d, i, *_ in found}
    assert sum((i, i) in hits for i in range(120)) >= 0.95 * 120 and all(d == i for d, i in hits)
    monkeypatch.setattr(decontaminate, "INDEX_WINDOWS", 0)
    assert {tuple(r) for r in contaminated(frame(spark, rows), bench).collect()} == found


def test_literal_matches_by_brute_force(spark):
    """Random lower-case texts have no slots: covered and longest follow from equal windows alone."""
    rng = random.Random(12)
    pool = words(rng, 30).split()
    item = [rng.choice(pool) for _ in range(24)]
    rows = []
    for i in range(60):
        a, n = rng.randrange(16), rng.randint(5, 20)
        rows.append((i, [rng.choice(pool) for _ in range(15)] + item[a : a + n] + [rng.choice(pool) for _ in range(15)]))
    want = {}
    for i, own in rows:
        runs = {}
        for p in range(len(own) - 7):
            for a in range(len(item) - 7):
                if own[p : p + 8] == item[a : a + 8]:
                    runs.setdefault(p - a, set()).update(range(a, a + 8))
        covered = set().union(*runs.values()) if runs else set()
        longest = max((max(len(list(g)) for _, g in groupby(sorted(x), lambda v, c=count(): v - next(c))) for x in runs.values()), default=0)
        if len(covered) >= 12 or longest >= 13:
            want[i] = (len(covered), longest)
    out = contaminated(frame(spark, [(i, " ".join(own)) for i, own in rows]), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    assert {r["doc_id"]: (r["covered"], r["longest"]) for r in out.collect()} == want and 5 < len(want) < 60


def test_rows_of_one_id_are_judged_by_themselves(spark):
    rng = random.Random(13)
    item = words(rng, 30)
    docs = frame(spark, [(9, "x " + item), (9, "clean text"), (None, item), (None, None)])
    left = clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left) == [(0, ""), (9, "clean text")]


def test_slots_of_several_words(spark):
    """Names of one word become names of two, units come and go, numbers are written as words."""
    item = "Yesterday in the evening John sells 12 kg of fresh apples at the old market for 30 euros and then with Ann he gives three baskets away to a friend of John"
    asked = [
        "Yesterday in the evening Mary Lou sells 55.5 g of fresh apples at the old market for 71 and then with Tom Ford he gives 99 baskets away to a friend of Mary Lou",
        "Yesterday in the evening Mary Lou Smith sells 55 pounds of fresh apples at the old market for two dollars and then with Bo he gives seventeen baskets away to a friend of Mary Lou Smith",
    ]
    other = "Yesterday in the evening Mary Lou sells 55 g of fresh apples at the old market for 71 euros and then with Tom Ford he gives 99 baskets away to a friend of Tom Ford"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = {r["doc_id"]: r for r in contaminated(frame(spark, [*enumerate(asked), (7, other)]), bench).collect()}
    assert out[0]["covered"] == out[1]["covered"] == 32 and out[7]["covered"] < 32
    short = spark.createDataFrame([(2, "How far does Ann run if she runs 5 km"), (3, "Ann Bob 5 km")], "item_id long, text string")
    found = contaminated(frame(spark, [(1, "So tell me how far does Tom Ford run if she runs 7.5 miles today"), (2, "Cid Dan 7 km and so on")]), short).collect()
    assert [(r["doc_id"], r["item_id"]) for r in found] == [(1, 2)]


def test_units_are_learned(spark):
    items = [(1, "She has 3 flurbs and 4 more flurbs in the red box by the door"), (2, "He sold 9 flurbs for each green hat that the two men had left behind them")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert "flurbs" in decontaminate._units(bench) and "more" not in decontaminate._units(bench)
    (found,) = contaminated(frame(spark, [(1, "He sold 12 for each green hat that the two men had left behind them")]), bench).collect()
    assert found["item_id"] == 2 and found["covered"] == 16


def tokens_of(text, units):
    """[(kind, value, unit, words)] by rules over words and marks, one at a time."""
    import re

    parts = re.findall(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+|[.!?\n]", text)
    kinds = ["mark" if p in ".!?\n" else "number" if p[0].isdigit() or p.lower() in decontaminate.COUNTED else "name" if p[0].isupper() and p[1:].islower() else "unit" if p.lower() in units else "word" for p in parts]
    out = []
    for i, (part, kind) in enumerate(zip(parts, kinds, strict=True)):
        before, behind = kinds[i - 1] if i else "mark", kinds[i + 1] if i + 1 < len(kinds) else "mark"
        if kind == "mark":
            out.append(None)
        elif kind == "unit" and before == "number":
            out[-1] = ("number", out[-1][1], part.lower(), 2)
        elif kind == "name" and (before != "mark" or behind == "name"):
            if out and out[-1] and out[-1][0] == "name":
                out[-1] = ("name", out[-1][1] + " " + part.lower(), "", out[-1][3] + 1)
            else:
                out.append(("name", part.lower(), "", 1))
        else:
            out.append(("number" if kind == "number" else "word", part.lower(), "", 1))
    return [t for t in out if t]


def brute(item, doc, units):
    """(covered, longest) of a pair by comparing all windows of words and of tokens."""
    spread = lambda toks: [w for k, v, u, _ in toks for w in (*v.split(" "), *([u] if u else []))]
    kept, longest = set(), 0
    for by_tokens in (False, True):
        a, b = tokens_of(item, units), tokens_of(doc, units)
        firsts = [sum(t[3] for t in a[:i]) for i in range(len(a) + 1)]
        if not by_tokens:
            a, b = ([("word", w, "", 1) for w in spread(x)] for x in (a, b))
            firsts = list(range(len(a) + 1))
        elif len(a) < 4:
            continue
        width = min(8, len(a))
        key = lambda t: t[1] if t[0] == "word" else t[0]
        shifts = {}
        for p in range(len(b) - width + 1):
            for q in range(len(a) - width + 1):
                slots = sum(t[0] != "word" for t in a[q : q + width])
                if [key(t) for t in a[q : q + width]] == [key(t) for t in b[p : p + width]] and [t[0] != "word" for t in a[q : q + width]] == [t[0] != "word" for t in b[p : p + width]] and width - slots >= min(4, max(1, width // 2)):
                    shifts.setdefault(p - q, set()).update(range(q, q + width))
        for shift, places in shifts.items():
            run, runs = [], []
            for at in sorted(places):
                pairs = [(i, a[x][i], b[x + shift][i]) for x in [*run, at] if a[x][0] != "word" for i in (1, 2) if a[x][i] and b[x + shift][i]]
                fits = all((x == u) == (y == v) for i, x, y in pairs for j, u, v in pairs if i == j)
                if run and (at != run[-1] + 1 or not fits):
                    runs.append(run)
                    run = []
                run.append(at)
            for one in [*runs, run]:
                words = {w for x in one for w in range(firsts[x], firsts[x + 1])}
                if len(one) >= width:
                    kept |= words
                    longest = max(longest, len(words))
    return len(kept), longest


def test_templates_slots_and_runs_by_brute_force(spark):
    rng = random.Random(31)
    pool = ["alpha", "beta", "gamma", "delta", "Ann", "Bob", "Cid", "5", "7", "19", "seven", "km", "kg", "."]

    def varied(text):
        out = []
        for w in text.split():
            r = rng.random()
            out += [] if r < 0.04 else [rng.choice(pool)] if r < 0.08 else [w, rng.choice(["Ann", "Bob", "km"])] if r < 0.12 else [{"Ann": "Dan", "Bob": "Eva Fay", "5": "6", "km": "kg"}.get(w, w) if r < 0.6 else w]
        return " ".join(out)

    items = [(i, " ".join(rng.choices(pool, k=rng.randint(4, 30)))) for i in range(25)]
    rows = [(i, " ".join(rng.choices(pool, k=10)) + " " + varied(items[i % 25][1]) + " " + " ".join(rng.choices(pool, k=10))) for i in range(150)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    units = decontaminate._units(bench)
    want = {}
    for d, doc in rows:
        for i, item in items:
            n = sum(t[3] for t in tokens_of(item, units))
            covered, longest = brute(item, doc, units)
            if n >= 4 and (covered >= 0.5 * n or longest >= 13):
                want[d, i] = (covered, longest, n)
    got = {(r["doc_id"], r["item_id"]): (r["covered"], r["longest"], r["words"]) for r in contaminated(frame(spark, rows), bench).collect()}
    assert got == want and len(want) > 30
