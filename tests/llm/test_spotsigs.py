import hashlib
import random

import regex

from shelfwise.llm import spotsigs

from .conftest import frame


def text(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "is"]) if rng.random() < 0.4 else "".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def test_edited_texts_and_likeness(spark):
    rng = random.Random(4)
    rows = [(i * 3, text(rng, rng.randint(1, 200))) for i in range(60)] + [(1000, "no anchors here at all 漢字 🙂"), (1001, ""), (1002, None)]
    out = {r["doc_id"]: r for r in spotsigs.compare_edited(frame(spark, rows).repartition(5)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for (doc, own), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        own, nxt = own or "", nxt or ""
        n = len(own)
        assert out[doc]["edited_sha256"] == hashlib.sha256((own[: n - n // 3] + nxt[: n // 3]).encode()).hexdigest()
        assert 0 <= out[doc]["near_next"] <= 1 and out[doc]["n_chars"] == n
    assert out[1001]["fingerprint"] == out[1002]["fingerprint"] and out[1001]["near_next"] < 1


def test_signatures_by_brute_force(spark):
    out = spotsigs.with_spots(frame(spark, [(1, "The cat sat. Of dogs, the big red fox ran"), (2, "cat THE cat sat -- of dogs the big red fox ran")]), "text", "spots").collect()
    assert len(out[0]["spots"]) == 3  # cat sat dogs, dogs big red, big red fox
    assert set(out[0]["spots"]) == set(out[1]["spots"])


def test_near_duplicates(spark):
    rng = random.Random(9)
    base = text(rng, 400)
    rows = [(1, base), (2, base + " the last word here"), (3, base), (4, text(rng, 400)), (5, base.replace(base[300:340], ""))]
    found = {(r["a"], r["b"]) for r in spotsigs.near_duplicates(frame(spark, rows)).collect()}
    assert found == {(1, 2), (1, 5), (2, 5)}


def test_odd_rows(spark, odd):
    out = spotsigs.compare_edited(odd).collect()
    assert sorted((r["doc_id"] for r in out), key=lambda i: (i is None, i)) == [1, 2, 3, 4, 5, 6, 7, 8, 9, 9, None, None]
    rows = sorted(odd.collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0), hashlib.md5((r.text or "").encode()).hexdigest()))
    want = []
    for own, nxt in zip(rows, [*rows[1:], rows[0]], strict=True):
        text, then = own.text or "", nxt.text or ""
        want.append((own.doc_id, hashlib.sha256((text[: len(text) - len(text) // 3] + then[: len(text) // 3]).encode()).hexdigest(), nxt.doc_id))
    assert sorted(((r["doc_id"], r["edited_sha256"], r["next_id"]) for r in out), key=repr) == sorted(want, key=repr)
    assert spotsigs.compare_edited(frame(spark, [])).count() == 0
    alone = spotsigs.compare_edited(frame(spark, [(1, "abcdef")])).collect()[0]
    assert alone["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()


def brute_spots(text):
    words = regex.sub(r"[^\p{L}\p{N}]+", " ", (text or "").lower()).split()
    content = [(i, w) for i, w in enumerate(words) if w not in spotsigs.ANCHORS]
    chains = {tuple(w for j, w in content if j > i)[: spotsigs.CHAIN] for i, w in enumerate(words) if w in spotsigs.ANCHORS}
    return chains or {tuple(words[i : i + spotsigs.CHAIN]) for i in range(max(1, len(words)))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_likeness_by_brute_force(spark):
    rng = random.Random(21)
    small = lambda n: " ".join(rng.choice(["the", "of", "and", "la", "der", "Apple", "pear", "fig", "plum-tree", "Ünï"]) for _ in range(n))
    rows = [(i, small(rng.randint(0, 60))) for i in range(80)] + [(100, "no anchor anywhere"), (101, None), (102, "the"), (103, "x the")]
    out = {r["doc_id"]: r for r in spotsigs.compare_edited(frame(spark, rows).repartition(6)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for (doc, own), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        own, nxt = own or "", nxt or ""
        edited = own[: len(own) - len(own) // 3] + nxt[: len(own) // 3]
        assert abs(out[doc]["near_edited"] - jaccard(brute_spots(own), brute_spots(edited))) < 1e-12, doc
        assert abs(out[doc]["near_next"] - jaccard(brute_spots(own), brute_spots(nxt))) < 1e-12, doc
        assert len(out[doc]["fingerprint"].split(" ")) == len(brute_spots(own))


def test_classes_by_brute_force(spark):
    rng = random.Random(22)
    rows = []
    for family in range(8):
        base = text(rng, 120).split()
        for i in range(8):
            own = list(base)
            for _ in range(rng.randint(0, 8)):
                own[rng.randrange(120)] = "".join(rng.choice("abcdefgh") for _ in range(5))
            rows.append((family * 100 + i, " ".join(own)))
    rows += [(900, rows[0][1]), (901, rows[9][1]), (902, ""), (903, None), (950, rows[20][1] + " and more text")]
    sets = [(d, brute_spots(t)) for d, t in rows]
    ids = sorted({d for d, _ in sets})
    alike = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[i + 1 :] if a != b and jaccard(x, y) >= 0.8]
    root = {d: d for d in ids}
    for _ in ids:
        for a, b in alike:
            root[a] = root[b] = min(root[a], root[b])
    got = spotsigs.near_classes(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["class_id"] == root[r["doc_id"]] and r["n_links"] == len({x for e in alike for x in e if r["doc_id"] in e} - {r["doc_id"]}), r
    found = {(r["a"], r["b"]) for r in spotsigs.near_duplicates(frame(spark, rows)).collect()}
    name = {d: min(e for e, y in sets if y == x) for d, x in sets}
    assert found == {(min(name[a], name[b]), max(name[a], name[b])) for a, b in alike if name[a] != name[b]} and len(found) > 3


def test_rows_without_id_and_repeated_rows(spark):
    """Copies are worked on once, and each has its own row."""
    rows = [(None, "abc def ghi")] * 300 + [(5, "the cat sat on it")] * 3 + [(None, "xyz")]
    out = spotsigs.compare_edited(frame(spark, rows).repartition(4)).collect()
    assert len(out) == 304 and sum(r["near_next"] == 1 for r in out) == 299 + 2
    assert sorted(r["next_id"] is None for r in out if r["doc_id"] == 5) == [False, False, True] and sum(r["next_id"] == 5 for r in out) == 3


def test_rows_of_one_id(spark):
    rows = [(9, "abcdef"), (9, "ghijkl"), (9, "ghijkl"), (3, "mnopqr")]
    out = spotsigs.compare_edited(frame(spark, rows)).collect()
    order = [*sorted(rows[:3], key=lambda r: hashlib.md5(r[1].encode()).hexdigest()), rows[3]]
    want = [hashlib.sha256((own[:4] + nxt[:2]).encode()).hexdigest() for (_, own), (_, nxt) in zip(order, order[1:] + order[:1], strict=True)]
    assert sorted(r["edited_sha256"] for r in out) == sorted(want)
