import random
import time

from shelfwise.llm.html_extract import UNWANTED, extract, main_text, parse, score

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header class="site-header"><h2>Site</h2></header><div class="cookie-notice">We use cookies, ok?</div>
<div id="wrap"><div class="sidebar"><p>About, me, and, you, and, more, words here.</p></div>
<div id="content"><h1>Title here</h1><div class="post-body"><p>One, two, three paragraph &amp; text that&nbsp;is   long enough.</p>
<p>Short.<ul><li>item a<li>item b</ul><table><tr><td>cell 1<td>cell 2</table>
<script>var x="<p>no</p>";</script><form><input><button>Send</button></form></div></div>
<section id="comments"><p>Great article, thanks, really, nice, very.</p></section></div>
<nav><a href="/">Home</a></nav><footer>&copy; 2020</footer></body></html>"""


def test_page_of_divs():
    assert main_text(PAGE) == "Title here\nOne, two, three paragraph & text that is long enough.\nShort.\nitem a\nitem b\ncell 1\ncell 2"


def test_sections_and_malformed_markup():
    assert main_text("<body><main><section><p>First, part.</p></section><section><p>Second.</p><aside>Ad</aside></section></main></body>") == "First, part.\nSecond."
    assert main_text('<nav><a href="x">x</a></nav><article><h1>H</h1><p><b>One.<br><p>Two &lt;b&gt; <i>it</i>al</p></article>') == "H\nOne.\nTwo <b> ital"
    assert main_text("a < b and <p>c<!-- x --> d") == "a < b and\nc d"
    assert main_text('<div class="ad">Buy, now, please</div>') == ""


def test_odd_rows(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "<p>" + "word, " * 50_000 + "</p>", "x"), (None, "u", "<p>a</p>", None), (None, "u", "<p>a</p>", None)]
    out = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(out) == 5
    by = {r["page_id"]: r["text"] for r in out}
    assert by[1] == "" and by[2] == "" and len(by[3]) == 299_999 and by[None] == "a"


LONG = "<p>" + "A long paragraph, with many words and, commas, that counts as text. " * 4 + "</p>"


def test_names_never_decide_against_the_score():
    three = main_text(f"<article>{LONG * 3}</article>")
    assert len(three) > 800
    assert main_text(f'<article class="post category-legal tag-search">{LONG * 3}</article>') == three
    assert main_text(f'<div class="page has-sidebar">{LONG * 3}</div>') == three == main_text(f'<div class="no-sidebar">{LONG * 3}</div>')
    assert main_text(f'<form id="all"><nav>menu</nav><div class="sidebar"><p>Side, bar.</p></div><div class="sidebar">{LONG * 3}</div></form>') == three
    assert main_text(f'<article><div class="article-header"><h1>Title</h1><p>Lead.</p></div>{LONG}<p class="legal">Small print.</p></article>').split("\n")[::3] == ["Title", "Small print."]
    assert main_text(f'<div><div class="article-header"><h1>Title</h1><p>Lead.</p></div><div class="body">{LONG * 2}</div></div>').startswith("Title\nLead.\n")
    comments = "".join(f'<div class="comment">{LONG}</div>' for _ in range(4))
    assert main_text(f'<main><div>{LONG * 3}</div><div id="comments">{comments}</div></main>') == three


def test_deep_and_broken_pages_take_linear_time():
    n = 100_000
    pages = {"<span>" * n + "x, y": "x, y", "<div>" * n + "text": "text", "<div><p>a</p>" * n: None, "<span>" * n + "<div></div>" * n: "", "<ul>" + "<div>" * n + "<li>x</li>" * n: None, "<span>" * n + "</b>" * n: "", "<svg>" * n: "", '<a "' * n: "", "<li><td>" * n: ""}
    began = time.process_time()
    for page, want in pages.items():
        got = main_text(page)
        assert want is None or got == want
    assert time.process_time() - began < 60


def brute(tree, above=(), weight=1.0, seen=None):
    """(score, length, linked) of every node, by walking up from every block; tree: (tag, class, children)."""
    seen = [] if seen is None else seen
    tag, name, children = tree
    weight *= UNWANTED if name == "sidebar" or tag == "aside" else 1
    mine = {"tag": tag, "score": 0.0, "length": 0, "linked": 0}
    seen.append(mine)
    path = (*above, mine)

    def texts(items, linked):
        for item in items:
            if isinstance(item, str):
                yield item, linked
            elif item[0] in ("a", "span"):
                yield from texts(item[2], linked or item[0] == "a")

    def blocks(items):
        for item in items:
            if not isinstance(item, str):
                if item[0] in ("a", "span"):
                    yield from blocks(item[2])
                else:
                    yield item

    own = list(texts(children, False))
    length, linked = sum(len(t) for t, _ in own), sum(len(t) for t, a in own if a)
    for node in path:
        node["length"] += length
        node["linked"] += linked
    if length:
        points = weight * (min(1, length / 25) + sum(t.count(",") for t, _ in own) + min(length / 100, 3)) * (1 - linked / length)
        holders = [x for x in path if x["tag"] in ("#root", "div", "section", "article", "aside")]
        for step, node in enumerate(holders[::-1][:5]):
            node["score"] += points / 2**step
    for child in blocks(children):
        brute(child, path, weight, seen)
    return seen


def test_points_by_brute_force():
    rng = random.Random(3)

    def made(depth):
        def inline():
            text = "".join(rng.choice(["word", ",", "xy"]) for _ in range(rng.randint(1, 60)))
            return rng.choice([text, ("a", "", [text]), ("span", "", [text, ("a", "", ["z"])])])

        tag = rng.choice(["div", "section", "article", "aside", "p", "p"]) if depth else "p"
        if tag == "p":
            return ("p", rng.choice(["", "sidebar"]), [inline() for _ in range(rng.randint(0, 3))])
        return (tag, rng.choice(["", "sidebar", "body"]), [made(depth - 1) if rng.random() < 0.8 else inline() for _ in range(rng.randint(0, 4))])

    def page(tree):
        return tree if isinstance(tree, str) else f'<{tree[0]} class="{tree[1]}">' + "".join(map(page, tree[2])) + f"</{tree[0]}>"

    for _ in range(300):
        trees = [made(6) for _ in range(2)]
        want = brute(("#root", "", trees))
        nodes = parse("".join(map(page, trees)))
        best = score(nodes)
        blocks = [n for n in nodes if n.tag not in ("a", "span")]
        assert [n.tag for n in blocks] == [w["tag"] for w in want]
        for n, w in zip(blocks, want, strict=True):
            assert abs(n.score - w["score"]) < 1e-9 and (n.length, n.linked) == (w["length"], w["linked"])
        value = lambda n, w: w["score"] * (1 - w["linked"] / max(1, w["length"])) * (1.5 if n.tag == "article" else 1)
        most = max((value(n, w) for n, w in zip(blocks, want, strict=True) if not n.gone), default=0)
        assert (best is None and most < 1e-9) or abs(value(best, want[blocks.index(best)]) - most) < 1e-9


def comments(n, mark=""):
    return "".join(f'<li{mark}><b class="author">Reader {i}</b> <time>2020-01-0{i % 9 + 1}</time><p>I think, as reader {i}, that this, all of it, was well worth the time, thanks.</p></li>' for i in range(n))


def test_comments_and_notices_never_come_back():
    two = "<p>The first paragraph, which is short.</p><p>The second, no longer.</p>"
    text = "The first paragraph, which is short.\nThe second, no longer."
    plain = "".join(f"<p>Nice, reader {i}, very, very nice, and so on, and on, for a long line.</p>" for i in range(40))
    for name in ('id="comments"', 'class="comment-list"', 'class="cookie-consent"', "hidden", 'style="display: none"', 'aria-hidden="true"', 'id="responses"', 'class="notice"'):
        for inner in (plain, f"<ul>{comments(40)}</ul>"):
            assert main_text(f"<article>{two}<section {name}>{inner}</section></article>") == text, name
            assert main_text(f"<body><div><div>{two}</div><div {name}>{inner}</div></div></body>") == text, name


def test_comments_of_any_name_are_told_by_their_shape():
    text = "\n".join(["Head", *["One, two and three, said at some length, as articles do it."] * 3])
    body = "<h1>Head</h1>" + "<p>One, two and three, said at some length, as articles do it.</p>" * 3
    for around in ("<ol>{}</ol>", '<div id="talkback"><h2>12 voices</h2><ul>{}</ul></div>', '<section class="x"><h3>What you say</h3>{}</section>'):
        assert main_text(f"<article>{body}{around.format(comments(12))}</article>") == text, around
        assert main_text(f"<div><div>{body}</div>{around.format(comments(12))}</div>") == text, around
    boxes = "".join(f'<div class="box"><span class="user-name">Ann {i}</span><div>I, for one, liked it, a lot, and more, number {i}.</div></div>' for i in range(4))
    assert main_text(f"<main>{body}{boxes}</main>") == text
    # a list with dates, a blog's index and a dialogue stay
    dated = "<ul>" + "".join(f"<li><time>200{i}</time> something, somewhere, happened.</li>" for i in range(5)) + "</ul>"
    assert main_text(f"<article>{body}{dated}</article>").count("happened") == 5
    index = "<p>All, or nearly all, of our texts.</p>" + "".join(f'<div class="entry"><h2>T {i}</h2><span class="date">1.1.</span><p>Some, words, of text number {i}, here.</p></div>' for i in range(5))
    assert main_text(f"<main>{index}</main>").count("of text number") == 5
    assert main_text(f"<article>{body}{comments(2)}</article>").count("Reader") == 2


def test_what_belongs_to_an_article_stays():
    links = "<ul><li><a href='a'>One source</a><li><a href='b'>Other source</a></ul>"
    assert main_text(f"<article><h1>H</h1><p>Text, with, commas.</p>{links}</article>") == "H\nText, with, commas.\nOne source\nOther source"
    text = "<p>Text, with, commas, and of some length, so that it counts.</p>"
    assert main_text(f"<body>{links}{text}{links}{text}{links}</body>").count("source") == 2
    assert main_text("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> hold, always.</p></article>") == "Let x=2 hold, always."
    assert main_text("<article><p>See, here: <svg><title>t</title><desc>d</desc><g><text>Axis <tspan>one</tspan></text></g></svg>, there.</p></article>") == "See, here: Axis one, there."
    assert main_text("<article><h1>Only</h1><h2>Headings</h2></article>") == "Only\nHeadings" and main_text("<body><h2>One</h2></body>") == "One"
    assert main_text("<p>A, b &<b>amp;</b> c &amp;amp; d</p>") == "A, b &amp; c &amp; d"
    assert main_text("<p>One,<!--> two,</p><p>three,<!---> four.</p><!-- x --!><p>Five.</p>") == "One, two,\nthree, four.\nFive."


def naive(trees, texts):
    """The article of a page of trees (tag, class, children), by recursion over the trees alone."""
    seen = brute(("#root", "", trees))
    flat = []

    def walk(tree, parent, unwanted):
        node = {"tree": tree, "parent": parent, "unwanted": tree[1] == "sidebar" or tree[0] == "aside", "kids": []}
        node["gone"] = unwanted or node["unwanted"]
        flat.append(node)
        stack = list(tree[2])
        while stack:
            item = stack.pop(0)
            if not isinstance(item, str):
                if item[0] in ("a", "span"):
                    stack = [*item[2], *stack]
                else:
                    node["kids"].append(walk(item, node, node["gone"]))
        return node

    walk(("#root", "", trees), None, False)
    for node, found in zip(flat, seen, strict=True):
        node |= {k: found[k] for k in ("score", "length", "linked")}
    value = lambda n: n["score"] * (1 - n["linked"] / max(1, n["length"])) * (1.5 if n["tree"][0] == "article" else 1)
    kept = [n for n in flat if not n["gone"] and n["score"] > 0]
    best = max(kept, key=value, default=None)

    def blocks(tree):
        held, out = [], []

        def flush():
            if line := " ".join("".join(held).split()):
                out.append(line)
            held.clear()

        def read(items):
            for item in items:
                if isinstance(item, str):
                    held.append(item)
                elif item[0] in ("a", "span"):
                    read(item[2])
                elif not (item[1] == "sidebar" or item[0] == "aside"):
                    flush()
                    out.extend(blocks(item))
        read(tree[2])
        flush()
        return out

    if best is None or value(best) <= 0:
        return ""
    if best["parent"] is None:
        return "\n".join(blocks(best["tree"]))
    lines = []
    for one in best["parent"]["kids"]:
        tag, name = one["tree"][:2]
        like = tag in ("section", "div") and (tag, name) == best["tree"][:2] and (name or tag == "section")
        if one is best or (not one["gone"] and one["length"] and one["linked"] / one["length"] < 0.5 and (like or tag == "p" or one["score"] >= 0.2 * best["score"])):
            lines += blocks(one["tree"])
    return "\n".join(lines)


def test_whole_texts_by_brute_force():
    """Pages whose wanted part has text to speak of, so that nothing unwanted comes back."""
    rng, tried = random.Random(9), 0

    def made(depth):
        def inline():
            text = " ".join(rng.choice(["word", "some,", "xy"]) for _ in range(rng.randint(1, 60)))
            return rng.choice([text, text, ("a", "", [text]), ("span", "", [text, ("a", "", ["z"])])])

        tag = rng.choice(["div", "section", "article", "aside", "p", "p", "p"]) if depth else "p"
        if tag == "p":
            return ("p", rng.choice(["", "", "sidebar"]), [inline() for _ in range(rng.randint(0, 3))])
        return (tag, rng.choice(["", "sidebar", "body"]), [made(depth - 1) if rng.random() < 0.8 else inline() for _ in range(rng.randint(0, 4))])

    def page(tree):
        return tree if isinstance(tree, str) else f'<{tree[0]} class="{tree[1]}">' + "".join(map(page, tree[2])) + f"</{tree[0]}>"

    for _ in range(600):
        trees = [made(5) for _ in range(3)]
        html = "".join(map(page, trees))
        nodes = parse(html)
        best = score(nodes)
        if best is None or best.plain < 250 or any(n.why and not n.gone for n in nodes):
            continue
        tried += 1
        assert main_text(html) == naive(trees, None), html
    assert tried > 100
