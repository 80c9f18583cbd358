import pytest
from pyspark.sql import functions as F

from shelfwise.functions import numbers as N
from shelfwise.functions import text as T
from shelfwise.plans.windows import chosen_scenes, spaced_scenes


def value(spark, column, **inputs):
    types = {k: {str: "string", int: "long", float: "double", type(None): "string"}[type(v)] for k, v in inputs.items()}
    return spark.createDataFrame([tuple(inputs.values())], ", ".join(f"{k} {t}" for k, t in types.items())).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("name", "creator", "title"),
    [
        ("John Doe - My Amazing Video.mp4", "John Doe", "My Amazing Video"), ("Creator - Part One - Part Two.mp4", "Creator", "Part One - Part Two"), ("Just A Title.mp4", None, "Just A Title"),
        ("Creator_Name_-_Video_Title.mp4", "Creator Name", "Video Title"), ("/Some Folder/Creator Name - Test Video.mp4", "Creator Name", "Test Video"), ("Watch Jane - Film.mp4", "Jane", "Film"), ("Watch - Film.mp4", "Watch", "Film"),
        ("Watch Me Dance.mp4", None, "Watch Me Dance"), ("A_-_B_-_VOE___(CDN)___Video_Cloud.mp4", "A", "B"), (" - Title.mp4", None, "- Title"),
    ],
)
def test_names(spark, name, creator, title):
    got = value(spark, T.parsed_name(F.col("n")), n=name)
    assert (got["creator"], got["title"]) == (creator, title)


def test_text(spark):
    assert value(spark, T.slug(F.col("n")), n="Crème  Brûlée & Co!") == "creme-brulee-co" and value(spark, T.slug(F.col("n")), n="漢字") == "video"
    assert value(spark, T.fnv1a(F.col("n")), n="hello") == "4f9f2cab" and value(spark, T.fnv1a(F.col("n")), n="") == "811c9dc5"
    assert value(spark, T.content_disposition(F.col("n")), n="é a.mp4") == "attachment; filename=\"_ a.mp4\"; filename*=UTF-8''%C3%A9%20a.mp4"
    assert value(spark, T.creator_name(F.col("n")), n="povocean") == "ocean" and value(spark, T.creator_name(F.col("n")), n="JOI - ") == "Unknown Creator"
    assert value(spark, T.safe_reason(F.col("n")), n="bad\n https://x.y/z?a=1  end") == "bad [url] end"


@pytest.mark.parametrize(
    ("name", "safe"),
    [("a/b:c*1.mp4", "bc1.mp4"), ("../../etc/passwd", "passwd"), ("C:\\x\\My: Video?.mp4", "My Video.mp4"), ("...hidden.mp4", "hidden.mp4"), ("a\u200bb\u202e.mkv", "ab.mkv"), ("name. . ", "name"), ("...", "video.bin"), ("x/", "video.bin"), ("", "video.bin"), ("x" * 200 + ".mp4", "x" * 176 + ".mp4"), ("x" * 200 + ".elevenchars", "x" * 180)],
)
def test_download_names(spark, name, safe):
    assert value(spark, T.download_name(F.col("n")), n=name) == safe


def test_names_from_titles_and_headers(spark):
    named = lambda title, ending: value(spark, T.download_name(F.lit(None).cast("string"), F.col("t"), F.col("e")), t=title, e=ending)
    assert [named("My: Title", ".MKV"), named("v1.2", "mp4"), named("Plain", "toolongending"), named("//", "mp4")] == ["My Title.mkv", "v1.2", "Plain", "video.bin"]
    said = lambda name: value(spark, T.content_disposition(F.col("n")), n=name)
    assert said('a"b\\.mp4') == 'attachment; filename="ab.mp4"' and said('"') == "attachment; filename=\"download\"; filename*=UTF-8''%22"
    assert said("🙂 (1)!.mp4") == "attachment; filename=\"__ (1)!.mp4\"; filename*=UTF-8''%F0%9F%99%82%20(1)!.mp4"


def test_links(spark):
    key = "k" * 43
    parts = lambda url: tuple(value(spark, T.link_parts(F.col("u")), u=url))
    assert parts(f" https://mega.nz/file/20oTQTBS#{key}\n") == ("20oTQTBS", key) and parts(f"http://www.mega.co.nz/file/20oTQTBS#{'k' * 32}")[1] == "k" * 32
    for bad in (f"https://mega.nz/embed/20oTQTBS#{key}", f"https://mega.nz/file/20oTQTBS!{key}", f"https://mega.io/file/20oTQTBS#{key}", "https://mega.nz/file/20oTQTBS#short", f"https://mega.nz/file/20oTQTBS#{'k' * 65}"):
        assert parts(bad) == (None, None)
    assert value(spark, T.embed_url(F.col("u"), muted=True), u=f"https://mega.nz/file/20oTQTBS#{key}") == f"https://mega.nz/embed/20oTQTBS#{key}!1m"


def test_numbers_told_by_their_size(spark):
    seconds = lambda v: value(spark, N.duration_seconds(F.col("v")), v=v)
    assert [seconds(v) for v in (0, -1, 999, 1000, 5000, 1500, 999_999, 1_000_000, 2_000_000)] == [None, None, 999, 1, 5, 2, 1000, 1, 2]
    assert seconds(0.4) == 0 and seconds(float("inf")) is None and seconds(float("nan")) is None
    size = lambda t: value(spark, N.size_bytes(F.col("t"), 7), t=t)
    assert [size(t) for t in ("5GB", "1.5 kb", "700", " 2 B ", "5G", "5GiB", "0", "", "-1", "1e3")] == [5 << 30, 1536, 700, 2, 7, 7, 7, 7, 7, 7]
    clock = lambda v: value(spark, T.clock(F.col("v")), v=v)
    assert [clock(v) for v in (0, 59.9, 60, 3600, -1, float("inf"), float("nan"))] == ["0:00", "0:59", "1:00", "1:00:00", None, None, None]
    assert value(spark, N.candidate_seeks(F.col("d")), d=100.0) == [5, 25, 50, 75, 98] and value(spark, N.candidate_seeks(F.col("d")), d=4.0) == [2, 10, 30, 60, 180] and value(spark, N.candidate_seeks(F.col("d")), d=5.0) == [1, 3, 4]


def test_account_errors(spark):
    from shelfwise.functions import classify as C

    kind = lambda text, login: value(spark, T.error_kind(F.col("t"), F.lit(login)), t=text)
    assert [kind("ESID (-15)", True), kind("(-26)", False), kind("ENOENT (-9)", True), kind("ENOENT (-9)", False), kind("fetch failed", True), kind("odd", True), kind("odd", False)] == ["session-expired", "mfa", "auth", "unknown", "transient", "auth", "unknown"]
    sniffed = lambda data: spark.createDataFrame([(bytearray(data),)], "d binary").select(C.sniffed_type(F.col("d"))).first()[0]
    packets = (b"G" + bytes(187)) * 5
    assert sniffed(packets) == "video/mp2t" and sniffed(packets[:188] * 3 + bytes(376)) is None and sniffed(packets[:752] + bytes(188)) == "video/mp2t"
    assert sniffed(b"\0\0\0\x10ftyp" + bytes(8)) == "video/mp4" and sniffed(b"\0\0\0\x11ftyp" + bytes(8)) is None and sniffed(b"\x1a\x45\xdf\xa3") == "video/webm" and sniffed(b"RIFF1234AVI ") == "video/x-msvideo" and sniffed(b"") is None


def windows(spark, rows, most, gap):
    table = spark.createDataFrame([(rows,)], "w array<struct<start: bigint, length: bigint>>")
    return [(w["start"], w["length"]) for w in table.select(N.merged_windows(F.col("w"), most, gap).alias("m")).first()["m"]]


def test_merged_windows(spark):
    assert windows(spark, [(50, 10), (0, 10), (15, 10), (90, 0)], 100, 5) == [(0, 25), (50, 10)]
    assert windows(spark, [(0, 60), (60, 60), (120, 60)], 130, 5) == [(0, 120), (120, 60)]  # the cap begins anew
    assert windows(spark, [(0, 100), (10, 20)], 100, 0) == [(0, 100)] and windows(spark, [], 1, 1) == []


def test_folds(spark):
    starts = value_of(spark, spaced_scenes(F.array(*map(F.lit, (1.0, 1.1, 1.2))), F.lit(1.2), F.lit(0.5), F.lit(20.0)))
    assert starts == [1.0, 2.0, pytest.approx(3.0)]
    scene = lambda *options: F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("bright"), F.lit(c).alias("signature")) for a, b, c in options])
    scenes = F.array(scene((5.0, False, 1.0), (6.0, True, 1.0)), scene((1.0, True, 2.0), (2.0, True, 9.0)), scene((9.0, False, 0.0)))
    assert value_of(spark, chosen_scenes(scenes)) == [2.0, 6.0, 9.0]


def value_of(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_montage(spark):
    from shelfwise.plans.montage import alternatives, montage

    planned = lambda d, n, s: [tuple(x) for x in value_of(spark, montage(F.lit(d).cast("double"), n, s))]
    tried = lambda at, length, d, n: value_of(spark, alternatives(F.lit(at), F.lit(length), F.lit(d).cast("double"), n))
    assert [s for s, _, _ in planned(100.0, 5, 1.2)] == [pytest.approx(x) for x in (10, 30, 50, 70, 90)]
    assert planned(None, 3, 1.2) == [(10.0, 1.2, True), (30.0, 1.2, True), (50.0, 1.2, True)] and len(planned(None, 9, 1)) == 5
    assert planned(1.5, 5, 1.2) == [(pytest.approx(0.27), pytest.approx(1.2), False)] and len(planned(5.0, 5, 1.2)) == 2
    assert tried(10.0, 1.2, None, 2) == [10.0, 11.5, 8.5] and tried(0.0, 1.0, 1.3, 9) == [pytest.approx(0.0)]


def test_greedy_scenes_by_brute_force(spark):
    from shelfwise.plans.windows import greedy_scenes
    from shelfwise.sources.catalog import Library

    lib = Library(spark, "/root/testdata/sf0.001")
    scenes = {}
    for r in lib.fragment.orderBy("stream", "idx").collect():
        scenes.setdefault(r["stream"], {}).setdefault((r["idx"] - 1) // 2, []).append((float(r["idx"]), r["keyframe"], r["first_byte"] / 1000))
    want = {}
    for stream, each in scenes.items():
        chosen = []
        for _, options in sorted(each.items()):
            chosen.append(next((o for o in options if o[1] and all(abs(o[2] - c[2]) >= 2.5 for c in chosen)), options[0]))
        want[stream] = sorted(c[0] for c in chosen)
    assert {r["stream"]: r["starts"] for r in greedy_scenes(lib).collect()} == want


def test_fnv_counts_utf16_units(spark):
    def plain(text):
        h = 0x811C9DC5
        data = text.encode("utf-16-be")
        for i in range(0, len(data), 2):
            h = (h ^ int.from_bytes(data[i : i + 2], "big")) * 0x01000193 & 0xFFFFFFFF
        return f"{h:x}"

    for text in ("abc", "Ünï", "漢字", "a🙂b"):
        assert value(spark, T.fnv1a(F.col("n")), n=text) == plain(text)


def test_order_by_brute_force(spark):
    import random

    from shelfwise.operators.order import numbered, running_total

    rng = random.Random(1)
    rows = [(i, rng.randint(0, 20), rng.randint(0, 9)) for i in range(500)]
    table = spark.createDataFrame(rows, "id long, a int, v long").repartition(7)
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    got = {r["id"]: r["pos"] for r in numbered(table, [F.desc("a"), F.col("id")]).collect()}
    assert got == {r[0]: p for p, r in enumerate(order, 1)}
    total, want = 0, {}
    for i, _, v in order:
        want[i] = total = total + v
    assert {r["id"]: r["s"] for r in running_total(table, [F.desc("a"), F.col("id")], F.col("v"), "s").collect()} == want
