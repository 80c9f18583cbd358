"""The home feed of all users in one plan: ranked pools by windows, and one fold for each user over the few rows of its pools."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions import query_language as Q
from shelfwise.functions.numbers import FEED_SOURCES, quotas
from shelfwise.operators.scope import PER_PAGE, newest, with_owner
from shelfwise.operators.selection import by_quota, fresh, round_robin
from shelfwise.plans.feed import HOME, NAMES_OF
from shelfwise.plans.scans import search_table
from shelfwise.plans.windows import SEED, shuffled
from shelfwise.registry import query
from shelfwise.sources.catalog import Library
from shelfwise.sources.shared import written
from shelfwise.sources.trigram_index import TrigramIndex

#: Watched videos that count, videos of a creator or by a title around a seed, pages of a search that are looked at, and seeds of a page.
WATCHED, AROUND, SEARCHED, SEEDS = 5, 12, 3, 2
MADE = "user_id int, page int, source string, id long, pos int"
POOL = ["user_id", "kind", "key", "rank", "id", "title", "creator_id", "mark"]


def top(rows: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each group with their rank. Spark cuts groups before it shuffles them, so a hot one is not gathered."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= most)


def as_pool(rows: DataFrame, kind: str, key: Column | None = None) -> DataFrame:
    """rows (user_id, rank, id ...) as rows of POOL."""
    given = {"kind": F.lit(kind), "key": F.lit(None).cast("string") if key is None else key.cast("string")}
    given |= {c: F.lit(None).cast(t) for c, t in (("title", "string"), ("creator_id", "long"), ("mark", "string")) if c not in rows.columns}
    return rows.withColumns(given).select("user_id", "kind", "key", F.col("rank").cast("long").alias("rank"), F.col("id").cast("long").alias("id"), "title", F.col("creator_id").cast("long").alias("creator_id"), "mark")


class Pools(NamedTuple):
    """One user's pools, as the fold reads them."""

    total: int
    recent: list[int]
    oldest: list[int]
    shuffled: list[int]
    watched: list[tuple[int, str, int | None]]
    creators: dict[int, list[int]]
    titles: dict[str, list[int]]
    known: dict[int, tuple[str, int | None]]

    def page(self, number: int) -> list[int]:
        """A page of the newest videos: from the front, or, for the last ones, from the end."""
        first, last = (number - 1) * PER_PAGE, min(number * PER_PAGE, self.total)
        if last <= len(self.recent):
            return self.recent[first:last]
        return [self.oldest[self.total - 1 - place] for place in range(first, last)]

    def by_title(self, title: str, without: set[int], most: int) -> list[int]:
        found = Q.literal(title)
        return fresh(self.titles.get(found[1], []), set(without), most) if found else []

    def by_history(self) -> list[int]:
        taken = {one for one, _, _ in self.watched}
        excluded, out = set(taken), []
        for creator in dict.fromkeys(c for _, _, c in self.watched if c is not None):
            out += fresh(fresh(self.creators.get(creator, []), set(excluded), PER_PAGE), taken, PER_PAGE - len(out))
        before = set(taken)
        for _, title, _ in self.watched:
            if len(out) < PER_PAGE:
                out += fresh(self.by_title(title, before, PER_PAGE), taken, PER_PAGE - len(out))
        return out

    def around(self, seeds: list[int]) -> list[int]:
        taken, out = set(seeds), []
        for one in seeds:
            title, creator = self.known[one]
            same = fresh(self.creators.get(creator, []), {one}, AROUND) if creator is not None else []
            for ids in (same, self.by_title(title, {one}, AROUND)):
                out += fresh(ids, taken, PER_PAGE - len(out))
        return out


def pages_of(pools: Pools, last: int) -> Iterator[tuple[int, list[tuple[str, int]]]]:
    """(page, picks) up to the last page asked for; what one page shows is taken for the next."""
    pages, history, taken = max(1, -(-pools.total // PER_PAGE)), pools.by_history(), set()
    share = quotas(PER_PAGE, bool(history))
    for number in range(1, last + 1):
        recent = pools.page(number)
        shuffled_page = pools.shuffled[(number - 1) * PER_PAGE : number * PER_PAGE]
        picks = by_quota({"recent": recent, "history": history if number == 1 else [], "related": pools.around(recent[:SEEDS]), "random": shuffled_page, "variety": pools.page(max(1, pages - number + 1))}, share, PER_PAGE, taken)
        taken.update(one for _, one in picks)
        yield number, round_robin([[p for p in picks if p[0] == source] for source in FEED_SOURCES])


def asked_titles(rows: DataFrame) -> DataFrame:
    """(user_id, term) of the titles to search for; a blank one is not searched."""
    term = F.trim(F.regexp_replace("title", r"(?U)\s+", " "))
    return rows.select("user_id", term.alias("term")).where("term <> ''").distinct()


def title_pools(own: DataFrame, public: DataFrame, titles: DataFrame) -> DataFrame:
    """(user_id, term, rank, id): the first pages of a literal search for each title in what its user sees."""
    columns = ["id", "title", "filename", "creator", "alltext", "created_at"]
    texts = own.select("user_id", *columns).unionByName(public.select(F.lit(None).cast("int").alias("user_id"), *columns))
    found = TrigramIndex.of(texts.select("id", "alltext")).lookup_many(titles.select("term").distinct())
    rows = titles.join(found, "term").join(texts.withColumnRenamed("user_id", "owner"), "id").where("owner IS NULL OR owner = user_id")
    rows = rows.where(F.contains(F.lower("alltext"), F.lower("term")))
    whole_words = F.forall(F.split("term", " "), lambda w: F.length(w) >= 3)
    rows = rows.withColumn("score", F.when(whole_words, Q.score([F.col("term")])))
    return top(rows, ["user_id", "term"], [F.asc_nulls_last("score"), *newest()], SEARCHED * PER_PAGE)


def home_feeds(lib: Library, last: int = 1, seed: str = SEED) -> DataFrame:
    """user_id, page, source, id, pos: pages 1 to last of the home feed of every user who has a video.

    Pools are cut to what the pages can use, so a user's fold reads a number of rows that depends on last alone. Public videos are in every user's shuffle:
    the first ones of their order, a few pages of ids, are sent to the folds.
    """
    columns = ["id", "title", "filename", "creator", "alltext", "created_at", "creator_id"]
    videos = search_table(with_owner(lib.video, lib.account), lib.creator)
    own = written(videos.where("owner IS NOT NULL AND owner_status <> 'DISCONNECTED'").select(F.col("owner").cast("int").alias("user_id"), *columns), "own-videos")
    public = videos.where("account_id IS NULL").select(*columns)
    most = last * PER_PAGE
    recent = written(top(own, ["user_id"], newest(), most), "recent")
    totals = own.groupBy("user_id").agg(F.count("*").alias("rank"))
    order = shuffled(seed)
    mark = F.concat_ws(" ", order[0].cast("string"), F.lpad(F.col("id").cast("string"), 20, "0"))
    shared = [(r["mark"], r["id"]) for r in public.select("id", mark.alias("mark")).orderBy("mark").limit(most).collect()]
    mixed = top(own.withColumn("mark", mark), ["user_id"], [F.col("mark")], most)
    known = lib.video.select(F.col("id").alias("video_id"), "id", "title", "creator_id")
    watched = top(lib.history, ["user_id"], [F.desc("ts"), F.col("video_id")], WATCHED).join(known, "video_id").join(totals.select("user_id"), "user_id", "left_semi")
    watched = written(watched.select("user_id", "rank", "id", "title", "creator_id"), "watched")
    seeds = recent.where(f"(rank - 1) % {PER_PAGE} < {SEEDS}").select("user_id", "title", "creator_id")
    sources = watched.select("user_id", "title", "creator_id").unionByName(seeds)
    creators = sources.where("creator_id IS NOT NULL").select("user_id", "creator_id").distinct()
    made = own.select("id", "creator_id", "created_at", F.col("user_id").alias("owner")).unionByName(public.select("id", "creator_id", "created_at", F.lit(None).cast("int").alias("owner")))
    made = creators.join(made, "creator_id").where("owner IS NULL OR owner = user_id")
    parts = [
        as_pool(totals.withColumn("id", F.lit(0)), "total"), as_pool(recent, "recent"), as_pool(top(own, ["user_id"], [F.asc("created_at"), F.asc("id")], most), "oldest"), as_pool(mixed, "shuffled"), as_pool(watched, "watched"),
        as_pool(top(made, ["user_id", "creator_id"], newest(), PER_PAGE + WATCHED), "creator", F.col("creator_id")), as_pool(title_pools(own, public, asked_titles(sources)), "title", F.col("term")),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)

    def fold(table: pd.DataFrame) -> pd.DataFrame:
        kinds = {kind: own.sort_values("rank") for kind, own in table.groupby("kind")}
        empty = table.iloc[:0]
        ids = lambda kind: kinds.get(kind, empty)["id"].tolist()
        keyed = lambda kind: {key: own["id"].tolist() for key, own in kinds.get(kind, empty).groupby("key")}
        whole = lambda value: None if pd.isna(value) else int(value)
        told = lambda kind: [(int(i), t, whole(c)) for i, t, c in kinds.get(kind, empty)[["id", "title", "creator_id"]].itertuples(index=False)]
        mixed = sorted([*shared, *kinds.get("shuffled", empty)[["mark", "id"]].itertuples(index=False, name=None)])
        pools = Pools(int(kinds["total"]["rank"].iloc[0]), ids("recent"), ids("oldest"), [one for _, one in mixed[:most]], told("watched"), {int(k): v for k, v in keyed("creator").items()}, keyed("title"), {i: (t, c) for i, t, c in told("recent")})
        user = int(table["user_id"].iloc[0])
        out = [(user, number, source, one, pos) for number, picks in pages_of(pools, last) for pos, (source, one) in enumerate(picks)]
        return pd.DataFrame(out, columns=["user_id", "page", "source", "id", "pos"])

    return rows.groupBy("user_id").applyInPandas(fold, MADE)


#: The feed of one user after the other; the users of the test tables are the five regions.
EACH = " UNION ALL ".join(
    f"SELECT {user} AS user_id, 1 AS page, source, id, pos FROM ({HOME.replace('owner = 1 ', f'owner = {user} ').replace('history WHERE user_id = 1 ', f'history WHERE user_id = {user} ')} SELECT {NAMES_OF} AS source, id, CAST(pos AS INTEGER) AS pos FROM page WHERE (SELECT n FROM size) > 0)" for user in range(5)
)


@query("qry_11_home_feeds", EACH)
def all_home_feeds(lib: Library) -> DataFrame:
    """The first page of every user; tested against the feed that is made for one user at a time."""
    return home_feeds(lib, 1)


@query("win_03_first_claims")
def all_second_pages(lib: Library) -> DataFrame:
    """Two pages of every user: each id goes to the first source of the first page that claims it."""
    return home_feeds(lib, 2)
