"""Recommendation pools, up next, and the home feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import query_language as Q
from shelfwise.functions.numbers import FEED_SOURCES, quotas
from shelfwise.operators.scope import PER_PAGE, is_own, newest, paged, total_pages
from shelfwise.operators.selection import by_quota, fresh, patterned, round_robin, up_next
from shelfwise.plans.filters import OWNED, VISIBLE
from shelfwise.plans.library import POS
from shelfwise.plans.search import BASE, rank_sql, score_sql, searchable
from shelfwise.plans.windows import SEED, shuffled
from shelfwise.registry import query
from shelfwise.sources.catalog import Library


def clamped(limit: int) -> int:
    """A limit of recommendations: 1 to 24."""
    return max(1, min(limit, 24))


class Pools:
    """Ranked pools of one user over one scan of what they may see."""

    def __init__(self, lib: Library, user: int):
        self.lib, self.user = lib, user
        self.rows = searchable(lib, user)

    def ids(self, rows: DataFrame, order: list[Column], limit: int, page: int = 1) -> list[int]:
        """At most a page of ids to the driver."""
        top = rows.orderBy(*order).offset((page - 1) * limit).limit(limit)
        return [r["id"] for r in top.select("id").collect()]

    def one(self, video: int):
        return self.rows.where(F.col("id") == video).select("id", "title", "creator_id").first()

    def same_creator(self, video: int, creator: int | None, limit: int = 12) -> list[int]:
        if creator is None:
            return []
        return self.ids(self.rows.where((F.col("creator_id") == creator) & (F.col("id") != video)), newest(), clamped(limit))

    def by_title(self, title: str, without: set[int] = frozenset(), limit: int = 12) -> list[int]:
        """From the first three pages of a literal search for the title."""
        node = Q.literal(title)
        if node is None:
            return []
        rows, rank = self.rows.where(Q.predicate(node)), Q.rank(node)
        order = newest() if rank is None else [F.asc_nulls_last("rank"), *newest()]
        found = self.ids(rows if rank is None else rows.withColumn("rank", rank), order, 3 * PER_PAGE)
        return fresh(found, set(without), clamped(limit))

    def shuffled(self, seed: str, page: int = 1) -> list[int]:
        return self.ids(self.rows, shuffled(seed), PER_PAGE, page)

    def recent(self, page: int = 1) -> list[int]:
        return self.ids(self.rows.where(is_own(self.user)), newest(), PER_PAGE, page)

    def by_history(self, limit: int = 12, without: set[int] = frozenset()) -> list[int]:
        """Videos by the creators of the last five watched ones, in that order, then by their titles; none that was watched lately."""
        last = self.lib.history.where(F.col("user_id") == self.user).orderBy(F.desc("ts"), "video_id").limit(5)
        seen = last.select(F.col("video_id").alias("id"), "ts").join(self.lib.video.select("id", "title", "creator_id"), "id").orderBy(F.desc("ts"), "id").collect()
        taken, out = {r["id"] for r in seen} | set(without), []
        for creator in dict.fromkeys(r["creator_id"] for r in seen if r["creator_id"] is not None):
            rows = self.rows.where((F.col("creator_id") == creator) & ~F.col("id").isin(*[r["id"] for r in seen], *without))
            out += fresh(self.ids(rows, newest(), clamped(limit)), taken, clamped(limit) - len(out))
        before = frozenset(taken)  # what earlier titles give is passed over later, not left out of a search
        for row in seen:
            if len(out) < clamped(limit):
                out += fresh(self.by_title(row["title"], before, limit), taken, clamped(limit) - len(out))
        return out

    def video_pools(self, video: int) -> dict[str, list[int]]:
        row = self.one(video)
        if row is None:
            return {"creator": [], "title": [], "random": []}
        seed = f"related-{video}"
        return {"creator": self.same_creator(video, row["creator_id"], 24), "title": self.by_title(row["title"], {video}, 24), "random": self.shuffled(seed) + self.shuffled(seed, 2)}

    def related(self, video: int, limit: int = 12) -> list[int]:
        """Of the same creator, then by title, then by chance."""
        pools, taken, out = self.video_pools(video), {video}, []
        for name in ("creator", "title", "random"):
            out += fresh(pools[name], taken, clamped(limit) - len(out))
        return out

    def around(self, seeds: list[int], cap: int = 24) -> list[int]:
        """Creator and title matches of the first two seeds, none of the seeds themselves."""
        taken, out = set(seeds), []
        for row in filter(None, map(self.one, seeds[:2])):
            for ids in (self.same_creator(row["id"], row["creator_id"], 12), self.by_title(row["title"], {row["id"]}, 12)):
                out += fresh(ids, taken, cap - len(out))
        return out

    def home(self, page: int = 1, seed: str = SEED) -> list[tuple[str, int]]:
        """(source, id) of a page of the home feed. Earlier pages are made first, as their ids are taken; an empty library has no feed."""
        total = self.rows.where(is_own(self.user)).count()
        if not total:
            return []
        pages, history, taken = total_pages(total), self.by_history(PER_PAGE), set()
        share = quotas(PER_PAGE, bool(history))
        for number in range(1, max(1, page) + 1):
            recent = self.recent(number)
            pools = {"recent": recent, "history": history if number == 1 else [], "related": self.around(recent[:2]), "random": self.shuffled(seed, number), "variety": self.recent(max(1, pages - number + 1))}
            picks = by_quota(pools, share, PER_PAGE, taken)
            taken.update(one for _, one in picks)
        return round_robin([[p for p in picks if p[0] == source] for source in FEED_SOURCES])


def sections(picks: list[tuple[str, int]]) -> dict[str, list[int]]:
    """The first page's groups: new ones, what follows the history, and discoveries."""
    group = {"recent": "new", "history": "for you", "related": "for you", "random": "discover", "variety": "discover"}
    out: dict[str, list[int]] = {"new": [], "for you": [], "discover": []}
    for source, one in picks:
        out[group[source]].append(one)
    return out


def numbered(lib: Library, rows: list[tuple], schema: str) -> DataFrame:
    return lib.spark.createDataFrame([(*r, i) if isinstance(r, tuple) else (r, i) for i, r in enumerate(rows)], f"{schema}, pos int")


SEEN = f"WITH o AS ({OWNED}), s AS (SELECT * FROM o WHERE {VISIBLE.format(1)})"


#: What user 1 sees, and, for the video 1: those of its creator, matches of its title and a shuffle, each in order. A list is the first ones of several such, each once.
SHELF = f"{BASE}, v AS (SELECT t.id, t.created_at, t.title, t.filename, t.creator, t.alltext, o.creator_id FROM t JOIN o ON o.id = t.id)"
NEAR_ONE = f"""{SHELF}, me AS (SELECT * FROM v WHERE id = 1), c AS (SELECT v.id, row_number() OVER (ORDER BY v.created_at DESC, v.id DESC) AS r FROM v, me WHERE v.creator_id = me.creator_id AND v.id <> 1),
    x AS (SELECT v.*, trim(regexp_replace(me.title, '\\s+', ' ', 'g')) AS term FROM v, me), m AS (SELECT id, created_at, {score_sql('term')} AS rank FROM x WHERE term <> '' AND contains(lower(alltext), lower(term))),
    h AS (SELECT id, row_number() OVER (ORDER BY r) AS r FROM (SELECT id, row_number() OVER (ORDER BY rank NULLS LAST, created_at DESC, id DESC) AS r FROM m) WHERE r <= 72 AND id <> 1),
    q AS (SELECT id, row_number() OVER (ORDER BY md5('related-1' || id), id) AS r FROM v)"""
CHOSEN = "k AS (SELECT id, min(part * 1000 + r) AS k FROM p WHERE id <> 1 GROUP BY id) SELECT id, CAST(row_number() OVER (ORDER BY k) AS INTEGER) - 1 AS pos FROM k ORDER BY k LIMIT {0}"


def history_sql(most: int) -> str:
    """w: the last five watched; past (id, r): what they lead to, by their creators and then by their titles."""
    return f"""w AS (SELECT v.id, v.title, v.creator_id, row_number() OVER (ORDER BY ts DESC, video_id) AS n FROM (SELECT * FROM history WHERE user_id = 1 ORDER BY ts DESC, video_id LIMIT 5) l JOIN video v ON v.id = l.video_id),
    wg AS (SELECT creator_id, min(n) AS n FROM w WHERE creator_id IS NOT NULL GROUP BY creator_id), wc AS (SELECT v.id, wg.n, row_number() OVER (PARTITION BY wg.n ORDER BY v.created_at DESC, v.id DESC) AS r FROM v JOIN wg ON wg.creator_id = v.creator_id WHERE v.id NOT IN (SELECT id FROM w)),
    wf AS (SELECT id, row_number() OVER (ORDER BY n, r) AS r FROM wc WHERE r <= {most} QUALIFY row_number() OVER (ORDER BY n, r) <= {most}),
    wx AS (SELECT v.*, w.n, trim(regexp_replace(w.title, '\\s+', ' ', 'g')) AS term FROM v, w), wm AS (SELECT id, created_at, n, {score_sql('term')} AS rank FROM wx WHERE term <> '' AND contains(lower(alltext), lower(term))),
    wh AS (SELECT id, n, row_number() OVER (PARTITION BY n ORDER BY rank NULLS LAST, created_at DESC, id DESC) AS r FROM wm), wi AS (SELECT id, n, row_number() OVER (PARTITION BY n ORDER BY r) AS r FROM wh WHERE r <= 72 AND id NOT IN (SELECT id FROM w) AND id NOT IN (SELECT id FROM wf)),
    wp AS (SELECT id, r AS k FROM wf UNION ALL SELECT id, 1000 * n + r FROM wi WHERE r <= {most}), wk AS (SELECT id, min(k) AS k FROM wp GROUP BY id), past AS (SELECT id, row_number() OVER (ORDER BY k) AS r FROM wk QUALIFY row_number() OVER (ORDER BY k) <= {most})"""


#: The first page of user 1: pools in the order of their sources, each source its quota of what those before it have left, then what fills the page.
HOME = f"""{SHELF}, mine AS (SELECT v.*, row_number() OVER (ORDER BY v.created_at DESC, v.id DESC) AS r FROM v JOIN t ON t.id = v.id WHERE t.account_id IS NOT NULL), size AS (SELECT count(*) AS n, (count(*) + 23) // 24 AS pages FROM mine), {history_sql(24)},
    quota AS (SELECT unnest(range(1, 6)) AS source, unnest(CASE WHEN (SELECT count(*) FROM past) > 0 THEN [4, 2, 4, 7, 7] ELSE [4, 0, 4, 8, 8] END) AS most),
    sc AS (SELECT a.r AS seed, v.id, row_number() OVER (PARTITION BY a.r ORDER BY v.created_at DESC, v.id DESC) AS r FROM mine a JOIN v ON v.creator_id = a.creator_id AND v.id <> a.id WHERE a.r <= 2),
    sx AS (SELECT v.*, a.r AS seed, a.id AS own, trim(regexp_replace(a.title, '\\s+', ' ', 'g')) AS term FROM v, mine a WHERE a.r <= 2), sm AS (SELECT id, created_at, seed, own, {score_sql('term')} AS rank FROM sx WHERE term <> '' AND contains(lower(alltext), lower(term))),
    sh AS (SELECT id, seed, row_number() OVER (PARTITION BY seed ORDER BY r) AS r FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY rank NULLS LAST, created_at DESC, id DESC) AS r FROM sm) WHERE r <= 72 AND id <> own),
    sp AS (SELECT id, min(k) AS k FROM (SELECT id, seed * 1000 + r AS k FROM sc WHERE r <= 12 UNION ALL SELECT id, seed * 1000 + 500 + r FROM sh WHERE r <= 12) WHERE id NOT IN (SELECT id FROM mine WHERE r <= 2) GROUP BY id),
    pool AS (SELECT 1 AS source, id, r FROM mine WHERE r <= 24 UNION ALL SELECT 2, id, r FROM past UNION ALL SELECT 3, id, row_number() OVER (ORDER BY k) FROM sp QUALIFY row_number() OVER (ORDER BY k) <= 24
        UNION ALL SELECT 4, id, r FROM (SELECT id, row_number() OVER (ORDER BY md5('{SEED}' || id), id) AS r FROM v) WHERE r <= 24 UNION ALL SELECT 5, id, r FROM mine, size WHERE r > (pages - 1) * 24),
    p1 AS (SELECT source, id, r FROM pool WHERE source = 1 QUALIFY row_number() OVER (ORDER BY r) <= (SELECT most FROM quota WHERE source = 1)),
    p2 AS (SELECT * FROM p1 UNION ALL SELECT * FROM (SELECT source, id, r FROM pool WHERE source = 2 AND id NOT IN (SELECT id FROM p1) QUALIFY row_number() OVER (ORDER BY r) <= (SELECT most FROM quota WHERE source = 2))),
    p3 AS (SELECT * FROM p2 UNION ALL SELECT * FROM (SELECT source, id, r FROM pool WHERE source = 3 AND id NOT IN (SELECT id FROM p2) QUALIFY row_number() OVER (ORDER BY r) <= (SELECT most FROM quota WHERE source = 3))),
    p4 AS (SELECT * FROM p3 UNION ALL SELECT * FROM (SELECT source, id, r FROM pool WHERE source = 4 AND id NOT IN (SELECT id FROM p3) QUALIFY row_number() OVER (ORDER BY r) <= (SELECT most FROM quota WHERE source = 4))),
    p5 AS (SELECT * FROM p4 UNION ALL SELECT * FROM (SELECT source, id, r FROM pool WHERE source = 5 AND id NOT IN (SELECT id FROM p4) QUALIFY row_number() OVER (ORDER BY r) <= (SELECT most FROM quota WHERE source = 5))),
    rest AS (SELECT id, min(source * 1000 + r) AS k FROM pool WHERE id NOT IN (SELECT id FROM p5) GROUP BY id), filled AS (SELECT source, id, 0 AS pass, r FROM p5 UNION ALL SELECT k // 1000, id, 1, k % 1000 FROM (SELECT *, row_number() OVER (ORDER BY k) AS n FROM rest) WHERE n <= 24 - (SELECT count(*) FROM p5)),
    turn AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pass, r) AS n FROM filled), page AS (SELECT source, id, row_number() OVER (ORDER BY n, source) - 1 AS pos FROM turn)"""
NAMES_OF = "['recent', 'history', 'related', 'random', 'variety'][source]"


@query("qry_09_same_creator", f"{SEEN} SELECT id, CAST(row_number() OVER (ORDER BY created_at DESC, id DESC) AS INTEGER) - 1 AS pos FROM s WHERE id <> 1 AND creator_id = (SELECT creator_id FROM s WHERE id = 1) ORDER BY pos LIMIT 12")
def same_creator(lib: Library) -> DataFrame:
    pools = Pools(lib, 1)
    return numbered(lib, pools.same_creator(1, pools.one(1)["creator_id"]), "id long")


@query("qry_09_title_related", f"{BASE}, m AS (SELECT *, {rank_sql(['the'])} AS rank FROM t WHERE alltext ILIKE '%the%' AND id <> 26) SELECT id, CAST(row_number() OVER (ORDER BY rank NULLS LAST, created_at DESC, id DESC) AS INTEGER) - 1 AS pos FROM m ORDER BY pos LIMIT 12")
def title_related(lib: Library) -> DataFrame:
    return numbered(lib, Pools(lib, 1).by_title("the", {26}), "id long")


@query("qry_09_history_related", f"{SHELF}, {history_sql(12)} SELECT id, CAST(r AS INTEGER) - 1 AS pos FROM past")
def history_related(lib: Library) -> DataFrame:
    """An ordered fold over several small queries."""
    return numbered(lib, Pools(lib, 1).by_history(), "id long")


@query("qry_09_random_discovery", f"{SEEN} SELECT id, CAST(row_number() OVER (ORDER BY md5('related-1' || id)) AS INTEGER) - 1 AS pos FROM s ORDER BY pos LIMIT 12")
def random_discovery(lib: Library) -> DataFrame:
    return numbered(lib, Pools(lib, 1).shuffled("related-1")[:12], "id long")


@query("qry_09_related", f"{NEAR_ONE}, p AS (SELECT id, 1 AS part, r FROM c WHERE r <= 24 UNION ALL SELECT id, 2, r FROM h WHERE r <= 24 UNION ALL SELECT id, 3, r FROM q WHERE r <= 48), {CHOSEN.format(12)}")
def related(lib: Library) -> DataFrame:
    return numbered(lib, Pools(lib, 1).related(1), "id long")


@query("qry_06_public_recommendations", f"SELECT id, {POS.format('CASE WHEN source = ' + repr('src0') + ' THEN 0 ELSE 1 END, file_size % 10, id')} FROM video WHERE account_id IS NULL AND id <> 0 ORDER BY pos LIMIT 12")
def public_recommendations(lib: Library) -> DataFrame:
    order = [F.when(F.col("source") == "src0", 0).otherwise(1), F.col("file_size") % 10, F.col("id")]
    return paged(lib.video.where("account_id IS NULL AND id <> 0"), order, 1, 12).select("id", "pos")


@query("qry_10_up_next", f"{NEAR_ONE}, p AS (SELECT id, 1 AS part, r FROM c WHERE r <= 2 UNION ALL SELECT id, 2, r FROM h WHERE r <= 24 UNION ALL SELECT id, 3, r FROM c WHERE r <= 24 UNION ALL SELECT id, 4, r FROM q WHERE r <= 48), {CHOSEN.format(4)}")
def next_up(lib: Library) -> DataFrame:
    return numbered(lib, up_next(1, Pools(lib, 1).video_pools(1)), "id long")


@query("win_05_patterned_sections")
def patterned_sections(lib: Library) -> DataFrame:
    """A video page's two lists, which share what is taken."""
    pools, taken = Pools(lib, 1).video_pools(1), {1}
    rows = [("more", i) for i in patterned(pools, "ctctr", 12, taken)] + [("discover", i) for i in patterned(pools, "rtrc", 12, taken)]
    return numbered(lib, rows, "list string, id long")


@query("qry_11_home_feed", f"{HOME} SELECT {NAMES_OF} AS source, id, CAST(pos AS INTEGER) AS pos FROM page")
def home_feed(lib: Library) -> DataFrame:
    return numbered(lib, Pools(lib, 1).home(1), "source string, id long")


@query("win_03_first_claim")
def second_page(lib: Library) -> DataFrame:
    """The second page: ids of the first are taken, and each id goes to the first source that claims it."""
    return numbered(lib, Pools(lib, 1).home(2), "source string, id long")


@query("qry_12_sections", f"{HOME}, g AS (SELECT id, pos, CASE WHEN source = 1 THEN 'new' WHEN source <= 3 THEN 'for you' ELSE 'discover' END AS section FROM page) SELECT section, id, CAST(row_number() OVER (ORDER BY CASE section WHEN 'new' THEN 1 WHEN 'for you' THEN 2 ELSE 3 END, pos) AS INTEGER) - 1 AS pos FROM g")
def home_sections(lib: Library) -> DataFrame:
    rows = [(name, one) for name, ids in sections(Pools(lib, 1).home(1)).items() for one in ids]
    return numbered(lib, rows, "section string, id long")
