"""Search: boolean and literal queries over what a user may see."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import query_language as Q
from shelfwise.operators.scope import in_library, newest, paged, with_owner
from shelfwise.plans.filters import OWNED, VISIBLE
from shelfwise.plans.scans import search_table
from shelfwise.plans.scalars import TRIGRAMS
from shelfwise.plans.windows import SEED, shuffled
from shelfwise.registry import query
from shelfwise.sources.catalog import Library
from shelfwise.sources.trigram_index import TrigramIndex

#: The command that shows a shuffle instead of a search.
RANDOM = "#random"


def searchable(lib: Library, user: int | None) -> DataFrame:
    return search_table(with_owner(lib.video, lib.account).where(in_library(user)), lib.creator)


def found(rows: DataFrame, node: tuple, page: int = 1) -> DataFrame:
    """A page of matches: the better rank first (unranked ones last), then the newer."""
    rows = rows.where(Q.predicate(node))
    rank = Q.rank(node)
    if rank is None:
        return paged(rows.withColumn("rank", F.lit(None).cast("double")), newest(), page)
    return paged(rows.withColumn("rank", rank), [F.asc_nulls_last("rank"), *newest()], page)


def search(lib: Library, text: str, user: int | None = None, page: int = 1) -> DataFrame:
    if text.strip() == RANDOM:
        return paged(searchable(lib, user), shuffled(SEED), page)
    return found(searchable(lib, user), Q.parse(text), page)


BASE = f"""WITH o AS ({OWNED}), s AS (SELECT o.id, o.created_at, coalesce(o.title, '') AS title, coalesce(o.filename, '') AS filename, coalesce(c.name, '') AS creator, o.account_id, o.owner, o.owner_status FROM o LEFT JOIN creator c ON c.id = o.creator_id),
    t AS (SELECT *, title || chr(10) || filename || chr(10) || creator AS alltext FROM s WHERE {VISIBLE.format(1)})"""
PAGE = "{0}, CAST(row_number() OVER (ORDER BY {1}) AS INTEGER) AS pos FROM {2} ORDER BY pos LIMIT 24"
TEXT = "the && !and || src13"


@query("qry_01_search_bool", f"{BASE}, m AS (SELECT * FROM t WHERE (alltext ILIKE '%the%' AND NOT alltext ILIKE '%and%') OR alltext ILIKE '%src13%') SELECT {PAGE.format('id', 'created_at DESC, id DESC', 'm')}")
def search_bool(lib: Library) -> DataFrame:
    """Filter of a boolean query, newest first."""
    return paged(searchable(lib, 1).where(Q.predicate(Q.parse(TEXT))), newest()).select("id", "pos")


def rank_sql(terms: list[str]) -> str:
    spaced = lambda x: f"' ' || regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' '"
    words = " + ".join(f"CASE WHEN contains({spaced(f)}, {spaced(repr(t))}) THEN {w} ELSE 0.0 END" for t in terms for f, w in Q.WEIGHTS.items())
    length = f"len(list_filter(string_split({spaced('alltext')}, ' '), lambda w: w <> ''))"

    def near(field: str, term: str) -> str:
        a, b = TRIGRAMS.format(field), TRIGRAMS.format(repr(term))
        return f"coalesce(len(list_intersect({a}, {b})) / nullif(len({a}) + len({b}) - len(list_intersect({a}, {b})), 0), 0.0)"

    similar = " + ".join(f"{w} * greatest({', '.join(near(f, t) for t in terms)})" for f, w in Q.SIMILARITY.items())
    match = " OR ".join(f"alltext ILIKE '%{t}%'" for t in terms)
    return f"CASE WHEN {match} THEN round(-(CAST({words} AS DOUBLE) / (1 + ln({length})) + 0.5 * ({similar})), 6) END"


def score_sql(term: str) -> str:
    """The rank of a term that is an expression, over rows that hold it; null if it has a word of under three characters."""
    spaced = lambda x: f"' ' || regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' '"
    words = " + ".join(f"CASE WHEN contains({spaced(f)}, {spaced(term)}) THEN {w} ELSE 0.0 END" for f, w in Q.WEIGHTS.items())
    length = f"len(list_filter(string_split({spaced('alltext')}, ' '), lambda w: w <> ''))"

    def near(field: str) -> str:
        a, b = TRIGRAMS.format(field), TRIGRAMS.format(term)
        return f"coalesce(len(list_intersect({a}, {b})) / nullif(len({a}) + len({b}) - len(list_intersect({a}, {b})), 0), 0.0)"

    similar = " + ".join(f"{w} * {near(f)}" for f, w in Q.SIMILARITY.items())
    whole = f"len(list_filter(string_split({term}, ' '), lambda w: length(w) < 3)) = 0"
    return f"CASE WHEN {whole} THEN round(-(CAST({words} AS DOUBLE) / (1 + ln({length})) + 0.5 * ({similar})), 6) END"


@query("qry_01_search_ranked", f"{BASE}, m AS (SELECT *, {rank_sql(['tion', 'the'])} AS rank FROM t WHERE alltext ILIKE '%tion%' OR alltext ILIKE '%the%' OR NOT alltext ILIKE '%src%') SELECT {PAGE.format('id, rank', 'rank NULLS LAST, created_at DESC, id DESC', 'm')}")
def search_ranked(lib: Library) -> DataFrame:
    """Ranked alternatives; str_24: weights by field."""
    return search(lib, "tion the !src", 1).select("id", "rank", "pos")


@query("qry_02_search_literal", f"{BASE}, m AS (SELECT *, {rank_sql(['the, '.strip()])} AS rank FROM t WHERE alltext ILIKE '%the,%') SELECT {PAGE.format('id', 'rank NULLS LAST, created_at DESC, id DESC', 'm')}")
def search_literal(lib: Library) -> DataFrame:
    """Operators in the text are text."""
    return found(searchable(lib, 1), Q.literal(" the, ")).select("id", "pos")


@query("fil_06_long_term", f"{BASE} SELECT id FROM t WHERE alltext ILIKE '%ntst%'")
def long_term(lib: Library) -> DataFrame:
    return searchable(lib, 1).where(Q.predicate(("term", "NTST"))).select("id")


@query("fil_07_short_term", f"{BASE} SELECT id FROM t WHERE title ILIKE '%st%' OR filename ILIKE '%st%' OR creator ILIKE '%st%'")
def short_term(lib: Library) -> DataFrame:
    return searchable(lib, 1).where(Q.predicate(("term", "st"))).select("id")


def indexed(lib: Library, node: tuple) -> DataFrame:
    """What user 1 sees of a query's matches, found by trigrams."""
    seen = searchable(lib, 1).select("id", "title", "filename", "creator", "alltext")
    return TrigramIndex.of(seen).matches(node).select("id")


@query("fil_06_indexed_term", f"{BASE} SELECT id FROM t WHERE alltext ILIKE '%ntst%'")
def indexed_long_term(lib: Library) -> DataFrame:
    return indexed(lib, ("term", "NTST"))


@query("fil_07_indexed_term", f"{BASE} SELECT id FROM t WHERE title ILIKE '%st%' OR filename ILIKE '%st%' OR creator ILIKE '%st%'")
def indexed_short_term(lib: Library) -> DataFrame:
    return indexed(lib, ("term", "st"))


@query("fil_09_indexed_composition", f"{BASE} SELECT id FROM t WHERE (alltext ILIKE '%src1%' OR alltext ILIKE '%ntst%') AND NOT alltext ILIKE '%the%' AND (title ILIKE '%an%' OR filename ILIKE '%an%' OR creator ILIKE '%an%')")
def indexed_composition(lib: Library) -> DataFrame:
    return indexed(lib, Q.parse("(src1 || ntst) && !the && an"))


@query("fil_08_escaped_pattern", "SELECT id FROM video WHERE contains(lower('100%_' || id || '\\' || title), '%_1') OR contains('\\' || title, '\\E')")
def escaped(lib: Library) -> DataFrame:
    text = F.concat(F.lit("100%_"), F.col("id").cast("string"), F.lit("\\"), F.col("title"))
    return lib.video.where(text.ilike(Q.pattern("%_1")) | F.concat(F.lit("\\"), "title").like(Q.pattern("\\E"))).select("id")


@query("fil_09_composition", f"{BASE} SELECT id FROM t WHERE (alltext ILIKE '%src1%' OR alltext ILIKE '%src2%') AND NOT (alltext ILIKE '%the%' AND NOT alltext ILIKE '%and%')")
def composition(lib: Library) -> DataFrame:
    return searchable(lib, 1).where(Q.predicate(Q.parse("(src1 || src2) && !(the && !and)"))).select("id")


@query("fil_10_fallback_predicate", f"{BASE} SELECT id FROM t WHERE contains(lower(title), 'ent') OR contains(lower(filename), 'ent') OR contains(lower(creator), 'ent')")
def fallback(lib: Library) -> DataFrame:
    """Field by field; the same rows as the joined text gives."""
    fields = [F.contains(F.lower(F.col(f)), F.lit("ent")) for f in ("title", "filename", "creator")]
    return searchable(lib, 1).where(fields[0] | fields[1] | fields[2]).select("id")


@query("srt_04_relevance_order", f"{BASE}, m AS (SELECT *, {rank_sql(['and'])} AS rank FROM t WHERE alltext ILIKE '%and%') SELECT {PAGE.format('id', 'rank NULLS LAST, created_at DESC, id DESC', 'm')}")
def relevance(lib: Library) -> DataFrame:
    return search(lib, "and", 1).select("id", "pos")


@query("qry_27_search_parity", f"{BASE}, a AS (SELECT id FROM t WHERE alltext ILIKE '%the%'), b AS (SELECT id FROM t WHERE title ILIKE '%the%' OR filename ILIKE '%the%' OR creator ILIKE '%the%') SELECT count(*) AS first, (SELECT count(*) FROM b) AS second, (SELECT count(*) FROM a JOIN b USING (id)) AS both FROM a")
def parity(lib: Library) -> DataFrame:
    """Two engines over one query: what each finds and what both do."""
    rows = searchable(lib, 1)
    a = rows.select("id", F.col("alltext").ilike("%the%").alias("a"), (F.col("title").ilike("%the%") | F.col("filename").ilike("%the%") | F.col("creator").ilike("%the%")).alias("b"))
    return a.agg(F.count_if("a").alias("first"), F.count_if("b").alias("second"), F.count_if(F.col("a") & F.col("b")).alias("both"))
