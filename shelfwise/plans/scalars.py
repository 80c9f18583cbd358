"""Scalar functions over whole tables."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions import classify as C
from shelfwise.functions import numbers as N
from shelfwise.functions import text as T
from shelfwise.functions.movie import movie_header
from shelfwise.plans import twins
from shelfwise.registry import query
from shelfwise.sources.catalog import Library


def titles(lib: Library) -> DataFrame:
    return lib.video.select("id", "title", "filename", "file_size", "duration")


@query("str_01_normal_term", "SELECT id, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS term FROM video")
def normal_term(lib: Library) -> DataFrame:
    return titles(lib).select("id", T.collapsed(F.col("title")).alias("term"))


NAMES = "CASE id % 6 WHEN 0 THEN filename WHEN 1 THEN '/a/b\\' || source || '_-_' || id || '_VOE.mp4' WHEN 2 THEN 'Watch_' || source || '_-_The_' || id || '.mkv' WHEN 3 THEN 'watch ' || source || ' - part - ' || id || '.mp4' WHEN 4 THEN 'plain__name_' || id || '.avi' ELSE 'x' || id || '_-_VOE___CDN.mp4' END"


def names(lib: Library) -> DataFrame:
    return lib.video.select("id", F.expr(NAMES.replace("\\", "\\\\").replace("||", "||")).alias("name"))


CLEAN = "regexp_replace(regexp_replace(regexp_replace(name, '^.*[/\\\\]', ''), '(?i)_-_(VOE|CDN|Content_Delivery|Video_Cloud)[^.]*\\.[^.]+$', ''), '^Watch_', '')"
STEM = f"regexp_replace({CLEAN}, '\\.[^.]+$', '')"
TITLE = f"trim(regexp_replace(regexp_replace({STEM}, '_+', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("str_02_clean_filename", f"WITH n AS (SELECT id, {NAMES} AS name FROM video) SELECT id, {CLEAN} AS name FROM n")
def clean_filename(lib: Library) -> DataFrame:
    return names(lib).select("id", T.clean_filename(F.col("name")).alias("name"))


@query("str_03_title", f"WITH n AS (SELECT id, {NAMES} AS name FROM video) SELECT id, {TITLE} AS title FROM n")
def title(lib: Library) -> DataFrame:
    return names(lib).select("id", T.title_of(F.col("name")).alias("title"))


@query("str_04_watch_prefix", f"WITH n AS (SELECT id, {NAMES} AS name FROM video) SELECT id, trim(regexp_replace(name, '(?i)^watch[_\\s]+', '')) AS name FROM n")
def watch_prefix(lib: Library) -> DataFrame:
    return names(lib).select("id", T.without_watch(F.col("name")).alias("name"))


def tidy(x: str, under: bool = True) -> str:
    inner = f"regexp_replace({x}, '_+', ' ', 'g')" if under else x
    return f"trim(regexp_replace({inner}, '\\s+', ' ', 'g'))"


@query("str_05_parsed_names", f"""WITH n AS (SELECT id, {NAMES} AS name FROM video), s AS (SELECT id, name, {STEM} AS s, {TITLE} AS plain FROM n),
    p AS (SELECT *, instr(s, ' - ') AS a, instr(s, '_-_') AS b FROM s),
    q AS (SELECT *, CASE WHEN a > 1 AND {tidy('substr(s, a + 3)', False)} <> '' THEN 1 WHEN b > 1 AND {tidy('substr(s, b + 3)')} <> '' THEN 2 ELSE 3 END AS k FROM p)
    SELECT id, CASE k WHEN 1 THEN nullif(trim(regexp_replace({tidy('substr(s, 1, a - 1)')}, '(?i)^watch[_\\s]+', '')), '') WHEN 2 THEN nullif(trim(regexp_replace({tidy('substr(s, 1, b - 1)')}, '(?i)^watch[_\\s]+', '')), '') END AS creator,
    CASE k WHEN 1 THEN {tidy('substr(s, a + 3)', False)} WHEN 2 THEN {tidy('substr(s, b + 3)')} ELSE plain END AS title FROM q""")
def parsed(lib: Library) -> DataFrame:
    return names(lib).select("id", T.parsed_name(F.col("name")).alias("p")).select("id", "p.*")


@query("str_06_slug", f"SELECT id, {twins.slug('title')} AS slug FROM video")
def slugs(lib: Library) -> DataFrame:
    return titles(lib).select("id", T.slug(F.col("title")).alias("slug"))


@query("str_07_guessed_creator", f"""WITH n AS (SELECT id, {NAMES} AS name FROM video), s AS (SELECT id, regexp_replace(name, '\\.[^.]+$', '') AS s FROM n)
    SELECT id, coalesce(nullif(trim(regexp_extract(s, '^_?([^_]+(?:[ _][^_]+)*?)_[–—-]\\s*', 1)), ''), nullif(trim(regexp_extract(s, '^_([^_]+(?:[ _][^_]+)*?)__', 1)), '')) AS creator FROM s""")
def guessed(lib: Library) -> DataFrame:
    return names(lib).select("id", T.guessed_creator(F.col("name")).alias("creator"))


@query("str_08_creator_name", """WITH n AS (SELECT id, CASE id % 5 WHEN 0 THEN 'POV - ' || source WHEN 1 THEN 'hot_girl_joi' WHEN 2 THEN 'jointly ' || source ELSE source || '__b  c' END AS name FROM video)
    SELECT id, coalesce(nullif(trim(regexp_replace(regexp_replace(trim(regexp_replace(name, '(?i)^(joi|bbc|hot[_ ]girl[_ ]joi|pov)[\\s_\\-–—]*', '')), '_+', ' ', 'g'), '\\s+', ' ', 'g')), ''), 'Unknown Creator') AS name FROM n""")
def creator_names(lib: Library) -> DataFrame:
    rows = lib.video.select("id", F.expr("CASE id % 5 WHEN 0 THEN 'POV - ' || source WHEN 1 THEN 'hot_girl_joi' WHEN 2 THEN 'jointly ' || source ELSE source || '__b  c' END").alias("name"))
    return rows.select("id", T.creator_name(F.col("name")).alias("name"))


@query("str_09_comparison_key", f"WITH n AS (SELECT id, {NAMES} AS name FROM video) SELECT id, {twins.comparison_key('name')} AS key FROM n")
def comparison_keys(lib: Library) -> DataFrame:
    """Compatibility normalisation and a fixpoint of stripped markers (str_10); odd characters are checked by cases."""
    return names(lib).select("id", T.normal_title(F.col("name")).alias("key"))


@query("str_11_extension", f"WITH n AS (SELECT id, {NAMES} AS name FROM video) SELECT id, lower(regexp_extract(name, '^.+\\.([^.]+)$', 1)) AS extension FROM n")
def extensions(lib: Library) -> DataFrame:
    return names(lib).select("id", T.extension(F.col("name")).alias("extension"))


@query("str_12_title_similarity", f"WITH v AS (SELECT a.id, lower(a.title) AS a, lower(b.title) AS b FROM video a JOIN video b ON b.id = a.id + 1) SELECT v.id, s.percent AS similarity FROM v JOIN {twins.similarity('v')} s ON s.a = v.a AND s.b = v.b")
def similarities(lib: Library) -> DataFrame:
    """Neighbours by id."""
    nxt = lib.video.select((F.col("id") - 1).alias("id"), F.col("title").alias("other"))
    return titles(lib).join(nxt, "id").select("id", T.title_similarity(F.lower("title"), F.lower("other")).alias("similarity"))


DOWNLOADS = "CASE id % 8 WHEN 0 THEN 'a/b:c*' || id || '.mp4' WHEN 1 THEN repeat('long ', 50) || id || '.mkv' WHEN 2 THEN '  ..' WHEN 3 THEN NULL WHEN 4 THEN '..hidden ' || id || '. .' WHEN 5 THEN repeat('x', 200) || '.elevenchars' WHEN 6 THEN 'tab' || chr(9) || chr(8203) || 'q\"' || id || '.MP4' ELSE filename END"
SAFE = "regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({0}, ''), '^.*[/\\\\]', '', 's'), '[<>:\"/\\\\|?*\\x00-\\x1f]', '', 'g'), '[\\x{{7f}}-\\x{{9f}}\\x{{200b}}-\\x{{200f}}\\x{{2028}}-\\x{{202f}}\\x{{feff}}]', '', 'g'), '^\\.+', ''), ' ' || chr(9) || chr(160)), '[. ]+$', '')"


def downloads(lib: Library) -> DataFrame:
    return lib.video.select("id", F.expr(DOWNLOADS).alias("name"), F.expr("CASE WHEN id % 3 = 0 THEN 'Title: ' || id WHEN id % 3 = 1 THEN 'Title.v' || id END").alias("title"), F.expr("CASE id % 4 WHEN 0 THEN '.M-KV ' WHEN 2 THEN 'twelve_letters' WHEN 3 THEN 'mp4' END").alias("ending"))


@query("str_13_download_name", f"""WITH n AS (SELECT id, {DOWNLOADS} AS name, CASE WHEN id % 3 = 0 THEN 'Title: ' || id WHEN id % 3 = 1 THEN 'Title.v' || id END AS title, CASE id % 4 WHEN 0 THEN 'mkv' WHEN 2 THEN '' WHEN 3 THEN 'mp4' ELSE '' END AS tail FROM video),
    c AS (SELECT id, {SAFE.format('name')} AS own, {SAFE.format('title')} AS other, tail FROM n),
    f AS (SELECT id, CASE WHEN own <> '' THEN own WHEN other = '' THEN 'video.bin' WHEN tail <> '' AND regexp_extract(other, '^.+(\\.[^.]{{1,10}})$', 1) = '' THEN other || '.' || tail ELSE other END AS name FROM c),
    e AS (SELECT id, name, regexp_extract(name, '^.+(\\.[^.]{{1,10}})$', 1) AS e FROM f)
    SELECT id, CASE WHEN length(name) > 180 THEN substr(name, 1, least(length(name) - length(e), 180 - length(e))) || e ELSE name END AS name FROM e""")
def download_names(lib: Library) -> DataFrame:
    return downloads(lib).select("id", T.download_name(F.col("name"), F.col("title"), F.col("ending")).alias("name"))


QUOTED = "CASE id % 6 WHEN 0 THEN 'a\"b' || chr(92) || id || '.mp4' WHEN 1 THEN 'é (' || id || ')!.mp4' WHEN 2 THEN '' WHEN 3 THEN '🙂' || id || '~*.mp4' WHEN 4 THEN '\"' ELSE filename END"


@query("str_14_content_disposition", f"""WITH n AS (SELECT id, {QUOTED} AS name FROM video), s AS (SELECT id, name, replace(replace(name, chr(92), ''), '"', '') AS s FROM n),
    a AS (SELECT *, coalesce(nullif(array_to_string(list_transform(string_split(s, ''), lambda c: CASE WHEN unicode(c) > 65535 THEN '__' WHEN c <> '' AND (unicode(c) < 32 OR unicode(c) > 126) THEN '_' ELSE c END), ''), ''), 'download') AS a FROM s)
    SELECT id, CASE WHEN s <> '' AND a = s THEN 'attachment; filename="' || s || '"' ELSE 'attachment; filename="' || a || '"; filename*=UTF-8' || chr(39) || chr(39) || replace(replace(replace(replace(replace(url_encode(name), '%21', '!'), '%27', chr(39)), '%28', '('), '%29', ')'), '%2A', '*') END AS header FROM a""")
def dispositions(lib: Library) -> DataFrame:
    return lib.video.select("id", F.expr(QUOTED).alias("name"), "filename").select("id", T.content_disposition(F.col("name")).alias("header"))


@query("str_15_safe_reason", "SELECT id, substr(trim(regexp_replace(regexp_replace('failed  at https://h/' || id || '?k=1 ' || title, 'https?://\\S+', '[url]', 'g'), '\\s+', ' ', 'g')), 1, 40) AS reason FROM video")
def reasons(lib: Library) -> DataFrame:
    said = F.concat(F.lit("failed  at https://h/"), F.col("id").cast("string"), F.lit("?k=1 "), F.col("title"))
    return titles(lib).select("id", T.safe_reason(said, 40).alias("reason"))


@query("str_16_label", "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 2 THEN substr(c_name || repeat('!', 60), 1, 50) WHEN 3 THEN 'MEGA account' ELSE 'user' || c_custkey END AS label FROM customer")
def labels(lib: Library) -> DataFrame:
    rows = lib.raw("customer").select(F.col("c_custkey").alias("id"), F.expr("CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN concat(' ', c_name, repeat('!', 60)) ELSE '' END").alias("label"), F.expr("concat(CASE WHEN c_custkey % 4 = 3 THEN '' ELSE concat('user', c_custkey) END, '@example.com')").alias("email"))
    return rows.select("id", T.label_of(F.col("label"), F.col("email")).alias("label"))


@query("str_17_folder_name", "SELECT id, CASE WHEN length(trim(regexp_replace(n, '\\s+', ' ', 'g'))) BETWEEN 1 AND 100 THEN trim(regexp_replace(n, '\\s+', ' ', 'g')) END AS name FROM (SELECT id, CASE id % 3 WHEN 0 THEN '   ' WHEN 1 THEN repeat('x', 101) ELSE ' a   ' || id END AS n FROM video)")
def folder_names(lib: Library) -> DataFrame:
    return lib.video.select("id", T.folder_name(F.expr("CASE id % 3 WHEN 0 THEN '   ' WHEN 1 THEN repeat('x', 101) ELSE ' a   ' || id END")).alias("name"))


@query("str_18_email", "SELECT c_custkey AS id, lower(trim('  ' || c_name || '@Example.COM ')) AS email FROM customer")
def emails(lib: Library) -> DataFrame:
    return lib.raw("customer").select(F.col("c_custkey").alias("id"), T.email_key(F.concat(F.lit("  "), "c_name", F.lit("@Example.COM "))).alias("email"))


@query("str_19_clock_and_bytes", """SELECT id, CASE WHEN s IS NULL OR s < 0 THEN NULL WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS clock,
    CASE WHEN b IS NULL OR b < 0 THEN NULL WHEN b >= 1048576 AND b / 1048576.0 < 10 THEN printf('%.1f MB', floor(b / 1048576.0 * 10 + 0.5) / 10) WHEN b >= 1048576 THEN printf('%d MB', CAST(floor(b / 1048576.0 + 0.5) AS BIGINT)) WHEN b >= 1024 AND b / 1024.0 < 10 THEN printf('%.1f KB', floor(b / 1024.0 * 10 + 0.5) / 10) WHEN b >= 1024 THEN printf('%d KB', CAST(floor(b / 1024.0 + 0.5) AS BIGINT)) ELSE printf('%d B', b) END AS size
    FROM (SELECT id, CASE id % 17 WHEN 3 THEN 0 WHEN 5 THEN -id - 1 ELSE duration * 7 END AS s, CASE id % 19 WHEN 3 THEN NULL WHEN 4 THEN -1 ELSE file_size * (id % 100) END AS b FROM video)""")
def clocks(lib: Library) -> DataFrame:
    return titles(lib).select("id", T.clock(F.expr("CASE id % 17 WHEN 3 THEN 0 WHEN 5 THEN -id - 1 ELSE duration * 7 END")).alias("clock"), T.bytes_text(F.expr("CASE id % 19 WHEN 3 THEN NULL WHEN 4 THEN -1 ELSE file_size * (id % 100) END")).alias("size"))


@query("str_20_vtt_time", "SELECT id, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS at FROM (SELECT id, file_size * 977 AS ms FROM video)")
def vtt(lib: Library) -> DataFrame:
    return titles(lib).select("id", T.vtt_time(F.col("file_size") * 977).alias("at"))


@query("str_21_fnv1a", """WITH u AS (SELECT id, list_transform(list_filter(string_split(title, ''), lambda c: c <> ''), lambda c: CAST(unicode(c) AS BIGINT)) AS points FROM video)
    SELECT id, lower(to_hex(list_reduce(flatten(list_transform(points, lambda p: CASE WHEN p > 65535 THEN [55296 + (p - 65536) // 1024, 56320 + (p - 65536) % 1024] ELSE [p] END)), lambda h, p: (xor(h, p) * 16777619) % 4294967296, CAST(2166136261 AS BIGINT)))) AS hash FROM u""")
def fnv(lib: Library) -> DataFrame:
    return titles(lib).select("id", T.fnv1a(F.col("title")).alias("hash"))


ATTRIBUTES = "CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN '703:0*t' || id || '/703:1*p/715:8*m' WHEN 2 THEN '7:0*a/7:0*b' || id || '/x/:1*q/7:8*' WHEN 3 THEN '7:8*m/7:9*n' ELSE '7:1*p*' || id END"


@query("str_22_attribute_handles", """SELECT id, CASE id % 5 WHEN 1 THEN 't' || id WHEN 2 THEN 'b' || id END AS thumbnail, CASE id % 5 WHEN 1 THEN 'p' WHEN 4 THEN 'p*' || id END AS preview, CASE WHEN id % 5 IN (1, 3) THEN 'm' END AS media FROM video""")
def handles(lib: Library) -> DataFrame:
    return lib.video.select("id", F.expr(ATTRIBUTES).alias("fa")).select("id", T.named_handles(F.col("fa")).alias("h")).select("id", "h.*")


TRIGRAMS = "list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query("str_23_trigram_similarity", f"WITH t AS (SELECT id, {TRIGRAMS.format('title')} AS a, {TRIGRAMS.format(chr(39) + 'the tion' + chr(39))} AS b FROM video) SELECT id, round(coalesce(len(list_intersect(a, b)) / nullif(len(a) + len(b) - len(list_intersect(a, b)), 0), 0), 9) AS similarity FROM t")
def trigram(lib: Library) -> DataFrame:
    rows = titles(lib).select("id", T.trigrams(F.col("title")).alias("a"), T.trigrams(F.lit("the tion")).alias("b"))
    return rows.select("id", F.round(T.trigram_similarity(F.col("a"), F.col("b")), 9).alias("similarity"))


LINK = "CASE id % 8 WHEN 0 THEN 'https://example.com/file/' || id WHEN 1 THEN ' https://mega.nz/file/AbCd' || lpad(CAST(id % 10000 AS STRING), 4, '0') || '#' || repeat('k', 43) || ' ' WHEN 2 THEN 'http://www.mega.co.nz/file/Ab-d_' || lpad(CAST(id % 1000 AS STRING), 3, '0') || '#' || repeat('k', 32 + CAST(id % 40 AS INT)) WHEN 3 THEN 'https://mega.nz/embed/AbCdEfGh#' || repeat('k', 43) WHEN 4 THEN 'https://mega.nz/file/AbCdEfGh!' || repeat('k', 43) WHEN 5 THEN 'https://mega.io/file/AbCdEfGh#' || repeat('k', 43) WHEN 6 THEN NULL ELSE 'https://mega.nz/file/AbCdEfGh#' || repeat('k', 43) || '/x' END"


@query("str_25_link_parts", """WITH p AS (SELECT id, CASE id % 8 WHEN 1 THEN 'AbCd' || lpad(CAST(id % 10000 AS VARCHAR), 4, '0') WHEN 2 THEN CASE WHEN id % 40 <= 32 THEN 'Ab-d_' || lpad(CAST(id % 1000 AS VARCHAR), 3, '0') END END AS node, CASE id % 8 WHEN 1 THEN repeat('k', 43) WHEN 2 THEN CASE WHEN id % 40 <= 32 THEN repeat('k', CAST(32 + id % 40 AS INTEGER)) END END AS key FROM video)
    SELECT id, node, key, 'https://mega.nz/embed/' || node || '#' || key AS embed, 'https://mega.nz/embed/' || node || '#' || key || '!1a' AS autoplay, 'https://mega.nz/embed/' || node || '#' || key || '!1a1m' AS preview FROM p""")
def links(lib: Library) -> DataFrame:
    url = F.col("url")
    rows = lib.video.select("id", F.expr(LINK).alias("url"))
    return rows.select("id", T.link_parts(url)["id"].alias("node"), T.link_parts(url)["key"].alias("key"), T.embed_url(url).alias("embed"), T.embed_url(url, autoplay=True).alias("autoplay"), T.preview_url(url).alias("preview"))


FAULTS = ("ESID (-15): Invalid session", "EMFAREQUIRED (-26)", "ENOENT (-9): not found", "EBLOCKED (-16)", "Invalid Credentials given", "EAGAIN (-3): congestion", "Too Busy", "connect ECONNRESET 1.2.3.4", "EKEY (-14)", "Server returned error 500")


@query("str_26_error_kind", """WITH f AS (SELECT id, id % 10 AS k, id % 3 = 0 AS login FROM video)
    SELECT id, CASE WHEN k = 0 THEN 'session-expired' WHEN k = 1 THEN 'mfa' WHEN login AND k IN (2, 3, 4) THEN 'auth' WHEN k IN (5, 6, 7, 9) THEN 'transient' WHEN login THEN 'auth' ELSE 'unknown' END AS kind FROM f""")
def error_kinds(lib: Library) -> DataFrame:
    """What an account's error is depends on where it came from: -9 is a wrong password while logging in, a missing file later."""
    said = F.concat(one_of(FAULTS, F.col("id") % 10), F.lit(" in "), F.coalesce(F.nullif(F.length("title"), F.lit(-1)), F.lit(0)).cast("string"), F.lit(" steps"))
    return titles(lib).select("id", T.error_kind(said, F.col("id") % 3 == 0).alias("kind"))


@query("mat_01_quotas", """WITH c AS (SELECT u.user_id, count(h.video_id) > 0 AS watched FROM (SELECT r_regionkey AS user_id FROM region UNION ALL SELECT 9) u LEFT JOIN history h ON h.user_id = u.user_id GROUP BY u.user_id)
    SELECT user_id, unnest(['recent', 'history', 'related', 'random', 'variety']) AS source, unnest(CASE WHEN watched THEN [4, 2, 4, 7, 7] ELSE [4, 0, 4, 8, 8] END) AS quota FROM c""")
def feed_quotas(lib: Library) -> DataFrame:
    """A page's places by source for every user, with a watch history and without (user 9 has none)."""
    users = lib.raw("region").select(F.col("r_regionkey").alias("user_id")).union(lib.spark.range(9, 10))
    watched = users.join(lib.history.select("user_id", F.lit(True).alias("watched")).distinct(), "user_id", "left")
    shares = lambda has: F.array(*[F.struct(F.lit(s).alias("source"), F.lit(n).alias("quota")) for s, n in N.quotas(24, has).items()])
    return watched.select("user_id", F.explode(F.when(F.col("watched"), shares(True)).otherwise(shares(False))).alias("q")).select("user_id", "q.*")


@query("mat_02_ladders", """SELECT id, [800, 800, 2000, 5000, 10000, 15000][CAST(least(attempts + recoveries, 5) AS INTEGER) + 1] AS resume, [1000, 2000, 4000][CAST(least(recoveries, 2) AS INTEGER) + 1] AS player FROM job""")
def ladders(lib: Library) -> DataFrame:
    """Fixed waits of a download that goes on and of the player, whose attempts count from 0."""
    return lib.job.select("id", N.ladder(N.RESUME_LADDER, F.col("attempts") + F.col("recoveries")).alias("resume"), N.ladder(N.PLAYER_LADDER, F.col("recoveries") + 1).alias("player"))


@query("mat_02_backoff", "SELECT id, CAST(least(300 * pow(2, greatest(attempts, 1) - 1), 1000) AS BIGINT) AS wait, CAST(least(60 * pow(2, greatest(recoveries + 1, 1) - 1), 600) AS BIGINT) AS recovery FROM job")
def backoffs(lib: Library) -> DataFrame:
    return lib.job.select("id", N.backoff(300, F.col("attempts"), 1000).alias("wait"), N.backoff(60, F.col("recoveries") + 1, 600).alias("recovery"))


@query("mat_03_candidate_times", "SELECT id, CASE WHEN duration > 0 THEN list_sort(list_distinct(list_transform([0.25, 0.5, 0.75], lambda f: CAST(greatest(0, least(floor(duration * f + 0.5), greatest(0, duration - 5))) AS BIGINT)))) ELSE [10, 30, 60] END AS times FROM video")
def candidate_times(lib: Library) -> DataFrame:
    return titles(lib).select("id", N.candidate_times(F.col("duration"), 4).alias("times"))


@query("mat_03_candidate_seeks", """WITH d AS (SELECT id, CASE id % 5 WHEN 0 THEN duration / 40.0 ELSE duration END AS d FROM video), r AS (SELECT id, CASE WHEN d > 4 THEN [0.05 * d, 0.25 * d, 0.5 * d, 0.75 * d, d - 2] ELSE [2, 10, 30, 60, 180] END AS r FROM d),
    s AS (SELECT id, unnest(list_transform(r, lambda t: CAST(greatest(1, floor(t + 0.5)) AS BIGINT))) AS t, generate_subscripts(r, 1) AS i FROM r), f AS (SELECT id, t, min(i) AS i FROM s GROUP BY id, t) SELECT id, list(t ORDER BY i) AS seeks FROM f GROUP BY id""")
def candidate_seeks(lib: Library) -> DataFrame:
    return titles(lib).select("id", N.candidate_seeks(F.expr("CASE id % 5 WHEN 0 THEN duration / 40.0D ELSE CAST(duration AS DOUBLE) END")).alias("seeks"))


@query("mat_05_byte_window", """WITH w AS (SELECT id, file_size * 1000 AS size, (id % 11) / 10.0 AS f FROM video), x AS (SELECT id, size, f, least(greatest(ceil(size * 0.03), least(4194304, size)), 6000000, size) AS want FROM w)
    SELECT id, CAST(greatest(0, least(floor(least(1.0, f) * size) - floor(least(1.0, f) * size) % 752, (size - want) - (size - want) % 752)) AS BIGINT) AS start, CAST(least(want, size - greatest(0, least(floor(least(1.0, f) * size) - floor(least(1.0, f) * size) % 752, (size - want) - (size - want) % 752))) AS BIGINT) AS length FROM x""")
def byte_windows(lib: Library) -> DataFrame:
    w = N.byte_window((F.col("id") % 11) / 10.0, F.col("file_size") * 1000, 6_000_000, 752)
    return titles(lib).select("id", w.alias("w")).select("id", "w.*")


@query("mat_06_merged_windows", """WITH RECURSIVE w AS (SELECT stream, first_byte AS a, first_byte + (end_byte - first_byte) // 2 AS b, row_number() OVER (PARTITION BY stream ORDER BY first_byte, end_byte) AS n FROM fragment WHERE end_byte - first_byte >= 2),
    m AS (SELECT stream, n, a, b, CAST(1 AS INTEGER) AS windows FROM w WHERE n = 1 UNION ALL
        SELECT w.stream, w.n, CASE WHEN w.a - m.b <= 1500 AND greatest(m.b, w.b) - m.a <= 8000 THEN m.a ELSE w.a END, CASE WHEN w.a - m.b <= 1500 AND greatest(m.b, w.b) - m.a <= 8000 THEN greatest(m.b, w.b) ELSE w.b END,
            windows + CASE WHEN w.a - m.b <= 1500 AND greatest(m.b, w.b) - m.a <= 8000 THEN 0 ELSE 1 END FROM m JOIN w ON w.stream = m.stream AND w.n = m.n + 1)
    SELECT stream, max(windows) AS windows FROM m GROUP BY stream""")
def merged(lib: Library) -> DataFrame:
    """A greedy fold with a cap on the merged length, so no gaps-and-islands window."""
    each = lib.fragment.groupBy("stream").agg(F.collect_list(F.struct(F.col("first_byte").alias("start"), ((F.col("end_byte") - F.col("first_byte")) / 2).cast("long").alias("length"))).alias("w"))
    return each.select("stream", F.size(N.merged_windows(F.col("w"), 8000, 1500)).alias("windows"))


@query("mat_08_canvas", """WITH p AS (SELECT p_partkey AS id, p_size * 40 AS w, p_partkey % 50 * 30 + 2 AS h FROM part), s AS (SELECT *, least(1.0, CASE WHEN h > w THEN 360 ELSE 640 END / greatest(w, 2), CASE WHEN h > w THEN 640 ELSE 360 END / greatest(h, 2)) AS s FROM p)
    SELECT id, CAST(greatest(2, floor(greatest(w, 2) * s / 2 + 0.5) * 2) AS BIGINT) AS width, CAST(greatest(2, floor(greatest(h, 2) * s / 2 + 0.5) * 2) AS BIGINT) AS height, CAST(least(30, greatest(1, floor(CASE WHEN w % 7 > 0 THEN w % 7 * 11.99 ELSE 30 END + 0.01))) AS INTEGER) AS fps, coalesce(w > 0 AND h > 0 AND abs(w / h - 16 / 9) <= 0.1, FALSE) AS wide FROM s""")
def canvases(lib: Library) -> DataFrame:
    rows = lib.raw("part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 40).alias("w"), (F.col("p_partkey") % 50 * 30 + 2).alias("h"))
    return rows.select("id", N.canvas(F.col("w"), F.col("h")).alias("c"), N.frame_rate(F.when(F.col("w") % 7 > 0, F.col("w") % 7 * F.lit(11.99)), 30).alias("fps"), N.is_widescreen(F.col("w"), F.col("h")).alias("wide")).select("id", "c.*", "fps", "wide")


@query("mat_09_sprite_grid", "SELECT stream, idx, (idx - 1) % 3 * 160 AS x, (idx - 1) // 3 * 90 AS y FROM fragment")
def sprites(lib: Library) -> DataFrame:
    """Where each cue's picture lies in a sheet three pictures wide."""
    tiles = lib.fragment.groupBy("stream").agg(F.max("idx").alias("n")).select("stream", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    grid = tiles.select("stream", (F.col("i") + 1).alias("idx"), (F.col("i") % 3 * 160).alias("x"), (F.floor(F.col("i") / 3) * 90).cast("int").alias("y"))
    return lib.fragment.select("stream", "idx").join(grid, ["stream", "idx"])


@query("mat_09_sprite_plan", """WITH d AS (SELECT id, greatest(0.5, CASE id % 5 WHEN 0 THEN 0.2 WHEN 1 THEN duration * 20.5 ELSE duration END) AS d FROM video WHERE duration IS NOT NULL), i AS (SELECT *, greatest(2, ceil(d / 60)) AS i FROM d), c AS (SELECT *, greatest(1, least(60, floor(d / i))) AS c FROM i)
    SELECT id, CAST(i AS BIGINT) AS interval, CAST(c AS BIGINT) AS count, CAST(ceil(c / 8.0) AS BIGINT) AS rows FROM c""")
def sprite_plans(lib: Library) -> DataFrame:
    seconds = F.expr("CASE id % 5 WHEN 0 THEN 0.2D WHEN 1 THEN duration * 20.5D ELSE CAST(duration AS DOUBLE) END")
    return titles(lib).where("duration IS NOT NULL").select("id", N.sprite_plan(seconds, 8, 60, 2).alias("p")).select("id", "p.*")


BOX = "concat(lpad(hex(8 + length({1}) div 2), 8, '0'), '{0}', {1})"
_LONG = "lpad(hex(CAST({0} AS BIGINT)), {1}, '0')"


def _box(kind: str, body: str) -> str:
    return BOX.format(kind.encode().hex().upper(), f"({body})")


def films(lib: Library) -> DataFrame:
    """id, data: the first bytes of files with headers of both versions, with media before or behind them, cut short, without a duration, and none at all."""
    scale, length = _LONG.format("600 + id % 7", 8), "duration * (600 + id % 7)"
    header = f"CASE WHEN id % 2 = 0 THEN concat('00000000', repeat('00', 8), {scale}, {_LONG.format(length, 8)}) ELSE concat('01000000', repeat('00', 16), {scale}, {_LONG.format(length, 16)}) END"
    track = lambda number, ticks: _box("trak", f"concat({_box('tkhd', f'concat(repeat(chr(48), 24), {_LONG.format(number, 8)})')}, {_box('mdia', _box('mdhd', f'concat(repeat(chr(48), 24), {_LONG.format(ticks, 8)})'))})")
    movie = _box("moov", f"concat({_box('mvhd', header)}, {track('id % 5 + 1', '90000')}, {track('9', '48000')})")
    media, kind = _box("mdat", "repeat('AB', CAST(id % 30 AS INT))"), _box("ftyp", "'69736F6D'")
    whole = f"CASE id % 6 WHEN 0 THEN concat({kind}, {media}, {movie}) WHEN 1 THEN concat({kind}, {movie}, {media}) WHEN 2 THEN left(concat({kind}, {movie}), 60) WHEN 3 THEN {kind} WHEN 4 THEN NULL ELSE {movie} END"
    return titles(lib).where("duration IS NOT NULL").withColumn("duration", F.expr("CASE WHEN id % 11 = 0 THEN 0 ELSE duration END")).select("id", F.unhex(F.expr(whole)).alias("data"))


@query("mat_14_movie_header", """SELECT id, CASE WHEN id % 6 IN (0, 1, 5) AND id % 11 <> 0 AND duration > 0 THEN CAST(duration AS DOUBLE) END AS seconds, CASE WHEN id % 6 = 0 THEN 'not-faststart' WHEN id % 6 IN (1, 5) THEN 'faststart' ELSE 'unknown' END AS faststart,
    CASE WHEN id % 6 IN (0, 1, 5) THEN CAST(id % 5 + 1 AS INTEGER) END AS video, CASE WHEN id % 6 IN (0, 1, 5) THEN 48000 END AS sound FROM video WHERE duration IS NOT NULL""")
def movie_headers(lib: Library) -> DataFrame:
    """Durations, the order of boxes and the tracks' clocks from files' first bytes."""
    return films(lib).select("id", movie_header("data").alias("h")).select("id", "h.seconds", "h.faststart", "h.video", F.try_element_at("h.clocks", F.lit(9)).alias("sound"))


def vtt_sheets(cues: DataFrame, columns: int, width: int, height: int) -> DataFrame:
    """sheet, text: a WebVTT document for each sheet of pictures.

    cues: sheet, url, k (picture's number from 0), start, interval and duration (ms), irregular (whether start is a time of its own, not a multiple of the
    interval). A cue ends with the next one or the duration; the first that would not last ends the document.
    """
    own = Window.partitionBy("sheet").orderBy("k")
    after = F.when(F.col("irregular"), F.coalesce(F.lead("start").over(own), F.col("duration"))).otherwise(F.col("start") + F.col("interval"))
    rows = cues.withColumn("end", F.least(after, F.col("duration")))
    rows = rows.withColumn("over", F.max((F.col("end") <= F.col("start")).cast("int")).over(own)).where("over = 0")
    place = F.concat_ws(",", F.col("k") % columns * width, F.floor(F.col("k") / columns) * height, F.lit(width), F.lit(height))
    cue = F.concat(T.vtt_time(F.col("start")), F.lit(" --> "), T.vtt_time(F.col("end")), F.lit("\n"), "url", F.lit("#xywh="), place)
    texts = rows.groupBy("sheet").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", cue.alias("cue")))), lambda c: c["cue"]), "\n\n").alias("cues"))
    return cues.select("sheet").distinct().join(texts, "sheet", "left").select("sheet", F.concat(F.lit("WEBVTT\n\n"), F.coalesce("cues", F.lit("")), F.lit("\n")).alias("text"))


@query("mat_09_sprite_vtt", """WITH c AS (SELECT stream, idx - 1 AS k, CASE WHEN stream % 2 = 0 THEN start_time * 977 ELSE (idx - 1) * 10500 END AS start, stream % 2 = 0 AS irregular, stream % 40 * 1500 AS duration FROM fragment),
    e AS (SELECT *, least(CASE WHEN irregular THEN coalesce(lead(start) OVER w, duration) ELSE start + 10500 END, duration) AS finish FROM c WINDOW w AS (PARTITION BY stream ORDER BY k)), o AS (SELECT *, bool_or(finish <= start) OVER (PARTITION BY stream ORDER BY k) AS over FROM e),
    t AS (SELECT stream, k, printf('%02d:%02d:%02d.%03d', start // 3600000, start // 60000 % 60, start // 1000 % 60, start % 1000) || ' --> ' || printf('%02d:%02d:%02d.%03d', finish // 3600000, finish // 60000 % 60, finish // 1000 % 60, finish % 1000) || chr(10) || '/s/' || stream || '.jpg#xywh=' || (k % 3 * 160) || ',' || (k // 3 * 90) || ',160,90' AS cue FROM o WHERE NOT over)
    SELECT s.stream AS sheet, 'WEBVTT' || chr(10) || chr(10) || coalesce((SELECT string_agg(cue, chr(10) || chr(10) ORDER BY k) FROM t WHERE t.stream = s.stream), '') || chr(10) AS text FROM (SELECT DISTINCT stream FROM fragment) s""")
def sprite_vtt(lib: Library) -> DataFrame:
    """Sheets with times of their own and with a fixed interval; one of no duration has no cues."""
    rows = lib.fragment.select(
        F.col("stream").alias("sheet"), F.concat(F.lit("/s/"), "stream", F.lit(".jpg")).alias("url"), (F.col("idx") - 1).alias("k"), F.expr("CASE WHEN stream % 2 = 0 THEN start_time * 977 ELSE (idx - 1) * 10500 END").alias("start"),
        F.lit(10_500).alias("interval"), (F.col("stream") % 40 * 1500).alias("duration"), (F.col("stream") % 2 == 0).alias("irregular"),
    )
    return vtt_sheets(rows, 3, 160, 90)


@query("mat_10_signature_distance", "SELECT vec_id AS id, CASE WHEN vec_id % 9 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE round(list_sum(list_transform(embedding[1:greatest(1, vec_id % 80)], lambda x: abs(CAST(x AS DOUBLE) - 0.5))) / least(len(embedding), greatest(1, vec_id % 80)), 6) END AS distance FROM embeddings")
def distances(lib: Library) -> DataFrame:
    """Against a picture of another length; one of no length is like nothing."""
    other = F.expr("CASE WHEN vec_id % 9 = 0 THEN CAST(array() AS array<double>) ELSE array_repeat(0.5D, CAST(greatest(1, vec_id % 80) AS INT)) END")
    rows = lib.raw("embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("a"), other.alias("b"))
    return rows.select("id", F.round(N.signature_distance(F.col("a"), F.col("b")), 6).alias("distance"))


UNITS = "CASE id % 7 WHEN 0 THEN 0 WHEN 1 THEN file_size % 1000 WHEN 2 THEN 1000 + file_size WHEN 3 THEN 1000000 + file_size * 1000 WHEN 4 THEN 1000 WHEN 5 THEN 999999 WHEN 6 THEN NULL END"


@query("mat_11_duration_units", f"SELECT id, CAST(CASE WHEN v > 0 THEN floor(CASE WHEN v >= 1000000 THEN v / 1000000 WHEN v >= 1000 THEN v / 1000 ELSE v END + 0.5) END AS BIGINT) AS seconds FROM (SELECT id, {UNITS} AS v FROM video)")
def duration_units(lib: Library) -> DataFrame:
    return lib.video.select("id", N.duration_seconds(F.expr(UNITS)).alias("seconds"))


RANGES = "CASE id % 11 WHEN 0 THEN 'bytes=' || id || '-' || (id + 99) WHEN 1 THEN 'bytes=-10' WHEN 2 THEN NULL WHEN 3 THEN 'bytes=9-2' WHEN 4 THEN 'bytes=0-' WHEN 5 THEN '' WHEN 6 THEN 'bytes=-0' WHEN 7 THEN 'bytes=-' WHEN 8 THEN 'bytes=0-99999999999999999999' WHEN 9 THEN 'bytes=99999999999999999999-' ELSE 'bytes=5-6,8-9' END"


@query("mat_12_byte_range", """SELECT id, k NOT IN (2, 5) AS asked, ok AS met, CASE WHEN ok THEN CASE k WHEN 0 THEN id WHEN 1 THEN greatest(file_size - 10, 0) ELSE 0 END END AS start, CASE WHEN ok THEN CASE k WHEN 0 THEN least(id + 99, file_size - 1) ELSE file_size - 1 END END AS "end"
    FROM (SELECT id, file_size, id % 11 AS k, CASE WHEN id % 11 IN (2, 5) THEN NULL ELSE file_size > 0 AND (id % 11 IN (1, 4, 8) OR (id % 11 = 0 AND id < file_size)) END AS ok FROM video)""")
def byte_ranges(lib: Library) -> DataFrame:
    """Without a header all is sent; a range that cannot be read or met is not."""
    rows = lib.video.select("id", N.byte_range(F.expr(RANGES), F.col("file_size")).alias("r"))
    return rows.select("id", F.col("r").isNotNull().alias("asked"), F.col("r.ok").alias("met"), F.col("r.start").alias("start"), F.col("r.end").alias("end"))


@query("mat_13_size_text", "SELECT id, CASE id % 8 WHEN 0 THEN CASE WHEN id = 0 THEN 5368709120 ELSE id * 1073741824 END WHEN 1 THEN id WHEN 2 THEN CAST(floor((id + 0.5) * 1048576) AS BIGINT) WHEN 3 THEN id * 1024 ELSE 5368709120 END AS bytes FROM video")
def size_texts(lib: Library) -> DataFrame:
    """What cannot be read, and zero, give the fallback; "5G" and "5GiB" cannot."""
    said = F.expr("CASE id % 8 WHEN 0 THEN concat(id, 'GB') WHEN 1 THEN concat(id, '') WHEN 2 THEN concat(id, '.5 mb') WHEN 3 THEN concat(' ', id, ' Kb ') WHEN 4 THEN concat(id, 'G') WHEN 5 THEN concat(id, 'GiB') WHEN 6 THEN '0' ELSE NULL END")
    return lib.video.select("id", N.size_bytes(said, 5 << 30).alias("bytes"))


@query("mat_15_timeline_window", """WITH w AS (SELECT id, duration AS d, file_size * 1000 AS size, duration * 0.7 AS t FROM video WHERE duration > 0), x AS (SELECT *, least(greatest(ceil(size * 18 * 1.6 / d), least(2097152, size)), 6000000) AS want FROM w),
    y AS (SELECT *, greatest(0, least(floor(t / d * size) - floor(t / d * size) % 752, greatest(0, size - want) - greatest(0, size - want) % 752)) AS s FROM x) SELECT id, CAST(s AS BIGINT) AS start, CAST(least(want, size - s) AS BIGINT) AS length FROM y""")
def timeline_windows(lib: Library) -> DataFrame:
    w = N.timeline_window((F.col("duration") * F.lit(Decimal("0.7"))).cast("double"), F.col("duration"), F.col("file_size") * 1000, 6_000_000, 752, factor=1.6)
    return lib.video.where("duration > 0").select("id", w.alias("w")).select("id", "w.*")


@query("mat_15_scene_window", """WITH v AS (SELECT id, CASE WHEN id % 4 = 0 THEN NULL ELSE duration END AS d, file_size * 1000 AS size, CAST(id % 700 AS DOUBLE) AS s, CASE WHEN id % 6 = 0 THEN NULL ELSE (id % 13) / 10.0 - 0.1 END AS f, id % 5 = 0 AS e FROM video),
    w AS (SELECT *, coalesce(d > 0, FALSE) AS known, CASE WHEN d > 0 THEN greatest(0, least(s, greatest(0, d - greatest(0.2, least(4.0, d))))) ELSE greatest(0, s) END AS t, least(1.0, greatest(0.0, f)) AS g FROM v),
    x AS (SELECT *, CASE WHEN known THEN least(greatest(ceil(size * 18 * 1.6 / d), least(2097152, size)), 6000000) ELSE least(greatest(ceil(size * 0.03), least(4194304, size)), 6000000, size) END AS want FROM w),
    y AS (SELECT *, floor(CASE WHEN known THEN t / d * size ELSE coalesce(g, 0) * size END) AS p, greatest(0, size - want) AS q FROM x), z AS (SELECT *, CASE WHEN size > 0 THEN greatest(0, least(p - p % 752, q - q % 752)) ELSE 0 END AS start FROM y)
    SELECT id, CAST(t AS DOUBLE) AS "at", CAST(start AS BIGINT) AS start, CAST(CASE WHEN size > 0 THEN least(want, size - start) ELSE 0 END AS BIGINT) AS length, NOT known OR e AS estimated, CASE WHEN NOT known THEN CAST(g AS DOUBLE) END AS fraction FROM z""")
def scene_windows(lib: Library) -> DataFrame:
    """A scene's bytes: clear of the end of a known duration, an estimate by fraction where it is not known."""
    rows = titles(lib).withColumn("d", F.expr("CASE WHEN id % 4 = 0 THEN NULL ELSE duration END"))
    fraction = F.expr("CASE WHEN id % 6 = 0 THEN NULL ELSE (id % 13) / 10.0D - 0.1D END")
    w = N.scene_window((F.col("id") % 700).cast("double"), F.lit(4.0), F.col("d"), F.col("file_size") * 1000, fraction, F.col("id") % 5 == 0, 6_000_000, 752)
    return rows.select("id", w.alias("w")).select("id", "w.*")


@query("dat_01_daily_seed", "SELECT DISTINCT 'home-' || strftime(ts, '%Y-%m-%d') AS seed FROM events")
def daily_seed(lib: Library) -> DataFrame:
    return lib.raw("events").select(F.concat(F.lit("home-"), F.date_format("ts", "yyyy-MM-dd")).alias("seed")).distinct()


@query("jsn_01_validated", "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k FROM events")
def validated_json(lib: Library) -> DataFrame:
    """Text that does not parse, or lacks a field, is null."""
    text = F.expr("CASE event_id % 6 WHEN 0 THEN 'no json' WHEN 3 THEN '{\"other\": 1}' ELSE props END")
    return lib.raw("events").select(F.col("event_id").alias("id"), F.from_json(text, "k int").alias("j")).select("id", "j.k")


@query("jsn_02_version_fingerprint", "SELECT id, substr(sha256('{\"size\":' || file_size || ',\"v\":2}'), 1, 10) AS version FROM video")
def version_fingerprint(lib: Library) -> DataFrame:
    return lib.video.select("id", F.substring(F.sha2(F.to_json(F.struct(F.col("file_size").alias("size"), F.lit(2).alias("v"))), 256), 1, 10).alias("version"))


@query("cls_01_media_type", f"""WITH n AS (SELECT id, CASE WHEN id % 2 = 0 THEN {NAMES} ELSE 'f' || id || '.' || (['MPG', 'mpeg', 'wmv', 'flv', '3gp', '3G2', 'ts', 'm4v', 'mov', 'webm', 'avi', 'ogv', 'mp4'])[id % 13 + 1] END AS name FROM video), e AS (SELECT id, lower(regexp_extract(name, '^.+\\.([^.]+)$', 1)) AS e FROM n)
    SELECT id, CASE WHEN e IN ('mp4', 'm4v') THEN 'video/mp4' WHEN e = 'mov' THEN 'video/quicktime' WHEN e = 'mkv' THEN 'video/x-matroska' WHEN e = 'webm' THEN 'video/webm' WHEN e = 'avi' THEN 'video/x-msvideo' WHEN e IN ('mpg', 'mpeg') THEN 'video/mpeg'
        WHEN e = 'wmv' THEN 'video/x-ms-wmv' WHEN e = 'flv' THEN 'video/x-flv' WHEN e = 'ts' THEN 'video/mp2t' WHEN e = '3gp' THEN 'video/3gpp' WHEN e = '3g2' THEN 'video/3gpp2' END AS mime FROM e""")
def media_types(lib: Library) -> DataFrame:
    """Lookup tables of a few entries as map literals."""
    rows = names(lib).withColumn("name", F.when(F.col("id") % 2 == 0, F.col("name")).otherwise(F.concat(F.lit("f"), "id", F.lit("."), one_of(("MPG", "mpeg", "wmv", "flv", "3gp", "3G2", "ts", "m4v", "mov", "webm", "avi", "ogv", "mp4"), F.col("id") % 13))))
    return rows.select("id", T.mime_of(F.col("name")).alias("mime"))


#: First bytes of files, in hex: a transport stream, one out of step, an MP4, a box longer than what was read, Matroska, RIFF, and too little.
HEADS = ("47" + "00" * 187 + "47" + "00" * 187, "47" + "00" * 187 + "48" + "00" * 187, "0000001866747970" + "00" * 32, "0000FFFF66747970" + "00" * 32, "1A45DFA3" + "00" * 8, "5249464600000000415649200000", "47", "")


@query("cls_01_route", """WITH s AS (SELECT id, id % 8 AS k, CASE id % 3 WHEN 0 THEN 'video/mp2t' WHEN 1 THEN 'video/mp4' END AS stored FROM video), c AS (SELECT *, CASE k WHEN 0 THEN 'ts' WHEN 2 THEN 'mp4' ELSE 'unknown' END AS seen FROM s)
    SELECT id, seen, CASE WHEN seen = 'ts' THEN 'mp2t' WHEN seen = 'mp4' THEN 'mp4' WHEN stored = 'video/mp2t' THEN 'mp2t' ELSE 'mp4' END AS verdict,
        CASE WHEN seen = 'ts' AND coalesce(stored, '') <> 'video/mp2t' THEN 'video/mp2t' WHEN seen = 'mp4' AND stored = 'video/mp2t' THEN 'video/mp4' END AS corrected FROM c""")
def routes(lib: Library) -> DataFrame:
    """How a file is played: by its first bytes, else by its stored label, which bytes may correct."""
    rows = lib.video.select("id", F.unhex(one_of(HEADS, F.col("id") % 8)).alias("head"), F.expr("CASE id % 3 WHEN 0 THEN 'video/mp2t' WHEN 1 THEN 'video/mp4' END").alias("stored"))
    return rows.select("id", "stored", C.container_of(F.col("head")).alias("seen")).select("id", "seen", C.routed(F.col("stored"), F.col("seen")).alias("r")).select("id", "seen", "r.*")


@query("cls_02_player_retry", """WITH p AS (SELECT id, [410, 503, 429, 500, 200, 206, 404, 301, NULL, NULL, 599, 503][id % 12 + 1] AS status, id % 12 = 9 AS down, CASE id % 5 WHEN 0 THEN '7' WHEN 1 THEN '0' WHEN 2 THEN '90' WHEN 3 THEN 'soon' END AS after, id % 4 AS attempt FROM video),
    w AS (SELECT *, [1000, 2000, 4000, 4000][attempt + 1] AS wait, CASE after WHEN '7' THEN 7000 WHEN '0' THEN 1000 WHEN '90' THEN 30000 END AS asked FROM p),
    a AS (SELECT *, CASE WHEN down THEN 'retry' WHEN status = 410 THEN 'unavailable' WHEN status IN (503, 429, 500, 599, 200, 206) THEN 'retry' ELSE 'fatal' END AS action FROM w)
    SELECT id, action, CAST(CASE WHEN action = 'retry' THEN CASE WHEN NOT down AND status IN (503, 429) THEN coalesce(asked, wait) ELSE wait END END AS BIGINT) AS delay, CASE WHEN action = 'fatal' THEN 'The video is still being prepared.' END AS message FROM a""")
def player_retries(lib: Library) -> DataFrame:
    """What a player does after an error, by a probe of the address: try again, and when, or give up."""
    status = one_of((410, 503, 429, 500, 200, 206, 404, 301, None, None, 599, 503), F.col("id") % 12).cast("int")
    after = one_of(("7", "0", "90", "soon", None), F.col("id") % 5)
    return lib.video.select("id", C.player_retry(status, F.col("id") % 12 == 9, after, F.col("id") % 4).alias("r")).select("id", "r.*")


@query("cls_02_retry_decision", "SELECT id, CASE WHEN status <> 'failed' THEN 'none' WHEN error_code IN ('max_attempts', 'worker_recovery_exhausted', 'unsupported_codec') THEN 'blocked' WHEN attempts >= 3 THEN 'exhausted' ELSE 'retry' END AS decision FROM job")
def retry_decision(lib: Library) -> DataFrame:
    return lib.job.select("id", F.when(F.col("status") != "failed", "none").when(auto_retry_blocked(), "blocked").when(F.col("attempts") >= 3, "exhausted").otherwise("retry").alias("decision"))


#: Errors that an ordinary scan never retries.
BLOCKED = ("max_attempts", "worker_recovery_exhausted", "unsupported_codec")


def auto_retry_blocked():
    return F.coalesce(F.col("error_code").isin(*BLOCKED), F.lit(False))


SAYINGS = ("Deadline exceeded after 90 s", "Unknown decoder: av9", "moov incomplete", "source size unknown", "Reconnect required", "read timed out", "ciphertext fetch truncated", "FFmpeg exit 1", "output empty", "attempt budget exhausted", "who knows")
CODES = ("job_timeout", "unsupported_codec", "moov_missing", "source_size_unknown", "source_unavailable", "download_timeout", "download_failed", "encode_failed", "output_invalid", "max_attempts", "internal")


def one_of(values: tuple, by):
    """values[by], counted from 0."""
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), by.cast("int"))


@query("cls_03_error_code", f"SELECT id, {list(CODES)}[id % 11 + 1] AS code, id % 11 NOT IN (1, 3, 4, 9) AS retryable FROM video")
def error_codes(lib: Library) -> DataFrame:
    return lib.video.select("id", C.outcome(one_of(SAYINGS, F.col("id") % 11)).alias("o")).select("id", "o.*")


@query("cls_04_thumb_verdict", "SELECT id, CASE WHEN duration IS NULL THEN 'unknown' WHEN duration >= 16 THEN 'usable' ELSE 'black' END AS verdict FROM video")
def thumb_verdicts(lib: Library) -> DataFrame:
    return lib.video.select("id", C.thumb_verdict(F.col("duration"), 16).alias("verdict"))


@query("cls_05_transient_network", "SELECT id, id % 6 IN (0, 3) AS transient FROM video")
def transient_errors(lib: Library) -> DataFrame:
    by = F.col("id") % 6
    name, code, said = (one_of(v, by) for v in (("Error", "AbortError", "Error", "TypeError", "TypeError", None), ("ECONNRESET", "ECONNRESET", "EPERM", None, None, None), ("x", "fetch failed", "fetch failed", "Fetch failed", "bad", None)))
    return lib.video.select("id", C.is_transient(name, code, said).alias("transient"))


@query("cls_06_asset_status", "SELECT id, CASE status WHEN 'completed' THEN 'pending' WHEN 'failed' THEN 'failed' ELSE status END AS asset, CASE status WHEN 'completed' THEN 'artifact_missing' WHEN 'failed' THEN 'generation_failed' WHEN 'unsupported' THEN 'unsupported_codec' END AS code FROM job")
def asset_statuses(lib: Library) -> DataFrame:
    return lib.job.select("id", C.asset(F.col("status")).alias("a")).select("id", F.col("a.status").alias("asset"), "a.code")
