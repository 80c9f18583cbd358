"""Document fingerprints by spot signatures, with DataFrame functions only.

A spot signature is a chain of CHAIN content words that follows a common word (an anchor); common words
inside the chain are skipped. A document's fingerprint is the set of its signatures, as 32-bit hashes in
rising order. The set follows the running text and ignores what has few common words, such as menus.

Similar sets have similar lengths, so a search splits fingerprints by length into ranges whose ends
differ by the threshold's factor, compares only neighbouring ranges, and meets candidates on the rarest
signatures of each set, of which a pair at the threshold must share one; so a frequent signature, which
many sets have, brings none of them together.

compare_edited() compares given pairs, exactly; near_duplicates() and near_classes() search.
Texts are read whole, however long they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import written
from shelfwise.llm.jaccard_join import components

CHAIN = 3
#: Anchors: the most common words of the languages at hand (fixed values).
ANCHORS = (
    "the of and to in is that for it was on are be with as at by this from or an a "
    "le la les de des du un une et est que qui dans pour sur par au avec en pas plus "
    "der die das und zu den mit von ist im für auf nicht ein eine als auch sich dem es "
    "el los las del y se por con no una su para al lo como más o pero sus"
).split()
MARK = "\x01"


def _words(text: Column) -> Column:
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" "))


def with_spots(rows: DataFrame, text: str, to: str, anchors: list[str] = ANCHORS) -> DataFrame:
    """rows with the column to: the sorted distinct signatures (array<int>) of the column text (null: empty).

    In a text without any anchor every word begins a chain; one without words has the signature of no words.
    """
    common = "|".join(sorted(set(anchors), key=lambda a: (-len(a), a)))
    marked = F.regexp_replace(_words(F.coalesce(F.col(text), F.lit(""))), f" +(?:{common})(?= )", MARK)
    rows = rows.withColumn("__m", F.trim(marked))
    rows = rows.withColumns({"__k": F.split("__m", " "), "__c": F.split(F.replace("__m", F.lit(MARK), F.lit("")), " ")})
    chain = lambda i: F.hash(*[F.coalesce(F.get(F.col("__c"), i + j), F.lit("")) for j in range(1, CHAIN + 1)])
    found = F.transform("__k", lambda word, i: F.when(F.endswith(word, F.lit(MARK)), chain(i)))
    rows = rows.withColumn("__f", F.array_sort(F.array_distinct(F.array_compact(found))))
    every = F.array_sort(F.array_distinct(F.transform("__k", lambda word, i: chain(i - 1))))
    return rows.withColumn(to, F.when(F.size("__f") == 0, every).otherwise(F.col("__f"))).drop("__m", "__k", "__c", "__f")


def fingerprint(spots: Column) -> Column:
    return F.array_join(F.transform(spots, lambda s: F.lower(F.hex(s.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of signatures, 0 to 1."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def neighbours(keys: DataFrame) -> DataFrame:
    """keys with next_key: the key that follows in falling order of doc_id (no doc_id comes last), then of digest; after the last the first. keys: key, doc_id, digest.

    No task sees more than one range of the order; across ranges only their first keys are put in order.
    """
    order = (F.desc("doc_id"), F.col("digest"))
    keys = written(keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "spot-ranges")
    across = Window.orderBy("part")
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.expr("~doc_id").alias("back"), "digest")
    bounds = keys.groupBy("part").agg(F.min_by("key", place).alias("top"))
    bounds = bounds.select("part", F.coalesce(F.lead("top").over(across), F.first("top").over(across)).alias("after"))
    following = F.coalesce(F.lead("key").over(Window.partitionBy("part").orderBy(*order)), "after")
    return keys.join(bounds, "part").withColumn("next_key", following).drop("part", "after")


def edited_and_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, spots, edited, next_id, next_spots: each document beside its edited text and its next document, with the signatures of both texts.

    The edited text has the last third of the code points replaced by as many from the start of the next document.
    Rows without doc_id come after all others. Rows that repeat a doc_id are documents of their own; rows that repeat the
    text as well are worked on once: all but the last of them have the next one's, that is their own, text beside them.
    Signatures are made once, before the only shuffle of whole texts, which serves both joins.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.md5(F.col("text").cast("binary")))
    docs = docs.withColumn("key", F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), "digest").cast("binary")))
    keys = docs.groupBy("key", "doc_id", "digest").agg(F.count("*").alias("times"), F.max(F.length("text")).cast("long").alias("n_chars"))
    order = neighbours(keys)
    pairs = F.array(F.struct("next_key", F.lit(1).cast("long").alias("times")), F.struct(F.col("key").alias("next_key"), (F.col("times") - 1).alias("times")))
    order = written(order.select("key", "n_chars", F.inline(pairs)).where("times > 0"), "spot-neighbours")
    texts = with_spots(docs.select("key", "doc_id", "text"), "text", "spots").dropDuplicates(["key"])
    said = texts.join(order.withColumnRenamed("key", "to").withColumnRenamed("next_key", "key"), "key")
    said = said.select(F.col("to").alias("key"), F.col("doc_id").alias("next_id"), F.substring("text", F.lit(1), F.expr("cast(n_chars div 3 as int)")).alias("head"), F.col("spots").alias("next_spots"), "times")
    n = F.length("text")
    kept = F.substring("text", F.lit(1), n - F.floor(n / 3).cast("int"))
    found = texts.join(said, "key").select("doc_id", "text", "spots", F.concat(kept, "head").alias("edited"), "next_id", "next_spots", "times")
    return found


def compare_edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_id; see edited_and_next."""
    rows = with_spots(edited_and_next(docs), "edited", "edited_spots")
    found = rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("spots")).alias("fingerprint"),
        fingerprint(F.col("edited_spots")).alias("edited_fingerprint"),
        likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"),
        likeness(F.col("spots"), F.col("next_spots")).alias("near_next"),
        "next_id",
        "times",
    )
    return found.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("__copy", "times")


def _sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, set_id) of every row with a doc_id, and the different fingerprints: set_id (least doc_id of those that have it), spots, n, copies."""
    rows = with_spots(docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", "spots").select("doc_id", "spots", F.md5(F.concat_ws(",", F.transform("spots", lambda x: x.cast("string")))).alias("key"))
    rows = written(rows, "spot-rows")
    sets = rows.groupBy("key").agg(F.min(F.struct("doc_id", "key")).alias("own"), F.first("spots").alias("spots"), F.count_distinct("doc_id").alias("copies"))
    # A repeated doc_id may have several fingerprints: numbers tell sets apart, ids only name them.
    sets = written(sets.select("key", F.col("own.doc_id").alias("set_id"), "spots", F.size("spots").alias("n"), "copies").withColumn("set", F.monotonically_increasing_id()), "spot-sets")
    return rows.select("doc_id", "key").join(sets.select("key", "set", "set_id"), "key").select("doc_id", "set", "set_id"), sets


def _alike(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, likeness): numbers of different sets at or over the threshold, a < b.

    Signatures are put in order of the number of sets that have them, and only the first few of each set are
    looked up: as many as a pair at the threshold cannot both miss. Sets meet only in their own or the next range of lengths.
    """
    each = sets.select("set", "n", F.explode("spots").alias("spot"))
    ranked = each.join(each.groupBy("spot").agg(F.count("*").alias("df")), "spot").groupBy("set", "n").agg(F.array_sort(F.collect_list(F.struct("df", "spot"))).alias("order"))
    level = F.floor(F.log("n") / -F.log(F.lit(threshold - 1e-6)))
    few = (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int")
    left = written(ranked.select("set", "n", level.alias("level"), F.explode(F.transform(F.slice("order", F.lit(1), few), lambda x: x["spot"])).alias("spot")), "spot-prefixes")
    right = left.select(F.col("set").alias("other"), F.col("n").alias("m"), F.explode(F.array(F.col("level") - 1, "level", F.col("level") + 1)).alias("level"), "spot")
    pairs = left.join(right, ["level", "spot"]).where(f"set < other and least(n, m) >= greatest(n, m) * {threshold!r} - 1e-9").select("set", "other").distinct()
    a, b = (sets.select(F.col("set").alias(i), F.col("spots").alias(s)) for i, s in (("set", "x"), ("other", "y")))
    found = pairs.join(a, "set").join(b, "other").select(F.col("set").alias("a"), F.col("other").alias("b"), likeness(F.col("x"), F.col("y")).alias("likeness"))
    return found.where(F.col("likeness") >= threshold)


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, likeness): pairs of different fingerprints at or over the threshold, each named by its least doc_id (a <= b)."""
    _, sets = _sets(docs)
    names = sets.select("set", "set_id")
    named = _alike(sets, threshold).join(names.withColumnsRenamed({"set": "a", "set_id": "x"}), "a").join(names.withColumnsRenamed({"set": "b", "set_id": "y"}), "b")
    return named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "likeness")


def near_classes(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, class_id, set_id, n_links, n_set_links) of every row with a doc_id.

    class_id: least doc_id of all that are linked with it, over any number of links; set_id: least doc_id with the
    same fingerprint; n_links: other documents at or over the threshold; n_set_links: other fingerprints so.
    """
    rows, sets = _sets(docs)
    pairs = written(_alike(sets, threshold).select("a", "b"), "spot-pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = both.join(sets.select(F.col("set").alias("b"), "copies"), "b").groupBy(F.col("a").alias("set")).agg(F.count("*").alias("n_set_links"), F.sum("copies").alias("linked"))
    root = components(pairs).withColumnRenamed("id", "set")
    found = sets.join(root, "set", "left").join(counts, "set", "left").select("set", "set_id", "copies", F.coalesce("root", "set").alias("root"), F.coalesce("n_set_links", F.lit(0).cast("long")).alias("n_set_links"), F.coalesce("linked", F.lit(0).cast("long")).alias("linked"))
    least = found.groupBy("root").agg(F.min("set_id").alias("class_id"))
    found = found.join(least, "root").select("set", "class_id", (F.col("linked") + F.col("copies") - 1).alias("n_links"), "n_set_links")
    return rows.join(found, "set").select("doc_id", "class_id", "set_id", "n_links", "n_set_links")
