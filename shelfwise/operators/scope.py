"""Who may see which video, and pages of a listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a page by default and at most (fixed values).
PER_PAGE, MOST_PER_PAGE = 24, 96


def with_owner(video: DataFrame, account: DataFrame) -> DataFrame:
    """video with owner and owner_status; both null for the public catalogue. The accounts of a library are few: Spark broadcasts them when they fit."""
    own = account.select(F.col("id").alias("account_id"), F.col("user_id").alias("owner"), F.col("status").alias("owner_status"))
    return video.join(own, "account_id", "left")


def is_public() -> Column:
    return F.col("account_id").isNull()


def is_own(user: int) -> Column:
    """Private and visible: of one of the user's accounts that is not disconnected."""
    return F.coalesce((F.col("owner") == user) & (F.col("owner_status") != "DISCONNECTED"), F.lit(False))


def in_library(user: int | None) -> Column:
    """What search and shuffle see: the user's own videos and the public ones; only these without a user."""
    return is_public() if user is None else is_public() | is_own(user)


def newest() -> list[Column]:
    return [F.desc("created_at"), F.desc("id")]


def clamp_page(page: int, per_page: int = PER_PAGE) -> tuple[int, int]:
    return max(1, page), min(MOST_PER_PAGE, max(1, per_page))


def total_pages(total: int, per_page: int = PER_PAGE) -> int:
    return max(1, -(-total // per_page))


#: Up to so many pages all are offered (fixed value).
ALL_PAGES = 7


def page_strips(page: Column, pages: Column) -> Column:
    """Page numbers to offer, the first, the last and those next to page; null stands for a gap."""
    near = F.array_sort(F.array_distinct(F.filter(F.array(F.lit(1).cast("long"), pages, page - 1, page, page + 1), lambda p: p.between(1, pages))))
    gaps = F.transform(near, lambda p, i: F.when((i > 0) & (p - F.coalesce(F.get(near, i - 1), p) > 1), F.array(F.lit(None).cast("long"), p)).otherwise(F.array(p)))
    return F.when(pages <= ALL_PAGES, F.sequence(F.lit(1).cast("long"), pages)).otherwise(F.flatten(gaps))


def paged(rows: DataFrame, order: list[Column], page: int = 1, per_page: int = PER_PAGE) -> DataFrame:
    """One page of rows with pos, the place in the whole order. Only a page's rows leave the top-k, and only they are numbered."""
    page, per_page = clamp_page(page, per_page)
    first = (page - 1) * per_page
    top = rows.orderBy(*order).offset(first).limit(per_page)
    return top.withColumn("pos", (F.row_number().over(Window.orderBy(*order)) + first).cast("int"))
