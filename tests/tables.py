"""A library of rows given by hand, with the tables that plans ask for."""

from datetime import datetime, timedelta

VIDEO = "id long, account_id int, title string, source string, file_size long, duration long, created_at timestamp_ntz, creator_id int, filename string, node_id string"


def video(id, title, account, day=0, creator=None, size=1000, duration=60, filename=None):  # noqa: A002
    return (id, account, title, "s", size, duration, datetime(2026, 1, 1) + timedelta(days=day), creator, filename or f"{title}.mp4", f"n{id}")


class Tables:
    """Two users with an account in order (1 and 2) and one disconnected account (9) of user 1."""

    def __init__(self, spark, video=(), creator=(), history=()):
        make = spark.createDataFrame
        self.spark = spark
        self.video = make(list(video), VIDEO)
        self.account = make([(1, 1, "SYNCED", "one", 0), (2, 2, "SYNCED", "two", 0), (9, 1, "DISCONNECTED", "gone", 0)], "id int, user_id int, status string, label string, failures int")
        self.creator = make(list(creator), "id int, user_id int, name string")
        self.history = make(list(history), "user_id int, video_id long, ts timestamp_ntz")
