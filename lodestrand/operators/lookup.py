"""Dimension lookups: courses, service status, as-of status and payload checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrand.functions.text import normalize_weekday, strip

STATUS_LABELS = {"open": "开放", "closed": "关闭", "busy": "繁忙", "maintenance": "维护中", "unknown": "未知"}
SERVICE_CODES = ("campus_card", "registrar", "library", "student_affairs")
CAMPUS_CODES = ("main", "east", "west")


def course_lookup(requests: DataFrame, courses: DataFrame) -> DataFrame:
    """``(request_id, n, text)`` for ``(request_id, weekday, keyword)``: a count and a line for each course, in the order ``seq``.

    Courses meet each distinct weekday and keyword once; requests then take the finished text.
    """
    asked = requests.select("request_id", normalize_weekday(F.col("weekday")).alias("day"), strip(F.coalesce("keyword", F.lit(""))).alias("word"))
    fits = (F.col("day") == F.col("weekday")) & ((F.col("word") == "") | F.lower("name").contains(F.lower("word")))
    line = F.concat(F.lit("- "), "start_time", F.lit(" "), "name", F.lit("，地点："), "location")
    found = (
        asked.select("day", "word").distinct().join(courses, fits, "left").groupBy("day", "word")
        .agg(F.count("name").cast("long").alias("n"), F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("seq", line.alias("line"))))).alias("lines"))
    )
    none = F.concat("day", F.when(F.col("word") != "", F.concat(F.lit("，关键字“"), "word", F.lit("”"))).otherwise(""), F.lit("没有找到课程。"))
    some = F.concat("day", F.lit("共找到"), F.col("n").cast("string"), F.lit("门课程：\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    text = F.when(F.col("day").isNull(), F.lit("invalid_weekday")).when(F.col("n") == 0, none).otherwise(some)
    told = found.select(F.col("day").alias("_day"), F.col("word").alias("_word"), "n", text.alias("text"))
    return asked.join(told, F.col("day").eqNullSafe(F.col("_day")) & (F.col("word") == F.col("_word"))).select("request_id", "n", "text")


def status_text(labels: dict[str, str] = STATUS_LABELS) -> Column:
    """A status row as text; queue and waiting time only where they are known."""
    mark = F.when(F.col("provider") == "mock", "[模拟数据]").otherwise("[官方业务API]")
    queue = F.when(F.col("queue_count").isNotNull(), F.concat(F.lit("；排队 "), F.col("queue_count").cast("string"), F.lit(" 人"))).otherwise("")
    wait = F.when(F.col("estimated_wait_minutes").isNotNull(), F.concat(F.lit("，预计等待 "), F.col("estimated_wait_minutes").cast("string"), F.lit(" 分钟"))).otherwise("")
    name = F.coalesce(*(F.when(F.col("status") == k, F.lit(v)) for k, v in labels.items()), F.col("status"))
    return F.concat(
        mark, F.lit(" "), "service_name", F.lit("当前状态："), name, F.lit("；地点："), "location", F.lit("；今日时间："), "today_hours", queue, wait,
        F.lit("；更新时间："), F.col("updated_at").cast("string"), F.lit("。"),
    )


def status_lookup(requests: DataFrame, status: DataFrame) -> DataFrame:
    """``(request_id, error, text)`` for ``(request_id, service_code, campus)``; unknown codes are refused, the campus defaults to main.

    Of several status rows of one service and campus the newest by ``updated_at`` counts.
    """
    asked = requests.select("request_id", "service_code", F.coalesce("campus", F.lit("main")).alias("campus"))
    others = [c for c in status.columns if c not in ("service_code", "campus", "updated_at")]
    newest = status.groupBy("service_code", "campus").agg(F.max(F.struct("updated_at", *others)).alias("s")).select("service_code", "campus", "s.*")
    joined = asked.join(newest, ["service_code", "campus"], "left")
    bad = ~F.coalesce(F.col("service_code").isin(*SERVICE_CODES), F.lit(False)) | ~F.col("campus").isin(*CAMPUS_CODES)
    error = F.when(bad, "invalid_argument").when(F.col("service_name").isNull(), "not_found")
    return joined.select("request_id", error.alias("error"), F.when(error.isNull(), status_text()).alias("text"))


def status_asof(requests: DataFrame, feed: DataFrame, keys: list[str], value: str = "status", ttl: int = 30, stale: int = 300, bucket: int = 3600) -> DataFrame:
    """For each request ``(request_id, *keys, ts)`` the newest row of ``feed (*keys, ts, value)`` at or before it.

    ``freshness``: fresh up to ``ttl`` seconds of age, stale up to ``stale``, else expired; missing without a
    row. Time is cut in buckets of ``bucket`` seconds, so that one key's line is many tasks' work: the last
    row of each key and bucket, found before the shuffle, is carried forward to the next buckets that have
    requests, and takes its place there as the oldest row; then each bucket is looked at by itself.
    """
    at = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / bucket).alias("_b")
    known = feed.select(*keys, at, "ts", F.col(value).alias("_v"))
    asked = requests.select(*keys, at, "ts", "request_id")
    newest = known.groupBy(*keys, "_b").agg(F.max(F.struct("ts", "_v")).alias("_last")).withColumn("_asks", F.lit(False))
    line = newest.unionByName(asked.select(*keys, "_b").distinct().withColumn("_asks", F.lit(True)), allowMissingColumns=True)
    earlier = W.partitionBy(*keys).orderBy("_b", F.desc("_asks")).rowsBetween(W.unboundedPreceding, -1)
    carried = line.withColumn("_last", F.last("_last", ignorenulls=True).over(earlier)).where("_asks and _last is not null").select(*keys, "_b", "_last.ts", "_last._v")
    both = known.unionByName(carried).withColumns({"_at": F.col("ts"), "_side": F.lit(0)}).unionByName(asked.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    own = W.partitionBy(*keys, "_b").orderBy("ts", "_side", "_v").rowsBetween(W.unboundedPreceding, 0)
    last = both.withColumn("_s", F.last(F.when(F.col("_side") == 0, F.struct("_at", "_v")), ignorenulls=True).over(own)).where("_side = 1")
    age = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("_s._at").cast("timestamp"))
    kind = F.when(age.isNull(), "missing").when(age <= ttl * 1_000_000, "fresh").when(age <= stale * 1_000_000, "stale").otherwise("expired")
    return last.select("request_id", *keys, "ts", F.col("_s._v").alias(value), F.col("_s._at").alias("as_of"), kind.alias("freshness"))


def payload_error(payload: Column, service_code: Column, campus: Column) -> Column:
    """Why a status payload (JSON text) is refused; null if it is fine. The first of the rules in order."""
    field = lambda name: F.get_json_object(payload, f"$.{name}")
    count = lambda name: field(name).isNotNull() & ~field(name).rlike(r"^[0-9]+$")
    long = F.lit(False)
    for name in ("service_name", "location", "today_hours"):
        long = long | field(name).isNull() | (strip(field(name)) == "") | (F.length(field(name)) > 200)
    time = field("updated_at")
    return (
        F.when(payload.isNull() | F.get_json_object(payload, "$").isNull(), "not_an_object")
        .when(~F.coalesce((field("service_code") == service_code) & (field("campus") == campus), F.lit(False)), "identity_mismatch")
        .when(~F.coalesce(field("status").isin(*STATUS_LABELS), F.lit(False)), "bad_status")
        .when(long, "bad_text")
        .when(count("queue_count") | count("estimated_wait_minutes"), "bad_count")
        .when(~F.coalesce(time.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$"), F.lit(False)), "bad_time")
        .when(~F.coalesce(field("request_id").rlike(r"^[A-Za-z0-9._:-]{1,100}$"), F.lit(True)), "bad_request_id")
    )
