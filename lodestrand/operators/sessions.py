"""Conversation logs, routing and snapshot tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrand.functions.text import LIVE_WORDS, contains_any, extract_campus, extract_service_code, extract_weekday, static_clauses, strip
from lodestrand.session import cut

# Words that decide the routing.
COURSE_WORDS = ("课表", "上课", "什么课", "在哪里上", "教室", "几点上课")
PROCESS_WORDS = ("流程", "指南", "办法", "规定", "政策", "材料", "申请", "办理", "退选")
ACTION_WORDS = ("怎么办", "丢了", "遗失", "不见了", "挂失", "补办", "借书", "还书", "续借", "申请", "预约", "材料", "流程")
SUBJECT_WORDS = ("图书馆", "借书", "借阅", "还书", "成绩单", "校园卡", "饭卡", "挂失", "补办", "奖学金", "评优", "实验室", "预约")
COURSE_KEYWORDS = ("Python", "机器学习", "人工智能", "英语")
MULTI_WORDS = ("并且", "以及", "同时", "另外", "还要", "还想", "和")
ASK_BLANK = "请输入你想查询的校园事务。"
ASK_WEEKDAY = "你想查询星期几的课程？例如：周三有什么课？"
ASK_SERVICE = "你想查询哪个服务当前是否开放？例如：校园卡服务中心现在开门吗？"


def history_tail(messages: DataFrame, n: int = 20) -> DataFrame:
    """The last ``n`` messages of each session; cut in each task before the shuffle."""
    own = W.partitionBy("session_id").orderBy(F.desc("turn"))
    return messages.withColumn("back", F.row_number().over(own)).where(F.col("back") <= n).drop("back")


def retain_recent_sessions(messages: DataFrame, m: int = 256) -> DataFrame:
    """Messages of the ``m`` sessions that were touched last (ties by session_id)."""
    last = messages.groupBy("session_id").agg(F.max("ts").alias("last")).orderBy(F.desc("last"), "session_id").limit(m)
    return messages.join(last.select("session_id"), "session_id", "left_semi")


def previous_user_text(messages: DataFrame, n: int = 6) -> DataFrame:
    """``previous``: user texts among the ``n`` messages before each one, joined by blanks."""
    own = W.partitionBy("session_id").orderBy("turn").rowsBetween(-n, -1)
    return messages.withColumn("previous", F.array_join(F.collect_list(F.when(F.col("role") == "user", F.col("content"))).over(own), " "))


def prompt_history(messages: DataFrame, n: int = 8, chars: int = 500) -> DataFrame:
    """``history``: the ``n`` messages before each one as "role: text", each text cut to ``chars``."""
    own = W.partitionBy("session_id").orderBy("turn").rowsBetween(-n, -1)
    line = F.concat("role", F.lit(": "), F.substring("content", 1, chars))
    return messages.withColumn("history", F.array_join(F.collect_list(line).over(own), "\n"))


def route_queries(messages: DataFrame) -> DataFrame:
    """``(session_id, turn, tools, weekday, keyword, service_code, campus, knowledge_query, direct_answer)`` of user messages.

    Tools are in the order course, status, knowledge. A missing weekday or service asks back, and
    then nothing is called. Follow-up questions take what they lack from the user texts before.
    """
    rows = previous_user_text(messages).where("role = 'user'").select("session_id", "turn", strip(F.col("content")).alias("query"), "previous")
    query, previous = F.col("query"), F.col("previous")
    context = strip(F.concat_ws(" ", previous, query))
    own_day = extract_weekday(query)
    course = contains_any(query, COURSE_WORDS) | (own_day.isNotNull() & query.contains("课"))
    course = course | (contains_any(query, ("哪里", "几点")) & contains_any(previous, (*COURSE_WORDS, "课程")))
    live = contains_any(query, LIVE_WORDS)
    process = contains_any(query, (*PROCESS_WORDS, *ACTION_WORDS))
    plan = rows.select(
        "*", context.alias("context"), course.alias("course"), live.alias("live"), process.alias("process"),
        F.coalesce(own_day, F.when(course, extract_weekday(previous))).alias("weekday"),
        F.coalesce(extract_service_code(query), extract_service_code(previous)).alias("service"),
    )
    knows = F.col("process") | (~F.col("live") & (contains_any(query, SUBJECT_WORDS) | (F.col("course") & contains_any(query, MULTI_WORDS)) | ~F.col("course")))
    keyword = F.coalesce(*(F.when(F.lower(F.col("context")).contains(w.lower()), F.lit(w)) for w in COURSE_KEYWORDS), F.lit(""))
    ask = (
        F.when(query == "", ASK_BLANK).when(F.col("course") & F.col("weekday").isNull(), ASK_WEEKDAY)
        .when(F.col("live") & F.col("service").isNull(), ASK_SERVICE)
    )
    done = plan.select("*", knows.alias("knows"), keyword.alias("word"), ask.alias("direct_answer"))
    calls = F.col("direct_answer").isNull()
    tool = lambda on, name: F.when(calls & on, F.lit(name))
    return done.select(
        "session_id", "turn",
        F.array_join(F.array_compact(F.array(tool(F.col("course"), "course"), tool(F.col("live"), "status"), tool(F.col("knows"), "knowledge"))), ",").alias("tools"),
        F.when(calls & F.col("course"), F.col("weekday")).alias("weekday"), F.when(calls & F.col("course"), F.col("word")).alias("keyword"),
        F.when(calls & F.col("live"), F.col("service")).alias("service_code"), F.when(calls & F.col("live"), extract_campus(F.col("context"))).alias("campus"),
        F.when(calls & F.col("knows"), static_clauses(query)).alias("knowledge_query"), "direct_answer",
    )


def commit_turns(messages: DataFrame) -> DataFrame:
    """Only complete turns: a user message and the assistant's answer right after it."""
    own = W.partitionBy("session_id").orderBy("turn")
    paired = messages.select("*", F.lead("role").over(own).alias("_next"), F.lag("role").over(own).alias("_last"))
    user = (F.col("role") == "user") & (F.col("_next") == "assistant")
    return paired.where(user | ((F.col("role") == "assistant") & (F.col("_last") == "user"))).drop("_next", "_last")


def clear_sessions(messages: DataFrame, ids: DataFrame) -> DataFrame:
    return messages.join(ids.select("session_id").distinct(), "session_id", "left_anti")


THREAD = ["thread_id", "checkpoint_ns"]


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot of each thread and namespace."""
    rest = [c for c in snapshots.columns if c not in (*THREAD, "checkpoint_id")]
    best = snapshots.groupBy(*THREAD).agg(F.max(F.struct("checkpoint_id", *rest)).alias("s"))
    return best.select(*THREAD, "s.*")


def prune_snapshots(snapshots: DataFrame, keep: int) -> DataFrame:
    """The newest ``keep`` snapshots of each thread; the oldest kept one loses its parent."""
    own = W.partitionBy(*THREAD)
    ranked = snapshots.select("*", F.row_number().over(own.orderBy(F.desc("checkpoint_id"))).alias("_n")).where(F.col("_n") <= keep)
    oldest = F.col("checkpoint_id") == F.min("checkpoint_id").over(own)
    return ranked.withColumn("parent_checkpoint_id", F.when(~oldest, F.col("parent_checkpoint_id"))).drop("_n")


def cap_threads(snapshots: DataFrame, m: int = 256) -> DataFrame:
    """Snapshots of the ``m`` threads whose newest snapshot is newest (ties by thread and namespace)."""
    newest = snapshots.groupBy(*THREAD).agg(F.max("checkpoint_id").alias("_newest")).orderBy(F.desc("_newest"), *THREAD).limit(m)
    return snapshots.join(newest.select(*THREAD), THREAD, "left_semi")


def rollback_after(snapshots: DataFrame, targets: DataFrame) -> DataFrame:
    """Snapshots that stay after rolling threads back to ``targets (thread_id, checkpoint_ns, keep_id)``, with ``error``.

    What lies before ``keep_id`` on the way from a thread's newest snapshot along the parents goes. A null
    keep_id removes the whole thread. A way that does not lead to keep_id is refused: all rows stay, with
    the error ``broken_chain``. Each round doubles the stride, so a chain of n snapshots takes log2(n) rounds.
    """
    own = snapshots.join(targets.select(*THREAD, "keep_id", F.lit(True).alias("_hit")), THREAD, "left")
    touched = own.where("_hit and keep_id is not null")
    hop = touched.where("checkpoint_id != keep_id").select(*THREAD, F.col("checkpoint_id").alias("at"), F.col("parent_checkpoint_id").alias("to")).where("to is not null")
    way = touched.groupBy(*THREAD).agg(F.max("checkpoint_id").alias("at"))
    longest = touched.groupBy(*THREAD).count().agg(F.max("count")).first()[0] or 0
    for _ in range(int(longest).bit_length()):
        way = cut(way.union(way.join(hop, [*THREAD, "at"]).select(*THREAD, "to")).distinct(), "way")
        hop = cut(hop.join(hop.select(*THREAD, F.col("at").alias("to"), F.col("to").alias("next")), [*THREAD, "to"]).select(*THREAD, "at", F.col("next").alias("to")), "hop")
    ends = targets.where("keep_id is not null").select(*THREAD, F.col("keep_id").alias("at"))
    fine = way.join(ends, [*THREAD, "at"], "left_semi").select(*THREAD)
    gone = way.join(ends, [*THREAD, "at"], "left_anti").join(fine, THREAD, "left_semi").withColumnRenamed("at", "checkpoint_id")
    kept = own.where("not coalesce(_hit, false) or keep_id is not null").join(gone, [*THREAD, "checkpoint_id"], "left_anti")
    marked = kept.join(fine.withColumn("_fine", F.lit(True)), THREAD, "left")
    return marked.withColumn("error", F.when(F.col("_hit") & F.col("_fine").isNull(), "broken_chain")).drop("_hit", "_fine", "keep_id")
