"""Inputs of the registered queries, derived from the tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Openings of questions; which one a message gets depends on its ids.
OPENINGS = (
    "请问一卡通丢了怎么办",
    "周三有什么课，图书馆现在开门吗？",
    "麻烦问一下饭卡坏了，重新办理要多少钱",
    "星期五上课在哪里？编号 ZX-900 几点 08:30",
    "奖学金申请流程和材料",
    "泰山校区教务处现在排队吗；补办成绩单要几天",
    "能不能告诉我机器学习 monday 课表",
    "几点上课",
    "学生处今天营业吗",
    "Room B12-A3 opens 9:05, fee 20 元",
    "",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. Texts in fewer file splits than the cluster has cores are dealt to all of them; a larger table stays where it is."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name == "documents" and df.rdd.getNumPartitions() < cores else df


def as_files(rows: DataFrame, folder: str) -> str:
    """Write ``rows (name, at, value)`` as text files of these names, lines in the order of ``at``; only files are renamed here, one by one."""
    spark = rows.sparkSession
    parts = f"{folder}-parts"
    rows.repartition("name").sortWithinPartitions("name", "at").select("name", "value").write.partitionBy("name").text(parts)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(folder))
    for of_name in (f.getPath() for f in fs.listStatus(path(parts)) if f.isDirectory()):
        for part in (f.getPath() for f in fs.listStatus(of_name) if f.getPath().getName().startswith("part-")):
            fs.rename(part, path(f"{folder}/{of_name.getName().removeprefix('name=')}"))
    return folder


def _spark_array(values) -> str:
    return "array(" + ", ".join("'" + v.replace("'", "\\'") + "'" for v in values) + ")"


def _duck_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns of the two known roles, user messages with an opening; ``ts`` from the ids."""
    at = f"pmod(conv_id * 7 + turn * 3, {len(OPENINGS)})"
    return table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')").selectExpr(
        "cast(conv_id as string) session_id", "turn", "role", "timestamp_seconds(1700000000 + conv_id * 997 + turn * 60) ts",
        f"case when role = 'user' then concat(get({_spark_array(OPENINGS)}, cast({at} as int)), ' ', text) else text end content",
    )


MESSAGES = f"""messages AS (SELECT CAST(conv_id AS VARCHAR) session_id, turn, role, 1700000000 + conv_id * 997 + turn * 60 AS sec,
 CASE WHEN role = 'user' THEN {_duck_list(OPENINGS)}[(conv_id * 7 + turn * 3) % {len(OPENINGS)} + 1] || ' ' || text ELSE text END AS content
 FROM conversations WHERE role IN ('user', 'assistant'))"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk for each document; toxic ones are private."""
    toxic = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return table(spark, sf_dir, "documents").join(toxic, "doc_id", "left").selectExpr(
        "concat('d', doc_id) chunk_id", "source title", "text content", "concat(source, '.md#', source) source", "concat('doc-', doc_id) document_id",
        "concat(source, '.md') source_name", "lang domain", "source category", "case when toxic = 1 then 'private' else 'public' end visibility",
        "'1' version", "'built_in' origin", "0 chunk_index",
    )


CHUNKS = """chunks AS (SELECT 'd' || doc_id AS chunk_id, source AS title, text AS content, source || '.md#' || source AS source, 'doc-' || doc_id AS document_id,
 source || '.md' AS source_name, lang AS domain, source AS category, CASE WHEN toxic = 1 THEN 'private' ELSE 'public' END AS visibility, '1' AS version
 FROM documents LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id))"""


def filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One filter for each language and one for everything public."""
    none = [F.lit(None).cast("string").alias(k) for k in ("document_id", "category", "version", "origin", "visibility")]
    langs = table(spark, sf_dir, "documents").select("lang").distinct()
    own = langs.select(F.concat(F.lit("f_"), "lang").alias("filter_id"), F.col("lang").alias("domain"), *none)
    every = langs.limit(1).select(F.lit("f_all").alias("filter_id"), F.lit(None).cast("string").alias("domain"), *none)
    return own.unionByName(every)


FILTERS = """filters AS (SELECT 'f_' || lang AS filter_id, lang AS domain FROM documents GROUP BY lang UNION ALL SELECT 'f_all', NULL)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as questions; every second one asks in English documents only."""
    return table(spark, sf_dir, "benchmark").selectExpr(
        "item_id query_id", "text query", "case when item_id % 2 = 0 then 'f_en' else 'f_all' end filter_id"
    )


QUESTIONS = """questions AS (SELECT item_id AS query_id, text AS query,
 CASE WHEN item_id % 2 = 0 THEN 'f_en' ELSE 'f_all' END AS filter_id FROM benchmark)"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as a chain of snapshots."""
    from pyspark.sql import Window as W

    name = F.lpad(F.col("event_id").cast("string"), 12, "0")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("thread_id"), F.lit("").alias("checkpoint_ns"), name.alias("checkpoint_id"))
    return rows.withColumn("parent_checkpoint_id", F.lag("checkpoint_id").over(W.partitionBy("thread_id").orderBy("checkpoint_id")))


SNAPSHOTS = """snapshots AS (SELECT CAST(user_id AS VARCHAR) AS thread_id, '' AS checkpoint_ns, lpad(CAST(event_id AS VARCHAR), 12, '0') AS checkpoint_id,
 lag(lpad(CAST(event_id AS VARCHAR), 12, '0')) OVER (PARTITION BY user_id ORDER BY event_id) AS parent_checkpoint_id FROM events)"""


def tok(x: str) -> str:
    """SQL of the tokenizer."""
    return (
        f"flatten(list_transform(regexp_extract_all(lower({x}), '[a-z0-9_]+|[一-鿿]+'), lambda p: CASE WHEN regexp_matches(p, '^[a-z0-9_]') THEN [p] "
        "ELSE list_concat(list_transform(range(1, length(p) + 1), lambda i: substr(p, i, 1)), list_transform(range(1, length(p)), lambda i: substr(p, i, 2))) END))"
    )


STOP = "('如何','怎么','应该','办理','申请','什么','哪里','可以')"


def informative(t: str) -> str:
    return f"((regexp_matches({t}, '^[a-z0-9_]+$') AND length({t}) >= 2) OR (NOT regexp_matches({t}, '^[a-z0-9_]+$') AND length({t}) = 2 AND {t} NOT IN {STOP}))"


BM25 = f"""{CHUNKS}, {FILTERS}, {QUESTIONS},
ctok AS (SELECT chunk_id, domain, visibility, {tok("title || ' ' || title || ' ' || title || ' ' || content")} AS tokens FROM chunks),
postings AS (SELECT chunk_id, domain, visibility, length, term, count(*) AS tf FROM (SELECT chunk_id, domain, visibility, len(tokens) AS length, unnest(tokens) AS term FROM ctok) GROUP BY ALL),
p2 AS (SELECT * FROM postings),
qt AS (SELECT query_id, filter_id, term, count(*) AS qtf FROM (SELECT query_id, filter_id, unnest({tok('query')}) AS term FROM questions) GROUP BY ALL),
qi AS (SELECT query_id, count(*) AS informative FROM qt WHERE {informative('term')} GROUP BY 1),
sizes AS (SELECT filter_id, count(*) AS n, avg(len(tokens)) AS average FROM ctok JOIN filters f ON visibility = 'public' AND (f.domain IS NULL OR f.domain = ctok.domain) GROUP BY 1),
found AS (SELECT q.*, chunk_id, tf, length FROM qt q JOIN filters f USING (filter_id) JOIN p2 p ON p.term = q.term AND visibility = 'public' AND (f.domain IS NULL OR f.domain = p.domain)),
dfs AS (SELECT filter_id, term, count(DISTINCT chunk_id) AS df FROM found GROUP BY ALL),
scored AS (SELECT query_id, chunk_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / average))), 9) AS score,
 count(*) FILTER ({informative('found.term')}) AS met, any_value(informative) AS informative FROM found JOIN dfs USING (filter_id, term) JOIN sizes USING (filter_id) JOIN qi USING (query_id) GROUP BY 1, 2),
ranked AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored WHERE met >= least(2, informative) AND score > 0)"""
