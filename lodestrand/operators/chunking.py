"""Markdown documents to chunks: sections, long texts, ids."""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.functions.text import strip

#: Characters that end a line.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
BOUNDARIES = "\n。！？;；"


def _opened_sections(blocks: Column, title: Column) -> Column:
    """Sections ``(section, title, content)`` of a document's blocks, by a state that goes from heading to heading.

    The state is the running number, the document's own title, the open title, and whether the block before has content.
    """
    section = "section int, title string, content string"
    start = F.struct(
        F.lit(0).alias("n"), F.lit(None).cast("string").alias("h1"), F.lit(None).cast("string").alias("name"), F.lit(False).alias("prior"),
        F.array().cast(f"array<struct<{section.replace(' ', ':').replace(',:', ',')}>>").alias("out"),
    )

    def step(state: Column, x: Column) -> Column:
        opens = (x["level"] >= 2) | ((x["level"] == 1) & state["prior"])
        n = state["n"] + F.when(opens, 1).otherwise(0)
        h1 = F.when(x["level"] == 1, x["heading"]).otherwise(state["h1"])
        name = F.when(x["level"] >= 2, F.concat(F.coalesce(h1, title), F.lit(" - "), x["heading"])).when(x["level"] == 1, x["heading"]).otherwise(state["name"])
        some = x["content"] != ""
        new = F.struct(n.alias("section"), F.coalesce(name, title).alias("title"), x["content"].alias("content"))
        return F.struct(n.alias("n"), h1.alias("h1"), name.alias("name"), some.alias("prior"), F.when(some, F.concat(state["out"], F.array(new))).otherwise(state["out"]).alias("out"))

    return F.aggregate(blocks, start, step, lambda state: state["out"])


def split_sections(docs: DataFrame) -> DataFrame:
    """``(document_id, section, title, content)`` of Markdown ``(document_id, text, title)``; extra columns are kept.

    A heading starts in the first column with one to three marks. One mark sets the document's title
    and opens a section only if the open one has content; two and three always open one, titled
    "document - heading". All of it happens inside the row: the lines between two headings are a block,
    and a state goes over the blocks. Nothing is shuffled.
    """
    keep = [c for c in docs.columns if c not in ("text", "title")]
    lines = docs.select(*keep, "title", F.split(F.regexp_replace("text", f"(?:{LINE_END})$", ""), LINE_END).alias("lines"))
    # what follows one mark or two or three in the first column, but no fourth
    pattern = r"(?U)^(#{1,3})\s+(\S.*?)\s*$"
    level = lambda line: F.when(line.startswith("#"), F.length(F.regexp_extract(line, pattern, 1))).otherwise(0)
    first = F.struct(F.lit(-1).alias("at"), F.lit(0).alias("level"), F.lit("").alias("heading"))
    marked = F.transform("lines", lambda line, i: F.when(level(line) > 0, F.struct(i.alias("at"), level(line).alias("level"), F.regexp_extract(line, pattern, 2).alias("heading"))))
    headed = lines.select(*keep, "title", "lines", F.concat(F.array(first), F.filter(marked, lambda x: x.isNotNull())).alias("heads"))
    end = lambda i: F.coalesce(F.get("heads", i + 1)["at"], F.size("lines"))
    rows = lambda x, i: F.slice("lines", x["at"] + 2, F.greatest(end(i) - x["at"] - 1, F.lit(0)))
    block = lambda x, i: F.struct(x["level"].alias("level"), x["heading"].alias("heading"), strip(F.array_join(rows(x, i), "\n")).alias("content"))
    blocks = headed.select(*keep, "title", F.transform("heads", block).alias("blocks"))
    return blocks.select(*keep, F.inline(_opened_sections(F.col("blocks"), F.col("title"))))


def split_text(text: str, most: int = 1200, overlap: int = 120) -> list[str]:
    """Pieces of at most ``most`` characters, cut after the last boundary of the second half, with ``overlap``."""
    if len(text) <= most:
        return [text.strip()] if text.strip() else []
    marks = [m.start() for m in re.finditer(f"[{BOUNDARIES}]", text)]
    spans = [(0, 0)]
    while spans[-1][1] < len(text):
        first = max(spans[-1][0] + 1, spans[-1][1] - overlap) if spans[-1][1] else 0
        last = first + most
        if last < len(text):
            at = bisect_left(marks, last) - 1
            last = marks[at] + 1 if at >= 0 and marks[at] >= first + most // 2 else last
        spans.append((first, min(last, len(text))))
    return [p for p in (text[a:b].strip() for a, b in spans[1:]) if p]


def split_long(most: int = 1200, overlap: int = 120):
    """The splitter as a vectorised function of a text column to an array of pieces; its loop depends on the data."""

    @F.pandas_udf("array<string>")
    def split(text: pd.Series) -> pd.Series:
        return text.map(lambda t: split_text(t, most, overlap) if t else [])

    return split


def build_chunks(docs: DataFrame, most: int = 1200, overlap: int = 120, prefix: str = "document_id") -> DataFrame:
    """Chunks of Markdown documents ``(document_id, source_name, title, text)``; other columns are kept as metadata.

    ``chunk_id`` is "document-section-part" (of the built-in corpus "title-section-part": ``prefix`` names the column),
    ``source`` is "name#title" and ``chunk_index`` is section * 1000 + part. Lines are stripped and blank ones dropped.
    """
    sections = split_sections(docs.withColumn("_prefix", F.col(prefix)))
    clean = F.array_join(F.filter(F.transform(F.split("content", LINE_END), strip), lambda x: x != ""), "\n")
    parts = sections.withColumn("content", clean).select("*", F.posexplode(split_long(most, overlap)("content")).alias("part", "piece"))
    return parts.select(
        F.concat_ws("-", "_prefix", "section", "part").alias("chunk_id"), "title", F.col("piece").alias("content"),
        F.concat("source_name", F.lit("#"), "title").alias("source"), (F.col("section") * 1000 + F.col("part")).cast("int").alias("chunk_index"),
        *(c for c in sections.columns if c not in ("section", "title", "content", "_prefix")),
    )
