"""Heuristic quality rules: a threshold table compiled into one projection of native expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.common import BLANK

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Frequent function words by language (fixed values).
STOP_WORDS = {
    "en": "the be to of and that have with is in a it for was on are this by",
    "de": "der die das und ist nicht mit von zu den ein eine im sich auf des auch es in",
    "fr": "le la les de des et un une est que dans pour pas sur du qui au avec en",
    "es": "el la los las de que y en un una es no por con para del se su al",
}
#: Verdict: each metric has to lie within its bounds (null: open). A rule may be replaced, added or removed.
RULES: dict[str, tuple[float | None, float | None]] = {
    "mean_word_chars": (2.0, 14.0),
    "symbol_ratio": (None, 0.2),
    "stop_word_ratio": (0.05, None),
    "dup_line_ratio": (None, 0.4),
    "ellipsis_line_ratio": (None, 0.3),
    "bullet_line_ratio": (None, 0.9),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for all its uses in ``body``, even inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_column(text: Column) -> Column:
    """Words between ASCII blanks; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{BLANK}+"), lambda w: w != "")


def repeated_words(hashes: Column, width: int = WINDOW) -> Column:
    """Words inside windows that occur at least twice, from the hashes of all windows in order.

    The hashes are sorted twice at most: alone, to see whether any repeats, and only then with
    their places, of which the repeated ones are merged into covered stretches.
    """

    def repeats(s: Column) -> Column:
        return F.exists(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.get(s, i) == F.get(s, i - 1))

    def covered(s: Column) -> Column:
        same = F.filter(
            s,
            lambda e, j: (F.get(s, j - 1)["h"] == e["h"]).eqNullSafe(F.lit(True)) | (F.get(s, j + 1)["h"] == e["h"]).eqNullSafe(F.lit(True)),
        )
        return let(
            F.sort_array(F.transform(same, lambda e: e["i"])),
            lambda p: F.aggregate(
                F.transform(p, lambda x, j: F.least(F.lit(width), F.coalesce(F.get(p, j + 1) - x, F.lit(width)))),
                F.lit(0).cast("long"),
                lambda a, x: a + x,
            ),
        )

    some = let(F.sort_array(hashes), repeats)
    places = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when((F.size(hashes) > 1) & some, let(places, covered)).otherwise(F.lit(0).cast("long"))


def _with_next(step: int) -> Callable[[Column, Column], Column]:
    return lambda h, i: F.xxhash64(h, F.get("_windows", i + step))


def quality_metrics(
    docs: DataFrame, stop_words: Mapping[str, str] = STOP_WORDS, symbols: str = SYMBOLS, width: int = WINDOW
) -> DataFrame:
    """``docs`` with the metrics that quality rules test; see :func:`quality_rules`.

    ``width`` is a power of two. Stop words count in lower case and capitalised.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lists = sorted({x for words in stop_words.values() for w in words.split() for x in (w, w.capitalize())})
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    split = docs.select(
        "*",
        words_column(F.col("text")).alias("_words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    # a window's hash by doubling: of 1, 2, 4 and 8 words from each place
    hashed = split.withColumn("_windows", F.transform("_words", lambda w: F.xxhash64(w)))
    for step in (1 << b for b in range(width.bit_length() - 1)):
        hashed = hashed.withColumn("_windows", F.transform("_windows", _with_next(step)))
    whole = F.greatest(F.size("_windows") - (width - 1), F.lit(0))
    hashed = hashed.withColumn("_windows", F.slice("_windows", F.lit(1), whole))
    counted = hashed.select(
        *docs.columns,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(f"[{re.escape(symbols)}]")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_windows"), width).alias("n_repeat_words"),
        F.size(F.filter("_words", lambda w: w.isin(lists))).cast("long").alias("n_stop_words"),
        F.size(F.filter("_lines", lambda x: x.rlike(r"(?:\.\.\.|\x{2026})[\x20\x09-\x0D]*$"))).cast("long").alias("_ellipsis"),
        F.size(F.filter("_lines", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*\x{2022}]\x20"))).cast("long").alias("_bullets"),
    )
    return counted.select(
        "*",
        ratio(F.col("word_chars"), F.col("n_words")).alias("mean_word_chars"),
        ratio(F.col("n_symbols"), F.col("n_words")).alias("symbol_ratio"),
        ratio(F.col("n_stop_words"), F.col("n_words")).alias("stop_word_ratio"),
        ratio(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_ratio"),
        ratio(F.col("_ellipsis"), F.col("n_lines")).alias("ellipsis_line_ratio"),
        ratio(F.col("_bullets"), F.col("n_lines")).alias("bullet_line_ratio"),
    ).drop("_ellipsis", "_bullets")


def verdict(rules: Mapping[str, Sequence[float | None]] = RULES) -> tuple[Column, Column]:
    """The names of the rules that a row breaks, and whether it breaks none."""
    tests = []
    for name, (least, most) in rules.items():
        bad = F.lit(False)
        if least is not None:
            bad = bad | (F.col(name) < least)
        if most is not None:
            bad = bad | (F.col(name) > most)
        tests.append(F.when(bad, F.lit(name)))
    broken = F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")
    return broken, F.size(broken) == 0


def base_failure(least_words: int = 20, most_repeated_percent: int = 30) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated_percent * F.col("n_words"))


def quality_rules(
    docs: DataFrame,
    rules: Mapping[str, Sequence[float | None]] = RULES,
    stop_words: Mapping[str, str] = STOP_WORDS,
    least_words: int = 20,
    most_repeated_percent: int = 30,
) -> DataFrame:
    """One row per input row: ``doc_id``, the metrics, ``base_failed``, ``broken_rules`` and ``kept``.

    Words lie between ASCII blanks. ``base_failed``: fewer than ``least_words`` words, or more
    than ``most_repeated_percent`` of them inside 8-word windows found twice or more. ``kept``: not
    base_failed, and every metric within its bounds in ``rules``.

    It is one projection over the scan: no shuffle, no user function. Windows are compared by
    their 64-bit hashes inside one text.

    Defined cases: null, empty or blank text has no words, so it fails the base rule; ratios over
    zero are 0; a null doc_id stays null; repeated rows are judged alike; an empty table gives no
    rows; columns other than doc_id and text are neither read nor returned.
    """
    broken, passed = verdict(rules)
    measured = quality_metrics(docs.select("doc_id", F.col("text").cast("string").alias("text")), stop_words).drop("text")
    failed = base_failure(least_words, most_repeated_percent)
    return _settled(measured.select("*", failed.alias("base_failed"), broken.alias("broken_rules"), (~failed & passed).alias("kept")))


def quality_filter(docs: DataFrame, rules: Mapping[str, Sequence[float | None]] = RULES) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_rules` keeps, with all their columns, in the same one pass."""
    measured = quality_metrics(docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text")))
    kept = ~base_failure() & verdict(rules)[1]
    return _settled(measured.select("row", kept.alias("kept"))).where("kept").select("row.*")


def _settled(df: DataFrame) -> DataFrame:
    """The same rows; filters on them stay above.

    A filter pushed below the steps that hash windows would repeat those steps for every word.
    """
    return df.select(F.explode_outer(F.array(F.struct(*df.columns))).alias("_s")).select("_s.*")
