"""Quality rules: a threshold table compiled into one chain of projections.

Every measure is a built-in expression over one row, so the plan is a scan, projections and nothing else: no shuffle, no
user function, memory bounded by one text.

Defined cases: a null or blank text has no words, so `base_failed` is true and every measure is 0. Ratios over zero words
count as 0. Repeated rows and ties give equal results row by row; extra columns are ignored. An empty table gives no rows.
Window equality is tested on 64-bit hashes of the five words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hornloom.llm._shared import WORD_SPACE, words

#: The characters counted as symbols, and frequent function words of the four languages.
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "the and of to in is that it for was on are as with be by at this or from an "
    "le la les de des du et un une en que qui pour dans est par sur au "
    "der die das und den von zu mit ein eine einer dem nicht ist sich auf "
    "el los las y una por con para del al se su es no"
).split()


@dataclass(frozen=True)
class Threshold:
    """A text is kept if low <= measure <= high; None leaves that side open."""

    measure: str
    low: float | None = None
    high: float | None = None


#: Production parameters: length, symbol, stop-word and line ratios.
THRESHOLDS = (
    Threshold("n_words", low=10),
    Threshold("mean_word_length", low=2.0, high=14.0),
    Threshold("symbol_ratio", high=0.2),
    Threshold("shout_ratio", high=0.3),
    Threshold("stop_word_ratio", low=0.03),
    Threshold("dup_line_ratio", high=0.3),
    Threshold("ellipsis_line_ratio", high=0.3),
    Threshold("bullet_line_ratio", high=0.9),
)

WINDOW = 5


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def _starts(lines: Column, pattern: str) -> Column:
    return F.size(F.filter(lines, lambda x: x.rlike(pattern)))


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and every measure of the text, one row for each row of docs."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(*keep, t.alias("_t"))
    d = d.select(
        *keep,
        words(F.col("_t")).alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"),
        F.length(F.translate("_t", WORD_SPACE, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("_t") - F.length(F.translate("_t", "!", ""))).cast("long").alias("n_shouts"),
    )
    windows = F.transform(F.sequence(F.lit(0), F.size("_w") - WINDOW), lambda i: F.xxhash64(*(F.get("_w", i + k) for k in range(WINDOW))))
    d = d.select(
        *keep, "word_chars", "n_symbols", "n_shouts",
        F.size("_w").cast("long").alias("n_words"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _starts(F.col("_l"), r"(\.\.\.|…)[\x20\x09-\x0D]*$").cast("long").alias("n_ellipsis_lines"),
        _starts(F.col("_l"), r"^[\x20\x09-\x0D]*[•●*-]").cast("long").alias("n_bullet_lines"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.when(F.size("_w") >= WINDOW, windows).alias("_h"),
    )
    plain = [c for c in d.columns if c != "_h"]
    # Only texts with a repeated window pay for the sort; equal windows are then neighbours.
    paired = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    d = d.select(*plain, F.when(F.size(F.array_distinct("_h")) < F.size("_h"), paired).alias("_s"))
    twin = lambda x, i: F.coalesce(x.h == F.get("_s", i - 1).h, F.lit(False)) | F.coalesce(x.h == F.get("_s", i + 1).h, F.lit(False))
    d = d.select(*plain, F.sort_array(F.transform(F.filter("_s", twin), lambda x: x.p)).alias("_p"))
    first = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate("_p", first, lambda a, p: F.struct((a.n + F.least(F.lit(WINDOW), p - a.last)).alias("n"), p.alias("last")), lambda a: a.n)
    d = d.select(*plain, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    return d.select(
        "*",
        _ratio(F.col("word_chars"), F.col("n_words")).alias("mean_word_length"),
        _ratio(F.col("n_symbols"), F.col("n_words")).alias("symbol_ratio"),
        _ratio(F.col("n_shouts"), F.col("n_words")).alias("shout_ratio"),
        _ratio(F.col("n_stop_words"), F.col("n_words")).alias("stop_word_ratio"),
        _ratio(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_ratio"),
        _ratio(F.col("n_ellipsis_lines"), F.col("n_lines")).alias("ellipsis_line_ratio"),
        _ratio(F.col("n_bullet_lines"), F.col("n_lines")).alias("bullet_line_ratio"),
    )


def verdict(thresholds: tuple[Threshold, ...] = THRESHOLDS) -> Column:
    """The table as one boolean expression over the measures."""
    out = F.lit(True)
    for t in thresholds:
        if t.low is not None:
            out = out & (F.col(t.measure) >= t.low)
        if t.high is not None:
            out = out & (F.col(t.measure) <= t.high)
    return out


def quality(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), thresholds: tuple[Threshold, ...] = THRESHOLDS) -> DataFrame:
    """`measure`, with base_failed (too short, or over a fifth repeated) and kept."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measure(docs, text, keep).withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(thresholds))


def sql(thresholds: tuple[Threshold, ...] = THRESHOLDS) -> str:
    """The query over `documents` as DuckDB SQL: windows and lines are unnested and counted."""
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    tests = [f"{t.measure} {op} {bound}" for t in thresholds for op, bound in ((">=", t.low), ("<=", t.high)) if bound is not None]
    ratio = lambda a, b: f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0.0 END"
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
    n AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i+{WINDOW - 1}], ' ')) AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
    r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM n, range({WINDOW}) AS x(k) WHERE c > 1 GROUP BY doc_id),
    m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
            length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols, length(t) - length(translate(t, '!', '')) AS n_shouts,
            CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
            len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS n_stop_words,
            len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines, len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[•●*-]'))) AS n_bullet_lines
          FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
    q AS (SELECT *, {ratio("word_chars", "n_words")} AS mean_word_length, {ratio("n_symbols", "n_words")} AS symbol_ratio, {ratio("n_shouts", "n_words")} AS shout_ratio, {ratio("n_stop_words", "n_words")} AS stop_word_ratio,
            {ratio("n_dup_lines", "n_lines")} AS dup_line_ratio, {ratio("n_ellipsis_lines", "n_lines")} AS ellipsis_line_ratio, {ratio("n_bullet_lines", "n_lines")} AS bullet_line_ratio FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
           NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND {" AND ".join(tests)} AS kept FROM q"""
