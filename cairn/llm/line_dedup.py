"""Site-relative line dedup: lines that too many of a host's pages share are boilerplate and go.

DataFrame operations only. A line is boilerplate if its pages are more than a given share of all pages of its host.
Two guards are off unless asked for: a least number of pages, without which a host of very few pages has no
line below the share, and pages with the same text as one, as copies of a page say nothing of its template. Lines are counted by hash first, with partial sums before the shuffle; the few
candidates are then counted again by their text, so a hash collision can drop nothing. A host has fewer
boilerplate lines than lines on a page divided by the ratio, so its list is short; the lists are broadcast
only if they were counted to be small, and joined with AQE splitting hot hosts otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import sized

#: A line is boilerplate on more than this share of a host's pages.
RATIO = 0.1


def host_of(url: str) -> Column:
    """The host of a URL column, lower case; null if there is none."""
    return F.lower(F.try_parse_url(F.col(url), F.lit("HOST")))


def boilerplate(df: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, least_pages: int = 1, same_once: bool = False) -> DataFrame:
    """(host, lines array<string>): the boilerplate lines of each host that has any."""
    pages = df.select(df[host_col].alias("host"), df[text_col].alias("text")).where("host IS NOT NULL AND text IS NOT NULL")
    lines = pages.select("host", *[F.xxhash64("text").alias("page")] * same_once, F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).where(F.trim("line") != "")
    enough = (F.col("n") > ratio * F.col("pages")) & (F.col("n") >= least_pages)

    def on_pages(rows: DataFrame, *line: str) -> DataFrame:
        rows = rows.select("host", *line, "page").distinct() if same_once else rows
        return rows.groupBy("host", *line).agg(F.count(F.lit(1)).alias("n"))

    totals = pages.select("host", *[F.xxhash64("text").alias("page")] * same_once)
    totals = (totals.distinct() if same_once else totals).groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    hashed = on_pages(lines.withColumn("hash", F.xxhash64("line")), "hash").where(F.col("n") >= least_pages)
    totals = sized(totals, "hosts")
    few = sized(hashed.join(totals, "host").where(enough).select("host", "hash"), "candidates")
    exact = lines.withColumn("hash", F.xxhash64("line")).join(few, ["host", "hash"], "left_semi")
    return on_pages(exact, "line").join(totals, "host").where(enough).groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def drop_boilerplate(df: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, least_pages: int = 1, same_once: bool = False, dropped_col: str | None = None) -> DataFrame:
    """`df` with boilerplate lines taken out of its texts, every row kept; `dropped_col` counts them if named.

    A row with a null host or text is returned as it is; lines of spaces alone are never boilerplate; a text
    that loses every line becomes empty. Rows that repeat are treated alike. Other columns pass through,
    whatever their names.
    """
    lists = sized(boilerplate(df, host_col, text_col, ratio, least_pages, same_once), "boilerplate").select(F.col("host").alias("__cairn_host"), F.col("lines").alias("__cairn_lines"))
    joined = df.join(lists, df[host_col] == lists["__cairn_host"], "left")
    text, gone = F.col(f"`{text_col}`"), F.col("__cairn_lines")
    cut = F.split(text, "\n")
    kept = F.filter(cut, lambda line: ~F.array_contains(gone, line))
    touched = gone.isNotNull() & F.arrays_overlap(cut, gone)
    out = [F.when(touched, F.array_join(kept, "\n")).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns]
    if dropped_col:
        out.append(F.when(touched, F.size(cut) - F.size(kept)).otherwise(0).alias(dropped_col))
    return joined.select(*out)


ORACLE_SQL = f"""
WITH page AS (SELECT source, text FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
total AS (SELECT source, count(*) AS pages FROM page GROUP BY source),
line AS (SELECT source, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM page),
often AS (
  SELECT source, line FROM line JOIN total USING (source) WHERE trim(line) <> ''
  GROUP BY source, line, pages HAVING count(*) > {RATIO} * pages
),
gone AS (SELECT source, list(line) AS lines FROM often GROUP BY source),
cut AS (
  SELECT doc_id, text, lines, string_split(text, chr(10)) AS parts,
         [x FOR x IN string_split(text, chr(10)) IF NOT list_contains(lines, x)] AS kept
  FROM documents LEFT JOIN gone USING (source)
)
SELECT doc_id, CASE WHEN lines IS NULL OR text IS NULL THEN text ELSE array_to_string(kept, chr(10)) END AS text,
       CAST(CASE WHEN lines IS NULL OR text IS NULL THEN 0 ELSE len(parts) - len(kept) END AS INTEGER) AS n_dropped
FROM cut
"""
