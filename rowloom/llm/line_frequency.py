"""Quality rules by cross-document line frequency (DataFrame functions only).

Lines are normalised (lower case, white space folded) and hashed. For each host the distinct documents
that hold a line are counted; exact copies of a text are one document. A line over the limits is boilerplate,
is removed, and a document that keeps too few of its words is rejected.

A step of its own sees to near copies, which would take each other's text for boilerplate: documents in which
lines over the limit make up more than 0.8 of the words, all with the same set of such lines, are near copies
of one another and count as one document. Documents with more text of their own always count.

Scale: texts are read once and reduced to one narrow feature row a document, written to the shared
folder. Line counts combine on the map side, so a line that a third of all documents hold is one row
from each task. Only lines that pass the plain count reach the second count.

Defined results: null text counts as the empty text (no words, base rule fails); a null host is a host
of its own; repeated rows get the same verdict each; an empty table gives no rows; columns of the input
with the names of result columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import own_columns, written

GAP = r"[\x20\x09-\x0D]+"
WINDOW = 5
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, GAP, -1), lambda w: w != "")


def repeat_words(words: Column, width: int = WINDOW) -> Column:
    """Words inside width-word windows that occur twice or more, first occurrence included."""

    def windows(h: Column) -> Column:
        return F.transform(F.slice(h, 1, F.greatest(F.size(h) - (width - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, width)]))

    def covered(w: Column) -> Column:
        order = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(order, lambda s: F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        spans = let(starts, lambda p: F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width)))))
        return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x)

    hashes = F.transform(words, lambda x: F.xxhash64(x))
    return let(let(hashes, windows), lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0).cast("long")))


def text_key(text: str, host: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(host))


def features(docs: DataFrame, keys: list[str], text: str = "text", host: str = "source") -> DataFrame:
    """keys, host, text_key, the statistics and, for each line with a word, its hash and words."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = docs.select(
        *keys,
        F.col(host).alias("__host"),
        text_key(text, host).alias("__key"),
        body.alias("__text"),
        words_of(body).alias("__words"),
        lines.alias("__lines"),
    )
    norm = F.transform("__lines", lambda x: F.trim(F.regexp_replace(F.lower(x), GAP, " ")))
    return split.select(
        *keys,
        "__host",
        "__key",
        F.size("__words").cast("long").alias("n_words"),
        F.aggregate("__words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        (F.length("__text") - F.length(F.regexp_replace("__text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("__words")).alias("n_repeat_words"),
        F.transform(norm, lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " ")).alias("n"))).alias("__marks"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def frequent_lines(marks: DataFrame, min_docs: int, share: float, own: float) -> DataFrame:
    """(__host, __line) of lines that at least min_docs and share of a host's distinct documents hold."""
    distinct = marks.groupBy("__host", "__key").agg(F.first("__marks").alias("__marks"), F.first("n_words").alias("n_words"))
    each = distinct.select("__host", "__key", "n_words", F.explode_outer("__marks").alias("__m"))
    lines = written(each.groupBy("__host", "__key", F.col("__m.h").alias("__line")).agg(F.sum("__m.n").alias("__n"), F.first("n_words").alias("n_words")), "lines")
    hosts = lines.select("__host", "__key").distinct().groupBy("__host").agg(F.greatest(F.lit(float(min_docs)), F.lit(share) * F.count("*")).alias("__limit"))
    held = lines.where(F.col("__line").isNotNull())

    def over(counts: DataFrame) -> DataFrame:
        c, h = counts.alias("c"), hosts.alias("h")
        return c.join(h, F.col("c.__host").eqNullSafe(F.col("h.__host"))).where(F.col("c.__docs") >= F.col("h.__limit")).select("c.__host", "c.__line")

    # a line below min_docs is under every limit; that leaves few rows for the join
    often = over(held.groupBy("__host", "__line").agg(F.count("*").alias("__docs")).where(F.col("__docs") >= min_docs))
    a, b = held.alias("a"), often.alias("b")
    hits = a.join(b, F.col("a.__host").eqNullSafe(F.col("b.__host")) & (F.col("a.__line") == F.col("b.__line"))).select("a.*")
    docs = hits.groupBy("__host", "__key").agg(F.sum("__n").alias("__often"), F.first("n_words").alias("n_words"), F.sort_array(F.collect_set("__line")).alias("__lines"))
    copies = F.col("n_words") - F.col("__often") < F.lit(own) * F.col("n_words")
    counted = docs.select("__host", F.when(copies, F.xxhash64("__lines", F.lit("copies"))).otherwise(F.col("__key")).alias("__as"), F.explode("__lines").alias("__line"))
    return over(counted.distinct().groupBy("__host", "__line").agg(F.count("*").alias("__docs")))


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", min_docs: int = 20, share: float = 0.1, min_words: int = 10, min_left: float = 0.2) -> DataFrame:
    """One row per document: key, the statistics, removed line hashes, words left, base_failed and kept.

    A line goes if at least max(min_docs, share of the host's distinct documents) of these hold it, near copies
    counting as one (less than min_left of their words are in lines of their own). A document is depleted if a line went and fewer than min_words words, or less than min_left
    of its words, remain.
    """
    marks = written(features(docs.select(key, text, host) if len({key, text, host}) == 3 else docs, [key], text, host), "marks")
    often = frequent_lines(marks, min_docs, share, min_left)
    held = marks.select(key, "__key", "__host", F.explode(F.array_distinct(F.transform("__marks", lambda m: m["h"]))).alias("__line"))
    a, b = held.alias("a"), often.alias("b")
    hits = a.join(b, F.col("a.__host").eqNullSafe(F.col("b.__host")) & (F.col("a.__line") == F.col("b.__line")), "left_semi")
    gone = hits.groupBy(F.col(key).alias("__id"), F.col("__key").alias("__key2")).agg(F.collect_set("__line").alias("removed"))
    out = marks.join(gone, F.col(key).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__key2")), "left")
    left = F.when(F.col("removed").isNull(), F.col("n_words")).otherwise(
        F.aggregate(F.filter("__marks", lambda m: ~F.array_contains(F.col("removed"), m["h"])), F.lit(0).cast("long"), lambda s, m: s + m["n"])
    )
    out = out.withColumn("n_words_left", left)
    depleted = F.col("removed").isNotNull() & ((F.col("n_words_left") < min_words) | (F.col("n_words_left") < min_left * F.col("n_words")))
    return out.select(key, "__key", *STATS, "removed", "n_words_left", base_failed().alias("base_failed"), (~base_failed() & ~depleted).alias("kept"))


def without_lines(text: Column, removed: Column) -> Column:
    """text without the lines whose normalised hash is in removed."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~F.array_contains(removed, F.xxhash64(F.trim(F.regexp_replace(F.lower(x), GAP, " "))))), "\n")


def filtered(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", length: str | None = "n_chars", **limits) -> DataFrame:
    """The documents that the rules keep, without their boilerplate lines; the columns of docs.

    Verdicts that change nothing are left out of the join, so its small side holds only documents that
    go or lose lines; the texts move at most once.
    """
    verdicts = judged(docs, key, text, host, **limits).where(~F.col("kept") | F.col("removed").isNotNull())
    small = verdicts.groupBy(F.col(key).alias("__id"), F.col("__key").alias("__key2")).agg(F.first("removed").alias("__removed"), F.min("kept").alias("__kept"))
    joined = docs.withColumn("__key", text_key(text, host)).join(small, F.col(key).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__key2")), "left")
    joined = joined.where(F.coalesce(F.col("__kept"), F.lit(True)))
    cleaned = F.when(F.col("__removed").isNull(), F.col(text)).otherwise(without_lines(F.col(text), F.col("__removed")))
    joined = joined.withColumn(text, cleaned)
    if length and length in docs.columns:
        joined = joined.withColumn(length, F.when(F.col("__removed").isNull(), F.col(length)).otherwise(F.length(text).cast(docs.schema[length].dataType)))
    return joined.select(*docs.columns)


def op5_line_frequency(docs: DataFrame) -> DataFrame:
    """The contract's columns; n_words_left and n_lines_removed besides."""
    out = judged(own_columns(docs, STATS))
    return out.select("doc_id", *STATS, "base_failed", "kept", "n_words_left", F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed_lines"))


#: The same in SQL. nw: the words of a text that are in lines over the plain limit; c: as which document it counts.
OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
 w AS (SELECT rid, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
 win AS (SELECT rid, i, list_slice(ws, i, i + 4) AS win FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
 twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM win) WHERE n > 1),
 rep AS (SELECT rid, count(DISTINCT i + j) AS n_repeat_words FROM twice, range(0, 5) AS g(j) GROUP BY rid),
 raw AS (SELECT rid, source, unnest(string_split(t, chr(10))) AS line FROM d),
 l AS (SELECT rid, source, line, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM raw
       WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
 dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY rid),
 u AS (SELECT DISTINCT rid, source, norm FROM l),
 one AS (SELECT min(rid) AS rid FROM d GROUP BY source, t),
 hosts AS (SELECT source, greatest(20.0, 0.1 * count(DISTINCT t)) AS lim FROM d GROUP BY source),
 plain AS (SELECT u.source, u.norm FROM u JOIN one USING (rid) JOIN hosts ON u.source IS NOT DISTINCT FROM hosts.source
           GROUP BY u.source, u.norm, hosts.lim HAVING count(*) >= hosts.lim),
 nw AS (SELECT l.rid, sum(len(string_split(l.norm, ' '))) AS n_often, array_to_string(list_sort(list(DISTINCT l.norm)), chr(10)) AS norms
        FROM l JOIN one USING (rid) JOIN plain p ON l.source IS NOT DISTINCT FROM p.source AND l.norm = p.norm GROUP BY l.rid),
 c AS (SELECT nw.rid, CASE WHEN len(w.ws) - n_often < 0.2 * len(w.ws) THEN 'c' || norms ELSE 'd' || nw.rid END AS doc FROM nw JOIN w USING (rid)),
 often AS (SELECT u.source, u.norm FROM u JOIN c USING (rid) JOIN plain p ON u.source IS NOT DISTINCT FROM p.source AND u.norm = p.norm
           JOIN hosts ON u.source IS NOT DISTINCT FROM hosts.source GROUP BY u.source, u.norm, hosts.lim HAVING count(DISTINCT doc) >= hosts.lim),
 gone AS (SELECT u.rid, u.norm FROM u JOIN often ON u.source IS NOT DISTINCT FROM often.source AND u.norm = often.norm),
 kept_lines AS (SELECT l.rid, coalesce(sum(len(string_split(l.norm, ' '))) FILTER (WHERE g.norm IS NULL), 0) AS n_left
                FROM l LEFT JOIN gone g ON l.rid = g.rid AND l.norm = g.norm GROUP BY l.rid),
 cut AS (SELECT rid, count(*) AS n_removed FROM gone GROUP BY rid),
 s AS (SELECT d.doc_id, len(w.ws) AS n_words, length(regexp_replace(d.t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
   length(d.t) - length(regexp_replace(d.t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n_dup_lines, 0) AS n_dup_lines,
   coalesce(rep.n_repeat_words, 0) AS n_repeat_words, coalesce(cut.n_removed, 0) AS n_removed, coalesce(kl.n_left, 0) AS n_left
  FROM d JOIN w USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN cut USING (rid) LEFT JOIN kept_lines kl USING (rid)),
 f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, CASE WHEN n_removed > 0 THEN n_left ELSE n_words END AS n_words_left FROM s)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
 n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT (n_removed > 0 AND (n_words_left < 10 OR n_words_left < 0.2 * n_words)) AS kept,
 n_words_left::BIGINT AS n_words_left, n_removed::INTEGER AS n_removed_lines
FROM f
"""
