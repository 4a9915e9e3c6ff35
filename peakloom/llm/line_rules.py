"""Quality rules with line frequencies across documents.

The rules of one document are array expressions over its words. The rule across documents counts, per host, the
distinct documents of every normalised line; lines above the limit are removed, and a document from which too much went
is rejected. All of it is DataFrame functions; only digests and counts are shuffled, never texts, until the places of removed lines are joined to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from peakloom.llm.common import NOT_SPACE, SPACE, digest, let, lines_with_words, normal_line, row_key, whole_text, words_of
from peakloom.session import cut_lineage

WINDOW = 8


def repeated_words(words: Column, n: int = WINDOW) -> Column:
    """Number of words inside n-word windows that occur at least twice in the text, first occurrence included.

    Windows are compared by 64-bit hashes within one text: for a text of a million words the chance of a false match is
    3 in 10^8. Sorting is done only for texts whose windows are not all distinct.
    """

    def sorted_positions(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            here = lambda j: F.get(s, j)["h"]
            marked = F.transform(s, lambda e, j: F.when((e["h"] == here(j - 1)) | (e["h"] == here(j + 1)), e["i"]))
            return F.sort_array(F.filter(marked, lambda x: x.isNotNull()))

        return let(pairs, repeated)

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(n), F.coalesce(F.get(p, i + 1) - x, F.lit(n))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def of_windows(windows: Column) -> Column:
        distinct = F.size(F.array_distinct(windows)) == F.size(windows)
        return F.when(distinct, F.lit(0).cast("long")).otherwise(let(sorted_positions(windows), covered))

    def of_hashes(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(h) - (n - 1)), lambda i: F.xxhash64(F.slice(h, i, n)))
        return F.when(F.size(h) < n + 1, F.lit(0).cast("long")).otherwise(let(windows, of_windows))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def text_rules(df: DataFrame) -> DataFrame:
    """Adds the counts of one document and ``base_failed`` to (doc_id, host, _key, text)."""
    text = whole_text()
    of_words = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))
    lines = let(lines_with_words(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    rules = df.select(
        "doc_id", "_host", "_key", "text", of_words.alias("w"),
        F.char_length(F.regexp_replace(text, f"{SPACE}+", "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        lines.alias("n_dup_lines"),
    )
    failed = (F.col("w.n") < 20) | (F.col("w.r") * 100 > F.col("w.n") * 30)
    return rules.select(
        "doc_id", "_host", "_key", "text", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        F.col("w.r").alias("n_repeat_words"), failed.alias("base_failed"),
    )


def _with_host(df: DataFrame, host: str) -> DataFrame:
    return df.select("doc_id", "text", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"), row_key().alias("_key"))


def _lines(df: DataFrame) -> DataFrame:
    """Lines with words: doc_id, _host, _key, pos (among all lines of the text), line (digest) and words."""
    numbered = F.transform(F.split(whole_text(), "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("x")))
    line = F.transform(
        F.filter(numbered, lambda s: s["x"].rlike(NOT_SPACE)),
        lambda s: F.struct(s["pos"].alias("pos"), digest(normal_line(s["x"])).alias("line"), F.size(words_of(s["x"])).cast("long").alias("words")),
    )
    return df.select("doc_id", "_host", "_key", F.explode(line).alias("x")).select(
        "doc_id", "_host", "_key", F.col("x.pos").alias("pos"), F.col("x.line").alias("line"), F.col("x.words").alias("words")
    )


def _without_lines(text: Column, gone: Column) -> Column:
    """The text without the lines at the places ``gone``. The places that stay are a set difference of numbers."""

    def left(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    return let(F.split(text, "\n"), left)


def frequent_lines(df: DataFrame, host: str = "source", max_docs: int = 20, max_share: float = 0.01) -> DataFrame:
    """(host, line digest, n_docs) of the lines found in more than ``max(max_docs, max_share * documents of the host)``
    distinct documents of the host. A document is a doc_id; rows without one are told apart by their text."""
    return _frequent(_with_host(df, host), max_docs, max_share)


def _frequent(d: DataFrame, max_docs: int, max_share: float) -> DataFrame:
    # two levels of partial aggregation: a line that stands everywhere is counted over many tasks
    doc = F.coalesce(F.col("doc_id").cast("string"), F.hex("_key"))
    seen = _lines(d).select("_host", "line", doc.alias("doc")).distinct().groupBy("_host", "line").agg(F.count(F.lit(1)).alias("n_docs"))
    hosts = d.select("_host", doc.alias("doc")).distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("host_docs"))
    limit = F.greatest(F.lit(float(max_docs)), F.col("host_docs") * F.lit(float(max_share)))
    return seen.filter(F.col("n_docs") > max_docs).join(hosts, "_host").filter(F.col("n_docs") > limit).select("_host", "line", "n_docs")


def judge(
    df: DataFrame, host: str = "source", max_docs: int = 20, max_share: float = 0.01, min_left: float = 0.3
) -> DataFrame:
    """Per row: doc_id, the counts of ``text_rules``, n_removed_words, text, depleted and kept.

    ``text`` is the input text without the lines above the limit; a null text stays null. ``depleted``: less than the share ``min_left`` of the words is left after removal. ``kept``: neither ``base_failed`` nor depleted. Null and empty texts have no words and fail the base rule. A
    null host is a host of its own. Equal rows get equal results; an empty table gives no rows; other columns are ignored.
    """
    d = _with_host(df, host)
    frequent = cut_lineage(_frequent(d, max_docs, max_share))
    # equal rows have one key, and each adds its words: the sums are divided by the rows of the key
    hit = _lines(d).join(frequent.select("_host", "line"), ["_host", "line"]).groupBy("_key").agg(
        F.sum("words").alias("hit_words"), F.collect_set("pos").alias("gone")
    )
    copies = d.groupBy("_key").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    removed = hit.join(copies, "_key", "left").select(
        "_key", (F.col("hit_words") / F.coalesce("copies", F.lit(1))).cast("long").alias("n_removed_words"), "gone"
    )
    rules = text_rules(d).join(removed, "_key", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (F.col("n_removed_words") > 0) & (left < F.col("n_words") * F.lit(min_left))
    cleaned = F.when(F.col("gone").isNull(), F.col("text")).otherwise(_without_lines(F.col("text"), F.col("gone")))
    judged = rules.withColumn("depleted", depleted).withColumn("kept", ~F.col("base_failed") & ~depleted)
    return judged.withColumn("text", cleaned).drop("_key", "_host", "gone")
