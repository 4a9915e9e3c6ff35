"""Secret scan with multipart credential linking.

Strong patterns are reported by themselves. Weaker candidates (identifiers, random-looking strings, service addresses)
are reported only when complementary parts stand near them in the same scope. Text is read once; from there on only
positions move. A span is found by two array expressions of one pattern: ``split`` gives the gaps and
``regexp_extract_all`` the matches, and their running lengths are the positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from peakloom.llm.common import fresh, let, row_key, whole_text
from peakloom.session import cut_lineage

# Fixed patterns of the strong kinds: (kind, pattern, group whose length counts, its least length).
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = [
    ("assign", ASSIGN, 2, 12),
    # a run that is long enough or none: the same as all runs with the short ones left out
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]
# Weak kinds. A secret must mix upper and lower case letters and digits.
WEAK = [
    ("identifier", r"""(?i:\b(?:user(?:name)?|login|account|client_?id|access_?key_?id|key_?id))["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}""", 0, 3),
    ("secret", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}", 0, 20),
    ("endpoint", r"""https?://[^\x20\x09-\x0D"'<>]+|(?<![A-Za-z0-9.-])[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++:[0-9]{2,5}(?![0-9])""", 0, 4),
]
BREAK = r"\n[\x20\x09\x0B-\x0D]*\n"
KINDS = [k for k, *_ in BASE + WEAK]
#: What a kind is to the others: part of a credential.
PART = {"assign": "secret", "hex": "secret", "secret": "secret", "access": "identifier", "identifier": "identifier", "endpoint": "endpoint"}
#: Parts that must stand near a weak candidate: any of them, or all of them.
NEEDS = {"secret": ("any", ["identifier", "endpoint"]), "identifier": ("all", ["secret"]), "endpoint": ("all", ["secret", "identifier"])}


def _matches(text: Column, number: int, pattern: str, group: int, least: int, mixed: bool = False) -> Column:
    """Matches of one pattern: kind number, place among its matches, gap before it, its length, and whether it counts."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def of(both: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            good = F.char_length(F.regexp_extract(m, pattern, group) if group else m) >= least
            if mixed:
                good = good & m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")
            return F.struct(
                F.lit(number).alias("kind"), i.cast("int").alias("i"), F.char_length(F.get(both["gaps"], i)).alias("gap"),
                F.char_length(m).alias("len"), good.alias("good"),
            )

        return F.transform(both["found"], one)

    return let(F.struct(gaps.alias("gaps"), found.alias("found")), of)


def _found(df: DataFrame) -> DataFrame:
    """One row per match of any kind: _key, kind (number), start, stop. Failing matches count for positions only."""
    text = whole_text()
    kinds = [_matches(text, n, p, g, least) for n, (_, p, g, least) in enumerate(BASE)]
    kinds += [_matches(text, len(BASE) + n, p, g, least, k == "secret") for n, (k, p, g, least) in enumerate(WEAK)]
    breaks = _matches(text, len(KINDS), BREAK, 0, 0)
    every = let(F.concat(*kinds), lambda x: F.when(F.size(x) > 0, F.concat(x, breaks)).otherwise(x))
    rows = df.select(row_key().alias("_key"), F.explode(every).alias("m")).select("_key", "m.*")
    # rows that are equal throughout have one key; their matches are taken once
    rows = rows.dropDuplicates(["_key", "kind", "i"])
    upto = W.partitionBy("_key", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    stop = F.sum(F.col("gap").cast("long") + F.col("len")).over(upto)
    return rows.select("_key", "kind", "len", "good", stop.alias("stop")).filter("good").select(
        "_key", "kind", (F.col("stop") - F.col("len")).alias("start"), "stop"
    )


def link_parts(found: DataFrame, reach: int = 200) -> DataFrame:
    """Weak candidates (_key, kind, start, stop) with complementary parts of the same scope at most ``reach`` code points away.

    A scope is a stretch of text without a blank line. A part that shares characters with the candidate is no evidence for
    it: only parts that end before it or start after it count. Every span opens and closes once; in the order of these
    places the nearest part before a candidate is the last one closed when it opens, and the nearest after it the first
    one opened when it has closed. No pairs are formed however many parts a text has.
    """
    by_place = W.partitionBy("_key").orderBy("start")
    up_to_here = by_place.rangeBetween(W.unboundedPreceding, W.currentRow)
    from_here = W.partitionBy("_key").orderBy(F.col("start").desc()).rangeBetween(W.unboundedPreceding, W.currentRow)
    strong = F.col("kind") < len(BASE)
    placed = found.select(
        "*",
        F.sum(F.when(F.col("kind") == len(KINDS), 1).otherwise(0)).over(up_to_here).alias("scope"),
        F.max(F.when(strong, F.col("stop"))).over(up_to_here).alias("strong_stop"),
        F.min(F.when(strong, F.col("start"))).over(from_here).alias("strong_start"),
    ).filter(F.col("kind") < len(KINDS))
    # a weak candidate that touches a strong match adds nothing
    clear = F.coalesce(F.col("strong_stop") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("strong_start") >= F.col("stop"), F.lit(True))
    parts = placed.filter(strong | clear).withColumn("part", F.element_at(
        F.create_map(*[x for n, k in enumerate(KINDS) for x in (F.lit(n), F.lit(PART[k]))]), F.col("kind")
    ))
    ends = F.explode(F.array(
        F.struct(F.col("start").alias("at"), F.lit(1).alias("opens")), F.struct(F.col("stop").alias("at"), F.lit(0).alias("opens"))
    ))
    events = parts.select("_key", "scope", "kind", "part", "start", "stop", ends.alias("e")).select(
        "_key", "scope", "kind", "part", "start", "stop", "e.at", "e.opens"
    )
    # at one place spans close before others open
    scope = W.partitionBy("_key", "scope")
    forward = scope.orderBy("at", "opens").rowsBetween(W.unboundedPreceding, W.currentRow)
    backward = scope.orderBy(F.col("at").desc(), F.col("opens").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    names = sorted(set(PART.values()))
    closed = [F.max(F.when((F.col("opens") == 0) & (F.col("part") == p), F.col("at"))).over(forward).alias(f"before_{p}") for p in names]
    opened = [F.min(F.when((F.col("opens") == 1) & (F.col("part") == p), F.col("at"))).over(backward).alias(f"after_{p}") for p in names]
    near = events.select("*", *closed, *opened).filter(~strong).select(
        "_key", "kind", "start", "stop", *[
            F.when(F.col("opens") == 1, F.col("start") - F.col(f"before_{p}") <= reach).otherwise(F.col(f"after_{p}") - F.col("stop") <= reach).alias(p)
            for p in names
        ]
    )
    seen = near.groupBy("_key", "kind", "start", "stop").agg(*[F.max(F.coalesce(F.col(p), F.lit(False))).alias(p) for p in names])
    rule = F.lit(False)
    for n, k in enumerate(KINDS):
        if k in NEEDS:
            how, needed = NEEDS[k]
            joined = F.col(needed[0])
            for x in needed[1:]:
                joined = joined | F.col(x) if how == "any" else joined & F.col(x)
            rule = F.when(F.col("kind") == n, joined).otherwise(rule)
    return seen.filter(rule).select("_key", "kind", "start", "stop")


def _spans(df: DataFrame, reach: int) -> DataFrame:
    """Per key with findings: ``spans`` as in ``scan``."""
    found = cut_lineage(_found(df))
    strong = found.filter(F.col("kind") < len(BASE))
    every = strong.select("_key", "kind", "start", "stop").union(link_parts(found, reach))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    span = F.struct("start", F.col("kind").alias("order"), kind.alias("kind"), "stop")
    return every.groupBy("_key").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def scan(df: DataFrame, reach: int = 200) -> DataFrame:
    """One row per input row: doc_id and ``spans``, an array of (start, order, kind, stop) sorted by start and kind.

    Positions are code points, ends exclusive. ``order`` below 3 marks the strong kinds. Null text counts as empty; a text
    without findings has an empty array. Equal rows get equal results; an empty table gives no rows; other columns are
    ignored.
    """
    spans = _spans(df, reach)
    empty = F.array().cast(spans.schema["spans"].dataType)
    return df.select("doc_id", row_key().alias("_key")).join(spans, "_key", "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))


def redact(df: DataFrame, reach: int = 200) -> DataFrame:
    """All columns of ``df``; every found span of ``text`` is replaced by ``[SECRET]``, overlapping spans by one mark.

    The same cases as in ``scan``; a null text stays null.
    """
    key, marks = fresh(df, "_key", "_marks")
    spans = _spans(df, reach).select(F.col("_key").alias(key), F.col("spans").alias(marks))
    piece = lambda at, length: F.substring(F.col("text"), (at + 1).cast("int"), length.cast("int"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(a: Column, r: Column) -> Column:
        more = F.concat(a["out"], piece(a["at"], r["start"] - a["at"]), F.lit("[SECRET]"))
        overlaps = (r["start"] < a["at"]) & (a["at"] > 0)
        return F.struct(
            F.when(overlaps, a["out"]).otherwise(more).alias("out"), F.greatest(a["at"], r["stop"]).alias("at")
        )

    text = F.aggregate(F.col(marks), start, step, lambda a: F.concat(a["out"], piece(a["at"], F.lit(2**31 - 1))))
    joined = df.withColumn(key, row_key()).join(spans, key, "left")
    return joined.select(*[
        F.when(F.col(marks).isNull(), F.col("text")).otherwise(text).alias(c) if c == "text" else F.col(f"`{c}`") for c in df.columns
    ])
