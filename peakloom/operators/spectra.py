"""Spectrum search: J4, J5, M1-M7, M9-M11, M16, W10.

Queries are dealt to tasks, and each task reads the stored library block by block, so what is stored and shuffled is linear
in the ions. An index over the ions of a block that a hit needs finds the pairs that can reach the wanted score, for any
m/z, and only these are scored; see ``ionmatch``. A query's hits are ranked in its task; see ``ranking``.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from peakloom.operators import ionmatch, ranking
from peakloom.scale import small_side
from peakloom.session import cut_lineage

#: Ions of one block: a few thousand spectra.
BLOCK_IONS = 200_000
#: Most partitions that the queries are dealt into.
MOST_PARTS = 100_000


def collect_spectra(ions: DataFrame, key: str) -> DataFrame:
    """Long ions (key, ion_idx, mz, intensity) to one row per spectrum, ions in their given order."""
    packed = F.array_sort(F.collect_list(F.struct("ion_idx", "mz", "intensity")))
    return ions.groupBy(key).agg(packed.alias("p")).select(
        key,
        F.transform(
            "p", lambda i: F.struct(i["mz"].cast("double").alias("mz"), i["intensity"].cast("int").alias("intensity"))
        ).alias("peaks"),
    )


def with_spectrum_columns(spectra: DataFrame) -> DataFrame:
    """Number of ions, sum of squared intensities, largest m/z, base peak and the integer m/z of the five strongest ions."""
    strongest = F.transform("peaks", lambda p, i: F.struct((-p["intensity"]).alias("s"), i.alias("i"), p["mz"].alias("mz")))
    by_strength = F.transform(F.slice(F.array_sort(strongest), 1, 5), lambda s: s["mz"].cast("int"))
    return spectra.withColumns(
        {
            "n_peaks": F.size("peaks"),
            "sum_sq": F.aggregate("peaks", F.lit(0.0), lambda a, p: a + p["intensity"].cast("double") * p["intensity"]),
            "max_mz": F.array_max(F.transform("peaks", lambda p: p["mz"])),
            "top_mz": by_strength,
            "base_peak_mz": F.get(by_strength, F.lit(0)),
        }
    )


def ri_penalty(ri_library: Column, ri_expected: Column, tolerance: float = 50.0) -> Column:
    """M7: 1 within the tolerance, falling to 0.5 at twice and 0.1 at four times it; 1 when an index is unknown."""
    d, t = F.abs(ri_library - ri_expected), float(tolerance)
    return (
        F.when(d.isNull() | (d <= t), 1.0)
        .when(d <= t * 2, F.lit(1.0) - F.lit(0.5) * (d - t) / t)
        .when(d <= t * 4, F.lit(0.5) - F.lit(0.4) * (d - t * 2) / (t * 2))
        .otherwise(0.1)
    )


def class_factor(compound_class: Column, confidence: Column) -> Column:
    """M9."""
    c = F.coalesce(confidence, F.lit(0.0))
    capped = F.least(c, F.lit(1.0))
    return (
        F.when(compound_class == "food_flavor", F.lit(1.05) + F.lit(0.15) * c)
        .when(compound_class == "natural_product", F.lit(1.05) + F.lit(0.10) * c)
        .when(compound_class == "pharmaceutical", F.lit(0.85) - F.lit(0.15) * capped)
        .when(compound_class == "industrial", F.lit(0.75) - F.lit(0.10) * capped)
        .otherwise(1.0)
    )


# The flat class factors of the fast profile.
FAST_FACTORS = {"food_flavor": 1.1, "pharmaceutical": 0.8, "industrial": 0.75}

_LIBRARY_COLUMNS = {
    "load_seq": "long", "name": "string", "cas": "string", "formula": "string", "ri_exp": "double", "rt_exp": "double",
    "source": "string", "compound_class": "string", "class_confidence": "double",
}


def prepare_library(library: DataFrame, min_peaks: int = 1) -> DataFrame:
    """Library with spectrum columns; optional attributes that are absent become null."""
    have = library.columns
    out = library.filter(F.size("peaks") >= min_peaks).withColumns(
        {c: F.lit(None).cast(t) for c, t in _LIBRARY_COLUMNS.items() if c not in have}
    )
    return with_spectrum_columns(out.withColumn("load_seq", F.coalesce("load_seq", "lib_id")))


def _ranked(
    queries: DataFrame, library: DataFrame, rule: ranking.Rule, values: dict[str, T.DataType], tolerance: float, block_ions: int,
    factor: Column | None = None, base_peak_filter: bool = False, sources: Sequence[str] | None = None,
) -> DataFrame:
    """Hits with their rank, the ``values`` that the rule gives them, query_max_mz and the library's attributes.

    Pairs that share no ion score 0 in every measure and are no hits; with ``base_peak_filter`` only the J4 candidates are,
    which come from the whole library whatever the ``sources``. Rows of one query_id are ranked together, and an entry
    takes its attributes by lib_id.
    """
    spark = queries.sparkSession
    queries = with_spectrum_columns(queries).filter(F.col("sum_sq") > 0)
    if "ri_expected" not in queries.columns:
        queries = queries.withColumn("ri_expected", F.lit(None).cast("double"))
    # both are read twice, to be counted and to be searched
    queries = cut_lineage(queries.select(
        "query_id", "peaks", "top_mz", F.col("n_peaks").alias("n_query"), F.col("sum_sq").alias("query_sq"),
        F.col("max_mz").alias("query_max_mz"), F.col("ri_expected").cast("double"),
    ))
    library = cut_lineage(library.filter(F.col("sum_sq") > 0).withColumn("factor", F.lit(1.0) if factor is None else factor))
    attributes = library.select(
        "lib_id", *_LIBRARY_COLUMNS, "factor", F.col("n_peaks").alias("n_lib"), F.col("sum_sq").alias("lib_sq"), F.col("max_mz").alias("lib_max_mz"),
    )
    if sources:
        attributes = attributes.filter(F.col("source").isin(list(sources)))
    entries = library.select("lib_id", "base_peak_mz", "peaks").join(attributes, "lib_id").orderBy("load_seq")
    entries = cut_lineage(entries.withColumn("entry", F.monotonically_increasing_id()))
    if base_peak_filter:
        near_tops = F.array_distinct(F.flatten(F.transform("top_mz", lambda m: F.array(m - 1, m, m + 1))))
        bases = library.agg(F.collect_set("base_peak_mz").alias("b")).scalar()
        # no entry has a base peak near the strong ions: every entry is a candidate
        queries = queries.withColumn("cand", F.array_intersect(near_tops, bases))
    queries = queries.drop("top_mz")
    size = lambda df: df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("peaks")), F.lit(0))).first()
    (n_lib, _), (n_query, query_ions) = size(entries), size(queries)
    parallel = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    kept = min(n_lib, 64 * rule.leaders.k) if rule.leaders else n_lib
    parts = max(4 * parallel, -(-query_ions // block_ions), -(-n_query * kept // ranking.PAIRS))
    shape = T.StructType([
        queries.schema["query_id"], T.StructField("entry", T.LongType()), T.StructField("rank", T.IntegerType()),
        *[T.StructField(c, t) for c, t in values.items()], queries.schema["query_max_mz"],
    ])
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in shape])
    run = ranking.ranker(sorted(entries.inputFiles()), n_lib, schema, rule, float(tolerance), base_peak_filter, block_ions, ["query_max_mz"])
    # the number of partitions is stated because a task's work is far larger than its size, by which adaptive execution
    # would merge partitions
    dealt = queries.repartition(max(1, min(parts, n_query, MOST_PARTS)), "query_id")
    attributes = entries.select("entry", *attributes.columns)
    return dealt.mapInArrow(run, shape).join(small_side(attributes, 300_000), "entry")


def search(
    queries: DataFrame,
    library: DataFrame,
    mode: str = "hybrid",
    min_match: int = 600,
    tolerance: float = 0.5,
    ri_tolerance: float = 50.0,
    ri_boost: bool = True,
    category_boost: bool = False,
    profile: str = "nist",
    k: int | None = None,
    block_ions: int = BLOCK_IONS,
) -> DataFrame:
    """M10 (``profile='nist'``) and M11 (``'fast'``): ranked hits of every query against the whole library.

    ``queries``: query_id, peaks, optional ri_expected. Entries below ``min_match`` (at least 1) are not hits. The fast
    profile keeps the hybrid score unrounded and applies index penalty and flat class factors before the threshold.
    """
    if min_match < 1:
        raise ValueError("min_match must be at least 1")
    if mode not in ("cosine", "forward", "reverse"):
        mode = "hybrid"
    fast, t = profile == "fast", float(ri_tolerance)
    lib = prepare_library(library, 2 if fast else 1)
    kind = F.coalesce("compound_class", F.lit("other"))
    both, counts = mode in ("forward", "hybrid"), mode != "cosine"
    if fast:
        # the boosts come before the threshold
        limit = min_match / max(FAST_FACTORS.values()) if category_boost else min_match
        rule = ranking.Fast(mode, limit, min_match, k, None, both, counts, t)
        factor = F.lit(float("nan"))
        for name, flat in FAST_FACTORS.items() if category_boost else ():
            factor = F.when(kind == name, flat).otherwise(factor)
    else:
        # the fast profile is ranked by other scores
        leaders = ionmatch.Leaders(k, min_match, by_index=True, backed=ri_boost, ri_tolerance=t) if k else None
        rule = ranking.Indexed(mode, min_match, min_match, k, leaders, both, counts, t, ri_boost)
        factor = class_factor(kind, F.col("class_confidence")) if category_boost else F.lit(1.0)
    whole, exact = T.IntegerType(), T.DoubleType()
    values = {"match_factor": whole, "effective_match": whole, "ri_penalty": exact, **({"score": exact} if fast else {})}
    hits = _ranked(queries, lib, rule, values, tolerance, block_ions, factor)
    return hits.select(
        "query_id", "lib_id", "name", "cas", "formula", "match_factor", "effective_match", F.col("ri_exp").alias("ri"), "ri_penalty",
        (F.lit(1.0) if fast else F.col("factor")).alias("category_factor"), kind.alias("compound_class"), F.col("n_lib").alias("num_peaks"), "rank",
    )


def search_manager(
    queries: DataFrame,
    library: DataFrame,
    min_match: int = 600,
    k: int | None = 20,
    sources: Sequence[str] | None = None,
    require_both: bool = True,
    tolerance: float = 0.5,
    block_ions: int = BLOCK_IONS,
) -> DataFrame:
    """Base-peak candidates scored both ways; a weak direction caps the combined factor at 500."""
    if min_match < 1:
        raise ValueError("min_match must be at least 1")
    leaders = ionmatch.Leaders(k, min_match, capped=require_both) if k else None
    rule = ranking.Mutual("mean" if require_both else "either", min_match, min_match, k, leaders, True, False, require_both)
    values = dict.fromkeys(("match_factor", "match_forward", "match_reverse"), T.IntegerType())
    hits = _ranked(queries, prepare_library(library, 3), rule, values, tolerance, block_ions, None, True, sources)
    return hits.select(
        "query_id", "lib_id", "load_seq", "name", "cas", "formula", "match_factor", "match_forward", "match_reverse",
        F.coalesce("source", F.lit("unknown")).alias("source"), F.col("n_lib").alias("n_ref_peaks"),
        "query_max_mz", "lib_max_mz", "rt_exp", "rank",
    )


def best_hit(hits: DataFrame) -> DataFrame:
    """The first hit of each query."""
    return hits.filter(F.col("rank") == 1)
