"""Peak, trace, spectrum and library tables derived from the generic test tables.

Each view is one SQL text that Spark and the check engine both run; only the unpacking of an array differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from peakloom.operators.spectra import collect_spectra
from peakloom.session import cut_lineage

PEAKS = """
SELECT concat('G', l_suppkey % 3) AS grp,
       concat('Sample', lpad(CAST(l_suppkey AS STRING), 4, '0'), '.D') AS sample,
       CASE WHEN p_size = 50 THEN concat('RT_', CAST(l_partkey % 3000 AS STRING)) ELSE lower(p_brand) END AS compound,
       2 + CAST((l_partkey * l_partkey * 31 + l_partkey * 17) % 30011 AS DOUBLE) / 1000 AS rt,
       l_extendedprice AS area, l_extendedprice AS amount,
       l_quantity * (100 + 10 * (l_suppkey % 3)) / 1000 AS conc,
       CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(50 + l_quantity AS INT) END AS match_factor
FROM lineitem JOIN part ON p_partkey = l_partkey
"""

TIC = """
SELECT concat('U', CAST(user_id AS STRING)) AS sample,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS idx,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS DOUBLE) / 100 AS t,
       value * CAST(1000.137 AS DOUBLE) AS y
FROM events
"""

# The same trace with points that have no intensity.
TIC_GAPS = TIC.replace("value * CAST(1000.137 AS DOUBLE)", "CASE WHEN event_id % 13 <> 5 THEN value * CAST(1000.137 AS DOUBLE) END")

UNPACK_SPARK = "SELECT vec_id, label, pos AS ion_idx, CAST(x AS DOUBLE) AS x FROM embeddings LATERAL VIEW posexplode(embedding) v AS pos, x"
UNPACK_CHECK = (
    "SELECT vec_id, label, CAST(generate_subscripts(embedding,1) - 1 AS INT) AS ion_idx, "
    "CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings"
)
SPECTRA = """
SELECT vec_id AS spec_id, label, ion_idx, 40 + ion_idx AS mz, intensity
FROM (SELECT vec_id, label, ion_idx,
             CAST(floor(abs(x) / max(abs(x)) OVER (PARTITION BY vec_id) * 999) AS INT) AS intensity FROM ({unpack}) e) z
WHERE intensity >= 150
"""

# All ions of all spectra.
SPECTRA_ALL = SPECTRA.replace("WHERE intensity >= 150\n", "")

# Measured m/z, between 0.7 and 1.7 apart in their order of numbers, in other places in each spectrum; all ions.
SPECTRA_FINE = """
SELECT vec_id AS spec_id, label, ion_idx, CAST(40000 + ion_idx * 700 + (vec_id * 37 + ion_idx * 11) % 970 AS DOUBLE) / 1000 AS mz,
       CAST(floor(abs(x) / max(abs(x)) OVER (PARTITION BY vec_id) * 999) AS INT) AS intensity FROM ({unpack}) e
"""

LIBRARY = """
SELECT p_partkey AS lib_id, p_partkey AS load_seq, p_name AS name,
       CASE WHEN p_size % 5 = 0 THEN NULL
            ELSE concat(CAST(100 + p_partkey % 150 AS STRING), '-00-', CAST(p_size % 10 AS STRING)) END AS cas,
       CASE WHEN p_size % 4 = 0 THEN NULL ELSE concat('C', CAST(p_size AS STRING), 'H', CAST(p_size * 2 AS STRING),
            CASE WHEN p_size % 7 = 0 THEN 'N2O' WHEN p_size % 11 = 0 THEN 'SiS' ELSE 'O' END) END AS formula,
       2 + CAST((p_partkey * p_partkey * 31 + p_partkey * 17) % 30011 AS DOUBLE) / 1000 AS rt_exp,
       CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(401 + p_partkey * 97 % 3500 AS DOUBLE) END AS ri_exp,
       CASE WHEN p_type IN ('SMALL', 'MEDIUM') THEN 'builtin_msp'
            WHEN p_type = 'LARGE' THEN 'nist_webbook_csv' ELSE 'msp_file' END AS source,
       CASE WHEN p_size % 6 = 0 THEN 'food_flavor' WHEN p_size % 6 = 1 THEN 'natural_product'
            WHEN p_size % 6 = 2 THEN 'pharmaceutical' WHEN p_size % 6 = 3 THEN 'industrial' ELSE 'other' END AS compound_class,
       CAST(p_size AS DOUBLE) / 50 AS class_confidence
FROM part WHERE p_partkey % 2 = 0 AND p_partkey IN (SELECT vec_id FROM embeddings)
"""

# Every part is an entry; those without a vector have no ions.
LIBRARY_ALL = LIBRARY.replace("FROM part WHERE p_partkey % 2 = 0 AND p_partkey IN (SELECT vec_id FROM embeddings)", "FROM part")

RI_REF = """
SELECT CAST(min(p_partkey) AS INT) AS ord, p_name AS name,
       CAST(401 + min(p_partkey) * 97 % 3500 AS DOUBLE) AS ri, CAST(count(*) AS INT) AS n
FROM part GROUP BY p_name
"""

RT_LIBRARY = """
SELECT CAST(p_partkey AS INT) AS ord, p_name AS name, lower(p_type) AS cat,
       2 + CAST((p_partkey * p_partkey * 31 + p_partkey * 17) % 30011 AS DOUBLE) / 1000 + CAST(p_size AS DOUBLE) / 200 AS rt_est
FROM part
"""

TEXTS = {
    "peaks": PEAKS, "tic": TIC, "tic_gaps": TIC_GAPS, "spectra": SPECTRA, "spectra_all": SPECTRA_ALL, "spectra_fine": SPECTRA_FINE,
    "library_all": LIBRARY_ALL, "library_rows": LIBRARY, "ri_ref": RI_REF, "rt_library": RT_LIBRARY,
}


def _tables(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a view text with its base tables bound as frames; nothing is registered in the session."""
    names = [n for n in ("lineitem", "part", "events", "embeddings", "pages") if n in sql]
    body = sql.replace("{", "{{").replace("}", "}}")
    bound = {}
    for name in names:
        bound[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        body = body.replace(f"FROM {name}", f"FROM {{{name}}}").replace(f"JOIN {name}", f"JOIN {{{name}}}")
    return spark.sql(body, **bound)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _tables(spark, sf_dir, TEXTS[name].replace("{unpack}", UNPACK_SPARK))


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "peaks")


def tic(spark: SparkSession, sf_dir: str) -> DataFrame:
    # traces are a stored table; the point numbers derived here are stored once per query
    return cut_lineage(view(spark, sf_dir, "tic"))


def tic_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_lineage(view(spark, sf_dir, "tic_gaps"))


def library(spark: SparkSession, sf_dir: str, ions: str = "spectra") -> DataFrame:
    """Even spectra as library entries."""
    ions = view(spark, sf_dir, ions).filter(F.col("spec_id") % 2 == 0)
    packed = collect_spectra(ions, "spec_id").withColumnRenamed("spec_id", "lib_id")
    # a library is a stored table; here it is derived, so it is stored once per query
    return cut_lineage(view(spark, sf_dir, "library_rows").join(packed, "lib_id"))


def whole_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries with all their ions."""
    packed = collect_spectra(view(spark, sf_dir, "spectra_all"), "spec_id").withColumnRenamed("spec_id", "lib_id")
    rows = view(spark, sf_dir, "library_all").join(packed, "lib_id", "left")
    return cut_lineage(rows.withColumn("peaks", F.coalesce("peaks", F.array().cast("array<struct<mz:double,intensity:int>>"))))


def queries(spark: SparkSession, sf_dir: str, ions: str = "spectra") -> DataFrame:
    """Odd spectra as queries, two in three with a measured index."""
    ions = view(spark, sf_dir, ions).filter(F.col("spec_id") % 2 == 1)
    ri = F.when(F.col("query_id") % 3 != 0, (F.lit(401) + F.col("query_id") * 97 % 3500).cast("double"))
    packed = collect_spectra(ions, "spec_id").withColumnRenamed("spec_id", "query_id")
    return cut_lineage(packed.withColumns({"ri_expected": ri, "ri_measured": ri}))


def ri_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "ri_ref")


def rt_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "rt_library")


def check_view(name: str) -> str:
    """The same view for the check engine."""
    return TEXTS[name].replace("{unpack}", UNPACK_CHECK).strip()
