"""Filling gaps in the reference tables from stored pages and responses: S11, S12, J10, K5, A28."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

# Page markers, cell and registry-number patterns of the index pages, and the accepted index range.
PAGE_MARKERS = ["Gas Chromatography", "Kovats"]
RI_CELL = r'<td class="right-nowrap">\s*(\d{2,4}\.\d{1,2})\s*</td>'
CAS_LINE = r"CAS Registry Number:\s*(\d{2,7}-\d{2}-\d)"
CAS_NUMBER = r"^\d{2,7}-\d{2}-\d$"
RI_RANGE = (400.0, 4000.0)


def page_values(
    pages: DataFrame,
    text: str = "html",
    markers: list[str] = PAGE_MARKERS,
    cell: str = RI_CELL,
    low: float = RI_RANGE[0],
    high: float = RI_RANGE[1],
) -> DataFrame:
    """Index values of every page, sorted and distinct, the one at position n // 2 as representative, and the CAS number.

    A page without any of the markers has no values. The whole page text is searched.
    """
    body = F.col(text)
    marked = F.lit(not markers)
    for marker in markers:
        marked = marked | body.contains(marker)
    found = F.transform(F.regexp_extract_all(text, F.lit(cell), F.lit(1)), lambda v: v.try_cast("double"))
    kept = F.transform(F.filter(found, lambda v: (v > low) & (v < high)), lambda v: F.round(v, 1))
    values = F.when(marked, F.array_sort(F.array_distinct(kept))).otherwise(F.array().cast("array<double>"))
    out = pages.withColumn("ri_values", values)
    return out.withColumns(
        {
            "n": F.size("ri_values"),
            "ri": F.get("ri_values", F.floor(F.size("ri_values") / 2).cast("int")),
            "cas": F.nullif(F.regexp_extract(text, CAS_LINE, 1), F.lit("")),
        }
    )


def first_cas(responses: DataFrame, body: str = "body") -> DataFrame:
    """The first synonym of a response that is a CAS number."""
    schema = "InformationList struct<Information:array<struct<Synonym:array<string>>>>"
    parsed = F.from_json(body, schema)
    first = F.get(parsed["InformationList"]["Information"], F.lit(0))
    names = F.transform(first["Synonym"], lambda s: F.trim(s))
    return responses.withColumn("cas", F.get(F.filter(names, lambda s: s.rlike(CAS_NUMBER)), F.lit(0)))


def first_inchikey(responses: DataFrame, body: str = "body") -> DataFrame:
    """The key of the first property record."""
    return responses.withColumn(
        "inchikey", F.nullif(F.get_json_object(body, "$.PropertyTable.Properties[0].InChIKey"), F.lit(""))
    )


def worklist(
    library: DataFrame,
    known: DataFrame | None = None,
    checked: DataFrame | None = None,
    missing: str | None = None,
    required: str | None = None,
    min_length: int = 3,
    max_length: int | None = 100,
    limit: int | None = None,
) -> DataFrame:
    """Entries still to look up: name of a sensible length, not in ``known`` and not in ``checked`` (column name).

    ``missing`` names a column that must be empty, ``required`` one that must not be.
    """
    name = F.lower(F.trim("name"))
    out = library.filter(F.length(name) >= min_length)
    if max_length:
        out = out.filter(F.length(name) <= max_length)
    for column, empty in ((missing, True), (required, False)):
        if column:
            blank = F.coalesce(F.trim(F.col(column).cast("string")) == "", F.lit(True))
            out = out.filter(blank if empty else ~blank)
    out = out.withColumn("key", name)
    for done in (known, checked):
        if done is not None:
            out = out.join(done.select(F.lower(F.trim("name")).alias("key")).distinct(), "key", "left_anti")
    return out.orderBy("load_seq").limit(limit) if limit else out


def upsert(new: DataFrame, old: DataFrame, key: str = "name") -> DataFrame:
    """K5: new rows replace old rows of the same key."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions of a table, from one listing of its folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    names = [status.getPath().getName() for status in system.listStatus(folder)]
    return sorted(int(n.removeprefix("version-")) for n in names if n.startswith("version-"))


def save_table(table: DataFrame, path: str) -> int:
    """K5: a new version of a stored table, visible as a whole or not at all; its number.

    Rows are written to a folder of their own, which then gets the next number by one rename. A rename to a name that
    exists fails, so of two writers one takes the next number. Readers that began with an older version keep it until it
    is removed. The file system must rename folders atomically, as local ones and HDFS do.
    """
    spark = table.sparkSession
    staged = f"{path.rstrip('/')}/staged-{uuid.uuid4().hex}"
    table.write.parquet(staged)
    hadoop = spark._jvm.org.apache.hadoop.fs
    source = hadoop.Path(staged)
    context = hadoop.FileContext.getFileContext(source.getFileSystem(spark._jsc.hadoopConfiguration()).getUri(), spark._jsc.hadoopConfiguration())
    options = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    while True:
        number = max(_versions(spark, path), default=0) + 1
        try:
            context.rename(source, hadoop.Path(f"{path.rstrip('/')}/version-{number}"), options)
            return number
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in str(error.java_exception):
                raise


def load_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest complete version of a stored table, or one by its number."""
    number = version or max(_versions(spark, path), default=None)
    if number is None:
        raise ValueError(f"no version of a table in {path}")
    return spark.read.parquet(f"{path.rstrip('/')}/version-{number}")


def upsert_table(new: DataFrame, path: str, key: str = "name") -> int:
    """K5: replace the rows of a stored table that have a key of ``new``, as a new version; its number."""
    spark = new.sparkSession
    return save_table(upsert(new, load_table(spark, path), key) if _versions(spark, path) else new, path)


def remove_versions(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Remove all but the newest versions; the numbers that went."""
    gone = _versions(spark, path)[:-keep] if keep else _versions(spark, path)
    for number in gone:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/version-{number}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return gone


def progress(work: DataFrame, results: DataFrame) -> DataFrame:
    """Names checked, found, hit rate and still open. ``results``: name, found."""
    open_ = work.join(results.select("name").distinct(), "name", "left_anti").agg(F.count(F.lit(1)).alias("n")).scalar()
    return results.agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("found")).alias("found")).select(
        "checked", "found",
        F.round(F.coalesce(F.try_divide(F.col("found") * 100.0, "checked"), F.lit(0.0)), 1).alias("hit_rate_pct"),
        open_.alias("remaining"),
    )
