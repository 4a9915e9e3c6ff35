"""Reference tables: MSP, JSON and CSV spectral libraries, and the retention-index table. S7-S10, S14."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from peakloom.session import cut_lineage
from peakloom.sources import json_ranges
from peakloom.sources.reports import number

_PEAKS = "array<struct<mz:double,intensity:int>>"

# MSP field names. Each entry is column -> pattern of the name in front of the colon.
TEXT_FIELDS = {
    "cas": r"CAS[^:\n]*", "formula": "FORMULA", "accession": r"DB#[^:\n]*", "inchikey": "INCHIKEY", "inchi": "INCHI",
    "smiles": "SMILES", "instrument_type": "INSTRUMENT_TYPE", "instrument": "INSTRUMENT", "ion_mode": "ION_MODE",
    "collision_energy": "COLLISION_ENERGY", "spectrum_type": "SPECTRUM_TYPE", "splash": "SPLASH",
    "compound_class": "COMPOUND_CLASS", "source_field": "SOURCE",
}
NUMBER_FIELDS = {
    "rt_exp": r"RT[^:\n]*", "ri_exp": "RETENTION ?INDEX", "num_peaks": r"NUM ?PEAKS", "precursor_mz": "PRECURSOR_?MZ",
    "mw": "(?:MW|EXACTMASS)",
}
_OTHER_FIELDS = ["NAME", "SYNON", "COMMENTS", "PRECURSOR_TYPE"]


def _field(pattern: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract("record", rf"(?im)^[ \t]*{pattern}[ \t]*:(.*)$", 1)), F.lit(""))


def _int(text: Column) -> Column:
    return number(text).cast("int")


def _place(file_split: Column, part: Column | None = None) -> Column:
    """Where a record stands in its file: the start of the split it was read with, its row there, its part of the row.

    Rows of a split are read in order by one task, so the running number of a task orders them; as it depends on how files
    are dealt to tasks, a table with places is written once before they are used.
    """
    row = F.monotonically_increasing_id()
    return F.struct(file_split.alias("split"), row.alias("row"), (F.lit(0) if part is None else part).alias("part"))


def _file_columns() -> list[Column]:
    """Name of the file that a row comes from, and the place of the row in it."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)
    return [name.alias("source_file"), _place(F.col("_metadata.file_block_start")).alias("place")]


def msp_records(blocks: DataFrame, text: str = "value") -> DataFrame:
    """One row per record: blocks are cut again at blank lines and at every NAME line."""
    clean = F.replace(F.col(text), F.lit("\r"), F.lit(""))
    parts = F.flatten(F.transform(F.split(clean, r"\n[ \t]*\n"), lambda b: F.split(b, r"(?im)(?=^[ \t]*NAME[ \t]*:)")))
    if "place" in blocks.columns:
        numbered = blocks.select("*", F.posexplode(parts).alias("_part", "record"))
        place = F.struct("place.split", "place.row", F.col("_part").alias("part"))
        cut = numbered.withColumn("place", place).drop("_part")
    else:
        cut = blocks.withColumn("record", F.explode(parts))
    return cut.filter(F.col("record").rlike(r"(?i)^\s*NAME[ \t]*:"))


def parse_msp(records: DataFrame, low: float | None = 10, high: float | None = 2000) -> DataFrame:
    """Library rows from a ``record`` column, both peak layouts.

    Layout A has ``mz int; mz int; ...`` with both cut to integers. Layout B has one pair per line after the Num Peaks line;
    a pair outside ``low`` < m/z < ``high`` (None: no bound) or without intensity is left out, the others stay.
    """
    known = "|".join([*TEXT_FIELDS.values(), *NUMBER_FIELDS.values(), *_OTHER_FIELDS])
    lines = F.transform(F.split("record", "\n"), lambda l, i: F.struct(i.alias("i"), F.trim(l).alias("line")))
    df = records.withColumn("lines", lines)
    df = df.withColumn("body", F.filter("lines", lambda x: ~x["line"].rlike(rf"(?i)^(?:{known})[ \t]*:")))
    df = df.withColumn("peaks_at", F.get(F.filter("lines", lambda x: x["line"].rlike(r"(?i)^NUM ?PEAKS[ \t]*:")), F.lit(0))["i"])

    def pair(text: Column, cut: bool) -> Column:
        parts = F.split(F.trim(text), r"\s+")
        mz = number(F.get(parts, F.lit(0)))
        return F.struct((mz.cast("int").cast("double") if cut else mz).alias("mz"), _int(F.get(parts, F.lit(1))).alias("intensity"))

    listed = F.flatten(
        F.transform(F.filter("body", lambda x: x["line"].contains(";")), lambda x: F.transform(F.split(x["line"], ";"), lambda p: pair(p, True)))
    )
    single = F.transform(
        F.filter("body", lambda x: (x["i"] > F.col("peaks_at")) & ~x["line"].contains(";") & (F.size(F.split(x["line"], r"\s+")) == 2)),
        lambda x: pair(x["line"], False),
    )
    whole = F.filter(listed, lambda p: p["mz"].isNotNull() & p["intensity"].isNotNull())
    def inside(p: Column) -> Column:
        return (F.lit(True) if low is None else p["mz"] > low) & (F.lit(True) if high is None else p["mz"] < high)

    in_range = F.filter(single, lambda p: p["mz"].isNotNull() & inside(p) & (p["intensity"] > 0))
    synonyms = F.transform(F.regexp_extract_all("record", F.lit(r"(?im)^[ \t]*SYNON[ \t]*:(.*)$"), F.lit(1)), lambda s: F.trim(s))
    return df.select(
        *[c for c in records.columns if c not in ("record", "value")],
        F.lower(_field("NAME")).alias("name"),
        *[_field(p).alias(c) for c, p in TEXT_FIELDS.items()],
        *[number(_field(p)).alias(c) for c, p in NUMBER_FIELDS.items()],
        synonyms.alias("synonyms"),
        F.concat(whole, F.coalesce(in_range, F.array().cast(_PEAKS))).cast(_PEAKS).alias("peaks"),
    ).withColumn("num_peaks", F.coalesce(F.col("num_peaks").cast("int"), F.size("peaks")))


def read_msp(spark: SparkSession, paths: str | Sequence[str], line_end: str = "\n", source: str = "msp_file") -> DataFrame:
    """S7 from files. Blank lines separate read units, so one large file is read by many tasks.

    For files with CRLF pass ``line_end='\\r\\n'``; otherwise the result is the same but such a file is one read unit.
    """
    return _msp_with_places(spark, paths, line_end, source).drop("place")


def _msp_with_places(spark: SparkSession, paths: str | Sequence[str], line_end: str = "\n", source: str = "msp_file") -> DataFrame:
    blocks = spark.read.option("lineSep", line_end * 2).text(list(paths) if not isinstance(paths, str) else paths)
    return parse_msp(msp_records(blocks.select("value", *_file_columns()))).withColumn("source", F.lit(source))


def _token_pairs(text: Column) -> Column:
    """'mz:int mz:int ...' to ions."""
    tokens = F.transform(F.split(F.trim(text), r"\s+"), lambda t: F.split(t, ":"))
    ions = F.transform(
        F.filter(tokens, lambda p: F.size(p) == 2),
        lambda p: F.struct(number(F.get(p, F.lit(0))).alias("mz"), _int(F.get(p, F.lit(1))).alias("intensity")),
    )
    return F.filter(ions, lambda p: p["mz"].isNotNull() & p["intensity"].isNotNull())


def read_library_json(spark: SparkSession, paths: str | Sequence[str], block: int = json_ranges.BLOCK) -> DataFrame:
    """A list of entries or a single one, with alternative key names; entries without a name or ions are left out."""
    return _json_with_places(spark, paths, block).drop("place")


_JSON_KEYS = [
    "compound", "name", "cas", "casNumber", "formula", "molecularFormula", "id", "inchi", "inchikey", "precursorMZ",
    "precursor", "instrument", "collisionEnergy", "ionizationMode", "ionMode", "spectrum",
]


def _json_with_places(spark: SparkSession, paths: str | Sequence[str], block: int = json_ranges.BLOCK) -> DataFrame:
    """Lists are cut into blocks that many tasks read; a single object is one entry. Documents in a store that only Spark
    opens are read as a whole, each by one task."""
    schema = ", ".join(f"`{k}` string" for k in _JSON_KEYS)
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = spark.read.format("binaryFile").load(paths).select("path", "length")
    cut = [r["path"] for r in files.filter(F.col("length") > block).collect() if json_ranges.reachable(r["path"])]
    whole = [p for p in (r["path"] for r in files.collect()) if p not in cut]
    parts = []
    if whole:
        reader = spark.read.option("multiLine", "true").schema(schema).json(whole)
        parts.append(reader.select(*_JSON_KEYS, *_file_columns()))
    if cut:
        items = json_ranges.json_items(spark, cut, block)
        place = F.struct("split", "row", F.lit(0).alias("part"))
        entry = F.from_json("text", schema)
        # members of an object are no entries; a file of that size that is one object has none
        parts.append(items.filter(F.col("text").startswith("{")).select(entry.alias("e"), F.regexp_extract("path", r"([^/]+)$", 1).alias("source_file"), place.alias("place")).select(
            "e.*", "source_file", "place"
        ))
    raw = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    out = raw.select(
        "place",
        F.lower(F.trim(F.coalesce("compound", "name"))).alias("name"),
        F.nullif(F.coalesce("cas", "casNumber"), F.lit("")).alias("cas"),
        F.nullif(F.coalesce("formula", "molecularFormula"), F.lit("")).alias("formula"),
        F.col("id").alias("accession"), "inchi", "inchikey",
        number(F.coalesce("precursorMZ", "precursor")).alias("precursor_mz"),
        "instrument", F.col("collisionEnergy").alias("collision_energy"),
        F.coalesce("ionizationMode", "ionMode").alias("ion_mode"),
        F.lit("mona_json").alias("source"), "source_file", _token_pairs(F.col("spectrum")).alias("peaks"),
    )
    return out.filter((F.length("name") > 0) & (F.size("peaks") > 0)).withColumn("num_peaks", F.size("peaks"))


# Header spellings of library tables and of their wide ion columns.
NAME_HEADERS = ("name", "compound", "compound name", "compound_name")
CAS_HEADERS = ("cas", "cas#", "cas number", "cas_number")
FORMULA_HEADERS = ("formula", "molecular formula", "mol formula")
WIDE_IONS = [("mz{}", "int{}"), ("m/z{}", "intensity{}"), ("peak{}_mz", "peak{}_int")]


def read_library_csv(spark: SparkSession, path: str | Sequence[str], encoding: str = "UTF-8") -> DataFrame:
    """A table with one spectrum column or wide ion pairs, as many as the header has; entries need 3 ions. The files of a
    call have one header."""
    return _csv_with_places(spark, path, encoding).drop("place")


def _csv_reader(spark: SparkSession, encoding: str):  # noqa: ANN202
    return spark.read.option("header", "true").option("encoding", encoding).option("mode", "DROPMALFORMED")


def _csv_with_places(spark: SparkSession, path: str | Sequence[str], encoding: str = "UTF-8") -> DataFrame:
    raw = _csv_reader(spark, encoding).csv(path if isinstance(path, str) else list(path))
    titles = {c.lower().strip(): c for c in raw.columns}

    def pick(options: Sequence[str]) -> Column:
        found = [titles[t] for t in titles if t in options]
        return F.trim(F.col(f"`{found[-1]}`")) if found else F.lit(None).cast("string")

    special = {*NAME_HEADERS, *CAS_HEADERS, *FORMULA_HEADERS}
    spectra = [c for t, c in titles.items() if t not in special and ("spectrum" in t or "peaks" in t or "ions" in t)]
    empty = F.array().cast(_PEAKS)
    listed = F.coalesce(_token_pairs(F.col(f"`{spectra[-1]}`")), empty) if spectra else empty
    listed = F.transform(listed, lambda p: F.struct(p["mz"].cast("int").cast("double").alias("mz"), p["intensity"].alias("intensity")))
    pairs = []
    for i in sorted({int(n) for t in titles for n in re.findall(r"[0-9]+", t)}):
        for mz, intensity in WIDE_IONS:
            if mz.format(i) in titles and intensity.format(i) in titles:
                pairs.append(
                    F.struct(
                        _int(F.col(f"`{titles[mz.format(i)]}`")).cast("double").alias("mz"),
                        _int(F.col(f"`{titles[intensity.format(i)]}`")).alias("intensity"),
                    )
                )
    wide = F.filter(F.array(*pairs), lambda p: p["mz"].isNotNull() & p["intensity"].isNotNull()) if pairs else empty
    out = raw.select(
        F.lower(pick(NAME_HEADERS)).alias("name"),
        F.nullif(pick(CAS_HEADERS), F.lit("")).alias("cas"),
        F.nullif(pick(FORMULA_HEADERS), F.lit("")).alias("formula"),
        F.lit("nist_webbook_csv").alias("source"),
        *_file_columns(),
        F.when(F.size(listed) > 0, listed).otherwise(wide).cast(_PEAKS).alias("peaks"),
    )
    return out.filter((F.length("name") > 0) & (F.col("name") != "nan") & (F.size("peaks") >= 3)).withColumn("num_peaks", F.size("peaks"))


def library_files(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """Files directly in a folder by lower-cased suffix, in name order. The listing is the one that any reader makes; names
    that begin with a dot or an underscore are hidden to it."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path")
    out: dict[str, list[str]] = {}
    for path in sorted(r["path"] for r in listing.collect()):
        out.setdefault(path.rsplit(".", 1)[-1].lower(), []).append(path)
    return out


def load_libraries(
    spark: SparkSession, folder: str, csv_files: Sequence[str] | None = None, builtin: DataFrame | None = None, encoding: str = "UTF-8"
) -> DataFrame:
    """All MSP, JSON and CSV files of a folder, whatever the case of their suffix, and optional built-in entries, as
    one table in load order. ``csv_files`` restricts the CSV files to some names.

    CSV files with the same header are read together. MSP files are split whichever line end they have.
    """
    files = library_files(spark, folder)
    parts = [] if builtin is None else [builtin.withColumn("source", F.lit("builtin_msp"))]
    ends: dict[str, list[str]] = {}
    for path in files.get("msp", []):
        first = spark.read.option("lineSep", "\n").text(path).first()
        ends.setdefault("\r\n" if first and first["value"].endswith("\r") else "\n", []).append(path)
    parts += [_msp_with_places(spark, paths, end) for end, paths in ends.items()]
    if files.get("json"):
        parts.append(_json_with_places(spark, files["json"]))
    headers: dict[tuple[str, ...], list[str]] = {}
    for path in files.get("csv", []):
        if csv_files is None or path.rsplit("/", 1)[-1] in csv_files:
            headers.setdefault(tuple(_csv_reader(spark, encoding).csv(path).columns), []).append(path)
    parts += [_csv_with_places(spark, paths, encoding) for paths in headers.values()]
    if not parts:
        raise ValueError(f"no library files in {folder}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return with_load_order(out)


def with_load_order(library: DataFrame) -> DataFrame:
    """Number entries from 0 as ``load_seq`` and ``lib_id``: built-in ones first, then by file name and place in the file.

    Repeated records stay, each with its own number. Numbers are made in two levels: a record's place within its split, and
    the records of all splits before, one row per split. A table without places keeps the order of its partitions. The
    table is written once, as places depend on how files were dealt to tasks.
    """
    if "source_file" not in library.columns:
        library = library.withColumn("source_file", F.lit(None).cast("string"))
    anywhere = _place(F.shiftright(F.monotonically_increasing_id(), 33))
    place = F.coalesce(F.col("place"), anywhere) if "place" in library.columns else anywhere
    group = F.struct(
        F.when(F.col("source") == "builtin_msp", 0).otherwise(1).alias("later"), F.coalesce("source_file", F.lit("")).alias("file"),
    )
    names = [c for c in library.columns if c not in ("place", "load_seq", "lib_id")]
    placed = cut_lineage(library.select(*[F.col(f"`{c}`") for c in names], group.alias("_group"), place.alias("_place")))
    split = ["_group", F.col("_place.split").alias("_split")]
    sizes = placed.groupBy(*split).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.orderBy("_group", "_split").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("_group", "_split", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_group", "_split").orderBy("_place")) - 1
    numbered = placed.withColumn("_split", F.col("_place.split")).withColumn("_in", inside).join(offsets, ["_group", "_split"])
    seq = (F.col("_before") + F.col("_in")).cast("long")
    return numbered.select(*[F.col(f"`{c}`") for c in names], seq.alias("load_seq"), seq.alias("lib_id"))


_RI_ENTRY = "map<string, struct<ri:double,n:int,all_ri:array<double>,cas:string,inchikey:string>>"


def parse_ri_table(texts: DataFrame) -> DataFrame:
    """A JSON map name -> {ri, n, all_ri, cas, inchikey}; indices outside 400..4000 are left out. ``texts``: text."""
    entries = F.map_entries(F.from_json("text", _RI_ENTRY))
    return _ri_rows(texts.select(F.posexplode(entries).alias("ord", "e")))


def _ri_rows(entries: DataFrame) -> DataFrame:
    low, high = 400, 4000
    return (
        entries.select("ord", F.lower("e.key").alias("name"), "e.value.*")
        .filter((F.col("ri") > low) & (F.col("ri") < high))
        .withColumns({"n": F.coalesce("n", F.lit(1)), "all_ri": F.coalesce("all_ri", F.array("ri"))})
    )


def read_ri_table(spark: SparkSession, path: str, block: int = json_ranges.BLOCK) -> DataFrame:
    """S10 from files. A large table is cut into blocks; ``ord`` then orders its names but leaves gaps."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").collect()
    if not any(r["length"] > block for r in files) or not all(json_ranges.reachable(r["path"]) for r in files):
        return parse_ri_table(spark.read.option("wholetext", "true").text(path).select(F.col("value").alias("text")))
    items = json_ranges.json_items(spark, path, block)
    place = F.shiftleft((F.col("split") / block).cast("long"), 32).bitwiseOR(F.col("row"))
    entry = F.map_entries(F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), _RI_ENTRY))
    return _ri_rows(items.select(place.alias("ord"), F.explode(entry).alias("e")))
