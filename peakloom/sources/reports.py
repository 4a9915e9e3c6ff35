"""Peak tables out of instrument report files: S3, S4, S5. One file is one run, so a file is one unit of reading."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, functions as F

from peakloom.sources.runs import RUN_FILE

_PEAK = "rt double, peak_type string, area double, amount double, conc double, compound string"


def _run_columns(path: Column) -> list[Column]:
    return [
        F.regexp_extract(path, RUN_FILE, 2).alias("grp"),
        F.regexp_extract(path, RUN_FILE, 3).alias("sample"),
        path.alias("path"),
    ]


def plain_path() -> Column:
    """Path of the file that a row comes from as a listing spells it: signs written as codes are themselves again."""
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(path, "^file:/+", "file:/")


def number(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def _found_below(reader: DataFrameReader, name_glob: str | None) -> DataFrameReader:
    """With a pattern of file names, all files below the given folders that fit it, at any depth."""
    return reader if name_glob is None else reader.option("recursiveFileLookup", "true").option("pathGlobFilter", name_glob)


def read_report_csv(
    spark: SparkSession, paths: str | Sequence[str], encoding: str = "UTF-16LE", max_name: int | None = None, name_glob: str | None = None
) -> DataFrame:
    """S3: quantitation reports without header; columns 0-4 and 7 are rt, type, area, amount, conc, name.

    A row with fewer than 8 fields, a number that does not parse, or a name that is empty or too long is left out. A byte
    order mark does not cost the first row.
    """
    schema = ", ".join(f"c{i} string" for i in range(8))
    raw = (
        _found_below(spark.read, name_glob).schema(schema).option("encoding", encoding).option("multiLine", "true")
        .option("quote", '"').option("escape", '"').csv(list(paths) if not isinstance(paths, str) else paths)
        .select("*", plain_path().alias("_path"))
    )
    name = F.lower(F.btrim(F.trim("c7"), F.lit('"')))
    return (
        raw.select(
            *_run_columns(F.col("_path")),
            number(F.replace(F.col("c0"), F.lit("\ufeff"), F.lit(""))).alias("rt"),
            F.btrim(F.trim("c1"), F.lit('"')).alias("peak_type"),
            number(F.col("c2")).alias("area"), number(F.col("c3")).alias("amount"), number(F.col("c4")).alias("conc"),
            name.alias("compound"),
        )
        .filter(
            F.col("rt").isNotNull() & F.col("area").isNotNull() & F.col("amount").isNotNull() & F.col("conc").isNotNull()
            & (F.length("compound") > 0) & (F.lit(True) if max_name is None else F.length("compound") <= max_name)
        )
    )


def read_texts(spark: SparkSession, paths: str | Sequence[str], name_glob: str | None = None) -> DataFrame:
    """path and text of whole files: UTF-16 with a mark or zero bytes, else UTF-8, else Latin-1. Line ends become \\n."""
    files = _found_below(spark.read.format("binaryFile"), name_glob).load(list(paths) if not isinstance(paths, str) else paths)
    mark, second = F.hex(F.substring("content", 1, 2)), F.hex(F.substring("content", 2, 1))
    plain = F.col("content").cast("string")
    text = (
        F.when((mark == "FFFE") | (second == "00"), F.decode("content", "UTF-16LE"))
        .when(F.is_valid_utf8(plain), plain)
        .otherwise(F.decode("content", "ISO-8859-1"))
    )
    clean = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\ufeff"), F.lit(""))
    return files.select("path", clean.alias("text"))


# Line formats of the three text layouts.
TABLE_HEADER = r"(?i)^\s*Peak\s+RetTime\s+Type"
TABLE_ROW = (
    r"^(\d+)\s+([\d.]+)\s+(\S+)\s+([\d.]+)\s+([\d.]+)\s+([\d.eE+\-]+)\s*(?:([\d.eE+\-]+)\s*)?(\S.*?)$"
)
QUANT_HEADER = r"(?i)^\s*Compound\s+RT\s+Area\s+Amount"
QUANT_ROW = r"^(.+?)\s{2,}([\d.]+)\s+([\d.]+)\s+([\d.eE+\-]+)\s*([\d.eE+\-]*)$"
QUANT_STOP = r"(?i)^(Signal|Peak|Sorted|Calib|Multiplier|Dilution|Sample\s+Name)"
TAB_HEADER = r"(?i)(RT|RetTime|retention)"


def _peak(rt: Column, kind: Column, area: Column, amount: Column, conc: Column, name: Column) -> Column:
    return F.struct(
        F.round(number(rt), 3).alias("rt"), kind.alias("peak_type"), F.round(number(area), 1).alias("area"),
        amount.alias("amount"), conc.alias("conc"), F.lower(F.trim(name)).alias("compound"),
    )


def _good(p: Column) -> Column:
    name = p["compound"]
    return (
        p["rt"].isNotNull() & p["area"].isNotNull() & p["amount"].isNotNull() & p["conc"].isNotNull()
        & (F.length(name) > 0)
    )


def _first(lines: Column, test) -> Column:
    return F.get(F.filter(lines, test), F.lit(0))["i"]


def _after(lines: Column, head: Column, end: Column | None = None) -> Column:
    """The lines behind a header and before ``end``; null without a header. Cut by place, as a test of each line would have the
    optimizer look for header and end again at each line."""
    return F.slice(lines, head + 2, F.size(lines) if end is None else end - head - 1)


def parse_report_texts(texts: DataFrame) -> DataFrame:
    """The first of three layouts that yields rows wins, per file. ``texts``: path, text.

    Everything about a file is decided inside its own row, so nothing is exchanged.
    """
    numbered = F.transform(F.split("text", "\n"), lambda line, i: F.struct(i.alias("i"), F.trim(line).alias("line"), line.alias("raw")))
    df = texts.select("path", numbered.alias("lines"))
    none = F.lit(None).cast("string")
    tabbed = F.filter("lines", lambda x: x["raw"].contains("\t") & x["raw"].rlike(TAB_HEADER))
    df = df.withColumns(
        {
            "h1": _first(F.col("lines"), lambda x: x["line"].rlike(TABLE_HEADER)),
            "h2": _first(F.col("lines"), lambda x: x["line"].rlike(QUANT_HEADER)),
            "h3": F.get(tabbed, F.lit(0))["i"],
            "titles": F.transform(F.split(F.get(tabbed, F.lit(0))["line"], "\t"), lambda t: F.lower(F.replace(F.trim(t), F.lit('"'), F.lit("")))),
        }
    )

    def table_row(x: Column) -> Column:
        part = [F.regexp_extract(x["line"], TABLE_ROW, g) for g in range(9)]
        return _peak(part[2], part[3], part[5], number(part[6]), number(part[6]), part[8])

    table = F.filter(
        F.transform(F.filter(_after(F.col("lines"), F.col("h1")), lambda x: x["line"].rlike(TABLE_ROW)), table_row),
        lambda p: _good(p) & ~p["compound"].startswith("-"),
    )
    stop = _first(_after(F.col("lines"), F.col("h2")), lambda x: x["line"].rlike(QUANT_STOP))
    df = df.withColumn("stop2", F.coalesce(stop, F.size("lines")))

    def quant_row(x: Column) -> Column:
        part = [F.regexp_extract(x["line"], QUANT_ROW, g) for g in range(6)]
        conc = F.when(part[5] != "", number(part[5])).otherwise(number(part[4]))
        return _peak(part[2], none, part[3], number(part[4]), conc, part[1])

    quant = F.filter(
        F.transform(
            F.filter(
                _after(F.col("lines"), F.col("h2"), F.col("stop2")),
                lambda x: x["line"].rlike(QUANT_ROW) & ~x["line"].rlike("^(---|===)"),
            ),
            quant_row,
        ),
        _good,
    )

    def column(test, but=None) -> Column:
        # the kinds are tried in order, so a title counts for the first kind it fits
        return F.array_max(F.transform("titles", lambda t, i: F.when(test(t) & (~but(t) if but else F.lit(True)), i)))

    def is_rt(t):
        return t.contains("rt") | t.contains("ret") | t.contains("time")

    def is_area(t):
        return t.contains("area")

    def is_amount(t):
        return t.contains("amount") | t.contains("conc")

    df = df.withColumns(
        {
            "c_rt": column(is_rt),
            "c_area": column(is_area, is_rt),
            "c_amount": column(is_amount, lambda t: is_rt(t) | is_area(t)),
            "c_name": column(
                lambda t: t.contains("name") | t.contains("compound"), lambda t: is_rt(t) | is_area(t) | is_amount(t)
            ),
        }
    )

    def tab_row(x: Column) -> Column:
        cell = F.split(x["line"], "\t")
        amount = F.when(F.col("c_amount").isNull() | (F.col("c_amount") >= F.size(cell)), F.lit(0.0)).otherwise(number(F.get(cell, F.col("c_amount"))))
        name = F.btrim(F.trim(F.get(cell, F.col("c_name"))), F.lit('"'))
        return _peak(F.get(cell, F.col("c_rt")), none, F.get(cell, F.col("c_area")), amount, amount, name)

    tab = F.filter(
        F.transform(
            F.filter(_after(F.col("lines"), F.col("h3")), lambda x: (x["line"] != "") & ~x["line"].startswith("---")),
            tab_row,
        ),
        _good,
    )
    complete = F.col("c_rt").isNotNull() & F.col("c_area").isNotNull() & F.col("c_name").isNotNull()
    df = df.withColumns({"table": table, "quant": quant})
    chosen = F.when(F.size("table") > 0, F.col("table")).when(F.size("quant") > 0, F.col("quant")).when(complete, tab)
    return df.select("path", F.inline(chosen)).select(
        *_run_columns(F.col("path")), "rt", "peak_type", "area", "amount", "conc", "compound"
    )


def read_report_txt(spark: SparkSession, paths: str | Sequence[str], name_glob: str | None = None) -> DataFrame:
    return parse_report_texts(read_texts(spark, paths, name_glob))


# Header spellings of the vendor hit table.
ALIASES = {
    "compound": ["name", "compound", "compound name", "compound_name", "component", "hit name"],
    "cas": ["cas", "cas number", "cas_number"],
    "rt": ["rt", "retention time", "rt [min]", "ret time", "retention_time", "r.t."],
    "area": ["area", "peak area", "area [counts]", "peak_area", "abundance"],
    "match_factor": ["match", "match factor", "match_factor", "match quality", "match_quality", "score", "mf"],
    "reverse_match": ["r.match", "reverse match", "reverse_match", "rmatch", "rmf"],
    "formula": ["formula", "molecular formula", "mol formula"],
    "height": ["height", "peak height"],
}


def parse_vendor_hits(texts: DataFrame) -> DataFrame:
    """Library search exports with any of the known headers, tab or comma separated. ``texts``: path, text.

    Returns path, hit_seq and the eight canonical columns. A number that does not parse drops its row.
    """
    rows = F.transform(F.split(F.trim("text"), "\n"), lambda l, i: F.struct(i.alias("i"), l.alias("line")))
    df = texts.select("path", rows.alias("rows"), F.get(F.split(F.trim("text"), "\n"), F.lit(0)).alias("head"))
    df = df.withColumn("tabbed", F.col("head").contains("\t"))
    titles = F.transform(
        F.split("head", "[\t,]"), lambda t: F.trim(F.replace(F.replace(F.lower(F.trim(t)), F.lit('"'), F.lit("")), F.lit("#"), F.lit("")))
    )
    titles = F.when(F.col("tabbed"), F.transform(F.split("head", "\t"), lambda t: F.trim(F.translate(F.lower(t), '"#', "")))).otherwise(titles)
    df = df.withColumn("titles", titles)

    def place(spellings: list[str]) -> Column:
        return F.array_max(F.transform("titles", lambda t, i: F.when(t.isin(spellings), i)))

    df = df.withColumns({f"p_{n}": place(a) for n, a in ALIASES.items()}).filter(F.col("p_compound").isNotNull() | F.col("p_rt").isNotNull())
    lines = df.select("*", F.inline(F.filter("rows", lambda r: (r["i"] > 0) & (F.trim(r["line"]) != "") & ~F.trim(r["line"]).startswith("#"))))

    def fields(sep: str) -> Column:
        quoted = F.regexp_extract_all("line", F.lit(rf'(?:^|{sep})("(?:[^"]|"")*"|[^{sep}]*)'), F.lit(1))
        return F.transform(quoted, lambda c: F.replace(F.btrim(F.trim(c), F.lit('"')), F.lit('""'), F.lit('"')))

    lines = lines.withColumn("cells", F.when(F.col("tabbed"), fields("\t")).otherwise(fields(",")))
    last = F.greatest(*[F.coalesce(f"p_{n}", F.lit(-1)) for n in ALIASES])
    lines = lines.filter(F.get("cells", last).isNotNull())

    def text(name: str) -> Column:
        return F.coalesce(F.get("cells", F.col(f"p_{name}")), F.lit(""))

    def value(name: str) -> Column:
        cell = F.replace(F.get("cells", F.col(f"p_{name}")), F.lit(","), F.lit("")) if name in ("area", "height") else F.get("cells", F.col(f"p_{name}"))
        return F.when(F.col(f"p_{name}").isNull(), F.lit(0.0)).otherwise(number(cell))

    numeric = ["rt", "area", "match_factor", "reverse_match", "height"]
    out = lines.select(
        "path", F.col("i").alias("hit_seq"), text("compound").alias("compound"), text("cas").alias("cas"), text("formula").alias("formula"),
        *[value(n).alias(n) for n in numeric],
    )
    for n in numeric:
        out = out.filter(F.col(n).isNotNull())
    return out.filter((F.col("compound") != "") | (F.col("rt") > 0)).withColumns(
        {n: F.col(n).cast("int") for n in ("match_factor", "reverse_match")}
    )


# Which files of a run can hold vendor hits, in order of precedence. {} is the sample name without .D.
HIT_FILES = ["{}_library*", "{}_nist*", "{}_match*"]
GENERIC_HIT_FILES = ["*library*", "*nist*", "*search*", "*match*"]


def vendor_hits(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """J1 input: hits with their sample and file priority: own name inside the run folder, own name beside it, any name inside.

    ``files``: sample, folder of every run. ``parsed``: output of ``parse_vendor_hits``.
    """
    runs = files.select("sample", "folder").distinct().withColumn("stem", F.replace(F.col("sample"), F.lit(".D"), F.lit("")))
    located = parsed.withColumns(
        {"dir": F.regexp_replace("path", "/[^/]+$", ""), "file": F.regexp_extract("path", "([^/]+)$", 1)}
    )

    def order(patterns: list[str], offset: int, own: bool) -> Column:
        out = F.lit(None).cast("int")
        for i, pattern in reversed(list(enumerate(patterns))):
            word = pattern.strip("{}*")
            test = F.col("file").startswith(F.concat("stem", F.lit(word))) if own else F.col("file").contains(word)
            out = F.when(test & F.lower("file").endswith(".csv"), offset + i).otherwise(out)
        return out

    inside = located.join(runs, located["dir"] == runs["folder"]).withColumn(
        "file_priority", F.coalesce(order(HIT_FILES, 0, True), order(GENERIC_HIT_FILES, 6, False))
    )
    # files beside the run folders carry the sample name up to the first of the three words
    stem_of = F.regexp_extract("file", r"^(.*?)_(?:library|nist|match)", 1)
    beside = located.withColumn("own_stem", stem_of).join(
        runs, (F.col("own_stem") == runs["stem"])
    ).filter(F.col("dir") != F.col("folder")).withColumn("file_priority", order(HIT_FILES, 3, True))
    columns = ["sample", "file_priority", "file", "hit_seq", "rt", "compound", "match_factor", "reverse_match", "formula", "cas"]
    return inside.select(*columns).unionByName(beside.select(*columns)).filter(F.col("file_priority").isNotNull())
