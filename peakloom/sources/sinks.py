"""Writers: K1-K4. Every sink writes a folder of part files, so no row passes through the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from peakloom.operators.stats import pivot_mean


def write_summary_csv(peaks: DataFrame, path: str, compounds: Sequence[str] | None = None) -> None:
    """K1: samples x compounds as CSV."""
    pivot_mean(peaks, compounds).write.mode("overwrite").option("header", "true").csv(path)


def write_bundle(tables: dict[str, DataFrame], path: str, kind: str = "parquet") -> None:
    """K2: one folder per table, in place of the sheets of a workbook."""
    for name, table in tables.items():
        writer = table.write.mode("overwrite")
        if kind == "csv":
            writer.option("header", "true").csv(f"{path}/{name}")
        else:
            writer.parquet(f"{path}/{name}")


def report_rows(sections: dict[str, DataFrame]) -> DataFrame:
    """K3: rows (section, body) with one JSON object per row of each section."""
    out = None
    for name, table in sections.items():
        rows = table.select(F.lit(name).alias("section"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in table.columns])).alias("body"))
        out = rows if out is None else out.unionByName(rows)
    return out


def write_report(sections: dict[str, DataFrame], path: str) -> None:
    report_rows(sections).write.mode("overwrite").partitionBy("section").json(path)


def _plain(value: Column) -> Column:
    """Whole numbers without a fraction, as they are read."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


def msp_text(library: DataFrame) -> DataFrame:
    """K4: one MSP record per entry, fields that are set only, ions as ``mz int; ``."""
    have = library.columns

    def line(title: str, column: str) -> Column:
        if column not in have:
            return F.lit(None).cast("string")
        text = F.col(column).cast("string") if column != "ri_exp" else _plain(F.col(column))
        return F.concat(F.lit(f"{title}: "), F.nullif(text, F.lit("")))

    ions = F.array_join(F.transform("peaks", lambda p: F.concat(_plain(p["mz"]), F.lit(" "), p["intensity"].cast("string"))), "; ")
    return library.select(
        F.concat_ws(
            "\n", line("NAME", "name"), line("CASNO", "cas"), line("FORMULA", "formula"), line("RT_EXP", "rt_exp"),
            line("RETENTIONINDEX", "ri_exp"), line("COMPOUND_CLASS", "compound_class"), line("SOURCE", "source"),
            F.concat(F.lit("NUM PEAKS: "), F.size("peaks").cast("string")), F.concat(ions, F.lit(";")),
        ).alias("value")
    )


def write_msp(library: DataFrame, path: str) -> None:
    # a blank line ends each record, also at the seam of two parts
    msp_text(library).write.mode("overwrite").option("lineSep", "\n\n").text(path)
