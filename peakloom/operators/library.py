"""Spectral library: W9, J6, A26, M19-M21."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from peakloom.operators.kovats import name_parts
from peakloom.session import cut_lineage

# Which source wins when two entries share a CAS number.
SOURCE_PRIORITY = {"builtin_msp": 3, "mona_json": 2, "msp_file": 2, "nist_webbook_csv": 1}


def source_priority(source: Column) -> Column:
    out = F.lit(0)
    for name, priority in SOURCE_PRIORITY.items():
        out = F.when(source == name, priority).otherwise(out)
    return out


def deduplicate(library: DataFrame, min_peaks: int = 3) -> DataFrame:
    """One entry per CAS number (source, then ions, then load order), one per name among entries without CAS.

    A rank limit of one is applied on both sides of the exchange, so a CAS with very many copies sends one row per task.
    """
    cas = F.nullif(F.trim("cas"), F.lit(""))
    usable = library.filter(F.size("peaks") >= min_peaks).withColumns(
        {
            "_key": F.coalesce(F.concat(F.lit("cas:"), cas), F.concat(F.lit("name:"), F.col("name"))),
            "_priority": F.when(cas.isNotNull(), source_priority(F.col("source"))).otherwise(0),
            "_size": F.when(cas.isNotNull(), F.size("peaks")).otherwise(0),
        }
    )
    order = W.partitionBy("_key").orderBy(F.desc("_priority"), F.desc("_size"), "load_seq")
    ranked = usable.withColumn("_rank", F.row_number().over(order))
    return ranked.filter(F.col("_rank") == 1).drop("_key", "_priority", "_size", "_rank")


def search_by_cas(library: DataFrame, cas: str) -> DataFrame:
    """J6."""
    return library.filter(F.col("cas") == cas.strip()).select("name", "cas", "formula", "source", F.size("peaks").alias("n_peaks"), "peaks")


def search_by_name(library: DataFrame, name: str, k: int = 20) -> DataFrame:
    """Names containing the text, exact matches first, then by number of ions."""
    wanted = name.lower().strip()
    return (
        library.filter(F.col("name").contains(wanted))
        .select("lib_id", "name", "cas", "formula", "source", F.size("peaks").alias("n_peaks"))
        .orderBy(F.col("name") != wanted, F.desc("n_peaks"), "lib_id")
        .limit(k)
    )


def summary(library: DataFrame) -> DataFrame:
    """A26."""
    return library.agg(
        F.count(F.lit(1)).alias("total_entries"), F.countDistinct(F.nullif("cas", F.lit(""))).alias("total_unique_cas")
    )


def entries_by_source(library: DataFrame) -> DataFrame:
    return library.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


# Name parts that score for a class. A part ending in $ counts only at the end of a name.
FLAVOR_PARTS = [
    "al", "ol", "one", "oate", "al$", "oic acid", "ester", "ether", "ketone", "aldehyde", "furan", "pyran", "lactone",
    "thiol", "thioether", "pyrazine", "thiazole", "oxazole", "pyrrole", "terpene", "phenol", "quinone", "ionone",
]
PHARMA_PARTS = [
    "ine$", "azole", "avir", "artan", "vastatin", "pril", "olol", "dipine", "sartan", "cycline", "mycin", "oxacin",
    "bital", "zepam", "profen", "vir$", "dronate", "mab$", "tinib", "zomib", "parib", "amine$", "ium$", "chloride",
    "sulfate", "sodium", "hydrochloride", "phosphate", "nitrate", "citrate", "metabolite",
]
INDUSTRIAL_PARTS = [
    "silane", "siloxane", "phosphate", "phosphonate", "polyethylene", "polypropylene", "polystyrene", "benzene, 1,",
    "benzene, 1-", "crown-", "peg ", "ethoxylate", "isocyanate", "epoxy", "acrylate", "methacrylate",
]
NATURAL_PARTS = [
    "terpene", "sesquiterpene", "diterpene", "triterpene", "alkaloid", "flavonoid", "steroid", "carotenoid",
    "fatty acid", "amino acid", "sugar", "glucose", "acid methyl ester", "acid ethyl ester",
]
# Names that are food aroma compounds without further scoring.
FOOD_NAMES = [
    "hexanal", "heptanal", "octanal", "nonanal", "decanal", "benzaldehyde", "phenylacetaldehyde", "vanillin",
    "ethyl vanillin", "acetoin", "diacetyl", "2,3-pentanedione", "furfural", "5-methylfurfural",
    "5-hydroxymethylfurfural", "maltol", "ethyl maltol", "furaneol", "sotolon", "2-acetyl-1-pyrroline",
    "2-acetylpyridine", "2-acetylpyrazine", "2-acetylthiazole", "2-acetyloxazole", "2-methylpyrazine",
    "2,5-dimethylpyrazine", "2,6-dimethylpyrazine", "2,3,5-trimethylpyrazine", "2-ethyl-3,5-dimethylpyrazine",
    "tetramethylpyrazine", "2,3,5,6-tetramethylpyrazine", "guaiacol", "4-ethylguaiacol", "4-vinylguaiacol", "eugenol",
    "isoeugenol", "limonene", "alpha-pinene", "beta-pinene", "myrcene", "linalool", "geraniol", "nerol", "citronellol",
    "citronellal", "camphor", "menthol", "thymol", "carvacrol", "estragole", "anethole", "ethyl acetate",
    "ethyl butanoate", "ethyl hexanoate", "ethyl octanoate", "ethyl decanoate", "isoamyl acetate", "isobutyl acetate",
    "methyl butanoate", "methyl hexanoate", "methyl octanoate", "acetic acid", "butanoic acid", "hexanoic acid",
    "octanoic acid", "3-methylbutanoic acid", "3-methylbutanal", "2-methylbutanal", "2-heptanone", "2-nonanone",
    "2-undecanone", "2-tridecanone", "dimethyl sulfide", "dimethyl disulfide", "dimethyl trisulfide", "methional",
    "methionol", "2-phenylethanol", "phenylethyl acetate", "benzyl alcohol", "gamma-decalactone", "gamma-nonalactone",
    "gamma-octalactone", "delta-decalactone", "delta-dodecalactone", "skatole", "indole", "cresol", "4-ethylphenol",
    "4-vinylphenol",
]


def _part_score(name: Column, parts: Sequence[str], at_end: float, inside: float) -> Column:
    total = F.lit(0.0)
    for part in parts:
        if part.endswith("$"):
            total = total + F.when(name.endswith(part[:-1]), at_end).otherwise(0.0)
        else:
            total = total + F.when(name.endswith(part), at_end).when(name.contains(part), inside).otherwise(0.0)
    return total


def _occurrences(text: Column, part: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / F.lit(len(part))


def classify(library: DataFrame) -> DataFrame:
    """compound_class and class_confidence from name, formula, number of ions and, when the column exists, mw.

    Element counts are substring counts, so SI also counts as S and NA as N.
    """
    name = F.lower(F.trim("name"))
    formula = F.upper(F.coalesce("formula", F.lit("")))
    ions = F.size("peaks") if "peaks" in library.columns else F.coalesce("n_peaks", F.lit(0))
    mw = F.col("mw") if "mw" in library.columns else F.lit(None).cast("double")
    n, s, si = _occurrences(formula, "N"), _occurrences(formula, "S"), _occurrences(formula, "SI")
    salts = formula.contains("P") | formula.contains("CL") | formula.contains("BR")

    df = library.withColumns(
        {
            "_food": _part_score(name, FLAVOR_PARTS, 1.5, 0.5),
            "_pharma": _part_score(name, PHARMA_PARTS, 2.0, 1.0),
            "_industrial": _part_score(name, INDUSTRIAL_PARTS, 2.0, 2.0),
            "_natural": _part_score(name, NATURAL_PARTS, 1.0, 1.0),
        }
    )
    sulfur_in_food = (s > 0) & (F.col("_food") > 0)
    df = df.withColumns(
        {
            "_pharma": F.col("_pharma") + F.when(n >= 2, n - 1).otherwise(0.0) + F.when(salts, 1.0).otherwise(0.0)
            + F.when(mw > 500, 2.0).otherwise(0.0),
            "_industrial": F.col("_industrial") + F.when(si > 0, 3.0).otherwise(0.0)
            + F.when((s > 0) & (F.col("_food") <= 0), 0.5).otherwise(0.0),
            "_food": F.col("_food") + F.when(sulfur_in_food, 1.0).otherwise(0.0)
            + F.when(mw > 500, -1.0).when(mw < 300, 0.5).otherwise(0.0)
            + F.when((ions > 0) & (ions < 15), 0.3).otherwise(0.0),
        }
    )
    scores = ["_food", "_pharma", "_industrial", "_natural"]
    best = F.greatest(*scores)
    category = (
        F.when(best <= 0.5, "other").when(F.col("_food") == best, "food_flavor")
        .when(F.col("_pharma") == best, "pharmaceutical").when(F.col("_industrial") == best, "industrial")
        .otherwise("natural_product")
    )
    ranked = F.sort_array(F.array(*scores), asc=False)
    confidence = F.least(F.lit(1.0), (F.get(ranked, F.lit(0)) - F.get(ranked, F.lit(1))) / 3.0 + F.lit(0.3).cast("double"))
    empty, food = F.coalesce(name == "", F.lit(True)), name.isin(FOOD_NAMES)
    return df.withColumns(
        {
            "compound_class": F.when(empty, "other").when(food, "food_flavor").otherwise(category),
            "class_confidence": F.when(empty, 0.0).when(food, 1.0).otherwise(confidence),
        }
    ).drop(*scores)


def class_shares(classified: DataFrame) -> DataFrame:
    """Entries and percent per class."""
    counts = classified.groupBy("compound_class").agg(F.count(F.lit(1)).alias("n"))
    whole = W.partitionBy(F.lit(0))  # one row per class
    return counts.withColumn("pct", F.round(F.col("n") / F.sum("n").over(whole) * 100, 1))


# Default rules: category names in order of precedence with a few keywords each. They are a short form; names that only a
# longer table knows come out differently. A table of any length is a parameter, as data (``rules_table``, ``categorized``).
CATEGORY_RULES = [
    ("ester", ["ester", "lactone", "acetate", "butyrate", "phthalate", "benzoate"]),
    ("solvent/VOC", ["solvent", "methanol", "ethanol", "acetone", "benzene", "toluene", "xylene", "hexane", "decane"]),
    ("ketone", ["ketone", "dione", "quinone", "heptanone", "ionone", "carvone", "camphor"]),
    ("pyrazine/pyrrole", ["pyrazine", "pyrrole", "imidazole", "pyridine", "indole", "skatole"]),
    ("alcohol", ["alcohol", "linalool", "geraniol", "menthol", "hexanol", "octanol", "glycerol"]),
    ("aldehyde", ["aldehyde", "hexanal", "octanal", "nonanal", "furfural", "citral"]),
    ("phenol/polyphenol", ["phenol", "guaiacol", "eugenol", "vanillin", "cresol", "thymol"]),
    ("PAH", ["naphthalene", "anthracene", "phenanthrene", "pyrene", "fluorene"]),
    ("amino acid/derivative", ["alanine", "glycine", "leucine", "lysine", "proline", "valine"]),
    ("sugar/carbohydrate", ["glucose", "fructose", "sucrose", "saccharide", "sugar"]),
    ("drug/pharmaceutical", ["ibuprofen", "aspirin", "antibiotic", "pharmaceutical", "statin"]),
    ("steroid/hormone", ["steroid", "sterol", "cholesterol", "testosterone", "cortisol"]),
    ("vitamin/cofactor", ["vitamin", "retinol", "tocopherol", "ascorbic", "biotin"]),
    ("lipid/fatty acid", ["lipid", "fatty acid", "palmitic", "stearic", "oleic"]),
    ("alkaloid", ["alkaloid", "caffeine", "nicotine", "quinine", "morphine"]),
    ("terpene/terpenoid", ["terpene", "pinene", "limonene", "myrcene", "cymene"]),
    ("organometallic/silicon", ["siloxane", "silane", "silyl", "ferrocene"]),
    ("PCB/organohalogen", ["polychlorinated", "pcb", "perfluor", "lindane", "ddt"]),
    ("pesticide/agrochemical", ["pesticide", "herbicide", "fungicide", "atrazine"]),
    ("plasticizer/additive", ["plasticizer", "adipate", "bisphenol", "paraben"]),
    ("mycotoxin", ["mycotoxin", "aflatoxin", "ochratoxin", "patulin"]),
    ("natural product", ["curcumin", "resveratrol", "natural product", "essential oil"]),
    ("environmental contaminant", ["dioxin", "nonylphenol", "triclosan"]),
    ("gas/small molecule", ["methane", "ethane", "ammonia", "nitrogen", "oxygen"]),
    ("sulfur compound", ["sulfide", "thiol", "thiophene", "thiazole", "sulfone"]),
]


def read_category_rules(spark, path: str) -> list[tuple[str, list[str]]]:
    """Rules from a JSON-lines file with ``category`` and ``keywords``; line order is precedence. A small settings file."""
    rows = spark.read.schema("category string, keywords array<string>").json(path, lineSep="\n")
    return [(r["category"], r["keywords"]) for r in rows.collect()]


def category(name: Column, rules: Sequence[tuple[str, Sequence[str]]] = CATEGORY_RULES) -> Column:
    """The first category with a keyword inside the name, else other/niche."""
    out = None
    for label, words in rules:
        test = F.lower(name).rlike("|".join(re.escape(w) for w in words))
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise("other/niche") if out is not None else F.lit("other/niche")


def category_counts(library: DataFrame, rules: Sequence[tuple[str, Sequence[str]]] = CATEGORY_RULES) -> DataFrame:
    return library.groupBy(category(F.col("name"), rules).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def rules_table(spark, path: str) -> DataFrame:  # noqa: ANN001
    """Rules from a JSON-lines file with ``category`` and ``keywords``, as (priority, category, keyword); line order is
    precedence. The priority orders the lines whatever their number and however the file was split."""
    rows = spark.read.schema("category string, keywords array<string>").json(path, lineSep="\n")
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return cut_lineage(rows.select(place.alias("priority"), "category", F.explode("keywords").alias("keyword")))


def categorized(names: DataFrame, rules: DataFrame) -> DataFrame:
    """M21 by an index over the keywords: (name, category) of each distinct name, other/niche without a keyword.

    ``rules``: priority, category, keyword. The substrings of a name that have the length of some keyword meet the keywords
    by equality, and the smallest priority wins, so the work follows the names and not names times keywords.
    """
    words = rules.select("priority", "category", F.lower("keyword").alias("keyword")).filter(F.col("keyword") != "")
    first = words.groupBy("keyword").agg(F.min(F.struct("priority", "category")).alias("rule"))
    distinct = names.select("name").distinct()
    lowered = distinct.select(F.lower("name").alias("text")).distinct()
    lengths = words.agg(F.collect_set(F.length("keyword")).alias("l")).scalar()
    parts = name_parts(lowered, "text", F.coalesce(lengths, F.array().cast("array<int>")), "keyword")
    best = parts.join(first, "keyword").groupBy("text").agg(F.min("rule").alias("rule"))
    found = distinct.join(best, F.lower("name") == F.col("text"), "left")
    return found.select("name", F.coalesce("rule.category", F.lit("other/niche")).alias("category"))


def counts_by_rules(library: DataFrame, rules: DataFrame) -> DataFrame:
    """Entries per category of ``categorized``."""
    counts = library.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    named = categorized(library, rules)
    return counts.join(named, counts["name"].eqNullSafe(named["name"])).groupBy("category").agg(F.sum("n").alias("n"))
