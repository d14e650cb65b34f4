"""Catalogues in and out: licenses, obligations, phrases, compatibility rules, packages, results of other scanners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Other names of columns in files that are imported.
LICENSE_ALIASES = {
    "shortname": ["shortname", "Short Name", "rf_shortname"], "fullname": ["fullname", "Long Name", "rf_fullname"], "text": ["text", "Full Text", "rf_text"],
    "parent_shortname": ["parent_shortname", "Decider Short Name"], "report_shortname": ["report_shortname", "Regular License Text Short Name"],
    "url": ["url", "URL", "rf_url"], "notes": ["notes", "rf_notes"], "source": ["source", "Foreign ID"], "risk": ["risk", "risk_level"],
}
OBLIGATION_ALIASES = {"type": ["type", "Type"], "topic": ["topic", "Obligation or Risk topic"], "text": ["text", "Full Text"], "classification": ["classification", "Classification"], "licnames": ["licnames", "Associated Licenses"]}
PHRASE_ALIASES = {"text": ["text", "phrase"], "acknowledgement": ["acknowledgement"], "comments": ["comments"], "licnames": ["licnames", "licenses"]}


def renamed(rows: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """The known columns under their own names; those missing are null, others are dropped."""
    present = {c.strip().lower(): c for c in rows.columns}
    pick = {k: next((present[a.lower()] for a in names if a.lower() in present), None) for k, names in aliases.items()}
    return rows.select(*[(F.col(f"`{c}`") if c else F.lit(None)).cast("string").alias(k) for k, c in pick.items()])


def read_catalogue(spark: SparkSession, path: str, aliases: dict[str, list[str]], delimiter: str = ",") -> DataFrame:
    """A CSV (quoted fields may span lines) or JSON file with any of the known headers."""
    if path.endswith(".json"):
        return renamed(spark.read.option("multiLine", True).json(path), aliases)
    return renamed(spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", delimiter).csv(path), aliases)


def upserted(known: DataFrame, new: DataFrame, key: str | list[str], columns: list[str]) -> DataFrame:
    """key (or keys), columns, state of an import (I12, I13): ``new``, ``updated`` or ``same``, and ``kept`` for rows not imported.

    Values that the import leaves empty keep their old value. Of several imported rows with a key the greatest counts.
    """
    keys = [key] if isinstance(key, str) else key
    n = new.groupBy(*keys).agg(*[F.max(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_new"))
    both = known.select(*keys, *columns, F.lit(True).alias("_old")).join(n, keys, "full")
    value = {c: F.coalesce(F.nullif(F.col(f"_{c}"), F.lit("")), F.col(c)) for c in columns}
    changed = F.lit(False)
    for c in columns:
        changed = changed | ~value[c].eqNullSafe(F.col(c))
    state = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "kept").when(changed, "updated").otherwise("same")
    return both.select(*keys, *[v.alias(c) for c, v in value.items()], state.alias("state"))


def linked_names(rows: DataFrame, licenses: DataFrame, sep: str = ";") -> DataFrame:
    """topic, text, rf_pk of an imported list of license names: one row for each known name."""
    names = rows.select("*", F.explode(F.split("licnames", sep)).alias("_n")).withColumn("_n", F.trim("_n"))
    return names.join(licenses.select("rf_pk", F.col("shortname").alias("_n")), "_n").drop("_n", "licnames")


def parse_rules(text: str) -> tuple[bool, list[dict]]:
    """The default and the rules of a compatibility file in the plain YAML form ``- key: value``."""
    default, rules, yes = False, [], ("true", "yes")
    for line in text.splitlines():
        body = line.split(" #")[0].strip()
        if not body or body.startswith("#") or body == "---":
            continue
        if body.startswith("default:"):
            default = body.partition(":")[2].strip().lower() in yes
            continue
        if body == "rules:":
            continue
        if body.startswith("- "):
            rules.append({})
            body = body[2:]
        key, sign, value = body.partition(":")
        if sign and rules:
            value = value.strip().strip("\"'")
            rules[-1][key.strip()] = None if value in ("", "~", "null") else value.lower() in yes if key.strip() == "compatibility" else value
    return default, rules


def format_rules(default: bool, rules: list[dict]) -> str:
    """The file that parse_rules reads."""
    value = lambda v: "~" if v is None else str(v).lower() if isinstance(v, bool) else f'"{v}"'
    out = ["---", f"default: {str(default).lower()}", "rules:"]
    for r in rules:
        out += [f"  {'- ' if i == 0 else '  '}{k}: {value(v)}" for i, (k, v) in enumerate(r.items())]
    return "\n".join(out) + "\n"


def rule_rows(spark: SparkSession, rules: list[dict], licenses: DataFrame) -> DataFrame:
    """Rules with license ids instead of names, as the compatibility operators take them."""
    names = "firstname string, secondname string, firsttype string, secondtype string, compatibility boolean"
    rows = spark.createDataFrame([tuple(r.get(k) for k in ("firstname", "secondname", "firsttype", "secondtype", "compatibility")) for r in rules], names)
    first, second = licenses.select(F.col("rf_pk").alias("first_rf_fk"), F.col("shortname").alias("firstname")), licenses.select(F.col("rf_pk").alias("second_rf_fk"), F.col("shortname").alias("secondname"))
    return rows.join(first, "firstname", "left").join(second, "secondname", "left").select("first_rf_fk", "second_rf_fk", F.col("firsttype").alias("first_type"), F.col("secondtype").alias("second_type"), "compatibility")


def control_field(control: Column, name: str) -> Column:
    """A field of a Debian control text with its continued lines joined by spaces (I8)."""
    value = F.regexp_extract(control, rf"(?im)^{name}:[ \t]*((?:.*)(?:\n[ \t]+.*)*)", 1)
    return F.nullif(F.trim(F.regexp_replace(value, r"\n[ \t]+", " ")), F.lit(""))


def debian_packages(files: DataFrame) -> DataFrame:
    """pfile_fk with the fields of files(pfile_fk, text) that are Debian control texts; depends and such as arrays (I8)."""
    t = F.col("text")
    plain = {"package": "Package", "version": "Version", "source_package": "Source", "maintainer": "Maintainer", "architecture": "Architecture", "section": "Section", "description": "Description"}
    rows = files.filter(t.rlike(r"(?im)^(Package|Source):")).select("pfile_fk", *[control_field(t, f).alias(c) for c, f in plain.items()], control_field(t, "Depends").alias("_d"))
    return rows.withColumn("requires", F.transform(F.split(F.coalesce("_d", F.lit("")), ","), lambda x: F.trim(x))).withColumn("requires", F.filter("requires", lambda x: x != "")).drop("_d")


def spec_packages(files: DataFrame) -> DataFrame:
    """pfile_fk with the fields of files(pfile_fk, text) that are RPM spec texts (I8); binary headers are not read."""
    t = F.col("text")
    plain = {"package": "Name", "version": "Version", "release": "Release", "license": "License", "vendor": "Vendor", "group": "Group", "url": "URL"}
    return files.filter(t.rlike(r"(?m)^Name:")).select("pfile_fk", *[control_field(t, f).alias(c) for c, f in plain.items()], F.regexp_extract_all(t, F.lit(r"(?m)^Requires:[ \t]*(.+)$"), F.lit(1)).alias("requires"))


def scanner_results(rows: DataFrame) -> DataFrame:
    """pfile_fk, shortname, pct, start, end of another scanner's JSON results in rows(pfile_fk, json)."""
    schema = "struct<licenses:array<struct<key:string,spdx_license_key:string,score:double,start_byte:int,end_byte:int>>>"
    each = rows.select("pfile_fk", F.explode(F.from_json("json", schema)["licenses"]).alias("l"))
    return each.select("pfile_fk", F.coalesce("l.spdx_license_key", "l.key").alias("shortname"), F.round("l.score").cast("int").alias("pct"), F.col("l.start_byte").alias("start"), F.col("l.end_byte").alias("end"))
