"""Pattern scanners: tags, contacts, keywords, phrase rules, text clean-up.

Scanners are projections: they run inside the JVM and shuffle nothing. Each takes a table with a text column and
returns one row for each finding.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.text import java_regex

from .fixed_patterns import CONTACTS, DUAL, EXPORT_CONTROL, KEYWORDS, PATENTS, TAG_DUAL, TAG_LIST, TAG_NAMES

def parse_config(text: str) -> dict[str, str]:
    """Patterns by name: ``__NAME__`` is replaced by the value so far, by nothing if there is none."""
    found: dict[str, str] = {}
    for line in text.splitlines():
        name, sign, value = line.partition("=")
        if sign and not line.startswith("#"):
            found[name.strip()] = re.sub(r"__([A-Z_a-z]+?)__", lambda m: found.get(m[1], ""), value)
    return found


PATTERNS = {k: "(?i)" + java_regex(v) for config in (CONTACTS, EXPORT_CONTROL, PATENTS, KEYWORDS) for k, v in parse_config(config).items()}
#: The group of a pattern that is the finding.
GROUPS = {"email": 1}


def regex_findings(files: DataFrame, key: str, text: Column, pattern: str, kind: str, group: int = 0) -> DataFrame:
    """key, type, content: every match of a pattern in Java's dialect, in order, repeats included."""
    return files.select(key, F.lit(kind).alias("type"), F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).alias("content"))


def described_scanner(description: str, default: str = "match") -> tuple[str, int, str]:
    """type, group and pattern of ``type@@group@@pattern``, of which the first two may be left out."""
    kind, group, pattern = re.fullmatch(r"(?:([A-Za-z]+)@@)?(?:(\d+)@@)?(.*)", description, re.S).groups()
    return kind or default, int(group or 0), pattern


def contact_findings(files: DataFrame, key: str, text: Column, kinds: tuple[str, ...] = ("url", "email", "author", "ecc", "ipra", "keyword")) -> DataFrame:
    """Findings of the configured scanners, cleaned and hashed: key, type, content, hash."""

    def found(kind: str) -> Column:
        hits = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(GROUPS.get(kind, 0)))
        return F.transform(hits, lambda x: F.struct(F.lit(kind).alias("type"), cleaned(x, kind).alias("content")))

    each = [found(k) for k in kinds]
    rows = files.select(key, F.explode(F.concat(*each)).alias("f")).select(key, "f.type", "f.content").filter("content != ''")
    return rows.withColumn("hash", F.md5("content"))


def cleaned(content: Column, kind: str = "") -> Column:
    """A finding's text: stretches of space become one, ends trimmed; of statements line starts and the tag's name go, too."""
    if kind == "statement":
        content = F.regexp_replace(content, r"\n[\s\p{Punct}]*", " ")
        content = F.regexp_replace(content, "(?i)spdx-filecopyrighttext:", " ")
    return F.trim(F.regexp_replace(content, r"[\s\x00-\x1f]{2,}", " "))


def license_tags(files: DataFrame, key: str, text: Column) -> DataFrame:
    """key, n_list, n, name: license names of tags in order, with the dual-license marker after a list that joins names."""
    lists = files.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(TAG_LIST), F.lit(1))).alias("n_list", "list"))
    names = F.regexp_extract_all("list", F.lit(TAG_NAMES), F.lit(1))
    duals = F.transform(F.regexp_extract_all("list", F.lit(TAG_DUAL), F.lit(0)), lambda _: F.lit(DUAL))
    return lists.select(key, "n_list", F.posexplode(F.concat(names, duals)).alias("n", "name"))


def tag_key(name: Column) -> Column:
    """A key under which names that mean the same license are equal: any case, X+ is X-or-later, X is X-only."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"(\+|-or-later)$", "+"), "-only$", "")


def resolved_tags(tags: DataFrame, licenses: DataFrame, candidates: DataFrame, group: int) -> DataFrame:
    """tags with rf_pk: an exact name (any case) before one that means the same, main licenses before the group's candidates; else null."""
    main = licenses.select("rf_pk", "shortname", F.lit(0).alias("_of"))
    own = candidates.filter(F.col("group_fk") == group).select("rf_pk", "shortname", F.lit(1).alias("_of"))
    known = main.union(own).withColumn("_key", tag_key(F.col("shortname")))
    names = tags.select("name").distinct().withColumn("_key", tag_key(F.col("name")))
    rank = F.struct("_of", (F.lower("name") != F.lower("shortname")).cast("int").alias("x"), "rf_pk")
    best = names.join(known, "_key").groupBy("name").agg(F.min(rank).alias("r")).select("name", "r.rf_pk")
    return tags.join(best, "name", "left")


def without_repeats(tags: DataFrame, key: str) -> DataFrame:
    """Tags without those equal to the one before in the same file."""
    before = F.lag("name").over(Window.partitionBy(key).orderBy("n_list", "n"))
    return tags.withColumn("_p", before).filter(~F.col("name").eqNullSafe(F.col("_p"))).drop("_p")


def line_scan(files: DataFrame, key: str, text: Column, pattern: str) -> DataFrame:
    """key, line, pos, content of the first hit in each line; one row with nulls for a file without any."""
    lines = files.select(key, F.posexplode_outer(F.split(text, "\n")).alias("n", "content"))
    hits = lines.filter(F.col("content").rlike(pattern)).select(key, (F.col("n") + 1).alias("line"), F.regexp_instr("content", F.lit(pattern)).alias("pos"), "content")
    return files.select(key).join(hits, key, "left")


# Phrase rules.


def rule_pattern(rule: str) -> str:
    """A phrase rule as a pattern: any, some and few stand for gaps of bounded length."""
    for mark, gap in (("=ANY=", ".*"), ("=SOME=", ".{0,60}"), ("=FEW=", ".{0,30}"), ("=YEAR=", r"(?:19|20)\d\d")):
        rule = rule.replace(mark, gap)
    return "(?is)" + rule


#: Our own rules: (license, interest, seed, rule).
RULES = [
    ("Apache-2.0", 2, "apache", r"apache license,? version 2"),
    ("MIT", 2, "mit license", r"\bmit license"),
    ("GPL-3.0-only", 2, "general public license", r"gnu general public license,? version 3"),
    ("CC-BY-NC-4.0", 2, "cc by-nc", r"\bcc by-nc 4\.0"),
    ("Reserved-rights", 1, "rights reserved", r"all =FEW=rights reserved"),
]


def keyword_score(text: Column, keywords: list[str], single: bool = False) -> Column:
    """How many of the keyword patterns occur; at least 1 for a file that is scanned alone."""
    total = sum((text.rlike("(?i)" + k).cast("int") for k in keywords), F.lit(0))
    return F.greatest(total, F.lit(1)) if single else total


def scan_worthy(name: Column, score: Column, patterns: list[str]) -> Column:
    """Files worth a scan: by their name or by a keyword."""
    by_name = F.lit(False)
    for p in patterns:
        by_name = by_name | name.rlike("(?i)" + p)
    return F.coalesce(by_name, F.lit(False)) | (score >= 1)


def phrase_rules(files: DataFrame, key: str, text: Column, rules: list[tuple[str, int, str, str]] = RULES) -> DataFrame:
    """key, shortname, interest of every rule that a text meets; a cheap seed goes before each pattern.

    Where a file has licenses of high interest (2), those of low interest are dropped. Files that meet no rule
    have one row with the name for "nothing".
    """
    low = F.lower(text)
    hits = [F.when(low.contains(seed) & text.rlike(rule_pattern(rule)), F.struct(F.lit(name).alias("shortname"), F.lit(interest).alias("interest"))) for name, interest, seed, rule in rules]
    found = F.filter(F.array(*hits), lambda x: x.isNotNull())
    best = F.exists(found, lambda x: x["interest"] >= 2)
    kept = F.filter(found, lambda x: ~best | (x["interest"] >= 2))
    none = F.array(F.struct(F.lit("No_license_found").alias("shortname"), F.lit(0).alias("interest")))
    return files.select(key, F.explode(F.when(F.size(kept) > 0, kept).otherwise(none)).alias("r")).select(key, "r.shortname", "r.interest")


#: Steps of the text clean-up: pattern and replacement, in a dialect that Java and RE2 share.
#: Markup loses its brackets and the signs of entities, not its words.
MARKUP_STEPS = [(r"(?i)<string|[<>]", " "), (r"(?i)&(copy;)", "\x02\\1"), ("&", " "), ("\x02", "&")]
#: What opens a comment at the start of a line.
COMMENT_STEPS = [(r"(?im)^[ \t]*(?://|dnl\b|rem\b|xcomm\b|comment\b|%%copyright:)", ""), (r"(?im)^[ \t]*(?:>|@(?:author|comment|center|rem|c essay|c)\b|\\par )", " ")]
POSTSCRIPT_STEPS = [(r"(?m)^%+|\)[ \t]*(?:show|Tj)\b", " ")]
#: Font sizes, written line ends and backslashes; characters outside ASCII, control characters and tildes.
PLAIN_STEPS = [(r"\\s[+-]?[0-9]*|\\n|\\", " "), (r"[^\x00-\x7F©]|[\x01-\x06\x0E-\x1F~]", ""), (r"[\x07\t\n\r\x0B\x0C\[\]{}*=#$|%!?`\"']", " "), (r"(?i)<string", " "), (r"\++([^ +])", r" \1")]
#: Punctuation goes, but for (c).
SENTENCE_STEPS = [(r"(?i)\((c)\)", "\x02\\1\x03"), (r"[(),:;]", " "), (r"\.", ""), ("\x02", "("), ("\x03", ")")]
#: The halves of a hyphenated word join; dashes, slashes and underscores at the end of a word and print calls go; spaces collapse.
WORD_STEPS = [(r"(?i)([a-z])- ([a-z])", r"\1\2"), ("[-_/]+ ", " "), (r"(?i)(^|[^rt])print[_a-z]* ", r"\1 "), (" +", " ")]


def clean_up_steps(markup: bool = False, postscript: bool = False, sentences: bool = True) -> list[tuple[str, str]]:
    return MARKUP_STEPS * markup + COMMENT_STEPS + POSTSCRIPT_STEPS * postscript + PLAIN_STEPS + SENTENCE_STEPS * sentences + WORD_STEPS


def doctored(text: Column, markup: bool = False, postscript: bool = False, sentences: bool = True) -> Column:
    """Text in the form rules are matched on (S16): ten steps from markup to spaces; sentences=False keeps punctuation between words."""
    for pattern, to in clean_up_steps(markup, postscript, sentences):
        text = F.regexp_replace(text, pattern, to.replace("\\1", "$1").replace("\\2", "$2"))
    return text


def original_positions(text: str, invisible: str = " \t\r\n") -> list[int]:
    """For each character of a text with collapsed stretches of space, where it stood before."""
    keep = [i for i, c in enumerate(text) if c not in invisible or i == 0 or text[i - 1] not in invisible]
    return keep


# Results of other tools.


def mapped_names(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """rows(pfile_fk, result) of a scanner that writes ``;;a,b``: one license name each, renamed as the map says; pct 0 for none."""
    head = F.split(F.split("result", ";").getItem(0), ",")
    each = rows.select("pfile_fk", F.explode(head).alias("_n")).withColumn("_n", F.trim("_n"))
    renamed = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else F.create_map().cast("map<string,string>")
    name = F.coalesce(renamed[F.col("_n")], F.col("_n"))
    return each.select("pfile_fk", name.alias("shortname"), F.when(F.col("_n").isin("", "NONE", "UNKNOWN"), 0).otherwise(100).alias("pct")).distinct()
