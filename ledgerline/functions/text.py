"""Scalar functions on text columns; all run inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that stand for "nothing", and prefixes of license references.
NO_LICENSE, VOID = "No_license_found", "Void"
REF_PREFIX = "LicenseRef-"


def natural_key(text: Column) -> Column:
    """A key whose plain order is the natural, case-insensitive order (file2 before file10)."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), F.lit(1))

    def part(x: Column) -> Column:
        number = F.regexp_replace(x, "^0+", "")
        return F.when(x.rlike(r"^\d"), F.concat(F.lpad(F.length(number).cast("string"), 4, "0"), number)).otherwise(x)

    return F.array_join(F.transform(parts, part), "")


def clean_name(name: Column) -> Column:
    """Unprintable characters, slashes and backslashes become ``~``."""
    return F.regexp_replace(name, r"[^\x20-\x7E]|[/\\]", "~")


def clean_text(text: Column) -> Column:
    """Text without control characters; tabs and line ends stay."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def without_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def fuzzy_name(name: Column, extension: bool = True) -> Column:
    """A file name without digits, dots, dashes and underscores; extension=False drops the extension first.

    Of a name with an extension the dot goes with it.
    """
    return F.regexp_replace(name if extension else F.regexp_replace(name, r"(?<=\.)[^.]*$", ""), r"[0-9._-]", "")


def spaces_to_dashes(name: Column) -> Column:
    """Spaces become dashes, but for those around AND, OR and WITH of an expression."""
    return F.regexp_replace(F.replace(name, F.lit(" "), F.lit("-")), r"(?i)-(OR|AND|WITH)-(?!later)", " $1 ")


def license_ref(name: Column) -> Column:
    """The identifier after the prefix holds letters, digits, dots and single inner dashes only; other names stay."""
    tail = F.regexp_replace(F.regexp_replace(F.substr(name, F.lit(len(REF_PREFIX) + 1)), r"[^a-zA-Z0-9.\-]", "-"), "-+", "-")
    tail = F.regexp_replace(tail, "^-|-$", "")
    return F.when(name.startswith(REF_PREFIX) & (tail != ""), F.concat(F.lit(REF_PREFIX), tail)).otherwise(name)


def spdx_id(short_name: Column, known_id: Column, own: str = "local-") -> Column:
    """The SPDX id of a license: the known one, else a reference made of its short name.

    A plus in a reference becomes ``-or-later``. The two names that stand for "nothing" stay.
    """
    nothing = F.lower(short_name).isin(NO_LICENSE.lower(), VOID.lower())
    made = F.when(short_name.startswith(REF_PREFIX), short_name).otherwise(F.concat(F.lit(REF_PREFIX + own), short_name))
    chosen = F.when(nothing, short_name).otherwise(F.coalesce(F.nullif(known_id, F.lit("")), made))
    chosen = F.when(chosen.startswith(REF_PREFIX), F.replace(chosen, F.lit("+"), F.lit("-or-later"))).otherwise(chosen)
    return license_ref(spaces_to_dashes(chosen))


def license_expression(names: Column) -> Column:
    """Names in natural order joined by AND; of exactly three with one dual-license marker the other two by OR."""
    ordered = F.transform(F.array_sort(F.transform(names, lambda x: F.struct(natural_key(x).alias("k"), x.alias("x")))), lambda s: s["x"])
    dual = F.filter(ordered, lambda x: x.rlike(rf"^({REF_PREFIX}(local-)?)?Dual-license"))
    rest = F.filter(ordered, lambda x: ~x.rlike(rf"^({REF_PREFIX}(local-)?)?Dual-license"))
    is_dual = (F.size(ordered) == 3) & (F.size(dual) > 0)
    two = F.when(F.size(dual) == 1, rest).otherwise(F.filter(ordered, lambda x, i: i > 0))
    return F.when(is_dual, F.array_join(two, " OR ")).otherwise(F.array_join(ordered, " AND "))


def risk_band(risk: Column) -> Column:
    """Risk 2 and 3 is yellow, 4 and 5 red, anything else (null too) white."""
    return F.when(risk.isin(2, 3), "yellow").when(risk.isin(4, 5), "red").otherwise("white")


def overlaid(edited: Column, original: Column) -> Column:
    """The edited value unless it is null or blank."""
    return F.coalesce(F.nullif(F.trim(edited), F.lit("")), original)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long")


def head_hex(text: Column, size: int = 32) -> Column:
    """The first bytes of a text, in upper-case hex."""
    return F.hex(F.substring(F.encode(text, "UTF-8"), 1, size))


def java_regex(pattern: str) -> str:
    """A POSIX or Perl-style pattern, meant for any case, in Java's dialect: bracket classes, UTF-8 bytes, runs without NUL."""
    # POSIX classes and what Java calls them.
    classes = {"alpha": r"\p{Alpha}", "digit": r"\d", "alnum": r"\p{Alnum}", "upper": r"\p{Alpha}", "lower": r"\p{Alpha}", "space": r"\s", "punct": r"\p{Punct}", "print": r"\p{Print}"}
    for name, java in classes.items():
        pattern = pattern.replace(f"[:{name}:]", java)
    several = r"(?:\\x[C-F][0-9A-F])(?:\\x[89AB][0-9A-F])+"
    pattern = re.sub(several, lambda m: bytes.fromhex(m[0].replace("\\x", "")).decode(), pattern)
    return pattern.replace(r"[^\0]*", r"[\s\S]*")
