"""Content fingerprints and the bits of a file mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bits of a mode.
ARTIFACT, CONTAINER = 1 << 28, 1 << 29
SCANNER_MASK = 0x3C000000


def is_artifact(mode: Column) -> Column:
    return mode.bitwiseAND(F.lit(ARTIFACT)) != 0


def is_container(mode: Column) -> Column:
    return mode.bitwiseAND(F.lit(CONTAINER)) != 0


def is_plain(mode: Column) -> Column:
    """Neither container nor artifact, as queries count files."""
    return mode.bitwiseAND(F.lit(ARTIFACT | CONTAINER)) == 0


def is_scannable(mode: Column) -> Column:
    """None of the four upper bits, as scanners pick files; stricter than is_plain."""
    return mode.bitwiseAND(F.lit(SCANNER_MASK)) == 0


def fingerprint(content: Column) -> list[Column]:
    """sha1, md5 and sha256 in upper-case hex, size in bytes and the three-part identifier of a content."""
    sha1, md5, size = F.upper(F.sha1(content)), F.upper(F.md5(content)), F.octet_length(content).cast("long")
    return [sha1.alias("sha1"), md5.alias("md5"), F.upper(F.sha2(content, 256)).alias("sha256"), size.alias("size"), F.concat_ws(".", sha1, md5, size.cast("string")).alias("fuid")]
