"""MIME types by content: a table of rules about bytes at offsets, nested, compiled to one column."""

from __future__ import annotations

import csv
import os
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes in which ``near`` looks.
NEAR = 1024
OWN_RULES = os.path.join(os.path.dirname(os.path.abspath(__file__)), "magic_rules.csv")
TESTS = ("hex", "text", "near", "line", "holds")


@dataclass
class Magic:
    """at: the offset. test and value: ``hex`` digits at the offset, ``?`` for any; ``text`` at the offset; ``near``
    text within NEAR bytes from it, ``line`` in the first line, ``holds`` anywhere, a dot for any byte in these.
    below: rules that tell more, tried in order where this one holds."""

    at: int
    test: str
    value: str
    mime: str
    below: list[Magic] = field(default_factory=list)


def parse_magic(text: str) -> list[Magic]:
    """Rules of a table level;at;test;value;mime: a row of level n belongs to the row of level n - 1 before it."""
    top: list[Magic] = []
    at_level: list[list[Magic]] = [top]
    for r in csv.DictReader(text.splitlines(), delimiter=";", quoting=csv.QUOTE_NONE):
        level = int(r["level"])
        if level >= len(at_level) or r["test"] not in TESTS or not r["value"]:
            raise ValueError(f"not a rule: {r}")
        rule = Magic(int(r["at"]), r["test"], r["value"], r["mime"])
        at_level[level].append(rule)
        at_level[level + 1 :] = [rule.below]
    return top


def own_magic() -> list[Magic]:
    with open(OWN_RULES, encoding="utf-8") as f:
        return parse_magic(f.read())


def _bytes(value: str, wild: str = "") -> str:
    """A pattern of hex digits for text, of which some characters may stand for any byte."""
    return "".join("[0-9A-F]{2}" if c in wild else c.encode().hex().upper() for c in value)


def holds(content: Column, rule: Magic) -> Column:
    """Whether a rule's test holds of a binary column; a few bytes are looked at, but for ``holds``."""
    if rule.test in ("hex", "text"):
        value = rule.value.upper() if rule.test == "hex" else _bytes(rule.value)
        head = F.hex(F.substring(content, rule.at + 1, len(value) // 2))
        return head.rlike(f"^{value.replace('?', '[0-9A-F]')}$") if "?" in value else head == value
    if rule.test == "holds":  # asked of the bytes' Latin-1 letters, of which each is one
        return F.decode(content, "ISO-8859-1").rlike("(?s)" + ".".join(map(_quoted, rule.value.split("."))))
    part = F.hex(F.substring(content, rule.at + 1, NEAR))
    if rule.test == "line":
        return part.rlike(f"^(?:(?!0A)[0-9A-F]{{2}})*?{_bytes(rule.value, '.')}")
    return part.rlike(f"^(?:[0-9A-F]{{2}})*?{_bytes(rule.value, '.')}")


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() else f"\\{c}" for c in text)


def by_content(content: Column, rules: list[Magic] | None = None) -> Column:
    """The type that the first rule to hold gives, by the most telling rule below it; null if none holds."""
    found: Column | None = None
    for rule in own_magic() if rules is None else rules:
        here = F.coalesce(by_content(content, rule.below), F.lit(rule.mime)) if rule.below else F.lit(rule.mime)
        found = F.when(holds(content, rule), here) if found is None else found.when(holds(content, rule), here)
    return F.lit(None).cast("string") if found is None else found
