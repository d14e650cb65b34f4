"""Scanners as table functions of SQL: SELECT ... FROM files, LATERAL scan_pattern(text, ...) (the interface of section 2.11).

A scanner is registered once in a session. Its output columns are found when a query is analysed; texts come a
row at a time, for which Arrow has a table each to make. The rows are those of the DataFrame forms.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .automaton import _LETTERS, SYMBOLS, Automaton, _symbols


def _constant(argument: AnalyzeArgument, name: str) -> str:
    if not argument.isConstantExpression or argument.value is None:
        raise ValueError(f"{name} must be a constant")
    return str(argument.value)


def _columns(*strings: str, more: tuple[str, ...] = ()) -> StructType:
    kinds = [*[(n, StringType()) for n in strings], *[(n, IntegerType()) for n in ("start", "end")], *[(n, StringType()) for n in more]]
    return StructType([StructField(n, kind) for n, kind in kinds])


class PatternScanner:
    """type, content, start, end (characters, end exclusive) of every match of a pattern.

    Arguments: text, pattern in Python's dialect, and, if wanted, type and group. With a pattern that has named groups
    these are columns, too.
    """

    @staticmethod
    def analyze(text: AnalyzeArgument, pattern: AnalyzeArgument, kind: AnalyzeArgument | None = None, group: AnalyzeArgument | None = None) -> AnalyzeResult:
        names = re.compile(_constant(pattern, "the pattern")).groupindex
        if wrong := [n for n in names if n in ("type", "content", "start", "end")]:
            raise ValueError(f"groups may not be named {wrong}")
        return AnalyzeResult(_columns("type", "content", more=tuple(names)))

    def eval(self, text: str | None, pattern: str, kind: str = "match", group: int = 0) -> Iterator[tuple]:
        compiled = re.compile(pattern)
        for m in compiled.finditer(text or ""):
            if m[group]:
                yield (kind, m[group], m.start(group), m.end(group), *[m[n] for n in compiled.groupindex])


class PhraseScanner:
    """phrase, start, end (characters of the text, end exclusive) where cleaned phrases stand in a text (see automaton).

    Arguments: text, and the phrases as one constant, separated by ``|``.
    """

    #: The cleaned form of each byte of a text.
    LETTERS = bytes(SYMBOLS.encode()[i] for i in _LETTERS)

    def __init__(self) -> None:
        self.known: tuple[str, Automaton, list[str], list[bytes]] | None = None

    @staticmethod
    def analyze(text: AnalyzeArgument, phrases: AnalyzeArgument) -> AnalyzeResult:
        for p in _constant(phrases, "the phrases").split("|"):
            if not p.strip() or set(p) - set(SYMBOLS[1:]):
                raise ValueError(f"not a cleaned phrase: {p!r}")
        return AnalyzeResult(_columns("phrase"))

    def eval(self, text: str | None, phrases: str) -> Iterator[tuple]:
        if self.known is None or self.known[0] != phrases:
            names = sorted(set(phrases.split("|")))
            self.known = phrases, Automaton(names), names, [f" {n} ".encode() for n in names]
        _, automaton, names, sought = self.known
        content = (text or "").encode()
        clean = b" " + b" ".join(content.translate(self.LETTERS).split()) + b" "
        if not any(s in clean for s in sought):  # most texts: where phrases stand is found for the others only
            return
        body = np.frombuffer(content, np.uint8)
        symbols, origin, _ = _symbols(body, np.array([0, len(body)], np.int64))
        found, after = automaton.found(symbols, max(16, math.isqrt(len(symbols)) // 4))  # one text is short: many short lanes
        for p, end in sorted(zip(found.tolist(), after.tolist(), strict=True), key=lambda x: (x[1] - len(names[x[0]]), x[0])):
            yield names[p], int(origin[end - len(names[p])]), int(origin[end - 1]) + 1


def register_scanners(spark: SparkSession) -> None:
    """Makes scan_pattern and scan_phrases known to a session's SQL."""
    spark.udtf.register("scan_pattern", udtf(PatternScanner, useArrow=False))
    spark.udtf.register("scan_phrases", udtf(PhraseScanner, useArrow=False))
