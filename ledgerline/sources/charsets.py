"""The charset of a content without a mark of its own: each charset's reading is scored by what letters stand beside what.

A reading in the wrong charset puts letters of several scripts, capitals after small letters, signs inside words, and
rare or impossible characters side by side. Kinds of characters and penalties of their pairs are parameters of one
table; a content is read in each charset, and the reading of the least penalty for each of its bytes wins.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Charsets that are tried, the likelier of equal scores first.
CHARSETS = ("cp1252", "cp1251", "koi8_r", "cp1253", "mac_roman", "cp437", "shift_jis", "euc_jp", "gb18030", "big5", "euc_kr")
#: Kinds of characters.
BAD, SPACE, DIGIT, SIGN, OTHER_SIGN, LOWER, UPPER, EXTRA_LOWER, EXTRA_UPPER, GREEK, GREEK_UPPER, CYRILLIC, CYRILLIC_UPPER, KANA, HAN, RARE_HAN, HANGUL, OTHER, DRAWN, EXTRA_RARE, NICE_SIGN, RARE_CYRILLIC = range(22)
_SCRIPTS = {LOWER: "latin", UPPER: "latin", EXTRA_LOWER: "latin", EXTRA_UPPER: "latin", EXTRA_RARE: "latin", GREEK: "greek", GREEK_UPPER: "greek", CYRILLIC: "cyrillic", CYRILLIC_UPPER: "cyrillic", RARE_CYRILLIC: "cyrillic", KANA: "east", HAN: "east", RARE_HAN: "east", HANGUL: "hangul", OTHER: "other"}
_CAPITALS = {UPPER, EXTRA_UPPER, GREEK_UPPER, CYRILLIC_UPPER}
#: Letters that a charset has beside those of its own languages: a reading that is made of them is an unlikely one.
_BESIDE = {"shift_jis": (GREEK, GREEK_UPPER, CYRILLIC, CYRILLIC_UPPER, RARE_CYRILLIC), "euc_jp": (GREEK, GREEK_UPPER, CYRILLIC, CYRILLIC_UPPER, RARE_CYRILLIC)} | {c: (GREEK, GREEK_UPPER, CYRILLIC, CYRILLIC_UPPER, RARE_CYRILLIC, KANA) for c in ("gb18030", "big5", "euc_kr")}
#: What a character of a kind costs wherever it stands.
_ALONE = {BAD: 20.0, OTHER_SIGN: 1.5, EXTRA_LOWER: 0.3, EXTRA_UPPER: 0.6, CYRILLIC: 0.1, CYRILLIC_UPPER: 0.2, RARE_CYRILLIC: 0.4, GREEK: 0.1, GREEK_UPPER: 0.2, HAN: 0.3, RARE_HAN: 4.0, HANGUL: 0.2, OTHER: 3.0, DRAWN: 6.0, EXTRA_RARE: 1.0, NICE_SIGN: 0.1}
#: Latin letters with marks that are common in some language.
_COMMON_LETTERS = set("àáâãäåæçèéêëíñóôõöøúüß")
#: Cyrillic letters of all languages that are written in them; others are those of few.
_COMMON_CYRILLIC = set("абвгдежзийклмнопрстуфхцчшщъыьэюяёі")
#: Characters that are common though they are no letters of ASCII.
_COMMON_SIGNS = set("‘’“”–—…©«» 、。「」・，！？¿¡°§")


def _kind(c: str) -> int:
    code, category = ord(c), unicodedata.category(c)
    if c in "\t\n\r\f" or category == "Zs" and code < 128:
        return SPACE
    if category in ("Cc", "Cn", "Co", "Cs") or code == 0xFFFD:
        return BAD
    if code < 128:
        return LOWER if c.islower() else UPPER if c.isupper() else DIGIT if c.isdigit() else SIGN
    if c in _COMMON_SIGNS:
        return NICE_SIGN
    if 0x2500 <= code < 0x25A0 or 0xFF61 <= code < 0xFFA0:
        return DRAWN
    if category[0] != "L":
        return OTHER_SIGN
    name = unicodedata.name(c, "")
    capital = c.isupper()
    for word, small, large in (("LATIN", EXTRA_LOWER, EXTRA_UPPER), ("GREEK", GREEK, GREEK_UPPER), ("CYRILLIC", CYRILLIC, CYRILLIC_UPPER), ("HIRAGANA", KANA, KANA), ("KATAKANA", KANA, KANA), ("HANGUL", HANGUL, HANGUL), ("CJK", HAN, HAN)):
        if name.startswith(word):
            if word == "CYRILLIC" and c.lower() not in _COMMON_CYRILLIC:
                return RARE_CYRILLIC
            return large if capital else small if small != EXTRA_LOWER or c in _COMMON_LETTERS else EXTRA_RARE
    return OTHER


def _common_han(charset: str) -> np.ndarray:
    """Which code points are characters of a charset's first level, where it has one."""
    levels = {"shift_jis": ("euc_jp", 0xB0, 0xCF), "euc_jp": ("euc_jp", 0xB0, 0xCF), "gb18030": ("gb2312", 0xB0, 0xD7), "big5": ("big5", 0xA4, 0xC6), "euc_kr": ("euc_kr", 0xCA, 0xFD)}
    common = np.ones(0x10000, bool)
    if charset in levels:
        by, first, last = levels[charset]
        common[:] = False
        for lead in range(first, last + 1):
            for trail in range(0x40, 0xFF):
                for c in bytes([lead, trail]).decode(by, "ignore"):
                    if ord(c) < 0x10000:
                        common[ord(c)] = True
    return common


@cache
def _kinds() -> np.ndarray:
    return np.array([_kind(chr(i)) for i in range(0x10000)], np.uint8)


@cache
def kinds(charset: str) -> np.ndarray:
    """The kind of each code point below 65536 as a charset has it."""
    out = _kinds().copy()
    out[(out == HAN) & ~_common_han(charset)] = RARE_HAN
    out[np.isin(out, _BESIDE.get(charset, ()))] = OTHER
    return out


@cache
def penalties() -> np.ndarray:
    """What each pair of neighbouring kinds costs, in whole tenths, so that equal sums are equal whatever their order."""
    table = np.zeros((22, 22))
    for a in range(22):
        for b in range(22):
            cost = _ALONE.get(b, 0.0)
            if a in _SCRIPTS and b in _SCRIPTS:
                if _SCRIPTS[a] != _SCRIPTS[b]:
                    cost += 6.0
                elif b in _CAPITALS:
                    cost += 0.3 if a in _CAPITALS else 5.0
                elif {a, b} <= {EXTRA_LOWER, EXTRA_UPPER, EXTRA_RARE}:
                    cost += 0.5
            elif NICE_SIGN in (a, b):  # dashes and quotes stand beside words, seldom inside them
                cost += 1.0 if a == b else 0.5 if _SCRIPTS.get(a, _SCRIPTS.get(b)) in ("latin", "greek", "cyrillic") else 0.0
            elif OTHER_SIGN in (a, b) and (a in _SCRIPTS or b in _SCRIPTS):
                cost += 3.0
            table[a, b] = cost
    return np.rint(10 * table).astype(np.int64)


def score(content: bytes, charset: str) -> float:
    """The penalty of a content's reading in a charset for each of its bytes."""
    text = content.decode(charset, "replace")
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    read = np.where(codes < 0x10000, kinds(charset)[np.minimum(codes, 0xFFFF)], OTHER)
    read = np.concatenate([[SPACE], read, [SPACE]])
    return float(penalties()[read[:-1], read[1:]].sum()) / max(1, len(content))


def guessed(content: bytes) -> str:
    """The charset of a content: UTF-8 where it is valid, else that of the best reading."""
    try:
        content.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        return min(CHARSETS, key=lambda c: score(content, c))


def _guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bodies = batch.column(batch.num_columns - 1)
        names = [guessed(x.as_py()) if x.is_valid else None for x in bodies]
        texts = [x.as_py().decode(n, "replace") if n else None for x, n in zip(bodies, names, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(texts, pa.string())], [*batch.schema.names[:-1], "charset", "text"])


def with_charset(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """key, charset and text of files without a byte-order mark: each content is read whole, in every charset.

    Null contents have neither. What a charset has no character for becomes U+FFFD.
    """
    rows = files.select(key, F.col(content).cast("binary").alias("_content"))
    return rows.mapInArrow(_guess, f"`{key}` {rows.schema[key].dataType.simpleString()}, charset string, text string")
