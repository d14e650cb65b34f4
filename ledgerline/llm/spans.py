"""Base patterns for personal data and secrets, with code point offsets."""

from __future__ import annotations

import math
import re
from collections import Counter

#: Kinds of personal data and of secrets, in their listed order.
PRIVATE_KINDS = ("email", "ip", "card", "phone")
SECRET_KINDS = ("assign", "access", "hex")

#: A found span: kind (place in the list), start, end, and what identifies it.
Span = tuple[int, int, int, str]

_DIGIT = re.compile(r"[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ASSIGN = re.compile(
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Leftmost matches, found from their @: the local part is all that may stand before it."""
    found, free = [], 0
    for m in _DOMAIN.finditer(text):
        at = start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            found.append((0, start, m.end(), text[start : m.end()].lower()))
            free = m.end()
    return found


def private_spans(text: str) -> list[Span]:
    """Base personal data, by kind and then start."""
    found = _emails(text) if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                found.append((1, m.start(), m.end(), m[0]))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(digits := re.sub("[ -]", "", m[0])) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end(), digits))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= len(digits := re.sub("[^0-9]", "", m[0])) <= 15:
                    found.append((3, m.start(), m.end(), digits))
    return found


def secret_spans(text: str) -> list[Span]:
    """Base secrets, by start and then kind; what identifies them is the value."""
    found = []
    if ":" in text or "=" in text:
        found += [(0, m.start(), m.end(), m[1]) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(2, m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], x[0]))


def entropy(text: str) -> float:
    """Bits a character."""
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def joined(spans: list[Span], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for k, a, b, _ in spans)


def free_spots(bounds: list[tuple[int, int]], taken: list[Span]) -> list[tuple[int, int]]:
    """The bounds (ascending, disjoint) that overlap no taken span."""
    taken = sorted((a, b) for _, a, b, _ in taken)
    out, i, reach = [], 0, 0
    for a, b in bounds:
        while i < len(taken) and taken[i][0] < b:
            reach = max(reach, taken[i][1])
            i += 1
        if reach <= a:
            out.append((a, b))
    return out
