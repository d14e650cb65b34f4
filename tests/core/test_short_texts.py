"""Phrases called from SQL: a text at a time costs what its length asks for."""

import random
import re

from ledgerline.operators import scanner_functions as S


def test_short_texts_take_few_steps(monkeypatch):
    lanes, found = [], S.Automaton.found
    monkeypatch.setattr(S.Automaton, "found", lambda self, symbols, lane=512: lanes.append(lane) or found(self, symbols, lane))
    scanner, rng = S.PhraseScanner(), random.Random(2)
    assert list(scanner.eval("É nothing to be seen here, mit licenses " * 50, "mit license|a a")) == [] and lanes == []
    for _ in range(200):
        words = [rng.choice(["MIT", "License", "a", "A", "é", "mit-license", "1999", "+", "c++"]) for _ in range(rng.randrange(60))]
        text = "".join(w + rng.choice([" ", ", ", "\n * ", " é"]) for w in words)
        want = []
        for p in ("mit license", "a a", "c++"):
            edge, within = "[^A-Za-z0-9+]", "[^A-Za-z0-9+]+"
            want += [(p, m.start(1), m.end(1)) for m in re.finditer(f"(?i)(?<![a-z0-9+])(?=({within.join(map(re.escape, p.split()))})(?:{edge}|$))", text, re.ASCII)]
        assert sorted(scanner.eval(text, "mit license|a a|c++")) == sorted(want)
    assert lanes and max(lanes) < 64
