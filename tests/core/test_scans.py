"""Scanners and the phrase matcher on literal cases and against plain models."""

import random

import numpy as np
from pyspark.sql import functions as F

from ledgerline.functions import text as X
from ledgerline.operators import phrases as P
from ledgerline.operators import scanners as S
from ledgerline.operators import statements as C


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "id long, text string")


def test_tags(spark):
    df = texts(spark, "x\n SPDX-License-Identifier: GPL-2.0\n", "spdx-license-identifier: GPL-2.0 AND LGPL-2.1+ WITH Classpath-exception-2.0\n", None, "", "no tag")
    rows = S.license_tags(df, "id", F.col("text")).orderBy("id", "n_list", "n").collect()
    assert [r.name for r in rows if r.id == 0] == ["GPL-2.0"]
    assert [r.name for r in rows if r.id == 1] == ["GPL-2.0", "LGPL-2.1+", "Classpath-exception-2.0", "Dual-license", "Dual-license"]
    assert {r.id for r in rows} == {0, 1}
    kept = S.without_repeats(S.license_tags(df, "id", F.col("text")), "id").filter("id = 1").collect()
    assert sorted(r.name for r in kept).count("Dual-license") == 1


def test_tag_names_that_mean_the_same(spark):
    rows = texts(spark, "GPL-2.0+", "gpl-2.0", "MIT", "Mit-only").select(S.tag_key(F.col("text")).alias("k")).collect()
    assert [r.k for r in rows] == ["gpl-2.0+", "gpl-2.0", "mit", "mit"]


def test_contacts(spark):
    df = texts(spark, "see https://a.example.org/x?y=1 or mail <me@corp.de>; written by Jane Roe.", None, "", "export control applies; patented work licensed under terms")
    rows = [(r.id, r.type, r.content) for r in S.contact_findings(df, "id", F.col("text")).collect()]
    assert (0, "url", "https://a.example.org/x?y=1") in rows
    assert (0, "email", "me@corp.de") in rows
    assert any(t == "author" and c.startswith("written by Jane") for _, t, c in rows)
    assert any(i == 3 and t == "ecc" and c.startswith("export control") for i, t, c in rows)
    assert {(3, "keyword", "patented"), (3, "keyword", "licensed under")} <= set(rows)
    rows = [(r.type, r.content) for r in S.contact_findings(texts(spark, PARAGRAPH), "id", F.col("text")).collect()]
    assert [c for t, c in rows if t == "author"] == ["Written by: me, myself and Irene.", "Authors all the people at ABC", "Author1", "Author1 Author2 Author3", "Author4", "maintained by benjamin drieu <benj@debian.org>"]
    assert [c for t, c in rows if t == "url"] == ["http://mysite.org/FAQ"] and [c for t, c in rows if t == "email"] == ["info@mysite.org", "benj@debian.org"]
    assert [c for t, c in rows if t == "ecc"] == ["space vehicle designed by NASA"]
    assert [c for t, c in rows if t == "keyword"] == ["licensed as", "stolen from"]


PARAGRAPH = (
    "© 2007 Hugh Jackman\n\nCopyright 2004 my company\n\nCopyrights by any strange people\n\n(C) copyright 2007-2011, 2013 my favourite company Google\n\n"
    "(C) 2007-2011, 2013 my favourite company Google\n\nif (c) { return -1 } \n\nWritten by: me, myself and Irene.\n\nAuthors all the people at ABC\n\n"
    "<author>Author1</author><head>All the people</head><author>Author1 Author2 Author3</author><author>Author4</author><b>example</b>Apache\n\n"
    "This file is protected under pants 1 , 2 ,3\n\nDo not modify this document\n\nthe shuttle is a space vehicle designed by NASA\n\n"
    "visit http://mysite.org/FAQ or write to info@mysite.org\n\nmaintained by benjamin drieu <benj@debian.org>\n\n"
    "* Copyright (c) 1989, 1993\n* The Regents of the University of California. All rights reserved.\n\nto be licensed as a whole"
    "/* Most of the following tests are stolen from RCS 5.7's src/conf.sh.  */"
)


def found_in(spark, *values):
    rows = C.copyright_findings(texts(spark, *values), "id").orderBy("id", "start").collect()
    return [[(v[r.start : r.end], r.is_enabled) for r in rows if r.id == i] for i, v in enumerate(values)]


def test_statements(spark):
    (got,) = found_in(spark, PARAGRAPH)
    assert [t for t, on in got if on] == [
        "© 2007 Hugh Jackman", "Copyright 2004 my company", "Copyrights by any strange people", "(C) copyright 2007-2011, 2013 my favourite company Google",
        "(C) 2007-2011, 2013 my favourite company Google", "Copyright (c) 1989, 1993\n* The Regents of the University of California.",
    ]
    names = ["Copyright © .NET Foundation and contributors\n", "© .NET Foundation and contributors\n", "Copyright © 2021 .NET Foundation\n"]
    names += ["Copyrighted (C) 1994 Normunds Saumanis (normunds@rx.tech.swh.lv)\n", "copyrighted 1990 Mark Adler\n", "Copyright (C) Torres Martinez\n", "Copyright (C) Tom Long Nguyen (tom.l.nguyen@intel.com)\n"]
    assert found_in(spark, *names) == [[(x.strip("\n"), True)] for x in names]
    assert found_in(spark, "copyright\n", "COPYRIGHT\n", "Copyrights\n", "", "nothing", "The copyright holders are not liable.") == [[]] * 6
    assert not [x for found in found_in(spark, "© sjw¨noise\n", "© ZgU,µgarbage\n", "© KtCtdy\"sègarbage\n") for x in found if x[1]]


def test_tagged_statements(spark):
    lines = ["// SPDX-FileCopyrightText: 2026 Institut für Technik", "// SPDX-FileCopyrightText: 2026 Me"]
    assert found_in(spark, "\n".join(lines)) == [[(x[3:], True) for x in lines]]
    quoted = ['"2026 Institut für A",', '"2026 Company mbH",', '"2026 Other AG",']
    listed = "x\nSPDX-FileCopyrightText = [\n" + "\n".join(quoted) + "\n]\nCopyright 2021 Google LLC\n"
    assert found_in(spark, listed) == [[("SPDX-FileCopyrightText = [", False), *[(q, True) for q in quoted], ("Copyright 2021 Google LLC", True)]]
    (got,) = found_in(spark, 'SPDX-FileCopyrightText = [\n"2026 Company A",\nCopyright 2021 Google LLC\n')
    assert ("Copyright 2021 Google LLC", True) in got and got[0][1] is False


def test_copyright_findings(spark):
    df = texts(spark, "Copyright 2001 Jane Roe", None, "", "x" * 100_000, "Copyright 1999 B\n" + "more words\n" * 20_000, "no\n" * 2000 + "copyright 2000 Big Corp. All rights reserved.")
    rows = C.copyright_findings(df, "id").orderBy("id").collect()
    assert [(r.id, r.content[:23], r.is_enabled) for r in rows] == [(0, "Copyright 2001 Jane Roe", True), (4, "Copyright 1999 B more w", True), (5, "copyright 2000 Big Corp", True)]
    assert rows[1].end - rows[1].start == 300 and rows[2].start == 6000


def test_line_scan(spark):
    rows = S.line_scan(texts(spark, "a\nb lic\nlic lic", "none", None, ""), "id", F.col("text"), "lic").orderBy("id", "line").collect()
    assert [(r.id, r.line, r.pos) for r in rows] == [(0, 2, 3), (0, 3, 1), (1, None, None), (2, None, None), (3, None, None)]


def test_doctored(spark):
    df = texts(spark, "//Th- is is     a li-\n// cence of the test string", "<!-- <b>MIT</b> License --> &copy; Me", "dnl a (c) 2000, b. \\s+3big\\n x", 'printf "free"; footprint of GPL v2+ and LGPL+2', None, "")
    plain = [r.p for r in df.orderBy("id").select(S.doctored(F.col("text")).alias("p")).collect()]
    assert plain[0] == "This is a li cence of the test string"
    assert plain[2] == " a (c) 2000 b big x" and plain[3] == " free footprint of GPL v2+ and LGPL 2" and plain[4:] == [None, ""]
    assert df.filter("id = 1").select(S.doctored(F.col("text"), markup=True)).first()[0] == " b MIT /b License &copy Me"


def test_config_and_rules():
    assert S.parse_config("A=x\nB=__A____C__y\n# n=1\nA=z__A__") == {"A": "zx", "B": "xy"}
    assert S.described_scanner("Name@@2@@a(b)(c)") == ("Name", 2, "a(b)(c)") and S.described_scanner("abc") == ("match", 0, "abc")
    assert S.rule_pattern("a=FEW=b=YEAR=") == r"(?is)a.{0,30}b(?:19|20)\d\d"
    assert S.original_positions("a  b\n c") == [0, 1, 3, 4, 6]


def test_tokens_agree(spark):
    rng = random.Random(5)
    values = ["".join(rng.choice(["a", "B", "rem", " ", "\n", "/", "*", "::", "dnl", "'''", "#", "é", "Z", ","]) for _ in range(60)) for _ in range(60)] + ["", "REM rem", "//"]
    rows = texts(spark, *values).select("text", P.token_array(F.col("text")).alias("t")).collect()
    for r in rows:
        assert list(r.t) == [x[0] for x in P.tokens(r.text)], repr(r.text)
        assert all(r.text[a:b].lower() == t for t, a, b in P.tokens(r.text) if t.isascii())


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def test_matcher(spark):
    full = " ".join(WORDS)
    changed = " ".join(WORDS[:8] + ["new", "words"] + WORDS[10:])
    phrases = spark.createDataFrame([(1, "Long", full), (2, "Short", "rho sigma"), (3, "Void", full), (4, "Other", "one two three four five six")], "rf_pk long, shortname string, text string")
    files = spark.createDataFrame([(1, f"pre {full} post"), (2, f"x {changed} y"), (3, "nothing here"), (4, None), (5, ""), (6, f"{full}\n// {full}")], "pfile_fk long, text string")
    rows = P.matches(files, phrases).orderBy("pfile_fk", "start").collect()
    got = [(r.pfile_fk, r.rf_pk, r.full, r.pct) for r in rows]
    assert got == [(1, 1, True, 100), (2, 1, False, int(100 * 18 / 22)), (6, 1, True, 100), (6, 1, True, 100)]
    first = rows[0]
    assert f"pre {full} post"[first.start : first.end] == full
    found = P.as_findings(files, P.matches(files, phrases), 7).collect()
    assert {(r.pfile_fk, r.rf_fk) for r in found} == {(1, 1), (2, 1), (6, 1), (3, None), (4, None), (5, None)}


def naive(words, phrases):
    """All spots tried without an index, one a diagonal, and the matches that no other stands for; plain lists."""
    found = {}

    def put(k, start, end, rank, full):
        if (k, start, end) not in found or found[k, start, end] < (full, rank):
            found[k, start, end] = (full, rank)

    def spell(text, phrase, s):
        i, j, matched, added = 0, s, 0, 0
        while i < len(text) and j < len(phrase):
            if text[i] == phrase[j]:
                i, j, matched = i + 1, j + 1, matched + 1
                continue
            steps = [(a * a + b * b, a, b) for a in range(min(P.MOST_DIFF, len(text) - i)) for b in range(min(P.MOST_DIFF, len(phrase) - j)) if all(i + a + k >= len(text) or j + b + k >= len(phrase) or text[i + a + k] == phrase[j + b + k] for k in range(P.RUN))]
            if not steps:
                break
            _, a, b = min(steps)
            i, j, added = i + a, j + b, added + a
        return (matched, added, i) if len(phrase) - j < P.MOST_DIFF else None

    for k, p in phrases.items():
        if len(p) <= P.RUN:
            for t in range(len(words)):
                if words[t : t + len(p)] == p:
                    put(k, t, t + len(p), 100.0, True)
            continue
        diagonals = {}
        for t in range(len(words) - 2):
            for s in range(min(P.MOST_LEADING + 1, len(p) - 2)):
                if words[t : t + 3] == p[s : s + 3]:
                    diagonals[t - s] = min(s, diagonals.get(t - s, s))
        for d, s in diagonals.items():
            t = d + s
            if s == 0 and words[t : t + len(p)] == p:
                put(k, t, t + len(p), 100.0, True)
            elif got := spell(words[t : t + -(-len(p) * 100 // P.LEAST_RANK) + 2 * P.RUN], p, s):
                rank = 100.0 * got[0] / (len(p) + got[1])
                if int(rank) > P.LEAST_RANK:
                    put(k, t, t + got[2], rank, False)
    holds = lambda x, y: x[1] <= y[1] and x[2] >= y[2]
    inside = lambda x, y: any(phrases[x][i : i + len(phrases[y])] == phrases[y] for i in range(len(phrases[x])))

    def stands_for(x, y):
        first = (x[1], -x[2], x[0]) < (y[1], -y[2], y[0])
        over, under = found[x][0] and holds(x, y), found[y][0] and holds(y, x)
        if over or under:
            return first if over and under else over
        if x[0] != y[0]:
            more, less = inside(x[0], y[0]), inside(y[0], x[0])
            if more or less:
                return first if more and less else more
            if found[x][0] or found[y][0]:
                return False
        return found[x][1] > found[y][1] or found[x][1] == found[y][1] and first

    return [(*y, 100 if found[y][0] else min(99, max(1, int(found[y][1])))) for y in found if not any(x != y and (holds(x, y) or holds(y, x)) and stands_for(x, y) for x in found)]


def test_matcher_against_all_spots(spark):
    rng = random.Random(3)
    base = [rng.choice(WORDS) for _ in range(40)]
    phrases = {1: base[:14], 2: base[10:30], 3: base[5:7], 4: [rng.choice(WORDS) for _ in range(12)], 5: base[12:20]}
    files = []
    for i in range(12):
        w = [rng.choice(WORDS) for _ in range(10)] + base + phrases[4]
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = "changed"
        for _ in range(rng.randrange(3)):
            w.insert(rng.randrange(len(w)), "more")
        files.append((i, " ".join(w)))
    df = spark.createDataFrame(files, "pfile_fk long, text string")
    catalogue = spark.createDataFrame([(k, f"n{k}", " ".join(v)) for k, v in phrases.items()], "rf_pk long, shortname string, text string")
    rows = P.matches(df, catalogue).collect()
    for i, text in files:
        spans = P.tokens(text)
        wanted = sorted((k, spans[a][1], spans[b - 1][2], pct) for k, a, b, pct in naive([x[0] for x in spans], phrases))
        assert sorted((r.rf_pk, r.start, r.end, r.pct) for r in rows if r.pfile_fk == i) == wanted
    assert {r.pct for r in rows} > {100}


def test_which_match_stands_for_which(spark):
    """The sign table of the overlap filter. Phrases: 1 a, 2 b c, 3 a b; so 3 includes 1."""
    cases = {
        "full before differing, one license": ([(1, True, 100.0, 1, 2), (1, False, 100.0, 1, 3)], {(1, 1, 3)}),
        "full before what it holds": ([(1, True, 100.0, 1, 3), (1, False, 100.0, 1, 2)], {(1, 1, 3)}),
        "two full ones of one span": ([(2, True, 100.0, 1, 2), (3, True, 100.0, 1, 2)], {(2, 1, 2)}),
        "the license that includes the other": ([(1, True, 100.0, 1, 2), (3, False, 100.0, 1, 3)], {(3, 1, 3)}),
        "by rank, one license": ([(1, False, 100.0, 1, 2), (1, False, 90.0, 1, 8)], {(1, 1, 2)}),
        "apart": ([(1, True, 100.0, 1, 2), (3, False, 100.0, 4, 8)], {(1, 1, 2), (3, 4, 8)}),
        "a full one of another license inside": ([(1, True, 100.0, 3, 4), (2, False, 80.0, 1, 8)], {(1, 3, 4), (2, 1, 8)}),
    }
    rows = [(i, *m) for i, (found, _) in enumerate(cases.values()) for m in found]
    found = spark.createDataFrame(rows, "pfile_fk long, rf_pk long, full boolean, rank double, start int, end int")
    got = P.surviving(found, spark.createDataFrame([(3, 1), (1, 1), (2, 2), (3, 3)], "big long, small long")).collect()
    for i, (name, (_, kept)) in enumerate(cases.items()):
        assert {(r.rf_pk, r.start, r.end) for r in got if r.pfile_fk == i} == kept, name


def test_nearest_agreement():
    a, b = np.arange(300), np.concatenate([[900, 901], np.arange(300)])
    assert P.nearest_agreement(a, b) == (0, 2) and P.nearest_agreement(b, a) == (2, 0)
    assert P.nearest_agreement(a, a + 1000) is None
    assert P.nearest_agreement(np.array([1, 2]), np.array([9, 2])) == (1, 1)
    matched, added, segments = P.aligned(np.array([1, 2, 3, 7, 8, 4, 5, 6]), np.array([0, 1, 2, 3, 4, 5, 6]), 1)
    assert (matched, added) == (6, 2)
    assert segments == [("removal", 0, 0, 0, 1), ("match", 0, 3, 1, 3), ("addition", 3, 2, 4, 0), ("match", 5, 3, 4, 3)]


def test_ignored_phrases(spark):
    rows = [(1, "Void", "a b c d"), (2, "X", "License by Scanner."), (3, "Y", None), (4, "Z", ""), (5, "W", "License by Scanner and more.")]
    assert [r.rf_pk for r in P.searched(spark.createDataFrame(rows, "rf_pk long, shortname string, text string")).collect()] == [5]


def test_phrase_hits(spark):
    files = spark.createDataFrame([(1, "All rights reserved."), (2, "rights"), (3, None)], "pfile_fk long, text string")
    phrases = spark.createDataFrame([(1, "ALL RIGHTS reserved."), (2, "rights"), (3, ""), (4, "all rights reserved. really")], "phrase_pk int, text string")
    assert sorted((r.pfile_fk, r.phrase_pk) for r in P.phrase_hits(files, phrases).collect()) == [(1, 1), (1, 2), (2, 2)]


def test_names(spark):
    rows = texts(spark, "file10.c", "File2.c", "file2.c").orderBy(X.natural_key(F.col("text")), "id").collect()
    assert [r.id for r in rows] == [1, 2, 0]
    one = texts(spark, "GPL-2.0+").select(X.spdx_id(F.col("text"), F.lit(None)).alias("a"), X.spdx_id(F.lit("Void"), F.lit("")).alias("b"), X.spdx_id(F.lit("LicenseRef-a b"), F.lit(None)).alias("c"), X.license_expression(F.array(F.lit("MIT"), F.lit("Dual-license"), F.lit("GPL"))).alias("d"), X.fuzzy_name(F.lit("lib-1.2_x.tar"), False).alias("e")).first()
    assert list(one) == ["LicenseRef-local-GPL-2.0-or-later", "Void", "LicenseRef-a-b", "GPL OR MIT", "libx"]
