"""Finding license texts in files: equi-joins on runs of tokens, one alignment a diagonal, survivors by dominance.

Texts and phrases are split into tokens. Every run of three tokens of a text is looked up among the runs at the
first eleven positions of all phrases (a join on hashes). Hits of a phrase on one diagonal (text position less
phrase position) are one start. Equal spans are found in the JVM; the other starts are aligned by numpy over
hashed tokens, each in a window as long as a match of sufficient rank can be. Which matches stay is decided for pairs
of which one's span holds the other's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.storage import broadcast_if_few, settled

from .tree import held_pairs

# Bounds of the matcher.
MOST_DIFF, RUN, MOST_LEADING, LEAST_RANK, MOST_TOKENS = 256, 3, 10, 66, 4_194_304
# Single delimiters, longer ones, and a token that is dropped.
DELIMITERS = " \t\n\r\f#^%,*"
LONG_DELIMITERS = ["//", "/*", "*/", "::", '"""', "'''", "dnl"]
IGNORED_TOKEN = "rem"
# Phrases of these names are never searched.
IGNORED_NAMES = ["Void", "No_license_found"]
#: Neither are the texts that only say which scanner made the license up.
IGNORED_TEXT = r"^License by \w+\.$"


def delimiter_pattern(delimiters: str = DELIMITERS) -> str:
    """A pattern of one delimiter, longer ones first."""
    return "|".join([re.escape(x) for x in LONG_DELIMITERS] + [f"[{re.escape(delimiters)}\0]"])


def token_array(text: Column, delimiters: str = DELIMITERS) -> Column:
    """The tokens of a text as an array: lower-case, without delimiters and dropped tokens (S1); JVM only."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = F.split(low, "(?:" + delimiter_pattern(delimiters).replace("\0", "\\x00").replace("dnl", "(?:[dD][nN][lL]|dnl)") + ")+")
    return F.slice(F.filter(parts, lambda x: (x != "") & (x != IGNORED_TOKEN)), 1, MOST_TOKENS)


def tokens(text: str, delimiters: str = DELIMITERS) -> list[tuple[str, int, int]]:
    """The tokens of a text with start and end, as token_array gives them."""
    found, at = [], 0
    for m in re.finditer(delimiter_pattern(delimiters), text):
        if m.start() > at:
            found.append((text[at : m.start()], at, m.start()))
        at = m.end()
    if at < len(text):
        found.append((text[at:], at, len(text)))
    low = [(t.translate(_LOWER), a, b) for t, a, b in found]
    return [x for x in low if x[0] != IGNORED_TOKEN][:MOST_TOKENS]


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def runs(tokens_col: str, first: int | None = None, length: int = RUN) -> Column:
    """Hashes of all runs of ``length`` tokens, or of those that start at the first positions, by position."""
    last = F.size(tokens_col) - length + 1
    ends = last if first is None else F.least(last, F.lit(first))
    at = lambda i: F.xxhash64(*[F.element_at(F.col(tokens_col), i + k) for k in range(length)])
    return F.when(ends > 0, F.transform(F.sequence(F.lit(1), ends), at))


#: Up to so many runs that are sought are compared with where texts are read, before anything is exploded or joined.
MOST_SOUGHT = 2000


def sought(index: DataFrame) -> tuple[tuple[int, ...], list[int] | None]:
    """The lengths of the runs (n, run) of an index, 1, 2 and 3 at most, and the runs themselves unless they are too many."""
    few = index.select("n", "run").distinct().limit(MOST_SOUGHT + 1).collect()
    if len(few) <= MOST_SOUGHT:
        return tuple(sorted({r.n for r in few})), sorted({r.run for r in few})
    return tuple(sorted(r.n for r in index.select("n").distinct().collect())), None


def _heads(df: DataFrame, key: str, column: str, lengths: tuple[int, ...] = (1, 2, 3), wanted: list[int] | None = None) -> DataFrame:
    """key, n, t, run: the runs of so many tokens of a text, in one scan, or those that are wanted. Only hashes are exploded, not the tokens."""
    placed = lambda n: F.transform(runs(column, length=n), lambda x, i: F.struct(F.lit(n).alias("n"), i.alias("t"), x.alias("run")))
    each = [placed(n) if wanted is None else F.filter(placed(n), lambda h: h["run"].isin(wanted)) for n in lengths]
    none = F.array().cast("array<struct<n:int,t:int,run:bigint>>")
    return df.select(key, F.explode(F.concat(*[F.coalesce(x, none) for x in each])).alias("h")).select(key, "h.n", "h.t", "h.run")


def germs(phrases: DataFrame) -> DataFrame:
    """rf_pk, n, run, s: what phrases(rf_pk, tokens) are looked up by: the runs at their first positions, short ones whole."""
    size = F.size("tokens")
    first = F.transform(runs("tokens", MOST_LEADING + 1), lambda x, i: F.struct(F.lit(RUN).alias("n"), x.alias("run"), i.alias("s")))
    whole = [F.when(size == n, F.array(F.struct(F.lit(n).alias("n"), F.element_at(runs("tokens", 1, n), 1).alias("run"), F.lit(0).alias("s")))) for n in range(1, RUN + 1)]
    return phrases.filter(size > 0).select("rf_pk", F.explode(F.when(size > RUN, first).otherwise(F.coalesce(*whole))).alias("x")).select("rf_pk", "x.n", "x.run", "x.s")


def candidates(files: DataFrame, phrases: DataFrame) -> DataFrame:
    """pfile_fk, rf_pk, t, s: a run of the text at t equals one of the phrase at s (S3, S4); phrases of up to three tokens at s = 0.

    files: pfile_fk, tokens; phrases: rf_pk, tokens. Texts are read once, and only runs of lengths that a phrase is
    looked up by are made; where phrases are few, others than theirs are dropped on the spot. Phrases outnumber files by
    far nowhere, so Spark chooses the side to broadcast by size.
    """
    index = germs(phrases)
    lengths, wanted = sought(index)
    if not lengths:
        return files.select("pfile_fk", F.lit(None).cast("long").alias("rf_pk"), F.lit(0).alias("t"), F.lit(0).alias("s")).limit(0)
    return _heads(files, "pfile_fk", "tokens", lengths, wanted).join(index, ["n", "run"]).select("pfile_fk", "rf_pk", "t", "s")


@cache
def visit_times(size: int = MOST_DIFF, per_quarter: int = 2 * MOST_DIFF) -> np.ndarray:
    """When an offset (text, phrase) below ``size`` is tried: quarter circles around the start, half a token apart.

    A circle is walked in equal angles from the phrase's axis to the text's, and an offset counts when it is
    passed last; 0: never. On each circle there are as many places whatever its length, so far offsets are left out.
    """
    angle = np.concatenate([[0.0], np.cumsum(np.full(per_quarter + 1, np.pi / 4 / (per_quarter // 2)))])
    angle = angle[angle < np.pi / 2]
    times = np.zeros((size, size), np.int64)
    for circle in range(2 * size):
        text, phrase = (np.floor(circle / 2 * f(angle)).astype(np.int64) for f in (np.sin, np.cos))
        np.maximum.at(times, (text, phrase), circle * len(angle) + np.arange(1, len(angle) + 1))
    times[0, 0] = 0
    return times


@cache
def _first_outside(size: int, side: int) -> int:
    """The earliest time of an offset outside a square."""
    times = visit_times(size).copy()
    times[:side, :side] = 0
    return int(times[times > 0].min(initial=np.iinfo(np.int64).max))


#: Squares in which an agreement is sought, one after another.
_SHELLS = (16, 64)


def nearest_agreement(text: np.ndarray, phrase: np.ndarray, most: int = MOST_DIFF, run: int = RUN) -> tuple[int, int] | None:
    """The offsets (text, phrase) below ``most`` that are tried first among those from which ``run`` tokens agree.

    Past the end of either nothing is asked. None if there is none. A square that holds an offset of an earlier time than
    all outside it need not be widened.
    """
    times = visit_times(most)
    for side in [*[x for x in _SHELLS if x < most], most]:
        same = text[: side + run - 1, None] == phrase[None, : side + run - 1]
        alike = same[:side, :side].copy()
        for k in range(1, run):
            after = np.ones_like(same)
            after[:-k, :-k] = same[k:, k:]
            # What was cut off by the square, not by an end, is there in the rows and columns beyond it.
            alike &= after[:side, :side]
        own = np.where(alike, times[: alike.shape[0], : alike.shape[1]], 0)
        tried = own[own > 0]
        wide = side >= most or (side >= len(text) and side >= len(phrase))
        if len(tried) and (wide or tried.min() < _first_outside(most, side)):
            down, right = np.nonzero(own == tried.min())
            return int(down[0]), int(right[0])
        if wide:
            break
    return None


def aligned(text: np.ndarray, phrase: np.ndarray, s: int = 0) -> tuple[int, int, list[tuple]] | None:
    """How text, from its first token on, spells phrase from token s on (S6): matched, added and segments.

    Stretches that agree alternate with edits that lead to the nearest agreement. Segments are (kind, text start,
    text length, phrase start, phrase length); what the phrase has more at either end is removed, up to MOST_DIFF
    tokens at its end. None where more than that is left over.
    """
    out = [("removal", 0, 0, 0, s)] if s else []
    i, j, matched, added = 0, s, 0, 0
    while i < len(text) and j < len(phrase):
        n = min(len(text) - i, len(phrase) - j)
        unlike = np.flatnonzero(text[i : i + n] != phrase[j : j + n])
        n = int(unlike[0]) if len(unlike) else n
        if n:
            out.append(("match", i, n, j, n))
        i, j, matched = i + n, j + n, matched + n
        if i == len(text) or j == len(phrase):
            break
        step = nearest_agreement(text[i:], phrase[j:])
        if step is None:
            break
        out.append(({(True, False): "addition", (False, True): "removal"}.get((step[0] > 0, step[1] > 0), "replace"), i, step[0], j, step[1]))
        i, j, added = i + step[0], j + step[1], added + step[0]
    left = len(phrase) - j
    if left >= MOST_DIFF:
        return None
    return matched, added, out + ([("removal", i, 0, j, left)] if left else [])


def _aligner(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = []
        for pfile, license, t, s, text, phrase in rows[["pfile_fk", "rf_pk", "t", "s", "window", "phrase"]].itertuples(index=False, name=None):
            if (got := aligned(text, phrase, s)) is None:
                continue
            matched, added, segments = got
            rank = 100.0 * matched / (len(phrase) + added)
            end = segments[-1][1] + segments[-1][2]
            out.append((pfile, license, rank, t, t + end, [{"kind": k, "start": t + a, "len": n, "rf_start": b, "rf_len": m} for k, a, n, b, m in segments]))
        yield pd.DataFrame(out, columns=["pfile_fk", "rf_pk", "rank", "start", "end", "segments"])


_SEGMENTS = "array<struct<kind:string,start:int,len:int,rf_start:int,rf_len:int>>"
_ALIGNED = f"pfile_fk long, rf_pk long, rank double, start int, end int, segments {_SEGMENTS}"
MATCH_SCHEMA = f"pfile_fk long, rf_pk long, full boolean, pct int, start int, end int, segments {_SEGMENTS}"


def token_matches(files: DataFrame, catalogue: DataFrame) -> DataFrame:
    """All matches of sufficient rank, overlapping ones too: pfile_fk, rf_pk, full, rank, start, end (tokens), segments.

    files: pfile_fk, tokens; catalogue: rf_pk, tokens. A match that adds more tokens than LEAST_RANK allows is none,
    so an alignment sees a window of so many tokens only, whatever the length of the text.
    """
    starts = candidates(files, catalogue).groupBy("pfile_fk", "rf_pk", (F.col("t") - F.col("s")).alias("diagonal")).agg(F.min("s").alias("s"))
    starts = starts.withColumn("t", F.col("diagonal") + F.col("s"))
    wide = F.ceil(F.size("wanted") * 100 / LEAST_RANK).cast("int") + 2 * RUN
    spots = starts.join(catalogue.withColumnRenamed("tokens", "wanted"), "rf_pk").join(files, "pfile_fk")
    spots = spots.select("pfile_fk", "rf_pk", "t", "s", "wanted", F.slice("tokens", F.col("t") + 1, wide).alias("window"))
    same = (F.col("s") == 0) & (F.slice("window", 1, F.size("wanted")) == F.col("wanted"))
    whole = F.array(F.struct(F.lit("match").alias("kind"), F.col("t").alias("start"), F.size("wanted").alias("len"), F.lit(0).alias("rf_start"), F.size("wanted").alias("rf_len")))
    full = spots.filter(same).select("pfile_fk", "rf_pk", F.lit(True).alias("full"), F.lit(100.0).alias("rank"), F.col("t").alias("start"), (F.col("t") + F.size("wanted")).alias("end"), whole.alias("segments"))
    hashed = lambda c: F.transform(c, lambda x: F.xxhash64(x))
    rest = spots.filter(~same & (F.size("wanted") > RUN)).select("pfile_fk", "rf_pk", "t", "s", hashed("window").alias("window"), hashed("wanted").alias("phrase"))
    near = rest.mapInPandas(_aligner, _ALIGNED).filter(F.col("rank").cast("int") > LEAST_RANK)
    return full.unionByName(near.withColumn("full", F.lit(False)))


def surviving(found: DataFrame, includes: DataFrame) -> DataFrame:
    """The matches that no other one of the same file stands for.

    found: pfile_fk, rf_pk, full, rank, start, end and more; includes: big, small (licenses whose phrase holds that
    of another). Two matches compete if one's span holds the other's. Then a full match stands for all that
    it holds; else a license that includes the other stands for it; else, if the one inside is a full match of
    another license, both stay; else the higher rank wins. Ties go to the match of the earlier start, then the longer one,
    then the least license. A match is dropped if any competitor stands for it.
    """
    keys = ("rf_pk", "start", "end")
    found = found.withColumn("_best", F.struct("full", "rank")).groupBy("pfile_fk", *keys).agg(F.max_by(F.struct(*[c for c in found.columns if c not in ("pfile_fk", *keys)]), "_best").alias("_m")).select("pfile_fk", *keys, "_m.*")
    found = settled(found, "matches")  # few beside the texts, and read several times
    match = F.struct(*keys, "full", "rank")
    held = held_pairs(found.select("pfile_fk", match.alias("point"), F.col("start").alias("at")), found.select("pfile_fk", match.alias("span"), F.col("start").alias("lft"), F.col("end").alias("rgt")), "pfile_fk")
    held = held.filter((F.col("point.end") <= F.col("span.end")) & (F.struct(*[F.col(f"point.{k}") for k in keys]) != F.struct(*[F.col(f"span.{k}") for k in keys])))
    both = held.withColumnRenamed("span", "a").withColumnRenamed("point", "b").unionByName(held.withColumnRenamed("span", "b").withColumnRenamed("point", "a")).distinct()
    pairs = both.select("pfile_fk", *[F.col(f"{n}.{c}").alias(f"{n}_{c}") for n in "ab" for c in (*keys, "full", "rank")])
    a_holds, b_holds = F.expr("a_start <= b_start and a_end >= b_end"), F.expr("b_start <= a_start and b_end >= a_end")
    other = F.col("a_rf_pk") != F.col("b_rf_pk")
    inside = includes.select("big", "small", F.lit(True).alias("yes"))
    for a, b in (("a_", "b_"), ("b_", "a_")):
        pairs = pairs.join(inside.select(F.col("big").alias(a + "rf_pk"), F.col("small").alias(b + "rf_pk"), F.col("yes").alias(a + "includes")), [a + "rf_pk", b + "rf_pk"], "left")
    order = lambda n: F.struct(F.col(n + "start"), -F.col(n + "end"), F.col(n + "rf_pk"))
    first = order("a_") < order("b_")
    a_over, b_over = F.col("a_full") & a_holds, F.col("b_full") & b_holds
    a_in, b_in = other & F.coalesce(F.col("a_includes"), F.lit(False)), other & F.coalesce(F.col("b_includes"), F.lit(False))
    beside = other & ((F.col("b_full") & a_holds) | (F.col("a_full") & b_holds))
    ranks = (F.col("a_rank") > F.col("b_rank")) | ((F.col("a_rank") == F.col("b_rank")) & first)
    wins = F.when(a_over & b_over, first).when(a_over, True).when(b_over, False).when(a_in & b_in, first).when(a_in, True).when(b_in, False).when(beside, False).otherwise(ranks)
    gone = pairs.filter(wins).select("pfile_fk", *[F.col("b_" + c).alias(c) for c in keys]).distinct()
    return found.join(gone, ["pfile_fk", *keys], "left_anti")


def _to_characters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Token positions of a file's matches as character positions."""
    for rows in batches:
        out = []
        for pfile, text, found in rows[["pfile_fk", "text", "found"]].itertuples(index=False, name=None):
            spans = np.array([(a, b) for _, a, b in tokens(text)] + [(len(text), len(text))])
            for m in found:
                segments = []
                for x in m["segments"]:
                    a = int(spans[x["start"], 0])
                    b = int(spans[x["start"] + x["len"] - 1, 1]) if x["len"] else a
                    segments.append({"kind": x["kind"], "start": a, "len": b - a, "rf_start": x["rf_start"], "rf_len": x["rf_len"]})
                end = int(spans[m["end"] - 1, 1]) if m["end"] > m["start"] else int(spans[m["start"], 0])
                out.append((pfile, m["rf_pk"], m["full"], 100 if m["full"] else min(99, max(1, int(m["rank"]))), int(spans[m["start"], 0]), end, segments))
        yield pd.DataFrame(out, columns=["pfile_fk", "rf_pk", "full", "pct", "start", "end", "segments"])


def searched(phrases: DataFrame, ignored_text: str = IGNORED_TEXT) -> DataFrame:
    """rf_pk and tokens of the phrases that are searched: not of ignored names or texts, not null or without tokens."""
    named = ~F.coalesce(F.col("shortname").isin(IGNORED_NAMES), F.lit(False))
    kept = phrases.filter(named & F.col("text").isNotNull() & ~F.trim("text").rlike(ignored_text))
    return kept.select("rf_pk", token_array(F.col("text")).alias("tokens")).filter(F.size("tokens") > 0)


def matches(files: DataFrame, phrases: DataFrame) -> DataFrame:
    """Matches of phrases(rf_pk, shortname, text) in files(pfile_fk, text): pfile_fk, rf_pk, full, pct, start, end, segments.

    Offsets are characters. Files and phrases meet in joins, on either side of which Spark may broadcast by size;
    texts are handed to Python for surviving matches only, to count characters. Null texts have no match; null and
    empty phrases are never found.
    """
    catalogue = searched(phrases)
    split = files.filter("text is not null").select("pfile_fk", token_array(F.col("text")).alias("tokens"))
    found = token_matches(split, catalogue)
    as_texts = phrases.select("rf_pk", "text").join(catalogue.select("rf_pk"), "rf_pk", "left_semi")
    held = phrase_hits(as_texts.withColumnRenamed("rf_pk", "pfile_fk"), as_texts.withColumnRenamed("rf_pk", "phrase_pk"))
    kept = surviving(found, held.select(F.col("pfile_fk").alias("big"), F.col("phrase_pk").alias("small")))
    by_file = kept.groupBy("pfile_fk").agg(F.collect_list(F.struct("rf_pk", "full", "rank", "start", "end", "segments")).alias("found"))
    return files.join(by_file, "pfile_fk").select("pfile_fk", "text", "found").mapInPandas(_to_characters, MATCH_SCHEMA)


def as_findings(files: DataFrame, found: DataFrame, agent: int) -> DataFrame:
    """Findings of a scan (S9): one for each match, and one with a null license for each file without any."""
    hit = found.select("pfile_fk", F.col("rf_pk").alias("rf_fk"), F.col("pct").cast("int"))
    none = files.select("pfile_fk").join(hit.select("pfile_fk"), "pfile_fk", "left_anti").select("pfile_fk", F.lit(None).cast("long").alias("rf_fk"), F.lit(None).cast("int").alias("pct"))
    return hit.unionByName(none).withColumn("agent_fk", F.lit(agent))


def unescaped(delimiters: str) -> str:
    """Delimiters as a user types them, with backslash escapes."""
    return delimiters.encode().decode("unicode_escape")


def bulk_matches(items: DataFrame, files: DataFrame, phrase: str, delimiters: str = DELIMITERS) -> DataFrame:
    """item and pfile_fk of items whose text holds a user's phrase token by token (S11); no differences are allowed.

    The phrase is a parameter: texts are searched inside the JVM, as one joined string between separators.
    """
    wanted = [x[0] for x in tokens(phrase, unescaped(delimiters))]
    if not wanted:
        return items.select("item", "pfile_fk").limit(0)
    # A text that lacks the longest token as it stands can't match; the others only are split.
    files = files.filter(F.contains(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(max(wanted, key=len))))
    joined = F.concat(F.lit("\x1f"), F.array_join(token_array(F.col("text"), unescaped(delimiters)), "\x1f"), F.lit("\x1f"))
    hit = files.filter(joined.contains("\x1f" + "\x1f".join(wanted) + "\x1f")).select("pfile_fk")
    return items.join(hit, "pfile_fk", "left_semi").select("item", "pfile_fk")


def phrase_hits(files: DataFrame, phrases: DataFrame) -> DataFrame:
    """pfile_fk, phrase_pk for phrases(phrase_pk, text) contained in files(pfile_fk, text), with no differences.

    Candidates share the phrase's first run of up to three tokens; the rest is compared on the spot.
    """
    p = phrases.select("phrase_pk", token_array(F.col("text")).alias("wanted")).filter(F.size("wanted") > 0)
    f = files.filter("text is not null").select("pfile_fk", token_array(F.col("text")).alias("tokens"))
    size = F.least(F.size("wanted"), F.lit(RUN))
    run = F.coalesce(*[F.when(size == n, F.element_at(runs("wanted", 1, n), 1)) for n in range(1, RUN + 1)])
    heads = p.select("phrase_pk", size.alias("n"), run.alias("run"))
    lengths, wanted = sought(heads)
    spots = _heads(f, "pfile_fk", "tokens", lengths or (RUN,), wanted).join(broadcast_if_few(heads), ["n", "run"])
    per_file = spots.groupBy("pfile_fk", "phrase_pk").agg(F.collect_list("t").alias("spots")).join(broadcast_if_few(p, 1000), "phrase_pk")
    same = F.exists("spots", lambda t: F.slice("tokens", t + 1, F.size("wanted")) == F.col("wanted"))
    return per_file.join(f, "pfile_fk").filter(same).select("pfile_fk", "phrase_pk")


def phrase_licenses(hits: DataFrame, phrase_map: DataFrame) -> DataFrame:
    """pfile_fk, rf_fk, removed of the licenses that found phrases stand for (S12); phrase_map: phrase_pk, rf_fk, removed."""
    return hits.join(broadcast_if_few(phrase_map), "phrase_pk").select("pfile_fk", "rf_fk", "removed").distinct()


def scan_candidates(items: DataFrame, decisions: DataFrame, findings: DataFrame, skip_irrelevant: bool = True, only_with_findings: bool = False, irrelevant: int = 4) -> DataFrame:
    """Distinct contents a bulk scan looks at."""
    rows = items
    if skip_irrelevant:
        rows = rows.join(decisions.filter(F.col("decision_type") == irrelevant).select("item"), "item", "left_anti")
    if only_with_findings:
        rows = rows.join(findings.filter("rf_fk is not null").select("pfile_fk"), "pfile_fk", "left_semi")
    return rows.filter("pfile_fk is not null").select("pfile_fk").distinct()
