"""Copyright statements: found, told from other uses of the word, and cut to size. All of it runs inside the JVM.

A statement is one match of a pattern that is put together from fixed values: where it begins, and which lines it goes
on over. Where a match starts follows from the lengths of what lies between matches. Judging and cutting are
projections over one row for each statement.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import java_regex

from . import fixed_patterns as fixed
from .scanners import cleaned, parse_config

_P = {k: java_regex(v).removesuffix(r"[\s\S]*") for k, v in parse_config(fixed.STATEMENTS).items()}
_BEGINS, _TAG = f"(?:{_P['REG_COPYRIGHT']})", f"(?:{_P['REG_SPDX_COPYRIGHT']})"
_LINE = r"[^\n]*"
_ARRAY = rf"(?={_LINE}{_TAG}){_LINE}\[[ \t\r]*\n(?:(?![ \t]*\]){_LINE}\n)*+[ \t]*\]"
_TAGGED = rf"(?={_LINE}{_TAG}){_LINE}"
#: Further lines belong to a statement up to a blank one (no two letters or digits in a row) or one with a statement of its own.
_PLAIN = rf"{_LINE}(?:\n(?={_P['REG_NON_BLANK']})(?!{_LINE}(?:{_P['REG_SIMPLE_COPYRIGHT']}|{_TAG})){_LINE})*+"
#: A statement: a list in brackets of tagged ones, a tagged line, or a line with what follows.
STATEMENT = rf"(?i)(?!{_P['REG_EXCEPTION']})(?={_BEGINS})(?:{_ARRAY}|{_TAGGED}|{_PLAIN})"
_QUOTED_LINE = r'(?m)^[^\n"]*"[^"\n]+"[^\n]*$'

_TRAILS = ["REG_STRIP_LICENSE_TRAIL", "REG_STRIP_TRADEMARK_TRAIL", "REG_ALL_RIGHT_RESERVE_TRAIL", "REG_STRIP_COPYSYM_NONYEAR"]
_NO_STATEMENTS = ["REG_EXCEPTION_TEMPLATE", "REG_EXCEPTION_BINARY_NOISE", "REG_EXCEPTION_META", "REG_EXCEPTION_CHARNAME_RUN"]
_OTHER_USES = ["REG_EXCEPTION_COPY", "REG_EXCEPTION_VERB_FOLLOW", "REG_EXCEPTION_ADJECTIVE_PREFIX", "REG_EXCEPTION_PASSIVE"]
KEEP, DEACTIVATE, DISCARD = "keep", "deactivate", "discard"


def located(text: Column, pattern: str) -> Column:
    """start (characters) and found of every match of a pattern, in order: array of structs."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    both = F.zip_with(hits, F.slice(gaps, F.lit(1), F.greatest(F.size(hits), F.lit(0))), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,found:string>>").alias("out"))

    def add(seen: Column, x: Column) -> Column:
        start = seen["at"] + F.length(x["gap"])
        own = F.array(F.struct(start.alias("start"), x["hit"].alias("found")))
        return F.struct((start + F.length(x["hit"])).alias("at"), F.concat(seen["out"], own).alias("out"))

    return F.aggregate(both, none, add, lambda seen: seen["out"])


def _any(text: Column, names: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike("(?is)" + _P[n]) for n in names])


def _class(characters: str) -> str:
    return "[" + re.sub(r"([\\\[\]^&-])", r"\\\1", characters) + "]"


def _with(rows: Column, **new) -> Column:
    """An array of structs with more fields, each a function of a struct; a step of its own, so that nothing is computed twice."""
    return F.transform(rows, lambda x: reduce(lambda y, name: y.withField(name, new[name](x)), new, x))


def replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """text with the first of each pair replaced by the second as long as it is found, pair by pair.

    What a replacement makes anew goes, too. A pass replaces all that is there. Each takes away some of a character that
    the first has more of than the second, so there are no more passes than the text has of that character.
    """
    mark = lambda old, new: max(sorted(set(old) - {" "}), key=lambda c: old.count(c) - new.count(c))
    steps = F.array(*[F.struct(F.lit(old).alias("old"), F.lit(new).alias("new"), F.lit(mark(old, new)).alias("mark")) for old, new in pairs])
    passes = lambda t, p: F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t) - F.length(F.replace(t, p["mark"], F.lit("")))))
    once = lambda t, p: F.when(F.contains(t, p["old"]), F.replace(t, p["old"], p["new"])).otherwise(t)
    return F.aggregate(steps, text, lambda t, p: F.when(F.contains(t, p["old"]), F.aggregate(passes(t, p), t, lambda u, _: once(u, p))).otherwise(t))


def judged(pieces: Column) -> Column:
    """Structs with raw (a statement) with what to do with it, and left, what is left of it.

    What follows a license, a trademark or a reservation of rights goes. A statement is kept but deactivated where it is
    a template, noise, or, up to its second mark, another use of the word. Noise and outer punctuation
    go, the first word is spelled one way, both as long as there is any, and one ending goes; if nothing or the bare word is left it is discarded.
    """
    cut = lambda x: reduce(lambda c, n: F.regexp_replace(c, "(?is)" + _P[n] + (r"[\s\S]*" if n == _TRAILS[-1] else ""), ""), _TRAILS, x["raw"])
    first = lambda x: F.regexp_extract(x["cut"], r"(?is)\A(?:.*?copyright.*?(?=copyright)|.*\z)", 0)

    def text(x: Column) -> Column:
        ends = _class(fixed.TRIMMED)
        t = replaced(x["cut"], [(noise, " ") for noise in fixed.NOISE])
        t = F.regexp_replace(t, f"^{ends}+|{ends}+\\z", "")
        t = F.regexp_replace(t, f"^{_class(fixed.TRIMMED_AT_START)}+|{_class(fixed.TRIMMED_AT_END)}+\\z", "")
        return replaced(t, [(word, fixed.FIRST_WORD) for word in fixed.FIRST_WORDS])

    def left(x: Column) -> Column:
        ending = reduce(lambda w, e: w.when(x["text"].endswith(e) & (F.length(x["text"]) > len(e) + 1), F.lit(len(e))), fixed.ENDINGS, F.when(F.lit(False), F.lit(0)))
        return F.substr(x["text"], F.lit(1), F.length(x["text"]) - F.coalesce(ending, F.lit(0)))

    def what(x: Column) -> Column:
        off = x["head"] | _any(x["raw"], ["REG_REMOVE_FILE_STATEMENT"]) | _any(x["cut"], _NO_STATEMENTS) | _any(x["first"], _OTHER_USES)
        return F.when(off, DEACTIVATE).when((x["left"] == "") | F.lower(x["left"]).isin("copyright", "copyrights", "copyrighted"), DISCARD).otherwise(KEEP)

    return _with(_with(_with(_with(pieces, cut=cut), first=first, text=text), left=left), what=what)


def copyright_findings(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, type, content, hash, start, end, is_enabled of the copyright statements.

    A statement reaches from its mark as far as what is left of it is long, a tagged one to the end of its line; no
    further than LONGEST_STATEMENT. In a bracketed list of tagged statements each quoted line is one, and the line
    that opens the list is deactivated; of a list without an end only that line is. Offsets are characters of the
    whole text, ends exclusive. Null and empty texts have none.
    """
    hits = files.filter(F.col(text).rlike("(?i)" + _BEGINS)).select(F.col(key), F.explode(located(F.col(text), STATEMENT)).alias("hit")).select(key, "hit.*")
    line = F.substring_index("found", "\n", 1)
    is_list = F.col("found").rlike(r"\A" + f"(?i){_ARRAY}" + r"\z")
    piece = lambda start, shown, raw, head, tagged: F.struct(start.alias("start"), shown.alias("shown"), raw.alias("raw"), head.alias("head"), tagged.alias("tagged"))
    quoted = lambda x: F.concat(F.lit(fixed.FIRST_WORDS[0] + ": "), F.regexp_extract(x["found"], '"([^"]+)"', 1))
    body = F.substr("found", F.length(line) + 2)
    inner = F.transform(located(body, _QUOTED_LINE), lambda x: piece(F.col("start") + F.length(line) + 1 + x["start"], x["found"], quoted(x), F.lit(False), F.lit(True)))
    tagged = line.rlike(f"(?i){_TAG}")
    opens = tagged & line.rlike(r"\[\s*\z")
    pieces = F.when(is_list, F.concat(F.array(piece(F.col("start"), line, line, F.lit(True), F.lit(True))), inner)).otherwise(F.array(piece(F.col("start"), F.col("found"), F.col("found"), opens, tagged)))
    rows = hits.select(key, F.explode(judged(pieces)).alias("p")).select(key, "p.start", "p.shown", "p.tagged", "p.left", "p.what").filter(F.col("what") != DISCARD)
    reach = F.when((F.col("what") == KEEP) & ~F.col("tagged"), F.length("left")).otherwise(F.length("shown"))
    reach = F.least(reach, F.length("shown"), F.lit(fixed.LONGEST_STATEMENT))
    rows = rows.withColumn("content", cleaned(F.substr("shown", F.lit(1), reach), "statement")).filter("content != ''")
    return rows.select(key, F.lit("statement").alias("type"), "content", F.md5("content").alias("hash"), "start", (F.col("start") + reach).alias("end"), (F.col("what") == KEEP).alias("is_enabled"))
