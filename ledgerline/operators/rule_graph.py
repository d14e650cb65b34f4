"""A license decision tree: rules that need phrases and other rules, evaluated over the phrases found in one pass."""

from __future__ import annotations

import csv
import json
import os
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .automaton import original_spans, scanned

#: Characters (cleaned) that may stand between the parts of a phrase with a gap.
GAP = 60
#: Rules of a graph: each is an expression.
MOST_RULES = 2000
OWN_RULES = os.path.join(os.path.dirname(os.path.abspath(__file__)), "license_rules.csv")
NOTHING = "No_license_found"


@dataclass(frozen=True)
class Rule:
    """A node: holds if one of ``says`` is in the text (each a sequence of phrases; none: always), all rules of
    ``needs`` hold and none of ``unless``. With a license it is a finding of that interest."""

    name: str
    license: str = ""
    interest: int = 0
    says: list[tuple[str, ...]] = field(default_factory=list)
    needs: list[str] = field(default_factory=list)
    unless: list[str] = field(default_factory=list)


def parse_rule_table(text: str) -> list[Rule]:
    """Rules of a table with the columns rule;license;interest;says;with;unless: says is alternatives (|) of phrases with
    gaps (..), with names rules joined by &, unless by |."""
    split = lambda s, sign: [x.strip() for x in s.split(sign) if x.strip()]
    rows = csv.DictReader(text.splitlines(), delimiter=";")
    return [Rule(r["rule"], r["license"], int(r["interest"]), [tuple(split(a, " .. ")) for a in split(r["says"], "|")], split(r["with"], "&"), split(r["unless"], "|")) for r in rows]


def own_rules() -> list[Rule]:
    with open(OWN_RULES, encoding="utf-8") as f:
        return parse_rule_table(f.read())


def in_order(rules: list[Rule]) -> list[Rule]:
    """Rules behind those that they name; ValueError for unknown names, repeated ones and cycles."""
    by_name = {r.name: r for r in rules}
    if len(by_name) < len(rules) or len(rules) > MOST_RULES:
        raise ValueError(f"up to {MOST_RULES} rules, each of a name of its own")
    if unknown := {n for r in rules for n in (*r.needs, *r.unless)} - set(by_name):
        raise ValueError(f"unknown rules: {sorted(unknown)}")
    out: dict[str, Rule] = {}
    rest = list(rules)
    while rest:
        ready = [r for r in rest if all(n in out for n in (*r.needs, *r.unless))]
        if not ready:
            raise ValueError(f"a cycle among {sorted(r.name for r in rest)}")
        out |= {r.name: r for r in ready}
        rest = [r for r in rest if r.name not in out]
    return list(out.values())


def phrases_of(rules: list[Rule]) -> list[str]:
    return sorted({p for r in rules for says in r.says for p in says})


_RULE = "array<struct<rule:int,says:array<array<int>>,needs:array<int>,unless:array<int>>>"
_SPANS = "array<struct<at:int,to:int>>"


def _spans(hits: Column, parts: Column, gap: int) -> Column:
    """(at, to) of the places where phrases stand one after another, each at most ``gap`` characters behind the one before."""
    span = lambda at, h: F.struct(at.alias("at"), h["to"].alias("to"))
    begin = F.transform(F.filter(hits, lambda h: h["phrase"] == parts[0]), lambda h: span(h["at"], h))
    after = lambda s, p: F.filter(hits, lambda h: (h["phrase"] == p) & (h["at"] >= s["to"]) & (h["at"] - s["to"] <= gap))
    follow = lambda spans, p: F.flatten(F.transform(spans, lambda s: F.transform(after(s, p), lambda h: span(s["at"], h))))
    return F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), begin, follow)


def holding(hits: Column, rules: list[Rule], number: dict[str, int], gap: int = GAP) -> Column:
    """rule (its place in ``rules``) and spans (at, to) of the rules that hold, given the phrases found in a text.

    Rules come behind those that they name, so one fold over them knows what each needs. The rules are one constant of
    the plan, whose size does not grow with them.
    """
    place = {r.name: i for i, r in enumerate(rules)}
    table = [{"rule": i, "says": [[number[p] for p in says] for says in r.says], "needs": [place[n] for n in r.needs], "unless": [place[n] for n in r.unless]} for i, r in enumerate(rules)]
    none = F.array().cast(f"array<struct<rule:int,spans:{_SPANS}>>")
    said = lambda r: F.array_distinct(F.flatten(F.transform(r["says"], lambda parts: _spans(hits, parts, gap))))
    told = F.transform(F.from_json(F.lit(json.dumps(table)), _RULE), lambda r: F.struct(r["rule"].alias("rule"), r["needs"].alias("needs"), r["unless"].alias("unless"), (F.size(r["says"]) > 0).alias("speaks"), said(r).alias("said")))
    told = F.filter(told, lambda r: ~r["speaks"] | (F.size(r["said"]) > 0))

    def step(state: Column, r: Column) -> Column:
        there = lambda n: F.exists(state, lambda s: s["rule"] == n)
        holds = F.forall(r["needs"], there) & ~F.exists(r["unless"], there)
        lent = F.array_distinct(F.flatten(F.transform(F.filter(state, lambda s: F.array_contains(r["needs"], s["rule"])), lambda s: s["spans"])))
        own = F.array(F.struct(r["rule"].alias("rule"), F.when(r["speaks"], r["said"]).otherwise(lent).alias("spans")))
        return F.when(holds, F.concat(state, own)).otherwise(state)

    return F.when(F.size(hits) > 0, F.aggregate(told, none, step)).otherwise(none)


def rule_findings(files: DataFrame, keys: list[str], text: Column, rules: list[Rule] | None = None, gap: int = GAP) -> DataFrame:
    """keys, shortname, interest and spans (start, end in the text) of the licenses that the rules find in each file.

    One pass over the texts finds all phrases of all rules; the rules are then evaluated over the few hits of a file. A
    rule with neither phrases nor needs holds in every text with a hit. A license that several rules find comes once,
    with the highest interest and the spans of all; a rule without phrases has those of the rules that it needs. Where a
    file has licenses of high interest (2), those of low interest are dropped; a file without any has one row with the
    name for "nothing" and no spans.
    """
    rules = in_order(own_rules() if rules is None else rules)
    number = {p: i for i, p in enumerate(phrases_of(rules))}
    rows = scanned(files, keys, text, list(number))
    of = lambda values: F.array(*[F.lit(v) for v in values])
    licenses, interests = of(r.license for r in rules), of(r.interest for r in rules)
    found = F.transform(holding(F.col("hits"), rules, number, gap), lambda s: F.struct(F.element_at(licenses, s["rule"] + 1).alias("shortname"), F.element_at(interests, s["rule"] + 1).alias("interest"), s["spans"].alias("spans")))
    rows = rows.select(*keys, "starts", "shifts", F.filter(found, lambda x: x["shortname"] != "").alias("_found"))
    best = F.exists("_found", lambda x: x["interest"] >= 2)
    rows = rows.withColumn("_found", F.filter("_found", lambda x: ~best | (x["interest"] >= 2)))
    same = lambda n: F.filter("_found", lambda x: x["shortname"] == n)
    merged = lambda n: F.struct(n.alias("shortname"), F.array_max(F.transform(same(n), lambda x: x["interest"])).alias("interest"), F.array_sort(F.array_distinct(F.flatten(F.transform(same(n), lambda x: x["spans"])))).alias("spans"))
    names = F.array_distinct(F.transform("_found", lambda x: x["shortname"]))
    nothing = F.array(F.struct(F.lit(NOTHING).alias("shortname"), F.lit(0).alias("interest"), F.array().cast(_SPANS).alias("spans")))
    each = rows.select(*keys, "starts", "shifts", F.explode(F.when(F.size("_found") > 0, F.transform(names, merged)).otherwise(nothing)).alias("r"))
    return each.select(*keys, "r.shortname", "r.interest", original_spans(F.col("starts"), F.col("shifts"), F.col("r.spans")).alias("spans"))
