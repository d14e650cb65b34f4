"""The log of decisions: what holds now, what follows from events and findings.

"Current" has several definitions in practice, so first_of takes the order as a parameter; each caller states its
own. Events have event_pk, item, rf_fk, removed, event_type, ts; decisions decision_pk, item, pfile_fk, group_fk,
decision_type, scope (0 item, 1 repository), ts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tree import held_pairs

# Types of decisions.
WIP, TO_BE_DISCUSSED, IRRELEVANT, IDENTIFIED, DO_NOT_USE, NON_FUNCTIONAL = 0, 3, 4, 5, 6, 7
# Scopes.
ITEM, REPO = 0, 1

#: Orders in which the first decision is the current one.
NEWEST = ["-decision_pk"]
ITEM_FIRST = ["scope", "-decision_pk"]
ITEM_FIRST_BY_DATE = ["scope", "-ts", "-decision_pk"]


def _order(names: list[str]) -> list[Column]:
    return [F.desc(n[1:]) if n[0] == "-" else F.asc(n) for n in names]


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the order given (``-name``: descending), as DISTINCT ON picks it (W2w).

    All columns stay. The window groups by key and needs a bound on rows of a key; Spark's rank limit drops all
    but the first row of a key before the shuffle, so large keys do not move.
    """
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*_order(order)))).filter("_n = 1").drop("_n")


def duplicates(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """All rows but the first of each key (W1y)."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*_order(order)))).filter("_n > 1").drop("_n")


def ranked_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """All rows of rank 1: ties stay (W1w)."""
    return rows.withColumn("_n", F.rank().over(Window.partitionBy(*keys).orderBy(*_order(order)))).filter("_n = 1").drop("_n")


def applicable(items: DataFrame, decisions: DataFrame, group: int, repo_uploads: DataFrame | None = None) -> DataFrame:
    """Decisions that apply to each item: item scope by item and group, repository scope by content.

    Two equi-joins instead of a join on OR. Repository scope applies to uploads that opt in (repo_uploads:
    upload_fk; None: all) and then for any group.
    """
    d = decisions.select("decision_pk", F.col("item").alias("_item"), F.col("pfile_fk").alias("_pfile"), "group_fk", "decision_type", "scope", "ts")
    own = d.filter((F.col("scope") == ITEM) & (F.col("group_fk") == group))
    by_item = items.join(own, items["item"] == own["_item"])
    asked = items if repo_uploads is None else items.join(repo_uploads.select("upload_fk"), "upload_fk", "left_semi")
    shared = d.filter(F.col("scope") == REPO)
    by_content = asked.join(shared, asked["pfile_fk"] == shared["_pfile"])
    return by_item.unionByName(by_content).drop("_item", "_pfile")


def current_decisions(items: DataFrame, decisions: DataFrame, group: int, order: list[str] = NEWEST, repo_uploads: DataFrame | None = None, keys: tuple[str, ...] = ("item",)) -> DataFrame:
    """One decision for each item to which one applies (C1); keys ("item", "scope") keep one of each scope."""
    return first_of(applicable(items, decisions, group, repo_uploads), list(keys), order)


def effective_events(events: DataFrame) -> DataFrame:
    """The last event of each item and license."""
    last = events.groupBy("item", "rf_fk").agg(F.max(F.struct("event_pk", "removed", "event_type", "ts")).alias("e"))
    return last.select("item", "rf_fk", "e.event_pk", "e.removed", "e.event_type", "e.ts")


def current_clearings(events: DataFrame, found: DataFrame) -> DataFrame:
    """item, rf_fk, removed, by_event, by_scanner from effective events and scanner findings (C3): an event beats a finding."""
    e = effective_events(events).select("item", "rf_fk", F.col("removed").alias("_removed"), F.lit(True).alias("by_event"))
    f = found.select("item", "rf_fk").distinct().withColumn("by_scanner", F.lit(True))
    both = e.join(f, ["item", "rf_fk"], "full")
    return both.select("item", "rf_fk", F.coalesce("_removed", F.lit(False)).alias("removed"), F.coalesce("by_event", F.lit(False)).alias("by_event"), F.coalesce("by_scanner", F.lit(False)).alias("by_scanner"))


def unhandled(found: DataFrame, events: DataFrame) -> DataFrame:
    """Found item and license pairs on which no event exists (C4)."""
    return found.select("item", "rf_fk").distinct().join(events.select("item", "rf_fk"), ["item", "rf_fk"], "left_anti")


def decide(items: DataFrame, events: DataFrame, found: DataFrame, decision_type: int, scope: int = ITEM, previous: DataFrame | None = None, nothing_known: bool = False) -> DataFrame:
    """New decisions from the last events and the findings (C5): item, decision_type, scope, licenses (array).

    Licenses are those not removed; nothing_known instead removes them all and decides identified. An item whose
    previous decision (item, decision_type, scope, licenses) says the same gets none.
    """
    held = current_clearings(events, found).filter("not removed").groupBy("item").agg(F.sort_array(F.collect_set("rf_fk")).alias("licenses"))
    empty = F.array().cast(held.schema["licenses"].dataType)
    out = items.select("item").join(held, "item", "left").withColumn("licenses", empty if nothing_known else F.coalesce("licenses", empty))
    out = out.select("item", F.lit(IDENTIFIED if nothing_known else decision_type).alias("decision_type"), F.lit(scope).alias("scope"), "licenses")
    return out if previous is None else out.join(previous.select(out.columns), out.columns, "left_anti")


def decision_map(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """item and decision_pk: the newest of the item, else the newest of its content in repository scope; irrelevant ones dropped."""
    own = decisions.filter(F.col("scope") == ITEM).groupBy("item").agg(F.max(F.struct("decision_pk", "decision_type")).alias("own"))
    shared = decisions.filter(F.col("scope") == REPO).groupBy("pfile_fk").agg(F.max(F.struct("decision_pk", "decision_type")).alias("shared"))
    both = items.select("item", "pfile_fk").join(own, "item", "left").join(shared, "pfile_fk", "left").withColumn("d", F.coalesce("own", "shared"))
    return both.filter(F.col("d").isNotNull() & (F.col("d.decision_type") != IRRELEVANT)).select("item", F.col("d.decision_pk").alias("decision_pk"), F.col("d.decision_type").alias("decision_type"))


def projected(rows: DataFrame, license_map: DataFrame, usage: int) -> DataFrame:
    """rows with projected_fk: the parent of rf_fk for a usage, else itself."""
    m = license_map.filter(F.col("usage") == usage).select("rf_fk", "rf_parent")
    return rows.join(m, "rf_fk", "left").withColumn("projected_fk", F.coalesce("rf_parent", "rf_fk")).drop("rf_parent")


def without_directory_marks(decisions: DataFrame, items: DataFrame, decision_type: int) -> DataFrame:
    """Decisions without those of a type on the items given: how a folder's mark is taken back."""
    hit = items.select("item").withColumn("decision_type", F.lit(decision_type))
    return decisions.join(hit, ["item", "decision_type"], "left_anti").select(decisions.columns)


def marked_directory(items: DataFrame, decided: DataFrame, decision_type: int) -> DataFrame:
    """A decision of the type for every item that does not hold it already."""
    hold = decided.filter(F.col("decision_type") == decision_type).select("item")
    return items.select("item").join(hold, "item", "left_anti").select("item", F.lit(decision_type).alias("decision_type"), F.lit(ITEM).alias("scope"))


def bulk_history(bulks: DataFrame, items: DataFrame, matches: DataFrame) -> DataFrame:
    """bulk_pk, item, tried, matched for items in a bulk's subtree or with one of its matches (C20)."""
    spans = bulks.select("upload_fk", F.col("bulk_pk").alias("span"), "lft", "rgt")
    tried = held_pairs(items.select("upload_fk", F.col("item").alias("point"), F.col("lft").alias("at")), spans, "upload_fk")
    tried = tried.select(F.col("span").alias("bulk_pk"), F.col("point").alias("item"), F.lit(True).alias("tried"))
    hit = matches.select("bulk_pk", "item").distinct().withColumn("matched", F.lit(True))
    return tried.join(hit, ["bulk_pk", "item"], "full").select("bulk_pk", "item", F.coalesce("tried", F.lit(False)).alias("tried"), F.coalesce("matched", F.lit(False)).alias("matched"))


def edited_texts(overlay: DataFrame, targets: DataFrame, action: str, content: str | None = None) -> DataFrame:
    """The overlay (fk, item, hash, content, is_enabled) after an edit of targets (fk, item, hash).

    ``edit`` sets the content, ``delete`` disables, ``restore`` enables, ``revert`` drops the overlay's rows.
    """
    rest = overlay.join(targets, ["fk", "item"], "left_anti")
    if action == "revert":
        return rest
    old = overlay.select("fk", "item", F.col("content").alias("_content"), F.col("is_enabled").alias("_enabled"))
    now = targets.join(old, ["fk", "item"], "left")
    text = F.lit(content) if action == "edit" else F.col("_content")
    state = {"edit": F.coalesce("_enabled", F.lit(True)), "delete": F.lit(False), "restore": F.lit(True)}[action]
    return rest.unionByName(now.select("fk", "item", "hash", text.cast("string").alias("content"), state.alias("is_enabled")))


# The rules of the cascade. matches: item, license (projected), scanner, rf_fk, region_start, region_end.


def _covered(matches: DataFrame, scanner: str) -> DataFrame:
    """Items where in every license ``scanner`` found something and the keyword scanner nothing else."""
    own = F.collect_set(F.when(F.col("scanner") == scanner, F.col("rf_fk")))
    other = F.collect_set(F.when(F.col("scanner") == "keyword", F.col("rf_fk")))
    per = matches.groupBy("item", "license").agg(own.alias("own"), other.alias("other"))
    fits = (F.size("own") > 0) & (F.size(F.array_except("other", "own")) == 0)
    return per.groupBy("item").agg(F.bool_and(fits).alias("ok")).filter("ok").select("item")


def tag_without_contradiction(matches: DataFrame) -> DataFrame:
    return _covered(matches, "tag")


def sidecar_without_contradiction(matches: DataFrame) -> DataFrame:
    return _covered(matches, "sidecar")


def phrases_cover_all(matches: DataFrame, events: DataFrame, phrase_type: int) -> DataFrame:
    """Items with events of phrases only, which name every license found (C9d)."""
    only = events.groupBy("item").agg(F.bool_and(F.col("event_type") == phrase_type).alias("ok")).filter("ok").select("item")
    named = effective_events(events).filter("not removed").select("item", F.col("rf_fk").alias("license"))
    missing = matches.select("item", "license").distinct().join(named, ["item", "license"], "left_anti").select("item")
    return only.join(missing, "item", "left_anti")


def keyword_inside_phrase(matches: DataFrame) -> DataFrame:
    """Items where every keyword match lies inside a phrase match of the same license, and each license has both.

    Only the extent of each match counts. Within an item and license phrase matches are few, but not bounded, so
    they are joined, not gathered.
    """
    key = matches.filter(F.col("scanner") == "keyword").withColumn("_k", F.monotonically_increasing_id())
    big = matches.filter(F.col("scanner") == "phrase").select(F.col("item").alias("_i"), F.col("license").alias("_l"), F.col("region_start").alias("_s"), F.col("region_end").alias("_e"))
    inside = (key["item"] == big["_i"]) & (key["license"] == big["_l"]) & (F.col("_s") >= 0) & (F.col("region_start") >= F.col("_s")) & (F.col("region_end") <= F.col("_e"))
    outside = key.join(big, inside, "left_anti").select("item").distinct()
    has = lambda s: F.bool_or(F.col("scanner") == s)
    both = matches.groupBy("item", "license").agg((has("keyword") & has("phrase")).alias("both")).groupBy("item").agg(F.bool_and("both").alias("ok")).filter("ok").select("item")
    return both.join(outside, "item", "left_anti")


def scanners_agree(matches: DataFrame, scanners: tuple[str, ...] = ("keyword", "phrase", "sentence")) -> DataFrame:
    """Items where all scanners found each license, and each finding was made by all of them."""
    per = matches.filter(F.col("scanner").isin(*scanners)).groupBy("item", "license", "rf_fk").agg(F.countDistinct("scanner").alias("n"))
    seen = per.groupBy("item").agg(F.min("n").alias("least"), F.countDistinct("license").alias("with"))
    every = matches.groupBy("item").agg(F.countDistinct("license").alias("all"))
    return seen.join(every, "item").filter((F.col("least") == len(scanners)) & (F.col("with") == F.col("all"))).select("item")


def one_license_type(matches: DataFrame, licenses: DataFrame, wanted: str, conflicting: DataFrame | None = None) -> DataFrame:
    """Items whose licenses are all of the wanted type, without those in conflict (C9e)."""
    typed = matches.select("item", "license").distinct().join(licenses.select(F.col("rf_pk").alias("license"), "license_type"), "license", "left")
    ok = typed.groupBy("item").agg(F.bool_and(F.coalesce(F.col("license_type") == wanted, F.lit(False))).alias("ok")).filter("ok").select("item")
    return ok if conflicting is None else ok.join(conflicting.select("item"), "item", "left_anti")


def cascade(items: DataFrame, rules: dict[str, DataFrame]) -> DataFrame:
    """item and rule: the first rule, in the order given, that decides the item (C9); items without one are left out."""
    tagged = [hit.select("item").distinct().withColumn("_n", F.lit(i)) for i, hit in enumerate(rules.values())]
    first = reduce(DataFrame.unionByName, tagged).groupBy("item").agg(F.min("_n").alias("_n"))
    return items.select("item").join(first, "item").select("item", F.element_at(F.array(*[F.lit(n) for n in rules]), F.col("_n") + 1).alias("rule"))


def auto_decisions(
    items: DataFrame, matches: DataFrame, events: DataFrame, decisions: DataFrame, licenses: DataFrame, phrase_type: int = 6, wanted_type: str = "Permissive", conflicting: DataFrame | None = None,
    scanners: tuple[str, ...] = ("keyword", "phrase", "sentence"),
) -> DataFrame:
    """The whole cascade: item and rule.

    Irrelevant items are skipped. Items with a decision are marked as work in progress where a license was found
    that the decision lacks (decisions: item, decision_type, licenses). Items with events are decided by the
    phrase rule only; the others by the first rule that fits.

    Matches are grouped once by item and license, which tells what each rule says of a license, and once by item, which
    tells whether it says so of all of them; the rules are then one expression. Only the containment of keywords in
    phrases needs a join of its own, of items where each license has both. The same rows as cascade() over
    the rules one by one.
    """
    typed = matches.join(licenses.select(F.col("rf_pk").alias("license"), "license_type"), "license", "left")
    by = lambda *names: F.collect_set(F.when(F.col("scanner").isin(*names), F.col("rf_fk")))
    each = {s: by(s) for s in dict.fromkeys((*scanners, "tag", "sidecar", "keyword"))}
    has = lambda name: F.bool_or(F.col("scanner") == name).alias(f"has_{name}")
    per = typed.groupBy("item", "license").agg(F.bool_or(F.col("license_type").eqNullSafe(wanted_type)).alias("wanted"), has("keyword"), has("phrase"), by(*scanners).alias("by_any"), *[c.alias(f"by_{s}") for s, c in each.items()])
    covers = lambda s: (F.size(f"by_{s}") > 0) & (F.size(F.array_except("by_keyword", f"by_{s}")) == 0)
    agree = reduce(lambda a, c: a & c, [F.size(f"by_{s}") == F.size("by_any") for s in scanners]) & (F.size("by_any") > 0)
    rules = {"tag": covers("tag"), "sidecar": covers("sidecar"), "twice": F.col("has_keyword") & F.col("has_phrase"), "agree": agree, "wanted": F.col("wanted")}
    found = per.groupBy("item").agg(F.collect_set("license").alias("_licenses"), *[F.bool_and(c).alias(f"_{n}") for n, c in rules.items()])
    last = decisions.select("item", "decision_type", F.col("licenses").alias("_known"))
    named = effective_events(events).groupBy("item").agg(F.collect_set(F.when(~F.col("removed"), F.col("rf_fk"))).alias("_named"))
    kinds = events.groupBy("item").agg(F.bool_and(F.col("event_type") == phrase_type).alias("_phrases"))
    rows = items.select("item").join(last, "item", "left").join(found, "item", "left").join(kinds.join(named, "item"), "item", "left")
    twice = matches.join(found.filter("_twice").select("item"), "item", "left_semi")
    rows = rows.join(keyword_inside_phrase(twice).withColumn("_inside", F.lit(True)), "item", "left")
    if conflicting is not None:
        rows = rows.join(conflicting.select("item").distinct().withColumn("_conflict", F.lit(True)), "item", "left").withColumn("_wanted", F.col("_wanted") & F.col("_conflict").isNull())
    news = (F.col("decision_type") != IRRELEVANT) & (F.size(F.array_except("_licenses", "_known")) > 0)
    cover = F.col("_phrases") & (F.size(F.array_except(F.coalesce("_licenses", F.array().cast("array<bigint>")), F.col("_named").cast("array<bigint>"))) == 0)
    rule = (
        F.when(F.col("decision_type").isNotNull(), F.when(news, "update"))
        .when(F.col("_phrases").isNotNull(), F.when(cover, "phrase events"))
        .when(F.col("_tag"), "tag").when(F.col("_sidecar"), "sidecar").when(F.col("_inside"), "keyword in phrase").when(F.col("_agree"), "agreement").when(F.col("_wanted"), "license type")
    )
    return rows.select("item", rule.alias("rule")).filter("rule is not null").distinct()


def decisions_of_job(events: DataFrame, job: int, found: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Decisions for the items on which a job left events."""
    touched = events.filter(F.col("job_fk") == job).select("item").distinct()
    keep = lambda df: df.join(touched, "item", "left_semi")
    return decide(touched, keep(events), keep(found), IDENTIFIED, previous=previous)
