"""Groups of names that may not hold certain pairs, and buildings that are known by their results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..sources.store import written
from .entities import follow, groups, same_results

# The order of the rules by which a name finds its building.
RULES = ("authority", "spelling", "qualifier", "dwelling")


def constrained_groups(links: DataFrame, forbidden: DataFrame, by: str, exclusive: DataFrame | None = None, rounds: int = 60) -> DataFrame:
    """(by, name, root): names joined by links (by, a, b, rank) in order of (rank, a, b), but for links that would put a forbidden pair
    (by, a, b) into one group, or two labels of a kind (exclusive: by, name, kind, label, one row for each name and kind); root is the least name of the group. Names without a
    link are absent, nulls and links of a name to itself count for nothing.

    The result is that of walking the links one by one. Names that are connected at all and hold no forbidden pair are one group at once. In the others, a link is taken
    where it is the first possible one of both its groups: what else is joined before can't touch these two, so the walk takes it as well. All such
    links are taken in a round, each round is a written table; a long chain of links in order takes a round each, and RuntimeError is raised if rounds don't do.
    """
    e = links.select(by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "rank").filter("a is not null and b is not null and a <> b")
    e = written(e.groupBy(by, "a", "b").agg(F.min("rank").alias("rank")), "links")
    no = written(forbidden.select(by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a is not null and b is not null and a <> b").distinct(), "forbidden")
    whole = written(groups(e, by, "a", "b"), "whole")
    root_of = lambda df, side: df.select(F.col(by), F.col("name").alias(side), F.col("root").alias(f"r{side}"))
    clash = no.join(root_of(whole, "a"), [by, "a"]).join(root_of(whole, "b"), [by, "b"]).filter("ra = rb").select(by, F.col("ra").alias("root"))
    if exclusive is not None:
        kinds = written(exclusive.select(by, "name", "kind", "label").filter("name is not null and kind is not null and label is not null").distinct(), "kinds")
        several = whole.join(kinds, [by, "name"]).groupBy(by, "root", "kind").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least <> most")
        clash = clash.union(several.select(by, "root"))
    clash = written(clash.distinct(), "clashes")
    easy = whole.join(clash, [by, "root"], "left_anti").select(by, "name", "root")
    hard = whole.join(clash, [by, "root"], "left_semi").select(by, "name")
    labels = written(hard.select(by, "name", F.col("name").alias("root")), "constrained")
    e = written(e.join(hard.withColumnRenamed("name", "a"), [by, "a"], "left_semi"), "links")
    for _ in range(rounds):
        at = e.join(root_of(labels, "a"), [by, "a"]).join(root_of(labels, "b"), [by, "b"]).filter("ra <> rb")
        at = at.select(by, F.struct("rank", "a", "b").alias("ord"), F.least("ra", "rb").alias("x"), F.greatest("ra", "rb").alias("y"))
        bad = no.join(root_of(labels, "a"), [by, "a"]).join(root_of(labels, "b"), [by, "b"]).select(by, F.least("ra", "rb").alias("x"), F.greatest("ra", "rb").alias("y"))
        if exclusive is not None:
            held = labels.join(kinds, [by, "name"]).groupBy(by, "root", "kind").agg(F.min("label").alias("label"))
            left, right = (held.select(by, F.col("root").alias(r), "kind", F.col("label").alias(f"l{r}")) for r in "xy")
            bad = bad.union(at.select(by, "x", "y").distinct().join(left, [by, "x"]).join(right, [by, "y", "kind"]).filter("lx <> ly").select(by, "x", "y"))
        bad = bad.distinct()
        open_ = written(at.join(bad, [by, "x", "y"], "left_anti"), "open-links")
        first = open_.select(by, "ord", F.explode(F.array("x", "y")).alias("root")).groupBy(by, "root").agg(F.min("ord").alias("ord"))
        both = open_.join(first.withColumnRenamed("root", "x"), [by, "x", "ord"], "left_semi").join(first.withColumnRenamed("root", "y"), [by, "y", "ord"], "left_semi")
        joined = written(both.select(by, F.col("y").alias("root"), F.col("x").alias("into")), "joined")
        if joined.isEmpty():
            return easy.unionByName(labels)
        labels = written(labels.join(joined, [by, "root"], "left").select(by, "name", F.coalesce("into", "root").alias("root")), "constrained")
    raise RuntimeError("constrained_groups: links are left after the last round")


def _number(name: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(names.normalize(name), f"(?i){pattern}", group).try_cast("int")


def name_links(rows: DataFrame, by: str) -> DataFrame:
    """(by, a, b, rank) for names (by, name, authority, pinned): links by the ordered RULES.

    A name of the same identifier as the one authoritative name that has it belongs to that name; names of one key to the authoritative one, else the shortest; an
    identifier followed by words ('1 Est') to the name that is this identifier; a dwelling to the one group of dwellings that names it. A name takes the first rule
    that gives it another name; pinned names, nulls and the name of the whole take none.
    """
    n = rows.filter(F.col("name").isNotNull() & (F.col("name") != names.UNIQUE)).groupBy(by, "name").agg(F.max(F.coalesce("authority", F.lit(False))).alias("authority"), F.max(F.coalesce("pinned", F.lit(False))).alias("pinned"))
    n = written(n.select(by, "name", "authority", "pinned", names.key(F.col("name")).alias("key"), names.core(F.col("name")).alias("core"), names.qualified_core(F.col("name")).alias("qualified")), "names")
    free = n.filter("not pinned")
    master = free.filter("authority and core <> ''").groupBy(by, "core").agg(F.min("name").alias("b"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    one = free.filter("core <> ''").join(master, [by, "core"]).select(by, "name", "b", F.lit(0).alias("rank"))
    best = free.filter("key <> ''").groupBy(by, "key").agg(F.min_by("name", F.struct((~F.col("authority")).alias("x"), F.char_length("name"), "name")).alias("b"))
    two = free.join(best, [by, "key"]).select(by, "name", "b", F.lit(1).alias("rank"))
    plain = free.filter(F.col("key").rlike(names.SHORT_ID)).groupBy(by, F.col("core").alias("qualified")).agg(F.min("name").alias("b"))
    three = free.filter("qualified <> ''").join(plain, [by, "qualified"]).select(by, "name", "b", F.lit(2).alias("rank"))
    name = F.col("name")
    single = free.select(by, "name", _number(name, "^(?:batiment\\s+)?(?:logement|lgt|maison)s?\\.?\\s*n?[°]?\\s*([0-9]+)$", 1).alias("k")).filter("k is not null")
    span = "^(?:batiment\\s+)?logements?\\s+([0-9]+)\\s*(et|a|à|-)\\s*([0-9]+)$"
    sets = free.select(by, F.col("name").alias("b"), _number(name, span, 1).alias("lo"), _number(name, span, 3).alias("hi"), F.lower(F.regexp_extract(names.normalize(name), f"(?i){span}", 2)).alias("word")).filter("lo is not null")
    members = sets.select(by, "b", F.explode(F.when(F.col("word") == "et", F.array("lo", "hi")).otherwise(F.sequence(F.least("lo", "hi"), F.greatest("lo", "hi")))).alias("k")).distinct()
    unique = members.groupBy(by, "k").agg(F.min("b").alias("b"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    four = single.join(unique, [by, "k"]).select(by, "name", "b", F.lit(3).alias("rank"))
    found = reduce(DataFrame.unionByName, (one, two, three, four)).filter("name <> b")
    return found.groupBy(by, F.col("name").alias("a")).agg(F.min(F.struct("rank", "b")).alias("f")).select(by, "a", F.col("f.b").alias("b"), F.col("f.rank").alias("rank"))


def qualifiers(rows: DataFrame, by: str) -> DataFrame:
    """(by, name, kind, label) of names with a qualifier ('1 Est': kind 1, label '1 est'), for groups that keep them apart."""
    return rows.filter("name is not null").select(by, "name", names.qualified_core(F.col("name")).alias("kind"), names.key(F.col("name")).alias("label")).filter("kind <> ''").distinct()


def building_groups(rows: DataFrame, by: str, manual: DataFrame | None = None, splits: DataFrame | None = None, apart: bool = False) -> DataFrame:
    """(by, name, target, mode) of names (by, name, authority, pinned): the name each stands for, and why.

    Links of name_links that splits (by, a, b) or, with apart, different qualifiers don't forbid make the groups. A group's target is its name that links to no other, the authoritative
    or else the shortest of several. Manual targets (by, name, target) take their names out of the rules and are followed to their end, for others' targets too. mode is manual, pinned,
    master, one of RULES or distinct.
    """
    n = rows.filter("name is not null").groupBy(by, "name").agg(F.max(F.coalesce("authority", F.lit(False))).alias("authority"), F.max(F.coalesce("pinned", F.lit(False))).alias("pinned"))
    links = written(name_links(n, by), "name-links")
    if manual is not None:
        manual = written(follow(manual, by), "manual")
        links = links.join(manual.select(by, F.col("name").alias("a")), [by, "a"], "left_anti").join(manual.select(by, F.col("name").alias("b")), [by, "b"], "left_anti").select(by, "a", "b", "rank")
    none = links.select(by, "a", "b").limit(0)
    grouped = written(constrained_groups(links, none if splits is None else splits, by, qualifiers(n, by) if apart else None), "grouped")
    sources = links.select(by, F.col("a").alias("name"), "rank")
    g = n.join(grouped, [by, "name"], "left").withColumn("root", F.coalesce("root", "name")).join(sources, [by, "name"], "left")
    target = g.groupBy(by, "root").agg(F.min_by("name", F.struct(F.col("rank").isNotNull().alias("x"), (~F.col("authority")).alias("y"), F.char_length("name"), "name")).alias("target"), F.count(F.lit(1)).alias("n"))
    rule = F.element_at(F.array(*map(F.lit, RULES)), F.col("rank") + 1)
    mode = F.when(F.col("pinned"), "pinned").when(F.col("n") == 1, "distinct").when(F.col("name") == F.col("target"), "master").otherwise(F.coalesce(rule, F.lit("master")))
    done = g.join(target, [by, "root"]).select(by, "name", "target", mode.alias("mode"))
    if manual is None:
        return done
    own = manual.select(by, "name", F.col("target").alias("own"))
    on = manual.select(by, F.col("name").alias("target"), F.col("target").alias("on"))
    told = done.join(own, [by, "name"], "left").join(on, [by, "target"], "left")
    return told.select(by, "name", F.coalesce("own", "on", "target").alias("target"), F.when(F.col("own").isNotNull() | F.col("on").isNotNull(), "manual").otherwise(F.col("mode")).alias("mode"))


def _decimals(value: Column) -> Column:
    """How many decimals a number is written with, six at most."""
    return F.char_length(F.rtrim(F.element_at(F.split(F.format_string("%.6f", value), "[.]"), 2), F.lit("0")))


def contained_results(readings: DataFrame, by: str) -> DataFrame:
    """(by, name, other): buildings all of whose results are, but for rounding, results of exactly one other building that has more of them.

    readings has by, building, field, value. Two values agree when they are equal at the fewer decimals of the two; whole numbers agree only with themselves. Buildings of equal results are
    looked up once. Each set meets, by its rarest element, the sets that hold this element; the pairs that met are then compared element by element. Nulls and zeros count for nothing.
    """
    r = readings.filter("building is not null and value is not null and value <> 0").groupBy(by, "building", "field").agg(F.max("value").alias("value"))
    r = r.withColumn("value", F.round("value", 6)).withColumn("d", _decimals(F.col("value")))
    sets = written(r.groupBy(by, "building").agg(F.array_sort(F.collect_list(F.struct("field", "value", "d"))).alias("s")), "result-sets")
    # One row for each set; a set that several buildings have can't be told from others that hold it, so only the number of holders and one of them are kept.
    kinds = written(sets.groupBy(by, "s").agg(F.min("building").alias("one"), F.max("building").alias("last"), F.count(F.lit(1)).alias("n")).withColumn("size", F.size("s")).withColumn("sid", F.xxhash64("s")), "result-kinds")
    # Keys of an element: at each number of decimals up to its own, the rounded value; two elements agree when they share one that is exact for either.
    level = F.sequence(F.least("e.d", F.lit(1)), F.col("e.d"))
    keyed = kinds.select(by, "sid", "size", "n", F.explode("s").alias("e")).select(by, "sid", "size", "n", "e.field", "e.value", "e.d", F.explode(level).alias("at"))
    keyed = written(keyed.withColumn("key", F.floor(F.col("value") * F.pow(F.lit(10.0), F.col("at")) + 0.5)), "result-keys")
    use = keyed.groupBy(by, "field", "at", "key").agg(F.count(F.lit(1)).alias("used"))
    per = keyed.join(use, [by, "field", "at", "key"]).groupBy(by, "sid", "field").agg(F.sum("used").alias("used"))
    rare = per.groupBy(by, "sid").agg(F.min_by("field", F.struct("used", "field")).alias("field"))
    a = keyed.join(rare, [by, "sid", "field"]).select(by, "field", "at", "key", F.col("sid").alias("a"), F.col("size").alias("na"), (F.col("d") == F.col("at")).alias("xa"))
    b = keyed.select(by, "field", "at", "key", F.col("sid").alias("b"), F.col("size").alias("nb"), (F.col("d") == F.col("at")).alias("xb"))
    met = a.join(b, [by, "field", "at", "key"]).filter("nb > na and (xa or xb)").select(by, "a", "b", "na").distinct()
    all_a = keyed.select(by, F.col("sid").alias("a"), "field", "at", "key", (F.col("d") == F.col("at")).alias("xa"))
    all_b = keyed.select(by, F.col("sid").alias("b"), "field", "at", "key", (F.col("d") == F.col("at")).alias("xb"))
    agree = met.join(all_a, [by, "a"]).join(all_b, [by, "b", "field", "at", "key"]).filter("xa or xb").groupBy(by, "a", "b", "na").agg(F.count_distinct("field").alias("same")).filter("same = na")
    holders = agree.join(kinds.select(by, F.col("sid").alias("b"), "one", "n"), [by, "b"]).groupBy(by, "a").agg(F.sum("n").alias("n"), F.min("one").alias("other")).filter("n = 1")
    who = sets.withColumn("a", F.xxhash64("s")).select(by, F.col("building").alias("name"), "a")
    return who.join(holders, [by, "a"]).select(by, "name", "other")


def result_merges(readings: DataFrame, by: str, ranks: DataFrame | None = None, manual: DataFrame | None = None, least: int = 2) -> DataFrame:
    """(by, name, target): buildings that are one by their results: those that share at least so many equal ones and differ in none, and those contained in
    exactly one other. The target of a group is the authoritative name, then the one of most results, then the shortest (ranks: by, name, authority). Names in manual (by, name, target),
    on either side, stay as they are."""
    r = readings
    if manual is not None:
        touched = manual.select(by, F.explode(F.array("name", "target")).alias("building")).distinct()
        r = r.join(touched, [by, "building"], "left_anti")
    pairs = same_results(r, by, least).select(by, "a", "b").unionByName(contained_results(r, by).select(by, F.col("name").alias("a"), F.col("other").alias("b")))
    found = written(groups(pairs, by, "a", "b"), "result-groups")
    count = readings.filter("value is not null").groupBy(by, F.col("building").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    ranked = found.join(count, [by, "name"], "left")
    ranked = ranked.withColumn("authority", F.lit(False)) if ranks is None else ranked.join(ranks.select(by, "name", "authority"), [by, "name"], "left")
    order = F.struct((~F.coalesce("authority", F.lit(False))).alias("x"), (-F.coalesce("n", F.lit(0))).alias("y"), F.char_length("name"), "name")
    master = ranked.groupBy(by, "root").agg(F.min_by("name", order).alias("target"))
    return ranked.join(master, [by, "root"]).filter("name <> target").select(by, "name", "target")
