"""Names of buildings: keys, aliases, similar names, groups, matching against a reference, perimeter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names
from ..functions.text import fold
from ..sources.store import written

# Words that only say that a name is a building's.
GENERIC = ("batiment", "batiments", "bat", "immeuble", "bloc", "tour", "hall", "cage", "le", "la", "les", "de", "du", "des")


def name_tokens(name: Column) -> Column:
    """Folded words of a name without generic ones; numbers lose leading zeros. Null gives no words."""
    words = F.filter(F.split(F.coalesce(fold(name), F.lit("")), "[^a-z0-9]+"), lambda t: (t != "") & ~t.isin(*GENERIC))
    return F.transform(words, lambda t: F.regexp_replace(t, "^0+(?=[0-9])", ""))


def merge_key(name: Column) -> Column:
    """Words of a name in their order; equal keys are one building."""
    return F.array_join(name_tokens(name), " ")


def core_id(name: Column) -> Column:
    """The first short identifier of a name (a letter, a number, or both); null without one."""
    return F.get(F.filter(name_tokens(name), lambda t: t.rlike("^(?:[a-z]?[0-9]{1,3}|[0-9]{1,3}[a-z]|[a-z])$")), F.lit(0))


def similarity(a: Column, b: Column) -> Column:
    """1 for equal merge keys, .98 for equal words in another order, .78 where one holds all words of the other, else the Jaccard share."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(F.array_join(a, " ") == F.array_join(b, " "), 1.0).when(F.array_sort(a) == F.array_sort(b), 0.98).when((both == least) & (least > 0), 0.78).otherwise(F.coalesce(F.try_divide(both, either), F.lit(0.0)))


def similar_names(rows: DataFrame, by: str, name: str, floor: float = 0.72, cap: float = 0.97) -> DataFrame:
    """(by, name, other, score) for pairs of different names of a group that reach floor and have different merge keys.

    Only names that share a rare word are compared. With the words of each name sorted by use in the group, names of a Jaccard share
    of floor agree on one of the first few of each, and a name held by another has its rarest word there; the rest scores too low.
    Nulls and names without words meet nothing.
    """
    n = rows.select(by, F.col(name).alias("name")).distinct().withColumn("t", F.array_distinct(name_tokens(F.col("name")))).filter("size(t) > 0")
    use = n.select(by, F.explode("t").alias("w")).groupBy(by, "w").agg(F.count(F.lit(1)).alias("used"))
    ranked = n.select(by, "name", F.explode("t").alias("w")).join(use, [by, "w"]).groupBy(by, "name").agg(F.array_sort(F.collect_list(F.struct("used", "w"))).alias("r"))
    short = ranked.select(by, "name", F.explode(F.slice("r", 1, 1)).alias("k")).select(by, F.col("name"), F.col("k.w").alias("w"))
    long_ = ranked.select(by, F.col("name").alias("other"), F.explode("r").alias("k")).select(by, "other", F.col("k.w").alias("w"))
    share = 1 - floor
    prefix = ranked.select(by, "name", F.explode(F.slice(F.col("r"), F.lit(1), F.floor(F.size("r") * F.lit(share)).cast("int") + 1)).alias("k")).select(by, "name", F.col("k.w").alias("w"))
    met = short.join(long_, [by, "w"]).select(by, "name", "other").union(prefix.join(prefix.withColumnRenamed("name", "other"), [by, "w"]).select(by, "name", "other"))
    met = met.filter("name <> other").select(by, F.least("name", "other").alias("name"), F.greatest("name", "other").alias("other")).distinct()
    scored = met.withColumn("score", similarity(name_tokens(F.col("name")), name_tokens(F.col("other"))))
    return scored.filter((F.col("score") >= floor) & (F.col("score") < 1)).withColumn("score", F.least("score", F.lit(cap)))


def follow(aliases: DataFrame, by: str, hops: int = 12) -> DataFrame:
    """(by, name, target): where chains of aliases (by, name, target) end after at most hops steps; one target for each name, the least.

    Each round joins the table with itself and doubles the steps made, so twelve hops take four joins. A ring keeps the name it is at.
    """
    step = aliases.filter("name is not null and target is not null").groupBy(by, "name").agg(F.min("target").alias("target"))
    at, made = step, 1
    while made < hops:
        nxt = at.select(F.col(by).alias("_by"), F.col("name").alias("_from"), F.col("target").alias("_to"))
        at = at.join(nxt, (F.col(by) == F.col("_by")) & (F.col("target") == F.col("_from")), "left").select(by, "name", F.coalesce("_to", "target").alias("target"))
        made *= 2
    return at


def groups(links: DataFrame, by: str, a: str, b: str, rounds: int = 40) -> DataFrame:
    """(by, name, root): connected names with the least name that each reaches; names only in no link are absent.

    Least labels spread over links and then jump along themselves, so long chains take a logarithm of rounds; each round is a
    written table. Raises RuntimeError if rounds do not do.
    """
    pairs = links.select(by, F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null")
    edges = written(pairs.union(pairs.select(by, "y", "x")).distinct(), "edges")
    labels = written(edges.groupBy(by, F.col("x").alias("name")).agg(F.least(F.min("y"), F.col("name")).alias("root")), "labels")
    for _ in range(rounds):
        seen = labels.select(F.col(by).alias("_b"), F.col("name").alias("_n"), F.col("root").alias("_r"))
        near = edges.join(seen, (F.col(by) == F.col("_b")) & (F.col("y") == F.col("_n"))).groupBy(by, F.col("x").alias("name")).agg(F.min("_r").alias("low"))
        spread = labels.join(near, [by, "name"]).select(by, "name", F.col("root").alias("old"), F.least("root", "low").alias("root"))
        jumped = spread.join(seen, (F.col(by) == F.col("_b")) & (F.col("root") == F.col("_n"))).select(by, "name", "old", F.least("root", "_r").alias("root"))
        new = written(jumped, "labels")
        labels = new.drop("old")
        if new.filter("root <> old").isEmpty():
            return labels
    raise RuntimeError("groups: the labels did not settle")


def same_results(readings: DataFrame, by: str, least: int = 2) -> DataFrame:
    """(by, a, b): names that share at least so many equal results (a relative millionth) and differ in none.

    readings has by, building, field, value. Names meet on (field, cell of the value), never on the field alone; fields in which both
    have a value but not the same one are then counted for the pairs that met.
    """
    r = readings.filter("value is not null").groupBy(by, "building", "field").agg(F.max("value").alias("value"))
    # Cells of logarithms a little wider than a millionth: equal values lie in one or in neighbours, so one side enters three cells.
    cell = F.when(F.col("value") == 0, 0).otherwise(F.floor(F.ln(F.abs("value")) / 1.1e-6)).cast("bigint")
    keyed = r.withColumn("cell", cell)
    l_ = keyed.select(by, F.col("building").alias("a"), "field", F.col("value").alias("x"), "cell")
    m = keyed.select(by, F.col("building").alias("b"), "field", F.col("value").alias("y"), F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    near = F.abs(F.col("x") - F.col("y")) <= 1e-6 * F.greatest(F.abs("x"), F.abs("y"))
    equal = l_.join(m, [by, "field", "cell"]).filter((F.col("a") < F.col("b")) & near).groupBy(by, "a", "b").agg(F.count(F.lit(1)).alias("equal")).filter(F.col("equal") >= least)
    both = equal.join(l_.select(by, "a", "field"), [by, "a"]).join(keyed.select(by, F.col("building").alias("b"), "field"), [by, "b", "field"]).groupBy(by, "a", "b", "equal").agg(F.count(F.lit(1)).alias("both"))
    return both.filter("both = equal").select(by, "a", "b", "equal")


def _decided(pairs: DataFrame, by: str) -> DataFrame:
    """Of candidate pairs (by, name, target, rule) those whose rule has one candidate for the name."""
    per = pairs.groupBy(by, "name", "rule").agg(F.min("target").alias("target"), F.max("target").alias("other"))
    return per.filter("target = other").drop("other")


def match_names(found: DataFrame, reference: DataFrame, by: str, name: str = "name", target: str = "target", manual: DataFrame | None = None) -> DataFrame:
    """(by, name, target, rule): the reference name each found name stands for; names that match nothing have a null target.

    Rules in order, each decides only with exactly one candidate: 0 manual (by, name, target; a null target forbids a match), 1 exact,
    2 key, 3 core identifier, 4 letter for number where the reference has only one kind, 5 one name begins with the words of the
    other, 6 loose spelling, 7 identifier at the end, 8 truncated (eight characters or more, two at most missing), 9 the only
    building. Lists are matched by the first two alone. Every rule is an equi-join on a key of both sides.
    """
    ref = reference.select(by, names.canonical(F.col(target)).alias("target")).filter("target is not null").distinct()
    ref = ref.withColumn("r_key", names.key(F.col("target"))).withColumn("r_core", names.core(F.col("target"))).withColumn("r_match", names.match_key(F.col("target")))
    ref = written(ref, "references")
    kinds = ref.groupBy(by).agg(F.count(F.lit(1)).alias("n_ref"), F.bool_and(F.col("r_core").rlike("^[a-z]$")).alias("letters"), F.bool_and(F.col("r_core").rlike("^[0-9]{1,3}$")).alias("numbers"), F.min("target").alias("only"))
    n = found.select(by, F.col(name).alias("name")).filter("name is not null").distinct().withColumn("shown", names.canonical(F.col("name")))
    n = n.withColumn("n_key", names.key(F.col("shown"))).withColumn("n_match", names.match_key(F.col("shown"))).withColumn("last", names.last_id(F.col("shown")))
    first = F.element_at(F.split("n_key", " "), 1)
    n = n.withColumn("n_core", F.when(first.rlike(names.SHORT_ID), names.core(F.col("shown"))).otherwise("")).withColumn("list", names.is_list(F.col("name")))
    n = n.withColumn("many", fold(F.col("shown")).rlike("\\b(?:et|ou)\\b|[,&+]"))
    n = written(n.join(kinds, by), "names").filter((F.col("shown") != names.UNIQUE))
    # A number goes with the letter of its place in the alphabet, in a group that has none of its own kind.
    swapped = F.when(F.col("letters") & F.col("n_core").rlike("^[0-9]{1,2}$") & F.col("n_core").try_cast("int").between(1, 26), F.chr(96 + F.col("n_core").try_cast("int")))
    swapped = swapped.when(F.col("numbers") & F.col("n_core").rlike("^[a-z]$"), (F.ascii("n_core") - 96).cast("string"))
    words = lambda c: F.split(F.col(c), " ")
    starts = lambda c: F.transform(F.sequence(F.lit(1), F.size(words(c))), lambda i: F.array_join(F.slice(words(c), F.lit(1), i), " "))
    bare = lambda c: F.regexp_replace(F.col(c), "^(?:batiment|bat) ", "")
    cut = lambda c: F.array_distinct(F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: F.substr(bare(c), F.lit(1), F.greatest(F.char_length(bare(c)) - k, F.lit(8)))))

    def side(df: DataFrame, own: str, made: list[tuple[str, Column, Column]]) -> DataFrame:
        """(by, own, rule, key): the keys of every rule whose condition holds."""
        keyed = F.flatten(F.array(*[F.when(ok, F.transform(keys, lambda k: F.struct(F.lit(r).alias("rule"), k.alias("key")))).otherwise(F.array().cast("array<struct<rule:string,key:string>>")) for r, keys, ok in made]))
        return df.select(by, own, F.inline(F.filter(keyed, lambda x: x["key"] != "")))

    yes, single = F.lit(True), ~F.col("list")
    loose, r_loose = names.loose_key(F.col("shown")), names.loose_key(F.col("target"))
    coded = F.when(r_loose.rlike("^[a-z]{1,2}[0-9]{0,2} .{5,}$"), F.regexp_replace(r_loose, "^[a-z]{1,2}[0-9]{0,2} ", "")).otherwise("")
    left = side(n, "name", [
        ("1 exact", F.array("shown"), yes), ("2 key", F.array("n_key"), yes), ("3 core", F.array("n_core"), single), ("4 letter", F.array(F.coalesce(swapped, F.lit(""))), single),
        ("5 prefix", F.array(F.concat(F.lit("="), "n_match")), (F.char_length("n_match") >= 3) & ~F.col("many")), ("5 prefix", starts("n_match"), (F.char_length("n_match") >= 3) & ~F.col("many")),
        ("6 loose", F.array(loose), (F.char_length(loose) >= 4) & ~F.col("many")), ("7 end", F.array("last"), ~F.col("many")), ("8 truncated", cut("n_match"), F.char_length(bare("n_match")) >= 8),
    ])
    last = names.last_id(F.col("target"))
    right = side(ref, "target", [
        ("1 exact", F.array("target"), yes), ("2 key", F.array("r_key"), yes), ("3 core", F.array("r_core"), yes), ("4 letter", F.array("r_core"), yes), ("5 prefix", F.array("r_match"), yes),
        ("5 prefix", F.transform(starts("r_match"), lambda k: F.concat(F.lit("="), k)), yes), ("6 loose", F.array_distinct(F.array(r_loose, coded)), yes), ("7 end", F.array_distinct(F.array(last, F.col("r_core"))), yes),
        ("8 truncated", cut("r_match"), F.char_length(bare("r_match")) >= 8),
    ])
    met = left.join(right, [by, "rule", "key"]).select(by, "name", "rule", "target").distinct()
    # A truncated name is the beginning of the other; keys alone also meet where both were cut.
    t = met.filter("rule = '8 truncated'").join(n.select(by, "name", bare("n_match").alias("a")), [by, "name"]).join(ref.select(by, "target", bare("r_match").alias("b")), [by, "target"])
    t = t.filter((F.col("a") != F.col("b")) & (F.col("a").startswith(F.col("b")) | F.col("b").startswith(F.col("a"))) & (F.abs(F.char_length("a") - F.char_length("b")) <= 2)).select(by, "name", "rule", "target")
    cored = met.filter("rule = '3 core'").select(by, "name").distinct()
    swaps = met.filter("rule = '4 letter'").join(cored, [by, "name"], "left_anti")
    # The identifier at the end does not count where the one at the beginning is another building's.
    ends = met.filter("rule = '7 end'").join(n.select(by, "name", "n_core", "last"), [by, "name"]).join(ref.select(by, F.col("r_core").alias("n_core")).distinct().withColumn("_held", F.lit(True)), [by, "n_core"], "left")
    ends = ends.filter("n_core = '' or n_core = last or _held is null").select(by, "name", "rule", "target")
    pairs = met.filter(~F.col("rule").isin("4 letter", "7 end", "8 truncated")).unionByName(swaps).unionByName(ends).unionByName(t)
    only = found.select(by, F.col(name).alias("name")).filter("name is not null").distinct().join(kinds.filter("n_ref = 1").select(by, F.col("only").alias("target")), by)
    short = (names.canonical(F.col("name")) == names.UNIQUE) | names.match_key(names.canonical(F.col("name"))).rlike("^(?:n ?)?(?:[a-z]|[0-9]{1,2}|bat|batiment|ensemble|projet)$")
    decided = _decided(pairs, by).unionByName(only.filter(short).withColumn("rule", F.lit("9 only")))
    best = decided.groupBy(by, "name").agg(F.min_by(F.struct("target", "rule"), "rule").alias("m")).select(by, "name", "m.*")
    whole = found.select(by, F.col(name).alias("name")).filter("name is not null").distinct().join(best, [by, "name"], "left")
    if manual is None:
        return whole
    said = manual.groupBy(by, "name").agg(F.max(names.canonical(F.col("target"))).alias("_to")).join(ref.select(by, F.col("target").alias("_to"), F.lit(True).alias("_known")), [by, "_to"], "left")
    said = said.select(by, "name", F.when(F.col("_known"), F.col("_to")).alias("_said"), F.lit(True).alias("_manual"))
    whole = whole.join(said, [by, "name"], "left")
    return whole.select(by, "name", F.when(F.col("_manual"), F.col("_said")).otherwise(F.col("target")).alias("target"), F.when(F.col("_manual"), "0 manual").otherwise(F.col("rule")).alias("rule"))


def rank_names(found: DataFrame, by: str, name: str = "name", results: str = "results") -> DataFrame:
    """(by, name, doubtful, place): display names with sure ones before doubtful, those of most results first; one for each key, identifier or its letter-number twin."""
    n = found.select(by, names.canonical(F.col(name)).alias("name"), F.col(results).alias("n")).filter(F.col("name") != names.UNIQUE)
    single = names.core(F.col("name"))
    twin = F.when(single.rlike("^[a-z]$"), (F.ascii(single) - 96).cast("string")).otherwise(single)
    same = F.when(names.key(F.col("name")).contains(" "), names.key(F.col("name"))).otherwise(twin)
    per = n.withColumn("same", same).groupBy(by, "same").agg(F.max_by(F.struct("name", "n"), F.struct(F.col("n"), F.col("name"))).alias("w")).select(by, "w.*")
    order = Window.partitionBy(by).orderBy("doubtful", F.col("n").desc_nulls_last(), "name")
    return per.withColumn("doubtful", names.is_part(F.col("name"))).withColumn("place", F.row_number().over(order)).select(by, "name", "doubtful", "place")


def top_names(found: DataFrame, totals: DataFrame, by: str, total: str = "total") -> DataFrame:
    """(by, name): the first total names of a group in rank; a total of one or none given takes the only sure name, else the name for a single building."""
    t = totals.select(by, F.greatest(F.coalesce(F.floor(F.col(total)).cast("int"), F.lit(1)), F.lit(1)).alias("_n"))
    ranked = rank_names(found, by)
    sure = ranked.filter("not doubtful").groupBy(by).agg(F.count(F.lit(1)).alias("_sure"), F.min("name").alias("_one"))
    one = t.filter("_n = 1").join(sure, by, "left").select(by, F.when(F.col("_sure") == 1, F.col("_one")).otherwise(names.UNIQUE).alias("name"))
    return one.unionByName(ranked.join(t.filter("_n > 1"), by).filter("place <= _n").select(by, "name"))


def reference_perimeter(named: DataFrame, totals: DataFrame, found: DataFrame, by: str) -> DataFrame:
    """(by, name, origin): the buildings of each group. Named ones (by, name) up to the total (by, total), in the order given by
    seq; where they are fewer, the best ranked found names that match none of them; a group without names has its total's best.

    named: by, name, seq; totals: by, total (null: as many as are named); found: by, name, results.
    """
    split = named.select(by, "seq", F.posexplode(names.split_group(F.col("name"))).alias("part", "one")).select(by, "seq", "part", names.canonical(F.col("one")).alias("name"))
    own = split.groupBy(by, "name").agg(F.min(F.struct("seq", "part")).alias("at")).withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("at", "name"))).drop("at")
    n = own.groupBy(by).agg(F.count(F.lit(1)).alias("_m")).join(totals.select(by, F.floor("total").cast("int").alias("_t")), by, "full")
    n = n.select(by, F.coalesce("_m", F.lit(0)).alias("_m"), F.greatest(F.coalesce("_t", "_m"), F.lit(1)).alias("_n"))
    kept = own.join(n, by).filter("place <= _n").select(by, "name", F.lit("named").alias("origin"))
    short = n.filter("_m > 0 and _m < _n")
    fits = match_names(found, kept.withColumnRenamed("name", "target"), by).filter("target is not null and rule <> '9 only'").select(by, "name")
    spare = rank_names(found.join(fits, [by, "name"], "left_anti"), by).join(kept.select(by, "name"), [by, "name"], "left_anti")
    spare = spare.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy("place"))).join(short, by).filter("_k <= _n - _m").select(by, "name", F.lit("found").alias("origin"))
    counted = top_names(found, n.filter("_m = 0").select(by, F.col("_n").alias("total")), by).withColumn("origin", F.lit("counted"))
    return kept.unionByName(spare).unionByName(counted)


def perimeter(rows: DataFrame, targets: DataFrame, by: str, shared: Column) -> DataFrame:
    """rows (by, building, field, value) within targets (by, building): own rows stay; rows of other names that are shared go to every
    target without an own value of the field, others go to review; the column fate says which (own, shared, review)."""
    t = targets.select(by, "building").distinct()
    own = rows.join(t, [by, "building"], "left_semi").withColumn("fate", F.lit("own"))
    other = rows.join(t, [by, "building"], "left_anti")
    fan = other.filter(shared).drop("building").join(t, by).join(own.select(by, "building", "field").distinct(), [by, "building", "field"], "left_anti").withColumn("fate", F.lit("shared"))
    return own.unionByName(fan).unionByName(other.filter(~F.coalesce(shared, F.lit(False))).withColumn("fate", F.lit("review")))
