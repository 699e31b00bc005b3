"""Measures on plans: lengths, areas, centres, correspondence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, normalize


def _pairs(points: Column) -> Column:
    return F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, v: s + v)


def path_length(points: Column) -> Column:
    """The length of a line through points (array of x, y); 0 for fewer than two."""
    return _total(F.transform(_pairs(points), lambda p: F.hypot(p["b"]["x"] - p["a"]["x"], p["b"]["y"] - p["a"]["y"])))


def area(points: Column) -> Column:
    """The area within a closed line through points; 0 for fewer than three."""
    ring = F.concat(points, F.slice(points, 1, 1))
    twice = _total(F.transform(_pairs(ring), lambda p: p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"]))
    return F.when(F.size(points) >= 3, F.abs(twice) / 2).otherwise(0.0)


def net_area(points: Column, holes: Column) -> Column:
    """An area without its holes (an array of point arrays; null: none), never below 0."""
    return F.greatest(area(points) - F.coalesce(_total(F.transform(holes, area)), F.lit(0.0)), F.lit(0.0))


def centre(points: Column) -> Column:
    """(x, y), the mean of the points; nulls for none."""
    n = F.size(points)
    mean = lambda axis: F.try_divide(_total(F.transform(points, lambda p: p[axis])), n.cast("double"))
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def correspondence(measures: DataFrame, by: list[str], kind: str, value: str, id_col: str) -> DataFrame:
    """(by, kind, n, total, v_min, v_mean, v_max, first_id): counts are totalled, other measures described; an id leads back to the plan."""
    v = F.col(value)
    count = F.col(kind) == "count"
    g = measures.groupBy(*by, kind).agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.min(v).alias("lo"), F.avg(v).alias("m"), F.max(v).alias("hi"), F.min(id_col).alias("first_id"))
    return g.select(*by, kind, "n", F.when(count, F.col("s")).alias("total"), F.when(~count, F.col("lo")).alias("v_min"), F.when(~count, F.col("m")).alias("v_mean"), F.when(~count, F.col("hi")).alias("v_max"), "first_id")


GLAZING_HEIGHT, GLAZING_SHARE = 2.20, 0.30
# Each rule of plans, what it looks at, and its limit.
PLAN_RULES = ("visible_access", "separation", "blind_rooms", "recess", "path_width", "hall_access", "hall_glazing")


def plan_rules(measures: DataFrame, by: str) -> DataFrame:
    """(by, rule, verdict, value, uncalibrated) of measures (by, cat, kind: count, length or area, value in metres; null: the page has no scale): Oui or Non, null where nothing was measured.

    visible_access: at least 60 % of counted accesses (visible, hidden); separation: no passage between buildings; blind_rooms: none unwatched; recess: at most 1.20 m deep; path_width: at least 1.40 m;
    hall_access: exactly one; hall_glazing: frames' width times 2.20 m at least 30 % of the hall's area. Sums and extremes only, so any plan may have any number of measures.
    """
    c = F.col
    count = lambda *cats: F.sum(F.when(c("cat").isin(*cats) & (c("kind") == "count"), c("value")).otherwise(0.0))
    extreme = lambda f, cat: f(F.when((c("cat") == cat) & (c("kind") == "length"), c("value")))
    total = lambda cat, kind: F.sum(F.when((c("cat") == cat) & (c("kind") == kind), c("value")).otherwise(0.0))
    missing = lambda *cats: F.count_if(c("cat").isin(*cats) & c("value").isNull())
    g = measures.groupBy(by).agg(
        count("visible").alias("v"), count("hidden").alias("h"), count("passage").alias("p"), count("watched").alias("w"), count("unwatched").alias("u"), extreme(F.max, "recess").alias("r"), extreme(F.min, "path").alias("t"), count("access").alias("a"),
        total("hall", "area").alias("area"), total("frame", "length").alias("frame"), missing("recess").alias("mr"), missing("path").alias("mt"), missing("hall", "frame").alias("mh"),
    )
    yes = lambda test: F.when(test, "Oui").otherwise("Non")
    ratio = c("frame") * GLAZING_HEIGHT / c("area")
    row = lambda name, ok, verdict, value, lost: F.struct(F.lit(name).alias("rule"), F.when(ok, verdict).alias("verdict"), F.when(ok, value).cast("double").alias("value"), lost.cast("long").alias("uncalibrated"))
    none = F.lit(0)
    rules = [
        row("visible_access", c("v") + c("h") > 0, yes(c("v") / (c("v") + c("h")) >= 0.6), c("v") / (c("v") + c("h")), none), row("separation", c("p") > 0, F.lit("Non"), c("p"), none), row("blind_rooms", c("w") + c("u") > 0, yes(c("u") == 0), c("u"), none),
        row("recess", c("r").isNotNull(), yes(c("r") <= 1.2 + 1e-9), c("r"), c("mr")), row("path_width", c("t").isNotNull(), yes(c("t") >= 1.4 - 1e-9), c("t"), c("mt")), row("hall_access", c("a") > 0, yes(c("a") == 1), c("a"), none),
        row("hall_glazing", (c("area") > 0) & (c("frame") > 0), yes(ratio >= GLAZING_SHARE), ratio, c("mh")),
    ]
    return g.select(by, F.inline(F.array(*rules)))


def plan_facts(rows: DataFrame, op: str, plan: str) -> DataFrame:
    """(op, rule, ok) of correspondence rows (op, plan, ref, kind: width, length, area or count, avg, n, total): each plan's frames times 2.20 m to its hall, and its accesses; every plan that has them has to pass."""
    ref = fold(normalize(F.col("ref")))
    frame = F.col("kind").isin("width", "length") & ref.rlike("menuiserie|vitr|chassis")
    hall = (F.col("kind") == "area") & ref.rlike("\\bhall\\b") & ~ref.rlike("menuiserie|vitr|acces")
    size = F.coalesce(F.col("avg") * F.col("n"), F.lit(0.0))
    per = rows.groupBy(op, plan).agg(F.sum(F.when(frame, size).otherwise(0.0)).alias("w"), F.sum(F.when(hall, size).otherwise(0.0)).alias("a"), F.sum(F.when((F.col("kind") == "count") & ref.rlike("\\bacces\\b"), F.col("total"))).alias("n"))
    both = F.array_compact(F.array(F.when((F.col("w") > 0) & (F.col("a") > 0), F.struct(F.lit("hall_glazing").alias("rule"), (F.col("w") * GLAZING_HEIGHT / F.col("a") >= GLAZING_SHARE).alias("ok"))), F.when(F.col("n").isNotNull(), F.struct(F.lit("hall_access").alias("rule"), (F.col("n") == 1).alias("ok")))))
    return per.select(op, F.inline(both)).groupBy(op, "rule").agg(F.bool_and("ok").alias("ok"))


def keyword_tokens(c: Column) -> Column:
    """The sorted words of a keyword or label, singular, without 'nombre de' and articles: equal arrays mean the same column."""
    t = F.regexp_replace(F.regexp_replace(fold(normalize(c)), "['’]", " "), "^(?:nombre|nb)\\s+(?:de\\s+|d\\s+)?", "")
    words = F.transform(F.split(t, "[^a-z0-9]+"), lambda w: F.regexp_replace(w, "s$", ""))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.char_length(w) > 1) & ~w.isin("de", "du", "des", "la", "le", "les", "nombre", "nb"))))


def plan_quantities(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """rows of kind count whose keyword (ref) has the words of a label of the catalog (field, label), as facts: (rows' columns, field, value, confidence, method). The first field of equal labels counts."""
    known = catalog.select(keyword_tokens(F.col("label")).alias("_k"), "field").groupBy("_k").agg(F.min("field").alias("field"))
    r = rows.filter((F.col("kind") == "count") & F.col("total").isNotNull()).withColumn("_k", keyword_tokens(F.col("ref"))).filter("size(_k) > 0")
    # A few labels against all rows: dealt by label, the rows of one keyword would meet in one task.
    return r.join(F.broadcast(known), "_k").drop("_k").withColumn("value", F.col("total").cast("double")).withColumn("confidence", F.lit(0.99)).withColumn("method", F.lit("plan:quantity"))


# Rooms by a word of a label.
ROOMS = [("Chambre", "chambre|\\bch\\b"), ("Séjour", "sejour|salon"), ("Cuisine", "cuisine|kitchenette"), ("SDB", "salle de bains?|\\bsdb\\b|salle d'eau|\\bsde\\b"), ("WC", "\\bwc\\b|toilettes"), ("Entrée", "entree"), ("Dégagement", "degagement|\\bdgt\\b"), ("Rangement", "rangement|\\brgt\\b"),
         ("Garage", "garage"), ("Bureau", "bureau"), ("Balcon", "balcon"), ("Terrasse", "terrasse"), ("Cave", "\\bcave\\b"), ("Logement", "logement|\\blgt\\b|appartement|maison|villa")]


def plan_label(c: Column) -> Column:
    """(name, cat, typology, surface) of a label on a plan ('Logement 3 - T3 - 65,2 m²')."""
    t = F.trim(F.regexp_replace(c, "\\s+", " "))
    low = fold(normalize(t))
    area = F.regexp_extract(t, "([0-9]+(?:[.,][0-9]+)?) ?m ?[²2](?![0-9])", 1)
    kind = F.regexp_extract(t, "(?i)\\b(?:T|F) ?([0-9]{1,2})(?: ?bis)?\\b", 1)
    typology = F.when(kind != "", F.concat(F.lit("T"), kind, F.when(t.rlike("(?i)\\b[TF] ?[0-9]{1,2} ?bis\\b"), " bis").otherwise("")))
    room = F.lit(None).cast("string")
    for name, pattern in reversed(ROOMS):
        room = F.when(low.rlike(pattern), name).otherwise(room)
    name = F.trim(F.regexp_replace(F.regexp_replace(t, "[0-9]+(?:[.,][0-9]+)? ?m ?[²2](?![0-9])", ""), "^[\\s\\-–·|,;]+|[\\s\\-–·|,;]+$", ""))
    return F.struct(F.coalesce(F.nullif(name, F.lit("")), t).alias("name"), F.coalesce(room, F.when(typology.isNotNull(), "Logement")).alias("cat"), typology.alias("typology"), F.translate(area, ",", ".").try_cast("double").alias("surface"))


def length_in_metres(c: Column) -> Column:
    """A length with its unit (mm, cm or m; m without one); null for others."""
    n = F.translate(F.regexp_extract(c, "([0-9]+(?:[.,][0-9]+)?) ?(mm|cm|m)?\\b", 1), ",", ".").try_cast("double")
    unit = F.lower(F.regexp_extract(c, "(?i)[0-9] ?(mm|cm|m)\\b", 1))
    return F.when(unit == "mm", n / 1000).when(unit == "cm", n / 100).otherwise(n)


def scale(points: Column, real: Column) -> Column:
    """Metres for each point of a plan from a line of known length; null without one."""
    drawn = path_length(points)
    return F.when((drawn > 0) & (real > 0), real / drawn)


def layers(text: Column) -> Column:
    """(principal, total, several) of the insulation layers a label names ('LDV 120 + PU 80 mm', '2x150 mm'): those over 15 and up to 600 mm; nulls for none."""
    t = F.regexp_replace(text, "([0-9]),([0-9])", "$1.$2")
    groups = F.regexp_extract_all(t, F.lit("(?i)(?<![0-9.])[0-9]{1,3}(?:\\.[0-9])?(?: ?x ?[0-9]{2,3})?(?: ?\\+ ?[0-9]{1,3}(?:\\.[0-9])?)* ?mm(?![a-z])"), F.lit(0))
    one = lambda g: F.transform(F.split(F.regexp_replace(g, "(?i) ?mm", ""), " ?\\+ ?"), lambda x: F.when(x.rlike("(?i)x"), F.regexp_extract(x, "^ ?([0-9.]+)", 1).try_cast("double") * F.regexp_extract(x, "(?i)x ?([0-9]+)", 1).try_cast("double")).otherwise(F.trim(x).try_cast("double")))
    kept = F.filter(F.flatten(F.transform(groups, one)), lambda v: (v > 15) & (v <= 600))
    codes = (F.size(F.regexp_extract_all(t, F.lit("(?i)(?<![a-z])(?:IS[CD]|IT[EI]|ISO|LDV|LDR|PU|PSE|XPS|LM)(?![a-z])"), F.lit(0))) >= 2) & t.contains("+")
    none = F.size(kept) == 0
    return F.struct(F.when(~none, F.array_max(kept)).alias("principal"), F.when(~none, F.aggregate(kept, F.lit(0.0), lambda a, b: a + b)).alias("total"), (codes | (F.size(kept) > 1)).alias("several"))


def resistance(text: Column, thickness_mm: Column) -> Column:
    """R of an insulation from its thickness and the lambda its text gives (0,038 or 38), to a twentieth; null without a plausible one."""
    raw = F.translate(F.regexp_extract(text, "(?:λ|(?i)lambda)\\s*(?:=|:)?\\s*(0[.,][0-9]{2,3}|[0-9]{2})(?![0-9])", 1), ",", ".").try_cast("double")
    lam = F.when(raw >= 10, raw / 1000).otherwise(raw)
    return F.when((thickness_mm > 0) & (lam > 0.01) & (lam < 0.2), F.floor(thickness_mm / 1000 / lam / 0.05 + 0.5) * 5 / 100)


def first_match(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The label of the first rule (label, pattern) that folded text matches; null for none."""
    t = fold(normalize(text))
    out = F.lit(None).cast("string")
    for label, pattern in reversed(rules):
        out = F.when(t.rlike(pattern), label).otherwise(out)
    return out
