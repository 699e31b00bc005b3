"""Search over whole texts: terms, criteria with their absence policy, themes. All on the document's row, without a shuffle."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import as_double, mask_rules, number_with_unit, numbers_in
from ..functions.text import fold
from .layouts import _once


def _plain(term: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", term.lower()) if not unicodedata.combining(c))


def term_pattern(term: str) -> str | None:
    """The pattern of a term on folded text: re: gives it as it is; else spaces and hyphens are alike, a plural s or x may follow,
    and no letter or digit may adjoin. None for an empty or invalid term."""
    if term.startswith("re:"):
        try:
            re.compile(term[3:])
        except re.error:
            return None
        return term[3:] or None
    words = [w for w in re.split(r"[\s-]+", _plain(term)) if w]
    return "(?:^|[^a-z0-9])" + r"[\s-]+".join(re.escape(w) + "[sx]?" for w in words) + "(?:[^a-z0-9]|$)" if words else None


def any_term(norm: Column, terms: tuple[str, ...]) -> Column:
    """Whether folded text has one of the terms; false where no term is valid."""
    found = [p for p in map(term_pattern, terms) if p]
    return norm.rlike("|".join(f"(?:{p})" for p in found)) if found else F.lit(False)


@dataclass(frozen=True)
class Criterion:
    """What to look for: a line with a keyword (or a weak one, which alone speaks against) and no excluded term, none within a line of it from exclude_near, with a context term
    within window lines (or in the sentence). A term of contrary_near there speaks against; all_of have to be there; of a number, one in the range."""

    id: str
    theme: str
    keywords: tuple[str, ...]
    exclude: tuple[str, ...] = ()
    context: tuple[str, ...] = ()
    negative: tuple[str, ...] = ()
    window: int = 0
    kind: str = "presence"  # presence, number, text, stats or field
    low: float = float("-inf")
    high: float = float("inf")
    unit: str | None = None
    required: bool = False
    inferred: bool = False  # a read document without the term means that it is absent
    weak: tuple[str, ...] = ()
    exclude_near: tuple[str, ...] = ()
    contrary_near: tuple[str, ...] = ()
    all_of: tuple[str, ...] = ()
    sentence: bool = False
    inverse: bool = False  # what is found speaks against
    field: str | None = None


def normalized(rows: list[dict]) -> list[Criterion]:
    """Criteria of a stored grid: unknown keys are left out, texts become lists at ; and line ends, numbers are read, empty ones are open; later ids replace earlier ones."""
    known = Criterion.__dataclass_fields__
    lists = {k for k, f in known.items() if str(f.type).startswith("tuple")}
    out: dict[str, Criterion] = {}
    for row in rows:
        made = {}
        for k, v in row.items():
            if k not in known or v is None:
                continue
            if k in lists:
                v = tuple(x.strip() for x in (re.split(r"[;\n]", v) if isinstance(v, str) else v) if x and x.strip())
            elif k in ("low", "high"):
                v = float(str(v).replace(",", ".")) if str(v).strip() else {"low": float("-inf"), "high": float("inf")}[k]
            made[k] = v
        if made.get("id"):
            out[made["id"]] = Criterion(**{"theme": "", "keywords": (), **made})
    return list(out.values())


#: What a line says: nothing, against, for.
NOTHING, AGAINST, FOR = 0, 1, 2


def _marks(c: Criterion) -> Column:
    """(i, says, value, denied) of the lines that have a keyword or a term of denial: their place, what they say, their number in the range or else the first one.

    Patterns on the keywords run over all lines; everything else only over those found. Each step is a transform of its own, so nothing in it is evaluated twice.
    """
    lines = F.col("_l")
    some = F.filter(F.transform(lines, lambda t, i: F.struct(i.alias("i"), t.alias("t"))), lambda x: any_term(x["t"], (*c.keywords, *c.weak, *c.negative)))
    some = F.transform(some, lambda x: F.struct(x["i"].alias("i"), x["t"].alias("t"), any_term(x["t"], c.keywords).alias("strong"), any_term(x["t"], c.negative).alias("denied")))
    some = F.transform(some, lambda x: F.struct(x["i"].alias("i"), x["t"].alias("t"), x["denied"].alias("denied"), (any_term(x["t"], c.weak) & ~x["strong"]).alias("weak"), ((x["strong"] | any_term(x["t"], c.weak)) & ~any_term(x["t"], c.exclude)).alias("ok")))

    def found(x: Column) -> Column:
        t, after = x["t"], F.get(lines, x["i"] + 1)
        captured = [p[3:] for p in c.keywords if p.startswith("re:") and re.compile(p[3:]).groups]
        found = number_with_unit(t, c.unit) if c.unit else numbers_in(t)
        for p in captured:
            own = F.array_compact(F.transform(F.regexp_extract_all(t, F.lit(p), F.lit(1)), as_double))
            found = F.when(F.size(own) > 0, own).otherwise(found)
        if c.kind == "number":  # a label without a digit goes with the number on the next line
            follow = number_with_unit(after, c.unit) if c.unit else numbers_in(after)
            found = F.when((F.size(found) == 0) & ~t.rlike("[0-9]") & after.isNotNull(), follow).otherwise(found)
        return found

    def hit(x: Column) -> Column:
        t, i, ok, against = x["t"], x["i"], x["ok"], x["weak"]
        before, after = F.get(lines, i - 1), F.get(lines, i + 1)
        if c.exclude_near:
            ok = ok & ~F.coalesce(any_term(before, c.exclude_near), F.lit(False)) & ~F.coalesce(any_term(after, c.exclude_near), F.lit(False))
        if c.sentence:
            led = F.coalesce(before.rlike(":\\s*$"), F.lit(False))
            open_ = ~t.rlike("[.:;]\\s*$") & after.isNotNull() & ~F.coalesce(after.rlike("^\\s*(?:[0-9]+[.-])+[0-9]*\\s|^\\s*[0-9]+(?:\\.[0-9]+)+\\b"), F.lit(False))
            near = F.filter(F.when(led, F.array(before, t)).when(open_, F.array(t, after)).otherwise(F.array(t)), lambda x: (x == t) | ~any_term(x, c.exclude))
        else:
            start = F.greatest(i - c.window, F.lit(0))
            near = F.slice(lines, start + 1, i + c.window + 1 - start)
        if c.contrary_near:
            contrary = F.exists(near, lambda x: any_term(x, c.contrary_near))
            against = against | contrary
        if c.context:
            there = F.exists(near, lambda x: any_term(x, c.context))
            ok = ok & (there | contrary if c.contrary_near else there)
        for term in c.all_of:
            against = against | ~_near_has(near, term)
        value = F.lit(None).cast("double")
        if c.kind in ("number", "stats"):
            value = F.coalesce(F.get(x["inside"], F.lit(0)), F.get(x["found"], F.lit(0)) if c.kind == "number" else F.lit(None).cast("double"))
            ok = ok & value.isNotNull()
            against = against | (F.size(x["inside"]) == 0)
        return F.struct(i.alias("i"), F.when(ok & ~x["denied"], F.when(against, AGAINST).otherwise(FOR)).otherwise(NOTHING).alias("says"), value.alias("value"), x["denied"].alias("denied"))

    if c.kind in ("number", "stats"):
        kept = ("i", "t", "denied", "weak", "ok")
        some = F.transform(some, lambda x: F.struct(*[x[k].alias(k) for k in kept], found(x).alias("found")))
        some = F.transform(some, lambda x: F.struct(*[x[k].alias(k) for k in (*kept, "found")], F.filter(x["found"], lambda v: v.between(c.low, c.high)).alias("inside")))
    return F.transform(some, hit)


def _near_has(near: Column, term: str) -> Column:
    return F.exists(near, lambda x: any_term(x, (term,)))


def grid(docs: DataFrame, criteria: list[Criterion], id_col: str = "doc_id", text_col: str = "text", evidences: int = 5, values: int = 2000) -> DataFrame:
    """(doc_id, criterion, theme, required, status, first_line, n_lines, contrary, values, lines) for every document and criterion.

    status: PRESENT; ABSENT_EXPLICIT where a line has a negative term; for kinds other than presence NOT_GIVEN; ABSENT_INFERRED if the criterion allows it, there is text and nothing
    speaks against; else UNDETERMINED. An inverse criterion is never present: what it finds is contrary. Null texts are never read, so nothing is inferred from them. values are
    the numbers found (of stats those in the range, up to `values`), lines the first `evidences` lines. Criteria of kind field are left to field_criteria.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).isNotNull().alias("_read"), F.col(text_col).alias("_text"))
    d = _once(d, _l=F.split(fold(F.coalesce(F.col("_text"), F.lit(""))), "\n")).drop("_text")
    asked = [c for c in criteria if c.kind != "field"]
    d = _once(d, **{f"_m{k}": _marks(c) for k, c in enumerate(asked)})
    d = _once(d, **{f"_a{k}": F.filter(f"_m{k}", lambda m: m["says"] > NOTHING) for k in range(len(asked))})
    d = _once(d, **{f"_y{k}": F.filter(f"_a{k}", lambda m: m["says"] == FOR) for k in range(len(asked))})
    out = []
    for k, c in enumerate(asked):
        at, yes = F.col(f"_a{k}"), F.col(f"_y{k}")
        seen = (F.size(yes) > 0) if not c.inverse else F.lit(False)
        contrary = (F.size(at) > 0) & ((F.size(yes) == 0) if not c.inverse else F.lit(True))
        nothing = F.when(F.lit(c.kind != "presence"), "NOT_GIVEN").when(F.lit(c.inferred and not c.inverse) & F.col("_read") & ~contrary, "ABSENT_INFERRED").otherwise("UNDETERMINED")
        denied = F.exists(f"_m{k}", lambda m: m["denied"]) & F.lit(not c.inverse)
        status = F.when(seen, "PRESENT").when(denied, "ABSENT_EXPLICIT").otherwise(nothing)
        numbers = F.slice(F.array_compact(F.transform(yes if c.kind == "stats" else at, lambda m: m["value"])), 1, values)
        shown = F.slice(F.transform(at, lambda m: F.get("_l", m["i"])), 1, evidences)
        out.append(F.struct(F.lit(c.id).alias("criterion"), F.lit(c.theme).alias("theme"), F.lit(c.required).alias("required"), status.alias("status"), F.get(yes, F.lit(0))["i"].alias("first_line"), F.size(yes).alias("n_lines"), contrary.alias("contrary"), numbers.alias("values"), shown.alias("lines")))
    return d.select("doc_id", F.inline(F.array(*out)))


def field_criteria(finals: DataFrame, criteria: list[Criterion], by: str = "operation") -> DataFrame:
    """(by, criterion, theme, required, status, contrary, values): criteria of kind field on the values finally kept (by, building, field, value_num): present where one lies in the range, contrary where none does; not given without any."""
    out = []
    for c in criteria:
        if c.kind == "field":
            v = F.when(F.col("field") == c.field, F.col("value_num"))
            inside = v.between(c.low, c.high)
            out.append(F.struct(F.lit(c.id).alias("criterion"), F.lit(c.theme).alias("theme"), F.lit(c.required).alias("required"), v.alias("v"), inside.alias("inside")))
    f = finals.select(by, F.inline(F.array(*out))).groupBy(by, "criterion", "theme", "required").agg(F.count("v").alias("n"), F.count_if("inside").alias("k"), F.min("v").alias("v_min"), F.max("v").alias("v_max"))
    status = F.when(F.col("k") > 0, "PRESENT").otherwise("NOT_GIVEN")
    return f.select(by, "criterion", "theme", "required", status.alias("status"), ((F.col("n") > 0) & (F.col("k") == 0)).alias("contrary"), "n", "v_min", "v_max")


def themes(found: DataFrame, least: int = 1, applicable_if: dict[str, str] | None = None, by: str = "doc_id") -> DataFrame:
    """(by, theme, n_found, ok): all required criteria and at least so many of any are present; ok is null where the theme's gate (applicable_if: theme to criterion) is not."""
    here = F.col("status") == "PRESENT"
    per = found.groupBy(by, "theme").agg(F.count_if(here).alias("n_found"), (F.bool_and(~F.col("required") | here) & (F.count_if(here) >= least)).alias("ok"))
    if not applicable_if:
        return per
    gates = found.filter(F.col("criterion").isin(*applicable_if.values()) & here).select(by, F.col("criterion").alias("_gate")).distinct()
    gate = F.create_map(*[x for k, v in applicable_if.items() for x in (F.lit(k), F.lit(v))])[F.col("theme")]
    j = per.withColumn("_gate", gate).join(gates.withColumn("_open", F.lit(True)), [by, "_gate"], "left")
    return j.select(by, "theme", "n_found", F.when(F.col("_gate").isNull() | F.col("_open"), F.col("ok")).alias("ok"))


def cell(kind: str, manual: Column, status: Column, contrary: Column, values: Column, text: Column, inverse: bool = False) -> Column:
    """What a criterion's cell shows: the decision by hand, else what speaks against, else an absence that may be told, else the numbers, the text, or Oui."""
    numbers = F.array_join(F.transform(F.array_distinct(values), lambda v: F.regexp_replace(F.format_string("%.6f", v), "\\.?0+$", "")), " ; ")
    against = F.lit("Indice contraire") if inverse else F.lit("Non conforme") if kind == "presence" else F.concat(F.lit("Hors seuil ("), numbers, F.lit(")"))
    shown = numbers if kind in ("number", "stats", "field") else text if kind == "text" else F.lit("Oui")
    return F.coalesce(F.nullif(manual, F.lit("")), F.when(contrary, against).when(status == "ABSENT_EXPLICIT", "Absent (écrit)").when(status == "ABSENT_INFERRED", "Absent (déduit)").when(status == "PRESENT", shown).otherwise(""))


# Words that widen a query, by the word of the query that calls for them.
SYNONYMS = {
    "toiture": ("toiture", "plancher haut", "combles"), "facade": ("facade", "mur", "paroi verticale"), "chaudiere": ("chaudiere", "chauffage"), "isolation": ("isolation", "isolant", "thermique"), "cep": ("cep", "coefficient cep", "consommations annuelles par poste"),
    "surface": ("shab", "sref", "surface habitable", "surface de reference", "surface utile", "surt", "srt", "surface du batiment"), "ic energie": ("ic energie", "energie ce"), "ic composants": ("ic composants", "iccomposant"),
}
# What the context of a query on these must have, and where its value stands.
INTENTS = {
    "surface": ("\\b(?:shab|sref|surt|srt|surface)\\b", "\\bshab\\b|\\bs ?ref\\b|\\bsurt\\b|\\bsrt\\b|surface (?:habitable|utile|reglementaire|thermique|(?:de )?reference|(?:totale )?du batiment)", "(?:\\bshab\\b|\\bs ?ref\\b|\\bsurt\\b|\\bsrt\\b|surface (?:habitable|utile|reglementaire|thermique|(?:de )?reference|(?:totale )?du batiment))[^0-9|]{0,35}([-+]?[0-9]+(?: [0-9]{3})*(?:[,.][0-9]+)?)", 20.0, 250000.0),
    "cep": ("\\bcep\\b|cep ?,? ?nr", "\\bcep\\b|consommations? annuelles? par poste", "(?:^|\\| ?)(?:coefficient )?cep\\b[^0-9|]{0,35}([-+]?[0-9]+(?:[,.][0-9]+)?)", -100.0, 5000.0),
    "ic": ("\\bic (?:energie|composants?)\\b", "\\bic (?:energie|composants?)\\b|energie \\( ?ce ?\\)", "\\bic (?:energie|composants?) ?(?:=|:)? ?([-+]?[0-9]+(?:[,.][0-9]+)?)", 0.0, 100000.0),
}


def free_search(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text", around: int = 4, most: int = 150) -> DataFrame:
    """(doc_id, idx, value, score, confidence, excerpt) of the best lines for a query in plain words, the first of equal values of a document, up to `most`.

    A line counts by its context of `around` lines on both sides: the best share of the words of the query or of one of its synonyms that stand there, at least a half. A probable number adds .08 and
    all words of the query .06 (headings lose .18 in rank); the confidence .46 + .46 share + these has to reach .90. A query on surfaces, Cep or Ic only takes contexts that name them and a value there.
    Each line is reduced to a bitmap of the query's words, so contexts are bits of neighbours: no shuffle before the best are drawn.
    """
    q = " ".join(_plain(query).split())
    variants = [q, *[v for key, words in SYNONYMS.items() if key in q or (key == "surface" and re.search(INTENTS["surface"][0], q)) for v in words]]
    split = lambda v: [w for w in re.split(r"[^a-z0-9]+", v) if len(w) > 1 or w == "ic"]
    parts = [p for p in dict.fromkeys(tuple(split(v)) for v in variants) if p]
    words = sorted({w for p in parts for w in p})
    if not words or len(words) > 62:
        raise ValueError("a query needs between one and 62 words")
    intent = next((k for k, (asked, *_) in INTENTS.items() if re.search(asked, q)), None)
    d = docs.select(F.col(id_col).alias("doc_id"), F.split(fold(F.coalesce(F.col(text_col), F.lit(""))), "\n").alias("_l"))
    d = d.withColumn("_m", F.transform("_l", lambda t: _bits(t, words)))
    span = lambda col, i: F.slice(F.col(col), F.greatest(i - around, F.lit(0)) + 1, i + around + 1 - F.greatest(i - around, F.lit(0)))
    d = d.withColumn("_c", F.transform("_m", lambda _, i: F.aggregate(span("_m", i), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))))
    share = lambda mask, p: F.bit_count(mask.bitwiseAND(F.lit(sum(1 << words.index(w) for w in set(p))))) / float(len(set(p)))
    best = F.transform("_c", lambda m: F.array_max(F.array(*[share(m, p) for p in parts])))
    rows = d.withColumn("_b", best).select("doc_id", F.inline(F.filter(F.transform("_b", lambda b, i: F.struct(i.alias("idx"), b.alias("share"), F.get("_c", i).alias("mask"), F.get("_l", i).alias("line"), F.array_join(span("_l", i), " | ").alias("context"))), lambda x: x["share"] >= 0.5)))
    heading = F.col("line").rlike("^(?:chapitre|section|partie) [0-9]+\\b|^[0-9]+(?:\\.[0-9]+)+\\.?\\s+|logiciel et version|version\\s*:")
    line, context = mask_rules(F.col("line")), mask_rules(F.col("context"))
    last = lambda c: F.try_element_at(numbers_in(c), F.lit(-1))
    number = F.coalesce(last(line), last(context))
    if intent:
        _, named, where, low, high = INTENTS[intent]
        rows = rows.filter(F.col("context").rlike(named))
        told = as_double(F.nullif(F.regexp_extract(context, where, 1), F.lit("")))
        number = F.when(told.between(low, high), told)
    rows = rows.withColumn("value", F.when(~heading, number)).withColumn("heading", heading)
    if intent:
        rows = rows.filter("value is not null")
    bonus = F.when(F.col("value").isNotNull(), 0.08).otherwise(0.0) + F.when(share(F.col("mask"), parts[0]) >= 0.99, 0.06).otherwise(0.0)
    rows = rows.withColumn("score", F.col("share") + bonus - F.when(F.col("heading"), 0.18).otherwise(0.0)).withColumn("confidence", F.least(F.lit(0.98), 0.46 + 0.46 * F.col("share") + bonus)).filter(F.col("confidence") >= 0.90 - 1e-9)
    first = F.struct((-F.round("score", 9)).alias("a"), (-F.round("confidence", 9)).alias("b"), F.col("idx"))
    kept = rows.groupBy("doc_id", "value").agg(F.min_by(F.struct("idx", "score", "confidence", F.substring("context", 1, 420).alias("excerpt")), first).alias("w")).select("doc_id", "w.idx", "value", "w.score", "w.confidence", "w.excerpt")
    return kept.orderBy(F.round("score", 9).desc(), F.round("confidence", 9).desc(), "doc_id", "idx").limit(most)


def _bits(t: Column, words: list[str]) -> Column:
    """Which words stand in a line, as bits."""
    return sum((F.when(t.rlike(f"(?:^|[^a-z0-9]){w}(?:[^a-z0-9]|$)"), F.lit(1 << k)).otherwise(F.lit(0)) for k, w in enumerate(words)), F.lit(0).cast("long"))
