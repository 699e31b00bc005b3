"""Facts from texts by declarative rules, tags and labels: expressions on the document's row, no shuffle and no Python."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import fr_number
from ..functions.text import fold

FACT = "array<struct<rule:string,field:string,section:string,value_num:double,value_text:string,confidence:double>>"


@dataclass(frozen=True)
class Rule:
    """One extraction rule. Gates look at the folded text; section_start may capture the section's name in its first group."""

    id: str
    field: str
    regex: str = ""
    group: int = 1
    kind: str = "number"  # number, text or constant
    confidence: float = 0.9
    doc_types: tuple[str, ...] = ()
    require_any: tuple[str, ...] = ()
    forbid_any: tuple[str, ...] = ()
    max_matches: int = 20
    selection: str = "first"  # first, all, min or max
    section_start: str | None = None
    section_end: str | None = None
    constant: str | None = None


def check_rules(rules: list[Rule]) -> list[str]:
    """What is wrong with a list of rules: repeated ids, unknown kinds or selections, missing or overlong patterns."""
    wrong = [f"{r.id}: repeated id" for i, r in enumerate(rules) if any(r.id == o.id for o in rules[:i])]
    for r in rules:
        if r.kind not in ("number", "text", "constant") or r.selection not in ("first", "all", "min", "max"):
            wrong.append(f"{r.id}: unknown kind or selection")
        if r.kind == "constant" and r.constant is None:
            wrong.append(f"{r.id}: a constant rule needs its constant")
        if r.kind != "constant" and not 0 < len(r.regex) <= 1200:
            wrong.append(f"{r.id}: pattern missing or longer than 1200")
        if r.selection in ("min", "max") and r.kind != "number":
            wrong.append(f"{r.id}: min and max are for numbers")
    return wrong


def _gate(norm: Column, doc_type: Column, r: Rule, among: bool = False) -> Column:
    ok = F.lit(True)
    if r.doc_types and among:
        own = F.lit(False)
        for t in r.doc_types:
            own = own | doc_type.contains(f" {t} ")
        ok = ok & own
    elif r.doc_types:
        ok = ok & doc_type.isin(*r.doc_types)
    for words, wanted in ((r.require_any, True), (r.forbid_any, False)):
        if words:
            hit = F.lit(False)
            for w in words:
                hit = hit | norm.contains(w)
            ok = ok & (hit if wanted else ~hit)
    return ok


def sections(text: Column, start: str, end: str | None) -> Column:
    """Array of (name, body): what follows each match of start, up to end or the next start; the name is start's first group."""
    parts = F.split(text, start)
    names = F.regexp_extract_all(text, F.lit(start), F.lit(1 if "(" in start.replace("(?", "") else 0))
    body = (lambda b: F.split(b, end, 2)[0]) if end else (lambda b: b)
    return F.zip_with(names, F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda n, b: F.struct(n.alias("name"), body(b).alias("body")))


def _matches(text: Column, r: Rule) -> Column:
    number = r.kind == "number"
    fact = lambda name, n, t: F.struct(F.lit(r.id).alias("rule"), F.lit(r.field).alias("field"), name.alias("section"), n.alias("value_num"), t.alias("value_text"), F.lit(r.confidence).alias("confidence"))
    no_number, no_text = F.lit(None).cast("double"), F.lit(None).cast("string")
    if r.kind == "constant":
        return F.array(fact(F.lit(""), no_number, F.lit(r.constant)))

    def of(name, body):
        found = F.slice(F.regexp_extract_all(body, F.lit(r.regex), F.lit(r.group)), 1, r.max_matches)
        values = F.filter(F.transform(found, fr_number), lambda v: v.isNotNull()) if number else F.filter(found, lambda v: v != "")
        if r.constant is not None:  # the text that stands for any match
            values = F.transform(values, lambda _: F.lit(r.constant))
        if r.selection == "first":
            values = F.slice(values, 1, 1)
        elif r.selection in ("min", "max"):
            best = F.array_min(values) if r.selection == "min" else F.array_max(values)
            values = F.array_compact(F.array(best))
        return F.transform(values, lambda v: fact(name, v if number else no_number, no_text if number else v))

    if r.section_start:
        return F.flatten(F.transform(sections(text, r.section_start, r.section_end), lambda s: of(s["name"], s["body"])))
    return of(F.lit(""), text)


def facts(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text", type_col: str | None = None, among: bool = False) -> DataFrame:
    """(doc_id, seq, rule, field, section, value_num, value_text, confidence) of all rules in one pass over the texts.

    A null text gives no facts. Repeated rows give their facts once each. Raises ValueError on faulty rules. With among the type column names several types, each between spaces.
    """
    wrong = check_rules(rules)
    if wrong:
        raise ValueError("; ".join(wrong))
    doc_type = F.col(type_col) if type_col else F.lit("")
    d = docs.filter(F.col(text_col).isNotNull())
    # Behind an explode, the folded text and the type are computed once a row and not once a rule; the folded text only for rules that look at it.
    norm = fold(F.col(text_col)) if any(r.require_any or r.forbid_any for r in rules) else F.lit("")
    d = d.select(F.col(id_col).alias("doc_id"), F.explode(F.array(F.struct(F.col(text_col).alias("_t"), norm.alias("_n"), doc_type.alias("_d")))).alias("_o")).select("doc_id", "_o.*")
    nothing = F.array().cast(FACT)
    # Rules in a row that have the same gate pass it together.
    gates = groupby(rules, lambda r: (r.doc_types, r.require_any, r.forbid_any))
    packs = [list(g) for _, g in gates]
    found = F.array(*[F.when(_gate(F.col("_n"), F.col("_d"), g[0], among), F.flatten(F.array(*[_matches(F.col("_t"), r).cast(FACT) for r in g]))).otherwise(nothing) for g in packs])
    return d.select("doc_id", F.posexplode(F.flatten(found)).alias("seq", "_f")).select("doc_id", "seq", "_f.*")


def tagged(docs: DataFrame, tags: dict[str, list[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, field, idx, value, confidence): lines that start with a tag and a separator; an empty value is read from the next line unless that is a tag too."""
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c))
    tag = {f: "|".join(plain(t).replace(" ", "\\s+") for t in ts) for f, ts in tags.items()}
    any_tag = f"^\\s*(?:{'|'.join(tag.values())})\\s*[:=]"
    d = docs.select(F.col(id_col).alias("doc_id"), F.split(F.coalesce(F.col(text_col), F.lit("")), "\n").alias("_l"))

    def scan(t, i):
        nxt = F.get(F.col("_l"), i + 1)
        out = []
        for f, p in tag.items():
            start = F.char_length(F.regexp_extract(fold(t), f"^\\s*(?:{p})\\s*[:=]", 0))
            own = F.trim(F.substr(t, start + 1))
            value = F.when(own != "", own).when(~F.coalesce(fold(nxt), F.lit("")).rlike(any_tag), F.trim(nxt))
            out.append(F.when(fold(t).rlike(f"^\\s*(?:{p})\\s*[:=]"), F.struct(F.lit(f).alias("field"), i.alias("idx"), value.alias("value"))))
        return F.array_compact(F.array(*out))

    found = F.filter(F.flatten(F.transform("_l", scan)), lambda x: x["value"] != "")
    return d.select("doc_id", F.inline(found)).withColumn("confidence", F.lit(0.915))


# Words that negate what follows, words that end a negation, words of a choice; how far a negation reaches.
NEGATIONS, STOPS, CHOICES, REACH = "non|sans|aucune?|pas de|pas d", "avec|mais|sauf|hormis", "retenue?|choisie?|selection|mention|label|option|exigence", 28


def presence(docs: DataFrame, tags: dict[str, list[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, field, idx, value, confidence): lines that mention a field by one of its tags (three characters or more): 'Oui', or 'Non' where every mention is negated.

    A negation reaches over 28 characters, up to a comma, a bar, a full stop or a stop word ('sans VMC, avec CTA': no and yes). Lines with a word of a choice are surer. Null texts
    mention nothing.
    """
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFD", re.sub("['’]", " ", t.lower())) if not unicodedata.combining(c))
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    clean = lambda t: F.trim(F.regexp_replace(F.regexp_replace(fold(t), "['’]", " "), "\\s+", " "))
    d = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.transform(lines, lambda t: clean(t))).alias("idx", "t"))
    # Behind an explode, a line's clauses are cut once.
    clauses = F.split("t", f"[,;|.]|\\b(?={STOPS}\\b)")
    d = d.select("doc_id", "idx", F.col("t").rlike(f"\\b(?:{CHOICES})").alias("choice"), F.explode(F.array(clauses)).alias("clauses"))
    rows = []
    for field, words in tags.items():
        pattern = "|".join(sorted((re.escape(plain(w)) for w in words if len(w) >= 3), key=len, reverse=True))
        if not pattern:
            continue
        # Of each clause, what stands before the first mention tells whether it is negated.
        before = F.transform(F.filter("clauses", _mentions(pattern)), _before(pattern))
        rows.append(F.struct(F.lit(field).alias("field"), before.alias("before")))
    found = d.select("doc_id", "idx", "choice", F.explode(F.array(*rows)).alias("m")).filter("size(m.before) > 0")
    negated = F.forall("m.before", lambda b: b.rlike(f"(?:^|[^a-z0-9])(?:{NEGATIONS})[^a-z0-9].{{0,{REACH}}}$"))
    return found.select("doc_id", "m.field", "idx", F.when(negated, "Non").otherwise("Oui").alias("value"), F.when(F.col("choice"), 0.90).otherwise(0.82).alias("confidence"))


def _mentions(pattern: str):
    return lambda clause: clause.rlike(f"(?<![a-z0-9])(?:{pattern})")


def _before(pattern: str):
    return lambda clause: F.element_at(F.split(clause, f"(?<![a-z0-9])(?:{pattern})", 2), 1)


def value_after(text: Column, label: str, within: int = 90) -> Column:
    """The first number within so many characters after a label; null without one."""
    return fr_number(F.regexp_extract(text, f"(?is){label}([^0-9]{{0,{within}}}?[0-9][0-9 .,]*)", 1))


def classify(norm: Column, scores: list[tuple[str, str, float]], damping: list[tuple[str, str, float]] = (), none: str = "generic") -> Column:
    """(doc_type, score, confidence): weights of all matching patterns (type, pattern, weight) added by type, damped by the factors
    of matching (type, pattern, factor), the largest type wins, the first name among equals; none where nothing matches."""
    types = sorted({t for t, _, _ in scores})
    each = []
    for t in types:
        s = F.lit(0.0)
        for kind, pattern, w in scores:
            if kind == t:
                s = s + F.when(norm.rlike(pattern), F.lit(float(w))).otherwise(0.0)
        for kind, pattern, factor in damping:
            if kind == t:
                s = s * F.when(norm.rlike(pattern), F.lit(float(factor))).otherwise(1.0)
        each.append(F.struct((-s).alias("minus"), F.lit(t).alias("type")))
    best = F.array_min(F.array(*each))
    score = -best["minus"]
    return F.when(score > 0, F.struct(best["type"].alias("doc_type"), score.alias("score"), F.least(F.lit(0.98), 0.4 + score / 20).alias("confidence"))).otherwise(
        F.struct(F.lit(none).alias("doc_type"), F.lit(0.0).alias("score"), F.lit(0.0).alias("confidence"))
    )


def vote(folder: Column, name: Column, page: Column, whole: Column) -> Column:
    """(doc_type, doubt) from four opinions (null: none): page and name agree, else folder and any other, else the whole text, else the first there is."""
    agree = F.when(page == name, page).when((folder == page) | (folder == name), folder).when(whole == page, page).when(whole == name, name)
    settled = F.coalesce(agree, whole, page, name, folder, F.lit("generic"))
    return F.struct(settled.alias("doc_type"), F.when(agree.isNull(), F.concat_ws(" / ", folder, name, page, whole)).alias("doubt"))
