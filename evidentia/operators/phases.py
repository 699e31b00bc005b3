"""Reports whose lines mean something only by what stands before them: chapters, phases, buildings, blocks.

A layout is a signature, marks and readings. A mark is a line that sets a state from there on ("RESULTATS DE L'ETAT INITIAL" sets the phase, "Batiment n° 2 : B" the building,
a heading the block) and may clear others; a reading is a line that gives values in some state. Lines are matched on their document's row; only lines that bear a
mark or a reading go on, and the states run over them as window frames (the last value that was set, by document). So neither the order of the phases nor text between them matters.

A reading's line is chosen by document, building and phase: the first one, the one of the largest or smallest number, all, or the label with most of a total. Null and empty texts
and documents without a known signature give nothing. Lines before the first building, and documents without any, are of `WHOLE`. A document repeated under one id
counts as one text after the other in no fixed order, so ids should be unique.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import small_methods
from ..functions.numbers import as_double
from ..functions.text import bears, let

WHOLE = "Bâtiment unique"
_NUMBER = "-?[0-9]+(?: [0-9]{3})*(?:[.,][0-9]+)?(?![0-9])"
_CELLS = f"{_NUMBER}|(?<![^ ])--?(?![^ ])"


@dataclass(frozen=True)
class Mark:
    """A line that sets a state: to value, or to the pattern's first group after the prefix. It also clears the states named."""

    state: str
    pattern: str
    value: str = ""
    prefix: str = ""
    clears: tuple[str, ...] = ()


@dataclass(frozen=True)
class Part:
    """One value of a reading's line. Fields by phase: (phase, field) pairs, or a field for any phase.

    Kinds: number (the at-th of the line's numbers, from the end if negative, times factor), text (a group), choice (the first of choices whose pattern matches the line),
    state (the value of the state named by text), constant (text), gain (percentage that the at-th number lies below the of-th).
    """

    field: str | tuple[tuple[str, str], ...]
    kind: str = "number"
    at: int = 1
    of: int = 0
    factor: float = 1.0
    text: str = ""
    choices: tuple[tuple[str, str], ...] = ()
    low: float = -1e300
    high: float = 1e300
    confidence: float = 0.9


@dataclass(frozen=True)
class Reading:
    """A line that gives values. `strip` is taken off before its numbers are read; cells counts lone dashes as empty numbers; states are (name, value) pairs that must
    hold; within is the most lines after the block's heading; key is the number that pick compares; everywhere gives the values to all buildings of the document."""

    id: str
    pattern: str
    parts: tuple[Part, ...]
    states: tuple[tuple[str, tuple[str, ...]], ...] = ()
    within: int = 0
    unless: str = ""
    strip: str = ""
    cells: bool = False
    least: int = 0
    over: int = 1
    pick: str = "first"  # first, max, min, all, or share (the label of the largest number, if it has 60 % of all)
    key: int = 1
    by_phase: bool = True
    everywhere: bool = False


@dataclass(frozen=True)
class Layout:
    name: str
    signature: tuple[str, ...]
    marks: tuple[Mark, ...]
    readings: tuple[Reading, ...]
    never: str = ""


def _numbers(text: Column, cells: bool) -> Column:
    """The numbers of a text as they are written."""
    return F.regexp_extract_all(text, F.lit(f"({_CELLS if cells else _NUMBER})"), F.lit(1))


def _at(numbers: Column, at: int) -> Column:
    return as_double(F.try_element_at(numbers, F.lit(at)))


def _text(part: Part, line: Column, low: Column, pattern: str) -> Column:
    """The text of a part that is read from its line."""
    if part.kind == "text":
        found = F.trim(F.regexp_extract(line, f"(?i){pattern}", part.at))
        return F.when(found != "", found)
    return F.coalesce(*[F.when(bears(line, low, p), F.lit(v)) for p, v in part.choices])


def _bare(r: Reading, line: Column) -> Column:
    return _numbers(F.regexp_replace(line, f"(?i){r.strip}", "") if r.strip else line, r.cells)


def _fine(r: Reading, line: Column, low: Column) -> Column:
    """Whether a line may be one of a reading; how many numbers it has is seen later."""
    fine = bears(line, low, r.pattern)
    return fine & ~bears(line, low, r.unless) if r.unless else fine


@dataclass(frozen=True)
class _Group:
    """Readings of the same lines, by their places among all, and the parts whose texts are read from the line (by kind, place and choices)."""

    readings: tuple[tuple[int, Reading], ...]
    texts: tuple[Part, ...]


def _groups(layout: Layout, first: int) -> list[_Group]:
    same: dict[tuple, list[tuple[int, Reading]]] = {}
    for k, r in enumerate(layout.readings):
        same.setdefault((r.pattern, r.unless, r.strip, r.cells, r.least, r.over), []).append((first + k, r))
    return [_Group(tuple(of), tuple({_text_key(p): p for _, r in of for p in r.parts if p.kind in ("text", "choice")}.values())) for of in same.values()]


def _text_key(p: Part) -> tuple:
    return p.kind, p.at, p.choices


def _all_groups(layouts: tuple[Layout, ...]) -> list[list[_Group]]:
    """The groups of each layout."""
    firsts = [sum(len(x.readings) for x in layouts[:k]) for k in range(len(layouts))]
    return [_groups(x, n) for x, n in zip(layouts, firsts)]


def _hits(first: int, groups: list[_Group]) -> Column:
    """An array of what groups of readings, known by their places among all, find in a line: its numbers as they are written and its texts. Each pattern is tried once; what
    readings make of the numbers is worked out where they are few."""
    found = []
    for k, g in enumerate(groups):
        r = g.readings[0][1]
        line, low = map(F.col, ("text", "low") if r.over == 1 else ("more", "low_more"))
        texts = F.array(*[_text(p, line, low, r.pattern) for p in g.texts]) if g.texts else F.array().cast("array<string>")
        numbers = any(x.least or x.pick in ("max", "min", "share") or any(p.kind in ("number", "gain") for p in x.parts) for _, x in g.readings)
        hit = F.struct(F.lit(first + k).alias("at"), (_bare(r, line) if numbers else F.array().cast("array<string>")).alias("numbers"), texts.alias("texts"))
        found.append(F.when(_fine(r, line, low), hit))
    return F.array(*found)


def _specs(r: Reading, g: _Group) -> Column:
    """What a reading's parts take of a line's numbers and texts."""
    at = {_text_key(p): k for k, p in enumerate(g.texts)}
    return F.array(*[
        F.struct(
            F.lit(p.kind).alias("kind"), F.lit(p.at if p.kind in ("number", "gain") else 1).alias("at"), F.lit(p.of if p.kind == "gain" else 1).alias("of"), F.lit(float(p.factor)).alias("factor"), F.lit(float(p.low)).alias("low"),
            F.lit(float(p.high)).alias("high"), F.lit(at.get(_text_key(p), -1) if p.kind in ("text", "choice") else -1).alias("text"), F.lit(p.text if p.kind == "constant" else None).cast("string").alias("constant"),
        )
        for p in r.parts
    ])


def _part(p: Column, numbers: Column, texts: Column) -> Column:
    """The number and the text of a part by its spec."""
    at = lambda k: as_double(F.try_element_at(numbers, p[k]))
    number = let(F.when(p["factor"] != 1.0, F.round(at("at") * p["factor"], 6)).otherwise(at("at")), lambda v: F.when((v >= p["low"]) & (v <= p["high"]), v))
    gain = F.when(at("of") > 0, F.round((at("of") - at("at")) / at("of") * 100, 1))
    return F.struct(F.when(p["kind"] == "number", number).when(p["kind"] == "gain", gain).alias("num"), F.when(p["text"] >= 0, F.get(texts, p["text"])).otherwise(p["constant"]).alias("text"))


def _readings(layouts: tuple[Layout, ...]) -> list[Reading]:
    return [r for x in layouts for r in x.readings]


def _per_reading(layouts: tuple[Layout, ...], of) -> Column:
    """What `of` gives for the reading of column at."""
    return F.element_at(F.array(*[of(r) for r in _readings(layouts)]), F.col("at") + 1)


def _of_parts(r: Reading) -> Column:
    """What a reading's parts say whatever the line is."""
    parts = []
    for p in r.parts:
        fields = F.create_map(*[F.lit(x) for pair in ((("", p.field),) if isinstance(p.field, str) else p.field) for x in pair])
        parts.append(F.struct(fields.alias("fields"), F.lit(p.kind == "state").alias("by_state"), F.lit(p.confidence).alias("confidence")))
    return F.array(*parts)


def _held(layouts: tuple[Layout, ...]) -> Column:
    """The value of the state that a reading's parts give; null for none."""
    given = {(k, p.text) for k, r in enumerate(_readings(layouts)) for p in r.parts if p.kind == "state"}
    return F.coalesce(F.lit(None).cast("string"), *[F.when(F.col("at").isin(*[k for k, t in given if t == s]), F.col(f"s_{s}")) for s in sorted({t for _, t in given})])


def _fits(layouts: tuple[Layout, ...]) -> Column:
    """Whether the states of a line are those that its reading wants."""
    fine = F.lit(False)
    readings = _readings(layouts)
    for states in sorted({r.states for r in readings}):
        here = F.col("at").isin(*[k for k, r in enumerate(readings) if r.states == states])
        for name, values in states:
            here = here & F.lower(F.coalesce(F.col(f"s_{name}"), F.lit(""))).isin(*values)
        fine = fine | here
    return fine


def _set(layout: Layout, state: str, line: Column, low: Column) -> Column:
    """The value that the last of a line's marks gives a state, empty where it clears it; null where no mark does either."""
    found = []
    for m in reversed(layout.marks):
        if state in m.clears:
            value = F.lit("")
        elif state == m.state:
            value = F.lit(m.value) if m.value else F.concat(F.lit(m.prefix), F.trim(F.regexp_extract(line, f"(?i){m.pattern}", 1)))
        else:
            continue
        found.append(F.when(bears(line, low, m.pattern), value))
    return F.coalesce(F.lit(None).cast("string"), *found)


def _states(layouts: tuple[Layout, ...]) -> list[str]:
    return sorted({"phase", "building", "block"} | {s for x in layouts for m in x.marks for s in (m.state, *m.clears)})


def layout_of(text: Column, layouts: tuple[Layout, ...], low: Column | None = None) -> Column:
    """The first layout all of whose signature a text bears; null for none. low is the text in lower case."""
    low = F.lower(text) if low is None else low
    tests = []
    for x in layouts:
        fine = F.lit(True)
        for s in x.signature:
            fine = fine & bears(text, low, s)
        tests.append(F.when(fine & ~bears(text, low, x.never) if x.never else fine, F.lit(x.name)))
    return F.coalesce(*tests)


def lines(docs: DataFrame, layouts: tuple[Layout, ...], id_col: str, text_col: str) -> DataFrame:
    """(id, layout, line, marks, hits): the lines that bear marks or readings of their document's layout; marks has a field for each state, null where it isn't set; hits has the
    groups of readings (at) with the line's numbers and texts."""
    from .layouts import _once, plain

    small_methods(docs.sparkSession)
    d = _once(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")), t=plain(F.col("_text"))).drop("_text")
    d = _once(d, low=F.lower("t"))
    # No filter on the layout: it would be pushed to where the documents are read and evaluated a second time there.
    d = d.select("id", layout_of(F.col("t"), layouts, F.col("low")).alias("layout"), F.transform(F.split("t", "\n"), lambda x: F.trim(x)).alias("all"))
    over = max(r.over for x in layouts for r in x.readings)
    more = lambda x, i: F.concat_ws(" ", F.slice("all", i + 1, over)) if over > 1 else x
    each = F.transform(F.when(F.col("layout").isNotNull(), F.col("all")), lambda x, i: F.struct(x.alias("text"), more(x, i).alias("more")))
    low = F.transform(each, lambda x: F.struct(x["text"].alias("text"), x["more"].alias("more"), F.lower(x["text"]).alias("low"), F.lower(x["more"]).alias("low_more")))
    d = d.select("id", "layout", F.posexplode(low).alias("line", "x")).select("id", "layout", "line", "x.*").filter("text <> ''")
    states = dict.fromkeys(_states(layouts), F.lit(None).cast("string"))
    hits = F.lit(None)
    groups = _all_groups(layouts)
    for k, x in enumerate(layouts):
        own = F.col("layout") == x.name
        states = {s: F.when(own, _set(x, s, F.col("text"), F.col("low"))).otherwise(c) for s, c in states.items()}
        hits = F.when(own, _hits(sum(map(len, groups[:k])), groups[k])).otherwise(hits)
    # The patterns are tried in a projection, which is compiled, where a generator or a function with a lambda would interpret them; behind an explode a filter can't
    # be pushed below it, where it would try all patterns a second time.
    found = d.select("id", "layout", "line", F.struct(*[c.alias(s) for s, c in states.items()]).alias("marks"), hits.alias("hits"))
    found = found.select("id", "layout", "line", F.explode(F.array(F.struct("marks", F.array_compact("hits").alias("hits")))).alias("f"))
    least = F.array(*[F.lit(g.readings[0][1].least) for of in groups for g in of])
    found = found.withColumn("hits", F.filter("f.hits", lambda h: F.size(h["numbers"]) >= F.element_at(least, h["at"] + 1)))
    some = F.size("hits") > 0
    for s in states:
        some = some | F.col(f"f.marks.{s}").isNotNull()
    return found.filter(some).select("id", "layout", "line", "f.marks", "hits")


def read(docs: DataFrame, layouts: tuple[Layout, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, layout, building, phase, field, value_num, value_text, rule, line, confidence)."""
    from .layouts import _once

    found = lines(docs, layouts, id_col, text_col)
    upto = Window.partitionBy("id").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # An empty value clears.
    held = [F.nullif(F.last(f"marks.{s}", ignorenulls=True).over(upto), F.lit("")).alias(f"s_{s}") for s in _states(layouts)]
    block_at = F.last(F.when(F.col("marks.block").isNotNull(), F.col("line")), ignorenulls=True).over(upto)
    found = found.select("id", "layout", "line", "hits", *held, block_at.alias("block_at"))
    found = found.withColumn("buildings", F.collect_set("s_building").over(Window.partitionBy("id")))
    groups = [g for of in _all_groups(layouts) for g in of]
    hits = found.filter("size(hits) > 0").select("*", F.explode("hits").alias("h")).drop("hits")
    hits = hits.withColumn("at", F.explode(F.element_at(F.array(*[F.array(*[F.lit(k) for k, _ in g.readings]) for g in groups]), F.col("h.at") + 1)))
    within, by_phase, everywhere = (_per_reading(layouts, lambda r, k=k: F.lit(getattr(r, k))) for k in ("within", "by_phase", "everywhere"))
    fits = _fits(layouts) & ((within == 0) | (F.col("line") - F.col("block_at") <= within))
    told = _per_reading(layouts, lambda r: F.lit(any(p.kind == "state" for p in r.parts))) | F.exists("parts", lambda p: p["num"].isNotNull() | p["text"].isNotNull())
    pick = _per_reading(layouts, lambda r: F.lit(r.pick))
    specs = {k: _specs(r, g) for g in groups for k, r in g.readings}
    spec = F.element_at(F.array(*[specs[k] for k in sorted(specs)]), F.col("at") + 1)
    # Other picks don't compare numbers.
    key = F.when(pick.isin("max", "min", "share"), as_double(F.try_element_at("h.numbers", _per_reading(layouts, lambda r: F.lit(r.key)))))
    hits = _once(hits.filter(fits), parts=F.transform(spec, lambda p: _part(p, F.col("h.numbers"), F.col("h.texts"))), key=key)
    building = F.when(~everywhere, F.coalesce(F.col("s_building"), F.lit(WHOLE)))
    hits = hits.filter(told).select(
        "id", "layout", "line", "at", "parts", "key", building.alias("building"), F.when(by_phase, F.col("s_phase")).alias("phase"), _held(layouts).alias("held"), F.when(everywhere, F.col("buildings")).alias("buildings")
    )

    by = ["id", "layout", "building", "phase", "at", F.when(pick == "all", F.col("line")).alias("each")]
    rank = F.when(pick.isin("max", "share"), -F.col("key")).when(pick == "min", F.col("key")).otherwise(F.lit(0.0))
    best = hits.groupBy(*by).agg(
        F.min_by(F.struct("line", "parts", "held", "buildings"), F.struct(F.coalesce(rank, F.lit(float("inf"))).alias("rank"), "line")).alias("b"),
        F.max("key").alias("most"), F.sum(F.greatest("key", F.lit(0.0))).alias("total"),
    ).withColumn("pick", pick).filter("pick <> 'share' or (most > 0 and most >= 0.6 * total)")
    zipped = F.arrays_zip(F.col("b.parts").alias("found"), _per_reading(layouts, _of_parts).alias("told"))
    parts = best.select("id", "layout", "building", "phase", _per_reading(layouts, lambda r: F.lit(r.id)).alias("rule"), everywhere.alias("everywhere"), "b.line", "b.held", "b.buildings", F.explode(zipped).alias("p"))
    text = F.coalesce("p.found.text", F.when(F.col("p.told.by_state"), F.col("held")))
    facts = parts.select("id", "layout", "building", "phase", "rule", "line", "everywhere", "buildings", F.coalesce(F.try_element_at("p.told.fields", F.coalesce("phase", F.lit(""))), F.try_element_at("p.told.fields", F.lit(""))).alias("field"),
                         F.col("p.found.num").alias("value_num"), text.alias("value_text"), "p.told.confidence").filter("field is not null and (value_num is not null or value_text is not null)")
    # Values for the whole document go to each of its buildings.
    names_of = F.when(~F.col("everywhere"), F.array("building")).when(F.size("buildings") > 0, F.col("buildings")).otherwise(F.array(F.lit(WHOLE)))
    done = facts.withColumn("building", F.explode(names_of))
    return done.select(F.col("id").alias(id_col), "layout", "building", "phase", "field", "value_num", "value_text", "rule", "line", "confidence")
