"""Costs and aids of operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import NUMBER, as_double, money, percent
from ..functions.text import fold, let, normalize

# States of an aid that count as secured.
SECURED = ("Versée", "Accordée")


def costs(lines: DataFrame, op: str, category: str, amount: str, declared: DataFrame | None = None) -> DataFrame:
    """(op, category, amount, total, pct): sums by category and their share of the total; a declared total (op, total) comes before the sum.

    Negative and null amounts count nothing; a null category is 'other'.
    """
    cat = F.coalesce(F.col(category), F.lit("other"))
    per = lines.groupBy(op, cat.alias("category")).agg(F.sum(F.when(F.col(amount) >= 0, F.col(amount)).otherwise(0.0)).alias("amount"))
    total = per.groupBy(op).agg(F.sum("amount").alias("total"))
    if declared is not None:
        total = total.join(declared.select(op, F.col("total").alias("_declared")), op, "left").select(op, F.coalesce("_declared", "total").alias("total"))
    return per.join(total, op).withColumn("pct", percent(F.col("amount"), F.col("total")))


def aids(lines: DataFrame, op: str, kind: str, amount: str, status: str) -> DataFrame:
    """(op, total, secured, secured_pct, dominant, first_financier_amount, n_kinds): the largest kind of an operation and its secured share."""
    secured = F.col(status).isin(*SECURED)
    per = lines.groupBy(op, kind).agg(F.sum(amount).alias("a"), F.sum(F.when(secured, F.col(amount)).otherwise(0.0)).alias("s"))
    g = per.groupBy(op).agg(F.sum("a").alias("total"), F.sum("s").alias("secured"), F.max_by(kind, F.struct("a", F.col(kind))).alias("dominant"), F.max("a").alias("first_amount"), F.count(F.lit(1)).alias("n_kinds"))
    return g.withColumn("secured_pct", percent(F.col("secured"), F.col("total")))


def own_funds(total: Column, capital: Column, loans: Column) -> Column:
    """What capital and loans leave of the total."""
    return total - F.coalesce(capital, F.lit(0.0)) - F.coalesce(loans, F.lit(0.0))


def best_lots(lines: DataFrame, by: list[str], confidence: str, seq: str, kept: list[str]) -> DataFrame:
    """(by, kept): the most confident line of each lot, the later one among equals."""
    return lines.groupBy(*by).agg(F.max_by(F.struct(*kept), F.struct(confidence, seq)).alias("_w")).select(*by, "_w.*")


# Posts of works by a word of the line's label.
POSTS = [("demolition", "demoli|curage|desamiant"), ("structure", "gros oeuvre|maconn|fondation|charpente|structure"), ("envelope", "facade|ravalement|bardage|isolation|etanch|couverture|toiture"), ("openings", "menuiser|fenetre|vitrage|serrurer|porte"),
         ("heating", "chauff|cvc|ventil|vmc|climat"), ("plumbing", "plomb|sanitaire|eau"), ("electricity", "electric|courant|eclairage|photovolt"), ("finishes", "peinture|revetement|sol|carrelage|platrer|cloison|doublage"), ("lifts", "ascenseur|elevateur"), ("outside", "vrd|espaces? verts?|voirie|amenagement")]
QUESTIONNAIRE = """operation struct<numeroOperation: string, contrat: string, commune: string>, financier struct<montantTotalOperation: double, couverture: string, lignesValidees: array<struct<source: string, lot: string, categorie: string, montant: double, commentaire: string>>>,
aides struct<statut: string, nombreLogements: double, lignes: array<struct<aideId: string, dispositif: string, categorie: string, porteur: string, montant: double, etat: string>>>"""


def post(label: Column) -> Column:
    """The post of works a label belongs to; null for none and for labels of several posts (a | b)."""
    t = fold(normalize(label))
    out = F.when(label.contains("|"), None)
    for name, pattern in POSTS:
        out = out.when(t.rlike(pattern), name)
    return out


def by_post(lines: DataFrame, op: str, label: str, amount: str) -> DataFrame:
    """(op, post, amount, pct) of works: sums by post, 'other' for lines of none, and their share."""
    per = lines.groupBy(op, F.coalesce(post(F.col(label)), F.lit("other")).alias("post")).agg(F.sum(F.coalesce(money(F.col(amount)), F.lit(0.0))).alias("amount"))
    total = per.groupBy(op).agg(F.sum("amount").alias("_t"))
    return per.join(total, op).select(op, "post", "amount", percent(F.col("amount"), F.col("_t")).alias("pct"))


def lot_lines(lines: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """(by, label, amount, confidence) of lines of a bill of quantities that name a lot: the last amount of the line; subtotals, taxes and general totals are left out. cells are parted by |."""
    low = fold(normalize(F.col(text)))
    is_lot = low.rlike("\\blot\\b") & ~low.rlike("sous[- ]?total|total\\s+general|\\btva\\b|\\bttc\\b")
    cells = F.split(normalize(F.col(text)), "\\s*\\|\\s*")
    label = F.coalesce(F.get(F.filter(cells, lambda c: fold(c).rlike("\\blot\\b")), F.lit(0)), F.get(cells, F.lit(0)))
    label = F.trim(F.regexp_replace(F.regexp_replace(label, "(?i)^total\\s+", ""), "\\s*:.*$", ""))
    amounts = F.array_compact(F.transform(F.filter(cells, lambda c: c.rlike(f"^{NUMBER} ?(?:€|(?i)eur)?$")), lambda c: as_double(F.regexp_extract(c, NUMBER, 0))))
    score = F.when(low.rlike("total\\s+lot"), 0.99).when(low.rlike("(?:montant|prix|total)\\s*ht"), 0.97).otherwise(0.91)
    return lines.filter(is_lot).select(*by, label.alias("label"), F.try_element_at(amounts, F.lit(-1)).alias("amount"), score.alias("confidence")).filter("amount > 0 and label <> ''")


def questionnaires(docs: DataFrame, id_col: str, json_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(identity, costs, aids) of questionnaires in JSON: (id, operation, contract, total), (id, source, label, category, amount), (id, aid, kind, level, amount, status). Other JSON and null give nothing."""
    d = docs.select(F.col(id_col).alias("id"), F.from_json(F.col(json_col), QUESTIONNAIRE).alias("q")).filter("q.operation is not null")
    identity = d.select("id", F.col("q.operation.numeroOperation").alias("operation"), F.col("q.operation.contrat").alias("contract"), money(F.col("q.financier.montantTotalOperation")).alias("total"))
    costs_ = d.select("id", F.inline("q.financier.lignesValidees")).select("id", "source", F.col("lot").alias("label"), F.when(fold(F.col("categorie")).contains("travaux"), "travaux").otherwise(F.coalesce(fold(F.col("categorie")), F.lit("autres"))).alias("category"), money(F.col("montant")).alias("amount"))
    aids_ = d.select("id", F.inline("q.aides.lignes")).select("id", F.coalesce("aideId", F.lit("autre")).alias("aid"), F.coalesce("categorie", F.lit("autre")).alias("kind"), F.col("porteur").alias("level"), money(F.col("montant")).alias("amount"), F.col("etat").alias("status"))
    return identity, costs_, aids_


def questionnaire_cells(lines: DataFrame, by: str) -> DataFrame:
    """(by, section, label, amount) of the lines (by, idx, text) of a questionnaire printed as a table: cells parted by |, the amount in the last, under the last section heading (costs or aids)."""
    low = fold(normalize(F.col("text")))
    section = let(low, lambda t: F.when(t.rlike("donnees financieres validees"), "costs").when(t.rlike("aides mobilisees"), "aids").when(t.rlike("^(?:identite|controle|transmission)\\b"), "other"))
    w = Window.partitionBy(by).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    cells = F.split(F.col("text"), "\\s*\\|\\s*")
    last = F.try_element_at(cells, F.lit(-1))
    amount = F.when(last.rlike("[0-9]"), as_double(F.regexp_extract(normalize(last), NUMBER, 0)))
    # What a row says is read before rows are sorted, so that no text is; a row that neither begins a section nor can be a cell is no more needed.
    # Behind an explode, it is read once.
    read = F.struct(section.alias("_begins"), F.when(F.size(cells) >= 2, F.trim(F.get(cells, F.lit(0)))).alias("label"), amount.alias("amount"))
    read = lines.select(by, "idx", F.explode(F.array(read)).alias("_r")).select(by, "idx", "_r.*")
    can = "amount >= 0 and label <> ''"
    r = read.filter(f"_begins is not null or {can}").withColumn("section", F.last("_begins", ignorenulls=True).over(w)).filter(can)
    return r.filter(F.col("section").isin("costs", "aids")).select(by, "section", "label", "amount")


def result(identity: DataFrame, costs_: DataFrame, bills: DataFrame, aids_: DataFrame, op: str, manual: DataFrame | None = None) -> DataFrame:
    """(op, cost_total, aid_total, own_funds, source) of every operation: a questionnaire's declared total before the sum of its lines, its lines before the bill of quantities (costs read
    from both would count twice), and amounts entered by hand (op, cost_total) before all. costs_, bills: op, amount; aids_: op, kind, amount; identity: op, total. Capital and loans (kinds capital and pret) lower the own funds."""
    q = costs_.groupBy(op).agg(F.sum("amount").alias("_q"))
    b = bills.groupBy(op).agg(F.sum("amount").alias("_b"))
    a = aids_.groupBy(op).agg(F.sum("amount").alias("aid_total"), F.sum(F.when(F.col("kind").isin("capital", "pret"), F.col("amount")).otherwise(0.0)).alias("_f"))
    i = identity.groupBy(op).agg(F.max("total").alias("_d"), F.lit(True).alias("_has"))
    j = i.join(q, op, "full").join(b, op, "full").join(a, op, "full")
    if manual is not None:
        j = j.join(manual.groupBy(op).agg(F.max("cost_total").alias("_m")), op, "full")
    hand = F.col("_m") if manual is not None else F.lit(None).cast("double")
    total = F.coalesce(hand, F.when(F.col("_has"), F.coalesce("_d", "_q")), "_q", "_b")
    source = F.when(hand.isNotNull(), "manual").when(F.col("_has") | F.col("_q").isNotNull(), "questionnaire").when(F.col("_b").isNotNull(), "bill")
    return j.select(op, total.alias("cost_total"), "aid_total", (total - F.coalesce("_f", F.lit(0.0))).alias("own_funds"), source.alias("source"))
