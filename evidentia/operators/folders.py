"""Folders and files of operations: contracts in names, what is skipped, read, current, changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, let, normalize

# Words of folders that are out of date, and words that may stand beside 'ancien' in such a name.
OBSOLETE = ("old", "obsolete", "perime", "perimee", "caduc", "caduque", "archive", "archivee", "archivage", "superseded", "outdated", "deprecated", "remplace", "remplacee")
GENERIC = ("version", "indice", "ind", "fichier", "document", "doc", "dossier", "etude", "piece", "cctp", "rset", "rsee", "plan", "note", "envoi", "v")
# The lots of a tender and their short names.
TRADES = (
    "gros oeuvre", "maconnerie", "demolition", "desamiantage", "terrassement", "fondation", "charpente", "couverture", "zinguerie", "etancheite", "bardage", "facade", "ravalement", "isolation thermique", "ite",
    "menuiserie", "serrurerie", "metallerie", "platrerie", "cloison", "doublage", "faux plafond", "plafond", "peinture", "revetement", "sols", "carrelage", "faience", "parquet", "electricite", "courants faibles",
    "cvc", "chauffage", "ventilation", "vmc", "plomberie", "sanitaire", "climatisation", "ascenseur", "vrd", "espaces verts", "espaces exterieurs", "amenagements exterieurs", "cloture", "portail", "nettoyage",
    "echafaudage", "generalites", "structure", "ossature", "beton", "automatisme", "controle d acces", "interphonie", "photovoltaique", "ecs", "equipements",
)
ABBREVIATIONS = {
    "electricite": ("elec", "cfo", "cfa", "courants forts", "courant fort", "courant faible"), "plomberie": ("plb", "plomb"), "menuiserie": ("mex", "min", "menuis"), "menuiseries exterieures": ("mex",),
    "menuiseries interieures": ("min",), "serrurerie": ("serr",), "metallerie": ("metal",), "gros oeuvre": ("go",), "chauffage": ("chauf",), "ventilation": ("vent",), "climatisation": ("clim",), "courants faibles": ("cfa",), "vrd": ("voirie",),
}
READABLE = ("pdf", "xml", "xlsx", "xls", "csv", "json", "txt")


def tokens(name: Column) -> Column:
    """Folded words of a folder's name without its numbering, in the singular."""
    n = F.regexp_replace(F.lower(F.coalesce(normalize(name), F.lit(""))), "^[0-9\\s._)(\\]–-]+(?=[a-z])", "")
    words = F.filter(F.split(n, "[^a-z0-9]+"), lambda t: t != "")
    return F.transform(words, lambda t: F.when((F.char_length(t) > 3) & t.rlike("[^s]s$"), F.regexp_replace(t, "s$", "")).otherwise(t))


def has_sequence(name: Column, wanted: list[str]) -> Column:
    """Whether a folder's words hold one of the names as a run of words."""
    line = F.concat(F.lit(" "), F.array_join(tokens(name), " "), F.lit(" "))
    out = F.lit(False)
    for w in wanted:
        out = out | line.contains(F.concat(F.lit(" "), F.array_join(tokens(F.lit(w)), " "), F.lit(" ")))
    return out


def obsolete(name: Column) -> Column:
    """Whether a folder's name says that its files are out of date ('Ancien' alone or with generic words; 'Ancienne Mairie' is a building)."""
    t = tokens(name)
    old = t.getItem(0).isNotNull() & F.exists(t, lambda w: w.isin("ancien", "ancienne", "anc")) & F.forall(t, lambda w: w.isin("ancien", "ancienne", "anc", *GENERIC) | w.rlike("^[0-9]+$"))
    said = F.array_join(t, " ").rlike("\\bversion (?:precedente|anterieure|obsolete)\\b|\\bne pas utiliser\\b|\\bnon valide\\b|\\ba (?:supprimer|jeter)\\b|\\bhors? perimetre\\b")
    return F.arrays_overlap(t, F.array(*map(F.lit, OBSOLETE))) | F.coalesce(old, F.lit(False)) | said


def ignore_reason(name: Column, system: tuple[str, ...] = ("thumbs.db", "desktop.ini"), prefixes: tuple[str, ...] = ("~$", "."), patterns: tuple[str, ...] = ()) -> Column:
    """Why a file is not read, null for one that is: product sheets, system and temporary files, no or unknown extension, names of correspondence (patterns)."""
    low = F.lower(normalize(name))
    bare = F.regexp_replace(F.regexp_replace(low, "\\.[a-z0-9]{1,6}$", ""), "[_.]+", " ")
    ext = F.regexp_extract(low, "\\.([a-z0-9]{1,6})$", 1)
    starts = F.lit(False)
    for p in prefixes:
        starts = starts | name.startswith(p)
    out = F.when(bare.rlike("(?:^|[^a-z0-9])fdes(?:[^a-z]|$)"), "product sheet").when(low.isin(*system), "system file").when(starts, "temporary file").when(ext == "", "no extension").when(~ext.isin(*READABLE), F.concat(F.lit("format "), ext))
    for p in patterns:
        out = out.when(bare.rlike(p), "correspondence")
    return out


def _plain(name: Column) -> Column:
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.regexp_replace(F.lower(normalize(name)), "\\.[a-z0-9]{1,6}$", ""), "[_.\\-–—()\\s]+", " ")), F.lit(" "))


def read_lot(name: Column, wanted: list[str]) -> Column:
    """(read, reason): a file of a tender is read when it names a wanted lot or none that can be told; without wanted lots all are."""
    ours = [x for w in wanted for k in [" ".join(w.lower().split())] for x in (k, *ABBREVIATIONS.get(k, ()))]
    if not ours:
        return F.struct(F.lit(True).alias("read"), F.lit("").alias("reason"))

    def has(plain: Column, words) -> Column:
        found = F.lit(False)
        for w in words:
            found = found | plain.contains(f" {w} ") | plain.contains(f" {w}s ")
        return found

    said = let(_plain(name), lambda plain: F.struct(has(plain, ours).alias("own"), (has(plain, TRADES) | plain.rlike(" lot ?n?°? ?[0-9]")).alias("lot")))
    return let(said, lambda x: F.struct((x["own"] | ~x["lot"]).alias("read"), F.when(x["own"], "wanted lot").when(~x["lot"], "").otherwise("other lot").alias("reason")))


def reread(name: Column, old_family: Column, tabs: list[str], lots: list[str]) -> Column:
    """Whether a document has to be read again for the chosen tabs (families) or lots."""
    return F.coalesce(old_family.isin(*tabs), F.lit(False)) | (F.coalesce(old_family == "cctp", F.lit(False)) & F.lit(bool(lots)) & read_lot(name, lots)["read"])


def folder_contracts(name: Column, least: int = 3, width: int = 8) -> Column:
    """(contracts, cancelled): the numbers at the head of a folder's name with three significant digits or more, padded, each once; cancelled where the name says so."""
    n = F.lower(F.coalesce(normalize(name), F.lit("")))
    cancelled = n.rlike("(?:^|[^a-z])annul(?:ee?s?)?(?![a-z])")
    rest = F.regexp_replace(n, "^\\s*annul(?:ee|e)\\b\\s*[-–:]?\\s*", "")
    head = F.regexp_extract(rest, "^[0-9\\s,;+&/._–-]*(?:(?:et|and)\\b[0-9\\s,;+&/._–-]*)*", 0)
    runs = F.filter(F.regexp_extract_all(head, F.lit("[0-9]+"), F.lit(0)), lambda r: F.char_length(F.regexp_replace(r, "^0+", "")).between(least, width))
    keys = F.array_distinct(F.transform(runs, lambda r: F.lpad(F.regexp_replace(r, "^0+", ""), width, "0")))
    return F.struct(keys.alias("contracts"), cancelled.alias("cancelled"))


def match_contracts(folders: DataFrame, wanted: DataFrame) -> DataFrame:
    """(contract, status, n, folder, shared) of wanted (contract) against folders (name, a path from the root): found, multiple, only cancelled or missing. Where one of several folders lies at
    the top it is the one; shared tells that its folder has other contracts too."""
    f = folders.select("name", folder_contracts(F.element_at(F.split("name", "/"), -1)).alias("f")).select("name", "f.cancelled", (F.size("f.contracts") > 1).alias("shared"), F.explode("f.contracts").alias("contract"))
    live, top = ~F.col("cancelled"), ~F.col("name").contains("/")
    g = f.groupBy("contract").agg(
        F.count_if(live).alias("n_live"), F.count_if(live & top).alias("n_top"), F.count(F.lit(1)).alias("n_all"), F.min(F.when(live, F.struct(~top, F.col("name"), F.col("shared")))).alias("first"),
    )
    j = wanted.select("contract").distinct().join(g, "contract", "left")
    one = (F.col("n_live") == 1) | (F.col("n_top") == 1)
    status = F.when(F.col("n_all").isNull(), "missing").when(F.col("n_live") == 0, "only cancelled").when(one, "found").otherwise("multiple")
    return j.select("contract", status.alias("status"), F.coalesce("n_live", F.lit(0)).alias("n"), F.when(one, F.col("first.name")).alias("folder"), F.coalesce(one & F.col("first.shared"), F.lit(False)).alias("shared"))


def shared_contracts(folders: DataFrame) -> DataFrame:
    """(contract, n): contracts held by more than one operation's folder."""
    f = folders.select("name", F.explode(folder_contracts(F.col("name"))["contracts"]).alias("contract"))
    return f.groupBy("contract").agg(F.countDistinct("name").alias("n")).filter("n > 1")


def walk(files: DataFrame, depth: int = 8) -> DataFrame:
    """(path, folder, name, level, skipped) of files (path below the root): those deeper than depth, or under a skipped or outdated folder, are marked with why."""
    parts = F.split("path", "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    why = F.when(F.size(folders) > depth, "too deep").when(F.exists(folders, lambda f: f.startswith(".")), "hidden").when(F.exists(folders, obsolete), "outdated folder")
    return files.select("path", F.array_join(folders, "/").alias("folder"), F.element_at(parts, -1).alias("name"), F.size(folders).alias("level"), why.alias("skipped"))


def reuse(files: DataFrame, registry: DataFrame) -> DataFrame:
    """files (path, content or sha) with the result of the registry (sha, result) for the same content: what need not be read again. Hashes are one row each in the registry's newest state."""
    f = files if "sha" in files.columns else files.withColumn("sha", F.sha2("content", 256)).drop("content")
    return f.join(registry.groupBy("sha").agg(F.max("result").alias("result")), "sha", "left")


def loadable(files: DataFrame, decisions: DataFrame) -> DataFrame:
    """Files (id, current, missing, result, state) that can be loaded: current, there, with a result, and done, or in review and accepted (decisions: id, accepted)."""
    d = decisions.groupBy("id").agg(F.bool_or("accepted").alias("_ok"))
    ready = (F.col("state") == "done") | (F.col("state") == "review") & F.coalesce("_ok", F.lit(False))
    return files.join(d, "id", "left").filter(F.col("current") & ~F.col("missing") & F.col("result").isNotNull() & ready).drop("_ok")


def counters(files: DataFrame, by: str = "operation") -> DataFrame:
    """(by, total, done, review, errors, ignored, missing, todo) of files (by, state, missing)."""
    n = lambda s: F.count_if(F.col("state") == s)
    return files.groupBy(by).agg(F.count(F.lit(1)).alias("total"), n("done").alias("done"), n("review").alias("review"), n("error").alias("errors"), n("ignored").alias("ignored"), F.count_if("missing").alias("missing"), F.count_if(F.col("state").isNull()).alias("todo"))


def plan_format(name: Column, width: Column, height: Column) -> Column:
    """The sheet (A3 to A0) of a plan by its long side in points; A3 only if its name says plan; null for smaller ones and for written documents."""
    long_, n = F.greatest(width, height), fold(normalize(name))
    # Words of written documents and of plans, and the least long sides.
    written = n.rlike("cctp|dpgf|\\brse[te]\\b|rsenv|notice|etude|rapport|contrat|\\bacv\\b|thermique|\\bdpe\\b|audit|devis|questionnaire|attestation|synthese|reperage")
    plan = n.rlike("(?:^|[^a-z])(?:plans?|pln|facades?|coupes?|niveaux?|rdc|r\\+[0-9]|masse|implantation|sous[- ]sol|toitures?|carnet)(?:[^a-z]|$)")
    return F.when(written, None).when(long_ >= 3300, "A0").when(long_ >= 2300, "A1").when(long_ >= 1650, "A2").when((long_ >= 1150) & plan, "A3")
