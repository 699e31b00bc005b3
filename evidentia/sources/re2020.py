"""Regulatory XML studies and certificates: one schema, facts by building, JVM-side from text to facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..operators.layouts import _once

_LIST = "array<struct<{}>>"
_ZONES_OUT = "Sortie_Zone_D_Collection struct<Sortie_Zone_D: array<struct<Index: int, Sortie_Groupe_D_Collection: struct<Sortie_Groupe_D: array<struct<Name: string, O_NbDegresHeures: double, O_NbDegresHeures_max: double>>>>>>"
_USES = [f"O_Cef_{v}_imp{u}_annuel double" for v in ("gaz", "fioul", "bois", "elec", "reseau") for u in ("", "_ch", "_fr", "_ecs")] + [f"O_Cef_elec_imp_{u}_annuel double" for u in ("ecl", "auxvent", "auxdist", "deplacement")]
_OPAQUE = "_type_paroi: int, nature: int, name: string, surface_totale: double, U_paroi: double, resistance_thermique_isolant: double, epaisseur_isolant: double"
_GENERAL = "donnees_generales struct<BET: struct<editeur_logiciel: string, nom_logiciel: string, version_logiciel: string, date_etude: string>, operation: struct<nom: string, name: string, num_permis: string, zone_climatique: string, adresse: struct<label: string, ligne: string, postcode: string, code_postal: string, city: string, ville: string>>, maitre_ouvrage: struct<nom: string>>"
_ENVELOPE = f"batiment_collection struct<batiment: array<struct<Index: int, enveloppe: struct<parois_opaques: array<struct<{_OPAQUE}>>, parois_vitrees: array<struct<name: string, surface_totale: double, type_vitrage: string>>>>>>"
SCHEMA = f"""
Datas_Comp struct<{_GENERAL.replace(' struct', ': struct', 1)}, {_ENVELOPE.replace(' struct', ': struct', 1)}>,
RSET struct<
  Entree_Projet: struct<Batiment_Collection: struct<Batiment: array<struct<Index: int, Name: string, Zone_Collection: struct<Zone: array<struct<Index: int, NB_logement: double, Is_Traversant: int, Groupe_Collection: struct<Groupe: array<struct<SHAB: double, Is_Climatise: int>>>>>>>>>>,
  Sortie_Projet: struct<Departement: string,
    Sortie_Batiment_B_Collection: struct<Sortie_Batiment_B: array<struct<Index: int, O_Bbio_pts_annuel: double, O_Bbio_Max: double>>>,
    Sortie_Batiment_C_Collection: struct<Sortie_Batiment_C: array<struct<Index: int, Name: string, O_SREF: double, O_Cep_annuel: double, O_Cep_Max: double, O_Cep_nr_annuel: double, O_Cep_nr_Max: double, {', '.join(u.replace(' ', ': ') for u in _USES)}>>>,
    Sortie_Batiment_D_Collection: struct<Sortie_Batiment_D: array<struct<Index: int, {_ZONES_OUT.replace(' struct', ': struct', 1)}>>>>>,
RSEnv struct<
  entree_projet: struct<batiment: array<struct<index: int, nom: string, sref: double, zone: array<struct<nb_logement: double>>>>>,
  sortie_projet: struct<batiment: array<struct<index: int,
    indicateur_perf_env: struct<ic_construction: double, ic_construction_max: double, ic_energie: double, ic_energie_max: double, ic_composant: double, ic_chantier: double, stock_c_batiment: double>,
    contributeur: struct<composant: struct<lot: array<struct<_ref: int, ic: double>>>, energie: struct<sous_contributeur: array<struct<_ref: int, indicateur_co2_dynamique: struct<valeur_phase_acv: array<double>>>>>>>>>>
"""
# Energy contributors by their number, primary energy factors, and names of carriers.
CONTRIBUTORS = {1: "ic_energy_heating", 2: "ic_energy_ecs", 3: "ic_energy_cooling", 5: "ic_energy_aux_vent", 6: "ic_energy_aux_dist", 7: "ic_energy_mobility"}
PRIMARY = {"gaz": 1.0, "elec": 2.3, "bois": 1.0, "reseau": 1.0, "fioul": 1.0}
VECTORS = {"gaz": "Gaz", "elec": "Électricité", "bois": "Bois / biomasse", "reseau": "Réseau de chaleur urbain", "fioul": "Fioul"}
CEP_BY_VECTOR = {"gaz": "cep_gas", "elec": "cep_electricity", "bois": "cep_biomass", "reseau": "cep_district"}


def parse(docs: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    """(id, x): the studies as structs; x is null for null or unreadable XML and for other documents."""
    x = F.from_xml(F.col(xml_col), SCHEMA, {"mode": "PERMISSIVE", "rowTag": "projet"})
    # Read once a row: what filters and takes apart the result would else hold the reading itself, each time anew.
    parsed = _once(docs, x=x).select(F.col(id_col).alias("id"), "x")
    return parsed.withColumn("x", F.when(F.col("x.RSET").isNotNull() | F.col("x.RSEnv").isNotNull(), F.col("x")))


def _at(rows: Column, index: Column, key: str = "Index") -> Column:
    """The element of an array of structs with this index."""
    return F.get(F.filter(rows, lambda r: r[key] == index), F.lit(0))


def _each(rows: Column, name: str) -> Column:
    """One field of every element of an array of structs."""
    return F.transform(rows, lambda r: r[name])


def _sum(values: Column) -> Column:
    """The sum of what is there; null for nothing."""
    v = F.array_compact(F.coalesce(values, F.array().cast("array<double>")))
    return F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, b: a + b))


def buildings(parsed: DataFrame) -> DataFrame:
    """(id, index, name, general columns and values of every building of a study); one row for each building of any part of it."""
    p, s, e = "x.RSET.Entree_Projet.Batiment_Collection.Batiment", "x.RSET.Sortie_Projet", "x.RSEnv"
    many = lambda path: F.coalesce(F.col(path), F.array())
    ids = F.array_distinct(F.array_compact(F.concat(*[_each(many(path), k) for path, k in ((p, "Index"), (f"{s}.Sortie_Batiment_C_Collection.Sortie_Batiment_C", "Index"), (f"{e}.sortie_projet.batiment", "index"), ("x.Datas_Comp.batiment_collection.batiment", "Index"))])))
    d = parsed.filter("x is not null").withColumn("_ids", ids).withColumn("index", F.explode("_ids"))
    i = F.col("index")
    d = d.withColumn("ein", _at(F.col(p), i)).withColumn("b", _at(F.col(f"{s}.Sortie_Batiment_B_Collection.Sortie_Batiment_B"), i)).withColumn("c", _at(F.col(f"{s}.Sortie_Batiment_C_Collection.Sortie_Batiment_C"), i))
    d = d.withColumn("dd", _at(F.col(f"{s}.Sortie_Batiment_D_Collection.Sortie_Batiment_D"), i)).withColumn("rin", _at(F.col(f"{e}.entree_projet.batiment"), i, "index")).withColumn("rout", _at(F.col(f"{e}.sortie_projet.batiment"), i, "index"))
    zones = F.coalesce(F.col("ein.Zone_Collection.Zone"), F.array())
    groups = F.flatten(F.transform(zones, lambda z: F.coalesce(z["Groupe_Collection"]["Groupe"], F.array())))
    hours = F.flatten(F.transform(F.coalesce(F.col("dd.Sortie_Zone_D_Collection.Sortie_Zone_D"), F.array()), lambda z: F.transform(F.coalesce(z["Sortie_Groupe_D_Collection"]["Sortie_Groupe_D"], F.array()), lambda g: F.struct(g["O_NbDegresHeures"].alias("dh"), g["O_NbDegresHeures_max"].alias("most"), z["Index"].alias("zone")))))
    d = d.withColumn("zones", zones).withColumn("hours", F.filter(hours, lambda h: h["dh"].isNotNull()))
    through = lambda flag: F.transform(F.filter("zones", lambda z: z["Is_Traversant"] == flag), lambda z: z["Index"])
    worst = lambda only: F.array_max(F.transform(F.filter("hours", only), lambda h: F.struct(h["dh"].alias("dh"), h["most"].alias("most"))))
    raw = F.filter(F.array("rin.nom", "ein.Name", "c.Name"), lambda n: F.coalesce(F.trim(n) != "", F.lit(False)))
    pick = F.coalesce(F.get(F.filter(raw, lambda n: n.rlike("(?i)[àâäéèêëîïôöùûüç]")), F.lit(0)), F.get(raw, F.lit(0)), F.lit(""))
    generic = pick.rlike("(?i)^b[aâ]t(?:iment)?\\.?$") | (pick == "")
    name = F.when(generic & (F.size("_ids") == 1), names.UNIQUE).when(generic, F.concat(F.lit("Bâtiment "), i.cast("string"))).otherwise(names.canonical(pick))
    op = F.col("x.Datas_Comp.donnees_generales.operation")
    perf = "rout.indicateur_perf_env"
    lots = F.coalesce(F.col("rout.contributeur.composant.lot"), F.array())
    energy = F.coalesce(F.col("rout.contributeur.energie.sous_contributeur"), F.array())
    cef = lambda v, u="": F.col(f"c.O_Cef_{v}_imp{u}_annuel")
    biggest = lambda u: F.array_max(F.array(*[F.struct(F.coalesce(cef(v, u), F.lit(0.0)).alias("n"), F.lit(label).alias("label")) for v, label in VECTORS.items()]))
    vector = lambda u: F.when(biggest(u)["n"] > 0, biggest(u)["label"])
    return d.select(
        "id", "index", name.alias("building"), F.coalesce(op["nom"], op["name"]).alias("operation_name"), F.coalesce(op["adresse"]["label"], op["adresse"]["ligne"]).alias("address"),
        F.coalesce(op["adresse"]["postcode"], op["adresse"]["code_postal"]).alias("postcode"), F.coalesce(op["adresse"]["city"], op["adresse"]["ville"]).alias("city"), F.col("x.Datas_Comp.donnees_generales.maitre_ouvrage.nom").alias("owner_company"),
        F.coalesce(F.col(f"{s}.Departement"), F.substring(F.coalesce(op["adresse"]["postcode"], op["adresse"]["code_postal"]), 1, 2)).alias("department"), F.col("x.Datas_Comp.donnees_generales.BET.date_etude").alias("study_date"),
        F.coalesce(_sum(F.transform("zones", lambda z: z["NB_logement"])), _sum(F.transform("rin.zone", lambda z: z["nb_logement"]))).alias("housing_count"), _sum(F.transform(groups, lambda g: g["SHAB"])).alias("shab"),
        F.when(F.size(through(1)) > 0, "Oui").alias("cross_ventilated"), F.when(F.size(through(0)) > 0, "Oui").alias("non_cross_ventilated"),
        F.col("b.O_Bbio_pts_annuel").alias("bbio"), F.col("b.O_Bbio_Max").alias("bbio_max"), F.col("c.O_Cep_annuel").alias("cep"), F.col("c.O_Cep_Max").alias("cep_max"), F.col("c.O_Cep_nr_annuel").alias("cepnr"), F.col("c.O_Cep_nr_Max").alias("cepnr_max"),
        *[F.round(cef(v) * PRIMARY[v], 2).alias(f) for v, f in CEP_BY_VECTOR.items()], *[F.round(F.col(f"c.O_Cef_elec_imp_{u}_annuel") * 2.3, 2).alias(f) for u, f in (("ecl", "cep_lighting"), ("auxvent", "cep_aux_vent"), ("auxdist", "cep_aux_dist"), ("deplacement", "cep_mobility"))],
        F.round(_sum(F.array(*[cef(v, "_fr") * PRIMARY[v] for v in VECTORS])), 2).alias("cep_cooling"), vector("_ch").alias("heating_vector_after"), vector("_ecs").alias("ecs_vector_after"),
        worst(lambda h: h["dh"] >= 0)["dh"].alias("dh"), worst(lambda h: h["dh"] >= 0)["most"].alias("dh_max"), worst(lambda h: F.array_contains(through(1), h["zone"]))["dh"].alias("dh_zt"), worst(lambda h: F.array_contains(through(0), h["zone"]))["dh"].alias("dh_znt"),
        *[F.col(f"{perf}.{tag}").alias(f) for tag, f in (("ic_construction", "ic_construction"), ("ic_construction_max", "ic_construction_max"), ("ic_energie", "ic_energy"), ("ic_energie_max", "ic_energy_max"), ("ic_composant", "ic_components"), ("ic_chantier", "ic_site"), ("stock_c_batiment", "stock_c_per_m2"))],
        *[_at(lots, F.lit(n), "_ref")["ic"].alias(f"ic_lot_{n}") for n in range(1, 14)],
        *[F.round(_sum(_at(energy, F.lit(n), "_ref")["indicateur_co2_dynamique"]["valeur_phase_acv"]), 3).alias(f) for n, f in CONTRIBUTORS.items()],
    )


def _target(kind: Column, nature: Column) -> Column:
    """wall, roof or floor of an opaque part by its type, else its nature; null for boxes and doors."""
    by_kind = F.when(kind.isin(100, 1), "wall").when(kind.isin(300, 3), "roof").when(kind.isin(200, 400, 2), "floor")
    by_nature = F.when(nature.between(100, 199), "wall").when(nature.between(300, 399), "roof").when(nature.between(200, 299) | nature.between(400, 499), "floor")
    return F.when(nature.isin(105, 106, 205, 305, 405), None).otherwise(F.coalesce(by_kind, by_nature))


def envelope(parsed: DataFrame) -> DataFrame:
    """(id, index, target, name, surface, u, r, thickness): the part of each kind with the largest surface in all, parts of one name taken together; thickness in mm."""
    b = parsed.filter("x is not null").select("id", F.explode("x.Datas_Comp.batiment_collection.batiment").alias("b")).select("id", F.col("b.Index").alias("index"), F.explode("b.enveloppe.parois_opaques").alias("p"))
    parts = b.select("id", "index", _target(F.col("p._type_paroi"), F.col("p.nature")).alias("target"), "p.*").filter("target is not null")
    per = parts.groupBy("id", "index", "target", "name").agg(F.sum(F.coalesce("surface_totale", F.lit(0.0))).alias("surface"), F.first("U_paroi", True).alias("u"), F.first("resistance_thermique_isolant", True).alias("r"), F.first("epaisseur_isolant", True).alias("cm"))
    return per.groupBy("id", "index", "target").agg(F.max_by(F.struct("name", "surface", "u", "r", (F.col("cm") * 10).alias("thickness")), F.struct("surface", "name")).alias("w")).select("id", "index", "target", "w.*")


def facts(rows: DataFrame) -> DataFrame:
    """(id, building, field, value_num, value_text, confidence, method): the values of buildings as facts, one for each that is there."""
    keep = ("id", "index", "building")
    one = [F.struct(F.lit(f.name).alias("field"), (F.col(f.name) if f.dataType.simpleString() == "double" else F.lit(None).cast("double")).alias("value_num"), (F.col(f.name) if f.dataType.simpleString() == "string" else F.lit(None).cast("string")).alias("value_text")) for f in rows.schema.fields if f.name not in keep]
    there = F.filter(F.array(*one), lambda x: x["value_num"].isNotNull() | F.coalesce(x["value_text"] != "", F.lit(False)))
    return rows.select("id", "building", F.inline(there)).withColumn("confidence", F.lit(0.999)).withColumn("method", F.concat(F.lit("xml:re2020:"), "field"))


CERTIFICATE = "administratif struct<date_etablissement_dpe: string, dpe_a_remplacer: string, reference_interne_projet: string, geolocalisation: struct<adresses: struct<adresse_bien: struct<ban_label: string, ban_postcode: string, ban_city: string>>>>, logement struct<caracteristique_generale: struct<annee_construction: int, surface_habitable_logement: double, surface_habitable_immeuble: double, nombre_appartement: double>, sortie: struct<ep_conso: struct<ep_conso_5_usages_m2: double, classe_bilan_dpe: string>, emission_ges: struct<emission_ges_5_usages_m2: double, classe_emission_ges: string>>>"


def certificates(docs: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    """(id, reference, study_date, address, postcode, city, construction_year, shab, housing_count, energy, carbon, energy_class, carbon_class) of certificates in XML; the classes are read, null where they are not there."""
    x = F.from_xml(F.col(xml_col), CERTIFICATE, {"mode": "PERMISSIVE", "rowTag": "dpe"})
    d = _once(docs, x=x).select(F.col(id_col).alias("id"), "x").filter("x.logement is not null")
    a, g, s = "x.administratif.geolocalisation.adresses.adresse_bien", "x.logement.caracteristique_generale", "x.logement.sortie"
    return d.select(
        "id", F.col("x.administratif.reference_interne_projet").alias("reference"), F.to_date("x.administratif.date_etablissement_dpe").alias("study_date"), F.col(f"{a}.ban_label").alias("address"), F.col(f"{a}.ban_postcode").alias("postcode"), F.col(f"{a}.ban_city").alias("city"),
        F.col(f"{g}.annee_construction").alias("construction_year"), F.coalesce(f"{g}.surface_habitable_immeuble", f"{g}.surface_habitable_logement").alias("shab"), F.col(f"{g}.nombre_appartement").alias("housing_count"),
        F.col(f"{s}.ep_conso.ep_conso_5_usages_m2").alias("energy"), F.col(f"{s}.emission_ges.emission_ges_5_usages_m2").alias("carbon"), F.col(f"{s}.ep_conso.classe_bilan_dpe").alias("energy_class"), F.col(f"{s}.emission_ges.classe_emission_ges").alias("carbon_class"),
    )
