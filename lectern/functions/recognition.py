"""What a document is, from its first characters: identity, date, issuer, court, area, parties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEAD = 4000
# Patterns of identities, months, issuers, courts and areas.
LAW = r"(?iu)\b(LEY\s+ESTATUTARIA|LEY|DECRETO\s+LEY|DECRETO|ACTO\s+LEGISLATIVO|RESOLUCI[OÓ]N|CIRCULAR|ACUERDO|ORDENANZA)\s+(?:N[oº°.]?\s*)?(\d{1,5})\s+(?:DE|DEL)\s+(\d{4})"
JUDGMENT = r"(?iu)\b(SU|C|T|A)\s*-\s*(\d{1,4})\s*(?:/\s*(\d{2})|\s+(?:DE|DEL)\s+(\d{4}))"
CODE = r"(?iu)\bC[OÓ]DIGO\s+([A-ZÁÉÍÓÚÑ][\wÁÉÍÓÚÑáéíóúñ\s]{3,60}?)(?=[.,\n]|\s+ART)"
CONSTITUTION = r"(?iu)\bCONSTITUCI[OÓ]N\s+POL[IÍ]TICA(?:\s+DE\s+COLOMBIA)?"
MONTHS = {"enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8, "septiembre": 9, "setiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12}
SPELLED = r"(?iu)\b(\d{1,2})\s+de\s+(" + "|".join(MONTHS) + r")\s+de\s+(\d{4})"
NUMERIC = r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b"
ISSUERS = (
    (r"CONGRESO\s+DE\s+COLOMBIA", "Congreso de Colombia"), (r"CONGRESO\s+DE\s+LA\s+REP[UÚ]BLICA", "Congreso de la República"),
    (r"PRESIDENTE\s+DE\s+LA\s+REP[UÚ]BLICA", "Presidencia de la República"), (r"ASAMBLEA\s+NACIONAL\s+CONSTITUYENTE", "Asamblea Nacional Constituyente"),
    (r"\bDIAN\b|DIRECCI[OÓ]N\s+DE\s+IMPUESTOS", "DIAN"),
)
MINISTRY = r"(?iu)(MINISTERIO\s+DE\s+(?:[A-ZÁÉÍÓÚÑ]+\s*){1,4})"
COURTS = (
    (r"CORTE\s+CONSTITUCIONAL", "CORTE_CONSTITUCIONAL"), (r"CORTE\s+SUPREMA\s+DE\s+JUSTICIA", "CORTE_SUPREMA_JUSTICIA"), (r"CONSEJO\s+DE\s+ESTADO", "CONSEJO_ESTADO"),
    (r"CONSEJO\s+SUPERIOR\s+DE\s+LA\s+JUDICATURA", "CONSEJO_SUPERIOR_JUDICATURA"), (r"JURISDICCI[OÓ]N\s+ESPECIAL\s+PARA\s+LA\s+PAZ|\bJEP\b", "JURISDICCION_ESPECIAL_PAZ"),
    (r"TRIBUNAL\s+ADMINISTRATIVO", "TRIBUNAL_ADMINISTRATIVO"), (r"TRIBUNAL\s+SUPERIOR", "TRIBUNAL_SUPERIOR"),
)
AREAS = {
    "CONSTITUCIONAL": ("constitución política", "derecho fundamental", "acción de tutela", "bloque de constitucionalidad", "exequible", "inexequible", "habeas corpus"),
    "PENAL": ("código penal", "delito", "punible", "pena privativa", "imputado", "fiscalía", "antijurídic", "dolo", "culpabilidad"),
    "LABORAL": ("contrato de trabajo", "trabajador", "empleador", "salario", "prestaciones sociales", "jornada laboral", "cesantías", "vacaciones remuneradas", "despido"),
    "TRIBUTARIO": ("estatuto tributario", "impuesto", "renta", "iva", "contribuyente", "declaración tributaria", "retención en la fuente", "dian"),
    "ADMINISTRATIVO": ("función pública", "acto administrativo", "contratación estatal", "entidad estatal", "servidor público", "cpaca", "secop"),
    "COMERCIAL": ("código de comercio", "sociedad comercial", "comerciante", "título valor", "establecimiento de comercio", "insolvencia"),
    "CIVIL": ("código civil", "obligación", "contrato civil", "bienes inmuebles", "prescripción adquisitiva", "responsabilidad contractual"),
    "PROCESAL": ("código general del proceso", "demanda", "recurso de apelación", "notificación", "término judicial", "caducidad", "competencia territorial"),
    "FAMILIA": ("código de infancia", "alimentos", "custodia", "patria potestad", "unión marital", "divorcio"),
    "SEGURIDAD_SOCIAL": ("sistema de seguridad social", "pensión", "eps", "afiliado", "riesgos laborales", "invalidez"),
    "AMBIENTAL": ("licencia ambiental", "recursos naturales", "impacto ambiental", "anla"),
}


def head(text: Column) -> Column:
    return F.substring(text, 1, HEAD)


def full_year(year: Column, two_digits: Column) -> Column:
    """The year given, else 1992 to 2091 from two digits."""
    two = F.nullif(two_digits, F.lit("")).cast("int")
    return F.coalesce(F.nullif(year, F.lit("")), F.when(two >= 92, two + 1900).otherwise(two + 2000).cast("string"))


def identify(text: Column) -> Column:
    """struct(pos, prio, type, external_id, title) of the earliest identity in the head; OTHER without one."""
    h = head(text)
    part = lambda p, i: F.regexp_extract(h, p, i)
    kind = F.upper(F.regexp_replace(part(LAW, 1), r"\s+", " "))
    law_type = F.replace(F.replace(kind, F.lit("Ó"), F.lit("O")), F.lit(" "), F.lit("_"))
    series, number, year = F.upper(part(JUDGMENT, 1)), part(JUDGMENT, 2), full_year(part(JUDGMENT, 4), part(JUDGMENT, 3))
    docket = F.concat(series, F.lit("-"), number)
    label = F.when(series == "A", "Auto").otherwise("Sentencia")
    none = F.lit(None).cast("string")
    found = [
        (CONSTITUTION, F.lit("CONSTITUCION"), F.lit("CONSTITUCION_POLITICA_1991"), F.lit("Constitución Política de Colombia")),
        (LAW, law_type, F.concat_ws("_", law_type, part(LAW, 2), part(LAW, 3)), F.concat(F.initcap(kind), F.lit(" "), part(LAW, 2), F.lit(" de "), part(LAW, 3))),
        (JUDGMENT, F.when(series == "A", "AUTO").otherwise("SENTENCIA"), F.concat(docket, F.lit("-"), year), F.concat(label, F.lit(" "), docket, F.lit(" de "), year)),
        (CODE, F.lit("CODIGO"), none, F.concat(F.lit("Código "), F.initcap(F.trim(F.regexp_replace(part(CODE, 1), r"\s+", " "))))),
    ]
    as_row = lambda pos, prio, t, e, n: F.struct(pos.alias("pos"), F.lit(prio).alias("prio"), t.alias("type"), e.alias("external_id"), n.alias("title"))
    rows = [F.when(h.rlike(p), as_row(F.length(F.regexp_extract(h, f"(?s)^(.*?)(?:{p})", 1)), i, t, e, n)) for i, (p, t, e, n) in enumerate(found)]
    return F.coalesce(F.array_min(F.array_compact(F.array(*rows))), as_row(F.lit(0), 9, F.lit("OTRO"), none, none))


def publication_date(text: Column) -> Column:
    """The first spelled date, else the first numeric one; an impossible date is null and does not fall through."""
    h = head(text)
    month = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    of = lambda y, m, d: F.when(y.cast("int").between(1800, 2100), F.try_to_date(F.concat_ws("-", y, F.lpad(m.cast("string"), 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd"))
    part = lambda p, i: F.nullif(F.regexp_extract(h, p, i), F.lit(""))
    spelled = of(part(SPELLED, 3), F.try_element_at(month, F.lower(part(SPELLED, 2))), part(SPELLED, 1))
    return F.when(h.rlike(SPELLED), spelled).when(h.rlike(NUMERIC), of(part(NUMERIC, 3), part(NUMERIC, 2), part(NUMERIC, 1)))


def issuer(text: Column) -> Column:
    h = head(text)
    ministry = F.initcap(F.trim(F.regexp_replace(F.regexp_extract(h, MINISTRY, 1), r"\s+", " ")))
    return F.substring(F.coalesce(*[F.when(h.rlike(f"(?iu){p}"), F.lit(n)) for p, n in ISSUERS], F.nullif(ministry, F.lit(""))), 1, 255)


def court(text: Column) -> Column:
    return F.coalesce(*[F.when(head(text).rlike(f"(?iu){p}"), F.lit(n)) for p, n in COURTS])


def legal_area(text: Column) -> Column:
    """The area with most of its terms in the text, if it has two at least and no rival."""
    low = F.lower(F.substring(text, 1, 20000))
    scores = F.array(*[F.struct(sum((low.contains(t).cast("int") for t in terms), F.lit(0)).alias("n"), F.lit(a).alias("area")) for a, terms in AREAS.items()])
    ranked = F.sort_array(scores, asc=False)
    return F.when((ranked[0].n >= 2) & (ranked[0].n > ranked[1].n), ranked[0].area)


# Words of procedural classes and of jurisdictions, first match first.
CLASSES = (
    (("accion de tutela", "acción de tutela", "juez de tutela"), "Acción de Tutela"), (("demanda ordinaria", "proceso ordinario laboral", "cptss"), "Demanda Ordinaria Laboral"),
    (("demanda declarativa", "proceso verbal", "cgp", "ley 1564"), "Demanda Civil / CGP"), (("contrato",), "Contrato / Minuta"),
    (("derecho de peticion", "derecho de petición", "articulo 23 cp"), "Derecho de Petición"), (("sentencia", "corte constitucional", "corte suprema", "consejo de estado"), "Providencia / Sentencia Judicial"),
    (("recurso de apelacion", "recurso de reposicion", "recurso de queja"), "Recurso Procesal"),
)
JURISDICTIONS = (
    (("constitucional", "tutela"), "Jurisdicción Constitucional"), (("laboral", "cst"), "Jurisdicción Laboral y Seguridad Social"), (("civil", "cgp", "comercial"), "Jurisdicción Civil y Comercial"),
    (("administrativ", "cpaca", "consejo de estado"), "Jurisdicción de lo Contencioso Administrativo"), (("penal", "fiscal", "ley 906"), "Jurisdicción Penal"),
)


#: Words whose letters stand in others by chance, and the forms that count: abbreviations as whole words, which e-mail addresses and keys can hold; "laboral" and what derives from it, with any prefix.
FORMS = {w: rf"(?U)\b{w}\b(?![\w.+-]*@)" for w in ("cptss", "cgp", "cst", "cpaca")} | {"laboral": r"(?U)laboral(?:es|mente|i\w*)?\b"}


def first_class(text: Column, classes, default: str) -> Column:
    low, out = F.lower(text), F.lit(default)
    holds = lambda w: low.contains(w) & low.rlike(FORMS[w]) if w in FORMS else low.contains(w)
    for words, name in reversed(classes):
        hit = F.lit(False)
        for w in words:
            hit = hit | holds(w)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def doc_class(text: Column) -> Column:
    return first_class(text, CLASSES, "Documento Jurídico General")


def jurisdiction_class(text: Column) -> Column:
    return first_class(text, JURISDICTIONS, "Jurisdicción Ordinaria (Colombia)")


# Case numbers, parties and clauses.
CASE = r"(?iu)(?:radicaci[oó]n|radicado|expediente|n[uú]mero)\s*(?:no\.?|n°|:)?\s*([0-9\-]{8,25})"
CLAIMANT = r"(?iu)(?:demandante|accionante|solicitante|convocante)\s*(?:es|:|\-)?\s*([A-ZÁÉÍÓÚÑ][A-Za-záéíóúñ\s\.]{3,50})"
DEFENDANT = r"(?iu)(?:demandad[oa]|accionad[oa]|solicitad[oa]|convocad[oa])\s*(?:es|:|\-)?\s*([A-ZÁÉÍÓÚÑ][A-Za-záéíóúñ\s\.]{3,50})"
CLAUSE = r"(?imdu)^\s*(?:cl[aá]usula|art[ií]culo|hecho|pretensi[oó]n)\s+([^\n\:\.]{1,40})[:\.\-]\s*([^\n]+)"


def case_fields(text: Column) -> Column:
    get = lambda p: F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit(""))
    return F.struct(get(CASE).alias("case_number"), get(CLAIMANT).alias("claimant"), get(DEFENDANT).alias("defendant"))


def key_clauses(text: Column, most: int = 5) -> Column:
    """array<struct(title, summary)>: of the first clauses those with over 10 characters, cut at 140."""
    z = F.slice(F.arrays_zip(F.regexp_extract_all(text, F.lit(CLAUSE), 1).alias("t"), F.regexp_extract_all(text, F.lit(CLAUSE), 2).alias("s")), 1, most)
    long = F.filter(z, lambda x: F.length(F.trim(x.s)) > 10)
    return F.transform(long, lambda x: F.struct(F.initcap(F.trim(x.t)).alias("title"), F.concat(F.substring(F.trim(x.s), 1, 140), F.when(F.length(x.s) > 140, "...").otherwise("")).alias("summary")))
