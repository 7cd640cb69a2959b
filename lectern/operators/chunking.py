"""Cutting texts at their structural headings, and long sections at paragraphs and sentences."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import estimate_tokens, stripped

CHUNK_SIZE, OVERLAP, MIN_SIZE = 1000, 200, 100
_ORDINAL, _SEP = r"(?:[oº°ª]\.?)?", r"\s*(?:[.\-–:)]|\s)"
# Headings as (kind, label, depth, pattern). A line that fits several is of the outermost kind, of two at one depth the first.
HEADINGS = (
    ("ARTICULO", "Artículo", 6, rf"(?iu)^\s*(?:ART[IÍ]CULOS?|ARTS?\.?)\s+(\d+[A-Za-z]?|[IVXLCDM]+|[ÚU]NICO|TRANSITORIO){_ORDINAL}{_SEP}"),
    ("PARAGRAFO", "Parágrafo", 7, rf"(?iu)^\s*(?:PAR[AÁ]GRAFOS?|PAR[AÁ]GS?\.?|PAR\.)\s*(\d+|[IVXLCDM]+|[ÚU]NICO|TRANSITORIO)?{_ORDINAL}{_SEP}"),
    ("LIBRO", "Libro", 1, rf"(?iu)^\s*LIBRO\s+([IVXLCDM]+|\d+|PRIMERO|SEGUNDO|TERCERO|CUARTO|QUINTO){_ORDINAL}\b"),
    ("PARTE", "Parte", 1, rf"(?iu)^\s*PARTE\s+([IVXLCDM]+|\d+|PRIMERA|SEGUNDA|TERCERA|CUARTA)\b"),
    ("TITULO", "Título", 2, rf"(?iu)^\s*T[IÍ]TULO\s+([IVXLCDM]+|\d+|PRELIMINAR|[ÚU]NICO){_ORDINAL}\b"),
    ("CAPITULO", "Capítulo", 3, rf"(?iu)^\s*CAP[IÍ]TULO\s+([IVXLCDM]+|\d+|[ÚU]NICO){_ORDINAL}\b"),
    ("SUBSECCION", "Subsección", 5, rf"(?iu)^\s*SUBSECCI[OÓ]N\s+([IVXLCDM]+|\d+|[ÚU]NICA){_ORDINAL}\b"),
    ("SECCION", "Sección", 4, rf"(?iu)^\s*SECCI[OÓ]N\s+([IVXLCDM]+|\d+|[ÚU]NICA){_ORDINAL}\b"),
    ("CONSIDERANDO", "Considerando", 6, r"(?iu)^\s*(CONSIDERANDO|CONSIDERACIONES(?:\s+DE\s+LA\s+CORTE)?)\s*:?\s*$"),
    ("RESUELVE", "Resuelve", 6, r"(?iu)^\s*(RESUELVE|DECIDE|DECRETA|ORDENA|FALLA)\s*:?\s*$"),
    ("NUMERAL", "Numeral", 8, r"(?iu)^\s*(PRIMERO|SEGUNDO|TERCERO|CUARTO|QUINTO|SEXTO|S[EÉ]PTIMO|OCTAVO|NOVENO|D[EÉ]CIMO)\s*[.\-–:]"),
    ("NUMERAL", "Numeral", 8, r"^\s*(\d+(?:\.\d+)*)\s*[.)]\s+(?=[A-ZÁÉÍÓÚÑa-záéíóúñ])"),
    ("LITERAL", "Literal", 9, r"^\s*(?:LITERAL\s+)?([a-z])\s*[.)]\s+(?=[A-ZÁÉÍÓÚÑa-záéíóúñ])"),
)
DEPTHS = tuple(range(1, 10))


def find_sections(docs: DataFrame) -> DataFrame:
    """(id, i, kind, number, label, depth, start): headings of (id, text) in order.

    A heading stands at a line's start; it begins with the blank lines before it.
    """
    lines = docs.select("id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    w = Window.partitionBy("id").orderBy("n")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumn("end", F.sum(F.length("line") + 1).over(w)).withColumn("filled_end", F.coalesce(F.max(F.when(F.trim("line") != "", F.col("end"))).over(before), F.lit(0)))
    last = F.lead("n").over(w).isNull()
    text = F.when(last, F.col("line")).otherwise(F.concat("line", F.lit("\n")))
    hit = F.lit(None).cast("struct<kind:string,label:string,depth:int,number:string>")
    for kind, label, depth, pattern in sorted(HEADINGS, key=lambda h: h[2])[::-1]:
        number = F.nullif(F.trim(F.regexp_extract("t", pattern, 1)), F.lit(""))
        number = F.when(F.upper(number) == kind, F.lit(None)).otherwise(number)
        hit = F.when(F.col("t").rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"), F.lit(depth).alias("depth"), number.alias("number"))).otherwise(hit)
    found = placed.withColumn("t", text).where(F.trim("line") != "").withColumn("h", hit).where("h is not null")
    label = F.concat_ws(" ", "h.label", "h.number")
    i = F.row_number().over(Window.partitionBy("id").orderBy("n")) - 1
    return found.select("id", i.alias("i"), "h.kind", "h.number", label.alias("label"), "h.depth", F.col("filled_end").alias("start"))


def section_paths(sections: DataFrame) -> DataFrame:
    """sections with section, article_number, path and stack size, from the open heading of each depth."""
    w = Window.partitionBy("id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    df = sections
    for d in DEPTHS:
        here = F.when(F.col("depth") == d, F.struct("i", "label", "kind", "number"))
        df = df.withColumn(f"l{d}", F.last(here, ignorenulls=True).over(w)).withColumn(f"c{d}", F.max(F.when(F.col("depth") < d, F.col("i"))).over(w))
    open_ = F.array_compact(F.array(*[F.when((F.lit(d) <= F.col("depth")) & (F.coalesce(F.col(f"c{d}"), F.lit(-1)) < F.col(f"l{d}.i")), F.col(f"l{d}")) for d in DEPTHS]))
    df = df.withColumn("stack", open_).drop(*[f"{x}{d}" for x in "lc" for d in DEPTHS])
    article = F.element_at(F.filter("stack", lambda s: s.kind == "ARTICULO"), -1).number
    df = df.withColumn("article_number", F.when(F.exists("stack", lambda s: s.kind == "ARTICULO"), article))
    inner = F.when((F.col("kind") == "ARTICULO") | F.col("article_number").isNull(), F.col("label")).otherwise(F.concat(F.lit("Artículo "), "article_number", F.lit(" > "), "label"))
    return df.select("id", "i", "kind", "depth", "start", F.substring(inner, 1, 512).alias("section"), "article_number", F.substring(F.array_join(F.transform("stack", lambda s: s.label), " > "), 1, 2000).alias("path"), F.size("stack").alias("levels"))


def _tokens_of(n: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(n / F.lit(3.6), 0).cast("int"))


def merge_spans(docs: DataFrame, paths: DataFrame, chunk_size: int = CHUNK_SIZE, min_size: int = MIN_SIZE) -> DataFrame:
    """(id, n, start, end, section, article_number, path): spans from heading to heading, short ones joined to the next.

    Text before the first heading is a span if it is long enough. The shallower stack is kept.
    """
    ends = paths.withColumn("end", F.lead("start").over(Window.partitionBy("id").orderBy("i"))).join(docs.select("id", F.length("text").alias("len")), "id")
    spans = ends.select("id", "i", "start", F.coalesce("end", "len").alias("end"), "section", "article_number", "path", "levels")
    head = spans.where("i = 0 and start > 0").where(_tokens_of(F.col("start")) >= min_size)
    none = F.lit(None).cast("string")
    all_ = spans.unionByName(head.select("id", F.lit(-1).alias("i"), F.lit(0).alias("start"), F.col("start").alias("end"), none.alias("section"), none.alias("article_number"), none.alias("path"), F.lit(0).alias("levels")))
    item = F.struct("i", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("levels").cast("int").alias("levels"))
    rows = all_.groupBy("id").agg(F.array_sort(F.collect_list(item)).alias("a"))

    @F.pandas_udf("array<struct<start:long,end:long,owner:int>>")
    def joined(owners: pd.Series, starts: pd.Series, ends: pd.Series, levels: pd.Series) -> pd.Series:
        return pd.Series([merged_spans(*x, chunk_size, min_size) for x in zip(owners, starts, ends, levels, strict=True)])

    merged = rows.select("id", F.posexplode(joined(*[F.col(f"a.{c}") for c in ("i", "start", "end", "levels")])).alias("n", "s")).select("id", "n", "s.*")
    return merged.join(all_.select("id", F.col("i").alias("owner"), "section", "article_number", "path"), ["id", "owner"]).select("id", "n", "start", "end", "section", "article_number", "path")


def merged_spans(owners: Sequence[int], starts: Sequence[int], ends: Sequence[int], levels: Sequence[int], chunk_size: int, min_size: int) -> list[dict]:
    """One pass over a text's spans; of joined ones the first of the fewest levels owns the span."""
    tokens = lambda n: max(1, round(n / 3.6))
    out: list[dict] = []
    shallow = 0
    for owner, start, end, level in zip(owners, starts, ends, levels, strict=True):
        if out and tokens(out[-1]["end"] - out[-1]["start"]) < min_size and tokens(end - out[-1]["start"]) <= chunk_size:
            out[-1]["end"] = int(end)
            if level < shallow:
                out[-1]["owner"], shallow = int(owner), level
        else:
            out.append({"start": int(start), "end": int(end), "owner": int(owner)})
            shallow = level
    return out


def emit_chunks(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """One chunk for each span: its text without outer blanks, exact offsets, tokens."""
    j = spans.join(docs.select("id", "text"), "id").withColumn("raw", F.substring(F.col("text"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")))
    lead = F.length(F.regexp_extract("raw", r"(?U)^\s*", 0))
    out = j.withColumn("content", stripped(F.col("raw"))).where("content <> ''").withColumn("char_start", F.col("start") + lead)
    index = F.row_number().over(Window.partitionBy("id").orderBy("n")) - 1
    return out.select("id", index.alias("chunk_index"), "section", "article_number", "path", "content", "char_start", (F.col("char_start") + F.length("content")).alias("char_end"), estimate_tokens(F.col("content")).alias("tokens"))


PARAGRAPH = r"\n\s*\n"
SENTENCE = "(?<=[.;:])\\s+(?=[A-ZÁÉÍÓÚÑ0-9¿«\"])"


def split_units(body: Column) -> Column:
    """array<struct(text, len, filled)>: sentences of paragraphs with the blanks after them, their length without those, and whether they hold more than blanks."""
    marked = F.regexp_replace(F.regexp_replace(body, PARAGRAPH, "\x01$0\x02"), SENTENCE, "\x01$0\x02")
    return F.transform(F.split(marked, "\x02"), lambda p: F.struct(F.replace(p, F.lit("\x01"), F.lit("")).alias("text"), F.length(F.substring_index(p, "\x01", 1)).alias("len"), (F.regexp_replace(F.substring_index(p, "\x01", 1), r"\s", "") != "").alias("filled")))


def greedy_parts(tokens: np.ndarray, size: int, overlap: int) -> list[tuple[int, int]]:
    """(first, after last) of parts of whole units: each as long as it keeps within `size` but with one new unit at least, then back by the fewest units that reach `overlap`, never by all of a part."""
    upto = np.concatenate(([0], np.cumsum(tokens)))
    out, a, b, n = [], 0, 0, len(tokens)
    while True:
        b = max(b + 1, int(np.searchsorted(upto, upto[a] + size, side="right")) - 1)
        if b >= n:
            return [*out, (a, n)]
        out.append((a, b))
        a = b if overlap <= 0 else max(a + 1, int(np.searchsorted(upto[:b], upto[b] - overlap, side="right")) - 1)


def divide(bodies: DataFrame, chunk_size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(id, part, total, char_start, char_end, content): greedy parts of whole units, the last units of a part repeated.

    The repeated units are the fewest that reach `overlap` tokens, never all of a part. A text
    within the size is one part. A text stays in its row; only the lengths of its units are folded.
    """

    @F.pandas_udf("array<struct<first:int,units:int,off:long>>")
    def parted(lens: pd.Series, wholes: pd.Series, filled: pd.Series) -> pd.Series:
        out = []
        for own, whole, has in zip(lens, wholes, filled, strict=True):
            at = np.flatnonzero(np.asarray(has, bool))
            offs = np.concatenate(([0], np.cumsum(whole)))
            tokens = np.maximum(1, np.round(np.asarray(own, float)[at] / 3.6)).astype(np.int64)
            out.append([{"first": int(at[a]), "units": int(at[b - 1] - at[a]) + 1, "off": int(offs[at[a]])} for a, b in greedy_parts(tokens, chunk_size, overlap)] if at.size else [])
        return pd.Series(out)

    rows = bodies.select("id", split_units(F.col("body")).alias("u"))
    cut = rows.select("id", "u", parted(F.col("u.len"), F.transform("u", lambda x: F.length(x.text)), F.col("u.filled")).alias("p"))
    raw = lambda p: F.array_join(F.transform(F.slice("u", p.first + 1, p.units), lambda x: x.text), "")
    made = F.transform("p", lambda p: F.struct(p.off.alias("off"), raw(p).alias("raw")))
    out = cut.select("id", F.size("p").alias("total"), F.posexplode(made).alias("part", "x")).select("id", (F.col("part") + 1).alias("part"), "total", "x.*")
    lead = F.length(F.regexp_extract("raw", r"(?U)^\s*", 0))
    placed = out.select("id", "part", "total", (F.col("off") + lead).alias("char_start"), stripped(F.col("raw")).alias("content"))
    return placed.withColumn("char_end", F.col("char_start") + F.length("content"))


def chunk_invariants(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks that are not verbatim, leave a gap in their index, or hold no token; none is expected."""
    j = chunks.join(docs.select("id", "text"), "id")
    gap = F.col("chunk_index") - F.coalesce(F.lag("chunk_index").over(Window.partitionBy("id").orderBy("chunk_index")), F.lit(-1)) != 1
    verbatim = F.substring(F.col("text"), (F.col("char_start") + 1).cast("int"), (F.col("char_end") - F.col("char_start")).cast("int")) == F.col("content")
    rule = F.when(~verbatim, "verbatim").when(gap, "index").when(F.col("tokens") <= 0, "tokens")
    return j.withColumn("rule", rule).where("rule is not null").select("id", "chunk_index", "rule")


def article_number(section: Column, own: Column) -> Column:
    """The article number given, else the one that the section names."""
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(F.regexp_extract(section, r"(?iu)art[ií]culo\s+([0-9]+[A-Za-z\-]*)", 1), F.lit("")))
