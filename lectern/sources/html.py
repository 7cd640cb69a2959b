"""Main text, titles, addresses and labelled fields of web pages, by expressions on the markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements that hold no text of the document, and where its text is looked for, in order.
DROPPED = ("script", "style", "nav", "header", "footer", "aside", "form", "button", "noscript", "iframe", "svg")
SELECTORS = (
    ("main", "(?is)<main\\b[^>]*>(.*)</main\\s*>"), ("article", "(?is)<article\\b[^>]*>(.*)</article\\s*>"),
    ("[role=main]", "(?is)<\\w+[^>]*\\brole=[\"']?main\\b[^>]*>(.*)</"), ("#contenido", "(?is)<\\w+[^>]*\\bid=[\"']?contenido\\b[^>]*>(.*)</"),
    ("#content", "(?is)<\\w+[^>]*\\bid=[\"']?content\\b[^>]*>(.*)</"), (".contenido", "(?is)<\\w+[^>]*\\bclass=[\"'][^\"']*\\bcontenido\\b[^>]*>(.*)</"),
    (".content", "(?is)<\\w+[^>]*\\bclass=[\"'][^\"']*\\bcontent\\b[^>]*>(.*)</"), ("#texto", "(?is)<\\w+[^>]*\\bid=[\"']?texto\\b[^>]*>(.*)</"),
    (".texto-norma", "(?is)<\\w+[^>]*\\bclass=[\"'][^\"']*\\btexto-norma\\b[^>]*>(.*)</"), (".documento", "(?is)<\\w+[^>]*\\bclass=[\"'][^\"']*\\bdocumento\\b[^>]*>(.*)</"),
)
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))
LEAST = 200


def unescaped(text: Column) -> Column:
    for entity, c in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(c))
    return text


def lines_of(markup: Column) -> Column:
    """Text between tags, one piece a line, trimmed, without empty lines."""
    parts = F.split(unescaped(F.regexp_replace(markup, "(?s)<[^>]*>", "\n")), "\n")
    return F.array_join(F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != ""), "\n")


def extract_html(pages: DataFrame) -> DataFrame:
    """(page_id, text, selector): the first place with over 200 characters of text, else the body, else all.

    A place runs from its first opening to its last closing tag; markup is not parsed into a tree.
    """
    html = F.regexp_replace("html", "(?s)<!--.*?-->", "")
    for tag in DROPPED:
        html = F.regexp_replace(html, f"(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>", "")
    df = pages.select("page_id", html.alias("h"))
    found = [F.struct(F.lit(name).alias("selector"), lines_of(F.regexp_extract("h", pattern, 1)).alias("text")) for name, pattern in SELECTORS]
    body = F.regexp_extract("h", "(?is)<body\\b[^>]*>(.*)</body\\s*>", 1)
    rest = F.when(body != "", F.struct(F.lit("body").alias("selector"), lines_of(body).alias("text"))).otherwise(F.struct(F.lit("document").alias("selector"), lines_of(F.col("h")).alias("text")))
    place = F.coalesce(*[F.when(F.length(F.replace(f.text, F.lit("\n"), F.lit(""))) > LEAST, f) for f in found], rest)
    return df.select("page_id", place.alias("p")).select("page_id", "p.text", "p.selector")


def html_title(html: Column) -> Column:
    """The visible heading of 10 to 512 characters, else the title within those bounds."""
    clean = lambda x: F.trim(F.regexp_replace(unescaped(F.regexp_replace(x, "(?s)<[^>]*>", " ")), r"\s+", " "))
    h1, title = (clean(F.regexp_extract(html, f"(?is)<{t}\\b[^>]*>(.*?)</{t}\\s*>", 1)) for t in ("h1", "title"))
    return F.coalesce(*[F.when(F.length(x).between(10, 512), x) for x in (h1, title)])


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a tag, in quotes or bare; empty where it has none."""
    pattern = f"(?is)\\s{name}\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)'|([^\\s\"'>]+))"
    return F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])


def html_canonical(html: Column) -> Column:
    """The page's own address: canonical link, else og:url, if it is an http address; attributes in any order."""
    first = lambda tags: F.get(tags, F.lit(0))
    links = F.filter(F.regexp_extract_all(html, F.lit("(?is)(<link\\b[^>]*>)"), 1), lambda t: F.array_contains(F.split(F.lower(attribute(t, "rel")), r"\s+"), "canonical"))
    metas = F.filter(F.regexp_extract_all(html, F.lit("(?is)(<meta\\b[^>]*>)"), 1), lambda t: attribute(t, "property") == "og:url")
    return F.coalesce(*[F.when(x.startswith("http"), x) for x in (attribute(first(links), "href"), attribute(first(metas), "content"))])


# Labels of a portal's record, its disclaimer, and words of list items that are no topics.
LABELS = {"issued": "Fecha de Expedición:", "effective": "Fecha de Entrada en Vigencia:", "medium": "Medio de Publicación:"}
DISCLAIMER = "Los datos publicados tienen propósitos exclusivamente informativos."
NO_TOPIC = ("concepto", "vigencia", "fecha")


def portal_fields(pages: DataFrame) -> DataFrame:
    """(page_id, issued, effective, medium, topics, text) of record pages (page_id, html): labelled lines, list items, the text after the disclaimer."""
    t = pages.select("page_id", "html", lines_of(F.col("html")).alias("t"))
    fields = [F.nullif(F.trim(F.regexp_extract("t", f"(?md)^{label}(.*)$", 1)), F.lit("")).alias(name) for name, label in LABELS.items()]
    items = F.transform(F.regexp_extract_all("html", F.lit("(?is)<li\\b[^>]*>(.*?)</li\\s*>"), 1), lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", "")))
    topics = F.filter(items, lambda x: (F.length(x) > 3) & ~F.lower(x).rlike("|".join(NO_TOPIC)))
    at = F.instr("t", DISCLAIMER)
    after = F.regexp_replace(F.substring(F.col("t"), at + len(DISCLAIMER), F.length("t")), r"^[^\n]*\n", "")
    return t.select("page_id", *fields, topics.alias("topics"), F.when(at > 0, after).otherwise(F.col("t")).alias("text"))


MOST_UPLOADED = 50


def article_rows(pages: DataFrame) -> DataFrame:
    """(page_id, title, position, number, text) of list pages (page_id, title, html): headings that link an article, each with the text block that follows."""
    pattern = "(?is)<h3[^>]*>\\s*<a[^>]*>([^<]*)</a>\\s*</h3>\\s*<div class=[\"']texto[\"'][^>]*>(.*?)</div>"
    zipped = F.arrays_zip(F.regexp_extract_all("html", F.lit(pattern), 1).alias("number"), F.regexp_extract_all("html", F.lit(pattern), 2).alias("text"))
    rows = pages.select("page_id", "title", F.posexplode(zipped).alias("position", "a"))
    return rows.select("page_id", "title", "position", F.trim("a.number").alias("number"), lines_of(F.col("a.text")).alias("text")).where(F.col("number").contains("Art"))


def uploaded_articles(pages: DataFrame, most: int = MOST_UPLOADED) -> DataFrame:
    """(page_id, position, number, text): the first `most` article blocks of an uploaded page, their number and their text elements."""
    blocks = F.regexp_extract_all("html", F.lit("(?is)<div\\b[^>]*\\bclass=[\"'][^\"']*\\barticulo\\b[^>]*>(.*?)(?=<div\\b[^>]*\\bclass=[\"'][^\"']*\\barticulo\\b|$)"), 1)
    part = lambda x, name: lines_of(F.regexp_extract(x, f"(?is)<(\\w+)\\b[^>]*\\bclass=[\"'][^\"']*\\b{name}\\b[^>]*>(.*?)</\\1\\s*>", 2))
    rows = pages.select("page_id", F.posexplode(F.slice(blocks, 1, most)).alias("position", "b"))
    return rows.select("page_id", "position", part(F.col("b"), "numero").alias("number"), part(F.col("b"), "texto").alias("text")).where("number <> '' and text <> ''")
