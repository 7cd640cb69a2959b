"""Text preparation as column expressions; only texts that are not in composed form leave the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters that are folded, one for one, to nothing, or to a longer text.
ONE_FOR_ONE = {
    " ": " ", " ": " ", " ": " ", "‘": "'", "’": "'", "‚": "'", "“": '"', "”": '"',
    "–": "-", "—": "-", "―": "-", "\t": " ",
}
DROPPED = "​‌‍﻿­"
ELLIPSIS = ("…", "...")
CHARS_PER_TOKEN = 3.6

#: Texts of these characters alone are composed already (NFC); a test holds every one of them to that.
COMPOSED = "\\x{0}-\\x{2ff}\\x{2002}-\\x{2027}\\x{2030}-\\x{205e}\\x{20a0}-\\x{20bf}\\x{2122}\\x{feff}"


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def composed(text: Column) -> Column:
    """The text in Unicode's composed form (NFC); only texts with a character that can change are handed to Python."""
    return F.coalesce(_nfc(F.when(text.rlike(r"[^\x00-\x7f]") & ~text.rlike(f"^[{COMPOSED}]*+\\z"), text)), text)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_confusables(text: Column) -> Column:
    return folded(composed(text))


def folded(text: Column) -> Column:
    """fold_confusables of a composed text; plain expressions, so that it may stand in a lambda."""
    plain = F.translate(text, "".join(ONE_FOR_ONE) + DROPPED, "".join(ONE_FOR_ONE.values()))
    return F.when(text.rlike(r"[^\x00-\x08\x0a-\x7f]"), F.replace(plain, F.lit(ELLIPSIS[0]), F.lit(ELLIPSIS[1]))).otherwise(text)  # all that is folded is a tab or no ASCII


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_query(text: Column) -> Column:
    return stripped(F.regexp_replace(F.replace(fold_confusables(text), F.lit("\n"), F.lit(" ")), " {2,}", " "))


# Whole lines that are page furniture.
FURNITURE = (
    r"p[áa]g(?:ina|\.)?\s*\d+(?:\s*(?:de|/)\s*\d+)?",
    r"-+\s*\d+\s*-+",
    r"\d{1,4}",
    r"diario\s+oficial(?:\s+n[oº°.]?\s*[\d.]+)?.*",
    r"gaceta\s+(?:oficial|del\s+congreso).*",
    r"imprimir|compartir|descargar|volver|inicio",
    r"[^\p{L}\p{N}]{3,}",
)
_LOW = "a-záéíóúñü"


def clean_text(text: Column) -> Column:
    """struct(text, original_length, cleaned_length, dropped, rejoined): folding, line ends, words and
    sentences rejoined across lines, furniture lines dropped, blanks collapsed."""
    folded = F.replace(F.replace(fold_confusables(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    hyphen = f"(?<=[{_LOW}])-\\n(?=[{_LOW}])"
    lines_of = lambda f: F.transform(F.split(F.regexp_replace(F.regexp_replace(f, hyphen, ""), f"(?<=[{_LOW},;])\\n(?=[{_LOW}])", " "), "\n"), stripped)
    kept_of = lambda lines: F.filter(lines, lambda x: ~x.rlike("(?iu)^(?:" + "|".join(FURNITURE) + ")$"))
    text_of = lambda kept: stripped(F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), " {2,}", " "), r"\n{3,}", "\n\n"))
    rejoined = lambda f: F.regexp_count(f, F.lit(hyphen))
    row = lambda f, lines, kept, out: F.struct(out.alias("text"), F.length(text).alias("original_length"), F.length(out).alias("cleaned_length"), (F.size(lines) - F.size(kept)).alias("dropped"), rejoined(f).alias("rejoined"))
    return let(folded, lambda f: let(lines_of(f), lambda lines: let(kept_of(lines), lambda kept: let(text_of(kept), lambda out: row(f, lines, kept, out)))))


def removed_ratio(original: Column, cleaned: Column) -> Column:
    return F.when(original == 0, F.lit(0.0)).otherwise(1 - cleaned / original)


def clean_markdown(text: Column) -> Column:
    unix = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    few = F.regexp_replace(unix, r"\n{3,}", "\n\n")
    pages = F.regexp_replace(few, r"(?iumd)^\s*p[aá]gina\s+\d+\s+(?:de\s+\d+)?\s*$", "")
    return stripped(F.regexp_replace(pages, r"(?iumd)^\s*folio\s+\d+\s*$", ""))


def estimate_tokens(text: Column) -> Column:
    """Tokens at 3.6 characters, halves to even, at least 1."""
    return F.greatest(F.lit(1), F.bround(F.length(text) / F.lit(CHARS_PER_TOKEN), 0).cast("int"))


def estimate_tokens_upload(text: Column) -> Column:
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / F.lit(3.8)).cast("int")))


def estimate_tokens_floor4(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def estimate_tokens_ceil4(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("int")


def folded_terms(text: Column) -> Column:
    """Lower-cased words without accents; a text of ASCII alone has none, and takes the shorter way to the same words."""
    wide = F.regexp_extract_all(F.translate(F.lower(text), "áéíóúüñ", "aeiouun"), F.lit(r"(?U)(\w+)"), 1)
    return F.when(text.rlike(r"[^\x00-\x7f]"), wide).otherwise(F.regexp_extract_all(F.lower(text), F.lit(r"\w+"), 0))


# Greetings and help phrases, without accents.
GREETINGS = ("hola", "buenas", "saludos", "buenos dias", "buenas tardes", "buenas noches", "hey", "hi", "hello")
HELP = ("quien eres", "que puedes hacer", "como funcionas", "como me ayudas", "en que me puedes ayudar")
PHRASES = (
    "hola", "buenas", "buenos dias", "buenas tardes", "buenas noches", "saludos", "hey", "hi", "hello", "que tal", "como estas", "como te va",
    "hola como estas", "hola buenas", "quien eres", "que puedes hacer", "como funcionas", "como me puedes ayudar", "que haces",
    "gracias", "muchas gracias", "ok gracias", "listo gracias", "adios", "chao", "hasta luego", "buen dia", "feliz dia", "ayuda",
)
_ACCENTED, _PLAIN = "áàâäãéèêëíìîïóòôöõúùûüñç", "aaaaaeeeeiiiiooooouuuunc"


def is_conversational(text: Column, more: tuple[str, ...] = ()) -> Column:
    """Whether a turn only greets or asks for help; `more` holds a service's own phrases, such as questions after its name."""
    plain = F.translate(F.lower(composed(text)), _ACCENTED, _PLAIN)
    norm = F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9\s]", " "), r"\s+", " "))
    n = F.size(F.split(norm, " "))
    starts = F.lit(False)
    for g in GREETINGS:
        starts = starts | norm.startswith(g)
    helps = F.lit(False)
    for h in HELP:
        helps = helps | norm.contains(h)
    return (norm == "") | norm.isin(*PHRASES, *more) | ((n <= 5) & starts) | ((n <= 6) & helps)


# What asks for the web; the first as it is written, the others in any case.
WEB_MODE, WEB_PHRASES = "[MODO: BÚSQUEDA WEB", ("buscar en internet", "noticias")


def wants_web(text: Column) -> Column:
    """Whether a turn asks for a live search; a null turn doesn't."""
    asks = text.contains(WEB_MODE)
    for phrase in WEB_PHRASES:
        asks = asks | F.lower(text).contains(phrase)
    return F.coalesce(asks, F.lit(False))


def clean_search_query(q: Column) -> Column:
    a = F.regexp_replace(q, r"\[[^\]]+\]", "")
    b = F.regexp_replace(a, r"(?i)Consulta del litigante:\s*", "")
    c = F.regexp_replace(b, r"(?i)Analiza este documento[^\n]*", "")
    d = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(d) >= 3, d).otherwise(stripped(q))


def domain(url: Column, default: str = "web") -> Column:
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.when(host == "", F.lit(default)).otherwise(F.replace(host, F.lit("www."), F.lit("")))


def citation_markers(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"\[(\d{1,9})\]"), 1)
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int"))))


# Keys whose values never leave the service.
FORBIDDEN = ("message_content", "query", "question", "answer", "prompt", "context", "chunk_content", "excerpt", "password", "api_key", "token", "authorization", "secret")


def redact(json_text: Column) -> Column:
    """The object as a map with the values of forbidden keys replaced."""
    m = F.from_json(json_text, "map<string,string>")
    return F.transform_values(m, lambda k, v: F.when(F.lower(k).isin(*FORBIDDEN), F.lit("[redacted]")).otherwise(v))


def thread_key(external: Column, question: Column) -> Column:
    return F.coalesce(external, F.concat(F.lit("q:"), F.substring(F.sha2(stripped(question), 256), 1, 32)))


def excerpt(content: Column, limit: int = 300) -> Column:
    """The first `limit` characters, cut after a late sentence end, with an ellipsis if they hold no sentence end."""
    head = stripped(F.substring(content, 1, limit))
    last = F.length(head) - F.instr(F.reverse(head), " .") - 1  # code points before the last ". "
    cut = F.when(last > limit // 2, F.substring(head, F.lit(1), last + 1)).otherwise(head)
    return F.when(F.length(content) <= limit, stripped(content)).when(F.instr(head, ". ") > 0, cut).otherwise(F.concat(head, F.lit("...")))


# Words that carry no signal in ranking.
STOP_WORDS = """
a al algo alguna algunas alguno algunos ante antes aquel aquella aquellas aquello aquellos aqui como con contra cual cuales cuando de del desde donde
dos el ella ellas ello ellos en entre era eran es esa esas ese eso esos esta estan estas este esto estos fue fueron ha han hasta hay la las le les lo los
mas me mi mis mucho muy nada ni no nos nosotros o os otra otras otro otros para pero poco por porque que quien quienes se sea sean ser si sin sobre son
su sus tambien tanto te tiene tienen todo todos tu tus un una unas uno unos y ya
""".split()


def rank_terms(text: Column) -> Column:
    """Words for ranking: folded, without stop words and single letters."""
    return rank_terms_of(composed(text))


def rank_terms_of(text: Column) -> Column:
    """rank_terms of a composed text, for lambdas."""
    return F.filter(folded_terms(folded(text)), lambda t: ~t.isin(*STOP_WORDS) & (F.length(t) > 1))
