"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no content of a query.
STOPWORDS = (
    "a an the and or but if then else when what which who whom whose why how "
    "is are was were be been being do does did done have has had having will would "
    "can could shall should may might must of in on at to for with by from as into "
    "it its this that these those there their them they he she we you i me my our "
    "your his her us about over under again once here"
).split()
# Abbreviations that do not end a sentence, without their last dot.
ABBREVIATIONS = ("mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "vs", "etc", "e.g", "i.e", "fig")

_EDGES = r"(?U)^\s+|\s+$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space, of any script, at both ends."""
    return F.regexp_replace(_col(c), _EDGES, "")


def tokens(c: Column | str) -> Column:
    """Runs of ASCII letters and digits in lower case, in order; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def content_terms(c: Column | str) -> Column:
    """Distinct tokens without stopwords, in order of first occurrence; all distinct tokens if nothing else is left."""
    found = tokens(c)
    stop = F.array(*map(F.lit, STOPWORDS))
    content = F.array_distinct(F.filter(found, lambda t: ~F.array_contains(stop, t)))
    return F.when(F.size(content) > 0, content).otherwise(F.array_distinct(found))


def bigrams(found: Column) -> Column:
    """Distinct pairs of neighbouring tokens, joined by a space."""
    n = F.size(found)
    pairs = F.zip_with(F.slice(found, 1, F.greatest(n - 1, F.lit(0))), F.slice(found, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(pairs)


def normalize_tag(c: Column | str) -> Column:
    """Lower case, white space collapsed, at most 64 characters."""
    return F.substring(F.regexp_replace(strip(F.lower(F.coalesce(_col(c), F.lit("")))), r"(?U)\s+", " "), 1, 64)


def normalize_doc_type(c: Column | str, allow_empty: bool = False) -> Column:
    """``document`` or ``memory`` from their aliases; an unknown value fails the query."""
    raw = strip(F.lower(F.coalesce(_col(c).cast("string"), F.lit(""))))
    compact = F.regexp_replace(raw, r"(?U)[\s_-]+", "")
    empty = F.lit(None).cast("string") if allow_empty else F.lit("document")
    return (
        F.when(raw == "", empty)
        .when(compact.isin("memory", "memories", "agentmemory", "agentmemories"), F.lit("memory"))
        .when(compact.isin("document", "documents", "doc", "docs"), F.lit("document"))
        .otherwise(F.raise_error(F.concat(F.lit("unknown doc_type: "), raw)))
    )


def safe_filename(c: Column | str, default: str = "file") -> Column:
    """Characters other than letters, digits, dot, underscore, hyphen and space become underscores."""
    name = strip(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"[^\p{L}\p{N}._\- ]", "_"))
    return F.when(name == "", F.lit(default)).otherwise(name)


def title_filename(c: Column | str) -> Column:
    """A title as the name of a text file: ``.md`` is added unless it has a plain text extension."""
    name = safe_filename(c, "note")
    return F.when(F.lower(name).rlike(r"\.(txt|md|markdown)$"), name).otherwise(F.concat(name, F.lit(".md")))


def content_hash(c: Column | str) -> Column:
    """SHA-256 of text or bytes, in lower case hexadecimal."""
    return F.sha2(_col(c).cast("binary"), 256)


def strip_tags(c: Column | str) -> Column:
    """Markup without its tags: tags become spaces, then entities are decoded, then white space is tidied.

    Entities decoded here are the five of XML and those of common pages; ``sources.extract`` decodes all of HTML's.
    """
    text = F.regexp_replace(_col(c), "<[^>]+>", " ")
    for entity, char in (("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = F.regexp_replace(text, r"[ \t]+", " ")
    return strip(F.regexp_replace(text, r"\n\s*\n\s*\n+", "\n\n"))


def html_text(c: Column | str) -> Column:
    """A page's text: scripts and styles go with their content, other tags alone."""
    return strip_tags(F.regexp_replace(_col(c), r"(?is)<(script|style)[^>]*>.*?</\1\s*>", " "))


def sentences(c: Column | str) -> Column:
    """Sentences, in order: paragraphs end at blank lines, sentences at ``. ! ? …`` with closing quotes and white space,
    but not after an abbreviation or initials.
    """
    para, end = "\u0002", "\u0001"
    text = strip(F.replace(F.coalesce(_col(c), F.lit("")), F.lit("\r\n"), F.lit("\n")))
    text = F.regexp_replace(text, r"(?U)\n\s*\n", para)
    text = F.regexp_replace(F.regexp_replace(text, r"(?U)[\s&&[^\u0001\u0002]]+", " "), f" ?{para} ?", para)
    text = F.regexp_replace(text, r"([.!?…][\"'”’)\]]*) ", f"$1{end}")
    guard = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    text = F.regexp_replace(text, rf"(?<=^|[ {end}{para}])((?i:{guard})\.|(?:[A-Z]\.)+){end}", "$1 ")
    return F.filter(F.split(text, f"[{end}{para}]"), lambda s: s != "")


def without_boilerplate(c: Column | str) -> Column:
    """The body between a public library's start and end markers, where a text has both in order."""
    text = _col(c)
    start, end = (F.instr(text, f"*** {w} OF THE PROJECT GUTENBERG EBOOK") for w in ("START", "END"))
    after = start + F.instr(F.substring(text, start, F.length(text)), "\n")
    body = strip(F.substring(text, after, F.greatest(end - after, F.lit(0))))
    return F.when((start > 0) & (end > start) & (body != ""), body).otherwise(text)
