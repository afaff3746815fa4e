"""Text operators as Column expressions: tokens, anchors, signals, normal forms, snippets, token budgets.

Where the length of a term counts, it is in UTF-8 bytes; windows and token estimates are in characters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STOPWORDS = (
    "the a an and or but if of for to in on at by with from as is are was were be been this that these those it "
    "its we you they them i he she his her their our yours have has had will would could should may might do does did "
    "not no yes so than then there here when where what who which how why all any each more most some such only own "
    "same very just into about after before between during while also must your mine ours"
).split()
LOW_SIGNAL_WORDS = ["anchor", "anchors", "document", "related", "title", "tags", "company", "cloud", "retail", "nusantara"]
ANCHOR = r"\b[A-Z][A-Z0-9]+(?:-[A-Z0-9]+){2,}\b"
ANCHOR_SHAPE = r"^[A-Z][A-Z0-9]+(?:-[A-Z0-9]+){2,}$"
DATE = r"(\d{1,2}([/-])\d{1,2}\2\d{2,4}(?!\d))"
#: Of a term of the inverted index.
MOST_CHARS = 40
QUERY_SYNTAX = '+:-()[]^"~*?\\/'

ALNUM = r"\p{IsAlphabetic}\p{N}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def not_empty(a: Column) -> Column:
    return F.filter(a, lambda x: x != "")


def compact(c: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def tokens(c: Column) -> Column:
    return not_empty(F.split(c, rf"[^{ALNUM}.']+"))


def clean_token(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[^{ALNUM}]+|[^{ALNUM}]+$", "")


def starts_upper(c: Column) -> Column:
    return c.rlike("^[A-Z]")


def is_content_term(c: Column) -> Column:
    low = F.lower(c)
    return F.octet_length(low).between(4, 30) & low.rlike(r"^\p{IsAlphabetic}+$") & ~low.isin(STOPWORDS)


def anchors(c: Column) -> Column:
    """Every anchor of at most 64 bytes, in order."""
    return F.filter(F.regexp_extract_all(c, F.lit(ANCHOR), F.lit(0)), lambda x: F.octet_length(x) <= 64)


def dates(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(DATE), F.lit(1))


def _non_anchor_words(c: Column) -> Column:
    words = F.split(F.regexp_replace(c, ANCHOR, " "), r"[^\p{IsAlphabetic}]+")
    return F.size(F.filter(words, lambda w: (F.octet_length(w) >= 4) & ~ascii_lower(w).isin(LOW_SIGNAL_WORDS)))


def is_marked(c: Column) -> Column:
    """Whether it has a word without which no text is metadata or an anchor list, unless it is blank.

    None of the words has a letter that another than its ASCII capital becomes; lower is much faster than translate.
    """
    glance = F.lower(c)
    return reduce(Column.__or__, [glance.contains(w) for w in ("title:", "tags:", "company:", "anchors")])


def chunk_signal(c: Column) -> Column:
    """metadata, anchor_list or content. Texts without a word that the others need are content at a glance."""
    return F.when(is_marked(c) | ~c.rlike(r"\S"), _signal_of_marked(c)).otherwise("content")


def _signal_of_marked(c: Column) -> Column:
    text = compact(c)
    low = ascii_lower(text)
    found = anchors(text)
    n = F.size(found)
    ratio = F.octet_length(F.concat_ws("", found)) / F.greatest(F.octet_length(text), F.lit(1))
    words = _non_anchor_words(text)
    prose = F.exists(F.split(text, "[.!?]"), lambda s: _non_anchor_words(s) >= 8)
    metadata = (low.contains("title:") | low.contains("tags:") | low.contains("company:")) & (n >= 1) & ~prose & ((words <= 18) | (ratio >= 0.25))
    labelled = low.contains("document anchors") | low.contains("related anchors") | low.contains("anchors:")
    listing = (n >= 2) & labelled & ((words <= 14) | (ratio >= 0.35))
    return F.when(text == "", "metadata").when(metadata, "metadata").when(listing, "anchor_list").otherwise("content")


def normalize_date(c: Column) -> Column:
    """ISO form of three all-digit parts, or null; the year is first if it has four digits, else last."""
    v = F.trim(c)
    sep = F.when(v.contains("/"), "/").when(v.contains("-"), "-")
    parts = F.split(v, F.when(sep == "/", "/").otherwise("-"))
    ok = sep.isNotNull() & (F.size(parts) == 3) & F.forall(parts, lambda p: p.rlike("^[0-9]+$"))
    num = [F.get(parts, F.lit(k)).try_cast("int") for k in range(3)]
    first = F.length(F.get(parts, F.lit(0))) == 4
    year = F.when(first, num[0]).otherwise(F.when(num[2] < 100, num[2] + 2000).otherwise(num[2]))
    month, day = num[1], F.when(first, num[2]).otherwise(num[0])
    return F.when(ok & month.between(1, 12) & day.between(1, 31) & year.isNotNull(), F.format_string("%04d-%02d-%02d", year, month, day))


def normalize_entity(c: Column) -> Column:
    shaped = F.trim(c).rlike(ANCHOR_SHAPE) & (F.octet_length(F.trim(c)) <= 64)
    plain = compact(F.lower(F.regexp_replace(c, rf"[^{ALNUM}]", " ")))
    return F.coalesce(normalize_date(c), F.when(shaped, F.trim(c)), plain)


def entity_terms(normalized: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normalized, r"\s+"), lambda t: F.octet_length(t) >= 2))


def sanitize_query(c: Column) -> Column:
    return F.translate(c, QUERY_SYNTAX, " " * len(QUERY_SYNTAX))


def routing_terms(c: Column) -> Column:
    return F.filter(F.split(ascii_lower(c), "[^a-z0-9]+"), lambda t: F.length(t) > 2)


def contains_phrase(haystack: Column, needle: Column) -> Column:
    return (needle != "") & F.contains(F.concat(F.lit(" "), haystack, F.lit(" ")), F.concat(F.lit(" "), needle, F.lit(" ")))


def index_terms(c: Column) -> Column:
    """Terms of the inverted index: lower-case letter and digit runs of at most MOST_CHARS characters."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: F.length(t).between(1, MOST_CHARS))


def snippet(text: Column, literal: Column, around: int = 40) -> Column:
    """The first hit, exact before case-insensitive, with `around` characters on both sides; null if there is none."""
    at = F.coalesce(F.nullif(F.position(literal, text), F.lit(0)), F.position(F.lower(literal), F.lower(text)))
    begin = F.greatest(at - around, F.lit(1))
    return F.when((literal != "") & (at > 0), F.substring(text, begin, at + F.length(literal) + around - begin))


def estimate_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(c) / 4)).cast("int")


def compact_lines(c: Column) -> Column:
    return F.array_join(not_empty(F.transform(F.split(c, "\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))), "\n")


def trim_to_budget(c: Column, budget: Column) -> Column:
    """Lines compacted; if longer than 4 characters a token, cut, at the last sentence end in the second half if any."""
    text = compact_lines(c)
    most = F.greatest(budget * 4, F.lit(1))
    cut = F.substring(text, F.lit(1), most)
    # The cut is found on bytes, the budget counts characters: both are compared as they are.
    upto = F.regexp_extract(cut, r"(?s)^(.*[.\n;])", 1)
    kept = F.when((upto != "") & (F.octet_length(upto) >= F.floor(most / 2)), upto).otherwise(cut)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(kept, r"\s+$", ""), F.lit("...")))


def excerpt_key(c: Column) -> Column:
    return F.substring(compact(ascii_lower(F.regexp_replace(F.regexp_replace(c, r"\s", " "), "[^A-Za-z0-9 ]", ""))), 1, 220)


def clean_transcript(c: Column) -> Column:
    """A transcript's spoken text: time stamps and bracketed remarks go, lines are joined."""
    lines = F.transform(F.split(c, "\r?\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^\[[^\]]*\]\s*", "")))
    spoken = F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^(\(.*\)|\[.*\])$") & ~F.forall(F.split(x, r"\s+"), lambda w: w.rlike(r"^(\(.*\)|\[.*\])$")))
    return F.array_join(spoken, " ")


#: Fixed values of file handling.
EXTENSIONS = "md txt pdf docx xlsx csv json png jpg jpeg webp tiff mp4 mov avi mkv webm wmv mp3 wav m4a flac ogg opus".split()
FORMATS = {"md": "md", "pdf": "pdf", "docx": "docx", "xlsx": "xlsx", "csv": "csv", "json": "json", "image": "png jpg jpeg webp tiff", "video": "mp4 mov avi mkv webm wmv", "audio": "mp3 wav m4a flac ogg opus"}
REFERENCE_STEMS = ["file_list", "filelist", "files", "relation_map", "relations", "toc", "table_of_contents"]


def filename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def is_supported(path: Column) -> Column:
    return extension(filename(path)).isin(EXTENSIONS)


def is_engine_output(path: Column, infix: str = ".extracted.") -> Column:
    return F.lower(filename(path)).contains(infix)


def format_of(path: Column) -> Column:
    ext, out = extension(filename(path)), F.lit("text")
    for name, own in FORMATS.items():
        out = F.when(ext.isin(own.split()), name).otherwise(out)
    return out


def doc_class(path: Column) -> Column:
    """reference for manifests, indexes, readmes and file lists by name; else content."""
    name = F.lower(filename(path))
    has_ext = name.contains(".")
    stem = F.when(has_ext, F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    ext = F.when(has_ext, F.regexp_extract(name, r"\.([^.]*)$", 1)).otherwise("")
    text_like = ext.isin("txt", "md", "json")
    listing = ((stem == "manifest") & (text_like | (ext == "csv"))) | ((stem == "index") & text_like) | stem.isin(REFERENCE_STEMS)
    readme = (stem == "readme") | stem.startswith("readme-") | stem.startswith("readme_")
    return F.when(name == "index.html", "content").when(listing | readme | (stem.endswith("_index") & text_like), "reference").otherwise("content")
