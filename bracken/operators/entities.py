"""Entity extraction: anchors, dates, phrases, proper nouns and keywords of each chunk, in one pass.

ASCII texts, the bulk, are read in an Arrow call that looks at a slice's different tokens once; others by Column
expressions, which know the classes of all characters but take some ten times as long. Both give the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ANCHOR, DATE, anchors, clean_token, dates, entity_terms, is_ascii, is_content_term, normalize_entity, starts_upper, tokens
from ..functions.text import STOPWORDS

MOST_ANCHORS, MOST_PHRASES, MOST_KEYWORDS = 20, 8, 5
#: Tokens that a reader remembers.
REMEMBERED = 1 << 16
#: Chunks whose rows are laid out at once.
SLICE = 1024
#: In extraction order.
KINDS = ("ANCHOR", "DATE", "PHRASE", "PROPER", "KEYWORD")
COLUMNS = ["chunk_id", "doc_id", "seq", "entity_type", "value", "confidence", "normalized_value"]


def _hits(values: Column, confidence: float) -> Column:
    return F.transform(values, lambda v: F.struct(v.alias("value"), F.lit(confidence).alias("confidence")))


def anchor_hits(content: Column) -> Column:
    return _hits(F.slice(F.array_distinct(anchors(content)), 1, MOST_ANCHORS), 1.0)


def date_hits(content: Column) -> Column:
    """Not made distinct; nothing is asked of what stands before the first digit."""
    return _hits(dates(content), 1.0)


def proper_hits(toks: Column) -> Column:
    """Capitalised tokens that don't begin a sentence."""

    def proper(t: Column, i: Column) -> Column:
        inside = (i > 0) & ~F.coalesce(F.get(toks, i - 1), F.lit(".")).endswith(".")
        return inside & t.rlike(r"^[A-Z]\p{IsAlphabetic}*$") & F.octet_length(t).between(4, 30) & ~F.lower(t).isin(STOPWORDS)

    return _hits(F.array_distinct(F.filter(toks, proper)), 0.7)


def phrase_hits(toks: Column) -> Column:
    """Neighbours that are both capitalised, or both content terms; the first eight, apart in lower case."""
    cleaned = F.transform(toks, clean_token)

    def pairs(c: Column) -> Column:
        both = F.zip_with(F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        hits = F.transform(both, lambda p: F.struct(F.concat_ws(" ", p["a"], p["b"]).alias("value"), F.when((p["a"] == "") | (p["b"] == ""), None).when(starts_upper(p["a"]) & starts_upper(p["b"]), 0.85).when(is_content_term(p["a"]) & is_content_term(p["b"]), 0.65).alias("confidence")))
        return F.filter(hits, lambda h: h["confidence"].isNotNull())

    def first(h: Column) -> Column:
        low = F.transform(h, lambda x: F.lower(x["value"]))
        return F.transform(F.array(F.struct(h.alias("h"), low.alias("l"))), lambda s: F.filter(s["h"], lambda x, i: F.array_position(s["l"], F.lower(x["value"])) == i + 1))[0]

    return F.slice(F.transform(F.transform(F.array(cleaned), pairs), first)[0], 1, MOST_PHRASES)


def keyword_hits(toks: Column) -> Column:
    """The five most frequent content terms, then those of them that occur twice or more."""
    terms = F.transform(F.filter(toks, is_content_term), F.lower)

    def ranked(ts: Column) -> Column:
        counts = F.transform(F.array_distinct(ts), lambda t: F.struct((-F.size(F.filter(ts, lambda x: x == t))).alias("minus"), t.alias("t")))
        return F.filter(F.slice(F.sort_array(counts), 1, MOST_KEYWORDS), lambda c: c["minus"] <= -2)

    top = F.transform(F.array(terms), ranked)[0]
    return F.transform(top, lambda c: F.struct(c["t"].alias("value"), F.least(-c["minus"] / 10.0, F.lit(1.0)).alias("confidence")))


def _set_of(chars: str) -> np.ndarray:
    """By byte: whether it is one of these."""
    return np.isin(np.arange(256), list(chars.encode()))


_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKEN, _WORD, _NUMBER = _set_of(_DIGITS + _UPPER + _LOWER + ".'"), _set_of(_DIGITS + _UPPER + _LOWER + "_-"), _set_of(_DIGITS + "/-")
_DASH, _SLASH, _CAPITAL, _DIGIT = _set_of("-"), _set_of("/-"), _set_of(_DIGITS + _UPPER), _set_of(_DIGITS)


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of true values begin and end; the first and the last value are false."""
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    return edges[::2], edges[1::2]


def _rank(own: np.ndarray) -> np.ndarray:
    """How many equal values stand before each; they stand together."""
    return np.arange(len(own)) - np.searchsorted(own, own)


def _first(own: np.ndarray, key: np.ndarray, most: int | None = None) -> np.ndarray:
    """Where the different keys of each text first stand, `most` of a text."""
    if not len(key):
        return np.arange(0)
    at = np.sort(np.unique(own * (int(key.max()) + 1) + key, return_index=True)[1])
    return at if most is None else at[_rank(own[at]) < most]


class AsciiReader:
    """The entities of ASCII texts, as the expressions above find them.

    The texts of a slice are one array of bytes: tokens are cut and numbered there, and compared by number. Strings are
    looked at once for each different token, pair or run that may hold an anchor or a date.
    """

    def __init__(self):
        self.known: dict[str, tuple] = {}
        self.stop = frozenset(STOPWORDS)
        anchors, dates = re.compile(ANCHOR, re.ASCII).findall, re.compile(DATE, re.ASCII).findall
        self.anchors = lambda run: [a for a in anchors(run) if len(a) <= 64]
        self.dates = lambda run: [d[0] for d in dates(run)]
        self.blank = str.maketrans({chr(k): " " for k in range(128) if not chr(k).isalnum()})

    def plain(self, value: str) -> str:
        return " ".join(value.translate(self.blank).lower().split())

    def token(self, t: str) -> tuple:
        """(cleaned, begins upper, cleaned is a content term, content term or "", may be a proper noun, ends with a dot)."""
        clean = t.strip(".'")
        term = lambda x: 4 <= len(x) <= 30 and x.isalpha() and x.lower() not in self.stop
        whole = term(t)
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[t] = out = (clean, "A" <= clean[:1] <= "Z", term(clean), t.lower() if whole else "", whole and "A" <= t[0] <= "Z", t.endswith("."))
        return out

    def date(self, value: str) -> str:
        day, month, year = (int(x) for x in value.replace("-", "/").split("/"))
        return f"{year + 2000 if year < 100 else year:04d}-{month:02d}-{day:02d}" if 1 <= month <= 12 and 1 <= day <= 31 else self.plain(value)

    @staticmethod
    def matches(text: str, code: np.ndarray, bounds: np.ndarray, inside: np.ndarray, joint: np.ndarray, side: np.ndarray, find) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(text, number of the match, matches by number), of a pattern that stays in a run of `inside` and has two joints there with `side` on both sides."""
        starts, ends = _runs(inside[code])
        joints = np.flatnonzero(joint[code[1:-1]] & side[code[:-2]] & side[code[2:]]) + 1
        hold = np.flatnonzero(np.bincount(np.searchsorted(starts, joints, "right") - 1, minlength=len(starts)) >= 2)
        own, which, names, met = [], [], {}, {}
        for k, start, end in zip(np.searchsorted(bounds, starts[hold]).tolist(), starts[hold].tolist(), ends[hold].tolist()):
            run = text[start:end]
            hits = met.get(run)
            if hits is None:
                met[run] = hits = [names.setdefault(x, len(names)) for x in find(run)]
            for h in hits:
                own.append(k)
                which.append(h)
        return np.array(own, np.int64), np.array(which, np.int64), list(names)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array]:
        """(text, place in KINDS, place in the last two, confidence), a row for each hit in extraction order; values, their normal forms."""
        text = "\n".join(["", *texts, ""])
        code = np.frombuffer(text.encode(), np.uint8)
        bounds = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        inside = _TOKEN[code]
        starts, ends = _runs(inside)
        own = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, bounds), prepend=0))
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(code[inside])).dictionary_encode()
        tok, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        known, token = self.known, self.token
        clean, *told = zip(*[known.get(t) or token(t) for t in words]) if words else [()] * 6
        up, content, proper, dot = (np.array(told[k], bool) for k in (0, 1, 3, 4))

        anchor_own, anchor, anchors = self.matches(text, code, bounds, _WORD, _DASH, _CAPITAL, self.anchors)
        at = _first(anchor_own, anchor, MOST_ANCHORS)
        anchor_own, anchor = anchor_own[at], anchor[at]
        date_own, date, dates = self.matches(text, code, bounds, _NUMBER, _SLASH, _DIGIT, self.dates)

        a, b, same = tok[:-1], tok[1:], own[:-1] == own[1:]
        lows: dict[str, int] = {}
        low = np.array([lows.setdefault(c.lower(), len(lows)) for c in clean], np.int64)
        at = np.flatnonzero(same & ((up[a] & up[b]) | (content[a] & content[b])))
        at = at[_first(own[at], low[a[at]] * len(lows) + low[b[at]], MOST_PHRASES)]
        pairs, phrase = np.unique(a[at] * len(words) + b[at], return_inverse=True)
        phrases = [f"{clean[p // len(words)]} {clean[p % len(words)]}" for p in pairs.tolist()]
        phrase_own, sure = own[at], np.where(up[a[at]] & up[b[at]], 0.85, 0.65)

        at = np.flatnonzero(proper[b] & same & ~dot[a]) + 1
        at = at[_first(own[at], tok[at])]
        proper_own, name = own[at], tok[at]

        terms = sorted({t for t in told[2] if t})
        number = {t: k for k, t in enumerate(terms)}
        term = np.array([number.get(t, -1) for t in told[2]], np.int64)[tok]
        at = np.flatnonzero(term >= 0)
        keys, times = np.unique(own[at] * max(1, len(terms)) + term[at], return_counts=True)
        keys, times = keys[times >= 2], times[times >= 2]
        term_own, term = np.divmod(keys, max(1, len(terms)))
        at = np.lexsort((term, -times, term_own))
        at = at[_rank(term_own[at]) < MOST_KEYWORDS]
        term_own, term, often = term_own[at], term[at], np.minimum(times[at] / 10.0, 1.0)

        values = [pa.array(anchors, pa.string()), pa.array(dates, pa.string()), pa.array(phrases, pa.string()), coded.dictionary, pa.array(terms, pa.string())]
        normals = [values[0], pa.array([self.date(x) for x in dates], pa.string()), pa.array([self.plain(x) for x in phrases], pa.string()), pc.ascii_lower(coded.dictionary), values[4]]
        before = np.cumsum([0, *map(len, values)])
        whose = [anchor_own, date_own, phrase_own, proper_own, term_own]
        which = np.concatenate([own + n for own, n in zip((anchor, date, phrase, name, term), before)])
        sureness = np.concatenate([np.ones(len(anchor)), np.ones(len(date)), sure, np.full(len(name), 0.7), often])
        kind = np.repeat(np.arange(len(KINDS)), [len(x) for x in whose])
        whose = np.concatenate(whose)
        order = np.argsort(whose, kind="stable")
        return whose[order], kind[order], which[order], sureness[order], pa.concat_arrays(values), pa.concat_arrays(normals)


def _read_ascii(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    read, kinds = AsciiReader(), pa.array(KINDS)
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            own, kind, which, confidence, values, normals = read(part.column("content").to_pylist())
            if len(own):
                ids = [part.column(c).take(pa.array(own)) for c in ("chunk_id", "doc_id")]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(_rank(own), pa.int32()), kinds.take(pa.array(kind)), values.take(pa.array(which)), pa.array(confidence), normals.take(pa.array(which))], COLUMNS)


def _by_expressions(content: Column) -> Column:
    def typed(toks: Column) -> Column:
        hits = (anchor_hits(content), date_hits(content), phrase_hits(toks), proper_hits(toks), keyword_hits(toks))
        return F.concat(*[_typed(kind, h) for kind, h in zip(KINDS, hits)])

    return F.transform(F.array(tokens(content)), typed)[0]


def extract_entities(chunks: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, seq, entity_type, value, normalized_value, confidence): a row for each hit, in extraction order."""
    own = chunks.select("chunk_id", "doc_id", "content")
    read = own.where(is_ascii(F.col("content"))).mapInArrow(_read_ascii, "chunk_id string, doc_id string, seq int, entity_type string, value string, confidence double, normalized_value string")
    other = own.where(~is_ascii(F.col("content"))).select("chunk_id", "doc_id", F.posexplode(_by_expressions(F.col("content"))).alias("seq", "hit")).select("chunk_id", "doc_id", "seq", "hit.*")
    return read.unionByName(other.withColumn("normalized_value", normalize_entity(F.col("value"))))


def _typed(kind: str, hits: Column) -> Column:
    return F.transform(hits, lambda h: F.struct(F.lit(kind).alias("entity_type"), h["value"].alias("value"), h["confidence"].cast("double").alias("confidence")))


def terms_of(entities: DataFrame) -> DataFrame:
    """(chunk_id, entity_seq, term): the distinct terms of each entity."""
    return entities.select("chunk_id", F.col("seq").alias("entity_seq"), F.explode(entity_terms(F.col("normalized_value"))).alias("term"))
