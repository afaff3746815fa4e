"""Secret scans: an Aho-Corasick automaton finds keywords, anchored regular expressions look only there, and
formats with an embedded check are validated.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, small_batches

#: The base kinds and their patterns; their order breaks ties of spans that start together.
ASSIGN = r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
BASE = ("assign", "access", "hex")
#: A private key up to the next END; its headers and body may hold hyphens, but no other BEGIN.
PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+-----END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----"
#: Kinds with an embedded check, added by the scan. A web token begins where no other character of its alphabet stands
#: before it, so that a long run of such characters is tried once.
CHECKED = {
    "github": r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])",
    "npm": r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])",
    "jwt": r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*",
    "pem": PEM,
    "xprv": r"[xyzt]prv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])",
    "age": r"AGE-SECRET-KEY-1[02-9AC-HJ-NP-Z]{58}(?![0-9A-Z])",
    "nsec": r"nsec1[02-9ac-hj-np-z]{58}(?![0-9a-z])",
}
KINDS = (*BASE, *CHECKED)
KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm", "eyj": "jwt", "-----begin": "pem", "xprv": "xprv", "yprv": "xprv", "zprv": "xprv", "tprv": "xprv", "age-secret-key-1": "age", "nsec1": "nsec"}
LEAST = {"assign": 12, "access": 18, "hex": 16}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
#: Generator of the bech32 checksum.
BECH32_STEPS = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@cache
def _compiled() -> dict[str, re.Pattern]:
    return {k: re.compile(p) for k, p in {"assign": ASSIGN, "access": ACCESS, "hex": HEX, **CHECKED}.items()}


@cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


def base62(n: int, width: int) -> str:
    out = ""
    while n:
        n, k = divmod(n, 62)
        out = BASE62[k] + out
    return out.rjust(width, "0")


def base58_checked(value: str) -> bool:
    """The last four bytes are the first of the others' double SHA-256."""
    n = 0
    for c in value:
        n = 58 * n + BASE58.index(c)
    data = n.to_bytes((n.bit_length() + 7) // 8)
    return hashlib.sha256(hashlib.sha256(data[:-4]).digest()).digest()[:4] == data[-4:]


def bech32_checked(prefix: str, rest: str) -> bool:
    check = 1
    for v in [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix] + [BECH32.index(c) for c in rest]:
        top = check >> 25
        check = (check & 0x1FFFFFF) << 5 ^ v
        for k, step in enumerate(BECH32_STEPS):
            check ^= step if top >> k & 1 else 0
    return check == 1


def valid(kind: str, value: str) -> bool:
    """The check that the format carries: a CRC-32 in base 62, a header that is JSON and names its algorithm, matching labels, checksums of base 58 and bech32."""
    if kind in ("github", "npm"):
        return base62(zlib.crc32(value[4:-6].encode()), 6) == value[-6:]
    if kind == "jwt":
        head = value.split(".", 1)[0]
        try:
            return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
        except (ValueError, TypeError, RecursionError):  # no base 64, no JSON, a number; nested without end
            return False
    if kind == "pem":
        return value[11 : value.index("-----", 11)] == value[value.rindex("-----END ") + 9 : -5]
    if kind == "xprv":
        return base58_checked(value)
    if kind in ("age", "nsec"):
        prefix, rest = value.lower().rsplit("1", 1)
        return bech32_checked(prefix, rest)
    return True


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets, by start, then by kind as listed."""
    lower = text.lower()
    if len(lower) != len(text):
        lower = text.translate(_LOWER)
    patterns, spans, ends = _compiled(), [], dict.fromkeys(KINDS, 0)
    starts = sorted((end - length + 1, kind) for end, (kind, length) in _automaton().iter(lower))
    for at, kind in starts:
        if at < ends[kind] or not (m := patterns[kind].match(text, at)):
            continue
        value = m.group(1) if kind == "assign" else m.group()
        if kind in LEAST:
            ends[kind] = m.end()  # a match that is too short still takes its place
            if len(value) < LEAST[kind]:
                continue
        elif not valid(kind, value):
            continue
        ends[kind] = m.end()
        spans.append((kind, at, m.end()))
    spans += [("hex", *m.span()) for m in patterns["hex"].finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of each row; spans: array of (kind, start, end) in code points, by start, ties by kind as listed.

    A null text is empty. Every row is scanned by itself, whole and in time that grows with its length: rows that
    repeat, and rows without an id, give a row each. Only id and text are read, so columns named like results don't
    matter.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                own = batch.slice(i, 500)
                spans = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(x or "")] for x in own.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([own.column("id"), pa.array(spans, kind)], names=["id", "spans"])
        give_back()

    small_batches(docs.sparkSession)

    id_type = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(find, f"id {id_type}, spans array<struct<kind:string,start:int,end:int>>")
    return out.withColumnRenamed("id", id_col)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one."""
    out, at = [], 0
    for kind, a, b in spans:
        if b <= at:
            continue
        out += [text[at : max(a, at)], f"[{kind}]" if a >= at else ""]
        at = b
    return "".join([*out, text[at:]])


def digest_text(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the spans of these kinds, comma-joined."""
    own = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
