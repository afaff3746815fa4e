"""Language identification of mixed text.

Script ranges narrow each word's candidate languages; character n-grams give the word a log-probability for each of
them; Viterbi over the words, with a penalty for each switch, labels spans. The document gets the language that
covers most of its letters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, small_batches, staged

#: First and last code point of the scripts that are told apart; any other letter is "other".
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "thai": [(0xE00, 0xE7F)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
}
#: Lengths of the character n-grams, and the slots they are hashed to.
GRAMS, SLOTS = (2, 3, 4), 1 << 17
#: A word's log-probabilities outside its script's languages.
OFF_SCRIPT = -30.0
#: Code points times languages that are scored at once: bounds a worker's memory.
CELLS = 1_600_000


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: is it a letter, its lower case, its script."""
    letter = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in np.flatnonzero(letter):
        if len(x := chr(c).lower()) == 1:
            lower[c] = ord(x)
    script = np.full(0x110000, len(SCRIPTS), np.uint8)
    for k, spans in enumerate(SCRIPTS.values()):
        for a, b in spans:
            script[a : b + 1] = k
    return letter, lower, script


def _chunks(texts: list[str], room: int) -> Iterator[list[int]]:
    """Numbers of consecutive texts, together of at most `room` code points; a longer text stands alone."""
    own, size = [], 0
    for i, x in enumerate(texts):
        if own and size + len(x) > room:
            yield own
            own, size = [], 0
        own.append(i)
        size += len(x) + 1
    if own:
        yield own


def _slots(c: np.ndarray) -> Iterator[np.ndarray]:
    """For each n the slot of the n-gram that ends at each code point."""
    for n in GRAMS:
        h = np.full(len(c), n, np.uint64)
        for k in range(n):
            before = np.r_[np.full(min(k, len(c)), 32, np.uint64), c[: max(0, len(c) - k)]] if k else c
            h = (h ^ before) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        yield (h % np.uint64(SLOTS)).astype(np.int32)


class Words:
    """Letter runs of some texts: text number, start and end within it, script, and the slots of their n-grams."""

    def __init__(self, texts: list[str]):
        letter, lower, script = _tables()
        code = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.starts_of = np.r_[0, np.cumsum([len(x) + 1 for x in texts])][:-1]
        is_letter = letter[code]
        edge = np.flatnonzero(np.diff(np.r_[False, is_letter, False].astype(np.int8)))
        a, b = edge[::2], edge[1::2]
        self.text = np.searchsorted(self.starts_of, a, side="right") - 1
        self.start, self.end = a - self.starts_of[self.text], b - self.starts_of[self.text]
        self.script = script[code[a]]
        c = np.where(is_letter, lower[code], 32).astype(np.uint64)
        self.a, self.b, self.codes = a, b, c

    def slots(self) -> Iterator[np.ndarray]:
        return _slots(self.codes)

    def scores(self, model: np.ndarray) -> np.ndarray:
        """(words, languages): sums over the n-grams that end in the word or at the character after it."""
        total = np.zeros((len(self.codes) + 1, model.shape[2]))
        for k, s in enumerate(self.slots()):
            total[1:] += model[k][s]
        np.cumsum(total, axis=0, out=total)
        return total[self.b + 1] - total[self.a]


class LanguageModel:
    """langs; logp: (n, slot, language); script_ok: (script, language)."""

    def __init__(self, langs: list[str], logp: np.ndarray, script_ok: np.ndarray, penalty: float):
        self.langs, self.logp, self.script_ok, self.penalty = langs, logp, script_ok, penalty

    def _narrowed(self, scores: np.ndarray, script: np.ndarray) -> np.ndarray:
        """Scores of words, those of languages that don't use the word's script far down; where none does, all stay."""
        ok = self.script_ok[script]
        return np.where(ok | ~ok.any(axis=1, keepdims=True), scores, scores + OFF_SCRIPT)

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int, float]]]:
        """For each text its spans: language, start, end (code points), share of its letters."""
        out: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
        room = max(64, CELLS // max(1, len(self.langs)))
        for own in _chunks(texts, room):
            if len(own) == 1 and len(texts[own[0]]) > room:
                states, start, end = self._slice_by_slice(texts[own[0]], room)
                text = np.zeros(len(states), np.int64)
            else:
                w = Words([texts[i] for i in own])
                text, start, end = w.text, w.start, w.end
                states = viterbi(self._narrowed(w.scores(self.logp), w.script), text, self.penalty) if len(text) else np.empty(0, np.int16)
            if not len(states):
                continue
            new = np.r_[True, (states[1:] != states[:-1]) | (text[1:] != text[:-1])]
            first = np.flatnonzero(new)
            last = np.r_[first[1:], len(states)] - 1
            letters = np.add.reduceat(end - start, first)
            every = np.bincount(text, weights=end - start, minlength=len(own))
            for f, e, n in zip(first.tolist(), last.tolist(), letters.tolist()):
                out[own[text[f]]].append((self.langs[states[f]], int(start[f]), int(end[e]), n / every[text[f]]))
        return out

    def _slice_by_slice(self, text: str, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """States, starts and ends of the words of a long text; only a slice of it is scored at a time.

        What is kept of a slice are its words' places and a byte or two for each word and language. A word over a cut
        carries its sum along; the code points before the slice complete its first n-grams.
        """
        letter, lower, scripts = _tables()
        k = len(self.langs)
        before, best, carry, open_at = np.full(max(GRAMS) - 1, 32, np.uint64), None, np.zeros(k), -1
        starts, ends, came = [], [], []
        for low in range(0, len(text) + 1, room):
            part = text[low : low + room] + "\n" * (low + room > len(text))
            code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
            is_letter = letter[code]
            c = np.r_[before, np.where(is_letter, lower[code], 32).astype(np.uint64)]
            total = np.zeros((len(code) + 1, k))
            for n, s in enumerate(_slots(c)):
                total[1:] += self.logp[n][s[len(before) :]]
            np.cumsum(total, axis=0, out=total)
            previous = np.r_[open_at >= 0, is_letter[:-1]]
            a, b = np.flatnonzero(is_letter & ~previous), np.flatnonzero(~is_letter & previous)
            begun = np.r_[np.zeros(int(open_at >= 0), np.int64), a]
            places = np.r_[np.full(int(open_at >= 0), open_at), low + a]
            done = len(b)
            scores = total[b + 1] - total[begun[:done]]
            kind = scripts[code[begun[:done]]]
            if done and open_at >= 0:
                scores[0] += carry
                kind[0] = scripts[ord(text[open_at])]
            if done:
                came.append(np.empty((done, k), np.int8 if k < 127 else np.int16))
                best = _advance(self._narrowed(scores, kind), best, self.penalty, came[-1])
                starts.append(places[:done])
                ends.append(low + b)
            if len(places) > done:
                carry = total[-1] - total[begun[done]] + (carry if open_at >= 0 and not done else 0)
                open_at = int(places[done])
            else:
                open_at = -1
            before = c[-len(before) :]
        if best is None:
            return (np.empty(0, np.int64),) * 3
        back = np.concatenate(came)
        states = np.empty(len(back), np.int16)
        now = int(best.argmax())
        for t in range(len(back) - 1, -1, -1):
            states[t] = now
            now = int(back[t, now])
        return states, np.concatenate(starts), np.concatenate(ends)


def _advance(scores: np.ndarray, best: np.ndarray | None, penalty: float, came: np.ndarray) -> np.ndarray:
    """Viterbi over one document's next words, from the values `best` of the states before them; fills `came`."""
    stay_at = np.arange(scores.shape[1])
    for t, own in enumerate(scores):
        if best is None:
            came[t], best = stay_at, own
            continue
        top = int(best.argmax())
        jump = best[top] - penalty
        stay = best >= jump
        came[t] = np.where(stay, stay_at, top)
        best = np.where(stay, best, jump) + own
    return best


def viterbi(scores: np.ndarray, doc: np.ndarray, penalty: float) -> np.ndarray:
    """The best state of each word; `doc` is sorted. All documents advance by a word together, the longest first.

    Ties go to the earlier state, and to staying.
    """
    n, k = scores.shape
    if k == 1:
        return np.zeros(n, np.int16)
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    length = np.diff(np.r_[first, n])
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    alive = np.searchsorted(-length, -np.arange(length[0]), side="left")  # documents longer than t
    best = scores[first].copy()
    came = np.empty((n, k), np.int8 if k < 127 else np.int16)
    for t in range(1, length[0]):
        m = alive[t]
        at = first[:m] + t
        v = best[:m]
        top = v.argmax(axis=1)
        jump = v[np.arange(m), top][:, None] - penalty
        stay = v >= jump
        came[at] = np.where(stay, np.arange(k), top[:, None])
        best[:m] = np.where(stay, v, jump) + scores[at]
    states = np.empty(n, np.int16)
    now = np.empty(len(first), np.int16)
    for t in range(length[0] - 1, -1, -1):
        m = alive[t]
        ends = length[:m] == t + 1
        now[:m][ends] = best[:m][ends].argmax(axis=1)
        at = first[:m] + t
        states[at] = now[:m]
        if t:
            now[:m] = came[at, now[:m]]
    return states


def train(docs: DataFrame, per_lang: int = 1500, penalty: float = 14.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learns from a bounded sample: of each language that has labelled rows, per_lang of its different (id, text) at most.

    Those with the smallest hashes are taken, so reruns agree. How many there are is estimated first, and only rows
    with hashes below about what is needed go further: no task gets more than a few thousand rows of a language,
    however many it has. Rows that repeat count once; null labels and null texts teach nothing. N-grams are counted,
    summed and made a model in Spark; the driver gets the model, languages x n-gram lengths x SLOTS numbers, whose size
    does not grow with the corpus.
    """
    spark = docs.sparkSession
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    hashed = F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)), 1)
    known = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), hashed.alias("h"))
    enough = F.least(F.lit(1.0), (1.25 * per_lang + 64) / F.approx_count_distinct("h", 0.03))
    below = staged(known.groupBy("lang").agg(enough.alias("part")), "language-sizes")  # a row a language; Spark sees its size
    near = known.join(below, "lang").where(F.col("h") <= F.col("part") * float(2**63))
    near = staged(near.groupBy("lang", "h").agg(F.first("text").alias("text")), "language-sample")
    last = near.groupBy("lang").agg(F.element_at(F.slice(F.sort_array(F.collect_list("h")), 1, per_lang), -1).alias("last"))
    sample = near.join(last, "lang").where(F.col("h") <= F.col("last"))
    room = CELLS // 4

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, own in pdf.groupby("lang"):
                # Long texts are cut: what is lost are the few n-grams over the cuts.
                texts = [x[a : a + room] for x in own["text"] for a in range(0, len(x), room)]
                for part in _chunks(texts, room):
                    w = Words([texts[i] for i in part])
                    yield pd.DataFrame({"lang": lang, "kind": -1, "slot": w.script.astype(np.int64), "n": w.end - w.start}).groupby(["lang", "kind", "slot"], as_index=False)["n"].sum()
                    inside = np.zeros(len(w.codes) + 1, bool)
                    inside[:-1] = w.codes != 32
                    inside = inside[:-1] | np.r_[False, inside[:-2]]
                    for k, s in enumerate(w.slots()):
                        slot, n = np.unique(s[inside], return_counts=True)
                        yield pd.DataFrame({"lang": lang, "kind": k, "slot": slot.astype(np.int64), "n": n})
        give_back()

    def finish(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        """Of one language: the scripts with a hundredth of its letters, and the logarithms of its n-grams' shares."""
        letters = own[own["kind"] == -1]
        scripts = np.zeros(len(SCRIPTS) + 1, bool)
        scripts[letters["slot"][letters["n"] >= 0.01 * letters["n"].sum()]] = True
        logp = np.zeros((len(GRAMS), SLOTS), np.float32)
        for n in range(len(GRAMS)):
            x = np.full(SLOTS, 0.1)
            g = own[own["kind"] == n]
            x[g["slot"]] += g["n"]
            logp[n] = np.log(x / x.sum()) / len(GRAMS)
        return pd.DataFrame({"lang": [key[0]], "scripts": [scripts.tobytes()], "logp": [logp.tobytes()]})

    small_batches(spark)
    counts = sample.select("lang", "text").mapInPandas(count, "lang string, kind int, slot long, n long").groupBy("lang", "kind", "slot").agg(F.sum("n").alias("n"))
    models = {r.lang: r for r in counts.groupBy("lang").applyInPandas(finish, "lang string, scripts binary, logp binary").toLocalIterator()}
    langs = sorted(r.lang for r in below.select("lang").collect())
    script_ok = np.zeros((len(SCRIPTS) + 1, max(1, len(langs))), bool)
    logp = np.full((len(GRAMS), SLOTS, max(1, len(langs))), np.float32(np.log(1 / SLOTS) / len(GRAMS)))
    for k, lang in enumerate(langs):
        if lang in models:  # else its texts have no letter
            script_ok[:, k] = np.frombuffer(models[lang].scripts, bool)
            logp[:, :, k] = np.frombuffer(models[lang].logp, np.float32).reshape(len(GRAMS), SLOTS)
    return LanguageModel(langs, logp, script_ok, penalty)


def label_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and spans for every row.

    lang_pred is the language of most letters, ties to the smaller name; score is its share of the letters. A null
    text, one without letters, and any text if nothing was learned is `und`, with score 0 and no spans. Columns
    of docs are returned as they are, but for any with the names of the three new ones, which are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x n-gram lengths x SLOTS floats

    def spans_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for texts in batches:
            found = m.spans([x or "" for x in texts]) if m.langs else [[] for _ in texts]
            yield pd.Series([[{"lang": a, "start": b, "end": c, "share": d} for a, b, c, d in x] for x in found])
        give_back()

    small_batches(docs.sparkSession)

    udf = F.pandas_udf(spans_of, "array<struct<lang:string,start:int,end:int,share:double>>")
    out = docs.withColumn("spans", udf(F.col(text_col)))
    langs = F.array_distinct(F.transform("spans", lambda s: s["lang"]))
    shares = F.transform(langs, lambda x: F.struct((-F.aggregate(F.filter("spans", lambda s: s["lang"] == x), F.lit(0.0), lambda t, s: t + s["share"])).alias("minus"), x.alias("lang")))
    out = out.withColumn("_best", F.array_min(shares))
    return out.withColumn("lang_pred", F.coalesce(F.col("_best.lang"), F.lit("und"))).withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(-F.col("_best.minus"), F.lit(0.0))))).drop("_best")


def is_held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
