"""Quality rules: a table of thresholds, compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, let

SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that it was for on are as with his they at be this from have or by one had not but what all were "
    "le la les de des du et est un une que qui dans pour pas sur au aux par ce il elle en ne se son avec plus ou "
    "der die das und ist von den dem ein eine zu mit sich des auf für nicht im als auch es an werden aus er hat dass sie nach wie "
    "el los las del y que un una por con para no se su lo como más al pero sus le ya o este"
).split()


@dataclass(frozen=True)
class Rule:
    """numerator / denominator must lie in [least, most]; a zero denominator, and fewer than `from_words` words, pass.

    latin: for texts in Latin letters only, for which word lengths and stop words are known. Others have half a byte
    or more for each character of a word beyond the first byte of it.
    """

    name: str
    numerator: str
    denominator: str
    least: float = 0.0
    most: float = float("inf")
    from_words: int = 0
    latin: bool = False


#: The thresholds. The base limits of the contract stand in base_failed.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 14.0, latin=True),
    Rule("symbols", "n_symbols", "n_words", most=0.10),
    Rule("stop_words", "n_stop_words", "n_words", least=0.02, from_words=40, latin=True),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=0.40),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", most=0.30, from_words=40),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", most=0.90, from_words=40),
)


def repeated_words(words: Column, n: Column, width: int = 5) -> Column:
    """Words inside windows of `width` words that the text has twice or more, the first ones included.

    Windows are compared by 64 bits of hash. Texts without a repeated window are told by counting distinct hashes;
    only the others are sorted.
    """
    windows = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[words[i + k] for k in range(width)]))

    def covered(w: Column) -> Column:
        ranked = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def places(s: Column) -> Column:
            twice = F.filter(s, lambda a, i: F.coalesce(F.get(s, i - 1)["x"] == a["x"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["x"] == a["x"], F.lit(False)))
            return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda a: F.sequence(a["i"], a["i"] + width - 1)))))

        return F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(let(ranked, places))

    return F.when(n < width, 0).otherwise(let(windows, covered))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, further counts, failed, base_failed, kept).

    failed: names of the rules that reject the text. A null or empty text has no words and fails the base rule. A
    ratio that equals a threshold passes. Only the id and the text are read, so columns named like results don't
    matter; every row gets a row, also rows that repeat and rows without an id.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    stops = [*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)]
    df = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.split(F.btrim(text, F.lit(SPACE_CHARS)), SPACE + "+").alias("_words"))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != ""))
    words = F.col("_words")
    # Splitting nothing gives one empty word.
    df = df.withColumn("n_words", F.when(words[0] == "", 0).otherwise(F.size(words)))
    lines = F.col("_lines")
    df = df.select(
        "_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.aggregate(words, F.lit(0), lambda n, w: n + F.length(w)).cast("long").alias("word_chars"),
        (F.octet_length("_text") - F.length("_text")).cast("long").alias("n_more_bytes"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_words(words, F.col("n_words")).cast("long").alias("n_repeat_words"),
        F.size(F.filter(words, lambda w: w.isin(stops))).cast("long").alias("n_stop_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.filter(lines, lambda x: F.btrim(x, F.lit(SPACE_CHARS)).rlike(r"(\.\.\.|…)$"))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.filter(lines, lambda x: F.btrim(x, F.lit(SPACE_CHARS)).rlike(r"^[-*•‣▪] "))).cast("long").alias("n_bullet_lines"),
    )
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))

    def broken(r: Rule) -> Column:
        top, bottom = F.col(r.numerator), F.col(r.denominator)
        bad = (top < r.least * bottom) if r.least > 0 else F.lit(False)
        if r.most < float("inf"):
            bad = bad | (top > r.most * bottom)
        if r.latin:
            bad = bad & (2 * F.col("n_more_bytes") < F.col("word_chars"))
        return F.when(bad & (bottom > 0) & (F.col("n_words") >= r.from_words), F.lit(r.name))

    failed = F.filter(F.array(*[broken(r) for r in rules]), lambda x: x.isNotNull()) if rules else F.array().cast("array<string>")
    df = df.withColumn("failed", failed).withColumn("base_failed", base)
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).withColumnRenamed("_id", id_col)
