"""Quality rules: base counts, and the divergence of a document's histograms from language references.

Built-in SQL functions only. Two histograms are compared with each reference by the Jensen-Shannon distance (square
root of the divergence in bits, 0 to 1): character classes and common words. A document is far from language if even
its nearest reference is far; a document of too few words is not judged by its histograms.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moderata.llm.shared import materialised

SPACES = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]+"

#: Shares of ASCII letters, other non-ASCII characters, digits, white space, punctuation and the rest, by language.
CLASS_SHARES: dict[str, list[float]] = {
    "en": [0.800, 0.001, 0.002, 0.168, 0.028, 0.001],
    "de": [0.775, 0.037, 0.002, 0.157, 0.028, 0.001],
    "fr": [0.712, 0.088, 0.002, 0.167, 0.030, 0.001],
    "es": [0.730, 0.076, 0.002, 0.162, 0.029, 0.001],
}
#: Shares of common words among all words, by language.
WORD_SHARES: dict[str, dict[str, float]] = {
    "en": {"the": 0.061, "of": 0.033, "and": 0.025, "to": 0.020, "a": 0.016, "in": 0.014, "is": 0.011, "that": 0.010, "it": 0.009, "for": 0.008},
    "de": {"der": 0.059, "die": 0.033, "und": 0.025, "in": 0.019, "den": 0.015, "von": 0.014, "zu": 0.011, "das": 0.010, "mit": 0.009, "sich": 0.008},
    "fr": {"de": 0.060, "la": 0.037, "le": 0.024, "et": 0.020, "les": 0.016, "des": 0.016, "en": 0.012, "un": 0.011, "du": 0.009, "une": 0.008},
    "es": {"de": 0.061, "la": 0.035, "que": 0.024, "el": 0.021, "en": 0.016, "y": 0.013, "los": 0.012, "se": 0.011, "del": 0.010, "las": 0.009},
}


@dataclass(frozen=True)
class Limits:
    """base rules: fewer words, or more than so many percent repeated; histograms: judged from min_words words on.

    word_distance is fitted to the labels of sf0.1 that reach the histograms, in steps of 0.01: at 0.22 and 0.23 the fewest
    are on the wrong side (16), and 0.23 rejects fewer good texts, 6 of 3,196, while 10 of 290 bad ones are within it. A
    text without any common word is at 0.33 to 0.34.
    """

    base_words: int = 20
    repeat_percent: int = 30
    min_words: int = 60
    class_distance: float = 0.30
    word_distance: float = 0.23


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once even where a lambda of the body uses it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, size: int = 8) -> Column:
    """Words that lie in a window of `size` words found at least twice, the first occurrence included."""

    def covered(hashes: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            twice = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]))
            at = F.sort_array(F.transform(twice, lambda x: x["i"]))
            return let(at, lambda p: F.aggregate(F.transform(p, lambda v, j: F.least(F.lit(size), F.coalesce(F.get(p, j + 1) - v, F.lit(size)))), F.lit(0), lambda a, b: a + b))

        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(ordered, of_sorted))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.xxhash64(F.slice(w, i, size)))

    return F.when(F.size(words) <= size, 0).otherwise(let(F.transform(words, lambda x: F.xxhash64(x)), lambda w: let(windows(w), covered)))


def js_distance(p: Column, q: list[float]) -> Column:
    """The Jensen-Shannon distance of a histogram (shares, one for each of q) to a reference."""
    reference = F.array(*[F.lit(float(x)) for x in q])

    def part(a: Column, b: Column) -> Column:
        middle = (a + b) / 2
        own = F.when(a > 0, a * F.log2(a / middle)).otherwise(0.0)
        other = F.when(b > 0, b * F.log2(b / middle)).otherwise(0.0)
        return (own + other) / 2

    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(p, reference, part), F.lit(0.0), lambda x, y: x + y)))


def measured(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_distance, word_distance) of each whole text."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # What is left of the text as one character class after the other is taken out; each step is used twice.
    rows = rows.withColumn("t0", F.regexp_replace("text", SPACES, ""))
    rows = rows.withColumn("t1", F.regexp_replace("t0", "[A-Za-z]+", ""))
    rows = rows.withColumn("t2", F.regexp_replace("t1", "[^\\x00-\\x7F]+", ""))
    rows = rows.withColumn("t3", F.regexp_replace("t2", "[0-9]+", ""))
    rows = rows.withColumn("t4", F.regexp_replace("t3", "[.,;:!?'\"()-]+", ""))
    lengths = {k: F.length(k) for k in ("text", "t0", "t1", "t2", "t3", "t4")}
    has_word = lambda line: F.length(F.regexp_replace(line, SPACES, "")) > 0
    rows = rows.select(
        "id",
        *[n.alias(f"n_{k}") for k, n in lengths.items()],
        (lengths["t4"] - F.length(F.regexp_replace("t4", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("text", SPACES), lambda x: x != "").alias("words"),
        F.filter(F.split("text", "\n"), has_word).alias("lines"),
    )
    common = sorted({w for shares in WORD_SHARES.values() for w in shares})
    plain = lambda x: F.lower(F.btrim(x, F.lit(".,;:!?")))
    rows = rows.select(
        "*",
        F.size("words").cast("long").alias("n_words"),
        F.filter(F.transform("words", plain), lambda x: x.isin(common)).alias("common"),
        F.array(*[c.cast("double") / F.greatest(F.col("n_text"), F.lit(1)) for c in (F.col("n_t0") - F.col("n_t1"), F.col("n_t1") - F.col("n_t2"), F.col("n_t2") - F.col("n_t3"), F.col("n_text") - F.col("n_t0"), F.col("n_t3") - F.col("n_t4"), F.col("n_t4"))]).alias("classes"),
    )
    share = lambda word: F.size(F.filter("common", lambda x: x == word)).cast("double") / F.greatest(F.col("n_words"), F.lit(1))
    rows = rows.select("*", *[share(w).alias(f"w_{w}") for w in common])

    def nearest_words(words: dict[str, float]) -> Column:
        bins = [F.col(f"w_{w}") for w in words]
        rest = F.greatest(F.lit(0.0), F.lit(1.0) - sum(bins[1:], bins[0]))
        return js_distance(F.array(*bins, rest), [*words.values(), 1 - sum(words.values())])

    return rows.select(
        F.col("id").alias(id_col),
        "n_words",
        F.col("n_t0").cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.least(*[js_distance(F.col("classes"), q) for q in CLASS_SHARES.values()]).alias("class_distance"),
        F.least(*[nearest_words(q) for q in WORD_SHARES.values()]).alias("word_distance"),
    )


def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limits: Limits | None = None) -> DataFrame:
    """The measures of each row with base_failed and kept; null and empty texts have no words and fail.

    One row for each row (repeated ids too), no shuffle, other columns are not read. kept: the base rules hold, and the
    text either has fewer than min_words words or both distances to the nearest reference are within their limits.
    """
    limits = limits or Limits()
    rows = measured(docs, id_col=id_col, text_col=text_col)
    failed = (F.col("n_words") < limits.base_words) | (100 * F.col("n_repeat_words") > limits.repeat_percent * F.col("n_words"))
    near = (F.col("class_distance") <= limits.class_distance) & (F.col("word_distance") <= limits.word_distance)
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ((F.col("n_words") < limits.min_words) | near))


def keep_good(docs: DataFrame, *, text_col: str = "text", limits: Limits | None = None) -> DataFrame:
    """The rows, every column as it was, whose text passes the quality rules."""
    # The verdict rides along with the whole row, so that nothing is joined and repeated ids are judged one by one.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text_col].alias("text"))
    judged = quality(rows, id_col="row", text_col="text", limits=limits)
    # Written first: a filter, or columns left out, would have the optimizer merge the stages and compute each chain many times.
    return materialised(judged).where("kept").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
