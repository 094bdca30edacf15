"""Quality rules: a table of thresholds compiled into one projection, without user functions.

Every rule names a ratio of the text and the range in which a clean document lies. ``measures`` gives the counts as
columns, ``verdict`` turns the table into one boolean column; the whole is a narrow projection, no exchange.

Null and empty texts have no words and fail the base rule; repeated rows get equal results; other columns of the input
are ignored, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import query
from .text import WORD, body, documents

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
INDEX_BITS = 24

# Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is that it for was on with as be by at this from are or an not you he a "
    "de la le les et des en un une du que est pour qui dans sur pas par au avec "
    "der die das und den von zu mit sich auf ist im dem nicht ein eine als auch für aus "
    "el los y del se las por con no su para al lo como más o pero una"
).split()


@dataclass(frozen=True)
class Rule:
    """A clean document has ``low <= measure <= high``; with fewer words than ``least_words`` the rule is silent."""
    measure: str
    low: float = float("-inf")
    high: float = float("inf")
    least_words: int = 0


RULES = (
    Rule("mean_word_length", 2.0, 14.0),
    Rule("symbol_ratio", high=0.2),
    Rule("stop_ratio", low=0.03),
    Rule("dup_line_ratio", high=0.5),
)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, also where ``use`` names it inside lambdas."""
    return F.get(F.transform(F.array(value), use), 0)


def _packed(h: Column) -> Column:
    """From word hashes, sorted longs: the high bits of a 3-word window's hash, then the place of its first word."""
    place = (1 << INDEX_BITS) - 1

    def key(x: Column, i: Column) -> Column:
        return F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)).bitwiseAND(F.lit(~place)).bitwiseOR(i.cast("long"))

    return F.sort_array(F.slice(F.transform(h, key), F.lit(1), F.size(h) - 2))


def _window(ws: Column, p: Column) -> Column:
    return F.slice(ws, p.cast("int") + 1, F.lit(3))


def _alike(s: Column, k: Column) -> Column:
    """Whether the entries at k and k+1 have the same window hash."""
    return F.shiftright(F.get(s, k), INDEX_BITS) == F.shiftright(F.get(s, k + 1), INDEX_BITS)


def _covered(first: Column) -> Column:
    return F.size(F.array_union(F.array_union(first, F.transform(first, lambda p: p + 1)),
                                F.transform(first, lambda p: p + 2)))


def repeat_words(ws: Column, packed: Column) -> Column:
    """Number of words in 3-word windows that the text holds twice or more.

    Windows are compared through sorted packed hashes. Neighbours with equal hash bits are compared word by word; on a
    difference, or beyond 2**24 words, the windows themselves are sorted, so the count is exact.
    """
    place = F.lit((1 << INDEX_BITS) - 1)
    at = lambda k: F.get(packed, k).bitwiseAND(place).cast("int")
    pairs = F.filter(F.sequence(F.lit(0), F.size(packed) - 2), lambda k: _alike(packed, k))
    collision = F.exists(pairs, lambda k: _window(ws, at(k)) != _window(ws, at(k + 1)))
    quick = _let(pairs, lambda ks: F.array_union(F.transform(ks, at), F.transform(ks, lambda k: at(k + 1))))
    full = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(ws) - 3),
                                    lambda p: F.struct(_window(ws, p).alias("w"), p.alias("p"))))
    same = lambda f, i, s: F.coalesce(F.get(f, i)["w"] == s["w"], F.lit(False))
    exact = _let(full, lambda f: F.transform(F.filter(f, lambda s, k: same(f, k + 1, s) | same(f, k - 1, s)), lambda s: s["p"]))
    return (F.when(F.size(ws) < 4, 0)
            .when((F.size(ws) >= 1 << INDEX_BITS) | collision, _let(exact, _covered))
            .otherwise(_let(quick, _covered)).cast("long"))


def _without(text: Column, characters: str, put: str = "") -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(put))
    return text


def measures(docs: DataFrame) -> DataFrame:
    """doc_id with counts and ratios of its whole text."""
    base = docs.select("doc_id", body().alias("_t"))
    base = base.withColumn("_s", _without(F.col("_t"), BLANKS[1:], " "))
    base = base.withColumn("_w", F.array_remove(F.split("_s", " "), ""))
    base = base.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    base = base.withColumn("_p", F.when(F.size("_w") >= 4, _packed(F.col("_h"))))
    base = base.withColumn("_l", F.filter(F.split("_t", "\n", -1), lambda s: s.rlike(WORD)))
    counts = base.select(
        "doc_id", F.size("_w").cast("long").alias("n_words"),
        F.length(F.replace("_s", F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(_without(F.col("_t"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_w"), F.col("_p")).alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.size(F.filter("_w", lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return counts.select("*", ratio("word_chars", "n_words").alias("mean_word_length"),
                         ratio("n_symbols", "n_words").alias("symbol_ratio"), ratio("n_stop", "n_words").alias("stop_ratio"),
                         ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one boolean column: true for a document inside every range."""
    ok = F.lit(True)
    for r in rules:
        ok = ok & (F.col(r.measure).between(r.low, r.high) | (F.col("n_words") < r.least_words))
    return ok


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, ratios and the verdict of every document."""
    return measures(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
ORACLE_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '{WORD}')) AS l
           FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id),
m AS (SELECT t.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
             len(l)::BIGINT AS n_lines, len(list_filter(w, lambda x: lower(x) IN ({_STOP})))::BIGINT AS n_stop
      FROM t LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 2.0 AND 14.0 AND n_symbols / n_words <= 0.2
         AND n_stop / n_words >= 0.03 AND n_dup_lines / n_lines <= 0.5 AS kept
FROM b
"""


@query("op6_quality_rules", ORACLE_SQL)
def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
