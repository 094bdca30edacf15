"""Phrase collocation mining: only the longest windows are counted, ROLLUP gives every shorter phrase.

1. A position leads a window of up to four words of its piece. Words and pairs of neighbouring words are counted by 64-bit
   hash, then triples of frequent pairs; the hashes of those that occur often enough to be in a candidate go into bit tables
   of bounded size. What only seems to be frequent costs time, never a count: nothing frequent is missed.
2. Each position is counted once, as the longest run of frequent triples that it leads, padded with empty words (or a
   frequent pair, a frequent word, nothing). A phrase with enough occurrences holds frequent words, pairs and triples only,
   so each of its occurrences starts such a window. Windows are summed
   first, then a Spark ROLLUP over (lang, w1, w2, w3, w4) sums the shorter prefixes: counts of all phrases
   above the limit, of single words, and of all words of a language, without exploding n-grams order by order.
3. Phrases meet the counts of their parts by joins on (lang, part); the lowest-scoring cut counts. Longer phrases name the
   phrases inside them, and a phrase goes when one of these has enough of its occurrences.
4. The best of a language are ranked in two steps, in hashed parts of the language first.

Null and empty texts have no words; a null language is ``und``. Ties of score go by count, then by phrase (UTF-8 bytes);
ties of cuts to the shortest first part. Repeated rows count as often as they stand there, ids are not read, other columns
may have any name. A text is read in blocks that end with a piece, so a long text needs no more memory than its longest
piece. Empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .registry import query
from .text import WordHashes, documents, scramble, stored

LONGEST, LEAST, TOP = 4, 30, 2000
COVERED, OF = 80, 100
SCORE = 2_000_000
BLOCK, HELD = 1 << 21, 1 << 23  # bytes of text looked at in one go; of all languages that wait for more
TABLE_BITS = 29  # at most 64 MB of bits for the frequent pairs
SLICES = 256
ROWS = 1 << 16  # rows sent to Spark at once
PARTS = 64
BREAK = b"\xff"  # no UTF-8 text holds this byte
CUTS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d", 10 * BREAK)
WORDS = [f"w{i}" for i in range(1, LONGEST + 1)]


def tokens(text: bytes) -> list[bytes]:
    """The words of a text, with a break where a piece ends."""
    return text.lower().translate(CUTS).replace(BREAK, b" \xff ").split()  # only spaces and tabs are left of what this splits at


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(lang, tokens) of about ``BLOCK`` bytes of text of one language each; texts are cut behind a piece."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    waiting = 0

    def take(lang: str) -> tuple[str, list[bytes]]:
        nonlocal waiting
        waiting -= size.pop(lang)
        return lang, tokens(BREAK.join(held.pop(lang)))

    def put(lang: str, raw: bytes) -> Iterator[tuple[str, list[bytes]]]:
        nonlocal waiting
        held.setdefault(lang, []).append(raw)
        size[lang] = size.get(lang, 0) + len(raw)
        waiting += len(raw)
        if size[lang] >= BLOCK:
            yield take(lang)

    for batch in batches:
        for s in range(0, batch.num_rows, 256):
            for lang, text in zip(*(c.to_pylist() for c in batch.slice(s, 256).columns)):
                raw = (text or "").encode("utf-8", "surrogatepass")
                at = 0
                while len(raw) - at > BLOCK:
                    end = max(raw.rfind(c, at, at + BLOCK) for c in (b"\n", b".", b","))
                    if end < 0:
                        end = min((e for e in (raw.find(c, at + BLOCK) for c in (b"\n", b".", b",")) if e >= 0), default=len(raw))
                    yield from put(lang, raw[at:end])
                    at = end + 1
                yield from put(lang, raw[at:])
                if waiting > HELD:
                    yield take(max(size, key=size.get))
    for lang in list(held):
        yield take(lang)


class Places:
    """The words of a block, their hashes in their language, and which of them, and runs of them, occur often enough."""

    def __init__(self, lang: str, ws: list[bytes], known: WordHashes):
        h = known.of(ws)
        self.there = h != np.uint64(known[BREAK])
        self.word = scramble(h + scramble(known.of([lang.encode("utf-8", "surrogatepass")])))
        self.pair = scramble(self.word[:-1] + h[1:])
        self.paired = self.there[:-1] & self.there[1:]
        self.triple = scramble(self.pair[:-1] + h[2:]) if len(ws) > 2 else np.empty(0, np.uint64)

    def frequent_pairs(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a place has a frequent word, and leads a frequent pair."""
        word = self.there & _is_set(table, self.word)
        return word, self.paired & word[:-1] & word[1:] & _is_set(table, self.pair)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of words and pairs and how often they occur in a block of the task."""
    known = WordHashes(1 << 18)
    for lang, ws in _blocks(batches):
        p = Places(lang, ws, known)
        yield from _summed(np.concatenate([p.word[p.there], p.pair[p.paired]]))


def _triple_counts(table):
    """The same of triples both pairs of which are frequent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits = WordHashes(1 << 18), np.frombuffer(table.value, np.uint8)
        for lang, ws in _blocks(batches):
            p = Places(lang, ws, known)
            on = p.frequent_pairs(bits)[1]
            yield from _summed(p.triple[on[:-1] & on[1:]])
    return run


def _summed(keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    keys, counts = np.unique(keys, return_counts=True)
    for s in range(0, len(keys), ROWS):
        some = slice(s, s + ROWS)
        yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(counts[some].astype(np.int64))], ["key", "c"])


def _table_bits(n: int) -> int:
    """One key in sixteen bits, up to the bound."""
    return min(TABLE_BITS, max(14, (16 * n).bit_length()))


def frequent(texts: DataFrame, count, least: int) -> np.ndarray:
    """A bit table in which every key is set that ``count`` finds ``least`` times or more; ``texts``: lang, text."""
    keys = texts.mapInArrow(count, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")).filter(F.col("c") >= least)
    keys = stored(keys.select("key"), "frequent")
    bits = _table_bits(keys.count())
    per = (1 << bits) // SLICES

    def pack(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(per, bool)
        for batch in batches:
            own[batch.column("at").to_numpy()] = True
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(own).tobytes()], pa.binary())], ["s", "bits"])

    place = F.pmod("key", F.lit(1 << bits))
    placed = keys.select(F.floor(place / per).cast("int").alias("s"), (place % per).cast("int").alias("at")).distinct()
    table = np.zeros((1 << bits) // 8, np.uint8)
    for r in placed.groupBy("s").applyInArrow(pack, "s int, bits binary").collect():  # 2 ** TABLE_BITS / 8 bytes at most
        table[r.s * per // 8:(r.s + 1) * per // 8] = np.frombuffer(r.bits, np.uint8)
    return table


def _is_set(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = key & np.uint64(8 * len(table) - 1)
    return (table[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1 > 0


def _distinct(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of columns of numbers below 2**32 and their counts."""
    code = columns[0].astype(np.uint64)
    for c in columns[1:]:
        code = (np.unique(code, return_inverse=True)[1].astype(np.uint64) << np.uint64(32)) | c.astype(np.uint64)
    _, firsts, counts = np.unique(code, return_index=True, return_counts=True)
    return [c[firsts] for c in columns], counts


def _windows(pairs, triples):
    """Padded longest windows with their counts in a block of the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pair_bits, triple_bits = WordHashes(1 << 18), *(np.frombuffer(t.value, np.uint8) for t in (pairs, triples))
        for lang, ws in _blocks(batches):
            p = Places(lang, ws, known)
            word, pair = p.frequent_pairs(pair_bits)
            on = np.zeros((LONGEST, len(ws) + LONGEST), bool)  # whether a place leads a frequent run of so many words
            on[0, :len(word)], on[1, :len(pair)] = word, pair
            on[2, :len(p.triple)] = pair[:-1] & pair[1:] & _is_set(triple_bits, p.triple) if len(p.triple) else False
            for k in range(3, LONGEST):
                on[k, :-1] = on[k - 1, :-1] & on[k - 1, 1:]
            ids: dict[bytes, int] = {b"": 0}
            code = np.zeros(len(ws) + LONGEST, np.int64)
            often = np.flatnonzero(word)
            code[often] = np.fromiter((ids.setdefault(ws[i], len(ids)) for i in often.tolist()), np.int64, len(often))
            rows, counts = _distinct([np.where(on[k, :len(ws)], code[k:k + len(ws)], 0)[p.there] for k in range(LONGEST)])
            names = pa.array(ids, pa.binary()).cast(pa.string())
            for s in range(0, len(counts), ROWS):
                some = slice(s, s + ROWS)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts[some]), pa.string()), *(names.take(pa.array(c[some])) for c in rows),
                                                  pa.array(counts[some].astype(np.int64))], ["lang", *WORDS, "c"])
    return run


def counted(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, size (words in the phrase; 0: all words of the language), w1 .. w4 and f, for phrases with ``least`` occurrences."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).cast("string").alias("lang"), "text").filter("text IS NOT NULL")
    sent = docs.sparkSession.sparkContext.broadcast
    pairs = sent(frequent(texts, _counts, least).tobytes())
    triples = sent(frequent(texts, _triple_counts(pairs), least).tobytes())
    windows = texts.mapInArrow(_windows(pairs, triples), "lang string, w1 string, w2 string, w3 string, w4 string, c long")
    longest = windows.groupBy("lang", *WORDS).agg(F.sum("c").alias("c"))  # one row a window before prefixes multiply them
    rolled = longest.rollup("lang", *WORDS).agg(F.sum("c").alias("f"), F.grouping_id().alias("_g"))
    # grouping_id has a bit for each column that is summed away, the last column's is 1
    size = F.lit(LONGEST) - F.bit_count("_g")
    last = F.get(F.array(F.lit("-"), *WORDS), size)  # a padded window counts where it is not padded
    rolled = rolled.withColumn("size", size).filter((F.col("size") >= 0) & ((F.col("size") == 0) | ((last != "") & (F.col("f") >= least))))
    return rolled.select("lang", "size", *WORDS, "f")


def _phrase(words: list[Column]) -> Column:
    return F.concat_ws(" ", *words)


def _best(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of a language with their rank; parts of a language are cut to ``top`` rows first."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    for keys in (["lang", part], ["lang"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= top)
    return rows


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each language."""
    found = stored(counted(docs, least), "phrases")
    names = [F.col(w) for w in WORDS]
    whole = F.element_at(F.array(*(_phrase(names[:m]) for m in range(1, LONGEST + 1))), F.col("size"))
    counts = found.filter("size > 0").select("lang", "size", whole.alias("phrase"), "f", *WORDS)
    many = counts.filter("size > 1").withColumnRenamed("f", "a")

    def cut(k: int, m: int) -> Column:
        return F.struct(F.lit(k).alias("k"), _phrase(names[:k]).alias("first"), _phrase(names[k:m]).alias("rest"))

    cuts = F.element_at(F.array(*(F.array(*(cut(k, m) for k in range(1, m))) for m in range(2, LONGEST + 1))), F.col("size") - 1)
    split = many.select("lang", "phrase", "a", F.explode(cuts).alias("_c")).select("lang", "phrase", "a", "_c.*")
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    split = split.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    wide = lambda c, p: F.col(c).cast(f"decimal({p},0)")
    split = split.withColumn("_up", wide("a", 19) * F.lit(SCORE).cast("decimal(7,0)")).withColumn("_by", wide("l", 19) + wide("r", 19))
    split = split.withColumn("score", F.expr("_up div _by"))
    scored = split.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("_s")).select("lang", "phrase", "a", "_s.*")

    def inside(m: int) -> Column:
        return F.array(*(_phrase(names[s:s + k]) for k in range(2, m) for s in range(m - k + 1)))

    parts = F.element_at(F.array(*(inside(m) for m in range(3, LONGEST + 1))), F.col("size") - 2)
    longer = many.filter("size > 2").select("lang", F.col("a").alias("_b"), F.explode(parts).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("_b").alias("_b"))
    own = scored.join(longer, ["lang", "phrase"], "left").filter(F.col("_b").isNull() | (OF * wide("_b", 19) < COVERED * wide("a", 19)))
    totals = found.filter("size = 0").select("lang", F.col("f").alias("n"))
    best = _best(own.select("lang", "phrase", "a", "l", "r", "score"), top).join(totals, "lang")
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(ps) AS p FROM pieces)),
places AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM words WHERE len(ws) > 0),
grams AS (SELECT lang, k, ws[i:i + k - 1] AS g FROM places, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, k, g, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM words GROUP BY lang),
cuts AS (SELECT c.lang, c.g, c.k, c.a, j, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a) // (l.a + r.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM f WHERE k > 1) c
  JOIN f l ON l.lang = c.lang AND l.g = c.g[1:j] JOIN f r ON r.lang = c.lang AND r.g = c.g[j + 1:c.k]),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
inner_parts AS (SELECT lang, g[s:s + m - 1] AS g, max(a) AS b
  FROM (SELECT lang, g, k, a, m, unnest(range(1, k - m + 2)) AS s FROM f, (SELECT unnest([2, 3]) AS m) WHERE k > m) GROUP BY 1, 2),
own AS (SELECT s.* FROM scored s LEFT JOIN inner_parts p ON p.lang = s.lang AND p.g = s.g WHERE p.b IS NULL OR 100 * p.b < 80 * s.a),
ranked AS (SELECT *, array_to_string(g, ' ') AS phrase FROM own)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT lang, phrase, a, l, r, n, score::BIGINT AS score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM ranked JOIN n USING (lang)) WHERE rank <= 2000
"""


@query("op12_phrase_collocations", SQL)
def op12_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))
