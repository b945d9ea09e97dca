"""Phrase collocation mining (operator 12).

Every 1..max_n-gram of a piece of text becomes a DataFrame row, hash aggregation counts them by language, the counts of
a phrase's parts are joined to it at each cut, scores are exact Decimal quotients, phrases that mostly occur inside a
phrase of one more word are dropped by an anti-join, and a window ranks the rest.

A phrase can't be frequent unless each two neighbours in it are, so a first pass counts the hashes of neighbouring words
and marks the frequent ones in a bitmap. The second pass makes rows of all words, of the pairs in the bitmap, and of longer
phrases that consist of such pairs. A hash that stands for several pairs only lets more rows through; counts are those of
the strings themselves. The bitmap has 16 bits for each frequent pair, and 2 ** 28 (32 MB) at most: with more pairs than
it can tell apart more rows go through, and the result stays the same.

A phrase inside one that is two words longer is inside one that is one word longer, which is at least as frequent; so
one-word extensions decide.

Edge cases: a null text is empty, a null language is ``und`` and counts with rows that say so; texts without words give
nothing; equal scores and counts rank by the phrase's UTF-8 bytes; repeated rows count each time; an empty table gives an
empty result; a text of any length is counted whole, a task holding its longest piece; only text and language are read,
so extra columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from millrace.llm.text import encoded, flat, frugal, mix, slices
from millrace.llm.sql import LOWER, UPPER
from millrace.storage import Workspace, scratch

#: Longest phrase, least count, phrases a language, hundredths of a phrase's count from which a longer one absorbs it.
MAX_N, LEAST, TOP, ABSORB = 4, 30, 2000, 80
UNKNOWN = "und"
#: Bytes handled at once, least and most bits of the bitmap (logarithms), bytes of strings made at once.
SLICE, FEWEST_BITS, MOST_BITS, STRINGS = 1 << 21, 20, 28, 1 << 26

#: 0 in a word, 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_VALUE = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _parts(texts: list[bytes], langs: list[str]) -> Iterator[tuple[list[bytes], list[str]]]:
    """The texts in lots of about ``SLICE`` bytes; a longer text is cut where a piece ends."""
    lot, names, size = [], [], 0
    for text, lang in zip(texts, langs, strict=True):
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > SLICE:
                breaks = np.flatnonzero(_KIND[np.frombuffer(text, np.uint8, SLICE, at)] == 2)
                end = at + int(breaks[-1]) + 1 if len(breaks) else _next_break(text, at + SLICE)
            if size and size + end - at > SLICE:
                yield lot, names
                lot, names, size = [], [], 0
            lot.append(text[at:end])
            names.append(lang)
            size, at = size + end - at, end
    if lot:
        yield lot, names


def _next_break(text: bytes, at: int) -> int:
    for k in range(at, len(text), SLICE):
        breaks = np.flatnonzero(_KIND[np.frombuffer(text, np.uint8, min(SLICE, len(text) - k), k)] == 2)
        if len(breaks):
            return k + int(breaks[0]) + 1
    return len(text)


class Words:
    """The words of some texts: ``norm`` holds them in turn, lower-cased, each with one blank behind it."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        data, bounds = flat(texts)
        kind = _KIND[data]
        at = np.flatnonzero(kind == 0)
        first = np.ones(len(at), bool)
        np.greater(at[1:], at[:-1] + 1, out=first[1:])
        edges = np.searchsorted(at, bounds[:-1])
        first[edges[edges < len(at)]] = True  # a text may start right where another ends
        firsts = np.flatnonzero(first)
        self.sizes = np.diff(np.append(firsts, len(at)))
        starts = at[firsts]
        doc = np.searchsorted(bounds, starts, side="right") - 1
        #: Words of one piece have one number.
        self.piece = np.cumsum(kind == 2)[starts] + doc
        self.starts = firsts + np.arange(len(firsts))
        self.norm = np.full(len(at) + len(firsts), 0x20, np.uint8)
        self.norm[np.arange(len(at)) + np.cumsum(first) - 1] = _LOWER[data[at]]
        self.names = sorted(set(langs))
        self.lang = np.array([self.names.index(x) for x in langs], np.int32)[doc] if langs else np.zeros(0, np.int32)

    def __len__(self) -> int:
        return len(self.sizes)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """For each word: is there a next one in its piece, and the hash of the two with their language."""
        if len(self) < 2:
            return np.zeros(len(self), bool), np.zeros(len(self), np.uint64)
        place = np.arange(len(self.norm) - len(self)) - np.repeat(self.starts - np.arange(len(self)), self.sizes)
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(self.sizes.max()), _STEP)]))
        letters = np.delete(self.norm, self.starts + self.sizes)
        h = mix(np.add.reduceat(_VALUE[letters] * powers[place], self.starts - np.arange(len(self))) + self.sizes.astype(np.uint64))
        seeds = np.array([xxhash.xxh64_intdigest(x) for x in self.names], np.uint64)[self.lang]
        both = np.zeros(len(self), np.uint64)
        both[:-1] = mix(h[:-1] * _STEP + h[1:] + seeds[:-1])
        return np.append(self.piece[1:] == self.piece[:-1], False), both

    def strings(self, at: np.ndarray, n: int) -> pa.Array:
        """The phrases of ``n`` words from the given words on."""
        begin = self.starts[at]
        sizes = self.starts[at + n - 1] + self.sizes[at + n - 1] - begin
        offsets = np.zeros(len(at) + 1, np.int64)
        np.cumsum(sizes, out=offsets[1:])
        data = self.norm[np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], sizes)]
        return pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])

    def counted(self, at: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
        """Rows (lang, words, phrase, f) of the phrases from the given words on, a lot of strings at a time."""
        ends = np.cumsum(self.starts[at + n - 1] + self.sizes[at + n - 1] - self.starts[at])
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STRINGS, side="right")))
            some = at[lo:hi]
            table = pa.table({"lang": pa.array(self.lang[some]), "phrase": self.strings(some, n)}).group_by(["lang", "phrase"], use_threads=False).aggregate([([], "count_all")]).combine_chunks()
            lang = pa.array(self.names, pa.string()).take(table["lang"].combine_chunks())
            yield pa.RecordBatch.from_arrays([lang, pa.array(np.full(table.num_rows, n, np.int32)), _one(table["phrase"]).cast(pa.binary()).cast(pa.string()), _one(table["count_all"])], names=_NAMES)
            lo = hi


_NAMES = ["lang", "words", "phrase", "f"]
_ROWS = "lang string, words int, phrase string, f bigint"


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    for batch in batches:
        for part in slices(batch, limit=SLICE):
            for texts, langs in _parts(encoded(part.column(1)), part.column(0).to_pylist()):
                words = Words(texts, langs)
                if len(words):
                    yield words


def _frequent_pairs(texts: DataFrame, least: int) -> DataFrame:
    """``h`` of neighbouring words that occur ``least`` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _lots(batches):
            joined, both = words.pairs()
            h, c = np.unique(both[joined], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["h", "c"])

    return texts.mapInArrow(frugal(run), "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= least).select("h")


def _bitmap(hashes: DataFrame) -> tuple[int, bytes]:
    """Logarithm of the number of bits, and a bitmap that holds every hash."""
    n = hashes.count()
    log = min(MOST_BITS, max(FEWEST_BITS, (16 * n).bit_length()))
    bit = F.pmod("h", F.lit(1 << log)) + 1  # the bitmap functions count from 1
    out = bytearray((1 << log) // 8 + 8192)
    for k, bits in hashes.groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).toLocalIterator():
        out[(k - 1) * 4096 : (k - 1) * 4096 + len(bits)] = bits
    return log, bytes(out)


def gram_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_n: int = MAX_N, least: int = LEAST, workspace: Workspace | None = None) -> DataFrame:
    """``lang, words, phrase, f``: counts of all phrases of up to ``max_n`` words that occur ``least`` times or more, and
    with ``words`` 0 the number of words of each language."""
    spark = docs.sparkSession
    ws = scratch(spark, "phrases", workspace)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))
    frequent = ws.save(_frequent_pairs(texts, least), "pairs")
    log, bits = _bitmap(frequent)
    sent = spark.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(sent.value, np.uint8)
        for words in _lots(batches):
            total = np.bincount(words.lang, minlength=len(words.names))
            k = len(words.names)
            yield pa.RecordBatch.from_arrays([pa.array(words.names, pa.string()), pa.array([0] * k, pa.int32()), pa.array([""] * k), pa.array(total, pa.int64())], names=_NAMES)
            yield from words.counted(np.arange(len(words)), 1)
            joined, both = words.pairs()
            at = (both.view(np.int64) % (1 << log)).astype(np.int64)
            pair = joined & (table[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0)
            run_of = pair
            for n in range(2, max_n + 1):
                yield from words.counted(np.flatnonzero(run_of), n)
                # n + 1 words: n words here, and a pair from the last of them on
                run_of = run_of & np.append(pair[n - 1 :], np.zeros(min(n - 1, len(pair)), bool))

    rows = texts.mapInArrow(frugal(run), _ROWS)
    counts = ws.save(rows.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where((F.col("words") == 0) | (F.col("f") >= least)), "counts")
    ws.keep(counts)
    return counts


def _decimal(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def scored(counts: DataFrame) -> DataFrame:
    """``lang, phrase, words, a, l, r, score`` of the phrases of two words and more, at the cut that scores lowest."""
    several = counts.where("words >= 2").select("lang", "phrase", "words", F.col("f").alias("a"))
    w = F.split("phrase", " ")
    cuts = F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(w, F.lit(1), k), " ").alias("first"), F.array_join(F.slice(w, k + 1, F.col("words")), " ").alias("rest")))
    cut = several.select("*", F.inline(cuts))
    part = counts.where("words >= 1")
    left, right = (part.select("lang", F.col("phrase").alias(name), F.col("f").alias(f)) for name, f in (("first", "l"), ("rest", "r")))
    met = cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("wide_a", _decimal(F.col("a")) * F.lit(2000000)).withColumn("wide_lr", _decimal(F.col("l")) + _decimal(F.col("r")))
    best = met.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(F.expr("wide_a div wide_lr").alias("score"), "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "words", "a", "best.l", "best.r", "best.score")


def unabsorbed(phrases: DataFrame, absorb: int = ABSORB) -> DataFrame:
    """The phrases without a phrase of one more word around them that has ``absorb`` hundredths of their count or more."""
    w = F.split("phrase", " ")
    inner = F.array(F.array_join(F.slice(w, F.lit(1), F.col("words") - 1), " "), F.array_join(F.slice(w, F.lit(2), F.col("words") - 1), " "))
    longer = phrases.where("words > 2").select(F.col("lang").alias("of"), F.explode(inner).alias("part"), F.col("a").alias("f")).groupBy("of", "part").agg(F.max("f").alias("f"))
    covers = (F.col("lang") == F.col("of")) & (F.col("phrase") == F.col("part")) & (_decimal(F.col("f")) * F.lit(100) >= _decimal(F.col("a")) * F.lit(absorb))
    return phrases.join(longer, covers, "left_anti")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_n: int = MAX_N, least: int = LEAST, absorb: int = ABSORB, top: int = TOP, workspace: Workspace | None = None) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best ``top`` phrases of each language."""
    ws = scratch(docs.sparkSession, "collocations", workspace)
    counts = gram_counts(docs, text_col, lang_col, max_n, least, ws)
    total = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    phrases = ws.save(scored(counts), "scored")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = unabsorbed(phrases, absorb).withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of every language of ``documents``."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = rf"""
WITH d AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM d),
g AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, {MAX_N + 1}) t(k) WHERE len(w) >= k) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k >= 2 AND f >= {LEAST}),
cut AS MATERIALIZED (SELECT lang, phrase, k, a, x, array_to_string(w[1:x], ' ') AS first, array_to_string(w[x + 1:], ' ') AS rest FROM c, range(1, {MAX_N}) t(x) WHERE x < k),
lc AS MATERIALIZED (SELECT cut.*, g.f AS l FROM cut JOIN g ON g.lang = cut.lang AND g.phrase = cut.first),
s AS MATERIALIZED (SELECT lc.*, g.f AS r, 2000000::HUGEINT * a // (l::HUGEINT + g.f) AS score FROM lc JOIN g ON g.lang = lc.lang AND g.phrase = lc.rest),
b AS MATERIALIZED (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, x) = 1),
part AS MATERIALIZED (SELECT lang, a AS f, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM c, range(2, {MAX_N}) t(m), range(1, {MAX_N}) u(i) WHERE m < k AND i + m - 1 <= k),
gone AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN part USING (lang, phrase) WHERE 100::HUGEINT * part.f >= {ABSORB}::HUGEINT * c.a),
o AS (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b ANTI JOIN gone USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM o JOIN n USING (lang) WHERE rank <= {TOP}
"""
