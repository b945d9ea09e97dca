"""Language identification by compression (operator 11).

Each language has a raw-content dictionary for zstandard: pieces of texts of that language. A text is encoded with every
dictionary, and the language whose dictionary makes it smallest is chosen; where the next best is hardly larger the choice
is marked as not accepted. Only runs of letters are encoded, lower-cased and with one blank between them. A text is encoded
whole, in blocks of ``BLOCK`` bytes that each start from the dictionary alone, so that long texts are judged by all
they hold and a block costs the same wherever it stands.

Learning: texts of a language fall into ``BUCKETS`` buckets by hash, and the text with the smallest hash of each bucket
gives one piece from a place that the hash chooses. So copies count once, and at most BUCKETS pieces of PIECE characters a
language reach the driver; with more than ``MAX_LANGS`` languages, those with the most rows are learned. A quarter of
the pieces stays out of the dictionaries and sets the temperature of the scores.

Edge cases: a null text, a text without letters, and every text where no language was learned get ``und`` with score 0 and
are not accepted; ties go to the language with more rows, then to the smaller name; null ids, null languages and texts
without letters are not learned from, and a null id is never held out; repeated rows are judged alike; an empty table gives
an empty result; only id, text and (for learning) language are read, and extra columns may have any name.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.llm.text import frugal, slices
from millrace.storage import Workspace, scratch

#: Pieces a language, characters of a piece, languages, bytes of a dictionary: the bounds of what is learned from.
BUCKETS, PIECE, MAX_LANGS, DICTIONARY = 384, 400, 64, 1 << 16
#: Every so many-th piece sets the temperature. Compression level, bytes encoded at once.
CALIBRATE, LEVEL, BLOCK = 4, 7, 1 << 13
#: A choice is accepted if the next best is larger by this share of the best size, and by a byte at least.
MARGIN = 0.02
UNKNOWN = "und"

_GAP = re.compile(r"[\W\d_]+")
#: Temperatures that are tried, in bits.
_TEMPERATURES = [2 ** (k / 2) for k in range(15)]


def letters(text: str | None) -> bytes:
    """The runs of letters (and of marks between them), lower-cased."""
    if not text or not any(map(str.isalpha, text)):
        return b""
    return _GAP.sub(" ", text.lower()).strip().encode()


@dataclass(frozen=True)
class Languages:
    """Names and dictionaries in order of preference, and the temperature of scores in bits."""

    names: tuple[str, ...]
    dictionaries: tuple[bytes, ...]
    temperature: float = 8.0

    def encoders(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for raw in self.dictionaries:
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out

    def judge(self, data: bytes, encoders: list[zstandard.ZstdCompressor]) -> tuple[str, float, float, bool]:
        """Language, score, margin (share of the best size that the next best is larger by) and acceptance."""
        if not data or not encoders:
            return UNKNOWN, 0.0, 0.0, False
        sizes = encoded_sizes(data, encoders)
        best = min(range(len(sizes)), key=lambda k: (sizes[k], k))
        following = min((x for k, x in enumerate(sizes) if k != best), default=None)
        if following is None:
            return self.names[best], 1.0, 1.0, True
        score = 1 / sum(math.exp(-8 * (x - sizes[best]) / self.temperature) for x in sizes)
        over = following - sizes[best]
        return self.names[best], score, over / sizes[best], over >= max(1, MARGIN * sizes[best])


def encoded_sizes(data: bytes, encoders: list[zstandard.ZstdCompressor]) -> list[int]:
    """Bytes of the whole text under each dictionary."""
    blocks = [data[k : k + BLOCK] for k in range(0, len(data), BLOCK)]
    return [sum(len(e.compress(x)) for x in blocks) for e in encoders]


def from_pieces(pieces: list[tuple[str, int, str]], rows: dict[str, int]) -> Languages:
    """Dictionaries from (language, hash, piece); ``rows`` orders the languages."""
    taken: dict[str, list[bytes]] = {}
    for lang, _, piece in sorted(pieces):
        data = letters(piece)
        if data:
            taken.setdefault(lang, []).append(data)
    names = tuple(sorted(taken, key=lambda x: (-rows[x], x)))
    # a language with few pieces needs them all
    held = {x: taken[x][::CALIBRATE] if len(taken[x]) >= 2 * CALIBRATE else [] for x in names}
    used = {x: [p for k, p in enumerate(taken[x]) if k % CALIBRATE] if held[x] else taken[x] for x in names}
    found = Languages(names, tuple(b" ".join(used[x])[-DICTIONARY:] for x in names))
    encoders, trials = found.encoders(), []
    for k, name in enumerate(names):
        for piece in held[name]:
            sizes = encoded_sizes(piece, encoders)
            trials.append([8 * (x - sizes[k]) for x in sizes])
    if not trials:
        return found
    cost = lambda t: sum(math.log(sum(math.exp(min(-x / t, 700.0)) for x in bits)) for bits in trials)
    return Languages(found.names, found.dictionaries, min(_TEMPERATURES, key=cost))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", workspace: Workspace | None = None) -> Languages:
    """Dictionaries of the languages of ``docs``. Two passes over the texts; what reaches the driver is bounded."""
    ws = scratch(docs.sparkSession, "languages", workspace)
    known = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    least = ws.save(known.groupBy("lang", F.pmod("h", F.lit(BUCKETS)).alias("bucket")).agg(F.min("h").alias("h"), F.count("*").alias("rows")), "least")
    rows = {r.lang: r.rows for r in least.groupBy("lang").agg(F.sum("rows").alias("rows")).orderBy(F.desc("rows"), "lang").limit(MAX_LANGS).collect()}
    if not rows:
        ws.close()
        return Languages((), ())
    wanted = least.where(F.col("lang").isin(list(rows))).select("lang", "h")  # at most MAX_LANGS * BUCKETS rows
    at = F.pmod(F.shiftright("h", 9), F.greatest(F.char_length("text") - PIECE, F.lit(0)) + 1) + 1
    picked = known.join(F.broadcast(wanted), ["lang", "h"]).select("lang", "h", F.col("text").substr(at.cast("int"), F.lit(PIECE)).alias("piece")).groupBy("lang", "h").agg(F.min("piece").alias("piece"))
    found = from_pieces([(r.lang, r.h, r.piece) for r in picked.collect()], rows)
    ws.close()
    return found


def identify(docs: DataFrame, languages: Languages, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, lang_pred, score, margin, accepted`` of every row. No shuffle; the dictionaries go to the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = languages.encoders()
        for batch in batches:
            for part in slices(batch):
                rows = [languages.judge(letters(t), encoders) for t in part.column(1).to_pylist()]
                made = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], names=["id", "lang_pred", "score", "margin", "accepted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(frugal(run), f"id {kind}, lang_pred string, score double, margin double, accepted boolean").withColumnRenamed("id", id_col)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document of ``documents``, learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    languages = learn(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, languages).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "accepted")
