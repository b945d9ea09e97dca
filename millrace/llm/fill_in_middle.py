"""Fill-in-middle transformation (operator 13).

A text is cut into a prefix, a middle and a suffix at units drawn from a hash of its id, and written with sentinels in
prefix-suffix-middle or suffix-prefix-middle order. The units are found with big integers, one bit a byte of the text:
``bytes.translate`` turns the bytes into a mask of their class, shifted boolean operations leave one bit at the first
byte of each unit, ``bit_count`` numbers the units, and halving the integer finds the bit of a given rank. All of it is
linear in the text; a text of m bytes takes some 3 m bytes more.

Units are code points (``char``), words with the blanks behind them (``word``; blanks before the first word belong to
it) or lines with their line ends (``line``).

Edge cases: a null text is empty, and an empty text or one that holds a sentinel stays plain; a null id draws like an
empty id; rows of one id draw alike but are cut by their own lengths, repeated rows alike; blank texts have no word, so
both cuts fall at 0; a text of any length is cut whole; an empty table gives an empty result; only id and text are read, so
extra columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.llm.text import IS_SPACE, encoded, frugal, slices

#: Sentinels of prefix, suffix and middle; hundredths of texts that are cut, and of these in spm order.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE, SPM = 90, 20
#: Seed of the draws.
SEED = 1


def _table(member: Callable[[int], bool]) -> bytes:
    return bytes(b"01"[member(x)] for x in range(256))


_CONTINUES = _table(lambda x: x & 0xC0 == 0x80)
_WORD = _table(lambda x: not IS_SPACE[x])
_NEWLINE = _table(lambda x: x == 0x0A)


def _mask(data: bytes, table: bytes) -> int:
    """The bytes of a class as bits, the first byte's bit highest."""
    return int(data.translate(table), 2)


def starts(data: bytes, unit: str = "char") -> int:
    """A bit at the first byte of each unit."""
    if not data:
        return 0
    first, every = 1 << len(data) - 1, (1 << len(data)) - 1
    if unit == "char":
        return every & ~_mask(data, _CONTINUES)
    if unit == "line":
        return first | _mask(data, _NEWLINE) >> 1
    if unit == "word":
        words = _mask(data, _WORD)
        found = words & ~(words >> 1)
        # blanks in front go to the first word
        return found & ~(1 << found.bit_length() - 1) | first if found else 0
    raise ValueError(f"unknown unit {unit!r}")


def place(bits: int, width: int, rank: int) -> int:
    """Position of the set bit with ``rank`` others before it, counted from the highest of ``width`` bits; ``width`` where
    there is none."""
    if rank >= bits.bit_count():
        return width
    at = 0
    while width > 1:
        low = width // 2
        high = bits >> low
        held = high.bit_count()
        if rank < held:
            bits, width = high, width - low
        else:
            rank, at, bits, width = rank - held, at + width - low, bits & (1 << low) - 1, low
    return at


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of an id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def cut(doc_id: int | None, data: bytes, unit: str = "char", rate: int = RATE, spm: int = SPM, seed: int = SEED, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> tuple[int, str, int | None, int | None, bytes]:
    """Number of units, form, units of prefix and middle, and the text as transformed."""
    bits = starts(data, unit)
    n = bits.bit_count()
    h1, h2, h3, h4 = draws(doc_id, seed)
    p, s, m = (x.encode() for x in sentinels)
    if not data or p in data or s in data or m in data or h3 % 100 >= rate:
        return n, "plain", None, None, data
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    # a cut at 0 leaves nothing before it, wherever the first unit starts
    x, y = (place(bits, len(data), k) if k else 0 for k in (a, b))
    before, between, after = data[:x], data[x:y], data[y:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, b"".join((s, after, p, before, m, between))
    return n, "psm", a, b - a, b"".join((p, before, s, after, m, between))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "char", rate: int = RATE, spm: int = SPM, seed: int = SEED, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """``<id>, n, form, prefix_units, middle_units, output`` of every row. No shuffle; each row stands alone."""
    if unit not in ("char", "line", "word"):
        raise ValueError(f"unknown unit {unit!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [cut(i, t, unit, rate, spm, seed, sentinels) for i, t in zip(part.column(0).to_pylist(), encoded(part.column(1)), strict=True)]
                made = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *made[:4], made[4].cast(pa.string())], names=["id", "n", "form", "prefix_units", "middle_units", "output"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(frugal(run), f"id {kind}, n bigint, form string, prefix_units bigint, middle_units bigint, output string")
    return out.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that ``output`` was made from. Each sentinel occurs once in a text that was cut."""
    p, s, m = sentinels
    head, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)
    psm = F.concat(F.substring_index(F.substring_index(head, s, 1), p, -1), middle, F.substring_index(head, s, -1))
    spm = F.concat(F.substring_index(head, p, -1), middle, F.substring_index(F.substring_index(head, p, 1), s, -1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents``, by its digests."""
    found = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = lambda x: F.sha2(x, 256)
    return found.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), digest("output").alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP13_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || doc_id) AS x FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM h),
s AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM s
"""
