"""Stand-ins for the driver tables: documents as catalogue rows with text hashes for image hashes, embeddings as faces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.storage import Workspace

try:  # the interpreter's own: hashlib's sets up a context for each of these short inputs, which takes as long again
    from _md5 import md5
except ImportError:
    from hashlib import md5

_BLANK = " \t\n\r"
#: All blanks as spaces.
_SPACED = bytes.maketrans(_BLANK.encode(), b" " * len(_BLANK))


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows without signatures."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = F.size(F.split(F.btrim(F.lower("text"), F.lit(_BLANK)), f"[{_BLANK}]+"))
    return d.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"), F.col("source").alias("bucket"),
        F.concat_ws("/", F.lit("/corpus"), "lang", "source", F.col("doc_id").cast("string")).alias("relPath"), F.col("n_chars").alias("size"),
        F.col("n_chars").cast("int").alias("width"), words.alias("height"), (F.lit(1_700_000_000) + F.col("doc_id") * 3600).alias("dateModified"),
        F.when(F.col("doc_id") % 3 == 0, F.lit(0).cast("bigint")).otherwise((F.lit(1_600_000_000) + F.col("doc_id") * 86_400) * 1000).alias("dateTaken"),
        F.sha2("text", 256).alias("sha"), F.lit(None).cast("string").alias("docUri"), "text",
    )


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _majority(raw: np.ndarray) -> int:
    """The number whose bits are those that most rows of 8 bytes have; bits are summed in bytes, 255 rows at a time."""
    if not len(raw):
        return 0
    lanes = np.unpackbits(raw, axis=1).view(np.uint64)
    ones = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0).view(np.uint8).sum(0, dtype=np.int64)
    return _signed(int.from_bytes(np.packbits(2 * ones > len(raw)).tobytes(), "big"))


def _signature(words: list[bytes]) -> tuple[int, int, list[int]]:
    one, two = (np.frombuffer(b"".join([md5(t).digest() for t in x]), np.uint8).reshape(-1, 16)[:, :8] for x in (words, map(b" ".join, zip(words, words[1:], strict=False))))
    cells = (np.ascontiguousarray(one[:, :4]).view(">u4").ravel() % 48).astype(np.int64)
    counts = np.bincount(cells, minlength=48)
    return _majority(one), _majority(two), np.minimum(255, 255 * counts // max(1, len(words))).tolist()


def text_signature(words: list[str]) -> tuple[int, int, list[int]]:
    """SimHash of words, of word pairs, and 48 hashed word shares."""
    return _signature([w.encode() for w in words])


def split(text: bytes) -> list[bytes]:
    """The words of a trimmed text; an empty one has one empty word."""
    return [w for w in text.translate(_SPACED).split(b" ") if w] or [b""]


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with signatures in place of their trimmed ``text``, one text at a time: the words of a whole batch take many times its
    bytes."""
    for batch in batches:
        text, rest = batch["text"].cast(pa.binary()), batch.drop_columns("text")
        sig = [_signature(split(t.as_py()) if t.is_valid else []) for t in text]
        made = [pa.array([s[k] for s in sig], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int32())))]
        yield pa.RecordBatch.from_arrays([*rest.columns, *made], names=[*rest.schema.names, "phash", "dhash", "colorSig"])


def signed_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows with signatures, written once so that later plans don't compute them again. Texts are read once, and
    the other columns go with them, so nothing is joined."""
    base = photos(spark, sf_dir)
    schema = ", ".join([*(f"{c} {kind}" for c, kind in base.drop("text").dtypes), "phash bigint, dhash bigint, colorSig array<int>"])
    signed = base.withColumn("text", F.btrim(F.lower("text"), F.lit(_BLANK))).mapInArrow(signatures, schema)
    return Workspace(spark, "signed").save(signed.withColumn("sigVersion", F.lit(1)), "photos")


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    v = F.col("vec_id")
    person = F.when(v % 4 == 0, F.col("label") + 1).otherwise(0).cast("bigint")
    return e.select(
        v.alias("faceId"), F.floor(v / 2).alias("photoId"), F.lit(0).alias("l"), F.lit(0).alias("t"), F.lit(100).alias("r"), F.lit(100).alias("b"),
        ((v * 37 % 100) / 100.0).cast("double").alias("quality"), "embedding", F.lit(1).alias("embVersion"), (F.col("label") % 5).cast("int").alias("clusterId"), person.alias("personId"), (v % 16 == 0).alias("pinned"),
    )


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return n.select((F.col("n_nationkey") + 1).cast("bigint").alias("personId"), F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.col("n_name")).alias("name"))
