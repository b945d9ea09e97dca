"""Packing (operator 9): best-fit decreasing into windows of at most ``WINDOW`` tokens.

Documents are tokenised and closed by an end id; overlong ones are first cut into full windows. What remains is packed
in order of falling length: a segment tree over remaining capacity finds the open window that fits most tightly.
Each task packs what it reads, in bounded rounds, so no row is shuffled; a round leaves few windows unfilled. Windows
whose fill stays under a bound are cut at powers of two, where no padding is added.

Edge cases: a null or empty text is the end id alone; ids, null ids and repeated rows are carried as they are, each row
is a document of its own; an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

import array
import functools
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from millrace.llm.text import frugal

#: The window, the id that closes a document, the vocabulary file and its one special string.
WINDOW, END_ID, VOCABULARY, SPECIAL = 2048, 1, "byte_bpe_50k.json", "<|endoftext|>"
#: Token ids held at once by a task before they are packed; a window filled less than this is cut at powers of two.
ROUND_TOKENS, WELL_FILLED = 6_000_000, 0.97
#: Encoded words kept by a worker.
CACHE_WORDS = 300_000
#: Marks a piece without leading space among the keys of the cache; a private-use character.
BARE = "\ue000"

_UNSAFE = re.compile(r"\s | \s|^ | $")
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_PLAIN = re.compile("[\\s!-~¡-ɏ]*")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Words(dict):
    """Ids, as little-endian bytes, of a text piece between two single spaces, its leading space included.

    The vocabulary's word pattern always starts a new word at a single space between two other characters, so a text's
    ids are those of its pieces in turn. A piece of plain Latin text is encoded by the rank file of the same
    vocabulary, which is the faster library; any other piece by the vocabulary file itself. Tests hold both equal.
    """

    def __init__(self, path: str):
        super().__init__()
        self.path, self.fast = path, self._ranks(path)
        self.piece = getattr(getattr(self.fast, "_core_bpe", None), "encode_single_piece", None) or (lambda b: self.fast.encode_ordinary(b.decode()))

    @functools.cached_property
    def full(self):
        """The vocabulary file itself, read when the first text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @staticmethod
    def _ranks(path: str):
        ranks_path = path.removesuffix(".json") + ".tiktoken"
        try:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        except (ImportError, FileNotFoundError):
            return None  # the vocabulary file alone gives the same ids, more slowly

    def encode(self, text: str) -> bytes:
        if self.fast is not None and len(text) < 64 and text[1:].isalpha() and text[:1] == " " and _PLAIN.fullmatch(text):
            return array.array("I", self.piece(text.encode())).tobytes()
        if self.fast is not None and _PLAIN.fullmatch(text) and SPECIAL not in text:
            return array.array("I", self.fast.encode_ordinary(text)).tobytes()
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        """Falls back on a known stem where a word certainly ends: at a line feed between other characters, and at a
        lone full stop or comma after a letter or digit. A leading BARE stands for "no leading space"."""
        head, feed, tail = piece.partition("\n")
        if feed and head and tail and head != BARE and not head[-1].isspace() and not tail[0].isspace():
            return self[head] + self[BARE + "\n"] + self[BARE + tail]
        if piece[-1:] in (".", ",") and piece[-2:-1].isalnum():
            ids = self[piece[:-1]] + self[BARE + piece[-1]]
        elif piece[:1] == BARE:
            ids = self.encode(piece[1:])
        else:
            ids = self.encode(" " + piece)
        if len(piece) < 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[piece] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if SPECIAL in text or BARE in text:
            return self.encode(text)
        pieces = _LONE_SPACE.split(text) if _UNSAFE.search(text) else text.split(" ")
        pieces[0] = BARE + pieces[0]
        return b"".join(map(self.__getitem__, pieces))


@functools.lru_cache(maxsize=2)
def _words(path: str) -> _Words:
    return _Words(path)


class CapacityTree:
    """Segment tree over capacities 0..size: how many open windows have each; finds the least capacity >= need."""

    def __init__(self, size: int):
        self.base = 1 << size.bit_length()
        self.any = bytearray(2 * self.base)
        self.open: list[list[int]] = [[] for _ in range(self.base)]

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        k = self.base + capacity
        while k and not self.any[k]:
            self.any[k] = 1
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return the tightest open window as (capacity, window)."""
        k = self.base + need
        if not self.any[k]:
            while k > 1 and (k & 1 or not self.any[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.base:
                k = 2 * k if self.any[2 * k] else 2 * k + 1
        capacity = k - self.base
        window = self.open[capacity].pop()
        if not self.open[capacity]:
            self.any[k] = 0
            k >>= 1
            while k and not (self.any[2 * k] or self.any[2 * k + 1]):
                self.any[k] = 0
                k >>= 1
        return capacity, window


def best_fit_decreasing(lengths: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The window of each item, and the fill of each window. Ties keep the order of the items."""
    tree, fills, of = CapacityTree(size), [], np.empty(len(lengths), np.int64)
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        found = tree.take(need)
        if found is None:
            found = (size, len(fills))
            fills.append(0)
        left, window = found[0] - need, found[1]
        fills[window] += need
        of[k] = window
        if left:
            tree.add(left, window)
    return of, np.array(fills, np.int64)


def _power_cuts(fill: int) -> list[int]:
    return [1 << k for k in range(fill.bit_length() - 1, -1, -1) if fill >> k & 1]


_NAMES = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class _Round:
    """Documents of one round; ``place`` lays them out and returns columns."""

    def __init__(self, size: int):
        self.size, self.tokens = size, 0
        self.docs: list[tuple[object, bytes]] = []

    def add(self, doc_id: object, ids: bytes) -> None:
        self.docs.append((doc_id, ids))
        self.tokens += len(ids) // 4

    def place(self, first_sequence: int) -> tuple[list, dict[str, list[int]], int]:
        size, rest, rows = self.size, [], []  # rows: doc, start, length, sequence, offset
        sequence = first_sequence
        for d, (_, ids) in enumerate(self.docs):
            n = len(ids) // 4
            for start in range(0, n - n % size, size):
                rows.append((d, start, size, sequence, 0))
                sequence += 1
            if n % size:
                rest.append((d, n - n % size, n % size))
        of, fills = best_fit_decreasing(np.array([x[2] for x in rest], np.int64), size)
        members: list[list[tuple[int, int, int]]] = [[] for _ in fills]
        for x, window in zip(rest, of.tolist(), strict=True):
            members[window].append(x)
        for window, fill in zip(members, fills.tolist(), strict=True):
            cuts = [fill] if fill >= WELL_FILLED * size or fill & (fill - 1) == 0 else _power_cuts(fill)
            room, offset = cuts.pop(0), 0
            for d, start, length in window:
                while length:
                    if offset == room:
                        room, offset, sequence = cuts.pop(0), 0, sequence + 1
                    n = min(length, room - offset)
                    rows.append((d, start, n, sequence, offset))
                    start, length, offset = start + n, length - n, offset + n
            sequence += 1
        cols: dict[str, list[int]] = {k: [] for k in _NAMES}
        ids_col = []
        for d, start, length, seq, offset in rows:
            doc_id, ids = self.docs[d]
            ids_col.append(doc_id)
            for k, v in zip(_NAMES, (start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, seq, offset), strict=True):
                cols[k].append(v)
        return ids_col, cols, sequence


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: Callable[[], str] = vocabulary_path, size: int = WINDOW, end_id: int = END_ID, round_tokens: int = ROUND_TOKENS) -> DataFrame:
    """One row per piece: id, ``start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``sequence_id`` is the reading task's number, times 2**36, plus a running number, so tasks need not agree on one.
    """
    end = np.array([end_id], "<u4").tobytes()
    id_type = docs.schema[id_col].dataType
    schema = f"{id_col} {id_type.simpleString()}, " + ", ".join(f"{x} bigint" for x in _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sequence = _words(vocabulary()), TaskContext.get().partitionId() << 36
        now, arrow_id = _Round(size), None

        def placed() -> pa.RecordBatch:
            nonlocal now, sequence
            ids, cols, sequence = now.place(sequence)
            now = _Round(size)
            return pa.RecordBatch.from_arrays([pa.array(ids, arrow_id), *[pa.array(cols[k], pa.int64()) for k in _NAMES]], names=[id_col, *_NAMES])

        try:
            for batch in batches:
                arrow_id = batch.schema.field(0).type
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    now.add(doc_id, words.ids(text.as_py() or "") + end)
                    if now.tokens >= round_tokens:
                        yield placed()
            if now.docs:
                yield placed()
        finally:  # a reused worker would hold words and vocabulary during other stages
            _words.cache_clear()
            words = None

    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(frugal(run), schema)


def op9(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
