"""Suffix-array dedup by bucket-pointer refinement (operator 10), on a sparse set of suffixes.

The dealt method sorts all suffixes; here only suffixes that a content rule selects are bucketed, and a bucket's pointer is
named by its content (two 64-bit hashes) in place of its rank, so that tasks agree on it without a global sort. README
states why.

Every ``LENGTH``-byte string selects one position inside it, the least of its q-gram hashes, so equal strings select
alike and only about one position in 35 becomes a suffix of the index. The suffixes are put into buckets by their
q-gram. A bucket is refined first by the bucket pointer of its whole surroundings (all that the strings which selected
it can see): suffixes alike in it are copies throughout, the earliest stays and the others lend their coverage at once.
Buckets that still hold two kinds or more are refined by the pointers at each later offset, which are built
from the pointers of half the length again and again, until each string of ``LENGTH`` bytes has a bucket of its own.

Only refinements that a filter of fixed size asks for carry text, and their strings are compared byte by byte with the
earliest of their bucket. Buckets of very many kinds are dealt out string by string, under 128 bits of hash. Each task
first settles what it can on its own and carries kinds that it met twice over its rounds, so a hot bucket brings about
one row of each kind and task to the task that settles it.

Edge cases: a null text is empty; a text under ``LENGTH`` bytes loses nothing; a null id comes before all others; rows
with the same id and text are one document, rows with the same id and other text are ordered by start, then by a hash of
the text; texts over PIECE bytes are indexed in pieces that overlap by a string; an empty table gives an empty result;
only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.text import encoded, mix, slices
from millrace.storage import Workspace, scratch

#: Length of a repeated string, q-gram of the first buckets, bits of a filter, kinds from which a bucket is dealt out
#: by string, bytes of text that a task settles at once, bytes that are indexed at once, and of a piece of an overlong
#: text; repeated kinds that a task carries from round to round at most.
LENGTH, Q, FILTER_BITS, MANY, ROUND_BYTES, SLICE, PIECE, CARRIED = 100, 32, 1 << 26, 4096, 16 << 20, 1 << 20, 4 << 20, 50_000

_C = np.uint64(0x9E3779B97F4A7C15)
_INDEX = np.uint64((1 << 26) - 1)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
_BYTE2 = mix(np.arange(1001, 1257, dtype=np.uint64)) | np.uint64(1)
_NULL_ID = -(1 << 63)


def _doubled(h: np.ndarray, length: int) -> np.ndarray:
    """Pointers of ``length``-byte strings (a power of two) at every offset, from those of half the length."""
    step = 1
    while step < length:
        h = h[:-step] * _C + mix(h[step:]) if len(h) > step else h[:0]
        step *= 2
    return h


def string_pointers(data: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """Pointers of all LENGTH-byte strings: from the binary parts of LENGTH."""
    base, at, out = table[data], 0, None
    for k in range(LENGTH.bit_length() - 1, -1, -1):
        if LENGTH >> k & 1:
            part = _doubled(base, 1 << k)[at : at + max(0, len(data) - LENGTH + 1)]
            out = part if out is None else out * _C + mix(part)
            at += 1 << k
    return mix(out)


def _powers(n: int, which: int, cache: dict[tuple[str, int], np.ndarray] = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """Powers of the first or second odd number and of its inverse, modulo 2**64."""
    if len(cache.get(("up", which), ())) < n:
        c = (int(_C) * 2 + 1 + which * 0x632BE59BD9B4E018) % (1 << 64) | 1
        for name, x in (("up", c), ("down", pow(c, -1, 1 << 64))):
            cache[name, which] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 1 << 20), np.uint64(x))]))
    return cache["up", which], cache["down", which]


def suffixes(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """The suffixes that the strings of these texts select: text number, position, first and last selecting start (all
    within the whole array), q-gram pointer and pointer of the surroundings."""
    n, width = len(data) - LENGTH + 1, LENGTH - Q + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return {"text": none, "at": none, "lo": none, "hi": none, "gram": none.view(np.uint64), "kind": none.view(np.uint64), "kind2": none.view(np.uint64)}
    gram = mix(_doubled(_BYTE[data], Q))
    key = (gram & ~_INDEX) | np.arange(len(gram), dtype=np.uint64)
    folded = np.concatenate([key, np.full(-len(key) % width, ~np.uint64(0))]).reshape(-1, width)
    before = np.minimum.accumulate(folded, axis=1).ravel()[: len(key)]
    behind = np.minimum.accumulate(folded[:, ::-1], axis=1)[:, ::-1].ravel()[: len(key)]
    chosen = (np.minimum(behind[:n], before[width - 1 : width - 1 + n]) & _INDEX).astype(np.int64)
    start = np.arange(n)
    text = np.searchsorted(bounds, start, side="right") - 1
    inside = np.flatnonzero(start + LENGTH <= bounds[text + 1])
    chosen, text = chosen[inside], text[inside]
    if not len(inside):
        return suffixes(data[:0], bounds)
    new = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(inside)) - 1
    lo, hi, at = inside[first], inside[last], chosen[first]
    place = mix((at - lo).astype(np.uint64) * np.uint64(1 << 20) + (hi - lo).astype(np.uint64))
    kinds = []
    for which, table in enumerate((_BYTE, _BYTE2)):
        up, down = _powers(len(data) + 1, which)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(table[data] * up[: len(data)])])
        kinds.append(mix((sums[hi + LENGTH] - sums[lo]) * down[lo] + place))
    return {"text": text[first], "at": at, "lo": lo, "hi": hi, "gram": gram[at], "kind": kinds[0], "kind2": kinds[1]}


def _pieces(doc: np.ndarray, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, bounds, id, text hash, offset of the piece in its text); overlong texts come in overlapping pieces."""
    marks = np.array([int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little", signed=True) for t in texts], np.int64)
    whole = [k for k, t in enumerate(texts) if len(t) <= PIECE]
    for rows, parts, offsets in [(whole, [texts[k] for k in whole], [0] * len(whole))] + [([k], [t[s : s + PIECE + LENGTH - 1]], [s]) for k, t in enumerate(texts) if len(t) > PIECE for s in range(0, len(t), PIECE)]:
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(np.int64)
        yield np.frombuffer(b"".join(parts), np.uint8), bounds, doc[rows], marks[rows], np.array(offsets, np.int64)


def _ids(column: pa.Array) -> np.ndarray:
    return np.asarray(column.fill_null(_NULL_ID))


_COLUMNS = ["doc", "mark", "at", "lo", "hi", "gram", "kind", "kind2"]


def _found(batch: pa.RecordBatch, keep=None) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Suffixes with positions relative to their text, and the bytes they were found in (with absolute lo in "raw")."""
    for part in slices(batch, limit=SLICE):
        for data, bounds, doc, marks, offset in _pieces(_ids(part.column(0)), encoded(part.column(1))):
            s = suffixes(data, bounds)
            if keep is not None:
                pick = np.flatnonzero(keep(s["gram"]))
                s = {k: v[pick] for k, v in s.items()}
            shift = offset[s["text"]] - bounds[s["text"]] if len(s["text"]) else s["text"]
            yield {"doc": doc[s["text"]], "mark": marks[s["text"]], "at": s["at"] + shift, "lo": s["lo"] + shift, "hi": s["hi"] + shift, "gram": s["gram"].view(np.int64), "kind": s["kind"].view(np.int64), "kind2": s["kind2"].view(np.int64), "raw": s["lo"]}, data


def _first_of_each(s: dict[str, np.ndarray], *keys: str) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys, then by document and position; and which rows (in that order) are the first of their keys."""
    order = np.lexsort((s["mark"], s["at"], s["doc"], *[s[k] for k in reversed(keys)]))
    first = np.ones(len(order), bool)
    if len(order) > 1:
        same = np.ones(len(order) - 1, bool)
        for k in keys:
            v = s[k][order]
            same &= v[1:] == v[:-1]
        first[1:] = ~same
    # a repeated row is the same document, not a later one
    return order, first


def _settled(s: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Split into the earliest suffix of each kind and the others; rows equal to the earliest in id, text and
    position are dropped."""
    order, first = _first_of_each(s, "gram", "kind", "kind2")
    leader = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))] if len(order) else order
    twin = ~first & (s["doc"][order] == s["doc"][leader]) & (s["at"][order] == s["at"][leader]) & (s["mark"][order] == s["mark"][leader])
    pick = lambda rows: {k: v[rows] for k, v in s.items()}
    return pick(order[first]), pick(order[~first & ~twin])


def merged(doc: np.ndarray, mark: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Unite overlapping and touching spans of a document."""
    order = np.lexsort((end, start, mark, doc))
    doc, mark, start, end = doc[order], mark[order], start[order], end[order]
    if not len(doc):
        return doc, mark, start, end
    owner = np.concatenate([[True], (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])])
    base = np.cumsum(owner) * (int(end.max()) + 1)  # later owners lie further on, so a running maximum stays within one
    reach = np.maximum.accumulate(end + base)
    new = owner.copy()
    new[1:] |= (start[1:] + base[1:]) > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], mark[first], start[first], reach[last] - base[last]


_ROW = "key bigint, kind bigint, kind2 bigint, doc bigint, mark bigint, at bigint, lo bigint, hi bigint, data binary"


def _rows(key, kind, kind2, doc, mark, at, lo, hi, data=None) -> pa.RecordBatch:
    n = len(key)
    cols = [pa.array(np.asarray(x, np.int64)) for x in (key, kind, kind2, doc, mark, at, lo, hi)]
    return pa.RecordBatch.from_arrays([*cols, pa.nulls(n, pa.binary()) if data is None else pa.array(data, pa.binary())], names=["key", "kind", "kind2", "doc", "mark", "at", "lo", "hi", "data"])


def _span_rows(doc, mark, start, end) -> pa.RecordBatch:
    """Spans travel with at = -1 and a key of their own document."""
    doc, mark, start, end = merged(doc, mark, start, end)
    zero = np.zeros(len(doc), np.int64)
    return _rows(mix(doc.view(np.uint64) + mark.view(np.uint64)).view(np.int64), zero, zero, doc, mark, np.full(len(doc), -1), start, end)


def _index(docs: DataFrame) -> DataFrame:
    """First buckets: each task keeps the earliest suffix of each kind and turns the others into spans. The kinds that a
    round met most often, CARRIED at most, are carried to the next one and sent at the end."""

    def settle(held: list[dict[str, np.ndarray]]) -> tuple[dict[str, np.ndarray], np.ndarray, pa.RecordBatch]:
        """What is kept, how often each of its kinds came again, and the spans of the others."""
        s = {k: np.concatenate([h[k] for h in held]) for k in _COLUMNS}
        kept, others = _settled(s)
        kinds, times = np.unique(others["kind"], return_counts=True)
        again = np.zeros(len(kept["kind"]), np.int64)
        if len(kinds):
            at = np.minimum(np.searchsorted(kinds, kept["kind"]), len(kinds) - 1)
            again = np.where(kinds[at] == kept["kind"], times[at], 0)
        return kept, again, _span_rows(others["doc"], others["mark"], others["lo"], others["hi"] + LENGTH)

    def sent(s: dict[str, np.ndarray]) -> pa.RecordBatch:
        return _rows(s["gram"], s["kind"], s["kind2"], s["doc"], s["mark"], s["at"], s["lo"], s["hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, carried = [], 0, None
        for batch in batches:
            for s, data in _found(batch):
                held.append({k: s[k] for k in _COLUMNS})
                size += len(data)
                if size >= ROUND_BYTES:
                    kept, again, spans = settle([*held, *([carried] if carried else [])])
                    stays = again > 0
                    if stays.sum() > CARRIED:
                        stays &= again > np.partition(again, -CARRIED)[-CARRIED]
                    carried = {k: v[stays] for k, v in kept.items()}
                    yield sent({k: v[~stays] for k, v in kept.items()})
                    yield spans
                    held, size = [], 0
        if held or carried:
            kept, _, spans = settle([*held, *([carried] if carried else [])])
            yield sent(kept)
            yield spans

    return docs.mapInArrow(run, _ROW)


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Regroup sorted batches so that each one holds all rows of its keys."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.asarray(batch.column(0))
        cut = int(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))[-1])
        if cut:
            yield pa.Table.from_batches([*rest, batch.slice(0, cut)])
            rest = []
        elif rest and rest[-1].column(0)[0].as_py() != key[0]:
            yield pa.Table.from_batches(rest)
            rest = []
        rest.append(batch.slice(cut))
    if rest:
        yield pa.Table.from_batches(rest)


_OUT = "doc bigint, mark bigint, start bigint, stop bigint, gram bigint, kinds bigint"


def _out(doc, mark, start, stop, gram=(), kinds=()) -> pa.RecordBatch:
    n, g = len(doc), len(gram)
    cols = [pa.concat_arrays([pa.array(np.asarray(x, np.int64)), pa.nulls(g, pa.int64())]) for x in (doc, mark, start, stop)]
    cols += [pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(np.asarray(x, np.int64))]) for x in (gram, kinds)]
    return pa.RecordBatch.from_arrays(cols, names=["doc", "mark", "start", "stop", "gram", "kinds"])


def _refine_by_kind(indexed: DataFrame) -> DataFrame:
    """Spans of all but the earliest suffix of each kind; and the buckets that hold two kinds or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_keys(batches):
            c = {k: np.asarray(table[k]) for k in ("key", "kind", "kind2", "doc", "mark", "at", "lo", "hi")}
            span = c["at"] < 0
            s = {k: v[~span] for k, v in c.items()}
            s["gram"] = s.pop("key")
            kept, others = _settled(s)
            gram, kinds = np.unique(kept["gram"], return_counts=True)
            doc, mark, start, stop = (np.concatenate([c[a][span], others[b] + extra]) for a, b, extra in (("doc", "doc", 0), ("mark", "mark", 0), ("lo", "lo", 0), ("hi", "hi", LENGTH)))
            yield _out(*merged(doc, mark, start, stop), gram[kinds > 1], kinds[kinds > 1])

    return indexed.repartition("key").sortWithinPartitions("key").mapInArrow(run, _OUT)


def _filter(grams: DataFrame) -> bytes:
    """A bitmap of fixed size that holds every gram."""
    bit = F.pmod("gram", F.lit(FILTER_BITS)) + 1  # the bitmap functions count from 1
    out = bytearray(FILTER_BITS // 8 + 8192)
    for k, bits in grams.groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect():
        out[(k - 1) * 4096 : (k - 1) * 4096 + len(bits)] = bits
    return bytes(out)


def _holds(bits: bytes):
    table = np.frombuffer(bits, np.uint8)

    def test(gram: np.ndarray) -> np.ndarray:
        at = (gram.view(np.int64) % FILTER_BITS).astype(np.int64)
        return table[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0

    return test


def _surroundings(docs: DataFrame, mixed, many) -> DataFrame:
    """The wanted suffixes, the earliest of each kind in this task, with their surroundings; those of buckets with
    very many kinds as single strings, again the earliest of each."""

    def settle(held: list[tuple[dict[str, np.ndarray], np.ndarray]], heavy) -> Iterator[pa.RecordBatch]:
        names = [*_COLUMNS, "raw"]
        s = {k: np.concatenate([h[k] for h, _ in held]) for k in names}
        s["from"] = np.repeat(np.arange(len(held)), [len(h["doc"]) for h, _ in held])
        kept, _ = _settled(s)
        cut = lambda rows: [held[f][1][a : a + n + LENGTH].tobytes() for f, a, n in zip(kept["from"][rows].tolist(), kept["raw"][rows].tolist(), (kept["hi"] - kept["lo"])[rows].tolist(), strict=True)]
        is_many = heavy(kept["gram"])
        few, lots = np.flatnonzero(~is_many), np.flatnonzero(is_many)
        yield _rows(*[kept[k][few] for k in ("gram", "kind", "kind2", "doc", "mark", "at", "lo", "hi")], cut(few))
        if len(lots):
            w = _strings(cut(lots), {k: v[lots] for k, v in kept.items()}, True)
            order, first = _first_of_each(w, "pointer", "pointer2")
            one, rest = order[first], order[~first]
            yield _rows(w["pointer"][one], w["pointer2"][one], np.zeros(len(one)), *[w[k][one] for k in ("doc", "mark", "at", "at", "at")])
            yield _span_rows(*[w[k][rest] for k in ("doc", "mark", "at")], w["at"][rest] + LENGTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, heavy, held, size = _holds(mixed.value), _holds(many.value), [], 0
        for batch in batches:
            for s, data in _found(batch, wanted):
                if len(s["doc"]):
                    held.append((s, data))
                    size += len(data)
                if size >= ROUND_BYTES // 2:
                    yield from settle(held, heavy)
                    held, size = [], 0
        if held:
            yield from settle(held, heavy)

    return docs.mapInArrow(run, _ROW)


def _strings(surroundings: list[bytes], s: dict[str, np.ndarray], twice: bool = False) -> dict[str, np.ndarray]:
    """Every LENGTH-byte string of every surroundings: its pointer, document and start, and where it stands in the joined
    surroundings (``byte``); with ``twice`` a second pointer."""
    sizes = np.array([len(x) - LENGTH + 1 for x in surroundings], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes + LENGTH - 1)])[:-1]
    data = np.frombuffer(b"".join(surroundings), np.uint8)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    byte = bounds[owner] + step
    second = string_pointers(data, _BYTE2)[byte].view(np.int64) if twice else np.zeros(len(byte), np.int64)
    return {"pointer": string_pointers(data)[byte].view(np.int64), "pointer2": second, "doc": s["doc"][owner], "mark": s["mark"][owner], "at": s["lo"][owner] + step, "byte": byte}


def _told_apart(w: dict[str, np.ndarray], order: np.ndarray, first: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same order and firsts, after each string that shares the pointer of an earlier one was compared with it byte by
    byte: a string that differs gets a ``pointer2`` of its own bytes, and the order is made again."""
    if not len(data):
        return order, first
    view = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    leader = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    differ = []
    for at in range(0, len(order), 1 << 16):  # some megabytes of strings at a time
        mine, its = order[at : at + (1 << 16)], leader[at : at + (1 << 16)]
        rest = np.flatnonzero((mine != its) & (w["byte"][mine] >= 0) & (w["byte"][its] >= 0))
        differ.append(mine[rest[(view[w["byte"][mine[rest]]] != view[w["byte"][its[rest]]]).any(1)]])
    differ = np.concatenate(differ)
    if not len(differ):
        return order, first
    for k in np.flatnonzero(np.isin(w["pointer"], w["pointer"][differ]) & (w["byte"] >= 0)).tolist():
        w["pointer2"][k] = int.from_bytes(hashlib.blake2b(view[w["byte"][k]].tobytes(), digest_size=8).digest(), "little", signed=True)
    return _first_of_each(w, "pointer", "pointer2")


def _refine_by_string(found: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_keys(batches):
            c = {k: np.asarray(table[k]) for k in ("key", "kind", "doc", "mark", "at", "lo", "hi")}
            data = table["data"].to_pylist()
            text = np.array([x is not None for x in data], bool)
            span, single = c["at"] < 0, (c["at"] >= 0) & ~text
            nowhere = np.full(int(single.sum()), -1, np.int64)
            parts = [{"pointer": c["key"][single], "pointer2": c["kind"][single], "doc": c["doc"][single], "mark": c["mark"][single], "at": c["at"][single], "byte": nowhere}]
            whole = [x for x in data if x is not None]
            if whole:
                parts.append(_strings(whole, {k: v[text] for k, v in c.items()}))
            w = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
            order, first = _first_of_each(w, "pointer", "pointer2")
            order, first = _told_apart(w, order, first, np.frombuffer(b"".join(whole), np.uint8))
            leader = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))] if len(order) else order
            twin = (w["doc"][order] == w["doc"][leader]) & (w["mark"][order] == w["mark"][leader]) & (w["at"][order] == w["at"][leader])
            later = order[~first & ~twin]
            doc, mark, start, stop = (np.concatenate(x) for x in ((c["doc"][span], w["doc"][later]), (c["mark"][span], w["mark"][later]), (c["lo"][span], w["at"][later]), (c["hi"][span], w["at"][later] + LENGTH)))
            yield _out(*merged(doc, mark, start, stop))

    return found.repartition("key").sortWithinPartitions("key").mapInArrow(run, _OUT)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", workspace: Workspace | None = None) -> DataFrame:
    """``doc, mark, spans`` of documents that hold bytes of an earlier string; ``mark`` is the text's hash."""
    spark = docs.sparkSession
    ws = scratch(spark, "substrings", workspace)
    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    first = ws.save(_refine_by_kind(_index(chosen)), "kinds")
    mixed = first.where("gram is not null")
    sc = spark.sparkContext
    wanted = _surroundings(chosen, sc.broadcast(_filter(mixed)), sc.broadcast(_filter(mixed.where(F.col("kinds") >= MANY))))
    second = ws.save(_refine_by_string(wanted), "strings")
    ws.keep(first, second)
    spans = first.where("doc is not null").unionByName(second.where("doc is not null"))
    return spans.groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", workspace: Workspace | None = None) -> DataFrame:
    """Per document: id, ``n_bytes, n_removed, n_spans, kept_sha256`` and the remaining bytes ``kept``."""
    spans = repeated_spans(docs, id_col, text_col, workspace)
    kind = docs.schema[id_col].dataType.simpleString()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            texts = encoded(batch.column(1))
            marks = [int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little", signed=True) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()), pa.array(_ids(batch.column(0).cast(pa.int64()))), pa.array(marks, pa.int64())], names=["id", "text", "of", "its"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            cols = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            for t, its in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                kept, at, n = [], 0, 0
                if its:
                    start, stop = np.array([(x["start"], x["stop"]) for x in its], np.int64).T
                    zero = np.zeros(len(start), np.int64)
                    for a, b in zip(*[x.tolist() for x in merged(zero, zero, start, stop)[2:]], strict=True):
                        kept.append(t[at:a])
                        at, n = b, n + 1
                kept = b"".join([*kept, t[at:]])
                for k, v in zip(cols, (len(t), len(t) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    cols[k].append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, pa.string() if k == "kept_sha256" else pa.binary() if k == "kept" else pa.int64()) for k, v in cols.items()]], names=[id_col, *cols])

    marked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(mark, f"id {kind}, text binary, of bigint, its bigint")
    joined = marked.join(spans, (F.col("of") == F.col("doc")) & (F.col("its") == F.col("mark")), "left").select("id", "text", "spans")
    return joined.mapInArrow(cut, f"{id_col} {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def op10(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
