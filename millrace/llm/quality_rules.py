"""Quality rules with distribution divergence (operator 7).

Each document's character-class and common-word histograms are compared with its language's reference by the
Jensen-Shannon distance (base 2, 0 to 1). References are the mean shares over all documents of the language that pass the
base rules. Texts below the minimum lengths are not judged by divergence.

Most words are in no list, so a text without any common word lies within 0.36 of its reference, and short texts lie
farther off than long ones. A language's word limit is therefore taken from the distances of all its judged documents
that pass the base rules, by length (the median and the spread of the lower half, which junk does not reach), and a text
must lie nearer to the reference than one without common words does. The fixed limit bounds both.

The references describe the corpus at hand: a language whose base-passing documents are mostly junk has a junk reference.

Edge cases: a null text is empty and fails the base rules; a language without a reference (null, not among the lists, or
none of its documents pass the base rules) is judged by the base rules alone and has null distances; lengths with few
documents take the limit of the next shorter length, which is wider; repeated rows are judged one by one; an empty table
gives an empty result; only id, text and language are read, whatever other columns there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.text import IS_SPACE, encoded, flat, mix, per_text, slices
from millrace.storage import Workspace, scratch

#: The symbols that are counted, the window of repeated words, the base limits.
SYMBOLS, WINDOW, MIN_WORDS, MAX_REPEATED = b"#*$%&|<>", 8, 20, 30
#: Common words of each language's reference.
COMMON = {
    "en": "the of and to in that is was for it with as his on be at by had not are but from or have an they which one you were".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son aux été".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si".split(),
}
WORDS = sorted({w for words in COMMON.values() for w in words})
LANGS = sorted(COMMON)
#: Divergence is judged from so many words and code points on, and rejects beyond these distances.
JUDGE_WORDS, JUDGE_CHARS, MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 40, 200, 0.30, 0.50
#: Derived word limits: bins of a distance, spreads above the median, least spread (a share of the median), documents that
#: a length needs, share of common words from which a reference tells texts without any.
BINS, SPREADS, LEAST_SPREAD, LEAST_DOCS, LEAST_COMMON = 1000, 6, 0.05, 20, 0.05
#: Lengths by half powers of two words; what the shares of one document add up to.
N_LENGTH, UNIT = 128, 1 << 24

_CLASS = np.full(256, 5, np.uint8)
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A] = 0, 1, 2
_CLASS[IS_SPACE] = 3
_CLASS[np.frombuffer(b".,;:!?'\"()-", np.uint8)] = 4
_CLASS[0xC0:0xE0], _CLASS[0xE0:] = 6, 7
_CLASS[0x80:0xC0] = 8  # continuation bytes, not counted
N_CLASS, N_WORD = 8, len(WORDS) + 1
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(SYMBOLS, np.uint8)] = True
_START = np.ones(256, bool)
_START[0x80:0xC0] = False


def _common_index(words: list[bytes]) -> np.ndarray:
    at = {w.encode(): k for k, w in enumerate(WORDS)}
    return np.fromiter((at.get(w.lower(), N_WORD - 1) for w in words), np.int64, len(words))


def repeated_words(ids: np.ndarray, of: np.ndarray, n: int, window: int = WINDOW) -> np.ndarray:
    """Per document, the words inside windows of ``window`` words (a power of two) that occur twice or more in it."""
    if len(ids) < window + 1:
        return np.zeros(n, np.int64)
    h, step = mix(ids.astype(np.uint64) + np.uint64(1)), 1
    while step < window:
        h = mix(h[:-step] * np.uint64(0x9E3779B97F4A7C15) + h[step:])
        step *= 2
    inside = np.flatnonzero(of[: len(h)] == of[window - 1 :])
    key = mix(h[inside] ^ mix(of[inside].astype(np.uint64) + np.uint64(7)))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    starts, edge = inside[twice], np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.bincount(of, weights=np.cumsum(edge[:-1]) > 0, minlength=n).astype(np.int64)


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The counts and both histograms of each text."""
    n = len(texts)
    data, bounds = flat(texts)
    of_byte = np.repeat(np.arange(n), np.diff(bounds))
    classes = np.bincount(of_byte * 9 + _CLASS[data], minlength=n * 9).reshape(n, 9)[:, :N_CLASS]
    known: dict[bytes, int] = {}
    split = [t.split() for t in texts]
    n_words = np.fromiter(map(len, split), np.int64, n)
    ids = np.fromiter((known.setdefault(w, len(known)) for words in split for w in words), np.int64, int(n_words.sum()))
    of = np.repeat(np.arange(n), n_words)
    common = _common_index(list(known)) if known else np.zeros(0, np.int64)
    words = np.bincount(of * N_WORD + common[ids], minlength=n * N_WORD).reshape(n, N_WORD)
    repeats = np.zeros(n, np.int64)
    for k, t in enumerate(texts):
        lines = [x for x in t.split(b"\n") if x and not x.isspace()]
        repeats[k] = len(lines) - len(set(lines))
    chars = per_text(_START[data], bounds)
    return {
        "n_words": n_words, "word_chars": chars - classes[:, 3], "n_symbols": per_text(_SYMBOL[data], bounds), "n_dup_lines": repeats,
        "n_repeat_words": repeated_words(ids, of, n), "n_chars": chars, "classes": classes, "words": words,
    }


def base_failed(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEATED * m["n_words"])


def js_distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts to a reference histogram; 0 for a row without counts."""
    total = counts.sum(1, keepdims=True)
    p, q = counts / np.maximum(total, 1), reference / max(reference.sum(), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.where(total[:, 0] > 0, np.sqrt(np.clip((left + right) / 2, 0, 1)), 0)


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_HISTOGRAM = N_CLASS + N_WORD


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id``, the counts, ``base_failed``, ``judged`` (long enough), ``own`` (number of the language, -1 where it has no
    word list) and both histograms as bytes of 32-bit counts."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                m = measure(encoded(part.column(1)))
                own = [LANGS.index(x) if x in COMMON else -1 for x in part.column(2).to_pylist()]
                judged = (m["n_words"] >= JUDGE_WORDS) & (m["n_chars"] >= JUDGE_CHARS)
                both = np.hstack([m["classes"], m["words"]]).astype("<u4")
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(m[x]) for x in _COUNTS], pa.array(base_failed(m)), pa.array(judged), pa.array(own, pa.int32()), pa.array([r.tobytes() for r in both], pa.binary())], names=["id", *_COUNTS, "base_failed", "judged", "own", "histogram"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return chosen.mapInArrow(run, f"id {kind}, {', '.join(f'{x} bigint' for x in _COUNTS)}, base_failed boolean, judged boolean, own int, histogram binary")


def _histograms(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, _HISTOGRAM).astype(np.int64)


def shares(both: np.ndarray) -> np.ndarray:
    """Each row's two histograms as shares of UNIT: whole numbers, so that sums don't depend on the order of the rows."""
    parts = (both[:, :N_CLASS], both[:, N_CLASS:])
    return np.hstack([np.rint(p * (UNIT / np.maximum(p.sum(1, keepdims=True), 1))).astype(np.int64) for p in parts])


def references(rows: DataFrame) -> dict[str, np.ndarray]:
    """Summed shares by language, over all base-passing documents, each of the same weight so that no long one decides
    alone; one vector at most for each of the languages."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(LANGS), _HISTOGRAM), np.int64)
        for batch in batches:
            own, both = np.asarray(batch.column(0)), shares(_histograms(batch.column(1)))
            for k in np.unique(own):
                sums[k] += both[own == k].sum(0)
        k, j = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(sums[k, j])], names=["k", "j", "n"])

    out = {x: np.zeros(_HISTOGRAM) for x in LANGS}
    passing = rows.where("own >= 0 and not base_failed").select("own", "histogram")
    for k, j, total in passing.mapInArrow(partial, "k int, j int, n bigint").groupBy("k", "j").agg(F.sum("n")).collect():
        out[LANGS[k]][j] = total
    return {x: v for x, v in out.items() if v.sum()}


def distances(rows: DataFrame, refs: dict[str, np.ndarray]) -> DataFrame:
    """``rows`` with ``char_distance`` and ``word_distance`` (null without a reference) in place of the histograms."""
    columns = [c for c in rows.columns if c != "histogram"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, both = np.asarray(batch.column("own")), _histograms(batch.column("histogram"))
            far = np.full((2, len(own)), np.nan)
            for lang, ref in refs.items():
                mine = own == LANGS.index(lang)
                far[0, mine] = js_distance(both[mine, :N_CLASS], ref[:N_CLASS])
                far[1, mine] = js_distance(both[mine, N_CLASS:], ref[N_CLASS:])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *[pa.array(x, from_pandas=True) for x in far]], names=[*columns, "char_distance", "word_distance"])

    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c != "histogram")
    return rows.mapInArrow(run, f"{kinds}, char_distance double, word_distance double")


def word_limits(counts: list[tuple[int, int, int, int]], refs: dict[str, np.ndarray]) -> np.ndarray:
    """Word limit by language and length class, from (language, class, bin, documents)."""
    seen = np.zeros((len(LANGS), N_LENGTH, BINS + 1), np.int64)
    for k, length, at, n in counts:
        seen[k, length, at] = n
    limits = np.full((len(LANGS), N_LENGTH), MAX_WORD_DISTANCE)
    for k, lang in enumerate(LANGS):
        if lang not in refs:
            continue
        ref, last = refs[lang][N_CLASS:], MAX_WORD_DISTANCE
        if ref[:-1].sum() >= LEAST_COMMON * ref.sum():
            last = min(last, js_distance(np.eye(1, N_WORD, N_WORD - 1), ref)[0] - 1e-9)
        bound = last
        for length in range(N_LENGTH):
            total = np.cumsum(seen[k, length])
            if total[-1] >= LEAST_DOCS:
                quarter, half = ((np.searchsorted(total, share * total[-1]) + 0.5) / BINS for share in (0.25, 0.5))
                last = min(bound, half + SPREADS * max(half - quarter, LEAST_SPREAD * half))
            limits[k, length] = last
    return limits


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", workspace: Workspace | None = None) -> DataFrame:
    """One row per document: the base counts, both distances, ``base_failed`` and ``kept``. Texts are measured once; the
    references and then the limits come from the saved histograms and distances."""
    ws = scratch(docs.sparkSession, "quality", workspace)
    rows = ws.save(measured(docs, id_col, text_col, lang_col), "measured")
    refs = references(rows)
    length = F.least(F.floor(2 * F.log2(F.greatest("n_words", F.lit(1)))), F.lit(N_LENGTH - 1)).cast("int")
    far = ws.save(distances(rows, refs).withColumn("length", length), "distances")
    ws.keep(far)
    counted = far.where("judged and not base_failed and word_distance is not null").groupBy("own", "length", F.floor(F.col("word_distance") * BINS).cast("int").alias("bin")).count()
    limits = word_limits([tuple(r) for r in counted.collect()], refs)  # at most one number for each language, length and bin
    limit = F.get(F.array(*[F.lit(float(x)) for x in limits.ravel()]), F.greatest("own", F.lit(0)) * N_LENGTH + F.col("length"))
    unlike = (F.col("char_distance") > MAX_CHAR_DISTANCE) | (F.col("word_distance") > limit)
    kept = ~F.col("base_failed") & ~(F.col("judged") & F.coalesce(unlike, F.lit(False)))
    return far.select(F.col("id").alias(id_col), *_COUNTS, "char_distance", "word_distance", "base_failed", kept.alias("kept"))


def op7(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
