"""Signatures of texts: plainly restated, and without the words of a whole batch in memory."""

import hashlib
import random
import re
import tracemalloc

import pyarrow as pa

from millrace.sources import surrogates as R


def plain(words):
    def simhash(tokens):
        bits = [int.from_bytes(hashlib.md5(t.encode()).digest()[:8], "big") for t in tokens]
        value = sum(1 << k for k in range(64) if 2 * sum(b >> k & 1 for b in bits) > len(bits))
        return value - (1 << 64) if value >> 63 else value

    cells = [int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big") % 48 for w in words]
    return simhash(words), simhash([" ".join(p) for p in zip(words, words[1:], strict=False)]), [min(255, 255 * cells.count(k) // max(1, len(words))) for k in range(48)]


def test_signatures_equal_their_plain_form():
    rng = random.Random(4)
    for n in (0, 1, 2, 3, 254, 255, 256, 257, 700):
        words = [rng.choice(["a", "été", "longer", str(rng.randrange(90))]) for _ in range(n)]
        assert R.text_signature(words) == plain(words)
    assert R.text_signature(["same"] * 600) == plain(["same"] * 600)


def test_a_batch_takes_little_more_than_a_text():
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(2000)) for _ in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(62)), pa.array([*texts, "", None])], names=["_id", "text"])
    tracemalloc.start()
    (out,) = R.signatures(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.column(1).to_pylist() == [plain(t.split(" "))[0] for t in texts[:1]] + out.column(1).to_pylist()[1:] and out.column(1)[61].as_py() == 0
    assert peak < 6 << 20  # the words of all texts alone take 7 MB


def test_words_are_split_as_the_sql_splits_them():
    """At blanks, tabs and line ends alone: other spaces are part of words."""
    texts = ["", "a", "a \t\r\nb", "a\u00a0b c\x0bd\x1ce \u2003 f", "été\tété"]
    assert [[w.decode() for w in R.split(t.encode())] for t in texts] == [re.split("[ \t\n\r]+", t) for t in texts]
