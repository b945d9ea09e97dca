"""Operators 11 to 13 against plain restatements, held-out rows and exact round trips, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import fill_in_middle as M, language_id as L, phrases as P

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, id string, n bigint, form string, words int, f bigint"


def docs(spark, rows):
    """Rows with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, g, "x", 7, "psm", 1, 2) for i, t, g in rows], DOCS)


# --- operator 13


def _units(text, unit):
    if unit == "char":
        return list(text)
    if unit == "line":
        return re.findall(r"[^\n]*\n|[^\n]+$", text)
    found = re.findall(r"[ \t\n\x0b\x0c\r]*[^ \t\n\x0b\x0c\r]+[ \t\n\x0b\x0c\r]*", text)
    return found


def _plain_fim(doc_id, text, unit="char"):
    text = text or ""
    units = _units(text, unit)
    n = len(units)
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[k : k + 8], 16) for k in (0, 8, 16, 24))
    if text == "" or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not units:
        s = text
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def _odd_texts():
    rng = random.Random(3)
    made = ["".join(rng.choice("aé日😀 \n\t<>PSḾ") for _ in range(rng.choice((1, 2, 3, 7, 40, 300)))) for _ in range(150)]
    return [None, "", " ", "\n", "a", "é", "😀", "a<P>b", "<M>", "x<S>", "<P", "<P<S", "> <", "\n\n", "  lead", "trail \n", "one two\nthree ", *made, "日本 " * 60_000]


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_fill_in_middle_equals_a_plain_restatement(spark, unit):
    rows = [(k if k % 11 else None, t, "en") for k, t in enumerate(_odd_texts())]
    rows += rows[:5]
    frame = docs(spark, rows)
    got = M.fill_in_middle(frame, unit=unit).withColumn("back", M.restored(F.col("output"), F.col("form"))).collect()
    assert Counter((r.doc_id, r.n, r.form, r.prefix_units, r.middle_units, r.output) for r in got) == Counter((i, *_plain_fim(i, t, unit)) for i, t, _ in rows)
    assert Counter((r.doc_id, r.back) for r in got) == Counter((i, t or "") for i, t, _ in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert M.fill_in_middle(frame.limit(0), unit=unit).count() == 0


def test_fill_in_middle_takes_other_sentinels_and_rates(spark):
    rows = [(k, f"text <P> {k}", "en") for k in range(60)]
    marks = ("⟨p⟩", "⟨s⟩", "⟨m⟩")
    got = M.fill_in_middle(docs(spark, rows), rate=100, spm=100, sentinels=marks).withColumn("back", M.restored(F.col("output"), F.col("form"), marks)).collect()
    assert {r.form for r in got} == {"spm"} and sorted(r.back for r in got) == sorted(t for _, t, _ in rows)
    with pytest.raises(ValueError):
        M.fill_in_middle(docs(spark, rows), unit="page")


def test_ranked_bits_are_found_by_halving():
    rng = random.Random(4)
    for width in (1, 2, 3, 63, 64, 65, 1000):
        bits = rng.getrandbits(width) | 1
        at = [k for k, x in enumerate(f"{bits:0{width}b}") if x == "1"]
        assert [M.place(bits, width, k) for k in range(len(at) + 2)] == [*at, width, width]


# --- operator 12


def _plain_phrases(rows, max_n, least, absorb, top):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lower):
            w = re.findall(r"[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, max_n + 1):
                for i in range(len(w) - k + 1):
                    f[lang or "und", *w[i : i + k]] += 1
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = {}
    for (lang, *w), a in cand.items():
        score, k = min((2000000 * a // (f[lang, *w[:k]] + f[lang, *w[k:]]), k) for k in range(1, len(w)))
        inside = any(q[0] == lang and len(q) > len(w) + 1 and 100 * b >= absorb * a and any(list(q[i : i + len(w)]) == w for i in range(1, len(q))) for q, b in cand.items())
        if not inside:
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]]))
    return [(lang, k + 1, p.decode(), -a, x, y, n[lang], -s) for lang, ps in out.items() for k, (s, a, p, x, y) in enumerate(sorted(ps)[:top])]


@pytest.mark.parametrize("max_n, least, absorb, top, size", [(4, 3, 80, 2000, 1 << 21), (4, 2, 50, 5, 64), (5, 3, 100, 40, 7), (2, 1, 80, 10_000, 300)])
def test_phrases_equal_a_plain_restatement(spark, monkeypatch, max_n, least, absorb, top, size):
    monkeypatch.setattr(P, "SLICE", size)
    monkeypatch.setattr(P, "STRINGS", max(size, 50))
    rng = random.Random(5)
    words = ["the", "The", "New", "york", "é", "É", "日本", "x\xa0y", "don't", "A", "b", "-"]
    gaps = [" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", " ; ", "?!"]
    make = lambda n: "".join(rng.choice(words) + rng.choice(gaps) for _ in range(n))
    rows = [(k, make(rng.choice((1, 5, 60))), rng.choice(["en", "en", "de", None, "und"])) for k in range(120)]
    rows += [(None, None, "en"), (1, "", "fr"), (2, " \t", None), (3, "... ,, \n", "en"), (4, make(3000), "de"), (5, "new york city hall " * 40, "en"), (5, "new york city hall " * 40, "en"), (6, "long " * 500 + "word" * 200, "fr")]
    frame = docs(spark, rows)
    got = P.collocations(frame, max_n=max_n, least=least, absorb=absorb, top=top).collect()
    assert Counter(map(tuple, got)) == Counter(_plain_phrases(rows, max_n, least, absorb, top))
    assert P.collocations(frame.limit(0)).count() == 0


def test_a_full_bitmap_changes_no_result(spark, monkeypatch):
    monkeypatch.setattr(P, "FEWEST_BITS", 3)
    monkeypatch.setattr(P, "MOST_BITS", 3)
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice("abcdefg") for _ in range(50)), "en") for k in range(30)]
    assert Counter(map(tuple, P.collocations(docs(spark, rows), least=4).collect())) == Counter(_plain_phrases(rows, 4, 4, 80, 2000))


def test_scores_are_exact_beyond_64_bits(spark):
    big = 9 * 10**17
    counts = spark.createDataFrame([("en", 0, "", 3 * big), ("en", 1, "a", big + 7), ("en", 1, "b", 2 * big + 1), ("en", 2, "a b", big + 5)], "lang string, words int, phrase string, f bigint")
    row = P.scored(counts).first()
    assert (row.score, row.l, row.r) == (2000000 * (big + 5) // (3 * big + 8), big + 7, 2 * big + 1)
    near = spark.createDataFrame([("en", "a b", 2, 10 * big), ("en", "a b c", 3, 8 * big), ("en", "b c", 2, 10 * big + 1)], "lang string, phrase string, words int, a bigint")
    assert sorted(r.phrase for r in P.unabsorbed(near).collect()) == ["a b c", "b c"]


# --- operator 11


def test_languages_of_held_out_documents(spark):
    found = L.op11(spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(found) == len(lang) and {r.lang_pred for r in found} <= {"de", "en", "es", "fr", "und"}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in found)
    assert all((r.lang_pred == "und") == (not any(map(str.isalpha, lang[r.doc_id][1] or ""))) for r in found)
    held = [r for r in found if r.held_out]
    right = np.mean([r.lang_pred == lang[r.doc_id][0] for r in held])
    sure = [r.lang_pred == lang[r.doc_id][0] for r in held if r.accepted]
    assert right >= 0.98 and np.mean(sure) >= 0.99 and len(sure) >= 0.95 * len(held)


def test_labels_of_held_out_rows_and_other_columns_do_not_matter(spark):
    docs_ = spark.read.parquet(f"{SF}/documents.parquet")
    held = L.held_out(F.col("doc_id"))
    other = docs_.withColumn("lang", F.when(held, "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("en"))
    assert L.learn(docs_.where(~held)) == L.learn(other.where(~held))


def test_language_id_on_odd_rows(spark):
    rng = random.Random(7)
    alphabet = {"aa": "abcde", "bb": "vwxyz", "cc": "αβγδε"}
    vocabulary = {g: ["".join(rng.choice(c) for _ in range(rng.randint(2, 6))) for _ in range(40)] for g, c in alphabet.items()}
    text = lambda g, n: " ".join(rng.choice(vocabulary[g]) for _ in range(n))
    rows = [(k, text(g, 60), g) for k in range(90) for g in ("aa", "bb", "cc") if g != "cc" or k % 9 == 0]
    rows += [(500, None, "aa"), (501, "12 34 !!", "aa"), (None, text("bb", 50), "aa"), (502, text("aa", 30), None), (503, "", "dd"), (504, "7", "ee")]
    rows += [(600 + k, "the same text " * 5, "aa") for k in range(50)]  # copies count once
    frame = docs(spark, rows)
    model = L.learn(frame)
    assert model.names == ("aa", "bb", "cc") and all(0 < len(d) <= L.DICTIONARY for d in model.dictionaries)
    assert model.dictionaries[0].count(b"the same text") <= 30
    asked = [(1, text("aa", 8), None), (2, text("bb", 4000) + "\n" + text("aa", 100), "aa"), (3, text("cc", 5).upper(), None), (4, None, "aa"), (5, "", "aa"), (6, "1 2 3 -- !", "aa"), (None, text("bb", 9), "x"), (2, "", "y"), (7, text("aa", 30_000), None), (8, "日本", None)]
    got = {(r.doc_id, r.lang_pred) for r in L.identify(docs(spark, asked), model).collect()}
    assert got == {(1, "aa"), (2, "bb"), (3, "cc"), (4, "und"), (5, "und"), (6, "und"), (None, "bb"), (2, "und"), (7, "aa"), (8, "aa")}
    unsure = L.identify(docs(spark, asked[-1:]), model).first()
    assert not unsure.accepted and unsure.score < 0.9
    assert L.identify(frame.limit(0), model).count() == 0
    nothing = L.learn(frame.limit(0))
    assert nothing == L.Languages((), ()) and {(r.lang_pred, r.score, r.accepted) for r in L.identify(frame, nothing).collect()} == {("und", 0.0, False)}


def test_the_languages_with_the_most_rows_are_learned(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_LANGS", 2)
    rows = [(k, f"word{'abcdefghij'[k % 10]} some text", ("a", "b", "b", "c", "c", "c")[k % 6]) for k in range(60)]
    assert L.learn(docs(spark, rows)).names == ("c", "b")


def test_every_block_of_a_long_text_counts():
    rng = random.Random(8)
    a, b = (" ".join("".join(rng.choice(c) for _ in range(5)) for _ in range(3000)).encode() for c in ("abcd", "efgh"))
    model = L.Languages(("a", "b"), (a[:8000], b[:8000]))
    encoders = model.encoders()
    parts = [x[k : k + L.BLOCK] for x in (a,) for k in range(0, len(x), L.BLOCK)]
    assert L.encoded_sizes(a, encoders) == [sum(len(e.compress(p)) for p in parts) for e in encoders]
    assert model.judge(a[:2000] + b, encoders)[0] == "b"
