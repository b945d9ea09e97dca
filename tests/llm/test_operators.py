"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, extra columns, no rows."""

import hashlib
import random
import re

import numpy as np
import pytest

from millrace.llm import embedding_join, jaccard_join, mixing, packing, pii, quality_classifier, quality_rules, quote_links, substring_dedup, url_filter

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, node bigint, spans string"


def docs(spark, texts):
    """Rows with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en" if k % 2 else None, None if k % 3 == 0 else f"s{k % 3}", 0, 9, 9, "x") for k, (i, t) in enumerate(texts)], DOCS)


def corpus(seed=5):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = make(120)
    out = [(1, base), (2, base), (3, base + " tail"), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "ONE  two"), (9, make(2000)), (10, base.replace(" ", "  ", 3))]
    out += [(20 + k, " ".join(w if rng.random() > 0.02 else "zz" for w in base.split())) for k in range(12)]
    out += [(40 + k, make(60) + " " + base[:250] + " " + make(20)) for k in range(4)]
    return [*out, (3, base + " tail"), (60, "é" * 300), (61, "é" * 300 + "x")]


def test_jaccard_join(spark):
    texts = corpus()
    got = jaccard_join.jaccard_components(docs(spark, texts)).collect()
    assert len(got) == len(texts)
    sets = []
    for _, t in texts:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w)} if 0 < len(w) < 4 else {b" ".join(w[k : k + 4]) for k in range(len(w) - 3)})
    comp = {i: i for i, _ in texts}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(texts[a][0]), root(texts[b][0])))
                comp[y] = x
    assert {(r.doc_id, r.component_id) for r in got} == {(i, root(i)) for i, _ in texts}
    sizes = {i: len(s) for (i, _), s in zip(texts, sets, strict=True)}
    assert all(r.n_shingles == sizes[r.doc_id] for r in got)
    assert jaccard_join.jaccard_components(docs(spark, texts).limit(0)).count() == 0


def test_overlaps_are_derived_exactly():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 200)).astype(np.uint64)) for _ in range(40)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets[:25]]
    assert (jaccard_join.overlaps(sets[:25], sets) == np.array(want)).all()


def test_pairs_near_the_limit_are_decided_on_all_bits():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 100).astype(np.uint64)
    sets = []
    for k in range(60):  # each differs from the base in some shingles, and in some of these only below the upper 40 bits
        s = base.copy()
        s[rng.permutation(100)[: rng.integers(0, 9)]] = rng.integers(0, 1 << 63, 1).astype(np.uint64)
        s[k] ^= np.uint64(1 + k)
        sets.append(np.unique(s))
    block = {"node": np.arange(60), "n": np.array([len(s) for s in sets]), "copies": np.ones(60, np.int64), "sets": sets}
    short = block | {"sets": [s >> jaccard_join.SPARE for s in sets]}
    first, edges, again = jaccard_join.compare_blocks(short, short, True, 96)
    second, more, none = jaccard_join.compare_blocks(block, block, True, 96, whole=True)
    inter = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    union = block["n"][:, None] + block["n"][None, :] - inter
    linked = 100 * inter >= 96 * union
    np.fill_diagonal(linked, False)
    rough = jaccard_join.overlaps(short["sets"], short["sets"])
    wrong = (100 * rough >= 96 * (block["n"][:, None] + block["n"][None, :] - rough)) != linked
    np.fill_diagonal(wrong, False)
    assert wrong.any() and again and not none
    sure = ~jaccard_join._doubtful(short, short, rough, 96)
    assert (np.array([first.get(k, 0) + second.get(k, 0) for k in range(60)])[~(wrong & sure).any(1)] == linked.sum(1)[~(wrong & sure).any(1)]).all()
    assert {k for e in edges + more for k in e} >= set(np.flatnonzero(linked.any(1)).tolist())
    sizes = np.array([1, 100, 5000, 10**6, 10**7])
    assert np.diag(jaccard_join.slack(sizes, sizes)).tolist() == sorted(np.diag(jaccard_join.slack(sizes, sizes)).tolist()) and jaccard_join.slack(sizes, sizes)[0, 0] == 1


def test_embedding_join(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    rows = [(k, v.tolist()) for k, v in enumerate(base)] + [(100 + k, (base[k % 5] + rng.normal(size=16) * 0.1).tolist()) for k in range(40)]
    rows += [(200, base[0].tolist()), (201, (2 * base[0]).tolist()), (202, None), (203, [0.0] * 16), (204, [float("nan")] * 16), (205, [1.0, 2.0]), (206, [1.0, None]), (207, []), (205, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<double>, pos string")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_join.near_duplicates(df, block_bytes=1 << 11).collect())
    ok = lambda v: v and None not in v and np.isfinite(v).all() and np.any(v)
    link = [[a != b and ok(rows[a][1]) and ok(rows[b][1]) and len(rows[a][1]) == len(rows[b][1]) and np.dot(rows[a][1], rows[b][1]) / np.linalg.norm(rows[a][1]) / np.linalg.norm(rows[b][1]) >= 0.95 for b in range(len(rows))] for a in range(len(rows))]
    label = [r[0] for r in rows]
    for _ in rows:
        label = [min([label[a], *[label[b] for b in range(len(rows)) if link[a][b]]]) for a in range(len(rows))]
    assert got == sorted((rows[a][0], sum(map(bool, link[a])), label[a], rows[a][0] == label[a]) for a in range(len(rows)))
    assert embedding_join.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("many", [4096, 2])
def test_substring_dedup(spark, many, monkeypatch):
    monkeypatch.setattr(substring_dedup, "MANY", many)
    texts = [x for x in corpus() if x[0] != 3] + [(3, "ab" * 300), (70, "q" * 99), (71, "q" * 100), (72, "q" * 250)]
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(docs(spark, texts)).collect()}
    seen = set()
    for i, t in sorted(texts):
        b = (t or "").encode()
        hit = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                hit[p : p + 100] = True
            seen.add(b[p : p + 100])
        kept = bytes(np.frombuffer(b, np.uint8)[~hit])
        spans = int(hit[:1].sum() + (hit[1:] & ~hit[:-1]).sum())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept) == (len(b), int(hit.sum()), spans, kept), i
    assert substring_dedup.remove_repeats(docs(spark, texts).limit(0)).count() == 0


def test_packing(spark):
    texts = [*corpus(), (80, "x <|endoftext|> y"), (81, "  a \n b  c\n\n"), (82, "naïve 漢字 🙂"), (None, "null id")]
    got = packing.pack(docs(spark, texts), round_tokens=3000).collect()
    windows = {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 2048
    words = packing._words(packing.vocabulary_path())
    for i, t in texts:
        ids = words.full.encode(t or "", add_special_tokens=False).ids
        assert words.ids(t or "") == np.array(ids, "<u4").tobytes()
        total = sum(r.length for r in got if r.doc_id == i)
        assert total == (len(ids) + 1) * sum(k == i for k, _ in texts)
    assert packing.pack(docs(spark, texts).limit(0)).count() == 0


def test_best_fit_takes_the_tightest_window():
    of, fills = packing.best_fit_decreasing(np.array([6, 5, 4, 3, 2]), 10)
    assert of.tolist() == [0, 1, 0, 1, 1] and fills.tolist() == [10, 10]


def test_mixing(spark):
    texts = [*corpus(), (None, "null id here")]
    df = docs(spark, texts)
    plan = mixing.plan_mix(df).collect()
    assert len(plan) == len(texts) and all(0 <= r.copies <= 2 for r in plan)
    by_source = {r.source: (r.source_size, r.target) for r in plan}
    assert abs(sum(t for _, t in by_source.values()) - 1.5 * sum(s for s, _ in by_source.values())) < 1e-6
    assert all(t <= 2 * s for s, t in by_source.values())
    assert mixing.mix(df).count() == sum(r.copies for r in plan) and mixing.mix(df).columns == df.columns
    assert mixing.plan_mix(df.limit(0)).count() == 0


def test_pii(spark):
    texts = [(1, None), (2, ""), (3, "a@b.c_d@e.f.. x@y..z a@b.c."), (4, "1.2.3.4.5.6.7.8 001.2.3.255 256.1.1.1"), (5, "4111 1111 1111 1111, 4111-1111-1111-1111- 4111  1111"), (6, "é😀 +1 (743) 555-3824 +12345"), (7, "7" * 2000 + " 1 2 3" * 900), (8, "a." * 900 + "@b" + ".c" * 900), (9, "my phone (743) 555-3824; write anna (at) host (dot) org")]
    df = docs(spark, texts)
    found = {r.doc_id: r for r in pii.find(df).collect()}
    for i, t in texts:
        t = t or ""
        luhn16 = lambda x: 16 <= len(d := re.sub("[ -]", "", x)) <= 19 and pii.luhn(d)
        want = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        want += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if max(map(int, m[0].split("."))) <= 255]
        want += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if luhn16(m[0])]
        want += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        assert [(s.kind, s.start, s.stop) for s in found[i].pii_base] == want, i
    assert {s.kind for s in found[9].pii_spans} == {"email", "phone"} and found[1].pii_spans == []
    assert {r.doc_id: r.text for r in pii.redact(df).collect()}[9] == "my phone [PHONE]; write [EMAIL]"
    assert pii.find(df.limit(0)).count() == 0


def test_pii_at_the_end_of_a_sentence_and_compressed_addresses(spark):
    texts = ["call my phone (743) 555-3824.", "phone 0743 555 3824. Then", "call my phone (743) 555-3824; or", "client ip address 2001:db8::1.", "and then there was fe80::1ff:fe23:4567:890a, too", "from host 2a02:26:9::8", "take x[1::2] of std::abs and add::face", "ip 1:2:3:4:5:6:7:8", "::ffff:1.2.3.4", "(743) 555-3824.5"]
    got = {r.doc_id: r.text for r in pii.redact(docs(spark, list(enumerate(texts)))).collect()}
    assert [got[k] for k in range(7)] == ["call my phone [PHONE].", "phone [PHONE]. Then", "call my phone [PHONE]; or", "client ip address [IP].", "and then there was [IP], too", "from host [IP]", texts[6]]
    assert got[8] == "::ffff:[IP]"


def test_quality_rules(spark):
    texts = [*corpus(), (90, "same line here\n" * 6 + "other"), (91, "a b c d e f g h " * 5), (92, "#*$ % & word | <x>")]
    rows = {(r.doc_id): r for r in quality_rules.judge(docs(spark, texts)).collect()}
    for i, t in texts:
        w = (t or "").encode().split()
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        covered = {j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(k, k + 8)} if len(w) < 500 else set()
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        r = rows[i]
        assert (r.n_words, r.n_repeat_words, r.n_dup_lines) == (len(w), len(covered), len(lines) - len(set(lines))), i
        assert r.word_chars == sum(len(x.decode()) for x in w) and r.n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r.kept and r.base_failed)
    assert quality_rules.judge(docs(spark, texts).limit(0)).count() == 0


def test_quality_rules_reject_texts_without_the_languages_common_words(spark):
    rng = random.Random(11)
    rare = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(5, 9))) for _ in range(3000)]

    def text(lang, n, share=0.25):
        return " ".join(rng.choice(quality_rules.COMMON[lang]) if rng.random() < share else rng.choice(rare) for _ in range(n))

    rows = [(1000 * k + j, text(lang, n), lang) for k, lang in enumerate(("en", "de")) for j, n in enumerate([100] * 40 + [600] * 40)]
    rows += [(9000, text("en", 100, 0), "en"), (9001, text("en", 600, 0), "de"), (9002, text("de", 100), "en"), (9003, text("en", 600), "de"), (9004, text("en", 9000, 0), "en"), (9005, text("en", 100, 0), None)]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert len(got) == len(rows) and not any(r.base_failed for r in got.values()) and all(got[k].word_distance < 0.5 for k in (9000, 9001, 9004))
    assert all(r.kept for k, r in got.items() if k < 9000) and [got[9000 + k].kept for k in range(6)] == [False] * 5 + [True]
    same = spark.createDataFrame([(k, text("en", 100, 0), "en") for k in range(30)], "doc_id bigint, text string, lang string")
    assert quality_rules.judge(same).where("kept").count() == 30  # no reference with common words


def test_quality_classifier(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(80)]
    texts = [(k, " ".join(rng.choice(words) for _ in range(60)) if k % 4 else " ".join([rng.choice(words)] * 60)) for k in range(240)] + [(500, None), (501, "")]
    labels = spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(240)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.quality_score for r in quality_classifier.score(docs(spark, texts), labels).collect()}
    assert len(got) == 242 and all(0 <= s <= 1 for s in got.values())
    import zlib

    held = [k for k in range(240) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert np.mean([(got[k] >= 0.7) == (k % 4 > 0) for k in held]) > 0.9
    assert {r.quality_score for r in quality_classifier.score(docs(spark, texts), labels.limit(0)).collect()} == {1.0}
    assert quality_classifier.score(docs(spark, texts).limit(0), labels).count() == 0


def test_url_filter(spark):
    urls = ["http://a.COM/x", "https://example.com/en/1", "https://www.example.com/en/2?q", "https://b.net/es/3#f", "http://net/fr/4", "http://b.net", "no scheme", None, "x://y://z/p", "http://b.org/a/1", "https://notcom/en/"] + [f"http://h.net/es/{k}" for k in range(9)]
    df = spark.createDataFrame([(k, u, "z") for k, u in enumerate(urls)], "page_id bigint, url string, host string")
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    assert [got[k].rule for k in range(11)] == ["com/", "example.com/en/", "www.example.com/en/", "net/es/", "net/fr/", None, None, None, None, None, None]
    assert [got[k].verdict for k in range(5)] == ["allow", "block", "allow", "block", "block"]
    assert (got[6].host, got[6].path, got[7].host, got[8].host, got[0].host) == ("", "", "", "y:", "a.com") and got[7].verdict == "allow"
    assert url_filter.judge(df.limit(0)).count() == 0


def test_url_tree_blocks_what_is_built_like_blocked_branches(spark):
    shop = lambda host, top: [f"http://{host}/{top}/{x}/{k}" for x in ("cart", "item") for k in range(8)]
    plain = [f"http://a.net/blog/{k}" for k in range(9)]
    urls = [*shop("a.net", "es"), *shop("a.net", "fr"), *shop("a.net", "sv"), *plain, *shop("b.org", "sv")]
    urls += [*shop("www.example.com", "en"), *shop("www.example.com", "zz")]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id bigint, url string")
    got = {urls[r.page_id]: r for r in url_filter.judge(df).collect()}
    assert all(got[u].verdict == "block" and got[u].rule is None for u in shop("a.net", "sv"))
    others = [u for u in urls if got[u].rule is None and u not in shop("a.net", "sv")]
    assert len(others) == 9 + 16 and all(got[u].verdict == "allow" for u in others)


def test_quote_links(spark):
    rows = [(1, 0, "u", "How do I reset the password of my account?"), (1, 1, "a", "Go to settings and choose reset.\n\nThen confirm the mail."), (1, 2, "u", "> Go to settings and choose reset.\nI see no settings there."), (1, 3, "u", "> > How do I reset the  PASSWORD of my account?\n> Go to settings and choose reset.\n>\n> Then confirm the mail.\nDone."), (1, 4, "a", "> I see no settings there.\nThey are top right."), (2, 0, "u", ">Then confirm the mail.\nWhat mail?"), (2, 1, "u", None), (None, 1, "u", "> x"), (2, 1, "u", None)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, hash string")
    got = quote_links.reply_order(df).orderBy("conv_id", "reply_key").collect()
    assert len(got) == len(rows)
    one = [r for r in got if r.conv_id == 1]
    assert [(r.turn, r.parent_turn, r.depth) for r in one] == [(0, None, 0), (1, None, 0), (2, 1, 1), (4, 2, 2), (3, 1, 1)]
    assert all(">" not in r.text for r in one) and [r.parent_conv for r in got if r.conv_id == 2 and r.turn == 0] == [1]
    assert quote_links.reply_order(df.limit(0)).count() == 0


def test_quotes_of_sentences_and_of_later_sayers(spark):
    rows = [(1, 0, "u", "> The moon is made of cheese\nIs it?"), (1, 1, "a", "The moon is made of cheese"), (2, 3, "u", "The moon is made of cheese")]
    rows += [(5, 0, "u", "Open the side door first. Then turn the left\nhandle twice. Wait a minute."), (5, 1, "a", "> Then turn the\n> left handle twice.\nWhich one?"), (5, 2, "u", "> Open the side door first.\nDone."), (6, 0, "u", "> Never said by anybody here.\nNo.")]
    got = {(r.conv_id, r.turn): (r.parent_conv, r.parent_turn) for r in quote_links.reply_order(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert got[1, 0] == (2, 3) and got[5, 1] == got[5, 2] == (5, 0) and got[6, 0] == (None, None)


def test_hash_of_no_span():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
