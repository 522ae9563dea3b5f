"""Operators that look at each text by itself, against plain versions of their contracts."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from factlake.llm import language, licenses, media, packing, pieces, pii, quality, repetition


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


# ---- personal data


def plain_spans(x):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for k, (kind, p) in enumerate(kinds.items()):
        for m in re.finditer(p, x):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(q) <= 255 for q in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def test_base_spans():
    rng = random.Random(2)
    for _ in range(3000):
        x = "".join(rng.choices([*"aé@@..--++12 0()\n", "a@b.c", "1.2.3.4", "4111 1111 1111 1111", "+1 (555) 555-5555"], k=rng.randint(0, 25)))
        assert pii.base_spans(x) == plain_spans(x), x


@pytest.fixture(scope="module")
def field():
    return pii.default_field()


def test_field(field):
    """Chains cut by reach decode as whole chains do, and most words get their label."""
    wrong = n = 0
    for words, labels in pii.training_table(9, 60):
        whole = pii.viterbi(field, field.emissions(pii.names_of(words)), np.array([len(words)]), np.array([False]), np.array([False])) if words else []
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        at = np.cumsum([0] + [len(w.encode()) + 1 for w in words])
        cut = [0] * len(words)
        for _, kind, lo, hi in pii.decode(field, data, np.array([0, len(data)])):
            for k in range(len(words)):
                cut[k] = kind if lo <= at[k] < hi else cut[k]
        assert cut == [0 if y == 0 else pii.LABELS[y][2:] for y in whole]
        wrong += sum(pii.LABELS[y] != z for y, z in zip(whole, labels))
        n += len(labels)
    assert wrong < 0.05 * n


def test_viterbi_is_best(field):
    rng = np.random.default_rng(1)
    e = rng.normal(0, 3, (5, pii.N))
    got = pii.viterbi(field, e, np.array([2, 3]), np.array([True, False]), np.array([False, True]))

    def best(e, before, after):
        from itertools import product

        def value(path):
            v = (field.move[0] if before else field.begin)[path[0]] + e[0, path[0]]
            v += sum(field.move[a, b] + e[k + 1, b] for k, (a, b) in enumerate(zip(path, path[1:])))
            return v + (field.move[path[-1], 0] if after else 0)

        return max(product(range(pii.N), repeat=len(e)), key=value)

    assert tuple(got[:2]) == best(e[:2], True, False) and tuple(got[2:]) == best(e[2:], False, True)


def test_private_rows(odd_docs, empty_docs, field):
    rows = pii.find_private(odd_docs).collect()
    assert all(r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in pii.all_spans(pii.default_field(), pa.array([t]))[0][1]) for r in rows for t in [dict((i, t) for i, t in texts_of(odd_docs))[r.doc_id]] if r.doc_id is not None)
    got = [(r.doc_id, r.base_sha256) for r in rows]
    want = [(i, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(t)).encode()).hexdigest()) for i, t in texts_of(odd_docs)]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert pii.find_private(empty_docs).count() == 0
    masked = pii.mask_documents(odd_docs.limit(0).union(odd_docs.sparkSession.createDataFrame([(1, "mail a@b.org é +1 (555) 555-5555.", "en", "s", 1, "k", 0)], odd_docs.schema)))
    assert masked.first().text == "mail [EMAIL] é [PHONE]."


# ---- language


def test_language(spark, odd_docs, empty_docs):
    words = {"aa": ["zorg", "blik", "mand", "ver"], "bb": ["zório", "ção", "nha", "lá"]}
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(words[lang], k=rng.randint(3, 30))), lang) for i in range(200) for lang in [rng.choice(list(words))]]
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 34 !", "bb"), (902, "zorg blik", None), (None, "ção nha", "bb")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(got[i].held_out for i in held) and sum(r.held_out for r in got.values()) == len(held) + sum(zlib.crc32(str(i).encode()) % 4 == 2 for i in (900, 901, 902))
    assert sum(got[i].lang_pred == dict((a, c) for a, _, c in rows)[i] for i in held) >= 0.95 * len(held)
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == "aa" and got[None].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language.identify(empty_docs).collect()} == set()
    assert language.identify(odd_docs).count() == odd_docs.count()


def test_repeated_ids_keep_their_language(spark):
    """Of rows that share an id each text is learned with its own language, and the order of rows doesn't matter."""
    french, english = "le chat est sur la table et il dort", "the cat is on the table and it sleeps"
    rows = [(1, french, "fr"), (1, english, "en"), (1, english, "en"), (1, None, "fr"), (3, "und", None)]
    train = language.F.lit(True)
    found = [language.sample(spark.createDataFrame(x, "doc_id long, text string, lang string").repartition(2), train) for x in (rows, rows[::-1])]
    for grams, langs in found:
        assert langs == ["en", "fr"] and [g.tolist() for g in grams] == [language.present(x.encode()).tolist() for x in (english, french)]


def test_plain_kernel_ridge():
    """With all texts as landmarks the fit is kernel ridge regression: decisions equal those of the kernel matrix solved directly."""
    rng = random.Random(7)
    texts = ["".join(rng.choices(own, k=rng.randint(10, 40))) for own in ("abcde ", "defgh ", "xyzab ") for _ in range(12)]
    langs = [n for n in "pqr" for _ in range(12)]
    grams = [language.present(x.encode()) for x in texts]
    model = language.fit(grams, langs, landmarks=99, ridge=0.05)
    sets = [set(g.tolist()) for g in grams]
    new = [set(language.present("".join(rng.choices("abcdefghxyz ", k=30)).encode()).tolist()) for _ in range(20)]

    def kernel(a, b):
        return np.array([[len(x & y) / np.sqrt(len(x) * len(y)) for y in b] for x in a])

    share = np.full(len(texts), 1 / 12)
    y = np.where(np.array(langs)[:, None] == np.array(list("pqr"))[None, :], 1.0, -1.0)
    k = kernel(sets, sets)
    mean = share / share.sum()
    centred = k - mean @ k - (k @ mean)[:, None] + mean @ k @ mean
    alpha = np.linalg.solve(share[:, None] * centred + 0.05 * np.eye(len(texts)), share[:, None] * (y - mean @ y))
    own = kernel(new, sets)
    want = (own - (own @ mean)[:, None] - mean @ k + mean @ k @ mean) @ alpha + mean @ y
    marks = np.array([[c in s for c in model.grams.tolist()] for s in new])
    assert np.allclose(model.decide(marks, np.array([len(s) for s in new])), want, atol=5e-3)


def test_long_text_language():
    """N-grams of a text of several steps are those of the whole."""
    text = ("abc é " * 300_000 + "zq").encode()
    mark = np.zeros(language.CODES, bool)
    mark[language.gram_codes(language.ALPHABET[np.frombuffer(text, np.uint8)])] = True
    assert np.array_equal(language.present(text), np.flatnonzero(mark))


def test_kernel_matches_sets():
    a, b = "abcab é", "bca É"
    gram = [language.present(x.encode()) for x in (a, b)]
    signs = [[int(v) for v in language.ALPHABET[np.frombuffer(x.encode(), np.uint8)]] for x in (a, b)]
    sets = [{tuple(s[i : i + n]) for n in (1, 2, 3) for i in range(len(s) - n + 1)} for s in signs]
    assert [len(g) for g in gram] == [len(s) for s in sets]
    assert len(np.intersect1d(*gram)) == len(sets[0] & sets[1])


# ---- pieces


def test_pieces(odd_docs, empty_docs):
    import sentencepiece

    path = public_tokenizers.path(pieces.MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    codec = pieces.Codec(path, remembered=90_000)
    rng = random.Random(3)
    texts = ["".join(rng.choices([*"aé ▁ \n\tthe ing日本😀́\x00x  ", "hello", " world", "   "], k=rng.randint(0, 90))) for _ in range(600)] + ["", " ", "▁", "a" * 200, "<s>", "</s> x"]
    for lo in range(0, len(texts), 100):
        part = texts[lo : lo + 100]
        for t, own in zip(part, codec.encode(part)):
            ids = library.encode(t, add_bos=True, add_eos=True)
            assert own == struct.pack(f"<{len(ids)}I", *ids), t
            assert codec.decode(own) == library.decode(ids), t
    for _ in range(300):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(32000)]) for _ in range(9)]
        assert codec.decode(ids) == library.decode(ids)
    assert all(codec.v.agenda(s) == codec.v.agendas([s])[0] for s in ("▁hello", "▁▁▁x", "▁日a日"))
    got = sorted((repr(r.doc_id), r.n_tokens, r.ids_sha256) for r in pieces.encode_documents(odd_docs).collect())
    want = sorted((repr(i), len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()) for i, t in texts_of(odd_docs) for ids in [library.encode(t, add_bos=True, add_eos=True)])
    assert got == want and pieces.encode_documents(empty_docs).count() == 0
    assert pieces.encode_documents(odd_docs, keep="ids").where("doc_id = 8").first().decoded == "x"


# ---- repetition


def plain_rules(x):
    w = re.findall(r"[^\x20\x09-\x0d]+", x)
    n = len(w)
    c = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    again, cover, longest = set(), set(), [0] * n
    for i in range(n - 2):
        if c[tuple(w[i : i + 3])] > 1:
            again |= {i, i + 1, i + 2}
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and w[i + k] == w[j + k]:
                k += 1
            longest[i], longest[j] = max(longest[i], k), max(longest[j], k)
    for i in range(n):
        if longest[i] >= repetition.MIN_SUBSTRING:
            cover |= set(range(i, i + longest[i]))
    lines, seen, dup = x.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), dup, len(again), len(cover), max(longest, default=0)


def test_repetition(odd_docs, empty_docs):
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["a", "b", "c é", "d\n", "# x"], k=rng.randint(0, 70))) for _ in range(120)] + ["", None, "a " * 80, ("x y z w v u t s r q p " * 3 + "k\n") * 2, "\x85 \xa0 b"]
    got = repetition.rules(pa.array(range(len(texts))), pa.array(texts))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat")
    for k, x in enumerate(texts):
        assert tuple(int(got[c].tolist()[k]) for c in names) == plain_rules(x or ""), x
    rows = repetition.quality_rules(odd_docs).collect()
    assert sorted((repr(r.doc_id), r.n_words, r.n_repeat_words) for r in rows) == sorted((repr(i), (p := plain_rules(t))[0], p[4]) for i, t in texts_of(odd_docs))
    assert repetition.quality_rules(empty_docs).count() == 0


def test_repetition_kept():
    """Texts that pass the base rules and fail the method by either limit, or just pass it, against brute force."""

    def page(n, *passages):
        """n words of which the passages, (words, times), are repeats; the others differ."""
        parts = [" ".join(f"p{k}w{i}" for i in range(size)) for k, (size, times) in enumerate(passages) for _ in range(times)]
        left = n - sum(a * b for a, b in passages)
        fill = [f"f{i}" for i in range(left)]
        return " ".join(x for k, part in enumerate(parts) for x in [*fill[k :: len(parts)], part]) if parts else " ".join(fill)

    cases = [
        (page(49), False), (page(50), True), (page(2000, (300, 2)), False), (page(1000, (50, 2)), True), (page(1020, (51, 2)), False), (page(999, (50, 2)), False), (page(400, (20, 2)), True), (page(399, (20, 2)), False),
        (page(300, (10, 2), (12, 2)), False), (page(100, (9, 4)), True), (page(100, (26, 2)), False),
    ]
    got = repetition.rules(pa.array(range(len(cases))), pa.array([x for x, _ in cases]))
    assert not any(got["base_failed"].tolist()[k] for k in range(1, len(cases) - 1))
    for k, (x, kept) in enumerate(cases):
        n, _, _, _, again, cover, longest = plain_rules(x)
        base = n < 50 or again > 0.5 * n
        assert (got["base_failed"].tolist()[k], got["kept"].tolist()[k]) == (base, not base and cover <= 0.1 * n and longest <= 50) == (base, kept), k


# ---- packing


def test_chunks():
    chunks = packing.Chunks(public_tokenizers.path(packing.TOKENIZER), remembered=30_000)
    rng = random.Random(1)
    texts = ["".join(rng.choices([*"aÉ'ßΣ \n\x85　éİ\x1c日!😀\x00,1", "don't", "<|endoftext|>", " I'LL", "é"], k=rng.randint(0, 50))) for _ in range(500)]
    for t, own in zip(texts, chunks.encode([t.encode() for t in texts])):
        ids = chunks.tokenizer.encode(t, add_special_tokens=False).ids
        assert own == struct.pack(f"<{len(ids)}I", *ids), t


def test_patterns():
    rng = np.random.default_rng(3)
    for rows in (1, 20, 400):
        demand = np.zeros(128, np.int64)
        np.add.at(demand, rng.integers(0, 128, rows), 1)
        found = packing.patterns(demand)
        assert (sum(p * n for p, n in found) == demand).all()
        assert all((p * np.arange(1, 129)).sum() <= 128 for p, _ in found)
    assert packing.patterns(np.zeros(128, np.int64)) == []
    value, column = packing.best_column(np.array([1.0, 2.1, 3.3, 3.0]), 4)
    assert abs(value - 4.3) < 1e-9 and column.tolist() == [1, 0, 1, 0]


def test_packing(odd_docs, empty_docs):
    rows = packing.pack_documents(odd_docs, sequence=64).collect()
    tokenizer = packing.Chunks(public_tokenizers.path(packing.TOKENIZER)).tokenizer
    want = Counter()
    for i, t in texts_of(odd_docs):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        for lo in range(0, len(ids), 64):
            part = ids[lo : lo + 64]
            want[i, lo, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(empty_docs).count() == 0


# ---- licences


def test_licenses(spark, odd_docs, empty_docs):
    texts = [t for _, t in licenses.TEMPLATES]
    rng = random.Random(6)

    def worn(t):
        w = t.split()
        for _ in range(len(w) // 12):
            w[rng.randrange(len(w))] = "zzz"
        return " ".join(w)

    rows = [(k, f"some words\n{worn(t)}\nmore of it") for k, t in enumerate(texts)] + [(90, texts[0] + "\n\n" + texts[2]), (91, "License"), (92, None), (93, "the work is under a license of the public")]

    def plain(text):
        clean = re.sub("[^a-z0-9\n]+", " ", (text or "").lower())
        units = {re.sub(" +", " ", u.replace("\n", " ")).strip() for u in [*clean.split("\n"), *re.split("\n ?\n[ \n]*", clean), clean]}
        hits, n = [], 0
        for u in units:
            own = set(licenses.bigrams_of(u))
            found = [(-2.0 * len(own & set(licenses.bigrams_of(t))) / (len(own) + len(licenses.bigrams_of(t))), name) for name, t in licenses.TEMPLATES if own]
            found = [x for x in found if -x[0] >= licenses.SIMILARITY]
            n += bool(found)
            hits += found
        return (n, min(hits)[1], -min(hits)[0], ",".join(sorted({x[1] for x in hits}))) if hits else (0, None, None, "")

    got = {r.doc_id: (r.n_matches, r.license, r.dice, r.licenses) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: plain(t) for i, t in rows}
    assert licenses.scan_licenses(odd_docs).where("n_matches = 0").count() == odd_docs.count() and licenses.scan_licenses(empty_docs).count() == 0
    plan = licenses.scan_licenses(spark.range(3).selectExpr("id as doc_id", "'x' as text"))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Exchange", "Join"))


NOTICES = {
    "All rights reserved.": "Proprietary", "all  rights reserved": "Proprietary", "Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under CC BY 4.0.": "CC-BY-4.0",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
}


def test_notice_lines(spark):
    """Every notice finds its licence where it stands alone on a line, the shortest too; its words apart don't."""
    lone = [*NOTICES.items(), *((t, name) for name, t in licenses.TEMPLATES)]
    rows = [(k, f"some words of a page\n{t}\nmore of it") for k, (t, _) in enumerate(lone)] + [(900, "All rights\nare reserved for guests"), (901, "reserved"), (902, "All rights reserved.")]
    got = {r.doc_id: (r.n_matches, r.license, r.dice) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k][0] >= 1 and got[k][1:] == (name, 1.0) for k, (_, name) in enumerate(lone))
    assert got[900] == got[901] == (0, None, None) and got[902] == (1, "Proprietary", 1.0)


def test_passages(spark, odd_docs, empty_docs):
    """Licences inside longer texts, as people lay them out, and all runs of words by brute force on small texts."""
    import textwrap

    mit = next(t for _, t in licenses.TEMPLATES if t.startswith("Permission is hereby granted, free"))
    cut = [mit.index("The above copyright"), mit.index("THE SOFTWARE IS")]
    layout = "\n\n".join(textwrap.fill(x, 70) for x in (mit[: cut[0]], mit[cut[0] : cut[1]], mit[cut[1] :]))
    bsd = licenses.FULL_TEXTS[0][1]
    code = "\n".join(f"def f{k}(x): return x + {k} * y{k}" for k in range(60))
    prose = " ".join(f"w{k}" for k in range(40))
    whole = [(1, f"{layout}\n\n{code}", "MIT"), (2, f"{code}\n# {bsd}\n{code}", "BSD-3-Clause"), (3, f"{prose} Released under the MIT License. {prose}", "MIT"), (4, f"{prose}\nit is licensed under CC\nBY 4.0. {prose}", "CC-BY-4.0"), (5, f"{code}\n{licenses.FULL_TEXTS[1][1]}", "BSD-2-Clause"), (6, code + prose, None), (7, None, None)]
    frame = spark.createDataFrame([x[:2] for x in whole], "doc_id long, text string")
    assert {r.doc_id: r.license for r in licenses.scan_passages(frame).collect()} == {i: name for i, _, name in whole}
    assert {r.doc_id for r in licenses.scan_licenses(frame).where("license is not null").collect()} == set()

    own = [("A", "licensed under cc by sa here"), ("B", "all rights reserved"), ("C", "to be or not to be or to go")]
    rng = random.Random(3)
    words = [*"licensed under cc by sa here all rights reserved to be or not to be or to go".split(), "x"]
    texts = [" ".join(rng.choices(words, k=3) + w + rng.choices(words, k=3)) for _ in range(60) for w in [rng.choice(own)[1].split()] for _ in [w.insert(rng.randrange(len(w)), "x") if rng.random() < 0.7 else w.pop(rng.randrange(len(w)))]]

    def plain(text):
        w, hits = text.split(), []
        for name, t in own:
            goal, most = set(licenses.bigrams_of(t)), int(1.5 * (len(t.split()) - 1))
            dice = [2.0 * len(b & goal) / (len(b) + len(goal)) for i in range(len(w)) for j in range(i + 2, min(len(w), i + most + 1) + 1) for b in [set(licenses.bigrams_of(" ".join(w[i:j])))]]
            hits += [(-max(dice), name)] if max(dice) >= 0.8 else []
        return (len(hits), min(hits)[1], -min(hits)[0], ",".join(sorted(x[1] for x in hits))) if hits else (0, None, None, "")

    got = licenses.scan_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), own)
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == {k: plain(x) for k, x in enumerate(texts)}
    assert licenses.scan_passages(odd_docs).where("n_matches = 0").count() == odd_docs.count() and licenses.scan_passages(empty_docs).count() == 0
    plan = licenses.scan_passages(frame)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Exchange", "Join"))


# ---- quality


def test_quality(spark, odd_docs, empty_docs):
    rng = random.Random(8)

    def text(good):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(rng.randint(20, 80))]
        return " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words)

    kind = {i: rng.random() < 0.7 for i in range(600)}
    docs = spark.createDataFrame([*((i, text(g)) for i, g in kind.items()), (700, None), (701, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(g), 0) for i, g in kind.items() if i % 2] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    held = [i for i in kind if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i in held) and len(got) == 602
    assert sum(got[i].predicted == kind[i] for i in held) >= 0.95 * len(held)
    assert got[700].score == got[701].score and all(r.predicted == (r.score >= 0.5) for r in got.values())
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert kept == {i for i, r in got.items() if r.predicted} and quality.keep_good(odd_docs, labels.limit(0)).count() == odd_docs.count()
    assert {r.score for r in quality.score_quality(odd_docs, labels.limit(0)).collect()} == {0.5} and quality.score_quality(empty_docs, labels).count() == 0


def test_prior_and_correction():
    rng = np.random.default_rng(2)
    p, u = rng.normal(2, 1, 3000), np.concatenate([rng.normal(2, 1, 1800), rng.normal(-2, 1, 1200)])
    assert abs(quality.class_prior(p, u) - 0.6) < 0.08


@pytest.mark.parametrize("prior, corrected", [(0.3, False), (0.99, True)])
def test_risk_gradient(monkeypatch, prior, corrected):
    """One step goes along the gradient of the non-negative risk, found by finite differences: of the whole risk, or where its negative
    part is below zero, up that part."""
    rng = np.random.default_rng(3)
    positive, web = rng.normal(1, 1, (40, 3)), rng.normal(-1, 1, (60, 3))
    monkeypatch.setattr(quality, "DECAY", 0.0)
    start = quality.train(positive, web, prior, steps=0)
    if corrected and start.score(web).mean() > start.score(positive).mean():  # the first net must score the web lower
        positive, web = web, positive
        start = quality.train(positive, web, prior, steps=0)
    x = [((p - start.mean) / start.scale).clip(-8, 8) for p in (positive, web)]

    def parts(values):
        w, b, v, c = values
        loss = [1 / (1 + np.exp(np.tanh(q @ w + b) @ v + c)) for q in x]
        return prior * loss[0].mean(), (1 - loss[1]).mean() - prior * (1 - loss[0]).mean()

    assert (parts(start.parts)[1] < 0) == corrected
    moved = quality.train(positive, web, prior, steps=1)

    def risk(values):
        plain, negative = parts(values)
        return -negative if negative < 0 else plain + negative

    for k, (a, b) in enumerate(zip(start.parts, moved.parts)):
        flat, signs = np.atleast_1d(a).ravel(), np.sign(np.atleast_1d(b - a)).ravel()
        for i in range(0, len(flat), max(1, len(flat) // 7)):
            both = []
            for h in (1e-5, -1e-5):
                values = [np.array(p, float) for p in start.parts]
                values[k].reshape(-1)[i] += h
                both.append(risk(values))
            slope = (both[0] - both[1]) / 2e-5
            assert abs(slope) < 1e-7 or np.sign(slope) == -signs[i], (k, i)  # the first step of Adam has the gradient's sign


def test_repeated_ids_collect_once(spark):
    """Rows that repeat an id give the driver one row, the same in any order."""
    rows = [(1, "a b c."), (1, "D E!"), (2, "x"), (2, "x")] + [(k, f"text {k}") for k in range(3, 9)]
    found = [quality._sampled(spark.createDataFrame(r, "doc_id long, text string").repartition(3), spark.createDataFrame([(1,), (1,), (2,), (None,)], "doc_id long"), 64) for r in (rows, rows[::-1])]
    assert found[0].shape == (2, len(quality.NAMES)) and np.array_equal(*found)


# ---- media


def test_media(odd_docs, empty_docs, tmp_path):
    rows = media.media_columns(odd_docs, f"file://{tmp_path}/media").collect()

    def plain(t):
        b = t.encode()
        p = b + b"\xff" * (max(576, -(-len(b) // 576) * 576) - len(b))
        return len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])

    assert sorted((repr(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == sorted((repr(i), *plain(t)) for i, t in texts_of(odd_docs))
    same = [(r.media_bytes, r.media_sha256, r.feature) for r in rows if r.doc_id in (1, 2)]
    assert len(set(same)) == 1 and media.media_columns(empty_docs, f"file://{tmp_path}/none").count() == 0
    import tarfile

    for r in rows:
        with tarfile.open(tmp_path / "media" / r.shard) as tar:
            member = next(m for m in tar if m.offset_data == r.offset)
            data = tar.extractfile(member).read()
            assert member.name == f"{r.media_sha256}.png" and len(data) == r.media_bytes and hashlib.sha256(data).hexdigest() == r.media_sha256


def test_payloads_are_stored_once(spark, tmp_path):
    """Equal payloads of many tasks are one member of all shards, and all their rows point at it."""
    docs = spark.createDataFrame([(k, "the same text" if k % 3 else f"text {k // 2}") for k in range(90)], "doc_id long, text string").repartition(9)
    rows = media.store_texts(docs, f"file://{tmp_path}/m").collect() if (tmp_path / "m").mkdir() is None else None
    import tarfile

    names = [m.name for p in (tmp_path / "m").iterdir() for m in tarfile.open(p)]
    assert len(rows) == 90 and len(names) == len(set(names)) == len({r.digest for r in rows}) == len({(r.shard, r.offset) for r in rows})


def test_header_reads_no_more(odd_docs, tmp_path, monkeypatch):
    """Metadata columns take the header's bytes of each payload and no others."""
    (tmp_path / "m").mkdir()
    folder = f"file://{tmp_path}/m"
    rows = media.store_texts(odd_docs, folder).collect()
    read, whole = [], media.Reader.read
    monkeypatch.setattr(media.Reader, "read", lambda self, shard, offset, length: read.append(length) or whole(self, shard, offset, length))
    reader = media.Reader(folder)
    for r in rows:
        assert media._metadata(reader, r.shard, r.offset, r.length) == (576, max(1, -(-r.n_bytes // 576)), 8)
    assert read == [media.HEADER] * len(rows)
    got = media.fill_metadata(odd_docs.sparkSession.createDataFrame(rows), folder).collect()
    assert sorted((repr(r.doc_id), r.width, r.height) for r in got) == sorted((repr(r.doc_id), 576, max(1, -(-r.n_bytes // 576))) for r in rows)


def test_damaged_images():
    data = media.to_png(media.payload_of(b"abc" * 900))
    assert media.png_header(data[: media.HEADER]) == (576, 5, 8) and media.from_png(data) == media.payload_of(b"abc" * 900)
    with pytest.raises(ValueError):
        media.from_png(data[:-6] + b"xxxxxx")


def test_shards_roll_over(tmp_path):
    """Shards are closed at their size, and a reader that keeps few open still reads all; one payload is longer than a shard."""
    shards = media.Shards(f"file://{tmp_path}", limit=3000)
    parts = [bytes([k]) * (200 + 900 * (k % 4)) for k in range(80)] + [b"z" * 9000]
    places = [shards.add(f"{k}", x) for k, x in enumerate(parts)]
    shards.close()
    reader = media.Reader(f"file://{tmp_path}")
    assert len({s for s, _ in places}) > media.KEPT_SHARDS and [reader.read(s, at, len(x)) for (s, at), x in zip(places, parts)] == parts


def test_feature():
    payload = media.payload_of(b"abc" * 900)
    x = [payload[k * len(payload) // 64 : (k + 1) * len(payload) // 64] for k in range(64)]
    means = [sum(p) / len(p) for p in x]
    bits = "".join("1" if m > sum(means) / 64 else "0" for m in means)
    mean = sum(payload) / len(payload)
    assert media.feature(payload) == f"{int(bits, 2):016x}:{mean:.3f}:{(sum((v - mean) ** 2 for v in payload) / len(payload)) ** 0.5:.3f}"


def test_very_long_texts(spark):
    """One text over a slice of 4 MB beside short ones: the operators of single texts handle it whole."""
    long = " ".join(f"w{k % 5000}x{k % 77}" for k in range(600_000))
    docs = spark.createDataFrame([(1, long), (2, "short text."), (3, None)], "doc_id long, text string")
    words = long.split()
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    again = len({i + j for i, t in enumerate(windows) if seen[t] > 1 for j in range(3)})
    got = {r.doc_id: r for r in repetition.quality_rules(docs).collect()}
    assert got[1].n_words == 600_000 and got[1].word_chars == sum(map(len, words)) and got[1].n_repeat_words == again
    codes = {r.doc_id: r for r in pieces.encode_documents(docs).collect()}
    assert codes[1].decoded_sha256 == hashlib.sha256(long.encode()).hexdigest() and codes[1].n_tokens > 600_000
    packed = packing.pack_documents(docs).where("doc_id = 1").collect()
    assert sum(r.length for r in packed) == packed[0].doc_tokens and len({r.start for r in packed}) == len(packed)
    assert {r.doc_id for r in language.predict(docs, None).collect()} == {1, 2, 3}
    assert {r.doc_id: r.n_matches for r in licenses.scan_licenses(docs).collect()} == {1: 0, 2: 0, 3: 0}
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.score_quality(docs, labels).count() == 3
