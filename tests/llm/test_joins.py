"""Operators on pairs and the pipeline, against brute force."""

import random

import numpy as np
import pytest
import xxhash

from factlake.llm import common, lines, simhash


def groups(names, linked):
    par = {x: x for x in names}

    def find(x):
        while par[x] != x:
            par[x] = par[par[x]]
            x = par[x]
        return x

    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if linked(a, b):
                par[find(a)] = find(b)
    return {x: find(x) for x in names}


def plain_print(x):
    import re

    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), x))
    if not w:
        return 0
    sh = [" ".join(w)] if len(w) < 4 else [" ".join(w[i : i + 4]) for i in range(len(w) - 3)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_fingerprint():
    rng = random.Random(1)
    for x in ["", " ", "A", "É b", "a b c d", *(" ".join(rng.choices(["Ab", "é", "c\n", "D"], k=rng.randint(0, 40))) for _ in range(80))]:
        assert simhash.fingerprint(x.encode()) == plain_print(x)


def test_blocks_cover():
    for n in (10, 10**7, 10**10):
        keys = simhash.blocks(n)
        assert all(sum(w for _, w in k) < 64 for k in keys)
        rng = random.Random(n)
        for _ in range(200):
            flips = rng.sample(range(64), 4)
            assert any(all(not any(s <= f < s + w for f in flips) for s, w in k) for k in keys)


@pytest.mark.parametrize("run_rows", [4096, 5])
def test_links_in_cuts(spark, run_rows, monkeypatch):
    """Fingerprints in dense clusters, with runs whole and cut in small pieces."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 6, dtype=np.int64)
    fps = {int(b) for b in base} | {int(b ^ np.bitwise_or.reduce([np.int64(1) << int(k) for k in rng.integers(0, 20, rng.integers(1, 5))])) for b in base for _ in range(25)}
    monkeypatch.setattr(common.salted_runs, "__defaults__", (run_rows, None, 0))
    frame = spark.createDataFrame([(x,) for x in fps], "fp long")
    edges = simhash.links(frame, len(fps))
    got = {r.node: r.root for r in common.components(edges, "t").collect()}
    names = sorted(fps)
    want = groups(names, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4)
    same = {}
    for x in names:
        same.setdefault(want[x], []).append(x)
    for own in same.values():
        assert {got.get(x, x) for x in own} == {min(own)}


def test_near_duplicates(spark, odd_docs, empty_docs):
    got = sorted((repr(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd_docs).collect())
    rows = [(r.doc_id, plain_print(r.text or "")) for r in odd_docs.collect()]
    own = groups(sorted({f for _, f in rows}), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for i, f in rows:
        if i is not None:
            least[own[f]] = min(i, least.get(own[f], i))
    assert got == sorted((repr(i), f"{f:016x}", least.get(own[f])) for i, f in rows)
    assert simhash.near_duplicates(empty_docs).count() == 0


def test_shared_folder(spark):
    """Rounds delete what the next one doesn't read, and a session on a cluster must name the folder."""
    from pathlib import Path
    from types import SimpleNamespace

    folder = Path(common.shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    common.components(spark.createDataFrame([(k, k + 1) for k in range(30)], "a long, b long"), "rounds")
    assert len(set(folder.iterdir()) - before) == 1
    far = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="spark://far:7077"))
    with pytest.raises(ValueError):
        common.shared_dir(far)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(k, k + 1) for k in range(100, 140)] + [(5, 5)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    linked = set(edges) | {(b, a) for a, b in edges}
    names = sorted({x for e in edges for x in e})
    want = groups(names, lambda a, b: (a, b) in linked)
    for x in got:
        assert got[x] == min(y for y in names if want[y] == want[x])
    assert set(got) == {x for a, b in edges if a != b for x in (a, b)}


def edits(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def worn(rng, s, k):
    s = list(s)
    for _ in range(k):
        r, i = rng.random(), rng.randrange(len(s))
        if r < 0.4:
            s.insert(i, rng.choice("abcé"))
        elif r < 0.7:
            s.pop(i)
        else:
            s[i] = rng.choice("abcé")
    return "".join(s)


@pytest.mark.parametrize("limit", [1, 2, 3])
def test_edit_join_parts(limit):
    rng = random.Random(limit)
    a = ["".join(rng.choices("abcé", k=rng.randint(20, 36))) for _ in range(400)]
    b = [worn(rng, x, rng.randint(0, 5)) for x in a]
    near = np.array([edits(x, y) <= limit for x, y in zip(a, b)])
    assert (lines.within(a, b, limit) == near).all()
    assert (lines.may_match(lines.signatures(a), lines.signatures(b), limit) | ~near).all()
    for x, y, n in zip(a, b, near):
        if n and x != y:
            keys = [{(s[p:q], seed, probe) for p, q, seed, probe in lines.substrings(len(s), limit)} for s in (x, y)]
            assert any((t, seed, o) in keys[1] for t, seed, p in keys[0] for o in ((False,) if p else (False, True)))


def test_odd_and_long_lines():
    """Control characters aren't taken for the edges of a line, and pairs of very different lengths are verified together."""
    rng = random.Random(11)
    a = ["".join(rng.choices("ab\x00\x01", k=rng.randint(6, 30))) for _ in range(1500)]
    b = [worn(rng, x, rng.randint(0, 4)) for x in a]
    for limit in (1, 2, 3):
        assert (lines.within(a, b, limit) == [edits(x, y) <= limit for x, y in zip(a, b)]).all()
        assert [lines._diagonals(x, y, limit) for x, y in zip(a, b)] == [edits(x, y) <= limit for x, y in zip(a, b)]
    long = "".join(rng.choices("abc ", k=400_000))
    near, far = "q" + long[1:399_990] + long[399_991:], long[:200_000] + "qqq" + long[200_000:]
    assert lines.within([long, "ab", long, near], [near, "ac", far, "ab"], 2).tolist() == [True, True, False, False]


def test_signatures_in_parts(monkeypatch):
    rng = random.Random(12)
    own = ["".join(rng.choices("abcé", k=rng.randint(1, 60))) for _ in range(300)]
    whole = lines.signatures(own)
    for size in (3, 10, 59):
        monkeypatch.setattr(lines, "SIGN_CHARS", size)
        assert (lines.signatures(own) == whole).all()


def test_many_equal_lines(spark):
    """A document of 60,000 equal lines loses all but one in time that follows their number."""
    import time

    docs = spark.createDataFrame([(1, "a line that is repeated again\n" * 60_000 + "end of it"), (2, "other")], "doc_id long, text string")
    begin = time.time()
    got = {r.doc_id: (r.text, r["__dropped"]) for r in lines.drop_lines(docs).collect()}
    assert got == {1: ("a line that is repeated again\nend of it", 59_999), 2: ("other", 0)} and time.time() - begin < 120


def test_links_of_documents(spark):
    """Each document says how many of its dropped lines were near copies, and where the lines that stay are."""
    base = "this is a line of some length, number one"
    docs = [(1, base), (2, base.replace("one", "on")), (3, base + "\nanother line that stands here alone"), (4, "another line that stands here alone\n" + base), (None, "nothing of it at all, nowhere")]
    got = {r.doc_id: (r.n_dropped, r.n_near, r.first_docs) for r in lines.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: (0, 0, []), 2: (1, 1, [1]), 3: (1, 0, [1]), 4: (2, 0, [1, 3]), None: (0, 0, [])}


@pytest.mark.parametrize("run_rows", [4096, 6])
def test_line_dedup(spark, run_rows, monkeypatch):
    monkeypatch.setattr(common.salted_runs, "__defaults__", (run_rows, None, 0))
    monkeypatch.setattr(lines, "RUN_ROWS", run_rows)
    rng = random.Random(5)
    base = ["".join(rng.choices("abcdefghi jklmno", k=rng.randint(18, 50))) for _ in range(30)]
    docs = [(i, "\n".join(worn(rng, rng.choice(base), rng.randint(0, 3)) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    docs += [(None, base[0]), (3, base[1] + "\n" + base[1]), (7, None), (8, ""), docs[5], docs[5]]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, line string").repartition(4)
    rows = lines.drop_lines(frame).collect()

    def key(i, x):
        return (i is not None, i or 0), lines.text_hash((x or "").encode())

    all_ = sorted({(*key(i, x), k, y) for i, x in docs for k, y in lines.document_lines(x or "")})
    own = groups(sorted({o[3] for o in all_}), lambda a, b: abs(len(a) - len(b)) <= 2 and edits(a, b) <= 2)
    seen, lost = set(), {}
    for o in all_:
        if own[o[3]] in seen:
            lost.setdefault(o[:2], set()).add(o[2])
        seen.add(own[o[3]])
    want = sorted((key(i, x)[0], "\n".join(y for k, y in enumerate((x or "").split("\n")) if k not in lost.get(key(i, x), ()))) for i, x in docs)
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.text or "") for r in rows) == want
    assert set(frame.columns) < set(rows[0].asDict()) and lines.line_dedup(frame.limit(0)).count() == 0


def test_short_lines(spark):
    """Short lines go if an earlier one is equal, in op6 and in the pipeline; empty ones and near copies stay."""
    import hashlib

    import corpus_pipeline as p

    docs = [(1, "Read more\n\nPrivacy Policy\nonly here"), (2, " Read more \n\nRead mere\nPrivacy Policy\nPrivacy Policy\nx"), (3, "x\nRead more\na line that is long enough"), (4, "Read more"), (5, None)]
    want = {1: docs[0][1], 2: "\nRead mere\nx", 3: "a line that is long enough", 4: "", 5: ""}
    frame = spark.createDataFrame([(*d, "en", "s", 1) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in lines.line_dedup(frame).collect()}
    assert got == {i: ((x or "").count("\n") + 1, n, hashlib.sha256(want[i].encode()).hexdigest()) for (i, x), n in zip(docs, (0, 3, 2, 1, 0))}
    assert {r.doc_id: r.text or "" for r in p.dedup_lines(spark, frame, "").collect()} == {i: x for i, x in want.items() if i != 4}


def test_one_row_of_each_group(spark):
    """Near-dedup of the pipeline keeps one row of each group, with null ids, repeated ids and equal rows."""
    import corpus_pipeline as p

    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    docs = [(None, a), (None, a), (2, a), (2, a), (3, a.upper()), (None, b), (None, b), (None, b.upper()), (5, c), (5, c), (5, d), (6, c), (7, None), (None, ""), (8, "")]
    rows = [(i, x, "en", "s" if k % 2 else "r", k) for k, (i, x) in enumerate(docs)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = [tuple(r) for r in p.near_dedup(spark, frame, "").collect()]
    simhash.FILTER_BITS, kept = 1 << 15, simhash.FILTER_BITS  # a crowded filter lets more rows pass and decides the same
    assert sorted(map(repr, got)) == sorted(repr(tuple(r)) for r in p.near_dedup(spark, frame, "").collect())
    simhash.FILTER_BITS = kept
    assert all(r in rows for r in got) and len(got) == len(set(got))
    own = groups(sorted({plain_print(x or "") for _, x in docs}), lambda x, y: (x ^ y).bit_count() <= 4)
    want = {}
    for i, x in docs:
        want.setdefault(own[plain_print(x or "")], []).append((i is None, i or 0))
    assert sorted((i is None, i or 0) for i, *_ in got) == sorted(map(min, want.values())) and len({own[plain_print(r[1] or "")] for r in got}) == len(got)
    assert len(got) == 5 and p.near_dedup(spark, frame.limit(0), "").count() == 0


def test_pipeline(spark):
    import corpus_pipeline as p

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [docs]
    for name, stage in p.STAGES:
        seen.append(common.materialize(stage(spark, seen[-1], folder), name))
    assert all(x.columns == list(p.COLUMNS) for x in seen[1:-1])
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in seen]
    assert all(a >= b for a, b in zip(ids, ids[1:])) and ids[-1] == ids[-2]
    prints = [simhash.fingerprint(r.text.encode()) for r in seen[3].collect()]
    assert all((a ^ b).bit_count() > 4 for i, a in enumerate(prints) for b in prints[i + 1 :])
    packed = seen[-1].groupBy("sequence_id").sum("length").collect()
    assert all(r[1] <= 2048 for r in packed)
