"""Near duplicates and repeated passages against brute force."""

import random

import numpy as np
import pytest

from colpattern.llm import omh, substring
from colpattern.llm.common import hashed_words


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def test_banded_distance_is_the_edit_distance():
    rng = random.Random(1)
    for _ in range(3000):
        a = [rng.randrange(4) for _ in range(rng.randrange(0, 24))]
        b = list(a)
        for _ in range(rng.randrange(0, 7)):
            k = rng.randrange(3)
            at = rng.randrange(len(b) + 1)
            b = b[:at] + [rng.randrange(4)] + b[at + (k == 0) :] if k < 2 else b[:at] + b[at + 1 :]
        most, d = rng.randrange(0, 9), edits(a, b)
        assert omh.banded_distance(omh.positions(a), len(a), b, most) == (d if d <= most else most + 1)


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=3):
    """Documents, near copies of 1 to 12 % edited words, exact copies, one large group, short texts."""
    rng = random.Random(seed)
    out = []
    for _ in range(40):
        out.append(words(rng, rng.randrange(30, 200)))
    for base in out[:25]:
        for _ in range(rng.randrange(1, 4)):
            c = list(base)
            for _ in range(max(1, int(len(c) * rng.uniform(0.01, 0.12)))):
                c[rng.randrange(len(c))] = f"n{rng.randrange(9999)}"
            out.append(c)
    big = words(rng, 120)
    for _ in range(60):
        c = list(big)
        for _ in range(5):
            c[rng.randrange(len(c))] = f"n{rng.randrange(9999)}"
        out.append(c)
    out += [list(x) for x in out[:10]]
    head = words(rng, 9)
    out += [head + words(rng, rng.randrange(3, 14)) for _ in range(40)]
    rng.shuffle(out)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def brute_groups(rows, least):
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    w = [(i, t.split()) for i, t in rows]
    for k, (i, a) in enumerate(w):
        for j, b in w[:k]:
            most = omh.allowed(len(a), len(b), least)
            if find(i) != find(j) and abs(len(a) - len(b)) <= most and edits(a, b) <= most:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in rows}


def test_groups_match_brute_force(docs):
    rows = corpus()
    got = {r["doc_id"]: r["group_id"] for r in omh.groups(docs(rows)).collect()}
    want = brute_groups(rows, omh.LEAST)
    assert set(got) == set(want)
    pairs = [(i, j) for i in want for j in want if i < j and want[i] == want[j]]
    found = sum(got[i] == got[j] for i, j in pairs)
    assert found >= 0.97 * len(pairs)
    assert all(want[i] == want[g] for i, g in got.items())  # nothing that is not a copy


def bucket_groups(rows, least):
    """The groups when all pairs that share a sketch are compared."""
    import pyarrow as pa

    own, keys = {}, {}
    for i, j, w, first in hashed_words(pa.array([t for _, t in rows])):
        key, start = omh.bucket_keys(w, first)
        for r in range(j - i):
            own[rows[i + r][0]] = w[first[r] : first[r + 1]].tolist()
            for x in key[start[r] : start[r + 1]].tolist():
                keys.setdefault(x, []).append(rows[i + r][0])
    root = {i: i for i in own}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, y in {tuple(sorted((a, b))) for ids in keys.values() for k, a in enumerate(ids) for b in ids[:k]}:
        most = omh.allowed(len(own[x]), len(own[y]), least)
        if find(x) != find(y) and omh.banded_distance(omh.positions(own[x]), len(own[x]), own[y], most) <= most:
            a, b = sorted((find(x), find(y)))
            root[b] = a
    return {i: find(i) for i in own}


@pytest.mark.parametrize("few", [0, 4])
def test_every_pair_of_a_bucket_counts(docs, monkeypatch, few):
    """120 copies of a text with 2 to 19 % edits, which are not all close to one of them."""
    monkeypatch.setattr(omh, "PAIRS_A_ROW", few, raising=False)
    rng = random.Random(11)
    rows, base = [], words(rng, 200)
    ids = rng.sample(range(10**6), 120)
    for i in ids:
        c = list(base)
        for at in rng.sample(range(200), int(200 * rng.uniform(0.02, 0.19))):
            c[at] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(c)))
    got = {r["doc_id"]: r["group_id"] for r in omh.groups(docs(rows)).collect()}
    assert got == bucket_groups(rows, omh.LEAST)


@pytest.mark.parametrize("n", [5, 6, 8, 9, 10, 12, 14, 15, 16, 20, 30, 50, 100, 200, 500])
def test_close_pairs_share_a_bucket(n):
    """Recall of the keys in each band of similarity down to LEAST, for scattered edits of three kinds."""
    rng = np.random.default_rng(n)
    most = omh.allowed(n, n, omh.LEAST)
    for e in sorted({1, most, max(1, most // 2), max(1, most * 9 // 10)}):
        for kind in ("substituted", "mixed"):
            texts = []
            for _ in range(200):
                a = rng.integers(1, 2**63, n, dtype=np.uint64).tolist()
                b = list(a)
                if kind == "substituted":
                    for at in rng.choice(n, e, replace=False):
                        b[at] = int(rng.integers(1, 2**63))
                for _ in range(e if kind == "mixed" else 0):
                    way, at = rng.integers(3), int(rng.integers(len(b)))
                    if way == 0:
                        b[at] = int(rng.integers(1, 2**63))
                    elif way == 1 or len(b) >= n:
                        b.pop(at)
                    else:
                        b.insert(at, int(rng.integers(1, 2**63)))
                texts += [a, b]
            first = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
            keys, start = omh.bucket_keys(np.concatenate([np.array(x, np.uint64) for x in texts]), first)
            own = [set(keys[start[i] : start[i + 1]].tolist()) for i in range(len(texts))]
            recall = sum(bool(x & y) for x, y in zip(own[::2], own[1::2], strict=True)) / 200
            assert recall >= (1 if n <= omh.short_words(omh.LEAST) else 0.9), (e, kind)


def test_short_copies_match_brute_force(docs):
    """Texts of 4 to 14 words with few edits: none may be missed."""
    rng = random.Random(8)
    rows = []
    for n in range(4, 15):
        for _ in range(12):
            base = words(rng, n)
            rows.append(base)
            c = list(base)
            for _ in range(omh.allowed(n, n, omh.LEAST)):
                at = rng.randrange(len(c))
                c[at : at + rng.randrange(2)] = [f"n{rng.randrange(9999)}"] if rng.random() < 0.6 or len(c) < n else []
            rows.append(c[:n])
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    got = {r["doc_id"]: r["group_id"] for r in omh.groups(docs(rows)).collect()}
    assert got == brute_groups(rows, omh.LEAST)


def test_slices_and_thresholds(spark, docs):
    rows = [(i, " ".join([f"a{k}" for k in range(40)] + [f"z{i}"])) for i in range(20)]
    edges = spark.createDataFrame([(0, i) for i in range(1, 20)], "a long, b long")
    assert omh.verify(docs(rows), edges, slice_rows=3).count() == 19
    assert omh.verify(docs(rows), edges, least=0.99).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100, 90), (90, 95)]
    got = {r["id"]: r["root"] for r in omh.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {90: 90, 95: 90, 100: 90}
    assert omh.components(spark.createDataFrame([], "a long, b long")).count() == 0
    with pytest.raises(RuntimeError):
        omh.components(spark.createDataFrame(chain, "a long, b long"), rounds=1)


def test_near_duplicates_odd_cases(docs, odd):
    df = docs(odd)
    got = {r["doc_id"]: (r["group_id"], r["keep"]) for r in omh.groups(df).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (3, True), 4: (4, True), 5: (5, True), 6: (6, True), 7: (7, True), 8: (7, False), 9: (9, True)}
    kept = omh.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=lambda x: x or 0) == [None, 1, 2, 3, 4, 5, 6, 7, 9]
    apart = [(3, "one text under an id"), (3, "another text under it"), (3, "another text under it"), (5, "another text under it")]
    kept = omh.drop_near_duplicates(docs(apart)).select("doc_id", "text").collect()
    assert sorted(map(tuple, kept)) == [(3, "another text under it"), (3, "one text under an id")]
    assert sorted(map(tuple, substring.drop_repeats(docs(apart)).select("doc_id", "text").collect())) == sorted(set(apart))
    assert omh.groups(docs([])).count() == 0
    assert omh.drop_near_duplicates(docs([])).count() == 0


# ------------------------------------------------ repeated passages
def test_cover():
    assert substring.is_cover(substring.PERIOD, substring.COVER)
    assert not substring.is_cover(31, (1, 2, 3))


def covered(rows, least):
    """{doc_id: words that lie in a window of `least` words which stands in a smaller document}."""
    seen, out = {}, {}
    for i, t in sorted(rows):
        w = t.split()
        own = [tuple(w[p : p + least]) for p in range(len(w) - least + 1)]
        hit = {q for p, x in enumerate(own) if x in seen for q in range(p, p + least)}
        if hit:
            out[i] = hit
        for x in own:
            seen.setdefault(x, i)
    return out


def passages(seed, n=40):
    rng = random.Random(seed)
    shared = [words(rng, k, 10**6) for k in (50, 51, 55, 64, 80, 120, 49, 30)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts += words(rng, rng.randrange(0, 70), 10**6)
            if rng.random() < 0.7:
                s = rng.choice(shared)
                parts += s
        out.append(parts)
    out.append(list(out[0]))
    return [(i, " ".join(w)) for i, w in enumerate(out)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_spans_match_brute_force(docs, seed):
    rows = passages(seed)
    got = {}
    texts = {i: t.split() for i, t in rows}
    for r in substring.spans(docs(rows)).collect():
        assert r["src_doc_id"] < r["doc_id"] and r["n_words"] >= substring.LEAST
        a, b = texts[r["doc_id"]], texts[r["src_doc_id"]]
        assert a[r["start_word"] : r["start_word"] + r["n_words"]] == b[r["src_start_word"] : r["src_start_word"] + r["n_words"]]
        got.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["start_word"] + r["n_words"]))
    assert got == covered(rows, substring.LEAST)


def test_dropping_keeps_the_first_copy(docs):
    rows = passages(5)
    kept = {r["doc_id"]: r for r in substring.drop_repeats(docs(rows)).collect()}
    gone = covered(rows, substring.LEAST)
    for i, t in rows:
        want = " ".join(w for k, w in enumerate(t.split()) if k not in gone.get(i, ()))
        assert (" ".join(kept[i]["text"].split()) if i in kept else "") == want
        if i in kept:
            assert kept[i]["n_chars"] == len(kept[i]["text"])


def test_repeats_odd_cases(docs, odd):
    passage = " ".join(f"p{i}" for i in range(60))
    df = docs([*odd, (10, passage), (11, "before it " + passage + " behind it"), (12, passage), (13, "And " * 500)])
    spans = substring.spans(df).collect()
    assert sorted((r["doc_id"], r["start_word"], r["n_words"], r["src_doc_id"]) for r in spans) == [(11, 2, 60, 10), (12, 0, 60, 10)]
    kept = {r["doc_id"]: r["text"] for r in substring.drop_repeats(df).collect()}
    assert kept[11] == "before it behind it" and 12 not in kept and kept[13] == "And " * 500
    assert kept[1] is None and kept[2] == "" and None in kept and kept[5] == odd[5][1]
    assert substring.drop_repeats(df).columns == df.columns
    assert substring.spans(docs([])).count() == 0 and substring.drop_repeats(docs([])).count() == 0
    with pytest.raises(ValueError):
        substring.spans(df, cover=(1, 2, 3))


def test_hot_passages(docs, monkeypatch):
    """A passage that every document holds twice, its hashes taken for hot and not; others are shared by few."""
    hot, rare = (" ".join(f"{c}{i}" for i in range(60)) for c in "pq")
    rows = [(i, f"{hot} only{i} {hot}" + (f" and {i} {rare}" if i in (3, 9, 27) else "")) for i in range(30)]
    want = sorted(map(tuple, substring.spans(docs(rows)).collect()))
    found = []
    plain = substring._hot
    monkeypatch.setattr(substring, "HOT_SAMPLE", 1)
    monkeypatch.setattr(substring, "HOT_ROWS", 20)
    monkeypatch.setattr(substring, "_hot", lambda rows: found.append(plain(rows)) or found[-1])
    assert sorted(map(tuple, substring.spans(docs(rows)).collect())) == want
    assert len(found) == 2 and all(len(h.hashes) for h in found) and found[1].salts > 1
    got = {}
    for i, start, n, *_ in want:
        got.setdefault(i, set()).update(range(start, start + n))
    assert got == covered(rows, substring.LEAST)


def test_passage_over_many_batches():
    """A group that reaches over batches, its first document alone in several of them."""
    import numpy as np

    def batches():
        for doc in ([1, 1], [1, 1], [1, 2], [2, 3]):
            yield substring.batch(substring._PLACE, np.full(2, 7, np.int64), np.zeros(2, np.int32), np.array(doc, np.int64), np.arange(2, dtype=np.int32))
        yield substring.batch(substring._PLACE, np.full(2, 8, np.int64), np.zeros(2, np.int32), np.array([5, 5], np.int64), np.arange(2, dtype=np.int32))

    assert sum(b.num_rows for b in substring._shared(batches())) == 8
    rows = [r for b in substring._repeated(batches()) for r in b.to_pylist()]
    assert [(r["doc_id"], r["src"]) for r in rows] == [(2, 1), (2, 1), (3, 1)]
