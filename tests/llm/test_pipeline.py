"""The pipeline and the packing query against plain Python versions, on a small corpus."""

import hashlib
import itertools
import random
from collections import Counter

import pytest
from test_dedup import brute_groups, covered

import corpus_pipeline
from colpattern.llm import curriculum, langid, omh, packing, substring
from colpattern.llm.tokens import TOKENIZER, count_udf


# ------------------------------------------------ plain versions of the stages; docs: [(doc_id, text, lang, source)]
def grams(t):
    s = "".join(c.lower() if c.isalpha() else " " for c in t)
    return [s[i : i + 4] for i in range(len(s) - 3) if "  " not in s[i : i + 4]]


def plain_language(docs):
    known = {}
    for _, t, lang, _ in docs:
        if lang:
            known.setdefault(lang, set()).update(grams(t))
    out = []
    for d in docs:
        own = grams(d[1])
        rates = [sum(g in k for g in own) / len(own) for k in known.values()] if own else [0]
        assert not 0.2 < max(rates) < 0.3  # chance hits of the filters don't decide
        if max(rates) >= langid.MIN_RATE:
            out.append(d)
    return out


def plain_near_duplicates(docs):
    groups = brute_groups([d[:2] for d in docs], omh.LEAST)
    return [d for d in docs if groups[d[0]] == d[0]]


def plain_repeats(docs):
    gone = covered([d[:2] for d in docs], substring.LEAST)
    out = []
    for i, t, *rest in docs:
        left = " ".join(w for k, w in enumerate(t.split()) if k not in gone.get(i, ()))
        if left or i not in gone:
            out.append((i, left if i in gone else t, *rest))
    return out


def plain_mixture(docs):
    grid, temper = curriculum.GRID, curriculum.TEMPER
    supply = Counter()
    for _, t, _, s in docs:
        supply[s] += len(t.split())
    everything = sum(supply.values())
    raw = {s: [(n / everything) ** p for p in temper] for s, n in supply.items()}
    weight = {s: [r[k] / sum(x[k] for x in raw.values()) for k in range(len(grid))] for s, r in raw.items()}

    def area(w, t):
        out = 0
        for k in range(len(grid) - 1):
            x = min(max(t - grid[k], 0), grid[k + 1] - grid[k])
            out += x * (w[k] + (w[k + 1] - w[k]) * x / (grid[k + 1] - grid[k]) / 2)
        return out

    total = max(n / area(weight[s], 1) for s, n in supply.items())
    out = []
    for s in supply:
        before = 0
        for d in sorted((d for d in docs if d[3] == s), key=lambda d: hashlib.md5(str(d[0]).encode()).hexdigest()):
            epoch = 0
            while epoch == 0 or (before + epoch * supply[s]) / total < area(weight[s], 1) - 1e-9:
                lo, hi = 0.0, 1.0
                for _ in range(60):
                    mid = (lo + hi) / 2
                    lo, hi = (mid, hi) if area(weight[s], mid) < (before + epoch * supply[s]) / total else (lo, mid)
                out.append((round(lo, 9), d[0], epoch, d))
                epoch += 1
            before += len(d[1].split())
    return [x[3] for x in sorted(out, key=lambda x: x[:3])]


def plain_pieces(docs, tokens):
    out = []
    for at, d in enumerate(docs):
        total, piece = tokens[d[1]] + 1, 0
        while total > 0:
            out.append((at, d[0], piece, min(total, packing.MAX_LEN)))
            total, piece = total - packing.MAX_LEN, piece + 1
    return out


def bins(n):
    return -(-n // packing.STEP)


def starts(put):
    out, at = [], Counter()
    for pack, slot, doc, piece, n in sorted(put):
        out.append((pack, slot, at[pack], doc, piece, n))
        at[pack] += n
    return out


def plain_packs(docs, tokens):
    """Packs that follow the order of docs."""
    all_ = plain_pieces(docs, tokens)
    plan = packing.plan(Counter(bins(x[3]) for x in all_), packing.MAX_LEN // packing.STEP)
    free, first = {}, 0
    for p, r in plan:
        for k in range(r):
            for slot, b in enumerate(p):
                free.setdefault(b, []).append(((k + 0.5) / r, first + k, slot))
        first += r
    put = []
    for b, own in free.items():
        have = sorted(x for x in all_ if bins(x[3]) == b)
        assert len(have) == len(own)
        have.sort(key=lambda x: (x[0], x[2]))
        put += [(pack, slot, x) for (_, pack, slot), x in zip(sorted(own), have, strict=True)]
    places = {}
    for pack, _, x in put:
        places.setdefault(pack, []).append(x[0])
    new = {pack: k for k, pack in enumerate(sorted(places, key=lambda p: (sum(places[p]) / len(places[p]), p)))}
    return starts((new[pack], slot, x[1], x[2], x[3]) for pack, slot, x in put)


def plain_packs_by_id(docs, tokens):
    all_ = plain_pieces(docs, tokens)
    plan = packing.plan(Counter(bins(x[3]) for x in all_), packing.MAX_LEN // packing.STEP)
    waiting = {}
    for x in sorted(all_, key=lambda x: (x[1], x[2])):
        waiting.setdefault(bins(x[3]), []).append(x)
    put, pack = [], 0
    for p, r in plan:
        for _ in range(r):
            put += [(pack, slot, *waiting[b].pop(0)[1:]) for slot, b in enumerate(p)]
            pack += 1
    assert not any(waiting.values())
    return starts(put)


# ------------------------------------------------ the corpus
STEMS = {"en": "the house garden water light where under river thing people mother always", "de": "das haus garten wasser licht wo unter fluss ding leute mutter immer"}


def corpus(seed=9):
    rng = random.Random(seed)

    def text(n, lang):
        return [rng.choice(STEMS[lang].split()) + rng.choice(["", "s", "ing", "er", "lich"]) + "".join(rng.choice("abcdeimnorst") for _ in range(3)) for _ in range(n)]

    passage = text(70, "en")
    out = []
    for k in range(44):
        lang = "en" if k % 3 else "de"
        w = text(rng.randrange(20, 160), lang)
        if k % 6 == 1:
            at = rng.randrange(len(w))
            w[at:at] = passage
        out.append((w, lang, "abc"[k % 3] if k % 5 else None))
    out.append((text(2600, "en"), "en", "a"))
    out.append(([], "en", "b"))
    for w, lang, source in out[:12]:
        c = list(w)
        for at in rng.sample(range(len(c)), len(c) // 25):
            c[at] = "anders" + "".join(rng.choice("abcdeimnorst") for _ in range(4))
        out.append((c, lang, rng.choice("abc")))
    out += [(["".join(rng.choice("qxzjkvw") for _ in range(6)) for _ in range(40)], None, "c") for _ in range(5)]
    rng.shuffle(out)
    out.append((passage, "en", "b"))  # nothing of it is left, as others came before
    return [(i, " ".join(w), lang, s) for i, (w, lang, s) in enumerate(out)]


@pytest.fixture
def one_partition(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", was)


def counted(spark, texts):
    df = spark.createDataFrame([(t,) for t in set(texts)], "t string")
    return {r["t"]: r["n"] for r in df.select("t", count_udf(TOKENIZER)("t").alias("n")).collect()}


# ------------------------------------------------ tests
def test_pipeline_matches_plain_python(spark, docs, one_partition, tmp_path):
    rows = corpus()
    docs(rows).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    want, sizes = rows, [len(rows)]
    for stage in (plain_language, plain_near_duplicates, plain_repeats, plain_mixture):
        want = stage(want)
        sizes.append(len(want))
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] < sizes[4]  # each stage has something to do
    got = corpus_pipeline.run(spark, str(tmp_path)).select("pack_id", "slot", "start", "doc_id", "piece", "n_tokens").collect()
    assert sorted(map(tuple, got)) == plain_packs(want, counted(spark, [d[1] for d in want]))


def test_packing_matches_plain_python(spark, docs):
    rows = corpus(4)
    got = packing.pack(docs(rows)).select("pack_id", "slot", "start", "doc_id", "piece", "n_tokens").collect()
    assert sorted(map(tuple, got)) == plain_packs_by_id(rows, counted(spark, [d[1] for d in rows]))


def fewest(lengths, size):
    """The least number of packs, by trying all ways."""
    best = len(lengths)

    def place(k, loads):
        nonlocal best
        if len(loads) >= best:
            return
        if k == len(lengths):
            best = len(loads)
            return
        for x in sorted(set(loads)):
            if x + lengths[k] <= size:
                at = loads.index(x)
                place(k + 1, [*loads[:at], x + lengths[k], *loads[at + 1 :]])
        place(k + 1, [*loads, lengths[k]])

    place(0, [])
    return best


def test_plans_are_near_the_fewest_packs():
    rng = random.Random(5)
    extra = []
    for _ in range(60):
        lengths = sorted((rng.randrange(1, 13) for _ in range(9)), reverse=True)
        packs = sum(r for _, r in packing.plan(Counter(lengths), 12))
        extra.append(packs - fewest(lengths, 12))
    assert min(extra) >= 0 and max(extra) <= 1 and sum(extra) <= 12


def test_fewest():
    assert fewest([5, 4, 3], 12) == 1 and fewest([7, 6, 5, 5], 12) == 2
    assert all(fewest(sorted(p, reverse=True), 4) == len(p) for p in itertools.product([3, 4], repeat=3))
