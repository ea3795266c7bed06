"""Language, quality and URL filters: held-out accuracy, known parameters, SQL."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from colpattern.llm import langid, urls, weak

SF = "/root/testdata/sf0.01"


# ------------------------------------------------ language
def test_held_out_languages(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(d.where("doc_id % 2 = 0"), per_lang=40)
    rows = langid.identify(d.where("doc_id % 2 = 1"), model).join(d.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_id"] for r in rows]) >= 0.99
    assert np.mean([r["keep"] for r in rows]) >= 0.99


def test_masks_hold_all_languages_of_a_gram():
    a, b = np.arange(100, dtype=np.uint32), np.arange(50, 150, dtype=np.uint32)
    m = langid.Model(["x", "y"], [a, b], slot_bits=12)
    got = m.masks(np.arange(150, dtype=np.uint32))
    assert all(got[i] & 1 for i in range(100)) and all(got[i] & 2 for i in range(50, 150))
    far = m.masks(np.arange(10_000, 60_000, dtype=np.uint32))
    for k in range(2):  # what the correction takes off is what the filter really lets through
        assert np.mean((far >> k) & 1) == pytest.approx(m.false[k], rel=0.3)
    many = langid.Model([str(i) for i in range(130)], [a + 1000 * i for i in range(130)], slot_bits=18)
    assert len(many.slots) == 3
    for i in (0, 63, 64, 129):
        assert all((many.masks(a + 1000 * i, i // 64) >> np.uint64(i % 64)) & np.uint64(1))


def test_decisions_match_sets():
    """The classification against sets of n-grams: rates differ by no more than chance hits do."""
    texts = ["the house and the garden are here", "das haus und der garten sind hier", "la casa y el jardin", "the garten sind hier", "zzz", None, ""]
    data, off = langid.buffers(pa.array(texts))
    g, first = langid.grams_of(data, off)
    own = [set(g[first[i] : first[i + 1]].tolist()) for i in range(3)]
    model = langid.Model(["de", "en", "es"], [np.array(sorted(own[i]), np.uint32) for i in (1, 0, 2)])
    best, rate, total = model.classify(pa.array(texts))
    for i in range(len(texts)):
        grams = g[first[i] : first[i + 1]].tolist()
        rates = [sum(x in own[j] for x in grams) / max(1, len(grams)) for j in (1, 0, 2)]
        assert total[i] == len(grams) and rate[i] == pytest.approx(max(rates), abs=0.01)
        assert best[i] == (int(np.argmax(rates)) if max(rates) > 0 else -1)


def test_grams_stay_inside_their_texts():
    data, off = langid.buffers(pa.array(["abcd", "ef", None, "GH ij", "É", ""]))
    g, first = langid.grams_of(data, off)
    assert np.diff(first).tolist() == [1, 0, 0, 2, 0, 0]
    assert g[1].tobytes() == b"gh i"


def test_language_odd_cases(docs, odd):
    rows = [*odd, (20, "the house and the garden are here " * 3, "en"), (21, "das haus und der garten sind hier " * 3, "de"), (22, "!!! 123 ???", "en"), (23, "zzqqxxyyvv kkjjwwpp", None)]
    df = docs(rows)
    model = langid.train(df.where("doc_id in (20, 21)"))
    got = {r["doc_id"]: r for r in langid.identify(df, model).collect()}
    assert (got[20]["lang_id"], got[21]["lang_id"]) == ("en", "de") and got[20]["keep"]
    assert [got[i]["lang_id"] for i in (1, 2, 3, 22)] == ["und"] * 4 and not got[22]["keep"] and not got[23]["keep"]
    kept = langid.keep_identified(df, model)
    assert kept.columns == df.columns and {20, 21} <= {r["doc_id"] for r in kept.collect()}
    assert langid.identify(docs([])).count() == 0 and langid.keep_identified(docs([])).count() == 0
    assert {r["lang_id"] for r in langid.identify(docs([(1, "some text", None)])).collect()} == {"und"}


# ------------------------------------------------ quality
def test_quality_follows_the_labels(spark):
    d, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = weak.score(d).join(labels, "doc_id").collect()
    good, bad = ([r["keep"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean(good) >= 0.98 and 1 - np.mean(bad) >= 0.8


def simulated(n, prior, labellers, seed):
    """(truth, votes) of labellers (how it votes on bad, on good documents: abstain, bad, good)."""
    rng = np.random.default_rng(seed)
    y = rng.random(n) < prior
    v = np.zeros((n, len(weak.LABELLERS)), np.int64)
    for j, (bad, good) in enumerate(labellers):
        v[:, j] = np.where(y, rng.choice(3, n, p=good), rng.choice(3, n, p=bad))
    return y, v


def held_against_truth(y, v, within):
    codes, counts = np.unique(weak.code(v), return_counts=True)
    post, prior, prob = weak.em(codes, counts)
    assert prior == pytest.approx(y[(v != weak.ABSTAIN).any(1)].mean(), abs=within)
    got = weak.accuracies(prob, prior)
    for j in range(v.shape[1]):
        if (v[:, j] != weak.ABSTAIN).any():
            right = ((v[:, j] == weak.GOOD) & y) | ((v[:, j] == weak.BAD) & ~y)
            assert got[j] == pytest.approx(right.sum() / (v[:, j] != weak.ABSTAIN).sum(), abs=within), j
    code = weak.code(v)
    for c in codes[(counts > 1000) & (codes > 0)]:
        assert post[np.searchsorted(codes, c)] == pytest.approx(y[code == c].mean(), abs=within)


@pytest.mark.parametrize(("prior", "seed"), [(0.6, 0), (0.6, 1), (0.8, 2), (0.4, 3)])
def test_em_estimates_a_coin_flip(prior, seed):
    """Four labellers that are right in 94 % of their votes, and one that votes bad by the toss of a coin."""
    able = ([0.5, 0.47, 0.03], [0.5, 0.03, 0.47])
    y, v = simulated(100_000, prior, [able] * 4 + [([0.5, 0.5, 0], [0.5, 0.5, 0])], seed)
    held_against_truth(y, v, 0.05)


def test_em_estimates_one_sided_labellers():
    """Each knows one defect; three of them also say what is fine, one of these badly."""
    defect = ([0.6, 0.4, 0], [0.997, 0.003, 0])
    y, v = simulated(100_000, 0.8, [defect] * 4 + [([0.3, 0.6, 0.1], [0.1, 0.02, 0.88]), ([0.5, 0.3, 0.2], [0.3, 0.05, 0.65]), ([0.4, 0.2, 0.4], [0.4, 0.1, 0.5])], 5)
    held_against_truth(y, v, 0.05)


def test_votes():
    t = pa.array(["Plain words stand here. They end in full stops, as they should. " * 4, "no*** one### reads$$$ this%%% " * 20, "SHOUT!! AND!! SHOUT!! MORE!! THAN!! ANY!! ONE!! " * 4, "again again again again again again again again again again again again ", "", None])
    data, off = weak.buffers(t)
    v = weak.votes(weak._Texts(data, off))
    assert weak.BAD not in v[0][[0, 1, 4, 6, 7]] and v[1, 0] == v[2, 1] == v[2, 7] == v[3, 3] == weak.BAD
    assert not v[4].any() and not v[5].any()
    assert (weak.decode(weak.code(v)) == v).all()


def test_quality_odd_cases(docs, odd):
    got = weak.score(docs(odd))
    assert got.count() == len(odd) and got.where("score is null or keep is null").count() == 0
    assert weak.score(docs([])).count() == 0


# ------------------------------------------------ URLs
CASES = [("https://www.casino-win.example.org/en/14", False), ("http://casinos.example.org", True), ("http://a.org/leads/trackers", True), ("http://ads-track.example.org", False), ("http://ads.example.org/ads/ads", True), ("HTTP://X.ORG/CHEAP/PILLS", False), ("http://x.org/free%20win", False), ("", True), (None, True), ("ads", True), ("http://ücasino.org", False), ("http://x.org/PIL\u212a/\u212aeygen/c\u212aick", True), ("http://x.org/" + "a" * 100_000 + "/casino", False)]


def test_url_cases():
    a = urls.automaton(urls.STRICT, urls.SOFT)
    for url, keep in CASES:
        hard, _, soft = urls.count(url, a)
        assert (hard < urls.STRICT_HITS and soft < urls.SOFT_TERMS) == keep or "%20win" in (url or ""), url
    with pytest.raises(ValueError):
        urls.automaton(["a-b"], [])


def test_vocabulary_files(tmp_path):
    (tmp_path / "terms").write_text("# terms\nbad strict\n\nso soft # a comment\n")
    assert urls.load(tmp_path / "terms") == (("bad",), ("so",))
    (tmp_path / "terms").write_text("bad mild\n")
    with pytest.raises(ValueError):
        urls.load(tmp_path / "terms")
    assert len(urls.STRICT) > 30 and len(urls.SOFT) > 40 and not set(urls.STRICT) & set(urls.SOFT)


def test_urls_match_sql(spark):
    rows = [(i, u, "h", True) for i, (u, _) in enumerate(CASES)] + [(None, "http://casino.org", "h", True), (3, "http://ads-track.example.org", "h", False)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, keep boolean")
    con = duckdb.connect()
    con.register("pages", pages.select("page_id", "url").toPandas())
    want = con.execute(urls.judge_sql()).fetchall()
    got = [tuple(r) for r in urls.judge(pages).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1]))
    clean = lambda r: (None if r[0] is None or r[0] != r[0] else int(r[0]), *r[1:])
    assert sorted(got, key=key) == sorted(map(clean, want), key=key)
    assert urls.judge(pages.limit(0)).count() == 0
    assert urls.judge(pages, strict=[], soft=[]).where("not keep").count() == 0
