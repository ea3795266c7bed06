"""Quality classifier from weak labels: heuristics, EM over their accuracies, a hashed linear scorer.

1. Eight overlapping heuristics vote good, bad or abstain on each document (`votes`). Four of them
   (symbols, capitals, lags, prose) also say what is good; each defect is seen by two at least.
2. Votes are a small code, so the corpus is summed up as counts per code (at most 3**8 rows,
   whatever its size). Expectation-maximisation on these counts estimates the share of good
   documents and, for each heuristic and class, how often it votes what, hence how accurate it is. Each code
   then has a posterior probability of being good. All documents count.
3. The posteriors of a bounded sample (`sample` documents, those with the smallest id hash) are
   the soft labels of a logistic regression on hashed features: byte trigrams and words that
   recur at short distances. The scorer is one weight per bucket, so scoring a document is a
   gather and a sum, over its whole text.

Defined results: a text that is null or has no words has no votes and no features: its posterior is
the prior and it is scored by the bias alone; rows with a null doc_id are scored but don't
train; repeated rows are scored alike. If no heuristic ever votes, everything is kept. An
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colpattern.llm.common import batch, buffers, cut, maybe_broadcast, mix, row_ranges, text_of, tidy, tidy_udf, word_bounds, word_hashes

#: Most documents that train the scorer.
SAMPLE = 4096
#: log2 of the scorer's weights.
BUCKET_BITS = 16
#: A document is kept from this score on.
KEEP = 0.5
#: Trigrams that a text counts as having beside its own, which say nothing: short texts score near the bias.
CALM = 64
#: Distances at which a recurring word is a feature.
LAGS = 8
LABELLERS = ("symbols", "capitals", "bigrams", "lags", "word_length", "prose", "bars", "shouting")
ABSTAIN, BAD, GOOD = 0, 1, 2

_KIND = np.zeros(256, np.uint8)  # 0 other
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[128:] = 1
for _c in b"#$%&*<>{}[]\\^~_=+@/|":
    _KIND[_c] = 3
for _c in b".!?":
    _KIND[_c] = 4
_KINDS = 5


class _Texts:
    """A chunk of texts: bytes, words and sums over each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.starts, self.ends = word_bounds(data, offsets)
        self.first = np.searchsorted(self.starts, offsets)
        self.words = np.diff(self.first)
        self.hash = word_hashes(data, self.starts, self.ends)
        self.row = np.repeat(np.arange(len(self.words)), self.words)

    def per_row(self, x: np.ndarray, row: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=x, minlength=len(self.words))

    def recurring(self, lag: int) -> np.ndarray:
        """For each word: whether the word `lag` before it in its row is the same."""
        out = np.zeros(len(self.hash), bool)
        if lag < len(out):
            out[lag:] = (self.hash[lag:] == self.hash[:-lag]) & (self.row[lag:] == self.row[:-lag])
        return out


def votes(t: _Texts) -> np.ndarray:
    """[rows, labellers] of ABSTAIN, BAD, GOOD."""
    rows = len(t.words)
    n_bytes = np.diff(t.offsets)
    kinds = np.zeros((rows, _KINDS))
    for k in range(1, _KINDS):
        sums = np.concatenate([[0], np.cumsum(_KIND[t.data] == k)])
        kinds[:, k] = sums[t.offsets[1:]] - sums[t.offsets[:-1]]
    words, size = np.maximum(t.words, 1), np.maximum(n_bytes, 1)
    letters = np.maximum(kinds[:, 1] + kinds[:, 2], 1)
    pairs = mix(t.hash[:-1] * np.uint64(3) + t.hash[1:])[t.row[:-1] == t.row[1:]] if len(t.hash) > 1 else np.zeros(0, np.uint64)
    pair_row = t.row[:-1][t.row[:-1] == t.row[1:]] if len(t.hash) > 1 else np.zeros(0, np.int64)
    bits = np.uint64(max(1, rows.bit_length()))
    key = np.sort((pair_row.astype(np.uint64) << (np.uint64(64) - bits)) | (pairs >> bits))
    again = np.concatenate([[False], key[1:] == key[:-1]]) if len(key) else np.zeros(0, bool)
    repeated = np.bincount((key >> (np.uint64(64) - bits)).astype(np.int64), weights=again, minlength=rows) / words
    lagged = np.zeros(len(t.hash), bool)
    for lag in range(1, LAGS + 1):
        lagged |= t.recurring(lag)
    lagged = t.per_row(lagged, t.row) / words
    bars = np.concatenate([[0], np.cumsum(t.data == ord("|"))])
    shouts = np.concatenate([[0], np.cumsum(t.data == ord("!"))])
    per_word = [(x[t.offsets[1:]] - x[t.offsets[:-1]]) / words for x in (bars, shouts)]
    length = n_bytes / words
    ends = kinds[:, 4] / words

    def vote(bad: np.ndarray, good: np.ndarray | bool = False) -> np.ndarray:
        return np.where(bad, BAD, np.where(good, GOOD, ABSTAIN))

    out = np.stack(
        [
            vote(kinds[:, 3] / size > 0.02, (kinds[:, 3] / size < 0.005) & (words >= 3)),
            vote((kinds[:, 2] / letters > 0.3) & (letters >= 20), (kinds[:, 2] / letters < 0.15) & (letters >= 10)),
            vote((repeated > 0.4) & (words >= 20)),
            vote((lagged > 0.6) & (words >= 10), (lagged < 0.3) & (words >= 3)),
            vote((length < 2.5) | (length > 14)),
            vote((ends < 0.005) & (words >= 60), (ends > 0.02) & (ends < 0.35) & (kinds[:, 3] / size < 0.02) & (lagged < 0.3) & (kinds[:, 2] / letters < 0.2)),
            vote(per_word[0] > 0.05),
            vote(per_word[1] > 0.3),
        ],
        axis=1,
    )
    out[t.words == 0] = ABSTAIN
    return out


def code(v: np.ndarray) -> np.ndarray:
    return v @ 3 ** np.arange(v.shape[1])


def decode(codes: np.ndarray) -> np.ndarray:
    return np.asarray(codes)[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


#: What a labeller is taken to do before its votes are counted: abstain, vote bad, vote good on documents that
#: are bad, good. And the share of good documents at first.
HINT, PRIOR = ((0.5, 0.3, 0.2), (0.4, 0.05, 0.55)), 0.7
#: Documents that the hint counts as in each class.
HINT_WEIGHT = 2.0


def em(codes: np.ndarray, counts: np.ndarray, rounds: int = 2000, tolerance: float = 1e-7) -> tuple[np.ndarray, float, np.ndarray]:
    """(posterior of good for each code, prior, vote probabilities [labeller, class, vote]).

    Most labellers know one defect and abstain without it, so an abstention is an outcome like the
    votes. Nothing holds a labeller to be right: the vote probabilities are what the counts say. The
    hint, from which the rounds start and which counts as HINT_WEIGHT documents, only says which of the two
    classes is the good one and keeps probabilities inside (0, 1). Where none votes, the prior stands."""
    v = decode(codes)
    voted = (v != ABSTAIN).any(1)
    n = np.asarray(counts, float) * voted
    hint = np.array(HINT)
    prob = np.repeat(hint[None], v.shape[1], 0)
    prior, post = PRIOR, np.full(len(v), PRIOR)
    for _ in range(rounds):
        log = np.log([1 - prior, prior])[None, :].repeat(len(v), 0)
        for j in range(v.shape[1]):
            log += np.log(prob[j][:, v[:, j]]).T
        new = np.where(voted, 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500))), prior)
        done = np.abs(new - post).max(initial=0) < tolerance
        post = new
        if done or not n.sum():
            break
        prior = float(np.clip((n * post).sum() / n.sum(), 0.01, 0.99))
        for j in range(v.shape[1]):
            tally = np.stack([np.bincount(v[:, j], weights=w, minlength=3) for w in (n * (1 - post), n * post)])
            tally += HINT_WEIGHT * hint
            prob[j] = tally / tally.sum(1, keepdims=True)
    return post, prior, prob


def accuracies(prob: np.ndarray, prior: float) -> np.ndarray:
    """How often each labeller is right when it votes."""
    right = (1 - prior) * prob[:, 0, BAD] + prior * prob[:, 1, GOOD]
    return right / (right + (1 - prior) * prob[:, 0, GOOD] + prior * prob[:, 1, BAD])


# ------------------------------------------------ features
def features(t: _Texts, bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of the byte trigrams, their rows, [rows, LAGS] shares of words that recur at each
    distance). Trigrams that begin in a recurring word are left out: it counts as recurring only."""
    n = len(t.data)
    lagged, any_ = np.zeros((len(t.words), LAGS)), np.zeros(len(t.hash), bool)
    for lag in range(1, LAGS + 1):
        hit = t.recurring(lag)
        any_ |= hit
        lagged[:, lag - 1] = t.per_row(hit, t.row) / np.maximum(t.words, 1)
    if n < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), lagged
    g = t.data[: n - 2].astype(np.uint32) | t.data[1 : n - 1].astype(np.uint32) << np.uint32(8) | t.data[2:].astype(np.uint32) << np.uint32(16)
    g = (g * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    ok = np.ones(n, bool)
    hidden = np.zeros(n + 1, np.int8)
    hidden[t.starts[any_]] += 1
    hidden[t.ends[any_]] -= 1
    ok[np.cumsum(hidden[:-1], dtype=np.int8) > 0] = False
    ends = t.offsets[1:]
    for k in (1, 2):  # trigrams that would reach over the end of a text
        bad = ends - k
        ok[bad[bad >= t.offsets[:-1]]] = False
    at = np.flatnonzero(ok[: n - 2])
    return g[at].astype(np.int64), np.searchsorted(ends, at, "right"), lagged


def lag_buckets(bits: int = BUCKET_BITS) -> np.ndarray:
    return (np.arange(1, LAGS + 1) * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - bits)


def _chunks(texts: pa.Array):
    data, offsets = buffers(texts)
    for i, j in row_ranges(offsets):
        a = int(offsets[i])
        yield i, j, _Texts(data[a : int(offsets[j])], offsets[i : j + 1] - a)


def _vote(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("code", pa.int32())])
    for b in batches:
        for i, j, t in _chunks(b.column("text")):
            yield batch(schema, b.column("doc_id")[i:j], code(votes(t)).astype(np.int32))


def _sparse(bits: int):
    schema = pa.schema([("doc_id", pa.int64()), ("code", pa.int32()), ("bucket", pa.list_(pa.int32())), ("value", pa.list_(pa.float32()))])

    def run(batches):
        for b in batches:
            for i, j, t in _chunks(b.column("text")):
                g, gr, lagged = features(t, bits)
                size = t.per_row(np.ones(len(gr)), gr) + CALM
                key, n = np.unique(gr << bits | g, return_counts=True)
                value = n / size[key >> bits]
                r, k = np.nonzero(lagged)
                key, value = np.concatenate([key, r << bits | lag_buckets(bits)[k]]), np.concatenate([value, lagged[r, k]])
                order = np.argsort(key, kind="stable")
                key, value = key[order], value[order]
                row, bucket = key >> bits, key & ((1 << bits) - 1)
                off = pa.array(np.searchsorted(row, np.arange(j - i + 1)), pa.int32())
                yield batch(schema, b.column("doc_id")[i:j], code(votes(t)).astype(np.int32), pa.ListArray.from_arrays(off, pa.array(bucket.astype(np.int32))), pa.ListArray.from_arrays(off, pa.array(value.astype(np.float32))))

    return run


class Scorer:
    """A weight per bucket and a bias; a score is a probability."""

    def __init__(self, weights: np.ndarray, bias: float, bits: int = BUCKET_BITS):
        self.weights, self.bias, self.bits = weights.astype(np.float32), bias, bits

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.empty(len(texts))
        for i, j, t in _chunks(texts):
            g, gr, lagged = features(t, self.bits)
            per = np.bincount(gr, minlength=j - i)
            sums = np.concatenate([[0.0], np.cumsum(self.weights[g], dtype=np.float64)])
            ends = np.cumsum(per)
            z = (sums[ends] - sums[ends - per]) / (per + CALM) + lagged @ self.weights[lag_buckets(self.bits)]
            out[i:j] = 1 / (1 + np.exp(-np.clip(self.bias + z, -50, 50)))
        return out


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int = BUCKET_BITS, rounds: int = 120, decay: float = 1e-3, rate: float = 0.3) -> Scorer:
    """Logistic regression on soft labels, full-batch Adagrad on standardised features. rows:
    (buckets, values) of each document."""
    size = 1 << bits
    if not len(labels):
        return Scorer(np.zeros(size), 4.0, bits)
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    bucket = np.concatenate([r[0] for r in rows]).astype(np.int64)
    value = np.concatenate([r[1] for r in rows]).astype(np.float64)
    power = np.bincount(bucket, weights=value**2, minlength=size) / len(rows)
    scale = np.where(power > 0, 1 / np.sqrt(np.maximum(power, 1e-12)), 0) / 30
    value = value * scale[bucket]
    w, b = np.zeros(size), float(np.log(np.clip(labels.mean(), 0.01, 0.99) / (1 - np.clip(labels.mean(), 0.01, 0.99))))
    seen, seen_b = np.full(size, 1e-8), 1e-8
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=value * w[bucket], minlength=len(rows)) + b, -50, 50)))
        g = (p - labels) / len(rows)
        grad = np.bincount(bucket, weights=value * g[row], minlength=size) + decay * w / len(rows)
        seen += grad**2
        w -= rate * grad / np.sqrt(seen)
        seen_b += g.sum() ** 2
        b -= rate * g.sum() / np.sqrt(seen_b)
    return Scorer(w * scale, b, bits)


def train(docs: DataFrame, sample: int = SAMPLE, bits: int = BUCKET_BITS) -> tuple[Scorer, dict[int, float], float, np.ndarray]:
    """(scorer, posterior of each code, prior, accuracies of the labellers)."""
    own = text_of(docs)
    counts = own.mapInArrow(tidy(_vote), "doc_id long, code int").groupBy("code").count().toPandas()
    codes = counts["code"].to_numpy()
    post, prior, prob = em(codes, counts["count"].to_numpy())
    table = dict(zip(codes.tolist(), post.tolist(), strict=True))
    ids = cut(own.where("doc_id is not null").select(F.col("doc_id").alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(sample))
    rows = own.join(maybe_broadcast(ids), F.col("doc_id") == F.col("id"), "left_semi").where("text is not null")
    got = rows.mapInArrow(tidy(_sparse(bits)), "doc_id long, code int, bucket array<int>, value array<float>").orderBy("doc_id").toArrow()
    sparse = [got.column(c).combine_chunks() for c in ("bucket", "value")]
    pairs = [(sparse[0][i].values.to_numpy(), sparse[1][i].values.to_numpy()) for i in range(got.num_rows)]
    labels = np.array([table[c] for c in got.column("code").to_pylist()])
    return fit(pairs, labels, bits), table, prior, accuracies(prob, prior)


def score(docs: DataFrame, keep: float = KEEP, sample: int = SAMPLE, bits: int = BUCKET_BITS, model: Scorer | None = None) -> DataFrame:
    """(doc_id, score, keep) of each row."""
    scorer = model or train(docs, sample, bits)[0]

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(scorer.score(texts), pa.float64())

    got = text_of(docs).select("doc_id", F.arrow_udf(tidy_udf(run), "double")("text").alias("p"))
    return got.select("doc_id", F.round("p", 6).alias("score"), (F.col("p") >= keep).alias("keep"))
