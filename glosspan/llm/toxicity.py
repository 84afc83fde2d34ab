"""Toxicity: a counterfactual-regularised classifier over words and their character n-grams.

A word's score is the sum of the weights of its n-grams; a document's logit is a bias plus its highest word score
and a share of the next one's, so one insult in a very long text counts as much as in a short one.  Labelled
sentences that hold an identity term are repeated with the term swapped for others of its group, and the squared
change of the logit is penalised during fitting, which keeps neutral mentions of groups from being marked.  Beside the
English list, groups are derived for each language from the labelled rows: words that go with neither class.

Defined cases: null and empty texts score as a text without words; repeated rows score alike; texts of any length
are read whole; a label table without both classes gives the constant prior; the held-out fold never teaches;
fitting uses at most ``per_class`` rows of each class and ``max_chars`` characters, both parameters; words that tie
for the highest score share its gradient; an empty table gives no rows; columns other than doc_id, text and (for the
groups of the fit only) lang are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import class_share, held_out, labelled_sample, map_batches, slices, table

BITS = 20
NGRAMS = (3, 4, 5, 6)
_PRIME = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…–—·¡¿"
THRESHOLD = 0.3
SECOND = 0.5

#: Groups of terms that may stand for one another in a counterfactual sentence.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("black", "white", "asian", "latino", "indigenous", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrant", "native", "refugee", "foreigner"),
    ("deaf", "blind", "disabled", "autistic"),
    ("old", "young", "elderly"),
)


def word_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(feature ids, word starts): hashed n-grams of each ``^word$`` and the whole word, over its bytes."""
    words = pc.binary_join_element_wise("^", words, "$", "")
    raw = words.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].astype(np.uint64)
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets)
    word = np.repeat(np.arange(len(sizes)), sizes)
    room = offsets[1:][word] - np.arange(len(data))
    owners, ids = [np.arange(len(sizes))], []
    powers = np.cumprod(np.full(int(sizes.max(initial=1)) + 1, _PRIME, np.uint64))
    within = np.arange(len(data)) - offsets[:-1][word]
    total = np.concatenate([[np.uint64(0)], np.cumsum((data + np.uint64(1)) * powers[within], dtype=np.uint64)])
    ids.append(_bucket(total[offsets[1:]] - total[offsets[:-1]], 99))
    for n in NGRAMS:
        if len(data) < n:
            continue
        h = np.zeros(len(data) - n + 1, np.uint64)
        for k in range(n):
            h = h * _PRIME + data[k:len(data) - n + 1 + k] + np.uint64(1)
        ok = room[:len(h)] >= n
        owners.append(word[:len(h)][ok])
        ids.append(_bucket(h[ok], n))
    owner, feature = np.concatenate(owners), np.concatenate(ids)
    order = np.argsort(owner, kind="stable")
    return feature[order], np.searchsorted(owner[order], np.arange(len(sizes)))


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h + np.uint64(salt)) * _MIX
    return ((h ^ (h >> np.uint64(29))) * _MIX >> np.uint64(64 - BITS)).astype(np.int64)


def word_slices(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct normalised words, each occurrence's index into them, and where each text's occurrences start."""
    split = pc.utf8_split_whitespace(texts)
    encoded = split.flatten().dictionary_encode()
    clean = pc.utf8_trim(pc.utf8_lower(encoded.dictionary.cast(pa.string())), characters=_MARKS)
    again = clean.dictionary_encode()
    index = np.asarray(again.indices)[np.asarray(encoded.indices)] if len(encoded) else np.zeros(0, np.int64)
    return again.dictionary, index, np.asarray(split.offsets)


def real_words(words: pa.Array) -> np.ndarray:
    """False for the empty word that marks alone, or a text without words, leave."""
    return np.asarray(pc.utf8_length(words)) > 0


def _top_two(scores: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's highest and next distinct score; 0 where there is none."""
    n = len(offsets) - 1
    first, second = np.zeros(n), np.zeros(n)
    some = np.flatnonzero(np.diff(offsets) > 0)
    if len(some):
        first[some] = np.maximum.reduceat(scores, offsets[some])
        lower = np.where(scores < np.repeat(first, np.diff(offsets)), scores, -np.inf)
        nxt = np.maximum.reduceat(lower, offsets[some])
        second[some] = np.where(np.isfinite(nxt), nxt, 0.0)
    return np.maximum(first, 0), np.maximum(second, 0)


@dataclass
class Model:
    bias: float
    weights: np.ndarray
    pairs: int = 0  # counterfactual pairs of the fit

    def logits(self, texts: pa.Array) -> np.ndarray:
        words, index, offsets = word_slices(texts)
        if not len(words):
            return np.full(len(texts), self.bias)
        feature, starts = word_features(words)
        s = np.add.reduceat(self.weights[feature].astype(np.float64), starts) * real_words(words)
        first, second = _top_two(s[index], offsets)
        return self.bias + first + SECOND * second

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts), -40, 40)))


_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_WORD = re.compile(r"[^\W\d_]+")


def derived_groups(rows: list[tuple[str, int]], words: int = 16, size: int = 4, least: int = 3, share: float = 0.25) -> tuple[tuple[str, ...], ...]:
    """Groups of ``size`` words of one language that may stand for one another, as their odds of a toxic row are alike.

    Words are in at least ``least`` rows of each class and at most a ``share`` of all rows, and their odds are within a
    standard error of the rows' odds; the ``words`` nearest to it are grouped by frequency.
    """
    held: tuple[Counter, Counter] = Counter(), Counter()
    for text, y in rows:
        held[y].update({w.lower() for w in _WORD.findall(text)})
    sizes = [sum(y == k for _, y in rows) for k in (0, 1)]
    alike = []
    for w, b in held[1].items():
        a = held[0][w]
        if min(a, b) < least or a + b > share * len(rows):
            continue
        odds = abs(np.log((b / sizes[1]) / (a / sizes[0])))
        if odds <= np.sqrt(1 / a + 1 / b):
            alike.append((float(odds), w, a + b))
    chosen = [w for _, w, _ in sorted(sorted(alike)[:words], key=lambda x: (x[2], x[1]))]
    return tuple(g for g in (tuple(chosen[i:i + size]) for i in range(0, len(chosen), size)) if len(g) > 1)


def sample_pairs(rows: list[tuple[str, int, str | None]], groups=IDENTITY_GROUPS) -> list[tuple[str, str]]:
    """Counterfactual pairs of (text, label, language) rows: by ``groups``, and by each language's derived groups."""
    by_lang: dict = {}
    for text, y, lang in rows:
        by_lang.setdefault(lang, []).append((text, y))
    out = []
    for _, own in sorted(by_lang.items(), key=lambda x: str(x[0])):
        listed = {t for g in groups for t in g}
        derived = (tuple(w for w in g if w not in listed) for g in derived_groups(own))
        out += counterfactuals([t for t, _ in own], (*groups, *derived))
    return out


def counterfactuals(texts: list[str], groups=IDENTITY_GROUPS) -> list[tuple[str, str]]:
    """Every (sentence, the same with one identity term swapped for another of its group)."""
    others = {t: g for g in groups for t in g}
    out = []
    for text in texts:
        low = text.lower()
        if not any(t in low for t in others):
            continue
        for s in _SENTENCE.findall(text):
            for m in _WORD.finditer(s):
                group = others.get(m[0].lower())
                if group:
                    for t in group:
                        if t != m[0].lower():
                            out.append((s, s[:m.start()] + t + s[m.end():]))
    return out


def fit(sample: list[tuple[str, int]], prior: float, groups=IDENTITY_GROUPS, penalty: float = 1.0, epochs: int = 40,
        rate: float = 0.4, decay: float = 2e-3, pairs: list[tuple[str, str]] | None = None) -> Model:
    """Fit by gradient from log-odds of the features' document counts; ``pairs`` stand instead of those by ``groups``."""
    y = np.array([l for _, l in sample], float)
    weights = np.zeros(1 << BITS, np.float32)
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    if not len(y) or y.min() == y.max():
        return Model(float(np.log(prior / (1 - prior))), weights)
    pairs = counterfactuals([t for t, _ in sample], groups) if pairs is None else pairs
    texts = pa.array([t for t, _ in sample] + [s for p in pairs for s in p], pa.string())
    words, index, offsets = word_slices(texts)
    n = len(sample)
    # distinct words of each text
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    both = np.unique(owner * np.int64(max(len(words), 1)) + index)
    owner, index = both // len(words), both % len(words)
    offsets = np.searchsorted(owner, np.arange(len(texts) + 1))
    feature, starts = word_features(words)
    real = real_words(words)
    per_word = np.diff(np.append(starts, len(feature)))
    word_of = np.repeat(np.arange(len(words)), per_word)
    doc_words = owner < n
    pos_w = np.bincount(index[doc_words], weights=y[owner[doc_words]], minlength=len(words))
    all_w = np.bincount(index[doc_words], minlength=len(words))
    pos_f = np.bincount(feature, weights=pos_w[word_of], minlength=1 << BITS)
    all_f = np.bincount(feature, weights=all_w[word_of], minlength=1 << BITS)
    share = y.mean()
    seen = all_f >= 4
    rate_f = (pos_f[seen] + 2 * share) / (all_f[seen] + 2)
    odds = np.log(rate_f / (1 - rate_f + 1e-9)) - np.log(share / (1 - share))
    noise = 1 / np.sqrt(np.maximum(np.minimum(pos_f[seen], all_f[seen]), 1))
    weights[seen] = np.clip(np.maximum(np.abs(odds) - 3 * noise, 0) * np.sign(odds), -3, 3) / 4
    bias = -2.0
    target_weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / n
    speed = np.zeros_like(weights)
    for _ in range(epochs):
        s = np.add.reduceat(weights[feature].astype(np.float64), starts) * real
        own = s[index]
        first, second = _top_two(own, offsets)
        z = bias + first + SECOND * second
        p = 1 / (1 + np.exp(-np.clip(z[:n], -40, 40)))
        dz = np.zeros(len(z))
        dz[:n] = (p - y) * target_weight
        if pairs:
            gap = (z[n::2] - z[n + 1::2]) / len(pairs)
            dz[n::2] += 2 * penalty * gap
            dz[n + 1::2] -= 2 * penalty * gap
        top1 = (own == np.repeat(first, np.diff(offsets))) & (own > 0)
        top2 = (own == np.repeat(second, np.diff(offsets))) & (own > 0)
        g_doc = np.repeat(dz, np.diff(offsets))
        g_word = np.bincount(index, weights=g_doc * (top1 + SECOND * top2), minlength=len(words))
        hot = np.flatnonzero(g_word[word_of])
        g = np.bincount(feature[hot], weights=g_word[word_of[hot]], minlength=1 << BITS).astype(np.float32)
        speed = 0.9 * speed + g
        weights -= np.float32(rate * 20) * speed / np.float32(1 + 10 * np.abs(speed).max())
        weights *= np.float32(1 - decay)
        bias -= rate * 4 * float(dz[:n].sum())
    weights[np.abs(weights) < 1e-6] = 0
    return Model(_centre(z[:n] - bias, y), weights, len(pairs))


def _centre(margin: np.ndarray, y: np.ndarray) -> float:
    """The bias that puts the decision midway between the top of class 0 and the bottom of class 1."""
    lo, hi = np.quantile(margin[y == 0], 0.995), np.quantile(margin[y == 1], 0.05)
    return -float((lo + hi) / 2 if hi > lo else lo)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2000, max_chars: int = 8_000_000, groups=IDENTITY_GROUPS, **options) -> Model:
    rows = labelled_sample(docs, labels, "toxic", per_class, max_chars, also="lang")
    return fit([(t, y) for t, y, _ in rows], class_share(labels, "toxic"), pairs=sample_pairs(rows, groups), **options)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; nothing is shuffled."""
    active = np.flatnonzero(model.weights)
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, active, model.weights[active]))
    state: dict = {}

    def run(batch: pa.RecordBatch):
        bias, ids, values = shared.value
        if "model" not in state:
            weights = np.zeros(1 << BITS, np.float32)
            weights[ids] = values
            state["model"] = Model(bias, weights)
        for part in slices(batch, "text", 3 << 20):
            p = state["model"].scores(part.column("text"))
            folds = [held_out(i) if i is not None else False for i in part.column("doc_id").to_pylist()]
            yield pa.table([part.column("doc_id"), pa.array(folds, pa.bool_()), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))],
                           names=["doc_id", "held_out", "score", "predicted"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), run,
                       "doc_id long, held_out boolean, score double, predicted int")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document's toxicity, learned from the rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
