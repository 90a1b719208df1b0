"""Toxicity by weak supervision.

Many voters look at a text and fire or stay silent: each word of a seed lexicon, and words and word-prefix patterns (also
counted: in two or three words of the text at least) that were developed on labelled rows. From then on they need no labels:
they vote on labelled and unlabelled documents alike. A generative latent-class model of the votes estimates, by EM, the
share of class 1, how often each voter fires under either class, and the correlations between voters that the classes leave
unexplained; correlated voters share their weight. The labels given take part as one more voter, of estimated error rates,
which abstains on unlabelled rows. The posterior labels of all these documents train a linear classifier on words and
patterns, which alone scores every text.

Training reads at most `TRAIN_ROWS` labelled and `UNLABELLED` other documents, those with the smallest hash of doc_id, and at
most `SAMPLE_WORDS` distinct words of each (those of smallest hash, of up to 64 letters); scoring reads every whole text.

Cases: NULL and empty texts get the score of a text without features; NULL labels are not used; without labelled rows of
both classes only the seed lexicon's voters exist, and the model is fitted on their votes (on no document at all it has
the bias alone); copies and near copies among training rows count once; repeated rows are scored alike; very long texts are
scored whole; ties in rank are broken by spelling; a column that has the score's name is replaced; further columns are
ignored; empty tables give empty results.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from kvlake.llm.common import with_field

#: Labelled and unlabelled rows that training reads at most, words of each, voters and features of the classifier at most.
TRAIN_ROWS, UNLABELLED, SAMPLE_WORDS, VOTERS, FEATURES = 8000, 4000, 4096, 160, 8192
#: Share of a feature's texts that must be of class 1 for it to become a voter.
PURITY = 0.85
PREFIXES = (3, 4, 5, 6, 7)
# A general seed lexicon of insults, as text.
SEED_WORDS = ("idiot moron stupid trash scum loser clown pathetic worthless disgusting filthy vermin imbecile "
              "bastard bitch whore degenerate subhuman").split()
WORDS = r"[^\W\d_]+"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def features(counts: dict[str, int]) -> set[str]:
    """Words, and prefixes of longer words: with a bar if there is such a word, with two or three if there are as many."""
    out, prefixes = set(counts), Counter()
    for w, n in counts.items():
        for k in PREFIXES:
            if len(w) > k:
                prefixes[w[:k]] += min(n, 3)
    for prefix, n in prefixes.items():
        out.update(prefix + "|" * k for k in range(1, min(n, 3) + 1))
    return out


def counted(text: str | None) -> Counter:
    return Counter(re.findall(WORDS, (text or "").lower()))


def _sampled_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zlib

    for b in batches:
        words = []
        for t in b.column(1):
            n = Counter({w: k for w, k in counted(t.as_py()).items() if len(w) <= 64})
            few = n if len(n) <= SAMPLE_WORDS else sorted(n, key=lambda w: (zlib.crc32(w.encode()), w))[:SAMPLE_WORDS]
            words.append(" ".join(w for w in sorted(few) for _ in range(min(n[w], 3))))
        yield pa.record_batch([b.column(0), pa.array(words, pa.string()), b.column(2)], ["doc_id", "words", "toxic"])


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, unlabelled: int = UNLABELLED) -> list[tuple[str, int | None]]:
    """The bounded sample, label None where there is none: chosen on ids alone, then joined, so that few texts move. Held-out
    documents are not in it. A text is its words, each up to three times; a doc_id counts once, however many rows share it."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    first = lambda ids, n: ids.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    others = docs.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct().join(known.select("doc_id"), "doc_id", "left_anti")
    ids = first(known, rows).unionByName(first(others, unlabelled).withColumn("toxic", F.lit(None).cast("int")))
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "toxic")
    texts = texts.mapInArrow(_sampled_words, "doc_id long, words string, toxic int")
    found = texts.groupBy("doc_id").agg(F.min("words").alias("words"), F.max("toxic").alias("toxic")).collect()  # at most rows + unlabelled
    return [(r.words, r.toxic) for r in sorted(found, key=lambda r: r.doc_id)]


def unlike(texts: list[str], rare: int = 40) -> list[int]:
    """Places of texts (words, space-joined) that are not copies or near copies of an earlier one: copies share the two of
    their rarer words that hash smallest. Without this, all words of a much-copied text would seem to tell its label."""
    import zlib

    first = sorted({t: i for i, t in reversed(list(enumerate(texts)))}.values())
    df = Counter(w for i in first for w in set(texts[i].split()))
    seen, out = set(), []
    for i in first:
        m = tuple(sorted(zlib.crc32(w.encode()) for w in set(texts[i].split()) if len(w) > 4 and df[w] <= rare)[:2])
        if m not in seen or not m:
            seen.add(m)
            out.append(i)
    return out


def telling(rows: list[set[str]], y: np.ndarray) -> dict[str, tuple[float, int, int]]:
    """Features that go with y beyond chance, with their evidence, hits and firings: the binomial tail at the base rate,
    times the number tried, is below 1."""
    hits = Counter(f for r, label in zip(rows, y) if label >= .5 for f in r)
    fit = {f for f, k in hits.items() if k >= 3}
    total = Counter(f for r in rows for f in r & fit)
    base = min(max(float(y.mean()), 1e-3), .5)
    out = {}
    for f, n in total.items():
        k = hits[f]
        if k >= PURITY * n:
            tail = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(base) + (n - k) * math.log1p(-base)
            if tail + math.log(max(2, len(fit))) < 0:
                out[f] = (-tail, k, n)
    return out


def voters(rows: list[set[str]], y: np.ndarray) -> list[str]:
    """The seed words, and telling features by evidence, as far as one still tells class 1 where no chosen one fires: a
    prefix that goes with a chosen word, and else with other texts, is none."""
    found = telling(rows, y)
    fires: dict[str, list[int]] = {}
    for i, r in enumerate(rows):
        for f in r & found.keys():
            fires.setdefault(f, []).append(i)
    chosen, covered = list(SEED_WORDS), np.array([not r.isdisjoint(SEED_WORDS) for r in rows], bool)
    for f in sorted(found, key=lambda f: (-found[f][0], -len(f), f)):
        at = np.array(fires[f])
        alone = at[~covered[at]]
        if f not in chosen and len(chosen) < VOTERS and len(alone) > 1 and (y[alone] >= .5).sum() >= PURITY * len(alone):
            chosen.append(f)
            covered[at] = True
    return chosen


def label_model(votes: np.ndarray, given: np.ndarray | None = None, prior: float = .1, rounds: int = 60) -> tuple[np.ndarray, dict]:
    """Posterior of class 1 for each row of 0/1 votes, and what was estimated.

    `given` is a voter that says 1, 0 or (NaN) nothing. EM starts from the votes alone: a row with a vote is thought to be
    of class 1. A voter's evidence is divided by the correlations it has with voters that fire beside it."""
    n, m = votes.shape
    any_ = votes.any(axis=1)
    told = ~np.isnan(given) if given is not None else np.zeros(n, bool)
    q = np.where(any_, .8, .02)
    says = given[told] if given is not None else np.empty(0)
    corr, ones, hit, false = np.eye(m), votes.sum(axis=1), .9, .05
    for step in range(rounds):
        prior = float(np.clip((q.sum() + 10 * prior) / (n + 10), 1e-3, .5))
        one = (q @ votes + .5) / (q.sum() + 1)
        zero = ((1 - q) @ votes + .05) / ((1 - q).sum() + 1)
        if step % 10 == 0 and n > 1:
            left = votes - q[:, None] * one - (1 - q)[:, None] * zero
            spread = np.sqrt((left ** 2).mean(axis=0)) + 1e-9
            corr = np.clip((left.T @ left / n) / np.outer(spread, spread), 0, 1)
            np.fill_diagonal(corr, 1)
        crowd = np.maximum(votes @ corr, 1)  # for each row and voter, the correlated votes beside it, itself included
        fired = np.log(np.clip(one, 1e-4, 1 - 1e-4) / np.clip(zero, 1e-5, 1 - 1e-4))
        silent = float((1 - (q[~any_].sum() + .5) / ((~any_).sum() + 1)))
        odds = (votes / crowd) @ fired + math.log(prior / (1 - prior))
        odds[~any_] = math.log((1 - silent) / silent)
        if told.any():
            # error rates of the labels, with the weight of a few rows on mostly right ones
            hit = (q[told] @ says + 9) / (q[told].sum() + 10)
            false = ((1 - q[told]) @ says + 1) / ((1 - q[told]).sum() + 20)
            odds[told] += np.where(says >= .5, math.log(hit / false), math.log((1 - hit) / (1 - false)))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        moved = np.abs(new - q).max() if n else 0
        q = new
        if moved < 1e-6:
            break
    return q, {"prior": prior, "one": one, "zero": zero, "correlation": corr, "hit": hit, "false": false, "votes": ones}


def logistic(rows: list[np.ndarray], q: np.ndarray, m: int, ridge: float = .05, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression on sparse 0/1 rows with soft labels, by accelerated gradient steps."""
    at = np.concatenate([np.full(len(r), i) for i, r in enumerate(rows)] or [[]]).astype(int)
    col = np.concatenate(rows or [[]]).astype(int)
    w, b = np.zeros(m), math.log((q.mean() + 1e-3) / (1 - q.mean() + 1e-3))
    vw, vb, rate = w.copy(), b, 2.0 / (1 + max([len(r) for r in rows], default=0))
    n = max(1, len(rows))
    for step in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(at, vw[col], n) + vb, -30, 30)))
        e = p - q
        w2 = vw - rate * (np.bincount(col, e[at], m) + ridge * vw)
        b2 = vb - rate * float(e.sum()) / math.sqrt(n)
        c = step / (step + 3)
        vw, vb = w2 + c * (w2 - w), b2 + c * (b2 - b)
        w, b = w2, b2
    return w, b


def _frequent(texts: list[str], least: int = 3, slots: int = 1 << 22) -> dict[str, int]:
    """Features of at least so many texts. A first count in hashed slots leaves few of the others to be held."""
    import zlib

    counts = np.zeros(slots, np.int32)
    hashed = lambda found: np.fromiter((zlib.crc32(f.encode()) % slots for f in found), np.int64, len(found))
    for t in texts:
        counts[np.unique(hashed(features(Counter(t.split()))))] += 1
    out: Counter = Counter()
    for t in texts:
        found = list(features(Counter(t.split())))
        out.update(f for f, n in zip(found, counts[hashed(found)].tolist()) if n >= least)
    return {f: n for f, n in out.items() if n >= least}


def fit(rows: list[tuple[str, int | None]]) -> dict:
    """{'bias', 'weights'}: a classifier on at most FEATURES words and patterns."""
    kept = unlike([t for t, _ in rows])
    seed = set(SEED_WORDS)
    toxic = {i for i in kept if (rows[i][1] or 0) >= 1 or (rows[i][1] is None and not seed.isdisjoint(rows[i][0].split()))}
    # what can tell at all: features of three such texts and of fewer others with a label; no more is held of the texts
    hits = _frequent([rows[i][0] for i in kept if i in toxic])
    misses = Counter(f for i in kept if i not in toxic and rows[i][1] is not None for f in features(Counter(rows[i][0].split())) if f in hits)
    fit_ = {f: f for f, n in hits.items() if n >= misses[f]} | {w: w for w in SEED_WORDS}
    seen = [{fit_[f] for f in features(Counter(rows[i][0].split())) if f in fit_} for i in kept]
    given = np.array([math.nan if rows[i][1] is None else float(rows[i][1] >= 1) for i in kept])
    told = np.flatnonzero(~np.isnan(given))
    both = 0 < given[told].sum() < len(told)
    chosen = voters([seen[i] for i in told], given[told]) if both else list(SEED_WORDS)
    place = {f: k for k, f in enumerate(chosen)}
    votes = np.zeros((len(kept), len(chosen)))
    for i, r in enumerate(seen):
        votes[i, [place[f] for f in r & place.keys()]] = 1
    if not len(kept):
        return {"bias": -4.0, "weights": {}}
    q, _ = label_model(votes, given if both else None, float(np.clip(given[told].mean(), .01, .5)) if both else .1)
    found = telling(seen, q)
    keep = sorted({*found, *chosen}, key=lambda f: (-found.get(f, (0,))[0], f))[:FEATURES]
    place = {f: k for k, f in enumerate(keep)}
    hits = [np.array(sorted(place[f] for f in r & place.keys()), np.int64) for r in seen]
    w, b = logistic(hits, q, len(keep))
    return {"bias": float(b), "weights": {f: float(x) for f, x in zip(keep, w) if x}}


class Scorer:
    """Scores of texts under a model. Of each word, only the prefixes that the model knows are counted."""

    def __init__(self, model: dict):
        self.bias, self.weights = model["bias"], model["weights"]
        self.prefixes = {f.rstrip("|") for f in self.weights if f.endswith("|")}
        self.find, self.memo = re.compile(WORDS).findall, {}

    def _known(self, w: str) -> tuple:
        if len(self.memo) > 1 << 17:
            self.memo.clear()
        got = self.memo[w] = (self.weights.get(w, 0.0), tuple(w[:k] for k in PREFIXES if len(w) > k and w[:k] in self.prefixes))
        return got

    def score(self, text: str | None) -> float:
        words = self.find((text or "").lower())
        memo, terms, prefixes = self.memo, [], {}
        for w in set(words):
            weight, starts = memo.get(w) or self._known(w)
            if weight:
                terms.append(weight)
            for p in starts:
                prefixes.setdefault(p, []).append(w)
        if prefixes:
            several = Counter(words) if len(prefixes) else {}
            for p, ws in prefixes.items():
                n = min(3, sum(min(3, several[w]) for w in ws))
                terms += [self.weights.get(p + "|" * k, 0.0) for k in range(1, n + 1)]
        z = self.bias + math.fsum(terms)  # exact, so the order of a set does not matter
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def score(docs: DataFrame, model: dict, text_col: str = "text", out: str = "score") -> DataFrame:
    """`docs` with the score of each whole text as `out`. The model is at most FEATURES weights."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[c for c in docs.columns if c.lower() != out.lower() or c == text_col], F.col(text_col).alias("__text"))
    if out.lower() == text_col.lower():
        rows = rows.drop(text_col)
    names = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            scores = [scorer.score(t.as_py()) for t in b.column(b.num_columns - 1)]
            yield pa.record_batch([*b.columns[:-1], pa.array(scores, pa.float64())], [*names, out])

    return rows.mapInArrow(run, with_field(rows.drop("__text"), out, T.DoubleType()))
