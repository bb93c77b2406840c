"""Toxicity by non-negative positive-unlabelled learning.

A numpy logistic classifier over words, word beginnings and beginnings that several words share is trained from confirmed toxic texts and unlabelled text:
with the class prior p, the risk is  p E_P[l(z)] + max(0, E_U[l(-z)] - p E_P[l(-z)]), and where the second term would
fall below zero the step goes the other way, as the non-negative estimator has it. The prior is the toxic share of the
labelled rows. Which features take part is decided on counts in both samples, corrected by the prior in the same way.

Both samples are bounded (parameters ``positives`` and ``unlabelled``) and taken by the hash of the id among the rows
to learn from, so fitting costs the same at any size; scoring reads every whole text once. Of n near copies within a
sample each weighs 1/n, since the chance words that copies of a toxic text share would pass for evidence.

Defined results: null and empty texts score the model's bias alone. Without toxic labels to learn from every score is
9e-14, the logistic of the least bias. A document whose labels disagree counts as toxic. Repeated rows are scored each. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm import common

#: Confirmed toxic and unlabelled documents that are learned from, at most; features of the model.
POSITIVES, UNLABELLED, FEATURES = 3000, 9000, 768
#: Likelihood ratio (G2) that a feature needs.
EVIDENCE = 20.0
#: A text with this score or more is called toxic.
THRESHOLD = 0.7
#: Words of the shingles that tell near copies in the samples.
SHINGLE = 5
#: Lengths of the word beginnings that are features beside whole words.
BEGINNINGS = (3, 4, 5, 6)
#: So many distinct words with one beginning are a feature of their own.
REPEATS = (2, 3)
#: Distinct words whose features a scoring task remembers before it starts anew.
REMEMBERED = 1_000_000

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features(word: str) -> list[str]:
    """A word and its beginnings, which carry over to forms that weren't seen in training."""
    return [f"={word}", *[f"^{word[:n]}" for n in BEGINNINGS if len(word) >= n]]


def text_features(found: set[str]) -> set[str]:
    """The features of a text's distinct words, and for each beginning whether two of them share it, or three (``2^``, ``3^``)."""
    shared = Counter(f for w in found for f in features(w)[1:])
    return {f for w in found for f in features(w)} | {f"{n}{f}" for f, c in shared.items() for n in REPEATS if c >= n}


def near_key(text: str) -> int:
    """The smallest hash of the text's five-word shingles: near copies mostly share it, other texts don't."""
    ws = [w.encode("utf-8", "surrogatepass") for w in _WORD.findall(text.lower())]
    return min(xxhash.xxh64_intdigest(b" ".join(ws[i : i + SHINGLE])) for i in range(max(1, len(ws) - SHINGLE + 1))) >> 1


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


class Model:
    """Weights of features; ``score`` is the logistic of their sum over a text's distinct features."""

    def __init__(self, names: list[str], weights: np.ndarray, bias: float) -> None:
        self.at, self.weights, self.bias = {n: i for i, n in enumerate(names)}, weights, bias
        #: Beginnings whose repeats are features, with (repeats, feature).
        self.repeats: dict[str, list[tuple[int, int]]] = {}
        for n, i in self.at.items():
            if n[0].isdigit():
                self.repeats.setdefault(n[1:], []).append((int(n[0]), i))
        self.seen: set[str] = set()
        self.hits: dict[str, list[int]] = {}
        self.begins: dict[str, list[str]] = {}

    def present(self, text: str) -> list[int]:
        found = words(text)
        if len(self.seen) > REMEMBERED:
            self.seen, self.hits, self.begins = set(), {}, {}
        new = found - self.seen
        for w in new:
            own = features(w)
            if hit := [self.at[f] for f in own if f in self.at]:
                self.hits[w] = hit
            if begin := [f for f in own if f in self.repeats]:
                self.begins[w] = begin
        self.seen |= new
        out = {i for w in found & self.hits.keys() for i in self.hits[w]}
        shared = Counter(f for w in found & self.begins.keys() for f in self.begins[w])
        return sorted(out | {i for f, c in shared.items() for n, i in self.repeats[f] if c >= n})

    def score(self, text: str) -> float:
        z = self.bias + float(self.weights[self.present(text)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def risk(w: np.ndarray, x_pos: np.ndarray, x_unl: np.ndarray, prior: float, a_pos: np.ndarray, a_unl: np.ndarray) -> tuple[float, float, np.ndarray]:
    """The risk's two parts for weights and bias ``w``, and the gradient that a step follows (without decay).

    a_*: what each document weighs, 1 in sum. Where the second part is negative, the step undoes it alone.
    """
    n = x_pos.shape[1]
    zp, zu = x_pos @ w[:n].astype(np.float32) + w[n], x_unl @ w[:n].astype(np.float32) + w[n]
    sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
    positive = prior * float(a_pos @ np.logaddexp(0, -zp))
    negative = float(a_unl @ np.logaddexp(0, zu) - prior * (a_pos @ np.logaddexp(0, zp)))
    part = lambda x, a, d: np.append(x.T @ (a * d).astype(np.float32), (a * d).sum())
    g_negative = part(x_unl, a_unl, su) - prior * part(x_pos, a_pos, sp)
    return positive, negative, prior * part(x_pos, a_pos, sp - 1) + g_negative if negative >= 0 else -g_negative


def fit(x_pos: np.ndarray, x_unl: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-5, weigh_pos: np.ndarray | None = None, weigh_unl: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk with the logistic loss; x_*: documents by features, 0 or 1."""
    prior = min(max(prior, 1e-4), 0.9)
    n = x_pos.shape[1]
    share = lambda x, given: np.full(len(x), 1 / len(x)) if given is None else given / given.sum()
    a_pos, a_unl = share(x_pos, weigh_pos), share(x_unl, weigh_unl)
    w = np.zeros(n + 1)
    w[n] = np.log(prior / (1 - prior))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        g = risk(w, x_pos, x_unl, prior, a_pos, a_unl)[2]
        g[:n] += decay * w[:n]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w[:n] = np.maximum(w[:n], 0)  # features were chosen for speaking for the label
    return w[:n], float(w[n])


def choose_features(counts: DataFrame, positives: float, unlabelled: float, prior: float, most: int) -> list[str]:
    """Features that toxic texts have more often than clean ones, beyond chance.

    The clean rate is (u - p a) / (1 - p) for rates a in toxic and u in unlabelled texts. A feature takes part if the
    likelihood ratio of its counts is at least EVIDENCE, so that few labels give few features rather than noise.
    """
    a, u = F.col("n_pos") / positives, F.col("n_unl") / unlabelled
    clean = F.greatest(F.lit(0.0), (u - prior * a) / (1 - prior))
    both = (F.col("n_pos") + F.col("n_unl")) / (positives + unlabelled)
    part = lambda n, of, q: F.when(n > 0, n * F.log(n / (of * q))).otherwise(0.0)
    ratio = 2 * (part(F.col("n_pos"), positives, both) + part(positives - F.col("n_pos"), positives, 1 - both) + part(F.col("n_unl"), unlabelled, both) + part(unlabelled - F.col("n_unl"), unlabelled, 1 - both))
    gain = a * F.log((a + 1 / positives) / (clean + 1 / unlabelled))
    rows = counts.filter((a > u) & (F.col("n_pos") >= 2)).filter(ratio >= EVIDENCE).withColumn("gain", gain).orderBy(F.desc("gain"), "feature").limit(most).collect()
    return sorted(r["feature"] for r in rows)


def train(documents: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, most: int = FEATURES) -> Model:
    docs = common.require(documents, "doc_id", "text").filter(~held_out())
    known = common.require(labels, "doc_id", "toxic").filter(~held_out()).filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg("toxic")).first()[0] or 0.0
    by_id = [F.col("id")]
    toxic, any_text = known.filter("toxic = 1").select(F.col("doc_id").alias("id")), docs.select(F.col("doc_id").alias("id")).filter("id is not null").distinct()
    # Ids alone are ordered and broadcast: at most positives + unlabelled of them.
    chosen = common.settle(common.sample_by_hash(toxic, positives, by_id, toxic.count()).withColumn("pos", F.lit(True)).union(common.sample_by_hash(any_text, unlabelled, by_id, any_text.count()).withColumn("pos", F.lit(False))), "toxic-ids")
    keyed = F.pandas_udf(lambda texts: pd.Series([near_key(t or "") for t in texts], dtype="int64"), "long")
    found = common.settle(docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("pos", "text", keyed("text").alias("key")).repartition(16), "toxic-found")
    # Of n near copies each weighs 1/n: a passage that copies share is no evidence for the words in it.
    copies = found.groupBy(F.col("pos").alias("p"), F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    sample = common.settle(found.join(F.broadcast(copies), (F.col("pos") == F.col("p")) & (F.col("key") == F.col("k"))).select("pos", "text", (1 / F.col("n")).alias("weight")), "toxic-sample")
    size = {r["pos"]: r["w"] for r in sample.groupBy("pos").agg(F.round(F.sum("weight"), 6).alias("w")).collect()}
    n_pos, n_unl = size.get(True, 0), size.get(False, 0)
    if not n_pos or not n_unl or not prior:
        return Model([], np.zeros(0), -30.0)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pos, unl = Counter(), Counter()
        for rows in batches:
            for p, text, weight in zip(rows["pos"], rows["text"], rows["weight"], strict=True):
                own = pos if p else unl
                for f in text_features(words(text or "")):
                    own[f] += weight
        yield pd.DataFrame([(f, n, unl[f]) for f, n in pos.items()] + [(f, 0.0, n) for f, n in unl.items() if f not in pos], columns=["feature", "n_pos", "n_unl"])

    # Rounded, as sums of parts depend on their order in the last bits.
    total = lambda c: F.round(F.sum(c), 6).alias(c)
    counts = sample.mapInPandas(count, "feature string, n_pos double, n_unl double").groupBy("feature").agg(total("n_pos"), total("n_unl"))
    names = choose_features(counts, n_pos, n_unl, prior, most)
    blank = Model(names, np.zeros(len(names)), 0.0)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"pos": rows["pos"], "at": [blank.present(t or "") for t in rows["text"]], "weight": rows["weight"]})

    # The rows of the sample come in any order; equal ones are one row with the sum of their weights.
    alike: dict[tuple[bool, tuple[int, ...]], list[float]] = {}
    for p, at, weight in sample.mapInPandas(encode, "pos boolean, at array<int>, weight double").toPandas().itertuples(index=False):
        alike.setdefault((bool(p), tuple(int(i) for i in at)), []).append(weight)
    x, weights_of = np.zeros((len(alike), len(names)), np.float32), np.zeros(len(alike))
    order = sorted(alike)
    for i, k in enumerate(order):
        x[i, np.array(k[1], int)] = 1
        weights_of[i] = math.fsum(alike[k])
    pos = np.array([k[0] for k in order], bool)
    weights, bias = fit(x[pos], x[~pos], prior, weigh_pos=weights_of[pos], weigh_unl=weights_of[~pos])
    return Model(names, weights, bias)


def scorer(model: Model):
    """A column function: texts to scores."""
    names, weights, bias = list(model.at), model.weights, model.bias

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(names, weights, bias)
        for texts in batches:
            yield pd.Series([own.score(t or "") for t in texts], dtype=float)

    return score


def score_documents(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **bounds: int) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    score = scorer(train(documents, labels, **bounds))
    scored = common.require(documents, "doc_id", "text").select("doc_id", held_out().alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that aren't called toxic, with all columns."""
    score = scorer(train(documents, labels))
    packed = documents.select(score("text").alias("score"), F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("doc"))
    return packed.filter(F.col("score") < threshold).select("doc.*")
