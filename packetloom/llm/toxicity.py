"""Operator 7, toxicity: multiple-instance learning. Sentences are scored, a noisy-or joins them to a document's score.

A sentence ends at ``.``, ``!``, ``?`` or a line feed. Its features are its lower-cased words and their first 3 to 6
bytes. Of a sentence s that has chosen features, p_s = sigmoid(b + sum of their weights); of a document,
1 - (1 - leak) * prod(1 - p_s) over such sentences; what the others may add is left to the leak. Weights are fitted to
document labels only, through the noisy-or, on a bounded sample of labelled rows; all documents are scored. The sentences
that explain a score are located in the text.

Null, empty and blank texts score the leak, a small constant. Without usable labels no feature has weight. Repeated
labels of a document count once, toxic if any is; null labels are ignored. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import written
from packetloom.llm.wordhash import WORD_BYTE, RangeHash, blocks, spans

#: The sample: labelled rows of each class at most, and the longest text that is learnt from.
SAMPLE_PER_CLASS, SAMPLE_CHARS = 2500, 200_000
PREFIXES = (3, 4, 5, 6)
MAX_FEATURES, LEAST_DOCUMENTS = 4096, 3
THRESHOLD, OFFENDING = 0.7, 0.5

ENDS_SENTENCE = np.zeros(256, dtype=bool)
ENDS_SENTENCE[list(b".!?\n")] = True


@dataclass
class Sentences:
    """Of a block of texts: the features of its words, the sentence of each, the text and end of each sentence."""

    features: np.ndarray
    sentence: np.ndarray
    text: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def sentences(data: np.ndarray, text_starts: np.ndarray) -> Sentences:
    begin, end = spans(WORD_BYTE[data])
    stops = np.flatnonzero(ENDS_SENTENCE[data])  # each text ends with a line feed
    own = np.searchsorted(stops, begin)
    ranges = RangeHash(data)
    features, sentence = [ranges.of(begin, end)], [own]
    for n in PREFIXES:
        longer = end - begin > n
        features.append(ranges.of(begin[longer], begin[longer] + n) ^ np.uint64(n))
        sentence.append(own[longer])
    starts = np.concatenate(([0], stops[:-1] + 1))
    return Sentences(np.concatenate(features), np.concatenate(sentence), np.searchsorted(text_starts, starts, side="right") - 1, starts, stops)


def prepared(texts: Iterable[str | None]) -> list[bytes]:
    return [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]


@dataclass
class Model:
    features: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint64))  # ascending
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -20.0
    leak: float = 0.01

    def found(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``features`` have a weight, and which weight."""
        if not len(self.features):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        if not hasattr(self, "_bits"):
            self._bits = np.zeros(1 << 16, dtype=bool)
            self._bits[(self.features & np.uint64(0xFFFF)).astype(np.int64)] = True
        hit = np.flatnonzero(self._bits[(features & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.features, features[hit]), len(self.features) - 1)
        same = self.features[at] == features[hit]
        return hit[same], at[same]

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """Scores, and for each text the spans (code points) of the sentences over OFFENDING, the worst first."""
        raw = prepared(texts)
        scores, located = np.full(len(raw), self.leak), [[] for _ in raw]
        for lo, _, data, starts in blocks(raw):
            s = sentences(data, starts)
            hit, at = self.found(s.features)
            if not len(hit):
                continue
            # a feature counts once a sentence
            pairs = np.unique(s.sentence[hit] * np.int64(len(self.features)) + at)
            rows, which = pairs // len(self.features), pairs % len(self.features)
            scored, inverse = np.unique(rows, return_inverse=True)
            z = self.bias + np.bincount(inverse, self.weights[which])
            log_q = np.bincount(s.text[scored], -np.logaddexp(0, z), minlength=len(starts) - 1)
            scores[lo : lo + len(log_q)] = 1 - (1 - self.leak) * np.exp(log_q)
            for i in scored[np.argsort(-z, kind="stable")][: int((z > np.log(OFFENDING / (1 - OFFENDING))).sum())]:
                t = s.text[i]
                located[lo + t].append((int(s.starts[i] - starts[t]), int(s.ends[i] - starts[t])))
        for i, found in enumerate(located):
            if found:
                data = raw[i]
                located[i] = [(len(data[:a].decode("utf-8", "replace")), len(data[:b].decode("utf-8", "replace"))) for a, b in found]
        return np.clip(scores, 0.0, 1.0), located


#: Weight decays to choose from, and into how many folds the training rows are dealt for it.
DECAYS, FOLDS = (5e-6, 5e-5, 5e-4, 5e-3), 3


def feature_counts(raw: list[bytes], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different features of some texts, and how many toxic and other texts have each."""
    seen, yes, no = [np.zeros(0, dtype=np.uint64)], [np.zeros(0)], [np.zeros(0)]
    for lo, _, data, starts in blocks(raw):
        s = sentences(data, starts)
        names, code = np.unique(s.features, return_inverse=True)
        once = np.unique((s.text[s.sentence] + lo) * np.int64(len(names) + 1) + code)
        label, code = toxic[once // (len(names) + 1)], once % (len(names) + 1)
        seen.append(names)
        yes.append(np.bincount(code, label, len(names)))
        no.append(np.bincount(code, 1 - label, len(names)))
    names, code = np.unique(np.concatenate(seen), return_inverse=True)
    return names, *(np.bincount(code, np.concatenate(x), len(names)) for x in (yes, no))


def chosen_model(names: np.ndarray, yes: np.ndarray, no: np.ndarray, n_yes: float, n_no: float) -> Model:
    """Where learning starts: the features that at least LEAST_DOCUMENTS toxic texts have, and toxic texts markedly more
    often than others, with their log odds as weights."""
    odds = np.log((yes + 0.5) / (n_yes - yes + 0.5)) - np.log((no + 0.5) / (n_no - no + 0.5))
    error = np.sqrt(1 / (yes + 0.5) + 1 / (no + 0.5))
    chosen = np.flatnonzero((yes >= LEAST_DOCUMENTS) & (odds > 2.0) & (odds > 2.0 * error))
    chosen = np.sort(chosen[np.lexsort((names[chosen], -(odds / error)[chosen]))][:MAX_FEATURES])
    return Model(names[chosen], np.clip(odds[chosen], 0, 6), -4.0, 0.02)


def hits_of(model: Model, raw: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text: the numbers of its sentences with chosen features and of these features, one pair a hit."""
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(raw)
    for lo, _, data, starts in blocks(raw):
        s = sentences(data, starts)
        hit, at = model.found(s.features)
        pairs = np.unique(s.sentence[hit] * np.int64(len(model.features) or 1) + at)
        sentence, which = pairs // (len(model.features) or 1), pairs % (len(model.features) or 1)
        owner = s.text[sentence]
        edges = np.searchsorted(owner, np.arange(len(starts)))
        for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            found[lo + i] = (sentence[a:b], which[a:b])
    return found


@dataclass
class Bags:
    """Texts as bags of sentences: label of each text, text of each sentence, and (sentence, feature) of each hit.

    Sentences without any chosen feature aren't in it: what they may add to a text's score is left to the leak.
    """

    labels: np.ndarray
    owner: np.ndarray
    row: np.ndarray
    which: np.ndarray

    @classmethod
    def of(cls, hits: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Bags:
        owner, row, which, base = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for text, (sentence, features) in enumerate(hits):
            names, code = np.unique(sentence, return_inverse=True)
            owner.append(np.full(len(names), text))
            row.append(code + base)
            which.append(np.asarray(features))
            base += len(names)
        return cls(np.asarray(labels, dtype=float), *(np.concatenate(x) for x in (owner, row, which)))

    def log_q(self, w: np.ndarray, b: float, leak: float) -> np.ndarray:
        """log(1 - score) of each text."""
        z = b + np.bincount(self.row, w[self.which], len(self.owner))
        return np.log1p(-leak) + np.bincount(self.owner, -np.logaddexp(0, z), len(self.labels))


def regressed(model: Model, bags: Bags, weight: np.ndarray, decay: float, steps: int = 300, rate: float = 0.1) -> Model:
    """Weights, bias and leak by gradient steps on the likelihood of the labels; ``weight``: of each text in it."""
    labels, owner, row, which = bags.labels, bags.owner, bags.row, bags.which
    w, b, leak = model.weights.copy(), model.bias, np.log(model.leak)
    m, v, total = np.zeros(len(w) + 2), np.zeros(len(w) + 2), max(weight.sum(), 1e-9)
    for step in range(1, steps + 1):
        z = b + np.bincount(row, w[which], len(owner))
        p = 1 / (1 + np.exp(-z))
        base_p = np.exp(min(leak, -0.7))
        q = np.exp(np.log1p(-base_p) + np.bincount(owner, -np.logaddexp(0, z), len(labels)))
        slope = weight * np.where(labels > 0, q / np.maximum(1 - q, 1e-9), -1.0)  # of the likelihood's fall, by log_q
        by_z = -slope[owner] * p
        grad = np.concatenate((np.bincount(which, by_z[row], len(w)) / total + decay * w, [by_z.sum() / total], [(-slope * base_p / (1 - base_p)).sum() / total]))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b, leak = w - move[:-2], b - move[-2], leak - move[-1]
    return Model(model.features, w, float(b), float(np.exp(min(leak, -0.7))))


def learned(model: Model, bags: Bags, share: float | None = None) -> Model:
    """The model fitted to ``bags``; ``share``: of toxic texts among all labelled ones, where the sample differs.

    The decay is the one under which texts of a fold are likeliest by the models of the other folds, over all folds of the
    training rows; no other row has a say in it.
    """
    labels = bags.labels
    n_yes = labels.sum()
    if not len(model.features):
        return Model(model.features, model.weights, -20.0, float(np.clip(n_yes / max(1, len(labels)) if share is None else share, 1e-6, 0.5)))
    weight = np.ones(len(labels))
    if share is not None and 0 < share < 1:
        weight = np.where(labels > 0, share / n_yes, (1 - share) / (len(labels) - n_yes)) * len(labels)
    # each class is dealt out in turn
    fold = np.zeros(len(labels), dtype=np.int64)
    for c in (0, 1):
        own = np.flatnonzero((labels > 0) == c)
        fold[own] = np.arange(len(own)) % FOLDS

    def loss(decay: float) -> float:
        found = 0.0
        for k in range(FOLDS):
            one = regressed(model, bags, weight * (fold != k), decay)
            log_q = bags.log_q(one.weights, one.bias, one.leak)
            likely = np.where(labels > 0, np.log(np.maximum(-np.expm1(log_q), 1e-12)), log_q)
            found -= float((weight * likely)[fold == k].sum())
        return found

    best = min(DECAYS, key=loss) if min(n_yes, len(labels) - n_yes) >= FOLDS else DECAYS[1]
    return regressed(model, bags, weight, best)


def fit(texts: list[str | None], labels: np.ndarray, share: float | None = None) -> Model:
    """The model of texts that are at hand; :func:`train` does the same with a table."""
    labels = np.asarray(labels, dtype=float)
    if not len(labels) or labels.min() == labels.max():
        return Model()
    raw = prepared(texts)
    model = chosen_model(*feature_counts(raw, labels), labels.sum(), len(labels) - labels.sum())
    return learned(model, Bags.of(hits_of(model, raw), labels), share)


def training_rows(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) that may be learnt from: those whose crc32 of the id as text isn't 1 modulo 3."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    return known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Fit on at most ``per_class`` labelled documents of each class, those with the smallest hashes of the id, none
    longer than SAMPLE_CHARS; of different texts under one id, the least.

    Texts stay with the executors: features are counted there, and the driver gets the counts of those that toxic texts
    have often, then the hits of the chosen ones in the sample.
    """
    rows = training_rows(labels)
    share = rows.agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0]
    order = F.xxhash64("doc_id")
    sample = rows.where("toxic > 0").orderBy(order, "doc_id").limit(per_class).unionByName(rows.where("toxic <= 0").orderBy(order, "doc_id").limit(per_class))
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS)).join(F.broadcast(sample), "doc_id")  # at most 2 * per_class ids
    got = written(texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max((F.col("toxic") > 0).cast("double")).alias("toxic")), "training-texts")
    n_yes, n = got.agg(F.sum("toxic"), F.count("*")).first()
    if not n or not 0 < n_yes < n:
        return Model()

    def counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, yes, no = feature_counts(prepared(batch.column("text").to_pylist()), batch.column("toxic").to_numpy(zero_copy_only=False))
            yield pa.record_batch([pa.array(names.view(np.int64)), pa.array(yes), pa.array(no)], names=["feature", "yes", "no"])

    summed = got.mapInArrow(counts, "feature long, yes double, no double").groupBy("feature").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    # what chosen_model would drop needn't travel
    odds = F.log((F.col("yes") + 0.5) / (n_yes - F.col("yes") + 0.5)) - F.log((F.col("no") + 0.5) / (n - n_yes - F.col("no") + 0.5))
    likely = summed.where((F.col("yes") >= LEAST_DOCUMENTS) & (odds > 1.99)).toArrow()
    names = likely.column("feature").to_numpy().view(np.uint64)
    by_name = np.argsort(names)
    model = chosen_model(names[by_name], *(likely.column(c).to_numpy()[by_name] for c in ("yes", "no")), n_yes, n - n_yes)

    def hits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = hits_of(model, prepared(batch.column("text").to_pylist()))
            yield pa.record_batch([batch.column("doc_id"), batch.column("toxic"), *(pa.array([x[i] for x in found], pa.list_(pa.int64())) for i in (0, 1))], names=["doc_id", "toxic", "sentence", "which"])

    bags = got.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic", "text").mapInArrow(hits, "doc_id long, toxic double, sentence array<long>, which array<long>").orderBy("doc_id").toArrow()
    pairs = [(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)) for a, b in zip(bags.column("sentence").to_pylist(), bags.column("which").to_pylist(), strict=True)]
    return learned(model, Bags.of(pairs, bags.column("toxic").to_numpy()), share)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, offending) of each row of (doc_id, text); offending: spans start:end, the worst first, by commas.

    No shuffle; the model that goes to each task has at most MAX_FEATURES weights.
    """

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                scores, located = model.score(part.column("text").to_pylist())
                yield pa.record_batch([part.column("doc_id"), pa.array(scores), pa.array([",".join(f"{a}:{b}" for a, b in x) for x in located], pa.string())], names=["doc_id", "score", "offending"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, "doc_id long, score double, offending string")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below ``threshold``. No shuffle."""

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series(model.score([t if isinstance(t, str) else None for t in texts])[0])

    return docs.where(score("text") < threshold)
