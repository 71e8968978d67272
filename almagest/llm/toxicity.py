"""Toxicity by a sparse logistic model with counterfactual regularisation.

Features are the words of a text (runs of letters and digits, A-Z as a-z) and
their first four to eight bytes, each as "occurs", "occurs twice" and "occurs four
times", hashed to 64 bits of which the last two are that level.  The model is
fitted on a bounded sample of labelled rows.  Besides log loss and an L1
penalty it pays for every *counterfactual pair*: a labelled text and the same text with
its identity terms swapped, word by word, for others of the same kind must score alike, so a
group that is named is no evidence by itself.  A text that names groups is paired
with each substitute; every text that names none gets a pair in which a group is
named, and one in which another is.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almagest.llm.common import LETTERS, chunked, labelled_sample, lower_case, text_bytes, trim, word_hashes, words
from almagest.sources.runtime import delete, materialise

_PREFIXES = (4, 5, 6, 7, 8)
_LEVEL = np.uint64(3)
_LEVELS = (1, 2, 4)
#: Terms of one kind may stand for each other.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "transgender"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab", "indigenous"),
    ("gay", "lesbian", "bisexual", "straight", "queer"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "blind", "deaf", "elderly", "young"),
    ("frauen", "männer", "muslime", "christen", "juden", "ausländer"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes"),
)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature hash) of every word and word prefix, with repetitions."""
    data = lower_case(data)
    starts, ends, rows = words(data, offsets, LETTERS)
    keys, where = [word_hashes(data, starts, ends)], [rows]
    for size in _PREFIXES:
        long = ends - starts > size
        keys.append(word_hashes(data, starts[long], starts[long] + size, salt=1))
        where.append(rows[long])
    return np.concatenate(where), np.concatenate(keys)


def features_of(texts: list[str]) -> list[np.ndarray]:
    """Distinct features of each text, ascending."""
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    rows, keys = features(data, offsets)
    keys &= ~_LEVEL
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])
    count = np.diff(np.append(np.flatnonzero(new), len(rows)))
    rows, keys = rows[new], keys[new]
    parts = [(rows[count >= n], keys[count >= n] | np.uint64(level)) for level, n in enumerate(_LEVELS)]
    rows, keys = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.lexsort((keys, rows))
    return np.split(keys[order], np.searchsorted(rows[order], np.arange(1, len(texts))))


class Model:
    """Weights of the selected features by level (ascending hashes) and the intercept."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        used = weights != 0
        self.bias, keys, weights = bias, keys[used], weights[used]
        self.keys, at = np.unique(keys & ~_LEVEL, return_inverse=True)
        self.weights = np.zeros((len(self.keys), len(_LEVELS)))
        self.weights[at, (keys & _LEVEL).astype(np.int64)] = weights
        self.maybe = np.zeros(1 << 18, dtype=bool)
        self.maybe[(self.keys >> np.uint64(46)).astype(np.int64)] = True

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows, keys = features(data, offsets)
        total = np.full(len(offsets) - 1, self.bias)
        hit = np.flatnonzero(self.maybe[(keys >> np.uint64(46)).astype(np.int64)])
        if len(hit):
            rows, keys = rows[hit], keys[hit] & ~_LEVEL
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            same = self.keys[at] == keys
            pairs, count = np.unique(rows[same] * len(self.keys) + at[same], return_counts=True)
            for level, n in enumerate(_LEVELS):
                some = pairs[count >= n]
                total += np.bincount(some // len(self.keys), weights=self.weights[some % len(self.keys), level], minlength=len(total))
        return total

    def scores(self, texts: list[str]) -> np.ndarray:
        return _sigmoid(self.logits(*text_bytes(pa.array(texts, pa.string()))))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def counterfactuals(text: str, identity=IDENTITY_TERMS) -> list[str]:
    """The text with its identity terms, word by word, replaced by others of their kind, once for each substitute; a text without one, with a term of some kind after it, and with another."""
    groups = [[t.encode() for t in g] for g in identity]
    if not groups:
        return []
    place = {t: (g, k) for g, group in enumerate(groups) for k, t in enumerate(group)}
    raw = text.encode()
    low = lambda w: lower_case(np.frombuffer(w, np.uint8)).tobytes()
    named = {place[w][0] for w in (low(m.group()) for m in _WORD.finditer(raw)) if w in place}
    if named:

        def other(turn: int):
            def swap(m):
                found = place.get(low(m.group()))
                return m.group() if found is None else groups[found[0]][(found[1] + turn) % len(groups[found[0]])]

            return _WORD.sub(swap, raw).decode()

        out = [other(turn) for turn in range(1, max(len(groups[g]) for g in named))]
    else:
        number = zlib.crc32(raw)
        group = groups[number % len(groups)]
        out = [f"{text} {group[(number // len(groups) + turn) % len(group)].decode()}" for turn in range(2)]
    return [t for t in dict.fromkeys(out) if t != text]


def gaps(text: str, identity=IDENTITY_TERMS) -> list[tuple[np.ndarray, np.ndarray]]:
    """What a text has and each of its counterfactuals has not, and the reverse; what they share has no part in the gap."""
    own, out = features_of([text])[0], []
    for other in counterfactuals(text, identity):  # one at a time, as a text may be very long
        other = features_of([other])[0]
        out.append((np.setdiff1d(own, other, assume_unique=True), np.setdiff1d(other, own, assume_unique=True)))
    return out


def strength(positive, seen, n_positive, n_seen, where=np.where, sqrt=np.sqrt, log=np.log, absolute=np.abs):
    """How far a feature's rate in label 1 is from that in label 0, in standard errors; 0 for one seen once.  For numbers or columns alike."""
    p1, p0 = (positive + 0.5) / (n_positive + 1), (seen - positive + 0.5) / (n_seen - n_positive + 1)
    z = absolute(log(p1 / p0)) / sqrt(1 / (positive + 0.5) + 1 / (seen - positive + 0.5))
    return where(seen < 2, 0.0, z)


def constant(labels: np.ndarray) -> Model:
    rate = float(labels.mean()) if len(labels) else 0.5
    return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log((rate + 0.01) / (1.01 - rate))))


def fit_features(chosen: np.ndarray, found: list[np.ndarray], pairs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, shares: np.ndarray, l1: float = 3e-5, counterfactual: float = 1.0, steps: int = 300) -> Model:
    """Fit the weights of the ``chosen`` features (ascending) on each sample text's features.

    ``pairs`` are the two sides of each gap that shall have no effect; ``shares``
    holds each row's class share, which restores the natural rate.  With one class
    only, or no rows, the model is constant.
    """
    labels = np.asarray(labels, dtype=float)
    if not len(labels) or labels.min() == labels.max() or not len(chosen):
        return constant(labels)

    def matrix(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        size = [len(r) for r in rows]
        flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
        place = np.minimum(np.searchsorted(chosen, flat), len(chosen) - 1)
        ok = chosen[place] == flat
        return np.repeat(np.arange(len(rows)), size)[ok], place[ok]

    r, c = matrix(found)
    ra, ca = matrix([p[0] for p in pairs])
    rb, cb = matrix([p[1] for p in pairs])
    n, m = len(found), len(pairs)
    per_class = np.array([(labels == v).sum() for v in (0.0, 1.0)])
    weight = np.asarray(shares) / per_class[labels.astype(int)]
    weight /= weight.sum()
    w, bias, momentum = np.zeros(len(chosen)), float(np.log((weight * labels).sum() / (weight * (1 - labels)).sum())), 1.0
    # a bound of the curvature, coordinate by coordinate: rare features may take large steps
    row_size = np.bincount(r, minlength=n) + 1.0
    curve = 0.25 * np.bincount(c, weights=(weight * row_size)[r], minlength=len(chosen))
    if m:
        spread = np.bincount(ra, minlength=m) + np.bincount(rb, minlength=m)
        for rows, cols in ((ra, ca), (rb, cb)):
            curve += 2 * counterfactual / m * np.bincount(cols, weights=spread[rows], minlength=len(chosen))
    step, bias_step = 1 / np.maximum(curve, 1e-9), 1 / (0.25 * (weight * row_size).sum())
    look, look_bias = w, bias
    for _ in range(steps):  # accelerated proximal gradient
        p = _sigmoid(np.bincount(r, weights=look[c], minlength=n) + look_bias)
        error = weight * (p - labels)
        grad = np.bincount(c, weights=error[r], minlength=len(chosen))
        if m:
            gap = np.bincount(ra, weights=look[ca], minlength=m) - np.bincount(rb, weights=look[cb], minlength=m)
            push = 2 * counterfactual / m * gap
            grad += np.bincount(ca, weights=push[ra], minlength=len(chosen)) - np.bincount(cb, weights=push[rb], minlength=len(chosen))
        new = look - step * grad
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_bias = look_bias - bias_step * error.sum()
        after = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        look, look_bias = new + (momentum - 1) / after * (new - w), new_bias + (momentum - 1) / after * (new_bias - bias)
        w, bias, momentum = new, new_bias, after
    return Model(chosen, w, float(bias))


def fit_texts(texts: list[str], labels, shares=None, identity=IDENTITY_TERMS, selected: int = 4000, **options) -> Model:
    """Fit on texts at hand; see ``fit``."""
    labels = np.asarray(labels, dtype=float)
    if not len(labels) or labels.min() == labels.max():
        return constant(labels)
    if shares is None:
        shares = np.array([(labels == v).mean() for v in labels])
    found = features_of(texts)
    vocabulary, at = np.unique(np.concatenate(found), return_inverse=True)
    positive, seen = np.bincount(at, weights=np.repeat(labels, [len(f) for f in found])), np.bincount(at)
    z = strength(positive, seen, labels.sum(), len(labels))
    chosen = np.sort(vocabulary[np.lexsort((vocabulary.view(np.int64), -z))[:selected]])
    terms = terms_of(identity)
    chosen = np.union1d(chosen, vocabulary[np.isin(vocabulary & ~_LEVEL, terms)])
    return fit_features(chosen, found, [p for t in texts for p in gaps(t, identity)], labels, shares, **options)


def terms_of(identity) -> np.ndarray:
    """Features, of whatever level, of the identity terms."""
    terms = [t for g in identity for t in g]
    return np.unique(features(*text_bytes(pa.array(terms, pa.string())))[1] & ~_LEVEL) if terms else np.zeros(0, np.uint64)


def _counted(batches):
    """The features of each sample text, one row each."""
    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("label").to_pylist()):
            found = features_of([text.as_py() or ""])[0]
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.full(len(found), label), pa.int32())], names=["feature", "label"])


def _sampled(batches, chosen: np.ndarray, identity):
    """Of each sample text the chosen features, and those of its gaps (sizes and features end to end)."""
    keep = lambda x: x[np.isin(x, chosen)]
    for batch in batches:
        for i, text in enumerate(batch.column("text")):
            text = text.as_py() or ""
            sides = [keep(x) for pair in gaps(text, identity) for x in pair]
            raw = [keep(features_of([text])[0]).tobytes(), np.array([len(x) for x in sides], "<i4").tobytes(), b"".join(x.tobytes() for x in sides)]
            yield pa.RecordBatch.from_arrays([batch.column("label").slice(i, 1), batch.column("share").slice(i, 1), *(pa.array([r], pa.binary()) for r in raw)], names=["label", "share", "found", "sizes", "gaps"])
        trim()


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, per_class: int = 3000, identity=IDENTITY_TERMS, selected: int = 4000, **options) -> Model:
    """Fit on at most ``per_class`` labelled training rows of each class; texts with equal features count once.

    Features are counted in executors and the ``selected`` most telling ones, and
    the identity terms', chosen; the driver then holds the chosen features of the
    sample's texts, at most 2 * per_class * selected numbers and as many a counterfactual.
    """
    spark = docs.sparkSession
    sample = materialise(labelled_sample(docs, labels, label, folds, per_class).select("text", "label", "share"), "labelled")
    sizes = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        rows = np.repeat(np.array([*sizes], float), [*sizes.values()]) if sizes else np.zeros(0)
        delete(sample)
        return constant(rows)
    counted = sample.repartition(64).mapInArrow(_counted, "feature long, label int").groupBy("feature").agg(F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("k"), F.count("*").alias("n"))
    z = strength(F.col("k"), F.col("n"), sizes.get(1, 0), sum(sizes.values()), lambda test, a, b: F.when(test, a).otherwise(b), F.sqrt, F.log, F.abs)
    terms = spark.createDataFrame([(int(t),) for t in terms_of(identity).view(np.int64)], "term long")
    best = counted.where("n > 1").coalesce(16).orderBy(F.desc(F.round(z, 9)), "feature").limit(selected).select("feature")
    named = counted.join(F.broadcast(terms), F.col("feature").bitwiseAND(F.lit(~3)) == F.col("term")).select("feature")
    chosen = np.unique(best.union(named).toPandas().feature.to_numpy(np.int64).view(np.uint64))
    spread = sample.repartition(64)  # whole texts differ much in size
    found = materialise(spread.mapInArrow(lambda it: _sampled(it, chosen, identity), "label int, share double, found binary, sizes binary, gaps binary"), "sampled")
    rows = sorted({(r.label, r.share, bytes(r.found), bytes(r.sizes), bytes(r.gaps)) for r in found.toLocalIterator()})
    delete(sample)
    delete(found)
    pairs = []
    for r in rows:
        sides = np.split(np.frombuffer(r[4], np.uint64), np.cumsum(np.frombuffer(r[3], "<i4"))[:-1]) if r[3] else []
        pairs += list(zip(sides[::2], sides[1::2]))
    return fit_features(chosen, [np.frombuffer(r[2], np.uint64) for r in rows], pairs, np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), **options)


def _scored(batches, model: Model):
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        scores = [_sigmoid(model.logits(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])) for lo, hi in chunked(offsets)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=[*batch.schema.names[:-1], "score"])
        trim()


def score(docs: DataFrame, model: Model, carry: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, *carry) for every row; null and empty texts get the intercept's score.

    The model (at most a few thousand weights) goes out with the tasks.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("score", T.DoubleType())])
    out = rows.mapInArrow(lambda it: _scored(it, model), schema)
    return out.select("doc_id", "score", *(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)))


def held_out(folds: int = 5):
    """False for a row without an id, though such a row is never learnt from either."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
