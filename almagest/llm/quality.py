"""Quality by a sparse ensemble of rules.

Statistics of a text are computed once, as plain columns.  On a bounded sample
of labelled rows, shallow trees are grown one after another on what the last
ones left; every path from a root to a node is a conjunctive rule ("symbols >
0.1 and mean word <= 7").  Lasso-penalised logistic weights keep few of them,
and the kept rules are compiled into one Spark column expression over the
statistics.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almagest.llm.common import chunked, id_text, labelled_sample, text_bytes, trim, word_hashes, words

#: Statistics of a text, in column order.
STATISTICS = (
    "bytes", "words", "mean_word", "longest_word", "upper", "digits", "symbols", "marks", "bars", "wide", "breaks",
    "distinct_words", "commonest_word", "distinct_lines", "mean_line", "ended_lines", "long_words", "capital_words", "distinct_pairs",
)

_CLASS = np.zeros((6, 256), dtype=bool)
for _row, _members in enumerate((range(65, 91), range(48, 58), b"#$%&*@^~<>{}[]\\/=+_", b"!?", b"|", range(128, 256))):
    _CLASS[_row, list(_members)] = True


def _distinct(rows: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each row, and the count of its commonest key."""
    order = np.lexsort((keys, rows))
    r, k = rows[order], keys[order]
    new = np.ones(len(r), dtype=bool)
    new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    at = np.flatnonzero(new)
    most = np.zeros(n, dtype=np.int64)
    np.maximum.at(most, r[at], np.diff(np.append(at, len(r))))
    return np.bincount(r[at], minlength=n), most


def _segments(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flag)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS per text; an empty text has zeros."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    whole = np.maximum(size, 1)
    starts, ends, rows = words(data, offsets)
    lengths, hashes = ends - starts, word_hashes(data, starts, ends, lower=True)
    n_words = np.bincount(rows, minlength=n).astype(float)
    per = np.maximum(n_words, 1)
    distinct, commonest = _distinct(rows, hashes, n)
    inner = np.flatnonzero(rows[1:] == rows[:-1])
    pairs, _ = _distinct(rows[inner], hashes[inner] * np.uint64(0x9E3779B97F4A7C15) + hashes[inner + 1], n)
    longest = np.zeros(n)
    np.maximum.at(longest, rows, lengths)
    is_break = data == 10
    breaks = _segments(is_break, offsets)
    line = np.concatenate([[0], np.cumsum(is_break)])[starts]  # the line of each word, over all texts
    first = np.ones(len(starts), dtype=bool)
    first[1:] = (line[1:] != line[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(first)
    order = np.arange(len(starts)) - np.repeat(at, np.diff(np.append(at, len(starts))))
    key = np.add.reduceat(hashes * (order.astype(np.uint64) * np.uint64(2) + np.uint64(1)), at) if len(at) else hashes
    lines = np.bincount(rows[at], minlength=n)
    distinct_lines, _ = _distinct(rows[at], key, n)
    last = np.append(at[1:], len(starts)) - 1 if len(at) else at
    ended = np.bincount(rows[at], weights=np.isin(data[ends[last] - 1], list(b'.!?"')), minlength=n) if len(at) else np.zeros(n)
    shares = [_segments(flag, offsets) / whole for flag in _CLASS[:, data]]
    capital = np.bincount(rows, weights=_CLASS[0][data[starts]], minlength=n)
    long = np.bincount(rows, weights=lengths > 14, minlength=n)
    total = np.bincount(rows, weights=lengths, minlength=n)
    return np.stack([
        size, n_words, total / per, longest, *shares, breaks / whole,
        distinct / per, commonest / per, distinct_lines / np.maximum(lines, 1), n_words / np.maximum(lines, 1), ended / np.maximum(lines, 1),
        long / per, capital / per, pairs / np.maximum(n_words - 1, 1),
    ], axis=1)


def _with_statistics(batches):
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        parts = [statistics(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in chunked(offsets)]
        table = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, table.T)], names=[*batch.schema.names[:-1], *STATISTICS])
        trim()


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, *STATISTICS), doubles, for every row; null text counts as empty."""
    return id_text(docs, id_col, text_col).mapInArrow(_with_statistics, "doc_id long, " + ", ".join(f"{c} double" for c in STATISTICS))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above?, threshold), all of which must hold


def _grow(x: np.ndarray, residual: np.ndarray, weight: np.ndarray, rows: np.ndarray, depth: int, least: int, path: Rule, rules: list[Rule], out: np.ndarray, cuts: list[np.ndarray]) -> None:
    """One regression tree on ``residual``; its paths go to ``rules``, its leaf means to ``out``."""
    w, r = weight[rows], residual[rows]
    mean = (w * r).sum() / w.sum()
    best = (1e-9, None)
    if depth and len(rows) >= 2 * least:
        for j in range(x.shape[1]):
            if not len(cuts[j]):
                continue
            place = np.searchsorted(cuts[j], x[rows, j])  # values above cut k have a place over k
            many = np.bincount(place, minlength=len(cuts[j]) + 1).cumsum()[:-1]
            mass = np.bincount(place, weights=w, minlength=len(cuts[j]) + 1).cumsum()[:-1]
            pull = np.bincount(place, weights=w * (r - mean), minlength=len(cuts[j]) + 1).cumsum()[:-1]
            ok = (many >= least) & (len(rows) - many >= least)
            gain = np.where(ok, pull**2 / np.maximum(mass, 1e-12) + pull**2 / np.maximum(w.sum() - mass, 1e-12), 0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (j, float(cuts[j][k])))
    if best[1] is None:
        out[rows] = mean
        return
    j, cut = best[1]
    for above in (False, True):
        part = rows[(x[rows, j] > cut) == above]
        here = (*path, (j, above, cut))
        rules.append(here)
        _grow(x, residual, weight, part, depth - 1, least, here, rules, out, cuts)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    ok = np.ones(len(x), dtype=bool)
    for j, above, cut in rule:
        ok &= (x[:, j] > cut) == above
    return ok


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class RuleModel:
    def __init__(self, rules: list[Rule], weights: np.ndarray, bias: float):
        self.rules, self.weights, self.bias = rules, weights, bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.bias + sum((w * holds(r, x) for r, w in zip(self.rules, self.weights)), np.zeros(len(x))))

    def column(self) -> Column:
        """The probability of label 1 as an expression over the statistics."""
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights):
            test = F.lit(True)
            for j, above, cut in rule:
                c = F.col(STATISTICS[j])
                test = test & (c > cut if above else c <= cut)
            total = total + F.when(test, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit_rules(x: np.ndarray, labels: np.ndarray, shares: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, l1: float = 1e-3, steps: int = 400) -> RuleModel:
    """Grow trees, collect their paths, and weigh the rules under an L1 penalty.

    With one class only, or no rows, the model is constant.
    """
    y = np.asarray(labels, dtype=float)
    if not len(y) or y.min() == y.max():
        p = float(y.mean()) if len(y) else 0.5
        return RuleModel([], np.zeros(0), float(np.log((p + 0.01) / (1.01 - p))))
    weight = np.asarray(shares) / np.array([(y == v).sum() for v in (0.0, 1.0)])[y.astype(int)]
    weight /= weight.sum()
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.01, 0.99, 60)))[:-1] if len(np.unique(x[:, j])) > 1 else np.zeros(0) for j in range(x.shape[1])]
    least, rules = max(5, len(y) // 400), []
    rate0 = (weight * y).sum()
    base = float(np.log(rate0 / (1 - rate0)))
    z = np.full(len(y), base)
    for _ in range(trees):
        p, out = _sigmoid(z), np.zeros(len(y))
        curve = np.maximum(p * (1 - p), 1e-3)
        _grow(x, (y - p) / curve, weight * curve, np.arange(len(y)), depth, least, (), rules, out, cuts)
        z += rate * np.clip(out, -4, 4)
    kept, seen = [], set()
    for rule in rules:
        on = holds(rule, x)
        key = on.tobytes()
        if key not in seen and 0 < on.sum() < len(y):
            seen.add(key)
            kept.append((rule, on))
    m = np.stack([on for _, on in kept], axis=1).astype(np.float64) if kept else np.zeros((len(y), 0))
    w, bias, look, look_bias, t = np.zeros(m.shape[1]), base, np.zeros(m.shape[1]), base, 1.0
    width = m.sum(axis=1) + 1
    step = 1 / np.maximum(0.25 * (m * (weight * width)[:, None]).sum(axis=0), 1e-9)
    bias_step = 1 / (0.25 * (weight * width).sum())
    for _ in range(steps):  # accelerated proximal gradient, a step size a rule
        error = weight * (_sigmoid(m @ look + look_bias) - y)
        new = look - step * (m.T @ error)
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_bias = look_bias - bias_step * error.sum()
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, look_bias = new + (t - 1) / after * (new - w), new_bias + (t - 1) / after * (new_bias - bias)
        w, bias, t = new, new_bias, after
    used = np.flatnonzero(w)
    return RuleModel([kept[i][0] for i in used], w[used], float(bias))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, per_class: int = 3000, **options) -> RuleModel:
    """Fit on at most ``per_class`` labelled training rows of each class; rows with equal statistics count once."""
    sample = labelled_sample(docs, labels, label, folds, per_class).select("label", "share", "text")
    rows = sample.mapInArrow(_with_statistics, "label int, share double, " + ", ".join(f"{c} double" for c in STATISTICS))
    rows = sorted(set(map(tuple, rows.collect())))
    table = np.array(rows) if rows else np.zeros((0, 2 + len(STATISTICS)))
    return fit_rules(table[:, 2:], table[:, 0], table[:, 1], **options)


def score(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row.

    Null and empty texts have the statistics of no words.  Repeated rows come back
    as often, null ids too; other columns are ignored, whatever their names.
    """
    return with_statistics(docs, id_col, text_col).select("doc_id", model.column().alias("score"))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))  # without an id: not learnt from, not held out
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
