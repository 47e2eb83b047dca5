"""Quality classifier with hierarchical empirical Bayes.

A logistic regression over letter and word statistics, fitted on a bounded hashed sample of labelled documents, gives each document
evidence for good quality. All documents' probabilities are summed by host and path. A host's share of good documents is shrunk toward the
global share and a path's toward its host's, each with a strength estimated from how much the groups differ (method of moments),
so sparse sites stand near the prior. A document's posterior log-odds are its evidence plus the log-odds of its path.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import SMALL_SLICE, lean, python_tasks, slices, split_words, string_buffers, written

#: Labelled documents the classifier is fitted on, at most, chosen by a hash of their doc_id.
SAMPLE = 20_000
THRESHOLD = 0.5
FLOOR = 1e-6

_GROUPS = ["!", "?", "|", "#$%&*@^~+=<>", "0123456789", ".,;:", "\"'()[]{}-_/\\", "\n", " \t\r\x0b\x0c", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"]
N_FEATURES = len(_GROUPS) + 6


def _group_matrix() -> np.ndarray:
    out = np.zeros((256, len(_GROUPS) + 1))
    for k, letters in enumerate(_GROUPS):
        out[[ord(x) for x in letters], k] = 1
    out[128:, len(_GROUPS)] = 1
    return out


_MATRIX = _group_matrix()


def features(texts: pa.Array) -> np.ndarray:
    """A row of statistics for each text: shares of byte groups, words repeated at once, word lengths, sizes."""
    data, offsets = string_buffers(texts)
    out = np.zeros((len(offsets) - 1, N_FEATURES))
    for a, b in slices(offsets, SMALL_SLICE):
        own, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        counts = np.array([np.bincount(own[x:y], minlength=256) for x, y in zip(at[:-1], at[1:], strict=True)]) @ _MATRIX
        starts, ends, hashes, first = split_words(own, at)
        words = np.diff(first)
        again = np.zeros(len(hashes) + 1)
        again[1:-1] = np.cumsum(hashes[1:] == hashes[:-1]) if len(hashes) > 1 else 0
        again[-1] = again[-2] if len(hashes) else 0
        repeats = np.maximum(0, again[np.maximum(first[1:] - 1, 0)] - again[first[:-1]])
        n = np.maximum(1, np.diff(at))
        per_word = np.maximum(1, words)
        out[a:b, : counts.shape[1]] = np.sqrt(counts / n[:, None])
        out[a:b, -5] = repeats / per_word
        out[a:b, -4] = np.sqrt(repeats / per_word)
        out[a:b, -3] = n / per_word / 10
        out[a:b, -2] = np.log1p(words)
        out[a:b, -1] = words < 20
    return out


@dataclass(frozen=True)
class Model:
    """Standardised weights; ``base`` is the log-odds of good among the labelled documents."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    base: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - np.array(self.mean)) / np.array(self.scale), -10, 10)
        return z @ np.array(self.weights[1:]) + self.weights[0]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> Model:
    """Ridge logistic regression by Newton steps. With one class only the evidence is 0 for all."""
    width = x.shape[1] if x.ndim == 2 else N_FEATURES
    if len(y) == 0 or y.min() == y.max():
        return Model((0.0,) * width, (1.0,) * width, (0.0,) * (width + 1), 0.0)
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.column_stack([np.ones(len(x)), np.clip((x - mean) / scale, -10, 10)])
    w = np.zeros(width + 1)
    penalty = np.full(width + 1, ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    share = y.mean()
    return Model(tuple(mean.tolist()), tuple(scale.tolist()), tuple(w.tolist()), math.log(share / (1 - share)))


def _as_array(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _over_batches(f: Callable[[pa.Array], pa.Array], kind: str) -> Callable[[Column], Column]:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return lean(lambda texts: map(f, texts))(batches)

    return F.arrow_udf(run, kind)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents. Labels without quality or doc_id are left out; a doc_id counts once."""
    python_tasks(docs.sparkSession)
    chosen = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("_y")).where("_id IS NOT NULL AND _y IS NOT NULL")
    chosen = chosen.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    statistics = _over_batches(lambda texts: _as_array(features(texts)), "array<double>")
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))  # at most ``sample`` rows
    rows = known.select("doc_id", "_y", statistics("text").alias("x")).groupBy("doc_id").agg(F.min(F.struct("_y", "x")).alias("r"))
    rows = rows.select("doc_id", "r.*").collect()
    rows.sort(key=lambda r: r["doc_id"])
    return fit(np.array([r["x"] for r in rows]), np.array([r["_y"] for r in rows]))


def evidence(model: Model, text: Column) -> Column:
    """Log likelihood ratio of good quality, the labelled share taken out."""
    return _over_batches(lambda texts: pa.array(model.log_odds(features(texts)) - model.base), "double")(text)


def _strength(groups: DataFrame, center: Column) -> Column:
    """How many observations the prior is worth: from the spread of the groups' shares about ``center``."""
    share = F.col("good") / F.col("n")
    spread = F.sum(F.col("n") * (share - center) * (share - center))
    noise = F.sum(center * (1 - center) * (1 - F.col("n") / F.col("n_above")))
    room = F.sum(F.col("n") * (1 - F.col("n") / F.col("n_above")))
    variance = F.greatest((spread - noise) / room, F.lit(1e-9))
    inside = F.avg(center * (1 - center))
    return F.coalesce(F.least(F.greatest(inside / variance - 1, F.lit(1.0)), F.lit(1e6)), F.lit(1.0))


def site_priors(scored: DataFrame, path: str = "_path") -> DataFrame:
    """``_host, path, host_share, path_share``: posterior means of the share of good documents, one row a path.

    ``scored`` has ``_host, _path, _good`` (probability in millionths, summed exactly).
    """
    paths = scored.groupBy("_host", "_path").agg(F.sum("_good").alias("good"), F.count(F.lit(1)).alias("n"))
    paths = written(paths.withColumn("good", F.col("good") / 1e6), "quality-paths")
    hosts = paths.groupBy("_host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    total = hosts.agg((F.sum("good") / F.sum("n")).alias("share"), F.sum("n").alias("n"))
    hosts = hosts.withColumn("share", total.select("share").scalar()).withColumn("n_above", total.select("n").scalar())
    hosts = written(hosts, "quality-hosts")
    strength = hosts.agg(_strength(hosts, F.col("share")).alias("s")).scalar()
    hosts = hosts.select(
        F.col("_host").alias("_h"), F.col("n").alias("n_above"), ((F.col("good") + strength * F.col("share")) / (F.col("n") + strength)).alias("host_share")
    )
    both = paths.join(hosts, F.col("_host").eqNullSafe(F.col("_h"))).drop("_h")
    both = written(both, "quality-sites")
    strength = both.where("n < n_above").agg(_strength(both, F.col("host_share")).alias("s")).scalar()
    share = (F.col("good") + strength * F.col("host_share")) / (F.col("n") + strength)
    return written(both.select("_host", "_path", "host_share", share.alias("path_share")), "quality-priors")


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(FLOOR)), F.lit(1 - FLOOR))
    return F.log(p / (1 - p))


def with_posterior(rows: DataFrame, priors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (``_evidence, _host, _path``) with ``host_share, path_share, posterior, accepted``."""
    named = priors.select(F.col("_host").alias("_h"), F.col("_path").alias("_p"), "host_share", "path_share")
    rows = rows.join(named, F.col("_host").eqNullSafe(F.col("_h")) & F.col("_path").eqNullSafe(F.col("_p")), "left").drop("_h", "_p")
    evident = F.coalesce("_evidence", F.lit(0.0))  # never null; said so, a filter on the posterior doesn't test the texts' evidence for null in a pass of its own
    posterior = 1 / (1 + F.exp(-(evident + _logit(F.col("path_share")))))
    return rows.withColumn("posterior", posterior).withColumn("accepted", F.col("posterior") >= threshold)


def _good(model: Model) -> Column:
    p = 1 / (1 + F.exp(-(F.col("_evidence") + F.lit(model.base))))
    return F.round(p * 1e6).cast("long").alias("_good")


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, evidence, host_share, path_share, posterior, accepted`` for every row of ``docs``.

    Null and empty texts have the statistics of an empty text. A null host or path is a site of its own. Rows that repeat are judged alike. Without labels of both
    kinds the evidence is 0. Empty table: no rows. Columns other than doc_id, text, host and path are not looked at.
    """
    model = train(docs, labels, sample)
    rows = docs.select("doc_id", F.col(host).alias("_host"), F.col(path).alias("_path"), evidence(model, F.col("text")).alias("_evidence"))
    rows = written(rows, "quality-rows")
    priors = site_priors(rows.select("_host", "_path", _good(model)))
    done = with_posterior(rows, priors, threshold)
    return done.select("doc_id", F.col("_evidence").alias("evidence"), "host_share", "path_share", "posterior", "accepted")


def accepted(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The accepted documents with their own columns. The evidence is computed again beside the text, so texts are joined with one row a site only."""
    model = train(docs, labels, sample)
    judged = docs.select(F.col(host).alias("_host"), F.col(path).alias("_path"), evidence(model, F.col("text")).alias("_evidence"))
    priors = site_priors(judged.select("_host", "_path", _good(model)))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    whole = whole.select("_row", F.col("_row")[host].alias("_host"), F.col("_row")[path].alias("_path"), evidence(model, F.col("_row.text")).alias("_evidence"))
    return with_posterior(whole, priors, threshold).where("accepted").select("_row.*")
