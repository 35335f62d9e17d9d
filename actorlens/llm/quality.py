"""Quality scores by positive-unlabelled learning.

Trusted positives and unlabelled documents are turned into format features; a linear model
minimises the non-negative unbiased risk of the logistic loss under an estimated class prior:

    risk = prior * E_p[loss(+g)] + max(0, E_u[loss(-g)] - prior * E_p[loss(-g)])

Labelled negatives are never used. The class prior is estimated from a first model that tells
positives from unlabelled rows: where trusted positives still pass a threshold, the share of
unlabelled rows that pass it, relative to that of positives, bounds the prior from above; the
smallest bound is taken. Every step of the fit is a Spark job whose tasks return sums.

Defined cases: a null or empty text has all-zero counts and gets a score like any other text;
texts that repeat get equal scores; without positives or unlabelled rows every score is 0.5; labels
that are null are ignored; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actorlens.llm.arrow import arrow_schema, id_and_text, key_type, pieces
from actorlens.llm.words import shingles, text_bytes, words
from actorlens.sources.storage import release, scratch_path

#: Rows of either kind a model is fitted on at most (positives) or about (unlabelled).
FIT_ROWS = 20_000
RIDGE = 1e-3

_LOWER, _UPPER, _DIGIT, _SPACE, _LINE, _STOP, _SYMBOL, _HIGH = range(8)


def _byte_kinds() -> np.ndarray:
    kinds = np.full(256, _SYMBOL, np.uint8)
    kinds[128:] = _HIGH
    for kind, characters in (
        (_LOWER, b"abcdefghijklmnopqrstuvwxyz"),
        (_UPPER, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        (_DIGIT, b"0123456789"),
        (_SPACE, b" \t\r\v\f"),
        (_LINE, b"\n"),
        (_STOP, b".,;:'\"?-()"),
    ):
        kinds[list(characters)] = kind
    return kinds


KINDS = _byte_kinds()
SHARES = 15
EDGES = (0.02, 0.1, 0.3)
#: Per share: itself, its root and a step at every edge; then the logs and the constant.
WIDTH = SHARES * (2 + len(EDGES)) + 4


def _repeats(values: np.ndarray) -> tuple[int, int]:
    """Distinct values and how often the most frequent one occurs."""
    ordered = np.sort(values)
    edges = np.flatnonzero(ordered[1:] != ordered[:-1])
    return len(edges) + 1, int(np.diff(edges, prepend=-1, append=len(ordered) - 1).max())


def shares(data: np.ndarray, hashes: np.ndarray, lengths: np.ndarray, last: np.ndarray) -> list[float]:
    """Format shares of a text between 0 and 1, of its bytes and its words."""
    n, size = len(hashes), len(data)
    counts = np.bincount(KINDS[data], minlength=8).tolist()
    values = [
        counts[_UPPER] / max(1, counts[_LOWER] + counts[_UPPER]),
        counts[_DIGIT] / max(1, size),
        counts[_SYMBOL] / max(1, size),
        counts[_STOP] / max(1, size),
        counts[_HIGH] / max(1, size),
        min(1.0, counts[_LINE] / max(1, n)),
    ]
    if not n:
        return values + [0.0] * (SHARES - len(values))
    pairs, fives = shingles(hashes, 2), shingles(hashes, 5)
    distinct, most = _repeats(hashes)
    return values + [
        np.count_nonzero(KINDS[last] == _SYMBOL) / n,
        np.count_nonzero(lengths == 1) / n,
        np.count_nonzero(lengths > 14) / n,
        min(1.0, int(lengths.sum()) / n / 20),
        np.count_nonzero(hashes[1:] == hashes[:-1]) / n,
        1 - distinct / n,
        most / n if n > 10 else 0.0,
        1 - _repeats(pairs)[0] / len(pairs),
        1 - _repeats(fives)[0] / len(fives),
    ]


def features(texts: pa.Array) -> np.ndarray:
    """One row of features per text."""
    found = words(texts)
    data, bounds = text_bytes(texts)
    ends = zip(bounds[:-1], bounds[1:], found.bounds[:-1], found.bounds[1:], strict=True)
    rows = [
        shares(data[a:b], found.hashes[c:d], found.lengths[c:d], found.last[c:d]) for a, b, c, d in ends
    ]
    x = np.array(rows, dtype=float).reshape(-1, SHARES)
    size, n = np.diff(bounds), np.diff(found.bounds)
    tail = [np.log1p(size) / 10, np.log1p(n) / 10, n == 0, np.ones(len(x))]
    return np.hstack([x, np.sqrt(x), *[x > edge for edge in EDGES], np.array(tail, dtype=float).T])


@dataclass(frozen=True)
class QualityModel:
    """A linear score of the features; ``scale`` brings them to a spread of 1."""

    weights: tuple[float, ...]
    scale: tuple[float, ...]
    prior: float

    def score(self, docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
        """(key, score, carried columns): the probability that the text is of the positive class."""
        carried = "".join(f", `{c}` {key_type(docs, c)}" for c in carry)
        schema = f"`{key}` {key_type(docs, key)}, score double{carried}"
        target = arrow_schema(schema)
        weights = np.array(self.weights) / np.array(self.scale) if self.weights else None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                if weights is None:
                    scores = np.full(batch.num_rows, 0.5)
                else:
                    # Summed row by row: equal texts get equal scores whatever else is in the batch.
                    scores = _sigmoid((features(batch.column(1)) * weights).sum(axis=1))
                columns = [batch.column(0), pa.array(scores), *batch.columns[2:]]
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) for c, f in zip(columns, target, strict=True)], schema=target
                )

        return id_and_text(docs, key, text, carry).mapInArrow(run, schema)


def _sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -40, 40)))


def _sums(sample: DataFrame, weights: np.ndarray, scale: np.ndarray) -> dict[str, np.ndarray]:
    """Sums over positives and unlabelled rows that one step needs; tasks return one row each."""
    width = len(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * (2 + 2 * width) + width * width * 2)
        for batch in batches:
            if not batch.num_rows:
                continue
            positive = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            x = batch.column(1).flatten().to_numpy().reshape(-1, width) / scale
            parts = []
            for part in (x[positive], x[~positive]):
                g = part @ weights
                s = _sigmoid(g)
                loss = np.logaddexp(0, g)
                parts += [[len(part), loss.sum()], part.sum(axis=0), part.T @ s]
                parts.append((part.T * (s * (1 - s)) @ part).ravel())
            total += np.concatenate([np.ravel(p) for p in parts])
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

    total = np.zeros(2 * (2 + 2 * width) + width * width * 2)
    for row in sample.select("positive", "x").mapInArrow(run, "sums array<double>").toLocalIterator():
        total += np.array(row["sums"])
    result, at = {}, 0
    for kind in "pu":
        for name, size in (("n", 1), ("loss", 1), ("x", width), ("sx", width), ("h", width * width)):
            result[kind + name] = total[at : at + size]
            at += size
    return result


def _fit(sample: DataFrame, scale: np.ndarray, prior: float | None, rounds: int = 12) -> np.ndarray:
    """Newton steps; without a prior the model only tells positives from unlabelled rows.

    With the logistic loss, loss(+g) - loss(-g) = -g, so the unbiased risk is convex:
    E_u[loss(-g)] - prior * E_p[g]. Whenever its negative part falls below zero, the step climbs
    that part instead, which keeps the risk non-negative.
    """
    width = len(scale)
    weights = np.zeros(width)
    for _ in range(rounds):
        s = _sums(sample, weights, scale)
        n_p, n_u = max(1.0, s["pn"][0]), max(1.0, s["un"][0])
        # Fewer positives, a plainer model.
        ridge = (RIDGE + 4 / n_p) * np.eye(width)
        ridge[-1, -1] = 0
        h_u, h_p = s["uh"].reshape(width, width) / n_u, s["ph"].reshape(width, width) / n_p
        if prior is None:
            gradient = 0.5 * (s["psx"] - s["px"]) / n_p + 0.5 * s["usx"] / n_u
            hessian = 0.5 * (h_p + h_u)
        else:
            negative = s["uloss"][0] / n_u - prior * s["ploss"][0] / n_p
            if negative >= 0:
                gradient = s["usx"] / n_u - prior * s["px"] / n_p
                hessian = h_u
            else:
                gradient = -(s["usx"] / n_u - prior * s["psx"] / n_p)
                hessian = h_u + prior * h_p
        step = np.linalg.solve(hessian + ridge + 1e-9 * np.eye(width), gradient + ridge @ weights)
        largest = np.abs(step).max()
        weights = weights - step * min(1.0, 4.0 / max(largest, 1e-12))
        if largest < 1e-6:
            break
    return weights


def _score_counts(sample: DataFrame, weights: np.ndarray, scale: np.ndarray, bins: int = 200) -> np.ndarray:
    """How many unlabelled rows and positives get at least each score, highest scores first."""
    width = len(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, bins), np.int64)
        for batch in batches:
            if batch.num_rows:
                positive = batch.column(0).to_numpy(zero_copy_only=False).astype(int)
                x = batch.column(1).flatten().to_numpy().reshape(-1, width) / scale
                place = np.minimum((_sigmoid(x @ weights) * bins).astype(int), bins - 1)
                np.add.at(counts, (positive, place), 1)
        yield pa.RecordBatch.from_arrays([pa.array([counts.ravel().tolist()], pa.list_(pa.int64()))], names=["c"])

    counts = np.zeros(2 * bins, np.int64)
    for row in sample.select("positive", "x").mapInArrow(run, "c array<bigint>").toLocalIterator():
        counts += np.array(row["c"])
    return counts.reshape(2, bins)[:, ::-1].cumsum(axis=1)


def _estimated_prior(sample: DataFrame, scale: np.ndarray) -> float:
    """Share of positives among unlabelled rows.

    Each half of the sample is scored by a model fitted on the other half. Of all thresholds the one
    with the smallest upper confidence bound counts.
    """
    estimates = []
    for half in (True, False):
        fitted = _fit(sample.filter(F.col("half") == half), scale, None, 8)
        unlabelled, positives = _score_counts(sample.filter(F.col("half") != half), fitted, scale)
        n_u, n_p = max(1, unlabelled[-1]), max(1, positives[-1])
        share_u, share_p = unlabelled / n_u, np.maximum(positives / n_p, 1e-9)
        slack = np.sqrt(np.log(20) / (2 * n_u)) + np.sqrt(np.log(20) / (2 * n_p))
        best = int(np.argmin(np.where(share_p > 0.5, (share_u + slack) / share_p, np.inf)))
        estimates.append(share_u[best] / share_p[best])
    return float(np.clip(np.mean(estimates), 0.02, 0.98))


def train(
    docs: DataFrame,
    positives: DataFrame,
    unlabelled: Column | None = None,
    fit_rows: int = FIT_ROWS,
    key: str = "doc_id",
    text: str = "text",
) -> QualityModel:
    """Fit on the texts of the keys in ``positives`` and on the rows of ``docs`` that ``unlabelled`` allows.

    At most ``fit_rows`` positives are taken, those with the smallest hash of the key, which bounds
    the list that is broadcast; and about as many unlabelled rows, by the hash of the key.
    """
    spark = docs.sparkSession
    mark = F.xxhash64(F.col(key).cast("string"))
    trusted = (
        positives.select(F.col(key)).filter(F.col(key).isNotNull()).distinct().orderBy(mark, key).limit(fit_rows)
        .select(F.col(key).alias("_key"), F.lit(True).alias("_trusted"))
    )
    allowed = F.lit(True) if unlabelled is None else F.coalesce(unlabelled, F.lit(False))
    total = docs.filter(allowed).count()
    share = min(1.0, fit_rows / max(1, total))
    drawn = F.pmod(F.xxhash64(F.lit("unlabelled"), F.col(key).cast("string")), F.lit(1 << 30)) < int(share * (1 << 30))
    rows = docs.select(F.col(key), F.col(text), (allowed & drawn).alias("_drawn"))
    joined = rows.join(F.broadcast(trusted), rows[key] == trusted["_key"], "left").filter(
        "_drawn or _trusted"
    )
    schema = "positive boolean, half boolean, x array<double>"
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, column=0):
            x = features(batch.column(0))
            for column, kind in ((1, False), (2, True)):
                taken = pc.fill_null(batch.column(column), False)
                rows = x[taken.to_numpy(zero_copy_only=False)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([kind] * len(rows), pa.bool_()),
                        batch.column(3).filter(taken),
                        pa.array(rows.tolist(), target.field(2).type),
                    ],
                    schema=target,
                )

    half = F.pmod(F.xxhash64(F.lit("half"), F.col(key).cast("string")), F.lit(2)) == 1
    texts = joined.select(
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"), "_drawn", "_trusted", half.alias("_half")
    )
    path = scratch_path(spark, "quality-sample")
    texts.mapInArrow(run, schema).write.parquet(path)
    # A bounded sample: a few tasks hold all of it.
    sample = spark.read.schema(schema).parquet(path).coalesce(6)
    try:
        kinds = {row["positive"]: row["n"] for row in sample.groupBy("positive").agg(F.count("*").alias("n")).collect()}
        if len(kinds) < 2:
            return QualityModel((), (), 0.5)
        scale = _spread(sample)
        prior = _estimated_prior(sample, scale)
        weights = _fit(sample, scale, prior)
    finally:
        release(spark, path)
    # Sums of doubles depend on the order of the tasks in their last digits.
    return QualityModel(tuple(np.round(weights, 6).tolist()), tuple(scale.tolist()), prior)


def _spread(sample: DataFrame) -> np.ndarray:
    """Root of the mean square of each feature over the unlabelled rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(WIDTH), 0
        for batch in batches:
            if batch.num_rows:
                unlabelled = ~batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
                x = batch.column(1).flatten().to_numpy().reshape(-1, WIDTH)[unlabelled]
                total += (x * x).sum(axis=0)
                n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([[*total.tolist(), float(n)]], pa.list_(pa.float64()))], names=["s"])

    total = np.zeros(WIDTH + 1)
    for row in sample.select("positive", "x").mapInArrow(run, "s array<double>").toLocalIterator():
        total += np.array(row["s"])
    root = np.sqrt(total[:-1] / max(1.0, total[-1]))
    return np.round(np.where(root > 1e-4, root, 1.0), 9)


def held_out(key: str = "doc_id") -> Column:
    """True for the fold that no model learns from: crc32 of the key as text, mod 4, is 2."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2
