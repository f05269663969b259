"""Quality scores: ridge regression on random Fourier features, calibrated by isotonic regression.

Document statistics (lengths, shares of characters, repetition) are standardised and mapped to cosines
of random directions, whose products approximate a Gaussian kernel. Every partition sums its part of
the normal equations, per fold of the learning rows. Scores of each fold by the equations of the others
are counted in bins, and isotonic regression over the bins turns scores into probabilities.

A text is read whole; its task holds some 100 bytes for each of its words.

Defined results: a null text counts as empty and is scored like any other; labels without an id or a
quality teach nothing; repeated labels count as often as they come; with nothing to learn from,
every score is 0.5; if all labels agree, every score is that label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.language import held_out
from tablewright.llm.stages import settle

FOLDS = 4
BINS = 512

#: Shares of these bytes among all bytes of a text are statistics of it.
_CLASSES = [
    bytes(range(65, 91)),
    bytes(range(97, 123)),
    b"0123456789",
    b".,;:?",
    b"!",
    b"|",
    b"#$%&*@^~_=+<>\\/",
    b"'\"()[]{}-",
    b"\n",
    b" ",
    bytes(range(128, 256)),
]
_CLASS_OF = np.zeros((256, len(_CLASSES)))
for _i, _bytes in enumerate(_CLASSES):
    _CLASS_OF[list(_bytes), _i] = 1.0
STATISTICS = len(_CLASSES) + 12


def statistics(body: bytes) -> np.ndarray:
    """Numbers that describe a text, none of them its words' meaning."""
    out = np.zeros(STATISTICS)
    if not body:
        return out
    counts = np.bincount(np.frombuffer(body, np.uint8), minlength=256)
    share = counts / len(body)
    out[: len(_CLASSES)] = share @ _CLASS_OF
    rest = out[len(_CLASSES) :]
    some = share[share > 0]
    rest[0] = np.log1p(len(body))
    rest[1] = -(some * np.log(some)).sum()
    lines = [line for line in body.split(b"\n") if line.strip()]
    if lines:
        rest[2] = np.log1p(len(lines))
        rest[3] = np.log1p(len(body) / len(lines))
        rest[4] = 1 - len(set(lines)) / len(lines)
    words = body.split()
    if words:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        rest[5] = np.log1p(len(words))
        rest[6] = np.log1p(sizes.mean())
        rest[7] = np.log1p(sizes.std())
        rest[8] = len(set(words)) / np.sqrt(len(words))
        rest[9] = (sizes == 1).mean()
        rest[10] = (sizes > 20).mean()
        rest[11] = np.log1p(sizes.max())
    return out


def _statistics(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def of(texts: pa.Array) -> pa.Array:
        flat = [statistics(t.as_py() or b"") for t in texts]
        values = pa.array(np.concatenate(flat) if flat else np.zeros(0))
        ends = pa.array(np.arange(len(flat) + 1) * STATISTICS, pa.int32())
        return pa.ListArray.from_arrays(ends, values)

    return of(text.cast("binary"))


class Features:
    """Standardised statistics as random Fourier features, and a constant."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, size: int, seed: int, width: float):
        random = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.directions = random.normal(0.0, 1.0 / width, (len(mean), size))
        self.phases = random.uniform(0.0, 2 * np.pi, size)

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip((rows - self.mean) / self.spread, -8, 8)
        waves = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.concatenate((waves, np.ones((len(rows), 1))), axis=1)


def _rows_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS)


def _normal_equations(train: DataFrame, features: Features) -> dict[int, np.ndarray]:
    """Per fold the sums of the products of features, the label as the last one.

    A partition sends one triangle of sums per fold, whose size depends on the features alone, and the
    triangles are added up before any reaches the driver.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x = features(_rows_of(batch.column(0)))
            x = np.concatenate((x, batch.column(1).to_numpy()[:, None]), axis=1)
            fold = batch.column(2).to_numpy()
            for f in np.unique(fold).tolist():
                part = x[fold == f]
                sums[f] = sums.get(f, 0) + part.T @ part
        for f, total in sums.items():
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(i), f), pa.int32()),
                    pa.array(i * len(total) + j, pa.int32()),
                    pa.array(total[i, j]),
                ],
                names=["fold", "at", "v"],
            )

    rows = (
        train.select("statistics", F.col("quality").cast("double"), "fold")
        .mapInArrow(summed, "fold int, at int, v double")
        .groupBy("fold", "at")
        .agg(F.sum("v").alias("v"))
        .toPandas()
    )
    size = len(features.phases) + 2
    out = {}
    for fold, part in rows.groupby("fold"):
        total = np.zeros(size * size)
        total[part["at"].to_numpy()] = part["v"].to_numpy()
        total = total.reshape(size, size)
        out[int(fold)] = total + np.triu(total, 1).T
    return out


def _ridge(sums: np.ndarray, penalty: float) -> np.ndarray:
    """Weights from the summed products; the constant is not held back."""
    size = len(sums) - 1
    hold = np.full(size, penalty)
    hold[-1] = 1e-9
    return np.linalg.solve(sums[:size, :size] + np.diag(hold), sums[:size, size])


def isotonic(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The non-decreasing means nearest to total / count: neighbours that fall are pooled."""
    pools: list[list[float]] = []
    for n, t in zip(count.tolist(), total.tolist(), strict=True):
        pools.append([n, t, 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            n, t, k = pools.pop()
            pools[-1] = [pools[-1][0] + n, pools[-1][1] + t, pools[-1][2] + k]
    return np.concatenate([np.full(k, t / n) for n, t, k in pools])




def _raw_score(statistics: Column, fold: Column, weights: dict[int, np.ndarray], features: Features):
    @F.arrow_udf("double")
    def of(rows: pa.Array, folds: pa.Array) -> pa.Array:
        fold = folds.to_numpy()
        x = features(_rows_of(rows))
        out = np.zeros(len(x))
        for f in np.unique(fold).tolist():
            out[fold == f] = x[fold == f] @ weights[f]
        return pa.array(out)

    return of(statistics, fold)


def learn(
    train: DataFrame, size: int = 256, penalty: float = 1.0, width: float = 6.0, seed: int = 7
):
    """A function from a statistics column to a score column, learned from (statistics, quality, fold)."""
    moments = train.select(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(F.col("statistics")[i]).alias(f"m{i}") for i in range(STATISTICS)],
        *[F.stddev_pop(F.col("statistics")[i]).alias(f"s{i}") for i in range(STATISTICS)],
    ).first()
    if not moments["n"]:
        return lambda statistics: F.lit(0.5)
    mean = np.array([moments[f"m{i}"] for i in range(STATISTICS)])
    spread = np.array([moments[f"s{i}"] for i in range(STATISTICS)])
    features = Features(mean, spread, size, seed, width)
    sums = _normal_equations(train, features)
    everything = sum(sums.values())
    if len(sums) > 1:
        weights = {f: _ridge(everything - own, penalty) for f, own in sums.items()}
    else:
        weights = {f: _ridge(own, penalty) for f, own in sums.items()}
    raw = _raw_score(F.col("statistics"), F.col("fold"), weights, features)
    binned = F.floor((raw + 0.5) / 2 * BINS)
    bins = (
        train.select(F.greatest(F.least(binned, F.lit(BINS - 1)), F.lit(0)).alias("bin"), "quality")
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("good"))
        .orderBy("bin")
        .collect()  # at most BINS rows
    )
    level = isotonic(np.array([b["n"] for b in bins]), np.array([float(b["good"]) for b in bins]))
    middle = (np.array([b["bin"] for b in bins]) + 0.5) / BINS * 2 - 0.5
    final = _ridge(everything, penalty)

    def score(statistics: Column) -> Column:
        @F.arrow_udf("double")
        def of(rows: pa.Array) -> pa.Array:
            return pa.array(np.interp(features(_rows_of(rows)) @ final, middle, level))

        return of(statistics)

    return score


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    quality: str = "quality",
    threshold: float = 0.7,
    parts: int = 4,
    which: int = 2,
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Only labels of documents that are not
    held out are learned from."""
    rows = settle(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            held_out(F.col(doc_id), parts, which).alias("held_out"),
            _statistics(F.col(text)).alias("statistics"),
        ),
        "statistics",
    )
    marks = labels.select(
        F.col(doc_id).alias("doc_id"), F.col(quality).cast("double").alias("quality")
    ).where("doc_id IS NOT NULL AND quality IS NOT NULL")
    train = settle(
        rows.where(~F.col("held_out"))
        .join(marks, "doc_id")
        .select(
            "statistics",
            "quality",
            (F.crc32(F.concat(F.lit("fold"), F.col("doc_id").cast("string")).cast("binary")) % FOLDS)
            .cast("int")
            .alias("fold"),
        ),
        "learning",
    )
    score = learn(train)
    return rows.select("doc_id", "held_out", score(F.col("statistics")).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
