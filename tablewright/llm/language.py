"""Language ID by rank-order profiles.

A language's profile is the ranking of its most frequent character n-grams (one to three letters, word
edges included) over all learning texts. A text's own most frequent n-grams are compared to each
profile by out-of-place distance: the sum of how far each one's rank is from its rank there, and
the longest way for one that the profile lacks. The nearest profile names the language.

Defined results: a null text or one without a letter is `und` with score 0, and so is every text
if there is nothing to learn from; rows with a null language teach nothing; ties between n-grams go
by letters, ties between languages by name; repeated rows count as often as they come. A text's letters are counted a
million at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.stages import release, releasing

UNKNOWN = "und"
SHIFT = 21  # bits of a character
PIECE = 1 << 20  # characters counted at once, of a text or of several short ones

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """For each character its lower-case letter, and 0 for what is no letter."""
    if not _letters:
        table = np.zeros(0x110000, np.int32)
        for c in range(0x110000):
            if chr(c).isalpha():
                lower = chr(c).lower()
                table[c] = ord(lower) if len(lower) == 1 else c
        _letters.append(table)
    return _letters[0]


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, counted = np.concatenate(keys), np.concatenate(counts)
    key, index = np.unique(key, return_inverse=True)
    return key, np.bincount(index, counted, len(key)).astype(np.int64)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text as packed characters, with counts; an edge of a word is character 0."""
    key, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    tail = np.zeros(1, np.int64)
    for at in range(0, max(len(text), 1), PIECE):
        codes = np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), "<u4")
        end = np.zeros(int(at + PIECE >= len(text)), np.int64)
        letters = np.concatenate((tail, _letter_table()[codes], end))
        real = letters > 0
        real[1:] |= letters[:-1] > 0  # one edge is left between words
        real[0] = True
        letters = letters[real]
        tail = letters[-2:]
        inner = letters[1:-1] > 0
        three = (letters[:-2] << 2 * SHIFT | letters[1:-1] << SHIFT | letters[2:])[inner]
        own, times = np.unique(three, return_counts=True)
        key, n = _merged([key, own], [n, times]) if len(key) else (own, times)
    if not len(key):
        return key, n
    # Shorter n-grams are sums of the longer: each letter is the middle of one.
    middle = key >> SHIFT & (1 << SHIFT) - 1
    last = key & (1 << SHIFT) - 1
    two, end = key >> SHIFT, middle << SHIFT
    # Three letters fill 63 bits: shorter n-grams are negative, apart from each other.
    single = -(1 << 60)
    return _merged(
        [key, -1 - two, -1 - end[last == 0], single - middle], [n, n, n[last == 0], n]
    )


def _top(key: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    return key[np.lexsort((key, -n))[:size]]


def learn_profiles(
    docs: DataFrame, text: str = "text", lang: str = "lang", size: int = 400, languages: int = 4096
) -> pd.DataFrame:
    """(lang, gram, rank): the `size` most frequent n-grams of each language, counted over all rows.

    Only the profiles reach the driver, `size` rows for each of at most `languages` languages.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[str]] = {}
        sizes: dict[str, int] = {}

        def taken(name: str) -> pa.RecordBatch:
            key, n = gram_counts("\n".join(held.pop(name)))  # no n-gram goes over a line end
            del sizes[name]
            return pa.RecordBatch.from_arrays(
                [pa.array([name] * len(key), pa.string()), pa.array(key), pa.array(n)],
                names=["lang", "gram", "n"],
            )

        for batch in batches:
            for body, name in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                body = body.as_py()
                held.setdefault(name, []).append(body)
                sizes[name] = sizes.get(name, 0) + len(body)
                if sizes[name] >= PIECE:
                    yield taken(name)
        for name in [*held]:
            yield taken(name)

    counts = (
        docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
        .where("text IS NOT NULL AND lang IS NOT NULL")
        .mapInArrow(releasing(counted), "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = (
        counts.withColumn("rank", F.row_number().over(best) - 1)
        .where(F.col("rank") < size)
        .select("lang", "gram", "rank")
        .limit(size * languages + 1)
        .toPandas()
    )
    if len(rows) > size * languages:
        raise ValueError(f"more than {languages} languages")
    return rows


def predict(text: Column, profiles: pd.DataFrame, size: int = 400) -> Column:
    """A struct (lang_pred, score) for each text.

    The score is how much nearer the best profile is than the farthest possible distance.
    """
    names = sorted(profiles["lang"].unique())
    grams = np.unique(profiles["gram"].to_numpy(np.int64))
    ranks = np.full((len(names), len(grams)), -1, np.int64)
    if names:
        row = np.searchsorted(np.array(names, object), profiles["lang"].to_numpy(object))
        column = np.searchsorted(grams, profiles["gram"].to_numpy(np.int64))
        ranks[row, column] = profiles["rank"]

    def one(body: str | None) -> tuple[str, float]:
        key, n = gram_counts(body) if body and names else ((), ())
        if not len(key):
            return UNKNOWN, 0.0
        own = _top(key, n, size)
        at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
        there = np.where(grams[at] == own, ranks[:, at], -1)
        far = np.where(there < 0, size, np.abs(there - np.arange(len(own)))).sum(axis=1)
        best = int(np.argmin(far))
        return names[best], 1.0 - float(far[best]) / (size * len(own))

    @F.arrow_udf("lang_pred string, score double")
    def of(texts: pa.Array) -> pa.Array:
        found = [one(t.as_py()) for t in texts]
        release()
        return pa.StructArray.from_arrays(
            [
                pa.array([f[0] for f in found], pa.string()),
                pa.array([f[1] for f in found], pa.float64()),
            ],
            names=["lang_pred", "score"],
        )

    return of(text)


def held_out(doc_id: Column, parts: int, which: int) -> Column:
    """Whether a document is kept from learning: by the crc32 of its id as text (null: empty)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == which


def identify(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    size: int = 400,
    parts: int = 3,
    which: int = 1,
) -> tuple[DataFrame, Column]:
    """Learns from what is not held out. Returns (doc_id, held_out, lang_pred, score) per document,
    and the prediction as a column over `docs`."""
    out = held_out(F.col(doc_id), parts, which)
    found = predict(F.col(text), learn_profiles(docs.where(~out), text, lang, size), size)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), out.alias("held_out"), found.alias("found")
    ).select("doc_id", "held_out", "found.lang_pred", "found.score")
    return rows, found
