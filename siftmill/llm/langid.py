"""Language identification: multinomial naive Bayes over hashed character n-grams.

The log-probability matrix has one row per language and 2**bits columns; its size is fixed by the number of languages, which
``MAX_MATRIX`` checks, so it is broadcast. Documents are scored many at a time in numpy. Null texts and texts without a
letter are ``und`` with score 0, as is everything where nothing could be learned. Repeated rows count as often as they
occur; ties go to the language that sorts first. Empty tables give no rows; only doc_id, text and lang are read.

The posterior says which language is likelier than the others, and nears 1 for any long text. Whether a text is of a learned
language at all is told by its fit, the mean log probability of its n-grams under the best language, beside the fits that
the labelled rows of that language have when each is left out of the counts (``judged``).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 14
ORDERS = (1, 2, 3)
#: Cells of the matrix at most; more languages than that allow are an error, not a reason to drop some.
MAX_MATRIX = 1 << 25
UNDETERMINED = "und"
#: A fit may lie so many standard deviations under the mean of its language; languages with fewer rows are held against all rows.
FIT_DEVIATIONS, FIT_ROWS = 6.0, 8
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def grams(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of lower-cased texts side by side, one row per order, and the first place of each text.

    Each text ends with a line end, and what would reach beyond it into the next text is 2**bits, which stands for no n-gram: what
    a text gives never depends on the texts around it.
    """
    points = [np.frombuffer((t.lower() + "\n").encode("utf-32-le", "surrogatepass"), dtype="<u4") for t in texts]
    ends = np.cumsum([len(p) for p in points], dtype=np.int64)
    chars = np.concatenate(points) if points else np.zeros(0, dtype=np.uint32)
    out = np.empty((len(ORDERS), len(chars)), dtype=np.int32)
    run = np.zeros(len(chars), dtype=np.uint32)
    for k, order in enumerate(ORDERS):
        run = run * np.uint32(_MULTIPLIERS[1]) + np.concatenate([chars[order - 1 :], np.full(min(order - 1, len(chars)), 10, dtype=np.uint32)]) * np.uint32(_MULTIPLIERS[0]) + np.uint32(k + 1)
        mixed = (run ^ (run >> np.uint32(15))) * np.uint32(_MULTIPLIERS[2])
        out[k] = mixed >> np.uint32(32 - bits)
        for back in range(1, order):
            out[k, np.maximum(ends - back, 0)] = 1 << bits
    return out, np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else np.zeros(0, dtype=np.int64)


def _slices(texts: list[str], chars: int = 500_000) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, text in enumerate(texts):
        total += len(text)
        if total >= chars or i + 1 == len(texts):
            yield start, i + 1
            start, total = i + 1, 0


def _counted(labelled: DataFrame, bits: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order, counts of n-grams (languages x buckets) and of rows, from all rows with text and lang."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            langs, texts = np.array(batch.column("lang").to_pylist(), dtype=object), np.array(batch.column("text").to_pylist(), dtype=object)
            for lang in set(langs.tolist()):
                own = texts[langs == lang].tolist()
                into = counts.setdefault(lang, np.zeros(1 << bits, dtype=np.int64))
                docs[lang] = docs.get(lang, 0) + len(own)
                for a, b in _slices(own):
                    into += np.bincount(grams(own[a:b], bits)[0].ravel(), minlength=(1 << bits) + 1)[:-1]
        for lang, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1)), pa.array(np.append(own[at], docs[lang]))], names=["lang", "bucket", "n"])

    rows = labelled.select("lang", "text").filter("lang is not null and text is not null").mapInArrow(count, "lang string, bucket long, n long")
    totals = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    langs = sorted(r["lang"] for r in totals.filter("bucket = -1").select("lang").limit((MAX_MATRIX >> bits) + 1).collect())
    if len(langs) << bits > MAX_MATRIX:
        raise ValueError(f"{len(langs)} languages and more need over {MAX_MATRIX} cells; lower bits or raise MAX_MATRIX")
    counts, prior = np.zeros((len(langs), 1 << bits)), np.zeros(len(langs))
    place = {lang: i for i, lang in enumerate(langs)}
    sums = totals.toPandas() if langs else None  # languages x 2**bits rows at most
    if langs:
        row, bucket, n = sums["lang"].map(place).to_numpy(), sums["bucket"].to_numpy(), sums["n"].to_numpy()
        prior[row[bucket < 0]] = n[bucket < 0]
        counts[row[bucket >= 0], bucket[bucket >= 0]] = n[bucket >= 0]
    return langs, counts, prior


def _logs(counts: np.ndarray, prior: np.ndarray) -> np.ndarray:
    logs = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * counts.shape[1]))
    return np.hstack([logs, np.log((prior + 1) / (prior.sum() + len(prior)))[:, None]]) if len(prior) else logs


def learn(labelled: DataFrame, bits: int = BITS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log probabilities (languages + prior column) from all rows with text and lang."""
    langs, counts, prior = _counted(labelled, bits)
    return langs, _logs(counts, prior)


def _own_grams(text: str, bits: int) -> np.ndarray:
    """The n-grams that lie in the text and its line end."""
    found = grams([text], bits)[0].ravel()
    return found[found < 1 << bits]


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def least_fits(labelled: DataFrame, langs: list[str], counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Per language the least fit of its texts: FIT_DEVIATIONS below the mean over all its labelled rows, each left out of the counts."""
    shared = labelled.sparkSession.sparkContext.broadcast(counts.astype(np.float32))

    def fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_counts, place = shared.value, {lang: i for i, lang in enumerate(langs)}
        sums = all_counts.sum(axis=1, dtype=np.float64)
        moments = np.zeros((len(langs), 3))
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if _has_letter(text):
                    i, bucket = place[lang], _own_grams(text, bits)
                    at, n = np.unique(bucket, return_counts=True)
                    rest = np.maximum(all_counts[i, at].astype(np.float64) - n, 0)
                    fit = n @ np.log((rest + 0.5) / (sums[i] - len(bucket) + 0.5 * (1 << bits))) / len(bucket)
                    moments[i] += 1, fit, fit * fit
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), *map(pa.array, moments.T.copy())], names=["lang", "n", "s", "q"])

    rows = labelled.select("lang", "text").filter("lang is not null and text is not null").mapInArrow(fits, "lang string, n double, s double, q double")
    moments = {r["lang"]: (r["n"], r["s"], r["q"]) for r in rows.groupBy("lang").agg(*[F.sum(c).alias(c) for c in "nsq"]).collect()}  # one row per language
    own = np.array([moments.get(lang, (0, 0, 0)) for lang in langs]).reshape(-1, 3)
    own[own[:, 0] < FIT_ROWS] = own.sum(axis=0)
    n = np.maximum(own[:, 0], 1)
    deviation = np.sqrt(np.maximum(own[:, 2] / n - (own[:, 1] / n) ** 2, 0))
    return np.where(own[:, 0] < FIT_ROWS, -np.inf, own[:, 1] / n - FIT_DEVIATIONS * deviation)


def judged(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """As ``identify``, with fit and least_fit, null without a language; languages with too few rows everywhere have no least one."""
    marked = docs.withColumn("held_out", held_out(F.col("doc_id")))
    labelled = marked.filter(~F.col("held_out"))
    langs, counts, prior = _counted(labelled, bits)
    least = least_fits(labelled, langs, counts, bits) if langs else np.zeros(0)
    matrix = _logs(counts, prior)
    shared = docs.sparkSession.sparkContext.broadcast(matrix.astype(np.float32))

    @F.pandas_udf("fit double, least_fit double")
    def fitted(texts, preds):
        import pandas as pd

        place, fit, floor = {lang: i for i, lang in enumerate(langs)}, np.full(len(texts), np.nan), np.full(len(texts), np.nan)
        for j, (text, pred) in enumerate(zip(texts.tolist(), preds.tolist(), strict=True)):
            if _has_letter(text) and pred in place:
                fit[j], floor[j] = shared.value[place[pred], _own_grams(text, bits)].mean(dtype=np.float64), least[place[pred]]
        return pd.DataFrame({"fit": fit, "least_fit": floor})

    rows = predict(marked, langs, matrix, bits).withColumn("_fitted", fitted("text", "lang_pred"))
    return rows.withColumns({c: F.nanvl(F.col(f"_fitted.{c}"), F.lit(None).cast("double")) for c in ("fit", "least_fit")}).drop("_fitted")


def predict(docs: DataFrame, langs: list[str], matrix: np.ndarray, bits: int = BITS) -> DataFrame:
    """``docs`` with lang_pred and score, the posterior probability of lang_pred."""
    prior = matrix[:, -1].astype(np.float64) if langs else np.zeros(0)
    # the last row is that of no n-gram
    shared = docs.sparkSession.sparkContext.broadcast(np.vstack([matrix[:, :-1].T, np.zeros((1, len(langs)))]).astype(np.float32) if langs else np.zeros((1, 0), dtype=np.float32))

    @F.pandas_udf("lang_pred string, score double")
    def scored(texts):
        import pandas as pd

        logs, names = shared.value, np.array([*langs, UNDETERMINED], dtype=object)
        pred, score = np.full(len(texts), len(langs)), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts.tolist()) if t and any(map(str.isalpha, t))] if langs else []
        own = [texts.iat[i] for i in known]
        for a, b in _slices(own):
            found, starts = grams(own[a:b], bits)
            sums = sum(np.add.reduceat(logs[g].astype(np.float64), starts, axis=0) for g in found) + prior
            best = sums.argmax(axis=1)
            at = known[a:b]
            pred[at], score[at] = best, 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        return pd.DataFrame({"lang_pred": names[pred], "score": score})

    return docs.withColumn("_scored", scored("text")).withColumns({"lang_pred": F.col("_scored.lang_pred"), "score": F.col("_scored.score")}).drop("_scored")


def identify(docs: DataFrame) -> DataFrame:
    """``docs`` with held_out, lang_pred and score; learned from all rows that aren't held out and have a language."""
    marked = docs.withColumn("held_out", held_out(F.col("doc_id")))
    langs, matrix = learn(marked.filter(~F.col("held_out")))
    return predict(marked, langs, matrix)
