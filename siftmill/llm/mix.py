"""Mixing sources to target weights: whole repeats of a source first, then a subset of its documents that fills the rest.

Documents are counted by exact length per source. Sources share all words by weight; no target exceeds ``MOST`` times its source,
and what is over goes to the others by weight. A source is taken whole as often as its target holds it; of the rest, each
length gives its share of documents, lengths that still fit give more, and bounded-knapsack dynamic programming over
the counts left fills the last words; where that misses the target, shares are given back as far as the programme can hold. Which documents of a length are taken follows a seeded hash, so reruns agree.

Null texts and texts without words have size 0 and are taken as often as the source is taken whole; null sources are a source, sorted last;
repeated rows are documents of their own; an empty table gives no rows. Working columns begin with an underscore.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm.common import bit, bitmaps, decided, gapless, laid_out, n_words, numbered, shielded, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A source is taken at most so many times.
MOST = 3
#: Words that the dynamic programme fills after the greedy steps. If these leave more, any length that still fits is over half of it.
FILLED = 1 << 16
#: Bits that the programme's sets of sums may take when it fills what given back shares leave.
MOST_BITS = 1 << 29
WEIGHTS = (1, 2, 3)


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS) -> dict[str | None, float]:
    """Words per source: shares by weight, capped at MOST times the source, the excess shared again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, free, left = {}, list(order), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > MOST * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = float(MOST * sizes[s])
        free, left = [s for s in free if s not in out], left - sum(out[s] for s in over)
    return out


def fill(budget: int, counts: dict[int, int]) -> dict[int, int]:
    """How many items of each length to take so that their sum comes as near to ``budget`` from below as can be.

    Bounded knapsack over subset sums: counts are split into powers of two, the sets of reachable sums are bit strings.
    """
    parts = []
    for length in sorted(counts, reverse=True):
        left, size = min(counts[length], budget // length if length else 0), 1
        while left > 0:
            parts.append((length, min(size, left)))
            left, size = left - size, size * 2
    reached, history, mask = 1, [], (1 << (budget + 1)) - 1
    for length, n in parts:
        history.append(reached)
        reached |= (reached << (length * n)) & mask
        if reached >> budget & 1:
            break
    total, taken = reached.bit_length() - 1, {}
    for (length, n), before in zip(reversed(parts[: len(history)]), reversed(history), strict=True):
        if not before >> total & 1:
            taken[length], total = taken.get(length, 0) + n, total - length * n
    return taken


def chosen(counts: dict[int, int], budget: int) -> dict[int, int]:
    """Documents to take of each length, ``budget`` words together or as near below as can be."""
    counts = {k: n for k, n in counts.items() if k > 0}
    whole = sum(k * n for k, n in counts.items())
    best, most = {}, -1
    for quarters in (4, 3, 2, 1, 0) if whole else ():  # of the shares
        taken = {k: n * budget * quarters // (4 * whole) for k, n in counts.items()}
        left = budget - sum(k * n for k, n in taken.items())
        if quarters == 4:
            for k in sorted(counts, reverse=True):
                more = min(counts[k] - taken[k], max(0, left - FILLED // 2) // k)
                taken[k], left = taken[k] + more, left - more * k
        rest = {k: n - taken[k] for k, n in counts.items() if n > taken[k] and k <= left}
        if quarters == 4 and left > FILLED:
            added = {max(rest): 1} if rest else {}
        elif quarters == 4 or (left + 1) * sum(min(n, left // k).bit_length() for k, n in rest.items()) <= MOST_BITS:
            added = fill(left, rest)
        else:
            break
        for k, n in added.items():
            taken[k], left = taken[k] + n, left - n * k
        if budget - left > most:
            best, most = taken, budget - left
        if most >= min(budget, whole):
            break
    return best


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = 17, whole: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target and times (how often the mix takes it) of every document.

    With ``whole``, instead, the mix itself: the rows of ``docs``, each as often as it is taken. ``docs`` is then written once with
    row numbers, laid out by chunk; decisions come to it as bitmaps, and no text is exchanged.
    """
    own, restored = shielded(docs, ("doc_id", "source", "text"))
    rows = numbered((own if whole else own.select("doc_id", "source", "text")).withColumn("_size", n_words(F.col("text"))))
    base = laid_out(rows, "_chunk", "sized") if whole else written(rows.drop("text"), "sized")
    key = F.concat(F.when(F.col("source").isNull(), "-").otherwise("+"), F.coalesce("source", F.lit("")))
    slim = base.select("doc_id", "source", "_size", key.alias("_k"), F.xxhash64("doc_id", "_size", F.lit(seed)).alias("_seeded"), "_chunk", "_pos")
    histogram = written(slim.groupBy("_k", "source", "_size").agg(F.count(F.lit(1)).alias("_n")), "lengths")
    sizes = {(r["_k"], r["source"]): r["s"] for r in histogram.groupBy("_k", "source").agg(F.sum(F.col("_size") * F.col("_n")).alias("s")).collect()}  # one row per source
    aims = targets({source: s for (_, source), s in sizes.items()}, weights)
    plan = [(k, s, aims[source], int(min(MOST, aims[source] // s)) if s else 1) for (k, source), s in sizes.items()]
    plan = written(docs.sparkSession.createDataFrame(plan, "_k string, _source_size long, _target double, _whole int"), "targets")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        rest = round(first["_target"] - float(first["_whole"]) * float(first["_source_size"])) if first["_whole"] < MOST else 0
        taken = chosen(dict(zip(pdf["_size"].tolist(), pdf["_n"].tolist(), strict=True)), max(0, int(rest)))
        return pdf.assign(_more=[taken.get(k, 0) for k in pdf["_size"].tolist()])

    lengths = histogram.drop("source").join(plan, "_k")
    counts = lengths.groupBy("_k").applyInPandas(choose, f"{', '.join(f'{c} {t}' for c, t in lengths.dtypes)}, _more bigint")
    ranked = _ranked(slim, written(counts, "counts"))
    times = (F.col("_whole") + (F.col("_at") < F.col("_more")).cast("int")).alias("times")
    if not whole:
        return ranked.select("doc_id", "source", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), times)
    ones, twos = (F.col("times").bitwiseAND(F.lit(n)) != 0 for n in (1, 2))  # MOST is 3
    taken = written(bitmaps(ranked.select("_chunk", "_pos", times).filter("times > 0"), _ones=ones, _twos=twos), "taken")
    n = bit(F.col("_ones"), F.col("_pos")).cast("int") + 2 * bit(F.col("_twos"), F.col("_pos")).cast("int")
    return decided(base, taken).withColumn("_times", n).filter("_times > 0").withColumn("_times", F.explode(F.expr("sequence(1, _times)"))).select(*restored)


def _ranked(slim: DataFrame, counts: DataFrame) -> DataFrame:
    """Number the documents of each (source, length) by their seeded hash.

    The hash is cut into about as many slices as a slice has documents, so neither slices nor the list of slices grow faster
    than the root of the number of documents.
    """
    slices = F.ceil(F.sqrt(F.col("_n")))
    at = F.floor((F.shiftrightunsigned("_seeded", 11) / F.lit(float(1 << 53))) * slices).cast("long")
    rows = slim.join(counts, ["_k", "_size"]).withColumn("_slice", at)
    return gapless(rows, ["_k", "_size"], "_at", chunk="_slice", order=["_seeded", "_chunk", "_pos"])
