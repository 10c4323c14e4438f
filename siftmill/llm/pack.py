"""Packing by shortest pack first over the length histogram.

Documents are encoded, ended, and cut into pieces of at most ``max_len`` ids (all but the last piece are full). Lengths
are placed longest first: a length goes into the shortest open patterns, those with the most room, whose counts are split
as the length is used up; where none has room, each new pack takes as many pieces of the length as it holds. Patterns are joined back to pieces by their rank among the
pieces of the same length, so nothing is gathered: the histogram has ``max_len`` rows, a pattern list few thousand.

Null texts are empty documents (the end id alone); null ids and repeated rows are documents of their own; an empty
table gives no pieces. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmill.llm import tokens
from siftmill.llm.common import laid_out, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(tokens)

PIECES = "doc_id long, start long, length int, doc_tokens long, ids binary, part int, pos int, rank long"


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, max_len: int, remember: int | None = None) -> DataFrame:
    """One row per piece, written and laid out by task: its ids (32-bit little-endian), its place among its task's pieces, and its rank among
    those of that length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(max_len + 1, dtype=np.int64)
        pos = 0
        encode, end = tokens.byte_bpe(tokenizer_path, remember), np.array([end_id], dtype="<u2").tobytes()
        for batch in batches:
            texts, ids_of = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for a, b in tokens.in_slices(texts):
                rows = []
                for doc, ids in zip(ids_of[a:b], encode(texts[a:b]), strict=True):
                    wide = np.frombuffer(ids + end, dtype="<u2").astype("<u4")
                    for start in range(0, len(wide), max_len):
                        piece = wide[start : start + max_len]
                        rows.append((doc, start, len(piece), len(wide), piece.tobytes(), part, pos, int(seen[len(piece)])))
                        seen[len(piece)] += 1
                        pos += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64()), strict=True)],
                    names=["doc_id", "start", "length", "doc_tokens", "ids", "part", "pos", "rank"],
                )

    return laid_out(docs.select("doc_id", "text").mapInArrow(cut, PIECES), "part", "pieces")


def patterns(histogram: dict[int, int], max_len: int) -> list[tuple[tuple[int, ...], int]]:
    """Shortest-pack-first: (lengths of a pack, number of such packs), using every count of the histogram up.

    Lengths are placed longest first, each into the shortest open packs if they have room for it; packs that the count
    of the length doesn't reach stay as they are. The number of patterns is at most twice the number of lengths and splits.
    """
    open_: list[list[list]] = [[] for _ in range(max_len + 1)]  # by room left: [lengths, packs]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        room = max_len
        while left > 0:
            while room >= length and not open_[room]:
                room -= 1
            if room < length:
                each = max_len // length  # one by one, the next copies go into the pack just opened, as it alone has room
                if left >= each:
                    open_[max_len - each * length].append([(length,) * each, left // each])
                if left % each:
                    open_[max_len - left % each * length].append([(length,) * (left % each), 1])
                break
            pack, n = open_[room].pop()
            used = min(n, left)
            if used < n:
                open_[room].append([pack, n - used])
            open_[room - length].append([(*pack, length), used])
            left -= used
    return [(pack, n) for group in open_ for pack, n in group]


def places(packs: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Runs of ranks: pieces of ``length`` from rank ``first`` on lie at ``offset`` in sequences ``sequence``, ``sequence`` + 1, …"""
    rows, used, sequence = [], {}, 0
    for pack, n in packs:
        offset = 0
        for length in pack:
            first = used.get(length, 0)
            rows.append((length, first, sequence, offset))
            used[length], offset = first + n, offset + length
        sequence += n
    rows.sort()
    columns = np.array(rows, dtype=np.int64).reshape(-1, 4).T
    return dict(zip(("length", "first", "sequence", "offset"), columns, strict=True))


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, max_len: int = 1024, payload: Column | None = None,
         remember: int | None = None) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset of every piece, and its ids or what ``payload`` makes of them."""
    cut = pieces(docs, tokenizer_path, end_id, max_len, remember)
    payload = F.col("ids") if payload is None else payload
    counts = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # max_len rows at most
    runs = places(patterns(histogram, max_len))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length, rank):
        import pandas as pd

        key = (runs["length"] << 40) + runs["first"]
        at = np.searchsorted(key, (length.to_numpy(np.int64) << 40) + rank.to_numpy(np.int64), side="right") - 1
        return pd.DataFrame({"sequence_id": runs["sequence"][at] + rank.to_numpy() - runs["first"][at], "offset": runs["offset"][at]})

    # places are found without the ids, which would wait in memory for Python's answers, and come to them as one row of arrays
    # per task: the ids stay where they are
    ranked = cut.select("part", "pos", "length", "rank").join(bases, ["part", "length"])
    at = ranked.select("part", "pos", placed("length", F.col("rank") + F.col("base")).alias("at"))
    of_part = at.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("pos", "at.sequence_id", "at.offset"))).alias("_places"))
    of_part = written(of_part.select("part", *[F.col(f"_places.{c}").alias(f"_{c}") for c in ("sequence_id", "offset")]), "places")
    cut = cut.select("doc_id", "start", F.col("length").cast("long").alias("length"), "doc_tokens", "part", "pos", payload)
    found = cut.join(of_part.hint("shuffle_hash"), "part")
    return found.withColumns({c: F.get(f"_{c}", F.col("pos")) for c in ("sequence_id", "offset")}).drop("part", "pos", "_sequence_id", "_offset")
