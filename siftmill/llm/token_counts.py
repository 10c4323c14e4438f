"""Token counts of whole texts by a two-tier lookup of pre-token lengths on the map side.

First tier: a compact table of the pre-tokens that are most frequent over all texts, with their numbers of tokens,
broadcast to every worker. Second tier: each worker process remembers the pre-tokens that it had to encode. No
pre-token is ever shuffled: what finds the frequent ones is a frequent-items sketch per task, of fixed size, and
the sketches are merged. The table decides how fast a text is counted, never how many tokens it has.

Null texts are empty (no bytes, no tokens); very long texts are counted whole; repeated rows are counted each; an empty
table gives no rows. Other columns are kept as they are, but for ``n_bytes``, ``n_tokens`` and ``over_limit``, which are
replaced. Texts whose pre-tokens can't be told with certainty (see ``tokens.Pieces``) are counted by the library as a whole.
"""

from __future__ import annotations

import sys
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm import tokens
from siftmill.llm.common import shielded

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(tokens)

#: Entries of the broadcast table, and items that each sketch tracks.
TABLE, TRACKED = 8_192, 32_768
#: Sketches of so many tasks are merged before the last merge.
MERGED = 64
#: Pre-tokens that a worker process remembers besides the table; beyond it the memory starts anew.
CACHE_PIECES = 800_000


def frequent(docs: DataFrame, entries: int = TABLE, tracked: int = TRACKED) -> list[str]:
    """The most frequent pre-tokens over all texts, by a frequent-items sketch: every item with more than about
    n / (0.75 tracked) of the n occurrences is found."""
    piece = F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(tokens.pre_tokens()), F.lit(0)))
    pieces = docs.select(F.expr(f"spark_partition_id() div {MERGED}").alias("part"), piece.alias("piece")).filter("piece <> ''")
    sketches = pieces.groupBy("part").agg(F.expr(f"approx_top_k_accumulate(piece, {tracked})").alias("s"))
    # grouped, as no sketches can't be combined
    top = sketches.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(s, {tracked}), {entries})").alias("top")).first()
    return [r["item"] for r in top["top"]] if top else []


def compact_table(pieces: list[str], path: str) -> tuple[pa.Array, np.ndarray]:
    """Pre-tokens in one Arrow array and their numbers of tokens beside it."""
    known = tokens.pieces_of(path).of(pieces)
    return pa.array(list(known), pa.string()), np.array([len(ids) // 4 for ids in known.values()], dtype=np.uint32)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, entries: int = TABLE) -> DataFrame:
    """``docs`` with n_bytes (of UTF-8), n_tokens as the library gives them without added special tokens, and over_limit."""
    splits = tokens.pieces_of(tokenizer_path).splits
    table = compact_table(frequent(docs, entries) if splits else [], tokenizer_path)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    name = uuid.uuid4().hex  # workers outlive queries

    @F.pandas_udf("long")
    def counted(texts):
        import pandas as pd

        pieces = tokens.pieces_of(tokenizer_path)
        memory = sys.__dict__.setdefault("_siftmill_counts", {})  # outlives the functions, which each task gets anew
        if memory.get("name") != name:
            memory.update(name=name, table=dict(zip(shared.value[0].to_pylist(), shared.value[1].tolist(), strict=True)))
        first, second = memory["table"], memory.setdefault(tokenizer_path, {})
        given, out = texts.tolist(), np.zeros(len(texts), dtype=np.int64)
        for a, b in tokens.in_slices(given):
            out[a:b] = _lengths(given[a:b], pieces, first, second)
        return pd.Series(out)

    own, restored = shielded(docs.drop("n_bytes", "n_tokens", "over_limit"), ("text",))
    rows = own.withColumn("_n_tokens", counted("text"))
    return rows.select(
        *restored, F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.col("_n_tokens").alias("n_tokens"),
        (F.col("_n_tokens") > limit).alias("over_limit"),
    )


def _lengths(texts: list[str | None], pieces: tokens.Pieces, first: dict[str, int], second: dict[str, int]) -> np.ndarray:
    """Tokens of each text: the table, then the worker's memory, then the library for what neither holds."""
    out = np.zeros(len(texts), dtype=np.int64)
    direct: list[int] = []
    misses: list[tuple[int, list[str]]] = []
    if len(second) > CACHE_PIECES:
        second.clear()
    get = first.get
    for i, text in enumerate(texts):
        found = pieces.split(text) if text else ()
        if found is None:
            direct.append(i)
            continue
        known = [*map(get, found)]
        if None in known:
            rest = [p for p, n in zip(found, known, strict=True) if n is None]
            misses.append((i, rest))
            out[i] = sum(filter(None, known))
        else:
            out[i] = sum(known)
    unknown = {p: None for _, rest in misses for p in rest if p not in second}
    second.update((p, len(ids) // 4) for p, ids in pieces.of(unknown).items())
    for i, rest in misses:
        out[i] += sum(map(second.__getitem__, rest))
    if direct:
        out[direct] = [len(ids) // 4 for ids in pieces.whole([texts[i] for i in direct])]
    return out
