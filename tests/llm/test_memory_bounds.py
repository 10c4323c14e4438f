"""What waits in memory beside the JVM's heap: texts on their way to Python, and the pre-tokens that a worker remembers."""

import pyarrow as pa

from siftmill.llm import common, tokens
from siftmill.llm.queries import tokenizer_path


def test_texts_come_to_python_a_few_at_a_time(spark, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([0])], names=["n", "part"])

    try:
        rows = common.laid_out(spark.range(0, 2000, 1, 1).mapInArrow(sizes, "n long, part long"), "part", "sizes")
        assert {r["n"] for r in rows.collect()} == {common.TEXTS_AT_ONCE}
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


def test_remembered_pre_tokens_are_bounded_and_change_no_id(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 20)
    path = tokenizer_path()
    kept = tokens.sys.__dict__.setdefault("_siftmill_tokens", {})
    before = kept.pop(path, None)
    try:
        encode, pieces = tokens.byte_bpe(path), tokens.pieces_of(path)
        texts = [" ".join(f"w{i % 7}x{i * k}" for i in range(9)) + " the end" for k in range(40)]
        for text in texts + texts[:3]:
            assert encode([text]) == pieces.whole([text], "<u2")
            assert all(len(g) <= 20 + 40 for g in kept[path]) and len(kept[path]) == 2
    finally:
        kept.pop(path, None)
        if before is not None:
            kept[path] = before
