"""Token ids as flat unsigned 16-bit files with 64-bit document offsets, in ascending document order.

A folder holds one trio of files per range of document ids: ``.ids`` (the ids of its documents, one after another),
``.offsets`` (one more than documents; place of each document inside the file) and ``.docs`` (document ids). Files are
named by the attempt that wrote them, and the manifest names only those of attempts that ended well, so a task that
is run again after a lost executor leaves nothing twice. Bases of files are prefix sums over the manifest.

Null texts are empty documents (the end id alone); null document ids sort first; repeated rows are documents of their
own, next to each other; an empty table gives an empty manifest. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftmill.llm import tokens
from siftmill.llm.common import shared_dir, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(tokens)

MANIFEST = "part int, file string, n_docs long, n_null_ids long, n_tokens long"
READ = "doc_id long, start long, n_tokens long, ids binary"
#: Ids that one batch of the reader holds at most, unless one document alone has more.
BATCH_IDS = 1_000_000


def _storage(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Encode ``text``, append ``end_id``, write the files; the manifest with the base (ids before) of each file."""
    folder = folder or f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        encode, end = tokens.byte_bpe(tokenizer_path), np.array([end_id], dtype="<u2").tobytes()
        sinks, n_docs, n_null, n_ids = {}, 0, 0, 0
        for batch in batches:
            if not sinks and batch.num_rows:
                storage, at = _storage(name)
                storage.create_dir(at.rpartition("/")[0], recursive=True)
                sinks = {kind: storage.open_output_stream(f"{at}.{kind}") for kind in ("ids", "offsets", "docs")}
                sinks["offsets"].write(np.zeros(1, dtype="<i8").tobytes())
            texts = batch.column("text").to_pylist()
            for a, b in tokens.in_slices(texts):
                ids = [x + end for x in encode(texts[a:b])]
                ends = n_ids + np.cumsum([len(x) // 2 for x in ids], dtype="<i8")
                known = batch.column("doc_id").slice(a, b - a)
                sinks["ids"].write(b"".join(ids))
                sinks["offsets"].write(ends.tobytes())
                sinks["docs"].write(known.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                n_docs, n_null, n_ids = n_docs + b - a, n_null + known.null_count, int(ends[-1])
        for sink in sinks.values():
            sink.close()
        if n_docs:
            yield pa.RecordBatch.from_arrays(
                [pa.array([task.partitionId()], pa.int32()), pa.array([name]), *(pa.array([x], pa.int64()) for x in (n_docs, n_null, n_ids))],
                names=["part", "file", "n_docs", "n_null_ids", "n_tokens"],
            )

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_h")).repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h")
    manifest = written(rows.select("doc_id", "text").mapInArrow(write, MANIFEST), "manifest")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document from the files: its id, the ids of all documents before it, and its own as 32-bit integers.

    Local files are memory-mapped; other stores are read by ranges.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            storage, at = _storage(row["file"])
            if storage.type_name == "local":
                ids = np.memmap(f"{at}.ids", dtype="<u2", mode="r")
                part = lambda a, b: ids[a:b]  # noqa: E731, B023
            else:
                source = storage.open_input_file(f"{at}.ids")
                part = lambda a, b: np.frombuffer(source.read_at(2 * (b - a), 2 * a), dtype="<u2")  # noqa: E731, B023
            offsets, docs = (np.frombuffer(storage.open_input_file(f"{at}.{kind}").read(), dtype="<i8") for kind in ("offsets", "docs"))
            first, n = 0, row["n_docs"]
            while first < n:
                last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BATCH_IDS, side="right")) - 1)
                wide, cuts = part(offsets[first], offsets[last]).astype("<u4").tobytes(), (4 * (offsets[first : last + 1] - offsets[first])).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs[first:last], mask=np.arange(first, last) < row["n_null_ids"]),
                        pa.array(offsets[first:last] + row["base"]),
                        pa.array(np.diff(offsets[first : last + 1])),
                        pa.array([wide[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )
                first = last

    files = max(1, manifest.count())
    return manifest.repartition(files, "part").mapInArrow(read, READ)
