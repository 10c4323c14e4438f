"""Operators 11, 12 and 13 against brute force on small tables, with nulls, empty and repeated rows and clashing columns."""

import hashlib
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

pytest.importorskip("siftmill.llm")

from siftmill.llm import centroids, filter_audit, queries, token_counts, tokens  # noqa: E402

DATA = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i}" for i in range(150))
ODD = [
    (1, None, "en"), (2, "", None), (3, " \n ", "en"), (4, LONG, "en"), (5, LONG, "de"), (5, LONG, "de"), (6, LONG + " #", ""), (7, LONG + " #", "en"),
    (None, LONG, "en"), (None, None, "fr"), (8, "ÀÉ A B " * 60, "fr"), (9, "x\x0by\x0cz\x1cq " * 40, "fr"), (10, "Wort " * 40_000, "de"), (11, "<|endoftext|> it's", "en"),
    (12, "日本 語  ½ x² ՘a", "en"), (13, "I'LL they'll  \n\n end  ", "en"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, g, 1, 2, 3, 4, 5) for i, t, g in ODD], "doc_id long, text string, lang string, part int, mask int, n int, n_tokens string, digest int")


@pytest.fixture(scope="module")
def odd_labels(spark):
    rows = [(4, 1, 0), (4, 0, 1), (5, 1, None), (6, None, 1), (None, 1, 1), (77, 1, 1), (10, 1, 1)]
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, quality int, toxic int, good string")


def plain_audit(docs, labels):
    least, parts = {}, {}
    for d in docs:
        if d["doc_id"] is not None:
            text = d["text"] or ""
            least[text] = min(least.get(text, d["doc_id"]), d["doc_id"])
    good = {r["doc_id"] for r in labels if r["quality"] == 1 and r["doc_id"] is not None}
    bad = {r["doc_id"] for r in labels if r["toxic"] == 1 and r["doc_id"] is not None}
    for d in docs:
        t, i = d["text"] or "", d["doc_id"]
        w = WORDS.findall(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        parts.setdefault(d["lang"] or "", []).append(({f for f in fails if fails[f]}, i in good, i in bad))
    out = []
    for part, rows in parts.items():
        shapley, own = Counter(), []
        for order in map("".join, permutations("ABCDE")):
            gone = set()
            for step, f in enumerate(order, 1):
                hit = [k for k, (fails, _, _) in enumerate(rows) if f in fails]
                out_now = [k for k in hit if k not in gone]
                shapley[f] += len(out_now)
                redundant = len(hit) - len(out_now)
                gone.update(out_now)
                own.append((part, order, step, len(rows) - len(gone), len(out_now), redundant, sum(r[0] == {f} for r in rows), sum(rows[k][1] for k in out_now), sum(rows[k][2] for k in out_now)))
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in own]
    return sorted(out)


def test_filter_audit(spark, odd, odd_labels):
    names = ["part", "filter_order", "step", *filter_audit.MEASURES, "shapley"]
    cases = [(odd, odd_labels), (odd, odd_labels.limit(0)), (spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))]
    for docs, labels in cases:
        got = filter_audit.audit(docs, labels)
        assert got.columns == names
        assert sorted(tuple(r) for r in got.collect()) == plain_audit(docs.collect(), labels.collect())
    assert filter_audit.audit(odd.limit(0), odd_labels).count() == 0


def test_no_python_and_no_text_exchange_in_the_audit(spark, odd, odd_labels):
    plan = filter_audit.audit(odd, odd_labels)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_clusters(ids, v, k, rounds, seed):
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, hashlib.sha256(f"{seed}:{ids[i]}".encode()).hexdigest(), v[i].tolist()))
    c = v[order[:k]]

    def assign():
        d = np.square(v[:, None] - c[None]).sum(axis=2)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(rounds):
        a, _ = assign()
        c = np.array([v[a == j].sum(axis=0) // (a == j).sum() if (a == j).any() else c[j] for j in range(len(c))])
    a, d = assign()
    return sorted(((ids[i], int(a[i]), int(d[i]), int(d[a == a[i]].sum()), int(d.sum()), centroids.centroid_sha256(c[a[i]])) for i in range(len(ids))), key=str)


def test_clusters_equal_plain_rounds(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[50:150] = x[50]  # one very common vector
    rows = [(i, r.tolist()) for i, r in enumerate(x)]
    rows += [(7, x[7].tolist()), (7, x[8].tolist()), (None, x[9].tolist()), (None, [0.0] * 8)]  # repeated and null ids
    out = [(400, None), (401, []), (402, [1.0] * 7), (403, [None] * 8), (404, [float("nan")] + [0.0] * 7), (405, [float("inf")] + [0.0] * 7)]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + out], "vec_id long, embedding array<float>, v int, cluster int").repartition(3)
    ids, v = [i for i, _ in rows], np.floor(np.array([r for _, r in rows], dtype=np.float32).astype(float) * 64).astype(np.int64)
    for k, rounds, block in ((16, 3, 16), (5, 0, 256), (1000, 2, 7)):
        got = centroids.labelled(frame, k=k, rounds=rounds, dims=8, scale=64, seed=1, block_rows=block).collect()
        assert sorted((tuple(r) for r in got), key=str) == plain_clusters(ids, v, k, rounds, 1)
    assert centroids.labelled(frame.filter("vec_id > 399"), dims=8).count() == 0
    with pytest.raises(ValueError, match="64 bits"):
        centroids.labelled(spark.createDataFrame([(1, [3e7] * 8)], "vec_id long, embedding array<double>"), dims=8)


def test_boxes_leave_out_far_centroids_only(spark):
    rng = np.random.default_rng(6)
    for _ in range(300):
        v, c = rng.integers(-9, 10, (12, 3)), rng.integers(-30, 31, (9, 3))
        among = centroids.candidates(v.min(axis=0), v.max(axis=0), c)
        d = np.square(v[:, None] - c[None]).sum(axis=2)
        assert set(np.argwhere(d == d.min(axis=1, keepdims=True))[:, 1]) <= set(among.tolist())
    centres = rng.normal(size=(32, 64))
    x = centres[rng.integers(0, 32, 4000)] + 0.05 * rng.normal(size=(4000, 64))
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    found = centroids.cluster(frame, k=16, rounds=2, block_rows=16)
    assert found.compared < 0.5


def test_hilbert_neighbours_touch():
    cells = np.array(np.meshgrid(*[np.arange(8)] * 3, indexing="ij")).reshape(3, -1).T
    keys = centroids.hilbert(cells, 3)
    order = sorted(range(len(cells)), key=lambda i: keys[i].tobytes())
    assert len({keys[i].tobytes() for i in order}) == len(cells)
    assert all(np.abs(cells[a] - cells[b]).sum() == 1 for a, b in zip(order, order[1:], strict=False))


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_token_counts(spark, odd, plain, monkeypatch):
    for docs, entries in ((odd, 4), (odd, token_counts.TABLE), (spark.read.parquet(f"{DATA}/documents.parquet"), 50)):
        got = token_counts.count_tokens(docs, queries.tokenizer_path(), 512, entries)
        assert set(docs.columns) <= set(got.columns)
        want = []
        for r in docs.collect():
            n = len(plain.encode(r["text"] or "", add_special_tokens=False).ids)
            want.append((r["doc_id"], len((r["text"] or "").encode()), n, n > 512))
        assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got.collect()), key=str) == sorted(want, key=str)
    assert token_counts.count_tokens(odd.limit(0), queries.tokenizer_path()).count() == 0
    assert token_counts.frequent(odd.filter("text is null")) == []


def test_other_tokenizers_count_whole_texts(spark, odd):
    import sentencepiece
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("piece_bpe_32k.model")
    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    word = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    some = odd.filter("doc_id < 10")
    texts = [r["text"] or "" for r in some.collect()]
    assert sorted(r["n_tokens"] for r in token_counts.count_tokens(some, path).collect()) == sorted(len(x) for x in processor.encode(texts))
    got = token_counts.count_tokens(some, queries.tokenizer_path("word_bpe_49k.json")).collect()
    assert sorted(r["n_tokens"] for r in got) == sorted(len(word.encode(t, add_special_tokens=False).ids) for t in texts)


def test_plan_of_counts_shuffles_no_pre_token(spark, odd):
    plan = token_counts.count_tokens(odd, queries.tokenizer_path())._jdf.queryExecution().toString()
    assert "Exchange" not in plan


def test_frequent_pre_tokens(spark, odd):
    docs = spark.createDataFrame([("the cat the dog the end " * 50,), ("Zebra",)], "text string")
    assert set(token_counts.frequent(docs, 4)) == {" the", " cat", " dog", " end"}


def test_pre_token_classes_are_the_librarys(plain):
    """Every character that ``split`` takes is of the same class in the tokenizer; all others go to it as they are."""
    pieces = tokens.pieces_of(queries.tokenizer_path())
    taken = [chr(c) for c in range(0x2200) if pieces.split(chr(c)) is not None]
    assert len(taken) > 600
    for c in taken:
        text = f"a{c}1 {c}{c}!{c} {c} \n{c}'s'{c}"
        assert pieces.split(text) == [text[a:b] for _, (a, b) in plain.pre_tokenizer.pre_tokenize_str(text)]
