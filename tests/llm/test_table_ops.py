"""Operators 1, 2, 3, 5, 6, 9 and the pipeline against brute force, with nulls, empty and repeated rows and clashing columns."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("siftmill.llm")

from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from siftmill.llm import chat, html_blocks, kd_shards, mix, quality, queries, vp_search  # noqa: E402

DATA = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None), (2, ""), (3, " \n "), (4, "one"), (5, "a b c d e f g h " * 4), (6, " lead\n\nlead\n lead\n#$ "), (6, "same"), (6, "same"), (None, "x"), (8, "été là ÉÈ | " * 2000)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i == 4 else "en", None if i == 8 else f"s{(i or 0) % 2}", 1, 2, 3, 4) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, kept int, _size int, shard int")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def plain_statistics(text):
    text = text or ""
    words, lines, seen, dups = WORDS.findall(text), [x for x in text.split("\n") if WORDS.search(x)], set(), 0
    for x in lines:
        dups += x in seen
        seen.add(x)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered.update(range(i, i + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered)


def test_statistics_and_base_rules(odd, documents):
    for docs in (odd, documents):
        rows = quality.assess(docs).collect()
        want = [(r["doc_id"], *(s := plain_statistics(r["text"])), s[0] < 20 or 100 * s[4] > 30 * s[0]) for r in docs.collect()]
        assert sorted(((r["doc_id"], *[r[c] for c in quality.STATS], r["base_failed"]) for r in rows), key=str) == sorted(want, key=str)
        assert not any(r["kept"] and r["base_failed"] for r in rows)
    assert quality.assess(odd.limit(0)).count() == 0
    assert sorted(r["doc_id"] for r in quality.assess(odd, whole=True).filter("_kept").collect()) == sorted(r["doc_id"] for r in quality.assess(odd).filter("kept").collect())


def plain_estimate(x):
    """The same concentration steps in numpy."""
    soft, n = np.diag(np.square(quality.SOFTEN)), len(x)

    def fit(rows, factor):
        return rows.mean(axis=0), np.cov(rows.T, bias=True) * factor + soft

    def distance(est):
        z = x - est[0]
        return np.einsum("ij,jk,ik->i", z, np.linalg.inv(est[1]), z)

    est = fit(x, 1.0)
    for _ in range(quality.STEPS):
        bins = np.floor(np.log1p(distance(est)) * quality.BINS)
        order = np.sort(bins)
        est = fit(x[bins <= order[int(np.ceil(quality.COVERAGE * n)) - 1]], quality.CONSISTENCY)
    return est, distance(est)


def test_minimum_covariance_determinant(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(0, 1, (400, quality.P)) * quality.SCALE).astype(int)
    x[:80] += 30 * quality.SCALE  # a fifth lies far off and must not pull the estimate
    rows = spark.createDataFrame([("p", *r) for r in x.tolist()], "_pool string, " + ", ".join(f"_x{i} long" for i in range(quality.P)))
    rows.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/mcd")
    rows = spark.read.parquet(path)
    found = quality._distance(rows.join(quality.estimates(rows), "_pool")).select("_x0", "_d").collect()
    assert all((r["_d"] > 500) == (r["_x0"] > 15 * quality.SCALE) for r in found)
    assert sum(r["_d"] > quality.CUT for r in found) <= 85
    _, want = plain_estimate(x / quality.SCALE)
    step = quality._step(rows, quality._fit(rows.withColumn("_start", F.lit("all")).groupBy("_pool", "_start").agg(*quality._sums()), 1.0)).first()
    z = x / quality.SCALE
    cov = np.cov(z.T, bias=True) + np.diag(np.square(quality.SOFTEN))
    d = np.einsum("ij,jk,ik->i", z - z.mean(0), np.linalg.inv(cov), z - z.mean(0))
    bins = np.floor(np.log1p(d) * quality.BINS)
    near = x[bins <= np.sort(bins)[int(np.ceil(0.75 * len(x))) - 1]]
    assert step["_n"] == len(near) and [step[f"_s{i}"] for i in range(quality.P)] == near.sum(0).tolist()


def test_junk_goes_and_clean_documents_stay_by_label(spark):
    """Symbols are rare in every pool, so its own spread is nothing: 158 of 301 went with a fixed threshold."""
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = quality.assess(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).filter("not base_failed").join(labels, "doc_id")
    found = {(r["quality"], r["kept"]): r["count"] for r in rows.groupBy("quality", "kept").count().collect()}
    assert found[0, False] > 0.95 * (found[0, False] + found[0, True])
    assert found[1, False] < 0.005 * (found[1, False] + found[1, True])


@pytest.mark.parametrize("factor", [1.0, queries.VP_FACTOR])
def test_nearest_neighbours(spark, monkeypatch, factor):
    monkeypatch.setattr(vp_search, "shard_rows", lambda n: 120)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 16)) + 3 * rng.normal(size=(8, 16))[rng.integers(0, 8, 400)]
    x[100:160] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1100, [0.0] * 16), (1200, [float("nan")] * 16), (1300, [None] * 16), (1400, []), (None, [1.0] * 16), (1500, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    tree = vp_search.index(frame)
    got = {}
    for r in vp_search.search(tree, frame.filter("vec_id % 20 = 0"), 10, factor).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    x, hit = x.astype(np.float32).astype(float), 0
    assert sorted(got) == list(range(0, 400, 20))
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(400), d))[:10].tolist()
        hit += len(set(want) & {v for v, _ in found})
        assert all(s == pytest.approx(d[v]) for v, s in found) and found == sorted(found, key=lambda f: (f[1], f[0]))
        assert factor > 1 or [v for v, _ in found] == want
    assert hit >= 0.9 * 200
    none = frame.limit(0)
    assert vp_search.search(vp_search.index(none), none).count() == 0


def test_kd_shards(odd, documents):
    for docs, leaves in ((odd, 3), (documents, 24), (documents.unionByName(documents).unionByName(documents.limit(1).crossJoin(documents.select().limit(150)).select(*documents.columns)), 7)):
        rows, source = kd_shards.shards(docs, leaves).collect(), docs.collect()
        want = sorted((str(r["doc_id"]), len(t := (r["text"] or "").encode()) + 8, zlib.crc32(t)) for r in source)
        assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == want
        sizes, slots = [0] * leaves, [[] for _ in range(leaves)]
        for r in rows:
            sizes[r["shard"]] += r["size"]
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots)
        assert max(sizes) - min(sizes) <= 6 * max(w[1] for w in want)
    assert kd_shards.shards(odd.limit(0)).count() == 0


def plain_kd(rows, first, leaves, whole):
    """Weighted medians along the widest dimension by sorting; a row is (size, values by dimension, row number)."""
    if leaves == 1 or not rows:
        return {r[2]: first for r in rows}
    extent = [(max(r[1][i] for r in rows) - min(r[1][i] for r in rows)) / whole[i] for i in range(4)]
    d = extent.index(max(extent))
    rows, wanted, upto, cut = sorted(rows, key=lambda r: (r[1][d], r[2])), sum(r[0] for r in rows) * (leaves // 2) / leaves, 0, 0
    while upto < wanted:
        upto, cut = upto + rows[cut][0], cut + 1
    return plain_kd(rows[:cut], first, leaves // 2, whole) | plain_kd(rows[cut:], first + leaves // 2, leaves - leaves // 2, whole)


def test_kd_cuts_are_weighted_medians(spark, documents):
    """Every row's leaf against plain sorting; sources share a long prefix, half of all rows share one of them."""
    source = F.when(F.col("doc_id") % 2 == 0, "https://example.org/a").when(F.col("doc_id") % 7 == 0, None).otherwise(F.concat(F.lit("https://example.org/"), "source"))
    docs = documents.withColumn("source", source)
    rows = kd_shards.entries(docs)
    names = [*kd_shards.DIMENSIONS]
    got = rows.withColumn("leaf", kd_shards.kd_tree(rows, 11)).select("size", *names, kd_shards.ROW, "leaf", "doc_id").collect()
    ranks = {v: i for i, v in enumerate(sorted({r["source"] for r in docs.collect() if r["source"] is not None}))}
    assert len(ranks) > 3 and {r["doc_id"]: r["_by_source"] for r in got} == {r["doc_id"]: ranks.get(r["source"], -1) for r in docs.collect()}
    plain = [(r["size"], [r[d] for d in names], r[kd_shards.ROW]) for r in got]
    whole = [max(1, max(p[1][i] for p in plain) - min(p[1][i] for p in plain)) for i in range(4)]
    assert plain_kd(plain, 0, 11, whole) == {r[kd_shards.ROW]: r["leaf"] for r in got}
    total = sum(p[0] for p in plain)
    sizes = {}
    for r in kd_shards.shards(docs, leaves=None, target_bytes=total // 5).collect():
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
    assert len(sizes) == -(-total // (total // 5)) and max(sizes.values()) < 1.6 * total / len(sizes)


def test_chat_round_trip(spark):
    nasty = ["", None, "\\### Assistant: </turn> ok", "</turn>\n### user: x", "a\\b \\h \\e \\\\", "####", "x\n", "</tur", "n>", ": ### "]
    rows = [(c, t, r, nasty[(c + t) % len(nasty)]) for c in range(10) for t, r in enumerate(("user", "assistant", "a: b\n", None, "###", "assistant"))]
    rows += [(None, None, "user", "x"), (None, 1, "user", "y"), (None, 1, "user", "y")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    for r in chat.formatted(frame).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("turns"))).collect():
        own = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text in rows if c == r["conv_id"]))
        assert [(t["role"], t["text"]) for t in r["turns"]] == [x[1:] for x in own]
        assert r["loss"] == "".join(x[2] for x in own if x[1] == "assistant")
        assert r["formatted"].count("</turn>\n") == len(own)
    assert chat.formatted(frame.limit(0)).count() == 0


def test_fill_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(40):
        counts = {int(k): int(n) for k, n in zip(rng.integers(1, 40, 5), rng.integers(1, 4, 5), strict=True)}
        budget = int(rng.integers(0, 150))
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * i for s in sums for i in range(n + 1)}
        taken = mix.fill(budget, counts)
        assert all(n <= counts[k] for k, n in taken.items())
        assert sum(k * n for k, n in taken.items()) == max(s for s in sums if s <= budget)


def test_sources_of_very_long_documents_are_filled(monkeypatch):
    for counts, budget, want in (({90_000: 1, 80_000: 1}, 85_000, 80_000), ({200_000: 1, 130_000: 2, 90_000: 10}, 260_000, 260_000), ({70_000: 30}, 1_000_000, 980_000), ({0: 3}, 5, 0), ({}, 0, 0)):
        taken = mix.chosen(counts, budget)
        assert sum(k * n for k, n in taken.items()) == want and all(n <= counts[k] for k, n in taken.items())
    monkeypatch.setattr(mix, "FILLED", 16)  # short lengths in the place of long ones
    rng = np.random.default_rng(6)
    for _ in range(200):
        counts = {int(k): int(n) for k, n in zip(rng.integers(5, 60, 5), rng.integers(1, 5, 5), strict=True)}
        budget, sums = int(rng.integers(0, sum(k * n for k, n in counts.items()) + 1)), {0}
        for k, n in counts.items():
            sums = {s + k * i for s in sums for i in range(n + 1)}
        taken = mix.chosen(counts, budget)
        assert all(0 <= n <= counts[k] for k, n in taken.items())
        assert sum(k * n for k, n in taken.items()) == max(s for s in sums if s <= budget)
    monkeypatch.setattr(mix, "MOST_BITS", 0)  # without room for more, one of the lengths that fit is taken
    assert mix.chosen({90: 1, 80: 1}, 85) == {90: 0, 80: 1}


def test_mix(odd, documents):
    for docs in (odd, documents):
        rows = mix.mix(docs).collect()
        assert sorted((str(r["doc_id"]), r["size"]) for r in rows) == sorted((str(r["doc_id"]), len(WORDS.findall(r["text"] or ""))) for r in docs.collect())
        totals, taken = Counter(), Counter()
        for r in rows:
            totals[r["source"]] += r["size"]
            taken[r["source"]] += r["size"] * r["times"]
            assert 0 <= r["times"] <= 3
        aims, largest = mix.targets(totals), max(r["size"] for r in rows)
        assert sum(aims.values()) == pytest.approx(sum(totals.values()))
        for r in rows:
            assert r["source_size"] == totals[r["source"]] and r["target"] == pytest.approx(aims[r["source"]])
            assert abs(taken[r["source"]] - r["target"]) <= largest
        key = lambda r: (str(r["doc_id"]), r["size"], r["times"])
        assert sorted(map(key, rows)) == sorted(map(key, mix.mix(docs).collect()))
        want = Counter((str(r["doc_id"]), r["size"]) for r in rows for _ in range(r["times"]))
        assert Counter((str(r["doc_id"]), len(WORDS.findall(r["text"] or ""))) for r in mix.mix(docs, whole=True).collect()) == want
    assert mix.targets({"a": 1, "b": 100, None: 100}) == {"a": 3.0, "b": pytest.approx(198 * 2 / 5), None: pytest.approx(198 * 3 / 5)}
    assert mix.mix(odd.limit(0)).count() == 0


def test_pages(spark):
    prose = "The cat and the dog were in the house, and it was not so bad for them as one would have thought at first sight of the place, or so they said."
    page = f"""<html><head><title>T</title><style>p>a{{}}</style></head><body><header>Site <a href=/>home</a></header><div class="cookie-notice">We use cookies on the site.
    </div><nav><ul><li><a href="/x">menu</a></li></ul></nav><article class="post"><h1>Short &amp; sweet</h1><p>{prose}<p>un<b>broken</b> word<br>next<script>var a="</p>";</script></p>
    <div class="ad">Buy the best of all now</div><p>{prose}</p><form><input value=1>Name</form></article><div id="comments"><p>{prose}</p></div><aside>{prose}</aside><footer>&copy; 2024 it</footer>"""
    rows = [(1, page), (2, None), (3, ""), (4, "<p>" + prose), (5, "<!-- x"), (6, f"<div><p>{prose}</p><p>Tiny.</p></div><p title='a>b'>{prose}"), (7, "plain"), (1, page)]
    frame = spark.createDataFrame(rows, "page_id long, html string").withColumn("blocks", F.lit("clash"))
    got = {r["page_id"]: r["text"] for r in html_blocks.extract(frame).collect()}
    assert got[1] == f"Short & sweet {prose} unbroken word next {prose}"
    assert got[2] == got[3] == got[5] == "" and got[4] == prose and got[6] == f"{prose} Tiny. {prose}" and got[7] == "plain"
    assert html_blocks.extract(frame).count() == len(rows) and html_blocks.extract(frame.limit(0)).count() == 0


@pytest.mark.parametrize("prose", [
    "Durante la primavera gli abitanti della valle tornavano ogni mattina nei campi, raccoglievano fiori selvatici e raccontavano ai bambini vecchie storie di pastori, lupi e montagne lontane.",
    "Wczesną wiosną mieszkańcy doliny wracali każdego ranka na pola, zbierali dzikie kwiaty i opowiadali dzieciom stare historie o pasterzach, wilkach oraz dalekich górach.",
    "Ранней весной жители долины каждое утро возвращались в поля, собирали дикие цветы и рассказывали детям старые истории о пастухах, волках и далёких горах.",
    "早春时节，山谷里的居民每天早晨都回到田野，采集野花，并给孩子们讲述关于牧羊人、狼和远山的古老故事，夜里大家围着炉火唱歌，直到月亮升起来。",
])
def test_pages_of_divs_in_languages_without_stop_words(prose):
    page = f"<body><div class=nav><a href=/>X</a></div><div><h1>Abc</h1><p>{prose}</p><p>{prose}</p><p>Xyz</p><p>{prose}</p></div><p><a href=/y>{prose}</a></p><div id=footer><p>{prose}</p></div></body>"
    assert [b["text"] for b in html_blocks.labelled(page) if b["kept"]][:5] == ["Abc", prose, prose, "Xyz", prose]
    assert [b["text"] for b in html_blocks.labelled(page) if b["kept"]][5:] == []
    short = [prose[i : i + 40] for i in range(0, 40, 10)]  # nothing but short blocks: all that isn't ruled out comes back
    page = f"<body><div><p><a href=/y>{prose}</a></p>" + "".join(f"<p>{x}</p>" for x in short) + "</div></body>"
    assert [b["text"] for b in html_blocks.labelled(page) if b["kept"]] == [x.strip() for x in short]


def test_long_code_and_tables_stay_beside_prose():
    prose = "The cat and the dog were in the house, and it was not so bad for them as one would have thought at first sight of the place, or so they said."
    code = " ".join(f"x{i} = f{i}(y{i}, z{i});" for i in range(20))
    page = f"<body><div><p>{prose}</p><pre>{code}</pre><p>{prose}</p><table><tr><td>{'12.5 kg ' * 30}</td></tr></table><p>{prose}</p></div><div class=footer>{code}</div></body>"
    assert [b["text"] for b in html_blocks.labelled(page) if b["kept"]] == [prose, code, prose, ("12.5 kg " * 30).strip(), prose]


@pytest.mark.parametrize("name,stays", [
    ("no-sidebar", True), ("has-sidebar", True), ("layout-with-sidebar", True), ("header-image", True), ("entry-share", True), ("related-none", True), ("content", True),
    ("sidebar", False), ("comments", False), ("footer wide", False)])
def test_wrappers_go_by_what_they_are(name, stays):
    prose = "The cat and the dog were in the house, and it was not so bad for them as one would have thought at first sight of the place, or so they said."
    side = f"<div class='left-sidebar'><p>{prose} By the side.</p></div><nav>Home</nav>"
    page = f"<body>{side if stays else ''}<div class='{name}'><h1>Of cats</h1><p>{prose}</p><p>{prose}</p></div></body>"
    kept = [b["text"] for b in html_blocks.labelled(page) if b["kept"]]
    assert kept == (["Of cats", prose, prose] if stays else [])


HOSTILE = ["<script", "<a ", "<article>x</article>", "<article>x ", "<!-- ", "<", '<a href="', "<a b='", "<a b='\"", "<!x", "&", '<div class="a', "<nav>", "</div>", "<script>x", "<b>x", '<p class="comment">x']


@pytest.mark.parametrize("shape", [*HOSTILE, "nested"])
def test_hostile_pages_take_linear_time(shape):
    import time

    def took(n):
        page = "<div>" * n + "</span>" * n + "</div>" * n if shape == "nested" else shape * n + "\"'>"
        start = time.perf_counter()
        html_blocks.labelled(page)
        return time.perf_counter() - start

    took(1000)
    assert took(32_000) < 6 * took(8_000) + 0.3


def test_pages_keep_their_columns(spark):
    rows = spark.createDataFrame([(1, None, "t", 2), (2, "", "t", 2), (3, "<p>x", "t", 2), (3, "<p>x", "t", 2)], "page_id long, html string, text string, url int")
    got = html_blocks.extract(rows)
    assert set(got.columns) == {"page_id", "html", "text", "url", "blocks"}
    assert sorted((r["page_id"], r["text"], r["url"]) for r in got.collect()) == [(1, "", 2), (2, "", 2), (3, "x", 2), (3, "x", 2)]


def test_pipeline(spark, odd, documents):
    docs = documents
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.written(stage(spark, docs, DATA), name)
        if name != "packing":
            assert docs.columns == documents.columns
            assert docs.join(before, docs.columns, "left_anti").count() == 0
    kept = {r["doc_id"] for r in quality.assess(documents).filter("kept").collect()}
    assert len(kept) < documents.count() and docs.select("doc_id").distinct().count() <= len(kept)
    assert docs.count() > 0
    rows = odd
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, DATA)
    rows.collect()
    assert corpus_pipeline.near_duplicates(spark, odd, DATA).filter("doc_id = 6 and text = 'same'").count() == 1


def exchanged(df):
    """Columns that the exchanges of a plan move, as it is before any stage has run."""
    todo, found = [df._jdf.queryExecution().executedPlan()], set()
    while todo:
        at = todo.pop()
        if at.nodeName() == "AdaptiveSparkPlan":
            at = at.initialPlan()
        if "Exchange" in at.nodeName():
            found |= {at.output().apply(i).name() for i in range(at.output().size())}
        todo.extend(at.children().apply(i) for i in range(at.children().size()))
    return found


def test_stages_exchange_decisions_and_leave_no_scratch(spark, documents, tmp_path):
    import pathlib

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    shared, docs = pathlib.Path(spark.conf.get("spark.checkpoint.dir")), documents
    try:
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, docs, DATA)
            if name != "quality_rules":
                assert not exchanged(rows) & {"text", "_given1", "ids"}
            rows.write.parquet(str(tmp_path / name))
            docs = spark.read.parquet(str(tmp_path / name))
            assert len(list(shared.glob("stage-*"))) <= 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    corpus_pipeline.next_stage(None, spark)
    assert not list(shared.glob("stage-*"))


def test_bits_of_decisions(spark):
    from siftmill.llm import common

    rows = spark.range(0, 70_000, 1, 2).withColumn("flag", F.expr("id % 3 = 0 or id % 32768 in (0, 7, 8, 32767)"))
    base = common.laid_out(common.numbered(rows), "_chunk", "base")
    maps = common.bitmaps(base.filter("id < 60000"), _set=F.col("flag"))
    got = common.decided(base, maps).select("id", common.bit(F.col("_set"), F.col("_pos")).alias("b")).collect()
    assert {r["id"] for r in got if r["b"]} == {r["id"] for r in rows.filter("flag and id < 60000").collect()}
    assert "Exchange" not in base._jdf.queryExecution().toString()


def test_texts_of_no_learned_language_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng, clean = np.random.default_rng(8), docs.filter("doc_id % 50 = 0 and length(text) between 500 and 2000").collect()
    foreign = [
        "Wczesną wiosną mieszkańcy doliny wracali każdego ranka na pola, zbierali dzikie kwiaty i opowiadali dzieciom stare historie o pasterzach, wilkach oraz dalekich górach.",
        "Ранней весной жители долины каждое утро возвращались в поля, собирали дикие цветы и рассказывали детям старые истории о пастухах, волках и далёких горах.",
        "ある春の朝、谷の人々は畑に戻り、野の花を摘み、子供たちに羊飼いや狼の古い物語を語りました。",
        " ".join("".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), 6)) for _ in range(60)),
        " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(60)),
        "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), 500)),
    ]
    extra = [(-i - 1, t * n, None) for i, (t, n) in enumerate((t, n) for t in foreign for n in (1, 20))] + [(-100 - i, r["text"], None) for i, r in enumerate(clean)]
    stay = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs.union(spark.createDataFrame(extra, docs.schema)), DATA).collect()}
    assert not any(-100 < i < 0 for i in stay)
    assert len(clean) > 5 and all(-100 - i in stay for i in range(len(clean)))
    print("language_id keeps", sum(i >= 0 for i in stay), "of", docs.count())
    assert sum(i >= 0 for i in stay) > 0.98 * docs.count()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("conversations", "documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    cursor = con.execute(queries.ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(map(tuple, queries.QUERIES[name](spark, DATA).select(*columns).collect())) == sorted(cursor.fetchall())


def test_packed_ids_wait_for_no_python_and_cross_no_exchange(spark):
    from siftmill.llm import pack

    texts = [(i, " ".join(f"word{j % 7}" for j in range((i * 37) % 3000))) for i in range(60)]
    packed = pack.pack(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), queries.tokenizer_path())
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "ids" in plan
    scan = [line for line in plan.splitlines() if "Exchange" in line and "ids" in line]
    assert not scan
    rows = packed.collect()
    assert sorted((r.doc_id, r.start) for r in rows) == sorted({(r.doc_id, r.start) for r in rows})
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length, len(r.ids)))
    for held in by.values():
        at = 0
        for offset, length, size in sorted(held):
            assert offset == at and size == 4 * length
            at += length
        assert at <= 1024
