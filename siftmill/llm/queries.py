"""The queries of this subpackage: each applies one operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.llm import centroids, chat, filter_audit, html_blocks, kd_shards, langid, mix, pack, quality, simhash, token_counts, token_files, vp_search
from siftmill.llm.common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"))


#: Measured on the test tables; one would be exact.
VP_FACTOR = 2.0


def op2_vantage_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vp_search.search(vp_search.index(vectors), vectors.filter("vec_id % 100 = 0"), k=10, factor=VP_FACTOR)


def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kd_shards.shards(table(spark, sf_dir, "documents"), leaves=24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_simhash_bk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = F.lit("\\### Assistant: </turn> ok")
    both = F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role"))))
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), both.alias("t"), says.alias("text")).select("conv_id", F.col("t.turn").cast("long").alias("turn"), "t.role", "text")
    rows = chat.formatted(given.unionByName(extra))
    shown = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat.loss_text(F.col("formatted"), F.col("turns"))
    return rows.withColumn("_loss", loss).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(shown, 256).alias("turns_sha256"), F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_mix_to_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix.mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)
    return token_files.read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_pack_shortest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0, max_len=1024, payload=F.crc32("ids").alias("ids_crc32"))


def op9_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html_blocks.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_language_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_hilbert_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.labelled(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64, seed=1)


def op13_two_tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), limit=512)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


QUERIES = {f.__name__: f for f in (op1_quality_mcd, op2_vantage_points, op3_kd_shards, op4_simhash_bk, op5_chat_round_trip, op6_mix_to_budget, op7_token_files, op8_pack_shortest_first, op9_html_blocks, op10_language_bayes, op11_filter_audit, op12_hilbert_zones, op13_two_tier_counts)}
ORACLE = {
    "op5_chat_round_trip": r"""
        WITH said AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) r(i)
        ), marked AS (
            SELECT *, replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\e') AS text2,
                replace(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\e'), ':', '\c'), chr(10), '\n') AS role2,
                contains(text, '###') OR contains(text, '</turn>') OR contains(role, '###') OR contains(role, ': ')
                OR regexp_matches(text, '\\[bhe]') OR regexp_matches(role, '\\[bhecn]') AS conflict
            FROM said
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CASE WHEN bool_or(conflict) THEN sum(14 + length(role2) + length(text2)) ELSE sum(14 + length(role) + length(text)) END::BIGINT AS formatted_chars
        FROM marked GROUP BY conv_id""",
    "op11_filter_audit": r"""
        WITH texts AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda w: w <> '') AS w
            FROM documents
        ), failing AS (
            SELECT doc_id, part, concat(
                CASE WHEN len(w) < 100 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' END,
                CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' END,
                CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' END) AS fs
            FROM texts
        ), said AS (
            SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id
        ), cells AS (
            SELECT part, fs, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(bad, 0)) AS bad FROM failing LEFT JOIN said USING (doc_id) GROUP BY part, fs
        ), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
        ), orders AS (
            SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
            WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
        ), steps AS (SELECT o, s, substr(o, s, 1) AS f, substr(o, 1, s - 1) AS earlier FROM orders, range(1, 6) r(s)
        ), met AS (
            SELECT *, contains(fs, f) AS fails, translate(fs, earlier, '') <> fs AS gone FROM steps, cells
        ), measured AS (
            SELECT part, o AS filter_order, s::INT AS step, f, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept,
                sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN fails AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
                sum(CASE WHEN fs = f THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost,
                sum(CASE WHEN fails AND NOT gone THEN bad ELSE 0 END)::BIGINT AS toxic_lost
            FROM met GROUP BY part, o, s, f
        )
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley
        FROM measured""",
}


def _lloyd_sql(k: int, rounds: int, dims: int, scale: int, seed: int) -> str:
    """Rounds of assignment and floor(sum / count), unrolled; the last assignment is the result."""
    steps = [f"""
        x AS (SELECT vec_id, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims}),
        c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS k, v FROM x QUALIFY k < {k})"""]
    for r in range(rounds + 1):
        steps.append(f"""
        d{r} AS (SELECT vec_id, x.v, c.k, list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance FROM x, c{r} c),
        a{r} AS (SELECT vec_id, v, k, distance FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, k) = 1)""")
        if r < rounds:
            steps.append(f"""
        s{r} AS (SELECT k, i, sum(v[i])::BIGINT AS s, count(*)::BIGINT AS n FROM a{r}, range(1, {dims + 1}) t(i) GROUP BY k, i),
        m{r} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{r} GROUP BY k),
        c{r + 1} AS (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON m.k = c.k)""")
    return "WITH" + ",".join(steps) + f"""
        SELECT a.vec_id, a.k::INT AS cluster, a.distance, sum(a.distance) OVER (PARTITION BY a.k)::BIGINT AS cluster_inertia,
            sum(a.distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} c ON c.k = a.k"""


ORACLE["op12_hilbert_zones"] = _lloyd_sql(k=16, rounds=3, dims=64, scale=64, seed=1)
