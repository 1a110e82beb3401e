"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorspark.llm import chat, decontaminate, fim, html_extract, jaccard, lines, mixing, neighbours, pii, quality, ranked, sharding, warc
from sensorspark.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


@query(
    "op3_warc",
    """
    WITH p AS (
        SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
    ), f AS (
        SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p
    )
    SELECT page_id, payload_bytes, payload_digest,
        CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN NULL ELSE first_id END AS refers_to
    FROM f
    """,
)
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).drop("url")


@query("op5_hilbert")
def op5_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    cells = {f"cell{i}": c for i, c in enumerate(sharding.document_dimensions())}
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *[c.alias(n) for n, c in cells.items()])
    out = sharding.shard(rows, [F.col(c) for c in cells], F.col("size"), [F.col("doc_id").asc_nulls_last(), F.col("text_crc32"), F.col("size")])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query(
    "op6_line_mph",
    r"""
    WITH l AS (
        SELECT d.rid, d.doc_id, u.n, u.line FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
            LATERAL (SELECT unnest(d.ls) AS line, generate_subscripts(d.ls, 1) AS n) u
    ), k AS (
        SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
    ), c AS (
        SELECT key, max(doc_id) AS last_id FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT rid) >= 3
    ), m AS (
        SELECT k.*, c.key IS NOT NULL AND k.doc_id IS DISTINCT FROM c.last_id AS gone FROM k LEFT JOIN c ON k.key = c.key
    )
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
    FROM m GROUP BY rid, doc_id
    """,
)
def op6_line_mph(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query(
    "op10_mixing",
    r"""
    WITH d AS (
        SELECT doc_id, source, md5(coalesce(text, '')) AS digest, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
            row_number() OVER (PARTITION BY source, doc_id, coalesce(text, '')) - 1 AS copy
        FROM documents
    ), q AS (
        SELECT doc_id, max(CASE WHEN quality >= 1 THEN 1.0 WHEN quality < 1 THEN 0.25 ELSE 0.5 END)::DOUBLE AS w FROM labels GROUP BY doc_id
    ), k AS (
        SELECT d.*, -ln((('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || ':' || digest || ':' || copy || ':7'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / coalesce(q.w, 0.5) AS key
        FROM d LEFT JOIN q USING (doc_id)
    ), s AS (
        SELECT source, sum(size)::DOUBLE AS source_size FROM d GROUP BY source
    ), w AS (
        SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM s
    ), f AS (
        SELECT *, 3 * source_size AS cap,
            coalesce(sum(3 * source_size) OVER e, 0) AS filled, coalesce(sum(weight) OVER e, 0) AS gone,
            sum(source_size) OVER () AS everything, sum(weight) OVER () AS weights
        FROM w WINDOW e AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), v AS (
        SELECT *, (everything - filled) / (weights - gone) AS level FROM f
    ), t AS (
        SELECT source, source_size, least(cap, weight * max(CASE WHEN level * weight <= cap THEN level END) OVER ()) AS target FROM v
    ), r AS (
        SELECT k.doc_id, k.size, t.source_size::BIGINT AS source_size, t.target, floor(coalesce(t.target / nullif(t.source_size, 0), 0))::BIGINT AS epochs,
            coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS LAST, k.digest, k.copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS earlier
        FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
    )
    SELECT doc_id, size, source_size, target,
        (epochs * size + greatest(0, least(size, round(target)::BIGINT - epochs * source_size - earlier)))::BIGINT AS taken
    FROM r
    """,
)
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = mixing.label_weights(table(spark, sf_dir, "labels"))
    out = mixing.mix_sources(table(spark, sf_dir, "documents"), quality)
    return out.select("doc_id", "size", "source_size", "target", "taken")


@query("op1_subword_quality")
def op1_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select(
        "doc_id", (~quality.learns()).alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


@query(
    "op8_chosen_path_join",
    r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS ws FROM documents
    ), s AS (
        SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] ELSE
            list_sort(list_distinct(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' ')))) END AS sh
        FROM w
    ), c AS (
        SELECT sh, min(doc_id) AS set_id, count(*) AS n_copies FROM s WHERE len(sh) > 0 GROUP BY sh
    ), u AS (
        SELECT set_id, n_copies, len(sh) AS n, unnest(sh) AS x FROM c
    ), p AS (
        SELECT a.set_id AS a, b.set_id AS b, any_value(b.n_copies) AS copies FROM u a JOIN u b ON a.x = b.x AND a.set_id <> b.set_id
        GROUP BY 1, 2 HAVING count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9
    ), r AS (
        SELECT set_id AS a, set_id AS b FROM c UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a
    ), k AS (
        SELECT a, min(b) AS class_id FROM r GROUP BY a
    ), l AS (
        SELECT a, sum(copies) AS links FROM p GROUP BY a
    )
    SELECT s.doc_id, coalesce(k.class_id, s.doc_id) AS class_id, coalesce(c.set_id, s.doc_id) AS set_id, coalesce(c.n_copies, 1)::BIGINT AS n_copies,
        (coalesce(l.links, 0) + coalesce(c.n_copies, 1) - 1)::BIGINT AS n_links
    FROM s LEFT JOIN c ON s.sh = c.sh LEFT JOIN k ON k.a = c.set_id LEFT JOIN l ON l.a = c.set_id
    """,
)
def op8_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


@query("op7_cgk_decontamination")
def op7_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_projection_kdtree")
def op2_projection_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op9_wrapper_induction")
def op9_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query(
    "op4_perspectives",
    r"""
    WITH t AS (
        SELECT conv_id, coalesce(nullif(trim(role), ''), 'unknown') AS speaker, coalesce(text, '') AS body, turn FROM conversations
    ), p AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, speaker, body) - 1 AS place FROM t
    ), w AS (
        SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'
    ), r AS (
        SELECT p.conv_id, w.perspective, (place // 64)::BIGINT AS chunk, place, speaker = perspective AS own,
            '<|im_start|>' || CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker <> 'system' THEN 'user name=' || replace(speaker, '<|', '< |') ELSE 'system' END || chr(10) AS head,
            replace(body, '<|', '< |') || '<|im_end|>' AS said
        FROM p JOIN w ON p.conv_id IS NOT DISTINCT FROM w.conv_id
    ), s AS (
        SELECT *, coalesce(sum(length(head) + length(said) + 1) OVER (PARTITION BY conv_id, perspective, chunk ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begun FROM r
    )
    SELECT conv_id, perspective, chunk, count(*)::INTEGER AS n_turns, string_agg(head || said || chr(10), '' ORDER BY place) AS dialogue,
        coalesce(string_agg((begun + length(head)) || '-' || (begun + length(head) + length(said)), ',' ORDER BY place) FILTER (own), '') AS spans
    FROM s GROUP BY conv_id, perspective, chunk
    """,
)
def op4_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.rotate(table(spark, sf_dir, "conversations"))
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["begin"].cast("string"), s["end"].cast("string"))), ",")
    return out.withColumn("spans", text)


@query(
    "op12_fim_assembly",
    r"""
    WITH d AS (
        SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
    ), h AS (
        SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS h1, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS h2,
            ('0x' || substr(h, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS h4
        FROM d
    ), f AS (
        SELECT *, least(h1, h2) AS a, greatest(h1, h2) AS b,
            CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form
        FROM h
    ), p AS (
        SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM f
    )
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
            ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
        sha256(t) AS restored_sha256
    FROM p
    """,
)
def op12_fim_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


@query(
    "op13_max_sketch_search",
    r"""
    WITH d AS (
        SELECT row_number() OVER () AS rid, doc_id,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
        FROM documents
    ), g AS (
        SELECT (count(*) FILTER (len(ts) > 0))::BIGINT AS docs, sum(len(ts))::BIGINT AS terms FROM d
    ), c AS (
        SELECT rid, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*)::BIGINT AS tf FROM (SELECT rid, doc_id, len(ts)::BIGINT AS n, unnest(ts) AS term FROM d) GROUP BY rid, term
    ), w AS (
        SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM c, g GROUP BY term
    ), i AS (
        SELECT row_number() OVER () AS iid, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)
    ), q AS (
        SELECT DISTINCT iid, item_id, term FROM (
            SELECT iid, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM i
        )
    ), s AS (
        SELECT iid, any_value(item_id) AS item_id, rid, any_value(doc_id) AS doc_id,
            sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))))::BIGINT AS score
        FROM q JOIN c USING (term) JOIN w USING (term), g GROUP BY iid, rid
    ), r AS (
        SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM s WHERE score > 0
    )
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
    """,
)
def op13_max_sketch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_semi_markov_pii")
def op11_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find_personal(docs, pii.train(docs))
    base = F.filter("spans", lambda s: s["base"])
    # Counts and digest are of the base spans; ``spans`` lists those that the field added as well.
    of = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(of) - F.size(F.array_remove(of, kind))).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
