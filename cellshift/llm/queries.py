"""The dealt operators as registered queries, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellshift.llm import byte_cnn, decontamination, filter_audit, kk_sharding, license_scan, merkle_manifest, packing, simhash, surrogates, token_counts, topk_search, toxicity_crf, url_filters
from cellshift.llm.common import held_out, materialize, read


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    histogram = token_counts.length_histogram(read(spark, sf_dir, "documents"), ["source"])
    return token_counts.suffix_sums(materialize(histogram, "lengths"), ["source"])


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity_crf.Model | None:
    learned = ~held_out("doc_id", 5, 0)
    return toxicity_crf.fit(read(spark, sf_dir, "documents").where(learned), read(spark, sf_dir, "labels").where(learned))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity_crf.score(read(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op6_kk_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kk_sharding.shard(read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(read(spark, sf_dir, "documents")))


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(read(spark, sf_dir, "embeddings"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    model = byte_cnn.fit(documents.where(~held_out("doc_id", 3, 1)))
    return byte_cnn.predict(documents, model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return audit.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest(read(spark, sf_dir, "documents"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(read(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (op1_token_counts, op2_toxicity, op3_decontamination, op4_license_scan, op5_simhash, op6_kk_sharding, op7_packing, op8_surrogates, op9_topk_search, op10_language_id,
              op11_filter_audit, op12_merkle_manifest, op13_url_filters)
}
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TEMPLATES = ", ".join(f"({i}, '{label}', list_distinct(string_split('{text}', ' ')), string_split('{told}', ' '))" for i, (label, text, told) in enumerate(license_scan.TEMPLATES))
_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_filters.RULES)
_HOST_WORDS = ", ".join(f"({i}, '{w}')" for i, w in enumerate(url_filters.HOST_WORDS))
_PHRASES = ", ".join(f"('{label}', string_split('{phrase}', ' '))" for phrase, label in license_scan.BASE.items())


def _hashed(*fields: str) -> str:
    each = " || ".join(f"coalesce(CAST(octet_length(encode(CAST({f} AS VARCHAR))) AS VARCHAR) || ':' || CAST({f} AS VARCHAR), '-')" for f in fields)
    return f"sha256({each})"


def _manifest_sql(levels: int = 8, groups: int = 4) -> str:
    """Level by level, each its own table: a lang's nodes while it has several, then the subroots'; 8 ** levels rows of a lang at most."""
    steps = [f"""crc AS (SELECT doc_id, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
            lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x)
            WHEN acc & 1 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END)) AS c FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL))""",
        f"""leaf AS (SELECT d.*, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, CASE WHEN c % 3 = 0 THEN changed ELSE leaf END AS f FROM (
            SELECT doc_id, lang, {_hashed('doc_id', 'source', 'lang', 'n_chars', 'text')} AS leaf,
                {_hashed('doc_id', 'source', 'lang', 'n_chars', f"translate(text, '{_UPPER}', '{_UPPER.lower()}')")} AS changed FROM documents) d LEFT JOIN crc USING (doc_id))""",
        "n0 AS (SELECT lang, r, leaf AS node FROM leaf)", "f0 AS (SELECT doc_id, lang, leaf, r, f, '' AS proof FROM leaf)"]
    run = "OVER (PARTITION BY lang, r // 8 ORDER BY r ROWS BETWEEN"

    def level(k: int, nodes: str) -> None:
        steps.append(f"""s{k} AS (SELECT lang, r, node, count(*) OVER (PARTITION BY lang) > 1 AS several, coalesce(string_agg(node, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
            coalesce(string_agg(node, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS behind FROM {nodes})""")
        steps.append(f"""n{k + 1} AS (SELECT lang, r // 8 AS r, CASE WHEN bool_or(several) THEN sha256(string_agg(node, '' ORDER BY r)) ELSE min(node) END AS node FROM s{k} GROUP BY lang, r // 8)""")

    for k in range(levels):
        level(k, f"n{k}")
        steps.append(f"""f{k + 1} AS (SELECT doc_id, f.lang, leaf, f.r // 8 AS r, CASE WHEN several THEN sha256(before || f || behind) ELSE f END AS f, proof || before || behind AS proof
            FROM f{k} f JOIN s{k} s ON f.lang IS NOT DISTINCT FROM s.lang AND f.r = s.r)""")
    steps.append(f"t0 AS (SELECT NULL AS lang, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS r, node, lang AS own FROM n{levels})")
    steps.append(f"g0 AS (SELECT f.doc_id, f.leaf, t.node AS subroot, t.r, f.f, f.proof FROM f{levels} f JOIN t0 t ON f.lang IS NOT DISTINCT FROM t.own)")
    for k in range(groups):
        top = levels + 1 + k
        level(top, "t0" if k == 0 else f"n{top}")
        steps.append(f"""g{k + 1} AS (SELECT doc_id, leaf, subroot, g.r // 8 AS r, CASE WHEN several THEN sha256(before || f || behind) ELSE f END AS f, proof || before || behind AS proof FROM g{k} g JOIN s{top} s ON g.r = s.r)""")
    return "WITH " + ", ".join(steps) + f""" SELECT doc_id, leaf, subroot, node AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = node AS verified FROM g{groups}, n{levels + groups + 1}"""


ORACLE: dict[str, str] = {
    "op4_license_scan": f"""
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'),
                '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
        phrases(label, ps) AS (VALUES {_PHRASES}), templates(t, label, ts, told) AS (VALUES {_TEMPLATES}),
        found AS (SELECT r, label, i FROM docs, phrases, unnest(range(len(ws) - len(ps) + 1)) u(i) WHERE ws[i + 1] = ps[1] AND ws[i + 1:i + len(ps)] = ps),
        base AS (SELECT r, count(*) AS n, min(i) AS low, max(i) AS high, list_sort(list(DISTINCT label)) AS labels FROM found GROUP BY r),
        blocks AS (SELECT r, b, list_distinct(ws[b * {license_scan.STRIDE} + 1:b * {license_scan.STRIDE} + {license_scan.BLOCK_WORDS}]) AS held
            FROM docs, unnest(range((len(ws) + {license_scan.STRIDE - 1}) // {license_scan.STRIDE})) u(b)),
        shares AS (SELECT r, label, len(list_intersect(held, ts)) / len(ts) AS share FROM blocks, templates WHERE list_has_all(held, told)),
        own AS (SELECT r, max(share) AS share, list(DISTINCT label) AS labels, count(*) AS n_blocks FROM shares WHERE share >= {license_scan.THRESHOLD} GROUP BY r)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, low AS first_word, high AS last_word,
            coalesce(array_to_string(base.labels, ','), '') AS base_labels,
            coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ','), '') AS labels,
            CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(own.share, 0.0)::DOUBLE END AS score, coalesce(n_blocks, 0) AS n_blocks
        FROM docs LEFT JOIN base USING (r) LEFT JOIN own USING (r)""",
    "op9_topk_search": """
        WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        pairs AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
        ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op11_filter_audit": f"""
        WITH RECURSIVE orders(o) AS (SELECT '' UNION ALL SELECT o || x FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) l(x) WHERE NOT contains(o, x)),
        steps AS (SELECT o, step, substr(o, step, 1) AS x, substr(o, 1, step - 1) AS earlier FROM orders, range(1, 6) r(step) WHERE length(o) = 5),
        told AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) < doc_id AS copied,
            regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        fails AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, concat(CASE WHEN len(ws) < {filter_audit.MIN_WORDS} THEN 'A' END,
            CASE WHEN 100 * len(list_distinct(ws)) < {filter_audit.DISTINCT_PERCENT} * len(ws) THEN 'B' END,
            CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {filter_audit.UPPER_PERCENT} * length(t) THEN 'C' END,
            CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN copied THEN 'E' END) AS failed FROM docs LEFT JOIN told USING (doc_id)),
        counted AS (SELECT part, failed, good, toxic, count(*) AS n FROM fails GROUP BY ALL),
        stepped AS (SELECT part, o, step, x, n, failed, good, toxic, contains(failed, x) AS hit, length(translate(earlier, failed, '')) < length(earlier) AS gone FROM counted, steps),
        summed AS (SELECT part, o AS filter_order, step, x, sum(n) FILTER (NOT hit AND NOT gone) AS kept, sum(n) FILTER (hit AND NOT gone) AS removed, sum(n) FILTER (hit AND gone) AS redundant,
            sum(n) FILTER (failed = x) AS unique_fails, sum(n) FILTER (hit AND NOT gone AND good) AS good_lost, sum(n) FILTER (hit AND NOT gone AND toxic) AS toxic_lost FROM stepped GROUP BY ALL)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
            CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM summed""",
    "op12_merkle_manifest": _manifest_sql(),
    "op13_url_filters": f"""
        WITH rules(verdict, h, p) AS (VALUES {_RULES}), words(i, w) AS (VALUES {_HOST_WORDS}),
        urls AS (SELECT row_number() OVER () AS id, page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*') ELSE '' END AS h,
            CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (SELECT id, page_id, translate(h, '{_UPPER}', '{_UPPER.lower()}') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM urls),
        fit AS (SELECT id, arg_max(struct_pack(verdict, rule := h || p), length(h || p)) AS best FROM parts, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY id),
        own AS (SELECT id, arg_min(w, i) AS w FROM parts, words WHERE contains(host, w) GROUP BY id)
        SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, CASE WHEN w IS NULL THEN 'allow' ELSE 'block' END) AS verdict, w AS host_word
        FROM parts LEFT JOIN fit USING (id) LEFT JOIN own USING (id)""",
}
