"""The numbered queries, each over its whole table, and the oracles of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, chat, decontaminate, language_id, minhash, mixing, ngram_join, pii, quality, sharding, spelling, token_count, warc
from .common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).drop("text")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_personal_data": op2_personal_data,
    "op3_source_mixing": op3_source_mixing,
    "op4_ngram_join": op4_ngram_join,
    "op5_decontamination": op5_decontamination,
    "op6_warc": op6_warc,
    "op7_quality_rules": op7_quality_rules,
    "op8_token_counts": op8_token_counts,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_sharding": op10_sharding,
    "op11_minhash_dedup": op11_minhash_dedup,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_token_alignment": op13_token_alignment,
}

OP3_SQL = r"""
WITH d AS (
    SELECT doc_id, source, coalesce(md5(doc_id::VARCHAR), '') AS o, coalesce('s' || source, 't') AS sk,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
    FROM documents
), s AS (
    SELECT sk, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY sk) - 1) % 3 + 1 AS weight FROM d GROUP BY sk
), c AS (
    SELECT *, (3 * source_size)::DOUBLE AS cap, (3 * source_size)::DOUBLE / weight AS ratio,
           row_number() OVER (ORDER BY (3 * source_size)::DOUBLE / weight, sk) AS rk FROM s
), l AS (
    SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c
), g AS (
    SELECT *, least(cap, coalesce((SELECT arg_min(level, rk) FROM l WHERE level <= ratio), 0) * weight) AS target FROM l
), w AS (
    SELECT d.doc_id, d.size, g.source_size, g.target, g.weight, floor(g.target)::BIGINT AS demand,
           coalesce(sum(d.size) OVER (PARTITION BY d.sk ORDER BY d.o, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offered
    FROM d JOIN g ON d.sk = g.sk
), t AS (
    SELECT *, (greatest(0, least(size, demand - offered)) + greatest(0, least(size, demand - source_size - offered))
               + greatest(0, least(size, demand - 2 * source_size - offered)))::BIGINT AS taken, offered::DOUBLE / target AS u
    FROM w
)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN CASE
           WHEN weight = 1 AND u < 0.625 THEN 0.0 + 2.0 * u / (1.5 + sqrt(greatest(0.0, 1.5 * 1.5 + 2.0 * -1.0 * u)))
           WHEN weight = 1 THEN 0.5 + 2.0 * (u - 0.625) / (1.0 + sqrt(greatest(0.0, 1.0 + 2.0 * -1.0 * (u - 0.625))))
           WHEN weight = 2 AND u < 0.5 THEN 0.0 + 2.0 * u / (1.0 + sqrt(greatest(0.0, 1.0)))
           WHEN weight = 2 THEN 0.5 + 2.0 * (u - 0.5) / (1.0 + sqrt(greatest(0.0, 1.0)))
           WHEN u < 0.375 THEN 0.0 + 2.0 * u / (0.5 + sqrt(greatest(0.0, 0.25 + 2.0 * 1.0 * u)))
           ELSE 0.5 + 2.0 * (u - 0.375) / (1.0 + sqrt(greatest(0.0, 1.0 + 2.0 * 1.0 * (u - 0.375)))) END END AS position
FROM t
"""

OP6_SQL = """
WITH p AS (
    SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS digest FROM pages
), k AS (
    SELECT digest, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY digest HAVING count(*) > 1
)
SELECT page_id, n AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN keeper IS NULL OR page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM p LEFT JOIN k ON p.digest = k.digest
"""

SHINGLES_SQL = r"""
    SELECT {id}, unnest(list_distinct(CASE
        WHEN len(w) = 0 THEN []
        WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END)) AS g
    FROM (SELECT {id}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {table})
"""

OP5_SQL = f"""
WITH d AS ({SHINGLES_SQL.format(id="doc_id", table="documents")}),
b AS ({SHINGLES_SQL.format(id="item_id", table="benchmark")}),
n AS (SELECT item_id, count(*) AS size FROM b GROUP BY item_id),
m AS (
    SELECT doc_id, item_id, count(*) AS shared FROM d JOIN b USING (g) GROUP BY doc_id, item_id
), v AS (
    SELECT doc_id, item_id, shared / size AS c FROM m JOIN n USING (item_id) WHERE 5 * shared >= 4 * size
), a AS (
    SELECT doc_id, count(*) AS n_items, list(item_id ORDER BY item_id) AS item_ids, max(c) AS containment FROM v GROUP BY doc_id
)
SELECT doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(item_ids, []::BIGINT[]) AS item_ids, containment
FROM documents LEFT JOIN a USING (doc_id)
"""

OP9_SQL = r"""
WITH t AS (
    SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), p AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos FROM t
), h AS (
    SELECT *, string_agg(md5(role || chr(1) || text), '') OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS h,
           max(pos) OVER (PARTITION BY conv_id) AS last FROM p
), i AS (
    SELECT DISTINCT pos, md5(h) AS h FROM h WHERE pos < last
), w AS (
    SELECT pos, md5(h) AS h, min(conv_id) AS conv_id FROM h WHERE pos = last GROUP BY ALL
), k AS (
    SELECT conv_id, pos + 1 AS n_turns FROM w WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.pos = w.pos AND i.h = w.h)
)
SELECT conv_id, n_turns::BIGINT AS n_turns, pos::BIGINT AS pos,
       '<|im_start|>' || replace(replace(regexp_replace(role, '[\r\n]+', ' ', 'g'), '<|im_start|>', '<| im_start |>'), '<|im_end|>', '<| im_end |>') || chr(10)
       || replace(replace(text, '<|im_start|>', '<| im_start |>'), '<|im_end|>', '<| im_end |>') || '<|im_end|>' || chr(10) AS chat
FROM p JOIN k USING (conv_id)
"""

COMPONENTS_SQL = """
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
p AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM d a JOIN d b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
    SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)
), r AS (
    SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y
)
SELECT documents.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, documents.doc_id) AS component_id
FROM documents LEFT JOIN n ON n.doc_id = documents.doc_id
LEFT JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = documents.doc_id
"""

OP4_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, hash(g) AS g FROM ({SHINGLES_SQL.format(id="doc_id", table="documents")})),
{COMPONENTS_SQL}"""

OP11_SQL = f"""
SELECT *, doc_id = component_id AS kept FROM (
WITH RECURSIVE d AS (SELECT doc_id, hash(g) AS g FROM ({SHINGLES_SQL.replace("w) < 5", "w) < 4").replace("w) - 3", "w) - 2").replace("i+4", "i+3").format(id="doc_id", table="documents")})),
{COMPONENTS_SQL})
"""

OP12_SQL = r"""
WITH RECURSIVE c AS (
    SELECT list(v ORDER BY i) AS t FROM (
        SELECT i, list_reduce(list_prepend(i, range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM range(256) r(i))
), o AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents
), d AS (
    SELECT run, count(*) AS k, hex(doc_id || ':' || run) AS x FROM o WHERE length(run) >= 5 GROUP BY doc_id, run
), h AS (
    SELECT run, k, xor(list_reduce(
        list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
        lambda a, b: xor(a >> 8, t[xor(a, b) % 256 + 1])), 4294967295) AS h
    FROM d, c
), w AS (
    SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(k)::BIGINT AS n
    FROM h GROUP BY 1 HAVING length(word) >= 5 AND sum(k) >= 3
), v AS (
    SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS v FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)
), p AS (
    SELECT a.word, a.n, b.word AS other, b.n AS m FROM v a JOIN v b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
    UNION SELECT v.word, v.n, w.word, w.n FROM v JOIN w ON w.word = v.v
    UNION SELECT w.word, w.n, v.word, v.n FROM v JOIN w ON w.word = v.v
), f AS (
    SELECT word, any_value(n) AS n, count(*) AS n_near, min((-m, other)) AS best FROM p GROUP BY word
), g AS (
    SELECT word, n_near, CASE WHEN -best[1] >= 2 * n THEN best[2] END AS form, CASE WHEN -best[1] >= 2 * n THEN -best[1] END AS form_n FROM f
), s AS (
    SELECT word, form AS root, 1 AS depth FROM g WHERE form IS NOT NULL
    UNION ALL SELECT s.word, g.form, depth + 1 FROM s JOIN g ON g.word = s.root WHERE g.form IS NOT NULL
)
SELECT w.word, form, coalesce(e.root, w.word) AS root, w.n, coalesce(n_near, 0)::BIGINT AS n_near, form_n::BIGINT AS form_n
FROM w LEFT JOIN g ON g.word = w.word LEFT JOIN (SELECT word, arg_max(root, depth) AS root FROM s GROUP BY word) e ON e.word = w.word
"""

ORACLES = {
    "op4_ngram_join": OP4_SQL,
    "op9_chat_formatting": OP9_SQL,
    "op5_decontamination": OP5_SQL,
    "op6_warc": OP6_SQL,
    "op3_source_mixing": OP3_SQL,
    "op11_minhash_dedup": OP11_SQL,
    "op12_spelling_variants": OP12_SQL,
}
