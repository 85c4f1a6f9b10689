"""Queries over documents and conversations: search, duplicates, features, secrets, flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as C
from ..operators import retypes as R
from ..operators import search_index as I
from ..operators import text as X
from ..operators.sequences import following
from ..session import scratch_folder
from .registry import Tables, query

STOPS = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
TERMS = f"""w AS (SELECT doc_id, regexp_replace(w, '^(.{{3,}}?)(?:ing|ed|es|s)$', '\\1') AS term FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS w FROM documents)
  WHERE w <> '' AND w NOT IN ({STOPS})), t AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL)"""
QUERY = ("ering", "thhea", "ouor")


@query(f"""WITH {TERMS}, h AS (SELECT doc_id, count(*) AS hits, sum(tf) AS dot FROM t WHERE term IN {QUERY} GROUP BY 1), n AS (SELECT doc_id, sqrt(sum(tf * tf)) AS norm FROM t GROUP BY 1)
  SELECT doc_id, round(0.68 * hits / 3 + 0.32 * dot / (norm * sqrt(3.0)), 6) AS score FROM h JOIN n USING (doc_id) WHERE 0.68 * hits / 3 + 0.32 * dot / (norm * sqrt(3.0)) >= 0.12 ORDER BY 0.68 * hits / 3 + 0.32 * dot / (norm * sqrt(3.0)) DESC, doc_id LIMIT 20""")
def hybrid_search(t: Tables) -> DataFrame:
    """A top-k report: the twenty best documents for a query, by matched terms and cosine."""
    return X.search(t.documents, "doc_id", "text", list(QUERY), 20).select("doc_id", F.round("score", 6).alias("score"))


INDEXED = "Thandthe reering ouorthe plans"
_Q = I.query_terms(INDEXED)
_W = ", ".join(f"('{t}', {float(_Q.count(t))})" for t in dict.fromkeys(_Q)) + "".join(f", ('concept:{I.CONCEPT_OF[t]}', {I.CONCEPT_WEIGHT})" for t in _Q if t in I.CONCEPT_OF)


@query(f"""WITH c(term, concept) AS (VALUES {", ".join(f"('{t}', 'concept:{n}')" for t, n in I.CONCEPT_OF.items())}), q(term, qw) AS (VALUES {_W}),
  w AS (SELECT doc_id, regexp_replace(w, '{I.ENDING}', '') AS term FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS w FROM documents)),
  t AS (SELECT doc_id, term, count(*)::DOUBLE AS w FROM w WHERE length(term) > 1 AND term NOT IN ({", ".join(f"'{x}'" for x in I.STOP_WORDS)}) GROUP BY ALL),
  v AS (SELECT * FROM t UNION ALL SELECT doc_id, concept, sum(w) * {I.CONCEPT_WEIGHT} FROM t JOIN c USING (term) GROUP BY ALL),
  n AS (SELECT doc_id, sum(w * w) AS norm2, sum(w * coalesce(qw, 0)) AS dot FROM v LEFT JOIN q USING (term) GROUP BY 1),
  s AS (SELECT d.doc_id, least(1, CASE WHEN contains(lower(text), '{INDEXED.lower()}') THEN 0.75 ELSE 0 END + ({" + ".join(f"contains(lower(text), '{t}')::INT" for t in _Q)}) / {len(_Q)}.0)::DOUBLE AS lexical, coalesce(dot / sqrt(norm2 * (SELECT sum(qw * qw) FROM q)), 0) AS semantic
    FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id WHERE text IS NOT NULL)
  SELECT doc_id, round(0.68 * lexical + 0.32 * semantic, 9) AS score, CASE WHEN semantic < 0.12 THEN 'full-text' WHEN lexical > 0 THEN 'hybrid' ELSE 'semantic' END AS match
  FROM s WHERE lexical > 0 OR semantic >= 0.12 ORDER BY 0.68 * lexical + 0.32 * semantic DESC, doc_id LIMIT 100""")
def indexed_search(t: Tables) -> DataFrame:
    """A top-k report: the hundred best documents for a query, by a stored index of all documents."""
    folder = scratch_folder(t.spark, "index")
    I.build(t.documents, "doc_id", "text", folder)
    return I.search(t.spark, folder, INDEXED).select(F.col("key").alias("doc_id"), F.round("score", 9).alias("score"), "match")


@query(f"""WITH {TERMS} SELECT term, count(*) AS documents, sum(tf)::BIGINT AS uses FROM t GROUP BY 1""")
def term_frequencies(t: Tables) -> DataFrame:
    return X.terms(t.documents, "doc_id", "text").groupBy("term").agg(F.count(F.lit(1)).alias("documents"), F.sum("tf").alias("uses"))


@query("""WITH w AS (SELECT doc_id, source, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
  s AS (SELECT doc_id, source, list_sort(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END)) AS s FROM w WHERE len(w) > 0),
  c AS (SELECT source, s, min(doc_id) AS rep FROM s GROUP BY ALL), g AS (SELECT rep, source, len(s) AS n, unnest(s) AS g FROM c),
  p AS (SELECT a.rep AS x, b.rep AS y, a.n + b.n AS total, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.source IS NOT DISTINCT FROM b.source AND a.rep < b.rep GROUP BY ALL)
  SELECT x AS doc_id, y AS other, round(c / (total - c), 6)::DOUBLE AS similarity FROM p WHERE c / (total - c) >= 0.8
  UNION ALL SELECT c.rep, s.doc_id, 1.0::DOUBLE FROM s JOIN c ON s.s = c.s AND s.source IS NOT DISTINCT FROM c.source WHERE s.doc_id <> c.rep""")
def near_dup_openers(t: Tables) -> DataFrame:
    """Texts of one source that were typed again: five-word shingles of whole texts, similarity 0.8. Equal sets as a class and its members, others as pairs of class representatives."""
    return X.similar_texts(t.documents, "doc_id", ["source"], "text").select("doc_id", "other", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH RECURSIVE w AS (SELECT doc_id, lang, doc_id * 10 AS minute, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(lower(text), '`+', ' ', 'g'), '\\S*/\\S*', ' ', 'g'), '\\d+', ' ', 'g'), '[^a-z]+'), lambda x: length(x) >= 2 AND x NOT IN ({", ".join(f"'{x}'" for x in R.STOP_WORDS)})) AS w
    FROM documents WHERE lang IS NOT NULL AND length(trim(text)) >= {R.MIN_CHARS} AND NOT regexp_matches(text, '^\\s*/')),
  g AS (SELECT doc_id, lang, minute, unnest(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM w WHERE len(w) >= {R.MIN_TOKENS}),
  n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1), c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.lang = b.lang AND a.doc_id <> b.doc_id AND abs(a.minute - b.minute) <= 10080 GROUP BY ALL),
  l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE c >= 0.5 * (p.n + q.n - c)), r AS (SELECT x, x AS y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
  k AS (SELECT x, min(y) AS cluster FROM r GROUP BY 1) SELECT k.x AS session_id, cluster, count(*) OVER (PARTITION BY cluster) AS size, links FROM k JOIN (SELECT x, count(*) AS links FROM l GROUP BY 1) d ON d.x = k.x""")
def retype_clusters(t: Tables) -> DataFrame:
    """Documents as openers, one in ten minutes: clusters of near-duplicate texts of a language within a week, with their links."""
    return R.retype_clusters(t.documents.select(F.col("doc_id").alias("session_id"), F.col("lang").alias("project"), (F.col("doc_id") * 600_000_000).alias("us"), F.col("text").alias("opener")))


@query("SELECT sha256(text) AS block, count(*) AS times, min(doc_id) AS first_id, (count(*) - 1) * any_value(length(text)) AS wasted FROM documents GROUP BY 1 HAVING count(*) >= 2")
def paste_duplicates(t: Tables) -> DataFrame:
    """Blocks pasted more than once, by hash, and the characters that costs."""
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("block"), F.length("text").alias("n"))
    return d.groupBy("block").agg(F.count(F.lit(1)).alias("times"), F.min("doc_id").alias("first_id"), ((F.count(F.lit(1)) - 1) * F.max("n")).alias("wasted")).filter("times >= 2")


def _secret_sql() -> str:
    text, columns = "coalesce(text, '')", []
    for kind, p in X.SECRETS.items():
        columns.append(f"len(regexp_extract_all({text}, '{p}')) AS {kind.replace('-', '_')}")
        text = f"regexp_replace({text}, '{p}', '[REDACTED:{kind}]', 'g')"
    return f"SELECT doc_id, {', '.join(columns)}, sha256({text}) AS clean FROM documents"


@query(_secret_sql())
def secret_scan(t: Tables) -> DataFrame:
    """How many secrets of each kind a document holds, and the hash of the scrubbed text."""
    text = F.coalesce("text", F.lit(""))
    some = X.may_hold_secret(text)
    counts = [F.when(some, c).otherwise(F.lit(0)).cast("bigint").alias(kind.replace("-", "_")) for kind, c in zip(X.SECRETS, X.secret_counts(text))]
    return t.documents.select("doc_id", *counts, F.sha2(F.when(some, X.scrub(text)).otherwise(text), 256).alias("clean"))


@query("""SELECT doc_id, length(text) AS chars, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words, len(regexp_extract_all(text, '\\n')) AS breaks, len(regexp_extract_all(text, '\\b(?:the|and)\\b')) AS joins, text LIKE '%@%' AS contact FROM documents""")
def prompt_traits(t: Tables) -> DataFrame:
    """Counts that describe a prompt."""
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("bigint")
    return t.documents.select("doc_id", F.length("text").cast("bigint").alias("chars"), n(r"[^\x20\x09-\x0D]+").alias("words"), n(r"\n").alias("breaks"),
                              n(r"\b(?:the|and)\b").alias("joins"), F.col("text").contains("@").alias("contact"))


@query("""SELECT role, count(*) AS turns, round(avg(length(text)), 4) AS mean_chars, count(*) FILTER (regexp_matches(lower(text), '\\b(?:the|and|of)\\b')) AS english, round(count(*) FILTER (length(text) > 1000) / count(*), 6) AS long_share FROM conversations GROUP BY 1""")
def assistant_features(t: Tables) -> DataFrame:
    """Features of turns by role."""
    c = t.conversations
    return c.groupBy("role").agg(
        F.count(F.lit(1)).alias("turns"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"), F.count_if(F.lower("text").rlike(r"\b(?:the|and|of)\b")).alias("english"),
        F.round(F.count_if(F.length("text") > 1000) / F.count(F.lit(1)), 6).alias("long_share"),
    )


@query("""WITH n AS (SELECT conv_id, turn, role, min(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS answer FROM conversations)
  SELECT answer - turn AS wait, count(*) AS n FROM n WHERE role = 'user' AND answer IS NOT NULL GROUP BY 1""")
def response_latency(t: Tables) -> DataFrame:
    """How many turns on the next answer to each user turn is; one answer may serve several."""
    w = following(["conv_id"], ["turn"])
    n = t.conversations.withColumn("answer", F.min(F.when(F.col("role") == "assistant", F.col("turn"))).over(w))
    return n.filter("role = 'user' AND answer IS NOT NULL").groupBy((F.col("answer") - F.col("turn")).alias("wait")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS prompts, sum(length(text))::BIGINT AS chars, arg_max(role, turn) AS last_role FROM conversations GROUP BY 1""")
def conv_stats(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "user").alias("prompts"), F.sum(F.length("text")).alias("chars"), F.max_by("role", "turn").alias("last_role")
    )


@query("""SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS so_far, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS prompt_no FROM conversations""")
def forensic_turns(t: Tables) -> DataFrame:
    """Running characters and prompt number of every turn."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return t.conversations.select("conv_id", "turn", F.sum(F.length("text")).over(w).alias("so_far"), F.count_if(F.col("role") == "user").over(w).alias("prompt_no"))


@query("""WITH s AS (SELECT conv_id, turn, coalesce(sum((role = 'system')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS task, role, length(text) AS n FROM conversations)
  SELECT conv_id, task::BIGINT AS task, count(*) FILTER (role = 'user') AS steering, sum(n)::BIGINT AS chars FROM s GROUP BY ALL""")
def task_steering_spans(t: Tables) -> DataFrame:
    """User turns within each task of a conversation."""
    from ..operators.sequences import span_index

    s = span_index(t.conversations, ["conv_id"], ["turn"], F.col("role") == "system", False, "task")
    return s.groupBy("conv_id", "task").agg(F.count_if(F.col("role") == "user").alias("steering"), F.sum(F.length("text")).alias("chars"))


@query(f"""WITH v AS (SELECT source, doc_id, unnest(list_distinct(list_transform(list_filter(regexp_extract_all(text, '{X.DISTINCTIVE}'), lambda v: length(v) <= {X.LONGEST_VALUE} AND regexp_matches(v, '[A-Za-z]') AND (v LIKE '%/%'
    OR (regexp_matches(v, '^[A-Fa-f0-9]{{12,}}$') AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Fa-f]')) OR (regexp_matches(v, '[0-9]') AND (regexp_matches(v, '[._:/@-]') OR length(v) >= 16))
    OR (regexp_matches(v, '[._:/@-]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')))), lambda v: lower(v)))) AS value FROM documents),
  p AS (SELECT source, value, min(doc_id) AS produced FROM v WHERE doc_id % 2 = 0 GROUP BY ALL)
  SELECT v.source, produced, doc_id AS used, count(*) AS tokens FROM v JOIN p ON v.source IS NOT DISTINCT FROM p.source AND v.value = p.value WHERE doc_id % 2 = 1 AND produced < doc_id GROUP BY ALL""")
def value_flow_edges(t: Tables) -> DataFrame:
    """Where a value came from: documents stand for a source's calls (odd ids) and results (even ids); an edge is from the first result with a distinctive value to a later call with it.

    The first producer is a running minimum over a value's rows, not a self-join.
    """
    v = t.documents.select("source", "doc_id", F.explode(X.distinctive_values("text")).alias("value"))
    w = Window.partitionBy("source", "value").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    v = v.withColumn("produced", F.min(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id"))).over(w)).filter("doc_id % 2 = 1 AND produced IS NOT NULL")
    return v.groupBy("source", "produced", F.col("doc_id").alias("used")).agg(F.count(F.lit(1)).alias("tokens"))


@query("""SELECT count(*) FILTER (regexp_matches(lower(text), '\\b(?:that|with|from)\\b')) AS waits, count(*) FILTER (regexp_matches(text, '^[A-ZÀ-Ý][a-zà-ÿ]+\\.')) AS openers, count(*) FILTER (text = '') AS blank FROM conversations WHERE role = 'assistant'""")
def wait_flags(t: Tables) -> DataFrame:
    """Language flags of assistant turns."""
    c = t.conversations.filter("role = 'assistant'")
    return c.agg(F.count_if(F.lower("text").rlike(r"\b(?:that|with|from)\b")).alias("waits"), F.count_if(F.col("text").rlike("^[A-ZÀ-Ý][a-zà-ÿ]+\\.")).alias("openers"), F.count_if(F.col("text") == "").alias("blank"))


@query(f"""WITH c AS (SELECT role, lower(text) AS t FROM conversations UNION ALL SELECT 'document', lower(text) FROM documents)
  SELECT role, {", ".join(f"count(*) FILTER (regexp_matches(t, '{p.replace(chr(39), chr(39) * 2)}')) AS {k}" for k, p in C.LANGUAGE.items())} FROM c GROUP BY 1""")
def language_flags(t: Tables) -> DataFrame:
    """Refusals, hedges, waits, claims and interruptions in what is said, by role, and in documents."""
    said = t.conversations.select("role", "text").unionByName(t.documents.select(F.lit("document").alias("role"), "text"))
    return said.select("role", *C.language_flags(F.col("text"))).groupBy("role").agg(*[F.count_if(k).alias(k) for k in C.LANGUAGE])
