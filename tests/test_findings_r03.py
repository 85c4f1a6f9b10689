"""What the findings of round 3 were about, each on a small table."""

import random

import numpy as np
import pyarrow.parquet as pq

from tracemill.llm import alignment
from tracemill.operators import graph


def plain_roots(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {x: find(x) for x in list(parent)}


def test_components_contract_only_new_edges(spark, monkeypatch):
    rows = []
    write = graph.materialized
    monkeypatch.setattr(graph, "materialized", lambda df: rows.append(1) or write(df))
    stars = [(i % 5, 5 + i) for i in range(40)]
    roots = graph.merged(None, spark.createDataFrame(stars, "u bigint, v bigint"))
    assert len(rows) == 2  # stars are components as they are: the edges are written and the roots, no round
    r, every = random.Random(3), list(stars)
    for n in (0, 3, 12):
        new = [(r.randrange(60), r.randrange(60)) for _ in range(n)]
        every += new
        roots = graph.merged(roots, spark.createDataFrame(new, "u bigint, v bigint"))
        got = [tuple(x) for x in roots.select("node", "root").collect()]
        assert len(got) == len(dict(got)) and dict(got) == plain_roots(every)
    chain = [(i, i + 1) for i in range(30)]
    assert dict(map(tuple, graph.components(spark.createDataFrame(chain, "u bigint, v bigint")).collect())) == plain_roots(chain)


def test_index_shuffles_texts_and_no_postings(spark, tmp_path):
    from tracemill.operators import search_index as index

    docs = spark.createDataFrame([(1, "plans and tables, plans again"), (2, "a planning error"), (3, None), (4, "")], "id int, text string")
    folder = str(tmp_path / "index")
    index.build(docs, "id", "text", folder)
    kept = {(r["kind"], r["key"], r["term"]): r["w"] for r in spark.read.parquet(f"{folder}/postings").collect()}
    assert kept[("words", 1, "plans")] == 2 and kept[("stems", 1, "plan")] == 2 and kept[("stems", 1, "concept:cost_usage")] == 2 * index.CONCEPT_WEIGHT
    assert ("stems", 2, "planning") not in kept and ("stems", 2, "a") not in kept and not [k for k in kept if k[1] in (3, 4)]
    assert [r["key"] for r in index.search(spark, folder, "plans").collect()] == [1, 2]


def test_ranking_has_the_rules_of_its_sql_only(spark, tmp_path):
    import duckdb
    from tracemill.plans import catalogue, rules
    from tracemill.plans.registry import Tables
    from tracemill.sources import star

    c = duckdb.connect()
    for t in ("orders", "events", "lineitem"):
        c.execute(f"COPY (SELECT * FROM '/root/testdata/sf0.001/{t}.parquet') TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    c.execute(f"""COPY (SELECT l_orderkey AS conv_id, 0::BIGINT AS turn, 'assistant' AS role, repeat('long answer ', 20000) AS text FROM '{tmp_path}/lineitem.parquet' WHERE l_quantity < 49 GROUP BY 1 ORDER BY 1 LIMIT 20)
      TO '{tmp_path}/conversations.parquet' (FORMAT parquet)""")
    assert "cost.output-verbosity" in [r["id"] for r in rules.evaluate(star.signals(Tables(spark, str(tmp_path))), [r for r in rules.RULES if r.id == "cost.output-verbosity"]).collect()]
    for t in ("orders", "events", "lineitem", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    want = [(i, s, a, n) for i, s, _, a, n in c.execute(catalogue.ORACLES["recs_ranked"]).fetchall()]
    got = [(r["id"], r["severity"], r["affected"], r["place"]) for r in catalogue.QUERIES["recs_ranked"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and want


def test_openings_meet_in_blocks_where_they_can_have_a_partner(spark):
    from pyspark.sql import functions as F
    from tracemill.operators import retypes

    r, week = random.Random(5), retypes.WINDOW_US
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(400)]
    lone = [(i, "p", i * week // 40, " ".join(r.choices(words, k=30))) for i in range(400)]  # any two words meet again in other weeks
    alike = [(1000, "p", 3 * week - 1, lone[7][3]), (1001, "p", 3 * week, lone[7][3] + " again today"), (1002, "p", 9 * week, lone[7][3] + " again")]
    rows = retypes.openers(spark.createDataFrame(lone + alike, "session_id long, project string, us long, opener string"))
    alive = {x["rep"] for x in retypes._meeting(rows, week, retypes.FLOOR).collect()}
    assert {7, 1001} <= alive and len(alive) < 40
    got = {x["session_id"]: (x["cluster"], x["size"], x["links"]) for x in retypes.retype_clusters(spark.createDataFrame(lone + alike, "session_id long, project string, us long, opener string")).collect()}
    assert got == {1000: (1000, 2, 1), 1001: (1000, 2, 1)}


def test_similar_texts_drop_what_can_have_no_partner_and_nothing_else(spark):
    from pyspark.sql import functions as F
    from tracemill.operators import text

    r, rows = random.Random(9), []
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    for n in [3, 5, 20, *range(text.WHOLE - 4, text.WHOLE + 6), *range(text.WHOLE * 5 // 4 - 2, text.WHOLE * 5 // 4 + 6), 700]:  # sizes around those at which the region begins
        base = [word() for _ in range(n)]
        rows += [base, base + [word()], base[: n // 2] + [word()] + base[n // 2 + 1 :], [word() for _ in range(n)]]
    rows.append(rows[9])
    df = spark.createDataFrame([(i, "s", " ".join(w)) for i, w in enumerate(rows)], "id long, source string, body string")
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in rows]
    want = {(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and not (b == len(rows) - 1 and a != 9)}
    got = text.similar_texts(df, "id", ["source"], "body").collect()
    assert {(x["id"], x["other"]) for x in got} == want and len(got) == len(want) > 40
    own = df.select(F.col("id").alias("_key"), F.array_sort(text.shingle_set("body", 5)).alias("_s")).withColumn("_class", F.col("_key").cast("string"))
    left = {x["_key"] for x in text._meeting(own, 0.8).collect()}
    assert {i for p in want for i in p} <= left and not {i for i in range(3, len(rows) - 1, 4)} & left


def test_pieces_are_cut_up_in_numpy():
    r, pieces = random.Random(13), []
    for _ in range(200):
        n = r.choice([0, 1, 1, 2, 3, 7, 40])
        ends = [[*sorted(r.sample(range(1, n), r.randrange(n))), n] if n else [] for _ in "ab"]
        pieces.append([([r.choice([0, 7, 10, 99_999]) for _ in e], e) for e in ends])
    ids, counts, sizes = ([np.array(x, np.int32) for x in y] for y in zip(*[
        ([i for p in pieces for i in p[s][0]], [len(p[s][0]) for p in pieces], [e - b for p in pieces for b, e in zip([0, *p[s][1]], p[s][1])]) for s in (0, 1)
    ]))
    groups, text, links = alignment.aligned(ids, counts, sizes)
    want = []
    for a, b in pieces:
        cuts = sorted(set(a[1]) & set(b[1]))
        parts = [[[i for i, e in zip(*side) if lo < e <= hi] for side in (a, b)] for lo, hi in zip([0, *cuts], cuts)]
        want.append((len(cuts), ";".join("|".join(",".join(map(str, side)) for side in p) for p in parts), [x * alignment.PACK + y for p in parts for x in p[0] for y in p[1]]))
    assert list(zip(groups.tolist(), text.to_pylist(), links.to_pylist())) == want


def test_a_worker_aligns_a_piece_once(monkeypatch):
    both, times, cut_up = alignment.Tokenizers(*alignment.vocabulary_paths()), [], alignment.aligned
    monkeypatch.setattr(alignment, "aligned", lambda ids, counts, sizes: times.append(len(counts[0])) or cut_up(ids, counts, sizes))
    assert both.block([])[2][0].to_pylist() == [] and not times
    _, counts, (text, links) = both.block(["the fox of the lake", "▁ has no tokens", None])
    assert times == [8]  # the, fox, of, lake, has, no, tokens and the piece that its tokens do not give
    assert counts[2][0] >= 5 and [c.tolist()[1:] for c in counts] == [[0, 0]] * 3 and len(text) == len(links) == 4
    again = both.block(["lake of the fox"])
    assert times == [8] and again[2][0].to_pylist() == text.to_pylist()
    monkeypatch.setattr(alignment, "REMEMBERED", 0)
    both.block(["lake of the fox"])
    assert times == [8, 4]


def test_few_blocks_are_read_at_once(spark, monkeypatch):
    tables, write = [], alignment.written
    monkeypatch.setattr(alignment, "written", lambda *args: tables.append(write(*args)) or tables[-1])
    text = "lake " * 210_000  # a block by itself
    rows = spark.createDataFrame([(i, text + str(i)) for i in range(20)], "doc_id long, text string").coalesce(1)
    assert alignment.align(rows).count() == 20
    metadata = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in tables[0].inputFiles()]
    sizes = [m.row_group(i).num_rows for m in metadata for i in range(m.num_row_groups)]
    assert sum(sizes) == 20 and max(sizes) == 8
