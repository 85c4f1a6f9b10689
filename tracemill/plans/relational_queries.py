"""Queries over orders, line items and their dimensions: roll-ups, joins, set operations, top-k.

An order stands for a session, a line item for a billed message of it, a part's brand for a
model, a supplier for a server, and customer, nation, region for project, team, department.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import scope
from ..operators import rollups as R
from .registry import Tables, query

PLACES = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _places(t: Tables) -> DataFrame:
    """Orders with their customer, nation and region; Spark broadcasts what is small enough."""
    c = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    return (
        t.orders.join(c, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    )


@query(f"""SELECT r_name, n_name, grouping(r_name)::INT + grouping(n_name)::INT AS level, count(*) AS sessions, round(sum(o_totalprice), 2) AS spend
  FROM {PLACES} GROUP BY ROLLUP (r_name, n_name)""")
def repo_rollup(t: Tables) -> DataFrame:
    """Sessions and spend by department and team, with the totals of both levels."""
    return _places(t).rollup("r_name", "n_name").agg(
        (F.grouping("r_name").cast("int") + F.grouping("n_name").cast("int")).alias("level"), F.count(F.lit(1)).alias("sessions"), F.round(F.sum("o_totalprice"), 2).alias("spend")
    )


@query("""SELECT c_custkey AS project, count(o_orderkey) AS sessions, min(o_orderdate)::DATE AS first_day, max(o_orderdate)::DATE AS last_day, round(coalesce(sum(o_totalprice), 0), 2) AS spend
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def group_projects(t: Tables) -> DataFrame:
    """A row a project, also for those without a session."""
    rows = t.customer.select(F.col("c_custkey").alias("project")).join(t.orders, F.col("o_custkey") == F.col("project"), "left")
    return rows.groupBy("project").agg(
        F.count("o_orderkey").alias("sessions"), F.min("o_orderdate").cast("date").alias("first_day"), F.max("o_orderdate").cast("date").alias("last_day"),
        F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("spend"),
    )


@query("SELECT round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, round(sum(l_extendedprice * l_tax), 2) AS tax, count(*) AS n FROM lineitem")
def spend_totals(t: Tables) -> DataFrame:
    return t.lineitem.agg(
        F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("net"),
        F.round(F.sum(F.col("l_extendedprice") * F.col("l_tax")), 2).alias("tax"), F.count(F.lit(1)).alias("n"),
    )


@query("""WITH s AS (SELECT l_returnflag, sum(l_extendedprice) AS input, sum(l_extendedprice * l_discount) AS cached, sum(l_extendedprice * l_tax) AS output FROM lineitem GROUP BY 1)
  SELECT l_returnflag AS model, kind, round(amount, 2) AS amount FROM s UNPIVOT (amount FOR kind IN (input, cached, output))""")
def spend_by_type(t: Tables) -> DataFrame:
    """Spend by token type as rows."""
    s = t.lineitem.groupBy(F.col("l_returnflag").alias("model")).agg(
        F.sum("l_extendedprice").alias("input"), F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("cached"), F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("output")
    )
    return s.unpivot("model", ["input", "cached", "output"], "kind", "amount").withColumn("amount", F.round("amount", 2))


@query("SELECT o_orderdate::DATE AS day, round(sum(o_totalprice), 2) AS spend, count(*) AS sessions FROM orders GROUP BY 1")
def spend_by_day(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("spend"), F.count(F.lit(1)).alias("sessions"))


@query(f"SELECT n_name AS project, round(sum(o_totalprice), 2) AS spend, round(100 * sum(o_totalprice) / sum(sum(o_totalprice)) OVER (), 4) AS share FROM {PLACES} GROUP BY 1")
def spend_by_project(t: Tables) -> DataFrame:
    s = _places(t).groupBy(F.col("n_name").alias("project")).agg(F.sum("o_totalprice").alias("s"))
    return s.select("project", F.round("s", 2).alias("spend"), F.round(R.share("s"), 4).alias("share"))


@query(f"""WITH s AS (SELECT n_name AS project, sum(o_totalprice) AS spend FROM {PLACES} GROUP BY 1), r AS (SELECT *, least(row_number() OVER (ORDER BY spend DESC, project), 6) AS rank FROM s)
  SELECT rank, CASE WHEN rank <= 5 THEN any_value(project) ELSE 'Other' END AS project, round(sum(spend), 2) AS spend, count(*) AS members FROM r GROUP BY rank""")
def share_topn_other(t: Tables) -> DataFrame:
    """The five dearest projects, and the others as one."""
    s = _places(t).groupBy(F.col("n_name").alias("project")).agg(F.sum("o_totalprice").alias("spend"))
    return R.top_n_other(s, "project", "spend", 5).withColumn("spend", F.round("spend", 2)).withColumn("rank", F.col("rank").cast("bigint"))


@query("""SELECT p_brand AS model, round(sum(l_extendedprice * (1 - l_discount)), 2) AS spend, count(*) AS messages, count(DISTINCT l_orderkey) AS sessions
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def spend_by_model(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("p_brand").alias("model")).agg(
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("spend"), F.count(F.lit(1)).alias("messages"), F.count_distinct("l_orderkey").alias("sessions")
    )


@query("""WITH s AS (SELECT l_orderkey AS session, sum(l_extendedprice) AS cost, arg_max(l_partkey, (l_extendedprice, l_partkey)) AS dearest FROM lineitem GROUP BY 1)
  SELECT session, round(cost, 2) AS cost, dearest, o_orderpriority AS priority FROM s JOIN orders ON o_orderkey = session ORDER BY s.cost DESC, session LIMIT 20""")
def top_expensive(t: Tables) -> DataFrame:
    """A top-k report: the twenty dearest sessions and their dearest message."""
    s = t.lineitem.groupBy(F.col("l_orderkey").alias("session")).agg(F.sum("l_extendedprice").alias("cost"), F.max_by("l_partkey", F.struct("l_extendedprice", "l_partkey")).alias("dearest"))
    top = s.orderBy(F.desc("cost"), "session").limit(20)
    return top.join(t.orders.select(F.col("o_orderkey").alias("session"), F.col("o_orderpriority").alias("priority")), "session").select(
        "session", F.round("cost", 2).alias("cost"), "dearest", "priority"
    )


@query("""WITH a AS (SELECT l_orderkey, l_suppkey, sum(l_quantity) AS w FROM lineitem GROUP BY ALL),
  b AS (SELECT l_suppkey, o_totalprice * w / sum(w) OVER (PARTITION BY l_orderkey) AS cost FROM a JOIN orders ON o_orderkey = l_orderkey)
  SELECT l_suppkey AS tool, round(sum(cost), 2) AS cost, count(*) AS sessions FROM b GROUP BY 1""")
def cost_by_tool_alloc(t: Tables) -> DataFrame:
    """A session's cost shared out over its tools by use."""
    a = t.lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("w"))
    a = a.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice"), "l_orderkey")
    return R.allocate(a, ["l_orderkey"], "o_totalprice", "w", "cost").groupBy(F.col("l_suppkey").alias("tool")).agg(
        F.round(F.sum("cost"), 2).alias("cost"), F.count(F.lit(1)).alias("sessions")
    )


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, array_agg(DISTINCT l_suppkey) AS ids, sum(l_extendedprice) AS cost FROM lineitem GROUP BY ALL)
  SELECT id AS tool_id, round(sum(part), 5) AS cost, count(*) AS messages FROM (SELECT unnest(ids) AS id, cost / len(ids) AS part FROM m) GROUP BY 1""")
def cost_by_tool_id(t: Tables) -> DataFrame:
    """A message's cost in equal parts to the tool ids it names."""
    m = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.collect_set("l_suppkey").alias("ids"), F.sum("l_extendedprice").alias("cost"))
    rows = m.select(F.explode("ids").alias("tool_id"), (F.col("cost") / F.size("ids")).alias("part"))
    return rows.groupBy("tool_id").agg(F.round(F.sum("part"), 5).alias("cost"), F.count(F.lit(1)).alias("messages"))


@query("""WITH r AS (SELECT l_suppkey, l_partkey, count(*) AS reads FROM lineitem GROUP BY ALL HAVING count(*) >= 2)
  SELECT l_partkey AS path, count(*) AS sessions, sum(reads)::BIGINT AS reads, max(reads) AS most FROM r GROUP BY 1 HAVING count(*) >= 2""")
def file_reread(t: Tables) -> DataFrame:
    """Paths read again within a session, in at least two sessions: two aggregations with a filter each."""
    r = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("reads")).filter("reads >= 2")
    return r.groupBy(F.col("l_partkey").alias("path")).agg(F.count(F.lit(1)).alias("sessions"), F.sum("reads").alias("reads"), F.max("reads").alias("most")).filter("sessions >= 2")


@query("""WITH r AS (SELECT l_suppkey, l_partkey, count(*) AS reads FROM lineitem GROUP BY ALL), x AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY reads DESC, l_partkey) AS k FROM r)
  SELECT l_suppkey AS session, l_partkey AS path, reads FROM x WHERE k <= 3""")
def reread_by_path(t: Tables) -> DataFrame:
    """The three most read paths of each session."""
    r = t.lineitem.groupBy(F.col("l_suppkey").alias("session"), F.col("l_partkey").alias("path")).agg(F.count(F.lit(1)).alias("reads"))
    return R.top_per_group(r, ["session"], [F.desc("reads"), F.col("path")], 3).drop("rank")


@query("""WITH r AS (SELECT l_shipdate::DATE AS day, l_partkey, count(*) AS runs FROM lineitem GROUP BY ALL HAVING count(*) >= 2)
  SELECT l_partkey AS command, sum(runs)::BIGINT AS runs, count(*) AS days FROM r GROUP BY 1 ORDER BY runs DESC, command LIMIT 15""")
def repeated_commands(t: Tables) -> DataFrame:
    """A top-k report: commands run again on the same day."""
    r = t.lineitem.groupBy(F.to_date("l_shipdate").alias("day"), F.col("l_partkey").alias("command")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return r.groupBy("command").agg(F.sum("n").alias("runs"), F.count(F.lit(1)).alias("days")).orderBy(F.desc("runs"), "command").limit(15)


@query("""SELECT l_partkey AS file, count(*) AS edits, count(DISTINCT l_orderkey) AS sessions, round(sum(l_quantity), 2) AS lines FROM lineitem GROUP BY 1 ORDER BY edits DESC, file LIMIT 15""")
def top_churn(t: Tables) -> DataFrame:
    """A top-k report: the files edited most."""
    return t.lineitem.groupBy(F.col("l_partkey").alias("file")).agg(
        F.count(F.lit(1)).alias("edits"), F.count_distinct("l_orderkey").alias("sessions"), F.round(F.sum("l_quantity"), 2).alias("lines")
    ).orderBy(F.desc("edits"), "file").limit(15)


@query("""SELECT p_type AS model, count(*) AS calls, round(sum(l_extendedprice) / sum(l_quantity), 4) AS ms_per_token, round(sum(l_tax) / nullif(sum(l_discount), 0), 6) AS tool_share
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def model_latency(t: Tables) -> DataFrame:
    """Ratios of sums, null where the divisor is 0."""
    rows = t.lineitem.join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("p_type").alias("model")).agg(
        F.count(F.lit(1)).alias("calls"), F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), 4).alias("ms_per_token"),
        F.round(F.sum("l_tax") / F.nullif(F.sum("l_discount"), F.lit(0.0)), 6).alias("tool_share"),
    )


@query("""SELECT n_name AS server, s_name AS tool, count(*) AS invocations, round(sum(l_quantity), 2) AS output FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY ROLLUP (server, tool)""")
def mcp_rollup(t: Tables) -> DataFrame:
    """Invocations by server and tool with subtotals."""
    rows = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.rollup(F.col("n_name").alias("server"), F.col("s_name").alias("tool")).agg(F.count(F.lit(1)).alias("invocations"), F.round(F.sum("l_quantity"), 2).alias("output"))


@query("""SELECT p_partkey AS tool, p_brand FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)""")
def inventory_unused(t: Tables) -> DataFrame:
    """What is installed and not used."""
    used = t.lineitem.filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return t.part.join(used, "p_partkey", "left_anti").select(F.col("p_partkey").alias("tool"), "p_brand")


@query("""SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = 1996)""")
def unused_installed(t: Tables) -> DataFrame:
    used = t.orders.filter(F.year("o_orderdate") == 1996).select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(used, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


@query("""WITH a AS (SELECT o_orderkey, o_totalprice, 'first' AS source FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_orderkey, round(o_totalprice / 2, 4) AS o_totalprice, 'second' AS source FROM orders WHERE o_totalprice > 200000)
  SELECT * FROM a UNION ALL SELECT * FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a)""")
def union_precedence(t: Tables) -> DataFrame:
    """Two sources of one thing: the second counts where the first has nothing."""
    a = t.orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice", F.lit("first").alias("source"))
    b = t.orders.filter("o_totalprice > 200000").select("o_orderkey", F.round(F.col("o_totalprice") / 2, 4).alias("o_totalprice"), F.lit("second").alias("source"))
    return a.unionByName(b.join(a.select("o_orderkey"), "o_orderkey", "left_anti"))


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_orderpriority = '1-URGENT'""")
def project_filter(t: Tables) -> DataFrame:
    """Sessions of the projects that pass a filter, by semi-join."""
    kept = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return scope.of_sessions(scope.route(t.orders, o_orderpriority="1-URGENT"), kept, "o_custkey").select("o_orderkey", "o_totalprice")


@query("""SELECT l_suppkey, count(*) AS messages FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 250000) GROUP BY 1""")
def semi_scope(t: Tables) -> DataFrame:
    """A table without the filtered column, scoped by the sessions that survive."""
    kept = t.orders.filter("o_totalprice > 250000").select(F.col("o_orderkey").alias("l_orderkey"))
    return scope.of_sessions(t.lineitem, kept, "l_orderkey").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("messages"))


@query("""WITH s AS (SELECT o_orderkey, o_orderdate, o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n,
    sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS before, sum(o_totalprice) OVER (PARTITION BY o_custkey) AS total FROM orders),
  c AS (SELECT *, before / k - (total - before) / (n - k) AS drop FROM s WHERE k >= 2 AND n - k >= 2)
  SELECT o_custkey AS project, arg_max(o_orderkey, (drop, -k)) AS pinned_after, round(max(drop), 7) AS saved_per_session FROM c GROUP BY 1 HAVING max(drop) > 0""")
def pin_split(t: Tables) -> DataFrame:
    """Where a project's mean cost fell most: prefix and suffix means, the best split by argmax."""
    w = Window.partitionBy("o_custkey")
    o = w.orderBy("o_orderdate", "o_orderkey")
    s = t.orders.select(
        "o_custkey", "o_orderkey", F.row_number().over(o).alias("k"), F.count(F.lit(1)).over(w).alias("n"),
        F.sum("o_totalprice").over(o.rowsBetween(Window.unboundedPreceding, 0)).alias("before"), F.sum("o_totalprice").over(w).alias("total"),
    ).filter("k >= 2 AND n - k >= 2")
    s = s.withColumn("drop", F.col("before") / F.col("k") - (F.col("total") - F.col("before")) / (F.col("n") - F.col("k")))
    best = s.groupBy(F.col("o_custkey").alias("project")).agg(F.max_by("o_orderkey", F.struct("drop", -F.col("k"))).alias("pinned_after"), F.max("drop").alias("d"))
    return best.filter("d > 0").select("project", "pinned_after", F.round("d", 7).alias("saved_per_session"))


@query("""WITH s AS (SELECT o_orderpriority AS priority, avg(o_totalprice) AS cost, count(*) AS n FROM orders GROUP BY 1) SELECT priority, n, round(cost / max(cost) OVER (), 6) AS relative FROM s""")
def gap_mining(t: Tables) -> DataFrame:
    """A group's mean against the largest mean."""
    s = t.orders.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.avg("o_totalprice").alias("cost"), F.count(F.lit(1)).alias("n"))
    return s.select("priority", "n", F.round(F.col("cost") / F.max("cost").over(Window.partitionBy()), 6).alias("relative"))


@query("""WITH d AS (SELECT n_name AS project, o_orderdate::DATE AS day, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), m AS (SELECT max(day) AS last FROM d)
  SELECT project, coalesce(sum(n) FILTER (day > last - 30), 0)::BIGINT AS recent, coalesce(sum(n) FILTER (day > last - 60 AND day <= last - 30), 0)::BIGINT AS prior FROM d, m GROUP BY 1""")
def project_momentum(t: Tables) -> DataFrame:
    """Sessions of the last thirty days against the thirty before, by project."""
    d = _places(t).select(F.col("n_name").alias("project"), F.to_date("o_orderdate").alias("day"))
    last = t.orders.agg(F.to_date(F.max("o_orderdate")).alias("last"))
    d = d.join(F.broadcast(last))  # one row
    return d.groupBy("project").agg(
        F.count_if(F.col("day") > F.date_sub("last", 30)).alias("recent"), F.count_if((F.col("day") > F.date_sub("last", 60)) & (F.col("day") <= F.date_sub("last", 30))).alias("prior")
    )


@query("""SELECT o_orderpriority, o_orderstatus FROM orders WHERE o_totalprice > 300000 INTERSECT SELECT o_orderpriority, o_orderstatus FROM orders WHERE o_totalprice < 2000""")
def shared_tools(t: Tables) -> DataFrame:
    """Combinations present in both of two sets."""
    of = lambda c: t.orders.filter(c).select("o_orderpriority", "o_orderstatus")
    return of("o_totalprice > 300000").intersect(of("o_totalprice < 2000"))


@query("""SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.09 AND l_returnflag = 'R'""")
def config_drift(t: Tables) -> DataFrame:
    """What one state has and the other lacks."""
    costly = t.lineitem.filter("l_quantity > 49 AND l_discount > 0.09 AND l_returnflag = 'R'").select("l_suppkey")
    return t.lineitem.filter("l_returnflag = 'A'").select("l_suppkey").subtract(costly)


@query("""WITH o AS (SELECT o_orderkey, o_orderdate, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) SELECT o_orderkey, o_totalprice FROM o WHERE k BETWEEN 101 AND 150""")
def ledger_page(t: Tables) -> DataFrame:
    """The third page of fifty, by offset and limit."""
    return scope.page(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 100, 50)


@query("""WITH o AS (SELECT p_partkey, p_retailprice, sum(p_size) OVER (ORDER BY p_retailprice DESC, p_partkey ROWS UNBOUNDED PRECEDING) AS used FROM part) SELECT p_partkey, used::BIGINT AS used FROM o WHERE used <= 500""")
def budgeted_prefix(t: Tables) -> DataFrame:
    """The best ranked files that fit a token budget: block sums give each price range its offset, so no task sorts the table."""
    from ..operators.stats import running_total

    ranked = running_total(t.part.select("p_partkey", "p_retailprice", "p_size"), "p_retailprice", "p_size", ("p_partkey",), descending=True)
    return ranked.withColumn("used", F.col("_before") + F.col("p_size")).filter("used <= 500").select("p_partkey", "used")


@query("""WITH a AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
  SELECT coalesce(a.o_custkey, b.o_custkey) AS project, coalesce(a.n, 0) AS done, coalesce(b.n, 0) AS urgent FROM a FULL JOIN b ON a.o_custkey = b.o_custkey""")
def steering_full_join(t: Tables) -> DataFrame:
    """Several inputs over the union of their keys."""
    a = t.orders.filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("project")).agg(F.count(F.lit(1)).alias("done"))
    b = t.orders.filter("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("project")).agg(F.count(F.lit(1)).alias("urgent"))
    return a.join(b, "project", "full").select("project", F.coalesce("done", F.lit(0)).alias("done"), F.coalesce("urgent", F.lit(0)).alias("urgent"))


@query("""WITH p AS (SELECT substr(md5(p_partkey::VARCHAR), 1, 3) AS prefix, min(p_partkey) AS id FROM part GROUP BY 1 HAVING count(*) = 1) SELECT id AS part, prefix, count(*) AS refs FROM lineitem JOIN p ON l_partkey = id GROUP BY ALL""")
def prefix_unique_lookup(t: Tables) -> DataFrame:
    """Short ids resolve only where they are unambiguous."""
    p = t.part.groupBy(F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 3).alias("prefix")).agg(F.min("p_partkey").alias("part"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    return t.lineitem.join(p, F.col("l_partkey") == F.col("part")).groupBy("part", "prefix").agg(F.count(F.lit(1)).alias("refs"))


@query("""SELECT c_mktsegment AS segment, count(*) AS sessions, max(o_orderdate)::DATE AS last_day FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-06-30' AND o_orderdate + INTERVAL 30 DAY >= TIMESTAMP '1997-02-01' GROUP BY 1""")
def overlap_scope(t: Tables) -> DataFrame:
    """Sessions whose span touches a range of days, by segment."""
    start = F.col("o_orderdate").cast("timestamp")
    rows = t.orders.withColumn("a", start).withColumn("b", start + F.expr("INTERVAL 30 DAYS"))
    low, high = F.lit("1997-02-01").cast("timestamp"), F.lit("1997-06-30").cast("timestamp")
    kept = scope.overlapping(rows, "a", "b", low, high).filter(F.col("a") >= F.lit("1997-01-01").cast("timestamp"))
    return kept.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("sessions"), F.max("o_orderdate").cast("date").alias("last_day"))
