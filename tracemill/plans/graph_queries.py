"""Queries over pages as a document graph: the first name of a page's host is a node, and a link's word names the node it means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph as G
from .registry import Tables, query

HOST, WORD = r"^https?://(?:m\.|www\.)?([^./?#]+)", r"^[^.,]*"
NODES = f"n AS (SELECT page_id, regexp_extract(url, '{HOST}', 1) AS node, html FROM pages)"


def _pages(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.regexp_extract("url", HOST, 1).alias("node"), "html")


def _links(t: Tables) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))
    return _pages(t).select(F.col("node").alias("src"), F.explode(found).alias("dst")).select("src", F.regexp_extract(F.lower("dst"), WORD, 0).alias("dst")).distinct()


LINKS = f"{NODES}, l AS (SELECT DISTINCT node AS src, regexp_extract(lower(unnest(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1))), '{WORD}') AS dst FROM n)"


@query(f"WITH {LINKS} SELECT src, dst FROM l")
def doc_graph_edges(t: Tables) -> DataFrame:
    return _links(t)


@query(f"WITH {LINKS} SELECT dst, count(*) AS in_degree FROM l GROUP BY 1")
def in_degree(t: Tables) -> DataFrame:
    return G.in_degree(_links(t))


@query(f"""WITH RECURSIVE {LINKS}, b AS (SELECT src AS x, dst AS y FROM l UNION SELECT dst, src FROM l),
  w AS (SELECT min(src) AS node, 0 AS d FROM l UNION SELECT y, d + 1 FROM w JOIN b ON x = node WHERE d < 3) SELECT node, min(d)::INT AS distance FROM w GROUP BY 1""")
def bfs_neighborhood(t: Tables) -> DataFrame:
    """What lies within three links of the first page's host."""
    links = _links(t)
    return G.neighbourhood(links, links.agg(F.min("src").alias("node")), 3)


@query(f"WITH {LINKS} SELECT DISTINCT node FROM n WHERE node NOT IN (SELECT dst FROM l WHERE src <> dst)")
def orphan_nodes(t: Tables) -> DataFrame:
    """Hosts that no other host links to."""
    return G.orphans(_pages(t).select("node").distinct(), _links(t))


@query(f"WITH {LINKS} SELECT src, dst FROM l WHERE dst NOT IN (SELECT node FROM n)")
def broken_links(t: Tables) -> DataFrame:
    """Links whose word is no host."""
    return G.dangling(_pages(t).select("node").distinct(), _links(t)).select("src", "dst")


@query(f"""WITH {NODES}, c AS (SELECT node, count(*) AS pages, count(DISTINCT sha256(html)) AS versions, max(page_id) AS latest FROM n GROUP BY 1)
  SELECT node, pages, versions, latest, round(percent_rank() OVER (ORDER BY latest), 6) AS recency FROM c""")
def doc_recency(t: Tables) -> DataFrame:
    """Hosts by the recency rank of their last page. The window runs over one row a host."""
    from pyspark.sql import Window

    c = _pages(t).groupBy("node").agg(F.count(F.lit(1)).alias("pages"), F.count_distinct(F.sha2("html", 256)).alias("versions"), F.max("page_id").alias("latest"))
    return c.withColumn("recency", F.round(F.percent_rank().over(Window.orderBy("latest")), 6))
