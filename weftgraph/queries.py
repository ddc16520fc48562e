"""Named queries over the test graph, each with the SQL that gives the same rows from the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .testgraph import database

Q: dict[str, tuple[str, str | None]] = {}
PARAMS: dict[str, dict] = {}


def q(name: str, query: str, sql: str | None, **params) -> None:
    Q[name] = (query, sql)
    if params:
        PARAMS[name] = params


LINKED = "linked(n, m, w) AS (SELECT n_nationkey, t.m, (7 * n_nationkey + 3 * t.m) % 10 + 1 FROM nation, LATERAL (SELECT unnest([(2 * n_nationkey + 1) % 25, (n_nationkey + 7) % 25]) AS m) t)"
NEXT = "nxt(a, b) AS (SELECT * FROM (SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL)"
WALKS = "walks(s, e, len, cost, nodes) AS (SELECT n_nationkey, n_nationkey, 0, 0, [n_nationkey] FROM nation WHERE n_nationkey < {top} UNION ALL SELECT s, l.m, len + 1, cost + l.w, list_append(nodes, l.m) FROM walks JOIN linked l ON l.n = e WHERE len < {hi}{more})"


def walks(top: int, hi: int, more: str = "") -> str:
    return f"WITH RECURSIVE {LINKED}, {WALKS.format(top=top, hi=hi, more=more)}"


# ---- the flagship

q(
    "flagship_region_orders",
    "MATCH (c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region), (c)-[:PLACED]->(o:Orders) WHERE r.r_name = 'ASIA' OR r.r_regionkey < 3 "
    "RETURN n.n_name AS nation, count(*) AS cnt, round(sum(o.o_totalprice), 2) AS total ORDER BY total DESC",
    "SELECT n_name AS nation, count(*) AS cnt, round(sum(o_totalprice), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN orders ON o_custkey = c_custkey WHERE r_name = 'ASIA' OR r_regionkey < 3 GROUP BY n_name",
)

# ---- scans

q("scan_label", "MATCH (n:Nation) RETURN n.n_nationkey AS k, n.n_name AS name", "SELECT n_nationkey AS k, n_name AS name FROM nation")
q(
    "scan_multilabel",
    "MATCH (x:Customer:Supplier) RETURN label(x) AS l, count(*) AS cnt, count(x.c_mktsegment) AS segs, round(sum(x.s_acctbal), 2) AS bal",
    "SELECT 'Customer' AS l, count(*) AS cnt, count(c_mktsegment) AS segs, CAST(NULL AS DOUBLE) AS bal FROM customer UNION ALL SELECT 'Supplier', count(*), 0, round(sum(s_acctbal), 2) FROM supplier",
)
q(
    "scan_anylabel",
    "MATCH (x) RETURN label(x) AS l, count(*) AS cnt",
    "SELECT 'Region' AS l, count(*) AS cnt FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part "
    "UNION ALL SELECT 'Orders', count(*) FROM orders UNION ALL SELECT 'User', count(DISTINCT user_id) FROM events UNION ALL SELECT 'Event', count(*) FROM events",
)
q("scan_pk_lookup", "MATCH (c:Customer {c_custkey: 42}) RETURN c.c_name AS name, c.c_acctbal AS bal", "SELECT c_name AS name, c_acctbal AS bal FROM customer WHERE c_custkey = 42")
q("scan_in_list", "MATCH (p:Part) WHERE p.p_partkey IN [3, 5, 8, 13, 999999] RETURN p.p_partkey AS k, p.p_name AS name", "SELECT p_partkey AS k, p_name AS name FROM part WHERE p_partkey IN (3, 5, 8, 13, 999999)")
q(
    "scan_all_properties",
    "MATCH (n:Nation) WHERE n.n_nationkey < 5 RETURN n.*",
    'SELECT n_nationkey AS "n.n_nationkey", n_name AS "n.n_name", n_regionkey AS "n.n_regionkey" FROM nation WHERE n_nationkey < 5',
)
q("filter_and_or_not", "MATCH (p:Part) WHERE (p.p_size > 40 OR p.p_size < 5) AND NOT p.p_retailprice > 1500 RETURN count(*) AS cnt", "SELECT count(*) AS cnt FROM part WHERE (p_size > 40 OR p_size < 5) AND NOT p_retailprice > 1500")
q(
    "filter_null",
    "MATCH (x:Customer:Supplier) WHERE x.s_name IS NULL RETURN count(*) AS cnt, count(x.c_name) AS named",
    "SELECT count(*) AS cnt, count(c_name) AS named FROM customer",
)
q(
    "filter_string_preds",
    "MATCH (p:Part) WHERE p.p_name STARTS WITH 'p' OR p.p_name CONTAINS '12' OR p.p_type ENDS WITH 'S' RETURN count(*) AS cnt",
    "SELECT count(*) AS cnt FROM part WHERE starts_with(p_name, 'p') OR contains(p_name, '12') OR suffix(p_type, 'S')",
)
q("filter_xor_regex", "MATCH (p:Part) WHERE p.p_size > 25 XOR p.p_brand =~ '.*[12]' RETURN count(*) AS cnt", "SELECT count(*) AS cnt FROM part WHERE (p_size > 25) <> regexp_full_match(p_brand, '.*[12]')")
q(
    "filter_timestamp",
    "MATCH (o:Orders) WHERE o.o_orderdate >= TIMESTAMP('1995-01-01 00:00:00') AND o.o_orderdate < '1996-01-01' RETURN count(*) AS cnt",
    "SELECT count(*) AS cnt FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'",
)

# ---- expansions

q("expand_out", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.n_name AS n, r.r_name AS r", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey")
q("expand_in", "MATCH (r:Region)<-[:IN_REGION]-(n:Nation) RETURN r.r_name AS r, count(n) AS cnt", "SELECT r_name AS r, count(*) AS cnt FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
q(
    "expand_both",
    "MATCH (a:Nation)-[e:LINKED]-(b:Nation) RETURN a.n_nationkey AS a, count(*) AS cnt, sum(e.w) AS w",
    f"WITH {LINKED} SELECT a, count(*) AS cnt, CAST(sum(w) AS BIGINT) AS w FROM (SELECT n AS a, w FROM linked UNION ALL SELECT m, w FROM linked) GROUP BY a",
)
q(
    "expand_edge_props",
    "MATCH (o:Orders)-[e:CONTAINS]->(p:Part) RETURN o.o_orderkey AS o, p.p_partkey AS p, e.quantity AS qty, e.returnflag AS flag",
    "SELECT l_orderkey AS o, l_partkey AS p, l_quantity AS qty, l_returnflag AS flag FROM lineitem",
)
q("expand_edge_pred", "MATCH (:Orders)-[e:CONTAINS {returnflag: 'R'}]->(p:Part) WHERE e.quantity > 30 AND p.p_size = 7 RETURN count(*) AS cnt", "SELECT count(*) AS cnt FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_quantity > 30 AND p_size = 7")
q(
    "expand_multi_triplet",
    "MATCH (x)-[:IN_NATION]->(n:Nation) RETURN label(x) AS l, n.n_name AS n, count(*) AS cnt",
    "SELECT 'Customer' AS l, n_name AS n, count(*) AS cnt FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name UNION ALL SELECT 'Supplier', n_name, count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name",
)
q(
    "expand_any_type",
    "MATCH (o:Orders)-[e]->(x) RETURN label(e) AS t, label(x) AS l, count(*) AS cnt",
    "SELECT 'CONTAINS' AS t, 'Part' AS l, count(*) AS cnt FROM lineitem UNION ALL SELECT 'SHIPPED_BY', 'Supplier', count(*) FROM lineitem",
)
q("expand_type_union", "MATCH (s:Supplier)-[e:SUPPLIES|IN_NATION]->(x) RETURN label(e) AS t, count(*) AS cnt", "SELECT 'SUPPLIES' AS t, count(*) AS cnt FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) UNION ALL SELECT 'IN_NATION', count(*) FROM supplier")
q(
    "expand_degree",
    "MATCH (c:Customer) OPTIONAL MATCH (c)-[e:PLACED]->(:Orders) WITH c, count(e) AS degree RETURN degree, count(*) AS customers",
    "SELECT degree, count(*) AS customers FROM (SELECT c_custkey, count(o_orderkey) AS degree FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey) GROUP BY degree",
)
q("expand_count", "MATCH (:Customer)-[:PLACED]->(:Orders)-[:CONTAINS]->(:Part) RETURN count(*) AS cnt", "SELECT count(*) AS cnt FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
q("self_loop", "MATCH (a:Nation)-[e:LINKED]->(a) RETURN a.n_nationkey AS a, e.w AS w", f"WITH {LINKED} SELECT n AS a, w FROM linked WHERE n = m")
q(
    "two_hop",
    "MATCH (s:Supplier)-[:IN_NATION]->(:Nation)-[:IN_REGION]->(r:Region) RETURN r.r_name AS r, count(s) AS cnt",
    "SELECT r_name AS r, count(*) AS cnt FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
)
q(
    "three_hop",
    "MATCH (r:Region)<-[:IN_REGION]-(:Nation)<-[:IN_NATION]-(:Customer)-[:PLACED]->(o:Orders) RETURN r.r_name AS r, count(o) AS cnt",
    "SELECT r_name AS r, count(*) AS cnt FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY r_name",
)
q("triangle", "MATCH (a:Nation)-[:LINKED]->(b:Nation)-[:LINKED]->(c:Nation)-[:LINKED]->(a) RETURN count(*) AS cnt", f"WITH {LINKED} SELECT count(*) AS cnt FROM linked x JOIN linked y ON y.n = x.m JOIN linked z ON z.n = y.m AND z.m = x.n")
q(
    "triangle_undirected",
    "MATCH (a:Nation)-[:LINKED]-(b:Nation)-[:LINKED]-(c:Nation)-[:LINKED]-(a) WHERE a.n_nationkey < b.n_nationkey AND b.n_nationkey < c.n_nationkey RETURN count(*) AS cnt",
    f"WITH {LINKED}, u AS (SELECT n, m FROM linked UNION ALL SELECT m, n FROM linked) SELECT count(*) AS cnt FROM u x JOIN u y ON y.n = x.m JOIN u z ON z.n = y.m AND z.m = x.n WHERE x.n < y.n AND y.n < z.n",
)
q(
    "triangle_edge_pred",
    "MATCH (a:Nation)-[e:LINKED]->(b:Nation)-[f:LINKED]->(c:Nation)<-[g:LINKED]-(a) WHERE e.w > 2 AND f.w > 2 RETURN count(*) AS cnt, sum(e.w + f.w + g.w) AS w",
    f"WITH {LINKED} SELECT count(*) AS cnt, CAST(sum(x.w + y.w + z.w) AS BIGINT) AS w FROM linked x JOIN linked y ON y.n = x.m JOIN linked z ON z.n = x.n AND z.m = y.m WHERE x.w > 2 AND y.w > 2",
)
q(
    "square",
    "MATCH (c:Customer)-[:PLACED]->(o:Orders)-[:SHIPPED_BY]->(s:Supplier)-[:IN_NATION]->(n:Nation)<-[:IN_NATION]-(c) RETURN n.n_name AS n, count(*) AS cnt",
    "SELECT n_name AS n, count(*) AS cnt FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name",
)
q(
    "multiway_intersect",
    "MATCH (a:Nation)-[:LINKED]->(x:Nation), (b:Nation)-[:LINKED]->(x), (c:Nation)-[:LINKED]->(x) WHERE a.n_nationkey < b.n_nationkey AND b.n_nationkey < c.n_nationkey RETURN x.n_nationkey AS x, count(*) AS cnt",
    f"WITH {LINKED} SELECT a.m AS x, count(*) AS cnt FROM linked a JOIN linked b ON a.m = b.m JOIN linked c ON c.m = a.m WHERE a.n < b.n AND b.n < c.n GROUP BY a.m",
)
q(
    "self_join_neq",
    "MATCH (p1:Part)<-[:CONTAINS]-(o:Orders)-[:CONTAINS]->(p2:Part) WHERE id(p1) <> id(p2) RETURN count(*) AS cnt",
    "SELECT count(*) AS cnt FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_partkey <> b.l_partkey",
)
q("node_equality", "MATCH (a:Nation)-[:LINKED]->(b:Nation)-[:LINKED]->(c:Nation) WHERE a <> c RETURN count(*) AS cnt", f"WITH {LINKED} SELECT count(*) AS cnt FROM linked x JOIN linked y ON y.n = x.m WHERE x.n <> y.m")
q(
    "join_hint",
    "MATCH (c:Customer)-[e:PLACED]->(o:Orders), (c)-[f:IN_NATION]->(n:Nation) HINT (n JOIN f) JOIN (c JOIN e) JOIN o RETURN n.n_name AS n, count(*) AS cnt",
    "SELECT n_name AS n, count(*) AS cnt FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name",
)

# ---- optional and existential patterns, joins

q("optional_match", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Orders) RETURN c.c_mktsegment AS s, count(*) AS n, count(o) AS orders", "SELECT c_mktsegment AS s, count(*) AS n, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
q(
    "optional_where_corr",
    "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Orders) WHERE o.o_totalprice > c.c_acctbal * 20 RETURN c.c_custkey AS c, count(o) AS cnt, min(o.o_totalprice) AS least",
    "SELECT c_custkey AS c, count(o_orderkey) AS cnt, min(o_totalprice) AS least FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 20 GROUP BY 1",
)
q(
    "optional_chain",
    "MATCH (n:Nation) OPTIONAL MATCH (n)<-[:IN_NATION]-(s:Supplier) OPTIONAL MATCH (s)-[:SUPPLIES]->(p:Part) WHERE p.p_size < 3 RETURN n.n_nationkey AS n, count(*) AS cnt, count(s) AS s, count(p) AS p",
    "SELECT n_nationkey AS n, count(*) AS cnt, count(s_suppkey) AS s, count(p_partkey) AS p FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN (SELECT DISTINCT l_suppkey, p_partkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size < 3) ON l_suppkey = s_suppkey GROUP BY 1",
)
q(
    "exists_pattern",
    "MATCH (n:Nation) WHERE EXISTS { MATCH (n)<-[:IN_NATION]-(s:Supplier) WHERE s.s_acctbal > 5000 } RETURN n.n_name AS n",
    "SELECT n_name AS n FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000)",
)
q("not_exists_pattern", "MATCH (c:Customer) WHERE NOT (c)-[:PLACED]->(:Orders {o_orderstatus: 'F'}) RETURN count(*) AS cnt", "SELECT count(*) AS cnt FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
q(
    "exists_under_or",
    "MATCH (n:Nation) WHERE n.n_nationkey < 4 OR (n)<-[:IN_NATION]-(:Supplier {s_suppkey: 7}) RETURN n.n_nationkey AS n",
    "SELECT n_nationkey AS n FROM nation WHERE n_nationkey < 4 OR n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey = 7)",
)
q(
    "count_subquery",
    "MATCH (n:Nation) RETURN n.n_nationkey AS n, COUNT { MATCH (n)<-[:IN_NATION]-(:Supplier) } AS s",
    "SELECT n_nationkey AS n, count(s_suppkey) AS s FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1",
)
q(
    "exists_correlated",
    "MATCH (c:Customer)-[:PLACED]->(o:Orders) WHERE EXISTS { MATCH (o)-[e:CONTAINS]->(:Part) WHERE e.extendedprice > c.c_acctbal * 12 } RETURN count(*) AS cnt",
    "SELECT count(*) AS cnt FROM customer JOIN orders ON o_custkey = c_custkey WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_extendedprice > c_acctbal * 12)",
)
q("cross_product", "MATCH (r:Region), (n:Nation) WHERE n.n_nationkey < 3 RETURN r.r_name AS r, n.n_name AS n", "SELECT r_name AS r, n_name AS n FROM region, nation WHERE n_nationkey < 3")
q("theta_join", "MATCH (a:Nation), (b:Nation) WHERE a.n_nationkey + 20 < b.n_nationkey RETURN a.n_nationkey AS a, b.n_nationkey AS b", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a, nation b WHERE a.n_nationkey + 20 < b.n_nationkey")
q("prop_hash_join", "MATCH (c:Customer), (s:Supplier) WHERE c.c_nationkey = s.s_nationkey AND s.s_acctbal < 0 RETURN s.s_suppkey AS s, count(*) AS cnt", "SELECT s_suppkey AS s, count(*) AS cnt FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE s_acctbal < 0 GROUP BY 1")
q(
    "multi_match",
    "MATCH (c:Customer)-[:PLACED]->(o:Orders) WHERE o.o_totalprice > 200000 MATCH (c)-[:IN_NATION]->(n:Nation) RETURN n.n_name AS n, count(*) AS cnt",
    "SELECT n_name AS n, count(*) AS cnt FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_totalprice > 200000 GROUP BY 1",
)

# ---- aggregates

q("agg_count_star", "MATCH (:Orders)-[:CONTAINS]->(:Part) RETURN count(*) AS cnt", "SELECT count(*) AS cnt FROM lineitem")
q("agg_count_distinct", "MATCH (o:Orders)-[:CONTAINS]->(p:Part) RETURN count(DISTINCT p) AS parts, count(DISTINCT o.o_custkey) AS customers", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT o_custkey) AS customers FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
q(
    "agg_sum_avg_min_max",
    "MATCH (p:Part) RETURN p.p_brand AS b, sum(p.p_size) AS s, round(avg(p.p_retailprice), 4) AS a, min(p.p_size) AS lo, max(p.p_name) AS hi",
    "SELECT p_brand AS b, CAST(sum(p_size) AS BIGINT) AS s, round(avg(p_retailprice), 4) AS a, min(p_size) AS lo, max(p_name) AS hi FROM part GROUP BY 1",
)
q("agg_collect", "MATCH (r:Region)<-[:IN_REGION]-(n:Nation) WITH r, n ORDER BY n.n_nationkey RETURN r.r_name AS r, size(collect(n.n_name)) AS names", "SELECT r_name AS r, CAST(count(*) AS INTEGER) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
q("agg_collect_distinct", "MATCH (c:Customer) RETURN c.c_nationkey AS n, size(collect(DISTINCT c.c_mktsegment)) AS segs", "SELECT c_nationkey AS n, CAST(count(DISTINCT c_mktsegment) AS INTEGER) AS segs FROM customer GROUP BY 1")
q("agg_empty_input", "MATCH (p:Part) WHERE p.p_size < 0 RETURN count(*) AS n, sum(p.p_size) AS s, max(p.p_size) AS m", "SELECT count(*) AS n, CAST(sum(p_size) AS BIGINT) AS s, max(p_size) AS m FROM part WHERE p_size < 0")
q(
    "agg_distinct_values",
    "MATCH (p:Part) RETURN p.p_brand AS b, sum(DISTINCT p.p_size) AS s, round(avg(DISTINCT p.p_size), 6) AS a",
    "SELECT p_brand AS b, CAST(sum(DISTINCT p_size) AS BIGINT) AS s, round(avg(DISTINCT p_size), 6) AS a FROM part GROUP BY 1",
)
q("agg_expression", "MATCH (o:Orders) RETURN o.o_orderstatus AS s, round(sum(o.o_totalprice) / count(*), 3) AS mean, count(*) + 1 AS more", "SELECT o_orderstatus AS s, round(sum(o_totalprice) / count(*), 3) AS mean, count(*) + 1 AS more FROM orders GROUP BY 1")
q(
    "group_multi_key",
    "MATCH (:Orders)-[e:CONTAINS]->(:Part) RETURN e.returnflag AS f, e.linestatus AS s, round(sum(e.quantity), 2) AS qty, round(sum(e.extendedprice * (1 - e.discount)), 2) AS rev, count(*) AS cnt",
    "SELECT l_returnflag AS f, l_linestatus AS s, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS rev, count(*) AS cnt FROM lineitem GROUP BY 1, 2",
)
q(
    "having_with",
    "MATCH (c:Customer)-[:PLACED]->(o:Orders) WITH c, count(o) AS cnt WHERE cnt > 12 RETURN c.c_name AS c, cnt",
    "SELECT c_name AS c, count(*) AS cnt FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name HAVING count(*) > 12",
)
q("distinct_rows", "MATCH (p:Part) RETURN DISTINCT p.p_brand AS b, p.p_size AS s", "SELECT DISTINCT p_brand AS b, p_size AS s FROM part")

# ---- order, limits, unions, lists

q("order_multi", "MATCH (n:Nation) RETURN n.n_regionkey AS r, n.n_name AS n ORDER BY r DESC, n LIMIT 7", "SELECT n_regionkey AS r, n_name AS n FROM nation ORDER BY r DESC, n LIMIT 7")
q("order_expr", "MATCH (p:Part) RETURN p.p_partkey AS k ORDER BY p.p_size * -1, p.p_partkey LIMIT 10", "SELECT p_partkey AS k FROM part ORDER BY p_size * -1, p_partkey LIMIT 10")
q("topk", "MATCH (c:Customer)-[:PLACED]->(o:Orders) RETURN c.c_name AS c, o.o_orderkey AS o, o.o_totalprice AS p ORDER BY p DESC, o LIMIT 20", "SELECT c_name AS c, o_orderkey AS o, o_totalprice AS p FROM customer JOIN orders ON o_custkey = c_custkey ORDER BY p DESC, o LIMIT 20")
q("skip_limit", "MATCH (c:Customer) RETURN c.c_custkey AS c ORDER BY c SKIP 10 LIMIT 2 + 3", "SELECT c_custkey AS c FROM customer ORDER BY c LIMIT 5 OFFSET 10")
q(
    "union_all",
    "MATCH (c:Customer) WHERE c.c_acctbal < 0 RETURN c.c_nationkey AS n UNION ALL MATCH (s:Supplier) WHERE s.s_acctbal < 0 RETURN s.s_nationkey AS k",
    "SELECT c_nationkey AS n FROM customer WHERE c_acctbal < 0 UNION ALL SELECT s_nationkey FROM supplier WHERE s_acctbal < 0",
)
q("union_distinct", "MATCH (c:Customer) RETURN c.c_nationkey AS n UNION MATCH (s:Supplier) RETURN s.s_nationkey AS n", "SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier")
q(
    "call_union",
    "MATCH (n:Nation) CALL (n) { MATCH (n)<-[:IN_NATION]-(c:Customer) RETURN n.n_name AS name, c.c_acctbal AS b UNION ALL MATCH (n)<-[:IN_NATION]-(s:Supplier) RETURN n.n_name AS name, s.s_acctbal AS b } RETURN name, count(*) AS cnt, round(sum(b), 2) AS total",
    "SELECT n_name AS name, count(*) AS cnt, round(sum(b), 2) AS total FROM nation JOIN (SELECT c_nationkey AS k, c_acctbal AS b FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier) ON k = n_nationkey GROUP BY 1",
)
q("unwind_literal", "UNWIND [3, 1, 2] AS x MATCH (n:Nation {n_nationkey: x}) RETURN x, n.n_name AS n", "SELECT CAST(n_nationkey AS BIGINT) AS x, n_name AS n FROM nation WHERE n_nationkey IN (1, 2, 3)")
q(
    "unwind_collect",
    "MATCH (r:Region)<-[:IN_REGION]-(n:Nation) WITH r, collect(n.n_nationkey) AS keys UNWIND keys AS k WITH r, k WHERE k % 2 = 0 RETURN r.r_name AS r, sum(k) AS s",
    "SELECT r_name AS r, CAST(sum(n_nationkey) AS BIGINT) AS s FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0 GROUP BY 1",
)
q(
    "with_chain",
    "MATCH (c:Customer)-[:PLACED]->(o:Orders) WITH c, sum(o.o_totalprice) AS t WITH c.c_mktsegment AS s, max(t) AS m RETURN s, round(m, 2) AS m ORDER BY s",
    "SELECT s, round(max(t), 2) AS m FROM (SELECT c_custkey, c_mktsegment AS s, sum(o_totalprice) AS t FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) GROUP BY s",
)
q(
    "with_top_then_match",
    "MATCH (c:Customer) WITH c ORDER BY c.c_acctbal DESC, c.c_custkey LIMIT 10 MATCH (c)-[:PLACED]->(o:Orders) RETURN c.c_custkey AS c, count(o) AS cnt",
    "SELECT c_custkey AS c, count(*) AS cnt FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10) JOIN orders ON o_custkey = c_custkey GROUP BY 1",
)

# ---- expressions

q(
    "case_searched",
    "MATCH (p:Part) RETURN CASE WHEN p.p_size < 10 THEN 'small' WHEN p.p_size < 30 THEN 'middle' ELSE 'large' END AS c, count(*) AS cnt",
    "SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS c, count(*) AS cnt FROM part GROUP BY 1",
)
q("case_simple", "MATCH (o:Orders) RETURN CASE o.o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS c, count(*) AS cnt", "SELECT CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS BIGINT) AS c, count(*) AS cnt FROM orders GROUP BY 1")
q("arith_int_div_mod", "MATCH (p:Part) RETURN p.p_partkey AS k, p.p_partkey / 7 AS d, p.p_partkey % 7 AS m, -p.p_partkey / 7 AS nd, -p.p_partkey % 7 AS nm", "SELECT p_partkey AS k, p_partkey // 7 AS d, p_partkey % 7 AS m, -(p_partkey // 7) AS nd, -(p_partkey % 7) AS nm FROM part")
q(
    "arith_pow_abs_neg",
    "MATCH (s:Supplier) RETURN s.s_suppkey AS k, abs(s.s_acctbal) AS a, -s.s_acctbal AS n, round(pow(s.s_suppkey, 2), 1) AS p, s.s_suppkey ^ 2 AS q",
    "SELECT s_suppkey AS k, abs(s_acctbal) AS a, -s_acctbal AS n, round(pow(s_suppkey, 2), 1) AS p, pow(s_suppkey, 2) AS q FROM supplier",
)
q("arith_float_zero", "MATCH (n:Nation) WHERE n.n_nationkey < 3 RETURN n.n_nationkey AS k, 1.5 / n.n_nationkey AS x, n.n_nationkey * 0.5 AS h", "SELECT n_nationkey AS k, CASE WHEN n_nationkey = 0 THEN CAST('inf' AS DOUBLE) ELSE CAST(1.5 AS DOUBLE) / n_nationkey END AS x, n_nationkey * CAST(0.5 AS DOUBLE) AS h FROM nation WHERE n_nationkey < 3")
q(
    "cast_numeric",
    "MATCH (p:Part) RETURN p.p_partkey AS k, CAST(p.p_retailprice AS INT64) AS i, CAST(p.p_size AS DOUBLE) AS d, CAST(p.p_partkey, 'INT32') AS s",
    "SELECT p_partkey AS k, CAST(trunc(p_retailprice) AS BIGINT) AS i, CAST(p_size AS DOUBLE) AS d, CAST(p_partkey AS INTEGER) AS s FROM part",
)
q(
    "cast_string",
    "MATCH (p:Part) RETURN CAST(p.p_partkey AS STRING) AS s, CAST('17', 'INT64') + p.p_partkey AS i",
    "SELECT CAST(p_partkey AS VARCHAR) AS s, 17 + p_partkey AS i FROM part",
)
q(
    "cast_temporal",
    "MATCH (o:Orders) RETURN o.o_orderkey AS o, CAST(o.o_orderdate AS DATE) AS d, DATE('1995-03-05') AS c",
    "SELECT o_orderkey AS o, CAST(o_orderdate AS DATE) AS d, DATE '1995-03-05' AS c FROM orders",
)
q(
    "date_part_all",
    "MATCH (e:Event) RETURN e.event_id AS e, date_part('year', e.ts) AS y, date_part('month', e.ts) AS mo, date_part('day', e.ts) AS d, date_part('hour', e.ts) AS h, date_part('minute', e.ts) AS mi, date_part('second', e.ts) AS s",
    "SELECT event_id AS e, year(ts) AS y, month(ts) AS mo, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s FROM events",
)
q(
    "date_plus_interval",
    "MATCH (o:Orders) RETURN o.o_orderkey AS o, o.o_orderdate + INTERVAL('3 days 4 hours') AS a, o.o_orderdate - INTERVAL('1 year 2 months') AS b",
    "SELECT o_orderkey AS o, o_orderdate + INTERVAL 3 DAY + INTERVAL 4 HOUR AS a, o_orderdate - INTERVAL 14 MONTH AS b FROM orders",
)
q(
    "ts_minus_ts_days",
    "MATCH (o:Orders)-[e:CONTAINS]->(:Part) WHERE e.shipdate - o.o_orderdate > INTERVAL('60 days') RETURN count(*) AS cnt",
    "SELECT count(*) AS cnt FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate - o_orderdate > INTERVAL 60 DAY",
)
q("list_index", "MATCH (n:Nation) WITH n, [n.n_name, 'x', 'y'] AS l RETURN n.n_nationkey AS n, l[0] AS a, l[2] AS b, [1, 2, 3][1] AS c", "SELECT n_nationkey AS n, n_name AS a, 'y' AS b, CAST(2 AS BIGINT) AS c FROM nation")
q("list_contains", "MATCH (n:Nation) RETURN n.n_nationkey AS n, list_contains([1, 2, n.n_regionkey], 3) AS a, n.n_nationkey IN [1, 5] AS b", "SELECT n_nationkey AS n, n_regionkey = 3 AS a, n_nationkey IN (1, 5) AS b FROM nation")
q(
    "str_upper_lower_reverse",
    "MATCH (p:Part) RETURN upper(p.p_name) AS u, lower(p.p_brand) AS l, reverse(p.p_name) AS r",
    "SELECT upper(p_name) AS u, lower(p_brand) AS l, reverse(p_name) AS r FROM part",
)
q("label_fn", "MATCH (a)-[e:IN_NATION]->(b) RETURN label(a) AS a, label(e) AS e, label(b) AS b, count(*) AS cnt", "SELECT 'Customer' AS a, 'IN_NATION' AS e, 'Nation' AS b, count(*) AS cnt FROM customer UNION ALL SELECT 'Supplier', 'IN_NATION', 'Nation', count(*) FROM supplier")
q("id_fn", "MATCH (a:Region), (b:Nation) WHERE id(a) < id(b) RETURN count(*) AS cnt, count(DISTINCT id(b)) AS ids", "SELECT count(*) AS cnt, count(DISTINCT n_nationkey) AS ids FROM region, nation")
q(
    "start_end_node",
    "MATCH (a:Nation)<-[e:LINKED]-(b:Nation) RETURN start_node(e)._KEY AS s, end_node(e)._KEY AS t, a.n_nationkey AS a",
    f"WITH {LINKED} SELECT CAST(n AS BIGINT) AS s, CAST(m AS BIGINT) AS t, m AS a FROM linked",
)
q("param_query", "MATCH (c:Customer) WHERE c.c_mktsegment = $seg AND c.c_acctbal > $low AND c.c_nationkey IN $keys RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 100.5 AND c_nationkey IN (1, 2, 3, 4)", seg="BUILDING", low=100.5, keys=[1, 2, 3, 4])

# ---- paths

q("path_walk_1_3", "MATCH (a:Nation)-[k:LINKED*1..3]->(b:Nation) WHERE a.n_nationkey < 5 RETURN a.n_nationkey AS a, b.n_nationkey AS b, length(k) AS len, count(*) AS cnt", f"{walks(5, 3)} SELECT s AS a, e AS b, CAST(len AS BIGINT) AS len, count(*) AS cnt FROM walks WHERE len >= 1 GROUP BY ALL")
q("path_walk_zero", "MATCH (a:Nation)-[k:LINKED*0..2]->(b:Nation) RETURN length(k) AS len, count(*) AS cnt", f"{walks(25, 2)} SELECT CAST(len AS BIGINT) AS len, count(*) AS cnt FROM walks GROUP BY 1")
q("path_walk_count", "MATCH (a:Nation)-[:LINKED*4..4]->(b:Nation) RETURN count(*) AS cnt", f"{walks(25, 4)} SELECT count(*) AS cnt FROM walks WHERE len = 4")
q("path_walk_both", "MATCH (a:Nation {n_nationkey: 2})-[k:LINKED*2..2]-(b:Nation) RETURN b.n_nationkey AS b, count(*) AS cnt", f"WITH {LINKED}, u AS (SELECT n, m FROM linked UNION ALL SELECT m, n FROM linked) SELECT y.m AS b, count(*) AS cnt FROM u x JOIN u y ON y.n = x.m WHERE x.n = 2 GROUP BY 1")
q("path_edge_pred", "MATCH (a:Nation)-[k:LINKED*1..3 (r, n | WHERE r.w > 4)]->(b:Nation) RETURN a.n_nationkey AS a, count(*) AS cnt", f"{walks(25, 3, ' AND l.w > 4')} SELECT s AS a, count(*) AS cnt FROM walks WHERE len >= 1 GROUP BY 1")
q(
    "path_node_pred",
    "MATCH (a:Nation)-[k:LINKED*2..3 (r, n | WHERE n.n_nationkey < 12)]->(b:Nation) RETURN a.n_nationkey AS a, count(*) AS cnt",
    f"{walks(25, 3, ' AND (len = 0 OR e < 12)')} SELECT s AS a, count(*) AS cnt FROM walks WHERE len >= 2 GROUP BY 1",
)
q(
    "path_trail",
    "MATCH (a:Nation {n_nationkey: 0})-[k:LINKED*TRAIL 1..5]->(b:Nation) RETURN length(k) AS len, count(*) AS cnt",
    f"WITH RECURSIVE {LINKED}, t(e, len, used) AS (SELECT 0, 0, CAST([] AS INTEGER[]) UNION ALL SELECT l.m, len + 1, list_append(used, l.n * 100 + l.m) FROM t JOIN linked l ON l.n = e WHERE len < 5 AND NOT list_contains(used, l.n * 100 + l.m)) SELECT CAST(len AS BIGINT) AS len, count(*) AS cnt FROM t WHERE len >= 1 GROUP BY 1",
)
q("path_acyclic", "MATCH (a:Nation {n_nationkey: 0})-[k:LINKED*ACYCLIC 1..5]->(b:Nation) RETURN length(k) AS len, count(*) AS cnt", f"{walks(1, 5, ' AND NOT list_contains(nodes, l.m)')} SELECT CAST(len AS BIGINT) AS len, count(*) AS cnt FROM walks WHERE len >= 1 GROUP BY 1")
q("path_shortest_len", "MATCH (a:Nation)-[k:LINKED*SHORTEST 1..8]->(b:Nation) WHERE a.n_nationkey < 3 RETURN a.n_nationkey AS a, b.n_nationkey AS b, length(k) AS len", f"{walks(3, 8)} SELECT s AS a, e AS b, CAST(min(len) AS BIGINT) AS len FROM walks WHERE len >= 1 GROUP BY 1, 2")
q(
    "path_all_shortest_count",
    "MATCH (a:Nation {n_nationkey: 1})-[k:LINKED*ALL SHORTEST 1..8]->(b:Nation) RETURN b.n_nationkey AS b, length(k) AS len, count(*) AS cnt",
    f"{walks(2, 8)} SELECT e AS b, CAST(len AS BIGINT) AS len, count(*) AS cnt FROM walks w WHERE s = 1 AND len >= 1 AND len = (SELECT min(len) FROM walks x WHERE x.s = 1 AND x.e = w.e AND x.len >= 1) GROUP BY 1, 2",
)
q(
    "path_weighted_cost",
    "MATCH (a:Nation {n_nationkey: 0})-[k:LINKED*WSHORTEST(w) 1..8]->(b:Nation) WHERE b <> a RETURN b.n_nationkey AS b, cost(k) AS c",
    f"{walks(1, 8)} SELECT e AS b, CAST(min(cost) AS DOUBLE) AS c FROM walks WHERE len >= 1 AND e <> 0 GROUP BY 1",
)
q(
    "path_nodes_props",
    "MATCH (a:Nation {n_nationkey: 3})-[k:LINKED*1..2]->(b:Nation) RETURN b.n_nationkey AS b, properties(nodes(k), 'n_nationkey')[0] AS first, size(properties(rels(k), 'w')) AS n",
    f"{walks(4, 2)} SELECT e AS b, nodes[1] AS first, CAST(len AS INTEGER) AS n FROM walks WHERE s = 3 AND len >= 1",
)
q(
    "path_is_trail_acyclic",
    "MATCH (a:Nation)-[k:LINKED*1..3]->(b:Nation) RETURN is_acyclic(k) AS a, count(*) AS cnt",
    f"{walks(25, 3)} SELECT len(list_distinct(nodes)) = len(nodes) AS a, count(*) AS cnt FROM walks WHERE len >= 1 GROUP BY 1",
)
q(
    "path_long_chain",
    "MATCH (u:User)-[:DID]->(e:Event)-[k:NEXT*1..5]->(f:Event) RETURN u.user_id AS u, length(k) AS len, count(*) AS cnt",
    f"WITH RECURSIVE {NEXT}, w(u, e, len) AS (SELECT user_id, event_id, 0 FROM events UNION ALL SELECT u, b, len + 1 FROM w JOIN nxt ON a = e WHERE len < 5) SELECT u, CAST(len AS BIGINT) AS len, count(*) AS cnt FROM w WHERE len >= 1 GROUP BY 1, 2",
)
q(
    "path_topk_shortest",
    "MATCH (a:Nation {n_nationkey: 0})-[k:LINKED*SHORTEST 1..6]->(b:Nation) WHERE b <> a RETURN b.n_nationkey AS b, length(k) AS len ORDER BY len, b LIMIT 6",
    f"{walks(1, 6)} SELECT e AS b, CAST(min(len) AS BIGINT) AS len FROM walks WHERE len >= 1 AND e <> 0 GROUP BY 1 ORDER BY len, b LIMIT 6",
)
q("named_path", "MATCH p = (a:Nation)-[e:LINKED]->(b:Nation)-[f:LINKED]->(c:Nation) RETURN length(p) AS len, is_acyclic(p) AS ac, count(*) AS cnt", f"{walks(25, 2)} SELECT CAST(2 AS BIGINT) AS len, len(list_distinct(nodes)) = 3 AS ac, count(*) AS cnt FROM walks WHERE len = 2 GROUP BY 2")

# ---- benchmark shapes

q(
    "lsqb_q1_like",
    "MATCH (:Region)<-[:IN_REGION]-(:Nation)<-[:IN_NATION]-(:Customer)-[:PLACED]->(:Orders)-[:CONTAINS]->(p:Part)<-[:SUPPLIES]-(s:Supplier)-[:IN_NATION]->(:Nation) RETURN count(*) AS cnt",
    "SELECT count(*) AS cnt FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem l ON l.l_orderkey = o_orderkey JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) x ON x.l_partkey = l.l_partkey",
)
q(
    "lsqb_q2_like",
    "MATCH (c:Customer)-[:PLACED]->(:Orders)-[:SHIPPED_BY]->(:Supplier)-[:IN_NATION]->(:Nation)<-[:IN_NATION]-(c) RETURN count(*) AS cnt",
    "SELECT count(*) AS cnt FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey",
)
q(
    "lsqb_q3_like",
    "MATCH (a:Nation)-[:LINKED]-(b:Nation)-[:LINKED]-(c:Nation)-[:LINKED]-(a), (a)-[:IN_REGION]->(r:Region), (b)-[:IN_REGION]->(r) RETURN count(*) AS cnt",
    f"WITH {LINKED}, u AS (SELECT n, m FROM linked UNION ALL SELECT m, n FROM linked) SELECT count(*) AS cnt FROM u x JOIN u y ON y.n = x.m JOIN u z ON z.n = y.m AND z.m = x.n JOIN nation a ON a.n_nationkey = x.n JOIN nation b ON b.n_nationkey = x.m AND a.n_regionkey = b.n_regionkey",
)
q(
    "lsqb_q4_like",
    "MATCH (o:Orders)-[:CONTAINS]->(:Part), (o)-[:SHIPPED_BY]->(:Supplier), (o)<-[:PLACED]-(:Customer) RETURN count(*) AS cnt",
    "SELECT count(*) AS cnt FROM orders JOIN lineitem a ON a.l_orderkey = o_orderkey JOIN lineitem b ON b.l_orderkey = o_orderkey",
)
q("lsqb_q5_like", "MATCH (p1:Part)<-[:CONTAINS]-(o:Orders)-[:CONTAINS]->(p2:Part) WHERE id(p1) <> id(p2) RETURN count(*) AS cnt", "SELECT count(*) AS cnt FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_partkey <> b.l_partkey")
q(
    "lsqb_q6_like",
    "MATCH (a:Nation)-[:LINKED]->(b:Nation)-[:LINKED]->(c:Nation)<-[:IN_NATION]-(x:Customer) WHERE id(a) <> id(c) RETURN count(*) AS cnt",
    f"WITH {LINKED} SELECT count(*) AS cnt FROM linked x JOIN linked y ON y.n = x.m JOIN customer ON c_nationkey = y.m WHERE x.n <> y.m",
)
q(
    "lsqb_q7_like",
    "MATCH (c:Customer)-[:IN_NATION]->(:Nation) OPTIONAL MATCH (c)-[:PLACED]->(o:Orders) OPTIONAL MATCH (o)-[:CONTAINS]->(:Part) RETURN count(*) AS cnt",
    "SELECT count(*) AS cnt FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey",
)
q(
    "lsqb_q8_like",
    "MATCH (s:Supplier)-[:SUPPLIES]->(p:Part)<-[:CONTAINS]-(o:Orders) WHERE NOT (o)-[:SHIPPED_BY]->(s) RETURN count(*) AS cnt",
    "SELECT count(*) AS cnt FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) x JOIN lineitem l ON l.l_partkey = x.l_partkey WHERE NOT EXISTS (SELECT 1 FROM lineitem y WHERE y.l_orderkey = l.l_orderkey AND y.l_suppkey = x.l_suppkey)",
)
q(
    "lsqb_q9_like",
    "MATCH (a:Nation)-[:LINKED]->(b:Nation)-[:LINKED]->(c:Nation)<-[:IN_NATION]-(x:Customer) WHERE NOT (a)-[:LINKED]->(c) AND id(a) <> id(c) RETURN count(*) AS cnt",
    f"WITH {LINKED} SELECT count(*) AS cnt FROM linked x JOIN linked y ON y.n = x.m JOIN customer ON c_nationkey = y.m WHERE x.n <> y.m AND NOT EXISTS (SELECT 1 FROM linked z WHERE z.n = x.n AND z.m = y.m)",
)
q(
    "ic1_like",
    "MATCH (a:Nation {n_nationkey: 4})-[k:LINKED*SHORTEST 1..3]->(b:Nation)<-[:IN_NATION]-(c:Customer) WHERE a <> b RETURN c.c_custkey AS c, length(k) AS d ORDER BY d, c LIMIT 20",
    f"{walks(5, 3)} SELECT c_custkey AS c, d FROM (SELECT e, CAST(min(len) AS BIGINT) AS d FROM walks WHERE s = 4 AND len >= 1 AND e <> 4 GROUP BY 1) JOIN customer ON c_nationkey = e ORDER BY d, c LIMIT 20",
)
q(
    "ic3_like",
    "MATCH (c:Customer)-[:PLACED]->(o:Orders)-[:SHIPPED_BY]->(s:Supplier)-[:IN_NATION]->(n:Nation) WHERE n.n_nationkey IN [1, 2] WITH c, n, count(*) AS cnt WITH c, sum(CASE WHEN n.n_nationkey = 1 THEN cnt ELSE 0 END) AS x, sum(CASE WHEN n.n_nationkey = 2 THEN cnt ELSE 0 END) AS y WHERE x > 0 AND y > 0 RETURN c.c_custkey AS c, x, y, x + y AS t ORDER BY t DESC, c LIMIT 20",
    "SELECT c, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(x + y AS BIGINT) AS t FROM (SELECT o_custkey AS c, sum((s_nationkey = 1)::INT) AS x, sum((s_nationkey = 2)::INT) AS y FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1) WHERE x > 0 AND y > 0 ORDER BY t DESC, c LIMIT 20",
)
q(
    "ic5_like",
    "MATCH (r:Region {r_regionkey: 1})<-[:IN_REGION]-(n:Nation) CALL (n) { MATCH (n)<-[:IN_NATION]-(c:Customer) RETURN 'customer' AS kind, c.c_custkey AS k, c.c_acctbal AS b ORDER BY b DESC, k LIMIT 5 UNION ALL MATCH (n)<-[:IN_NATION]-(s:Supplier) RETURN 'supplier' AS kind, s.s_suppkey AS k, s.s_acctbal AS b ORDER BY b DESC, k LIMIT 5 } RETURN kind, k, b ORDER BY b DESC, k",
    "SELECT * FROM (SELECT 'customer' AS kind, c_custkey AS k, c_acctbal AS b FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 ORDER BY b DESC, k LIMIT 5) UNION ALL SELECT * FROM (SELECT 'supplier', s_suppkey, s_acctbal AS b FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1 ORDER BY b DESC, s_suppkey LIMIT 5)",
)
q(
    "ic10_like",
    "MATCH (c:Customer)-[:PLACED]->(o:Orders) WHERE date_part('month', o.o_orderdate) = 5 AND NOT (c)-[:IN_NATION]->(:Nation {n_nationkey: 3}) RETURN c.c_custkey AS c, count(o) AS cnt",
    "SELECT c_custkey AS c, count(*) AS cnt FROM customer JOIN orders ON o_custkey = c_custkey WHERE month(o_orderdate) = 5 AND c_nationkey <> 3 GROUP BY 1",
)
q(
    "ic13_like",
    "MATCH (a:Nation {n_nationkey: 0}), (b:Nation {n_nationkey: 24}) OPTIONAL MATCH (a)-[k:LINKED*SHORTEST 1..10]->(b) RETURN CASE WHEN k IS NULL THEN -1 ELSE length(k) END AS len",
    f"{walks(1, 8)} SELECT CAST(coalesce(min(len), -1) AS BIGINT) AS len FROM walks WHERE e = 24 AND len >= 1",
)

# ---- a network that grows with the tables

REFERS = "refers(a, b, w, eid) AS (SELECT o_custkey, (SELECT min(c_custkey) FROM customer) + (o_orderkey * 7919 + o_custkey * 31) % (SELECT count(*) FROM customer), o_orderkey % 9 + 1, o_orderkey FROM orders)"
REACHED = "reached(e, len) AS (SELECT {start}, 0 UNION SELECT b, len + 1 FROM reached JOIN refers ON a = e WHERE len < {hi})"
q(
    "refers_between",
    "MATCH (a:Customer {c_custkey: 1}), (b:Customer) WHERE b.c_custkey % 50 = 7 MATCH (a)-[k:REFERS*SHORTEST 1..6]->(b) RETURN b.c_custkey AS b, length(k) AS len",
    f"WITH RECURSIVE {REFERS}, {REACHED.format(start=1, hi=6)} SELECT e AS b, CAST(min(len) AS BIGINT) AS len FROM reached JOIN customer ON c_custkey = e WHERE len >= 1 AND e % 50 = 7 GROUP BY 1",
)
q(
    "refers_nearest",
    "MATCH (a:Customer {c_custkey: 1})-[k:REFERS*SHORTEST 1..10]->(b:Customer) RETURN b.c_custkey AS b, length(k) AS len ORDER BY len, b LIMIT 12",
    f"WITH RECURSIVE {REFERS}, {REACHED.format(start=1, hi=10)} SELECT e AS b, CAST(min(len) AS BIGINT) AS len FROM reached JOIN customer ON c_custkey = e WHERE len >= 1 GROUP BY 1 ORDER BY len, b LIMIT 12",
)
q(
    "refers_all_shortest",
    "MATCH (a:Customer {c_custkey: 1})-[k:REFERS*ALL SHORTEST 1..3]->(b:Customer) RETURN length(k) AS len, count(*) AS cnt",
    f"WITH RECURSIVE {REFERS}, w(e, len) AS (SELECT 1, 0 UNION ALL SELECT b, len + 1 FROM w JOIN refers ON a = e WHERE len < 3), d AS (SELECT e, min(len) AS least FROM w JOIN customer ON c_custkey = e WHERE len >= 1 GROUP BY 1) SELECT CAST(len AS BIGINT) AS len, count(*) AS cnt FROM w JOIN d ON d.e = w.e AND least = len GROUP BY 1",
)
q(
    "refers_path_edges",
    "MATCH (a:Customer {c_custkey: 1}), (b:Customer) WHERE b.c_custkey % 40 = 3 MATCH (a)-[k:REFERS*ALL SHORTEST 1..4]->(b) RETURN b.c_custkey AS b, count(*) AS cnt, min(size(rels(k))) AS len",
    f"WITH RECURSIVE {REFERS}, w(e, len) AS (SELECT 1, 0 UNION ALL SELECT b, len + 1 FROM w JOIN refers ON a = e WHERE len < 4), d AS (SELECT e, min(len) AS least FROM w JOIN customer ON c_custkey = e WHERE len >= 1 AND e % 40 = 3 GROUP BY 1) SELECT w.e AS b, count(*) AS cnt, CAST(min(len) AS INTEGER) AS len FROM w JOIN d ON d.e = w.e AND least = len GROUP BY 1",
)
q(
    "refers_triangles",
    "MATCH (a:Customer)-[:REFERS]->(b:Customer)-[:REFERS]->(c:Customer)-[:REFERS]->(a) RETURN count(*) AS cnt",
    f"WITH {REFERS}, r AS (SELECT a, b FROM refers JOIN customer ON c_custkey = b) SELECT count(*) AS cnt FROM r x JOIN r y ON y.a = x.b JOIN r z ON z.a = y.b AND z.b = x.a",
)
q(
    "refers_trail",
    "MATCH (a:Customer {c_custkey: 1})-[k:REFERS*TRAIL 1..3]->(b:Customer) RETURN length(k) AS len, count(*) AS cnt",
    f"WITH RECURSIVE {REFERS}, w(e, len, seen) AS (SELECT 1, 0, CAST([] AS BIGINT[]) UNION ALL SELECT b, len + 1, list_append(seen, eid) FROM w JOIN refers ON a = e WHERE len < 3 AND NOT list_contains(seen, eid)) SELECT CAST(len AS BIGINT) AS len, count(*) AS cnt FROM w JOIN customer ON c_custkey = e WHERE len >= 1 GROUP BY 1",
)

# ---- paths and predicates of further forms

q(
    "named_path_long",
    "MATCH p = (a:Nation)-[:LINKED*1..2]->(b:Nation)-[:LINKED]->(c:Nation) RETURN length(p) AS len, is_acyclic(p) AS ac, count(*) AS cnt",
    f"{walks(25, 3)} SELECT CAST(len AS BIGINT) AS len, len(list_distinct(nodes)) = len + 1 AS ac, count(*) AS cnt FROM walks WHERE len >= 2 GROUP BY 1, 2",
)
q(
    "path_pred_both",
    "MATCH (a:Nation)-[k:LINKED*2..3 (r, n | WHERE r.w + n.n_regionkey > 6)]->(b:Nation) RETURN length(k) AS len, count(*) AS cnt",
    f"WITH RECURSIVE {LINKED}, w(e, len) AS (SELECT m, 1 FROM linked UNION ALL SELECT y.m, 2 FROM linked x JOIN nation ON n_nationkey = x.m JOIN linked y ON y.n = x.m WHERE x.w + n_regionkey > 6) SELECT CAST(2 AS BIGINT) AS len, count(*) AS cnt FROM w WHERE len = 2 UNION ALL SELECT 3, count(*) FROM linked x JOIN nation p ON p.n_nationkey = x.m JOIN linked y ON y.n = x.m JOIN nation s ON s.n_nationkey = y.m JOIN linked z ON z.n = y.m WHERE x.w + p.n_regionkey > 6 AND y.w + s.n_regionkey > 6",
)
q(
    "path_all_weighted",
    "MATCH (a:Nation {n_nationkey: 0})-[k:LINKED*ALL WSHORTEST(w) 1..4]->(b:Nation) RETURN b.n_nationkey AS b, cost(k) AS cost, count(*) AS cnt",
    f"{walks(1, 4)}, d AS (SELECT e, min(cost) AS least FROM walks WHERE len >= 1 GROUP BY 1) SELECT walks.e AS b, CAST(least AS DOUBLE) AS cost, count(*) AS cnt FROM walks JOIN d ON d.e = walks.e AND cost = least WHERE len >= 1 AND walks.e <> 0 GROUP BY 1, 2",
)
q("exists_alone", "MATCH (r:Region) WHERE EXISTS { MATCH (n:Nation) WHERE n.n_nationkey = 3 } AND NOT EXISTS { MATCH (n:Nation) WHERE n.n_nationkey < 0 } RETURN r.r_name AS r", "SELECT r_name AS r FROM region")
q("exists_alone_marked", "MATCH (r:Region) RETURN r.r_name AS r, COUNT { MATCH (n:Nation)-[:LINKED]->(n) } AS loops, EXISTS { MATCH (n:Nation {n_nationkey: 99}) } AS none", f"WITH {LINKED} SELECT r_name AS r, (SELECT count(*) FROM linked WHERE n = m) AS loops, false AS none FROM region")
q(
    "interval_mixed",
    "MATCH (o:Orders) WHERE INTERVAL('40 days') > INTERVAL('1 month') AND INTERVAL('1 year') + INTERVAL('3 days') > INTERVAL('12 months') RETURN o.o_orderkey AS o, o.o_orderdate + (INTERVAL('1 year') + INTERVAL('3 days')) AS d",
    "SELECT o_orderkey AS o, o_orderdate + INTERVAL 12 MONTH + INTERVAL 3 DAY AS d FROM orders",
)
q("struct_extract", "MATCH (n:Nation) RETURN struct_extract({k: n.n_nationkey, name: n.n_name}, 'name') AS name", "SELECT n_name AS name FROM nation")


def _run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return database(spark, sf_dir).connect().execute(Q[name][0], parameters=PARAMS.get(name)).df

    run.__name__ = name
    return run


QUERIES = {name: _run(name) for name in Q}
ORACLE_SQL = {name: sql for name, (_, sql) in Q.items() if sql}
