"""The relational surface that a read-only query may use, over the star schema.

Each feature is one SQL text given to both engines through the gate, or a DataFrame plan beside its SQL.
"""

from pyspark.sql import functions as F

from quern.plans.gate import Gate
from quern.queries.base import TABLES, query, register
from quern.sources.catalog import namespace


def through_gate(sql: str):
    def run(t):
        views = namespace(t.spark, t.sf_dir, TABLES)
        return Gate(t.spark, views).dataframe(sql)

    return run


FEATURES = {
    "r1_filter": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'R') AND NOT l_linestatus = 'F' AND l_shipdate IS NOT NULL",
    "r2_inner_join": "SELECT o.o_orderkey, c.c_name, n.n_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE o.o_totalprice > 100000",
    "r2_self_join": "SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "r2_cross_join": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "r3_left_join": "SELECT c.c_custkey, count(o.o_orderkey) AS orders FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey",
    "r4_exists": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 150000)",
    "r4_not_exists": "SELECT p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 45)",
    "r5_theta_join": "SELECT a.s_suppkey, count(*) AS richer FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND b.s_acctbal > a.s_acctbal GROUP BY a.s_suppkey",
    "r6_aggregates": "SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, round(sum(l_quantity), 2) AS quantity, min(l_shipdate) AS first_ship, max(l_extendedprice) AS top_price, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10",
    "r7_distinct": "SELECT DISTINCT p_brand, p_size FROM part",
    "r8_grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "r8_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "r8_rollup": "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)",
    "r9_window": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders",
    "r10_order_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 10",
    "r11_union": "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier",
    "r11_union_all": "SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "r11_intersect": "SELECT l_suppkey AS suppkey FROM lineitem WHERE l_quantity > 49 INTERSECT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0",
    "r11_except": "SELECT c_custkey AS custkey FROM customer EXCEPT SELECT o_custkey FROM orders",
    "r12_cte": "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), top AS (SELECT o_custkey FROM big WHERE total > 500000) SELECT c_custkey, c_name FROM customer JOIN top ON c_custkey = o_custkey",
    "r13_recursive_cte": "WITH RECURSIVE s(k, depth, path) AS (SELECT n_nationkey, 0, CAST(n_name AS STRING) FROM nation WHERE n_nationkey < 4 UNION ALL SELECT n.n_nationkey, s.depth + 1, concat(s.path, '/', n.n_name) FROM s JOIN nation n ON n.n_nationkey = s.k + 4) SELECT k, depth, path FROM s",
    "r14_scalar_subquery": "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > (SELECT avg(s_acctbal) FROM supplier)",
    "r14_correlated_subquery": "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "r14_derived_table": "SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) x GROUP BY n",
    "r15_cast": "SELECT p_partkey, CAST(p_size AS VARCHAR(10)) AS size_text, CAST(p_retailprice AS BIGINT) AS whole, CAST('42' AS INT) AS answer FROM part WHERE p_retailprice = floor(p_retailprice)",
    "r16_functions": "SELECT c_custkey, upper(c_mktsegment) AS segment, substr(c_name, 1, 8) AS head, length(c_name) AS n, replace(c_name, '#', '-') AS renamed, abs(c_acctbal) AS size, round(c_acctbal, 1) AS rounded, coalesce(nullif(c_nationkey, 3), -1) AS nation, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'fine' END AS state, trim(concat(' ', c_mktsegment, ' ')) AS trimmed FROM customer",
    "r16_dates": "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY year(o_orderdate), month(o_orderdate)",
    "r18_identifier_case": "SELECT N_Name AS name, n_NATIONKEY AS number FROM Nation WHERE N_NATIONKEY > 10",
}
for _name, _sql in FEATURES.items():
    register(_name, through_gate(_sql), _sql)


@query("SELECT n_name FROM nation WHERE lower(n_name) = lower('FRANCE') OR lower(n_name) LIKE 'nation%'")
def r15_collation(t):
    """Case-blind comparison by collation."""
    c = F.collate(F.col("n_name"), "UTF8_LCASE")
    return t("nation").where((c == F.lit("FRANCE")) | c.startswith("nation")).select("n_name")


@query("SELECT n_nationkey, 'ANY' AS label FROM nation WHERE 'it''s' = 'it''s'")
def r17_double_quoted_string(t):
    """In the default dialect a double-quoted word is a string."""
    views = namespace(t.spark, t.sf_dir, TABLES)
    return Gate(t.spark, views).dataframe("""SELECT n_nationkey, "ANY" AS label FROM nation WHERE "it's" = 'it''s'""")


@query("""SELECT json_extract_string(props, '$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1""")
def r16_json(t):
    return t("events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
 round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def r6_pricing_summary(t):
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    rows = t("lineitem").where(F.col("l_shipdate") <= F.to_timestamp(F.lit("1998-09-02")))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(price), 2).alias("sum_disc"),
        F.round(F.sum(price * (1 + F.col("l_tax"))), 2).alias("sum_charge"), F.count(F.lit(1)).alias("n"),
    )


ASOF = """SELECT a.event_id, b.event_id AS purchase_id FROM events a ASOF JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY ALL) b ON a.user_id = b.user_id AND a.ts >= b.ts"""


@query(ASOF)
def r5_as_of_join(t):
    """Each event with its user's latest purchase so far: one window over the union, no range join."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    bought = F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id"))
    return t("events").withColumn("p", F.max(bought).over(w)).where("p is not null").select("event_id", F.col("p.event_id").alias("purchase_id"))
