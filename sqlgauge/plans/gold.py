"""Gold-query corpus over the test tables: one query per SQL construct.

Every entry names a construct the benchmarked SQL may use; its gold query
runs through the batch executor and the oracle runs the same question in
DuckDB (``duck`` when the dialects differ).  ``alt`` is an equivalent
rewrite (other column aliases, row order or predicate form) and ``wrong`` a
near miss; the replayed model answers are built from them.

All queries read whole tables.  Money is summed as decimals, so that no verdict
depends on the order in which partitions add up.  Counts and sums are cast to
BIGINT or DOUBLE, doubles rounded, window ranks cast to BIGINT, so both engines
give the same types.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Gold:
    key: str
    question: str
    sql: str
    alt: str
    wrong: str
    duck: str | None = None       # DuckDB form when Spark's differs
    duck_alt: str | None = None
    duck_wrong: str | None = None

    def oracle(self, which: str = "sql") -> str:
        if which == "sql":
            return self.duck or self.sql
        if which == "alt":
            return self.duck_alt or self.alt
        return self.duck_wrong or self.wrong


GOLD: list[Gold] = [
    Gold("scan", "Show every order.",
         "SELECT * FROM orders",
         "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority "
         "FROM orders ORDER BY o_orderkey DESC",
         "SELECT * FROM orders WHERE o_orderstatus = 'F'"),
    Gold("project", "List each order key with its price and status.",
         "SELECT o_orderkey, o_totalprice AS price, o_orderstatus AS status FROM orders",
         "SELECT o.o_orderkey, o.o_totalprice, o.o_orderstatus FROM orders o",
         "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"),
    Gold("filter", "Which line items shipped from 1997 on have a quantity above 45?",
         "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem "
         "WHERE l_quantity > 45 AND l_shipdate >= DATE '1997-01-01'",
         "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem "
         "WHERE NOT (l_quantity <= 45) AND l_shipdate >= DATE '1997-01-01'",
         "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem "
         "WHERE l_quantity >= 45 AND l_shipdate >= DATE '1997-01-01'"),
    Gold("predicates", "Automobile customers outside nations 1-3 whose name does not end in 7.",
         "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment LIKE 'AUTO%' "
         "AND c_name NOT LIKE '%7' AND c_nationkey NOT IN (1, 2, 3)",
         "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'AUTOMOBILE' "
         "AND NOT c_name LIKE '%7' AND c_nationkey NOT IN (3, 2, 1)",
         "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment LIKE 'AUTO%' "
         "AND c_nationkey NOT IN (1, 2, 3)"),
    Gold("distinct", "Which return flag and line status pairs occur?",
         "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
         "SELECT l_returnflag, l_linestatus FROM lineitem GROUP BY l_returnflag, l_linestatus",
         "SELECT l_returnflag, l_linestatus FROM lineitem"),
    Gold("join", "Name the customer and nation of every order.",
         "SELECT c.c_name, o.o_orderkey, n.n_name FROM orders o "
         "JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey",
         "SELECT c.c_name, o.o_orderkey, n.n_name FROM nation n "
         "JOIN customer c ON c.c_nationkey = n.n_nationkey JOIN orders o ON o.o_custkey = c.c_custkey",
         "SELECT c.c_name, o.o_orderkey, n.n_name FROM orders o "
         "JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_custkey = n.n_nationkey"),
    Gold("outer_join", "List every nation with its region and suppliers, if any.",
         "SELECT r.r_name, n.n_name, s.s_name FROM supplier s "
         "RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey "
         "LEFT JOIN region r ON n.n_regionkey = r.r_regionkey",
         "SELECT r.r_name, n.n_name, s.s_name FROM nation n "
         "LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey "
         "LEFT JOIN region r ON r.r_regionkey = n.n_regionkey",
         "SELECT r.r_name, n.n_name, s.s_name FROM supplier s "
         "JOIN nation n ON s.s_nationkey = n.n_nationkey "
         "JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_regionkey < 4"),
    Gold("comma_join", "Which line items are for parts larger than size 45?",
         "SELECT p.p_name, l.l_orderkey, l.l_quantity FROM part p, lineitem l "
         "WHERE p.p_partkey = l.l_partkey AND p.p_size > 45",
         "SELECT p.p_name, l.l_orderkey, l.l_quantity FROM lineitem l JOIN part p "
         "ON p.p_partkey = l.l_partkey WHERE p.p_size >= 46",
         "SELECT p.p_name, l.l_orderkey, l.l_quantity FROM part p, lineitem l "
         "WHERE p.p_partkey = l.l_suppkey AND p.p_size > 45"),
    Gold("lateral", "Split every order priority into its parts, with positions.",
         "SELECT o.o_orderkey, t.pos, t.part FROM orders o "
         "LATERAL VIEW posexplode(split(o.o_orderpriority, '-')) t AS pos, part",
         "SELECT o_orderkey, pos, part AS piece FROM orders "
         "LATERAL VIEW posexplode(split(o_orderpriority, '-')) x AS pos, part",
         "SELECT o.o_orderkey, t.pos, t.part FROM orders o "
         "LATERAL VIEW posexplode(split(o.o_orderpriority, '-')) t AS pos, part WHERE t.pos > 0",
         duck="SELECT o_orderkey, CAST(generate_subscripts(string_split(o_orderpriority, '-'), 1) - 1 "
              "AS INTEGER) AS pos, unnest(string_split(o_orderpriority, '-')) AS part FROM orders",
         duck_alt="SELECT o_orderkey, CAST(generate_subscripts(string_split(o_orderpriority, '-'), 1) - 1 "
                  "AS INTEGER) AS pos, unnest(string_split(o_orderpriority, '-')) AS piece FROM orders",
         duck_wrong="SELECT * FROM (SELECT o_orderkey, CAST(generate_subscripts(string_split(o_orderpriority, "
                    "'-'), 1) - 1 AS INTEGER) AS pos, unnest(string_split(o_orderpriority, '-')) AS part "
                    "FROM orders) u WHERE pos > 0"),
    Gold("exists", "Customers in region 1 with at least one urgent order.",
         "SELECT c.c_custkey, c.c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o "
         "WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT') "
         "AND c.c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
         "SELECT DISTINCT c.c_custkey, c.c_name FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey "
         "JOIN nation n ON n.n_nationkey = c.c_nationkey "
         "WHERE o.o_orderpriority = '1-URGENT' AND n.n_regionkey = 1",
         "SELECT c.c_custkey, c.c_name FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey "
         "JOIN nation n ON n.n_nationkey = c.c_nationkey "
         "WHERE o.o_orderpriority = '1-URGENT' AND n.n_regionkey = 1"),
    Gold("aggregate", "Line item count, total quantity, mean price, first ship date and top discount.",
         "SELECT count(*) AS n_rows, CAST(sum(l_quantity) AS BIGINT) AS sum_qty, "
         "round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) / count(*), 2) AS avg_price, min(l_shipdate) AS first_ship, "
         "max(l_discount) AS max_discount FROM lineitem",
         "SELECT count(l_orderkey), CAST(sum(l_quantity) AS BIGINT), "
         "round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) / count(l_orderkey), 2), "
         "min(l_shipdate), max(l_discount) FROM lineitem",
         "SELECT count(DISTINCT l_orderkey), CAST(sum(l_quantity) AS BIGINT), "
         "round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) / count(*), 2), "
         "min(l_shipdate), max(l_discount) FROM lineitem"),
    Gold("string_agg", "For each order, its line numbers in order, comma separated.",
         "SELECT l_orderkey, string_agg(CAST(l_linenumber AS STRING), ',') "
         "WITHIN GROUP (ORDER BY l_linenumber) AS lines FROM lineitem GROUP BY l_orderkey",
         "SELECT l_orderkey, array_join(array_sort(collect_list(CAST(l_linenumber AS STRING))), ',') "
         "FROM lineitem GROUP BY l_orderkey",
         "SELECT l_orderkey, string_agg(CAST(l_linenumber AS STRING), ',') "
         "WITHIN GROUP (ORDER BY l_linenumber DESC) AS lines FROM lineitem GROUP BY l_orderkey",
         duck="SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) "
              "AS lines FROM lineitem GROUP BY l_orderkey",
         duck_alt="SELECT l_orderkey, array_to_string(list_sort(list(CAST(l_linenumber AS VARCHAR))), ',') "
                  "FROM lineitem GROUP BY l_orderkey",
         duck_wrong="SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber DESC) "
                    "AS lines FROM lineitem GROUP BY l_orderkey"),
    Gold("having", "Customers with more than 12 orders: order count and total spend.",
         "SELECT o_custkey, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM orders "
         "GROUP BY o_custkey HAVING count(*) > 12",
         "SELECT o_custkey, count(o_orderkey) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS s FROM orders "
         "GROUP BY o_custkey HAVING count(o_orderkey) >= 13",
         "SELECT o_custkey, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM orders "
         "GROUP BY o_custkey HAVING count(*) > 10"),
    Gold("scalar_subquery", "Parts priced above the average part price.",
         "SELECT p_partkey, p_name, p_retailprice FROM part "
         "WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)",
         "SELECT p.p_partkey, p.p_name, p.p_retailprice FROM part p "
         "WHERE p.p_retailprice > (SELECT sum(p_retailprice) / count(*) FROM part)",
         "SELECT p_partkey, p_name, p_retailprice FROM part "
         "WHERE p_retailprice > (SELECT min(p_retailprice) FROM part)"),
    Gold("correlated", "Orders priced above their customer's average order.",
         "SELECT o.o_orderkey, o.o_custkey, o.o_totalprice FROM orders o WHERE o.o_totalprice > "
         "(SELECT avg(o2.o_totalprice) FROM orders o2 WHERE o2.o_custkey = o.o_custkey)",
         "SELECT o.o_orderkey, o.o_custkey, o.o_totalprice FROM orders o JOIN "
         "(SELECT o_custkey, avg(o_totalprice) AS a FROM orders GROUP BY o_custkey) m "
         "ON m.o_custkey = o.o_custkey WHERE o.o_totalprice > m.a",
         "SELECT o.o_orderkey, o.o_custkey, o.o_totalprice FROM orders o WHERE o.o_totalprice > "
         "(SELECT avg(o2.o_totalprice) FROM orders o2)"),
    Gold("setops", "Nation keys: union, intersection and bag difference of customers and suppliers.",
         "SELECT 'union' AS op, k FROM (SELECT c_nationkey AS k FROM customer UNION "
         "SELECT s_nationkey FROM supplier) u UNION ALL SELECT 'intersect', k FROM "
         "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) i "
         "UNION ALL SELECT 'except_all', k FROM (SELECT c_nationkey AS k FROM customer "
         "EXCEPT ALL SELECT s_nationkey FROM supplier) e",
         "SELECT 'union' AS op, k FROM (SELECT DISTINCT c_nationkey AS k FROM customer UNION "
         "SELECT DISTINCT s_nationkey FROM supplier) u UNION ALL SELECT 'intersect', k FROM "
         "(SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer) i "
         "UNION ALL SELECT 'except_all', k FROM (SELECT c_nationkey AS k FROM customer "
         "EXCEPT ALL SELECT s_nationkey FROM supplier) e",
         "SELECT 'union' AS op, k FROM (SELECT c_nationkey AS k FROM customer UNION "
         "SELECT s_nationkey FROM supplier) u UNION ALL SELECT 'intersect', k FROM "
         "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) i "
         "UNION ALL SELECT 'except_all', k FROM (SELECT c_nationkey AS k FROM customer "
         "EXCEPT SELECT s_nationkey FROM supplier) e"),
    Gold("rank", "Rank each customer's orders by price, highest first.",
         "SELECT o_custkey, o_orderkey, o_totalprice, CAST(rank() OVER (PARTITION BY o_custkey "
         "ORDER BY o_totalprice DESC) AS BIGINT) AS rnk FROM orders",
         "SELECT o_custkey, o_orderkey, o_totalprice, CAST(rank() OVER (PARTITION BY o_custkey "
         "ORDER BY -o_totalprice) AS BIGINT) AS r FROM orders",
         "SELECT o_custkey, o_orderkey, o_totalprice, CAST(rank() OVER (PARTITION BY o_custkey "
         "ORDER BY o_totalprice) AS BIGINT) AS rnk FROM orders"),
    Gold("window_frames", "Per customer in date order: row number, status rank, neighbours and running total.",
         "SELECT o_orderkey, o_custkey, CAST(row_number() OVER w AS BIGINT) AS rn, "
         "CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS BIGINT) AS drank, "
         "lag(o_orderkey) OVER w AS prev_key, lead(o_orderkey) OVER w AS next_key, "
         "round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey "
         "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running_total FROM orders "
         "WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
         "SELECT o_orderkey, o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT), "
         "CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS BIGINT), "
         "lag(o_orderkey, 1) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), "
         "lead(o_orderkey, 1) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), "
         "round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey "
         "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) FROM orders",
         "SELECT o_orderkey, o_custkey, CAST(row_number() OVER w AS BIGINT) AS rn, "
         "CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS BIGINT) AS drank, "
         "lag(o_orderkey) OVER w AS prev_key, lead(o_orderkey) OVER w AS next_key, "
         "round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS running_total FROM orders "
         "WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"),
    Gold("cte", "Customers whose total spend exceeds 3,000,000.",
         "WITH spend AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS total FROM orders GROUP BY o_custkey) "
         "SELECT c.c_name, CAST(s.total AS DOUBLE) AS total FROM spend s JOIN customer c "
         "ON c.c_custkey = s.o_custkey WHERE s.total > 3000000",
         "SELECT c.c_name, CAST(sum(CAST(o.o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) FROM customer c JOIN orders o "
         "ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey, c.c_name HAVING sum(CAST(o.o_totalprice AS DECIMAL(18, 2))) > 3000000",
         "WITH spend AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS total FROM orders GROUP BY o_custkey) "
         "SELECT c.c_name, CAST(s.total AS DOUBLE) AS total FROM spend s JOIN customer c "
         "ON c.c_custkey = s.o_custkey WHERE s.total > 300000"),
    Gold("deep", "Nations with a customer who placed an order above 450,000.",
         "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer "
         "WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000))",
         "SELECT DISTINCT n.n_name FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey "
         "JOIN orders o ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 450000",
         "SELECT n.n_name FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey "
         "JOIN orders o ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 450000"),
    Gold("topk", "The 20 most expensive orders.",
         "SELECT o_orderkey, o_custkey, o_totalprice FROM orders "
         "ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
         "SELECT o_orderkey, o_custkey, o_totalprice FROM (SELECT *, row_number() OVER "
         "(ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) t WHERE r <= 20",
         "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice LIMIT 20"),
]

GOLD_BY_KEY = {g.key: g for g in GOLD}
