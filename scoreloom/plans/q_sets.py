"""Sorting, limits and set operations."""

from pyspark.sql import functions as F

from scoreloom.operators import sets as S
from scoreloom.operators.aggregates import system_summary
from scoreloom.plans.q_aggregates import r6
from scoreloom.plans.registry import query


@query("top_by", """SELECT condition, round(avg(score), 6) AS mean, count(*) AS n FROM ratings GROUP BY 1 ORDER BY avg(score) DESC, condition LIMIT 4""",
       ["ratings"])
def top_by(t):
    return r6(S.top_by(system_summary(t.ratings()), "mean", 4, ["condition"]).select("condition", "mean", "n"), "mean")


@query("common_songs", """SELECT o_custkey AS song FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT o_custkey FROM orders
    WHERE o_orderpriority = '5-LOW' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '2-HIGH' INTERSECT SELECT o_custkey FROM orders
    WHERE o_orderpriority = '3-MEDIUM' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED'""")
def common_songs(t):
    a = t.arms()
    return S.common_songs([a.where(F.col("run") == r) for r in ("1-URGENT", "5-LOW", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")], "song")


@query("union_listeners", """SELECT l_suppkey AS id FROM lineitem UNION SELECT s_suppkey FROM supplier UNION SELECT user_id FROM events
    UNION SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer""")
def union_listeners(t):
    return S.union_listeners([t.lineitem.select(F.col("l_suppkey").alias("id")), t.supplier.select(F.col("s_suppkey").alias("id")),
                              t.events.select(F.col("user_id").alias("id")), t.orders.select(F.col("o_custkey").alias("id")),
                              t.customer.select(F.col("c_custkey").alias("id"))], "id")


@query("only_in", """WITH a AS (SELECT DISTINCT song FROM arms WHERE run = '1-URGENT'), b AS (SELECT DISTINCT song FROM arms WHERE run = '5-LOW')
    SELECT song, 'a' AS side FROM a WHERE song NOT IN (SELECT song FROM b) UNION ALL SELECT song, 'b' FROM b WHERE song NOT IN (SELECT song FROM a)""",
       ["arms"])
def only_in(t):
    a = t.arms()
    return S.only_in(a.where("run = '1-URGENT'"), a.where("run = '5-LOW'"), "song")


@query("nested_subset", """SELECT 'buyers' AS pair, count(*) = 0 AS nested, count(*) AS n_outside FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)
    UNION ALL SELECT 'customers', count(*) = 0, count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)""")
def nested_subset(t):
    o, c = t.orders.select(F.col("o_custkey").alias("id")), t.customer.select(F.col("c_custkey").alias("id"))
    return S.nested_subset(o, c, "id").select(F.lit("buyers").alias("pair"), "nested", "n_outside").unionByName(
        S.nested_subset(c, o, "id").select(F.lit("customers").alias("pair"), "nested", "n_outside"))
