"""Which big open orders get funded first, by nation: every family of operators in one question."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.operators.filters import criteria, top_n
from quarrylens.operators.joins import attribute_join
from quarrylens.operators.score import allocate, score
from quarrylens.operators.summarise import summarise
from quarrylens.queries.inputs import rounded, table


def flagship(spark, sf):
    orders = table(spark, sf, "orders").withColumn("cost", F.floor("o_totalprice").cast("double"))
    o = attribute_join(orders, table(spark, sf, "customer"), "o_custkey", "c_custkey", "inner")
    o = attribute_join(o, table(spark, sf, "nation"), "r_c_nationkey", "n_nationkey", "inner")
    o = o.select("o_orderkey", "o_orderstatus", "cost", F.col("r_c_acctbal").alias("balance"), F.col("r_n_name").alias("nation"))
    good = criteria(o, [{"label": "open", "expression": "o_orderstatus = 'O'"}, {"label": "big", "expression": "cost > 50000"}], "drop")
    scored = score(good, [{"field": "cost", "weight": 2}, {"field": "balance", "weight": 1}])
    first = top_n(scored, "score", 500)
    funded = allocate(first, "cost", 2e7, "score", ["o_orderkey"])
    return rounded(summarise(funded, ["nation", "cost_status"], [{"fn": "count", "alias": "orders"}, {"fn": "sum", "field": "cost", "alias": "cost"}, {"fn": "avg", "field": "score", "alias": "score"}]), 4)


SQL = """
WITH g AS (SELECT o_orderkey, floor(o_totalprice) AS cost, c_acctbal AS balance, n_name AS nation FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'O' AND floor(o_totalprice) > 50000),
s AS (SELECT *, 2 / 3.0::DOUBLE * ((cost - min(cost) OVER ()) / (max(cost) OVER () - min(cost) OVER ())) + 1 / 3.0::DOUBLE * ((balance - min(balance) OVER ()) / (max(balance) OVER () - min(balance) OVER ())) AS score FROM g),
t AS (SELECT * FROM (SELECT *, rank() OVER (ORDER BY score DESC) AS r FROM s) WHERE r <= 500),
c AS (SELECT *, sum(cost) OVER (ORDER BY score DESC, o_orderkey ROWS UNBOUNDED PRECEDING) AS cum FROM t)
SELECT nation, CASE WHEN cum <= 2e7 THEN 'within' ELSE 'over' END AS cost_status, count(*) AS orders, round(sum(cost), 4) AS cost, round(avg(score), 4) AS score FROM c GROUP BY 1, 2
"""

QUERIES = {"flagship": (flagship, SQL)}
