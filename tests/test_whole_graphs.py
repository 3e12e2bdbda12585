"""Registered graph queries meet all rows of their tables."""

import json

from pyspark.sql import functions as F

from provgraph import queries
from provgraph.sources import relational


def test_transitions_have_no_time_limit(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 7, "a"), (2, "2024-01-01 09:00:00", 7, "b"), (3, "2024-02-01 09:00:00", 7, "c"), (4, "2024-02-01 09:10:00", 7, "c"), (5, "2024-02-01 10:00:00", 8, "d")]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "events.parquet"))
    edges = {(r.arg1, r.arg2) for r in relational.transition_graph(spark, str(tmp_path)).edges.collect()}
    assert edges == {("type:b:9", "type:a:0"), ("type:c:9", "type:b:9")}


def test_json_export_has_the_order_graph(spark, sf):
    orders, lines = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("orders", "lineitem"))
    got = queries.QUERIES["json_export"](spark, sf)
    count = {r.section: r["count"] for r in got.groupBy("section").count().collect()}
    assert count["activity"] == orders.count() and count["wasGeneratedBy"] == lines.select("l_orderkey", "l_linenumber").distinct().count()
    one = orders.orderBy("o_orderkey").first()
    record = json.loads(got.filter(F.col("id") == f"order:{one.o_orderkey}").first().record)
    assert record["prov:startTime"] == one.o_orderdate.strftime("%Y-%m-%dT%H:%M:%S") and one.o_orderpriority in json.dumps(record)


def test_provn_export_has_orders_and_items(spark, sf):
    orders, lines = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("orders", "lineitem"))
    got = queries.QUERIES["provn_export"](spark, sf).cache()
    assert got.filter("record LIKE 'activity(order:%'").count() == orders.count()
    assert got.filter("record LIKE 'entity(item:%'").count() == lines.select("l_orderkey", "l_linenumber").distinct().count()
    g = relational.order_graph(spark, sf)
    assert got.count() == g.nodes.count() + g.edges.count()
    one = orders.orderBy("o_orderkey").first()
    record = got.filter(F.col("record").startswith(f"activity(order:{one.o_orderkey},")).first().record
    assert one.o_orderdate.strftime("%Y-%m-%dT%H:%M:%S") in record and f'"{one.o_orderpriority}"' in record
