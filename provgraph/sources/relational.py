"""Provenance graphs from relational tables.

``order_graph``: orders are main activities that generate items and use parts; customers and
suppliers are receiving and sending agents, acting for their nation and region.
``activity_graph``: events of a user inform one another in time order, and turns of a
conversation derive from one another and are attributed to their role; copies of a document are
alternates of the first. ``transition_graph``: how event types follow each other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import ProvGraph
from .build import all_of, attr_rows, edge_rows, graph_from, id_of, node_rows


def _table(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_graph(spark: SparkSession, sf_dir: str) -> ProvGraph:
    """Ids are unique by construction: items by (order, line), of repeated lines the first by the other columns."""
    t = _table(spark, sf_dir)
    orders, lines = t("orders"), t("lineitem")
    line_id = id_of("item", "l_orderkey", "l_linenumber")
    order_of_line, part_of_line, supp_of_line = id_of("order", "l_orderkey"), id_of("part", "l_partkey"), id_of("supp", "l_suppkey")
    shipped = lines.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
    done = orders.join(shipped, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    # of the lines under one number the least (part, supplier, ship date, price) is the item; its part and supplier are the least pair
    least = lambda *columns: lines.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct(*columns)).alias("x")).select("l_orderkey", "l_linenumber", "x.*")
    items, full_items = least("l_partkey", "l_suppkey"), least("l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    nodes = all_of(
        node_rows(done, "bundle:orders", id_of("order", "o_orderkey"), "activity", "cpm:MainActivity", start=F.col("o_orderdate"), end=F.col("shipped"), ordinal=F.col("o_orderkey")),
        node_rows(items, "bundle:orders", line_id, "entity", ordinal=F.col("l_orderkey")),
        node_rows(t("part"), "bundle:parts", id_of("part", "p_partkey"), "entity", "cpm:BackwardConnector", ordinal=F.col("p_partkey")),
        node_rows(t("customer"), "bundle:agents", id_of("cust", "c_custkey"), "agent", "cpm:ReceiverAgent", ordinal=F.col("c_custkey")),
        node_rows(t("supplier"), "bundle:agents", id_of("supp", "s_suppkey"), "agent", "cpm:SenderAgent", ordinal=F.col("s_suppkey")),
        node_rows(t("nation"), "bundle:agents", id_of("nation", "n_nationkey"), "agent", ordinal=F.col("n_nationkey")),
        node_rows(t("region"), "bundle:agents", id_of("region", "r_regionkey"), "agent", ordinal=F.col("r_regionkey")),
    )
    edges = all_of(
        edge_rows(items, "bundle:orders", "generation", line_id, order_of_line),
        edge_rows(items, "bundle:orders", "derivation", line_id, part_of_line),
        edge_rows(items, "bundle:orders", "attribution", line_id, supp_of_line),
        edge_rows(items.select("l_orderkey", "l_partkey").distinct(), "bundle:orders", "usage", order_of_line, part_of_line),
        edge_rows(orders, "bundle:orders", "association", id_of("order", "o_orderkey"), id_of("cust", "o_custkey")),
        edge_rows(t("customer"), "bundle:agents", "delegation", id_of("cust", "c_custkey"), id_of("nation", "c_nationkey")),
        edge_rows(t("supplier"), "bundle:agents", "delegation", id_of("supp", "s_suppkey"), id_of("nation", "s_nationkey")),
        edge_rows(t("nation"), "bundle:agents", "delegation", id_of("nation", "n_nationkey"), id_of("region", "n_regionkey")),
    )
    attrs = all_of(
        attr_rows(orders, id_of("order", "o_orderkey"), priority="o_orderpriority", status="o_orderstatus"),
        attr_rows(full_items, line_id, quantity="l_quantity"),
    )
    missing = all_of(
        _lacking(lines, "l_orderkey", orders, "o_orderkey", "order"), _lacking(items, "l_partkey", t("part"), "p_partkey", "part"), _lacking(items, "l_suppkey", t("supplier"), "s_suppkey", "supp"),
        _lacking(orders, "o_custkey", t("customer"), "c_custkey", "cust"), _lacking(t("nation"), "n_regionkey", t("region"), "r_regionkey", "region"),
        _lacking(t("customer").select(F.col("c_nationkey").alias("k")).union(t("supplier").select("s_nationkey")), "k", t("nation"), "n_nationkey", "nation"),
    )
    return graph_from(spark, nodes, edges, attrs, missing=missing)


def _lacking(rows: DataFrame, key: str, declared: DataFrame, own: str, prefix: str) -> DataFrame:
    """(node_id, ordinal) of the keys that no row of their own table declares; found among keys, before they are ids."""
    keys = rows.select(F.col(key).alias("_key")).distinct()
    return keys.join(declared.select(F.col(own).alias("_own")), F.col("_key").eqNullSafe(F.col("_own")), "left_anti").select(id_of(prefix, "_key").alias("node_id"), F.lit(0).cast("long").alias("ordinal"))


def _none_missing(spark: SparkSession) -> DataFrame:
    """For graphs whose edges have their ends from the rows that make the nodes."""
    return spark.createDataFrame([], "node_id string, ordinal long")


def activity_graph(spark: SparkSession, sf_dir: str) -> ProvGraph:
    t = _table(spark, sf_dir)
    events, turns, docs = t("events"), t("conversations").select("conv_id", "turn", "role"), t("documents").select("doc_id", "text")
    events = events.withColumn("last", F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    turns = turns.withColumn("last", F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn")))
    firsts = docs.groupBy(F.md5("text").alias("key")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = docs.select("doc_id", F.md5("text").alias("key")).join(firsts, "key").filter("doc_id <> first")
    turn = id_of("turn", "conv_id", "turn")
    nodes = all_of(
        node_rows(events, "bundle:events", id_of("ev", "event_id"), "activity", start=F.col("ts"), ordinal=F.col("event_id")),
        node_rows(turns, "bundle:conversations", turn, "entity", ordinal=F.col("conv_id")),
        node_rows(turns.select("role").distinct(), "bundle:conversations", id_of("role", "role"), "agent"),
        node_rows(docs, "bundle:documents", id_of("doc", "doc_id"), "entity", ordinal=F.col("doc_id")),
    )
    edges = all_of(
        edge_rows(events.filter("last IS NOT NULL"), "bundle:events", "communication", id_of("ev", "event_id"), id_of("ev", "last")),
        edge_rows(turns.filter("last IS NOT NULL"), "bundle:conversations", "derivation", turn, id_of("turn", "conv_id", "last")),
        edge_rows(turns, "bundle:conversations", "attribution", turn, id_of("role", "role")),
        edge_rows(copies, "bundle:documents", "alternate", id_of("doc", "doc_id"), id_of("doc", "first")),
    )
    return graph_from(spark, nodes, edges, missing=_none_missing(spark))


def transition_graph(spark: SparkSession, sf_dir: str) -> ProvGraph:
    """Event types by hour of day; one is informed by another that directly precedes it for a user, however long before."""
    events = _table(spark, sf_dir)("events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.concat_ws(":", "event_type", F.hour("ts").cast("string"))
    steps = events.select(kind.alias("kind"), F.lag(kind).over(w).alias("last"))
    changes = steps.filter(F.col("last") != F.col("kind"))
    nodes = node_rows(events.select(kind.alias("kind")).distinct(), "bundle:types", id_of("type", "kind"), "activity")
    edges = edge_rows(changes.select("kind", "last").distinct(), "bundle:types", "communication", id_of("type", "kind"), id_of("type", "last"))
    return graph_from(spark, nodes, edges, missing=_none_missing(spark))
