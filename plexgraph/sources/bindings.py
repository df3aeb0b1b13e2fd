"""The test tables as a property graph: regions are collections, trade their relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import stage
from ..workers import ready

#: Bound graphs that were written in the shared folder, by session, table and the state of the files they come from.
_BOUND: dict[tuple, DataFrame] = {}
#: Rows of a task of a shuffle, so that its sorts stay in memory whatever the tables' size.
TASK_ROWS = 500_000
#: A table of at most so many keys and names goes to every task.
BROADCAST_ROWS = 500_000


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        ready(spark)
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def rows(self, *names: str) -> int:
        return sum(getattr(self, name).count() for name in names)

    def tasks(self, rows: int) -> int:
        """The number of tasks that a shuffle of so many rows needs."""
        return max(self.spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))

    def state(self, *names: str) -> tuple:
        """Path, length and time of change of the files of some tables."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        out = []
        for name in names:
            at = path(f"{self.folder}/{name}.parquet")
            files = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True)
            while files.hasNext():
                f = files.next()
                out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        return tuple(sorted(out))


def _bound(t: Tables, name: str, make) -> DataFrame:
    """A table of the graph, written once for each state of the test tables, as a store would hold it."""
    key = (t.spark.sparkContext.applicationId, name, t.state("nation", "region", "customer", "supplier", "part", "orders", "lineitem"))
    if key not in _BOUND:
        _BOUND[key] = stage(make(t), f"bound-{name}")
    return _BOUND[key]


def geography(t: Tables) -> DataFrame:
    """Nations with their region's name: 25 rows by their nature."""
    return t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", F.col("r_name").alias("collection"))


def entity_events(t: Tables) -> DataFrame:
    """Writes (collection, name, type, description, seq): customers, suppliers, nations, and parts where they are ordered."""
    geo = F.broadcast(geography(t))
    people = t.customer.join(geo, F.col("c_nationkey") == F.col("n_nationkey")).select("collection", F.col("c_name").alias("name"), F.lit("PERSON").alias("type"), F.col("c_mktsegment").alias("description"), F.concat(F.lit("0"), F.lpad(F.col("c_custkey").cast("string"), 12, "0")).alias("seq"))
    firms = t.supplier.join(geo, F.col("s_nationkey") == F.col("n_nationkey")).select("collection", F.col("s_name").alias("name"), F.lit("ORGANIZATION").alias("type"), F.lit("").alias("description"), F.concat(F.lit("1"), F.lpad(F.col("s_suppkey").cast("string"), 12, "0")).alias("seq"))
    places = geography(t).select("collection", F.col("n_name").alias("name"), F.lit("LOCATION").alias("type"), F.lit("").alias("description"), F.concat(F.lit("2"), F.lpad(F.col("n_nationkey").cast("string"), 12, "0")).alias("seq"))
    parts = t.part.select(F.col("p_name").alias("name"), F.lit("OBJECT").alias("type"), F.col("p_type").alias("description"), F.concat(F.lit("3"), F.lpad(F.col("p_partkey").cast("string"), 12, "0")).alias("seq"))
    regions = t.region.select(F.col("r_name").alias("collection"))  # five rows
    return people.unionByName(firms).unionByName(places).unionByName(parts.withColumn("one", F.lit(1)).join(F.broadcast(regions.withColumn("one", F.lit(1))), "one").select("collection", "name", "type", "description", "seq"))


def entities(t: Tables) -> DataFrame:
    return _bound(t, "entities", upserted_entities)


def upserted_entities(t: Tables) -> DataFrame:
    """The entities after all writes."""
    from ..operators.graph import upsert_entities

    empty = t.spark.createDataFrame([], "collection string, name string, type string, description string, aliases array<string>")
    return upsert_entities(empty, entity_events(t), tasks=t.tasks(t.rows("customer", "supplier", "nation") + t.rows("part") * t.rows("region")))


def _joined(t: Tables, left: DataFrame, left_key: str, left_rows: int, right: DataFrame, right_key: str, right_rows: int, how: str = "inner") -> DataFrame:
    """left with right's columns: a small right side goes to every task, else both are dealt by the key."""
    on = F.col(left_key) == F.col(right_key)
    if right_rows <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), on, how)
    n = t.tasks(left_rows + right_rows)
    return left.repartition(n, left_key).join(right.repartition(n, right_key).hint("merge"), on, how)


def _located(t: Tables) -> DataFrame:
    """(collection, source, target): where customers and suppliers are."""
    geo = F.broadcast(geography(t))
    people = t.customer.join(geo, F.col("c_nationkey") == F.col("n_nationkey")).select("collection", F.col("c_name").alias("source"), F.col("n_name").alias("target"))
    return people.unionByName(t.supplier.join(geo, F.col("s_nationkey") == F.col("n_nationkey")).select("collection", F.col("s_name").alias("source"), F.col("n_name").alias("target")))


def _trade(t: Tables) -> DataFrame:
    """(collection, source, target, ordered, at, order, line): each order line once as bought and once as made.  Both come from one pass over the lines."""
    geo = F.broadcast(geography(t))
    people = t.customer.join(geo, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("collection").alias("c_collection"), "c_name")
    firms = t.supplier.join(geo, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("collection").alias("s_collection"), "s_name")
    n_lines, n_orders = t.rows("lineitem"), t.rows("orders")
    orders = _joined(t, t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), "o_custkey", n_orders, people, "c_custkey", t.rows("customer"), "left").drop("o_custkey")
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    named = _joined(t, lines, "l_partkey", n_lines, t.part.select("p_partkey", "p_name"), "p_partkey", t.rows("part")).drop("l_partkey", "p_partkey")
    dated = _joined(t, named, "l_orderkey", n_lines, orders, "o_orderkey", n_orders).drop("l_orderkey")
    every = _joined(t, dated, "l_suppkey", n_lines, firms, "s_suppkey", t.rows("supplier"), "left")
    event = lambda c, source, key, ordered: F.when(F.col(key).isNotNull(), F.struct(F.col(c).alias("collection"), F.col(source).alias("source"), F.lit(ordered).alias("ordered")))
    told = every.select(F.explode(F.array(event("c_collection", "c_name", "c_custkey", True), event("s_collection", "s_name", "s_suppkey", False))).alias("e"), F.col("p_name").alias("target"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("order"), F.col("l_linenumber").cast("int").alias("line"))
    return told.where("e is not null").select("e.collection", "e.source", "target", "e.ordered", "at", "order", "line")


def _kind() -> list[Column]:
    """What _trade's columns mean for a relation."""
    return [F.when(F.col("ordered"), "ORDERED").otherwise("PRODUCES").alias("predicate"), F.when(F.col("ordered"), F.col("at").cast("date").cast("string")).otherwise("").alias("valid_from")]


def _order(key: str) -> Column:
    return F.concat(F.lit("order_"), F.col(key).cast("string"))


def relation_events(t: Tables) -> DataFrame:
    """Writes (collection, source, target, predicate, valid_from, source_doc, seq)."""
    none, first = F.lit(""), F.struct(F.lit(None).cast("timestamp").alias("at"), F.lit(0).cast("long").alias("order"), F.lit(0).alias("line"))
    sit = _located(t).select("collection", "source", "target", F.lit("LOCATED_IN").alias("predicate"), none.alias("valid_from"), none.alias("source_doc"), first.alias("seq"))
    return sit.unionByName(_trade(t).select("collection", "source", "target", *_kind(), _order("order").alias("source_doc"), F.struct("at", "order", "line").alias("seq")))


def relation_tasks(t: Tables) -> int:
    """Tasks for a shuffle of relation_events."""
    return t.tasks(2 * t.rows("lineitem") + t.rows("customer", "supplier"))


def relations(t: Tables) -> DataFrame:
    return _bound(t, "relations", written_relations)


def written_relations(t: Tables) -> DataFrame:
    """The relations after all writes: per key, the last source_doc; every end is an entity by construction.

    Lines are shuffled once for their key, without what the key and the order tell; two lines of an order have one source_doc."""
    from ..operators.graph import EDGE

    sit = _located(t).distinct().select("collection", "source", "target", F.lit("LOCATED_IN").alias("predicate"), F.lit("").alias("valid_from"), F.lit("").alias("source_doc"))
    dealt = _trade(t).repartition(relation_tasks(t), "collection", "source", "target")
    last = dealt.groupBy("collection", "source", "target", *_kind()).agg(F.max(F.struct("at", "order")).alias("last"))
    return sit.unionByName(last.select(*EDGE, _order("last.order").alias("source_doc")))


def hierarchy(t: Tables) -> DataFrame:
    """Nations below regions below WORLD."""
    return geography(t).select(F.col("n_name").alias("collection"), F.col("collection").alias("parent")).unionByName(t.region.select(F.col("r_name").alias("collection"), F.lit("WORLD").alias("parent")))


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.concat(F.lit("label_"), F.col("label").cast("string")).alias("collection"), "vec_id", F.col("embedding").alias("vector"))


def documents(t: Tables) -> DataFrame:
    return t.documents.select(F.col("source").alias("collection"), F.col("doc_id").cast("string").alias("source_id"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"), F.col("text").alias("content"))
