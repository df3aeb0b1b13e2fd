"""The engine's operators as queries over the test tables, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .functions.chunking import chunks
from .operators import community as C
from .operators import export, extract, lifecycle, resolve, scope, vectors
from .operators import graph as G
from .operators.mentions import mentions
from .plans import evaluate, reports, search
from .providers import HashedNgrams, Scripted, embedded
from .schema import NUMBER_UNITS
from .sources import bindings as B

GEO = "geo AS (SELECT n_nationkey, n_name, r_name AS collection FROM nation JOIN region ON n_regionkey = r_regionkey)"
ENTITIES = (
    GEO
    + """, entity_events AS (
  SELECT collection, c_name AS name, 'PERSON' AS type, c_mktsegment AS description, '0' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS seq FROM customer JOIN geo ON c_nationkey = n_nationkey
  UNION ALL SELECT collection, s_name, 'ORGANIZATION', '', '1' || lpad(CAST(s_suppkey AS VARCHAR), 12, '0') FROM supplier JOIN geo ON s_nationkey = n_nationkey
  UNION ALL SELECT collection, n_name, 'LOCATION', '', '2' || lpad(CAST(n_nationkey AS VARCHAR), 12, '0') FROM geo
  UNION ALL SELECT r_name, p_name, 'OBJECT', p_type, '3' || lpad(CAST(p_partkey AS VARCHAR), 12, '0') FROM part, region
), entities AS (SELECT collection, name, arg_max(type, seq) AS type, arg_max(description, seq) AS description FROM entity_events GROUP BY collection, name)"""
)
RELATIONS = """relation_events AS (
  SELECT collection, c_name AS source, n_name AS target, 'LOCATED_IN' AS predicate, '' AS valid_from, '' AS source_doc, '0' AS seq FROM customer JOIN geo ON c_nationkey = n_nationkey
  UNION ALL SELECT collection, s_name, n_name, 'LOCATED_IN', '', '', '0' FROM supplier JOIN geo ON s_nationkey = n_nationkey
  UNION ALL SELECT collection, c_name, p_name, 'ORDERED', strftime(o_orderdate, '%Y-%m-%d'), 'order_' || o_orderkey, strftime(o_orderdate, '%Y%m%d%H%M%S') || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') || lpad(CAST(l_linenumber AS VARCHAR), 4, '0')
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey JOIN geo ON c_nationkey = n_nationkey
  UNION ALL SELECT collection, s_name, p_name, 'PRODUCES', '', 'order_' || o_orderkey, strftime(o_orderdate, '%Y%m%d%H%M%S') || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') || lpad(CAST(l_linenumber AS VARCHAR), 4, '0')
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN geo ON s_nationkey = n_nationkey
), relations AS (SELECT collection, source, target, predicate, valid_from, arg_max(source_doc, seq) AS source_doc FROM relation_events GROUP BY collection, source, target, predicate, valid_from)"""
GRAPH = f"WITH {ENTITIES}, {RELATIONS} "
UNIT = "unit AS (SELECT vec_id, 'label_' || label AS collection, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
FULL_COSINE = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"
COSINE = f"round({FULL_COSINE}, 6)"
COMMUNITY = "member AS (SELECT collection, n_name AS community_id, c_name AS name FROM customer JOIN geo ON c_nationkey = n_nationkey UNION ALL SELECT collection, n_name, s_name FROM supplier JOIN geo ON s_nationkey = n_nationkey UNION ALL SELECT collection, n_name, n_name FROM geo)"
LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[B.Tables], DataFrame]) -> Callable[[B.Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(B.Tables(spark, folder))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _no_bridges(t: B.Tables) -> DataFrame:
    return t.spark.createDataFrame([], "collection_lo string, name_lo string, collection_hi string, name_hi string")


def _bridge_batch(t: B.Tables) -> DataFrame:
    """The same part in two regions, both ways round."""
    own = B.entities(t).where("type = 'OBJECT'").select("collection", "name")
    return own.toDF("collection_a", "name").join(own.toDF("collection_b", "name"), "name").where("collection_a <> collection_b").select("collection_a", F.col("name").alias("name_a"), "collection_b", F.col("name").alias("name_b"))


def _bridges(t: B.Tables) -> DataFrame:
    return G.canonical_bridges(_bridge_batch(t), B.entities(t))


BRIDGES = "bridges AS (SELECT a.collection AS collection_lo, a.name AS name_lo, b.collection AS collection_hi, b.name AS name_hi FROM entities a JOIN entities b ON a.name = b.name AND a.collection < b.collection WHERE a.type = 'OBJECT' AND b.type = 'OBJECT')"


# Graph


@query(f"WITH {ENTITIES} SELECT collection, name, type, description FROM entities")
def entity_upsert_lww(t):
    return B.upserted_entities(t).select("collection", "name", "type", "description")


@query(GRAPH + "SELECT * FROM relations")
def relation_upsert_lww(t):
    state = t.spark.createDataFrame([], "collection string, source string, target string, predicate string, valid_from string, source_doc string")
    return G.upsert_relations(state, B.relation_events(t), B.entities(t), B.relation_tasks(t))


@query(GRAPH + "SELECT r.collection, source AS name, predicate, target AS other, valid_from, source_doc FROM relations r JOIN entities e ON e.collection = r.collection AND e.name = r.source WHERE e.type = 'PERSON'")
def graph_out_neighbors(t):
    return G.outgoing(B.relations(t), B.entities(t).where("type = 'PERSON'"))


@query(GRAPH + "SELECT r.collection, target AS name, predicate, source AS other, valid_from, source_doc FROM relations r JOIN entities e ON e.collection = r.collection AND e.name = r.target WHERE e.type = 'OBJECT'")
def graph_in_neighbors(t):
    return G.incoming(B.relations(t), B.entities(t).where("type = 'OBJECT'"))


@query(f"WITH {ENTITIES} SELECT e.collection, e.name, e.type, e.description FROM entities e JOIN geo g ON e.collection = g.collection AND e.name = g.n_name")
def entity_lookup(t):
    return G.lookup(B.entities(t), B.geography(t).withColumnRenamed("n_name", "name")).select("collection", "name", "type", "description")


@query(f"WITH {ENTITIES} SELECT DISTINCT type FROM entities")
def distinct_types(t):
    return B.entities(t).select("type").distinct()


@query(GRAPH + "SELECT DISTINCT predicate FROM relations")
def distinct_predicates(t):
    return B.relations(t).select("predicate").distinct()


@query(GRAPH + "SELECT e.collection, n_entities, coalesce(n_relations, 0) AS n_relations FROM (SELECT collection, count(*) AS n_entities FROM entities GROUP BY 1) e LEFT JOIN (SELECT collection, count(*) AS n_relations FROM relations GROUP BY 1) r USING (collection) WHERE e.collection IN ('ASIA', 'EUROPE')")
def scope_counts(t):
    return G.counts(B.entities(t), B.relations(t), ["ASIA", "EUROPE"])


@query(GRAPH + ", ends AS (SELECT collection, source AS name FROM relations WHERE predicate <> 'LOCATED_IN' UNION SELECT collection, target FROM relations WHERE predicate <> 'LOCATED_IN') SELECT collection, name FROM entities EXCEPT SELECT collection, name FROM ends")
def isolated_entities(t):
    """Of the graph of trade alone, in which nations and parts that nobody ordered or sold stand by themselves."""
    return G.isolated(B.entities(t), B.relations(t).where("predicate <> 'LOCATED_IN'"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orders_without_lines(t):
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query(GRAPH + "SELECT collection, name, count(*) AS degree FROM (SELECT collection, source AS name FROM relations UNION ALL SELECT collection, target FROM relations) GROUP BY collection, name")
def degree(t):
    return G.degrees(B.relations(t))


@query(f"WITH {ENTITIES} SELECT collection FROM entities UNION SELECT source FROM documents")
def known_collections(t):
    return scope.known_collections(B.entities(t), B.documents(t))


@query("SELECT source AS collection, count(*) AS n_documents FROM documents GROUP BY source")
def collection_doc_counts(t):
    return lifecycle.document_counts(B.documents(t))


@query(
    GRAPH
    + """, plan AS (SELECT collection, s_name AS gone, min(s_name) OVER (PARTITION BY s_nationkey) AS kept FROM supplier JOIN geo ON s_nationkey = n_nationkey)
SELECT r.collection, coalesce(p.kept, r.source) AS source, coalesce(q.kept, r.target) AS target, predicate, valid_from, min(source_doc) AS source_doc
FROM relations r LEFT JOIN plan p ON p.collection = r.collection AND p.gone = r.source LEFT JOIN plan q ON q.collection = r.collection AND q.gone = r.target GROUP BY ALL"""
)
def entity_merge(t):
    own = t.supplier.join(F.broadcast(B.geography(t)), F.col("s_nationkey") == F.col("n_nationkey"))
    pairs = own.join(own.groupBy("s_nationkey").agg(F.min("s_name").alias("keep")), "s_nationkey").where("s_name <> keep").select("collection", "keep", F.col("s_name").alias("drop"))
    return G.merge_entities(B.entities(t), B.relations(t), _no_bridges(t), G.resolve_merges(pairs), tasks=t.tasks(B.relations(t).count()))[1]


@query(f"WITH {ENTITIES}, {BRIDGES} SELECT * FROM bridges")
def bridge_canonical(t):
    return _bridges(t)


@query(f"WITH {ENTITIES}, {BRIDGES} SELECT collection_lo AS collection, name_lo AS name, collection_hi AS other_collection, name_hi AS other_name FROM bridges WHERE collection_hi IN ('ASIA', 'AFRICA') UNION ALL SELECT collection_hi, name_hi, collection_lo, name_lo FROM bridges WHERE collection_lo IN ('ASIA', 'AFRICA')")
def bridge_neighbors(t):
    return G.bridge_neighbours(_bridges(t), scope=["ASIA", "AFRICA"])


ALIAS = "'C' || CAST(c_custkey AS VARCHAR)"


@query(
    f"WITH {ENTITIES}, alias AS (SELECT collection, c_name AS name, {ALIAS} AS form FROM customer JOIN geo ON c_nationkey = n_nationkey), "
    "wanted AS (SELECT DISTINCT collection, candidate FROM (SELECT collection, name AS candidate FROM entities UNION ALL SELECT collection, form FROM alias UNION ALL SELECT collection, 'nobody ' || n_name FROM geo)) "
    "SELECT w.collection, w.candidate, coalesce(e.name, min(a.name)) AS name FROM wanted w LEFT JOIN entities e ON e.collection = w.collection AND e.name = w.candidate LEFT JOIN alias a ON a.collection = w.collection AND a.form = w.candidate GROUP BY w.collection, w.candidate, e.name"
)
def alias_resolution(t):
    geo = B.geography(t)
    alias = t.customer.join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey")).select("collection", F.col("c_name").alias("name"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("alias"))
    entities = G.add_aliases(B.entities(t), alias)
    wanted = entities.select("collection", F.col("name").alias("candidate")).unionByName(alias.select("collection", F.col("alias").alias("candidate"))).unionByName(geo.select("collection", F.concat(F.lit("nobody "), "n_name").alias("candidate")))
    return G.canonical_names(entities, wanted)


@query(
    f"WITH RECURSIVE {GEO}, edges AS (SELECT n_name AS child, collection AS parent FROM geo UNION ALL SELECT r_name, 'WORLD' FROM region), every AS (SELECT child AS x FROM edges UNION SELECT parent FROM edges), "
    "reach(collection, descendant) AS (SELECT x, x FROM every UNION SELECT r.collection, e.child FROM reach r JOIN edges e ON e.parent = r.descendant) SELECT collection, descendant FROM reach"
)
def collection_descendants(t):
    return scope.descendants(B.hierarchy(t))


@query(
    f"WITH {GEO}, edges AS (SELECT n_name AS collection, collection AS parent FROM geo UNION ALL SELECT r_name, 'WORLD' FROM region), {ENTITIES.replace(GEO + ', ', '')}, "
    "names AS (SELECT collection FROM entities UNION SELECT source FROM documents UNION SELECT collection FROM edges) "
    "SELECT n.collection, p.parent, coalesce(e.k, 0) AS n_entities, coalesce(d.k, 0) AS n_documents, p.parent IS NULL AS is_root FROM names n LEFT JOIN (SELECT * FROM edges WHERE parent IN (SELECT collection FROM names)) p USING (collection) "
    "LEFT JOIN (SELECT collection, count(*) AS k FROM entities GROUP BY 1) e USING (collection) LEFT JOIN (SELECT source AS collection, count(*) AS k FROM documents GROUP BY 1) d USING (collection)"
)
def collection_tree(t):
    return scope.tree(B.hierarchy(t), B.entities(t), B.documents(t))


# Resolution


def _variants(t: B.Tables) -> DataFrame:
    own = B.entities(t).where("type = 'PERSON'").select("collection", "name")
    return own.unionByName(own.select("collection", F.upper(F.replace("name", F.lit("#"), F.lit(" - "))).alias("name")))


@query(
    GRAPH
    + """, variants AS (SELECT collection, name FROM entities WHERE type = 'PERSON' UNION ALL SELECT collection, upper(replace(name, '#', ' - ')) FROM entities WHERE type = 'PERSON'),
deg AS (SELECT collection, name, count(*) AS degree FROM (SELECT collection, source AS name FROM relations UNION ALL SELECT collection, target FROM relations) GROUP BY 1, 2),
keyed AS (SELECT v.collection, v.name, lower(regexp_replace(v.name, '[^\\p{L}\\p{N}]+', '', 'g')) AS key, coalesce(degree, 0) AS degree FROM variants v LEFT JOIN deg USING (collection, name)),
ranked AS (SELECT *, first_value(name) OVER (PARTITION BY collection, key ORDER BY degree DESC, length(name), name DESC) AS keep FROM keyed WHERE key <> '')
SELECT collection, keep, name AS "drop" FROM ranked WHERE name <> keep"""
)
def normalized_duplicates(t):
    return resolve.normalized_duplicates(_variants(t), B.relations(t))


def _pairs_sql(where: str) -> str:
    return f"WITH {UNIT}, p AS (SELECT a.collection, a.vec_id AS a, b.vec_id AS b, b.collection AS other, {COSINE} AS score FROM unit a JOIN unit b ON a.vec_id < b.vec_id AND {where}) "


@query(_pairs_sql("a.collection = b.collection") + "SELECT collection, a, b, score FROM p WHERE score > 0.3")
def similarity_pairs_in_collection(t):
    return resolve.similar_pairs(B.vectors(t), 0.3, key="vec_id", digits=6)


@query(_pairs_sql("a.collection = b.collection") + "SELECT collection, a, b, score FROM p WHERE score > 0.3 AND score <= 0.35")
def similarity_pairs_band(t):
    return resolve.similar_pairs(B.vectors(t), 0.3, 0.35, key="vec_id", digits=6)


@query(
    f"WITH {UNIT}, p AS (SELECT a.collection, lpad(CAST(a.vec_id AS VARCHAR), 12, '0') AS name, b.collection AS other_collection, lpad(CAST(b.vec_id AS VARCHAR), 12, '0') AS other_name, {COSINE} AS score FROM unit a JOIN unit b ON a.collection < b.collection) "
    "SELECT * FROM p WHERE score > 0.35"
)
def bridge_candidates(t):
    own = B.vectors(t).select("collection", F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("name"), "vector")
    return resolve.bridge_candidates(own, _no_bridges(t), 0.35, digits=6)


def _top_sql(where: str) -> str:
    return (
        f"WITH {UNIT}, s AS (SELECT a.vec_id AS query_id, b.vec_id, {FULL_COSINE} AS score FROM unit a JOIN unit b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0{where}), "
        'r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, round(score, 6) AS score FROM s) SELECT * FROM r WHERE "rank" <= 12'
    )


@query(_top_sql(""))
def vector_topk(t):
    asked = t.embeddings.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return vectors.batched_top_k(t.embeddings, asked, 12)


@query(_top_sql(" AND b.collection IN ('label_0', 'label_1', 'label_2')"))
def vector_topk_scoped(t):
    asked = t.embeddings.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return vectors.batched_top_k(scope.in_scope(B.vectors(t), ["label_0", "label_1", "label_2"]).withColumnRenamed("vector", "embedding"), asked, 12)


# Documents and text


@query("SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def document_hash_dedup(t):
    return t.documents.groupBy(T.content_hash(F.col("text")).alias("content_hash")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR l.quality = 0")
def change_detection(t):
    stored = t.documents.join(t.labels, "doc_id").select(F.col("source").alias("collection"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"), F.when(F.col("quality") == 0, F.lit("stale")).otherwise(T.content_hash(F.col("text"))).alias("content_hash"))
    return lifecycle.needs_processing(B.documents(t), stored).select(F.col("source_id").cast("long").alias("doc_id"))


@query("SELECT CAST(doc_id AS VARCHAR) AS source_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND lang <> 'es'")
def orphan_sources(t):
    used = B.documents(t).select("source_id")
    none = t.spark.createDataFrame([], "source_doc string")
    kept = t.labels.select(F.col("doc_id").cast("string").alias("source_id"))
    running = t.documents.where("lang = 'es'").select(F.col("doc_id").cast("string").alias("source_id"))
    return lifecycle.orphans(used, none, none, kept, running)


@query(
    """WITH lines AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS x FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
cells AS (SELECT doc_id, i, x, list_filter(list_transform(string_split(x, '|'), lambda c: regexp_replace(c, '^\\s+|\\s+$', '', 'g')), lambda c: c <> '') AS c FROM lines),
kept AS (SELECT doc_id, i, CASE WHEN contains(x, '|') AND regexp_full_match(x, '[\\s|:\\-]*') THEN NULL WHEN length(x) - length(replace(x, '|', '')) >= 3 THEN CASE WHEN len(c) > 0 THEN array_to_string(c, ' ') END ELSE x END AS y FROM cells)
SELECT d.doc_id, sha256(coalesce(regexp_replace(string_agg(y, chr(10) ORDER BY i), '\\n{3,}', chr(10) || chr(10), 'g'), '')) AS clean_sha256 FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id AND y IS NOT NULL GROUP BY d.doc_id"""
)
def clean_markdown(t):
    return t.documents.select("doc_id", F.sha2(T.clean_markdown(F.col("text")), 256).alias("clean_sha256"))


@query()
def chunk_text(t):
    """Rows only: a greedy fold.  Chunks with overlap, over all documents."""
    return t.documents.select("doc_id", F.posexplode(chunks(T.clean_markdown(F.col("text")), 1960, 392)).alias("chunk_idx", "text"))


UNITS = sorted(NUMBER_UNITS, key=len, reverse=True)


def _noise_sql() -> str:
    inner = "regexp_replace(name, '[0-9,.\\s]', '', 'g')"
    for u in UNITS:
        inner = f"replace({inner}, '{u}', '')"
    return (
        "WITH names AS (SELECT DISTINCT name FROM (SELECT CAST(n_chars AS VARCHAR) || '만 명' AS name FROM documents UNION ALL SELECT lang || ' ' || n_chars FROM documents UNION ALL SELECT source FROM documents UNION ALL SELECT CAST(n_chars AS VARCHAR) || '점 G7' FROM documents UNION ALL SELECT lang FROM documents)) "
        f"SELECT name, CASE WHEN trim(name) = '' THEN true WHEN NOT regexp_matches(name, '[0-9]') THEN false ELSE {inner} = '' END AS noise FROM names"
    )


@query(_noise_sql())
def noise_name_filter(t):
    n = F.col("n_chars").cast("string")
    names = t.documents.select(F.explode(F.array(F.concat(n, F.lit("만 명")), F.concat_ws(" ", "lang", n), F.col("source"), F.concat(n, F.lit("점 G7")), F.col("lang"))).alias("name")).distinct()
    return names.select("name", T.is_noise_name(F.col("name")).alias("noise"))


@query(
    "WITH raw AS (SELECT '  ' || o_orderpriority || ' ' AS x FROM orders UNION ALL SELECT event_type FROM events UNION ALL SELECT p_type FROM part UNION ALL SELECT '-' || p_brand || '--' FROM part) "
    "SELECT upper(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '[\\s\\-]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g')) AS predicate, count(*) AS n FROM raw GROUP BY 1"
)
def predicate_normalize(t):
    raw = t.orders.select(F.concat(F.lit("  "), "o_orderpriority", F.lit(" ")).alias("x")).unionByName(t.events.select(F.col("event_type").alias("x"))).unionByName(t.part.select(F.col("p_type").alias("x"))).unionByName(t.part.select(F.concat(F.lit("-"), "p_brand", F.lit("--")).alias("x")))
    return raw.groupBy(T.predicate(F.col("x")).alias("predicate")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN '화자(' || conv_id || ')' ELSE role END AS name FROM conversations")
def first_person_promote(t):
    name = F.when(F.col("role") == "user", F.lit("나")).otherwise(F.col("role"))
    return t.conversations.select("conv_id", "turn", T.first_person(name, F.col("conv_id").cast("string")).alias("name"))


@query(
    "WITH r AS (SELECT l_orderkey AS doc, CAST(l_suppkey AS VARCHAR) AS source, CAST(l_partkey AS VARCHAR) AS target, l_returnflag AS predicate, row_number() OVER (PARTITION BY l_orderkey, l_suppkey, l_partkey ORDER BY l_linenumber) AS nth FROM lineitem) "
    "SELECT doc, 'S' || source AS source, 'P' || target AS target, predicate FROM r WHERE nth = 1"
)
def reconcile_pair_dedup(t):
    rows = t.lineitem.select(F.lit("c").alias("collection"), F.col("l_orderkey").cast("string").alias("source_id"), F.lit(0).alias("chunk_idx"), F.struct(F.lit(0).alias("turn"), F.col("l_linenumber").alias("at")).alias("seq"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("source"), F.col("l_returnflag").alias("predicate"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("target"), F.lit("").alias("valid_from"))
    none = t.spark.createDataFrame([], "collection string, source_id string, chunk_idx int, seq struct<turn:int,at:int>, name string, type string, description string, aliases array<string>")
    return extract.reconcile(none, rows)[1].select(F.col("source_id").cast("long").alias("doc"), "source", "target", "predicate")


@query(
    f"WITH {GEO} SELECT collection, c_name AS entity_name, count(*) AS n_candidates, array_to_string(list(o_orderpriority ORDER BY 'order_' || o_orderkey), '|') AS candidates "
    "FROM orders JOIN customer ON o_custkey = c_custkey JOIN geo ON c_nationkey = n_nationkey GROUP BY 1, 2 HAVING count(*) >= 2"
)
def desc_candidates_min(t):
    items = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(B.geography(t)), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = items.select("collection", F.col("c_name").alias("entity_name"), F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")).alias("source_doc"), F.col("o_orderpriority").alias("description"))
    return extract.desc_candidates(rows).withColumn("candidates", F.array_join("candidates", "|"))


# Communities and reports


def _nation_communities(t: B.Tables) -> DataFrame:
    geo = F.broadcast(B.geography(t))
    people = t.customer.join(geo, F.col("c_nationkey") == F.col("n_nationkey")).select("collection", F.col("n_name").alias("community_id"), F.col("c_name").alias("name"))
    firms = t.supplier.join(geo, F.col("s_nationkey") == F.col("n_nationkey")).select("collection", F.col("n_name").alias("community_id"), F.col("s_name").alias("name"))
    places = B.geography(t).select("collection", F.col("n_name").alias("community_id"), F.col("n_name").alias("name"))
    return people.unionByName(firms).unionByName(places).groupBy("collection", "community_id").agg(F.array_sort(F.collect_list("name")).alias("entity_names")).withColumn("level", F.lit(0)).withColumn("parent_community_id", F.lit(None).cast("string"))


SIDED = f"""{COMMUNITY}, met AS (SELECT r.*, s.community_id AS sc, d.community_id AS dc FROM relations r LEFT JOIN member s ON s.collection = r.collection AND s.name = r.source LEFT JOIN member d ON d.collection = r.collection AND d.name = r.target),
sided AS (SELECT 'inner' AS side, collection, sc AS community_id, source, predicate, target, valid_from, source_doc FROM met WHERE sc = dc
  UNION ALL SELECT 'outer', collection, sc, source, predicate, target, valid_from, source_doc FROM met WHERE sc IS NOT NULL AND (dc IS NULL OR sc <> dc)
  UNION ALL SELECT 'outer', collection, dc, source, predicate, target, valid_from, source_doc FROM met WHERE dc IS NOT NULL AND (sc IS NULL OR sc <> dc))"""


@query(GRAPH + f", {SIDED}, n AS (SELECT *, row_number() OVER (PARTITION BY collection, community_id, side ORDER BY source, predicate, target, valid_from) AS nth FROM sided) SELECT side, collection, community_id, source, predicate, target, valid_from, source_doc FROM n WHERE side = 'inner' OR nth <= 20")
def community_boundary_edges(t):
    return C.boundary_edges(_nation_communities(t), B.relations(t))


@query(
    f"WITH {GEO}, orders_of AS (SELECT collection, n_name AS community_id, o_orderpriority AS source_doc, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN geo ON c_nationkey = n_nationkey GROUP BY ALL) "
    "SELECT collection, community_id, arg_min(source_doc, (-n, source_doc)) AS source_doc FROM orders_of GROUP BY 1, 2"
)
def dominant_source(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(B.geography(t)), F.col("c_nationkey") == F.col("n_nationkey"))
    return C.dominant_sources(rows.select(F.lit("inner").alias("side"), "collection", F.col("n_name").alias("community_id"), F.col("o_orderpriority").alias("source_doc")))


@query()
def communities_leiden(t):
    """Rows only: a seeded iterative partition.  Who orders together, in each region."""
    return C.detect(B.entities(t), B.relations(t)).select("collection", "community_id", "level", "parent_community_id", "size")


REPORTED = f"""{SIDED}, n AS (SELECT *, row_number() OVER (PARTITION BY collection, community_id, side ORDER BY source, predicate, target, valid_from) AS nth FROM sided),
line AS (SELECT collection, community_id, side, source || ' -[' || predicate || ']-> ' || target || ' ' || valid_from AS x FROM n WHERE side = 'inner' OR nth <= 20),
told AS (SELECT collection, community_id, coalesce(string_agg(x, chr(10) ORDER BY x) FILTER (WHERE side = 'inner'), '') AS i, coalesce(string_agg(x, chr(10) ORDER BY x) FILTER (WHERE side = 'outer'), '') AS o FROM line GROUP BY 1, 2),
people AS (SELECT m.collection, community_id, string_agg(concat_ws(': ', m.name, e.description), chr(10) ORDER BY concat_ws(': ', m.name, e.description)) AS m FROM member m LEFT JOIN entities e ON e.collection = m.collection AND e.name = m.name GROUP BY 1, 2),
leaf AS (SELECT collection, community_id, 1 AS level, concat_ws(chr(10), 'Report on these members:', m, 'Relations:', i, 'Beyond:', o, 'Source:', '') AS p, substr(sha256(concat_ws(chr(31), m, i, o, '')), 1, 16) AS content_signature FROM people JOIN told USING (collection, community_id)),
low AS (SELECT *, length(p) || ' characters' AS title, length(p) - length(replace(p, chr(10), '')) || ' lines' AS summary FROM leaf),
top AS (SELECT collection, 'all ' || collection AS community_id, 0 AS level, concat_ws(chr(10), 'Report on these reports:', string_agg(title || chr(10) || summary, chr(10) || chr(10) ORDER BY title || chr(10) || summary), 'Source:', '') AS p, substr(sha256(concat_ws(chr(31), string_agg(content_signature, '|' ORDER BY content_signature), '')), 1, 16) AS content_signature FROM low GROUP BY collection),
both_ AS (SELECT collection, community_id, level, p, content_signature FROM leaf UNION ALL SELECT * FROM top)"""


@query(GRAPH + f", {REPORTED} SELECT collection, community_id, level, length(p) || ' characters' AS title, length(p) - length(replace(p, chr(10), '')) || ' lines' AS summary, CAST(7 AS DOUBLE) AS rating, content_signature FROM both_")
def reports_bottom_up(t):
    """Reports by a scripted model that tells its prompt's size, from the nations up to their regions."""
    low = _nation_communities(t).withColumn("level", F.lit(1)).withColumn("parent_community_id", F.concat(F.lit("all "), "collection"))
    high = low.groupBy("collection", F.col("parent_community_id").alias("community_id")).agg(F.array_sort(F.flatten(F.collect_list("entity_names"))).alias("entity_names")).withColumn("level", F.lit(0)).withColumn("parent_community_id", F.lit(None).cast("string"))
    from .schema import REPORTS

    old = t.spark.createDataFrame([], REPORTS)
    model = Scripted(lambda p: f'{{"title": "{len(p)} characters", "summary": "{p.count(chr(10))} lines", "rating": "7"}}')
    return reports.generate_reports(low.unionByName(high.select(*low.columns)), B.entities(t), B.relations(t), old, model).select("collection", "community_id", "level", "title", "summary", "rating", "content_signature")


@query(
    """WITH s AS (SELECT n_name AS subquery, CAST(c_custkey AS VARCHAR) AS community_id, c_acctbal / 10000 AS score FROM customer JOIN nation ON c_nationkey = n_nationkey),
r AS (SELECT *, row_number() OVER (PARTITION BY subquery ORDER BY score DESC, community_id) AS nth, sum(CASE WHEN score >= 0.55 * best THEN 1 ELSE 0 END) OVER (PARTITION BY subquery) AS n_ok
  FROM (SELECT *, max(score) OVER (PARTITION BY subquery) AS best FROM s))
SELECT subquery, community_id, score, CAST(nth AS INTEGER) AS "rank" FROM r WHERE nth <= least(20, greatest(n_ok, 3))"""
)
def report_admission(t):
    own = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("subquery"), F.col("c_custkey").cast("string").alias("community_id"), (F.col("c_acctbal") / 10000).alias("score"))
    return search.admitted(own, key=["community_id"])


@query(
    """WITH e AS (SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) % 4 AS k, event_type FROM events)
SELECT count(DISTINCT event_type) AS examined, count(*) AS calls, count_if(k >= 2) AS failed, count_if(k = 1) AS relevant FROM e"""
)
def evidence_stats(t):
    k = F.regexp_extract("props", "[0-9]+", 0).cast("long") % 4
    said = F.when(k == 0, '{"evidence_points": [" ", null]}').when(k == 1, '```json\n{"evidence_points": ["x"]}\n```').when(k == 2, '{"points": ["x"]}').otherwise("not json")
    return search.evidence_stats(search.with_points(t.events.select(F.lit("c").alias("collection"), F.col("event_type").alias("community_id"), said.alias("response"))))


@query("SELECT CAST(timezone('America/Los_Angeles', timezone('UTC', ts)) AS DATE) AS usage_date, count(*) AS request_count FROM events GROUP BY 1")
def usage_by_pacific_date(t):
    none = t.spark.createDataFrame([], "usage_date date, request_count bigint")
    return lifecycle.record_usage(none, t.events.select("ts", F.lit(1).alias("n")))


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def mention_match(t):
    return mentions(t.documents.select("doc_id", "text"), t.benchmark.select("item_id", F.col("text").alias("name")), "doc_id", "item_id")


QUESTION = "What do NATION_3 and NATION_14 trade with Customer#000000007?"


@query(
    GRAPH
    + f""", m AS (SELECT * FROM entities WHERE contains('{QUESTION}', name) ORDER BY name, collection LIMIT 20)
SELECT collection, name, 0 AS "rank", 0 AS kind, '[' || collection || '] ' || name || ' (' || type || ') ' || description AS line FROM m
UNION SELECT m.collection, m.name, 0, 2, '  -[' || predicate || ']-> ' || target FROM m JOIN relations r ON r.collection = m.collection AND r.source = m.name
UNION SELECT m.collection, m.name, 0, 3, '  <-[' || predicate || ']- ' || source FROM m JOIN relations r ON r.collection = m.collection AND r.target = m.name"""
)
def graph_context_lines(t):
    return search.context_lines(search.matched_entities(B.entities(t), QUESTION), B.relations(t), _no_bridges(t))


@query(
    """WITH v AS (SELECT o_orderkey AS question, CASE o_orderstatus WHEN 'O' THEN 'A' WHEN 'F' THEN 'B' ELSE 'tie' END AS x, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'A' WHEN o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED') THEN 'B' ELSE 'tie' END AS y FROM orders)
SELECT question, CASE WHEN x = y THEN x ELSE 'tie' END AS winner FROM v"""
)
def judge_consistency(t):
    first = F.when(F.col("o_orderstatus") == "O", '{"winner": "1"}').when(F.col("o_orderstatus") == "F", '{"winner": "2"}').otherwise("?")
    second = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), '{"winner": "2"}').when(F.col("o_orderpriority").isin("3-MEDIUM", "4-NOT SPECIFIED"), '{"winner": "1"}').otherwise('{"winner": "tie"}')
    said = t.orders.select(F.col("o_orderkey").alias("question"), F.posexplode(F.array(first, second)).alias("turn", "response"))
    return evaluate.verdicts(said)


@query(GRAPH + ", kept AS (SELECT collection, name FROM entities WHERE type <> 'ORGANIZATION') SELECT r.collection || '::' || source AS source_id, r.collection || '::' || target AS target_id, predicate, valid_from, source_doc FROM relations r JOIN kept a ON a.collection = r.collection AND a.name = r.source JOIN kept b ON b.collection = r.collection AND b.name = r.target")
def gexf_edges_valid(t):
    return export.valid_edges(B.entities(t).where("type <> 'ORGANIZATION'"), B.relations(t))


@query(GRAPH + f", {BRIDGES} SELECT 'entities' AS what, count(*) AS n FROM entities WHERE collection <> 'ASIA' UNION ALL SELECT 'relations', count(*) FROM relations WHERE collection <> 'ASIA' UNION ALL SELECT 'bridges', count(*) FROM bridges WHERE 'ASIA' NOT IN (collection_lo, collection_hi)")
def collection_cascade_delete(t):
    e, r, b = G.delete_collection(B.entities(t), B.relations(t), _bridges(t), "ASIA")
    count = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
    return count("entities", e).unionByName(count("relations", r)).unionByName(count("bridges", b))


@query(GRAPH + ", gone AS (SELECT collection, name FROM entities WHERE type = 'ORGANIZATION') SELECT r.* FROM relations r WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.collection = r.collection AND g.name IN (r.source, r.target))")
def entity_delete_detach(t):
    e = B.entities(t)
    return G.delete_entities(e, B.relations(t), _no_bridges(t), e.where("type = 'ORGANIZATION'"))[1].select("collection", "source", "target", "predicate", "valid_from", "source_doc")


@query(
    GRAPH
    + """, ends AS (SELECT collection, source AS name, source || ' -[' || predicate || ']-> ' || target AS line, source, predicate, target, valid_from FROM relations UNION ALL SELECT collection, target, source || ' -[' || predicate || ']-> ' || target, source, predicate, target, valid_from FROM relations WHERE source <> target),
nth AS (SELECT *, row_number() OVER (PARTITION BY collection, name ORDER BY source, predicate, target, valid_from) AS i, count(*) OVER (PARTITION BY collection, name) AS n FROM ends),
told AS (SELECT collection, name, n, string_agg(line, chr(10) ORDER BY i) AS lines FROM nth WHERE i <= 3 GROUP BY 1, 2, 3)
SELECT e.collection, e.name, e.description, coalesce(lines, '') AS lines, coalesce(n, 0) AS n_relations FROM entities e LEFT JOIN told USING (collection, name)"""
)
def entity_contexts(t):
    return G.contexts(B.entities(t), B.relations(t)).withColumn("lines", F.array_join("lines", "\n"))


@query(f"WITH {GEO}, p AS (SELECT collection, c_name, c_custkey, c_nationkey, max(c_custkey) OVER (PARTITION BY c_nationkey) AS last FROM customer JOIN geo ON c_nationkey = n_nationkey) SELECT p.collection, p.c_name AS \"drop\", c.c_name AS keep FROM p JOIN customer c ON c.c_custkey = p.last WHERE p.c_custkey <> p.last")
def coref_fold(t):
    """Which entities a person's aliases absorb, with chains followed to their end: each customer's alias is the one before in its nation."""
    geo = F.broadcast(B.geography(t))
    people = t.customer.join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
    before = F.lag("c_name").over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    items = people.select("collection", F.col("c_name").alias("name"), F.lit("PERSON").alias("type"), before.alias("alias")).where("alias is not null").select("collection", "name", "type", F.array("alias").alias("aliases"))
    merges, _ = extract.coref_fold(B.entities(t), B.relations(t), items)
    return G.resolve_merges(merges)


@query()
def local_answer_context(t):
    """Rows only: the chunks nearest to each benchmark item, by hashed n-gram embeddings."""
    provider = HashedNgrams()
    docs = t.documents.select(F.col("doc_id").alias("vec_id"), embedded(F.col("text"), provider).alias("embedding"))
    asked = t.benchmark.select((-1 - F.col("item_id")).alias("query_id"), embedded(F.col("text"), provider).alias("embedding"))
    return vectors.batched_top_k(docs, asked, 12).withColumn("query_id", -1 - F.col("query_id")).withColumnRenamed("vec_id", "doc_id")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_windowed(t):
    from .streaming.inbox import windowed_counts

    return windowed_counts(t.events)
