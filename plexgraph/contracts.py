"""Further operators as queries over the test tables, each with its SQL: text, extraction, edits of the graph, resolution, vectors, scopes, reports, lifecycle."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .config import DEFAULTS, Settings
from .functions import text as T
from .functions.chunking import chunk_count, chunks
from .operators import community as C
from .operators import extract, lifecycle, resolve, scope, vectors
from .operators import graph as G
from .plans import ingest, reports, search
from .providers import ProviderError, Scripted, embedded
from .queries import BRIDGES, COSINE, ENTITIES, FULL_COSINE, GEO, GRAPH, UNIT, _bridges, _nation_communities, _no_bridges, _variants, query
from .schema import DECOMPOSED_BACKENDS, PARTICLES, SEED_PREDICATES, TABLES
from .sources import bindings as B
from .sources.store import Store
from .staging import staged_path

ALNUM = "regexp_replace(text, '[^A-Za-z0-9]', '', 'g')"
PIECES = f"x AS (SELECT doc_id, {ALNUM} AS x FROM documents), n AS (SELECT *, CASE WHEN length(x) = 0 THEN 0 WHEN length(x) <= 1960 THEN 1 ELSE 1 + CAST(ceil((length(x) - 1960) / 1568.0) AS BIGINT) END AS k FROM x)"


def _unbroken() -> Column:
    """A document's letters and digits alone."""
    return F.regexp_replace("text", "[^A-Za-z0-9]", "")


def _of(t: B.Tables, rows: list[tuple], schema: str) -> DataFrame:
    return t.spark.createDataFrame(rows, schema)


# Text


@query(f"WITH {PIECES} SELECT doc_id, CAST(i AS INTEGER) AS chunk_idx, substr(x, 1 + i * 1568, 1960) AS text FROM (SELECT *, unnest(range(0, k)) AS i FROM n)")
def chunk_unbroken(t):
    """Documents' letters and digits without a boundary: chunks by single characters, with overlap."""
    return t.documents.select("doc_id", F.posexplode(chunks(_unbroken(), 1960, 392)).alias("chunk_idx", "text"))


@query(f"WITH {PIECES} SELECT doc_id, CAST(k AS INTEGER) AS n_requests FROM n")
def request_counts(t):
    return lifecycle.request_counts(t.documents.select("doc_id", _unbroken().alias("content"))).select("doc_id", "n_requests")


@query(f"WITH {PIECES} SELECT 3 * sum(k) AS requests, 3 * sum(k) + 100 <= 500 AS allowed, CAST(ceil(3 * sum(k) / 500.0) AS BIGINT) AS parts FROM n")
def quota_estimate(t):
    return lifecycle.quota(t.documents.select(_unbroken().alias("content")), 100, Settings(glean_rounds=2))


@query(
    f"WITH p AS (SELECT unnest({list(PARTICLES)!r}) AS p), n AS (SELECT c_name || p AS name FROM customer, p UNION ALL SELECT '나' || p FROM p UNION ALL SELECT c_name FROM customer UNION ALL SELECT p || '가' || p FROM p) "
    f"SELECT name, CASE WHEN length(name) > 2 AND right(name, 1) IN {PARTICLES!r} THEN left(name, length(name) - 1) ELSE name END AS bare FROM n"
)
def strip_particles(t):
    p = F.array(*[F.lit(x) for x in PARTICLES])
    some = t.spark.range(1).select(F.explode(p).alias("p"))
    names = t.customer.select(F.explode(F.transform(p, lambda x: F.concat("c_name", x))).alias("name")).unionByName(some.select(F.concat(F.lit("나"), "p").alias("name"))).unionByName(t.customer.select(F.col("c_name").alias("name")))
    names = names.unionByName(some.select(F.concat("p", F.lit("가"), "p").alias("name")))
    return names.select("name", T.strip_particle(F.col("name")).alias("bare"))


FILES = "SELECT o_orderkey || '_' || o_orderpriority || '.tar.md' AS f FROM orders UNION ALL SELECT '.' || o_orderkey FROM orders UNION ALL SELECT o_orderstatus || o_orderkey FROM orders"


@query(f"SELECT f, regexp_replace(regexp_replace(f, '(.)\\.[^.]*$', '\\1'), '^[0-9]+_', '') AS label FROM ({FILES})")
def document_labels(t):
    k = F.col("o_orderkey").cast("string")
    names = t.orders.select(F.explode(F.array(F.concat(k, F.lit("_"), "o_orderpriority", F.lit(".tar.md")), F.concat(F.lit("."), k), F.concat("o_orderstatus", k))).alias("f"))
    return names.select("f", T.document_label(F.col("f")).alias("label"))


@query(
    f"WITH {ENTITIES}, raw AS (SELECT ' ' || lower(type) || ' ' AS x FROM entities UNION ALL SELECT event_type FROM events UNION ALL SELECT p_type FROM part) "
    "SELECT CASE WHEN upper(trim(x)) IN ('PERSON', 'ORGANIZATION', 'LOCATION', 'EVENT', 'WORK', 'CONCEPT', 'OBJECT', 'DATE', 'OTHER') THEN upper(trim(x)) ELSE 'OTHER' END AS type, count(*) AS n FROM raw GROUP BY 1"
)
def entity_types(t):
    raw = B.entities(t).select(F.concat(F.lit(" "), F.lower("type"), F.lit(" ")).alias("x")).unionByName(t.events.select(F.col("event_type").alias("x"))).unionByName(t.part.select(F.col("p_type").alias("x")))
    return raw.groupBy(T.entity_type(F.col("x")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, 'x' || (c_custkey % 3) || '|' || c_mktsegment AS aliases FROM customer")
def alias_cleaning(t):
    x = F.concat(F.lit("x"), (F.col("c_custkey") % 3).cast("string"))
    said = F.array(F.concat(F.lit(" "), "c_name", F.lit(" ")), x, F.lit(""), F.lit("  "), F.lit(None), "c_mktsegment", F.concat(x, F.lit(" ")), "c_name")
    return t.customer.select("c_custkey", F.array_join(T.clean_aliases(F.col("c_name"), said), "|").alias("aliases"))


# Extraction


def _answers(t: B.Tables) -> DataFrame:
    """What a model might say on each order line: two names under other keys; on some a blank name, a relation without a target, or no JSON."""
    n = F.col("l_linenumber")
    supp, part = F.concat(F.lit("S"), F.col("l_suppkey").cast("string")), F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    e = F.concat(F.lit('{"name": " '), supp, F.lit(' ", "type": " organization"}, {"id": "'), part, F.lit('", "type": "gadget"}'), F.when(n % 5 == 0, F.lit(', {"name": " "}')).otherwise(""))
    r = F.concat(F.lit('{"subject": "'), supp, F.lit('", "to": "'), part, F.lit('", "predicate": " sells-to "}'), F.when(n % 4 == 0, F.lit(', {"from": "x", "predicate": "p"}')).otherwise(""))
    said = F.when(n == 3, F.lit("I can't say")).otherwise(F.concat(F.lit('```json\n{"entities": ['), e, F.lit('], "relations": ['), r, F.lit("]}\n```")))
    return t.lineitem.select(F.lit("c").alias("collection"), F.col("l_orderkey").cast("string").alias("source_id"), n.alias("chunk_idx"), said.alias("response"))


def _items_sql(where: str) -> str:
    return f"SELECT CAST(l_orderkey AS VARCHAR) AS source_id, l_linenumber AS chunk_idx, name, type FROM (SELECT *, unnest([{{'name': 'S' || l_suppkey, 'type': 'ORGANIZATION'}}, {{'name': 'P' || l_partkey, 'type': 'OTHER'}}], recursive := true) FROM lineitem WHERE {where})"


@query(_items_sql("l_linenumber <> 3 AND l_linenumber % 5 <> 0 AND l_linenumber % 4 <> 0"))
def entity_items_strict(t):
    return extract.entity_items(_answers(t)).select("source_id", "chunk_idx", "name", "type")


@query(_items_sql("l_linenumber <> 3"))
def entity_items_each(t):
    return extract.entity_items(_answers(t), strict=False, drop_noise=True).select("source_id", "chunk_idx", "name", "type")


@query("SELECT CAST(l_orderkey AS VARCHAR) AS source_id, l_linenumber AS chunk_idx, 'S' || l_suppkey AS source, 'SELLS_TO' AS predicate, 'P' || l_partkey AS target FROM lineitem WHERE l_linenumber <> 3 AND l_linenumber % 5 <> 0 AND l_linenumber % 4 <> 0")
def relation_items_strict(t):
    return extract.relation_items(_answers(t)).select("source_id", "chunk_idx", "source", "predicate", "target")


@query("SELECT CAST(l_orderkey AS VARCHAR) AS source_id, l_linenumber AS chunk_idx, 'S' || l_suppkey AS source, 'SELLS_TO' AS predicate, 'P' || l_partkey AS target FROM lineitem WHERE l_linenumber <> 3")
def relation_items_each(t):
    return extract.relation_items(_answers(t), strict=False).select("source_id", "chunk_idx", "source", "predicate", "target")


@query(
    "WITH i AS (SELECT l_orderkey AS doc, l_linenumber AS n, (CAST(l_linenumber AS BIGINT) * 1000000 + l_partkey) * 100000 + l_suppkey AS o, 'S' || l_suppkey % 3 AS name, CASE l_returnflag WHEN 'A' THEN 'DATE' WHEN 'N' THEN 'EVENT' ELSE 'PERSON' END AS type, CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 1 ELSE 0 END AS p, CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus || l_linenumber ELSE '' END AS d, "
    "CASE WHEN l_linenumber = 2 THEN l_partkey || '만' ELSE 'P' || l_partkey % 5 END AS target FROM lineitem) "
    "SELECT doc, name, arg_min(type, (p, o)) AS type, coalesce(arg_min(d, o) FILTER (WHERE d <> ''), '') AS description FROM i GROUP BY doc, name "
    "UNION ALL SELECT DISTINCT doc, target, 'OTHER', '' FROM i WHERE n <> 2"
)
def reconciled_entities(t):
    """One entity for each name of an order: the type that ranks first, the first description; targets that nothing lists are added, mere numbers aren't."""
    n = F.col("l_linenumber")
    key = [F.lit("c").alias("collection"), F.col("l_orderkey").cast("string").alias("source_id"), F.lit(0).alias("chunk_idx"), F.struct(F.lit(0).alias("turn"), ((n.cast("long") * 1_000_000 + F.col("l_partkey")) * 100_000 + F.col("l_suppkey")).alias("at")).alias("seq")]
    name = F.concat(F.lit("S"), (F.col("l_suppkey") % 3).cast("string"))
    kind = F.when(F.col("l_returnflag") == "A", "DATE").when(F.col("l_returnflag") == "N", "EVENT").otherwise("PERSON")
    told = F.when(n % 2 == 0, F.concat("l_linestatus", n.cast("string"))).otherwise("")
    target = F.when(n == 2, F.concat(F.col("l_partkey").cast("string"), F.lit("만"))).otherwise(F.concat(F.lit("P"), (F.col("l_partkey") % 5).cast("string")))
    e = t.lineitem.select(*key, name.alias("name"), kind.alias("type"), told.alias("description"), F.array().cast("array<string>").alias("aliases"))
    r = t.lineitem.select(*key, name.alias("source"), F.lit("P").alias("predicate"), target.alias("target"), F.lit("").alias("valid_from"))
    return extract.reconcile(e, r)[0].select(F.col("source_id").cast("long").alias("doc"), "name", "type", "description")


BACKENDS = [*DECOMPOSED_BACKENDS, "gemini", "other"]


@query(
    f"SELECT doc_id, mode, backend, CASE WHEN mode <> 'auto' THEN mode WHEN backend IN {DECOMPOSED_BACKENDS!r} THEN 'decomposed' ELSE 'single' END AS chosen "
    f"FROM (SELECT doc_id, ['auto', 'single', 'decomposed'][doc_id % 3 + 1] AS mode, {list(BACKENDS)!r}[doc_id // 3 % {len(BACKENDS)} + 1] AS backend FROM documents)"
)
def extraction_modes(t):
    """Every document asks for a mode and goes to a backend, dealt by its id."""
    modes = ("auto", "single", "decomposed")
    at = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (n + 1).cast("int"))
    asked = t.documents.select("doc_id", at(modes, F.col("doc_id") % 3).alias("mode"), at(BACKENDS, F.floor(F.col("doc_id") / 3) % len(BACKENDS)).alias("backend"))
    chosen = _of(t, [(m, b, extract.extraction_mode(m, b)) for m in modes for b in BACKENDS], "mode string, backend string, chosen string")
    return asked.join(F.broadcast(chosen), ["mode", "backend"]).select("doc_id", "mode", "backend", "chosen")


@query(f"WITH {PIECES} SELECT doc_id, false AS fast, k <= 3 AS auto, true AS quality FROM n")
def type_splits(t):
    n = chunk_count(_unbroken(), 1960, 392)
    return t.documents.select("doc_id", *[extract.type_split(x, n).alias(x) for x in ("fast", "auto", "quality")])


ASK, ASK_NAMES = f"Extract entities and relations as JSON. Prefer these predicates: {', '.join(SEED_PREDICATES)}.", "Extract entities as JSON."


def _prompt_sql(ask: str, predicates: str) -> str:
    return (
        "names AS (SELECT DISTINCT split_part(text, ' ', 1) AS name FROM documents WHERE split_part(text, ' ', 1) <> ''), "
        "hints AS (SELECT conv_id, turn, name, row_number() OVER (PARTITION BY conv_id, turn ORDER BY name) AS i FROM conversations JOIN names ON contains(text, name)), "
        "told AS (SELECT conv_id, turn, string_agg(name, ', ' ORDER BY i) AS names FROM hints WHERE i <= 30 GROUP BY 1, 2), "
        f"p AS (SELECT c.conv_id, c.turn, '{ask}' || chr(10) || CASE WHEN names IS NULL THEN '' ELSE 'Known names: ' || names || chr(10) END || {predicates} || 'Text:' || chr(10) || text AS prompt FROM conversations c LEFT JOIN told t ON t.conv_id = c.conv_id AND t.turn = c.turn WHERE text IS NOT NULL)"
    )


def _talk(t: B.Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations as chunks, and the documents' first words as known names."""
    rows = t.conversations.where("text is not null").select(F.lit("c").alias("collection"), F.col("conv_id").cast("string").alias("source_id"), F.col("turn").cast("int").alias("chunk_idx"), "text")
    first = F.element_at(F.split("text", " "), 1)
    names = t.documents.select(F.lit("c").alias("collection"), first.alias("name")).where("name <> ''").distinct()
    links = _of(t, [("c", "a", "b", "OWNS", "", ""), ("c", "a", "b", "MANAGES", "", "")], TABLES["relations"])
    return rows, names, links


@query(f"""WITH {_prompt_sql(ASK, "'Known predicates: MANAGES, OWNS' || chr(10)")} SELECT CAST(conv_id AS VARCHAR) AS source_id, CAST(turn AS INTEGER) AS chunk_idx, sha256(prompt) AS prompt FROM p""")
def extraction_prompts(t):
    return extract.prompts(*_talk(t)).select("source_id", "chunk_idx", F.sha2("prompt", 256).alias("prompt"))


@query(
    f"""WITH {_prompt_sql(ASK_NAMES, "''")}, g AS (SELECT * FROM (VALUES ('PERSON', 'people, by name'), ('ORGANIZATION', 'companies, institutions and other organisations'), ('LOCATION', 'places, regions and facilities'), ('OBJECT', 'objects, works, concepts and events'), ('ALL', 'entities of every type')) AS v(type_group, told)) """
    "SELECT CAST(conv_id AS VARCHAR) AS source_id, CAST(turn AS INTEGER) AS chunk_idx, type_group, sha256('Give only ' || told || '.' || chr(10) || prompt) AS prompt FROM p JOIN g ON (type_group = 'ALL') = (turn % 2 = 1)"
)
def entity_pass_prompts(t):
    """Chunks of even turns are asked once for each group of types, the others once."""
    rows, names, _ = _talk(t)
    asked = extract.group_prompts(extract.prompts(rows, names, None), F.col("chunk_idx") % 2 == 0)
    return asked.select("source_id", "chunk_idx", "type_group", F.sha2("prompt", 256).alias("prompt"))


def _people(t: B.Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = t.customer.select(F.lit("c").alias("collection"), F.col("c_custkey").cast("string").alias("source_id"), F.lit(0).alias("chunk_idx"), F.col("c_name").alias("text"))
    return rows, _of(t, [], TABLES["entities"]), _of(t, [], TABLES["relations"])


def _said(*names: str, links: tuple = ()) -> str:
    return json.dumps({"entities": [{"name": n, "type": "PERSON"} for n in names], "relations": [{"source": a, "predicate": "knows", "target": b} for a, b in links]})


def _single(prompt: str) -> str:
    name = prompt.split("Text:\n")[1]
    if name.endswith("7"):
        raise ProviderError("busy")
    return "not json" if name.endswith("3") else _said(name)


@query("SELECT CAST(c_custkey AS VARCHAR) AS source_id, c_name AS name FROM customer WHERE right(c_name, 1) NOT IN ('3', '7')")
def extract_single(t):
    """A call that fails, or an answer that is no JSON, leaves its chunk out."""
    return extract.extract(*_people(t), Scripted(_single))[0].select("source_id", "name")


def _decomposed(prompt: str) -> str:
    if prompt.startswith("Relations among: "):
        return _said(links=((prompt.split("\n")[0].removeprefix("Relations among: "), "HQ"),))
    return _said(prompt.split("Text:\n")[1]) if "people, by name" in prompt else "broken"


@query("SELECT CAST(c_custkey AS VARCHAR) AS source_id, unnest([c_name, 'HQ']) AS name, unnest(['PERSON', 'OTHER']) AS type FROM customer")
def extract_decomposed(t):
    """One group of types answers, three fail; the relation's other end is added."""
    return extract.extract(*_people(t), Scripted(_decomposed), mode="decomposed")[0].select("source_id", "name", "type")


def _gleaned(prompt: str) -> str:
    name = prompt.split("Text:\n")[1].split("\n")[0]
    more = "\nAlready found: " in prompt and int(name[-1]) % 2 == 0
    return _said(name, name + " jr") if more else _said(name)


@query("SELECT CAST(c_custkey AS VARCHAR) AS source_id, CAST(CASE WHEN CAST(right(c_name, 1) AS INTEGER) % 2 = 0 THEN 3 ELSE 2 END AS BIGINT) AS calls, CASE WHEN CAST(right(c_name, 1) AS INTEGER) % 2 = 0 THEN 2 ELSE 1 END AS names FROM customer")
def gleaning_calls(t):
    """Further turns of three at most: a chunk that gained nothing is asked no more."""
    found, _, calls = extract.extract(*_people(t), Scripted(_gleaned), Settings(glean_rounds=3))
    n = calls.groupBy("source_id").agg(F.count(F.lit(1)).alias("calls"))
    return n.join(found.groupBy("source_id").agg(F.count(F.lit(1)).cast("int").alias("names")), "source_id")


@query(
    "WITH e AS (SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events) SELECT event_id, CASE WHEN k % 4 < 2 THEN 't' || k END AS title, CASE WHEN k % 4 < 2 THEN 's' END AS summary, CASE WHEN k % 4 = 0 THEN k / 2 END AS rating FROM e"
)
def parsed_reports(t):
    k = F.regexp_extract("props", "[0-9]+", 0).cast("long")
    body = lambda rating: F.concat(F.lit('{"title": "t'), k.cast("string"), F.lit('", "summary": "s", "rating": '), rating, F.lit("}"))
    said = F.when(k % 4 == 0, body((k / 2).cast("string"))).when(k % 4 == 1, body(F.lit('"high"'))).when(k % 4 == 2, F.lit('{"title": "t", "summary": " "}')).otherwise("no")
    return t.events.select("event_id", reports.parsed_report(said).alias("r")).select("event_id", "r.title", "r.summary", "r.rating")


# The graph


@query(f"WITH {ENTITIES} SELECT e.collection, e.name, CASE WHEN c_custkey % 2 = 1 THEN 'said ' || c_custkey ELSE e.description END AS description FROM entities e LEFT JOIN customer ON e.name = c_name")
def description_update(t):
    geo = F.broadcast(B.geography(t))
    new = t.customer.where("c_custkey % 2 = 1").join(geo, F.col("c_nationkey") == F.col("n_nationkey")).select("collection", F.col("c_name").alias("name"), F.concat(F.lit("said "), F.col("c_custkey").cast("string")).alias("description"))
    return G.update_descriptions(B.entities(t), new).select("collection", "name", "description")


@query(GRAPH + "SELECT * FROM relations WHERE source_doc <> 'order_3'")
def relations_without_source(t):
    return G.delete_relations_of(B.relations(t), "order_3")


@query(f"WITH {ENTITIES}, {BRIDGES} SELECT * FROM bridges WHERE 'ASIA' NOT IN (collection_lo, collection_hi)")
def bridges_removed(t):
    """Bridges of one region are removed, named in the other order than they are stored."""
    own = _bridges(t)
    gone = own.where("'ASIA' in (collection_lo, collection_hi)").select(F.col("collection_hi").alias("collection_a"), F.col("name_hi").alias("name_a"), F.col("collection_lo").alias("collection_b"), F.col("name_lo").alias("name_b"))
    return G.remove_bridges(own, gone)


@query(f"WITH {ENTITIES}, {BRIDGES} SELECT collection_hi AS collection_a, name_hi AS name_a, collection_lo AS collection_b, name_lo AS name_b FROM bridges")
def bridged_pairs(t):
    """Of asked pairs, in the other order, those that a bridge joins; an entity with itself and with another part are not."""
    swapped = _bridges(t).select(F.col("collection_hi").alias("collection_a"), F.col("name_hi").alias("name_a"), F.col("collection_lo").alias("collection_b"), F.col("name_lo").alias("name_b"))
    other = swapped.withColumn("name_b", F.concat("name_b", F.lit(" not")))
    return G.bridged(_bridges(t), swapped.unionByName(other).unionByName(swapped.select("collection_a", "name_a", F.col("collection_a").alias("collection_b"), F.col("name_a").alias("name_b"))))


@query(GRAPH + ", ends AS (SELECT collection, source AS name FROM relations WHERE predicate <> 'LOCATED_IN' UNION SELECT collection, target FROM relations WHERE predicate <> 'LOCATED_IN') SELECT e.collection, e.name FROM entities e JOIN ends USING (collection, name)")
def isolated_dropped(t):
    return G.drop_isolated(B.entities(t), B.relations(t).where("predicate <> 'LOCATED_IN'")).select("collection", "name")


@query(f"WITH {GEO} SELECT collection, c_name AS name FROM customer JOIN geo ON c_nationkey = n_nationkey")
def existing_entities(t):
    asked = t.customer.join(F.broadcast(B.geography(t)), F.col("c_nationkey") == F.col("n_nationkey")).select("collection", F.explode(F.array("c_name", F.concat(F.lit("no "), "c_name"))).alias("name"))
    return G.existing(B.entities(t), asked)


@query(f"WITH {GEO} SELECT collection, c_name || p AS candidate, CASE WHEN p IN ('가', '은') THEN c_name END AS name FROM customer JOIN geo ON c_nationkey = n_nationkey, (SELECT unnest(['가', '은', '도']) AS p)")
def alias_resolution_stripped(t):
    own = t.customer.join(F.broadcast(B.geography(t)), F.col("c_nationkey") == F.col("n_nationkey"))
    asked = own.select("collection", F.explode(F.array(*[F.concat("c_name", F.lit(p)) for p in ("가", "은", "도")])).alias("candidate"))
    return G.canonical_names(B.entities(t), asked, stripped=True)


# Resolution


def _lettered(t: B.Tables) -> DataFrame:
    return B.vectors(t).select("collection", F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("name"), "vector")


def _blacklist(t: B.Tables) -> DataFrame:
    """The greater id first, so that the order must not matter."""
    return t.embeddings.select(F.concat(F.lit("label_"), F.col("label").cast("string")).alias("collection"), F.lpad((F.col("vec_id") + 10).cast("string"), 12, "0").alias("node_a"), F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("node_b"), F.lit("").alias("reason"))


PAIRED = f"{UNIT}, p AS (SELECT a.collection, lpad(CAST(a.vec_id AS VARCHAR), 12, '0') AS keep, lpad(CAST(b.vec_id AS VARCHAR), 12, '0') AS \"drop\", {COSINE} AS score FROM unit a JOIN unit b ON a.collection = b.collection AND a.vec_id < b.vec_id AND b.vec_id <> a.vec_id + 10)"


@query(f'WITH {PAIRED} SELECT collection, keep, "drop", score FROM p WHERE score > 0.3')
def merge_candidates(t):
    links = _of(t, [], TABLES["relations"])
    return resolve.merge_candidates(_lettered(t), links, 0.3, _blacklist(t), digits=6)


@query(f"WITH {PAIRED} SELECT collection, keep, \"drop\", score, 'about ' || keep AS keep_description, CAST(0 AS BIGINT) AS drop_relations FROM p WHERE score > 0.25 AND score <= 0.3")
def review_candidates(t):
    links = _of(t, [], TABLES["relations"])
    e = _lettered(t).select("collection", "name", F.lit("").alias("type"), F.concat(F.lit("about "), "name").alias("description"), F.array().cast("array<string>").alias("aliases"))
    got = resolve.review_candidates(_lettered(t), e, links, 0.25, 0.3, _blacklist(t), digits=6)
    return got.select("collection", "keep", "drop", "score", F.col("keep_context.description").alias("keep_description"), F.col("drop_context.n_relations").cast("long").alias("drop_relations"))


@query(f"WITH {ENTITIES} SELECT collection, name, upper(replace(name, '#', ' - ')) AS aliases FROM entities WHERE type = 'PERSON'")
def merged_duplicates(t):
    """Each customer and a spelling of it: the one with relations stays and takes the other's name as an alias."""
    own = _variants(t).select("collection", "name", F.lit("PERSON").alias("type"), F.lit("").alias("description"), F.array().cast("array<string>").alias("aliases"))
    links = B.relations(t)
    return resolve.apply_merges(own, links, _no_bridges(t), resolve.normalized_duplicates(own, links))[0].select("collection", "name", F.array_join("aliases", "|").alias("aliases"))


@query(
    f"WITH {GEO}, c AS (SELECT collection, c_name AS name, c_custkey FROM customer JOIN geo ON c_nationkey = n_nationkey) "
    "SELECT 'entity' AS what, collection, name AS a, '' AS b FROM c UNION ALL SELECT 'entity', collection, name || ' II', '' FROM c WHERE c_custkey % 2 = 1 UNION ALL SELECT 'blacklist', collection, name, name || ' II' FROM c WHERE c_custkey % 2 = 1"
)
def review_applied(t):
    """Each customer and its second: even pairs are merged, odd ones blacklisted."""
    own = t.customer.join(F.broadcast(B.geography(t)), F.col("c_nationkey") == F.col("n_nationkey")).select("collection", F.col("c_name").alias("keep"), F.concat("c_name", F.lit(" II")).alias("drop"), (F.col("c_custkey") % 2 == 0).alias("approved"), F.lit("r").alias("reason"))
    e = own.select("collection", F.explode(F.array("keep", "drop")).alias("name"), F.lit("PERSON").alias("type"), F.lit("").alias("description"), F.array().cast("array<string>").alias("aliases"))
    left, _, _, black = resolve.apply_review(e, _of(t, [], TABLES["relations"]), _no_bridges(t), _of(t, [], TABLES["merge_blacklist"]), own)
    return left.select(F.lit("entity").alias("what"), "collection", F.col("name").alias("a"), F.lit("").alias("b")).unionByName(black.select(F.lit("blacklist").alias("what"), "collection", F.col("node_a").alias("a"), F.col("node_b").alias("b")))


@query("SELECT 'c' AS collection, 'S' || s_suppkey AS node_a, 'T' || s_suppkey AS node_b, CASE WHEN s_suppkey % 2 = 0 THEN 'old' ELSE 'new' END AS reason FROM supplier WHERE s_suppkey % 3 <> 0")
def blacklist_edited(t):
    """Even pairs are there; all are added, in the other order; then every third is removed."""
    k = F.col("s_suppkey").cast("string")
    pair = lambda df, first, reason: df.select(F.lit("c").alias("collection"), F.concat(F.lit(first[0]), k).alias("node_a"), F.concat(F.lit(first[1]), k).alias("node_b"), F.lit(reason).alias("reason"))
    added = resolve.add_blacklist(pair(t.supplier.where("s_suppkey % 2 = 0"), "ST", "old"), pair(t.supplier, "TS", "new"))
    return resolve.remove_blacklist(added, pair(t.supplier.where("s_suppkey % 3 = 0"), "TS", ""))


# Vectors


def _chunk_rows(t: B.Tables) -> DataFrame:
    return t.documents.select(F.col("lang").alias("collection"), F.col("doc_id").cast("string").alias("source_id"), (F.col("doc_id") % 3).cast("int").alias("chunk_idx"), F.col("source").alias("text"), F.array(F.lit(1.0)).cast("array<float>").alias("embedding"))


@query("SELECT CAST(doc_id AS VARCHAR) AS source_id, CAST(doc_id % 3 AS INTEGER) AS chunk_idx, CASE WHEN doc_id % 2 = 0 THEN 'newer' ELSE source END AS text FROM documents UNION ALL SELECT 'n' || doc_id, 0, 'newer' FROM documents WHERE doc_id % 2 = 0")
def chunk_upsert(t):
    """Even documents' chunks come again, twice each, and as many new ones."""
    even = _chunk_rows(t).where("cast(source_id as long) % 2 = 0")
    new = even.withColumn("source_id", F.concat(F.lit("n"), "source_id")).withColumn("chunk_idx", F.lit(0))
    both = even.unionByName(new)
    return vectors.upsert_chunks(_chunk_rows(t), both.withColumn("text", F.lit("new")).unionByName(both.withColumn("text", F.lit("newer")))).select("source_id", "chunk_idx", "text")


@query("SELECT CAST(doc_id AS VARCHAR) AS source_id, lang AS collection FROM documents WHERE lang <> 'es' AND doc_id <> 5")
def chunk_deletes(t):
    return vectors.delete_chunks(vectors.delete_chunks(_chunk_rows(t), source_id="5"), collection="es").select("source_id", "collection")


@query("SELECT lang AS collection, count(*) AS n_chunks FROM documents WHERE lang IN ('en', 'de') GROUP BY 1")
def chunk_counts(t):
    return vectors.count_chunks(_chunk_rows(t), ["en", "de"])


@query("SELECT DISTINCT CAST(doc_id AS VARCHAR) AS source_id FROM documents")
def chunk_sources(t):
    return vectors.source_ids(_chunk_rows(t).unionByName(_chunk_rows(t)))


class Measures:
    """A text's characters, its letters e and its spaces as a vector."""

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[float(len(x)), float(x.count("e")), float(x.count(" "))] for x in texts]


def _measured(x: str) -> str:
    return f"[CAST(length({x}) AS DOUBLE), CAST(length({x}) - length(replace({x}, 'e', '')) AS DOUBLE), CAST(length({x}) - length(replace({x}, ' ', '')) AS DOUBLE)]"


@query(f"SELECT doc_id, m[1] AS chars, m[2] AS es, m[3] AS spaces FROM (SELECT doc_id, {_measured('regexp_replace(text, chr(91) || chr(94) || chr(32) || chr(45) || chr(126) || chr(93), chr(32), chr(103))')} AS m FROM documents)")
def embedded_texts(t):
    """Vectors of a provider, in Arrow batches; other than printable ASCII signs count as spaces."""
    v = embedded(F.regexp_replace("text", "[^ -~]", " "), Measures())
    return t.documents.select("doc_id", v.alias("v")).select("doc_id", *[F.col("v")[i].cast("double").alias(n) for i, n in enumerate(("chars", "es", "spaces"))])


@query(f"WITH {UNIT} SELECT b.vec_id, {COSINE} AS score FROM unit a, unit b WHERE a.vec_id = 0 ORDER BY {FULL_COSINE} DESC, b.vec_id LIMIT 12")
def single_top_k(t):
    """One question's nearest rows."""
    asked = t.embeddings.where("vec_id = 0").first().embedding
    return vectors.top_k(t.embeddings, asked, 12, key=("vec_id",)).select("vec_id", F.round("score", 6).alias("score"))


# Scopes


@query(f"WITH {GEO}, o AS (SELECT 'ASIA' AS r, 0 AS i UNION ALL SELECT 'EUROPE', 1), n AS (SELECT i, 0 AS j, r AS name FROM o UNION ALL SELECT i, 1, n_name FROM geo JOIN o ON r = collection) SELECT CAST(row_number() OVER (ORDER BY i, j, name) - 1 AS INTEGER) AS place, name FROM n")
def scope_expanded(t):
    return _of(t, list(enumerate(scope.expand_scope(B.hierarchy(t), " ASIA, EUROPE ,, ASIA") or [])), "place int, name string")


@query(
    f"WITH {GEO} SELECT 'parent' AS what, n_name AS a, CASE WHEN n_nationkey = 0 THEN 'NEW' ELSE collection END AS b FROM geo WHERE n_nationkey <> 1 UNION ALL SELECT 'parent', r_name, 'WORLD' FROM region "
    "UNION ALL SELECT 'child', n_name, collection FROM geo WHERE collection = 'ASIA' AND n_nationkey > 1 UNION ALL SELECT 'refused', 'WORLD', n_name FROM geo WHERE n_nationkey = 2 UNION ALL SELECT 'refused', 'ASIA', 'ASIA'"
)
def hierarchy_edits(t):
    """One nation gets another parent, one loses its own; a parent below its child, or itself, is refused."""
    name = {r.n_nationkey: r.n_name for r in B.geography(t).collect()}  # 25 rows
    own = scope.unset_parent(scope.set_parent(B.hierarchy(t), name[0], "NEW"), name[1])
    refused = []
    for child, parent in (("WORLD", name[2]), ("ASIA", "ASIA")):
        try:
            scope.set_parent(own, child, parent)
        except ValueError:
            refused.append(("refused", child, parent))
    told = own.select(F.lit("parent").alias("what"), F.col("collection").alias("a"), F.col("parent").alias("b"))
    kids = scope.children(own, "ASIA").select(F.lit("child").alias("what"), F.col("collection").alias("a"), F.lit("ASIA").alias("b"))
    return told.unionByName(kids).unionByName(_of(t, refused, "what string, a string, b string"))


@query(f"WITH {ENTITIES} SELECT collection FROM entities UNION SELECT source FROM documents")
def scope_of_everything(t):
    return _of(t, [(x,) for x in scope.resolve_scope(None, B.entities(t), B.documents(t))], "collection string")


# Communities and reports


@query(GRAPH + "SELECT collection, least(source, target) AS a, greatest(source, target) AS b, CAST(count(*) AS DOUBLE) AS weight FROM relations GROUP BY 1, 2, 3")
def weighted_edges(t):
    return C.weighted_edges(B.entities(t), B.relations(t))


def _words_sql(text: str, name: str) -> str:
    return ", ".join(f"CAST(sum(CAST('0x' || substr(sha256({text}), {1 + 12 * i}, 12) AS HUGEINT)) AS VARCHAR) AS {name}{i}" for i in range(5))


@query(
    GRAPH
    + f""", e AS (SELECT collection, CAST(count(*) AS VARCHAR) AS n, {_words_sql('name', 'e')} FROM entities GROUP BY 1), r AS (SELECT collection, CAST(count(*) AS VARCHAR) AS m, {_words_sql("concat_ws(chr(31), source, predicate, target, valid_from)", 'r')} FROM relations GROUP BY 1)
SELECT collection, sha256(concat_ws('|', collection, n, {', '.join(f'e{i}' for i in range(5))}, m, {', '.join(f'r{i}' for i in range(5))})) AS graph_signature FROM e JOIN r USING (collection)"""
)
def graph_signatures(t):
    return C.graph_signatures(B.entities(t).repartition(5), B.relations(t))


@query(f"WITH {GEO} SELECT n_name AS community_id, collection, CASE WHEN collection = 'ASIA' THEN 'new' ELSE 'old' END AS graph_signature FROM geo WHERE collection <> 'ASIA' OR n_nationkey % 2 = 0")
def communities_replaced(t):
    geo = B.geography(t).select("collection", F.col("n_name").alias("community_id"), "n_nationkey")
    rows = lambda df, s: df.select("collection", "community_id", F.lit(0).alias("level"), F.lit(None).cast("string").alias("parent_community_id"), F.array("community_id").alias("entity_names"), F.lit(1).alias("size"), F.lit(s).alias("graph_signature"))
    return C.replace_communities(rows(geo, "old"), rows(geo.where("collection = 'ASIA' and n_nationkey % 2 = 0"), "new")).select("community_id", "collection", "graph_signature")


@query("SELECT n_name AS collection, CASE WHEN n_nationkey % 3 = 0 THEN true WHEN n_nationkey % 3 = 1 THEN false ELSE true END AS dirty FROM nation")
def build_states(t):
    """Of nations, some are marked dirty, some clean, some deleted from the state: these count as dirty."""
    own = t.nation.select(F.col("n_name").alias("collection"), "n_nationkey")
    third = lambda i: own.where(F.col("n_nationkey") % 3 == i)
    state = own.select("collection", F.lit(False).alias("dirty"), F.lit("s").alias("graph_signature"))
    state = lifecycle.drop_build_state(lifecycle.mark_dirty(state, third(0)), third(2))
    return lifecycle.is_dirty(state, own)


@query(f"WITH {GEO} SELECT collection, n_name AS community_id, 1 AS level FROM geo WHERE collection IN ('ASIA', 'AFRICA')")
def communities_of_level(t):
    low = _nation_communities(t).withColumn("level", F.lit(1))
    both = low.unionByName(low.withColumn("level", F.lit(0)))
    return C.in_order(both, ["ASIA", "AFRICA"], 1).select("collection", "community_id", "level")


@query(f"WITH {GEO} SELECT collection, n_name AS community_id, 'low' AS title FROM geo UNION ALL SELECT r_name, 'all ' || r_name, 'top' FROM region")
def report_models(t):
    """The level above the others is told by the top model; a parent is made from its children."""
    low = _nation_communities(t).withColumn("level", F.lit(1)).withColumn("parent_community_id", F.concat(F.lit("all "), "collection"))
    high = low.groupBy("collection", F.col("parent_community_id").alias("community_id")).agg(F.array_sort(F.flatten(F.collect_list("entity_names"))).alias("entity_names")).withColumn("level", F.lit(0)).withColumn("parent_community_id", F.lit(None).cast("string"))
    one = lambda x: Scripted(lambda p: json.dumps({"title": x, "summary": "s"}))
    return reports.generate_reports(low.unionByName(high.select(*low.columns)), B.entities(t), B.relations(t), _of(t, [], TABLES["community_reports"]), one("low"), DEFAULTS, one("top")).select("collection", "community_id", "title")


QUESTION = "Where do the merchants meet?"


@query(
    f"WITH r AS (SELECT c_custkey, c_name || chr(10) || repeat('ae ', CAST(c_custkey % 13 AS INTEGER)) AS x FROM customer), s AS (SELECT c_custkey, {_measured('x')} AS v, {_measured(chr(39) + QUESTION + chr(39))} AS q FROM r), "
    "k AS (SELECT c_custkey, list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))) AS score FROM s), o AS (SELECT *, row_number() OVER (ORDER BY score DESC, lpad(CAST(c_custkey AS VARCHAR), 9, '0')) AS i FROM k) "
    'SELECT c_custkey, CAST(i AS INTEGER) AS "rank" FROM o WHERE i <= 20 AND (i <= 3 OR score >= 0.55 * (SELECT max(score) FROM k))'
)
def reports_ranked(t):
    """Reports by the likeness of title and summary to a question."""
    own = t.customer.select(F.lit("c").alias("collection"), F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("community_id"), F.lit(0).alias("level"), F.col("c_name").alias("title"), F.expr("repeat('ae ', cast(c_custkey % 13 as int))").alias("summary"))
    return search.ranked_reports(own, [QUESTION], Measures()).select(F.col("community_id").cast("long").alias("c_custkey"), "rank")


@query(
    "WITH q AS (SELECT n_nationkey, n_name, n_nationkey % 2 = 0 AS whole, CASE WHEN n_nationkey % 2 = 0 THEN 'Who is ' || n_name || '? 그리고 Where is ' || n_name || '?' ELSE n_name || ' 및 the sea trade?' END AS q FROM nation) "
    "SELECT n_nationkey, CAST(0 AS INTEGER) AS part, q AS said FROM q UNION ALL SELECT n_nationkey, 1, 'Who is ' || n_name || '?' FROM q WHERE whole UNION ALL SELECT n_nationkey, 2, 'Where is ' || n_name || '?' FROM q WHERE whole"
)
def questions_split(t):
    """A list of whole questions is split, a list inside one question is not."""
    rows = []
    for r in t.nation.collect():  # 25 rows
        q = f"Who is {r.n_name}? 그리고 Where is {r.n_name}?" if r.n_nationkey % 2 == 0 else f"{r.n_name} 및 the sea trade?"
        rows += [(r.n_nationkey, i, x) for i, x in enumerate(search.subquestions(q))]
    return _of(t, rows, "n_nationkey int, part int, said string")


@query(f"WITH {GEO}, n AS (SELECT collection, n_name, row_number() OVER (PARTITION BY collection ORDER BY n_name) AS i FROM geo) SELECT collection, string_agg('[본문 ' || i || ']' || chr(10) || n_name, chr(10) || '---' || chr(10) ORDER BY i) AS told FROM n GROUP BY 1")
def numbered_texts(t):
    """Texts of a region, each once, without blank ones."""
    names: dict[str, list[str]] = {}
    for r in B.geography(t).orderBy("n_name").collect():  # 25 rows
        names.setdefault(r.collection, []).extend([r.n_name, f" {r.n_name} ", " "])
    return _of(t, [(k, search.text_context(v)) for k, v in names.items()], "collection string, told string")


# Documents and their store


@query("SELECT doc_id, 'doc_' || substr(sha256(concat_ws(chr(31), source, doc_id || '.txt', sha256(text))), 1, 16) AS source_id FROM documents")
def new_source_ids(t):
    own = B.documents(t).withColumnRenamed("source_id", "doc_id").withColumn("content_hash", T.content_hash(F.col("content")))
    return lifecycle.new_source_ids(own).select(F.col("doc_id").cast("long").alias("doc_id"), "source_id")


def _documents(t: B.Tables) -> DataFrame:
    return B.documents(t).select("source_id", "collection", "file_name", "content", T.content_hash(F.col("content")).alias("content_hash"), F.lit(None).cast("timestamp").alias("last_modified"))


@query("SELECT source AS collection, doc_id || '.txt' AS file_name, CAST(doc_id AS VARCHAR) AS source_id, sha256(text) AS content_hash FROM documents UNION ALL SELECT source, doc_id || '.md', NULL, NULL FROM documents")
def document_lookups(t):
    """Every file, and one that isn't stored beside it."""
    keys = B.documents(t).select("collection", F.explode(F.array("file_name", F.concat("source_id", F.lit(".md")))).alias("file_name"))
    return lifecycle.content_hash_of(_documents(t), keys)


@query("SELECT CAST(doc_id AS VARCHAR) AS source_id, doc_id || '.txt' AS file_name FROM documents WHERE source = (SELECT min(source) FROM documents)")
def document_names(t):
    return lifecycle.source_names(_documents(t), [_documents(t).agg(F.min("collection")).first()[0]])


def _newer(t: B.Tables) -> DataFrame:
    return _documents(t).where("cast(source_id as long) % 2 = 0").withColumn("source_id", F.concat(F.lit("n"), "source_id"))


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN 'n' ELSE '' END || doc_id AS source_id, doc_id || '.txt' AS file_name FROM documents")
def documents_upserted(t):
    return lifecycle.upsert_documents(_documents(t), _newer(t)).select("source_id", "file_name")


@query("SELECT 'chunk' AS what, CAST(doc_id AS VARCHAR) AS source FROM documents WHERE doc_id % 2 = 1 UNION ALL SELECT 'relation', CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 2 = 1 UNION ALL SELECT 'candidate', CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 2 = 1")
def document_replaced(t):
    """What came from the documents that newer ones retire goes with them."""
    gone = lifecycle.superseded(_documents(t), _newer(t))
    kept = lifecycle.without_sources(gone, _chunk_rows(t), _links(t), _candidates(t))
    return kept[0].select(F.lit("chunk").alias("what"), F.col("source_id").alias("source")).unionByName(kept[1].select(F.lit("relation").alias("what"), F.col("source_doc").alias("source"))).unionByName(kept[2].select(F.lit("candidate").alias("what"), F.col("source_doc").alias("source")))


def _links(t: B.Tables) -> DataFrame:
    return B.documents(t).select("collection", F.col("source_id").alias("source"), F.lit("all").alias("target"), F.lit("P").alias("predicate"), F.lit("").alias("valid_from"), F.col("source_id").alias("source_doc"))


def _candidates(t: B.Tables) -> DataFrame:
    return B.documents(t).select("collection", F.col("source_id").alias("entity_name"), F.col("source_id").alias("source_doc"), F.lit("d").alias("description"))


def _store(t: B.Tables) -> Store:
    """A store of the documents with a chunk, an entity, a relation and a candidate each."""
    store = Store(t.spark, staged_path(t.spark, "store"))
    own = B.documents(t)
    store.commit(
        documents=_documents(t), chunks=own.select("collection", "source_id", F.lit(0).alias("chunk_idx"), F.lit("").alias("text"), F.array().cast("array<float>").alias("embedding")), relations=_links(t), entity_desc_candidates=_candidates(t),
        entities=own.select("collection", F.col("source_id").alias("name"), F.lit("OTHER").alias("type"), F.lit("").alias("description"), F.array().cast("array<string>").alias("aliases")),
        merge_blacklist=own.select("collection", F.lit("a").alias("node_a"), F.lit("b").alias("node_b"), F.lit("").alias("reason")).distinct(), ingest_progress=own.select("collection", F.lit("f").alias("file_name"), F.lit("s").alias("source_id"), F.lit("h").alias("content_hash"), F.lit(2).alias("total_chunks"), F.lit(1).alias("done_chunks")).distinct(),
        community_build_state=own.select("collection").distinct().select("collection", F.lit(False).alias("dirty"), F.lit("").alias("graph_signature")), collection_meta=own.select("collection", F.lit("top").alias("parent")).distinct(),
    )
    return store


def _sizes(store: Store, names: tuple[str, ...]) -> DataFrame:
    out = None
    for name in names:
        row = store.table(name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("WITH n AS (SELECT count(*) AS n FROM documents) SELECT unnest(['documents', 'chunks', 'relations', 'entity_desc_candidates', 'entities', 'dirty']) AS what, unnest([n - 1, n - 1, n - 1, n - 1, n, 1]) AS n FROM n")
def document_deleted(t):
    """One document with its chunk, relation and candidate; its entity stays, its collection is dirty."""
    store = _store(t)
    one = B.documents(t).where("source_id = '5'").first()
    ingest.delete_document(store, one.collection, one.file_name)
    dirty = store.table("community_build_state").where("dirty").agg(F.count(F.lit(1)).alias("n")).select(F.lit("dirty").alias("what"), "n")
    return _sizes(store, ("documents", "chunks", "relations", "entity_desc_candidates", "entities")).unionByName(dirty)


@query(
    "WITH c AS (SELECT min(source) AS c, count(DISTINCT source) AS k FROM documents), n AS (SELECT count(*) AS n, any_value(k) AS k FROM documents, c WHERE source <> c) "
    "SELECT unnest(['documents', 'chunks', 'entities', 'relations', 'entity_desc_candidates', 'community_build_state', 'ingest_progress', 'merge_blacklist', 'collection_meta']) AS what, unnest([n, n, n, n, n, k - 1, k, k, k]) AS n FROM n"
)
def collection_deleted(t):
    """A collection with all that hangs on it; progress, blacklist and hierarchy stay."""
    store = _store(t)
    ingest.delete_collection(store, B.documents(t).agg(F.min("collection")).first()[0])
    return _sizes(store, ("documents", "chunks", "entities", "relations", "entity_desc_candidates", "community_build_state", "ingest_progress", "merge_blacklist", "collection_meta"))


@query("WITH n AS (SELECT count(*) FILTER (WHERE doc_id % 4 <> 0) AS n, count(*) AS m FROM documents) SELECT unnest(['chunks', 'relations', 'entity_desc_candidates', 'entities']) AS what, unnest([n, n, n, m]) AS n FROM n")
def orphans_collected(t):
    """Every fourth document's row is gone; what referred to it goes."""
    store = _store(t)
    store.commit(documents=store.table("documents").where("cast(source_id as long) % 4 <> 0"))
    ingest.collect_orphans(store)
    return _sizes(store, ("chunks", "relations", "entity_desc_candidates", "entities"))


@query("SELECT 1 AS version, count(*) AS n FROM documents UNION ALL SELECT 2, 0 UNION ALL SELECT 3, count(*) FROM documents")
def store_versions(t):
    """A second version empties a table; restoring the first makes a third; a copy outlives both."""
    store = _store(t)
    seen = [(1, store.table("documents").count())]
    store.commit(documents=store.table("documents").limit(0))
    seen.append((2, store.table("documents").count()))
    store.restore(1)
    copy = store.backup(staged_path(t.spark, "copies"))
    store.commit(documents=store.table("documents").limit(0))
    store.restore_copy(copy)
    return _of(t, [*seen, (3, store.table("documents").count())], "version int, n long")


PROGRESS = "f AS (SELECT o_orderkey AS k, 1 + o_orderkey % 4 AS total, o_orderkey % 3 AS same, o_orderkey % 5 AS held FROM orders)"


@query(
    f"WITH {PROGRESS} SELECT CAST(k AS VARCHAR) AS file_name, CAST(CASE WHEN held <> 0 AND same = 0 AND held <> 1 THEN least(total, 2) ELSE 0 END AS INTEGER) AS first_chunk, CASE WHEN held <> 0 AND same = 0 THEN 's' || k END AS resumed_id FROM f"
)
def ingest_resumed(t):
    """Broken-off files go on where they stopped if content and chunks are the same; with another number of chunks they keep their id; else they start anew."""
    k = F.col("o_orderkey")
    name, total = k.cast("string").alias("file_name"), (1 + k % 4).cast("int")
    held = t.orders.where(k % 5 != 0).select(F.lit("c").alias("collection"), name, F.concat(F.lit("s"), k.cast("string")).alias("source_id"), F.lit("h").alias("content_hash"), F.when(k % 5 == 1, total + 1).otherwise(total).alias("total_chunks"), F.lit(0).alias("done_chunks"))
    done = lifecycle.mark_done(held, t.orders.select(F.lit("c").alias("collection"), name, F.least(total, F.lit(2)).alias("done_chunks")))
    asked = t.orders.select(F.lit("c").alias("collection"), name, F.when(k % 3 == 0, "h").otherwise("other").alias("content_hash"), total.alias("total_chunks"))
    return lifecycle.resumable(done, asked).select("file_name", "first_chunk", "resumed_id")


@query("SELECT 'c' AS collection, CAST(o_orderkey AS VARCHAR) AS file_name, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE 'old' END AS source_id FROM orders WHERE o_orderkey % 3 <> 0")
def progress_kept(t):
    """Even files start again, every third ends."""
    row = lambda df, s: df.select(F.lit("c").alias("collection"), F.col("o_orderkey").cast("string").alias("file_name"), F.lit(s).alias("source_id"), F.lit("h").alias("content_hash"), F.lit(3).alias("total_chunks"), F.lit(0).alias("done_chunks"))
    state = lifecycle.start_progress(row(t.orders, "old"), row(t.orders.where("o_orderkey % 2 = 0"), "new"))
    return lifecycle.end_progress(state, row(t.orders.where("o_orderkey % 3 = 0"), "")).select("collection", "file_name", "source_id")


@query(
    GRAPH
    + ", ends AS (SELECT collection, source AS name FROM relations UNION SELECT collection, target FROM relations) SELECT 'entities' AS what, count(*) AS n FROM entities UNION ALL SELECT 'relations', count(*) FROM relations UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'chunks', count(*) FROM documents "
    "UNION ALL SELECT 'types', count(DISTINCT type) FROM entities UNION ALL SELECT 'predicates', count(DISTINCT predicate) FROM relations UNION ALL SELECT 'collections', count(DISTINCT collection) FROM entities UNION ALL SELECT 'isolated', (SELECT count(*) FROM entities) - (SELECT count(*) FROM entities JOIN ends USING (collection, name))"
)
def status_figures(t):
    return lifecycle.status(B.entities(t), B.relations(t), B.documents(t), _chunk_rows(t))
