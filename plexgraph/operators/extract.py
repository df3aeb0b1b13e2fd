"""Extraction: prompts, validation of what a model returns, and reconciliation.

Items are rows (collection, source_id, chunk_idx, seq, ...); seq gives them a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.text import clean_aliases, entity_type, first_person, is_noise_name, predicate, strip_fence
from ..providers import LanguageModel, generated
from ..schema import DECOMPOSED_BACKENDS, SEED_PREDICATES, TYPE_PRIORITY
from ..staging import stage
from .mentions import mentions

CHUNK = ["collection", "source_id", "chunk_idx"]
ENTITY = "struct<name:string,id:string,text:string,entity:string,label:string,type:string,description:string,aliases:array<string>>"
RELATION = "struct<source:string,subject:string,from:string,target:string,object:string,to:string,predicate:string,valid_from:string>"
RESULT = f"struct<entities:array<{ENTITY}>,relations:array<{RELATION}>>"

#: What each pass asks for.
TYPE_GROUPS = (
    ("PERSON", "people, by name"),
    ("ORGANIZATION", "companies, institutions and other organisations"),
    ("LOCATION", "places, regions and facilities"),
    ("OBJECT", "objects, works, concepts and events"),
)


def _blank(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", "") == ""


def prompts(chunks: DataFrame, entities: DataFrame, relations: DataFrame | None, settings: Settings = DEFAULTS) -> DataFrame:
    """chunks with prompt: known names that occur in the chunk (the first max_name_hints), known predicates (none without relations), and the text."""
    keyed = chunks.select("collection", F.struct("source_id", "chunk_idx").alias("chunk"), "text")
    met = mentions(keyed, entities.select("collection", "name", F.col("name").alias("hint")), "chunk", "hint", ["collection"]).select("collection", "chunk.*", F.col("hint").alias("name"))
    nth = F.row_number().over(Window.partitionBy(*CHUNK).orderBy("name"))
    hints = met.withColumn("nth", nth).where(F.col("nth") <= settings.max_name_hints).groupBy(*CHUNK).agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))
    both = chunks.join(hints, CHUNK, "left")
    if relations is None:
        both = both.withColumn("predicates", F.lit(None).cast("string"))
    else:
        known = relations.select("collection", "predicate").distinct().groupBy("collection").agg(F.array_join(F.array_sort(F.collect_list("predicate")), ", ").alias("predicates"))
        both = both.join(known, "collection", "left")
    names_line = F.when(F.col("names").isNotNull(), F.concat(F.lit("Known names: "), F.col("names"), F.lit("\n"))).otherwise("")
    predicates_line = F.when(F.col("predicates").isNotNull(), F.concat(F.lit("Known predicates: "), F.col("predicates"), F.lit("\n"))).otherwise("")
    ask = "Extract entities as JSON.\n" if relations is None else f"Extract entities and relations as JSON. Prefer these predicates: {', '.join(SEED_PREDICATES)}.\n"
    return both.select(*chunks.columns, F.concat(F.lit(ask), names_line, predicates_line, F.lit("Text:\n"), F.col("text")).alias("prompt"))


def group_prompts(prompted: DataFrame, split: Column) -> DataFrame:
    """One prompt for each type group where split holds, else one for all: a bounded product of at most four."""
    groups = F.when(split, F.array(*[F.lit(g) for g, _ in TYPE_GROUPS])).otherwise(F.array(F.lit("ALL")))
    told = F.create_map(*[F.lit(x) for g in (*TYPE_GROUPS, ("ALL", "entities of every type")) for x in g])
    return prompted.withColumn("type_group", F.explode(groups)).withColumn("prompt", F.concat(F.lit("Give only "), told[F.col("type_group")], F.lit(".\n"), F.col("prompt")))


def _name(x: Column) -> Column:
    return F.coalesce(x["name"], x["id"], x["text"], x["entity"], x["label"])


def _source(x: Column) -> Column:
    return F.coalesce(x["source"], x["subject"], x["from"])


def _target(x: Column) -> Column:
    return F.coalesce(x["target"], x["object"], x["to"])


def parsed(raw: Column) -> Column:
    return F.from_json(strip_fence(raw), RESULT)


def valid_result(result: Column) -> Column:
    """Whether a whole result holds: the entities are there and no item lacks what it must have."""
    entities = F.forall(F.coalesce(result["entities"], F.array().cast(f"array<{ENTITY}>")), lambda e: ~_blank(_name(e)))
    relations = F.forall(F.coalesce(result["relations"], F.array().cast(f"array<{RELATION}>")), lambda r: ~_blank(_source(r)) & ~_blank(_target(r)) & ~_blank(r["predicate"]))
    return result.isNotNull() & (result["entities"].isNotNull() | result["relations"].isNotNull()) & F.coalesce(entities & relations, F.lit(False))


def _results(responses: DataFrame, strict: bool) -> DataFrame:
    """(CHUNK, turn, result) of responses that are JSON, dealt by chunk, as a few files may hold them all.

    A generator stands between a result and the filters on it: they would each parse the response again."""
    turn = F.col("turn") if "turn" in responses.columns else F.lit(0)
    dealt = responses.select(*CHUNK, turn.alias("turn"), "response").repartition(*CHUNK)
    own = dealt.select(*CHUNK, "turn", F.explode(F.array(parsed(F.col("response")))).alias("result")).where("result is not null")
    return own.where(valid_result(F.col("result"))) if strict else own


def entity_items(responses: DataFrame, strict: bool = True, drop_noise: bool = False) -> DataFrame:
    """One row for each entity of responses (CHUNK, response, and turn if several share a chunk).

    strict drops the whole response if any item is bad; otherwise bad items go one by one."""
    e = F.col("item")
    rows = _results(responses, strict).select(*CHUNK, "turn", F.posexplode("result.entities").alias("at", "item")).where(~_blank(_name(e)))
    name = F.regexp_replace(_name(e), r"(?U)^\s+|\s+$", "")
    out = rows.select(*CHUNK, F.struct("turn", "at").alias("seq"), name.alias("name"), entity_type(F.coalesce(e["type"], F.lit(""))).alias("type"), F.coalesce(e["description"], F.lit("")).alias("description"), clean_aliases(name, e["aliases"]).alias("aliases"))
    return out.where(~is_noise_name(F.col("name"))) if drop_noise else out


def relation_items(responses: DataFrame, strict: bool = True) -> DataFrame:
    r = F.col("item")
    trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    rows = _results(responses, strict).select(*CHUNK, "turn", F.posexplode("result.relations").alias("at", "item")).where(~_blank(_source(r)) & ~_blank(_target(r)) & ~_blank(r["predicate"]))
    return rows.select(*CHUNK, F.struct("turn", "at").alias("seq"), trim(_source(r)).alias("source"), predicate(r["predicate"]).alias("predicate"), trim(_target(r)).alias("target"), F.coalesce(r["valid_from"], F.lit("")).alias("valid_from"))


def priority(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in TYPE_PRIORITY.items() for x in kv])[kind]


def reconcile(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One entity for each name and one relation for each ordered pair of a chunk; missing ends become OTHER entities.

    Entities and ends meet in one grouping by chunk and name.  A noise name is never an entity, so a relation
    that has one goes by its own row."""
    real = entities.where(~is_noise_name(F.col("name")))
    noisy = is_noise_name(F.col("source")) | is_noise_name(F.col("target"))
    good = relations.where(~F.coalesce(noisy, F.lit(False)))
    first = good.withColumn("nth", F.row_number().over(Window.partitionBy(*CHUNK, "source", "target").orderBy("seq"))).where("nth = 1").select(*relations.columns)
    kept = real.select(*CHUNK, "name", "seq", "type", "description", "aliases", F.lit(True).alias("own"))
    ends = good.select(*CHUNK, F.explode(F.array("source", "target")).alias("name"), "seq", F.lit(False).alias("own"))
    own = F.col("own")
    met = kept.unionByName(ends, allowMissingColumns=True).groupBy(*CHUNK, "name").agg(
        F.coalesce(F.min(F.when(own, F.col("seq"))), F.min("seq")).alias("seq"),
        F.when(F.max("own"), F.min_by("type", F.when(own, F.struct(priority(F.col("type")).alias("p"), F.col("seq").alias("s"))))).otherwise("OTHER").alias("type"),
        F.coalesce(F.min_by("description", F.when(own & (F.col("description") != ""), F.col("seq"))), F.lit("")).alias("description"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.when(own, F.struct("seq", "aliases")))), lambda x: x["aliases"]))).alias("aliases"),
    )
    return met, first


def promote_first_person(entities: DataFrame, relations: DataFrame, label: Column, scope: str = "document") -> tuple[DataFrame, DataFrame]:
    out = relations
    for end in ("source", "target"):
        out = out.withColumn(end, first_person(F.col(end), label, scope))
    return entities.withColumn("name", first_person(F.col("name"), label, scope)), out


def extraction_mode(mode: str, backend: str) -> str:
    return mode if mode != "auto" else "decomposed" if backend in DECOMPOSED_BACKENDS else "single"


def type_split(profile: str, chunk_count: Column, threshold: int = DEFAULTS.fast_threshold) -> Column:
    """Whether a document's chunks are asked once for each type group."""
    return F.lit(False) if profile == "fast" else chunk_count <= threshold if profile == "auto" else F.lit(True)


def gleaned(asked: DataFrame, said: DataFrame, model: LanguageModel, rounds: int, parallel: int | None = None) -> DataFrame:
    """said (turn 0 of asked) with the further turns, at most rounds: each tells what is already found, and a chunk whose turn failed or brought nothing new has no more."""
    on = asked.join(said.where("ok").where(valid_result(parsed(F.col("response")))).select(*CHUNK), CHUNK, "left_semi")
    for turn in range(1, rounds + 1):
        names, links = entity_items(said).select(*CHUNK, "name", "seq"), relation_items(said).select(*CHUNK, "source", "predicate", "target").distinct()
        first = names.groupBy(*CHUNK, "name").agg(F.min("seq").alias("seq"))
        listed = first.groupBy(*CHUNK).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "name"))), lambda x: x["name"]), ", ").alias("listed"))
        told = F.concat(F.col("prompt"), F.lit("\nAlready found: "), F.coalesce("listed", F.lit("-")), F.lit("\nGive only what is missing."))
        more = stage(generated(on.join(listed, CHUNK, "left").withColumn("prompt", told).select(*asked.columns).repartition(*CHUNK), model, json=True, parallel=parallel).withColumn("turn", F.lit(turn)), "said")
        new = entity_items(more).select(*CHUNK, "name").join(first, [*CHUNK, "name"], "left_anti").select(*CHUNK)
        new = new.unionByName(relation_items(more).select(*CHUNK, "source", "predicate", "target").join(links, [*CHUNK, "source", "predicate", "target"], "left_anti").select(*CHUNK)).distinct()
        said = said.unionByName(more)
        on = stage(on.join(new, CHUNK, "left_semi"), "active")
        if not on.limit(1).count():
            break
    return said


def extract(chunks: DataFrame, entities: DataFrame, relations: DataFrame, model: LanguageModel, settings: Settings = DEFAULTS, mode: str = "single", parallel: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relations, all responses with ok: a row for each call) of chunks; a failed call leaves its chunk out.

    What a model said is written before it is used, as it may not answer twice alike.  Chunks are dealt before
    it is asked, as a few files may hold them all."""
    asked = prompts(chunks, entities, relations, settings).repartition(*CHUNK)
    if mode == "single":
        said = stage(generated(asked, model, json=True, parallel=parallel).withColumn("turn", F.lit(0)), "said")
        said = gleaned(asked, said, model, settings.glean_rounds, parallel)
        return *reconcile(entity_items(said), relation_items(said)), said
    # The entity pass hints at names only; the relation pass asks with the whole prompt.
    counted = prompts(chunks, entities, None, settings).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("collection", "source_id")))
    grouped = group_prompts(counted, type_split(settings.profile, F.col("n"), settings.fast_threshold)).repartition(*CHUNK)
    said = stage(generated(grouped, model, json=True, parallel=parallel), "said")
    order = {g: i for i, (g, _) in enumerate(TYPE_GROUPS)} | {"ALL": 0}
    said = said.withColumn("turn", F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[F.col("type_group")])
    found = entity_items(said, strict=False, drop_noise=True)
    listed = found.groupBy(*CHUNK).agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("listed"))
    second = asked.join(listed, CHUNK).withColumn("prompt", F.concat(F.lit("Relations among: "), F.col("listed"), F.lit("\n"), F.col("prompt"))).drop("listed")
    told = stage(generated(second, model, json=True, parallel=parallel), "said")
    return *reconcile(found, relation_items(told, strict=False)), said.unionByName(told.withColumn("turn", F.lit(len(TYPE_GROUPS))), allowMissingColumns=True)


def desc_candidates(items: DataFrame, minimum: int = 2) -> DataFrame:
    """Entities with at least `minimum` described candidates, with the candidates in order of their source."""
    rows = items.where("description <> ''").groupBy("collection", "entity_name", "source_doc").agg(F.max("description").alias("description"))
    return rows.groupBy("collection", "entity_name").agg(F.count(F.lit(1)).alias("n_candidates"), F.transform(F.array_sort(F.collect_list(F.struct("source_doc", "description"))), lambda x: x["description"]).alias("candidates")).where(F.col("n_candidates") >= minimum)


def summarised(entities: DataFrame, items: DataFrame, model: LanguageModel, minimum: int = 2) -> DataFrame:
    """entities with descriptions merged by the model; failures and blanks keep the old one."""
    from .graph import update_descriptions

    asked = desc_candidates(items, minimum).select("collection", F.col("entity_name").alias("name"), F.concat(F.lit("Merge into one description:\n- "), F.array_join("candidates", "\n- ")).alias("prompt"))
    said = generated(asked, model).where(F.col("ok") & ~_blank(F.col("response")))
    return update_descriptions(entities, said.select("collection", "name", F.regexp_replace("response", r"(?U)^\s+|\s+$", "").alias("description")))


def coref_fold(entities: DataFrame, relations: DataFrame, items: DataFrame, blacklist: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(merges, aliases) that a person's aliases ask for: an alias that is itself an entity is absorbed.

    items: collection, name, type, aliases.  Set-based: merges are resolved to their roots first, so chains lose nothing."""
    from .graph import canonical_names
    from .resolve import not_blacklisted

    said = items.where("type = 'PERSON'").select("collection", "name", F.explode("aliases").alias("candidate"))
    met = said.join(canonical_names(entities, said).withColumnRenamed("name", "other"), ["collection", "candidate"])
    pairs = met.where("other is not null and other <> name").select("collection", F.col("name").alias("keep"), F.col("other").alias("drop")).distinct()
    return not_blacklisted(pairs, blacklist), said.select("collection", "name", F.col("candidate").alias("alias"))
