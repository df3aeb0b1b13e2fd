"""Community reports, bottom-up: a level's reports are made from those of the level below, and reused where nothing changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.text import document_label, strip_fence
from ..operators.community import boundary_edges, dominant_sources
from ..providers import LanguageModel, generated
from ..schema import REPORTS
from ..staging import stage

KEY = ["collection", "community_id"]


def parsed_report(raw):
    """title and summary must be there; a rating that is no number is null."""
    r = F.from_json(strip_fence(raw), "struct<title:string,summary:string,rating:string>")
    good = (F.trim(F.coalesce(r["title"], F.lit(""))) != "") & (F.trim(F.coalesce(r["summary"], F.lit(""))) != "")
    return F.when(good, F.struct(r["title"].alias("title"), r["summary"].alias("summary"), r["rating"].try_cast("double").alias("rating")))


def model_for_level(level: int, model: LanguageModel, top_model: LanguageModel | None = None, settings: Settings = DEFAULTS) -> LanguageModel:
    """The top model, if there is one, for the levels above report_top_levels."""
    return top_model if top_model is not None and level < settings.report_top_levels else model


def leaf_material(communities: DataFrame, entities: DataFrame, relations: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """For each community: members, inner and outer relations as text, dominant source and their signature."""
    member = communities.select(*KEY, F.explode("entity_names").alias("name")).join(entities.select("collection", "name", "description"), ["collection", "name"], "left")
    people = member.groupBy(*KEY).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "name", "description"))), "\n").alias("members"))
    edges = boundary_edges(communities, relations, settings.external_max)
    line = F.concat("source", F.lit(" -["), "predicate", F.lit("]-> "), "target", F.lit(" "), "valid_from")
    told = edges.groupBy(*KEY).agg(*[F.array_join(F.array_sort(F.collect_list(F.when(F.col("side") == s, line))), "\n").alias(s) for s in ("inner", "outer")])
    source = dominant_sources(edges).select(*KEY, document_label(F.col("source_doc")).alias("source"))
    out = people.join(told, KEY, "left").join(source, KEY, "left")
    return out.na.fill("", ["inner", "outer", "source"]).withColumn("content_signature", F.substring(F.sha2(F.concat_ws("\x1f", "members", "inner", "outer", "source"), 256), 1, 16))


def generate_reports(communities: DataFrame, entities: DataFrame, relations: DataFrame, old: DataFrame, model: LanguageModel, settings: Settings = DEFAULTS, top_model: LanguageModel | None = None) -> DataFrame:
    """All reports of communities' collections; one pass for each level, of which there are at most community_max_level + 1.

    A parent is made from its children's reports and skipped if it has none; a failed call skips its
    community; an unchanged signature reuses the old report without a call."""
    spark = communities.sparkSession
    parents = communities.where("parent_community_id is not null").select("collection", F.col("parent_community_id").alias("community_id")).distinct()
    leaves = communities.join(parents, KEY, "left_anti")
    material = leaf_material(leaves, entities, relations, settings).withColumn("prompt", F.concat_ws("\n", F.lit("Report on these members:"), "members", F.lit("Relations:"), "inner", F.lit("Beyond:"), "outer", F.lit("Source:"), "source"))
    # Every level reads it: made once, it keeps the relations out of the levels' plans.
    material = stage(material, "material")
    top = communities.agg(F.max("level")).first()[0]
    done = spark.createDataFrame([], REPORTS + ", source string")
    for level in range(-1 if top is None else top, -1, -1):
        here = communities.where(F.col("level") == level).select(*KEY, "level")
        leaf = here.join(material.select(*KEY, "prompt", "content_signature", "source"), KEY)
        kids = communities.where(F.col("level") == level + 1).select("collection", F.col("community_id").alias("kid"), F.col("parent_community_id").alias("community_id"))
        below = kids.join(done.select("collection", F.col("community_id").alias("kid"), "title", "summary", "content_signature", "source"), ["collection", "kid"])
        joined = below.groupBy(*KEY).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("\n", "title", "summary"))), "\n\n").alias("text"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("source") != "", F.col("source")))), ", ").alias("source"), F.array_join(F.array_sort(F.collect_list("content_signature")), "|").alias("signs"))
        parent = here.join(joined, KEY).select(*KEY, "level", F.concat_ws("\n", F.lit("Report on these reports:"), "text", F.lit("Source:"), "source").alias("prompt"), F.substring(F.sha2(F.concat_ws("\x1f", "signs", "source"), 256), 1, 16).alias("content_signature"), "source")
        wanted = leaf.select(*parent.columns).unionByName(parent)
        kept = old.select(*KEY, F.col("content_signature"), "title", "summary", "rating", "updated_at")
        reused = wanted.join(kept, [*KEY, "content_signature"])
        fresh = wanted.join(kept, [*KEY, "content_signature"], "left_anti")
        said = generated(fresh, model_for_level(level, model, top_model, settings), json=True).withColumn("report", parsed_report(F.col("response"))).where("report is not null")
        names = [x.split()[0] for x in REPORTS.split(", ")] + ["source"]
        new = said.select(*KEY, "level", "report.*", "content_signature", F.current_timestamp().alias("updated_at"), "source").select(*names)
        level_rows = reused.select(*names).unionByName(new)
        # A model may not answer twice alike: what a level said is kept before the next one reads it.
        done = done.unionByName(stage(level_rows, "reports"))
    return done.drop("source")
