"""Communities and their reports, rebuilt only where a collection changed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..operators import community
from ..operators.scope import in_scope
from ..providers import LanguageModel
from ..sources.store import Store
from ..staging import stage
from . import reports


def build(store: Store, model: LanguageModel | None = None, scope: list[str] | None = None, settings: Settings = DEFAULTS, force: bool = False) -> tuple[list[str], list[str]]:
    """Bring the communities of a scope up to date, and with a model their reports; returns the collections detected anew and those reported anew.

    A collection is detected where its graph's signature is not that of its last build, and reported
    where it was detected, where it is dirty (a description may have changed) or where it has
    communities without any report; of these, unchanged communities still cost no call.  A collection whose graph is
    gone loses its communities and reports.  Dirty marks are cleared in the one commit at the end, so a
    build that broke off leaves them; without a model a collection detected anew is dirty, as its
    reports are behind, and other marks stay."""
    entities, relations = (in_scope(store.table(n), scope) for n in ("entities", "relations"))
    old = {n: in_scope(store.table(n), scope) for n in ("communities", "community_reports", "community_build_state")}
    signed = stage(community.graph_signatures(entities, relations), "signatures")
    built = old["community_build_state"].select("collection", "dirty", F.col("graph_signature").alias("before"))
    known = old["communities"].select("collection").distinct().withColumn("has", F.lit(True))
    told = old["community_reports"].select("collection").distinct().withColumn("told", F.lit(True))
    state = signed.join(built, "collection", "full").join(known, "collection", "full").join(told, "collection", "left")
    moved = ~F.col("graph_signature").eqNullSafe(F.col("before")) | F.lit(force)
    behind = moved | F.coalesce("dirty", F.lit(True)) | (F.col("has") & F.col("told").isNull())
    # One row for each collection that changed.
    rows = state.select("collection", moved.alias("moved"), behind.alias("behind"), F.col("graph_signature").isNull().alias("gone")).where("moved or behind").collect()
    anew = [r.collection for r in rows if r.moved and not r.gone]
    gone = [r.collection for r in rows if r.gone]
    retold = [r.collection for r in rows if r.behind and not r.gone] if model is not None else []
    some = sorted({*anew, *gone, *retold})
    if not some:
        return [], []
    communities = store.table("communities", some).where(~F.col("collection").isin([*anew, *gone]))
    if anew:
        found = community.detect(store.table("entities", anew), store.table("relations", anew), settings)
        communities = communities.unionByName(stage(found, "communities").select(*communities.columns))
    out = {"communities": communities}
    kept = store.table("community_reports", some)
    if retold:
        fresh = reports.generate_reports(communities.where(F.col("collection").isin(retold)), store.table("entities", retold), store.table("relations", retold), kept, model, settings)
        out["community_reports"] = kept.where(~F.col("collection").isin([*retold, *gone])).unionByName(fresh.select(*kept.columns))
    elif gone:
        out["community_reports"] = kept.where(~F.col("collection").isin(gone))
    out["community_build_state"] = signed.where(F.col("collection").isin(some)).select("collection", F.lit(model is None).alias("dirty"), "graph_signature")
    store.commit(some, **out)
    return sorted(anew), sorted(retold)
