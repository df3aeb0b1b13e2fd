"""Merging: equal keys first, then similar vectors of what is left, and a person's decisions on the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import resolve
from ..operators.lifecycle import mark_dirty
from ..operators.scope import in_scope
from ..providers import Embedding, embedded
from ..sources.store import Store
from ..staging import stage
from .ingest import touched


def named_vectors(entities: DataFrame, embedding: Embedding, described: bool = False) -> DataFrame:
    """collection, name and the vector of the name, or of name and description."""
    text = F.concat_ws(": ", "name", "description") if described else F.col("name")
    return entities.select("collection", "name", embedded(text, embedding).alias("vector"))


def merge(store: Store, embedding: Embedding | None, threshold: float, scope: list[str] | None = None, backups: str | None = None) -> int:
    """Merge entities with equal keys; then, with an embedding, similar ones of what is left.  Returns how many went.

    If there is anything to merge, a copy of the store goes to backups first; collections without a merge stay clean."""
    gone = 0
    for step in ("equal", "similar") if embedding else ("equal",):
        e, r, b, black = (store.table(n) for n in ("entities", "relations", "same_as", "merge_blacklist"))
        own = in_scope(e, scope)
        pairs = resolve.normalized_duplicates(own, r, black) if step == "equal" else resolve.merge_candidates(named_vectors(own, embedding), r, threshold, black)
        pairs = stage(pairs.select("collection", "keep", "drop"), "merge-pairs")
        n = pairs.select("collection", "drop").distinct().count()
        if not n:
            continue
        if backups and not gone:
            store.backup(backups)
        _commit(store, touched(pairs), *resolve.apply_merges(e, r, b, pairs), pairs)
        gone += n
    return gone


def _commit(store: Store, some: list[str], entities: DataFrame, relations: DataFrame, bridges: DataFrame, pairs: DataFrame, **more: DataFrame) -> None:
    """Write some collections, and the bridges; those with a pair are dirty."""
    store.commit(some, entities=entities, relations=relations, same_as=bridges, community_build_state=mark_dirty(store.table("community_build_state"), pairs), **more)


def review(store: Store, embedding: Embedding, low: float, high: float, scope: list[str] | None = None) -> DataFrame:
    """The pairs between the thresholds, with their contexts, for a person to decide on."""
    own, r = in_scope(store.table("entities"), scope), store.table("relations")
    return resolve.review_candidates(named_vectors(own, embedding), own, r, low, high, store.table("merge_blacklist"))


def decide(store: Store, decided: DataFrame, backups: str | None = None) -> None:
    """Merge what is approved of decided (collection, keep, drop, approved, reason), blacklist the rest."""
    decided = stage(decided, "decided")
    if backups and decided.where("approved").limit(1).count():
        store.backup(backups)
    e, r, b, black = (store.table(n) for n in ("entities", "relations", "same_as", "merge_blacklist"))
    *graph, black = resolve.apply_review(e, r, b, black, decided)
    _commit(store, touched(decided), *graph, decided.where("approved"), merge_blacklist=black)
