"""Which names occur in which texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

try:
    import ahocorasick
except ImportError:
    ahocorasick = None

#: Bytes of names whose automaton a worker may hold, about a fortieth of its size; characters of a name's beginning that the join beyond is on; characters of a block.
AUTOMATON_BYTES, BEGINNING, BLOCK = 8 << 20, 16, 256


def mentions(texts: DataFrame, names: DataFrame, text_key: str, name_key: str, group: list[str] | None = None, most_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """(text_key, name_key) of every name that a text of its group contains, each pair once.

    Names of up to most_bytes go to the workers as one automaton, which reads each text once; beyond it,
    or without the automaton's library, texts and names are equi-joined on the names' beginnings."""
    group = group or []
    real = names.where(F.length("name") > 0).select(*group, name_key, "name")
    size = real.agg(F.coalesce(F.sum(F.octet_length("name")), F.lit(0))).first()[0]
    if ahocorasick is None or size > most_bytes:
        return joined_mentions(texts, real, text_key, name_key, group)
    held = texts.sparkSession.sparkContext.broadcast([tuple(r) for r in real.distinct().collect()])  # at most most_bytes of names
    fields = [*group, text_key, name_key]
    schema = T.StructType([texts.schema[c] for c in (*group, text_key)] + [names.schema[name_key]])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ahocorasick.Automaton()
        keys: dict[str, list[tuple]] = {}
        for *own, key, name in held.value:
            keys.setdefault(name, []).append((tuple(own), key))
        for name, have in keys.items():
            machine.add_word(name, have)
        if keys:
            machine.make_automaton()
        for batch in batches:
            rows = []
            if keys:
                *own, ids, said = [c.to_pylist() for c in batch.columns]
                for at, (i, text) in enumerate(zip(ids, said, strict=True)):
                    here = tuple(c[at] for c in own)
                    rows += [(*here, i, k) for k in {k for _, have in machine.iter(text or "") for g, k in have if g == here}]
            kinds = to_arrow_schema(schema)
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.field(n).type) for n in range(len(fields))], fields)

    return texts.select(*group, text_key, F.col("text").cast("string").alias("text")).mapInArrow(found, schema).distinct()


def joined_mentions(texts: DataFrame, real: DataFrame, text_key: str, name_key: str, group: list[str]) -> DataFrame:
    """The same, equi-joined on the name's beginning, then confirmed.

    Every place of a text offers its next characters, as many as some name's beginning has, so no text
    meets a name whose beginning it does not hold."""
    size = F.least(F.length("name"), F.lit(BEGINNING))
    sizes = F.array(*[F.lit(n) for n in sorted(real.agg(F.collect_set(size)).first()[0])]).cast("array<int>")  # at most BEGINNING sizes
    starts = real.select(*group, name_key, "name", F.substring(F.col("name"), F.lit(1), size).alias("gram"))
    # A character's place in a string is found by counting from its start, so long texts are first cut into blocks.
    blocks = texts.where(F.length("text") > 0).select(*group, text_key, "text", F.explode(F.sequence(F.lit(1), F.length("text"), F.lit(BLOCK))).alias("first"))
    block = F.substring(F.col("text"), F.col("first"), F.lit(BLOCK + BEGINNING - 1))
    blocks = blocks.select(*group, text_key, block.alias("block"))
    grams = F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.length("block") - n + 1))), lambda i: F.substring(F.col("block"), i, n))))
    pieces = blocks.select(*group, text_key, F.explode(grams).alias("gram"))  # the text itself is not carried to each place
    met = pieces.join(starts, [*group, "gram"]).select(*group, text_key, name_key, "name").distinct()
    return met.join(texts.select(*group, text_key, "text"), [*group, text_key]).where(F.contains("text", "name")).select(*group, text_key, name_key).distinct()
