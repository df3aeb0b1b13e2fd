"""Importance resampling towards a target's n-grams, from a position table.

Words are exploded with their positions; window lead() per document puts the following words beside
each, one for each further order, so a row holds every n-gram that starts at its position.  N-grams
are hashed into buckets, counted over all documents and over the target, and each bucket's log ratio
(its gain) is joined back to the n-grams by a table of one row for each bucket, whose number is a
parameter.  A document's weight is the mean of its gains; with a Gumbel draw from its id added, the
highest scores are a sample without replacement whose odds follow the weights.

Counts and weights are combined inside each task, so what is shuffled is one row for each bucket and
one for each document; only orders above 1, whose windows need a document's words in one place, deal
the texts out once for each pass.  The texts are read twice instead of being stored as n-grams.  Ranks
come from one range sort of narrow rows: a row's place in its part, after the sizes of the parts before.

Edge cases: null, empty and wordless texts have no features, weight 0, and are not drawn where a least
number of words is asked; a null id draws as the empty string; repeated rows and equal ids are rows
of their own, whose ranks among each other are in no order; a text of any length is a group of its
own; an empty target gives every bucket the gain of unseen ones; an empty table gives no rows; other
columns, whatever their names, are ignored by weights, and kept by resampled.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import CRC_TABLE_SQL, LOWER, UPPER, crc32_sql, lower_ascii, stage, table, unused

ORDERS, BUCKETS = 1, 10_000
LEAST_WORDS, PERCENT, SEED = 20, 10, "2024"
#: What separates words, before A-Z become lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A gain table of at most so many rows is broadcast (8 MB); the number of buckets bounds it.
BROADCAST_BUCKETS = 500_000


def _lowered(word: Column) -> Column:
    """A-Z in lower case; words of ASCII alone by the faster built-in."""
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(lower_ascii(word))


def positions(docs: DataFrame, keys: list[str], orders: int) -> DataFrame:
    """(keys, nth, pos, gram_1 to gram_orders): one row for each word, and one with nulls at either end of a text that begins or ends between words."""
    rows = docs.select(*keys, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("nth"))
    if orders > 1:
        rows = rows.repartition("nth")  # so that the windows below find each document in one place
    split = F.split("text", BETWEEN, -1)
    words = rows.select(*keys, "nth", F.posexplode(split).alias("pos", "word")).select(*keys, "nth", "pos", F.nullif(_lowered(F.col("word")), F.lit("")).alias("word"))
    order = Window.partitionBy("nth").orderBy("pos")
    following = words.select("*", *[F.lead("word", n).over(order).alias(f"next_{n}") for n in range(1, orders)])
    # concat is null where a following word is: no n-gram reaches over the end.
    grams = [F.concat(F.col("word"), *[x for m in range(1, n) for x in (F.lit(" "), F.col(f"next_{m}"))]) for n in range(1, orders + 1)]
    return following.select(*keys, "nth", "pos", *[g.alias(f"gram_{n}") for n, g in enumerate(grams, 1)])


def features(docs: DataFrame, keys: list[str], orders: int, buckets: int) -> DataFrame:
    """(keys, nth, bucket, first): a row for each n-gram of any order; bucket is null for none; first marks those of order 1."""
    found, bucket = positions(docs, keys, orders), lambda n: F.crc32(F.col(f"gram_{n}").cast("binary")) % buckets
    if orders == 1:
        return found.select(*keys, "nth", bucket(1).alias("bucket"), F.col("gram_1").isNotNull().alias("first"))
    each = F.explode(F.array(*[F.struct(bucket(n).alias("bucket"), (F.col(f"gram_{n}").isNotNull() if n == 1 else F.lit(False)).alias("first")) for n in range(1, orders + 1)]))
    return found.select(*keys, "nth", each.alias("x")).select(*keys, "nth", "x.bucket", "x.first")


def bucket_counts(docs: DataFrame, orders: int, buckets: int) -> DataFrame:
    return features(docs, [], orders, buckets).where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gains(docs: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of the buckets that docs use: floored thousandths of the log ratio, each bucket counted once more than found."""
    own, aim = stage(bucket_counts(docs, orders, buckets), "bucket-counts"), stage(bucket_counts(target, orders, buckets), "target-counts")
    total = lambda df: float(df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] + buckets)
    both = own.withColumnRenamed("n", "s").join(aim.withColumnRenamed("n", "t"), "bucket", "left")
    ratio = (F.coalesce("t", F.lit(0)) + 1).cast("double") * F.lit(total(own)) / ((F.col("s") + 1).cast("double") * F.lit(total(aim)))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def _draw(doc_id: Column, seed: str) -> Column:
    """A Gumbel variate in floored thousandths, from 32 bits of the id's hash."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weights(docs: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """(doc_id, nth, n_words, n_features, weight, score), one row for each of docs' rows."""
    gain = gains(docs, target, orders, buckets)
    met = features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], orders, buckets).join(F.broadcast(gain) if buckets <= BROADCAST_BUCKETS else gain, "bucket", "left")
    each = met.groupBy("nth", "doc_id").agg(F.count_if("first").alias("n_words"), F.count("bucket").alias("n_features"), F.sum("gain").alias("sum"))
    weight = F.coalesce(F.floor(F.col("sum") / F.col("n_features")), F.lit(0))
    return each.select("doc_id", "nth", "n_words", "n_features", weight.alias("weight"), (weight + _draw(F.col("doc_id"), seed)).alias("score"))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """rows, written once in this order, with rank: 1, 2, 3 ... without a task that sees them all."""
    placed = stage(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__at", 33)
    sizes = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # one for each task of the sort
    before = accumulate([0, *[n for _, n in sizes]])
    base = rows.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before, strict=False)], "__part long, __base long")
    nth = F.col("__base") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1
    return placed.withColumn("__part", part).join(F.broadcast(base), "__part").withColumn("rank", nth).drop("__part", "__base", "__at")


def importance(docs: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; rank counts those drawn from 1 and is null for the others."""
    every = stage(weights(docs, target, orders, buckets, seed), "weights")
    able = F.col("n_words") >= least_words
    n = every.where(able).count() * percent // 100
    drawn = ranked(every.where(able), F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("nth")).withColumn("rank", F.when(F.col("rank") <= n, F.col("rank")))
    return drawn.unionByName(every.where(~able).withColumn("rank", F.lit(None).cast("long"))).select("doc_id", "n_features", "weight", "score", "rank")


def resampled(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """docs' rows, with all their columns, whose id was drawn; of rows that share an id one draw keeps all."""
    (name,) = unused(docs, "drawn_id")
    drawn = importance(docs, target, **options).where("rank is not null").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(drawn, F.col("doc_id").cast("long").eqNullSafe(F.col(name)), "left_semi")


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = rf"unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w"

ORACLE_SQL = f"""
WITH words AS (SELECT 'd' AS side, doc_id, {_WORDS} FROM documents UNION ALL SELECT 't', NULL, {_WORDS} FROM benchmark),
{CRC_TABLE_SQL},
distinct_words AS (SELECT DISTINCT w FROM words),
bytes AS (SELECT w, hex(encode(w)) AS h FROM distinct_words),
hashed AS (
  SELECT w, {crc32_sql('h')} % 10000 AS bucket
  FROM bytes, crc_table
),
counted AS (
  SELECT bucket, count(*) FILTER (WHERE side = 'd') AS s, count(*) FILTER (WHERE side = 't') AS t FROM words JOIN hashed USING (w) GROUP BY bucket
),
totals AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM counted),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(s_all + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(t_all + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM counted, totals
),
summed AS (SELECT doc_id, count(*) AS n, sum(gain) AS g FROM words JOIN hashed USING (w) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(floor(CAST(g AS DOUBLE) / n), 0) AS BIGINT) AS weight,
         CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS draw
  FROM documents d LEFT JOIN summed USING (doc_id)
),
able AS (SELECT doc_id, row_number() OVER (ORDER BY weight + draw DESC, doc_id) AS nth, count(*) OVER () AS all_able FROM scored WHERE n_features >= 20)
SELECT s.doc_id, CAST(n_features AS BIGINT) AS n_features, weight, weight + draw AS score, CASE WHEN nth <= 10 * all_able // 100 THEN nth END AS rank
FROM scored s LEFT JOIN able USING (doc_id)
"""
