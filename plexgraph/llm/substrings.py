"""Exact substring dedup with a sparse, range-partitioned suffix array.

A byte is removed if a string of `width` bytes that covers it also starts elsewhere.  Of all
suffixes only those at anchors are kept: in every window of `width` bytes, the leftmost least hash of
its `gram`-byte strings marks one position, which depends on the window's bytes alone.  Equal windows
hence have anchors at the same offset, and those anchors' suffixes begin with the same gram.

1. Equal rows are folded to two, which repeat each other as any number would.  Anchors are found in one
   scan; those whose gram occurs once in the corpus are dropped.
2. Anchors with equal surroundings (all bytes that a window over the gram can reach) form a class.  A
   class of two or more is repeated as a whole.
3. One suffix of each class whose gram has further classes goes into the suffix array: suffixes are
   range-partitioned by their leading bytes with sampled splitters (equal grams stay together, so no
   group crosses a boundary), sorted in each bucket by a multikey sort, eight bytes at a time, and
   compared with their neighbours.  The longest common prefixes to the right, and those of the
   reversed bytes to the left, tell for every offset which windows are equal.
4. A gram with more classes than a bucket should hold (a line that many documents share, in
   ever different surroundings) would gather in one task; its windows' 128-bit hashes are counted instead,
   over all partitions.

A gram, class or text that a third of all rows share is dealt to several tasks in every join.  What is
gathered for one text (its anchors, its spans) is bounded by its length.

Edge cases: a null text is empty; texts shorter than `width` lose nothing; a very long text is searched
in overlapping parts and put together by one task; repeated rows and equal texts count as occurrences
of each other, so nothing depends on an order among ties, and any number of them costs what two do; null ids are ordinary; an empty table gives
no rows; an input column named like the result column is replaced, all others are kept, and
without_repeats keeps every column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import columns, drop_staged, hot_keys, ready, spread_join, stage, table, unused

WIDTH, GRAM = 200, 32
#: Classes of one gram that a bucket of the suffix array sorts at once (about 30 MB of bytes); the
#: windows of larger groups are counted.
GROUP_CLASSES = 1 << 16
#: Rows of one gram or class that a join gives to one task at least.
HOT_ROWS = 1 << 12
#: Bytes of several short texts, or of a part of a long one, that are searched for anchors at once.
BLOCK = 1 << 18
ANCHORS = "doc_id long, doc_key long, pos long, reach_left int, reach_right int, gram long, around long"
FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def doc_key() -> Column:
    """With doc_id, it tells rows apart that differ in their text; equal rows share their result."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the gram at each position; gram is a multiple of 8, up to 32."""
    x = data.astype(np.uint64)
    x = x[:-1] | x[1:] << np.uint64(8)
    x = x[:-2] | x[2:] << np.uint64(16)
    x = x[:-4] | x[4:] << np.uint64(32)
    n = len(data) - gram + 1
    h = x[:n] * FACTORS[0]
    for i in range(8, gram, 8):
        h ^= h >> np.uint64(31)
        h += x[i : i + n] * FACTORS[i // 8]
    h ^= h >> np.uint64(32)
    h *= FACTORS[4]
    return h ^ h >> np.uint64(29)


def anchors(data: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> np.ndarray:
    """For each window of data, in order, the position of its anchor."""
    w = width - gram + 1
    hashes = gram_hashes(data, gram)
    low = np.uint64((1 << 20) - 1)
    key = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    n = len(key)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    rows = padded.reshape(-1, w)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(after[: n - w + 1], before[w - 1 : n]) & low).astype(np.int64)


def _document_anchors(texts: list[bytes], width: int, gram: int) -> Iterator[tuple[int, int]]:
    """(text, position) of every anchor; short texts are searched together, long ones in overlapping parts."""
    block: list[tuple[int, int, bytes]] = []  # (text, start of the part, bytes)
    size = 0

    def search() -> Iterator[tuple[int, int]]:
        data = np.frombuffer(b"".join(x[2] for x in block), np.uint8)
        at = anchors(data, width, gram)
        ends = np.cumsum([len(x[2]) for x in block])
        starts = ends - [len(x[2]) for x in block]
        inside = np.zeros(len(at), bool)
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            inside[a : b - width + 1] = True
        at = at[inside]
        at = at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at
        part = np.searchsorted(ends, at, "right")
        for p, x in zip(part.tolist(), (at - starts[part]).tolist(), strict=True):
            yield block[p][0], block[p][1] + x

    for i, text in enumerate(texts):
        for start in range(0, max(0, len(text) - width + 1), BLOCK):
            part = text[start : start + BLOCK + width - 1]
            block.append((i, start, part))
            size += len(part)
            if size >= BLOCK:
                yield from search()
                block.clear()
                size = 0
    if block:
        yield from search()


def find_anchors(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """The anchors of docs, with hashes of the gram and of all bytes that a window over it can reach."""
    ready(docs.sparkSession)
    back = width - gram

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest as digest

        for whole in batches:
            for low in range(0, whole.num_rows, 1024):
                batch = whole.slice(low, 1024)
                names, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                texts = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in batch.column(2)]
                rows: list[tuple] = []
                last = (-1, -1)
                for i, at in _document_anchors(texts, width, gram):
                    if (i, at) == last:
                        continue
                    last = (i, at)
                    text = texts[i]
                    a, b = max(0, at - back), min(len(text), at + width)
                    rows.append((names[i], keys[i], at, at - a, b - at, digest(text[at : at + gram]), digest(text[a:b], at - a)))
                if rows:
                    cols = list(zip(*rows, strict=True))
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                    hashes = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in cols[5:]]
                    yield pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(cols[:5], kinds, strict=True)], *hashes], [x.split()[0] for x in ANCHORS.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), doc_key().alias("doc_key"), F.col("text").cast("string")).mapInArrow(scan, ANCHORS)


def multikey_sort(words: np.ndarray) -> np.ndarray:
    """The order of rows of big-endian words: each column sorts only what all columns before leave tied."""
    order = np.argsort(words[:, 0], kind="stable")
    value = words[order, 0]
    group = np.cumsum(np.r_[0, value[1:] != value[:-1]])
    for j in range(1, words.shape[1]):
        sizes = np.bincount(group)
        tied = np.flatnonzero(sizes[group] > 1)
        if not len(tied):
            break
        rows = order[tied]
        again = np.lexsort((words[rows, j], group[tied]))
        order[tied] = rows[again]
        value = words[order, j]
        fresh = np.r_[False, (group[1:] != group[:-1]) | ((value[1:] != value[:-1]) & (sizes[group[1:]] > 1))]
        group = np.cumsum(fresh)
    return order


def _words(rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes padded to whole words, the same as big-endian words)."""
    width = -(-width // 8) * 8
    data = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in rows), np.uint8).reshape(len(rows), width)
    return data, data.view(">u8").astype(np.uint64)


def _common(data: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row, in order, shares with the row before it; -1 for the first."""
    differ = data[order[1:]] != data[order[:-1]]
    shared = np.where(differ.any(1), differ.argmax(1), data.shape[1])
    return np.r_[-1, np.minimum(shared, np.minimum(sizes[order[1:]], sizes[order[:-1]]))]


def repeated_offsets(right: list[bytes], left: list[bytes], width: int = WIDTH, gram: int = GRAM) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, rows whose window that many bytes before the anchor equals another row's); right holds suffixes, left the reversed bytes before them."""
    r_size, l_size = np.array([len(x) for x in right]), np.array([len(x) for x in left])
    data, words = _words(right, width)
    order = multikey_sort(np.concatenate([words, r_size[:, None].astype(np.uint64)], 1))
    r_common = _common(data, r_size, order)
    same_gram = np.cumsum(r_common < gram)
    gram_of = np.empty(len(right), np.int64)
    gram_of[order] = same_gram
    l_data, l_words = _words(left, width - gram)
    l_order = multikey_sort(np.concatenate([gram_of[:, None].astype(np.uint64), l_words, l_size[:, None].astype(np.uint64)], 1))
    l_common = _common(l_data, l_size, l_order)
    l_common[np.r_[True, gram_of[l_order[1:]] != gram_of[l_order[:-1]]]] = -1

    def most(common: np.ndarray, order: np.ndarray) -> np.ndarray:
        out = np.empty(len(order), np.int64)
        out[order] = np.maximum(common, np.r_[common[1:], -1])
        return out

    r_most, l_most = most(r_common, order), most(l_common, l_order)
    can = (l_most >= 0) & (r_most + l_most >= width)
    if not can.any():
        return
    for back in range(max(0, width - int(r_most[can].max())), min(width - gram, int(l_most[can].max())) + 1):
        rows = np.flatnonzero(can & (l_most >= back) & (r_most >= width - back))
        if len(rows) < 2:
            continue
        r_class, l_class = np.empty(len(right), np.int64), np.empty(len(right), np.int64)
        r_class[order] = np.cumsum(r_common < width - back)
        l_class[l_order] = np.cumsum(l_common < back)
        key = r_class[rows] * (len(right) + 1) + l_class[rows]
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        hit = rows[by[np.r_[False, same] | np.r_[same, False]]]
        if len(hit):
            yield back, hit


def _spans_of_groups(rows: list[tuple], width: int, gram: int) -> list[tuple]:
    """rows: (doc_id, doc_key, pos, suffix, reversed prefix); spans (doc_id, doc_key, low, high)."""
    hits = np.zeros((len(rows), width - gram + 3), bool)
    for back, at in repeated_offsets([x[3] for x in rows], [x[4] for x in rows], width, gram):
        hits[at, back + 1] = True
    edge = np.diff(hits.astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    _, after = np.nonzero(edge == -1)
    return [(rows[i][0], rows[i][1], rows[i][2] - (b - 1), rows[i][2] - a + width) for i, a, b in zip(row.tolist(), first.tolist(), after.tolist(), strict=True)]


def _record(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "doc_key", "low", "high"])


SPANS = "doc_id long, doc_key long, low long, high long"


def suffix_spans(suffixes: DataFrame, width: int = WIDTH, gram: int = GRAM, chunk: int = 20_000) -> DataFrame:
    """Spans of windows that repeat, from suffixes (doc_id, doc_key, pos, suffix, prefix) of distinct surroundings."""

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if len(held) >= chunk and row[3][:gram] != held[-1][3][:gram]:
                    yield _record(_spans_of_groups(held, width, gram))
                    held = []
                held.append(row)
        if held:
            yield _record(_spans_of_groups(held, width, gram))

    n = int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = suffixes.withColumn("lead", F.substring("suffix", 1, gram)).repartitionByRange(n, "lead").sortWithinPartitions("lead")
    return ordered.select("doc_id", "doc_key", "pos", "suffix", "prefix").mapInArrow(buckets, SPANS)


def window_spans(suffixes: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """The same for grams of very many classes: windows are told apart by 128 bits of hash and counted."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_intdigest as digest

        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                rows = []
                for doc, key, pos, suffix, prefix in zip(*[whole.slice(low, 256).column(i).to_pylist() for i in range(5)], strict=True):
                    data = prefix[::-1] + suffix
                    for at in range(len(data) - width + 1):
                        h = digest(data[at : at + width])
                        rows.append((doc, key, pos - len(prefix) + at, h >> 64, h & (1 << 64) - 1))
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:3]], *[pa.array(np.array(c, np.uint64).view(np.int64)) for c in cols[3:]]], ["doc_id", "doc_key", "low", "h1", "h2"])

    own = suffixes.select("doc_id", "doc_key", "pos", "suffix", "prefix").mapInArrow(windows, "doc_id long, doc_key long, low long, h1 long, h2 long")
    own = stage(own, "windows")
    place = F.struct("doc_id", "doc_key", "low")  # a window that two grams of its text report is one occurrence
    twice = own.groupBy("h1", "h2").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("not (a <=> b)").select("h1", "h2")
    return own.join(twice, ["h1", "h2"], "left_semi").select("doc_id", "doc_key", "low", (F.col("low") + width).alias("high"))


def folded(docs: DataFrame, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) of each different row once; and the same with repeated rows twice, which tells all that more copies would."""
    who = F.struct(F.col("doc_id").cast("long").alias("doc_id"), doc_key().alias("doc_key"))
    texts = docs.select(who.alias("who"), F.col("text").cast("string").alias("text"))
    copies = stage(texts.groupBy("who").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated-rows")
    rows = copies.agg(F.sum("n")).first()[0]
    plain = lambda df: df.select(F.col("who.doc_id").alias("doc_id"), "text")
    if not rows:
        drop_staged(copies)
        return plain(texts), plain(texts)
    key = F.xxhash64("who")
    met = lambda how: spread_join(texts, copies.select("who"), ["who"], key, hot_keys(copies, key, rows, hot_rows), how)
    one = plain(stage(met("left_semi").groupBy("who").agg(F.first("text").alias("text")), "rows-once"))
    rest = plain(met("left_anti"))
    return rest.unionByName(one), rest.unionByName(one).unionByName(one)


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, group_classes: int = GROUP_CLASSES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, doc_key and spans: byte ranges, in any order, that cover exactly the bytes to remove."""
    docs, copied = folded(docs, hot_rows)
    found = stage(find_anchors(copied, width, gram), "anchors")
    gram_ = F.col("gram")
    counts = stage(found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "grams")
    kept = stage(spread_join(found, counts.select("gram"), ["gram"], gram_, hot_keys(counts, gram_, found.count(), hot_rows), "left_semi"), "repeated-anchors")
    drop_staged(found)
    drop_staged(counts)
    classes = stage(kept.groupBy("gram", "around").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "doc_key", "pos", "reach_left", "reach_right")).alias("one")), "classes")
    twice, both = classes.where("n > 1"), F.xxhash64("gram", "around")
    whole = spread_join(kept, twice.select("gram", "around"), ["gram", "around"], both, hot_keys(twice, both, kept.count(), hot_rows), "left_semi").where(F.col("reach_left") + F.col("reach_right") >= width)
    whole = whole.select("doc_id", "doc_key", (F.col("pos") - F.col("reach_left")).alias("low"), (F.col("pos") + F.col("reach_right")).alias("high"))
    many = stage(classes.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "classes-of-grams")
    ones = spread_join(classes.select("gram", "one"), many, ["gram"], gram_, hot_keys(many, gram_, classes.count(), hot_rows), "inner").select("one.*", (F.col("n") > group_classes).alias("large"))
    wanted = ones.groupBy(F.col("doc_id").alias("d"), F.col("doc_key").alias("k")).agg(F.collect_list(F.struct("pos", "reach_left", "reach_right", "large")).alias("places"))
    texts = docs.select(F.col("doc_id").cast("long"), doc_key().alias("doc_key"), F.col("text").cast("string").cast("binary").alias("data"))
    joined = texts.join(wanted.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("doc_key") == F.col("k")))
    suffixes = stage(_surroundings(joined), "suffixes")
    edges = suffix_spans(suffixes.where("not large"), width, gram).unionByName(window_spans(suffixes.where("large"), width, gram))
    return whole.unionByName(edges).groupBy("doc_id", "doc_key").agg(F.collect_list(F.struct("low", "high")).alias("spans"))


def _surroundings(joined: DataFrame) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 64):
                rows = []
                for doc, key, data, places in zip(*[c.to_pylist() for c in whole.slice(low, 64).columns], strict=True):
                    rows += [(doc, key, p["pos"], p["large"], data[p["pos"] : p["pos"] + p["reach_right"]], data[p["pos"] - p["reach_left"] : p["pos"]][::-1]) for p in places]
                cols = list(zip(*rows, strict=True)) if rows else [()] * 6
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "doc_key", "pos", "large", "suffix", "prefix"])

    return joined.select("doc_id", "doc_key", "data", "places").mapInArrow(cut, "doc_id long, doc_key long, pos long, large boolean, suffix binary, prefix binary")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


REST = "struct<n_bytes:long,n_removed:long,n_spans:long,kept:binary>"


def _rest(docs: DataFrame, name: str, own, kind: str, width: int, gram: int, group_classes: int) -> DataFrame:
    """docs with a column made of a text's bytes and of the spans to remove, instead of any of that name."""
    d, k, found, key = unused(docs, "__d", "__k", "__spans", "__key")
    spans = repeated_spans(docs, width, gram, group_classes).select(F.col("doc_id").alias(d), F.col("doc_key").alias(k), F.col("spans").alias(found))
    keyed = docs.withColumn(key, doc_key())
    met = keyed.join(spans.hint("shuffle_hash"), F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.col(key) == F.col(k)), "left")
    made = F.arrow_udf(own, kind).asNondeterministic()(F.col("text").cast("string").cast("binary"), F.col(found))  # else a use of two fields would run it twice
    return met.select(*columns(docs, name), made.alias(name))


def _kept(data: bytes, spans: list[dict] | None) -> tuple[list[tuple[int, int]], bytes]:
    out = merged([(x["low"], x["high"]) for x in spans or ()])
    parts, done = [], 0
    for low, high in out:
        parts.append(data[done:low])
        done = high
    return out, b"".join([*parts, data[done:]])


def deduplicated(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, group_classes: int = GROUP_CLASSES) -> DataFrame:
    """docs with dedup: n_bytes, n_removed, n_spans (maximal removed runs) and the kept bytes."""

    def own(texts: pa.Array, spans: pa.Array) -> pa.Array:
        sizes, removed, runs, rest = [], [], [], []
        for text, found in zip(texts, spans.to_pylist(), strict=True):
            data = text.as_py() or b""
            out, kept = _kept(data, found)
            sizes.append(len(data))
            removed.append(len(data) - len(kept))
            runs.append(len(out))
            rest.append(kept)
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(rest, pa.binary())], ["n_bytes", "n_removed", "n_spans", "kept"])

    return _rest(docs, "dedup", own, REST, width, gram, group_classes)


def without_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, group_classes: int = GROUP_CLASSES) -> DataFrame:
    """docs' own columns with the repeated bytes cut from text; a character that is cut in part goes whole."""

    def own(texts: pa.Array, spans: pa.Array) -> pa.Array:
        """The new text; null where nothing goes."""
        return pa.array([_kept(text.as_py() or b"", found)[1].decode("utf-8", "ignore") if found else None for text, found in zip(texts, spans.to_pylist(), strict=True)], pa.string())

    (name,) = unused(docs, "__text")
    new, was_cut = F.col(name), F.col(name).isNotNull()
    given = {"text": F.coalesce(new, "text").alias("text")}
    if "n_chars" in docs.columns:
        given["n_chars"] = F.when(was_cut, F.length(new).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")).alias("n_chars")
    return _rest(docs, name, own, "string", width, gram, group_classes).select(*[given.get(c, F.col(f"`{c}`")) for c in docs.columns])


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "dedup.n_bytes", "dedup.n_removed", "dedup.n_spans", F.sha2("dedup.kept", 256).alias("kept_sha256"))
