"""Text, names and chunks: literal cases."""

import pytest
from pyspark.sql import functions as F

from plexgraph.functions import text as T
from plexgraph.functions.chunking import chunk_text, chunks
from plexgraph.schema import ENTITY_TYPES


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[1] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("text", "size", "overlap", "want"),
    [
        ("abcdefgh", 5, 0, ["abcde", "fgh"]),
        ("0123456789abc", 6, 3, ["012345", "345678", "6789ab", "9abc"]),
        ("short enough", 12, 5, ["short enough"]),
        ("", 7, 2, []),
        (None, 7, 2, []),
    ],
)
def test_chunks(text, size, overlap, want):
    assert chunk_text(text, size, overlap) == want


def test_chunks_keep_sentences_and_ends():
    text = "The tide went out. Nobody saw the boat! Was it gone? It was."
    got = chunk_text(text, 25)
    assert got == ["The tide went out. ", "Nobody saw the boat! ", "Was it gone? It was."] and "".join(got) == text
    lines = "".join(f"line {i}\n" for i in range(300))
    assert all(x.endswith("\n") for x in chunk_text(lines, 70, 20)) and "".join(chunk_text(lines, 70)) == lines
    assert all(len(c) <= 12 for c in chunk_text("one three seventeen two eleven", 12, 6, strict=True))


def test_chunks_of_a_column(spark):
    got = spark.createDataFrame([("가" * 25,), (None,)], "x string").select(F.size(chunks(F.col("x"), 10)).alias("n")).collect()
    assert [r.n for r in got] == [3, 0]


def test_clean_markdown(spark):
    table = "| port |  | ships | 41 |\n|:--|--|--|--:|\n| | | |\nafter\n\n\n\n\nlast | one pipe"
    got, rules, null = column(spark, [table, "|---|---|---|\n" * 9 + "the only line", None], T.clean_markdown)
    assert got == "port ships 41\nafter\n\nlast | one pipe"
    assert rules == "the only line" and null is None


def test_names(spark):
    noise = ["7", "88.5 %", "12월 3일", "4,200원", "9억", "", "60만 개", "2시간 5분", "3배"]
    real = ["항구", "A4 용지", "7번 부두", "Route 66", "MP3", "x1"]
    assert column(spark, noise, T.is_noise_name) == [True] * len(noise)
    assert column(spark, real, T.is_noise_name) == [False] * len(real)
    assert column(spark, ["선장은", "등대를", "배가", "바다와", "항구"], T.strip_particle) == ["선장", "등대", "배가", "바다", "항구"]
    a, b, c, d, e, f = column(spark, ["North  Pier", "north-pier", "Pier 1/2", "Pier 1/2/3", "선장은", "선장"], T.name_key)
    assert a == b and c != d and e == f
    assert column(spark, ["sails to", " Moored-At ", "_x __y_"], T.predicate) == ["SAILS_TO", "MOORED_AT", "X_Y"]
    assert column(spark, ["location", "vessel", None, " Event "], T.entity_type) == ["LOCATION", "OTHER", "OTHER", "EVENT"]
    assert set(column(spark, list(ENTITY_TYPES), T.entity_type)) == set(ENTITY_TYPES)
    assert column(spark, ["나", "나룻배", "저"], lambda c: T.first_person(c, F.lit("일지"))) == ["화자(일지)", "나룻배", "화자(일지)"]
    assert column(spark, ["나", "내"], lambda c: T.first_person(c, F.lit("일지"), "collection")) == ["화자", "화자"]
    assert column(spark, ["나"], lambda c: T.first_person(c, F.lit("x"), "off")) == ["나"]
    assert column(spark, ["17_log.txt", "log.2.txt"], T.document_label) == ["log", "log.2"]


def test_aliases(spark):
    df = spark.createDataFrame([("harbour", ["port", " ", "harbour", "haven ", "port", ""]), ("x", None)], "name string, aliases array<string>")
    assert [r[0] for r in df.select(T.clean_aliases(F.col("name"), F.col("aliases"))).collect()] == [["port", "haven"], []]


def test_counting_chunks_keeps_none_of_them(spark):
    import tracemalloc

    from plexgraph.functions import chunking

    text = "ab c" * 500_000
    tracemalloc.start()
    n = sum(1 for _ in chunking.each_chunk(text, 1960, 392))
    counting = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(chunking.chunk_text(text, 1960, 392)) and counting < len(text) / 2
    rows = spark.createDataFrame([("",), (None,), ("x" * 5000,), ("a b. " * 1000,)], "t string")
    got = rows.select(chunking.chunk_count(F.col("t"), 1960, 392).alias("n"), F.size(chunking.chunks(F.col("t"), 1960, 392)).alias("m")).collect()
    assert [r.n for r in got] == [r.m for r in got] and got[2].n > 2


def test_ngrams_are_hashed_once_for_many_texts(monkeypatch):
    import hashlib

    from plexgraph import providers

    calls, real = [], hashlib.blake2b
    monkeypatch.setattr(providers.hashlib, "blake2b", lambda *a, **k: calls.append(1) or real(*a, **k))
    texts = ["", "a", "한국어 é😀", "abc abc " * 200]
    got = providers.HashedNgrams(sizes=(1, 2, 3, 5)).embed([*texts, *texts])
    assert len(calls) < 100
    for text, row in zip(texts, got, strict=False):
        want = [0.0] * 64
        for gram in (text[i : i + n] for n in (1, 2, 3, 5) for i in range(len(text) - n + 1)):
            h = int.from_bytes(real(gram.encode(), digest_size=8).digest(), "little")
            want[h % 64] += 1 if h >> 63 else -1
        assert row == want
    assert got[: len(texts)] == got[len(texts) :]
