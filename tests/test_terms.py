"""The index of terms against brute force; rewriting with very many terms; one shard and several give the same."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.operators import substitute as s
from veilspark.operators import terms


def brute(texts, words):
    return sorted((i, p, k) for i, t in enumerate(texts) for k, w in enumerate(words) for p in range(len(t)) if t.startswith(w, p))


@pytest.mark.parametrize("letters", ["ab", "abü€", "a"])
def test_every_place_of_every_term(letters):
    rng = random.Random(len(letters))
    for _ in range(100):
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 16, 17, 25]))).encode() for _ in range(rng.randint(0, 30))})
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))).encode() for _ in range(rng.randint(0, 5))]
        offsets = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
        text, place, term = terms.TermIndex(words).find(np.frombuffer(b"".join(texts), np.uint8), offsets)
        assert sorted(zip(text.tolist(), (place - offsets[text]).tolist(), term.tolist())) == brute(texts, words)


def replaced(text, rows):
    met = []
    for e, (old, new) in enumerate(rows):
        if old in text:
            met.append(e)
            text = text.replace(old, new)
    return text, met


def test_entries_that_replacing_meets():
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abc") for _ in range(rng.randint(1, n))).encode()
    for _ in range(200):
        rows = [(word(4), word(5)) for _ in range(rng.randint(0, 12))]
        shard = terms.Entries([(o, n, n) for o, n in rows])
        ordered = list(zip(shard.olds, shard.made))
        texts = [word(30) for _ in range(5)] + [b""]
        for text, known in zip(texts, shard.closed(texts)):
            want, met = replaced(text, ordered)
            assert set(met) <= set(known)
            assert replaced(text, [ordered[e] for e in known])[0] == want


@pytest.fixture(scope="module")
def many(spark):
    """A million entries, of which a text meets few; texts with places of all kinds."""
    rows = spark.range(1_000_000).select(F.concat(F.lit("Kunde "), F.col("id").cast("string"), F.lit("!")).alias("original"), F.concat(F.lit("<"), F.col("id").cast("string"), F.lit(">")).alias("surrogate"), F.lit(True).alias("confirmed"))
    docs = spark.range(200).select(F.col("id").cast("int").alias("doc_id"), F.expr("concat('ü Kunde ', id * 4999, '!Kunde ', id, '! kunde 7! Kunde 1000000!')").alias("text"))
    return rows, docs


def test_a_million_terms(spark, many):
    mapping, docs = many
    began = time.time()
    there = s.encode(docs, mapping).orderBy("doc_id").collect()
    assert [r["text"] for r in there] == [f"ü <{i * 4999}><{i}> kunde 7! Kunde 1000000!" for i in range(200)]
    assert all(r["replacements_made"] == 2 for r in there[1:]) and there[0]["replacements_made"] == 2
    assert time.time() - began < 120


def test_shards_give_what_one_index_gives(spark, monkeypatch):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abc ü") for _ in range(rng.randint(1, n)))
    mapping = spark.createDataFrame([(w, word(5), True) for w in sorted({word(4) for _ in range(40)})], "original string, surrogate string, confirmed boolean")
    docs = spark.createDataFrame([(i, word(40)) for i in range(30)] + [(90, None), (91, "")], "doc_id int, text string")
    runs = [lambda: s.encode(docs, mapping), lambda: s.decode(docs, mapping), lambda: s.preview(docs, mapping), lambda: s.highlight(docs, mapping)]
    norm = lambda df: {r["doc_id"]: list(r) for r in df.collect()}
    one = [norm(run()) for run in runs]
    monkeypatch.setattr(terms, "MAX_ENTRIES", 9)
    assert [norm(run()) for run in runs] == one


def test_places_of_one_term_that_overlap(spark):
    mapping = spark.createDataFrame([("aa", "x", True), ("a", "y", True)], "original string, surrogate string, confirmed boolean")
    docs = spark.createDataFrame([(1, "aaaaa"), (2, None)], "doc_id int, text string")
    rows = {r["doc_id"]: r["spans"] for r in s.preview(docs, mapping).collect()}
    assert [(x["start"], x["end"]) for x in rows[1]] == [(0, 1), (0, 2), (1, 2), (2, 3), (2, 4), (3, 4), (4, 5)] and rows[2] is None
    assert [(x["start"], x["end"]) for x in s.highlight(docs, mapping).collect()[0]["spans"]] == [(0, 2), (2, 4), (4, 5)]


def test_entries_without_companion_and_the_empty_term(spark):
    mapping = spark.createDataFrame([("a", None, True), ("", "x", True), (None, "z", True), ("b", "", True)], "original string, surrogate string, confirmed boolean")
    docs = spark.createDataFrame([(1, "abc")], "doc_id int, text string")
    assert s.encode(docs, mapping).first()["text"] == "ac"
    assert s.encode(docs, mapping.limit(0)).first()["text"] == "abc"
