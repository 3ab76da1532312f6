"""The mapping and both ways of rewriting."""

import pytest
from pyspark.sql import functions as F

from veilspark.operators import mapping as m
from veilspark.operators import review, terms
from veilspark.operators import substitute as s
from veilspark.streaming import detect_stream


def mapped(spark, rows):
    made = [(o.lower(), o, n, "person", c) for o, n, c in rows]
    return spark.createDataFrame(made, m.SCHEMA)


def items(spark, rows):
    return spark.createDataFrame([(o, c, n, i) for i, (o, c, n) in enumerate(rows)], "original string, category string, surrogate string, position int")


def test_add_bulk(spark):
    one = m.add_bulk(m.empty(spark), items(spark, [("Anna", "person", None), ("ANNA", "person", None), ("Bob", "person", " Person-2 "), ("Cora", "person", " "), ("ACME", "firma", None)]))
    got = {r["original"]: r["surrogate"] for r in one.collect()}
    assert got == {"Anna": "Person-1", "Bob": "Person-2", "Cora": "Person-3", "ACME": "Company-1"}
    two = m.add_bulk(one, items(spark, [("bob", "person", "x"), ("Dora", "person", None)]))
    assert {r["original"]: r["surrogate"] for r in two.collect()} == got | {"Dora": "Person-4"}
    kept = spark.createDataFrame([("Person", 9)], "label string, n int")
    assert {r["surrogate"] for r in m.add_bulk(one, items(spark, [("Eva", "person", None)]), kept).collect()} >= {"Person-10"}
    assert m.next_labels(one).filter("category = 'person'").first()["surrogate"] == "Person-4"
    assert m.add_bulk(m.empty(spark), items(spark, [("x", "ort", None)]).limit(0)).count() == 0


def test_labels_step_over_taken_numbers(spark):
    """Many new ones, numbers taken in runs and alone, by the mapping and by hand: one after the other in brute force."""
    base = mapped(spark, [("a", "Person-3", True), ("b", "Person-2", True)]).unionByName(spark.createDataFrame([("c", "c", "Person-5", "ort", True), ("d", "d", "Person-6", "ort", True), ("e", "e", "Person-9", "ort", True)], m.SCHEMA))
    given = [("x", "person", "Person-11"), ("y", "person", "Person-40")]
    new = [(f"n{i:03}", "person", None) for i in range(60)]
    got = {r["original"]: r["surrogate"] for r in m.add_bulk(base, items(spark, given + new)).collect()}
    taken, number = {2, 3, 5, 6, 9, 11, 40}, 3
    for name, *_ in new:
        number += 1
        while number in taken:
            number += 1
        assert got[name] == f"Person-{number}"
    assert m.next_labels(base).filter("category = 'person'").first()["surrogate"] == "Person-4"


def test_update_remove_import_list(spark):
    base = mapped(spark, [("Anna", "Person-1", True), ("bob", "Person-2", True)])
    patch = spark.createDataFrame([("anna", None, None, False)], "id string, surrogate string, category string, confirmed boolean")
    assert {r["original"]: r["confirmed"] for r in m.update(base, patch).collect()} == {"Anna": False, "bob": True}
    with pytest.raises(m.EntryNotFound):
        m.update(base, patch.withColumn("id", F.lit("nobody")))
    with pytest.raises(m.EntryNotFound):
        m.remove(base, spark.createDataFrame([("nobody",)], "id string"))
    assert m.remove(base, spark.createDataFrame([("bob",)], "id string")).count() == 1
    more = mapped(spark, [("ANNA", "other", True), ("Zoe", "Person-7", True)])
    grown = m.import_entries(base, more)
    assert {r["original"]: r["surrogate"] for r in grown.collect()} == {"Anna": "Person-1", "bob": "Person-2", "Zoe": "Person-7"}
    assert m.counters(grown).first()["n"] == 7
    assert [r["original"] for r in m.listed(grown).collect()] == ["Anna", "bob", "Zoe"]


def test_save_and_load(spark, tmp_path):
    base = mapped(spark, [("Anna", "Person-1", True), ("bob", "Person-2", False)])
    m.save(base, f"{tmp_path}/store")
    assert sorted(map(tuple, m.load(spark, f"{tmp_path}/store").collect())) == sorted(map(tuple, base.collect()))
    many = spark.range(25_000).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("n"), "id").alias("original"), F.lit("s").alias("surrogate"), F.lit("ort").alias("category"), F.lit(True).alias("confirmed"))
    m.save(many, f"{tmp_path}/many", field="replacement")
    assert m.load(spark, f"{tmp_path}/many", field="replacement").exceptAll(many).count() == 0 and m.load(spark, f"{tmp_path}/many", field="replacement").count() == 25_000


def test_rewriting(spark):
    base = mapped(spark, [("Peter Schmidt", "Person-1", True), ("Schmidt", "Person-10", True), ("$10", "Amount-1", True), ("geheim", "x", False), ("", "y", True)])
    docs = spark.createDataFrame([(1, "Peter Schmidt und Schmidt, $10 geheim, schmidt"), (2, None), (3, "")], "doc_id int, text string")
    there = s.encode(docs, base).orderBy("doc_id").collect()
    assert there[0]["text"] == "Person-1 und Person-10, Amount-1 geheim, schmidt"
    assert there[0]["replacements_made"] == 1 + 1 + 1
    assert there[1]["text"] is None and there[2]["text"] == ""
    back = s.decode(s.encode(docs, base).drop("replacements_made"), base).orderBy("doc_id").collect()
    assert back[0]["text"] == "Peter Schmidt und Schmidt,  geheim, schmidt"  # $10 is read as a template
    strict = s.decode(s.encode(docs, base).drop("replacements_made"), base, strict=True).orderBy("doc_id").collect()
    assert strict[0]["text"] == docs.first()["text"]


def test_places(spark):
    base = mapped(spark, [("Ann", "P-1", True), ("Anna", "P-2", True)])
    docs = spark.createDataFrame([(1, "ü Anna, ANNA")], "doc_id int, text string")
    spans = s.preview(docs, base).first()["spans"]
    assert [(x["start"], x["end"], x["term"]) for x in spans] == [(3, 6, "Ann"), (3, 7, "Anna")]
    marks = s.highlight(docs, base).first()["spans"]
    assert [(x["start"], x["end"]) for x in marks] == [(2, 6), (8, 12)]


def test_large_mappings_are_not_broadcast(spark, monkeypatch):
    base = mapped(spark, [("Peter Schmidt", "Person-1", True), ("Ärger", "Person-2", True)])
    docs = spark.createDataFrame([(1, "Peter Schmidt hat Ärger"), (2, "nichts"), (3, None)], "doc_id int, text string")
    small = sorted(map(tuple, s.encode(docs, base).collect()), key=str)
    monkeypatch.setattr(terms, "MAX_ENTRIES", 1)
    assert sorted(map(tuple, s.encode(docs, base).collect()), key=str) == small


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "Mail an a@b.de"), (2, "nochmal a@b.de und c@d.de")], "doc_id int, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("doc_id int, text string").parquet(f"{tmp_path}/in")
    q = detect_stream.pseudonymize(stream, f"{tmp_path}/map", f"{tmp_path}/out", f"{tmp_path}/check")
    q.processAllAvailable()
    q.stop()
    texts = {r["doc_id"]: r["text"] for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out").collect()}
    assert texts == {1: "Mail an Email-1", 2: "nochmal Email-1 und Email-2"}
    assert detect_stream.latest(spark, f"{tmp_path}/map").count() == 2


def test_large_mappings_give_what_small_ones_give(spark, monkeypatch):
    """Short terms inside words, terms that only a replacement makes, capitals, terms without letters, nulls."""
    entries = [("EU", "Ort-1"), ("Ort-1 Bank", "Firma-7"), ("Bank", "Haus"), ("7-Haus", "x"), ("a", "€€"), ("€€", "Z"), ("§", "Par"), ("Müller", "Person-1"), ("Bankhaus", "EU Bank")]
    mapping = spark.createDataFrame([(o, n, True) for o, n in entries], "original string, surrogate string, confirmed boolean")
    texts = ["EUR und NEU", "die EU Bank", "Bankhaus MÜLLER, Müller", "bank BANK a§a", "", None, "Ort-1 Person-1 Haus x Par Z", "Firma-7-Bank", "nichts"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    runs = [lambda: s.encode(docs, mapping), lambda: s.decode(docs, mapping), lambda: s.preview(docs, mapping), lambda: s.highlight(docs, mapping)]
    norm = lambda df: {r["doc_id"]: list(r) for r in df.collect()}
    small = [norm(run()) for run in runs]
    monkeypatch.setattr(terms, "MAX_ENTRIES", 3)
    assert [norm(run()) for run in runs] == small


def test_reviews(spark):
    """Ticked by confidence or by hand, blank overrides, unticked, several forms and reviews of one text, nulls, reviews of nothing found."""
    found = spark.createDataFrame([("Anna", "person", 0.9), ("ANNA", "person", 0.95), ("Bob", "person", 0.6), ("Cora", "person", 0.9), (None, "person", 1.0), ("Dora", "ort", 0.75)], "entity string, category string, confidence double")
    said = [("bob", True, " ", None, "B-1"), ("Cora", False, "x", None, None), ("Dora", True, "Dorfen", "ort", " "), ("new", True, None, "firma", None), ("lost", True, None, None, None), ("bob", None, "never", None, None)]
    reviews = spark.createDataFrame(said, "entity string, checked boolean, text string, category string, surrogate string")
    rows = {tuple(r) for r in review.projected(found, reviews).collect()}
    assert rows == {("ANNA", "person", None, False), ("Bob", "person", "B-1", True), ("Dorfen", "ort", None, True), ("new", "firma", None, True)}
    stored = mapped(spark, [("anna", "Person-4", True), ("zoe", "Person-9", True)])
    merged = {r["original"]: (r["origin"], r["conflict"]) for r in review.merged(stored, review.projected(found, reviews)).collect()}
    assert merged == {"anna": ("stored", None), "zoe": ("stored", None), "Bob": ("reviewed", None), "Dorfen": ("reviewed", None), "new": ("reviewed", None)}
    grown = {r["original"]: r["surrogate"] for r in review.grown(stored, found, reviews).collect()}
    assert grown == {"anna": "Person-4", "zoe": "Person-9", "Bob": "B-1", "Dorfen": "Address-1" if grown["Dorfen"].startswith("A") else grown["Dorfen"], "new": "Company-1"}
    assert review.grown(stored, found.limit(0), reviews.limit(0)).count() == 2


def test_store_of_deltas(spark, tmp_path, monkeypatch):
    """A batch writes its new entries only; numbers go on over restarts and repeats, also of entries removed since; compaction
    keeps all and removes what nothing reads."""
    monkeypatch.setattr(detect_stream, "COMPACT_AFTER", 2)
    store = lambda: detect_stream.MappingStore(spark, f"{tmp_path}/store")
    new = lambda *names: items(spark, [(n, "person", None) for n in names])
    read = lambda df: {r["original"]: r["surrogate"] for r in df.collect()}
    assert read(store().mapping()) == {}
    assert read(store().add(0, new("Anna", "Bob"))) == {"Anna": "Person-1", "Bob": "Person-2"}
    assert read(store().add(1, new("ANNA", "Cora"))) == {"Anna": "Person-1", "Bob": "Person-2", "Cora": "Person-3"}
    assert read(spark.read.parquet(f"{tmp_path}/store/delta-000000000001")) == {"Cora": "Person-3"}
    assert read(store().add(1, new("never"))) == read(store().mapping())  # a repeated batch finds its own delta
    # Cora, who has the highest number, is removed from the store: the number isn't given again.
    spark.createDataFrame([], m.SCHEMA).write.mode("overwrite").parquet(f"{tmp_path}/store/delta-000000000001")
    want = {"Anna": "Person-1", "Bob": "Person-2", "Dora": "Person-4"}
    assert read(store().add(2, new("Dora"))) == want
    store().compact(2)
    assert store().numbers("base") == [2] and read(store().mapping()) == want
    for number, name in enumerate(("Eva", "Fred", "Gus", "Hans"), 3):
        store().add(number, new(name))
        store().compact(number)
    assert store().numbers("base")[-1] == 6 and 0 not in store().numbers("delta") and 2 not in store().numbers("delta")
    assert read(store().mapping()) == want | {"Eva": "Person-5", "Fred": "Person-6", "Gus": "Person-7", "Hans": "Person-8"}


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    docs = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    docs("Mail an a@b.de").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("doc_id int, text string").parquet(f"{tmp_path}/in")

    def run():
        q = detect_stream.pseudonymize(stream, f"{tmp_path}/map", f"{tmp_path}/out", f"{tmp_path}/check")
        q.processAllAvailable()
        q.stop()
        return sorted(r["text"] for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out").collect())

    assert run() == ["Mail an Email-1"]
    docs("nun c@d.de und a@b.de").write.mode("append").parquet(f"{tmp_path}/in")
    assert run() == ["Mail an Email-1", "nun Email-2 und Email-1"]
    assert {r["surrogate"] for r in spark.read.parquet(f"{tmp_path}/map/delta-000000000001").collect()} == {"Email-2"}


def test_first_start_and_reset(spark, tmp_path):
    path = f"{tmp_path}/saved"
    assert m.load_or_empty(spark, path).count() == 0 and not m.reset(spark, path)
    rows = [("1", "Anna", "P-1", "person", True), ("2", "ANNA", "P-2", "person", False), ("3", None, "P-3", "person", True)]
    m.save(spark.createDataFrame(rows, m.empty(spark).schema), path)
    assert sorted(r["id"] for r in m.load_or_empty(spark, path).collect()) == ["1", "3"]
    (tmp_path / "saved" / "other.txt").write_text("x")
    with pytest.raises(ValueError, match="more than"):
        m.reset(spark, path)
    (tmp_path / "saved" / "other.txt").unlink()
    assert m.reset(spark, path) and m.load_or_empty(spark, path).count() == 0
