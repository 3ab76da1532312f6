"""The training-data operators against brute force, round trips and the edges that they define."""

import base64
import hashlib
import itertools
import os
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilspark.llm import common, fingerprint, langid, line_dedup, near_dedup, packing, passages, quality, secret_scan, spm, tokenizer, warc

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bands string, k string, site string"
ODD = [None, "", " ", "\n\n", "a", "  two  blanks ", "é́𝄞   ß ẞ", "x" * 60_000, "wort " * 12_000, "a b c d e f g h i j k l"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and very long texts, ties and repeated rows, extra columns with clashing names."""
    rows = [(i, t, None if i % 2 else "en", None if i % 3 else "s", None, "b", None, "q") for i, t in enumerate(ODD)]
    rows += [rows[9]] * 3 + [(None, "null id", None, None, None, None, None, None), (9, "another text", "de", "s", 1, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --- 1: SentencePiece ----------------------------------------------------------------------------------------------------


def test_spm_equals_the_library(spark, docs, odd, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(1)
    texts = [r["text"] for r in docs.collect()] + [t for t in ODD if t] + ["".join(rng.choice("abcetn  \n.é🙂日") for _ in range(70)) for _ in range(300)] + ["aaaaaaaaaaaaa", "\x00 x", "tab\tand\r\n"]
    m = spm.Model.from_file(path)
    got = [np.frombuffer(x, "<i4").tolist() for x in m.encode(texts)]
    assert got == sp.encode(texts)
    assert [m.decode(x) for x in got] == texts
    rows = spm.round_trip(odd, path).collect()
    assert all(r["decoded"] == r["text"] for r in rows) and len(rows) == odd.count()
    assert [r["decoded"] for r in spm.decode(spm.encode(odd, path), path).collect()] == [r["text"] for r in rows]
    assert spm.round_trip(none, path).count() == 0


def test_viterbi_is_the_best_segmentation():
    pieces = [("<unk>", 0.0), ("▁", -3.0), ("a", -2.5), ("b", -2.6), ("ab", -3.1), ("ba", -3.3), ("aba", -4.5), ("▁a", -3.9), ("▁ab", -4.2), ("bb", -5.0)]
    m = spm.Model(pieces, spm.UNIGRAM, 0)

    def score(word, ends):
        return sum(m.scores.get(word[a:b], m.worst if b - a == 1 else -1e9) for a, b in zip([0, *ends], ends))

    rng = random.Random(2)
    for _ in range(200):
        w = "▁" + "".join(rng.choice("abc") for _ in range(rng.randint(0, 8)))
        best = max(score(w, [*(i + 1 for i, c in enumerate(cut) if c), len(w)]) for cut in itertools.product([0, 1], repeat=len(w) - 1))
        begins = np.flatnonzero(m.viterbi([w])[0][0]).tolist()
        assert abs(score(w, [*begins[1:], len(w)]) - best) < 1e-9
        assert abs(score(w, m.viterbi_long(w)) - best) < 1e-9
    assert np.frombuffer(m.encode(["cc a"])[0], "<i4").tolist()[:2] == [1, 0]


# --- 2: lines --------------------------------------------------------------------------------------------------------------


def brute_lines(rows, ratio, least):
    pages, on = Counter(), defaultdict(set)
    for i, (site, text) in enumerate(rows):
        pages[site] += 1
        for line in (text or "").split("\n"):
            if k := line.strip(" \t\n\x0b\x0c\r"):
                on[site, k].add(i)
    bad = {x for x, s in on.items() if len(s) >= least and len(s) > ratio * pages[x[0]]}
    return [None if t is None else "\n".join(x for x in t.split("\n") if (s, x.strip(" \t\n\x0b\x0c\r")) not in bad) for s, t in rows]


def test_line_dedup(spark, docs, odd, none):
    for df in (docs, odd):
        rows = [(r["source"], r["text"]) for r in df.collect()]
        want = Counter(brute_lines(rows, 0.1, 2))
        out = line_dedup.dedup_lines(df, min_pages=2)
        assert out.columns == [*df.columns, "n_lines", "n_dropped"]
        assert Counter(r["text"] for r in out.collect()) == want
    assert line_dedup.dedup_lines(none).count() == 0


# --- 3: WARC ----------------------------------------------------------------------------------------------------------------


def test_warc(spark):
    big = "ü" * 100_000
    rows = [(1, "u", "same"), (2, "v\n", "same"), (3, None, None), (4, "w", ""), (5, "x", big), (6, "x", "solo"), (7, "y", "same"), (7, "y", "same"), (None, "n", "same"), (None, "n", "other")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = common.new_folder(spark, "warc-test")
    warc.write_archive(warc.planned(pages), path, roll_bytes="2000")
    got = warc.read_archive(spark, path).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = max(first.get(h or "", -1), i)
    assert len(got) == len(rows)
    seen = Counter()
    for r in got:
        seen[r["page_id"]] += 1
        if r["page_id"] is None:
            assert r["record_type"] == ("revisit" if r["refers_to"] else "response")
            continue
        html = next(h for i, _, h in rows if i == r["page_id"]) or ""
        data = html.encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert r["record_type"] == ("response" if first[html] == r["page_id"] else "revisit")
        assert r["refers_to"] == (None if first[html] == r["page_id"] else first[html])
        assert r["payload"] == (data if r["record_type"] == "response" else None)
    assert seen == Counter(i for i, _, _ in rows)
    only = warc.read_archive(spark, path).filter("record_type = 'revisit' AND target_uri LIKE 'u%'")
    assert "Filter" not in only._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0] and [r["page_id"] for r in only.collect()] == [1]
    empty = common.new_folder(spark, "warc-test")
    warc.write_archive(warc.planned(pages.limit(0)), empty)
    assert warc.read_archive(spark, empty).count() == 0


def test_warc_commits(spark, tmp_path):
    one = spark.createDataFrame([(1, "u", "a")], "page_id long, url string, html string")
    path = common.new_folder(spark, "warc-test")
    for _ in range(2):
        warc.write_archive(warc.planned(one), path)
    assert warc.read_archive(spark, path).count() == 2  # appended, not replaced
    # Columns of the names used inside clash with nothing.
    clash = one.selectExpr("*", "'x' AS sha", "5 AS first", "7 AS n", "'y' AS payload", "'z' AS record_type")
    warc.write_archive(warc.planned(clash), path, mode="overwrite")
    assert [(r["page_id"], bytes(r["payload"])) for r in warc.read_archive(spark, path).collect()] == [(1, b"a")]
    files = [n for n in os.listdir(path.removeprefix("file://")) if not n.startswith(".")]
    assert len(files) == 2  # a manifest, an archive

    def rows(fail):
        yield pa.RecordBatch.from_pylist([{"page_id": 1, "url": "u", "payload": b"a", "record_type": "response", "refers_to": None}], pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("record_type", pa.string()), ("refers_to", pa.int64())]))
        if fail:
            raise ValueError("lost")

    writer = warc.WarcWriter({"path": f"file://{tmp_path}"})
    with pytest.raises(ValueError):
        writer.write(rows(True))
    assert not os.listdir(tmp_path)
    done = writer.write(rows(False))
    assert len(os.listdir(tmp_path)) == 1
    writer.abort([done, None])
    assert not os.listdir(tmp_path)


def test_warc_members_of_several_records(spark, tmp_path):
    import gzip

    from pyarrow import fs

    rng = np.random.default_rng(3)
    data = [warc.record(i, f"u{i}", rng.bytes(int(rng.integers(0, 9000))) + b"z" * (2_000_000 * (i == 7)), "response", None) for i in range(40)]
    path = tmp_path / "several.warc.gz"
    path.write_bytes(b"".join(gzip.compress(b"".join(data[i : i + 5])) for i in range(0, 40, 5)))
    size = path.stat().st_size
    store = fs.LocalFileSystem()
    for step in (size, 1000, 30_000):
        found = []
        for at in range(0, size, step):
            with store.open_input_file(str(path)) as f:
                found += [warc._page(r.headers["warc-record-id"]) for r in warc.records(f, start=at, end=at + step)]
        assert found == list(range(40))
    with store.open_input_file(str(path)) as f:
        assert [warc._page(r.headers["warc-record-id"]) for r in warc.records(f, lambda h: h["warc-target-uri"] in ("u3", "u39"))] == [3, 39]
    read = warc.read_archive(spark, f"file://{tmp_path}", split_bytes="20000")
    assert read.rdd.getNumPartitions() == -(-size // 20000) and sorted(r["page_id"] for r in read.collect()) == list(range(40))
    path.write_bytes(path.read_bytes()[:-2000])
    with store.open_input_file(str(path)) as f, pytest.raises(EOFError):
        list(warc.records(f))
    info = b"software: x\r\n\r\ny"
    path.write_bytes(gzip.compress(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(info), info)))
    assert [(r["record_type"], bytes(r["payload"])) for r in warc.read_archive(spark, f"file://{tmp_path}").collect()] == [("warcinfo", info)]


def test_warc_of_other_writers(tmp_path):
    import gzip

    from pyarrow import fs

    data = [warc.record(i, f"u{i}", b"p" * (i * 5000), "response", None) for i in range(5)]
    store = fs.LocalFileSystem()
    for name, content in (("plain.warc", b"".join(data)), ("members.warc.gz", b"".join(map(gzip.compress, data)))):
        (tmp_path / name).write_bytes(content)
        with store.open_input_file(str(tmp_path / name)) as f:
            assert [len(r.http()[1]) for r in warc.records(f)] == [0, 5000, 10000, 15000, 20000]
        with store.open_input_file(str(tmp_path / name)) as f:
            assert [r.headers["warc-target-uri"] for r in warc.records(f, lambda h: h["warc-target-uri"] == "u3")] == ["u3"]


# --- 4: quality ---------------------------------------------------------------------------------------------------------------


def brute_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_statistics(docs, odd):
    for df in (docs, odd):
        for r in quality.statistics(df).collect():
            n, *_, repeated = want = brute_statistics(r["text"])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
            del n, repeated


def brute_distances(x, floors, h=quality.H, steps=quality.STEPS):
    """The same estimate in numpy."""
    p = x.shape[1]

    def low(values, q):
        ordered = np.sort(values)
        return ordered[max(0, int(np.ceil(q * len(ordered))) - 1)]

    grid = lambda v: np.floor(v * quality.GRID)
    centre = np.array([low(grid(x[:, i]), 0.5) for i in range(p)]) / quality.GRID
    spread = np.array([max(low(grid(np.abs(x[:, i] - centre[i])), 0.5) / quality.GRID * 1.4826, floors[i]) for i in range(p)])
    factor = np.diag(spread)

    def d2(c, f):
        y = np.linalg.solve(f, (x - c).T)
        return (y * y).sum(axis=0)

    inner = quality.chi2_quantile(h, p)
    for step in range(steps + 1):
        d = d2(centre, factor)
        if step < steps:
            b = np.floor(np.log2(d + 2.0**-10) * quality.FINE)
            chosen, scale = b <= low(b, h), h / quality.chi2_cdf(inner, p + 2)
        else:
            edge = quality.chi2_quantile(0.975, p)
            chosen, scale = d <= edge, 0.975 / quality.chi2_cdf(edge, p + 2)
        s = x[chosen]
        centre = s.mean(axis=0)
        cov = (s.T @ s / len(s) - np.outer(centre, centre)) * scale + np.diag(np.array(floors) ** 2)
        factor = np.linalg.cholesky(cov)
    return d2(centre, factor)


def test_robust_distances(spark, docs, odd, none):
    one = docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y"))
    rows = quality.judged(one).orderBy("doc_id").collect()
    exprs = [F.expr(sql).cast("double").alias(f"x{i}") for i, (sql, _) in enumerate(quality.FEATURES.values())]
    x = np.array(quality.statistics(one).orderBy("doc_id").select(*exprs).collect())
    want = brute_distances(x, [f for _, f in quality.FEATURES.values()])
    assert np.allclose([r["d2"] for r in rows], want, rtol=1e-6, atol=1e-9)
    cut = quality.chi2_quantile(quality.CUTOFF, len(quality.FEATURES))
    assert [r["kept"] for r in rows] == [not r["base_failed"] and d <= cut for r, d in zip(rows, want)]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = [r["kept"] for r in quality.judged(docs).collect() if labels.get(r["doc_id"]) == 1 and not r["base_failed"]]
    assert kept and all(kept)
    assert quality.judged(odd).count() == odd.count() and quality.judged(none).count() == 0
    again = quality.judged_rows(docs)
    assert Counter(r["kept"] for r in again.collect()) == Counter(r["kept"] for r in quality.judged(docs).collect())


def test_chi_square():
    assert abs(quality.chi2_quantile(0.75, 6) - 7.8408) < 1e-3 and abs(quality.chi2_cdf(2.0, 2) - (1 - np.exp(-1))) < 1e-12


# --- 5: near-duplicates --------------------------------------------------------------------------------------------------


def brute_classes(texts):
    """Classes of texts by all pairs."""
    with np.errstate(over="ignore"):
        labels = [near_dedup.labelled(near_dedup.shingles(near_dedup.word_hashes(t))) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or (len(labels[i]) and near_dedup.similarity(labels[i], labels[j])):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(texts))]


def edited(text, rng, share):
    words = text.split(" ")
    for _ in range(max(1, int(len(words) * share))):
        words[rng.randrange(len(words))] = f"neu{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_duplicates(spark, docs, odd, none):
    rng = random.Random(3)
    base = [r["text"] for r in docs.orderBy("doc_id").collect()][:120]
    long = [t for t in base if len(t.split()) > 120][:15]
    texts = base + [edited(t, rng, 0.01) for t in long for _ in range(4)] + long[:5] * 3
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(rows).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)
    kept = near_dedup.deduplicated(rows)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values())) and kept.columns == rows.columns
    assert near_dedup.classes(odd).count() == odd.count() and near_dedup.classes(none).count() == 0
    left = near_dedup.deduplicated(odd).collect()
    assert Counter(r["text"] for r in left)["a b c d e f g h i j k l"] == 1 and near_dedup.deduplicated(none).count() == 0


def test_near_duplicates_on_a_template(spark):
    """Pairs just above the limit among many pages that share a template just below it: only all-pairs search finds all."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**9)}"
    template, texts = [word() for _ in range(234)], []
    for _ in range(60):
        own = [word() for _ in range(66)]
        texts.append(" ".join(template + own))
        texts.append(" ".join(template + own[:16] + [word() for _ in range(50)]))
    order = list(range(len(texts)))
    rng.shuffle(order)
    texts = [texts[i] for i in order]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(rows).collect()}
    want = brute_classes(texts)
    assert len(set(want)) == 60 and [got[i] for i in range(len(texts))] == want


def test_similarity_is_the_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(200):
        a = [rng.randrange(30) for _ in range(rng.randint(1, 25))]
        b = [x for x in a if rng.random() > 0.1] + [rng.randrange(30)]
        with np.errstate(over="ignore"):
            la, lb = (near_dedup.labelled(np.array(x, dtype=np.uint64)) for x in (a, b))
        table = np.zeros((len(la) + 1, len(lb) + 1), int)
        for i, j in itertools.product(range(len(la)), range(len(lb))):
            table[i + 1, j + 1] = table[i, j] + 1 if la[i] == lb[j] else max(table[i, j + 1], table[i + 1, j])
        want = table[-1, -1] / max(len(a), len(b))
        assert near_dedup.similarity(la, lb) == pytest.approx(want if want >= 0.8 - 1e-9 else 0.0)


def test_likely_in(spark):
    left = spark.range(200_000).selectExpr("id AS a", "id % 7 AS b")
    right = left.filter("a % 50 = 0").withColumnsRenamed({"a": "c", "b": "d"})
    kept = common.likely_in(left, right, ["c", "d"], ["a", "b"])
    ids = {r["a"] for r in kept.collect()}
    assert {*range(0, 200_000, 50)} <= ids and len(ids) < 5000  # none that is there is lost; few others pass
    marked = common.likely_in(left, right, ["c", "d"], ["a", "b"], mark="m")
    assert marked.columns == ["a", "b", "m"] and marked.count() == 200_000 and {r["a"] for r in marked.filter("m").collect()} == ids
    assert common.likely_in(left, right.limit(0), ["c", "d"], ["a", "b"]).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000, i) for i in range(1001, 1300)] + [(i, i + 1) for i in range(2000, 2040)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert all(got[x] == find(x) for x in parent if x in got) and all(x in got for a, b in edges if a != b for x in (a, b))
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 6: languages ------------------------------------------------------------------------------------------------------------


def test_language_id(spark, docs, odd, none):
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    langs, logs = langid.train(docs.filter(~held))
    rows = langid.predict(docs.filter(held), langs, logs).join(docs, "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(odd, langs, logs).collect()}
    assert got[0] == got[1] == got[2] == "und" and got[4] in langs
    assert langid.predict(none, langs, logs).count() == 0
    nothing = langid.train(none)
    assert {r["lang_pred"] for r in langid.predict(docs, *nothing).collect()} == {"und"}


def test_scores_sum_over_whole_texts(docs, monkeypatch):
    langs, logs = langid.train(docs)
    texts = [r["text"] for r in docs.limit(40).collect()] + ["", None, "é"]

    def brute(t):
        total = np.zeros(len(langs))
        for k, n in enumerate(langid.ORDERS):
            for b in langid.hashed(langid.code_points(t), n):
                total += logs[k * langid.BUCKETS + b]
        return langs[int(np.argmax(total))]

    for run in (1 << 20, 100):
        monkeypatch.setattr(langid, "RUN", run)
        assert langid.score(texts, langs, logs)[0][:40] == [brute(t) for t in texts[:40]]


# --- 7: passages --------------------------------------------------------------------------------------------------------------


def test_passages(spark, docs, odd, none):
    rng = random.Random(6)
    words = [w for r in docs.orderBy("doc_id").limit(60).collect() for w in r["text"].split()]
    draw = lambda n: [rng.choice(words) for _ in range(n)]
    texts, planted = [" ".join(draw(rng.randint(20, 400))) for _ in range(60)], []
    for p in range(25):
        passage, group = draw(51 + p % 4), []
        for _ in range(2 + p % 3):
            w = draw(rng.randint(0, 200))
            at = rng.randint(0, len(w))
            group.append(len(texts))
            texts.append(" ".join(w[:at] + passage + w[at:]))
        planted.append((group, " ".join(passage)))
    texts += [texts[0]] * 3
    rows = passages.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    told = defaultdict(list)
    for r in rows:
        told[r["doc_id"]].append(r)
    for group, passage in planted:
        classes = [{(r["class_doc_id"], r["class_start"]) for r in told[i] if passage in " ".join(texts[i].split()[r["start_word"] : r["end_word"]])} for i in group]
        assert set.intersection(*classes)
    expected = {i for g, _ in planted for i in g} | {0, *range(len(texts) - 3, len(texts))}
    assert set(told) == expected  # clean documents are left alone
    assert sum(r["kept"] for r in rows) == len({(r["class_doc_id"], r["class_start"], r["kind"]) for r in rows})
    assert {r["doc_id"] for r in passages.repeated_passages(odd).collect()} <= {8}
    assert passages.repeated_passages(none).count() == 0


def test_cuts_don_t_depend_on_surroundings():
    rng = np.random.default_rng(7)
    with np.errstate(over="ignore"):
        for _ in range(100):
            hashes = rng.integers(0, 50 if rng.random() < 0.3 else 2**63, rng.integers(1, 300)).astype(np.uint64)
            drawn = near_dedup._mix(hashes ^ passages._SALT)
            want = set()
            for i in range(len(drawn) - passages.WINDOW + 1):
                inside = drawn[i : i + passages.WINDOW]
                want.add(i + max(np.flatnonzero(inside == inside.min())))
            assert set(passages.cuts(hashes).tolist()) == want


def test_every_occurrence_is_aligned():
    """A passage twice in one text, one after an earlier fragment of it, one edited; and a text of one word."""
    rng = random.Random(13)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    p = words(56)
    found = lambda x, y: [f[:4] for f in passages.common_passages(*(near_dedup.shingles(near_dedup.word_hashes(" ".join(t))) for t in (x, y)))]
    with np.errstate(over="ignore"):
        b = words(10) + p + words(30)
        assert found(words(20) + p + words(40) + p + words(5), b) == [(20, 76, 10, 66), (116, 172, 10, 66)]
        assert found(words(20) + p[:30] + words(40) + p + words(5), b) == [(90, 146, 10, 66)]
        assert found(words(20) + p[10:40] + words(40) + p[:28] + words(1) + p[29:] + words(5), b) == [(90, 146, 10, 66)]
        assert found(["wort"] * 3000, ["wort"] * 2000)[0][2:] == (0, 2000)
        many = [[x for _ in range(12) for x in words(30) + p] for _ in range(2)]
        links = passages.common_passages(*(near_dedup.shingles(near_dedup.word_hashes(" ".join(t))) for t in many))
        kept = passages.spanning(links)
        assert len(links) >= 144 and len(kept) == 23 and {x[:2] for x in kept} == {x[:2] for x in links} and {x[2:4] for x in kept} == {x[2:4] for x in links}
        assert [x[:4] for x in passages.spanning([(0, 60, 0, 60, 1.0), (50, 120, 0, 70, 1.0), (200, 260, 300, 360, 1.0)])] == [(0, 120, 0, 70), (200, 260, 300, 360)]


def test_texts_hashed_together_are_hashed_alike():
    """Words and bands of many texts are those of each text; equal hashes are equal words, of any length and white space."""
    text = "Ein\tzwei\n\ndrei  ü " + "x" * 8 + " " + "x" * 9 + " " + "y" * 300 + " \x0b" + "y" * 301 + " a\u00a0b\x00 \ud800"
    texts = ["", " \n", text, "drei", "", " ".join(f"w{i % 90}" for i in range(400)), text + " ", "kurz " * 49]
    hashes, upto = near_dedup.words_of(texts)
    words = [w for t in texts for w in t.encode("utf-8", "surrogatepass").split()]
    assert len(hashes) == len(words) and len(upto) == len(texts) + 1 and len(set(zip(words, hashes.tolist(), strict=True))) == len(set(words)) == len(set(hashes.tolist()))
    with np.errstate(over="ignore"):
        bands, at, n = passages.bands_of(texts)
        for i, t in enumerate(texts):
            assert hashes[upto[i] : upto[i + 1]].tolist() == near_dedup.word_hashes(t).tolist()
            one, count = passages.bands(t)
            assert count == n[i] == len(t.encode("utf-8", "surrogatepass").split())
            assert bands[at[i] : at[i + 1]].tolist() == one.tolist() and len(one) == len(set(one.tolist()))
    assert len(near_dedup.words_of([])[0]) == 0 and passages.bands("")[1] == 0


def test_edited_passages_share_a_band():
    """Passages of 50 to 60 words with a word changed, left out or put in, in other surroundings."""
    rng = random.Random(12)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    tried = 0
    with np.errstate(over="ignore"):
        for _ in range(600):
            one = words(rng.randint(50, 60))
            at = rng.randrange(len(one))
            two = one[:at] + words(rng.randint(0, 2)) + one[at + rng.randint(0, 1) :]
            a, b = (set(near_dedup.shingles(near_dedup.word_hashes(" ".join(x))).tolist()) for x in (one, two))
            if min(len(one), len(two)) < passages.LEAST_WORDS or len(a & b) < 0.8 * len(a | b):
                continue
            tried += 1
            here, there = (passages.bands(" ".join(words(80) + x + words(80)))[0] for x in (one, two))
            assert len(np.intersect1d(here, there))
    assert tried > 300


def test_passages_around_boilerplate(spark):
    """Pairs of texts that have a few words on both sides of what all texts share in common, verbatim and edited."""
    rng = random.Random(14)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    for common, beyond, edit in ((46, 3, False), (40, 8, False), (40, 9, True)):
        shared, texts = words(common), []
        for _ in range(100):
            passage = words(beyond) + shared + words(beyond)
            texts.append(words(rng.randint(0, 80)) + passage + words(rng.randint(0, 80)))
            if edit:
                passage[rng.randrange(beyond, beyond + common)] = "edited"
            texts.append(words(rng.randint(0, 80)) + passage + words(rng.randint(0, 80)))
        docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
        told = defaultdict(set)
        for r in passages.repeated_passages(docs).collect():
            told[r["doc_id"]].add((r["class_doc_id"], r["class_start"]))
        together = sum(bool(told[2 * i] & told[2 * i + 1]) for i in range(100))
        with np.errstate(over="ignore"):
            hashes = [near_dedup.shingles(near_dedup.word_hashes(" ".join(t))) for t in texts]
            alike = sum(bool(passages.common_passages(hashes[2 * i], hashes[2 * i + 1])) for i in range(100))
        assert together >= (95 if edit else 100) * alike / 100 and alike >= 90


@pytest.mark.parametrize("crowd,family", [(200, 20), (120, 60)])
def test_passages_of_parts_that_a_crowd_has_apart(spark, crowd, family):
    """Two blocks of 30 words apart in a crowd, side by side with one own word between them in a family of documents."""
    rng = random.Random(crowd)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    one, two = words(30), words(30)
    texts = [words(rng.randint(20, 60)) + one + words(rng.randint(60, 90)) + two + words(rng.randint(20, 60)) for _ in range(crowd)]
    texts += [words(rng.randint(20, 60)) + one + words(1) + two + words(rng.randint(20, 60)) for _ in range(family)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    docs = spark.createDataFrame([(order[i], " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    told = Counter()
    for r in passages.repeated_passages(docs).collect():
        told[r["class_doc_id"], r["class_start"]] += order.index(r["doc_id"]) >= crowd
    assert max(told.values(), default=0) >= 0.95 * family


def test_passages_of_copies(spark):
    """Copies of a text have its passages, too; they are removals."""
    rng = random.Random(15)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    p = words(60)
    one, two = " ".join(words(30) + p + words(5)), " ".join(p + words(40))
    rows = passages.repeated_passages(spark.createDataFrame([(1, one), (2, one), (3, two), (4, one)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["start_word"], r["end_word"], r["class_doc_id"], r["kept"]) for r in rows if r["kind"] == "passage") == [(1, 30, 90, 1, True), (2, 30, 90, 1, False), (3, 0, 60, 1, False), (4, 30, 90, 1, False)]
    assert sorted((r["doc_id"], r["class_doc_id"], r["kept"]) for r in rows if r["kind"] == "copy") == [(1, 1, True), (2, 1, False), (4, 1, False)]


# --- 8: packing ---------------------------------------------------------------------------------------------------------------


def test_packing(spark, docs, odd, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    for df in (docs, odd.drop("k").filter("doc_id IS NULL OR doc_id <> 9"), none):
        rows = packing.pack(df, path).collect()
        texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
        by_doc, by_sequence = defaultdict(list), defaultdict(list)
        for r in rows:
            by_doc[r["doc_id"]].append(r)
            by_sequence[r["sequence_id"]].append(r)
        assert set(by_doc) == set(texts)
        for i, pieces in by_doc.items():
            ids = t.encode(texts[i], add_special_tokens=False).ids + [0]
            pieces.sort(key=lambda r: r["start"])
            assert [x for r in pieces for x in np.frombuffer(r["ids"], "<u4").tolist()] == ids
            assert all(r["doc_tokens"] == len(ids) for r in pieces) and pieces[0]["start"] == 0
            assert all(a["start"] + a["length"] == b["start"] for a, b in zip(pieces, pieces[1:]))
        padding = 0
        for pieces in by_sequence.values():
            pieces.sort(key=lambda r: r["offset"])
            assert pieces[0]["offset"] == 0 and all(a["offset"] + a["length"] == b["offset"] for a, b in zip(pieces, pieces[1:]))
            total = sum(r["length"] for r in pieces)
            assert total <= 1024 and len(pieces) <= 64
            padding += 0 if total & (total - 1) == 0 else 1024 - total
        assert padding <= 0.02 * sum(r["length"] for r in rows)


def test_limits_hold_together():
    rng = random.Random(8)
    limits = packing.Limits(tokens=100, segments=4, loss_tokens=50, cut=False)
    packer = packing.Packer(limits)
    lengths = [(rng.randint(1, 100), rng.random()) for _ in range(2000)]
    pieces = [packing.Piece(i, 0, np.zeros(n, np.uint32), n, n - min(50, int(n * f))) for i, (n, f) in enumerate(lengths)]
    sequences = [s for p in pieces for s in packer.add(p)] + list(packer.close())
    assert sorted(p.doc_id for s in sequences for p in s) == list(range(2000))
    for s in sequences:
        assert sum(len(p.ids) for p in s) <= 100 and len(s) <= 4 and sum(p.loss() for p in s) <= 50
    with pytest.raises(ValueError):
        list(packer.add(packing.Piece(0, 0, np.zeros(101, np.uint32), 101, 0)))


def test_chunked_ids_are_the_tokenizer_s(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t, mine = Tokenizer.from_file(path), tokenizer.ByteBpe(path)
    rng = random.Random(9)
    texts = [r["text"] for r in docs.limit(100).collect()] + [x for x in ODD if x] + ["<|endoftext|> x", "a \n b", "it's 12.5% — “q”\t x"] + ["".join(rng.choice("ab1 \n\t.'é 🙂") for _ in range(60)) for _ in range(500)]
    for x in texts:
        assert np.frombuffer(mine.encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


# --- 9: fingerprints ----------------------------------------------------------------------------------------------------------


def test_fingerprints(spark, docs, odd, none, monkeypatch):
    for df in (docs, odd):
        rows = sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        want = Counter()
        for i, (doc_id, text) in enumerate(rows):
            following = rows[(i + 1) % len(rows)][1]
            n = len(text) // 4
            changed = text[: len(text) - n] + following[:n]
            canon = lambda t: " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()).split()).encode()
            want[doc_id, len(text), fingerprint.digest(canon(text)), hashlib.sha256(changed.encode()).hexdigest(), fingerprint.digest(canon(changed)), float(canon(text) == canon(changed)), float(canon(text) == canon(following))] += 1
        for blocks in (1, 3, 40):
            assert Counter(map(tuple, fingerprint.fingerprints(df, blocks=blocks).collect())) == want
    assert fingerprint.fingerprints(none).count() == 0


# --- 10: secrets ----------------------------------------------------------------------------------------------------------------


def brute_spans(text):
    caseless = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    keys = "|".join(map(caseless, ["password", "passwd", "secret", "token"])) + "|" + caseless("api") + "_?" + caseless("key")
    out = []
    for k, (pattern, keep) in enumerate([(rf"""({keys})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6), ("AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("[0-9a-f]+", lambda m: len(m[0]) >= 24)]):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if keep(m)]
    return sorted(out)


def test_secrets(spark, docs, odd, none):
    model = secret_scan.train(secret_scan.labelled_samples(spark, 600))
    rng = random.Random(10)
    parts = ["password", "TOKEN", "api_key", "=", ":", '"', "'", " ", "é", "𝄞", "AKIA", "ABCDEFGHIJKLMNOP1", "deadbeef" * 3, "abc", "Xk29sPqLw83jdkLLQz91", "\n", "secret:token:abcdefg"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(800)]
    df = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    out = secret_scan.scan(df, model).withColumn("red", secret_scan.redacted("coalesce(text, '')", "spans"))
    for r in out.collect():
        text = r["text"] or ""
        spans = [tuple(s) for s in r["spans"]]
        assert [s for s in spans if s[1] < 3] == brute_spans(text)
        for s, k, e in spans:
            if k == 3:
                assert not any(a < e and b > s for a, kk, b in spans if kk < 3)
        at, want = 0, ""
        for s, _, e in spans:
            if s >= at:
                want += text[at:s] + "[secret]"
            at = max(at, e)
        assert r["red"] == want + text[at:]
    assert secret_scan.scan(none, model).count() == 0


def brute_added(text, ratios, base):
    """Spans of the Markov pair, by trying every stretch of every run."""
    alphabet = secret_scan.ALPHABET
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", text):
        t = m.group()
        codes = [0] + [alphabet.index(c) + 1 for c in t]
        steps = [ratios[p * len(alphabet) + c - 1] for p, c in zip(codes, codes[1:])]
        total = [0.0, *itertools.accumulate(steps)]
        best, i, j = max((total[j] - total[i], i, j) for i in range(len(t)) for j in range(i + 1, len(t) + 1))
        if best <= secret_scan.THRESHOLD or j - i < secret_scan.STRETCH:
            continue
        while i and t[i - 1] not in "/_=-":
            i -= 1
        while j < len(t) and t[j] not in "/_=-":
            j += 1
        while j < len(t) and t[j] == "=":
            j += 1
        if not any(s < m.start() + j and e > m.start() + i for s, _, e in base):
            out.append((m.start() + i, 3, m.start() + j))
    return out


def test_markov_models_tell_random_from_ordinary(spark, docs):
    model = secret_scan.train(secret_scan.labelled_samples(spark))
    found = lambda df: secret_scan.scan(df, model).select("text", "random", F.expr("exists(spans, x -> x.k = 3)").alias("f"), F.expr("exists(spans, x -> x.k < 3)").alias("b")).collect()
    # Ids that training has not seen; random ones are cut to a length.
    fresh = secret_scan.labelled_samples(spark, 2500, start=1_000_000).filter("length(text) >= 24")
    got = found(fresh.withColumn("text", F.expr("CASE WHEN random THEN substring(text, 1, 24) ELSE text END")))
    assert not any(r["f"] for r in got if not r["random"])
    random_ones = [r for r in got if r["random"]]
    assert sum(r["f"] or r["b"] for r in random_ones) >= 0.98 * len(random_ones)
    # Keys planted in documents: of other forms than the samples', with no word before them and inside of paths.
    rng = random.Random(11)
    texts = [r["text"] for r in docs.collect() if r["text"] and len(r["text"]) > 200]
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    forms = [upper + upper.lower() + "0123456789", upper + upper.lower() + "0123456789+/", upper + "234567", "0123456789ABCDEF", upper + upper.lower()]
    planted = []
    for n in range(400):
        key = "".join(rng.choice(forms[n % 5]) for _ in range(rng.randint(24, 44)))
        text = rng.choice(texts)
        at = text.index(" ", rng.randrange(len(text) // 2)) + 1
        around = ["{} ", "config/service/{}/index-file ", '"{}" '][n % 3]
        planted.append((n, text[:at] + around.format(key) + text[at:], at + around.index("{}"), key))
    out = secret_scan.scan(spark.createDataFrame([(n, t) for n, t, _, _ in planted], "doc_id long, text string"), model)
    spans = {r["doc_id"]: [tuple(x) for x in r["spans"]] for r in out.collect()}
    whole = sum(any(s <= at + 2 and e >= at + len(key) - 2 for s, _, e in spans[n]) for n, _, at, key in planted)
    assert whole >= 0.95 * len(planted)
    for n, text, _, _ in planted:
        base = brute_spans(text)
        # Stretches of equal ratio may differ; sums in another order differ by little.
        assert [s for s in spans[n] if s[1] == 3] == brute_added(text, model.ratios, base)
    # Documents without a secret are left alone.
    own = secret_scan.scan(docs.select("doc_id", "text"), model)
    assert own.filter("exists(spans, x -> x.k = 3)").count() == 0


def test_crc_of_pieces(spark, docs):
    r = packing.pack(docs.limit(3), public_tokenizers.path("byte_bpe_50k.json")).select("ids", F.crc32("ids").alias("c")).first()
    assert r["c"] == zlib.crc32(r["ids"])


# --- the pipeline -----------------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in p.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_dedup", "secret_scan", "packing"]
    now = docs
    for name, stage in p.STAGES[:-1]:
        before, now = now, common.written(stage(spark, now, DATA), "test-stage")
        assert now.columns == p.COLUMNS
        if name == "quality_rules":
            verdict = {r["doc_id"] for r in quality.judged(before).filter("kept").collect()}
            assert {r["doc_id"] for r in now.collect()} == verdict
        elif name == "line_dedup":
            rows = [(r["source"], r["text"]) for r in before.collect()]
            assert Counter(r["text"] for r in now.collect()) == Counter(brute_lines(rows, line_dedup.RATIO, line_dedup.MIN_PAGES))
        elif name == "near_dedup":
            ordered = before.orderBy("doc_id").collect()
            first = brute_classes([r["text"] for r in ordered])
            assert {r["doc_id"] for r in now.collect()} == {ordered[i]["doc_id"] for i in set(first)}
        else:
            assert not any(brute_spans(r["text"]) for r in now.collect()) and now.count() == before.count()
    pieces = p.STAGES[-1][1](spark, now, DATA)
    assert {r["doc_id"] for r in pieces.collect()} == {r["doc_id"] for r in now.collect()}


def test_line_dedup_sql(spark):
    import duckdb

    from veilspark.llm import queries as q

    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = Counter(map(tuple, c.sql("select doc_id, n_lines, n_dropped, n_chars, text_sha256 from (" + q.LINE_DEDUP_SQL + ")").fetchall()))
    assert Counter(map(tuple, q.op2_line_dedup(spark, DATA).collect())) == want
