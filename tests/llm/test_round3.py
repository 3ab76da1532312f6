"""Source audit, URL filter and periodic runs against brute force, with the edges that they define."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from veilspark.llm import queries, runs, source_audit, url_filter

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, runs string, host string, n int"
ODD = [None, "", " ", "\n\t", "a", "a\u00a0b a\u00a0b", "Ä" * 40, "x " * 3000, "wort " * 12 + "b " * 40, "A b1C d", "über ÜBER Über", "a b c " * 20]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, ties and repeated rows, extra columns with clashing names."""
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", None, "r", "h", None) for i, t in enumerate(ODD)]
    rows += [rows[-1]] * 3 + [(None, "null id", None, None, None, None, None, None), (9, "another A b1C", "de", "s", 1, None, None, None), (9, "", "de", "t", 1, None, None, None), (10, "alone", "fr", "only", 1, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


# --- 11: source audit -----------------------------------------------------------------------------------------------------


def brute_audit(rows, least):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        groups[lang, source].update(words)
        docs[lang].update(set(words))
    kept = {lang: sorted(t for t, n in c.items() if n >= least) for lang, c in docs.items()}
    total = {g: sum(c[t] for t in kept[g[0]]) for g, c in groups.items()}
    share = lambda n, d: 1 + 1_000_000_000 * (n + 1) // d
    out = []
    for (lang, source), mine in groups.items():
        v = len(kept[lang])
        pairs = []
        for (other_lang, other), theirs in groups.items():
            if other_lang == lang and other != source:
                f = lambda t: (share(mine[t], total[lang, source] + v), share(theirs[t], total[lang, other] + v))  # noqa: B023, E731
                pairs.append((-sum((p - q) ** 2 // q for p, q in map(f, kept[lang])), other.encode()))
        of_lang = sum(n for g, n in total.items() if g[0] == lang)
        terms = []
        for t in kept[lang]:
            p, q = share(mine[t], total[lang, source] + v), share(sum(c[t] for g, c in groups.items() if g[0] == lang), of_lang + v)
            if mine[t] and p > q:
                terms.append((-((p - q) ** 2 // q), t.encode()))
        out += [(lang, source, "pair", i.decode(), -f, r + 1) for r, (f, i) in enumerate(sorted(pairs))]
        out += [(lang, source, "term", i.decode(), -f, r + 1) for r, (f, i) in enumerate(sorted(terms)[:200])]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_audit(spark, documents, odd, small, monkeypatch):
    """Against plain counting; with tiny chunks, blocks and parts as with large ones."""
    if small:
        monkeypatch.setattr(source_audit, "BLOCK_ENTRIES", 40)
        monkeypatch.setattr(source_audit, "OUTPUT_ROWS", 3)
    for df, least in ((documents.limit(60), 3), (odd, 2), (odd, 50)):
        rows = [(r["text"], r["lang"], r["source"]) for r in df.collect()]
        if small and df is not odd:
            continue
        assert sorted(map(tuple, source_audit.audit(spark.createDataFrame(df.collect(), df.schema), min_docs=least).collect())) == brute_audit(rows, least)
    assert source_audit.audit(odd.limit(0)).count() == 0


def test_digests_and_groups():
    rng = random.Random(1)
    words = [bytes(rng.choice(b"abc\xc3") for _ in range(rng.randint(1, 70))) for _ in range(2000)] + [b"ab"] * 50
    low, lengths = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
    starts = np.cumsum(lengths) - lengths
    assert source_audit.digests(low, starts, lengths).tolist() == [xxhash.xxh64_intdigest(w) for w in words]
    for hashed in (source_audit.digests, lambda low, starts, lengths: (lengths % 3).astype(np.uint64)):  # all collide: bytes decide
        group, first = source_audit.grouped(low, starts, starts + lengths, hashed)
        known = {}
        assert all(known.setdefault(w, g) == g for w, g in zip(words, group.tolist())) and len(set(known.values())) == len(known) == len(first)


def test_shares_are_exact_for_large_counts():
    n, total = np.array([0, 7, 10**15 - 1, 9 * 10**15 - 1]), np.array([9 * 10**15] * 4)
    assert source_audit._shares(n, total).tolist() == [1 + 10**9 * (int(x) + 1) // (9 * 10**15) for x in n]


# --- 12: URL filter -------------------------------------------------------------------------------------------------------------

URLS = [
    None, "", "no scheme", "http://", "http://com/", "http://COM", "http://a.com?x=1", "https://Www.Example.COM/en/x?q#f", "https://www.example.com/EN/", "http://example.com/en/", "http://sub.example.com/en/1", "http://example.com/en", "http://notexample.com/en/",
    "x://b.net/es/", "x://b.net/fr/é?u=http://c.net/es/", "x://b.net/de/", "x://bnet/es/", "x://b.net#/es/", "a://b://c.com/", "http://user@h.com:80/", "http://h.com:80/", "http://" + "a." * 300 + "org/" + "p/" * 500,
]


def brute_host(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", rest).groups()
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def test_rules(spark):
    rules = spark.createDataFrame(queries.URL_RULES, url_filter.RULES)
    urls = spark.createDataFrame([(i, u, "clash", "clash", None, "x") for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, host string, rule string, score double, extra string")
    labelled = spark.createDataFrame([], "url string, blocked boolean")
    out = url_filter.judge(urls, rules, labelled)
    assert out.columns == ["page_id", "url", "extra", "host", "path", "rule", "verdict", "score"]
    rows = {r["page_id"]: r for r in out.collect()}
    assert len(rows) == len(URLS) + 3
    for i, url in enumerate(URLS + URLS[:3]):
        host, path = brute_host(url)
        fits = [(len(h + p), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, "allow")
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"], rows[i]["verdict"]) == (host, path, rule, verdict), url
    assert url_filter.judge(urls.limit(0), rules, labelled).count() == 0
    assert {r["verdict"] for r in url_filter.judge(urls, rules.limit(0), spark.createDataFrame([("http://a.b/", True)], "url string, blocked boolean")).collect()} == {"block"}


def test_trees_on_urls_that_they_have_not_seen(spark):
    model = url_filter.train(spark, url_filter.with_host(url_filter.labelled_samples(spark)))
    rows = lambda urls: model.score(url_filter.with_features(url_filter.with_host(urls)))
    held = rows(url_filter.labelled_samples(spark, 1000, salt=99)).select("blocked", (F.col("score") >= 0.5).alias("told")).collect()
    assert sum(r["blocked"] == r["told"] for r in held) >= 0.97 * len(held)
    pages = rows(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).select("host", "score").collect()
    spam = re.compile("spam-farm|adult-x|cheap-pills|ads-track|casino-win|free-bets")
    assert all((r["score"] >= 0.5) == bool(spam.search(r["host"])) for r in pages)


# --- 13: periodic runs ----------------------------------------------------------------------------------------------------------


def brute_runs(w, least=12):
    found = {}
    for p in range(1, len(w) // 2 + 1):
        s = 0
        while s + p < len(w):
            e = s + p
            while e < len(w) and w[e] == w[e - p]:
                e += 1
            if e - s >= max(least, 2 * p) and (s == 0 or w[s - 1] != w[s - 1 + p]):
                found.setdefault((s, e), p)
            s = max(s + 1, e - p)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def drawn(rng):
    w = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 50))]
    return w[: rng.randint(0, len(w))] + w[: rng.randint(0, 9)] * rng.randint(1, 9) + w[:5] if rng.random() < 0.6 else w


@pytest.mark.parametrize("weak", [False, True])
def test_runs(weak, monkeypatch):
    """All runs of texts worked on together; with hashes that nearly always agree, too."""
    if weak:
        monkeypatch.setattr(runs, "_values", lambda ids: (ids % 2).astype(np.uint64))
    monkeypatch.setattr(runs, "BLOCK_PAIRS", 50)
    rng = random.Random(2)
    for _ in range(150):
        texts, least = [drawn(rng) for _ in range(rng.randint(1, 5))], rng.choice([2, 4, 12])
        ends = np.cumsum([len(t) for t in texts])
        got = runs.find_runs(np.array([x for t in texts for x in t], np.int64), ends - np.array([len(t) for t in texts]), ends, least)
        assert [[tuple(r[1:]) for r in got.tolist() if r[0] == i] for i in range(len(texts))] == [brute_runs(t, least) for t in texts]


def test_detect(spark, odd):
    out = runs.detect(odd)
    assert out.columns == [c for c in odd.columns if c != "runs"] + ["runs", "collapsed"]
    rows = out.collect()
    assert len(rows) == odd.count()
    for r in rows:
        words = [x.decode() for x in (r["text"] or "").encode().split()]
        want = brute_runs(words)
        assert [tuple(x) for x in r["runs"]] == want
        gone = {i for s, n, p in want for i in range(s + p, s + n)}
        assert r["collapsed"] == (None if r["text"] is None else " ".join(w for i, w in enumerate(words) if i not in gone))
    assert runs.detect(odd.limit(0)).count() == 0


def test_query_makes_texts_periodic(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(rng.randint(0, 80)))) for i in range(120)] + [(200, None), (None, "x " * 30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    for i, text in rows:
        words = (text or "").split()
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
        want = brute_runs(words)
        best = min(want, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        gone = {j for s, n, p in want for j in range(s + p, s + n)}
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        r = got[i]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(want), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if want else None)
        assert r["runs_sha256"] == sha("".join(f"{s},{n},{p}\n" for s, n, p in want)) and r["collapsed_sha256"] == sha(" ".join(w for j, w in enumerate(words) if j not in gone))
