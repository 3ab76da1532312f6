"""The exact step of near-duplicate search: pairs by the rarest shingles."""

import itertools
import random

from veilspark.llm import near_dedup


def test_rarest_shingles_find_all_alike_and_no_crowd(spark):
    rng, docs = random.Random(7), {}
    crowd = [rng.getrandbits(60) for _ in range(60)]  # in every document of a crowd, which are of 40 shingles of their own
    for i in range(300):
        docs[i] = (i, crowd + [rng.getrandbits(60) for _ in range(40)])
    base = [rng.getrandbits(60) for _ in range(100)]
    for i in range(300, 360):  # around the threshold, of different lengths, some of one class
        kept = rng.sample(base, rng.randint(70, 100))
        docs[i] = (300 + i % 30, kept + [rng.getrandbits(60) for _ in range(rng.randint(0, 25))])
    rows = [(k, row, c, len(keys)) for row, (c, keys) in docs.items() for k in keys]
    labels = spark.createDataFrame(rows, "key long, row long, class long, n long")
    found = {(r["a"], r["b"]) for r in near_dedup._pairs_by_key(near_dedup._rarest(labels)).collect()}
    alike = {(b, a) for a, b in itertools.combinations(sorted(docs), 2) if docs[a][0] != docs[b][0] and len(set(docs[a][1]) & set(docs[b][1])) >= 0.8 * max(len(docs[a][1]), len(docs[b][1])) - 1e-9}
    assert len(alike) > 100 and alike <= found
    assert all(b >= 300 for _, b in found)  # no two of the crowd
