"""The corpus pipeline, stage by stage and whole, against brute force."""

import random

import numpy as np
import pytest

from graphloom.llm import quality
from tests.llm.test_operators import brute_repeats, classes_of

PROSE = [f"word{i}" for i in range(600)]


def grams(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    import string

    rng = random.Random(31)
    prose = lambda n: " ".join(rng.choice(PROSE) for _ in range(n))
    docs, labels = [], []
    items = [(k, prose(40)) for k in range(6)]
    passages = [prose(30) for _ in range(3)]
    for i in range(160):
        docs.append((i, prose(rng.randrange(30, 160))))
    docs += [(200 + k, docs[k][1]) for k in range(12)]  # exact copies
    docs += [(300 + k, docs[k][1] + " and more") for k in range(20, 32)]  # near copies
    docs += [(400 + k, prose(50) + " " + passages[k % 3] + " " + prose(50)) for k in range(12)]
    docs += [(500 + k, prose(30) + " " + items[k % 6][1] + " " + prose(30)) for k in range(8)]
    docs += [(600 + k, "".join(rng.choice(string.punctuation + "$$!!") for _ in range(300))) for k in range(60)]  # junk
    docs += [(3, prose(60)), (None, prose(60)), (None, prose(70)), (None, docs[40][1]), (700, None), (701, "")]
    for i, t in docs:
        if i is not None and i < 700:
            labels.append((i, 0 if 600 <= i < 700 else 1, 0))
    rows = [(i, t, "en", ["hot", "hot", "b", None][k % 4], len(t or ""), "x") for k, (i, t) in enumerate(docs)]
    at = str(tmp_path_factory.mktemp("corpus"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, dict(items)


def rows_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=str)


def test_stages(spark, corpus, tmp_path):
    import corpus_pipeline

    at, items = corpus
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns, steps = docs.columns, dict(corpus_pipeline.STAGES)

    def step(name, docs):
        out = steps[name](spark, docs, at)
        out.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    # Classifier: junk goes, prose stays; rows are those that its own model accepts.
    model = quality.train(docs, spark.read.parquet(f"{at}/labels.parquet"))
    want = [x for x in rows_of(docs) if model.score(np.array([quality.features((x[1] or "").encode())]))[0] >= 0.5]
    good = step("quality classifier", docs)
    assert rows_of(good) == want and good.columns == columns
    assert not any(i is not None and 600 <= i < 700 for i, _ in want) and len(want) >= 200

    # Near copies: one row of each class stays, the first by id, nulls last.
    have = rows_of(good)
    n, sets = range(len(have)), [grams(t) for _, t in have]
    root = classes_of([(a, b) for a in n for b in range(a) if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9], n)
    groups = {}
    for k in n:
        groups.setdefault(root[k], []).append((have[k][0] is None, have[k][0] or 0, have[k]))
    single = step("SimHash near-dedup", good)
    got = rows_of(single)
    assert len(got) == len(groups) and single.columns == columns
    assert {i for i, _ in got if i is not None} == {min(g)[1] for g in groups.values() if not min(g)[0]}
    assert set(got) <= set(have)

    # Repeats, judged on this stage's own input; nothing else of a text changes.
    from hashlib import sha256

    order = sorted(set(got), key=lambda x: (x[0] is None, x[0] or 0, sha256((x[1] or "").encode()).hexdigest()))
    rest = brute_repeats(list(enumerate(t for _, t in order)), 100)
    want = sorted(((i, rest[k].decode()) for k, (i, t) in enumerate(order) if rest[k].strip() or rest[k] == (t or "").encode()), key=str)
    cut = step("suffix-array dedup", single)
    assert rows_of(cut) == want and cut.columns == columns
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())

    # Benchmark items: documents that hold one go.
    benchmark = [grams(t) for t in items.values()]
    want = [x for x in rows_of(cut) if not any(len(b & grams(x[1])) >= 0.8 * len(b) for b in benchmark)]
    clean = step("benchmark decontamination", cut)
    assert rows_of(clean) == want and len(want) < cut.count() and clean.columns == columns

    mixed = step("mixing sources to target weights", clean).collect()
    assert len(mixed) == len(want) and all(0 <= r["taken"] <= 3 * r["size"] for r in mixed)
    by = {}
    for r in mixed:
        by.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    assert all(abs(t - x) <= 1 for t, x in by.values())
    whole = corpus_pipeline.run(spark, at).collect()
    assert sorted(map(str, whole)) == sorted(map(str, mixed))


def test_stages_of_empty_tables(spark, corpus):
    import corpus_pipeline

    at, _ = corpus
    docs = spark.read.parquet(f"{at}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, at).count() == 0
