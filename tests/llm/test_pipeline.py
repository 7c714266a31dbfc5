"""The corpus pipeline against plain versions of its stages, each judged on its own input."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from beamgrid.llm import repetition

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(d / str(k)))
        docs = spark.read.parquet(str(d / str(k)))
        out.append(docs)
    return out


def _rows(df):
    return [(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()]


def test_columns(tables):
    assert all(t.columns == tables[0].columns for t in tables[1:-1])
    assert tables[-1].columns == [*tables[0].columns, "size", "shard", "slot"]


def test_quality_rules(tables):
    limits = repetition.Limits()

    def passes(x):
        w = WORD.findall(x or "")
        chars = max(1, sum(map(len, w)))
        for n, limit in limits.ngrams.items():
            c = Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
            inside = {j for k in range(len(w) - n + 1) if c[tuple(w[k : k + n])] > 1 for j in range(k, k + n)}
            if n == 5 and 100 * len(inside) > 20 * len(w) or sum(len(w[j]) for j in inside) > limit * chars:
                return False
        seen, dup = set(), 0
        for line in (x or "").split("\n"):
            if WORD.search(line):
                dup += (line in seen) * sum(map(len, WORD.findall(line)))
                seen.add(line)
        return len(w) >= 10 and dup <= limits.line_chars * chars

    assert Counter(_rows(tables[1])) == Counter(r for r in _rows(tables[0]) if passes(r[1]))


def test_near_duplicates(tables):
    def shingles(x):
        w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), x or ""))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    rows = sorted(_rows(tables[1]))
    sets, root = [shingles(x) for _, x, _ in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = i, j
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                root[max(a, b)] = min(a, b)
    assert Counter(_rows(tables[2])) == Counter(r for k, r in enumerate(rows) if root[k] == k)


def test_clashing_columns(tables, spark):
    """Extra columns named as stages name theirs keep their values."""
    names = ["row", "nth", "copies", "number", "own0", "_id", "_row", "_words", "m", "node", "best", "rank", "x", "repetition", "found", "taken"]
    docs = tables[0].limit(60).select("*", *[F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in names]).cache()
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns[: len(docs.columns)] == docs.columns
        assert out.where(" or ".join(f"{c} <> concat('{c} ', doc_id)" for c in names)).count() == 0 and out.count() > 0


def test_decontamination(tables, spark):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda x: word.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), x or ""))
    grams = set()
    for (x,) in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect():
        w = words(x)
        n = min(13, len(w))
        grams |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()

    def clean(x):
        w = words(x)
        hit = {j for n in {len(g) for g in grams} for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in grams for j in range(k, k + n)}
        return not hit or 20 * len(hit) < len(w)

    assert Counter(_rows(tables[3])) == Counter(r for r in _rows(tables[2]) if clean(r[1]))


def test_mixing(tables):
    before, after = _rows(tables[3]), _rows(tables[4])
    times = Counter(after)
    assert set(times) <= set(before) and all(n <= 2 * Counter(before)[r] for r, n in times.items())
    size, taken, longest = Counter(), Counter(), Counter()
    for i, x, s in before:
        n = len(WORD.findall(x))
        size[s] += n
        longest[s] = max(longest[s], n)
        taken[s] += n * times[i, x, s] // max(1, Counter(before)[i, x, s])
    names = sorted(s for s in size if s is not None) + [None] * (None in size)
    weight, total, capped = {s: corpus_pipeline.WEIGHTS[k % 3] for k, s in enumerate(names)}, 1.5 * sum(size.values()), set()
    while True:
        rest, open_ = total - sum(2 * size[s] for s in capped), sum(weight[s] for s in names if s not in capped)
        target = {s: 2 * size[s] if s in capped else rest * weight[s] / open_ for s in names}
        over = {s for s in names if s not in capped and target[s] > 2 * size[s]}
        if not over:
            break
        capped |= over
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in names)


def test_sharding(tables):
    assert Counter(_rows(tables[5])) == Counter(_rows(tables[4]))
    for r in tables[5].groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("d"), F.max("slot").alias("m"), F.min("slot").alias("l")).collect():
        assert (r.n, r.l, r.m) == (r.d, 0, r.n - 1) and 0 <= r.shard < corpus_pipeline.SHARDS


def test_run(tables, spark):
    assert Counter(_rows(corpus_pipeline.run(spark, SF))) == Counter(_rows(tables[5]))


def test_stages_of_nothing(tables, spark):
    docs = tables[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_stages_of_texts_use_small_batches(spark, monkeypatch):
    """Such a stage runs when its result is written; after the pipeline, or a failure in it, the session's setting is as before."""
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(name)

    def fails(spark, docs, sf_dir):
        seen.append(spark.conf.get(name))
        raise ValueError("stop")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [corpus_pipeline.STAGES[0], ("fails", fails)])
    with pytest.raises(ValueError, match="stop"):
        corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert seen == [str(corpus_pipeline._stage.TEXTS_AT_ONCE)] and spark.conf.get(name) == before
