"""Line quality, hard negatives and lexical search against brute force and held-out labels."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sitesift.llm import lexical, linequality, negatives

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"


def parquet(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


# ---- line quality

def every_path(unary, turns):
    """Chances of "good" by going through all labelings."""
    n = len(unary)
    total, good = 0.0, np.zeros(n)
    for code in range(1 << n):
        y = [code >> i & 1 for i in range(n)]
        w = math.exp(sum(u for u, v in zip(unary, y) if v) + sum(turns[a, b] for a, b in zip(y, y[1:])))
        total += w
        good += w * np.array(y)
    return good / total


def test_forward_backward_equals_all_paths():
    r = np.random.default_rng(3)
    lengths = np.array([1, 5, 3, 8, 1, 2])
    unary, turns = r.normal(size=lengths.sum()) * 2, r.normal(size=(2, 2))
    chains = linequality.Chains(lengths)
    own = np.empty(len(unary))
    own[chains.at] = unary
    ahead, behind = chains.forward_backward(own, turns)
    got = linequality.chance(ahead + behind)[chains.at]
    want = np.concatenate([every_path(u, turns) for u in np.split(unary, np.cumsum(lengths)[:-1])])
    assert np.allclose(got, want, atol=1e-12)


def test_gradient_equals_differences():
    r = np.random.default_rng(4)
    lengths = np.array([4, 1, 3])
    x, labels = r.normal(size=(8, 3)), np.array([1.0, 0.0, 1.0])
    chains = linequality.Chains(lengths)
    rows = np.empty_like(x)
    rows[chains.at] = x
    label, share = np.empty(8), np.full(8, 1.0)
    label[chains.at] = np.repeat(labels, lengths)

    def likelihood(point):
        total = 0.0
        for text, y in zip(np.split(x, np.cumsum(lengths)[:-1]), labels):
            unary, turns = text @ point[:3], point[3:].reshape(2, 2)
            n, every = len(text), 0.0
            path = lambda ys: sum(u for u, v in zip(unary, ys) if v) + sum(turns[a, b] for a, b in zip(ys, ys[1:]))
            for code in range(1 << n):
                every += math.exp(path([code >> i & 1 for i in range(n)]))
            total += path([int(y)] * n) - math.log(every)
        return total

    point = r.normal(size=7)
    by_weight, by_turn = linequality.gradient((point[:3], point[3:].reshape(2, 2)), rows, chains, label, share)
    got = np.concatenate([by_weight, by_turn.ravel()])
    for i in range(7):
        step = np.eye(7)[i] * 1e-5
        assert abs((likelihood(point + step) - likelihood(point - step)) / 2e-5 - got[i]) < 1e-5


def test_held_out_accuracy(spark):
    docs, labels = parquet(spark, MIDDLE, "documents"), parquet(spark, MIDDLE, "labels")
    rows = linequality.quality_scores(docs, labels).collect()
    known = {r.doc_id: r.quality for r in labels.collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [(r.predicted, known[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in known]
    assert len(held) > 50 and np.mean([p == y for p, y, _ in held]) >= 0.97
    good, bad = [s for _, y, s in held if y], [s for _, y, s in held if not y]
    assert np.mean([a > b for a in good for b in bad]) >= 0.99
    # labels of held-out rows change nothing, nor do languages and sources
    turned = labels.withColumn("quality", F.when(linequality.remainder("doc_id") == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = linequality.quality_scores(docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit(None)), turned).collect()
    assert {(r.doc_id, r.score) for r in again} == {(r.doc_id, r.score) for r in rows}


def test_line_quality_odd_tables(spark, odd, empty):
    labels = parquet(spark, MIDDLE, "labels").limit(0)
    scores = linequality.quality_scores(odd, labels).collect()
    assert len(scores) == odd.count() and {r.score for r in scores} == {0.5}
    some = spark.createDataFrame([(5, 0), (5, 1), (9, 1), (10, 1), (16, 0), (None, 1), (11, None), (12, 7)], "doc_id bigint, quality int")
    scores = linequality.quality_scores(odd, some)
    assert scores.count() == odd.count() and scores.where("score IS NULL OR isnan(score)").count() == 0
    assert linequality.quality_scores(empty, some).count() == 0
    model = linequality.fit(odd, some)
    lines = linequality.label_lines(odd, model)
    want = Counter((r.doc_id, i) for r in odd.collect() for i in range((r.text or "").count("\n") + 1))
    assert Counter((r.doc.doc_id, r.line) for r in lines.collect()) == want


def test_fit_is_bounded(spark):
    docs, labels = parquet(spark, SMALL, "documents"), parquet(spark, SMALL, "labels")
    whole = linequality.fit(docs, labels)
    assert not np.array_equal(whole.weights, linequality.fit(docs, labels, sample=20).weights)
    assert not np.array_equal(whole.weights, linequality.fit(docs, labels, lines=60).weights)
    assert np.array_equal(whole.weights, linequality.fit(docs.repartition(3), labels.repartition(5)).weights)


# ---- hard negatives

def mined(rows, c=negatives.DEFAULT):
    own = {}
    for i, x, label in rows:
        if i is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        moved = (label + 1) % c.labels if i % c.moved_step == 0 else label
        if i not in own or (label, x) < own[i][2]:
            own[i] = (moved, [math.floor(256 * float(v)) for v in x], (label, x))
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    out = set()
    for a in (i for i in own if i % c.anchor_step == 0):
        near = [(-dot(own[a][1], own[b][1]), b, own[b][0] == own[a][0]) for b in own if b != a]
        near.sort()
        for ps, p, _ in [n for n in near if n[2]][: c.positives]:
            ps = -ps
            fit = [(-s, b) for s, b, alike in near if not alike and c.low * ps <= -100 * s <= c.high * ps]
            out |= {(a, p, k + 1, b, ps, s) for k, (s, b) in enumerate(fit[: c.negatives])}
    return out


def test_negatives_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROW_TILE", 90)
    monkeypatch.setattr(negatives, "ANCHOR_TILE", 2)
    r = random.Random(2)
    same = [0.25] * 9
    rows = [(i, [r.gauss(0, 1) for _ in range(9)], r.randrange(3)) for i in range(-300, 300)]
    rows += [(1000 + i, same, i % 3) for i in range(120)] + [(1200 + i, [0.0] * 9, i % 2) for i in range(0, 40)]
    rows += [(2000, [1.0, 2.0], 1), (2001, [1.0], 2), (2100, [], 0), (2002, [], 1), (7, [9.0] * 9, 0), (7, [8.0] * 9, 0), (3, None, 1),
             (2003, [1.0, None], 1), (2004, [float("nan")], 1), (2005, [float("inf")], 1), (2006, [1.0], None), (None, [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("score", F.lit("x")).withColumn("rank", F.lit(1))
    single = [(i, None if x is None else [None if v is None else float(np.float32(v)) for v in x], label) for i, x, label in rows]
    got = [tuple(x) for x in negatives.hard_negatives(df).collect()]
    assert len(got) == len(set(got)) and set(got) == mined(single)
    assert negatives.hard_negatives(df.limit(0)).count() == 0


@pytest.mark.parametrize("dimensions", [1, 9, 64, 100])
def test_intervals_hold_every_score(dimensions):
    r = np.random.default_rng(dimensions)
    vectors = np.concatenate([r.normal(0, 60, (400, dimensions)), np.zeros((1, dimensions)),
                              np.full((1, dimensions), negatives.limit(dimensions))]).astype("<i4")
    codes, alignment, rest = negatives.coded(vectors)
    table = pa.table({
        "vec_id": np.arange(len(vectors)), "label": np.zeros(len(vectors), np.int64), "vector": [v.tobytes() for v in vectors],
        "code": [c.tobytes() for c in codes], "alignment": alignment, "rest": rest})
    tile = negatives.Tile(table, dimensions)
    for anchor in vectors.astype(np.int64):
        low, high = tile.intervals(anchor)
        scores = tile.vectors @ anchor
        assert (low <= scores).all() and (scores <= high).all()


def test_intervals_pass_rows_over():
    r = np.random.default_rng(0)
    vectors = np.concatenate([r.normal(0, 20, (3000, 64)), r.normal(0, 20, (1, 64)) * 6]).astype("<i4")
    codes, alignment, rest = negatives.coded(vectors)
    table = pa.table({"vec_id": np.arange(3001), "label": np.zeros(3001, np.int64), "vector": [v.tobytes() for v in vectors],
                      "code": [c.tobytes() for c in codes], "alignment": alignment, "rest": rest})
    tile = negatives.Tile(table, 64)
    anchor = vectors[-1].astype(np.int64)
    low, high = tile.intervals(anchor)
    assert (high < anchor @ anchor).mean() > 0.9  # rows that cannot beat a copy of the anchor are known without their vectors


# ---- lexical search

def ranked(documents, items, many=50):
    own = [(i, Counter(lexical.terms(t))) for i, t in documents if lexical.terms(t)]
    n, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(lexical.terms(t))
    out = []
    for item, words in asked.items():
        scores = []
        for i, c in own:
            m = 50 + (50 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in words & c.keys())
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scores)[:many])]
    return sorted(out, key=repr)


def test_terms():
    assert lexical.terms("AbC-1_2 Ünï\x7f`z@[{~É") == [t.encode() for t in ("abc", "1", "2", "Ünï", "z", "É")]
    assert lexical.terms(None) == lexical.terms("") == lexical.terms(" -- ") == []


@pytest.mark.parametrize("shard, block, most", [(8192, 64, 100_000), (40, 4, 300)])
def test_search_against_brute_force(spark, odd, empty, monkeypatch, shard, block, most):
    monkeypatch.setattr(lexical, "SHARD", shard)
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical.query_blocks, "__defaults__", (most,))
    items = [(1, "a b c d e"), (1, "one"), (2, None), (3, ""), (None, "a"), (4, "changed key"), (5, "ß漢字 é"), (6, "y x x")]
    items = spark.createDataFrame(items, "item_id bigint, text string").union(
        parquet(spark, SMALL, "benchmark").selectExpr("item_id + 100", "text")).withColumn("rank", F.lit("r"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "30")
    for docs in (odd, parquet(spark, SMALL, "documents").select("doc_id", "text").union(
            spark.createDataFrame([(5000 + i, "one a key b") for i in range(150)] + [(-3, "one a key b")], "doc_id bigint, text string")).repartition(3)):
        texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        rows = lexical.search(docs, items).collect()
        asked = [(r.item_id, r.text) for r in items.collect()]
        assert rows and sorted([tuple(r) for r in rows], key=repr) == ranked(texts, asked)
    assert lexical.search(empty, items).count() == 0 and lexical.search(odd, items.limit(0)).count() == 0


def test_blocks_are_passed_over():
    """Similar documents share blocks, and blocks whose bound fails are not scored."""
    r = np.random.default_rng(6)
    size, docs = 40, 2000
    held = [np.sort(r.choice(np.arange(8 * (i % 4), 8 * (i % 4) + 12), 6, replace=False)) for i in range(docs)]
    starts = np.arange(docs + 1) * 6
    impacts = r.integers(1000, 2000, 6 * docs)
    shard = lexical.Shard(starts, np.concatenate(held), impacts, [np.arange(size)] * size)
    scored = []
    plain = shard.scores
    shard.scores = lambda rows, weight: scored.append(len(rows)) or plain(rows, weight)
    weight = np.zeros(size, np.int64)
    asked = np.array([0, 1, 2, 3, 4, 30, 31])
    weight[asked] = [9, 5, 8, 7, 6, 5, 4]
    rows, scores = shard.search(asked, weight, 5, 1)
    every = plain(np.arange(docs), weight)
    assert sorted(scores.tolist())[-5:] == sorted(every.tolist())[-5:] and sum(scored) < docs / 2
    spans = shard.opened(0)
    assert spans.ends[-1] == len(spans.rows) == len(np.unique(spans.rows))


def test_units_are_cut_in_small_portions():
    """The words and ids of a portion are objects: before, a million characters were cut at once."""
    from sitesift.llm.units import Units

    most = []
    units = Units(lambda parts: most.append(sum(map(len, parts))) or [p.encode("utf-32-le") for p in parts])
    texts = [" ".join(f"w{i * 97 + j}" for j in range(900)) for i in range(120)]
    found = units.ids(texts)
    assert found == [t.encode("utf-32-le") for t in texts]
    assert max(most) <= 300_000


def test_words_are_encoded_once_beside_marks_and_line_feeds():
    """Before, a word with marks or a line feed beside it went to the encoder as a unit of its own."""
    from sitesift.llm.units import Units

    seen = []
    units = Units(lambda parts: seen.extend(parts) or [p.encode("utf-32-le") for p in parts])
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("one", "zwö", "trois")]
    texts = [" ".join(f"x {w}. {w}\n{w}, {w}###\n{w}" for w in words), None, "", " x\n", "a\0b c", "a  b\n\nc .d\t\n"]
    assert units.ids(texts) == [(t or "").encode("utf-32-le") for t in texts]
    assert units.ids(texts) == [(t or "").encode("utf-32-le") for t in texts]
    assert len(seen) <= 2 * len(words) + 30


def test_byte_bpe_encodes_a_text_once(spark):
    """Before, the ids and their decoding each had an encoding of their own."""
    import public_tokenizers

    from sitesift.llm import bpe

    df = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id bigint, text string")
    plan = bpe.bpe_digest(df, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)._jdf.queryExecution().executedPlan().toString()
    assert "pythonUDF0" in plan and "pythonUDF1" not in plan
