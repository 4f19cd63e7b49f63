"""Operators that relate rows: conversations, shards, near-duplicates, passages, components, and the pipeline."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitesift.llm import chat, neardup, passages, shards
from sitesift.llm.shared import components, known_to, unknown_to

from .conftest import texts_of

SMALL = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def union_find(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    r = random.Random(4)
    pairs = {"chain": [(i, i + 1) for i in range(40)], "star": [(0, i) for i in range(1, 60)], "none": [],
             "random": [(r.randrange(80), r.randrange(80)) for _ in range(60)]}[shape]
    rows = components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()
    want = union_find([(a, b) for a, b in pairs if a != b])
    assert {(x.id, x.root) for x in rows} == set(want.items()) and len(rows) == len(want)


def test_bitmap_joins(spark, odd):
    ids = spark.createDataFrame([(3,), (6,), (99,)], "id bigint")
    assert sorted(r.doc_id for r in known_to(odd, "doc_id", ids).collect()) == [3, 6, 6]
    rest = unknown_to(odd, "doc_id", ids)
    assert rest.count() == odd.count() - 3 and rest.columns == odd.columns


def test_escapes_come_back(spark):
    r = random.Random(9)
    bits = ["\\", "<", "[", "|", "<|", "</s>", "<s>", "[INST]", "[/INST]", "<|im_end|>\n", "x", "\n", "<\\|", "é"]
    rows = [("".join(r.choice(bits) for _ in range(r.randint(0, 12))),) for _ in range(3000)]
    df = spark.createDataFrame(rows, "t string").withColumn("e", chat.escape(F.col("t"))).withColumn("u", chat.unescape(F.col("e")))
    for x in df.collect():
        assert x.t == x.u
        assert not any(mark in x.e for mark in ("<|", "</s>", "<s>", "[INST]", "[/INST]"))


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_conversations(spark):
    special = [(None, 0, "user", "hi"), (None, 1, "assistant", None), (5, 3, "assistant", "\\<|x"), (5, 3, "assistant", "\\<|x"),
               (5, None, None, ""), (6, 0, "assistant", "</s>[INST] ok [/INST]"), (8, 2, "<|im_start|>", "a\\"), (8, 1, "user", "b")]
    special += [(9, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(70)]
    special = spark.createDataFrame(special, "conv_id bigint, turn bigint, role string, text string")
    for df in (special, spark.read.parquet(f"{SMALL}/conversations.parquet"), special.limit(0)):
        turns = defaultdict(list)
        for r in df.collect():
            turns[r.conv_id].append((-1 if r.turn is None else r.turn, r.role or "", r.text or ""))
        rows = {r.conv_id: r for r in chat.conversation_digest(df).collect()}
        assert set(rows) == set(turns)
        for conv, said in turns.items():
            said.sort()
            r, loss = rows[conv], "".join(t for _, role, t in said if role == "assistant")
            assert r.turns_sha256 == digest("".join(f"{role}\n{t}\n" for _, role, t in said))
            assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(said), len(loss), digest(loss))


def test_branches_and_cycles(spark):
    rows = [(1, 1, None, 1.0), (1, 2, 1, 5.0), (1, 3, 1, 2.0), (1, 4, 3, 9.0), (1, 5, 2, None), (1, 6, 77, 3.0),
            (1, 7, 8, 50.0), (1, 8, 7, 50.0), (1, 9, 8, 99.0), (2, 1, None, None)]
    tree = spark.createDataFrame(rows, "conv_id bigint, msg_id bigint, parent_id bigint, score double")
    found = defaultdict(list)
    for r in chat.chosen_paths(tree).collect():
        found[r.conv_id, r["rank"]].append((r.place, r.msg_id))
    paths = {k: [m for _, m in sorted(v)] for k, v in found.items()}
    assert paths == {(1, 1): [1, 3, 4], (1, 2): [1, 2, 5], (1, 3): [6], (2, 1): [1]}
    best = chat.chosen_paths(tree, branches=1).collect()
    assert {r.leaf for r in best} == {4, 1}


def least_maximum(sizes, k):
    best = {0: 0}
    total = np.concatenate([[0], np.cumsum(sizes)])
    row = [total[i] for i in range(len(sizes) + 1)]
    for _ in range(k - 1):
        row = [0] + [min(max(row[j], total[i] - total[j]) for j in range(i)) if i else 0 for i in range(1, len(sizes) + 1)]
    return row[len(sizes)] if best else 0


@pytest.mark.parametrize("count, k", [(1, 4), (5, 16), (300, 7), (2000, 16)])
def test_minimax(spark, count, k, monkeypatch):
    monkeypatch.setattr(shards, "FIRST_BITS", 4)  # so that refinement is needed
    monkeypatch.setattr(shards, "FINER_BITS", 3)
    r = random.Random(count)
    groups = sorted({r.randrange(-2**63, 2**63): r.choice([1, 5, 40, r.randrange(1, 3000)]) for _ in range(count)}.items())
    edges = shards.minimax_cuts(spark.createDataFrame(groups, "key bigint, size bigint"), k)
    loads = Counter()
    for key, size in groups:
        loads[sum(key >= e for e in edges)] += size
    assert len(edges) < k
    if count <= 300:
        assert max(loads.values()) == least_maximum([s for _, s in groups], k)
    else:
        assert max(loads.values()) <= sum(s for _, s in groups) / k + max(s for _, s in groups)


def test_shards(spark, odd, empty):
    for df in (documents(spark), odd):
        rows = shards.shard(df).collect()
        assert len(rows) == df.count()
        by_shard, size_of = defaultdict(list), {i: t or "" for i, t in texts_of(df)}
        shard_of = {}
        for r in rows:
            by_shard[r.shard].append(r.slot)
            if r.doc_id is not None:
                text = size_of[r.doc_id]
                assert (r.size, r.text_crc32) == (len(text.encode()) + 1, zlib.crc32(text.encode()))
                assert shard_of.setdefault(text, r.shard) == r.shard
            assert 0 <= r.shard < 16 and r.law == "bytes" and r.grown_shard is None
        assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert shards.shard(empty).count() == 0


def shingles(text, size=5):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def near_by_hand(texts, share):
    sets = {i: shingles(t) for i, t in texts}
    held = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            held[g].append(i)
    common = Counter((a, b) for l in held.values() for a in l for b in l if a < b)
    links = [(a, b) for (a, b), c in common.items() if 100 * c >= share * (len(sets[a]) + len(sets[b]) - c)]
    roots = union_find(links)
    return sets, {i: roots.get(i, i) for i in sets}


def test_near_duplicates(spark, odd, empty):
    for df in (documents(spark), odd):
        sets, roots = near_by_hand([(i, t) for i, t in texts_of(df) if i is not None], 85)
        rows = neardup.near_digest(df).collect()
        assert len(rows) == df.count()
        for r in rows:
            if r.doc_id is None:
                assert r.component_id is None and r.kept
            else:
                assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), roots[r.doc_id], roots[r.doc_id] == r.doc_id)
    assert neardup.near_digest(empty).count() == 0
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").select("doc_id").distinct().collect()) == sorted(
        i for i, root in roots.items() if i == root)


def test_crowd_of_near_copies(spark):
    """Hundreds of copies with few and many changes: crowded regions, found whole."""
    r = random.Random(1)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(400):
        words = list(base)
        for _ in range(r.randint(0, 8)):
            words[r.randrange(100)] = f"x{r.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    _, roots = near_by_hand(rows, 85)
    got = {r.doc_id: r.component_id for r in neardup.near_digest(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == roots


def test_bands_are_tuned():
    forest = passages.tuned(80, 0.99, 60)
    for rows, enough in ((forest.step, True), (forest.step + 1, False)):
        assert (1 - (1 - 0.8**rows) ** (60 // rows) >= 0.99) == enough


def test_passages(spark, odd, empty):
    for df in (documents(spark), odd):
        texts = [(i, t) for i, t in texts_of(df) if i is not None]
        held = defaultdict(set)
        for i, t in texts:
            words = (t or "").encode().lower().split()
            for k in range(len(words) - 50):
                held[tuple(words[k:k + 51])].add(i)
        want = set().union(*[v for v in held.values() if len(v) > 1])
        rows = passages.repeats(df).collect()
        assert want and want <= {r.doc_id for r in rows}
        words = {i: (t or "").encode().lower().split() for i, t in texts}
        for r in rows:  # what is reported repeats: 32 words for a passage, similar paragraphs
            mine = set(map(tuple, zip(*[words[r.doc_id][r.start + j:r.start + r.n_words] for j in range(5)])))
            others = [d for d in words if d != r.doc_id]
            assert r.removed == ((r.doc_id, r.start) != (r.kept_doc, r.kept_start))
            if r.kind == "passage":
                piece = words[r.doc_id][r.start:r.start + 32]
                assert any(piece == words[d][k:k + 32] for d in others for k in range(len(words[d]) - 31) if words[d][k] == piece[0])
            else:
                assert any(len(mine & set(map(tuple, zip(*[words[d][j:] for j in range(5)])))) >= 0.4 * len(mine) for d in others)
    assert passages.repeats(empty).count() == 0


def test_pipeline(spark, tmp_path, odd):
    import corpus_pipeline
    from sitesift.llm import bpe, decontaminate, quality, secrets

    texts = dict(texts_of(documents(spark)))
    verdict = {r.doc_id for r in quality.quality_digest(documents(spark)).collect() if r.kept}
    _, roots = near_by_hand([(i, t) for i, t in texts.items() if i in verdict], 80)
    kept = {i for i, root in roots.items() if i == root}
    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    kept = {i for i in kept if not any(item in decontaminate.normal(texts[i]) for item in items)}
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in rows} == kept and len(rows) == len(kept)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
    tokens = bpe.rank_table(corpus_pipeline.public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    clean = dict(texts_of(secrets.redact(documents(spark))))
    assert all(b"".join(tokens[i] for i in r.ids) == clean[r.doc_id].encode() for r in rows)

    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "MinHash near-dedup", "benchmark decontamination", "secret scans", "byte-level BPE encoding and decoding"]
    folder = tmp_path / "odd"
    odd.write.parquet(str(folder / "documents.parquet"))
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(str(folder / "benchmark.parquet"))
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(folder))
        assert docs.columns == odd.columns
    assert corpus_pipeline.run(spark, str(folder)).count() >= 1


def test_crowd_leaves_no_pair_out(spark):
    """A hot group whose rows stand between a document and its one near copy in every tree."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:j] + [f"x{i}"] + base[j + 1:])) for i in range(600) for j in [r.randrange(200)]]
    for i in range(600, 680):  # about 0.85 to few of the group
        words = list(base)
        for j in r.sample(range(200), 4):
            words[j] = f"y{r.randrange(6)}"
        rows.append((i, " ".join(words)))
    _, roots = near_by_hand(rows, 85)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x.id: x.component for x in neardup.near_components(df, forest=neardup.Forest(region=2)).collect()}
    assert len({i for i, root in roots.items() if root != i}) > 600 and got == roots


def test_rows_that_leave_a_crowd_meet_their_neighbours():
    orders = np.zeros((21, 16), np.uint16)
    orders[:, 6] = [0] * 10 + [1] + [2] * 10  # one row stands alone from the seventh hash on
    left, right, crowd = neardup.neighbours(orders, np.zeros(21, np.int64), neardup.DEFAULT)
    met = set(zip(left.tolist(), right.tolist()))
    assert {(9, 10), (10, 11)} <= met and set(crowd.tolist()) == set(range(21))


def test_a_crowded_region_goes_deeper_until_its_parts_are_small():
    r = np.random.default_rng(4)
    orders = r.integers(0, 3, (3000, 16)).astype(np.uint16)
    orders[:, :5] = 7
    orders[-40:] = 9  # equal rows: no depth parts them
    orders = orders[np.lexsort(orders.T[::-1])]
    left, right, crowd = neardup.neighbours(orders, np.zeros(3000, np.int64), neardup.DEFAULT)
    assert len(crowd) == 3000 and len(left) < 3.5 * 3000 and len(set(zip(left.tolist(), right.tolist()))) == len(left)
    met = set(zip(left.tolist(), right.tolist()))
    assert all((i, i + 1) in met for i in range(2999) if (orders[i, :5] == orders[i + 1, :5]).all())
    for depth in range(6, 17):  # any part of few rows is paired whole
        parts = {}
        for i, row in enumerate(orders[:, :depth].tolist()):
            parts.setdefault(tuple(row), []).append(i)
        for rows in parts.values():
            assert len(rows) > 8 or all((a, b) in met for a in rows for b in rows if a < b)


@pytest.mark.parametrize("block", [256, 3])
def test_prefix_join_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    r = random.Random(8)
    base = [f"w{i}" for i in range(90)]
    texts = [" ".join(w if r.random() > 0.012 * (i % 4) else f"x{r.randrange(50)}" for w in base) for i in range(120)]
    sets = {i: neardup.shingle_set(t) for i, t in enumerate(texts)}
    nodes = spark.createDataFrame([(i, len(s), i % 100) for i, s in sets.items()], "id bigint, n int, root bigint")
    held = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in sets.items()], "id bigint, shingles binary")
    pairs = neardup.shared_rare(nodes, held, 85)
    assert pairs.count() == pairs.distinct().count()
    got = {(x.a, x.b) for x in neardup.confirmed(pairs, held, 85).collect()}
    want = set()
    for a in sets:
        for b in range(a + 1, len(sets)):
            common = len(np.intersect1d(sets[a], sets[b]))
            if a % 100 != b % 100 and 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
                want.add((a, b))
    assert len(want) > 100 and got == want


def test_pipeline_takes_near_copies_from_080(spark):
    import corpus_pipeline

    r = random.Random(12)
    rows = []
    for i in range(0, 60, 2):
        words = [f"w{r.randrange(10**6)}" for _ in range(120)]
        other = list(words)
        for j in r.sample(range(24), r.choice([2, 3, 4])):
            other[5 * j] = f"x{r.randrange(10**6)}"
        rows += [(i, " ".join(words)), (i + 1, " ".join(other))]
    _, at_80 = near_by_hand(rows, 80)
    _, at_85 = near_by_hand(rows, 85)
    assert at_80 != at_85
    left = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), SMALL)
    assert {x.doc_id for x in left.collect()} == {i for i, root in at_80.items() if i == root}


def test_bands_miss_less_than_a_thousandth():
    forest = passages.tuned()
    assert (forest.trees, forest.step) == (16, 4) and (1 - 0.8**forest.step) ** forest.trees < 0.001


def test_passages_keep_one_copy_and_reach_their_ends(spark):
    def words(name, n):
        return " ".join(f"{name}{i}" for i in range(n))

    x, y, z = words("x", 60), words("y", 70), words("z", 51)
    texts = {1: f"{words('a', 5)} {x} {words('b', 9)}", 5: f"{words('c', 30)} {x} {y} {words('d', 30)}", 9: f"{y} {words('e', 40)}",
             11: f"{words('f', 30)} {z} {words('g', 30)}", 12: f"{words('h', 45)} {z} {words('i', 25)}"}
    rows = passages.repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    gone = {d: set() for d in texts}
    for r in rows:
        if (r.doc_id, r.start) != (r.kept_doc, r.kept_start):
            gone[r.doc_id] |= set(range(r.start, r.start + r.n_words))
            one, other = texts[r.doc_id].split(), texts[r.kept_doc].split()
            assert one[r.start:r.start + r.n_words] == other[r.kept_start:r.kept_start + r.n_words]
    assert gone == {1: set(), 5: set(range(30, 90)), 9: set(range(70)), 11: set(), 12: set(range(45, 96))}


def test_short_lines_are_paragraphs(spark):
    line = [f"w{i}" for i in range(40)]
    near = line[:39] + ["other"]
    texts = [(1, "a b\n" + " ".join(line)), (2, "c\n" + " ".join(near)), (3, "one two three four five"), (4, "x\none two three four five"), (5, "q r s t u")]
    rows = passages.repeated_paragraphs(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.start, r.n_words, r.kept_doc, r.kept_start) for r in rows} == {
        (1, 2, 40, 1, 2), (2, 1, 40, 1, 2), (3, 0, 5, 3, 0), (4, 1, 5, 3, 0)}


def test_paragraphs_of_any_id(spark):
    """Ids from negative to the largest, rows given twice, and links and components against brute force."""
    r = random.Random(21)
    line = lambda: [f"w{r.randrange(10**5)}" for _ in range(40)]
    ids = [-(2**63), -2, -1, 0, 5, 2**39, 2**62, 2**63 - 1]
    texts = {}
    shared = [line() for _ in range(3)]
    for k, i in enumerate(ids):
        lines = [line()]
        for s in shared[: 1 + k % 3]:
            near = list(s)
            near[-1 - k % 2] = f"x{k}"  # 5-word sets of 36; one word at the end changes one or two of them
            lines.append(near)
        texts[i] = "\n".join(map(" ".join, lines))
    rows = [*texts.items(), (-1, texts[-1]), (None, texts[0])]
    got = passages.repeated_paragraphs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    nodes = [(i, at, set(map(tuple, zip(*[w[j:] for j in range(5)])))) for i, t in texts.items()
             for at, w in zip(np.cumsum([0, *(len(x.split()) for x in t.split("\n"))]).tolist(), map(str.split, t.split("\n")))]
    roots = union_find([(a, b) for a in range(len(nodes)) for b in range(a) if 100 * len(nodes[a][2] & nodes[b][2]) >= 80 * len(nodes[a][2] | nodes[b][2])])
    groups = defaultdict(list)
    for n, root in roots.items():
        groups[root].append(nodes[n][:2])
    want = {(*place, *min(places)) for places in groups.values() for place in places}
    assert len(want) > 12 and len(got) == len(want) and {(x.doc_id, x.start, x.kept_doc, x.kept_start) for x in got} == want


def test_paragraph_recall_on_a_table(spark):
    """Every pair of similar lines of the small table ends in one component."""
    lines = []
    for i, t in texts_of(documents(spark)):
        at = 0
        for piece in (t or "").split("\n"):
            words = piece.encode().lower().split()
            if len(words) >= 5:
                lines.append((i, at, frozenset(zip(*[words[j:] for j in range(5)]))))
            at += len(words)
    holders = defaultdict(list)
    for n, (_, _, s) in enumerate(lines):
        for g in s:
            holders[g].append(n)
    pairs = {(a, b) for held in holders.values() if len(held) < 400 for a in held for b in held if a < b}
    links = [(a, b) for a, b in pairs if 100 * len(lines[a][2] & lines[b][2]) >= 80 * len(lines[a][2] | lines[b][2])]
    rows = passages.repeated_paragraphs(documents(spark)).collect()
    component = {(x.doc_id, x.start): (x.kept_doc, x.kept_start) for x in rows}
    across = [(a, b) for a, b in links if lines[a][0] != lines[b][0]]
    found = sum(component.get(lines[a][:2], 0) == component.get(lines[b][:2], 1) for a, b in across)
    assert len(across) > 50 and found >= 0.999 * len(across)


@pytest.mark.parametrize("folder", ["empty", "odd"])
def test_pipeline_on_odd_tables(spark, tmp_path, odd, empty, folder):
    import corpus_pipeline

    docs = {"empty": empty, "odd": odd}[folder]
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == {"empty": empty, "odd": odd}[folder].columns
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert all(r.round_trip for r in rows) and (bool(rows) == (folder == "odd"))


def test_lines_signed_together_are_signed_as_alone(monkeypatch):
    r = random.Random(4)
    lines = [" ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.choice([5, 6, 9, 40, 2500]))) for _ in range(60)]
    forest = passages.tuned()
    alone = [(len(s), *neardup.set_key(s), neardup.signature_bytes(s, forest)) for s in map(neardup.shingle_set, lines)]
    for portion in (1, 4000, 1 << 19):
        monkeypatch.setattr(neardup, "PORTION", portion)
        assert list(neardup.signed_lines(lines, forest)) == alone


def test_finished_tables_of_substring_dedup_are_deleted(spark, odd):
    """Before, all tables of all steps stayed on disk to the end."""
    from pathlib import Path

    from sitesift.llm.shared import stored

    stored(spark.range(1))
    top = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = set(top.glob("table-*"))
    found = passages.repeats(odd)
    assert found.count() > 0
    assert len(set(top.glob("table-*")) - before) == 1


def test_pieces_are_cut_once(spark, monkeypatch):
    """Before, all texts were cut into pieces twice, and every repeated piece carried the words around it through a shuffle."""
    calls, real = [], passages.piece_rows
    monkeypatch.setattr(passages, "piece_rows", lambda *a, **k: calls.append(a) or real(*a, **k))
    assert passages.repeated_passages(documents(spark)).count() > 0 and len(calls) == 1


def test_word_codes_of_texts_together():
    import pyarrow as pa
    import xxhash

    from sitesift.llm.shared import split_words

    texts = [None, "", " \t", "A b\x0bÄ é　x \x1c y\n\nZ", "w " * 40, "a  b", "q" + " w" * 51, " ".join(map(str, range(300)))]
    codes, size = neardup.word_codes(pa.array(texts, pa.string()))
    assert size.tolist() == [len(split_words(t)) for t in texts]
    assert codes.tolist() == [xxhash.xxh3_64_intdigest(w) for t in texts for w in split_words(t)]
