"""Near-duplicates and exact search against brute force, with awkward rows."""

import random

import numpy as np
import pytest

from tidebook.llm import exact_topk, near_dedup
from tidebook.llm.common import Scratch, components
from tidebook.llm.exact_topk import Tree, top_k

DOCS = "doc_id long, text string, lang string, set_key string, n long"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "x", 1) for i, t in texts], DOCS)


def brute(texts, width, percent=80):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and (n := len(sets[a] & sets[b])) and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus(seed=5):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    out, passage = [], text(30)
    for base in range(12):
        words = text(r.choice([6, 25, 60, 150, 400]))
        for _ in range(r.choice([1, 4, 9])):
            copy = list(words)
            for _ in range(int(len(copy) * r.choice([0, 0.01, 0.03, 0.08]))):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            out.append(" ".join(copy) if base % 3 else " ".join(copy[:10] + passage + copy[10:]))
    out += ["", " \t\n", "one", "one", "ONE two three", "one two three", None, "a b c d", "a  b\tc d", "É x y z w", "é x y z w", " ".join(text(20_000))]
    ids = list(range(100, 100 + len(out)))
    r.shuffle(ids)
    return list(zip(ids, out, strict=True))


@pytest.mark.parametrize("width", [4, 5])
def test_components_equal_brute_force(spark, width):
    texts = corpus(width)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(spark, docs_of(spark, texts), width).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in brute(texts, width).items()}


def test_large_group_around_one_base_is_found_whole(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    r = random.Random(2)
    base = [f"b{i}" for i in range(120)]
    texts = [(0, " ".join(base))]
    for i in range(1, 90):
        copy = list(base)
        for _ in range(r.choice([1, 2, 5, 9, 14])):
            copy[r.randrange(120)] = f"x{r.randrange(40)}"
        texts.append((i, " ".join(copy)))
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(spark, docs_of(spark, texts), 4).collect()}
    assert got == {i: c for i, (_, c) in brute(texts, 4).items()}


def test_no_rows_null_ids_and_repeated_rows(spark):
    assert near_dedup.near_duplicates(spark, docs_of(spark, []), 4).count() == 0
    rows = docs_of(spark, [(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (None, "z"), (5, "A b c d e f")])
    got = sorted(((r["doc_id"] or 0), r["component_id"] or 0, r["kept"]) for r in near_dedup.near_duplicates(spark, rows, 4).collect())
    assert got == [(0, 0, False), (0, 3, False), (3, 3, True), (3, 3, True), (5, 3, False)]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(500, i) for i in range(501, 560)]
    got = {r["node"]: r["component"] for r in components(spark, Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 61), 1), **dict.fromkeys(range(500, 560), 500)}


def brute_top(rows, k, every=100):
    ints = {i: np.floor(np.asarray(v, np.float64) * 1024).astype(np.int64) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in ints:
        if q % every == 0:
            best = sorted(((-int(ints[q] @ v), i) for i, v in ints.items() if i != q and len(v) == len(ints[q])))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=8)]) for i in range(900)]
    rows += [(i, rows[1][1]) for i in range(900, 1000)]  # one vector many times: ties
    rows += [(1000, None), (1001, []), (1002, [1.0, None] + [0.0] * 6), (1003, [float("nan")] * 8), (1004, [float("inf")] * 8), (1100, [1.0, 2.0]), (1101, [3.0, -1.0]), (1200, rows[5][1])]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<float>, label int, shard int")
    assert sorted(map(tuple, top_k(spark, df).collect())) == brute_top(rows, 10)


def test_top_k_of_few_rows_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert top_k(spark, spark.createDataFrame([], schema)).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (7, [2.0]), (8, [2.0])], schema)
    assert [tuple(r) for r in top_k(spark, few).orderBy("rank").collect()] == [(0, 1, 7, 2048 * 1024), (0, 2, 8, 2048 * 1024)]


def test_top_k_over_many_cells_and_shards_with_repeated_ids(spark, monkeypatch):
    for name, value in (("SHARD_ROWS", 40), ("LEAST_ROWS", 8), ("CELLS", 12), ("DIMS", 2), ("SAMPLE", 200)):
        monkeypatch.setattr(exact_topk, name, value)
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(size=4) + (i % 3) * 4]) for i in range(700)]
    rows += [(i, [0.5] * 4) for i in range(700, 850)] + [(i, [float(x) for x in r.normal(size=3)]) for i in range(900, 1010)] + [(2000 + i, [float(i), 1.0]) for i in range(0, 110)] + [(3100, [0.25] * 3000), (3101, [0.5] * 3000)]
    again = [(17, [9.0] * 4), (17, [9.0] * 4), (100, [50.0] * 4), (100, [51.0] * 4), (333, rows[333][1])]
    df = spark.createDataFrame(rows + again, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, top_k(spark, df, k=7).collect()))
    ints = [(i, np.floor(np.asarray(v) * 1024).astype(np.int64)) for i, v in rows + again]
    asks = {}
    for i, v in ints:
        if i % 100 == 0 and (i not in asks or v.tolist() < asks[i].tolist()):
            asks[i] = v
    want = []
    for q, v in asks.items():
        best = sorted((-int(v @ w), i) for i, w in ints if i != q and len(w) == len(v))[:7]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_tree_boxes_are_tight():
    v = np.arange(600, dtype=np.int64).reshape(300, 2) % 97
    tree = Tree(np.arange(300), v, 10)
    for (a, b), (lo, hi), low, high in zip(tree.child, tree.span, tree.low, tree.high, strict=True):
        if a < 0:
            assert (tree.vectors[lo:hi].min(0) == low).all() and (tree.vectors[lo:hi].max(0) == high).all()
        else:
            assert (np.minimum(tree.low[a], tree.low[b]) == low).all() and (np.maximum(tree.high[a], tree.high[b]) == high).all()
