import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm.embedding_dedup import near_duplicate_vectors
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.shingle_join import bitmap_of, intersections, may_link, merged, prefix_lengths, shingle_join
from tidemark.plans.components import connected_components


def groups_of(links, nodes):
    comp = {n: n for n in nodes}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        comp[b] = a
    return {n: root(n) for n in nodes}


def brute_exact(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    group = defaultdict(list)
    for i, t in norm:
        group[t].append(i)
    least = {t: min((i for i in g if i is not None), default=None) for t, g in group.items()}
    return sorted(((i, least[t], len(group[t]), i == least[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in norm), key=repr)


@pytest.mark.parametrize("first,growth", [(128, 4), (1, 2)])
def test_exact_dedup(spark, edge, empty, documents, scratch, first, growth):
    tied = spark.createDataFrame([(i, "a" * (i % 5) + "é" * (i % 3)) for i in range(60)], "doc_id long, text string")
    for df in (edge, empty, tied, *([documents] if first > 1 else [])):
        got = exact_dedup(df, scratch, first, growth).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
        assert sorted(map(tuple, got), key=repr) == brute_exact([(r.doc_id, r.text) for r in df.collect()])


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_shingles(rows, size, percent):
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    comp = groups_of(links, range(len(sets)))
    least = defaultdict(list)
    for k, c in comp.items():
        if rows[k][0] is not None:
            least[c].append(rows[k][0])
    degree = np.bincount(np.array(links, dtype=int).ravel(), minlength=len(sets))
    return sorted(((rows[k][0], len(sets[k]), min(least[comp[k]], default=None), int(degree[k])) for k in range(len(sets))), key=repr)


def near_copies(rng, n, words, changes):
    base = [f"w{rng.integers(500)}" for _ in range(words)]
    for _ in range(n):
        w = list(base)
        for k in rng.integers(len(w), size=changes):
            w[k] = f"v{rng.integers(10**6)}"
        yield " ".join(w)


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_shingle_join(spark, edge, empty, documents, scratch, size, percent):
    rng = np.random.default_rng(3)
    texts = [t for n, w, c in ((40, 100, 1), (25, 60, 2), (10, 9, 1), (5, 4, 1), (30, 200, 8)) for t in near_copies(rng, n, w, c)]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for df in (edge, made, documents, empty):
        got = shingle_join(df, scratch, size, percent).select("doc_id", "n_shingles", "component_id", "n_links").collect()
        assert sorted(map(tuple, got), key=repr) == brute_shingles([(r.doc_id, r.text) for r in df.collect()], size, percent)


def test_small_leaves_and_nodes_find_the_same(spark, scratch, monkeypatch):
    import tidemark.llm.shingle_join as S

    rng = np.random.default_rng(4)
    texts = [t for n in (60, 30, 30) for t in near_copies(rng, n, 50, 1)]
    rows = list(enumerate(texts))
    for name, value in (("LEAF_TOKENS", 300), ("LEAF_ROWS", 4), ("NODE_LEAVES", 3), ("COLUMNS", 7)):
        monkeypatch.setattr(S, name, value)
    got = shingle_join(spark.createDataFrame(rows, "doc_id long, text string"), scratch).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert sorted(map(tuple, got), key=repr) == brute_shingles(rows, 4, 85)


def test_bounds_never_prune_a_link():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 2**63, size=rng.integers(1, 400), dtype=np.uint64)
        sets += [np.unique(base), np.unique(np.concatenate([base[: int(len(base) * 0.95)], rng.integers(0, 2**63, size=3, dtype=np.uint64)]))]
    bits, n = np.stack([bitmap_of(s) for s in sets]), np.array([len(s) for s in sets])
    nodes = {"bits": bits, "low": n, "high": n, "spare": n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)}
    both = intersections(sets, sets).astype(int)
    link = 185 * both >= 85 * (n[:, None] + n[None, :])
    assert not (link & ~may_link(nodes, nodes)).any()
    for _ in range(100):
        pick = [rng.choice(len(sets), size=5, replace=False) for _ in range(2)]
        a, b = (merged({k: v[p] for k, v in nodes.items()}) for p in pick)
        assert may_link(a, b)[0, 0] or not link[np.ix_(*pick)].any()
    assert (prefix_lengths(n) >= 1).all() and prefix_lengths(np.array([0, 1, 100])).tolist() == [0, 1, 16]


def brute_vectors(rows, least):
    ok = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for i in ok:
        for j in ok:
            if j < i and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], dtype=np.float64) for k in (i, j))
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                    links.append((i, j))
    return links, ok


def test_near_duplicate_vectors(spark, scratch):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((30, 16))
    vectors = [(base[k % 30] + 0.05 * rng.standard_normal(16)).tolist() for k in range(150)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] + [1.0] * 15, vectors[0], vectors[0], [2 * x for x in vectors[0]], [1.0, 2.0], [1.0, 2.01], [1e300, 1.0], [1e-300, 1e-310]]
    rows = [(i, v) for i, v in enumerate(vectors + odd)] + [(None, vectors[3]), (5, vectors[5])]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, cid string, code string")
    got = near_duplicate_vectors(df, scratch).collect()
    links, _ = brute_vectors(rows, 0.9)
    comp = groups_of(links, range(len(rows)))
    least = defaultdict(list)
    for k, c in comp.items():
        if rows[k][0] is not None:
            least[c].append(rows[k][0])
    degree = np.bincount(np.array(links).ravel(), minlength=len(rows))
    want = sorted(((rows[k][0], int(degree[k]), min(least[comp[k]], default=None), rows[k][0] == min(least[comp[k]], default=-1)) for k in range(len(rows))), key=repr)
    assert sorted(map(tuple, got), key=repr) == want
    assert near_duplicate_vectors(df.limit(0), scratch).count() == 0


def test_recall_on_whole_table(spark, scratch):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    m = np.array([r.embedding for r in df.orderBy("vec_id").collect()], dtype=np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    true = ((m @ m.T) >= 0.9).sum() - len(m)
    found = near_duplicate_vectors(df, scratch).agg({"n_links": "sum"}).first()[0]
    assert 0.9 * true <= found <= true


def test_ragged_and_tight_buckets(spark, scratch, monkeypatch):
    """A third of the rows in one tight cluster over many blocks, a third null, and the links of the cluster counted without loss."""
    import tidemark.llm.embedding_dedup as E

    monkeypatch.setattr(E, "PER_BLOCK", 64)
    rng = np.random.default_rng(12)
    centre = rng.standard_normal(32)
    rows = [(k, (centre + 0.01 * rng.standard_normal(32)).tolist()) for k in range(700)] + [(1000 + k, None) for k in range(700)] + [(2000 + k, rng.standard_normal(32).tolist()) for k in range(700)] + [(3000 + k, [1.0, 0.0]) for k in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicate_vectors(df, scratch).collect()}
    assert all(got[k] == (699, 0, k == 0) for k in range(700)) and all(got[k] == (0, k, True) for k in range(1000, 1700)) and all(got[k] == (299, 3000, k == 3000) for k in range(3000, 3300))


def pairs_near_the_threshold(rng, n, dim, common):
    """Unit vectors and partners of cosine 0.90 to 0.91; with a common direction both share it, at a mean cosine of 0.5."""
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    mean = unit(rng.standard_normal((1, dim))) * (0.5**0.5 if common else 0.0)

    def own(m):
        return unit(m - (m @ unit(mean).T) * unit(mean)) if common else unit(m)

    a = own(rng.standard_normal((n, dim)))
    b = own(rng.standard_normal((n, dim)))
    b = unit(b - (a * b).sum(axis=1, keepdims=True) * a)
    cosine, shared = rng.uniform(0.90, 0.91, size=(n, 1)), (mean * mean).sum()
    c = (cosine - shared) / (1 - shared)
    long = np.sqrt(1 - shared)
    a, b = mean + long * a, mean + long * (c * a + np.sqrt(1 - c * c) * b)
    assert np.allclose((a * b).sum(axis=1, keepdims=True), cosine)
    return a, b


@pytest.mark.parametrize("dim", [16, 32, 64])
@pytest.mark.parametrize("common", [False, True])
def test_recall_at_every_size(dim, common):
    from tidemark.llm.embedding_dedup import choose_index

    rng = np.random.default_rng(8)
    a, b = pairs_near_the_threshold(rng, 6000, dim, common)
    for rows in (10**4, 10**6, 10**8, 10**9):
        index = choose_index(a[:4000], rows)
        x, y = index.codes(a[4000:]), index.codes(b[4000:])
        met = (index.keys_of(x) == index.keys_of(y)).any(axis=0) & (np.bitwise_count(x ^ y).sum(axis=1) <= index.limit) if index.tables.width else np.ones(2000, dtype=bool)
        assert met.mean() >= 0.93, rows


@pytest.mark.parametrize("common", [False, True])
def test_links_near_the_threshold(spark, scratch, common):
    """16 components and many rows: one code has no room for several wide tables."""
    a, b = pairs_near_the_threshold(np.random.default_rng(9), 12_000, 16, common)
    vectors = [*a.tolist(), *b[:2000].tolist()]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    got = {r.vec_id: r.component_id for r in near_duplicate_vectors(df, scratch).collect()}
    assert len(got) == len(vectors) and sum(got[k] == got[len(a) + k] for k in range(2000)) >= 0.9 * 2000


@pytest.mark.parametrize("hot", ["7", "CAST(NULL AS BIGINT)"])
def test_shingle_join_with_one_id_on_a_third_of_the_rows(spark, scratch, hot):
    """The hot id is on 10,000 different texts; every fourth of all texts comes twice, once with a word changed at its end, once whole."""
    words = "array_join(transform(sequence(1, 30), k -> concat('w', t % 9973, 'x', k)), ' ')"
    df = spark.range(30000).selectExpr("id", f"IF(id % 3 = 0, {hot}, id) AS doc_id", "IF(id % 4 = 1, id - 1, id) AS t").selectExpr("id", "doc_id", f"concat({words}, ' ', t, IF(id % 8 = 1, ' end', ' last')) AS text")
    got = shingle_join(df.select("doc_id", "text"), scratch).selectExpr("sum(n_links)", "count(*)").first()
    # By brute force among texts with one first word, as others share no shingle.
    texts = [r.text for r in df.orderBy("id").collect()]
    sets = [frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) for w in (t.split() for t in texts)]
    groups = defaultdict(list)
    for k, t in enumerate(texts):
        groups[t.split()[0]].append(k)
    links = sum(100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) for g in groups.values() for a in g for b in g if a != b)
    assert got[1] == 30000 and links >= 15000 and got[0] == links
    assert spark.read.parquet(f"{scratch.path}/*-leaves").selectExpr("sum(size(docs))").first()[0] <= 30000


def test_shingle_join_of_repeated_rows(spark, scratch):
    """One row on a third of all rows: its tokens are needed once."""
    rows = [(7, "the very same words again and again in a row")] * 2000 + [(k, f"the very same words again and again in a row {k}") for k in range(100, 130)] + [(k, f"own {k} text {k} of {k} no {k} one {k}") for k in range(1000, 3000)]
    got = shingle_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), scratch).collect()
    assert {r.component_id for r in got if r.doc_id == 7 or 100 <= r.doc_id < 130} == {7} and all(r.component_id == r.doc_id for r in got if r.doc_id >= 1000)
    assert {r.n_links for r in got if r.doc_id == 7} == {2029}
    assert spark.read.parquet(f"{scratch.path}/*-leaves").selectExpr("sum(size(docs))").first()[0] <= 60


def test_short_texts_that_share_a_passage_do_not_meet(spark, scratch):
    """Passages grow with the corpus, and what meets is compared with all that meets it."""
    from tidemark.llm.shingle_join import _meetings, _sketched

    rng = np.random.default_rng(8)
    passage = " ".join(f"p{k}" for k in range(9))
    rows = [(i, passage + "".join(f" v{rng.integers(10**9)}" for _ in range(12 + i % 100))) for i in range(400)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    assert _meetings(_sketched(made, 4, 85), scratch, 85).isEmpty()


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_links_between_short_and_longer_sets(spark, scratch, size, percent):
    from tidemark.llm.shingle_join import SHORT

    rng = np.random.default_rng(9)
    rows = []
    for extra in (-1, 0, 1, 2, 5, 12, 19, 22, 23, 24, 31, 32, 33):
        for _ in range(4):
            whole = [f"v{rng.integers(10**9)}" for _ in range(SHORT + size - 1 + extra)]
            rows += [(len(rows) + k, " ".join(whole[: len(whole) - cut])) for k, cut in enumerate((0, 1, max(1, extra), 22, 30))]
    got = shingle_join(spark.createDataFrame(rows, "doc_id long, text string"), scratch, size, percent).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert sorted(map(tuple, got), key=repr) == brute_shingles(rows, size, percent)


def test_leaf_pairs_in_rounds_find_the_same(spark, scratch, monkeypatch):
    """Leaves travel with each of their pairs, so pairs are compared some at a time."""
    import tidemark.llm.shingle_join as S

    rng = np.random.default_rng(10)
    rows = list(enumerate(t for n in (60, 30) for t in near_copies(rng, n, 50, 1)))
    for name, value in (("LEAF_TOKENS", 300), ("LEAF_ROWS", 8), ("PAIRS", 9), ("PAIRS_A_LEAF", 1)):
        monkeypatch.setattr(S, name, value)
    got = shingle_join(spark.createDataFrame(rows, "doc_id long, text string"), scratch).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert sorted(map(tuple, got), key=repr) == brute_shingles(rows, 4, 85)
    assert sum(path.endswith("-across") for path in scratch.held) > 2


def test_components_against_union_find_with_fewer_edges_each_round(spark, scratch, monkeypatch):
    """What is joined again in every round is what is left, not all edges: chains in order and in any order, a hub, a dense group, self loops."""
    rng = np.random.default_rng(5)
    chain, ids = np.arange(300), rng.permutation(np.arange(1000, 1300))
    dense = 2000 + rng.integers(0, 80, (1500, 2))
    edges = [*zip(chain, chain[1:]), *zip(ids, ids[1:]), *((i, 5999) for i in range(5000, 5999)), *dense.tolist(), (7000, 7000), (-5, -3)]
    edges = [(int(a), int(b)) for a, b in edges]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    left, write = [], scratch.table

    def table(df, name="t"):
        t = write(df, name)
        if name == "edges":
            left.append(t.count())
        return t

    monkeypatch.setattr(scratch, "table", table)
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()
    assert len(got) == len(up) and {r.node: r.comp for r in got} == {x: root(x) for x in up}
    assert left[-1] == 0 and sum(left[1:]) < left[0]
    assert connected_components(spark.createDataFrame([], "a long, b long"), scratch).count() == 0
