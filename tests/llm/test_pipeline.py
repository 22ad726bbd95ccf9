import re
from collections import Counter

import corpus_pipeline as P
from tidemark.llm.quality import fit_quality
from tidemark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def rows(df):
    return df.select(*P.COLUMNS).collect()


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = [docs]
    for k, (_, stage) in enumerate(P.STAGES[:-1]):
        out = stage(spark, kept[-1], FOLDER)
        assert tuple(out.columns) == P.COLUMNS
        out.write.parquet(f"{tmp_path}/{k}")
        kept.append(spark.read.parquet(f"{tmp_path}/{k}"))
    model = fit_quality(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    good = {r.doc_id for r, s in zip(rows(docs), model.scores([r.text or "" for r in rows(docs)]), strict=True) if s >= 0.5}
    assert {r.doc_id for r in rows(kept[1])} == good
    first = {}
    for r in sorted(rows(kept[1]), key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), r.doc_id)
    assert {r.doc_id for r in rows(kept[2])} == set(first.values())
    sets = {r.doc_id: {tuple(w[i : i + 5]) for w in [r.text.lower().split()] for i in range(max(1, len(w) - 4))} for r in rows(kept[2])}
    near = {r.doc_id for r in rows(kept[3])}
    like = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert near <= set(sets) and not any(a < b and like(a, b) for a in near for b in near)
    assert all(any(like(x, y) for y in sets if y != x) for x in set(sets) - near)
    taken = Counter(r.doc_id for r in rows(kept[4]))
    assert set(taken) <= near and max(taken.values()) <= 3
    last = P.STAGES[-1][1](spark, kept[4], FOLDER).collect()
    assert Counter(r.doc_id for r in last) == taken and all(r.round_trip and r.n_tokens == len(r.ids) for r in last)


def test_run_and_queries(spark):
    assert P.run(spark, FOLDER).count() > 0
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_stages_on_edges(spark, edge, empty):
    for df in (edge.select(*P.COLUMNS), empty):
        docs = df
        for _, stage in P.STAGES:
            docs = stage(spark, docs, FOLDER)
        assert docs.count() <= 3 * df.count()


def test_one_row_of_each_group_stays(spark, edge):
    """Also of rows without a doc_id, and where a copy's doc_id repeats on another text."""
    long = " ".join(f"w{k}" for k in range(100))
    near = long.replace("w50", "v50")
    other, alone = long.replace("w", "a"), long.replace("w", "b")
    made = [(1, long), (2, near), (2, other), (None, alone), (None, alone + " "), (None, long), (7, other), (None, "nothing like it"), (7, "nothing at all"), (9, "same"), (9, "same")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in made], edge.select(*P.COLUMNS).schema)
    key = lambda df: sorted(((r.doc_id, r.text.strip()) for r in df.collect()), key=repr)
    alike = [(None, alone), (1, long), (2, other), (7, "nothing at all"), (9, "same"), (None, "nothing like it")]
    assert key(P.drop_near_copies(spark, docs, FOLDER)) == sorted(alike, key=repr)
    unlike = Counter([(None, alone), (None, alone), (1, long), (2, near), (2, other), (7, "nothing at all"), (9, "same"), (None, "nothing like it")])
    assert Counter(key(P.drop_copies(spark, docs, FOLDER))) == unlike
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=repr)
    exact = P.drop_copies(spark, edge.select(*P.COLUMNS), FOLDER)
    assert ids(exact) == sorted([1, 3, 5, 6, 7, 8, 9, 10, None], key=repr)
    assert ids(P.drop_near_copies(spark, exact, FOLDER)) == sorted([1, 3, 5, 6, 7, 8, 10, None], key=repr)
