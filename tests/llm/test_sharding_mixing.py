import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from tidemark.llm.kd_sharding import kd_shards
from tidemark.llm.mixing import mix_sources
from tidemark.llm.queries import ORACLE_SQL


def check_shards(rows, docs, shards):
    texts = sorted(((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs), key=repr)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=repr) == texts
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return Counter({s: sum(r.size for r in rows if r.shard == s) for s in range(shards)})


@pytest.mark.parametrize("shards", [40, 7])
def test_kd_shards(spark, edge, empty, scratch, shards):
    check_shards(kd_shards(edge, scratch, shards).collect(), edge.collect(), shards)
    assert kd_shards(empty, scratch, shards).count() == 0


def test_kd_shards_are_balanced_and_stable(spark, scratch):
    n = 4000
    df = spark.range(n).selectExpr("id AS doc_id", "repeat('x', CAST(50 + id % 91 AS INT)) AS text", "IF(id % 3 = 0, 'en', 'de') AS lang", "IF(id % 3 < 2, 'hot', concat('s', id % 5)) AS source", "50 + id % 91 AS n_chars")
    rows = kd_shards(df, scratch).collect()
    sizes = check_shards(rows, df.collect(), 40)
    assert max(sizes.values()) - min(sizes.values()) <= 0.1 * sum(sizes.values()) / 40 + 2 * 160
    again = {r.doc_id: r.shard for r in kd_shards(df.repartition(7), scratch).collect()}
    assert again == {r.doc_id: r.shard for r in rows}


def brute_shards(rows, shards):
    """The whole tree again on plain lists: (key per dimension, size) rows, cut at the weighted quantile of the widest dimension."""
    out = {}

    def cut(part, leaves, first):
        if leaves == 1:
            out.update(dict.fromkeys(part, first))
            return
        if not part:
            return
        dim = max(range(4), key=lambda i: ((max(rows[r][0][i] for r in part) >> 32) - (min(rows[r][0][i] for r in part) >> 32), -i))
        goal, below, low = sum(rows[r][1] for r in part) * (leaves // 2) / leaves, 0, []
        for r in sorted(part, key=lambda r: rows[r][0][dim]):
            if below + rows[r][1] > goal and goal - below <= below + rows[r][1] - goal:
                break
            below += rows[r][1]
            low.append(r)
            if below > goal:
                break
        cut(low, leaves // 2, first)
        cut([r for r in part if r not in set(low)], leaves - leaves // 2, first + leaves // 2)

    cut(list(rows), shards, 0)
    return out


def test_kd_cuts_against_brute_force(spark, scratch):
    """Rows of one size and grids without ties: every cut is exact, so the shards are the brute-force tree's."""
    rng = random.Random(3)
    ids, chars, n = rng.sample(range(10**6), 600), rng.sample(range(10**6), 600), 600
    sources, langs = [rng.choice(["news/a", "news/b", "news/c-long-name-1", "news/c-long-name-2", None]) for _ in range(n)], [rng.choice(["en", "de", None]) for _ in range(n)]
    df = spark.createDataFrame([(ids[k], "x" * 84, langs[k], sources[k], chars[k]) for k in range(n)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.shard for r in kd_shards(df, scratch, 8).collect()}
    order = lambda names: {v: k + 1.0 for k, v in enumerate(sorted(set(names), key=lambda v: (v is not None, v or "")))}
    ties = {r.doc_id: r.h & 0xFFFFF000 for r in df.selectExpr("doc_id", "xxhash64(doc_id, text) AS h").collect()}

    def grid(values):
        low, high = min(values), max(values)
        return [math.floor((v - low) / (high - low) * (2**31 - 1)) for v in values]

    so, la = order(sources), order(langs)
    dims = list(zip(grid([so[s] for s in sources]), grid([la[x] for x in langs]), grid(chars), grid(ids), strict=True))
    rows = {ids[k]: ([g << 32 | ties[ids[k]] for g in dims[k]], 100) for k in range(n)}
    assert got == brute_shards(rows, 8)


def test_a_repeated_row_on_a_third_of_all(spark, scratch):
    rows = spark.range(30000).selectExpr("IF(id % 3 = 0, 7, id) AS doc_id", "IF(id % 3 = 0, 'the same words', concat('text ', id)) AS text", "'en' AS lang", "'hot' AS source", "IF(id % 3 = 0, 14, 9) AS n_chars").repartition(8)
    sizes = check_shards(kd_shards(rows, scratch).collect(), rows.collect(), 40)
    assert max(sizes.values()) - min(sizes.values()) <= 0.1 * sum(sizes.values()) / 40
    got = mix_sources(rows, scratch, rows_per_block=200).select("doc_id", "size", "taken")
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "parts" in plan
    taken = got.collect()
    assert len(taken) == 30000 and sum(r.taken for r in taken) == sum(r.size for r in taken)
    per_part = scratch.spark.read.parquet(f"{scratch.path}/*-hot").agg({"parts": "max"}).first()[0]
    assert per_part >= 50


def test_mixing_matches_sql_and_targets(spark, edge, documents, empty, scratch, tmp_path):
    for k, df in enumerate((edge.select("doc_id", "text", "source"), documents)):
        df.write.parquet(f"{tmp_path}/{k}")
        c = duckdb.connect()
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/{k}/*.parquet'")
        names = ["doc_id", "size", "source_size", "target", "taken"]
        want = c.execute(f"SELECT {', '.join(names)} FROM ({ORACLE_SQL['op5_source_mixing']})").fetchall()
        got = [tuple(r) for r in mix_sources(df, scratch).select(*names).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
        assert all(t <= 3 * s for _, s, _, _, t in got)
    assert mix_sources(empty, scratch).count() == 0


def brute_targets(sizes):
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, open_, left = {}, set(sizes), sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over
    return target


def test_targets_and_budgets(spark, scratch):
    rows = [(k, "w " * (1 + k % 9), ["a", "b", "c", None, "d"][0 if k % 3 else k % 5]) for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_sources(df, scratch, carry=("source",)).collect()
    sizes = Counter()
    for r in got:
        sizes[r.source] += r.size
    want, taken = brute_targets(sizes), Counter()
    for r in got:
        taken[r.source] += r.taken
        assert abs(r.target - want[r.source]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    whole = mix_sources(df, scratch, whole=True, carry=("source",)).collect()
    assert all(r.last_epoch in (0, r.size) for r in whole)
    for s in sizes:
        assert abs(sum(r.taken for r in whole if r.source == s) - want[s]) <= 9
