import random
import re

import duckdb
import pandas as pd

from provenant.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, key int"


def water_filling(sizes, weights, budget, cap):
    """Clamp and hand on, again and again, as the method is told."""
    target, clamped = {}, set()
    left, total = dict(weights), budget * sum(sizes.values())
    while True:
        share = total - sum(cap * sizes[s] for s in clamped)
        live = {s: w for s, w in left.items() if s not in clamped}
        target = {s: cap * sizes[s] for s in clamped} | {s: share * w / sum(live.values()) for s, w in live.items()}
        over = {s for s in live if target[s] > cap * sizes[s] + 1e-9}
        if not over:
            return target
        clamped |= over


def rows(seed=1, n=600):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        source = rng.choice(["b", "a", "é", None, "Z", "hot", "hot", "hot"])
        text = None if i % 50 == 0 else " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 60))) + rng.choice(["", " ", "\n\t"])
        out.append((i, text, source, "x", 1))
    return out


def test_targets_equal_the_loop_and_taken_is_near(spark):
    data = rows()
    got = mixing.op7_mix(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(data)
    source, text = {r[0]: r[2] for r in data}, {r[0]: r[1] for r in data}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", text[i] or "")) for i in text}
    names = sorted({s for s in source.values() if s is not None}) + [None]
    sums = {s: sum(size[i] for i in size if source[i] == s) for s in names}
    want = water_filling(sums, {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, 1.5, 2.0)
    taken = dict.fromkeys(names, 0)
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == sums[source[r.doc_id]]
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6 * max(1, r.target)
        assert r.taken in (0, r.size, 2 * r.size)
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 30 for s in names)


def test_equals_sql_and_reruns_agree(spark):
    data = rows(2)
    docs = spark.createDataFrame(data, SCHEMA)
    a = sorted(map(tuple, mixing.op7_mix(docs).collect()))
    b = sorted(map(tuple, mixing.op7_mix(docs.repartition(7)).collect()))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(data, columns=["doc_id", "text", "source", "size", "key"]))
    assert a == b == sorted(con.sql(mixing.ORACLE_SQL).fetchall())


def test_mixed_rows_follow_the_plan(spark):
    docs = spark.createDataFrame(rows(3), SCHEMA)
    plan = {r.doc_id: r.taken // r.size for r in mixing.op7_mix(docs).collect() if r.size}
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    count = {}
    for r in out.collect():
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert all(count.get(i, 0) == n for i, n in plan.items())


def test_edges(spark):
    assert mixing.op7_mix(spark.createDataFrame([], SCHEMA)).count() == 0
    got = mixing.op7_mix(spark.createDataFrame([(1, None, None, None, None), (None, "", "a", None, None)], SCHEMA)).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2
    same = mixing.op7_mix(spark.createDataFrame([(None, "a b", None, None, None)] * 4, SCHEMA)).collect()
    assert len(same) == 4 and all(r.target == 12.0 for r in same)
