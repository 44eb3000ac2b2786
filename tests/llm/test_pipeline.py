"""The pipeline's stages against plain versions on a small corpus, and that each stage's decisions take effect."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from provenant.llm import common, quality, simhash
from tests.llm.test_line_dedup import brute
from tests.llm.test_simhash import plain_components


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """A third of sf0.01's documents and each stage's result, written and read again as run() does."""
    d = tmp_path_factory.mktemp("sf")
    for t in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet").where("doc_id < 350").write.parquet(f"{d}/{t}.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(d / f"stage{k}")
        stage(spark, out[-1], str(d)).write.parquet(path)
        out.append(spark.read.parquet(path))
    return str(d), out


def test_columns_stay(stages):
    _, out = stages
    assert all(x.dtypes == out[0].dtypes for x in out[:-1])


def test_quality_rejects(spark, stages):
    d, out = stages
    model = quality.train(out[0], spark.read.parquet(f"{d}/labels.parquet"))
    t = quality.with_features(out[0]).select("doc_id", "__q_.*").toPandas()
    keep = set(t.doc_id[model.score(t[list(quality.FEATURES)].to_numpy()) >= 0.5])
    got = {r.doc_id for r in out[1].collect()}
    assert got == keep and 0 < len(got) < out[0].count()


def test_lines_go_once(stages):
    _, out = stages
    rows = [(r.doc_id, r.text) for r in out[1].collect()]
    want, _ = brute_exact(rows)
    got = {r.doc_id: r.text for r in out[2].collect()}
    assert set(got) == set(want)
    # plain version without similarity: what it drops is dropped here too
    for i in got:
        lines = lambda t: Counter(x for x in t.split("\n") if x)
        assert not lines(got[i]) - lines(want[i])
    assert sum(len(t) for t in got.values()) < sum(len(t) for _, t in rows)
    assert all(r.n_chars == len(r.text) for r in out[2].collect())


def brute_exact(rows):
    return brute(rows, fuzzy=False)


def test_one_of_each_group_stays(stages):
    """All pairs of five-word shingle sets compared: of each group of Jaccard 0.8 the first stays."""
    _, out = stages
    sets = {}
    for r in out[2].collect():
        w = "".join(c.lower() if c.isascii() else c for c in r.text or "").split()
        sets[r.doc_id] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    near = lambda p, q: p == q or min(len(p), len(q)) >= 0.8 * max(len(p), len(q)) and len(p & q) >= 0.8 * len(p | q)
    comp = plain_components(list(sets), [(a, b) for a in sets for b in sets if a < b and near(sets[a], sets[b])])
    assert {r.doc_id for r in out[3].collect()} == {i for i in sets if comp[i] == i}


def test_near_copies_of_repeated_rows_and_clashing_names(spark):
    rows = [(1, "a b c d e f", 1, 2), (1, "a b c d e f", 3, 4), (2, "A b c d e f", 5, 6), (None, "x y", 7, 8), (4, "x  y", 9, 9)]
    got = simhash.simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string, spot int, copy_key int")).collect()
    assert [r.doc_id for r in got if r.doc_id is not None] == [1] and len(got) == 2


def test_mix_comes_near_its_weights(stages):
    _, out = stages
    size = lambda t: len((t or "").split())
    before, after = defaultdict(int), defaultdict(int)
    for r in out[3].collect():
        before[r.source] += size(r.text)
    for r in out[4].collect():
        after[r.source] += size(r.text)
    largest = max(size(r.text) for r in out[3].collect())
    total = sum(before.values())
    assert abs(sum(after.values()) - 1.5 * total) <= largest * len(before)
    assert all(after[s] <= 2 * before[s] for s in before)


def test_packing_holds_every_row(stages):
    _, out = stages
    got = out[5].collect()
    starts = Counter(r.doc_id for r in got if r.piece == 0)
    assert starts == Counter(r.doc_id for r in out[4].collect())
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_run_is_the_stages(spark, stages):
    d, out = stages
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert Counter(map(key, corpus_pipeline.run(spark, d).collect())) == Counter(map(key, out[5].collect()))


def test_empty_documents(spark, stages):
    d, out = stages
    docs = out[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
        assert docs.count() == 0


def test_dedup_of_empty_texts_keeps_one(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, " "), (4, "some words here")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.simhash_dedup(docs).collect()) == [1, 4]


def test_near_copies_with_edited_words_go(spark):
    """Two words of 100 changed leave a five-word Jaccard near 0.8 or above; all are to be dropped, and unlike texts kept."""
    base = [[f"w{i}x{k}" for k in range(100)] for i in range(40)]
    edited = [[*w[:30], "other", *w[31:98], "end", w[99]] for w in base]
    docs = [(i, " ".join(w)) for i, w in enumerate(base + edited)] + [(100, " ".join(base[0][:50])), (101, ""), (102, " "), (None, "w")]
    got = corpus_pipeline.near_copies(spark, spark.createDataFrame(docs, "doc_id long, text string"), "").collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == [*range(40), 100, 101] and len(got) == 43


def test_written_tables_free_what_the_driver_held(spark, monkeypatch):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    monkeypatch.setattr(common, "_tidied", [float("-inf")])
    before = whole()
    common.materialize(spark.range(3), "tidy")
    once = whole()
    common.materialize(spark.range(3), "tidy")
    assert before < once == whole()  # and not again at once
