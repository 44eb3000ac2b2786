import random
from collections import Counter

import numpy as np

from provenant.llm import lm_score as lm

SCHEMA = "doc_id long, text string, n int, block string"


def small_net(seed=0):
    rng = np.random.default_rng(seed)
    net = lm.Network.start(rng.integers(0, 50, lm.CLASSES).astype(float))
    return net.like(rng.normal(0, 0.3, net.flat().size))


def test_probabilities_add_up_and_equal_plain_sums():
    net = small_net()
    context = np.array([[5, lm.EDGE, 17, lm.CLASSES - 96]])
    p = np.exp([net.log_probabilities(context, np.array([t]))[0] for t in range(lm.CLASSES)])
    assert abs(p.sum() - 1) < 1e-3
    a = [net.hidden[j] + sum(net.side[k, c, j] for k, c in enumerate(context[0])) for j in range(lm.HIDDEN)]
    one = [sum(np.tanh(a[j]) * net.high[d, j] for j in range(lm.HIDDEN)) + net.high_bias[d] for d in range(lm.DIGIT)]
    two = [sum(np.tanh(a[j] + net.given[3, j]) * net.low[d, j] for j in range(lm.HIDDEN)) + net.low_bias[3, d] for d in range(lm.DIGIT)]
    want = one[3] - np.log(np.exp(one).sum()) + two[9] - np.log(np.exp(two).sum())
    assert abs(net.log_probabilities(context, np.array([3 * lm.DIGIT + 9]))[0] - want) < 1e-3


def test_gradient_equals_differences():
    net = small_net(1)
    net = lm.Network(*[getattr(net, f.name).astype(np.float64) for f in lm.fields(net)])
    rng = np.random.default_rng(2)
    context, target = rng.integers(0, lm.CLASSES, (6, 4)), rng.integers(0, lm.CLASSES, 6)
    context[1] = context[0]
    dense = net.gradient(context, target)
    loss = lambda: -net.log_probabilities(context, target).sum()
    for name, g in dense.items():
        at = tuple(rng.integers(0, s) for s in g.shape)
        if name == "given":
            at = (target[0] // lm.DIGIT, at[1])
        if name == "side":
            at = (2, context[0, 2], 3)
        value = getattr(net, name)
        value[at] += 1e-5
        up = loss()
        value[at] -= 2e-5
        assert abs((up - loss()) / 2e-5 - g[at]) < 1e-4
        value[at] += 1e-5


def texts(rng, n):
    """Sentences with a strong order, so that context tells the word."""
    out = []
    for _ in range(n):
        k = rng.randrange(40)
        out.append(" ".join(f"w{(k + i) % 40}" for i in range(rng.randint(20, 60))))
    return out


def test_order_is_learned_and_rows_are_whole(spark):
    rng = random.Random(1)
    rows = [(i, t, 1, "b") for i, t in enumerate(texts(rng, 400))]
    mixed = rows[0][1].split()
    rng.shuffle(mixed)
    rows += [(1000, " ".join(mixed), 1, "b"), (1001, rows[0][1].upper(), 1, "b"), (1002, None, 1, "b"), (None, " \n", 1, "b"), (1003, "long " * 100_000, 1, "b")]
    docs = spark.createDataFrame(rows, SCHEMA)
    counts = lm.materialize(lm.word_counts(docs), "counts")
    model = lm.train(docs, counts)
    got = {r.doc_id: r for r in lm.scored(docs, model, counts).collect()}
    assert len(got) == len(rows)
    assert got[0].log_likelihood == got[1001].log_likelihood
    assert got[1000].log_likelihood < 1.5 * got[0].log_likelihood
    assert got[1002].n_tokens == got[None].n_tokens == 0 and got[1002].log_likelihood == 0
    assert got[1003].n_tokens == 100_000
    check_plain(docs, model, counts, got, {i: rows[i if i < 400 else 400][1] for i in (0, 7, 1000)})


def check_plain(docs, model, counts, got, texts):
    """Scores against sums over single tokens, from the network's probabilities of classes and the counts of all words."""
    n = {r.h: r.n for r in counts.collect()}
    place = {int(h): k for k, h in enumerate(model.words.common)}
    cls = lambda h: place[h] if place.get(h, lm.CLASSES) < lm.OWN else lm.OWN + h % (lm.CLASSES - lm.OWN)
    total, words = Counter(), Counter()
    for h, m in n.items():
        total[cls(h)] += m
        words[cls(h)] += 1
    for i, text in texts.items():
        hashes = [lm.word_hash(w.encode()) for w in text.lower().split()]
        ids = [lm.EDGE] * 2 + [cls(h) for h in hashes] + [lm.EDGE] * 2
        plain = 0.0
        for k, h in enumerate(hashes, 2):
            plain += float(model.net.log_probabilities(np.array([[ids[k - 2], ids[k - 1], ids[k + 1], ids[k + 2]]]), np.array([ids[k]]))[0])
            if place.get(h, lm.CLASSES) >= lm.OWN:
                plain += np.log((n[h] + lm.ADDED) / (total[cls(h)] + lm.ADDED * (words[cls(h)] + 1)))
        assert abs(plain - got[i].log_likelihood) < 1e-3 * abs(plain)


def test_rare_words_are_joined(spark, monkeypatch):
    """With few common words most counts come by the join; scores equal plain sums all the same."""
    monkeypatch.setattr(lm, "COMMON", 1500)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    counts = lm.materialize(lm.word_counts(docs), "counts")
    model = lm.train(docs, counts, rounds=1)
    assert lm.OWN < len(model.words.common) <= 1500 < counts.count()
    got = {r.doc_id: r for r in lm.scored(docs, model, counts).collect()}
    short = [r for r in docs.where("text is not null").orderBy("n_chars", "doc_id").limit(40).collect()][-5:]
    check_plain(docs, model, counts, got, {r.doc_id: r.text for r in short if r.text.isascii()})


def test_counts_cover_all_words(spark):
    docs = spark.createDataFrame([(1, "a b A", 0, ""), (2, "b\tc", 0, ""), (3, None, 0, "")], SCHEMA)
    got = {r.h: r.n for r in lm.word_counts(docs).collect()}
    assert got == {lm.word_hash(b"a"): 2, lm.word_hash(b"b"): 2, lm.word_hash(b"c"): 1}


def test_training_beats_word_frequencies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 10 = 0")
    counts = lm.materialize(lm.word_counts(docs), "counts")
    start, end = lm.train(docs, counts, rounds=0), lm.train(docs, counts)
    total = lambda m: lm.scored(docs, m, counts).groupBy().sum("log_likelihood").collect()[0][0]
    assert total(end) > total(start)


def test_one_step_equals_plain_gradient_descent():
    """A pass over one batch is one AdaGrad step on the summed gradient of all its windows."""
    rng = np.random.default_rng(4)
    net = small_net(3)
    context, target = rng.integers(0, lm.CLASSES, (50, 4)), rng.integers(0, lm.CLASSES, 50)
    got, seen = lm.fitted(net, [(context, target)], rate=0.1, batch=64)
    assert seen == 50
    for name, g in net.gradient(context, target).items():
        want = getattr(net, name) - 0.1 * g / np.sqrt(0.64 + g * g)
        assert np.allclose(getattr(got, name), want, atol=1e-4)


def test_edges(spark):
    assert lm.op5_lm_score(spark.createDataFrame([], SCHEMA)).count() == 0
    row = lm.op5_lm_score(spark.createDataFrame([(1, None, 0, "")], SCHEMA)).collect()[0]
    assert (row.n_tokens, row.log_likelihood, row.mean_log_probability) == (0, 0.0, None)


def test_every_token_is_trained_on(spark, monkeypatch):
    """Production's rounds have a window for each token between them, of short documents too."""
    docs = spark.createDataFrame([(1, "a b c", 0, ""), (2, " ".join(["d"] * 70), 0, ""), (3, None, 0, "")] + [(i, "e f", 0, "") for i in range(4, 30)], SCHEMA)
    counts = lm.materialize(lm.word_counts(docs), "counts")
    words, seen = lm.vocabulary(counts), []

    def count(part, model):
        batches = [lm.pa.RecordBatch.from_pylist([{"text": r.text} for r in part.collect()], lm.pa.schema([("text", lm.pa.string())]))]
        seen.append(sum(len(t) for _, t in lm.training_blocks(batches, words)))
        return model.net

    monkeypatch.setattr(lm, "_round", count)
    lm.train(docs, counts)
    assert len(seen) == 3 and sum(seen) == 73 + 52


def test_parameters_are_averaged_by_windows(spark):
    parts = [(p, d, n, np.full(3, v * n).tobytes()) for p in range(2) for d, n, v in ((0, 10, 1.0), (0, 30, 2.0), (1, 5, 4.0))]
    df = spark.createDataFrame(parts, "piece int, deal int, seen long, part binary")
    got = sorted((r.piece, r.seen, np.frombuffer(r.part).tolist()) for r in lm._summed(df).collect())
    assert got == sorted((p, n, [v] * 3) for p in range(2) for n, v in ((40, 70.0), (5, 20.0)))
