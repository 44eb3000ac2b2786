import random

import numpy as np
import pytest
import xxhash

from provenant.llm import hamming
from provenant.llm.components import connected_components
from provenant.llm.simhash import majority_bits, op3_simhash, simhash_dedup


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, links):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {i: root(i) for i in ids}


def test_majority_bits_matches_counting():
    rng = np.random.default_rng(1)
    for n in (1, 2, 254, 255, 256, 1000):
        h = rng.integers(0, 2**64, n, dtype=np.uint64)
        want = sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h) > n)
        assert majority_bits(h) == want


def test_op3_equals_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(50)] + ["É", "ÄB", "Q x"]
    texts = [None, "", " \t\n", "One", "one two", "Ünï CODE text here"]
    for _ in range(60):
        base = rng.choices(vocab, k=rng.randint(1, 400))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append("\n".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(i, t, 7) for i, t in zip(ids, texts)]
    fp = {i: plain_fingerprint(t) for i, t, _ in rows}
    links = [(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 3]
    want = plain_components(ids, links)
    got = op3_simhash(spark.createDataFrame(rows, "doc_id long, text string, fp int")).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fp[i]:016x}", want[i]) for i in ids}


def test_op3_empty_and_repeated(spark):
    schema = "doc_id long, text string"
    assert op3_simhash(spark.createDataFrame([], schema)).count() == 0
    got = op3_simhash(spark.createDataFrame([(2, "a b c"), (2, "a b c"), (None, "a b c")], schema)).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 2), (2, 2), (2, 2)]


def test_dedup_keeps_smallest(spark):
    docs = spark.createDataFrame([(5, "a b c d", "x"), (3, "A b c d", "y"), (9, "other words stand here", "z")], "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in simhash_dedup(docs).collect()) == [3, 9]


@pytest.mark.parametrize("capacity", [8, 16_384])
@pytest.mark.parametrize("bits", [3, 4])
def test_links_connect_as_all_pairs_do(spark, bits, capacity):
    rng = random.Random(bits)
    fps = {0, (1 << 64) - 1}
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 8)):
            fps.add(x)
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
    hot = rng.getrandbits(64)
    fps |= {hot ^ rng.getrandbits(12) for _ in range(60)}
    fps = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = [(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= bits]
    want = plain_components(fps, links)
    out = hamming.hamming_links(spark.createDataFrame([(x, x) for x in fps], "node long, fp long"), bits, capacity)
    got = {r.node: r.component for r in connected_components(out).collect()}
    assert {x: got.get(x, x) for x in fps} == want


def test_components_of_long_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, i) for i in range(1001, 1100)]
    odd = [(5000, 5000), (None, 3), (1, 0), (0, 1)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(path + star + odd, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[i] == 1000 for i in range(1000, 1100)) and 5000 not in got
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
