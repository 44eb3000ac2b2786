import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from provenant.llm import packing

os.environ["TOKENIZERS_PARALLELISM"] = "false"


def exact_bins(items, capacity):
    """Fewest bins, by trying everything."""
    best = [len(items)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms)}.values():
            if rooms[i] >= items[k]:
                rooms[i] -= items[k]
                go(k + 1, rooms)
                rooms[i] += items[k]
        go(k + 1, [*rooms, capacity - items[k]])

    items = sorted(items, reverse=True)
    go(0, [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=9))
def test_few_items_take_fewest_bins(items):
    counts = np.bincount(items, minlength=31)
    got = packing.bin_completion(counts, 30)
    used = Counter()
    for bin_, n in got:
        assert sum(bin_) <= 30
        for x in bin_:
            used[x] += n
    assert used == Counter(items)
    best = exact_bins(items, 30)
    assert packing.lower_bound(counts, 30) <= best
    assert sum(n for _, n in got) == best


def test_many_items_come_within_one_of_the_bound():
    rng = np.random.default_rng(5)
    counts = np.bincount(np.minimum(2048, rng.lognormal(6, 1, 200_000).astype(int) + 1), minlength=2049)
    got = packing.bin_completion(counts, 2048)
    assert sum(n for _, n in got) <= packing.lower_bound(counts, 2048) + 1


def test_placing_equals_the_tokenizer(spark):
    rng = random.Random(2)
    texts = [None, "", "a", "<|endoftext|> x", "Größe über\n\n  alles\t1234!?", "é" * 5000, "word " * 6000]
    texts += [" ".join("".join(rng.choices("abcdeé .\n", k=rng.randint(1, 9))) for _ in range(rng.randint(0, 1500))) for _ in range(60)]
    rows = [(i if i != 3 else None, t, 1, 2) for i, t in enumerate(texts)] + [(8, texts[8], 1, 2)]
    got = packing.op4_packing(spark.createDataFrame(rows, "doc_id long, text string, length int, bucket int")).collect()
    hf = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    hf.encode_special_tokens = True
    want = Counter()
    for i, t, *_ in rows:
        ids = np.array([*hf.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        over = len(ids) % 2048
        cuts = ([0] if over else []) + list(range(over, len(ids), 2048))
        for k, a in enumerate(cuts):
            part = ids[a : cuts[k + 1] if k + 1 < len(cuts) else len(ids)]
            want[(i, k, a, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    counts = np.bincount([r.length for r in got], minlength=2049)
    assert len(bins) == sum(n for _, n in packing.bin_completion(counts, 2048))


def test_sequences_hold_the_ids(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_ROWS", 3)
    docs = spark.createDataFrame([(i, "ab cd " * i) for i in range(30)], "doc_id long, text string")
    got = packing.packed_sequences(docs, 64).collect()
    enc = packing.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    want = Counter(x for i in range(30) for x in [*enc.encode_ordinary("ab cd " * i), 0])
    assert Counter(x for r in got for x in r.ids) == want
    assert all(len(r.ids) <= 64 for r in got)


def test_empty(spark):
    assert packing.op4_packing(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_added_tokens_are_those_of_the_tokenizer(spark):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a<|endoftext|>b", "<|endoftext|><|endoftext|>", " x <|endoftext|> y\n", "<|endoftext|", "", "  <|endoftext|>  "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in packing.tokenized_pieces(docs, 2048, with_ids=True).collect()}
    assert got == {k: [*plain.encode(x, add_special_tokens=False).ids, 0] for k, x in enumerate(texts)}
