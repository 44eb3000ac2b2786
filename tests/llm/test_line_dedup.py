import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

from provenant.llm import edit, similar
from provenant.llm import line_dedup as ld
from tests.llm.test_simhash import plain_components

SCHEMA = "doc_id long, text string, key string, lines int"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def within(pairs):
    a, b, limit = zip(*pairs)
    return edit.edit_within([edit.points(x) for x in a], [edit.points(x) for x in b], np.array(limit)).tolist()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text("abc", max_size=12), st.text("abc", max_size=12), st.integers(0, 12)), min_size=1, max_size=80))
def test_edit_within(pairs):
    assert within(pairs) == [distance(a, b) <= k for a, b, k in pairs]


def test_edit_within_of_long_texts():
    rng = random.Random(3)
    pairs = []
    for n in [250] * 40 + [700] * 30:
        a = rng.choices("abcdé王", k=n)
        b = list(a)
        for _ in range(rng.randint(0, n // 5)):
            i = rng.randrange(len(b))
            b[i : i + rng.randint(0, 1)] = rng.choices("abcd", k=rng.randint(0, 1))
        d = distance(a, b)
        pairs.append(("".join(a), "".join(b), max(0, d + rng.randint(-1, 1))))
    assert within(pairs) == [distance(a, b) <= k for a, b, k in pairs]


def brute(rows, similarity=0.9, fuzzy=True):
    """Every pair of distinct lines compared."""
    lines = {}
    for i, t, *_ in rows:
        for k, line in enumerate(ld.normalized_lines(t or "")):
            if line:
                lines.setdefault(line, []).append((i, k))
    names = list(lines)
    links = []
    for a in names if fuzzy else ():
        for b in names:
            p, q = a.decode(), b.decode()
            limit = int((1 - similarity) * max(len(p), len(q)) + 1e-9)
            if a < b and abs(len(p) - len(q)) <= limit and distance(p, q) <= limit:
                links.append((a, b))
    group = plain_components(names, links)
    first = {}
    for x in names:
        first[group[x]] = min(first.get(group[x], (1e18, 0)), min(lines[x]))
    out = {}
    for i, t, *_ in rows:
        if t is None:
            out[i] = None
            continue
        keep = []
        for k, (raw, line) in enumerate(zip(t.split("\n"), ld.normalized_lines(t))):
            if not line or first[group[line]] == (i, k):
                keep.append(raw)
        out[i] = "\n".join(keep)
    return out, links


def test_equals_brute_force(spark, monkeypatch):
    """With every line in one group of candidates, what is dropped is what a plain comparison of all pairs drops."""
    rng = random.Random(6)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(400)]
    pool = [" ".join(rng.choices(vocab, k=rng.randint(1, 20))) for _ in range(50)]

    def line():
        s = rng.choice(pool)
        if rng.random() < 0.4:
            w = s.split()
            w[rng.randrange(len(w))] = rng.choice(vocab)
            s = " ".join(w)
        return rng.choice([s, s.upper(), s + "!!", "  " + s, ""]) if rng.random() < 0.5 else s + f" {rng.randint(0, 9)}"

    rows = [(i, "\n".join(line() for _ in range(rng.randint(0, 4))), "k", 1) for i in range(80)]
    rows += [(500, None, "k", 1), (501, "", None, None), (502, "...\n\n---", "k", 1), (503, "Long Line " * 30_000, "k", 1)]
    want, links = brute([r for r in rows if r[0] != 503])
    assert len(links) > 10
    monkeypatch.setattr(ld, "candidate_groups", lambda items, *_: items.selectExpr("1L as root", "0 as band", "h").distinct())
    out = ld.dedup_lines(spark.createDataFrame(rows, SCHEMA), max_bits=64, max_far=64, counts=("n_lines", "n_kept")).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r.text for r in out}
    assert got.pop(503) == rows[-1][1]
    assert got == want
    for r in out:
        assert r.n_kept <= r.n_lines
        if r.text:
            assert r.n_kept == len(r.text.split("\n"))


def test_recall_against_brute_force(spark):
    """Of the pairs of lines of edit similarity 0.9 and more, nine in ten at least are to be compared."""
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()
    lines = sorted({x for t in texts for x in ld.normalized_lines(t or "") if 9 <= len(x.decode()) <= 400}, key=lambda x: (len(x), x))
    points = [edit.points(x.decode()) for x in lines]
    size = np.array([len(x) for x in points])
    letters = np.stack([np.bincount(x & 63, minlength=64) for x in points])
    a, b = [], []
    for x in range(0, len(lines), 3):
        y = np.arange(x + 1, np.searchsorted(size, size[x] / 0.9 + 1e-6, side="right"))
        y = y[np.abs(letters[y] - letters[x]).sum(axis=1) <= 2 * (0.1 * size[y] + 1e-9).astype(int)]
        a += [x] * len(y)
        b += y.tolist()
    near = edit.edit_within([points[k] for k in a], [points[k] for k in b], (0.1 * size[b] + 1e-9).astype(int))
    pairs = [(lines[x], lines[y]) for x, y, n in zip(a, b, near) if n]
    assert len(pairs) > 30
    masked = [x.translate(ld._AS_ZERO) for x in lines]
    fp, roots = similar.gram_marks(masked)
    every = [set(r) | set(ld.half_roots(x.decode()) if len(x) < ld.HALVED else ()) for r, x in zip(roots.tolist(), masked)]
    place = {x: k for k, x in enumerate(lines)}
    found = 0
    for p, q in pairs:
        far = int(fp[place[p]] ^ fp[place[q]]).bit_count()
        found += far <= 3 or far <= 15 and bool(every[place[p]] & every[place[q]])
    assert found >= 0.9 * len(pairs)


def test_one_edit_is_always_a_candidate():
    """Whatever the length, lines that are one edit apart share a half."""
    rng = random.Random(2)
    for n in range(9, 40):
        a = "".join(rng.choices("abcdefgh", k=n))
        for k in range(n):
            for b in (a[:k] + "z" + a[k + 1 :], a[:k] + a[k + 1 :], a[:k] + "z" + a[k:]):
                assert set(ld.half_roots(a)) & set(ld.half_roots(b))


def test_large_groups_are_cut(spark):
    rng = random.Random(1)
    base = [f"word{i}" for i in range(60)]
    lines = []
    for i in range(80):
        w = list(base)
        w[rng.randrange(60)] = f"x{i}"
        lines.append(" ".join(w))
    df = spark.createDataFrame([(7, 0, i, 0, [i], x) for i, x in enumerate(lines)], "root long, band int, h long, fp long, roots array<long>, line string")
    for capacity in (10, 4096):
        links = [(r.src, r.dst) for r in similar.compared(df, "line", ld.similar_lines(0.9), 3, 15, capacity).collect()]
        assert set(plain_components(range(80), links).values()) == {0}


def test_repeated_rows_and_clashing_names(spark):
    """Of rows alike in id and text one keeps its lines; columns may have the names of helpers."""
    schema = "doc_id long, text string, line_key int, LINE_DROP string, spot int, number int"
    rows = [(1, "a b c\nd e\n--", 5, "x", 1, 2), (1, "a b c\nd e\n--", 6, "y", 1, 2), (1, "a b c\nf g", 7, "z", 1, 2), (None, "d e", 8, None, 1, 2)]
    got = ld.dedup_lines(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r.line_key for r in got) == [5, 6, 7, 8] and {r.LINE_DROP for r in got} == {"x", "y", "z", None}
    assert Counter(x for r in got for x in r.text.split("\n") if x) == Counter(["a b c", "d e", "f g", "--", "--"])
    assert ld.dedup_lines(spark.createDataFrame([], schema)).count() == 0


def test_short_lines_digits_and_word_borders(spark):
    rows = [(1, "Short line one ok\nRoom 101 opens at 10\none two three four five six seven eight"), (2, "Short line one okk\nRoom 999 opens at 99\none two three four five six seveneight")]
    got = {r.doc_id: r.text for r in ld.op2_line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1] and got[2] == "Room 999 opens at 99"


def test_one_changed_letter_is_found(spark):
    """Of similar lines few are within some bits of SimHash; nearly all are to be linked."""
    rng = random.Random(12)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(400)]
    lines = [" ".join(rng.choices(vocab, k=rng.randint(8, 31))) for _ in range(100)]
    changed = []
    for s in lines:
        k = rng.choice([k for k, x in enumerate(s) if x != " "])
        changed.append(s[:k] + "z" + s[k + 1 :])
    docs = spark.createDataFrame([(1, "\n".join(lines), "k", 1), (2, "\n".join(changed), "k", 1)], SCHEMA)
    got = {r.doc_id: r.n_kept for r in ld.op2_line_dedup(docs).collect()}
    assert got[1] == 100 and got[2] <= 1


def test_items_of_one_fingerprint_meet(spark):
    """Two items that share a fingerprint and no root are compared; planes part the counters evenly."""
    items = spark.createDataFrame([(1, 77, [10]), (2, 77, [11]), (3, -77, [12]), (3, -77, [12])], "h long, fp long, roots array<long>")
    groups: dict[int, set[int]] = {}
    for r in similar.candidate_groups(items, 3, 15).collect():
        groups.setdefault(r["root"], set()).add(r["h"])
    assert [g for g in groups.values() if len(g) > 1] == [{1, 2}]
    assert not similar._PLANES.sum(axis=0).any()


def exchanged(plan, name):
    """How often a column is dealt out anew in a physical plan."""
    here = "Exchange" in plan.nodeName() and f"{name}#" in plan.output().mkString(" ")
    below = plan.children()
    return here + sum(exchanged(below.apply(k), name) for k in range(below.size()))


def test_lines_travel_to_their_key_and_their_blocks_only(spark):
    """Candidates are dealt into blocks without their lines; the links are those of rows that hold them."""
    rng = random.Random(4)
    lines = ["".join(rng.choices("abcdefgh ", k=60)) for _ in range(12)]
    lines += [x[:k] + "z" + x[k + 1 :] for k, x in enumerate(lines)]
    items = spark.createDataFrame([(i, 0, [i], x) for i, x in enumerate(lines)], "h long, fp long, roots array<long>, line string")
    met = spark.createDataFrame([(r, 0, i) for r in (1, 2) for i in range(len(lines)) if r == 1 or i % 12 < 5], "root long, band int, h long")
    before = [spark.conf.get(x) for x in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links = similar.compared(met, "line", ld.similar_lines(0.9), 3, 15, 10, items=items)
        assert exchanged(links._jdf.queryExecution().executedPlan(), "line") == 2
        got = [(r.src, r.dst) for r in links.collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[1])
    want = [(r.src, r.dst) for r in similar.compared(met.join(items, "h"), "line", ld.similar_lines(0.9), 3, 15, 10).collect()]
    assert len(got) >= 12 and plain_components(range(24), got) == plain_components(range(24), want)


def test_lines_of_other_lengths_are_no_candidates(spark):
    """Items that share a root are told when one of them at least is long enough for another; a size may be very large."""
    sizes = {1: 100, 2: 90, 3: 89, 4: 50, 5: 10**8, 6: 2**31 - 1}
    rows = [(1, 0, [7]), (2, 1, [7]), (3, 0, [8]), (4, 0, [8]), (5, 0, [9]), (6, 0, [9]), (1, 0, [10]), (3, 0, [10])]
    items = spark.createDataFrame([(h, fp, sizes[h], roots) for h, fp, roots in rows], "h long, fp long, size int, roots array<long>")
    groups: dict[int, list[tuple[int, int]]] = {}
    for r in similar.candidate_groups(items.where("fp = 0 or h = 2"), 0, 15, 0.9).where("band <> 99").collect():
        groups.setdefault(r["root"], []).append((r["h"], r["band"]))
    assert sorted(sorted(g) for g in groups.values()) == [[(1, 0), (2, 0)], [(5, 0), (6, 0)]]


def test_lines_are_normalised_as_before():
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choices("a Bé-\t\n\r\v\f\x1c\x85 İ.", k=rng.randint(0, 40)))
        assert ld.normalized_lines(text) == [b" ".join(x.split()) for x in text.lower().encode().translate(None, ld._MARKS).split(b"\n")]


def test_a_short_difference_needs_no_table(monkeypatch):
    """Between equal heads and tails, what is left can be replaced within the limit."""
    monkeypatch.setattr(edit, "_banded", None)
    monkeypatch.setattr(edit, "_one", None)
    a = "one line of some words that stays as it is"
    assert within([(a, a.replace("some", "zz"), 4), (a, a, 0), (a, a + "!", 1), ("", "ab", 2), ("aaa", "aa", 1)] * 30) == [True] * 150
