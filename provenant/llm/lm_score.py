"""Documents scored by masked pseudo-likelihood under a bidirectional window network, in numpy.

Every token is predicted from two words on either side: the network gives the
probability of its class, the counts of all words that of the word in its
class. A class has two digits, so a prediction is two softmaxes, exactly
normalised over all classes. The network is fitted to the windows of all
tokens of the corpus, each once, by local steps in each partition whose
parameters are averaged after every round.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import column, materialize, text_bytes

DIGIT = 32
CLASSES = DIGIT * DIGIT
#: Classes of a single word, the most frequent; the others are shared by words of equal hash.
OWN = 3 * CLASSES // 4
#: Words at most whose counts every task knows; the counts of the others are joined.
COMMON = 65_536
SIDES = (-2, -1, 1, 2)
HIDDEN = 16
EDGE = CLASSES  # stands before the first and after the last word
#: Tokens scored, words remembered and windows shuffled at once.
CHUNK, KNOWN, BLOCK = 8_192, 300_000, 16_384
#: Half an occurrence more for every word of a class, and for one that was never seen.
ADDED = 0.5
_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - 2**63


@dataclass(frozen=True)
class Vocabulary:
    """Hashes of the common words, the most frequent first, their log share of their class, and each class's words and occurrences."""

    common: np.ndarray
    log_share: np.ndarray
    class_counts: np.ndarray
    class_words: np.ndarray

    def classes(self) -> np.ndarray:
        """Class of every code: a common word's place, or len(common) plus the class of a rare word."""
        own = np.arange(len(self.common))
        return np.concatenate([np.where(own < OWN, own, shared_class(self.common)), np.arange(CLASSES)])


def shared_class(h: np.ndarray) -> np.ndarray:
    return OWN + h % (CLASSES - OWN)


class Codes(dict):
    """word -> code; remembers a bounded number of words."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.place = {int(h): k for k, h in enumerate(vocabulary.common)}

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        h = word_hash(word)
        value = self[word] = self.place.get(h, len(self.place) + OWN + h % (CLASSES - OWN))
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int32, count=len(words))


def word_counts(documents: DataFrame) -> DataFrame:
    """h, n: how often each word stands in all documents."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            h = np.fromiter(map(word_hash, count), dtype=np.int64, count=len(count))
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(list(count.values()), pa.int64())], names=["h", "n"])

        count: Counter = Counter()
        for batch in batches:
            for text in text_bytes(batch):
                count.update(words_of(text))
                if len(count) >= KNOWN:
                    yield made()
                    count.clear()
        yield made()

    return documents.select("text").mapInArrow(of, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


@dataclass
class Network:
    """Parameters: what each side's word adds to the hidden layer, and the two output layers."""

    side: np.ndarray  # 4, CLASSES + 1, HIDDEN
    hidden: np.ndarray  # HIDDEN
    high: np.ndarray  # DIGIT, HIDDEN
    high_bias: np.ndarray  # DIGIT
    given: np.ndarray  # DIGIT, HIDDEN: what the first digit adds for the second
    low: np.ndarray  # DIGIT, HIDDEN
    low_bias: np.ndarray  # DIGIT, DIGIT

    @classmethod
    def start(cls, class_counts: np.ndarray, seed: int = 5) -> Network:
        """Small random weights; biases that predict each class as often as it occurs."""
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.05, shape).astype(np.float32)
        share = (class_counts + 0.1).reshape(DIGIT, DIGIT)
        high = share.sum(axis=1)
        return cls(
            draw(len(SIDES), CLASSES + 1, HIDDEN), np.zeros(HIDDEN, np.float32), draw(DIGIT, HIDDEN), np.log(high / high.sum()).astype(np.float32),
            draw(DIGIT, HIDDEN), draw(DIGIT, HIDDEN), np.log(share / high[:, None]).astype(np.float32),
        )

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, f.name).reshape(-1) for f in fields(self)])

    def like(self, flat: np.ndarray) -> Network:
        parts, at = [], 0
        for f in fields(self):
            mine = getattr(self, f.name)
            parts.append(flat[at : at + mine.size].reshape(mine.shape).astype(np.float32))
            at += mine.size
        return Network(*parts)

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log p(target | context) of windows: context (n, 4), target (n)."""
        first, second = np.divmod(target, DIGIT)
        a = self.hidden + self.side[0, context[:, 0]]
        for k in range(1, len(SIDES)):
            a += self.side[k, context[:, k]]
        row = np.arange(len(target))
        one = np.tanh(a) @ self.high.T + self.high_bias
        two = np.tanh(a + self.given[first]) @ self.low.T + self.low_bias[first]
        value = one[row, first] + two[row, second]
        return value - np.log(_sums(one)[1] * _sums(two)[1].astype(np.float64))

    def gradient(self, context: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the negative log-likelihood, summed over windows."""
        first, second = np.divmod(target, DIGIT)
        row = np.arange(len(target))
        a = self.hidden + self.side[0, context[:, 0]]
        for k in range(1, len(SIDES)):
            a += self.side[k, context[:, k]]
        h, h2 = np.tanh(a), np.tanh(a + self.given[first])
        e1 = _softmax(h @ self.high.T + self.high_bias)
        e1[row, first] -= 1
        e2 = _softmax(h2 @ self.low.T + self.low_bias[first])
        e2[row, second] -= 1
        which = np.zeros((len(target), DIGIT), dtype=a.dtype)
        which[row, first] = 1
        da2, da = e2 @ self.low, e1 @ self.high
        da2 -= da2 * h2 * h2
        da -= da * h * h
        da += da2
        # each side's word gets the whole of da
        unit, weights = np.arange(HIDDEN), da.reshape(-1).astype(np.float64)
        side = np.empty_like(self.side)
        for k in range(len(SIDES)):
            at = (context[:, k].astype(np.int64) * HIDDEN)[:, None] + unit
            side[k] = np.bincount(at.reshape(-1), weights, side[k].size).reshape(-1, HIDDEN)
        return {"side": side, "hidden": da.sum(axis=0), "high": e1.T @ h, "high_bias": e1.sum(axis=0), "given": which.T @ da2, "low": e2.T @ h2, "low_bias": which.T @ e2}


def _sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of logits, in the range of single precision, and their sums by row."""
    np.clip(x, -80, 80, out=x)
    np.exp(x, out=x)
    return x, x @ np.ones(x.shape[1], dtype=x.dtype)


def _softmax(x: np.ndarray) -> np.ndarray:
    x, total = _sums(x)
    x /= total[:, None]
    return x


def fitted(net: Network, blocks: Iterator[tuple[np.ndarray, np.ndarray]], rate: float = 0.1, batch: int = 2048) -> tuple[Network, int]:
    """net after one pass of AdaGrad over blocks of windows (contexts, targets), and how many windows there were."""
    net = net.like(net.flat())
    square = {f.name: np.full(getattr(net, f.name).shape, 1e-2 * batch, dtype=np.float32) for f in fields(net)}
    rng, seen = np.random.default_rng(3), 0
    for context, target in blocks:
        order = rng.permutation(len(target))
        seen += len(order)
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            for name, g in net.gradient(context[part], target[part]).items():
                step = g * g
                square[name] += step
                np.sqrt(square[name], out=step)
                np.divide(g, step, out=step)
                step *= rate
                value = getattr(net, name)
                value -= step
    return net, seen


def windows(texts: list[np.ndarray], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(contexts, targets) of every token of texts of classes, in order, at most `most` at a time."""
    gap = np.array([EDGE, EDGE], dtype=np.int64)
    flat = np.concatenate([x for t in texts for x in (gap, t)] + [gap]).astype(np.int32)
    at = np.flatnonzero(flat != EDGE)
    for i in range(0, len(at), most):
        here = at[i : i + most]
        yield np.stack([flat[here + s] for s in SIDES], axis=1), flat[here]


@dataclass(frozen=True)
class LanguageModel:
    words: Vocabulary
    net: Network


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The common words and the classes of counts(h, n), a written table.

    Common are the most frequent, by eighths of a doubling: as many steps as
    hold COMMON words together. No task sorts the words, and what reaches the
    driver is bounded by COMMON and the number of classes.
    """
    step = F.floor(F.log2("n") * 8).alias("step")
    steps = sorted(((r["step"], r["count"]) for r in counts.groupBy(step).count().collect()), reverse=True)
    held, least = 0, None
    for k, many in steps:
        if held + many > COMMON:
            break
        held, least = held + many, k
    top = counts.where(step >= least).toPandas() if least is not None else counts.limit(0).toPandas()
    top = top.sort_values(["n", "h"], ascending=[False, True])
    h, n = top["h"].to_numpy(dtype=np.int64), top["n"].to_numpy(dtype=np.float64)
    place = np.where(np.arange(len(h)) < OWN, np.arange(len(h)), shared_class(h))
    sums, words = np.zeros(CLASSES), np.zeros(CLASSES)
    np.add.at(sums, place, n)
    np.add.at(words, place, 1)
    rare = counts.where(step < least) if least is not None else counts
    for r in rare.groupBy(F.pmod("h", F.lit(CLASSES - OWN)).alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        sums[OWN + r["k"]] += r["n"]
        words[OWN + r["k"]] += r["words"]
    # a word with a class of its own is all of it
    share = np.where(np.arange(len(h)) < OWN, 0.0, np.log((n + ADDED) / (sums + ADDED * (words + 1))[place]))
    return Vocabulary(h, share, sums, words)


def train(documents: DataFrame, counts: DataFrame, rounds: int = 3) -> LanguageModel:
    """Fit words and network to documents(doc_id, text), whose word_counts are counts, a written table.

    Counts cover all words. The documents are dealt to as many rounds as
    there are, so the windows of all tokens are used, each once.
    """
    model = LanguageModel(words := vocabulary(counts), Network.start(words.class_counts))
    for k in range(rounds):
        part = documents.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == k)
        model = LanguageModel(words, _round(part, model))
    return model


def training_blocks(batches: Iterator[pa.RecordBatch], words: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows of every token of the texts, some BLOCK at a time."""
    codes, classes = Codes(words), words.classes()
    held, size = [], 0
    for batch in batches:
        for text in text_bytes(batch):
            held.append(classes[codes.of(words_of(text))])
            size += len(held[-1])
            if size >= BLOCK:
                yield from windows(held, BLOCK)
                held, size = [], 0
    if size:
        yield from windows(held, BLOCK)


#: Pieces that the parameters are sent in, and sums that each piece is first brought down to.
PIECES, SUMS = 8, 64


def _round(documents: DataFrame, model: LanguageModel) -> Network:
    """The network after a pass in every partition, averaged by the windows each has seen."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, seen = fitted(shared.value.net, training_blocks(batches, shared.value.words))
        if seen:
            parts = [(x.astype("<f8") * seen).tobytes() for x in np.array_split(mine.flat(), PIECES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([seen] * PIECES, pa.int64()), pa.array(parts, pa.binary())], names=["piece", "seen", "part"])

    rows = documents.select("text").mapInArrow(local, "piece int, seen long, part binary")
    some = _summed(rows.withColumn("deal", F.pmod(F.xxhash64("part"), F.lit(SUMS)).cast("int")))
    parts = {r["piece"]: (r["seen"], r["part"]) for r in _summed(some.withColumn("deal", F.lit(0))).collect()}  # the parameters, once
    shared.unpersist()
    if not parts:
        return model.net
    return model.net.like(np.concatenate([np.frombuffer(parts[k][1], "<f8") / parts[k][0] for k in range(PIECES)]))


def _summed(parts: DataFrame) -> DataFrame:
    """piece, seen, part of parts(piece, deal, seen, part), added up by piece and deal; one sum is held at a time."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seen, total = None, 0, None

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([seen], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["piece", "seen", "part"])

        for batch in batches:
            for piece, deal, n, part in zip(*(column(batch, c) for c in ("piece", "deal", "seen", "part"))):
                values = np.frombuffer(part.as_py(), "<f8")
                if (piece.as_py(), deal.as_py()) != key:
                    if key is not None:
                        yield made()
                    key, seen, total = (piece.as_py(), deal.as_py()), 0, np.zeros(len(values))
                seen, total = seen + n.as_py(), total + values
        if key is not None:
            yield made()

    ordered = parts.repartition("piece", "deal").sortWithinPartitions("piece", "deal")
    return ordered.select("piece", "deal", "seen", "part").mapInArrow(of, "piece int, seen long, part binary")


def network_scores(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, mark (of the text), n_tokens, known, rare of every whole text.

    known is the sum of log p(class | both sides) over all tokens and of log
    p(word | class) over the common ones; rare tells the other words by hash,
    with how often they occur.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, net = shared.value.words, shared.value.net
        codes, classes, common = Codes(words), words.classes(), len(words.common)
        share = np.concatenate([words.log_share, np.zeros(CLASSES)])
        for batch in batches:
            n = batch.num_rows
            sizes, sums, marks = np.zeros(n, dtype=np.int64), np.zeros(n), np.zeros(n, dtype=np.int64)
            many, rare, times = np.zeros(n + 1, dtype=np.int32), [], []
            held, who, size = [], [], 0

            def add() -> None:
                row, at = np.repeat(who, [len(x) for x in held]), 0
                for context, target in windows(held, CHUNK):
                    value = net.log_probabilities(context, target).astype(np.float64)
                    np.add(sums, np.bincount(row[at : at + len(target)], value, minlength=n), out=sums)
                    at += len(target)

            for k, text in enumerate(text_bytes(batch)):
                tokens = words_of(text)
                code = codes.of(tokens)
                sizes[k], marks[k] = len(tokens), xxhash.xxh64_intdigest(text) - 2**63
                sums[k] = share[code].sum()
                few = Counter(tokens[i] for i in np.flatnonzero(code >= common))
                many[k + 1] = len(few)
                rare.extend(map(word_hash, few))
                times.extend(few.values())
                if len(tokens):
                    held.append(classes[code])
                    who.append(k)
                    size += len(tokens)
                if size >= CHUNK:
                    add()
                    held, who, size = [], [], 0
            if held:
                add()
            words_of_row = pa.StructArray.from_arrays([pa.array(rare, pa.int64()), pa.array(times, pa.int64())], names=["h", "times"])
            arrays = [column(batch, "doc_id"), pa.array(marks), pa.array(sizes), pa.array(sums), pa.ListArray.from_arrays(np.cumsum(many, dtype=np.int32), words_of_row)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "mark", "n_tokens", "known", "rare"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(of, "doc_id long, mark long, n_tokens long, known double, rare array<struct<h:long,times:long>>")


def scored(documents: DataFrame, model: LanguageModel, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, log_likelihood: the sum of log p(token | both sides) of every whole text; counts(h, n) tells how often each word occurs."""
    rows = materialize(network_scores(documents, model), "lm-scores")
    rare = rows.select("mark", "rare").where("size(rare) > 0").dropDuplicates(["mark"]).select("mark", F.inline("rare"))
    words = model.words
    k = F.pmod("h", F.lit(CLASSES - OWN)).cast("int")
    total = F.get(F.array(*[F.lit(float(x)) for x in (words.class_counts + ADDED * (words.class_words + 1))[OWN:]]), k)
    share = F.log((F.coalesce("n", F.lit(0)) + F.lit(ADDED)) / total)
    sums = rare.join(counts, "h", "left").groupBy("mark").agg(F.sum(F.col("times") * share).alias("more"))
    out = rows.drop("rare").join(sums, "mark", "left")
    return out.select("doc_id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0.0))).alias("log_likelihood"))


def op5_lm_score(documents: DataFrame) -> DataFrame:
    """doc_id, n_tokens, log_likelihood, mean_log_probability of every row of documents(doc_id, text).

    Tokens are words between white space (space, U+0009-000D), A-Z
    lower-cased. A text without tokens has log-likelihood 0 and a null mean.
    Equal texts score alike, repeated rows each. Ids may be null. Extra columns
    are ignored; an empty table gives an empty result.
    """
    counts = materialize(word_counts(documents), "lm-counts")
    out = scored(documents, train(documents, counts), counts)
    return out.withColumn("mean_log_probability", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))
