"""Subword lattice language model (operator 6)."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, text_chunks, written

LOG10 = float(np.log(10))
#: Distinct words that a task counts before it hands them on.
COUNTED = 200_000
#: Bytes of text after which it does so at the latest.
COUNTED_BYTES = 1 << 26
#: Most frequent words that documents look up without a shuffle; all other words are joined.
HEAD = 100_000
#: Bytes of such a word at most, so that their table is bounded by bytes too.
HEAD_BYTES = 64
#: Text bytes whose words are looked up at once.
LOOKED_UP = 1 << 21
#: Factors of the vocabulary's scores that are tried on the training words; the likeliest is taken.
SCALES = (0.8, 1.0, 1.25)
#: Steps of expectation maximisation after the vocabulary's own scores.
STEPS = 2
#: Pieces that each piece has been seen as beforehand, so that none is impossible.
SEEN = 0.1
#: Words of one length below which each is scored by itself and not beside the others.
FEW = 10
_odd = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces that can be part of a word, as bytes with a space for the space mark, and the vocabulary's own scores for them.

    A unigram model's scores are log probabilities and are taken as they are. Those of a merge vocabulary are ranks (0, -1,
    -2, ...), which stand for a frequency by Zipf's law: the score of a piece is the log of 1 / (rank + 10). Single bytes
    are pieces too, a hundredth as likely as the last piece where the vocabulary doesn't list them.
    """
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [(lib.id_to_piece(i).replace("▁", " "), lib.get_score(i)) for i in range(lib.get_piece_size()) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
    own = [(p, s) for p, s in own if " " not in p[1:]]
    ranks = all(s == int(s) for _, s in own)
    scores = {p.encode(): -float(np.log(10 - s)) if ranks else s for p, s in own}
    low = min(scores.values(), default=0.0) - float(np.log(100))
    for b in range(256):
        scores.setdefault(bytes([b]), low)
    pieces = sorted(scores)
    return pieces, np.array([scores[x] for x in pieces])


def weights(scores: np.ndarray, scale: float, end: float) -> np.ndarray:
    """Log probabilities of the pieces: the scaled scores, made to sum to what the probability of an end leaves."""
    x = scores * scale
    top = x.max()
    return x - top - np.log(np.exp(x - top).sum()) + np.log1p(-end)


@dataclass
class Lattice:
    """Finds pieces by a hash of their bytes. logp: natural logs of their probabilities, a row for each law that is tried."""

    pieces: list[bytes]
    logp: np.ndarray

    def __post_init__(self):
        self.logp = np.atleast_2d(self.logp)
        self.laws_of = self.logp.T.tolist()
        self.most = max(map(len, self.pieces))
        self.at = {p: i for i, p in enumerate(self.pieces)}
        self.starts = {p[:k] for p in self.pieces for k in range(1, len(p) + 1)}
        # Starts of pieces: a table for two bytes, hashes for more; each tells the piece's id, or -1 if it is only a start.
        self.single = np.array([self.at.get(bytes([b]), -1) for b in range(256)])
        self.double, self.alive = np.full(1 << 16, -1), np.zeros(1 << 16, bool)
        for x in self.starts:
            if len(x) == 2:
                self.double[x[0] << 8 | x[1]], self.alive[x[0] << 8 | x[1]] = self.at.get(x, -1), True
        longer = [x for x in self.starts if len(x) > 2]
        hashes = self._hashes(longer)
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], np.array([self.at.get(longer[i], -1) for i in order], np.int64)
        assert len(np.unique(self.keys)) == len(self.keys)
        self.there = np.zeros(1 << 20, bool)
        self.there[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros(len(words), np.uint64)
        for n in {len(w) for w in words}:
            at = [i for i, w in enumerate(words) if len(w) == n]
            data = np.frombuffer(b"".join(words[i] for i in at), np.uint8).reshape(-1, n).astype(np.uint64)
            h = np.zeros(len(at), np.uint64)
            for j in range(n):
                h = h * _odd + data[:, j] + np.uint64(1)
            out[at] = mix64(h, n)
        return out

    def edges(self, block: np.ndarray) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For each end in words of equal length (rows of bytes): (length, rows, piece ids) of the pieces that end there.
        From each place on, only the words go on whose bytes so far begin some piece."""
        n = block.shape[1]
        ends: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(n + 1)]
        columns = np.ascontiguousarray(block.T)
        every = np.arange(len(block))

        def add(end: int, size: int, rows: np.ndarray, ids: np.ndarray) -> None:
            own = np.flatnonzero(ids >= 0)
            if len(own):
                ends[end].append((size, rows[own], ids[own]))

        for i in range(n):
            add(i + 1, 1, every, self.single[columns[i]])
            if i + 1 == n:
                break
            two = columns[i].astype(np.int64) << 8 | columns[i + 1]
            rows = np.flatnonzero(self.alive[two])
            add(i + 2, 2, rows, self.double[two[rows]])
            h = (columns[i][rows].astype(np.uint64) + np.uint64(1)) * _odd + columns[i + 1][rows] + np.uint64(1)
            for j in range(i + 2, min(n, i + self.most)):
                h = h * _odd + columns[j][rows] + np.uint64(1)
                key = mix64(h, j + 1 - i)
                near = np.flatnonzero(self.there[(key >> np.uint64(44)).astype(np.int64)])
                key = key[near]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                ok = self.keys[at] == key
                rows, h = rows[near[ok]], h[near[ok]]
                if not len(rows):
                    break
                add(j + 1, j + 1 - i, rows, self.ids[at[ok]])
        return ends

    def forward(self, block: np.ndarray, ends, law: int, count: bool = True) -> tuple[np.ndarray, np.ndarray | float]:
        """For each word: the log of the summed probability of all segmentations under a law, and the expected number of
        pieces (0 unless they are to be counted)."""
        n, logp = block.shape[1], self.logp[law]
        alpha, used = np.zeros((n + 1, len(block))), np.zeros((n + 1, len(block) if count else 0))
        for j in range(1, n + 1):
            terms = [alpha[j - size][rows] + logp[ids] for size, rows, ids in ends[j]]
            top, total = np.full(len(block), -np.inf), np.zeros(len(block))
            for (_, rows, _), term in zip(ends[j], terms, strict=True):
                top[rows] = np.maximum(top[rows], term)
            for (size, rows, _), term in zip(ends[j], terms, strict=True):
                share = np.exp(term - top[rows])
                total[rows] += share
                if count:
                    used[j][rows] += share * used[j - size][rows]
            alpha[j] = top + np.log(total)
            if count:
                used[j] = used[j] / total + 1
        return alpha[-1], used[-1] if count else 0.0

    def forward_one(self, word: bytes) -> tuple[list[float], list[float]]:
        """forward() of one word under each law, for words that are long or alone in their length: a lookup for each piece there is."""
        out, n = ([], []), len(word)
        found: list[list[tuple[int, list[float]]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            for j in range(i + 1, min(n, i + self.most) + 1):
                piece = word[i:j]
                if piece not in self.starts:
                    break
                if (at := self.at.get(piece)) is not None:
                    found[j].append((i, self.laws_of[at]))
        for law in range(len(self.logp)):
            alpha, used = [0.0] * (n + 1), [0.0] * (n + 1)
            for j in range(1, n + 1):
                terms = [alpha[i] + p[law] for i, p in found[j]]
                top = max(terms)
                shares = [math.exp(t - top) for t in terms]
                total = sum(shares)
                alpha[j] = top + math.log(total)
                used[j] = sum(x * used[i] for x, (i, _) in zip(shares, found[j], strict=True)) / total + 1
            out[0].append(alpha[n])
            out[1].append(used[n])
        return out

    def word_logp(self, words: list[bytes], count: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(laws x words) log probability of each word over all its segmentations, and its expected number of pieces."""
        logp, used = np.zeros((len(self.logp), len(words))), np.zeros((len(self.logp), len(words)))
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(order) else []:
            n = int(size[own[0]]) + 1  # each word is led by a space
            if len(own) < FEW:
                for i in own:
                    logp[:, i], used[:, i] = self.forward_one(b" " + words[i])
                continue
            step = min(1 << 13, max(FEW, (1 << 20) // n))
            for lo in range(0, len(own), step):
                at = own[lo : lo + step]
                block = np.frombuffer(b"".join(b" " + words[i] for i in at), np.uint8).reshape(len(at), n)
                ends = self.edges(block)
                for law in range(len(self.logp)):
                    logp[law, at], used[law, at] = self.forward(block, ends, law, count)
        return logp, used


    def _backward(self, block: np.ndarray, ends, total: np.ndarray) -> None:
        """Adds to `total`, by piece, the expected uses in words of equal length over all their segmentations, under the first law."""
        n, logp = block.shape[1], self.logp[0]
        alpha, beta = np.zeros((n + 1, len(block))), np.full((n + 1, len(block)), -np.inf)
        for j in range(1, n + 1):
            top = np.full(len(block), -np.inf)
            terms = [alpha[j - size][rows] + logp[ids] for size, rows, ids in ends[j]]
            for (_, rows, _), term in zip(ends[j], terms, strict=True):
                top[rows] = np.maximum(top[rows], term)
            share = np.zeros(len(block))
            for (_, rows, _), term in zip(ends[j], terms, strict=True):
                share[rows] += np.exp(term - top[rows])
            alpha[j] = top + np.log(share)
        beta[n] = 0
        for j in range(n, 0, -1):
            after = beta[j] - alpha[n]
            for size, rows, ids in ends[j]:
                term = logp[ids] + beta[j][rows]
                beta[j - size][rows] = np.logaddexp(beta[j - size][rows], term)
                np.add.at(total, ids, np.exp(alpha[j - size][rows] + logp[ids] + after[rows]))

    def _backward_one(self, word: bytes, total: np.ndarray) -> None:
        """_backward() of one word that is long or alone in its length."""
        n = len(word)
        found: list[list[tuple[int, int, float]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            for j in range(i + 1, min(n, i + self.most) + 1):
                piece = word[i:j]
                if piece not in self.starts:
                    break
                if (at := self.at.get(piece)) is not None:
                    found[j].append((i, at, self.laws_of[at][0]))
        alpha, beta = [0.0] * (n + 1), [-math.inf] * n + [0.0]
        for j in range(1, n + 1):
            terms = [alpha[i] + p for i, _, p in found[j]]
            top = max(terms)
            alpha[j] = top + math.log(sum(math.exp(t - top) for t in terms))
        for j in range(n, 0, -1):
            for i, at, p in found[j]:
                term = p + beta[j]
                high, low = max(beta[i], term), min(beta[i], term)
                beta[i] = high + math.log1p(math.exp(low - high)) if high > -math.inf else high
                total[at] += math.exp(min(0.0, alpha[i] + term - alpha[n]))

    def expected(self, words: list[bytes]) -> np.ndarray:
        """By piece, its expected number of uses in the words, each taken once, over all their segmentations."""
        total = np.zeros(len(self.pieces))
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(order) else []:
            n = int(size[own[0]]) + 1
            if len(own) < FEW:
                for i in own:
                    self._backward_one(b" " + words[i], total)
                continue
            step = min(1 << 13, max(FEW, (1 << 20) // n))
            for lo in range(0, len(own), step):
                at = own[lo : lo + step]
                block = np.frombuffer(b"".join(b" " + words[i] for i in at), np.uint8).reshape(len(at), n)
                self._backward(block, self.edges(block), total)
        return total


def word_counts(docs: DataFrame, train: Column, text_col: str) -> DataFrame:
    """(word, c): each distinct word of all rows and its count in the training rows (0 if it is in others only)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Counter[bytes] = Counter()
        other: set[bytes] = set()
        held = 0

        def out() -> pa.RecordBatch:
            rest = other - known.keys()
            words, counts = [*known, *rest], [*known.values(), *([0] * len(rest))]
            known.clear()
            other.clear()
            return pa.record_batch([pa.array(words, pa.binary()), pa.array(counts, pa.int64())], ["word", "c"])

        for b in batches:
            for text, learn in zip(b.column("text").cast(pa.binary()), b.column("train").to_pylist(), strict=True):
                text = text.as_py() or b""
                (known if learn else other).update(words_of(text))
                held += len(text)
                if len(known) + len(other) >= COUNTED or held >= COUNTED_BYTES:
                    yield out()
                    held = 0
        yield out()

    rows = docs.select(F.col(text_col).alias("text"), train.alias("train"))
    return rows.mapInArrow(counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def fit(words: DataFrame, end_count: int, model: str, scales: tuple[float, ...] = SCALES) -> tuple[list[bytes], np.ndarray, float]:
    """(pieces, log probabilities, log probability of an end): the vocabulary's own scores, by the factor under which the training words are
    likeliest, beside an end whose probability is its share of all pieces and ends in the training rows.

    One pass over all distinct words scores them under every factor; two sums for each factor reach the driver.
    """
    pieces, scores = vocabulary(model)
    laws = np.stack([weights(scores, s, 0.0) for s in scales])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, total = Lattice(pieces, laws), np.zeros((2, len(scales)))
        for b in batches:
            c = b.column("c").to_numpy()
            total += [x @ c for x in lattice.word_logp(b.column("word").to_pylist())]
        yield pa.record_batch([pa.array(np.arange(len(scales))), pa.array(total[0]), pa.array(total[1])], ["law", "logp", "pieces"])

    found = {r["law"]: r for r in words.filter("c > 0").mapInArrow(sums, "law long, logp double, pieces double").groupBy("law").agg(F.sum("logp").alias("logp"), F.sum("pieces").alias("pieces")).collect()}
    best = max(range(len(scales)), key=lambda k: (found[k]["logp"], -k) if k in found else (0.0, -abs(scales[k] - 1)))
    used = found[best]["pieces"] if found else 0.0
    end = (end_count + 1) / (end_count + used + 2)
    return pieces, weights(scores, scales[best], end), float(np.log(end))


def learn(words: DataFrame, pieces: list[bytes], logp: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Log probabilities of the pieces after some steps of expectation maximisation over the distinct training words.

    Each word counts once: the pieces stand in for words that aren't known, which are like the seldom ones. A step is a
    pass over the words; sums for each piece, as many as the vocabulary has, reach the driver.
    """
    for _ in range(steps):
        now = logp

        def sums(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            lattice, total = Lattice(pieces, now), np.zeros(len(pieces))
            for b in batches:
                total += lattice.expected(b.column("word").to_pylist())
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array(at), pa.array(total[at])], ["piece", "uses"])

        found = words.filter("c > 0").mapInArrow(sums, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toArrow()
        uses = np.full(len(pieces), SEEN)
        uses[found.column("piece").to_numpy()] += found.column("uses").to_numpy()
        logp = np.log(uses / uses.sum())
    return logp


def score(docs: DataFrame, train: Column, model: str, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row.

    `score` is log10 of the text's probability under a lattice of each word: the word as a whole, if the training rows have
    it, beside all its segmentations into the vocabulary's pieces. A whole word has its count less a discount (that of
    Ney, from the words seen once and twice); what the discounts leave goes to the pieces, whose weights begin with the
    vocabulary's own scores and are learned from the distinct training words (see fit and learn). Words and the end are
    drawn one by one, so the probabilities of all texts add up to one at most. `base_score` is the add-half word unigram of the same training rows. Counts, vocabulary and lattice scores
    are tables over all distinct words; a document's words among the `head` most frequent of up to HEAD_BYTES (a bounded broadcast) are
    added up where it is read, and all its others are joined to the table.

    Words: A to Z in lower case, split at space and bytes 9 to 13; one end is added and counted as a token. Null and
    empty texts have the end alone. Without training rows every count is 0. Repeated rows give a row each.
    """
    spark = docs.sparkSession
    train = F.coalesce(train, F.lit(False))
    counts = written(word_counts(docs, train, text_col), "words")
    ends = docs.filter(train).count()
    sums = counts.filter("c > 0").agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).first()
    n, v = (sums["n"] or 0) + ends, sums["v"] + (ends > 0)
    of_words = sums["n"] or 0
    discount = (sums["once"] + 1) / (sums["once"] + 2 * sums["twice"] + 2)
    left = discount * sums["v"] / of_words if of_words else 1.0
    end = (ends + 1) / (n + 2)
    base = lambda c: np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    pieces, logp, _ = fit(counts, ends, model)
    logp = learn(counts, pieces, logp - np.logaddexp.reduce(logp))
    shared = spark.sparkContext.broadcast((pieces, logp))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*shared.value)
        for b in batches:
            c = b.column("c").to_numpy()
            spelt = lattice.word_logp(b.column("word").to_pylist(), count=False)[0][0] + math.log(left)
            whole = np.log(np.maximum(c - discount, 1e-300) / max(of_words, 1))
            lp = (np.where(c > 0, np.logaddexp(whole, spelt), spelt) + math.log1p(-end)) / LOG10
            yield pa.record_batch([b.column("word"), b.column("c"), pa.array(base(c)), pa.array(lp)], ["word", "c", "base", "lp"])

    words = written(counts.mapInArrow(each, "word binary, c long, base double, lp double"), "scores")
    top = words.filter(F.octet_length("word") <= HEAD_BYTES).orderBy(F.desc("c"), "word").limit(head).toArrow()
    known = {w: (int(c > 0), b, p) for w, c, b, p in zip(*(top.column(x).to_pylist() for x in ("word", "c", "base", "lp")), strict=True)}
    common = spark.sparkContext.broadcast(known)
    end_base, end_lp = float(base(ends)), math.log10(end)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row of each document, with word null, and one for each of its words that isn't common."""
        table, row = common.value, TaskContext.get().partitionId() << 33
        for b in batches:
            for part, _, _ in text_chunks(b, "text", LOOKED_UP):
                index, word, times, tokens, seen, bases, scores = [], [], [], [], [], [], []
                for i, text in enumerate(part.column("text").cast(pa.binary())):
                    all_words = words_of(text.as_py())
                    own_seen, own_base, own_lp = int(ends > 0), end_base, end_lp
                    for w, k in Counter(all_words).items():
                        if hit := table.get(w):
                            own_seen += k * hit[0]
                            own_base += k * hit[1]
                            own_lp += k * hit[2]
                        else:
                            index.append(i)
                            word.append(w)
                            times.append(k)
                    tokens.append(len(all_words) + 1)
                    seen.append(own_seen)
                    bases.append(own_base)
                    scores.append(own_lp)
                m, k = part.num_rows, len(word)
                ids = part.column("id")
                none = lambda kind: pa.nulls(k, kind)
                yield pa.RecordBatch.from_arrays([
                    pa.array(row + np.concatenate([np.arange(m), np.array(index, np.int64)])),
                    pa.concat_arrays([ids, pa.nulls(k, ids.type)]),
                    pa.concat_arrays([part.column("train"), none(pa.bool_())]),
                    pa.array([None] * m + word, pa.binary()),
                    pa.array(tokens + times, pa.int64()),
                    pa.concat_arrays([pa.array(seen, pa.int64()), none(pa.int64())]),
                    pa.concat_arrays([pa.array(bases, pa.float64()), none(pa.float64())]),
                    pa.concat_arrays([pa.array(scores, pa.float64()), none(pa.float64())]),
                ], ["row", "id", "train", "word", "n", "known", "base", "lp"])
                row += m

    rows = docs.select(F.col(id_col).alias("id"), train.alias("train"), F.col(text_col).alias("text"))
    made = written(rows.mapInArrow(parts, f"row long, id {rows.schema['id'].dataType.simpleString()}, train boolean, word binary, n long, known long, base double, lp double"), "parts")
    rare = made.filter("word IS NOT NULL").select("row", "word", "n").join(words, "word")
    rare = rare.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k"), F.sum(F.col("n") * F.col("base")).alias("b"), F.sum(F.col("n") * F.col("lp")).alias("p"))
    out = made.filter("word IS NULL").drop("word").join(rare, "row", "left")
    return out.select(
        F.col("id").alias(id_col), (~F.col("train")).alias("held_out"), F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"), (F.col("lp") + F.coalesce("p", F.lit(0.0))).alias("score"),
    )
