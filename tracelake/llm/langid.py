"""Language identification by rank-order profiles (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import text_chunks, unclashed

#: Most frequent n-grams of a profile.
PROFILE = 300
#: Distinct n-gram codes: three symbols of 6 bits.
CODES = 1 << 18
#: Documents that one sort handles; their number is in the key beside the code.
MOST_DOCS = 1 << 12
#: Text bytes that one sort handles; it takes about 60 bytes for each.
SORTED_BYTES = 1 << 19
#: Longer texts are counted by pieces.
LONG_BYTES = 1 << 22
UNKNOWN = "und"
#: A text is taken for a language if its score is at least this share of the median of the language's labelled texts of its length.
SHARE = 0.5
#: Labelled texts that a median needs.
LEAST_TEXTS = 20
#: Lengths are classed by their number of bits.
LENGTHS = 64
_symbols = np.zeros(256, np.uint8)
_symbols[ord("a") : ord("z") + 1] = np.arange(1, 27)
_symbols[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_symbols[128:] = 27 + np.arange(128) % 36


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, code) of the n-grams of 1 to 3 bytes of texts that lie end to end.

    A to Z count as lower case; other ASCII bytes are breaks (symbol 0); bytes from 128 on share 36 symbols. A break is
    also put around each text. An n-gram holds a break at its ends only, and not alone.
    """
    n = len(off) - 1
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(off))
    at = np.arange(len(data)) + 2 * doc + 1  # two breaks between texts
    sym, owner = np.zeros(len(data) + 2 * n + 2, np.int32), np.zeros(len(data) + 2 * n + 2, np.int32)
    sym[at], owner[at] = _symbols[data], doc
    owner[off[:-1] + 2 * np.arange(n)] = np.arange(n)  # the break before a text
    (one, two, three), codes = coded(sym)
    return np.concatenate([owner[one], owner[two], owner[three]]), codes


def coded(sym: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """(places of the n-grams of 1, 2 and 3 symbols, all codes in this order), as far as three symbols reach from the place."""
    a, b, c = sym[:-2], sym[1:-1], sym[2:]
    one, two, three = np.flatnonzero(a), np.flatnonzero(a | b), np.flatnonzero(b)
    codes = np.concatenate([a[one], a[two] << 6 | b[two], a[three] << 12 | b[three] << 6 | c[three]])
    codes[len(one) : len(one) + len(two)] |= 63 << 12  # no symbol is 63: apart from the n-grams of other lengths
    return (one, two, three), codes


def gram_counts(data: np.ndarray) -> np.ndarray:
    """How often each n-gram code occurs in one text, counted SORTED_BYTES places at a time: for long texts."""
    sym, total = np.zeros(len(data) + 4, np.uint8), np.zeros(CODES, np.int64)
    sym[1 : len(data) + 1] = _symbols[data]
    for lo in range(0, len(sym) - 2, SORTED_BYTES):
        total += np.bincount(coded(sym[lo : lo + SORTED_BYTES + 2].astype(np.int32))[1], minlength=CODES)
    return total


def ranked(docs: np.ndarray, codes: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, code, rank) of the most frequent n-grams of each document; ties by code."""
    key, count = np.unique((docs.astype(np.int64) << 18 | codes).astype(np.int32 if n <= MOST_DOCS else np.int64), return_counts=True)
    key = key.astype(np.int64)
    order = np.sort((key >> 18) << 49 | (np.int64((1 << 31) - 1) - count) << 18 | (key & (CODES - 1)))
    doc = order >> 49
    rank = np.arange(len(order)) - np.searchsorted(doc, np.arange(n))[doc]
    keep = rank < most
    return doc[keep], order[keep] & (CODES - 1), rank[keep]


@dataclass
class Profiles:
    """The ranks of each language's most frequent n-grams; languages in order."""

    languages: list[str]
    ranks: np.ndarray  # languages x CODES, PROFILE where an n-gram is missing

    def predict(self, docs: np.ndarray, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(language index, score) of n documents: the language with the smallest sum of rank differences. The score is
        1 less the share of the largest sum there could be; 0 without n-grams."""
        return self.nearest(*ranked(docs, codes, n, PROFILE), n)

    def predict_long(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """predict() of one text from the counts of its codes."""
        code = np.flatnonzero(counts)
        code = code[np.lexsort((code, -counts[code]))][:PROFILE]
        return self.nearest(np.zeros(len(code), np.int64), code, np.arange(len(code)), 1)

    def nearest(self, doc: np.ndarray, code: np.ndarray, rank: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        total = np.zeros((n, len(self.languages)))
        for k, own in enumerate(self.ranks):
            there = own[code].astype(np.int64)
            total[:, k] = np.bincount(doc, np.where(there < PROFILE, np.abs(there - rank), PROFILE), n)
        best = total.argmin(1) if len(self.languages) else np.zeros(n, np.int64)
        kept = np.bincount(doc, minlength=n)
        worst = np.maximum(kept * PROFILE, 1)
        score = np.where(kept > 0, 1 - total[np.arange(n), best] / worst, 0) if len(self.languages) else np.zeros(n)
        return best, np.clip(score, 0, 1)


def pieces(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Chunks of a batch of at most MOST_DOCS rows."""
    for lo in range(0, batch.num_rows, MOST_DOCS):
        yield from text_chunks(batch.slice(lo, MOST_DOCS), column, SORTED_BYTES)


def learn(docs: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles from all rows where `train` holds and text and language are not null.

    Tasks add up the n-grams of each language, Spark sums and ranks them, and the PROFILE best of each language reach
    the driver: what is gathered there is bounded by the number of languages.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, total in sums.items():
                at = np.flatnonzero(total)
                yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "code", "n"])
            sums.clear()

        for whole in batches:
            for batch, data, off in pieces(whole, "text"):
                names, index = np.unique(np.array(batch.column("lang").to_pylist(), object), return_inverse=True)
                long = len(off) == 2 and len(data) > LONG_BYTES
                doc, code = (None, None) if long else grams(data, off)
                for k, lang in enumerate(names):
                    if lang not in sums:
                        if len(sums) >= 64:
                            yield from out()
                        sums[lang] = np.zeros(CODES, np.int64)
                    sums[lang] += gram_counts(data) if long else np.bincount(code[index[doc] == k], minlength=CODES)
        yield from out()

    rows = docs.filter(train & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sums = rows.mapInArrow(counted, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = sums.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "code")) - 1).filter(F.col("rank") < PROFILE)
    got = best.select("lang", "code", "rank").toArrow()
    languages = sorted(set(got.column("lang").to_pylist()))
    ranks = np.full((len(languages), CODES), PROFILE, np.int16)
    at = {x: k for k, x in enumerate(languages)}
    ranks[[at[x] for x in got.column("lang").to_pylist()], got.column("code").to_numpy()] = got.column("rank").to_numpy()
    return Profiles(languages, ranks)


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter (a general category of L)."""
    return any(map(str.isalpha, text or ""))


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text", keep: list[str] | None = None, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """The columns `keep` (all by default) of each row, with the predicted language and a score from 0 to 1.

    Texts that are null or have no letter (general category L) are `und` with score 0. Texts are taken whole; the n-grams of
    long ones are counted by pieces. Languages at the same distance: the first by name. With no profile all are `und`.
    Repeated rows give a row each, an empty table none.
    """
    keep = docs.columns if keep is None else keep
    own = unclashed(docs, "_text")
    shared = docs.sparkSession.sparkContext.broadcast((profiles.languages, profiles.ranks))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Profiles(*shared.value)
        names = np.array([*known.languages, UNKNOWN], object)
        for whole in batches:
            for batch, data, off in pieces(whole, own):
                if len(off) == 2 and len(data) > LONG_BYTES:
                    counts = gram_counts(data)
                    best, points = known.predict_long(counts)
                    ascii_letters = np.array([counts[1:27].any()])
                else:
                    docs_of, codes = grams(data, off)
                    best, points = known.predict(docs_of, codes, batch.num_rows)
                    ascii_letters = np.bincount(docs_of[(codes > 0) & (codes <= 26)], minlength=batch.num_rows) > 0
                texts = batch.column(own)
                ok = np.array([a or has_letter(texts[i].as_py()) for i, a in enumerate(ascii_letters.tolist())], bool) & bool(known.languages)
                best, points = np.where(ok, best, len(known.languages)), np.where(ok, points, 0.0)
                columns = [batch.column(i) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(names[best], pa.string()), pa.array(points, pa.float64())], [*batch.schema.names[:-1], lang, score])

    rows = docs.select(*keep, F.col(text_col).alias(own))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return rows.mapInArrow(each, f"{fields}{', ' if fields else ''}{lang} string, {score} double")


def length_class(col: str | Column) -> Column:
    """The number of binary digits of a text's bytes."""
    return F.length(F.bin(F.coalesce(F.octet_length(col), F.lit(0)).cast("long"))).cast("int")


def least_scores(told: DataFrame, train: Column, floor: float, text_col: str = "text", lang_col: str = "lang", lang: str = "lang_pred", score: str = "score") -> Column:
    """The smallest score at which a row of `told` agrees with its predicted language: SHARE of the median score of the rows
    of that language and length class where `train` holds and label and prediction are the same.

    A length class of under LEAST_TEXTS such rows takes the median of all languages together; if these have too few as well,
    the smaller value of its measured neighbours; if it is shorter than all measured ones, `floor`. What reaches the driver is a row for each language and length class.
    """
    right = told.filter(train & (F.col(lang_col) == F.col(lang)))
    each = F.explode(F.array(F.col(lang), F.lit("")))  # no language has an empty name here: it stands for all
    rows = right.filter(F.col(lang) != "").select(each.alias("lang"), length_class(text_col).alias("c"), F.col(score).alias("s")).groupBy("lang", "c").agg(F.count("*").alias("n"), F.percentile_approx("s", 0.5).alias("m"))
    known: dict[str, dict[int, float]] = {}
    for r in rows.filter(F.col("n") >= LEAST_TEXTS).collect():
        known.setdefault(r["lang"], {})[r["c"]] = max(floor, SHARE * r["m"])
    least, pooled = F.lit(floor), known.pop("", {})
    for name, own in known.items():
        own, values = pooled | own, []
        for c in range(1, LENGTHS + 1):
            below, above = max((x for x in own if x <= c), default=None), min((x for x in own if x >= c), default=None)
            values.append(floor if below is None else own[below] if above is None else min(own[below], own[above]))
        least = F.when(F.col(lang) == name, F.element_at(F.array(*map(F.lit, values)), length_class(text_col))).otherwise(least)
    return least
