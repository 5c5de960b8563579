"""BPE encoding and decoding by contiguous rank arrays (operator 12).

The vocabulary ends words with a mark and drops white space, so no token reaches across a space: a text's tokens are
those of its space-separated chunks in order, and a worker keeps the ids of chunks that it has seen (bounded).
Normalising and cutting into words are the file's own steps; merging is done here.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, text_chunks, unclashed
from .token_chunks import CACHE_CHARS, PLACED

#: Chunks, and words, that one worker keeps at least; at most twice as many.
KEPT = 150_000
#: Symbols of a short word; the scans of longer ones would cost their square.
SHORT = 64
NO_RANK = 1 << 30
NO_PAIR = NO_RANK << 8
#: Chunks of these characters alone are their own normal form but for case; the marks among them are no letters or digits.
LATIN = re.compile("[!-~\u00c0-\u012f\u0131-\u017f]*")
LATIN_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^a-z\u00df-\u00f6\u00f8-\u017f0-9]+")
#: The file's own pattern and steps for which the two above hold.
FILE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
FILE_STEPS = ["NFC", "Replace", "Lowercase"]
_loaded: dict[str, WordBpe] = {}
_tokens: dict[str, pa.Array] = {}


class _Memo(dict):
    """A bounded memo of `make` in two generations: what a full one held stays at hand until the next is full."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= KEPT:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class WordBpe:
    """Encoder and decoder of one BPE file with word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        steps = [x["type"] for x in (file["normalizer"] or {}).get("normalizers", [])]
        pattern = (file["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
        self.latin_holds = steps == FILE_STEPS and pattern == FILE_PATTERN
        self.lib = Tokenizer.from_file(path)
        self.end, self.ids = model["end_of_word_suffix"], model["vocab"]
        added = {t.content: i for i, t in self.lib.get_added_tokens_decoder().items()}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.added = added
        merges = [tuple(pair) for pair in model["merges"]]
        #: By the merged part: rank and length of the left part, in one number. Each part is made by one pair.
        self.pair = {a + b: r << 8 | len(a) for r, (a, b) in enumerate(merges)}
        if len(self.pair) < len(merges) or max(map(len, self.pair), default=0) > 255:
            raise ValueError(f"{path}: two merges make one token, or a token is too long")
        self._tables(merges)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = iter(range(256, 512))
        #: Bytes as the characters that the vocabulary writes for them: the printable ones stand for themselves.
        self.chars = {b: b if b in shown else next(hidden) for b in range(256)}
        self.words = _Memo(lambda word: array("i", self.merge(word)).tobytes())
        self.kept = _Memo(self._chunk)

    def _tables(self, merges: list[tuple[str, str]]) -> None:
        """Pairs of ids as sorted keys, with their ranks and results, for long words."""
        pairs = np.array([[self.ids[a], self.ids[b], self.ids[a + b]] for a, b in merges], np.int64).reshape(-1, 3)
        keys = pairs[:, 0] << 32 | pairs[:, 1]
        order = np.argsort(keys)
        self.keys, self.key_rank, self.result = keys[order], order.astype(np.int32), pairs[:, 2].astype(np.int32)
        made = np.full(int(pairs.max(initial=0)) + 1, -1)
        np.maximum.at(made, pairs[:, 2], np.arange(len(pairs)))
        #: Whether no merge can make a pair of a smaller rank than its own: then all pairs of the least rank can merge at once.
        self.ascending = bool((made[pairs[:, :2]].max(axis=1, initial=-1) < np.arange(len(pairs))).all())

    def merge(self, word: str) -> list[int]:
        """Ids of one word (its bytes as characters): part boundaries and the ranks of adjacent parts lie in two arrays; the
        boundary of the least rank goes, and the ranks beside it are looked up again."""
        if len(word) > SHORT:
            return self._merge_long(word)
        s, get = word + self.end, self.pair.get
        bounds = [*range(len(word)), len(s)]

        def rank(a: int, b: int, c: int) -> int:
            pair = get(s[a:c], NO_PAIR)
            return pair if pair & 255 == b - a else NO_PAIR

        ranks = [*map(rank, bounds, bounds[1:], bounds[2:])]
        while ranks and (least := min(ranks)) < NO_PAIR:
            i = ranks.index(least)
            del bounds[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(*bounds[i - 1 : i + 2])
            if i < len(ranks):
                ranks[i] = rank(*bounds[i : i + 3])
        return [self.ids[s[a:b]] for a, b in zip(bounds, bounds[1:])]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.key_rank[at], np.int32(NO_RANK))

    def _merge_long(self, word: str) -> list[int]:
        """The same for a long word: the two arrays are numpy's, and all pairs of the least rank merge in one scan, from the
        left where they overlap. Where a merge could make a smaller rank, only the leftmost pair does."""
        chars = sorted(set(word))
        code = {c: self.ids[c] for c in chars}
        parts = np.fromiter((code[c] for c in word), np.int32, len(word))
        parts[-1] = self.ids[word[-1] + self.end]
        ranks = self._ranks(parts[:-1], parts[1:])
        while len(ranks) and (least := int(ranks.min())) < NO_RANK:
            at = np.flatnonzero(ranks == least)
            if self.ascending:  # of a run of overlapping pairs each second one merges
                run = np.flatnonzero(np.diff(at, prepend=-2) > 1)
                at = at[(np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))) % 2 == 0]
            else:
                at = at[:1]
            parts[at] = self.result[least]
            parts, ranks = np.delete(parts, at + 1), np.delete(ranks, at)
            at = at - np.arange(len(at))
            for k in (at - 1, at):
                k = k[(k >= 0) & (k < len(ranks))]
                ranks[k] = self._ranks(parts[k], parts[k + 1])
        return parts.tolist()

    def _chunk(self, chunk: str) -> bytes:
        """Ids of text between spaces. Special strings are cut out before anything else."""
        if self.latin_holds and LATIN.fullmatch(chunk) and not (self.special and self.special.search(chunk)):
            words = LATIN_WORD.findall(chunk.lower())
            return b"".join([self.words[w if w.isascii() else w.encode().decode("latin1").translate(self.chars)] for w in words])
        out = []
        for part in self.special.split(chunk) if self.special else [chunk]:
            if part in self.added:
                out.append(np.array([self.added[part]], "<i4").tobytes())
            elif part:
                out += [self.words[w] for w, _ in self.lib.pre_tokenizer.pre_tokenize_str(self.lib.normalizer.normalize_str(part))]
        return b"".join(out)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of ids of each). Each distinct chunk of the texts is looked up once."""
        split = pc.split_pattern(texts.fill_null(""), " ")
        first = split.offsets.to_numpy().astype(np.int64)
        coded = split.values.slice(first[0], first[-1] - first[0]).dictionary_encode()
        codes, values = coded.indices.to_numpy(), [*map(self.kept.__getitem__, coded.dictionary.to_pylist())]
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        pool, start = np.frombuffer(b"".join(values), "<i4"), np.cumsum(sizes) - sizes
        before = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(sizes[codes], out=before[1:])
        parts = [pool[:0]]
        for lo in range(0, len(codes), PLACED):
            own = codes[lo : lo + PLACED]
            n = sizes[own]
            parts.append(pool[np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        return np.concatenate(parts), np.diff(before[first - first[0]])

    @staticmethod
    def of(path: str) -> WordBpe:
        return _loaded.get(path) or _loaded.setdefault(path, WordBpe(path))


def token_texts(path: str) -> pa.Array:
    """The token of each id, added ones included."""
    if path not in _tokens:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        texts = {i: t for t, i in file["model"]["vocab"].items()} | {t["id"]: t["content"] for t in file["added_tokens"]}
        _tokens[path] = pa.array([texts.get(i, "") for i in range(max(texts) + 1)], pa.large_string())
    return _tokens[path]


def decoded(ids: pa.ListArray, tokens: pa.Array) -> pa.Array:
    """The tokens of each list, joined by spaces: the file names no decoder, so the library joins them so."""
    lo, hi = ids.offsets[0].as_py(), ids.offsets[-1].as_py()
    lists = pa.LargeListArray.from_arrays(pc.subtract(ids.offsets, lo).cast(pa.int64()), tokens.take(ids.values.slice(lo, hi - lo)))
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string()))


def encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the column `ids` (array<int>): what the tokenizers library gives for the whole text without added special
    tokens, truncation or padding; special strings inside a text are one id each.

    Null and empty texts have no ids; equal texts have equal ids; every row stays, in an empty table none. A column that
    is called as `ids` already keeps its name, and the new one gets an underscore. Nothing is shuffled. Texts are worked
    off about two megabytes at a time; one text is never cut, so a worker needs about 30 bytes for each byte of the
    longest one.
    """
    ids = unclashed(docs, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordBpe.of(vocabulary)
        for batch in batches:
            for part, _, _ in text_chunks(batch, text, CHUNK_BYTES):
                flat, counts = coder.encode_all(part.column(text).cast(pa.string()))
                off = np.zeros(len(counts) + 1, np.int32)
                np.cumsum(counts, out=off[1:])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(off), pa.array(flat, pa.int32()))], [*part.schema.names, ids])

    return docs.mapInArrow(run, docs.withColumn(ids, F.lit(None).cast("array<int>")).schema)


def decode(rows: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """rows with the column `decoded`: the library's decode of the ids, special tokens kept. No ids or a null array give the
    empty text; an id that the vocabulary lacks is an error."""
    text = unclashed(rows, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_texts(vocabulary)
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            for lo in range(0, len(batch), 1024):
                part = batch.slice(lo, 1024)
                lists = pa.array(part.column(at).to_pylist(), pa.list_(pa.int32())) if part.column(at).null_count else part.column(at)
                yield pa.RecordBatch.from_arrays([*part.columns, decoded(lists, tokens).fill_null("").cast(pa.string())], [*part.schema.names, text])

    return rows.mapInArrow(run, rows.withColumn(text, F.lit(None).cast("string")).schema)
