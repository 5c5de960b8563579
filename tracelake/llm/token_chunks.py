"""Exact tokenization by cached chunks.

Both vocabularies used here join no characters across a single space between two other characters: no piece of the
first has its space mark behind another character, and the pattern of the second begins a new part at such a space.
So a text's tokens are those of its space-separated chunks in order, and a worker keeps the tokens of chunks that it
has seen. The caches are bounded; a full one starts anew.
"""

from __future__ import annotations

import hashlib
import string
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks that one worker keeps.
CACHE_ENTRIES = 500_000
#: Chunks whose ids are put in place at once.
PLACED = 1 << 18
#: Longer chunks are not kept.
CACHE_CHARS = 64
#: Marks that the pattern takes as one part behind a word; the apostrophe can begin other parts.
MARKS = string.punctuation.replace("'", "")
_loaded: dict[tuple[str, str], object] = {}
#: White space besides space and line feed; a text that holds any is encoded whole.
_rare_space = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]


def _plain_space(text: str) -> bool:
    """Whether each space stands alone between two other characters, as far as white space goes."""
    return not (text[0] == " " or text[-1] == " " or any(x in text for x in ("  ", " \n", "\n ")) or any(c in text for c in _rare_space))


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


class _Kept(dict):
    """A bounded memo of `make` in two generations: what a full one held stays at hand until the next is full."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, chunk):
        value = self.old.get(chunk)
        if value is None:
            value = self.make(chunk)
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[chunk] = value
        return value


class PieceCounter:
    """Token counts of a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size())]
        self.splits = not any("▁" in p.lstrip("▁") for p in pieces) and self._plain()
        self.kept = _Kept(lambda chunk: len(self.lib.encode(chunk)))

    def _plain(self) -> bool:
        """Whether the model leaves characters as they are and marks the front of a text like a space."""
        probe = "a  é ﬁ 　x"
        return self.lib.encode(probe, out_type=str) == self.lib.encode(probe, out_type=str) and self.lib.decode(self.lib.encode(probe)) == probe

    def count(self, text: str) -> int:
        if not text:
            return len(self.lib.encode(text))
        if not self.splits or "▁" in text or text[0] == " " or text[-1] == " " or "  " in text:
            return len(self.lib.encode(text))
        return sum(map(self.kept.__getitem__, text.split(" ")))

    @staticmethod
    def of(path: str) -> PieceCounter:
        return _loaded.get(("piece", path)) or _loaded.setdefault(("piece", path), PieceCounter(path))


class ByteBpe:
    """Ids of a byte-level BPE file of the tokenizers library, as little-endian int32 bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.tokenize = self.lib.model.tokenize
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.first, self.later = _Kept(lambda word: self._encode("", word)), _Kept(lambda word: self._encode(" ", word))
        self.feed = np.array(self.lib.encode("\n", add_special_tokens=False).ids, "<i4").tobytes()
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = iter(range(256, 512))
        #: Bytes as the characters that the vocabulary writes for them: the printable ones stand for themselves.
        self.chars = {b: b if b in shown else next(hidden) for b in range(256)}
        self.space = chr(self.chars[32])

    def _part(self, part: str) -> bytes:
        """The ids of one part of the pattern, by the library's merges."""
        return array("i", [t.id for t in self.tokenize(part.encode().decode("latin1").translate(self.chars))]).tobytes()

    def _encode(self, space: str, word: str) -> bytes:
        if word.isalpha():
            if word.isascii():
                return array("i", [t.id for t in self.tokenize(self.space + word if space else word)]).tobytes()
            return self._part(space + word)
        kept = self.later if space else self.first
        core = word.rstrip(MARKS)
        if len(core) < len(word) and core.isalpha():  # a word and a part of marks
            return kept[core] + self.first[word[len(core) :]]
        lines = word.split("\n")
        if len(lines) > 1 and all(lines):  # a single line feed is a part of its own
            return kept[lines[0]] + b"".join([self.feed + self.first[x] for x in lines[1:]])
        return array("i", self.lib.encode(space + word, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0].tobytes()

    def _begin(self, text: str) -> tuple[bytes, bool]:
        """The ids of a text's first chunk; those of the whole text where its chunks can't be told apart by spaces."""
        if not text:
            return b"", False
        if _plain_space(text) and not any(s in text for s in self.special):
            return self.first[text.partition(" ")[0]], True
        return array("i", self.lib.encode(text, add_special_tokens=False).ids).tobytes(), False

    def encode_all(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of ids of each). Each distinct chunk of the texts is looked up once."""
        begins = [self._begin(x or "") for x in texts.to_pylist()]
        split = pc.split_pattern(pc.if_else(pa.array([b for _, b in begins], pa.bool_()), texts, ""), " ")
        first = split.offsets.to_numpy().astype(np.int64)
        coded = split.values.slice(first[0], first[-1] - first[0]).dictionary_encode()
        first -= first[0]
        codes, n = coded.indices.to_numpy().copy(), len(coded.dictionary)
        codes[first[:-1]] = n + np.arange(len(begins))
        values = [*map(self.later.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False).tolist()), *[b for b, _ in begins]]
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        pool, start = np.frombuffer(b"".join(values), "<i4"), np.cumsum(sizes) - sizes
        parts, counts = [], np.zeros(len(codes) + 1, np.int64)
        np.cumsum(sizes[codes], out=counts[1:])
        for lo in range(0, len(codes), PLACED):
            own = codes[lo : lo + PLACED]
            n_ids = sizes[own]
            parts.append(pool[np.repeat(start[own] - (np.cumsum(n_ids) - n_ids), n_ids) + np.arange(n_ids.sum())])
        return np.concatenate(parts) if parts else pool, np.diff(counts[first])

    @staticmethod
    def of(path: str) -> ByteBpe:
        return _loaded.get(("bpe", path)) or _loaded.setdefault(("bpe", path), ByteBpe(path))
