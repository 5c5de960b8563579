"""Benchmark decontamination by edit distance (operator 2).

Edit distance is over words (ASCII letters and digits, and characters beyond ASCII but for punctuation, symbols and spaces;
A to Z in lower case). In scripts that put no spaces between words each character is a word.

The CGK random walk embeds a window of words: at step t it emits the word at its place, and moves on if a random bit of
(t, word) is set. Two windows within a small edit distance soon walk in step again, so their embeddings differ in few
places: edit distance becomes Hamming distance. Bit sampling hashes a few sampled steps of a walk, and REPEATS walks with
other random bits and samples repeat it. Windows have three quarters of an item's size class. An item is embedded from each
of its words on, so it is found wherever its edits lie; a document from every word, or every stride_of(class) words.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, text_chunks, written

#: Steps sampled of each walk for one hash.
SAMPLES = 3
#: Walks with other bits and samples. In trials with all accepted edits used up (1,200 a size, edits at the front, middle
#: and back, even and random; see recall_trial in the tests) they find 0.95 or more of the passages of each size.
REPEATS = 8
REPEATS_LARGE = 16  # of classes from LARGE on
LARGE = 128
#: Items of fewer words are found by runs of words that their edits must leave unchanged (see cuts).
SHORT = 8
#: Item words whose hashes are broadcast at once (a longer item makes a block of its own); more are handled in blocks,
#: each in a pass over the documents.
WORDS_A_PASS = 250_000
#: Text bytes that are searched at once.
SEARCHED_BYTES = 1 << 20
_word_bytes = np.zeros(256, np.uint8)
_word_bytes[np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyz", np.uint8)] = np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyz", np.uint8)
_word_bytes[ord("A") : ord("Z") + 1] = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
_word_bytes[128:] = np.arange(128, 256)
#: Characters beyond ASCII that end words (1), and of scripts without spaces (2): Thai to Tibetan, Myanmar, Khmer, Tai Le to Khmer symbols, Tai Tham, kana, Han.
_kinds = np.array([0 if c < 128 else 1 if unicodedata.category(chr(c))[0] in "PSZ" or c == 0x200B else 0 for c in range(0x40000)], np.uint8)
for _a, _b in ((0xE00, 0xFFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x30FF), (0x3105, 0x312F), (0x31A0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0xA4CF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF)):
    _kinds[_a : _b + 1] = np.where(_kinds[_a : _b + 1] == 1, 1, 2)
_odd = np.uint64(0x9E3779B97F4A7C15)


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, bytes, kind) of the characters beyond ASCII of UTF-8 texts, see _kinds."""
    lead = np.flatnonzero(data >= 0xC2)
    first, more = data[lead].astype(np.int32), np.append(data, np.zeros(3, np.uint8)).astype(np.int32) & 63
    size = 2 + (first >= 0xE0) + (first >= 0xF0)
    two = (first & 31) << 6 | more[lead + 1]
    three = (first & 15) << 12 | more[lead + 1] << 6 | more[lead + 2]
    four = (first & 7) << 18 | more[lead + 1] << 12 | more[lead + 2] << 6 | more[lead + 3]
    code = np.where(size == 2, two, np.where(size == 3, three, four))
    return lead, size, np.where(code < len(_kinds), _kinds[np.minimum(code, len(_kinds) - 1)], 0)


def word_starts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(norm, inside, start, starts) of texts that lie end to end: their bytes in lower case, zero outside words; whether a
    byte is in a word; whether one begins there; and where words begin."""
    norm = _word_bytes[data]
    lead, size, kind = characters(data)
    for k in range(4):
        norm[lead[(kind == 1) & (size > k)] + k] = 0
    inside = norm > 0
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    alone, after = lead[kind == 2], (lead + size)[kind == 2]
    start[alone] = True
    after = after[after < len(data)]
    start[after] = inside[after]
    heads = off[:-1][np.diff(off) > 0]
    start[heads] = inside[heads]
    return norm, inside, start, np.flatnonzero(start)


def words_at(data: np.ndarray, starts: np.ndarray, lo: int, hi: int) -> list[bytes]:
    """The words lo to hi of a text, as normalised bytes."""
    begin, end = int(starts[lo]), int(starts[hi]) if hi < len(starts) else len(data)
    norm, _, _, own = word_starts(data[begin:end], np.array([0, end - begin]))
    return [norm[a:b].tobytes().rstrip(b"\0") for a, b in zip(own, [*own[1:], end - begin])]


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): 64-bit hashes of the words of texts that lie end to end. A zero follows each text's words."""
    n = len(off) - 1
    norm, inside, start, starts = word_starts(data, off)
    power = np.cumprod(np.full(4096, _odd))
    hashes = np.zeros(len(starts), np.uint64)
    if len(starts):
        ends = np.flatnonzero(inside & ~np.append(inside[1:], False) | np.append(start[1:], False) & inside) + 1
        size = ends - starts
        place = np.arange(len(norm)) - np.repeat(starts, np.diff(np.append(starts, len(norm)))) if starts[0] == 0 else None
        if place is None:
            place = np.concatenate([np.zeros(starts[0], np.int64), np.arange(starts[0], len(norm)) - np.repeat(starts, np.diff(np.append(starts, len(norm))))])
        terms = np.where(inside, (norm.astype(np.uint64) + np.uint64(1)) * power[place % 4096], np.uint64(0))
        hashes = mix64(np.add.reduceat(terms, starts) + size.astype(np.uint64))
        hashes[hashes == 0] = 1
    doc = np.searchsorted(off, starts, "right") - 1
    per = np.bincount(doc, minlength=n)
    out = np.zeros(len(starts) + n, np.uint64)
    out[np.arange(len(starts)) + doc] = hashes
    return out, np.concatenate([[0], np.cumsum(per + 1)])


def cuts(words: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the most + 1 runs of an item: the whole item, in lengths that differ by one at most."""
    at = [words * k // (most + 1) for k in range(most + 2)]
    return list(zip(at[:-1], np.diff(at).tolist(), strict=True))


def runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """The hash of the `length` words from each place on."""
    n = max(0, len(hashes) - length + 1)
    key = np.full(n, np.uint64(length))
    for k in range(length):
        key = mix64(key * _odd + hashes[k : k + n])
    return key


def class_of(words: int) -> int:
    """The largest of 8, 12, 16, 24, 32, ... that is not above the size: two classes an octave share their windows."""
    octave = 1 << (words.bit_length() - 1)
    return octave * 3 // 2 if words >= octave * 3 // 2 else octave


def stride_of(size: int) -> int:
    """Words from one document window of a class to the next, a power of two; a passage holds 16 windows at least, or one at each word."""
    return 1 << max(0, (size // 16).bit_length() - 1)


def repeats_of(size: int) -> int:
    return REPEATS_LARGE if size >= LARGE else REPEATS


def samples(size: int, repeat: int) -> np.ndarray:
    """The steps that are hashed, in order. A walk moves on at every other step, so it reads 3/4 * size words in 3/2 * size steps."""
    return np.sort(np.random.default_rng([size, repeat]).choice(size * 3 // 2, SAMPLES, replace=False))


def random_bits(hashes: np.ndarray, repeat: int, step: int) -> np.ndarray:
    """The words' bits of the 64 steps from `step` on, as 8 bytes each; none are set for the end of a text."""
    bits = mix64(hashes, 1 + repeat * 4096 + step // 64).astype("<u8")
    bits[hashes == 0] = 0
    return bits.view(np.uint8).reshape(-1, 8)


def walks(hashes: np.ndarray, sizes: list[int], repeat: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, starts, key) of the walks of one repeat from every stride_of(size) words on, for each size.

    Walks of all sizes share their bits, so each step is taken once. A zero (a text's end) has no bit set: a walk stays there.
    """
    places = np.arange(len(hashes))
    wanted = {size: samples(size, repeat) for size in sizes}
    keys = {size: np.full(-(-len(hashes) // stride_of(size)), np.uint64(repeat * 4096 + size)) for size in sizes}
    at, every = places.copy(), 1
    for t in range(max((w[-1] for w in wanted.values()), default=-1) + 1):
        for size in [x for x, w in wanted.items() if t in w]:
            own = at[:: stride_of(size) // every] if stride_of(size) > every else at
            keys[size] = keys[size] * _odd + np.take(hashes, own, mode="clip")
            if t == wanted[size][-1]:
                yield size, places[:: stride_of(size)], mix64(keys.pop(size))
                del wanted[size]
        if not wanted:
            return
        more = math.gcd(*(stride_of(x) for x in wanted))
        if more > every:
            at, every = at[:: more // every].copy(), more
        if t % 64 == 0:
            bits = random_bits(hashes, repeat, t)
        if t % 8 == 0:
            eight = np.ascontiguousarray(bits[:, t % 64 // 8])
        at += np.take(eight >> np.uint8(t % 8) & np.uint8(1), at, mode="clip")


@dataclass
class Items:
    """A block of benchmark items and the hashes of their walks, or of their runs if they are short."""

    ids: list
    words: list[np.ndarray]
    most: list[int]  # largest accepted edit distance
    #: By length of the runs, or by (size, repeat) of the walks: keys in order, item, place in the item.
    tables: dict[int | tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]
    texts: list[bytes] = ()

    @staticmethod
    def of(ids: list, words: list[np.ndarray], similarity: float, texts: list[bytes] = ()) -> Items:
        items, rows = Items(ids, words, [int((1 - similarity) * len(w) + 1e-9) for w in words], {}, texts), {}
        for i, w in enumerate(words):
            for start, length in cuts(len(w), items.most[i]) if 0 < len(w) < SHORT else ():
                rows.setdefault(length, []).append((int(runs(w[start : start + length], length)[0]), i, start))
        for length, own in rows.items():
            items._add(length, *(np.array(x, t) for x, t in zip(zip(*own, strict=True), (np.uint64, np.int32, np.int32), strict=True)))
        for size in sorted({class_of(len(w)) for w in words if len(w) >= SHORT}):
            own = [i for i, w in enumerate(words) if len(w) >= SHORT and class_of(len(w)) == size]
            first = np.cumsum([0, *[len(words[i]) + 1 for i in own]])
            item = np.repeat(np.array(own, np.int32), np.diff(first))
            offset = (np.arange(first[-1]) - np.repeat(first[:-1], np.diff(first))).astype(np.int32)
            flat = np.concatenate([np.append(words[i], np.uint64(0)) for i in own])
            for r in range(repeats_of(size)):
                key, last, told = every_walk(flat, size, r)
                inside = (flat[last] != 0) & (told == SAMPLES)  # a walk that ends outside the item, or tells a word twice, says too little
                items._add((size, r), key[inside], item[inside], offset[inside])
        return items

    def _add(self, table: int | tuple[int, int], keys: np.ndarray, item: np.ndarray, offset: np.ndarray) -> None:
        order = np.argsort(keys)
        self.tables[table] = keys[order], item[order], offset[order]

    def filters(self) -> dict[int | tuple[int, int], np.ndarray]:
        """For each table, which leading bits its keys have."""
        out = {}
        for name, (keys, _, _) in self.tables.items():
            out[name] = np.zeros(1 << min(24, max(16, (len(keys) * 16).bit_length())), bool)
            out[name][leading(keys, out[name])] = True
        return out


def every_walk(hashes: np.ndarray, size: int, repeat: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, last place, number of places told) of the walk of a class from each word on."""
    at, key, wanted = np.arange(len(hashes)), np.full(len(hashes), np.uint64(repeat * 4096 + size)), samples(size, repeat)
    last, told = np.full(len(hashes), -1), np.zeros(len(hashes), np.int64)
    for t in range(wanted[-1]):
        if t in wanted:
            key = key * _odd + hashes[at]
            last, told = at, told + (at != last)
        if t % 64 == 0:
            bits = random_bits(hashes, repeat, t)
        at = at + (bits[at, t % 64 // 8] >> np.uint8(t % 8) & np.uint8(1))
    return mix64(key * _odd + hashes[at]), at, told + (at != last)


def leading(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(65 - len(table).bit_length())).astype(np.int64)


def edit_span(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int] | None:
    """(distance, end) of the part of `text` with the smallest word edit distance to the item, if it is `most` or less.

    The usual table, one row for each item word, starting and ending anywhere in the text; equal distances take the
    first end. Rows are numpy operations: the moves along a row are a running minimum. Each item word that the text lacks
    costs one edit at least, so too many of them decide at once.
    """
    there = (item[:, None] == text).any(1) if len(item) * len(text) < 1 << 18 else np.isin(item, text)
    if len(item) - np.count_nonzero(there) > most:
        return None
    along = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, w in enumerate(item):
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (text != w))
        row = np.minimum.accumulate(new - along) + along
        if i % 8 == 7 and row.min() > most:
            return None
    end = int(row.argmin())
    return (int(row[end]), end) if row[end] <= most else None


def hits(items: Items, filters: dict, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(item, place of the item's first word, place of the hash) of the windows and runs of a text that share a hash with an item."""

    def met(name: int | tuple[int, int], keys: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        table, item, offset = items.tables[name]
        hit = np.flatnonzero(filters[name][leading(keys, filters[name])])
        lo, hi = np.searchsorted(table, keys[hit], "left"), np.searchsorted(table, keys[hit], "right")
        hit, lo, per = hit[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        k = np.repeat(lo - (np.cumsum(per) - per), per) + np.arange(per.sum())
        return item[k].astype(np.int64), np.repeat(starts[hit], per) - offset[k], np.repeat(starts[hit], per)

    for length in [x for x in items.tables if isinstance(x, int)]:
        keys = runs(hashes, length)
        yield met(length, keys, np.arange(len(keys)))
    sizes: dict[int, list[int]] = {}
    for size, r in [x for x in items.tables if not isinstance(x, int)]:
        sizes.setdefault(r, []).append(size)
    for r, own in sizes.items():
        for size, starts, keys in walks(hashes, own, r):
            yield met((size, r), keys, starts)


def matches(items: Items, filters: dict, hashes: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(document, item, distance, place of the end in words) of the best match of each pair that shares a hash."""
    found = [np.stack(x) for x in hits(items, filters, hashes) if len(x[0])]
    if not found:
        return []
    k, begin, place = np.concatenate(found, axis=1)
    most = np.array(items.most, np.int64)
    doc = np.searchsorted(off, place, "right") - 1  # a hash of an item holds no text's end, so it lies in one text
    slack = np.maximum(4, most[k])
    # Hits of the same alignment within the slack are tried once, from the first of them.
    order = np.lexsort((begin, k, doc))
    doc, k, begin, slack = doc[order], k[order], begin[order], slack[order]
    cell = np.where(most[k] > 0, begin // (slack + 1), 0)  # where no edit is accepted, the whole item is the run: the first hit is the best
    new = np.append(True, (doc[1:] != doc[:-1]) | (k[1:] != k[:-1]) | (cell[1:] != cell[:-1]))
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for d, i, at, room in zip(*(x[new].tolist() for x in (doc, k, begin, slack)), strict=True):
        if not items.most[i]:
            best[d, i] = (0, at + len(items.words[i]) - int(off[d]))
            continue
        lo, hi = max(int(off[d]), at - 2 * room - 1), min(int(off[d + 1]) - 1, at + len(items.words[i]) + 2 * room + 1)
        if span := edit_span(items.words[i], hashes[lo:hi], items.most[i]):
            value = (span[0], lo + span[1] - int(off[d]))
            best[d, i] = min(best.get((d, i), value), value)
    return [(d, i, *v) for (d, i), v in sorted(best.items())]


def pieces(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about SEARCHED_BYTES of a text that cut no word: they end at an ASCII break, or else at a character that ends
    words or is a word of its own; a word longer than that is never cut."""
    lo = 0
    while lo < len(data):
        hi, at = len(data), lo + SEARCHED_BYTES
        while at < len(data):
            window = data[at : at + SEARCHED_BYTES]
            breaks = np.flatnonzero(_word_bytes[window] == 0)
            if not len(breaks):
                lead, _, kind = characters(window)
                breaks = lead[kind > 0]
            if len(breaks):
                hi = at + int(breaks[0])
                break
            at += SEARCHED_BYTES
        yield lo, hi
        lo = hi


def exactly(items: Items, data: np.ndarray, starts: np.ndarray, item: int, distance: int, end: int) -> tuple[int, int] | None:
    """(distance, end) of a match by the words' bytes: that of the hashes if all equal hashes are equal words, or else the
    best one of the whole text, if there is one."""
    most, code = items.most[item], {}
    own = np.frombuffer(items.texts[item], np.uint8)
    begins = word_starts(own, np.array([0, len(own)]))[3]
    coded = lambda words: np.array([code.setdefault(w, len(code)) for w in words], np.int64)
    a = coded(words_at(own, begins, 0, len(begins))) if len(begins) else np.zeros(0, np.int64)
    lo = max(0, end - len(a) - most)
    found = edit_span(a, coded(words_at(data, starts, lo, end)), most) if end > lo else None
    if found and found[0] <= distance:
        return distance, end
    found = edit_span(a, coded(words_at(data, starts, 0, len(starts))), most) if len(starts) else None
    return found


def search_text(items: Items, filters: dict, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int]]:
    """matches() of texts that lie end to end. A text above SEARCHED_BYTES is hashed and searched piece by piece: pieces of
    the text end at ASCII breaks, and pieces of its words overlap by more than any match and its slack."""
    if len(off) != 2 or len(data) <= 2 * SEARCHED_BYTES:
        return matches(items, filters, *word_hashes(data, off))
    words = np.concatenate([word_hashes(data[lo:hi], np.array([0, hi - lo]))[0][:-1] for lo, hi in pieces(data)])
    room = max((len(w) + 4 * max(4, m) + 4 for w, m in zip(items.words, items.most, strict=True)), default=0)
    step, best = max(SEARCHED_BYTES // 6, 4 * room), {}
    for lo in range(0, max(1, len(words) - room), step):
        own = np.append(words[lo : lo + step + 2 * room], np.uint64(0))
        for _, i, distance, end in matches(items, filters, own, np.array([0, len(own)])):
            best[i] = min(best.get(i, (distance, lo + end)), (distance, lo + end))
    return [(0, i, *v) for i, v in sorted(best.items())]


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, distance, item_words, end_word): a row for each document row and benchmark item of which it holds a
    passage within an edit distance of (1 - similarity) of the item's words.

    Documents are read in place and nothing is shuffled. Each match of the hashes is verified by the words' bytes, so there
    are no false rows; an exact copy is found by every walk, and of the passages at the limit of similarity the share that REPEATS
    tells. The benchmark is the query set: its items go to the tasks WORDS_A_PASS words at a time, and each such block
    takes a pass over the documents. With several blocks each is written and its broadcast is dropped before the next.

    Null texts and those without words match nothing. Items of any length count; those of fewer than 1 / (1 - similarity)
    words accept no edit, so a document holds them word by word or not at all. Repeated rows of documents or
    items give rows each. Other columns are ignored.
    """
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {id_type}, item_id {item_type}, distance int, item_words int, end_word int"
    kind = benchmark.select(item_id).limit(0).toArrow().schema.field(0).type

    def search(ids: list, words: list[np.ndarray], texts: list[bytes]) -> tuple[DataFrame, Broadcast]:
        shared = docs.sparkSession.sparkContext.broadcast(Items.of(ids, words, similarity, texts))

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = shared.value
            if not (filters := items.filters()):
                return
            for whole in batches:
                for batch, data, off in text_chunks(whole, "text", SEARCHED_BYTES):
                    found, starts = [], {}
                    for d, i, distance, end in search_text(items, filters, data, off):
                        own = data[off[d] : off[d + 1]]
                        if d not in starts:
                            starts = {d: np.concatenate([lo + word_starts(own[lo:hi], np.array([0, hi - lo]))[3] for lo, hi in pieces(own)])}
                        if exact := exactly(items, own, starts[d], i, distance, end):
                            found.append((d, i, *exact))
                    if found:
                        doc, item, distance, end = zip(*found, strict=True)
                        of = batch.column("id").take(pa.array(doc))
                        sizes = [len(items.words[k]) for k in item]
                        yield pa.record_batch([of, pa.array([items.ids[k] for k in item], kind), *(pa.array(x, pa.int32()) for x in (distance, sizes, end))], ["id", "item_id", "distance", "item_words", "end_word"])

        return rows.mapInArrow(each, schema), shared

    out, ids, words, texts, held = [], [], [], [], 0
    for row in benchmark.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).toLocalIterator():
        data = np.frombuffer((row["t"] or "").encode(), np.uint8)
        own = word_hashes(data, np.array([0, len(data)]))[0][:-1]
        if ids and held + len(own) > WORDS_A_PASS:
            found, shared = search(ids, words, texts)
            out.append(written(found, "leaks"))
            shared.destroy()
            ids, words, texts, held = [], [], [], 0
        ids.append(row["i"])
        words.append(own)
        texts.append(data.tobytes())
        held += len(own)
    out.append(search(ids, words, texts)[0])
    return reduce(DataFrame.union, out).withColumnsRenamed({"id": id_col, "item_id": item_id if item_id != id_col else f"item_{item_id}"})
