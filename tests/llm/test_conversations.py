"""Conversation repair, prefix tries and word BPE against brute-force versions."""

import collections
import functools
import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tracelake.llm import conversations, prefix_trie, queries, word_bpe
from tracelake.llm.queries import tokenizer

SPACE = " \t\n\x0b\x0c\r"
LEGAL = {"s": {"": "S"}, "u": {"": "U", "S": "U", "A": "U"}, "a": {"U": "A"}}
SCHEMA = "conv_id long, turn long, role string, text string, code int, times string, digest string, whole int, turns int, path string"


def least_edits(rows):
    """The cheapest edits of (initial, must go, truncated), the ASCII-least of them, by trying all."""

    @functools.cache
    def best(i, state, inserted=0):
        found = [(0, "")] if i == len(rows) and state in ("", "A") else []
        nxt = "A" if state == "U" else "U"
        if inserted < 2:
            found.append((5 + (b := best(i, nxt, inserted + 1))[0], "I" + b[1]))
        if i < len(rows):
            initial, gone, cut = rows[i]
            found.append((2 + (b := best(i + 1, state))[0], "D" + b[1]))
            if not gone:
                found.append((1 + 5 * cut + (b := best(i + 1, nxt))[0], "R" + b[1]))
                if (to := LEGAL.get(initial, {}).get(state)) is not None:
                    found.append((5 * cut + (b := best(i + 1, to))[0], "K" + b[1]))
        return min(found) if found else (1 << 40, "")

    return best(0, "")


def plain_repair(rows):
    """conv_id -> the contract's row, of (conv_id, turn, role, text) in any order."""
    out, by = {}, collections.defaultdict(list)
    said = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        text = "" if fate == 1 else "".join(c for c in text if c not in ".!?") if fate == 2 else text
        by[conv] += [(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(f"{len(t[1].encode())}\n{t[1]}\n{t[2]}".encode()).digest()))
        seen, coded, faults = set(), [], collections.Counter()
        for _, role, text in turns:
            end = text.rstrip(SPACE)[-1:]
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            coded.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit = least_edits(tuple(coded))
        lines, state, at = [], "", 0
        for e in audit:
            role, text = (turns[at][1:] if e != "I" else ("", ""))
            at += e != "I"
            if e in "IR":
                role = "assistant" if state == "U" else "user"
            if e != "D":
                lines.append(f"{role}:{text}")
                state = {"s": "S", "u": "U", "a": "A"}[role[0]]
        numbers = {t[0] for t in turns if t[0] is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def random_turns(seed, n, lengths=12):
    rng = random.Random(seed)
    texts = ["", " \t", None, "Yes.", "No", "Why? ", "é!\n", "cut off,", "a\x0b", "long " * 50 + "end."]
    rows = []
    for conv in [None, *range(-3, n)]:
        for k in range(rng.randint(1, lengths)):
            rows.append((conv, rng.choice([k, k, k, k + 1, None]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "über"]), rng.choice(texts)))
    return rows


def extra(rows):
    return [(*r, 1, "t", "d", 2, 3, "p") for r in rows]


def repaired(spark, rows):
    df = spark.createDataFrame(extra(rows), SCHEMA).repartition(3)
    out = conversations.digests(conversations.repair(conversations.damage(df), times=F.col("times")))
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in out.collect()}


def test_repair_brute_force(spark):
    rows = random_turns(5, 150)
    rows += rows[:40]
    assert repaired(spark, rows) == plain_repair(rows)


def test_tight_edits_brute_force():
    rng = random.Random(8)
    for _ in range(1500):
        codes = bytes(rng.randint(0, 3) | rng.choice([0, 0, 0, 4, 8, 16]) for _ in range(rng.randint(0, 30)))
        rows = tuple(("_sua"[c & 3], bool(c & 12), bool(c & 16)) for c in codes)
        assert conversations.tight_edits(codes) == least_edits(rows)


def test_repair_of_a_long_conversation(spark):
    rows = [(7, i, ["user", "assistant"][i % 2], f"turn {i}.") for i in range(30_000)] + [(8, 0, "user", "x." * 3_000_000)]
    got = repaired(spark, rows)
    assert len(got[7][6]) >= 28_000 and got[8] == plain_repair(rows[-1:])[8]


def test_repair_gives_turns(spark):
    rows = [(1, 0, "tool", "Go."), (1, 1, "assistant", "Well"), (1, 2, "assistant", "Well."), (2, 5, "user", "Hi."), (3, 0, "user", "  ")]
    out = conversations.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    turns = [(r.conv_id, r.place, r.edit, r.role, r.text) for r in sorted(out, key=lambda r: (r.conv_id, r.place)) if r.place]
    assert turns == [(1, 1, "R", "user", "Go."), (1, 2, "K", "assistant", "Well.")]
    assert {r.conv_id: r.report.audit for r in out if not r.place} == {1: "RDK", 2: "D", 3: "D"}


def test_repair_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversations.digests(conversations.repair(empty)).count() == 0
    text_ids = spark.createDataFrame([("a", 1, "user", "Hi."), ("b", 1, "assistant", "x")], "conv_id string, turn int, role string, text string")
    assert {r.conv_id for r in conversations.digests(conversations.repair(text_ids)).collect()} == {"a", "b"}


def plain_trie(rows):
    turns = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        turns[conv].append((turn is not None, turn or 0, role or "", hashlib.sha256(f"{len((role or '').encode())}\n{role or ''}\n{text or ''}".encode()).digest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(x)] for c, x in turns.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = (abs(c) // 5 * 5) * (1 if c >= 0 else -1)
        paths[c] = own.get(base, [])[:h] + own[c][h:]
    nodes = collections.defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes[tuple(p[:d])].append(c)
    kids = collections.defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = (len(nodes[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[k] for k in kids[p])
        ends = sorted(c for c in nodes[p] if len(paths[c]) == len(p))
        out.append((min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return collections.Counter(out)


def trie(spark, rows, turns_a_task):
    df = spark.createDataFrame(extra(rows), SCHEMA).repartition(3)
    out = prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.conversations(df)), turns_a_task)
    return collections.Counter((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in out.collect())


def trie_turns():
    rng = random.Random(2)
    rows = []
    for c in range(-12, 220):
        own = rng.randint(1, 14)
        rows += [(c, rng.choice([k, k, k, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "a", None, "é" * 3])) for k in range(own)]
    for c in range(300, 340):  # copies, some cut short
        rows += [(c, k, "user", f"turn {k}") for k in range(40 if c % 3 else 25)]
    return [r for r in rows if r[0] not in (15, 105)]


@pytest.mark.parametrize("turns_a_task", [10_000_000, 300, 20])
def test_trie_brute_force(spark, turns_a_task):
    rows = trie_turns()
    assert trie(spark, rows, turns_a_task) == plain_trie(rows)


def test_trie_edges(spark):
    assert trie(spark, [], 10) == collections.Counter()
    assert trie(spark, [(7, 0, "user", "x")], 10) == plain_trie([(7, 0, "user", "x")])
    with_null = trie(spark, [(None, 0, "user", "x"), (1, 0, "user", "x")], 10)
    assert sum(with_null.values()) == len({k[1:2] for k in with_null}) and max(k[3] for k in with_null) == 2
    long = [(c, k, "user", f"t{k}") for c in (1000, 1001) for k in range(3000)]
    assert trie(spark, long, 100) == plain_trie(long)


BPE_TEXTS = [None, "", " ", "Hello  World's <|endoftext|>x", "İstanbul ΣΑΣ é é Å 12 34!!?", "漢字かな " * 40, "　a\u0085b\x1cc", "ab" * 500, "x" * 70, "the cat\nsat\r\n\ton", "<|startoftext|><|endof", "naïve-façade ÷× ŉ ſ", "😀😀 👍🏽"]


def test_word_bpe_like_the_library(spark):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rng = random.Random(4)
    alphabet = [*"aAbz é'sStT019.,!?\n", "漢", "Σ", "ǅ", "́", "<|endoftext|>", "'RE", "quick", " "]
    texts = [*BPE_TEXTS, *["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(400)], " ".join("".join(rng.choices("etaoin", k=5)) for _ in range(60_000))]
    rows = [(i, t, "clash", [1]) for i, t in enumerate(texts)] + [(3, texts[3], None, None)] * 2 + [(None, "null id", "x", [])]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string, ids array<int>").repartition(4)
    coded = word_bpe.encode(df, path, ids="tokens")
    assert coded.columns == [*df.columns, "tokens"] and word_bpe.encode(df, path).columns[-1] == "ids_"
    out = word_bpe.decode(coded, path, ids="tokens").collect()
    assert len(out) == len(rows)
    for r in out:
        want = lib.encode(r.text or "", add_special_tokens=False).ids
        assert r.tokens == want and r.decoded_ == lib.decode(want, skip_special_tokens=False)
    assert word_bpe.encode(df.limit(0), path).count() == 0
    assert word_bpe.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>"), path).select("decoded").collect() == [("",), ("",)]


def test_long_words_like_short_ones():
    coder = word_bpe.WordBpe.of(tokenizer("word_bpe_49k.json"))
    rng = random.Random(6)
    for letters in ("ab", "etaoinshr", "e"):
        for _ in range(100):
            word = "".join(rng.choices(letters, k=rng.randint(2, word_bpe.SHORT)))
            assert coder._merge_long(word) == coder.merge(word)
            coder.ascending = False
            assert coder._merge_long(word) == coder.merge(word)
            coder.ascending = True


def test_registered(spark, tmp_path):
    """The queries over small tables, against the brute-force versions."""
    rows = [r for r in random_turns(9, 40) if r[0] is not None]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([*enumerate(BPE_TEXTS)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op11_conversation_repair"](spark, str(tmp_path))
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == plain_repair(rows)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert collections.Counter(map(tuple, queries.QUERIES["op13_prefix_trie"](spark, str(tmp_path)).select(names).collect())) == plain_trie(rows)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    for r in queries.QUERIES["op12_word_bpe"](spark, str(tmp_path)).collect():
        ids = lib.encode(BPE_TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))
