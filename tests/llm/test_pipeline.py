"""The pipeline's stages against plain versions, on planted cases."""

import random

import corpus_pipeline as P
import pytest

import __spark_entry__ as entry


def prose(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(21)
    items = [(i, prose(rng, 30)) for i in range(5)]
    clean = [(i, prose(rng, rng.randint(40, 300))) for i in range(200)]
    shared = prose(rng, 60)
    clean += [(300 + i, f"{prose(rng, 200)} {shared} {prose(rng, 150)}") for i in range(20)]  # a passage that documents share
    copies = [(500 + i, clean[i][1]) for i in range(10)] + [(500, clean[0][1])]
    near = []
    for i in range(10, 20):
        w = clean[i][1].split()
        w[len(w) // 2] = "changed"
        near.append((500 + i, " ".join(w)))
    leaked = [(600 + i, f"{prose(rng, 50)} {items[i % 5][1].upper()} {prose(rng, 50)}") for i in range(10)]
    junk = [(700, None), (701, ""), (702, "1234 !!! 5678"), (703, "\n")]
    rows = [(i, t, "aa", "s", len(t or "")) for i, t in clean + copies + near + leaked + junk]
    folder = tmp_path_factory.mktemp("planted")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), {i for i, _ in clean}, {i for i, _ in copies + near}, {i for i, _ in leaked}, {i for i, _ in junk}


def test_stages(spark, planted):
    folder, clean, copies, leaked, junk = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    a = P.known_language(spark, docs, folder)
    assert a.columns == docs.columns and ids(a) == clean | copies | leaked
    b = P.one_of_each_group(spark, docs, folder)
    assert b.columns == docs.columns and ids(b) & (clean | copies | leaked) == clean | leaked
    c = P.no_leaks(spark, docs, folder)
    assert c.columns == docs.columns and ids(c) == clean | copies | junk
    assert ids(P.length_buckets(spark, docs, folder)) == ids(docs)


def test_language_rejects_junk(spark):
    rng = random.Random(22)
    words = {x: ["".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(200)] for x, letters in (("aa", "ghijkkkklmnop"), ("bb", "opqrstttuvwxy"))}
    clean = [(i, " ".join(rng.choices(words[x], k=rng.randint(40, 300))), x) for i in range(300) for x in ["aa", "bb"][i % 2 : i % 2 + 1]]
    letters = "abcdefghijklmnopqrstuvwxyz"
    junk = [(1000 + i, "".join(rng.choices(letters, k=rng.choice([300, 3000]))), None) for i in range(20)]
    junk += [(1100 + i, prose(rng, 200, letters), None) for i in range(20)] + [(1200 + i, rng.randbytes(600).hex(), None) for i in range(20)]
    docs = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in P.known_language(spark, docs, "").collect()}
    assert kept == {i for i, *_ in clean}


def test_run(spark, planted):
    folder, clean, *_ = planted
    assert {r.doc_id for r in entry.queries()["pipeline"](spark, folder).collect()} == clean


def test_empty_table(spark, planted, tmp_path):
    folder = planted[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_registered(spark):
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
