import base64
import random
import re
import unicodedata

import duckdb
import pytest
import tiktoken

from reelgrain.llm import bpe, leakage, pieces, queries, sampling, splits
from reelgrain.session import table


@pytest.fixture(scope="module")
def own():
    return bpe.Encoder(bpe.read_vocabulary())


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_sql(spark, data):
    con = duckdb.connect()
    for name in ("manifest", "label_alias", "sampling_target"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, data)
        assert sorted(map(tuple, df.collect())) == sorted(con.execute(sql).fetchall())


def test_encoding_is_the_public_one(spark, data, own, reference):
    texts = {r.doc_id: r.text for r in table(spark, data, "documents").collect()}
    got = {r.doc_id: r.ids for r in bpe.encoded(table(spark, data, "documents")).collect()}
    assert got == {k: reference(t) if t else [] for k, t in texts.items()}
    rng = random.Random(2)
    for text in ["", " ", "\n\n  \t x", "<|endoftext|>", "a" * 20_000, "".join(rng.choice("ab") for _ in range(20_000)), "日本語😀🏳️‍🌈" * 50, "\u0000﻿​", "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0xD7FF), rng.randrange(0x10000, 0x1FFFF)])) for _ in range(5000))]:
        assert list(own.encode(text)) == reference(text)
    assert list(own.encode(None)) == [] and own.queue.pop() is None


def test_pieces_hold_the_text(own):
    rng = random.Random(4)
    texts = ["", "x" * 9000, "é" * 4000, "😀" * 3000, " ".join("word" for _ in range(5000)), "\n\n".join(f"# Part {i}\n\n" + "A sentence here. " * rng.randrange(1, 90) for i in range(40)), "\n" * 6000, "。".join("文字" * 30 for _ in range(60))]
    for text in texts:
        found = pieces.cut(own, text, 256, 32)
        ids = own.encode(text)
        assert found[0][0] == 0 and found[-1][1] == len(ids)
        for (s, e, size, kind, piece), after in zip(found, [*found[1:], None]):
            assert size == len(own.encode(piece)) <= 256 and e > s or not ids
            if after:
                assert 32 <= e - after[0] <= 35 and after[1] > e
        raw, at, whole = text.encode(), [0], b""
        for i in ids:
            at.append(at[-1] + own.lengths[i])
        for s, e, _, _, piece in found:
            assert piece.encode() == raw[at[s] : at[e]]
            whole = whole[: at[s]] + piece.encode()
        assert whole == raw
    assert {k for *_, k, _ in pieces.cut(own, texts[5], 256, 32)} <= {"section", "paragraph", "sentence", "word", "end"}


def test_whole_documents_stay(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "short", "x"), (3, "short", "x"), (4, "word " * 2000, "x")], "doc_id bigint, text string, ids string")
    rows = pieces.pieces(df).collect()
    assert sorted((r.doc_id, r.n_pieces) for r in rows if r.doc_id < 4) == [(1, 1), (2, 1), (3, 1), (3, 1)]
    assert [r.doc_id for r in pieces.oversized(df).collect()] == [4]
    assert {r.doc_id: len(r.ids) for r in bpe.encoded(df).collect()}[1] == 0


def brute_leaks(documents, items):
    find = lambda t: re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", t or "").lower())
    out = set()
    for d, text in documents:
        w = find(text)
        for i, item in items:
            q = find(item)
            n = min(12, len(q))
            grams = {tuple(q[k : k + n]) for k in range(len(q) - n + 1)} if n else set()
            if any(tuple(w[k : k + n]) in grams for k in range(len(w) - n + 1)) and n:
                out.add((d, i))
    return out


@pytest.mark.parametrize("block", [40, 200_000])
def test_leaks_against_brute_force(spark, block):
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(12)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, "Same opening words for all items here " * (i % 2) + say(rng.choice([1, 2, 3, 4, 5, 6, 11, 12, 13, 30]))) for i in range(25)] + [(90, None), (91, ""), (92, "_ . !")]
    documents = [(1, None), (2, ""), (3, " \n")]
    for d in range(10, 90):
        item = rng.choice(items[:25])[1].split()
        k = rng.randrange(len(item))
        part = item[k : k + rng.choice([11, 12, 20])]
        documents.append((d, say(rng.randrange(8)) + rng.choice([" ", "--", "\n\n_"]) + rng.choice([" ", "*"]).join(part).upper() + "; " + say(rng.randrange(8))))
    documents += [documents[5], (200, "ｗ１ W２"), (201, " ".join(t for _, t in items if t) * 20)]
    df = spark.createDataFrame([(d, t, 1) for d, t in documents], "doc_id bigint, text string, item_id int")
    got = sorted(map(tuple, leakage.leaks(df, spark.createDataFrame(items, "item_id bigint, text string"), block_words=block).collect()))
    assert got == sorted(brute_leaks(documents, items))


def test_leaks_of_nothing(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    assert leakage.leaks(some, none).count() == 0
    assert leakage.leaks(spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([(1, "a")], "item_id bigint, text string")).count() == 0


ROW = "entry_id bigint, source string, video_sha256 string, group_key string"


def grouped(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], ROW)
    return {r.entry_id: r.group_key for r in splits.linked(df).collect()}


def test_groups(spark):
    d = [f"{i:064x}" for i in range(9)]
    rows = [(1, "B", d[1]), (2, " b ", None), (3, "a", d[1].upper()), (4, None, d[2]), (5, "n/a", f"SHA256:{d[2]}"), (6, "lone", d[3]), (7, None, None), (8, "NULL", "bad"), (9, "", d[1]), (10, "z", d[4]), (11, "y", d[4]), (12, "y", d[5]), (13, "x", d[5])]
    assert grouped(spark, rows) == {1: "a", 2: "a", 3: "a", 9: "a", 4: d[2], 5: d[2], 10: "x", 11: "x", 12: "x", 13: "x"}
    assert grouped(spark, []) == {}


def test_long_chain_and_hot_source(spark):
    rows = [(i, f"s{i // 2:03d}", f"{(i + 1) // 2:064x}") for i in range(200)] + [(1000 + i, "hot", None) for i in range(500)]
    got = grouped(spark, rows)
    assert {got[i] for i in range(200)} == {"s000"} and {got[1000 + i] for i in range(500)} == {"hot"}


def test_splits_keep_groups_whole(spark, data):
    m, t = table(spark, data, "manifest"), table(spark, data, "split_target")
    rows = splits.assign(m, t).collect()
    assert len(rows) == m.count() and {r.split_name for r in rows} <= {"train", "validation", "test"}
    by = {}
    for r in rows:
        if r.group_key is not None:
            by.setdefault(r.group_key, set()).add(r.split_name)
    assert all(len(s) == 1 for s in by.values())


def test_split_shares(spark):
    df = spark.createDataFrame([(i, f"s{i // 3}" if i < 8000 else "hot", None, "x") for i in range(12_000)], ROW)
    t = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split_name string, target_share double")
    got = {r.split_name: r["count"] / 12_000 for r in splits.assign(df, t).groupBy("split_name").count().collect()}
    assert all(abs(got[k] - v) < 0.02 for k, v in (("train", 0.8), ("validation", 0.1), ("test", 0.1)))


def test_spread():
    assert sampling.spread(10, [1, 1], [0, 0], [100, 100]) == [5, 5]
    assert sampling.spread(10, [1, 1], [0, 0], [2, 100]) == [2, 8]
    assert sampling.spread(10, [9, 1], [0, 4], [100, 100]) == [6, 4]
    assert sampling.spread(10, [1, 1], [0, 0], [3, 3]) == [3, 3]
    rng = random.Random(0)
    for _ in range(300):
        n = rng.randrange(1, 8)
        caps, least = [rng.randrange(0, 50) for _ in range(n)], [rng.randrange(0, 5) for _ in range(n)]
        q = rng.randrange(0, 150)
        got = sampling.spread(q, [rng.random() for _ in range(n)], least, caps)
        floor = sum(min(a, c) for a, c in zip(least, caps))
        assert sum(got) == max(floor, min(q, sum(caps))) and all(min(a, c) <= g <= c for a, g, c in zip(least, got, caps))


def test_unmet_quota_goes_to_siblings_first():
    leaves = [sampling.Leaf("a", "x", 0.25, 0, 1), sampling.Leaf("a", "y", 0.25, 0, 100), sampling.Leaf("b", "z", 0.5, 0, 100)]
    assert sampling.allocate(leaves, 40) == [1, 19, 20]
    assert sampling.allocate([sampling.Leaf("a", "x", 0.25, 0, 1), sampling.Leaf("a", "y", 0.25, 0, 4), leaves[2]], 40) == [1, 4, 35]


def test_draw(spark):
    rows = [(i, " Real " if i % 10 else "fake", " Cam" if i % 4 else "gen", "x") for i in range(4000)] + [(9000, None, "cam", "x"), (9001, "odd", "cam", "x"), (9002, "real", None, "x")]
    m = spark.createDataFrame(rows, "entry_id bigint, expected_label string, generator_or_camera string, label string")
    labels = spark.createDataFrame([("real", "real"), ("fake", "ai_generated")], "alias string, expected_label string")
    t = spark.createDataFrame([("real", "cam", 0.6, 2, 500), ("ai_generated", "gen", 0.3, 2, 500), ("ai_generated", "nowhere", 0.1, 2, 500)], "expected_label string, generator_or_camera string, target_share double, min_rows bigint, sample_size bigint")
    got = [r.entry_id for r in sampling.draw(m, labels, t).collect()]
    assert len(got) == len(set(got)) == 500 and sorted(got) == sorted(r.entry_id for r in sampling.draw(m.repartition(7), labels, t).collect())
    report = {(r.expected_label, r.generator_or_camera): (r.available, r.drawn, r.unmet) for r in sampling.report(m, labels, t).collect()}
    assert report["ai_generated", "nowhere"] == (0, 0, True) and report["ai_generated", "gen"][1] == 200
    assert sampling.draw(m.limit(0), labels, t).count() == 0



def test_splits_spread_labels_and_generators(spark):
    """Sources of one label and one generator each: large ones of one label come first by size, small ones are many."""
    rows = []
    for i in range(40):
        rows += [(f"big{i}", ("Fake ", "real")[i < 20], f"g{i % 2}")] * (110 if i < 20 else 90)
    for i in range(1000):
        rows += [(f"small{i}", ("real", None, "fake")[i % 3], ("g0", "G1 ", "g2")[i % 7 % 3])] * 4
    df = spark.createDataFrame([(k, *r, None) for k, r in enumerate(rows)], "entry_id bigint, source string, expected_label string, generator_or_camera string, video_sha256 string")
    t = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split_name string, target_share double")
    aliases = spark.createDataFrame([("fake", "ai_generated"), ("real", "real")], "alias string, expected_label string")
    got = {r.entry_id: r.split_name for r in splits.assign(df, t, aliases=aliases).collect()}
    assert len(got) == len(rows)
    for value in (1, 2):
        seen = {}
        for k, r in enumerate(rows):
            seen.setdefault((r[value] or "").strip().lower(), []).append(got[k])
        for name, where in seen.items():
            assert all(abs(where.count(s) / len(where) - v) < 0.03 for s, v in (("train", 0.8), ("validation", 0.1), ("test", 0.1))), name
