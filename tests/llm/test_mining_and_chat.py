"""Hard negatives, collocations and chat formatting against brute force and exact round trips."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from postmill.llm import chat, collocations, negatives, queries

VECTORS = "vec_id bigint, embedding array<float>, label int, rid string, vector int"
TURNS = "conv_id bigint, turn bigint, role string, text string, segments int"
DATA = "/root/testdata/sf0.001"


def plain_negatives(rows, anchor, n_positives=5, n_negatives=3):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = Counter()
    for n, (i, v, lab) in enumerate(ok):
        if i is None or not anchor(i):
            continue
        scored = sorted(((-dot(v, w), j is None, j or 0, j, m) for m, (j, w, _) in enumerate(ok) if m != n))
        positives = [(-s, j) for s, _, _, j, m in scored if ok[m][2] == lab][:n_positives]
        for p, pid in positives:
            fits = [(-s, j) for s, _, _, j, m in scored if ok[m][2] != lab and 50 * p <= -100 * s <= 95 * p][:n_negatives]
            out.update((i, pid, r + 1, j, p, s) for r, (s, j) in enumerate(fits))
    return out


@pytest.mark.parametrize("digit, block, held", [(8, 2048, 1 << 17), (3, 12, 2)])
def test_hard_negatives(spark, monkeypatch, digit, block, held):
    """Nulls, ties, repeated ids and rows, vectors of several lengths, negative scores; with three bits a pass and small blocks too."""
    monkeypatch.setattr(negatives, "DIGIT", digit)
    monkeypatch.setattr(negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(negatives, "HELD", held)
    rnd = random.Random(4)
    rows = [(i, [rnd.choice([-0.5, 0.1, 0.25, 0.5, rnd.random()]) for _ in range(4)], rnd.randrange(3)) for i in range(60)]
    rows += [(100 + i, [0.5, 0.5, 0.5, 0.5], i % 2) for i in range(30)]  # a common vector
    rows += [(5, rows[5][1], rows[5][2]), (5, [0.4] * 4, 1), (None, [0.5] * 4, 0), (200, None, 1), (205, [0.1, None], 1), (210, [float("nan")] * 4, 1), (215, [float("inf")] * 4, 1)]
    rows += [(220, [0.3] * 4, None), (225, [], 1), (230, [0.9, 0.9], 2), (235, [-0.5] * 4, 2), (240, [0.3] * 6, 0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS).repartition(3)
    got = negatives.hard_negatives(df, F.col("vec_id") % 5 == 0)
    assert Counter(map(tuple, got.collect())) == plain_negatives(rows, lambda i: i % 5 == 0)
    assert got.schema.simpleString() == "struct<anchor_id:bigint,positive_id:bigint,rank:int,negative_id:bigint,positive_score:bigint,negative_score:bigint>"


def test_hard_negatives_of_large_components(spark):
    """Scores beyond what a double holds exactly; beyond a long it says so."""
    rnd = random.Random(5)
    rows = [(i, [float(np.float32(rnd.uniform(0.5, 1) * 2**20)) for _ in range(3)], i % 2) for i in range(40)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)
    assert Counter(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % 4 == 0).collect())) == plain_negatives(rows, lambda i: i % 4 == 0)
    with pytest.raises(ArithmeticError):
        negatives.hard_negatives(spark.createDataFrame([(0, [1e30], 1, "x", 1), (1, [1e30], 1, "x", 1)], VECTORS), F.lit(True))


def test_hard_negatives_of_nothing(spark):
    df = spark.createDataFrame([], VECTORS)
    assert negatives.hard_negatives(df, F.lit(True)).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(1, [1.0], 1, "x", 1)], VECTORS), F.lit(None).cast("boolean")).count() == 0


def plain_collocations(rows, longest=4, least=30, most=2000):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = [x for x in re.split("[ \t]", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        cover = Counter()
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    cover[p[i : i + m]] = max(cover[p[i : i + m]], a)
        ranked = []
        for p, a in found.items():
            if 100 * cover[p] < 80 * a:
                s, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(ranked)[:most])]
    return sorted(out)


@pytest.mark.parametrize("size", [1 << 23, 400])
def test_collocations(spark, monkeypatch, size):
    monkeypatch.setattr(collocations, "SHARD_BYTES", size)
    rnd = random.Random(6)
    vocab = ["Ab", "ab", "é", "É", "x", "y", "zz", "<b>", "na me", "中"]
    text = lambda: "".join(rnd.choice(vocab) + rnd.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\x0b", "\r\n", "! "]) for _ in range(rnd.randint(0, 60)))
    rows = [(text(), rnd.choice(["en", "en", "de", None, "und"])) for _ in range(150)]
    rows += [("a a a a a a a a", "fr")] * 20 + [("x y zz", "en")] * 40 + [("", "en"), (None, "en"), (None, None), (" \t.", "es"), ("one two three", "es"), ("x y " * 3000, "it")]
    df = spark.createDataFrame([(i, t, lang, "w1") for i, (t, lang) in enumerate(rows)], "doc_id bigint, text string, lang string, shard string").repartition(3)
    got = collocations.collocations(df)
    want = plain_collocations(rows)
    assert sorted(map(tuple, got.collect())) == want and {r[0] for r in want} >= {"en", "und", "fr", "it"}
    assert sorted(map(tuple, collocations.collocations(df, longest=3, least=5, most=7).collect())) == plain_collocations(rows, 3, 5, 7)
    assert collocations.collocations(df.limit(0)).count() == 0


def test_scores_beyond_64_bits(spark):
    a, parts = 4 * 10**18, 9 * 10**18
    df = spark.createDataFrame([(a, parts)], "a bigint, parts bigint")
    assert df.select(collocations._score(F.col("a"), F.col("parts"), 2_000_000)).first()[0] == 2_000_000 * a // parts


def test_chats_round_trip(spark):
    rnd = random.Random(7)
    bits = ["<", "|", "\\", "<|im_end|>", "<|im_start|>", "assistant", "\n", "a", "é", " ", "<\\|", ">", "\\n", "\\b", "$1"]
    roles = ["user", "assistant", "system", "tool", None, "", "a\nb", "<|im_end|>\n", "\\n", "<\\|", "\\b"]
    rows = [(c, t, rnd.choice(roles), rnd.choice([None, "", "".join(rnd.choices(bits, k=rnd.randint(0, 12)))])) for c in range(60) for t in range(rnd.randint(1, 9))]
    rows += [(None, 0, "user", "x"), (None, None, "user", "first"), (7, 1, "user", "same turn"), (7, 1, "user", "same turn"), (99, 0, "assistant", "w " * 200_000)]
    made = chat.format_chats(spark.createDataFrame([(*r, 1) for r in rows], TURNS).repartition(3))
    got = {r.conv_id: r for r in made.select("*", chat.formatted(F.col("segments")).alias("out"), chat.read_turns(chat.formatted(F.col("segments"))).alias("turns")).collect()}
    digests = {r.conv_id: r for r in chat.digests(made).collect()}
    groups = defaultdict(list)
    for c, t, role, text in rows:
        groups[c].append((t is not None, t or 0, role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == set(groups) == set(digests)
    for c, turns in groups.items():
        turns = [t[2:] for t in sorted(turns)]
        assert [tuple(t) for t in got[c].turns] == turns
        assert got[c].out.count("<|im_start|>") == got[c].out.count("<|im_end|>") == len(turns)
        said = "".join(t for role, t in turns if role == "assistant")
        d = digests[c]
        assert (d.n_turns, d.turns_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)))
        assert (d.loss_chars, d.loss_sha256, d.formatted_chars) == (len(said), sha(said), len(got[c].out))
        assert [s.loss for s in got[c].segments] == [x for role, _ in turns for x in (False, role == "assistant", False)]


def test_chat_machine(spark):
    cases = {"ua": (True, None), "sua": (True, None), "uaua": (True, None), "u": (False, None), "s": (False, None), "su": (False, None), "a": (False, 1), "uu": (False, 2), "uaa": (False, 3), "uas": (False, 3), "usa": (False, 2), "uax": (False, 3)}
    role = {"u": "user", "a": "assistant", "s": "system", "x": None}
    rows = [(i, t, role[r], "t", 1) for i, order in enumerate(cases) for t, r in enumerate(order)]
    got = {r.conv_id: (r.valid, r.stop) for r in chat.format_chats(spark.createDataFrame(rows, TURNS)).collect()}
    assert got == dict(enumerate(cases.values()))
    own = chat.Template("<#T>", "<#E>", "", ("<", "#"), ("bot",), {(chat.START, "bot"): "done"}, ("done",))
    one = chat.format_chats(spark.createDataFrame([(1, 0, "bot", "<#T><\\#", 1)], TURNS), own).select("valid", chat.formatted(F.col("segments")).alias("out"), chat.loss_text(F.col("segments"), own).alias("loss")).first()
    assert (one.valid, one.out, one.loss) == (True, "<#T>bot\n<\\#T><\\\\#<#E>", "<#T><\\#")
    for bad in (("<|a", "<|a", "\n"), ("x", "<|e", "\n"), ("<|s", "<|e", "<|")):
        with pytest.raises(ValueError):
            chat.Template(*bad)
    assert chat.format_chats(spark.createDataFrame([], TURNS)).count() == 0


@pytest.mark.parametrize("name", ["op11_negatives", "op12_collocations", "op13_chat"])
def test_queries_equal_their_sql(spark, name):
    got = queries.QUERIES[name](spark, DATA)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = sorted(got.columns)
    assert sorted(c[0] for c in want.description) == columns
    at = [[c[0] for c in want.description].index(c) for c in columns]
    rows = [tuple(r[i] for i in at) for r in want.fetchall()]
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(rows) and rows
