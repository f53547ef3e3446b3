"""Corpus operators against brute force on small tables with nulls, ties, empties and repeated rows."""

import hashlib
import importlib
import itertools
import json
import os
import random
import re
import time
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from postmill.llm import bpe, exact, fingerprints, html_wrappers, mixing, ngram_join, quality, suffix, toxicity, urls
from postmill.llm.queries import URL_RULES, tokenizer_path

SCHEMA = "doc_id bigint, text string, lang string, source string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "en", "s0")[:4] if len(r) == 2 else r for r in rows], SCHEMA)


def words(rnd, n, letters="abcde"):
    return " ".join("".join(rnd.choices(letters, k=rnd.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(1)
    base = [words(rnd, n) for n in (60, 80, 120, 160)]
    passage = words(rnd, 140)
    out = []
    for i in range(90):
        t = rnd.choice(base).split()
        for _ in range(rnd.randint(0, 4)):
            t[rnd.randrange(len(t))] = words(rnd, 1)
        out.append((i, " ".join(t) + rnd.choice(["", "", "\n" + passage, " " + passage[rnd.randint(0, 300) :], " " + words(rnd, 20)])))
    out += [(i, words(rnd, rnd.randint(0, 9))) for i in range(100, 120)]
    out += [(200, "A b"), (201, "a B"), (202, ""), (203, None), (204, " \t\n"), (None, out[0][1]), (None, None), (5, out[5][1]), (300, "ab " * 500), (301, "ab " * 400 + "x"), (302, "é" * 400), (303, "x" * 399)]
    return out


def test_exact_copies(spark, rows):
    got = exact.assign_copies(frame(spark, rows).repartition(3)).collect()
    norm = lambda t: (t or "").encode().lower().decode()
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    want = Counter((i, max((x for x in groups[norm(t)] if x is not None), default=None), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)
    kept = exact.drop_copies(frame(spark, rows).withColumn("digest", F.lit("own"))).collect()
    assert len(kept) == len(groups) and {r.digest for r in kept} == {"own"}
    assert exact.assign_copies(frame(spark, [])).count() == 0


def test_exact_copies_merge_in_rounds(spark):
    df = spark.range(0, 400, 1, 20).select(F.col("id").alias("doc_id"), (F.col("id") % 7).cast("string").alias("text"))
    assert {(r.keep_id, r.group_size) for r in exact.assign_copies(df).collect()} == {(max(range(k, 400, 7)), len(range(k, 400, 7))) for k in range(7)}


def test_exact_copies_in_small_batches(spark):
    """A task's runs come in many Arrow batches; copies across their borders are one."""
    df = spark.range(0, 3000, 1, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 700).alias("text"))
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = exact.assign_copies(df).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    assert {(r.keep_id, r.group_size) for r in got} == {(max(range(k, 3000, 700)), len(range(k, 3000, 700))) for k in range(700)}


def test_near_duplicates(spark, rows):
    got = ngram_join.near_duplicates(frame(spark, rows))
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    members = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        members[find(k)].append(i)
    want = Counter((i, len(sets[k]), min((x for x in members[find(k)] if x is not None), default=None)) for k, (i, _) in enumerate(rows))
    got = got.collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert len({r.component_id for r in got if r.kept}) == len({w[2] for w in want})
    assert ngram_join.near_duplicates(frame(spark, [])).count() == 0
    assert set(ngram_join.keep_one(frame(spark, rows).withColumn("root", F.lit(1))).columns) == {"doc_id", "text", "lang", "source", "root"}


def components_of(texts):
    """Of each text the place of the first one that links reach, by comparing all pairs."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if both and 100 * both >= 80 * (len(a) + len(b) - both):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize(("rounds", "held"), [(0, 300), (2, 500_000)])
def test_near_copies_of_large_groups(spark, rounds, held):
    """Two large groups of near copies around the threshold, a passage that many others share, sets of two to nine words."""
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    bases, common, texts = [word(90), word(60)], word(40), []
    for base in bases:
        for _ in range(110):
            own = list(base)
            for at in rng.integers(0, len(own), rng.integers(0, 4)):
                own[at : at + int(rng.integers(0, 3))] = word(int(rng.integers(0, 3)))
            texts.append(" ".join(own))
    texts += [" ".join(common + word(int(rng.integers(5, 60)))) for _ in range(60)]
    texts += [" ".join(["a", "b", "c", "d", "e", "f", "g", "h", "i"][: int(k)]) for k in rng.integers(1, 10, 20)]
    texts += texts[:30]
    want = components_of(texts)
    got = ngram_join.near_duplicates(frame(spark, list(enumerate(texts))).repartition(7), rounds=rounds, held_tokens=held).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(want))


@pytest.mark.parametrize("rounds", [0, 2])
def test_groups_of_several_components(spark, rounds):
    """Sets of one size with one prefix, the rarest shingles of a common head, but two bodies: one group, two components."""
    rng = np.random.default_rng(9)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    head, joint, texts = word(40), word(4), []
    for body in (word(100), word(100)):
        for _ in range(10):
            own = list(body)
            own[int(rng.integers(20, 80))] = word(1)[0]
            texts.append(" ".join(head + joint + own))
        texts += [" ".join([*word(20 + i), *joint, *body]) for i in range(15)]
    got = ngram_join.near_duplicates(frame(spark, list(enumerate(texts))), rounds=rounds).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(components_of(texts)))


def thue_morse(n):
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_complements_of_thue_morse_have_names_of_their_own(spark):
    docs = [x for n in (512, 1024, 4096) for x in thue_morse(n)]
    got = ngram_join.near_duplicates(frame(spark, list(enumerate(docs)))).collect()
    assert all(r.component_id == r.doc_id for r in got)
    for x, y in zip(docs[::2], docs[1::2], strict=True):
        names = suffix.Names(np.frombuffer((x + y).encode(), np.uint8))
        assert all(names(np.array([0]), len(x), k) != names(np.array([len(x)]), len(x), k) for k in (0, 1))
    half, (x, y) = "0123456789" * 20, thue_morse(512)
    texts = [half[:150] + x + "left", half[50:] + y + "right", *docs]
    seen = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    gone = [len({j for i in range(len(t) - 399) if seen[t[i : i + 400]] > 1 for j in range(i, i + 400)}) for t in texts]
    got = suffix.remove_repeats(frame(spark, list(enumerate(texts)))).collect()
    assert [r.n_removed for r in sorted(got)] == gone


def test_repeats(spark, rows):
    got = suffix.remove_repeats(frame(spark, rows))
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    want = Counter()
    for (i, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 399):
            if seen[t[k : k + 400]] > 1:
                gone[k : k + 400] = True
        starts = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        want[i, len(t), int(gone.sum()), starts, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()] += 1
    assert Counter(tuple(r) for r in got.collect()) == want
    full = suffix.remove_repeats(frame(spark, rows[:20]), with_kept=True).collect()
    assert all(len(r.kept) == r.n_bytes - r.n_removed == r.n_bytes - sum(s.end - s.begin for s in r.spans) for r in full)
    assert suffix.remove_repeats(frame(spark, [])).count() == 0


def test_contested_intervals_have_numbers_of_their_own(spark, rows, monkeypatch):
    """Intervals are joined by a number that no two share; a hash would at some size give two of them one."""
    seen = []
    contexts_of = suffix._contexts
    monkeypatch.setattr(suffix, "_contexts", lambda docs, wanted: seen.append(contexts_of(docs, wanted)) or seen[-1])
    suffix.repeated_windows(frame(spark, rows))
    n, own, intervals = seen[0].agg(F.count("*"), F.countDistinct("cid"), F.countDistinct(F.struct("k1", "k2", "a", "s"))).first()
    assert n == own == intervals > 50


def test_bpe_is_the_library(spark, rows):
    tokenizers = pytest.importorskip("tokenizers")
    rnd = random.Random(2)
    alphabet = ["a", "b", "é", " ", "  ", "\n", "\t", "'s", "'ll", "_", "1", "२", "²", "½", "ª", "ñ", "<|endoftext|>", "😀", "日本", "\x1c", "\x85", "\xa0", "!?", "Ā", "ȡ"]
    more = [(1000 + i, "".join(rnd.choices(alphabet, k=rnd.randint(0, 60)))) for i in range(300)] + [(2000, "z" * 3000 + " " * 500), (2001, "Word" * 100)]
    every = rows + more
    library = tokenizers.Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for i, t in every:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    encoded = bpe.encode_documents(frame(spark, every), tokenizer_path(), with_ids=True)
    assert Counter(tuple(r)[:4] for r in encoded.collect()) == want
    back = bpe.decode_documents(encoded.select("doc_id", "ids"), tokenizer_path())
    assert Counter(tuple(r) for r in back.collect()) == Counter((i, t or "") for i, t in every)
    assert bpe.encode_documents(frame(spark, []), tokenizer_path()).count() == 0


def test_the_driver_compiles_no_lexicon(spark, monkeypatch):
    """Merges, words and states of a lexicon are hundreds of MB of objects: a task makes them, the driver gets the packed arrays."""
    tokenizers = pytest.importorskip("tokenizers")

    def only_in_tasks(name, driver=os.getpid()):
        def make(*args):
            assert os.getpid() != driver, "made on the driver"
            return getattr(importlib.import_module("postmill.llm.bpe"), name)(*args)

        return make

    texts = ["one two three one two", "three two one " * 5, None, ""]
    want = tokenizers.Tokenizer.from_file(tokenizer_path())
    for name in ("Merges", "compile_lexicon"):
        monkeypatch.setattr(bpe, name, only_in_tasks(name))
    for chunk in (bpe._CHUNK, 64):
        monkeypatch.setattr(bpe, "_CHUNK", chunk)
        for r in bpe.encode_documents(frame(spark, list(enumerate(texts))), tokenizer_path(), with_ids=True, with_decoded=False).collect():
            assert np.frombuffer(r.ids, "<u4").tolist() == want.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
    monkeypatch.undo()
    assert bpe.encode_documents(frame(spark, []), tokenizer_path()).count() == 0  # a lexicon without words needs no task


def test_long_words_stay_out_of_lexicon_and_memory(spark):
    """Words beyond 64 bytes are merged each time: neither the driver nor a worker's memo holds them."""
    tokenizers = pytest.importorskip("tokenizers")
    rnd = random.Random(21)
    blob, han = "".join(rnd.choices("ABCdef", k=200_000)), "日本語文" * 500
    with open(tokenizer_path(), encoding="utf-8") as f:
        spec = json.load(f)
    docs = frame(spark, [(i, f"{blob} {han} short {'日' * 21} {'日' * 22}") for i in range(3)])
    found = bpe.frequent_words(docs, spec)
    assert " short" in found and " " + "日" * 21 in found and max(len(w.encode()) for w in found) <= bpe.WORD_BYTES
    library = tokenizers.Tokenizer.from_file(tokenizer_path())
    for r in bpe.encode_documents(docs, tokenizer_path(), with_ids=True).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(f"{blob} {han} short {'日' * 21} {'日' * 22}", add_special_tokens=False).ids
    merges = bpe.Merges(spec)
    none = SimpleNamespace(index=lambda words: np.full(len(words), -1))
    encoder = bpe.Encoder(merges, none)
    encoder.encode([f"{blob} a {han}", han])
    assert set(encoder.memo) == {" a"}


@pytest.mark.parametrize(
    "change",
    [
        {"normalizer": {"type": "NFC"}},
        {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "use_regex": True}},
        {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}},
        {"pre_tokenizer": {"type": "Whitespace"}},
        {"pre_tokenizer": None},
        {"decoder": None},
        {"added_tokens": [{"id": 1, "content": "<x>", "lstrip": True}]},
        {"model": {"type": "WordPiece"}},
        {"model": {"type": "BPE", "ignore_merges": True}},
    ],
)
def test_other_tokenizer_settings_are_refused(change):
    fine = {"model": {"type": "BPE", "dropout": None}, "normalizer": None, "added_tokens": [{"id": 0, "content": "<y>"}], "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}, "decoder": {"type": "ByteLevel"}}
    bpe.refuse_other_settings(fine)
    with pytest.raises(ValueError):
        bpe.refuse_other_settings(fine | change)


def test_lexicon_is_minimal_and_exact(tmp_path):
    vocabulary = {w.encode(): [len(w)] * (len(w) % 3) for w in ("car", "cars", "cat", "cats", "dog", "dogs", "do", "")}
    parts = bpe.compile_lexicon(vocabulary)
    (tmp_path / "x").write_bytes(bpe.Lexicon.packed(parts))
    lexicon = bpe.Lexicon(str(tmp_path / "x"))
    assert lexicon.index(sorted(vocabulary)).tolist() == list(range(len(vocabulary)))
    assert lexicon.index([b"ca", b"carsx", b"zzz", b"d"]).tolist() == [-1] * 4
    assert len(parts["final"]) < 10  # the suffix s is shared


def test_fingerprints(spark, rows):
    got = fingerprints.fingerprint_documents(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    order = sorted(((i, t or "") for i, t in rows if i is not None), key=lambda x: -x[0])
    unique = [x for x in order if [y[0] for y in order].count(x[0]) == 1]
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}

    def pieces(t):
        out, piece = Counter(), []
        tokens = [x for w in re.findall(r"\n|[^\x20\x09-\x0D]+", t) for x in (re.findall("(?s).{1,32}", w) if len(w.encode()) > 32 else [w])]
        for i, x in enumerate(tokens, 1):
            piece.append(x)
            h = xxhash.xxh64_intdigest(x, seed=42)
            if x != "\n" and (i == len(tokens) or tokens[i] == "\n" or (h - (h >> 63 << 64)) % (4 if i <= 48 else 24) == 0):
                out[tuple(piece)] += 1
                piece = []
        return out

    def like(a, b):
        x, y = pieces(a), pieces(b)
        return (x & y).total() / (x | y).total() if x | y else 1.0

    checked = 0
    for k, (i, t) in enumerate(order[:-1]):
        if (i, t) not in unique or order[k + 1] not in unique:
            continue
        after, third = order[k + 1][1], len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        r = by_id[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_next == pytest.approx(like(t, after)) and r.near_edited == pytest.approx(like(t, edited))
        checked += 1
    assert checked > 100
    same = defaultdict(set)
    for r in got:
        if r.doc_id in (202, 203):
            same["empty"].add(r.fingerprint)
    assert len(same["empty"]) == 1
    assert fingerprints.fingerprint_documents(frame(spark, [(1, "a b")])).first().near_next == 1.0
    assert fingerprints.fingerprint_documents(frame(spark, [])).count() == 0


def test_fingerprints_of_writing_without_spaces(spark):
    """Unspaced, tabbed and wide-spaced texts are near their own edit (two thirds of four thirds are common, but for borders) and far from the next text."""
    rnd = random.Random(12)
    letters = lambda n: "".join(rnd.choices("abcdefghij", k=n))
    docs = [(i, "".join(rnd.choices("的一是不了人我在有他这中大来上个国", k=1200))) for i in range(4)]
    docs += [(10 + i, letters(1200)) for i in range(4)]
    docs += [(20 + i, sep.join(letters(5) for _ in range(300))) for i, sep in enumerate(["\t", "\r", "\x0b", "\x0c", " \t "])]
    got = fingerprints.fingerprint_documents(frame(spark, docs)).collect()
    assert all(r.near_edited > 0.2 and r.near_next < 0.05 for r in got), [(r.doc_id, r.near_edited, r.near_next) for r in got]


def test_fingerprints_can_be_peeled_from_their_texts(spark):
    text = words(random.Random(4), 400, "abcdefgh")
    docs = [(1, text), (2, text[:900] + " other " + text[905:]), (3, text)]
    prints = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint_documents(frame(spark, docs)).collect()}
    assert prints[1] == prints[3] != prints[2]
    told = spark.createDataFrame([(prints[1], prints[2])], "x string, y string").selectExpr(f"{fingerprints.peel(fingerprints.subtract(fingerprints.from_text('x'), fingerprints.from_text('y')), fingerprints.FIRST_CELLS)} as d").first().d
    count = [int(prints[i].split(":")[0]) for i in (1, 2)]
    assert 0 < told.a <= 4 and count[0] - told.a == count[1] - told.b


def test_fingerprints_of_very_many_lines(spark):
    rnd = random.Random(13)
    lines = [f"{rnd.randrange(10**6)} x" for _ in range(50_000)]
    docs = [(1, "\n".join(lines)), (2, "\n".join(["new", *lines[:-5]])), (3, "same\n" * 50_000)]
    began = time.time()
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(frame(spark, docs)).collect()}
    assert time.time() - began < 120
    assert got[2].near_next > 0.99 and got[1].near_next < 0.01 and 0.4 < got[1].near_edited < 0.8


def test_url_rules(spark):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    cases = {
        "http://www.Example.com/en/1?x=/": ("www.example.com", "/en/1", "www.example.com/en/", "allow"), "https://m.example.com/en/": ("m.example.com", "/en/", "example.com/en/", "block"),
        "https://m.example.com/fr/": ("m.example.com", "/fr/", "com/", "allow"), "http://a.net/es/x#y": ("a.net", "/es/x", "net/es/", "block"), "http://a.net/en/": ("a.net", "/en/", None, "allow"),
        "http://com": ("com", "", None, "allow"), "ftp://x.com#/": ("x.com", "", None, "allow"), "x.com/en/": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"),
        "http://example.com:80/en/": ("example.com:80", "/en/", None, "allow"), "a://b.com/://c.net/es/": ("b.com", "/://c.net/es/", "com/", "allow"), "http://É.com/ÉN": ("É.com", "/ÉN", "com/", "allow"),
    }
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id int, url string").withColumn("host", F.lit("clash"))
    odd = spark.createDataFrame([("Éa.com", "/", "block"), ("a.b.c.d", "/x/", "block")], "host string, path string, verdict string")
    asked = [("http://x.Éa.COM/", "block"), ("http://éa.com/", "allow"), ("http://" + "a." * 3000 + "b.c.d/x/", "block"), ("http://b.c.d/x/", "allow")]
    table = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(asked)], "page_id bigint, url string")
    assert {r.page_id: r.verdict for r in urls.judge(table, odd).collect()} == {i: v for i, (_, v) in enumerate(asked)}
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, rules).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    assert urls.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.judge(pages, rules.limit(0), "block").collect()} == {"block"}
    many = spark.range(500).select(F.concat(F.lit("h"), "id", F.lit(".org")).alias("host"), F.lit("/").alias("path"), F.lit("block").alias("verdict"))
    asked = spark.range(1000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), "id", F.lit(".org/a")).alias("url"))
    assert urls.judge(asked, many).where("verdict = 'block'").agg(F.min("page_id"), F.max("page_id"), F.count("*")).first() == (0, 499, 500)


def test_mixing(spark):
    rnd = random.Random(4)
    docs = [(i, "w " * rnd.randint(0, 40), "en", rnd.choice(["a", "b", "B", None, "é"])) for i in range(600)] + [(None, None, "en", "a"), (7, "x y", "en", "only"), (7, "x y", "en", "only")]
    got = mixing.mix_by_source(frame(spark, docs))
    one = got.collect()
    assert Counter(one) == Counter(mixing.mix_by_source(frame(spark, docs)).collect()) and len(one) == len(docs)
    have = defaultdict(int)
    for _, t, _, s in docs:
        have[s] += len((t or "").split())
    targets = mixing.targets_for(have)
    order = ["B", "a", "b", "only", "é", None]
    weights = dict(zip(order, (5, 2, 1, 5, 2, 1), strict=True))
    assert sum(targets.values()) == pytest.approx(1.5 * sum(have.values()))
    free = [s for s in order if targets[s] < 2 * have[s] - 1e-9]
    assert len({round(targets[s] / weights[s], 6) for s in free}) == 1 and all(targets[s] <= 2 * have[s] for s in order)
    taken = defaultdict(int)
    for r in one:
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[r.source_size, round(r.target, 6)] += r.taken
    for s in order:
        assert abs(taken[have[s], round(targets[s], 6)] - targets[s]) <= max(2, 0.02 * targets[s])
    repeated = mixing.repeat_by_source(frame(spark, docs))
    assert repeated.columns == ["doc_id", "text", "lang", "source"]
    assert sum(len((r.text or "").split()) for r in repeated.collect()) == pytest.approx(sum(r.taken for r in one), abs=4)
    assert mixing.mix_by_source(frame(spark, [])).count() == 0


def test_mixing_beside_columns_of_its_names(spark):
    """Columns of documents named as those of the mix change nothing and come back as they were."""
    rnd = random.Random(14)
    docs = frame(spark, [(i, "w " * rnd.randint(1, 30), "en", rnd.choice("abc")) for i in range(200)] + [(None, None, None, None)])
    extra = {c: F.lit(f"own {c}") for c in ("h", "rid", "pattern", "size", "copies", "taken", "target", "source_size", "row", "m_id", "again")}
    plain, clashing = mixing.mix_by_source(docs), mixing.mix_by_source(docs.withColumns(extra))
    assert clashing.columns == plain.columns and Counter(clashing.collect()) == Counter(plain.collect())
    got = mixing.repeat_by_source(docs.withColumns(extra))
    assert got.columns == [*docs.columns, *extra]
    assert Counter(r[:4] for r in got.collect()) == Counter(tuple(r) for r in mixing.repeat_by_source(docs).collect())
    assert {tuple(r[4:]) for r in got.collect()} == {tuple(f"own {c}" for c in extra)}


def test_mixing_goes_on_behind_a_long_document(spark, monkeypatch):
    """A document of half a source's words at the cut hides no later one that fits: the choice is the fold's, row by row."""
    rnd = random.Random(12)
    sizes = {"a": [100_000] + [100] * 1000, "b": [rnd.choice([0, 1, 3, 50, 900, 20_000]) for _ in range(500)], "c": [5, 5, 5]}
    table = [(i, s, n) for i, (s, n) in enumerate((s, n) for s, all_ in sizes.items() for n in all_)]
    docs = spark.createDataFrame(table, "doc_id bigint, source string, words bigint").withColumn("text", F.col("source"))
    extra = {"a": 100_000, "b": sum(sizes["b"]) // 2, "c": 7}
    for bound, seed in ((20_000, 1), (20_000, 2), (0, 3)):
        monkeypatch.setattr(mixing, "FILL_ROWS", bound, raising=False)
        got = mixing.mix(docs, F.array("source"), F.col("words"), {s: sum(sizes[s]) + extra[s] for s in sizes}, 2, seed).collect()
        for s in sizes:
            left = extra[s]
            for r in sorted((r for r in got if r.pattern == [f"s{s}"]), key=lambda r: (r.h, r.rid)):
                fits = r["size"] <= left
                assert r.copies == 1 + fits or r["size"] == 0
                left -= r["size"] * fits
            assert left == {"a": 0, "b": left, "c": 2}[s]


def test_flow_with_overlapping_sources():
    flow = mixing.min_cost_flow({("a",): 10, ("a", "b"): 10, ("b",): 4}, {"a": 12, "b": 16}, 2)
    into = Counter()
    for (_, s), f in flow.items():
        into[s] += f
    assert into == {"a": 12, "b": 16}
    used = Counter()
    for (p, _), f in flow.items():
        used[p] += f
    repeats = sum(max(0, used[p] - n) for p, n in {("a",): 10, ("a", "b"): 10, ("b",): 4}.items())
    assert repeats == 4  # 28 of 24 words: no more is repeated than needed


def test_segments_are_maximal():
    rng = np.random.default_rng(3)

    def brute(s, a, b):
        found = [(sum(s[i:j]), i - j, -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)]
        best = max(found, default=(0,))
        return [] if best[0] <= 0 else brute(s, a, best[3]) + [(best[3], best[4])] + brute(s, best[4], b)

    for _ in range(200):
        s = rng.normal(size=rng.integers(0, 12))
        assert [(a, b) for a, b, _ in toxicity.segments(s)] == brute(list(s), 0, len(s))


def test_toxicity_learns_without_the_held_out(spark):
    rnd = random.Random(9)
    docs, labels = [], []
    for i in range(900):
        bad = i % 5 == 0
        t = words(rnd, 60).split()
        if bad:
            t[30:34] = [rnd.choice(["gruxo", "flimbar", "snoddle"]) + rnd.choice(["", "ish"]) for _ in range(4)]
        docs.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    docs += [(None, None), (5000, ""), (5001, "gruxo flimbar snoddle gruxo")]
    table = spark.createDataFrame([*labels, (None, 1), (1, None)], "doc_id bigint, toxic int")
    got = toxicity.score_documents(frame(spark, docs), table, with_passages=True).collect()
    out = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert len(out) > 150 and all(r.predicted == (r.doc_id % 5 == 0) for r in out)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    bad = next(r for r in out if r.predicted)
    text = dict(docs)[bad.doc_id]
    assert any(re.match("gruxo|flimbar|snoddle", text[p.begin : p.end]) for p in bad.passages)
    assert {r.predicted for r in toxicity.score_documents(frame(spark, docs), table.limit(0)).collect()} == {0}
    assert toxicity.score_documents(frame(spark, []), table.limit(0)).count() == 0


def test_token_scores_equal_a_plain_computation():
    """Log-odds under the Dirichlet prior less their standard errors, lambda and K, one number at a time."""
    rng = np.random.default_rng(19)
    n_clean, n_toxic = 900, 120
    clean, toxic = rng.integers(0, 60, 400), rng.integers(0, 60, 400)
    names = [f"w{i}" for i in range(400)]
    want = {}
    for name, c, t in zip(names, clean.tolist(), toxic.tolist(), strict=True):
        alpha = toxicity.PRIOR * (c + t) / (n_clean + n_toxic) + 0.05
        odds = [(x + alpha) / (n + toxicity.PRIOR - x - alpha + 0.1) for x, n in ((t, n_toxic), (c, n_clean))]
        least = np.log(odds[0] / odds[1]) - toxicity.CAUTION * (1 / (t + alpha) + 1 / (c + alpha)) ** 0.5
        if least >= toxicity.LEAST_SCORE and t >= toxicity.LEAST_DOCS:
            want[name] = least
    got = toxicity.token_scores(names, clean.astype(float), toxic.astype(float), float(n_clean), float(n_toxic))
    assert 10 < len(want) < 400 and got == pytest.approx(want)
    scores, shares = np.array([-0.3, 0.8, 1.9]), np.array([0.9, 0.07, 0.03])
    best, m = np.array([0.0, 0.8, 1.6, 1.9]), np.array([10, 50, 90, 400])
    lam, k = toxicity.extreme_values(scores, shares, best, m)
    assert lam > 0.1 and sum(p * np.exp(lam * s) for s, p in zip(scores, shares, strict=True)) == pytest.approx(1)
    assert np.log(k) == pytest.approx(sum(lam * b - np.log(n) for b, n in zip(best[1:], m[1:], strict=True)) / 3 - 0.5772)


def test_toxicity_of_held_out_documents(spark):
    """Documents that don't teach are told apart: each toxic one against each clean one."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    want = {r.doc_id: r.toxic for r in labels.where("toxic is not null").collect()}
    got = toxicity.score_documents(docs, labels).where("held_out").collect()
    toxic, clean = ([r for r in got if want.get(r.doc_id) == y] for y in (1, 0))
    wins = sum((a.score > b.score) + (a.score == b.score) / 2 for a in toxic for b in clean)
    found, false = sum(r.predicted for r in toxic), sum(r.predicted for r in clean)
    assert wins / (len(toxic) * len(clean)) > 0.93
    assert found / len(toxic) > 0.8 and found / (found + false) > 0.85


def test_copies_with_several_labels_teach_the_largest(spark):
    docs = frame(spark, [(i, "one text") for i in range(40)] + [(100 + i, f"text {i}") for i in range(20)]).repartition(5)
    labels = spark.createDataFrame([(i, int(i == 17)) for i in range(40)] + [(100 + i, 0) for i in range(20)] + [(105, 1), (105, 0)], "doc_id bigint, toxic int")
    got = {r.text: r.y for r in toxicity.training_sample(docs, labels, "toxic", F.lit(True), 1000).collect()}
    assert got == {"one text": 1, **{f"text {i}": int(i == 5) for i in range(20)}}


def test_quality_keeps_the_good(spark):
    rnd = random.Random(8)
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        t = words(rnd, 50)
        docs.append((i, t.upper().replace(" ", "!! ") if bad else t, rnd.choice(["en", None]), rnd.choice(["a", "b", None])))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, int(not bad)))
    docs += [(None, None, None, None), (401, "", "en", "a")]
    table = spark.createDataFrame([*labels, (None, 0), (3, None)], "doc_id bigint, quality int")
    df = spark.createDataFrame(docs, SCHEMA).withColumn("row", F.lit("clash"))
    got = quality.judge(df, table).collect()
    assert len(got) == len(docs)
    assert all(r.quality.kept == (r.doc_id % 4 != 0) for r in got if r.doc_id is not None and r.doc_id < 400)
    kept = quality.keep_good(df, table)
    assert kept.columns == df.columns
    assert quality.judge(df, table.limit(0)).where("not quality.kept").count() == 0
    assert quality.keep_good(df.limit(0), table).count() == 0


def _strength(means, groups):
    total = sum(n for _, n in groups)
    seen = sum(n * (bad / n - m) ** 2 for m, (bad, n) in zip(means, groups, strict=True)) / total
    noise = [m * (1 - m) for m in means]
    return max(1.0, min(1e5, sum(noise) / len(noise) / max(seen - sum(noise) / total, 1e-6) - 1))


@pytest.mark.parametrize("spread", [0.0, 0.3])
def test_posteriors_equal_a_plain_computation(spark, spread):
    """Rates by host and path, nulls being sites of their own, against sums in plain Python; sparse paths stay near their host."""
    rnd = random.Random(88)
    rows, centre = [], {}
    for host, path, n in [("a", "x", 300), ("a", "y", 40), ("a", None, 1), ("b", "x", 90), ("b", "y", 2), (None, "x", 25), (None, None, 3), ("c", "x", 1)]:
        centre[host, path] = 0.4 + spread * rnd.choice([-1, 1]) * rnd.random()
        rows += [(host, path, min(1.0, max(0.0, rnd.gauss(centre[host, path], 0.1)))) for _ in range(n)]
    paths, hosts = defaultdict(lambda: (0.0, 0)), defaultdict(lambda: (0.0, 0))
    for host, path, p in rows:
        for table, key in ((paths, (host, path)), (hosts, host)):
            table[key] = (table[key][0] + p, table[key][1] + 1)
    rate = sum(p for *_, p in rows) / len(rows)
    s1 = _strength([rate] * len(hosts), list(hosts.values()))
    by_host = {h: (bad + s1 * rate) / (n + s1) for h, (bad, n) in hosts.items()}
    s2 = _strength([by_host[h] for h, _ in paths], list(paths.values()))
    by_path = {k: (bad + s2 * by_host[k[0]]) / (n + s2) for k, (bad, n) in paths.items()}
    got, got_rate = quality.path_posteriors(spark.createDataFrame(rows, "host string, path string, p_doc double"))
    got = {(r.host, r.path): (r.host_rate, r.path_rate) for r in got.collect()}
    assert got_rate == pytest.approx(rate) and got.keys() == paths.keys()
    for key, (host_rate, path_rate) in got.items():
        assert (host_rate, path_rate) == pytest.approx((by_host[key[0]], by_path[key]), rel=1e-9)
        raw = paths[key][0] / paths[key][1]
        assert min(raw, host_rate) - 1e-12 <= path_rate <= max(raw, host_rate) + 1e-12


def test_quality_of_held_out_documents(spark):
    """A quarter of the labelled documents doesn't teach; the others tell their labels."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 2
    want = {r.doc_id: r.quality for r in labels.where(held & F.col("quality").isNotNull()).collect()}
    got = quality.judge_without_text(docs, labels.where(~held)).select("doc_id", "quality.*").where(held).collect()
    good, bad = ([r for r in got if want.get(r.doc_id) == y] for y in (1, 0))
    wins = sum((g.score > b.score) + (g.score == b.score) / 2 for g in good for b in bad)
    assert len(bad) >= 5 and wins / (len(good) * len(bad)) > 0.98
    assert all(g.kept for g in good) and sum(not b.kept for b in bad) / len(bad) > 0.8


def test_rows_that_repeat_an_id_share_its_label(spark):
    """Rows of one id under several labels: the smallest label teaches, each row is judged by its own text."""
    fine, junk = "plain words in a row here", "BUY!! NOW!! $$$ ### @@@"
    rows = [(i // 2, fine if i // 2 % 2 else junk, "en", "a") for i in range(80)]
    table = spark.createDataFrame([(i, y) for i in range(40) for y in ([1] if i % 2 else [0, 1])], "doc_id bigint, quality int")
    got = quality.judge(spark.createDataFrame(rows, SCHEMA), table).collect()
    assert len(got) == 80 and all(r.quality.kept == (r.text == fine) for r in got)


def test_fingerprints_of_moved_and_repeated_texts(spark):
    """A word in front moves one border; rows that repeat an id and long texts are ordered like others."""
    long = words(random.Random(3), 20_000, "abcdefgh")
    got = fingerprints.fingerprint_documents(frame(spark, [(2, long), (1, "word " + long)])).collect()
    assert {r.doc_id for r in got if r.near_next > 0.97} == {1, 2}
    docs = [(5, f"text {i} of five") for i in range(300)] + [(4, "same")] * 50 + [(None, "x"), (6, "y")]
    got = fingerprints.with_next(frame(spark, docs)).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(docs) and Counter(r.next_text for r in got) == Counter(t for _, t in docs)


def test_quality_beside_columns_of_its_names(spark):
    rows = [(i, "fine words here" if i % 2 else "BAD!! BAD!! $$$", "en", "a", 1, 2, 3) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA + ", quality int, host int, p_doc int")
    table = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    got = quality.judge(df, table)
    assert got.columns == [*df.columns, "quality_"] and {r.doc_id % 2 for r in got.where("quality_.kept").collect()} == {1}
    assert quality.keep_good(df, table).columns == df.columns
    assert {r.kept for r in quality.judge_without_text(df, table).select("quality_.kept").collect()} == {True, False}


def test_quality_counts_all_words():
    at = quality.FEATURES.index("most_common")
    for text in ("buy now " * 2500, "now buy " * 2500, "".join(f"w{i} junk " for i in range(5000)), "a b b"):
        found = Counter(text.split())
        assert quality.features_of(text)[at] == pytest.approx(max(found.values()) / found.total() * np.log(found.total() + 2))


PAGE = "<html><head><title>t</title></head><body><nav><ul><li>Home</li><li>News</li></ul></nav><div class=promo>buy</div><{0}><h1>Title {1}</h1><p>One &amp; <b>two\n {1}</b><br>three<p>Four<aside>no</aside>{2}</{0}><div class='comments'><p>me</p></div><footer>f {1}</footer>"


def test_html_blocks():
    def text(page):  # by the wrapper of this page alone
        blocks = html_wrappers.blocks_of(page)
        return html_wrappers.main_text(blocks, html_wrappers.verdict(html_wrappers.page_items(blocks)))

    assert text(PAGE.format("article", 5, "<script>var a='<p>x</p>'</script>")) == "Title 5\nOne & two 5 three\nFour"
    assert text("") == "" and text("plain &lt;b&gt;") == "plain <b>"
    assert text("<article><div class='post-header'><h1>T</h1><p>by me</p></div><p>x</p></article>") == text("<article><header>by me<h1>T</h1></header><p>x</article>") == "T\nx"
    assert text("<header><h1>Site</h1></header><div class=header><h2>n</h2></div><p>x") == "x"
    assert text("<div><p>a</p><form>f<p>g</p></form><p hidden>h</p><p>i<!-- <p>c</p> -->j</div>") == "a\nij"


def test_wrappers(spark):
    pages = [(i, "http://h.org/1", PAGE.format("div", f"number {i} " * 9, "")) for i in range(12)] + [(50 + i, f"http://x{i}.org/", PAGE.format("article", i, "")) for i in range(3)]
    for i in range(12):  # a frame around the content that only the wrapper tells from it
        pages.append((100 + i, "http://w.org/", f"<body><div id=top><p>Same line everywhere</p></div><div id=main>{''.join(f'<p>text {i} {k} ' + 'long ' * 9 + '</p>' for k in range(1 + i % 3))}</div><div id=end><p>Our address</p></div>"))
    pages += [(900, None, "<p>x</p>"), (901, "u", None), (None, "http://h.org/", "<p>y")]
    got = html_wrappers.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("advice", F.lit(1))).collect()
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[50] == "Title 0\nOne & two 0 three\nFour" and by[900] == "x" and by[901] == "" and by[None] == "y"
    assert by[3].startswith("Title number 3") and "Home" not in by[3] and "buy" not in by[3]
    for i in range(12):
        assert by[100 + i] == "\n".join(" ".join(f"text {i} {k} {'long ' * 9}".split()) for k in range(1 + i % 3))
    assert html_wrappers.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


@pytest.mark.parametrize("tag", ["article", "div"])
@pytest.mark.parametrize("bounds", [{}, {"streams": 1, "broadcast_hosts": 0}])
def test_wrappers_find_the_truth(spark, tag, bounds):
    """Pages of many layouts on a host: only their wrapper tells a line of the template in the content's own elements."""
    rnd = random.Random(6)
    pages, truth, alone = [], {}, 0
    for i in range(40):
        body = [words(rnd, 12) for _ in range(1 + i % 4)]
        extra = "".join(f"<div class='layout{'xyz'[i % 3] * (1 + i % 5)}'><p>{x}</p></div>" for x in body[1:])
        page = f"<body><p>Our site since 1990</p><nav><a>home</a></nav><{tag}><h1>Head {i}</h1><p>{body[0]}</p>{extra}<p class=tail>Read it again on our site</p></{tag}><div class=ad>{words(rnd, 9)}</div></body>"
        pages.append((i, f"http://h{i % 2}.org/{i}", page))
        truth[i] = "\n".join([f"Head {i}", *body])
        alone += html_wrappers.main_text(html_wrappers.blocks_of(page), {}) != truth[i]
    got = html_wrappers.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string"), **bounds).collect()
    assert {r.page_id: r.text for r in got} == truth and alone == 40  # each page's text is changed by its wrapper


def test_copies_of_a_page_are_one_page(spark):
    page = lambda i: f"<body><div id=top><p>Same line everywhere</p></div><div id=main><h1>Title {i}</h1><p>Body {i}</p></div>"
    pages = [(i, "http://copies.org/", page(0)) for i in range(12)]  # copies only
    pages += [(100 + i, "http://half.org/", page(max(0, i - 9))) for i in range(14)]  # 10 copies, 4 others: 5 distinct
    pages += [(200 + i, "http://few.org/", page(max(0, i - 9))) for i in range(13)]  # 4 distinct
    pages += [(300 + i, "http://one.org/", "<body><div><p>All there is</p></div>" if i < 6 else f"<body><div><p>All there is</p></div><table><tr><td>{i}</td></tr></table>") for i in range(12)]
    rows = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(5, "page_id")
    by = {r.page_id: r.text for r in html_wrappers.extract(rows).collect()}
    for i in range(12):
        assert by[i] == "Same line everywhere\nTitle 0\nBody 0"
        assert by[300 + i].startswith("All there is") if i < 6 else by[300 + i]
    for i in range(14):
        assert by[100 + i] == f"Title {max(0, i - 9)}\nBody {max(0, i - 9)}"
    for i in range(13):
        assert by[200 + i].endswith(f"Title {max(0, i - 9)}\nBody {max(0, i - 9)}")


def test_template_texts_inside_article(spark):
    body = lambda i: "".join(f"<p>Text {i} {k}</p>" for k in range(1 + i % 3))
    pages = [(i, "http://a.org/", f"<article><h1>Title {i}</h1>{body(i)}<p>Read our app</p><section><p>All rights reserved</p></section></article>") for i in range(30)]
    pages += [(100 + i, "http://b.org/", f"<main><p>Buy now</p><h2>Title {i}</h2></main>") for i in range(8)]
    pages += [(200 + i, "http://c.org/", f"<article><p>Text {i}</p><p>{'Some pages' if i % 2 else 'have this'}</p><p>Text {i}</p></article>") for i in range(8)]
    pages += [(300 + i, "http://d.org/", "<article><h1>Copy</h1><p>One</p><p>Two</p></article>") for i in range(8)]
    rows = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(5, "page_id")
    by = {r.page_id: r.text for r in html_wrappers.extract(rows).collect()}
    for i in range(30):
        assert by[i] == "\n".join([f"Title {i}", *[f"Text {i} {k}" for k in range(1 + i % 3)]])
    for i in range(8):
        assert by[100 + i] == f"Title {i}" and by[300 + i] == "Copy\nOne\nTwo"
        assert by[200 + i] == f"Text {i}\n{'Some pages' if i % 2 else 'have this'}\nText {i}"


def test_class_names_that_are_no_marks(spark):
    """Names that only hold a mark's word are content; names of nothing but marks and places are not."""
    content = "share-price ad-free notice-of-award search-results banner-year related-work reply-to-critics promo-history".split()
    marks = "comment-list site-footer cookie-banner ad-slot-1 related-posts-box top-nav".split()
    page = lambda i: "<body><article>" + "".join(f"<div class='{c}'><p>{c} said {i}</p></div>" for c in [*content, *(m for m in marks if m != "related-posts-box")]) + f"<p>Body {i}</p></article></body>"
    rows = spark.createDataFrame([(i, "http://n.org/", page(i)) for i in range(7)], "page_id bigint, url string, html string")
    assert {r.page_id: r.text for r in html_wrappers.extract(rows).collect()} == {i: "\n".join([*(f"{c} said {i}" for c in content), f"Body {i}"]) for i in range(7)}


@pytest.mark.parametrize("n", [2, 3, 12])
def test_pages_without_marks_lose_their_menu(spark, n):
    """Plain elements only: what the pages share is their frame; two pages are enough if they differ in most of their text."""
    rnd = random.Random(n)
    body = {i: [words(rnd, 20) for _ in range(2 + i % 3)] for i in range(n)}
    page = lambda i: "<body><table><tr><td>Start</td><td>Prices</td><td>About us</td></tr></table>" + f"<div>{''.join(f'<p>{x}</p>' for x in body[i])}</div>" + "<div><span>Call us at any time</span></div></body>"
    rows = spark.createDataFrame([(i, "http://plain.org/", page(i)) for i in range(n)], "page_id bigint, url string, html string")
    assert {r.page_id: r.text for r in html_wrappers.extract(rows).collect()} == {i: "\n".join(body[i]) for i in range(n)}


def test_near_copies_of_a_page_keep_their_text(spark):
    """Pages that agree in nearly everything are versions of one page, not its template."""
    rnd = random.Random(2)
    text = [words(rnd, 30) for _ in range(6)]
    page = lambda i: f"<body><article><h1>Report</h1>{''.join(f'<p>{x}</p>' for x in text)}<p>Version {i}</p></article></body>"
    rows = spark.createDataFrame([(i, "http://v.org/", page(i)) for i in range(5)], "page_id bigint, url string, html string")
    assert {r.page_id: r.text for r in html_wrappers.extract(rows).collect()} == {i: "\n".join(["Report", *text, f"Version {i}"]) for i in range(5)}


def test_matches_are_a_longest_chain_and_wrappers_are_bounded(monkeypatch):
    rnd = random.Random(9)
    for _ in range(200):
        a, b = (rnd.choices("abcdef", k=rnd.randint(0, 12)) for _ in range(2))
        pairs = html_wrappers._matches(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs) and len({j for _, j in pairs}) == len(pairs)
        nth = lambda xs: [(x, xs[:i].count(x)) for i, x in enumerate(xs)]
        x, y = nth(a), nth(b)
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + (x[i] == y[j]))
        assert len(pairs) == best[-1][-1]
    item = lambda p: [p, False, False, 0, 1, 10]
    wrapper = [item("keep")]
    began = time.time()
    for _ in range(200):  # random layouts: neither the wrapper nor the time for a page grows without bound
        wrapper = html_wrappers.align(wrapper, [item("keep"), *[item(f"x{rnd.randrange(10**9)}") for _ in range(30)]])
    assert len(wrapper) <= html_wrappers.MOST_TOKENS and wrapper[0][:3] == ["keep", False, False] and wrapper[0][4] == 201
    assert time.time() - began < 60
    one = html_wrappers.page_items(html_wrappers.blocks_of("<body>" + "".join(f"<p class=c{'x' * (i % 50)}>t{i}</p><div>{i}</div>" for i in range(50_000)) + "</body>"))
    assert len(html_wrappers.align(one, one)) == len(one)  # a page of 100,000 blocks


def test_wrapper_alignment():
    item = lambda p, d=0: [p, False, False, d, 1, 10]
    one = html_wrappers.fold([item("a", 1), item("p", 2), item("p", 3), item("z", 4)])
    two = html_wrappers.fold([item("a", 1), item("p", 5), item("q", 6), item("z", 7)])
    assert [(x[0], x[1], x[2], x[3]) for x in html_wrappers.align(one, two)] == [("a", False, False, 1), ("p", True, False, 0), ("q", False, True, 6), ("z", False, False, 0)]


def test_repeats_beyond_a_chunk(spark):
    """Texts longer than what is hashed at once: a passage that stands across its border, and one in a text of another length."""
    rng = np.random.default_rng(2)
    letters = lambda n: rng.integers(97, 123, n, dtype=np.uint8).tobytes().decode()
    shared, edge = letters(5000), suffix.CHUNK
    docs = [(1, letters(edge - 2500) + shared + letters(100_000)), (2, letters(700) + shared), (3, letters(2 * edge)), (4, shared[:399])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix.remove_repeats(frame(spark, docs)).collect()}
    assert got == {1: (edge + 102_500, 5000, 1), 2: (5700, 5000, 1), 3: (2 * edge, 0, 0), 4: (399, 0, 0)}


def test_sketches_are_retried(spark, rows, monkeypatch):
    """More differences than a sub-sketch is made for: larger ones, and at last the digests themselves, give the same likeness."""
    near = lambda: sorted((r.doc_id or 0, r.n_chars, r.near_edited, r.near_next) for r in fingerprints.fingerprint_documents(frame(spark, rows)).collect())
    want = near()
    for keys in (30, 3000):
        monkeypatch.setattr(fingerprints, "PART_KEYS", keys)
        assert near() == want


def test_large_sides_are_salted_or_joined(spark, rows, monkeypatch):
    """What is broadcast behind a count gives the same rows where the count is too large for it."""
    docs = frame(spark, [(i, t, "en", f"s{(i or 0) % 5}") for i, t in rows])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, quality int")
    pages = spark.createDataFrame([(i, f"http://{'www.' * (i % 2)}example.com/{'en' if i % 3 else 'fr'}/{i}") for i in range(50)], "page_id bigint, url string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")

    def results():
        mixed = Counter(map(tuple, mixing.mix_by_source(docs).collect()))
        judged = Counter((r.doc_id, r.quality.kept, round(r.quality.score, 9)) for r in quality.judge(docs, labels).collect())
        return mixed, judged, Counter(map(tuple, urls.judge(pages, rules).collect()))

    want = results()
    monkeypatch.setattr(mixing, "BROADCAST_PATTERNS", 0)
    monkeypatch.setattr(quality, "BROADCAST_PATTERNS", 0)
    monkeypatch.setattr(urls, "BROADCAST_ENTRIES", 0)
    assert results() == want


def test_flow_is_largest_and_cheapest():
    """Against all flows of small instances: first the most words, then the least cost of repeated ones."""
    rnd = random.Random(12)
    for _ in range(60):
        patterns = rnd.sample([("a",), ("b",), ("a", "b"), ("b", "c"), ("a", "b", "c")], 3)
        capacity, copies = {p: rnd.randint(0, 3) for p in patterns}, rnd.randint(1, 2)
        quota = {s: rnd.randint(0, 4) for s in "abc"}
        cost = lambda f, capacity=capacity: sum(max(0, sum(x for (p, _), x in f.items() if p == q) - n) for q, n in capacity.items())
        edges = [(p, s) for p in patterns for s in p]
        best = (0, 0)
        for amounts in itertools.product(*[range(min(capacity[p] * copies, quota[s]) + 1) for p, s in edges]):
            f = dict(zip(edges, amounts, strict=True))
            if all(sum(x for (q, _), x in f.items() if q == p) <= capacity[p] * copies for p in patterns) and all(sum(x for (_, t), x in f.items() if t == s) <= quota[s] for s in quota):
                best = max(best, (sum(amounts), -cost(f)))
        got = mixing.min_cost_flow(capacity, quota, copies)
        assert (sum(got.values()), -cost(got)) == best


def test_flow_of_many_sources():
    """10,000 sources, each with a pattern of its own and in overlapping ones: seconds, nothing above its bounds, no way left to send more."""
    rnd = random.Random(3)
    names = [f"s{i:05}" for i in range(10_000)]
    capacity = {(s,): rnd.randint(0, 10**9) for s in names}
    capacity |= {(a, b): rnd.randint(1, 10**9) for a, b in zip(names, names[1:], strict=False)}
    capacity |= {tuple(sorted(rnd.sample(names, 3))): rnd.randint(1, 10**9) for _ in range(5000)}
    quota = {s: rnd.randint(0, 4 * 10**9) for s in names}
    began = time.time()
    flow = mixing.min_cost_flow(capacity, quota, 2)
    assert time.time() - began < 60
    used, into = Counter(), Counter()
    for (p, s), words in flow.items():
        assert s in p and words > 0
        used[p] += words
        into[s] += words
    assert all(used[p] <= 2 * capacity[p] for p in capacity) and all(into[s] <= quota[s] for s in names)

    def stuck(free):
        """Sources that patterns with ``free`` words reach, over patterns that could send elsewhere, are full."""
        seen, queue = set(), [p for p in capacity if free(p)]
        senders = defaultdict(list)
        for p, s in flow:
            senders[s].append(p)
        patterns = set(queue)
        while queue:
            for s in queue.pop():
                if s not in seen:
                    seen.add(s)
                    queue += [p for p in senders[s] if p not in patterns]
                    patterns |= set(senders[s])
        return seen, patterns

    reached, _ = stuck(lambda p: used[p] < 2 * capacity[p])
    assert all(into[s] == quota[s] for s in reached)  # largest
    _, patterns = stuck(lambda p: used[p] < capacity[p])
    assert all(used[p] <= capacity[p] for p in patterns)  # cheapest: no first copy can stand in for a second


def test_many_patterns_are_refused(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a b", f"s{i}") for i in range(5)], "doc_id bigint, text string, source string")
    monkeypatch.setattr(mixing, "MOST_PATTERNS", 5)
    assert mixing.mix_by_source(docs).count() == 5
    monkeypatch.setattr(mixing, "MOST_PATTERNS", 4)
    with pytest.raises(ValueError):
        mixing.mix_by_source(docs)


@pytest.mark.parametrize("streams", [1, 200])
def test_tokens_beyond_a_wrapper_s_length_count(spark, streams):
    """Texts of the template on paths that few pages have are found however long the layouts of a host together are."""
    rnd = random.Random(1)
    lines = {i: [j for j in range(30) if rnd.random() < 0.6] if i < 24 else [] for i in range(30)}

    def page(i):
        body = "".join(f"<div class=r{'x' * j}><p>Repeated line {j}</p></div><div class=s{'y' * j}><p>{i} own {j}</p></div>" for j in lines[i])
        return (i, f"https://{'long' if i < 24 else 'short'}/{i}", f"<body><main><h1>Title {i}</h1>{body}<p>Body of {i}</p></main><div class=q{'z' * (i % 5)}>Foot</div></body>")

    rows = spark.createDataFrame([page(i) for i in range(30)] + [(90, "https://long/n", None), (91, "https://long/e", ""), (92, "https://long/m", "<nav>menu</nav>")], "page_id bigint, url string, html string")
    truth = {i: "\n".join([f"Title {i}", *[f"{i} own {j}" for j in lines[i]], f"Body of {i}"]) for i in range(30)} | {90: "", 91: "", 92: ""}
    assert {r.page_id: r.text for r in html_wrappers.extract(rows, streams=streams, most_tokens=12).collect()} == truth
