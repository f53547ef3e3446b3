"""The pipeline's stages against their meaning, on a small corpus."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline


def test_pipeline(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    from postmill.llm.queries import tokenizer_path

    rnd = random.Random(11)
    text = lambda n: " ".join("".join(rnd.choices("abcdef", k=rnd.randint(2, 7))) for _ in range(n))
    docs, labels = [], []
    for i in range(200):
        t = text(rnd.randint(30, 60))
        bad = i % 5 == 0
        docs.append((i, t.upper().replace(" ", "!! ") if bad else t, "en", f"s{i % 4}", len(t)))
        labels.append((i, int(not bad), 0))
    good = [d for d in docs if d[0] % 5]
    for k, (i, t, lang, source, n) in enumerate(good[:40]):  # exact copies under larger ids, near copies
        docs.append((1000 + i, t.title().swapcase() if k % 2 else t + " extra", lang, source, n))
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = at.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        at = stage(spark, at, str(tmp_path))
        at.write.parquet(str(tmp_path / f"stage{k}"))
        at = spark.read.parquet(str(tmp_path / f"stage{k}"))
        seen[name] = at.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert at.columns == columns
    ids = {name: {r.doc_id for r in rows} for name, rows in seen.items()}
    assert not any(i % 5 == 0 and i < 200 for i in ids["quality"]) and {d[0] for d in good} <= ids["quality"]
    lowered = Counter(r.text.lower() for r in seen["exact_dedup"])
    assert set(lowered.values()) == {1} and set(lowered) == {r.text.lower() for r in seen["quality"]}
    largest = {}
    for r in seen["quality"]:
        largest[r.text.lower()] = max(largest.get(r.text.lower(), -1), r.doc_id)
    assert ids["exact_dedup"] == set(largest.values())
    near = {i for i in ids["exact_dedup"] if i >= 1000 and i - 1000 in ids["exact_dedup"]}  # a copy with one more word
    assert ids["near_dedup"] == ids["exact_dedup"] - near
    assert ids["mixing"] <= ids["near_dedup"] and max(Counter(r.doc_id for r in seen["mixing"]).values()) == 2
    words = sum(len(r.text.split()) for r in seen["near_dedup"])
    assert sum(len(r.text.split()) for r in seen["mixing"]) == pytest.approx(1.5 * words, rel=0.02)
    library = tokenizers.Tokenizer.from_file(tokenizer_path())
    want = Counter((r.doc_id, hashlib.sha256(np.array(library.encode(r.text, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()) for r in seen["mixing"])
    assert Counter((r.doc_id, r.ids_sha256) for r in seen["encoding"]) == want
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["encoding"])


def test_encoding_stage_gives_the_ids(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    from postmill.llm.queries import tokenizer_path

    docs = [(1, "One and two"), (2, ""), (3, None), (3, "Grüße, 世界! " * 40), (None, "again again"), (1, "One and two")]
    got = dict(corpus_pipeline.STAGES)["encoding"](spark, spark.createDataFrame(docs, "doc_id bigint, text string"), str(tmp_path)).collect()
    library = tokenizers.Tokenizer.from_file(tokenizer_path())
    want = Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids)) for i, t in docs)
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    assert all(r.n_tokens * 4 == len(r.ids) and r.ids_sha256 == hashlib.sha256(r.ids).hexdigest() for r in got)


CLASHING = "doc_id bigint, text string, lang string, source string, n_chars bigint, quality int, kept boolean, root bigint, size bigint, digest string, h bigint, token string"


def test_stages_with_nulls_repeats_and_clashing_columns(spark, tmp_path):
    """Each stage keeps all columns whatever their names, and takes nulls, repeated rows, a megabyte of text and an empty table."""
    rnd = random.Random(4)
    text = lambda n: " ".join("".join(rnd.choices("abcdef", k=rnd.randint(2, 7))) for _ in range(n))
    long = text(180_000)
    texts = [(i, text(40)) for i in range(30)]
    texts += [(None, None), (None, None), (None, texts[3][1]), (5, None), (6, ""), (7, " \n "), texts[8], texts[8], (100, texts[9][1].upper()), (9, text(30)), (200, long), (201, long + " more")]
    rows = [(i, t, None if (i or 0) % 3 == 0 else "en", None if (i or 0) % 4 == 0 else "a", None, 1, True, 2, 3, "d", 4, "t") for i, t in texts]
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, CLASHING)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.count() == 0
        if name == "encoding":
            assert out.count() == docs.count()
            break
        assert out.columns == docs.columns == none.columns
        got = out.collect()
        if name == "exact_dedup":
            assert Counter((r.text or "").lower() for r in got).most_common(1)[0][1] == 1
            assert 100 in {r.doc_id for r in got} and None not in {r.doc_id for r in got if r.text == texts[3][1]}
        if name == "near_dedup":
            assert {200, 201} & {r.doc_id for r in got} == {200} and {9, 100} <= {r.doc_id for r in got}
        if name == "mixing":
            assert max(Counter((r.doc_id, r.text) for r in got).values()) <= 2
        docs = spark.createDataFrame(got, CLASHING)
