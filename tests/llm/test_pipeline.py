import random
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_decontaminate import brute as brute_leaks
from tests.llm.test_exact_dedup import brute as brute_exact
from tests.llm.test_ngram_join import brute as brute_near


def make(spark, folder, texts, items):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_against_brute_force(spark, tmp_path, prose):
    r = random.Random(3)
    texts = prose(50) + ["12 34 !!", "  a b", "ab", None]
    items = [" ".join(r.choice(["red", "blue", "green", "of", "one", "two"]) + r.choice(["", "", "."]) for _ in range(25)) for _ in range(5)]
    texts += [f"some text before {items[1]} and after", items[2], "quite clean here"]
    sf_dir = make(spark, tmp_path, texts, items)

    left = {i: t for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    left = {i: left[i] for i, v in brute_exact(left.items()).items() if v[2]}
    ids = sorted(left)
    left = {i: left[i] for k, i in enumerate(ids) if brute_near([left[j] for j in ids], 5, 80)[k][1] == k}
    ids = sorted(left)
    leaks = {d for d, _ in brute_leaks([left[i] for i in ids], items)}
    left = {i: left[i] for k, i in enumerate(ids) if k not in leaks}

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs, seqs = defaultdict(int), defaultdict(int)
    for p in corpus_pipeline.run(spark, sf_dir).collect():
        docs[p.doc_id] += p.length
        seqs[p.sequence_id] += p.length
    assert docs == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in left.items()}
    assert all(n == 1024 or n & (n - 1) == 0 for n in seqs.values())


def test_stages_keep_columns_and_handle_odd_rows(spark, tmp_path, odd_frame):
    sf_dir = make(spark, tmp_path, ["a"], ["what is this. nothing much really at all"])
    docs = odd_frame(["a b c", "same text", "ab c", None, "", "what is this. nothing much really at all"])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == {0, 1, None}
        else:
            assert out.columns == docs.columns and stage(spark, docs.limit(0), sf_dir).count() == 0
        docs = out
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("limit", [0, 500_000])
def test_without(spark, frame, monkeypatch, limit):
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_IDS", limit)
    docs = frame(["a", "b", "c"])
    assert {r.doc_id for r in corpus_pipeline.without(docs, docs.where("doc_id = 1").select("doc_id")).collect()} == {0, 2}


def test_language_stage_decides_by_likelihood(spark, frame):
    r = random.Random(8)
    words = ["".join(r.choice("the ing er on at re".split()) for _ in range(r.randint(1, 3))) for _ in range(300)]
    clean = [" ".join(r.choice(words) for _ in range(r.randint(1, 150))) for _ in range(200)]
    noise = [" ".join("".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(7)) for _ in range(60)) for _ in range(4)]
    docs = frame(clean + ["12 34", None] + noise).selectExpr("doc_id", "text", "if(doc_id < 200, lang, null) lang", "source", "n_chars")
    assert {x.doc_id for x in corpus_pipeline.language(spark, docs, "").collect()} == set(range(200))
    unlabelled = docs.selectExpr("doc_id", "text", "cast(null as string) lang", "source", "n_chars")
    assert {x.doc_id for x in corpus_pipeline.language(spark, unlabelled, "").collect()} == set(range(200)) | set(range(202, 206))
