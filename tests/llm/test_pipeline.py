"""The pipeline stages: who stays, what changes, and that columns of documents are kept."""

import hashlib
import random

import pytest

import corpus_pipeline
from studyframe.llm import queries
from studyframe.llm.bpe import load_tokenizer

EN = "the house and the garden are near the river of the town with a bridge and many old trees".split()
DE = "das haus und der garten liegen an dem fluss der stadt mit einer alten brücke und bäumen".split()


def text(rnd, words, n):
    return " ".join(rnd.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rnd = random.Random(8)
    bench = [(k, text(rnd, EN, 30)) for k in range(3)]
    docs = [(k, text(rnd, EN if k % 2 else DE, 80), "en" if k % 2 else "de", f"s{k % 3}") for k in range(40)]
    copies = [(100 + k, docs[k][1] + " end", docs[k][2], "s0") for k in range(5)] + [(200, docs[7][1], "en", "s1")]
    leaks = [(300 + k, text(rnd, EN, 40) + " " + b + " " + text(rnd, EN, 40), "en", "s2") for k, b in bench]
    secrets = [(400, text(rnd, EN, 50) + " token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" " + text(rnd, EN, 50), "en", "s1")]
    odd = [(500, None, "en", "s1"), (501, "", "en", None), (502, "12 34 !!", None, "s1"), (None, docs[3][1], "en", "s1"), docs[9], (None, text(rnd, DE, 60), None, None)]
    rows = [(*r, len(r[1]) if r[1] is not None else None, "extra") for r in docs + copies + leaks + secrets + odd]
    folder = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, language string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows


def ident(doc_id):
    return -1 if doc_id is None else doc_id


def test_stages_follow_the_given_order():
    assert len(corpus_pipeline.STAGES) == 5 and [n for n, _ in corpus_pipeline.STAGES][0] == "language_id"


def test_each_stage_decides_on_all_its_input(spark, small):
    folder, rows = small
    docs = queries.table(spark, folder, "documents")
    columns, left = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.materialize(stage(spark, docs, folder), "stage")
        assert docs.columns == columns
        left.append(docs.collect())
    known, distinct, clean, masked = left
    assert sorted(ident(r[0]) for r in rows if r[0] not in (500, 501, 502)) == sorted(ident(r.doc_id) for r in known)
    assert sorted(ident(r.doc_id) for r in distinct) == sorted([*range(40), 300, 301, 302, 400, -1])
    assert sorted(ident(r.doc_id) for r in clean) == sorted([*range(40), 400, -1])
    before = {r.doc_id: r.text for r in clean}
    for r in masked:
        if r.doc_id == 400:
            assert "[secret]" in r.text and "24be" not in r.text and r.n_chars == len(r.text)
        else:
            assert r.text == before[r.doc_id]


def test_packed_pieces_hold_every_token_of_what_is_left(spark, small):
    folder, _ = small
    rows = corpus_pipeline.run(spark, folder).collect()
    tokenizer = load_tokenizer(queries.tokenizer_path())
    docs = queries.table(spark, folder, "documents")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.materialize(stage(spark, docs, folder), "stage")
    want = {r.doc_id: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect()}
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want


def test_empty_documents(spark, small, tmp_path):
    folder, _ = small
    queries.table(spark, folder, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    queries.table(spark, folder, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_chat_query_equals_its_digests(spark):
    sf = "/root/testdata/sf0.001"
    turns = {}
    for r in sorted(queries.table(spark, sf, "conversations").collect(), key=lambda r: (r.conv_id, r.turn)):
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    turns[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]

    def digest(s):
        return hashlib.sha256(s.encode()).hexdigest()

    for r in queries.op9_chat_format(spark, sf).collect():
        own = turns[r.conv_id]
        lost = "".join(t for role, t in own if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (
            len(own), digest("".join(f"{a}\n{b}\n" for a, b in own)), len(lost), digest(lost))


def test_stages_stand_clashing_and_missing_columns(spark):
    rows = [(1, "the house and the garden are near the river of the town", "a", "b", "c"), (1, "the house and the garden are near the river of the town", "a", "b", "c"),
            (2, "a token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" b", "a", "b", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, named_id string, Named_Digest string, leaked_key string")
    kept = corpus_pipeline.distinct_documents(spark, docs, None)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2] and kept.columns == docs.columns
    masked = corpus_pipeline.without_secrets(spark, kept, None)
    assert masked.columns == docs.columns and any("[secret]" in r.text for r in masked.collect())
