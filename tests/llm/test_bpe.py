"""The encoder against the tokenizers library."""

from __future__ import annotations

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from innsight.llm import bpe
from innsight.llm.tables import read_table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.vocabulary_path())
    t.no_padding()
    t.no_truncation()
    return t


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary.read(bpe.vocabulary_path()))


def test_random_texts(library, encoder):
    rng = random.Random(1)
    signs = [chr(c) for c in range(1, 0x2FFF)]
    tokens = [n.removesuffix("</w>") for n in encoder.v.names]
    tricky = list("aAbB'sdtrevml10 .,!\n\t\x1c\x85\xa0ΣσİıßÅéÉ́​") + ["<|endoftext|>", "<|startoftext|>", "<|end", "ﬁ", "🙂", "힣"]
    texts = []
    for _ in range(1500):
        texts.append("".join(rng.choices(signs, k=rng.randint(1, 12))))
        texts.append("".join(rng.choices("abcdefgh", k=rng.randint(1, 40))))
        texts.append("".join(rng.choices(tricky, k=rng.randint(1, 30))))
        texts.append("".join(rng.choices(tokens, k=rng.randint(1, 4))))
    texts += ["a" * 5000, "ab" * 3000, "!" * 999, "0" * 50, "", " "]
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [encoder.encode(t) for t in texts] == expected


def test_pairs_and_words_replay_the_merges(encoder):
    """The pair table and the backtracking give what replaying the merges gives."""
    v = encoder.v
    strings = {i: s for s, i in v.strings.items()}
    merges = {(a, b): (rank, v.strings.get(strings[a] + strings[b])) for (a, b), rank in v.ranks.items()}
    rng = random.Random(2)
    ids = [i for i, s in strings.items() if not s.endswith(bpe.END)]
    for _ in range(3000):
        a, b = rng.choice(ids), rng.choice(list(strings))
        symbols = v.symbols(strings[a] + strings[b], v.strings)
        assert encoder.compatible(a, b) == (bpe.merge_word(symbols, merges) == [a, b])
    for _ in range(500):
        word = "".join(rng.choices("abeinrst", k=rng.randint(1, 30))) + bpe.END
        assert list(encoder.encode_word(word)) == bpe.merge_word(v.symbols(word, v.strings), merges)


def test_bounded_tables_do_not_change_ids(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 3)
    monkeypatch.setattr(bpe, "CACHED_PAIRS", 3)
    encoder = bpe.Encoder(bpe.Vocabulary.read(bpe.vocabulary_path()))
    rng = random.Random(3)
    for _ in range(300):
        text = " ".join("".join(rng.choices("abcde", k=rng.randint(1, 6))) for _ in range(10))
        assert encoder.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_query_on_documents(spark, library):
    found = {r.doc_id: r for r in bpe.op4_bpe(spark, SF).collect()}
    documents = read_table(spark, SF, "documents").collect()
    assert len(found) == len(documents)
    for d in documents:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        r = found[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_cases(spark, library):
    texts = [(1, None), (2, ""), (3, " \t"), (4, "a <|endoftext|> B"), (None, "x"), (4, "a <|endoftext|> B"), (5, "word " * 30_000)]
    df = spark.createDataFrame([(i, t, "q", 1) for i, t in texts], "doc_id long, text string, ids string, Decoded int")
    out = bpe.encode_decode(df, bpe.vocabulary_path())
    assert out.columns == ["doc_id", "text", "ids", "Decoded", "ids_", "decoded_"]
    rows = out.collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids_ == ids and r.decoded_ == library.decode(ids, skip_special_tokens=False)
        assert r.ids == "q"
    assert bpe.digests(df.filter("1 = 0"), bpe.vocabulary_path()).count() == 0


def test_one_pass(spark):
    plan = bpe.op4_bpe(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_apart_and_together_agree(spark):
    df = read_table(spark, SF, "documents").select("doc_id", "text")
    path = bpe.vocabulary_path()
    apart = bpe.with_decoded(bpe.with_ids(df, path), path)
    assert sorted(apart.collect()) == sorted(bpe.encode_decode(df, path).collect())
