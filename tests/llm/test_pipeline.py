"""The pipeline, stage by stage, against brute force; and the registration."""

from __future__ import annotations

import ast
import hashlib
import os
import re
from collections import Counter

import __spark_entry__
import corpus_pipeline
from innsight.llm import bpe, mixing
from innsight.llm.tables import materialize, read_table
from test_dedup import brute_components
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))


def test_registered():
    queries = __spark_entry__.queries()
    for n in range(1, 11):
        assert len([q for q in queries if re.match(rf"op{n}_", q)]) == 1
    assert queries["pipeline"] is corpus_pipeline.run
    assert set(__spark_entry__.oracle_sql()) <= set(queries)


def test_stages_one_by_one(spark):
    docs = read_table(spark, SF, "documents")
    extra = spark.createDataFrame([(9001, None), (9002, "12 !!"), (9003, "")], "doc_id long, text string")
    docs = materialize(docs.unionByName(extra, allowMissingColumns=True), "test")
    columns = set(docs.columns)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, before, SF), "test")
        if name == "bpe":
            continue
        assert set(docs.columns) == columns
        given, kept = ([r.doc_id for r in d.select("doc_id").collect()] for d in (before, docs))
        if name == "language_id":
            assert set(given) - set(kept) == {9001, 9002, 9003}
        elif name == "exact_dedup":
            groups: dict = {}
            for i in given:
                groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i]), []).append(i)
            assert sorted(kept) == sorted(min(g) for g in groups.values())
        elif name == "near_dedup":
            components = brute_components({i: texts[i] for i in given}, 5, 80)
            assert sorted(kept) == sorted(i for i in given if components[i][1] == i)
        elif name == "mixing":
            plan = {r.doc_id: r.copies for r in mixing.mix_documents(before).collect() if r.copies}
            assert Counter(kept) == plan
    library = Tokenizer.from_file(bpe.vocabulary_path())
    for r in docs.collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_is_the_stages(spark):
    docs = read_table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, docs.collect()))


def test_nothing_else_imports_the_package():
    for folder, _, files in os.walk(os.path.join(ROOT, "innsight")):
        if os.path.basename(folder) in ("llm", "__pycache__"):
            continue
        for file in files:
            if file.endswith(".py"):
                tree = ast.parse(open(os.path.join(folder, file), encoding="utf-8").read())
                names = [n.module or "" for n in ast.walk(tree) if isinstance(n, ast.ImportFrom)]
                names += [a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names]
                assert not [n for n in names if "llm" in n.split(".") or n == "corpus_pipeline"]
