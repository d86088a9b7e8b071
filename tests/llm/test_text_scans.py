"""Licence scan, language ID, quality, fingerprints: brute force, accuracy, defined cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from innsight.llm import language, licenses, lz_fingerprint, quality
from innsight.llm.tables import crc_remainder, read_table

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, id string, word string"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in texts], SCHEMA)


def base_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    starts, labels = [], set()
    for phrase, label in phrases.items():
        wanted = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(wanted)] == wanted:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_license_scan_on_documents(spark):
    found = {r.doc_id: r for r in licenses.op1_license_scan(spark, LARGER).collect()}
    documents = read_table(spark, LARGER, "documents").collect()
    assert len(found) == len(documents)
    for d in documents:
        r = found[d.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_places(d.text)
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_license_notices_and_cases(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    texts = [
        (1, None), (2, ""), (3, "MIT license mit License. Apache LICENSE"), (4, "x " * 50_000 + mit.upper() + " y"),
        (5, mit.replace("hereby", "not")), (6, "Licensed under CC BY-NC 4.0"), (7, "é license ümit mit license"), (None, "cc by"),
        (7, "é license ümit mit license"),
    ]
    out = licenses.scan_licenses(table(spark, texts)).collect()
    labels = {r.doc_id: sorted({m.label for m in r.matches}) for r in out}
    assert labels == {1: [], 2: [], 3: ["apache", "mit"], 4: ["mit"], 5: [], 6: ["cc-by", "cc-by-nc"], 7: ["mit"], None: ["cc-by"]}
    assert len(out) == len(texts)
    assert [m.start for r in out if r.doc_id == 4 for m in r.matches] == [50_000]
    assert licenses.scan_licenses(table(spark, texts).filter("1 = 0")).count() == 0


def test_license_base_places_do_not_depend_on_frequencies():
    rng = random.Random(3)
    words = [w.encode() for w in "gnu general public license apache cc by mit x".split()]
    vocabulary = licenses.template_vocabulary(licenses.TEMPLATES)
    for _ in range(200):
        text = [rng.choice(words) for _ in range(40)]
        frequencies = {w: rng.randrange(100) for w in vocabulary}
        postings, votes = licenses.rare_word_index(licenses.TEMPLATES, 100, frequencies)
        base = [s for k, s, _ in licenses.find_matches(text, licenses.TEMPLATES, postings, votes) if licenses.TEMPLATES[k].base]
        assert len(base) == base_places(b" ".join(text).decode())[1]


def plain_matches(words):
    """(template, start) and coverage by trying every template at every place."""
    found = {}
    for k, t in enumerate(licenses.TEMPLATES):
        n = len(t.words)
        for start in range(1 - n, len(words)):
            place = {q: words[start + q] for q in range(n) if 0 <= start + q < len(words)}
            whole = all(place.get(at + i) == w for at, wanted in t.phrases for i, w in enumerate(wanted))
            hits = sum(place.get(q) == w for q, w in enumerate(t.words))
            if whole and hits / n >= (1 if t.base else licenses.MIN_COVERAGE):
                found[k, start] = hits / n
    return found


def test_license_matches_equal_brute_force_whatever_the_frequencies():
    rng = random.Random(5)
    vocabulary = sorted(licenses.template_vocabulary(licenses.TEMPLATES))
    some = 0
    for _ in range(150):
        text = []
        for t in rng.sample(licenses.TEMPLATES, 4):
            words = [w if rng.random() > 0.12 else rng.choice([b"font", *vocabulary]) for w in t.words]
            text += words[rng.choice([0, 0, 1]) :] + [b"the"] * rng.randrange(3)
        text = text[rng.choice([0, 0, 2]) : len(text) - rng.choice([0, 0, 2])]
        frequencies = {w: rng.choice([0, 0, 1, 50]) for w in vocabulary}
        index = licenses.rare_word_index(licenses.TEMPLATES, 60, frequencies)
        got = {(k, s): c for k, s, c in licenses.find_matches(text, licenses.TEMPLATES, *index)}
        assert got == plain_matches(text)
        some += len(got)
    assert some > 200


def test_license_labels_and_score_on_documents(spark):
    found = {r.doc_id: r for r in licenses.op1_license_scan(spark, LARGER).collect()}
    for d in read_table(spark, LARGER, "documents").collect():
        r = found[d.doc_id]
        own = set(licenses.split_words((d.text or "").encode()))
        if not any({w for _, wanted in t.phrases for w in wanted} <= own for t in licenses.TEMPLATES):
            assert (r.labels, r.score) == ("", 0.0)  # no key phrase can stand
            continue
        matches = plain_matches(licenses.split_words((d.text or "").encode()))
        strength = [0.5 if licenses.TEMPLATES[k].base else c for (k, _), c in matches.items()]
        labels = {licenses.TEMPLATES[k].label for k, _ in matches}
        assert (r.labels, r.score) == (",".join(sorted(labels)), max(strength, default=0.0))


def test_license_notice_with_words_the_corpus_lacks(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    font = mit.replace("software and associated documentation", "font and its accompanying")
    out = licenses.scan_licenses(table(spark, [(1, font), (2, "plain words"), (3, "a font")])).collect()
    assert {r.doc_id: [m.label for m in r.matches] for r in out} == {1: ["mit"], 2: [], 3: []}


def test_crc_remainder(spark):
    df = spark.createDataFrame([(i,) for i in (0, 7, 12345)] + [(None,)], "i long")
    got = [r.r for r in df.select(crc_remainder(F.col("i"), 4).alias("r")).collect()]
    assert got == [zlib.crc32(t) % 4 for t in (b"0", b"7", b"12345", b"")]


def test_language_held_out_accuracy(spark):
    found = language.op5_language_id(spark, LARGER)
    joined = found.join(read_table(spark, LARGER, "documents"), "doc_id").filter("held_out and lang is not null")
    right, n = joined.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert n > 100 and right / n > 0.98
    assert found.filter("score < 0 or score > 1 or score is null").count() == 0


def test_language_cases(spark):
    train = spark.createDataFrame(
        [(i, "the cat and the dog", "en") for i in range(5)] + [(i + 9, "le chat et le chien", "fr") for i in range(5)] + [(30, "x", None), (31, None, "en")],
        "doc_id long, text string, lang string",
    )
    model = language.fit(train)
    assert model.languages == ["en", "fr"]
    texts = [(1, "THE DOGS"), (2, "chiens"), (3, None), (4, ""), (5, "12 34 !!"), (6, "日本"), (None, "le chat"), (7, "le " * 40_000)]
    df = table(spark, texts)
    out = {r.doc_id: r.language for r in language.with_language(df, model).collect()}
    assert {i: v.lang for i, v in out.items()} == {1: "en", 2: "fr", 3: "und", 4: "und", 5: "und", 6: "en", None: "fr", 7: "fr"}
    assert out[3].score == 0 and 0.5 < out[7].score <= 1
    nothing = language.fit(train.filter("1 = 0"))
    assert {r.language.lang for r in language.with_language(df, nothing).collect()} == {"und"}
    docs = df.withColumn("lang", F.when(F.col("doc_id") == 1, "en").when(F.col("doc_id") == 2, "fr"))
    kept = language.keep_identified(docs)
    assert sorted(kept.columns) == sorted(docs.columns) and {r.doc_id for r in kept.collect()} == {1, 2, 6, 7, None}
    assert kept.filter("lang is null").count() == 0
    assert language.with_language(df.filter("1 = 0"), model).count() == 0


def test_quality_held_out_accuracy(spark):
    found = quality.op2_quality(spark, LARGER)
    documents = read_table(spark, LARGER, "documents")
    assert found.count() == documents.count()
    assert found.filter("score is null or score < 0 or score > 1 or predicted <> cast(score >= 0.5 as int)").count() == 0
    joined = found.join(read_table(spark, LARGER, "labels"), "doc_id").filter("held_out").toPandas()
    good, bad = joined[joined.quality == 1].score.to_numpy(), joined[joined.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.95
    assert (joined.predicted == joined.quality).mean() > 0.95


def test_quality_non_negative_risk_learns_without_negatives():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1, 1, (3000, quality.FEATURES)), rng.normal(-1, 1, (1000, quality.FEATURES))
    net = quality.fit_network(good[:500], np.concatenate([good[500:2000], bad[:500]]), 0.75)
    assert (net.score(good[2000:]) > 0.5).mean() > 0.95 and (net.score(bad[500:]) < 0.5).mean() > 0.95


def test_quality_cases(spark):
    documents = table(spark, [(i, f"some words {i}.") for i in range(8)] + [(9, None), (10, ""), (None, "x"), (3, "some words 3.")])
    labels = spark.createDataFrame([(i, 1) for i in range(5)] + [(0, 0), (1, 1), (9, 0), (None, 1), (7, None)], "doc_id long, quality int")
    network, prior = quality.fit(documents, labels)
    assert abs(prior - 5 / 8) < 1e-9
    scored = documents.select("doc_id", quality.quality_score(documents, network, prior, F.col("text")).alias("s")).collect()
    assert len(scored) == 12 and all(0 <= r.s <= 1 for r in scored)
    none, prior = quality.fit(documents, labels.filter("1 = 0"))
    assert none is None and prior == 0.5
    assert {r.s for r in documents.select(quality.quality_score(documents, none, prior, F.col("text")).alias("s")).collect()} == {0.5}
    empty = documents.filter("1 = 0")
    assert empty.select(quality.quality_score(empty, network, prior, F.col("text"))).count() == 0


def test_fingerprints_on_documents(spark):
    out = {r.doc_id: r for r in lz_fingerprint.op6_fingerprint(spark, SF).collect()}
    documents = sorted(((r.doc_id, r.text or "") for r in read_table(spark, SF, "documents").collect()), reverse=True)
    assert len(out) == len(documents)
    multipliers = lz_fingerprint._multipliers()
    for k, (i, text) in enumerate(documents):
        following = documents[(k + 1) % len(documents)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = (lz_fingerprint.fingerprint(t, {}, multipliers) for t in (text, edited, following))
        r = out[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (lz_fingerprint.as_hex(a), lz_fingerprint.as_hex(b))
        assert (r.near_edited, r.near_next) == (lz_fingerprint.likeness(a, b), lz_fingerprint.likeness(a, c))


def test_phrase_sets_are_lz78():
    def plain(symbols):
        known, phrase = set(), ()
        for s in symbols:
            phrase += (s,)
            if phrase not in known:
                known.add(phrase)
                phrase = ()
        return known

    rng = random.Random(2)
    for _ in range(50):
        symbols = [rng.randrange(1, 4) for _ in range(rng.randrange(200))]
        assert len(lz_fingerprint.phrase_set(symbols)) == len(plain(symbols))


def test_likeness_estimates_phrase_overlap():
    rng = random.Random(4)
    words = [str(rng.randrange(10**6)) for _ in range(1200)]
    multipliers = lz_fingerprint._multipliers()
    for common in (300, 900):
        other = words[:common] + [str(rng.randrange(10**6)) for _ in range(1200 - common)]
        a, b = (lz_fingerprint.fingerprint(" ".join(w), {}, multipliers) for w in (words, other))
        assert abs(lz_fingerprint.likeness(a, b) - common / (2400 - common)) < 0.12


def plain_phrases(text):
    """LZ78 phrases of a text as tuples of symbols, cut letter by letter."""
    found, phrase = set(), ()
    for word in text.split():
        pieces, start = [], 0
        for i in range(lz_fingerprint.WINDOW, len(word)):
            h = 0
            for c in word[i - lz_fingerprint.WINDOW : i]:
                h = ((h ^ ord(c)) * 0x9E3779B1) % 2**32
                h ^= h >> 15
            if h % lz_fingerprint.CUT_ONE_IN == 0:
                pieces.append(word[start:i])
                start = i
        for piece in [*pieces, word[start:]]:
            phrase += (piece,)
            if phrase not in found:
                found.add(phrase)
                phrase = ()
    return found


def test_likenesses_of_the_query_are_near_the_plain_overlap(spark):
    out = {r.doc_id: r for r in lz_fingerprint.op6_fingerprint(spark, SF).collect()}
    documents = sorted(((r.doc_id, r.text or "") for r in read_table(spark, SF, "documents").collect()), reverse=True)
    off = []
    for k, (i, text) in enumerate(documents):
        following = documents[(k + 1) % len(documents)][1]
        half = len(text) // 2
        a, b, c = map(plain_phrases, (text, text[: len(text) - half] + following[:half], following))
        for got, x in ((out[i].near_edited, b), (out[i].near_next, c)):
            overlap = len(a & x) / len(a | x) if a | x else 1.0
            off.append(abs(got - overlap))
    assert max(off) < 0.25 and sum(off) / len(off) < 0.05  # 128 samples: five deviations are 0.22


def test_symbols_do_not_depend_on_where_a_text_begins():
    rng = random.Random(8)
    multipliers = lz_fingerprint._multipliers()
    chinese = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(4000))
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(30_000))
    for text in (chinese, letters):
        a, b = (lz_fingerprint.symbols(t) for t in (text, "x" + text))
        assert b"".join(a).decode() == text and len(a) > len(text) / 30
        assert len(set(a) & set(b)) >= len(set(a)) - 2
        prints = [lz_fingerprint.fingerprint(t, {}, multipliers) for t in (text, "x" + text, text[::-1])]
        assert lz_fingerprint.likeness(prints[0], prints[1]) > 0.9 > 0.2 > lz_fingerprint.likeness(prints[0], prints[2])


def test_cut_places_do_not_depend_on_the_block(monkeypatch):
    text = "".join(random.Random(9).choice("abcdef \u3000\U0001f600") for _ in range(5000))
    whole = lz_fingerprint.cut_places(text)
    for block in (1, 7, 64):
        monkeypatch.setattr(lz_fingerprint, "BLOCK", block)
        assert lz_fingerprint.cut_places(text) == whole


def test_fingerprint_cases(spark):
    texts = [(1, None), (2, ""), (2, ""), (None, "x y"), (3, "a b c a b c"), (4, "日本語" * 3000), (5, " ")]
    out = lz_fingerprint.compare_with_next(table(spark, texts)).collect()
    assert len(out) == len(texts)
    by_id = {r.doc_id: r for r in out}
    assert by_id[4].n_chars == 9000 and by_id[1].fingerprint == "" == by_id[5].fingerprint
    assert (by_id[2].near_next, by_id[1].near_next, by_id[1].near_edited) == (1.0, 0.0, 1.0)
    edited = "日本語" * 1500 + "a b c a b c"
    assert by_id[4].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    alone = lz_fingerprint.compare_with_next(table(spark, [(8, "p q r s")])).collect()
    assert [r.near_next for r in alone] == [1.0]
    assert lz_fingerprint.compare_with_next(table(spark, texts).filter("1 = 0")).count() == 0
