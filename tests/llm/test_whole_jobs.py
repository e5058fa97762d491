"""Operators over the whole of their job: nothing of a text, an alphabet or a template is left out."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pytest

from sparktext.llm import common, induced, langid, licenses, minhash, queries, simhash, suffix, toxicity


# language identification


def _naive_phrases(text: str, own: str) -> int:
    n, i = 0, 0
    while i < len(text):
        j = i
        while j < len(text) and text[i : j + 1] in own:
            j += 1
        i, n = max(j, i + 1), n + 1
    return n


def test_phrases_over_large_alphabets():
    rng = random.Random(4)
    han = [chr(0x4E00 + i) for i in range(700)]
    texts = {"ja": "".join(rng.choices(han[300:], k=900)), "zh": "".join(rng.choices(han[:500], k=900)), "el": "".join(rng.choices("αβγδεζηθικλ", k=300))}
    parser = langid.Parser(langid.LanguageModel(tuple((lang, (t,)) for lang, t in texts.items())))
    for _ in range(40):
        asked = "".join(rng.choices(han + list("αβγδabc"), k=60)) + texts["zh"][(a := rng.randrange(800)) : a + 40] + texts["ja"][a : a + 30]
        assert parser.phrases([asked])[0].tolist() == [_naive_phrases(asked, t) for t in texts.values()]
    asked = ["".join(texts["zh"][200:240]), "".join(texts["ja"][200:240])]
    assert parser.predict(asked)[0] == ["zh", "ja"]


def test_languages_of_long_documents_alone_have_models(spark):
    rows = [(i, f"{word} " * 5000, lang) for i, (word, lang) in enumerate([("the cat", "en"), ("der hund", "de"), ("le chien", "fr")])]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert [lang for lang, _ in model.texts] == ["de", "en", "fr"]
    assert all(sum(map(len, t)) == 10_000 for _, t in model.texts)


# licenses


def test_full_license_texts_are_found(spark):
    texts = [t for _, t in licenses.TEXTS]
    mangled = [" ".join(w for i, w in enumerate(t.split()) if i % 40) for t in texts]  # a word in forty is gone: the drift leaves the band of long texts
    frame = spark.createDataFrame([(i, f"x = 1\n# {t}\ny = 2") for i, t in enumerate(texts)], "doc_id long, text string")
    rows = licenses.scan(frame).collect()
    for i, (name, text) in enumerate(licenses.TEXTS):
        spans = [(r.coverage, r.stop - r.start) for r in rows if r.doc_id == i and r.license == name]
        assert any(c == 1.0 and n > 0.97 * len(text.encode()) for c, n in spans), name
    short = licenses.Scanner.of(licenses.TEMPLATES).scan(mangled[[n for n, _ in licenses.TEXTS].index("MIT")], 0.85)
    assert [(n, c > 0.95) for n, c, _, _ in short] == [("MIT", True)]


@pytest.mark.parametrize("notice", ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3."])
def test_every_copy_of_a_repeated_notice_is_found(notice):
    for copies in (2, 3, 7):
        found = licenses.Scanner.of(licenses.TEMPLATES).scan("some text " + f"{notice} " * copies + "more text", 0.85)
        n = len(notice) + 1
        assert [(a, b) for _, _, a, b in found] == [(10 + i * n, 10 + i * n + len(notice) - 1) for i in range(copies)]


# pipeline


def test_pipeline_takes_near_copies_from_0_8_on(spark):
    import corpus_pipeline

    rng = random.Random(6)
    rows = []
    for k in range(30):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        rows.append((2 * k, " ".join(words)))
        for i in range(rng.choice([1, 3, 4, 5, 6])):  # runs of five with it: five of 196 for each edited word
            words[20 + 30 * i] = f"x{k}"
        rows.append((2 * k + 1, " ".join(words)))
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(196)} for i, t in rows}
    likeness = [100 * len(sets[2 * k] & sets[2 * k + 1]) / len(sets[2 * k] | sets[2 * k + 1]) for k in range(30)]
    assert any(80 <= x < 85 for x in likeness) and any(x < 80 for x in likeness)
    kept = {r.doc_id for r in corpus_pipeline.without_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert kept == {i for i, _ in rows if i % 2 == 0 or likeness[i // 2] < 80}


# fingerprints


def test_simhash_query_finds_all_near_fingerprints(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for radius, found in ((6, queries.op2_simhash(spark, sf_dir)), (12, simhash.linked(docs, 12))):
        rows = found.collect()
        first: dict[int, int] = {}
        for r in sorted(rows, key=lambda r: r.doc_id):
            first.setdefault(int(r.fingerprint, 16), r.doc_id)
        for r in rows:
            mine = int(r.fingerprint, 16)
            assert (r.representative, r.links) == (first[mine], sum(0 < (mine ^ p).bit_count() <= radius for p in first))
    assert any(r.links for r in rows)


def test_near_copies_move_only_the_texts_in_question(spark):
    docs = spark.range(20_000).selectExpr("id - 10000 AS doc_id", "'x' AS text", "1 AS word")
    ids = spark.range(500).selectExpr("id * 37 - 9000 AS id")
    found = [r.doc_id for r in common.among(docs, "doc_id", ids, 500).collect()]
    assert {i * 37 - 9000 for i in range(500)} <= set(found) and len(found) == len(set(found)) < 500 + 19_500 / 10
    assert common.among(docs, "doc_id", ids, 500, most_words=1).count() == 20_000
    assert common.among(docs, "doc_id", ids.where("false"), 0).count() == 0


def test_near_copies_keep_only_buckets_of_several(spark):
    rows = [(i, r, 1) for i, r in enumerate([b"a" * 160, b"a" * 152 + b"b" * 8, b"c" * 160])]
    found = minhash._buckets(spark.createDataFrame(rows, "id long, registers binary, n int")).collect()
    assert sorted((r.band, r.id) for r in found) == [(b, i) for b in range(19) for i in (0, 1)]
    assert len({r.key for r in found}) == 19 and len({r.a for r in found}) == 1 and found[0].a in (0, 1)


# passages


def test_fragments_of_a_batch_take_little_memory():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 40_000, 300)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    data = rng.integers(97, 101, starts[-1]).astype(np.uint8)
    data[-30_000:] = data[:30_000]
    tracemalloc.start()
    found = suffix._windows(data, starts, 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * len(data)  # what is found takes about 2 bytes for one of text, twice while it is joined
    for want, got in zip(suffix._windows_of(data, starts, 50), found):
        assert want.dtype == got.dtype and (want == got).all()


def test_queues_are_read_in_blocks():
    queue = induced.Queues(None, 1 << 30, "x")
    for i in range(1000):
        queue.push(7, np.arange(200 * i, 200 * i + 200, dtype=np.int32), np.zeros(200, np.uint8))
    for backwards in (False, True):
        found = [at for at, _ in queue.all(7, backwards)]
        assert len(found) == 4 and (np.concatenate(found[::-1] if backwards else found) == np.arange(200_000)).all()
    assert not list(queue.all(8)) and not list(queue.all(8, True))


# workers


def test_what_other_operators_keep_is_dropped():
    none = np.zeros(0, np.int64)
    first, second = (toxicity.ToxicityModel({}, np.zeros(0), none, none, np.zeros(1, np.int64), none, np.zeros(0), 0.1, 15) for _ in range(2))
    common.trim()
    kept = toxicity.Scorer.of(first)
    common.trim()  # the task that asked for it
    assert toxicity.Scorer.of(first) is kept
    common.trim()
    common.trim()  # another operator's task
    assert not toxicity.Scorer._kept and toxicity.Scorer.of(first) is not kept
    toxicity.Scorer.of(second)
    assert list(toxicity.Scorer._kept) == [second.key]


def test_texts_of_many_hubs_are_cut_once(spark):
    words = [f"w{i}" for i in range(200)]
    texts = {i: " ".join([*words[:60], f"x{i}"]) if i % 2 else " ".join([*words[:12], f"y{i}"]) for i in range(40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    pairs = [(a, b) for a in texts for b in texts if a < b]
    found = minhash._confirmed(docs, spark.createDataFrame(pairs, "a long, b long"), 85).collect()
    assert sorted(map(tuple, found)) == [(a, b) for a, b in pairs if a % 2 and b % 2]
    sets = minhash.Sets(most_words=1000)
    assert sets[texts[1]][0] is sets[texts[1]][0] and len(sets[None][0]) == 0
    for i in range(100):
        assert len(sets[f"{i} {texts[1]}"][0]) == 58 and len(sets) < 20
