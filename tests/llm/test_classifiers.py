import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.llm import language_tree as L
from ebbtide.llm import license_paragraphs as P
from ebbtide.llm import quality_neighbours as Q
from ebbtide.llm import subword_toxicity as T
from ebbtide.llm.grams import packed

SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def folder(small):
    return small.replace("sf0.001", "sf0.01")


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, folder):
    return spark.read.parquet(f"{folder}/labels.parquet")


def test_language_of_held_out_documents(spark, folder, docs):
    got = L.op8_language(spark, folder).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 150 and (got.lang == got.lang_pred).mean() > 0.98
    assert got.score.between(0, 1).all()


def test_languages_without_letters_or_training(spark, docs):
    odd = spark.createDataFrame([(1, None, None), (2, "", "x"), (3, "12 ?!", None), (4, "the " * 5000, "en"),
                                 (None, "the", None)], SCHEMA + "").withColumn("score", F.lit("v"))
    model = L.learn(docs)
    assert model.families == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    kept = L.keep_identified(odd, model)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} <= {4, None}
    found = L.identify(odd.drop("score"), model).collect()
    assert [r["lang_pred"] for r in found][:3] == ["und"] * 3 and found[3]["lang_pred"] == "en"
    empty = L.learn(odd.limit(0).drop("score"))
    assert empty is None and {r["lang_pred"] for r in L.identify(odd.drop("score"), empty).collect()} == {"und"}


def test_one_language_and_three_in_a_family():
    assert L.LanguageTree(["the cat"] * 3, ["en"] * 3).predict(*packed(["a", ""]))[0] == ["en", "en"]
    texts = ["the house and that", "der hund und das", "de hond en het"] * 8
    model = L.LanguageTree(texts, ["en", "de", "nl"] * 8)
    assert model.predict(*packed(texts[:3]))[0] == ["en", "de", "nl"]


def test_mean_weights_equal_a_plain_loop():
    data, offsets = packed(["abc de", "", "x", "Ünï cödé the end"])
    weights = np.random.default_rng(1).normal(size=len(L.ORDERS) << L.BITS).astype(np.float32)
    index = L.features(data, offsets)
    for r in range(4):
        alone = L.features(*packed([["abc de", "", "x", "Ünï cödé the end"][r]]))
        values = np.concatenate([weights[i[g]] for i, g in alone])
        want = L.SCALE * values.sum() / max(1, len(values))
        assert L.sums(index, offsets, weights)[r] == pytest.approx(want, abs=1e-3)


def test_quality_of_held_out_documents(spark, folder, labels):
    got = Q.op3_quality(spark, folder).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1].score.values, got[got.quality == 0].score.values
    assert (good[:, None] > bad[None, :]).mean() > 0.9
    assert (got.predicted == (got.score >= 0.3)).all() and (got.predicted == got.quality).mean() > 0.85


def test_neighbour_votes_equal_a_plain_search():
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abc *#"), 60)) for _ in range(40)]
    model = Q.NeighbourVote(texts, [k % 2 for k in range(40)], {0: 1.0, 1: 0.5})
    new = ["".join(rng.choice(list("abc *#"), 30)) for _ in range(300)] + [""]
    got = model.score(*packed(new))
    for text, score in list(zip(new, got))[:20] + [("", got[-1])]:
        x = Q.counts(*packed([text]))[0] * model.idf
        z = x @ model.basis
        cosine = model.vectors @ (z / max(np.linalg.norm(z), 1e-12))
        near = np.argsort(-cosine)[: Q.NEIGHBOURS]
        power = np.maximum(cosine[near], 0) ** Q.SHARPNESS * model.weight[near]
        want = (power @ model.labels[near] + 0.05 * model.prior) / (power.sum() + 0.05)
        assert score == pytest.approx(want, abs=2e-3)


def test_toxicity_of_held_out_documents(spark, folder, labels):
    got = T.op6_toxicity(spark, folder).join(labels, "doc_id").where("held_out").toPandas()
    toxic, clean = got[got.toxic == 1].score.values, got[got.toxic == 0].score.values
    assert len(got) > 50 and (toxic[:, None] > clean[None, :]).mean() > 0.8


def test_misspelt_words_and_long_texts():
    clean = [f"this is the plain sentence number {k} about a green garden and the weather" for k in range(60)]
    toxic = [c + " you stupid idiot" for c in clean]
    model = T.SubwordSoftmax(clean + toxic, [0] * 60 + [1] * 60)
    texts = ["my neighbour is an idiott and a stupidd man", clean[3], clean[5] * 300,
             clean[5] * 300 + " you stupid idiot " + clean[5] * 300, ""]
    score = model.score(*packed(texts))
    assert score[0] > 0.5 and score[3] > 0.5 and max(score[1], score[2], score[4]) < 0.5


def test_windows_of_words_count_each_word_once():
    grams, window, base = T.subwords(*packed(["the the the the", "", "a " * 40, "dogs cats"]))
    assert list(base) == [0, 1, 2, 5, 6]
    assert len(grams[window == 0]) == len(T.subwords(*packed(["the "]))[0])
    assert (window == 1).sum() == 0 and len(grams[window == 5]) > 5


def test_scores_of_odd_rows(spark, docs, labels):
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (2, "")], "doc_id long, text string")
    for module in (Q, T):
        rows = Q.score_texts(odd, module.learn(docs, labels)).collect()
        assert len(rows) == 4 and all(0 <= r["score"] <= 1 for r in rows)
        assert module.learn(docs, labels.limit(0)) is None
        assert {r["score"] for r in Q.score_texts(odd, None).collect()} == {0.5}
        assert Q.score_texts(odd.limit(0), None).count() == 0


@pytest.fixture(scope="module")
def licences(docs):
    return P.LicenceModel(docs)


def test_licence_lines(spark, docs, licences):
    lines = {"gpl": "This work is licensed under the GNU General Public License, version 3.",
             "mit": "Released under the MIT License.", "apache": "Licensed under the Apache License, Version 2.0.",
             "cc-by-nc": "Licensed under CC BY-NC 4.0."}
    found = P.licence_paragraphs(docs, licences).groupBy("doc_id").agg(F.collect_set("family").alias("f"))
    got = {r["doc_id"]: set(r["f"]) for r in found.collect()}
    for r in docs.collect():
        want = {f for f, line in lines.items() if line in r["text"]}
        assert got.get(r["doc_id"], set()) == want, r["doc_id"]


def test_licence_mentions_and_odd_rows(spark, licences):
    rows = [(1, None), (2, ""), (3, "He lost his driving licence near the public library.\nFree software is nice."),
            (4, "x\n\nThis Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.\ny"),
            (None, "SPDX-License-Identifier: Apache-2.0"), (4, "z")]
    docs = spark.createDataFrame([(*r, "v") for r in rows], "doc_id long, text string, family string")
    got = {(r["doc_id"], r["place"], r["family"]) for r in P.licence_paragraphs(docs, licences).collect()}
    assert got == {(4, 2, "mpl"), (None, 0, "apache")}
    assert P.licence_paragraphs(docs.limit(0), licences).count() == 0


def test_licence_notices_inside_longer_lines(spark, licences):
    prose = "The weather in the valley was mild and the farmers of the region went to the market with their goods "
    rows = [(1, "Copyright (c) 2021 Jane Doe. Released under the MIT License."),
            (2, prose * 20 + "and this work is licensed under the GNU General Public License, version 3. " + prose * 20),
            (3, prose + "Licensed under CC BY-NC 4.0. " + prose),
            (4, prose + "Released under the MIT License. " + prose + "Licensed under the Apache License, Version 2.0. "),
            (5, prose + "and the album was released under the terms of the contract, subject to the following conditions"),
            (6, "She studied at MIT; the license of the restaurant was renewed free of charge. " + prose)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["place"], r["family"]) for r in P.licence_paragraphs(docs, licences).collect())
    assert got == [(1, 0, "mit"), (2, 0, "gpl"), (3, 0, "cc-by-nc"), (4, 0, "apache"), (4, 0, "mit")]


def test_training_pieces_have_the_stated_numbers_of_words(spark):
    rows = spark.createDataFrame([("a", [f"w{k}" for k in range(16)]), ("b", ["x", "y"])], "family string, words array<string>")
    got = {}
    for r in P.pieces(rows).collect():
        got.setdefault(r["family"], []).append(r["words"])
    whole = [f"w{k}" for k in range(16)]
    want = [whole] + [whole[i : i + k] for k in (5, 8, 13) for i in range(16 - k + 1)]
    assert sorted(got["a"]) == sorted(want) and got["b"] == [["x", "y"]]


def plain_runs(pairs, own, fewest):
    """Runs as `matching_runs` describes them, with a plain loop."""
    found, k = [], 0
    while k < len(pairs):
        if pairs[k] not in own:
            k += 1
            continue
        first, score, hits, best, end, most = k, 0, 0, 0, k, 0
        while k < len(pairs):
            if pairs[k] in own:
                score, hits = score + P.GAIN, hits + 1
                if score >= best:
                    best, end, most = score, k + 1, hits
            else:
                if score < P.LOSS:
                    break
                score -= P.LOSS
            k += 1
        if most >= fewest:
            found.append((first, end - first, most))
    return found


def test_matching_runs_equal_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    rows = [[str(x) for x in rng.choice(["a", "b", "c", "x", "y"], n, p=p)]
            for n in (0, 1, 2, 3, 7, 20, 60, 300) for p in ([0.2] * 5, [0.3, 0.3, 0.3, 0.05, 0.05], [0.1] * 3 + [0.35] * 2)]
    own = ["a", "b", "c"]
    df = spark.createDataFrame([(r,) for r in rows], "pairs array<string>")
    for fewest in (1, 3, 8):
        got = df.select("pairs", P.matching_runs(F.col("pairs"), own, fewest).alias("runs"),
                        P.has_run(F.col("pairs"), own, fewest).alias("any")).collect()
        for r in got:
            want = plain_runs(r["pairs"], own, fewest)
            assert [tuple(x) for x in r["runs"]] == want and (r["any"] or not want)


def test_only_what_cannot_be_confirmed_is_left_out(spark, licences):
    rng = np.random.default_rng(6)
    known = sorted(licences.followers)
    rows = [[str(x) for x in rng.choice(known if rng.random() < 0.7 else [*known[:20], "zz", "qq"], n)]
            for n in (1, 2, 3, 5, 9, 14) for _ in range(30)]
    listed = [r["words"] for r in licences.templates.collect()]
    rows += [x[i : i + n] + ["zz"] * z for x in listed for i in (0, 2) for n in (3, 6, 12) for z in (0, 1, 3)]
    df = spark.createDataFrame([(r,) for r in rows], "words array<string>")
    for r in df.select("words", licences.could_be_confirmed(F.col("words")).alias("could")).collect():
        own = {" ".join(p) for p in zip(r["words"], r["words"][1:])}
        share = max(len(own & set(licences.own_pairs(f))) / max(1, len(own)) for f in P.FAMILIES)
        assert r["could"] or not own or share < P.CONFIRMED, r["words"]


def test_long_repeated_and_clashing_licence_lines(spark, licences):
    line = "Released under the MIT License."
    rows = [(1, "word " * 60000 + line + " word" * 60000, "v", 1), (2, line, "v", 1), (2, line, "v", 1),
            (3, line + "\n" + line, "v", 1), (4, (line + " ") * 400, "v", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, family string, row int")
    got = [(r["doc_id"], r["place"], r["family"]) for r in P.licence_paragraphs(docs, licences).collect()]
    assert sorted(got) == [(1, 0, "mit"), (2, 0, "mit"), (2, 0, "mit"), (3, 0, "mit"), (3, 1, "mit"), (4, 0, "mit")]


def test_licence_model_learns_from_every_line(spark):
    """Each of 3000 documents has a line of its own; the lines' features are those of their n-grams."""
    rows = [(i, f"tale{i} of the public license\nrain\n\n{'free software ' * (i % 3)}word{i % 7}") for i in range(3000)]
    lines = {tuple(line.split()) for _, text in rows for line in text.split("\n") if line}
    model = P.LicenceModel(spark.createDataFrame(rows, "doc_id long, text string"))
    want = {}
    for line in lines:
        own = {" ".join(line[i : i + n]) for n in (1, 2, 3) for i in range(len(line) - n + 1)} & set(model.features)
        want[tuple(sorted(own))] = want.get(tuple(sorted(own)), 0) + 1
    got = {}
    for r in model.lines.collect():
        got[tuple(r["grams"])] = got.get(tuple(r["grams"]), 0) + r["n"]
    assert got == want and sum(got.values()) == len(lines) == 3000 + 1 + 7 * 3
