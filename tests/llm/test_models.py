"""Quality, language and toxicity: held-out accuracy on the given tables, and unclean rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slopeworks.llm import language, quality, toxicity
from slopeworks.llm.queries import op1_toxicity, op7_quality, op9_language, remainder
from tests.llm.fixtures import documents, no_documents, texts

SF = "/root/testdata/sf0.01"


def held_out(spark, query, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label)
    return query(spark, SF).filter("held_out").join(labels, "doc_id").toPandas()


def test_quality_held_out(spark):
    rows = held_out(spark, op7_quality, "quality")
    assert (rows.predicted == rows.quality).mean() > 0.95
    assert rows.score.between(0, 1).all()


def test_toxicity_held_out(spark):
    rows = held_out(spark, op1_toxicity, "toxic")
    assert (rows.predicted == rows.toxic).mean() > 0.93
    assert rows[rows.toxic == 1].score.mean() > 3 * rows[rows.toxic == 0].score.mean()


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = op9_language(spark, SF).filter("held_out").join(docs, "doc_id").toPandas()
    assert (rows.lang_pred == rows.lang).mean() > 0.98


def test_labels_of_held_out_rows_teach_nothing(spark, tmp_path):
    """Turning every held-out label round, and every lang, changes no score."""
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    for name in ("quality", "toxic"):
        turned = F.when(remainder("doc_id", 5) == 0, 1 - F.col(name)).otherwise(F.col(name))
        labels = labels.withColumn(name, turned.cast("int"))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for query in (op1_toxicity, op7_quality):
        before = {r.doc_id: r.score for r in query(spark, "/root/testdata/sf0.001").collect()}
        assert before == pytest.approx({r.doc_id: r.score for r in query(spark, str(tmp_path)).collect()})


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, label int").selectExpr("*", "'x' as text", "1 as score")


def test_unclean_rows(spark):
    docs, labels = documents(spark), labels_of(spark, [(0, 1), (1, 0), (1, 0), (2, None), (100, 1), (101, 0), (103, 1), (None, 1)])
    found = quality.score(quality.features(docs), quality.train(quality.features(docs), labels, "doc_id", "label"))
    assert sorted(r.doc_id for r in found.collect()) == sorted(i for i, _ in texts())
    assert all(0 <= r.score <= 1 for r in found.collect())
    model = toxicity.train(docs, labels, "doc_id", "text", "label", F.col("id") % 2 == 0)
    found = toxicity.score(docs, model).collect()
    assert sorted(r.doc_id for r in found) == sorted(i for i, _ in texts()) and all(0 <= r.score <= 1 for r in found)


def test_nothing_to_learn_from(spark):
    none = labels_of(spark, [])
    docs = documents(spark)
    rows = quality.features(docs)
    assert {r.score for r in quality.score(rows, quality.train(rows, none, "doc_id", "label")).collect()} == {0.5}
    model = toxicity.train(docs, none, "doc_id", "text", "label", F.col("id") % 2 == 0)
    assert {r.score for r in toxicity.score(docs, model).collect()} == {0.0}
    found = language.identify(docs, language.train(no_documents(spark))).collect()
    assert {(r.lang_pred, r.score) for r in found} == {("und", 0.0)}
    for frame in (quality.score(quality.features(no_documents(spark)), quality.AdditiveModel()), toxicity.score(no_documents(spark), model)):
        assert frame.count() == 0


def languages_of(spark, model, words):
    frame = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    rows = sorted(language.identify(frame, model).collect(), key=lambda r: r.doc_id)
    return [r.lang_pred for r in rows], np.array([r.score for r in rows])


def test_language_backs_off_to_shorter_grams(spark):
    rows = [(1, "walking talking making", "en"), (2, "walking", "en"), (3, "gehen stehen sehen", "de"), (4, None, "de"), (5, "x", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(frame)
    langs, scores = languages_of(spark, model, ["working", "drehen", "1234 !!!", "", "WALKING", "東京", "  walking drehen sehen"])
    assert langs[:2] == ["en", "de"] and langs[2:4] == ["und", "und"] and langs[4] == "en" and langs[6] == "de"
    assert scores[2] == scores[3] == 0 and 0 <= scores.min() and scores.max() <= 1
    assert scores[5] == pytest.approx(0.5)  # a word without a known n-gram does not vote


def test_known_word_has_its_log_frequency(spark):
    rows = [(1, "same same same other", "aa"), (2, "same different", "bb")]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    _, scores = languages_of(spark, model, ["same"])
    words, alpha = 3, 0.5
    a, b = (3 + alpha) / (4 + alpha * words), (1 + alpha) / (2 + alpha * words)
    assert scores[0] == pytest.approx(a / (a + b), rel=1e-5)


LANGUAGE_ROWS = [
    (1, "Walking talking, making walking MAKING ever-after", "en"), (2, "walking straße über", "de"),
    (3, "gehen stehen sehen gehen", "de"), (4, "идти стоять видеть идти", "ru"), (5, None, "de"), (6, "lost", None),
    (7, "andare vedere stare parlare", "it"), (7, "andare vedere stare parlare", "it"), (None, "restare mai", "it"),
]
ASKED = [
    *texts(), (None, "working"), (None, "working"), (500, "видеть working"), (501, "ǅ İstanbul straßen"), (502, "gehend " * 300),
    (503, "x" * 20_000), (504, "qq andare wxyz " * 2000), (505, "東京 стоит"),
]


def language_brute_force(rows, asked):
    """Plain dictionaries of counts: words first, then n-grams of the longest order that has any."""

    def words_of(text):
        return "".join(c if c.isalpha() else " " for c in (text or "").lower()).split(" ")

    def grams(word, order):
        marked = f"\0{word}\0"
        return [g for g in (marked[k : k + order] for k in range(len(marked) - order + 1)) if g != "\0"]

    counts = {order: {} for order in range(language.MAX_ORDER + 1)}
    for _, text, lang in rows:
        for word in words_of(text) if lang and text is not None else ():
            for order in counts if word else ():
                for key in grams(word, order) if order else [word]:
                    own = counts[order].setdefault(key, {})
                    own[lang] = own.get(lang, 0) + 1
    langs = sorted({lang for _, text, lang in rows if lang and text is not None})
    sums = {(o, lang): sum(c.get(lang, 0) for c in counts[o].values()) for o in counts for lang in langs}

    def vote(order, key):
        return np.array([np.log((counts[order][key].get(l, 0) + 0.5) / (sums[order, l] + 0.5 * len(counts[order]))) for l in langs])

    out = []
    for doc_id, text in asked:
        total, any_ = np.zeros(len(langs)), False
        for word in filter(None, words_of(text)):
            any_ = True
            if word in counts[0]:
                total = total + vote(0, word)
                continue
            for order in range(language.MAX_ORDER, 0, -1):
                known = [vote(order, g) for g in grams(word, order) if g in counts[order]]
                if known:
                    total = total + np.mean(known, axis=0)
                    break
        share = np.exp(total - total.max())
        out.append((doc_id, langs[int(total.argmax())] if any_ else "und", 1 / share.sum() if any_ else 0.0))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [0, 3, 10, 1 << 17])
def test_language_against_brute_force_with_words_beyond_the_broadcast(spark, monkeypatch, most):
    monkeypatch.setattr(language, "MAX_WORDS", most or 1)
    monkeypatch.setattr(language, "MAX_GRAMS", most or 1)
    monkeypatch.setattr(language, "_NAMED", 4 if most == 3 else 1 << 20)
    frame = spark.createDataFrame(LANGUAGE_ROWS, "doc_id long, text string, lang string").selectExpr("*", "1 as n", "2 as votes")
    found = language.identify(documents(spark, ASKED), language.train(frame)).collect()
    expected = language_brute_force(LANGUAGE_ROWS, ASKED)
    key = lambda r: (str(r[0]), r[1])
    found, expected = sorted(map(tuple, found), key=key), sorted(expected, key=key)
    assert [r[:1] for r in found] == [r[:1] for r in expected]
    assert [r[2] for r in found] == pytest.approx([r[2] for r in expected], abs=1e-4)
    assert [a for a, b in zip(found, expected, strict=True) if a[1] != b[1] and b[2] > 0.51] == []


def test_features_do_not_depend_on_neighbours():
    rows = pa.array([t or "" for _, t in texts()])
    together = quality.block_features(rows)
    alone = np.vstack([quality.block_features(rows.slice(k, 1)) for k in range(len(rows))])
    assert np.allclose(together, alone)
    assert np.isfinite(together).all() and not together[41].any()


def test_additive_model_learns_an_interaction():
    random = np.random.default_rng(0)
    rows = random.uniform(size=(4000, len(quality.FEATURES)))
    labels = ((rows[:, 0] > 0.5) ^ (rows[:, 1] > 0.5)).astype(float)
    model = quality.fit(rows[:3000], labels[:3000])
    assert (0, 1) in [(a, b) for a, b, _ in model.pairs]
    assert ((model.scores(rows[3000:]) > 0.5) == labels[3000:]).mean() > 0.9


def test_copies_count_once_for_toxicity(spark):
    rows = [(k, "a b c d e f") for k in range(50)] + [(100, "c d x"), (101, "q d")]
    labels = labels_of(spark, [(k, 1) for k in range(50)] + [(100, 0), (101, 0)])
    joined = documents(spark, rows).select("doc_id", "text").join(labels.select("doc_id", "label"), "doc_id")
    counts = {(r.ordinary, r.toxic, r.types) for r in toxicity.counted(joined.select("text", "label")).collect()}
    assert (2, 1, 2) in counts  # d: behind c in both classes, behind q in one
    assert max(r[1] for r in counts) == 1


def toxicity_rows(spark):
    """Rare toxic words behind four different words each, ordinary ones behind many; ids 0 to 3 modulo 4."""
    rows = [(k, " ".join(f"{a}{b} mild{'abcd'[k % 4]}{b}" for a in "pqrst" for b in "uvwxyz")) for k in range(0, 40)]
    rows += [(100 + k, f"one{'abcdefgh'[k % 8]} vile{'stuv'[k // 8]}") for k in range(32)]
    labels = labels_of(spark, [(k, int(k >= 100)) for k, _ in rows])
    return documents(spark, [*rows, (None, "vilet vileu"), (None, "vilet vileu"), (200, ""), (201, "pu milda")]), labels


def test_toxicity_words_beyond_the_broadcast_are_joined(spark, monkeypatch):
    docs, labels = toxicity_rows(spark)

    def scores():
        model = toxicity.train(docs, labels, "doc_id", "text", "label", F.col("id") % 4 == 0)
        rows = [(r.doc_id is None, r.doc_id, r.ratio, r.score) for r in toxicity.score(docs, model).collect()]
        return model, sorted(rows, key=str)

    whole, expected = scores()
    assert whole.rest is None and len({r[2] for r in expected}) > 3
    for most in (3, 10):
        monkeypatch.setattr(toxicity, "MAX_WORDS", most)
        model, found = scores()
        assert len(model.words) == most and most + model.rest.count() == len(whole.words)
        assert [r[:2] for r in found] == [r[:2] for r in expected]
        assert [r[2:] for r in found] == [pytest.approx(r[2:]) for r in expected]


def toxicity_brute_force(rows, asked, discount, pair_discount):
    """``whole, worst`` by dictionaries of counts: log-likelihoods of whole texts in two models of word pairs."""
    from collections import Counter, defaultdict

    def pairs_of(text):
        words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        return list(zip(["", *words], words))  # noqa: B905

    n = [Counter(pair for text, label in rows if label == c for pair in pairs_of(text)) for c in (0, 1)]
    both = n[0] + n[1]
    own = [Counter(w for _, w in n[c]) for c in (0, 1)]
    types, bands = Counter(w for _, w in both), defaultdict(lambda: [0, 0])
    for w, k in types.items():
        for c in (0, 1):
            bands[k.bit_length()][c] += own[c][w]
    freed = np.mean([1 - sum(max(k - discount, 0) for k in own[c].values()) / sum(own[c].values()) for c in (0, 1)])
    total = sum(sum(own[c].values()) for c in (0, 1))

    def alone(c, w):
        ordinary, toxic = bands[types[w].bit_length()]
        share = (toxic + 1) / (ordinary + toxic + 2)
        share = share if c else 1 - share
        return (max(own[c][w] - discount, 0) + freed * types[w] * share) / share / total

    def after(counts, v):
        return [k for (a, _), k in counts.items() if a == v]

    def behind(c, v, w):
        around = after(both, v)
        if not around:
            return alone(c, w)
        kept = [sum(max(k - pair_discount, 0) for k in after(n[d], v)) for d in (0, 1)]
        spare = np.mean([1 - kept[d] / sum(after(n[d], v)) if after(n[d], v) else 1 for d in (0, 1)])
        left = sum(min(k, pair_discount) for k in around)
        shared = max(both[v, w] - pair_discount, 0)
        back = (shared + left * alone(c, w)) / sum(around) if shared else alone(c, w)  # else the classes share the factor
        if not kept[c]:
            return back
        return (1 - spare) * max(n[c][v, w] - pair_discount, 0) / kept[c] + spare * back

    found = []
    for text in asked:
        ratios = [np.log(behind(1, v, w) / behind(0, v, w)) if types[w] else _context(after, n, v, pair_discount) for v, w in pairs_of(text)]
        worst = sorted(ratios)[-toxicity.WORST :]
        found.append((np.mean(ratios) if ratios else 0.0, np.mean(worst) if worst else 0.0))
    return found


def _context(after, n, v, discount):
    """An unseen word has the same probability in both classes, but for what the context leaves to it."""
    kept = [sum(max(k - discount, 0) for k in after(n[d], v)) for d in (0, 1)]
    spare = np.mean([1 - kept[d] / sum(after(n[d], v)) if after(n[d], v) else 1 for d in (0, 1)])
    left = [spare if kept[d] else 1 for d in (0, 1)]
    return np.log(left[1] / left[0])


@pytest.mark.parametrize("most", [5, 1 << 20])
def test_toxicity_is_of_whole_texts_in_two_models_of_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(toxicity, "MAX_WORDS", most)
    random = np.random.default_rng(4)
    words = [f"w{chr(97 + k)}" for k in range(12)]
    rows = [(" ".join(random.choice(words[3 * label :], 40)), label) for label in (0, 0, 0, 1, 1) for _ in range(3)]
    rows += [("wa vile wb vile wc vile we vile wf vile one", 1), ("one wa two wb one wd", 0)]
    asked = [*[text for text, _ in rows[::4]], "vile wa wb", "unseen wa unseen", "wa", "", None, "wk wl wk wl vile one vile one " * 50]
    model = toxicity.built(toxicity.all_counts(spark.createDataFrame(rows, "text string, label int")))
    assert (model.rest is not None) == (most == 5)
    frame = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string").repartition(3)
    found = sorted(toxicity.score(frame, model).collect())
    expected = toxicity_brute_force(rows, asked, toxicity.DISCOUNT, toxicity.PAIR_DISCOUNT)
    assert len({round(float(e[0]), 6) for e in expected}) > 6
    assert [(r.whole, r.worst) for r in found] == [pytest.approx(e) for e in expected]


def test_toxicity_counts_the_fold_too(spark):
    docs, labels = toxicity_rows(spark)
    more = [(300 + 4 * k, f"two{'abcdefgh'[k]} fold") for k in range(8)]  # in the fold only
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    labels = labels.select("doc_id", "label").union(spark.createDataFrame([(k, 1) for k, _ in more], "doc_id long, label int"))
    model = toxicity.train(docs, labels, "doc_id", "text", "label", F.col("id") % 4 == 0)
    (found,) = toxicity.score(spark.createDataFrame([(1, "fold fold")], "doc_id long, text string"), model).collect()
    assert found.ratio > 0.5
