"""Language models of many languages and of large alphabets."""

from collections import Counter

import numpy as np

from tastewright.llm import language


def words(rng, letters, n):
    return ["".join(rng.choice(letters, rng.integers(2, 6))) for _ in range(n)]


def test_every_language_is_learnt(spark):
    """Seventy languages, the last ones rare, each with letters of its own: 5,600 in all."""
    rng = np.random.default_rng(2)
    rows = []
    for k in range(70):
        letters = [chr(0x4E00 + 80 * k + j) for j in range(80)]
        for _ in range(40 if k < 60 else 15):
            rows.append((len(rows), " ".join(words(rng, letters, 30)), f"l{k:02}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    assert len(model.languages) == 70 and len(model.known) > 5000
    found = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert [i for i, _, lang in rows if found[i].lang_pred != lang] == []
    assert np.mean([found[i].rejected for i, _, lang in rows if lang >= "l60"]) < 0.2


def test_rare_letters_stay_apart():
    """Two languages whose letters are all rarer than 4,500 others."""
    rng = np.random.default_rng(3)
    common = [chr(0x4E00 + j) for j in range(4500)]
    counts = {"common": Counter({c + d: 50 for c, d in zip(common, common[1:] + common[:1])})}
    rare = {"x": [chr(0xAC00 + j) for j in range(40)], "y": [chr(0xAD00 + j) for j in range(40)]}
    for name, letters in rare.items():
        counts[name] = Counter(words(rng, letters, 200))
    scorer = language.Scorer(language.LanguageModel(counts))
    texts = [" ".join(words(rng, letters, 20)).encode() for letters in rare.values()]
    assert scorer.predict(texts)[0].tolist() == ["x", "y"]


def test_blocks_change_no_score(monkeypatch):
    rng = np.random.default_rng(5)
    counts = {n: Counter(words(rng, list(letters), 100)) for n, letters in (("a", "abcdef"), ("b", "defghi"), ("c", "aeiou"))}
    texts = [" ".join(words(rng, list("abcdefghiouz"), 20)).encode() for _ in range(5)]
    whole = language.Scorer(language.LanguageModel(counts)).entropies(texts)[0]
    monkeypatch.setattr(language, "BLOCK", 1)
    assert np.allclose(language.Scorer(language.LanguageModel(counts)).entropies(texts)[0], whole, atol=1e-4)
