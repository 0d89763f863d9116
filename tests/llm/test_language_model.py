"""The language model keeps the words of every language, and joins give the scores of one process."""

from __future__ import annotations

import random
import zlib

import pytest

from quantaint.llm import language

SCHEMA = "doc_id long, text string, lang string"


def rows_of(rng: random.Random) -> tuple[list[tuple], list[str], list[str]]:
    """45,000 words of a hot language three times each; a rare one, about 1 % of the rows, has words of its
    own and words of the hot one, all made of the same letters."""
    words = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(46_000)]
    hot, own = words[:45_000], words[45_000:45_500]
    shared = hot[:200]
    texts = [("en", " ".join(hot[i : i + 100])) for i in range(0, len(hot), 100)] * 4
    texts += [("qq", " ".join(own + shared))] * 18
    rows = [(i, text, lang) for i, (lang, text) in enumerate(texts)]
    return rows, own, shared


def test_rare_language_keeps_its_words(spark):
    rows, own, shared = rows_of(random.Random(3))
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    model = language.train(spark.createDataFrame(learned, SCHEMA).select("lang", "text"))
    assert set(own + shared) <= set(model.tables[0].rows)
    at = model.languages.index("qq")
    unseen = min(v[at] for v in model.tables[0].values)
    assert all(model.tables[0].values[model.tables[0].rows[w]][at] > unseen for w in own + shared)


@pytest.mark.parametrize("held_words", [100, 300_000])
def test_joined_scores_equal_one_process(spark, held_words):
    rng = random.Random(5)
    rows, own, shared = rows_of(rng)
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    scorer = language.Scorer(language.train(spark.createDataFrame(learned, SCHEMA).select("lang", "text")))
    rows += [(10_000 + i, " ".join(rng.sample(own, 2) + ["zzz", "kk", "abcxyz", "é"]), None) for i in range(60)]
    rows += [(20_000, None, "en"), (20_001, "12 ²", None), (20_002, "zz", None), (20_003, "j", None)]
    got = language.predict_languages(spark.createDataFrame(rows, SCHEMA), held_words=held_words).collect()
    texts = {r[0]: r[1] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        lang, score = scorer.predict(texts[r.doc_id])
        assert (r.lang_pred, r.score) == (lang, pytest.approx(score, rel=1e-6))
    assert {r.lang_pred for r in got if 10_000 <= r.doc_id < 20_000} == {"qq"}


@pytest.mark.parametrize("broadcast_grams", [0, 300_000])
def test_few_stage_tables(spark, monkeypatch, broadcast_grams):
    """Each table that is stored makes executors write files; the back-off to shorter n-grams stores two."""
    monkeypatch.setattr(language, "BROADCAST_GRAMS", broadcast_grams)
    stored = []
    for name in ("keep", "keep_texts"):
        write = getattr(language, name)
        monkeypatch.setattr(
            language, name, lambda df, label, write=write: (stored.append(label), write(df, label))[1]
        )
    texts = [("en", "the cat and the dog a"), ("de", "der hund und die katze é")]
    rows = [(i, *texts[i % 2][::-1]) for i in range(30)]
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    # Words that were not learned, with known n-grams of each length, with none, and of one letter.
    odd = ["thecat dogs", "cathun", "hxt txe", "xaxx", "щщщщ", "щ", "x", "a", "é щ"]
    rows += [(1000 + i, text, None) for i, text in enumerate(odd)]
    got = language.predict_languages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(stored) <= 6
    monkeypatch.undo()
    scorer = language.Scorer(language.train(spark.createDataFrame(learned, SCHEMA).select("lang", "text")))
    by_id = {r[0]: r[1] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        lang, score = scorer.predict(by_id[r.doc_id])
        assert (r.lang_pred, r.score) == (lang, pytest.approx(score, rel=1e-6))
