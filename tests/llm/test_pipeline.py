"""Each stage of the corpus pipeline against a brute-force version of it, and the whole on a small table."""

import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from eventmesa.llm import langid, packed, queries
from eventmesa.llm.common import new_path
from pyspark.sql import functions as F

from .test_operators import brute_components, brute_mix, prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)
BENCH = [(1, " ".join(f"item{i}" for i in range(20)))]


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(17)
    lexicon = {lang: ["".join(r.choices(letters, k=r.randint(3, 7))) for _ in range(80)] for lang, letters in {"aa": "eintrsdhul", "bb": "aoqécumpgf"}.items()}
    rows = []
    for i in range(240):
        lang = "ab"[i % 2] * 2
        w = r.choices(lexicon[lang], k=r.randint(20, 60))
        if i % 12 == 5:
            w[3:3] = BENCH[0][1].split()[2:18]
        rows.append((i, " ".join(w), lang, ["x", "y", None][i % 3], 1))
    rows += [(300 + i, rows[i][1] + " more", *rows[i][2:]) for i in range(0, 60, 3)]
    rows += [(400, None, "aa", "x", 0), (401, "123 456", "aa", "x", 0), (402, " ".join("wvkzjx"[i % 6] * 3 + "wkzxvj"[i % 5] for i in range(60)), None, "y", 0), (None, rows[7][1], "bb", "x", 0)]
    path = new_path(spark, "pipeline")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows


def ran(spark, stage, path, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    out = STAGES[stage](spark, docs, path)
    assert stage == "token_output" or out.schema == docs.schema
    return [tuple(x) for x in out.collect()]


def test_language_stage_drops_what_is_rejected(spark, tables):
    path, rows = tables
    kept = {x[0] for x in ran(spark, "language_id", path, rows)}
    assert not kept & {400, 401, 402} and len(kept & set(range(240))) >= 236
    docs = spark.createDataFrame(rows, SCHEMA)
    verdicts = langid.predict(docs, langid.fit(langid.teaching(docs))).where("not rejected").collect()
    assert kept == {x.doc_id for x in verdicts}


def test_dedup_stage_matches_all_pairs(spark, tables):
    path, rows = tables
    named = [x for x in rows if x[0] is not None]
    least = brute_components([(x[0], x[1]) for x in named], 5, 80)
    assert sorted(x[0] for x in ran(spark, "near_dedup", path, rows)) == sorted(i for i, (_, c) in least.items() if i == c)


def test_decontamination_stage_drops_windows(spark, tables):
    path, rows = tables
    item = BENCH[0][1].split()
    windows = [item[i : i + 13] for i in range(len(item) - 12)]

    def bad(text):
        w = (text or "").split()
        hit = {p + j for p in range(len(w) - 12) if w[p : p + 13] in windows for j in range(13)}
        return bool(hit) and 20 * len(hit) >= len(w)

    assert Counter(ran(spark, "decontamination", path, rows)) == Counter(x for x in rows if not bad(x[1]))


def test_mixing_stage_takes_what_brute_force_takes(spark, tables):
    path, rows = tables
    place = list(range(len(rows)))
    keyed = [(x[0], x[1]) for x in rows]
    source = {x[0]: x[3] for x in rows}
    times = brute_mix(keyed, source)
    assert Counter(ran(spark, "mixing", path, rows)) == Counter({rows[k]: times[k][2] for k in place if times[k][2]})


def test_token_stage_holds_what_the_tokenizer_gives(spark, tables):
    path, rows = tables
    rows = sorted(rows[:40] + rows[:3], key=lambda x: x[0])
    tokenizer, start, expected = packed.tokenizer_at(queries.tokenizer_path()), 0, []
    for x in rows:
        ids = np.array(tokenizer.encode(x[1], add_special_tokens=False).ids + [2], "<u4")
        expected.append((x[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(ran(spark, "token_output", path, rows)) == expected


def test_run_is_the_stages_one_after_another(spark, tables):
    path, rows = tables
    for stage in list(STAGES)[:-1]:
        rows = ran(spark, stage, path, rows)
    ends = Counter(x[0] for x in rows)
    out = corpus_pipeline.run(spark, path)
    got = out.collect()
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and Counter(x.doc_id for x in got) == ends
    assert sorted(x.start for x in got)[0] == 0 and out.agg(F.max(F.col("start") + F.col("n_tokens")) == F.sum("n_tokens")).first()[0]


def test_stages_take_an_empty_table(spark, tables):
    for stage in STAGES:
        assert ran(spark, stage, tables[0], []) == []


def test_word_scores_do_not_depend_on_how_many_are_learnt_at_once(monkeypatch):
    r = np.random.default_rng(5)
    model = langid.Model(["a", "b"], r.normal(size=(langid.BUCKETS, 2)), np.zeros(2), 1.0, 0.0)
    texts = [" ".join("".join(r.choice(list("abcdeé1"), r.integers(1, 9))) for _ in range(300)).encode() for _ in range(4)]
    whole = langid.WordScores(model).logits(texts)
    monkeypatch.setattr(langid, "LEARNT_AT_ONCE", 7)
    monkeypatch.setattr(langid, "KNOWN_WORDS", 100)
    scores = langid.WordScores(model)
    parts = [scores.logits([texts[0], t]) for t in texts]  # the cache is emptied between batches that share words
    assert all(np.allclose(whole[0][[0, i]], z) and (whole[1][[0, i]] == n).all() for i, (z, n) in enumerate(parts))
