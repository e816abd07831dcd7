import datetime

import numpy as np
import pyarrow as pa
import pytest
from common import WORD, empty, rows, table
from pyspark.sql import functions as F

from tarnflow.llm import langid, repetition


def longest_by_definition(w):
    out = []
    for i in range(len(w)):
        best = 0
        for j in range(len(w)):
            n = 0
            while i != j and i + n < len(w) and j + n < len(w) and w[i + n] == w[j + n]:
                n += 1
            best = max(best, n)
        out.append(best)
    return out


def test_repeats_against_definition():
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(list("abc"), rng.integers(0, 50))) for _ in range(40)] + ["", " ", "a a a a a a"]
    codes, starts = repetition.words_of(pa.array(texts))
    got = repetition.repeats(codes, starts)
    for k, t in enumerate(texts):
        assert got[starts[k] : starts[k + 1]].tolist() == longest_by_definition(t.split())


def judged_by_definition(text, limits):
    t = text or ""
    w = WORD.findall(t)
    n = len(w)
    seen, dups = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 3]) for i in range(n - 2)]
    twice = {x for x in windows if windows.count(x) > 1} if n < 400 else {x for x, c in __import__("collections").Counter(windows).items() if c > 1}
    inside = set()
    for i, x in enumerate(windows):
        if x in twice:
            inside.update((i, i + 1, i + 2))
    base = (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dups, len(inside))
    failed = n < limits.min_words or 100 * len(inside) > limits.max_repeat_words_pct * n
    return base, failed


@pytest.mark.parametrize("extra", [False, True])
def test_quality(spark, extra):
    limits = repetition.Limits()
    got = repetition.quality(table(spark, extra), limits).collect()
    want = sorted(((r[0] is not None, r[0] or 0, *judged_by_definition(r[1], limits)) for r in rows()), key=str)
    have = sorted(((r.doc_id is not None, r.doc_id or 0, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words), r.base_failed) for r in got), key=str)
    assert have == want
    assert not any(r.kept and r.base_failed for r in got)
    assert repetition.quality(empty(spark)).count() == 0


def test_verdict_on_a_repeated_half(spark):
    rng = np.random.default_rng(2)
    half = " ".join(f"w{x}" for x in rng.integers(0, 10**6, 120))
    clean = " ".join(f"w{x}" for x in rng.integers(0, 10**6, 200))
    got = {r.doc_id: r for r in repetition.quality(spark.createDataFrame([(1, half + " " + half), (2, clean)], "doc_id long, text string")).collect()}
    assert not got[1].kept and got[1].longest_repeat == 120 and got[1].covered_words == 240
    assert got[2].kept and got[2].covered_words == 0


def ppm_by_definition(training, text):
    """Code length in 1/1024 bit with counts in plain dictionaries, one byte at a time."""
    import math
    from collections import Counter

    seen = [Counter() for _ in range(4)]
    for t in training:
        raw = langid.PAD + t.encode()
        for i in range(3, len(raw)):
            for k in range(4):
                seen[k][raw[i - k : i], raw[i]] += 1
    followers = [Counter() for _ in range(4)]
    totals = [Counter() for _ in range(4)]
    for k in range(4):
        for (context, _), n in seen[k].items():
            followers[k][context] += 1
            totals[k][context] += n
    bits = lambda share: int(np.rint(-math.log2(share) * langid.UNIT))
    raw, out = langid.PAD + text.encode(), 0
    for i in range(3, len(raw)):
        for k in (3, 2, 1, 0):
            context = raw[i - k : i]
            n, d, c = totals[k][context], followers[k][context], seen[k][context, raw[i]]
            if c:
                out += bits(c / (n + d))
                break
            out += bits(d / (n + d)) if n else 0
        else:
            out += 8 * langid.UNIT
    return out


def test_code_lengths_against_definition(spark):
    model = langid.train(table(spark))
    assert model.languages == ["en", "fr"]
    learned = {r.doc_id for r in table(spark).where(~langid.held_out()).collect()} - {None}
    of = {x: [t for i, t, lang, *_ in rows() if lang == x and t is not None and i in learned] for x in model.languages}
    texts = ["hello", "", "é Ñ", "日本", "abc def " * 9, rows()[3][1], rows()[40][1] or "", "\n\n\nab"]
    assert model.score([t.encode() for t in texts]).tolist() == [[ppm_by_definition(of[x], t) for x in model.languages] for t in texts]


def test_costs_follow_the_escape_rule():
    """A tiny history, worked out by hand: after 'zab' three times 'c', once 'd'."""
    import pandas as pd

    gram = lambda s: int.from_bytes(s.encode(), "big")
    model = langid.build(pd.DataFrame({"lang": ["x"] * 2, "gram": [gram("zabc"), gram("zabd")], "n": [3, 1]}))
    cost = lambda s: model.cost(np.array([gram(s)]))[0, 0] / langid.UNIT
    assert cost("zabc") == pytest.approx(-np.log2(3 / 6), abs=1e-3)
    assert cost("zabq") == pytest.approx(-4 * np.log2(2 / 6) + 8, abs=1e-2)
    assert cost("yabc") == pytest.approx(-np.log2(3 / 6), abs=1e-3)


def test_signs_that_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "½ ² Ⅷ 12 _"), (2, "ªa"), (3, "語")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, langid.train(table(spark))).collect()}
    assert got[1] == "und" and "und" not in (got[2], got[3])


def test_prediction(spark):
    docs = table(spark, True)
    got = {r.doc_id: r for r in langid.predict(docs, langid.train(docs)).collect()}
    held = {r.doc_id: r.h for r in docs.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("h")).collect()}
    assert all(got[i].held_out == bool(h) for i, h in held.items())
    for i, t in ((r[0], r[1]) for r in rows()):
        assert (got[i].lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
        assert 0 <= got[i].score <= 1
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert langid.train(none) is None
    assert {r.lang_pred for r in langid.predict(none, None).collect()} == {"und"}
    assert langid.predict(empty(spark), langid.train(empty(spark))).count() == 0


def test_held_out_accuracy(spark):
    import os

    at = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(at):
        pytest.skip("no test tables")
    docs = spark.read.parquet(at)
    got = langid.predict(docs, langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]
    assert got > 0.98


def test_timestamps_and_other_columns_pass(spark):
    docs = spark.createDataFrame([(1, "the cat sat", "en", datetime.datetime(2020, 1, 1), [1, 2])], "doc_id long, text string, lang string, at timestamp, xs array<int>")
    assert langid.keep_known(docs, langid.train(docs), 0.0).count() in (0, 1)
