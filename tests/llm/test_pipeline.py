import random
import zlib
from collections import Counter

import numpy as np
import pytest
from common import CLASHING, WORD, rows, table
from test_dedup import classes_by_definition, lines_by_definition
from test_quality import ppm_by_definition

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")


@pytest.fixture
def folder(spark, tmp_path):
    table(spark, True).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_stages_keep_columns_and_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, n = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == columns
            n.append(docs.count())
    assert n[1] < n[0] and n[2] == n[1] and n[3] < n[2] and n[4] <= n[3]
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(docs.columns)


def test_run_equals_stages_on_empty(spark, tmp_path):
    spark.createDataFrame([], CLASHING).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def corpus():
    """Documents in two languages with shared lines, near copies and shared passages that no reading can mistake."""
    rng = random.Random(5)
    words = {x: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(4000)] for x, letters in (("en", "etaoinshrdlu"), ("xx", "zqkvwypbgfmc"))}
    new = lambda x, n: [rng.choice(words[x]) for _ in range(n)]
    line = "This Line is in many of the documents, it is long enough."
    out = [(k, "\n".join(" ".join(new(x, 14)) for _ in range(9)), x) for k in range(40) for x in ["en" if k % 3 else "xx"]]
    out += [(100 + k, "\n".join([" ".join(new("en", 90)), line.upper() if k % 2 else line, " ".join(new("en", 30))]), "en") for k in range(7)]
    base = [new("en", 200) for _ in range(4)]
    for k, b in enumerate(base):
        out += [(200 + 10 * k, " ".join(b), "en"), (201 + 10 * k, " ".join(["zzz", *b[1:]]), "en"), (202 + 10 * k, " ".join(b), "en")]
    passage = new("en", 60)
    out += [(300 + k, " ".join(new("en", 70 + k) + passage + new("en", 50)), "en") for k in range(5)]
    out += [(400, "12 34 !!", "en"), (401, None, "en"), (402, "", None), (403, "½ ²", "xx")]
    return out


def shared_runs(texts, n=50):
    """Runs of words that several documents have, with the documents."""
    seen = {}
    for i, t in texts.items():
        w = WORD.findall(t.lower())
        for a in range(len(w) - n + 1):
            seen.setdefault(tuple(w[a : a + n]), set()).add(i)
    return {k: v for k, v in seen.items() if len(v) > 1}


def test_run_against_plain_definitions(spark, tmp_path):
    """Each stage by its definition on the rows that the stage before it kept; the last gives run()'s rows."""
    import zlib as _zlib

    from tokenizers import Tokenizer

    data = corpus()
    spark.createDataFrame([(i, t, x, "s", None) for i, t, x in data], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = docs.collect()
    # languages: exact code lengths of every text under each language
    learned = {x: [t for i, t, lang in data if lang == x and t is not None and _zlib.crc32(str(i).encode()) % 4 != 2] for x in ("en", "xx")}
    want = {}
    for i, t, _ in data:
        if any(c.isalpha() for c in t or ""):
            bits = [ppm_by_definition(learned[x], t) / 1024 for x in ("en", "xx")]
            if 1 / sum(2.0 ** min(0, min(bits) - b) for b in bits) >= 0.5:
                want[i] = t
    assert {r.doc_id: r.text for r in kept["language_id"]} == want and not {400, 401, 402, 403} & set(want) and len(want) == len(data) - 4
    lines = lines_by_definition(want.items())
    assert Counter((r.doc_id, r.text) for r in kept["line_dedup"]) == Counter({k[:2]: n for k, n in lines.items()}.keys()) and sum(k[3] for k in lines) == 6
    after = {k[0]: k[1] for k in lines}
    classes = classes_by_definition(after.items(), 5, 80)
    first = {i: t for i, t in after.items() if any(k[0] == i == k[2] for k in classes)}
    assert {r.doc_id: r.text for r in kept["near_duplicates"]} == first and len(first) == len(after) - 8
    clean = {r.doc_id: r.text for r in kept["substring_dedup"]}
    shared = shared_runs(first)
    touched = set().union(*shared.values())
    assert touched == set(range(300, 305)) and set(clean) == set(first)
    assert all(clean[i] == first[i] for i in clean if i not in touched)
    assert not shared_runs(clean)
    lost = {i: len(WORD.findall(first[i])) - len(WORD.findall(clean[i])) for i in touched}
    assert sorted(lost.values()) == [0, 60, 60, 60, 60]
    library = Tokenizer.from_file(corpus_pipeline.vocabulary("byte_bpe_50k.json"))
    pieces = Counter()
    for i, t in clean.items():
        ids = library.encode(t, add_special_tokens=False).ids + [0]
        edge = len(ids) % 2048 or 2048
        for p, (a, z) in enumerate([(0, edge), *((s, s + 2048) for s in range(edge, len(ids), 2048))] if len(ids) > 2048 else [(0, len(ids))]):
            pieces[i, p, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in kept["packing"]) == pieces
    places = {}
    for r in kept["packing"]:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(a + n == b for x in places.values() for (a, n), (b, _) in zip(sorted(x), sorted(x)[1:])) and all(min(x)[0] == 0 and max(a + n for a, n in x) <= 2048 for x in places.values())
    assert Counter(tuple(r)[:5] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == pieces


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder).collect()
    kept = {r.doc_id for r in got}
    letters = {r[0] for r in rows() if any(c.isalpha() for c in r[1] or "")}
    assert kept <= letters and len(kept) > 30


def test_language_id_lets_go_of_coders(spark):
    """A worker that packed before keeps no coder, with its memory of pieces, while it works on languages."""
    import pyarrow as pa

    from tarnflow.llm import bpe, langid, packing
    from tarnflow.llm.queries import vocabulary

    docs = spark.createDataFrame([(k, f"some words of text {k}", "en", "s", 1) for k in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    packing.pieces(docs, vocabulary("byte_bpe_50k.json"), 0, 2048).count()
    model = langid.train(docs)
    kept = langid.keep_known(docs, model, min_score=0.0)

    def coders(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(bpe._coders)] * b.num_rows, pa.int64())], names=["n"])

    assert kept.count() == 40
    assert {r.n for r in kept.mapInArrow(coders, "n long").collect()} == {0}
