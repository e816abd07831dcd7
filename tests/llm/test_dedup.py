import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from common import LOWER, SCHEMA, WORD, empty, rows, table

from tarnflow.llm import graph, jaccard_join, line_dedup, media_chunks, substring_dedup, words


@pytest.mark.parametrize("extra", [False, True])
def test_media(spark, extra):
    got = media_chunks.media(table(spark, extra)).collect()
    want = Counter()
    for r in rows():
        b = (r[1] or "").encode()
        p = b + bytes(-len(b) % 64 or (0 if b else 64))
        want[r[0], len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    by_text = defaultdict(set)
    for r in got:
        by_text[r.payload_sha256].add((r.media_sha256, r.feature, r.media_bytes))
    assert all(len(v) == 1 for v in by_text.values())
    assert media_chunks.media(empty(spark)).count() == 0


def test_shared_chunks_are_stored_once(spark):
    import random

    rng = random.Random(1)
    common = "".join(rng.choice("abcdefgh \n") for _ in range(30_000))
    docs = spark.createDataFrame([(k, "".join(rng.choice("xyz ") for _ in range(3000 + k)) + common) for k in range(6)], "doc_id long, text string")
    keyed = docs.selectExpr("doc_id", "unhex(md5(text)) AS key", "text")
    rows_ = media_chunks._manifests(keyed)
    store = media_chunks._store(keyed, media_chunks._roles(rows_)).collect()
    chunks = [r for r in store if r.key is None]
    assert chunks and len({bytes(r.name) for r in chunks}) == len(chunks)
    assert sum(len(r.bytes) for r in store) < 6 * 3100 + 2 * 30_000 + 6 * 4096


def test_media_digests_are_of_the_stored_bytes(spark):
    """Put together from the store's rows by plain code."""
    import random

    rng = random.Random(3)
    common = "".join(rng.choice("abcdefgh \n") for _ in range(30_000))
    data = [(r[0], r[1] or "") for r in rows()] + [(900 + k, "".join(rng.choice("xyz ") for _ in range(3000)) + common) for k in range(3)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    keyed = docs.selectExpr("coalesce(doc_id, 0) AS doc_id", "unhex(md5(text)) AS key", "text")
    store = media_chunks._store(keyed, media_chunks._roles(media_chunks._manifests(keyed))).collect()
    chunks = {bytes(r.name): bytes(r.bytes) for r in store if r.key is None}
    want = set()
    for r in store:
        if r.key is not None:
            n, names, lengths = media_chunks.parsed(bytes(r.head))
            kept, parts = bytes(r.bytes), [bytes(r.head)]
            for i, (name, size) in enumerate(zip(names, lengths)):
                part, kept = (chunks[name], kept) if i in r.shared else (kept[:size], kept[size:])
                parts.append(part)
            assert not kept and len(b"".join(parts[1:])) % 64 == 0
            want.add((hashlib.sha256(b"".join(parts[1:])).hexdigest(), hashlib.sha256(b"".join(parts)).hexdigest(), len(b"".join(parts))))
    assert chunks and want == {(r.payload_sha256, r.media_sha256, r.media_bytes) for r in media_chunks.media(docs).collect()}


def test_damaged_chunks_are_noticed():
    with pytest.raises(ValueError, match="damaged"):
        media_chunks.reconstruct([media_chunks.digest(b"abc")], [3], b"abd", {})


def lines_by_definition(data, min_chars=40, min_docs=5):
    blank = " \t\n\x0b\x0c\r"
    holders = defaultdict(set)
    for i, t in data:
        for line in (t or "").split("\n"):
            key = line.strip(blank).translate(LOWER)
            if len(key) >= min_chars:
                holders[key].add(-(1 << 63) if i is None else i)
    out = Counter()
    for i, t in data:
        lines = (t or "").split("\n")
        own = -(1 << 63) if i is None else i
        keep = [x for x in lines if not (len(h := holders.get(x.strip(blank).translate(LOWER), ())) >= min_docs and own != max(h))]
        out[i, "\n".join(keep), len(lines), len(lines) - len(keep)] += 1
    return out


def test_line_dedup(spark):
    got = line_dedup.line_dedup(table(spark, True)).select("doc_id", "text", "n_lines", "n_dropped")
    want = lines_by_definition([(r[0], r[1]) for r in rows()])
    assert Counter(map(tuple, got.collect())) == want
    assert sum(k[3] for k in want) > 0
    assert line_dedup.line_dedup(empty(spark)).count() == 0
    assert line_dedup.line_dedup(table(spark, True), report=False).columns == table(spark, True).columns


def classes_by_definition(data, k, percent):
    sets, parent = [], {}
    for i, t in data:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append((i, frozenset(tuple(w[a : a + k]) for a in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (_, x) in enumerate(sets):
        for b, (_, y) in enumerate(sets[:a]):
            both = len(x & y)
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, s) in enumerate(sets):
        if i is not None:
            r = find(a)
            least[r] = min(least.get(r, i), i)
    return Counter((i, len(s), least.get(find(a)) if s else i) for a, (i, s) in enumerate(sets))


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_jaccard_join(spark, k, percent):
    data = [(r[0], r[1]) for r in rows()]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(table(spark, True), k, percent).collect())
    assert got == classes_by_definition(data, k, percent)


def test_jaccard_chain_of_small_steps(spark):
    """Texts that link only to their neighbours, so that pivots alone don't settle the tiles."""
    w = [f"w{i}" for i in range(60)]
    data = [(k, " ".join(w[k : k + 40])) for k in range(12)] + [(100 + k, " ".join(w[:20] + [f"z{k}{j}" for j in range(20)])) for k in range(5)]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(spark.createDataFrame(data, "doc_id long, text string"), 4, 85).collect())
    assert got == classes_by_definition(data, 4, 85)


def test_jaccard_empty(spark):
    assert jaccard_join.join(empty(spark)).count() == 0
    assert jaccard_join.join(spark.createDataFrame([(1, None), (2, None)], "doc_id long, text string")).count() == 2


def test_tiles_meet_for_every_link():
    """Sets at the very limit share a tile, at all sizes."""
    import numpy as np

    rng = np.random.default_rng(5)
    for n in [*range(1, 60), 100, 333, 900]:
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for percent in (80, 85):
            lost = n * (100 - percent) // 100
            y = x[: n - lost] if lost < n else x
            swapped = 0
            while 100 * (n - swapped - 1) >= percent * (n + swapped + 1):
                swapped += 1
            z = np.unique(np.concatenate([x[swapped:], rng.integers(0, 1 << 63, swapped, dtype=np.uint64)]))
            for other in (y, z):
                assert np.intersect1d(jaccard_join.tiles(x, percent), jaccard_join.tiles(other, percent)).size


def test_substring_dedup(spark):
    docs = table(spark)
    found = substring_dedup.passages(docs).collect()
    words = {r[0]: WORD.findall((r[1] or "").translate(LOWER)) for r in rows()}
    runs = defaultdict(set)
    for i, w in words.items():
        for a in range(len(w) - 49):
            runs[tuple(w[a : a + 50])].add(i)
    flagged = {r.doc_id for r in found if r.doc_id != r.ref_doc_id}
    for together in runs.values():
        assert len(together - flagged) <= 1
    for r in found:
        assert r.end_word - r.start_word >= 50 and r.n_matched >= 0.8 * r.n_words
        assert r.doc_id != r.ref_doc_id or r.ref_start_word + 50 <= r.start_word
        assert set(words[r.doc_id][r.start_word : r.end_word]) & set(words[r.ref_doc_id][r.ref_start_word : r.ref_end_word])
    cleaned = {r.doc_id: r.text for r in substring_dedup.cleaned(table(spark, True)).collect()}
    assert substring_dedup.cleaned(table(spark, True)).columns == table(spark, True).columns
    for i, t in ((r[0], r[1]) for r in rows()):
        if i not in {r.doc_id for r in found} and t:
            assert cleaned[i] == t
    left = defaultdict(set)
    for i, t in cleaned.items():
        w = WORD.findall((t or "").translate(LOWER))
        for a in range(len(w) - 49):
            left[tuple(w[a : a + 50])].add(i)
    assert max((len(v) for v in left.values()), default=0) <= 1
    assert substring_dedup.passages(empty(spark)).count() == 0


def test_fuzzy_passage(spark):
    import random

    rng = random.Random(2)
    new = lambda n: [f"{rng.choice('abcdef')}{rng.randrange(10**6)}" for _ in range(n)]
    p = new(80)
    q = p[:20] + ["x"] + p[21:45] + p[46:60] + ["y", "z"] + p[60:]
    docs = spark.createDataFrame([(1, " ".join(new(100) + p + new(50)), "", "", 0), (2, " ".join(new(30) + q + new(70)), "", "", 0), (3, " ".join(new(200)), "", "", 0)], SCHEMA)
    r = substring_dedup.passages(docs).collect()
    assert len(r) == 1 and {r[0].doc_id, r[0].ref_doc_id} == {1, 2}
    spans = {r[0].doc_id: (r[0].start_word, r[0].end_word), r[0].ref_doc_id: (r[0].ref_start_word, r[0].ref_end_word)}
    assert abs(spans[1][0] - 100) <= 3 and abs(spans[1][1] - 180) <= 3 and abs(spans[2][0] - 30) <= 3 and abs(spans[2][1] - 111) <= 3


def test_chains_against_all_chains():
    """The Fenwick tree finds the best chain that trying all predecessors finds."""
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(60):
        p, q = np.sort(rng.integers(0, 40, 25)), rng.integers(0, 40, 25)
        best = [0.0] * 25
        for i in range(25):
            best[i] = 1 + max([0.0, *(best[j] - substring_dedup.GAP * (p[i] - p[j] + q[i] - q[j]) for j in range(i) if p[j] < p[i] and q[j] < q[i])])
        score = lambda c: len(c) - substring_dedup.GAP * sum(b[0] - a[0] + b[1] - a[1] for a, b in zip(c, c[1:]))
        got = substring_dedup.chains(p, q)
        if max(best) >= 3:
            assert got and max(map(score, got)) == pytest.approx(max(best), abs=1e-9)


def fresh(seed):
    """Words that no other text has."""
    import random

    rng = random.Random(seed)
    return lambda n: [f"{rng.choice('abcdef')}{rng.randrange(10**9)}" for _ in range(n)]


def covered(found, doc):
    return {k for r in found if r.doc_id == doc for k in range(r.start_word, r.end_word)}


@pytest.mark.parametrize(("length", "between", "times"), [(50, 26, 2), (50, 34, 2), (100, 30, 6)])
def test_passages_with_other_words_between(spark, length, between, times):
    new = fresh(length + between)
    shared = [new(length) for _ in range(times)]
    texts = [[w for s in shared for w in new(between) + s] + new(between) for _ in range(2)]
    found = substring_dedup.passages(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")).collect()
    (doc,) = {r.doc_id for r in found}
    assert {k for s in range(times) for k in range(s * (length + between) + between, (s + 1) * (length + between))} <= covered(found, doc)


def test_passage_of_shared_lines(spark):
    """Each line of the passage also stands alone in other texts, so that its seeds have other holders."""
    new = fresh(5)
    lines = [new(20) for _ in range(3)]
    data = [(k, " ".join(new(15) + lines[k % 3] + new(40))) for k in range(30)]
    data += [(100 + k, " ".join(new(30) + sum(lines, []) + new(30))) for k in range(4)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    found = substring_dedup.passages(docs).collect()
    whole = [d for d in range(100, 104) if set(range(30, 90)) <= covered(found, d)]
    assert len(whole) == 3 and not any(r.doc_id < 100 for r in found)


def test_windows_against_all_runs(spark):
    """Random texts over few lines: of every run of 50 words that several texts have, one place is left."""
    import random

    rng, new = random.Random(9), fresh(9)
    lines = [new(rng.randint(3, 25)) for _ in range(40)]
    data = [(k, sum((rng.choice(lines) for _ in range(rng.randint(2, 30))), [])) for k in range(60)]
    found = substring_dedup.passages(spark.createDataFrame([(k, " ".join(w)) for k, w in data], "doc_id long, text string")).collect()
    gone = {k: covered(found, k) for k, _ in data}
    runs = defaultdict(list)
    for k, w in data:
        for a in range(len(w) - 49):
            runs[tuple(w[a : a + 50])].append((k, set(range(a, a + 50)) <= gone[k]))
    shared = [v for v in runs.values() if len({k for k, _ in v}) > 1]
    assert shared
    for v in shared:
        assert len({k for k, covers in v if not covers}) <= 1


def test_passage_twice_in_one_text(spark):
    new = fresh(3)
    passage, data = new(70), []
    for k in range(4):
        data.append((k, " ".join(new(20) + passage + new(60) + passage + new(20))))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert len({r.doc_id for r in substring_dedup.passages(docs).collect()}) >= 3
    together = " ".join(r.text for r in substring_dedup.cleaned(docs).collect())
    assert together.count(" ".join(passage[5:65])) == 1


@pytest.mark.parametrize(("length", "every", "rate"), [(60, 6, 0), (60, 5, 0), (80, 6, 0), (60, 0, 0.15), (80, 0, 0.15), (60, 0, 0.1)])
def test_recall_of_edited_passages(spark, length, every, rate):
    """Against brute force: all pairs of texts with one passage each, which match by as many words as were left."""
    import random

    rng, new = random.Random(length + every), fresh(length * 10 + every)
    data, edited = [], set()
    for k in range(100):
        p = new(length)
        changed = {i for i in range(length) if (every and i % every == every - 1) or rng.random() < rate}
        q = [new(1)[0] if i in changed else x for i, x in enumerate(p)]
        inner = sorted(set(range(length)) - changed)
        n = inner[-1] - inner[0] + 1
        if n >= 50 and len(inner) >= 0.8 * n:
            edited.add(k)
        data += [(2 * k, " ".join(new(40) + p + new(40))), (2 * k + 1, " ".join(new(30) + q + new(50)))]
    found = substring_dedup.passages(spark.createDataFrame(data, "doc_id long, text string")).collect()
    caught = {r.doc_id // 2 for r in found}
    assert all(r.doc_id // 2 == r.ref_doc_id // 2 for r in found)
    assert len(edited) > 60 and len(caught & edited) >= 0.95 * len(edited)


def test_jaccard_counts_all_links(spark):
    """Five texts that all link, steps that only neighbours link, copies, and over 256 texts in one class."""
    w = [f"w{i}" for i in range(400)]
    data = [(k, " ".join([*w[:60], f"x{k}"])) for k in range(5)] + [(9, " ".join([*w[:60], "x0"]))]
    data += [(100 + k, " ".join(w[100 + k : 140 + k])) for k in range(12)] + [(200, "alone"), (201, ""), (202, None)]
    data += [(1000 + k, " ".join([*w[200:260], f"y{k}"])) for k in range(300)]
    sets = {i: {tuple(t[a : a + 4]) for a in range(len(t) - 3)} or ({tuple(t)} if t else set()) for i, t in ((i, (x or "").split()) for i, x in data)}
    want = {a: sum(a != b and bool(x & y) and 100 * len(x & y) >= 85 * len(x | y) for b, y in sets.items()) for a, x in sets.items()}
    got = {r.doc_id: r.n_links for r in jaccard_join.join(spark.createDataFrame(data, "doc_id long, text string"), 4, 85, count_links=True).collect()}
    assert got == want and want[0] == 5 and want[1000] == 299


def test_repeat_inside_one_text(spark):
    """Its second copy refers to the first; a text of one repeated line keeps one run of it; runs that overlap don't count."""
    new = fresh(12)
    passage, line = new(60), new(7)
    data = [(1, new(30) + passage + new(45) + passage + new(10)), (2, line * 40), (3, new(300)), (4, (new(1) * 60) + new(50))]
    found = substring_dedup.passages(spark.createDataFrame([(k, " ".join(w)) for k, w in data], "doc_id long, text string")).collect()
    assert all(r.doc_id == r.ref_doc_id for r in found)
    assert covered(found, 1) == set(range(135, 195))
    assert {r.ref_start_word for r in found if r.doc_id == 1} == {30}
    assert set(range(56, 280)) <= covered(found, 2) and not covered(found, 3) and not covered(found, 4)


def test_passage_whose_halves_others_hold(spark):
    """Thirty groups: A and B share 60 words, C has the first half of them and D the second."""
    new = fresh(31)
    data = []
    for g in range(30):
        p = new(60)
        data += [(10 * g, new(40) + p + new(40)), (10 * g + 1, new(25) + p + new(60)), (10 * g + 2, new(50) + p[:30] + new(50)), (10 * g + 3, new(50) + p[30:] + new(50))]
    found = substring_dedup.passages(spark.createDataFrame([(k, " ".join(w)) for k, w in data], "doc_id long, text string")).collect()
    assert {r.doc_id // 10 for r in found} == set(range(30)) and {r.doc_id % 10 for r in found} <= {0, 1}


def test_passage_of_very_many_texts(spark):
    """A group larger than what a task keeps apart: all but one have the passage flagged, whole."""
    new = fresh(77)
    p = new(55)
    data = [(k, " ".join(new(10 + k % 7) + p + new(30))) for k in range(400)]
    found = substring_dedup.passages(spark.createDataFrame(data, "doc_id long, text string").repartition(5)).collect()
    whole = [k for k in range(400) if set(range(10 + k % 7, 65 + k % 7)) <= covered(found, k)]
    assert len(whole) == 399 and len({r.doc_id for r in found}) == 399


def test_seeds_are_chosen_alike():
    """Two texts that agree on K + W - 1 words share a seed there; at most W seeds apart, in words of few kinds too."""
    import numpy as np

    rng = np.random.default_rng(8)
    for kinds in (1, 2, 3, 10**6):
        for _ in range(50):
            common = rng.integers(0, kinds, substring_dedup.K + substring_dedup.W - 1)
            texts = [np.concatenate([rng.integers(0, 10**6, rng.integers(0, 40)), common, rng.integers(0, 10**6, rng.integers(0, 40))]).astype(np.uint32) for _ in range(2)]
            at = [next(i for i in range(len(t)) if (t[i : i + len(common)] == common).all()) for t in texts]
            h, text, pos = substring_dedup.seeds(np.concatenate(texts), np.cumsum([0, *map(len, texts)]))
            inner = [{(x, p - at[k]) for x, j, p in zip(h.tolist(), text.tolist(), pos.tolist()) if j == k and at[k] <= p < at[k] + substring_dedup.W} for k in (0, 1)]
            assert inner[0] & inner[1]


def test_covering():
    import random

    rng = random.Random(6)
    for _ in range(200):
        rows_ = [(a, a + rng.randint(50, 90)) for a in (rng.randint(0, 400) for _ in range(rng.randint(0, 30)))]
        some = substring_dedup.covering(rows_)
        union = lambda rs: {k for a, z in rs for k in range(a, z)}
        assert union(some) == union(rows_) and set(some) <= set(rows_) and sum(z - a for a, z in some) <= 2 * len(union(rows_)) + 1


def test_passage_of_seeds_that_many_texts_have(spark):
    """Two texts share an edited passage, each run of four of whose words stands in sixty other texts that share nothing else."""
    new = fresh(91)
    p = new(60)
    q = [x if i % 7 < 6 else new(1)[0] for i, x in enumerate(p)]
    data = [(1, new(40) + p + new(40)), (2, new(30) + q + new(50))]
    data += [(100 * (i + 1) + j, new(25) + p[i : i + 4] + new(25)) for i in range(57) for j in range(60)]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in data], "doc_id long, text string").repartition(4)
    found = substring_dedup.passages(docs).collect()
    assert {(r.doc_id, r.ref_doc_id) for r in found} in ({(1, 2)}, {(2, 1)})
    assert len(found) == 1 and found[0].n_words >= 50 and found[0].n_matched >= 0.8 * found[0].n_words


def test_open_pairs_meet_every_text_before():
    """However many texts have a pair, whatever the size of blocks; pairs that are not open ask nothing."""
    import numpy as np

    rng = np.random.default_rng(5)
    h, k, p = rng.integers(0, 4, 400).astype(np.uint64), rng.integers(0, 90, 400), rng.integers(0, 1000, 400)
    d, asks = rng.integers(1, 49, 400), rng.random(400) < 0.4
    want = {(k[i], k[j], p[i], p[j], p[i] + d[i], p[j] + d[j]) for i in np.flatnonzero(asks) for j in range(400) if h[i] == h[j] and k[j] < k[i]}
    size = substring_dedup.EMITTED
    for substring_dedup.EMITTED in (50, size):
        got = {r for block in substring_dedup.met(h, k, p | np.where(asks, substring_dedup.MARK, 0), d) for r in zip(*(c.tolist() for c in block))}
        assert got == want


def test_few_texts_of_a_seed_all_meet():
    import numpy as np

    n = substring_dedup.FEW
    for texts, hot in ((n, False), (n + 1, True)):
        key, holder, _, _, _, heat = substring_dedup.matched(np.ones(texts, np.int64), np.arange(texts), np.arange(texts), near=True)
        pairs = {(a, b) for a, b in zip(key.tolist(), holder.tolist()) if a != b}
        assert heat.all() == hot and (hot or pairs == {(a, b) for a in range(texts) for b in range(a)})


def test_passage_around_a_line_of_many_texts(spark):
    """Two texts agree on a line that a hundred have, and on 25 of the 32 words beside it, but on no other four in a row."""
    new = fresh(17)
    line, p = new(20), new(32)
    q = [x if i % 4 < 3 else new(1)[0] for i, x in enumerate(p)]
    data = [(1, new(40) + line + p + new(40)), (2, new(30) + line + q + new(50))]
    data += [(10 + j, new(40) + line + new(40)) for j in range(100)]
    found = substring_dedup.passages(spark.createDataFrame([(k, " ".join(w)) for k, w in data], "doc_id long, text string").repartition(3)).collect()
    assert {(r.doc_id, r.ref_doc_id) for r in found} in ({(1, 2)}, {(2, 1)})
    assert all(r.n_words >= 50 and r.n_matched >= 0.8 * r.n_words for r in found)


def test_screen_keeps_every_passage():
    rng = np.random.default_rng(3)
    n, rows = 200, []
    for k in range(400):
        x, y = rng.integers(0, 1 << 32, (2, n), dtype=np.uint32)
        a, b, size = (int(v) for v in (rng.integers(0, 60), rng.integers(0, 60), rng.integers(9, 110)))
        y[b : b + size] = np.where(rng.random(size) < rng.choice([0, 0.1, 0.2]), y[b : b + size], x[a : a + size])
        pick = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(x[a : a + size] == y[b : b + size], substring_dedup.K).all(axis=1))[:4]
        if len(pick) > 1 and np.diff(pick).max() <= substring_dedup.MAX_GAP:
            rows.append((x, y, a + pick, b + pick))
    x0, y0 = ([max(0, int(r[c][0]) - substring_dedup.MARGIN) for r in rows] for c in (2, 3))
    x1, y1 = ([min(n, int(r[c][-1]) + substring_dedup.K + substring_dedup.MARGIN) for r in rows] for c in (2, 3))
    whole = [bool(substring_dedup.aligned(x[i:j], y[k:m], list(zip((p - i).tolist(), (q - k).tolist())), 50, 0.8)) for (x, y, p, q), i, j, k, m in zip(rows, x0, x1, y0, y1)]
    lists = {"p": [r[2] for r in rows], "q": [r[3] for r in rows], "sizes": [[len(r[2])] for r in rows]}
    base = {c: pa.array(v, pa.list_(pa.int32())) for c, v in lists.items()} | {c: pa.array(v, pa.int32()) for c, v in (("x0", x0), ("x1", x1), ("y0", y0), ("y1", y1))}
    for bits in (False, True):
        cut = lambda w, a, z: np.packbits((w & np.uint32(1)).astype(np.uint8)).tobytes()[a >> 3 : (z + 7) >> 3] if bits else w[a:z].tobytes()  # noqa: B023, E731
        data = {"x": pa.array([cut(r[0], a, z) for r, a, z in zip(rows, x0, x1)], pa.binary()), "y": pa.array([cut(r[1], a, z) for r, a, z in zip(rows, y0, y1)], pa.binary())}
        b = pa.RecordBatch.from_pydict(base | data)
        keep = substring_dedup.hopeful(b, 50, 0.8, bits)
        assert not (np.array(whole) & ~keep).any() and keep.mean() < 0.9
        left = substring_dedup.only_hopeful(b, 50, 0.8, bits)
        assert left.column("p").to_pylist() == [r[2].tolist() for r, k in zip(rows, keep) if k]
    assert any(whole)


def test_plain_chains_are_those_of_a_search():
    rng = np.random.default_rng(4)
    k, h, p, q = [], [], [], []
    for pair in range(60):
        at = np.unique(rng.integers(0, 90, rng.integers(2, 7)))
        shift = np.where(rng.random(len(at)) < 0.1, 1, 0)
        k += [pair] * len(at)
        h += [-1 - pair] * len(at)
        p += at.tolist()
        q += (at + 5 + shift).tolist()
    k, h, p, q = (np.array(c, np.int64) for c in (k, h, p, q))
    edges = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]]))
    a, z = edges[:-1], edges[1:]
    a, z = a[z - a > 1], z[z - a > 1]
    plain, columns = substring_dedup.plain_chains(k, h, p, q, a, z)
    assert 0 < plain.sum() < len(a)
    for i, (key, ps, qs, size) in enumerate(zip(*(columns[c].to_pylist() for c in (0, 2, 3, 4)))):
        j = int(np.flatnonzero(plain)[i])
        assert substring_dedup.chains(p[a[j] : z[j]], q[a[j] : z[j]]) == [list(zip(ps, qs))] and size == [len(ps)] and key == k[a[j]]


def test_components_let_go_of_shuffles(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(graph, "release", calls.append)
    links = spark.createDataFrame([(k, k + 1) for k in range(20)], "a long, b long")
    assert {r.root for r in graph.components(links).collect()} == {0} and len(calls) > 1


def test_pairs_of_a_line_meet_only_where_a_passage_may_be():
    """Three hundred texts have a line and nothing else in common but for two, which go on alike: few pairs are left to look
    at, that one among them; no run that may be a passage is missed by bytes."""
    import numpy as np

    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 1 << 32, 113, dtype=np.uint32) for _ in range(300)]
    for t in texts:
        t[50:63] = np.arange(13)
    texts[7][63:103] = texts[200][63:103]
    texts[7][66:103:5] += np.uint32(1)
    w, bounds = np.concatenate(texts), 113 * np.arange(301)
    k, p, d = np.arange(300), np.full(300, 52), np.full(300, 5)
    bits = substring_dedup.sides(w, bounds[:-1], bounds[1:], k, p, d)
    found = {(a, b) for block in substring_dedup.met(np.zeros(300, np.uint64), k, p | substring_dedup.MARK, d, list(bits)) for a, b in zip(*(c.tolist() for c in block[:2]))}
    assert (200, 7) in found and len(found) < 0.1 * 300 * 299 / 2

    left, right = (rng.random((2, 400, 64)) < rng.uniform(0.5, 0.9, (2, 400, 1)))
    n = rng.integers(9, 53, 400)
    may = substring_dedup.may_reach(*(np.packbits(c, axis=1, bitorder="little").view("<u8")[:, 0] for c in (left, right)), n, 50, 0.8)
    sums = [np.concatenate([np.zeros((400, 1), int), np.cumsum(c, axis=1)], axis=1) for c in (left, right)]
    a, b = np.mgrid[:65, :65]
    long = a + b + n[:, None, None]
    plain = ((long >= 50) & (10 * (sums[0][:, :, None] + sums[1][:, None, :] + n[:, None, None]) >= 8 * long)).any(axis=(1, 2))
    assert may[plain].all() and plain.any() and not may.all()


def test_second_tiles_keep_clear_of_the_first():
    """Each pair of tiles is told apart as its words are."""
    import numpy as np

    m = substring_dedup
    place = lambda i, size, count: {(i >= count, j) for j in range(i % count * size, (i % count + 1) * size)}
    first, second = (x.ravel() for x in np.mgrid[: 2 * m.TILES, : 2 * m.SECONDS])
    want = [not place(a, m.TILE, m.TILES) & place(b, m.SECOND, m.SECONDS) for a, b in zip(first.tolist(), second.tolist())]
    assert m.apart(first, second).tolist() == want


def test_passage_in_a_crowded_tile(spark, monkeypatch):
    """As a passage around a line of many texts, with a limit at which the tiles inside that line are left for second ones."""
    monkeypatch.setattr(substring_dedup, "CROWDED", 8)
    new = fresh(18)
    line, p = new(20), new(32)
    q = [x if i % 4 < 3 else new(1)[0] for i, x in enumerate(p)]
    data = [(1, new(40) + line + p + new(40)), (2, new(30) + line + q + new(50))]
    data += [(10 + j, new(40) + line + new(40)) for j in range(100)]
    found = substring_dedup.passages(spark.createDataFrame([(k, " ".join(w)) for k, w in data], "doc_id long, text string").repartition(3)).collect()
    assert {(r.doc_id, r.ref_doc_id) for r in found} in ({(1, 2)}, {(2, 1)})


def test_screen_of_bent_chains():
    """No chain across diagonals that holds a passage goes; of texts that agree on a few words only, nearly all go."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(12)
    rows, whole, alike = [], [], []
    for i in range(400):
        x = rng.integers(0, 1 << 32, 160, dtype=np.uint32)
        y = rng.integers(0, 1 << 32, 170, dtype=np.uint32)
        more, size = int(rng.integers(1, 6)), int(rng.integers(6, 45))
        a = 80
        y[a + 10 - size : a + 10] = x[a - size : a]
        y[a + 10 + more : a + 10 + more + size] = x[a : a + size]
        y[rng.random(170) < rng.uniform(0, 0.3)] += np.uint32(1)
        chain = [(j, j + 10) for j in range(a - size, a - 3, 3) if (x[j : j + 4] == y[j + 10 : j + 14]).all()]
        chain += [(j, j + 10 + more) for j in range(a, a + size - 3, 3) if (x[j : j + 4] == y[j + 10 + more : j + 14 + more]).all()]
        if len({q - p for p, q in chain}) < 2:
            continue
        rows.append((x, y, chain))
        whole.append(bool(substring_dedup.aligned(x, y, chain, 50, 0.8)))
        alike.append(size)
    lists = [pa.array([[m[c] for m in r[2]] for r in rows], pa.list_(pa.int32())) for c in (0, 1)]
    zero = pa.array([0] * len(rows), pa.int32())
    sizes = pa.array([[len(r[2])] for r in rows], pa.list_(pa.int32()))
    b = pa.record_batch({"p": lists[0], "q": lists[1], "sizes": sizes, "x0": zero, "y0": zero} | {c: pa.array([r[i].tobytes() for r in rows], pa.binary()) for i, c in enumerate("xy")})
    keep, whole, alike = substring_dedup.hopeful(b, 50, 0.8), np.array(whole), np.array(alike)
    assert keep[whole].all() and whole.sum() > 50 and (alike < 15).sum() > 20 and not keep[alike < 15].any()


def test_blocks_give_their_columns_back_in_few_bytes():
    """Positions in texts are small: their upper bytes must not reach the disk."""
    g = np.random.default_rng(5)
    n = 20_000
    bucket, key = g.integers(0, 3, n), g.integers(-(1 << 62), 1 << 62, 40)[g.integers(0, 40, n)]
    h, p = g.integers(0, 1 << 32, n).astype("<u4"), g.integers(0, 1 << 11, n).astype("<u4")
    b = words.blocks(bucket, [key], [h, p, (p % 7).astype("u1")])
    got = {k: words.unblocked(x, 1, ["<u4", "<u4", "u1"]) for k, x in zip(b.column("bucket").to_pylist(), b.column("block").to_pylist())}
    for k, columns in got.items():
        for c, want in zip(columns, (key, h, p, p % 7)):
            assert c.tolist() == want[bucket == k].tolist()
    assert sum(len(pa.compress(x, "lz4", asbytes=True)) for x in b.column("block").to_pylist()) < 9.5 * n
    assert words.unblocked(words.blocks(bucket[:1], [key[:1]], [h[:1]]).column("block")[0].as_py(), 1, ["<u4"])[1].tolist() == h[:1].tolist()


def test_both_sides_of_alignment_read_one_shuffle_of_the_texts(spark):
    texts = spark.createDataFrame([(1, 60, b"", b"")], "key long, n long, words binary, bits binary")
    pairs = spark.createDataFrame([], "key long, holder long, p array<int>, q array<int>, sizes array<int>, x0 int, x1 int, y0 int, y1 int")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for step in (substring_dedup._aligned, substring_dedup._screened):
            assert "ReusedExchange" in step(pairs, texts, 50, 0.8)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
