import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from common import empty, table

from tarnflow.llm import alignment, conversation_repair, embedding_dedup

tokenizers = pytest.importorskip("public_tokenizers")
FIRST, SECOND = tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model")


def letters():
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in keep)}


def ends(parts):
    out, n = [], 0
    for p in parts:
        n += len(p)
        out.append(n)
    return out


def alignment_by_definition(texts):
    """Whole texts through both libraries, groups from the set of common ends, counts over all documents."""
    import sentencepiece
    from tokenizers import Tokenizer

    first, second, byte = Tokenizer.from_file(FIRST), sentencepiece.SentencePieceProcessor(model_file=SECOND), letters()
    first.encode_special_tokens = True
    docs = []
    for t in texts:
        docs.append(None)
        if not t:
            continue
        a, b = first.encode(" " + t, add_special_tokens=False).ids, second.encode(t)
        x = [bytes(byte[c] for c in first.id_to_token(k)) for k in a]
        y = [bytes([int(second.id_to_piece(k)[3:-1], 16)]) if second.is_byte(k) else second.id_to_piece(k).replace("\u2581", " ").encode() for k in b]
        if not (b"".join(x) == b"".join(y) == (" " + t).encode()):
            continue
        a_ends, b_ends, groups, i, j = ends(x), ends(y), [], 0, 0
        for c in sorted(set(a_ends) & set(b_ends)):
            p, q = a_ends.index(c, i) + 1, b_ends.index(c, j) + 1
            groups.append((a[i:p], b[j:q]))
            i, j = p, q
        docs[-1] = (a, b, groups)
    n = Counter()
    for d in docs:
        n.update({(x, y) for g, h in d[2] for x in g for y in h} if d else ())
    best = {}
    for (x, _), k in n.items():
        best[x] = max(best.get(x, 0), k)
    out = []
    for d in docs:
        links = [(x, y) for g, h in d[2] for x in g for y in h] if d else []
        text = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in d[2]) if d else ""
        out.append((*(map(len, d) if d else (0, 0, 0)), len(links), sum(n[k] == best[k[0]] for k in links), sum(n[k] for k in links), hashlib.sha256(text.encode()).hexdigest() if d else ""))
    return out


def same_alignment(df, **options):
    key = lambda r: tuple((x is not None, x) for x in r)
    rows = df.select("doc_id", "text").collect()
    want = sorted(((r.doc_id, *w) for r, w in zip(rows, alignment_by_definition([r.text for r in rows]))), key=key)
    assert sorted((tuple(r) for r in alignment.align(df, FIRST, SECOND, **options).collect()), key=key) == want
    return want


def test_alignment(spark):
    want = same_alignment(table(spark, True))
    assert sum(w[3] for w in want) > 1000 and any(w[4] > w[3] for w in want)
    assert alignment.align(empty(spark), FIRST, SECOND).count() == 0


@pytest.mark.parametrize("top", [alignment.TOP, 40])
def test_alignment_of_odd_texts(spark, top):
    """Texts of marks, runs of white space, special strings and characters that one side spells as bytes; few or all
    counts sent to the tasks."""
    rng = random.Random(5)
    parts = ["a", "b", "the", " ", "  ", "\n", "\t", "\xa0", "\u3000", "é", "日", "\u2581", "<s>", "<|endoftext|>", "'s", "1", "23", ".", "!!", "\r\n", "x\ny", " \n", "ﬁ", "\u200b", "😀", "\x00"]
    odd = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))) for k in range(1500)]
    odd += [(9000, "z" * 40_000), (9001, "ab cd " * 9000), (9002, "日本" * 5000 + " " + "q" * 150), (3, odd[3][1]), (3, odd[3][1])]
    want = same_alignment(spark.createDataFrame(odd, "doc_id long, text string").repartition(3), top=top)
    assert any(w[1] == 0 for w in want) and sum(w[1] > 0 for w in want) > 500


NOT_BLANK = re.compile(r"[^\x20\x09-\x0D]")
NEXT, NAME = {"": "u", "s": "u", "u": "a", "a": "u"}, {"u": "user", "a": "assistant"}


def repaired_by_definition(rows, damage=True):
    """Row by row over whole audits and texts."""
    own = lambda v: " " if v is None else v
    conversations, out = {}, {}
    for c, t, r, x in rows:
        turns = conversations.setdefault(c, [])
        r, x, hit = own(r), own(x), zlib.crc32(f"{own(c)}:{own(t)}".encode()) % 20 if damage else 9
        x = "" if hit == 1 else re.sub("[.!?]", "", x) if hit == 2 else x
        turns += [(t, "user" if hit == 4 else r, x)] * {0: 0, 3: 2}.get(hit, 1)
    for c, v in conversations.items():
        v.sort(key=lambda q: (q[0] is not None, q[0] or 0, q[1], q[2]))
        turns, seen, faults = {q[0] for q in v} - {None}, set(), []
        for _, r, x in v:
            ink = NOT_BLANK.findall(x)
            faults.append("blank" if not ink else "duplicate" if (r, x) in seen else "truncated" if ink[-1] not in ".!?" else "")
            seen.add((r, x))
        best = {"": (0, "", [])}

        def put(table, state, found):
            if state not in table or found[:2] < table[state][:2]:
                table[state] = found

        def with_insertions(table):
            for _ in range(3):
                for s, (k, a, o) in list(table.items()):
                    put(table, NEXT[s], (k + 2, a + "I", [*o, NAME[NEXT[s]] + ":"]))
            return table

        for (_, r, x), fault in zip(v, faults):
            after, more = {}, fault == "truncated"
            for s, (k, a, o) in with_insertions(best).items():
                put(after, s, (k + 3, a + "D", o))
                if fault not in ("blank", "duplicate"):
                    put(after, NEXT[s], (k + 2 + more, a + "R", [*o, f"{NAME[NEXT[s]]}:{x}"]))
                    if (r[:1], s) in {("s", ""), ("u", ""), ("u", "s"), ("u", "a"), ("a", "u")}:
                        put(after, r[:1], (k + more, a + "K", [*o, f"{r}:{x}"]))
            best = after
        cost, audit, text = min(v for s, v in with_insertions(best).items() if s in ("", "a"))
        inis = [q[1][:1] for q in v]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(inis, inis[1:]))
        out[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *map(faults.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest())
    return out


def conversations():
    """Ties, nulls in every column, repeated rows, other roles, and one conversation of several pieces."""
    rng = random.Random(3)
    rows = [
        (c, rng.choice([None, k, k, k, k]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(["Hi.", "ok", "", "  \n", "Yes!", "no. ", None, "é?"]))
        for c in [None, *range(40)]
        for k in range(rng.randint(1, 12))
    ]
    rows += [(777, k, rng.choice(["user", "assistant", "system"]), rng.choice([f"t{k}.", f"t{k}", " ", "again."])) for k in range(5000)]
    return rows + [(778, 5, "user", "the same.")] * 300 + [(779, 1, "user", "x" * 300_000)]


@pytest.mark.parametrize("damage", [True, False])
def test_repair(spark, damage, monkeypatch):
    monkeypatch.setattr(conversation_repair, "PIECE_BITS", 7)
    rows = conversations()
    df = spark.createDataFrame([(*r, "i", 1, "s", None, "t", 1) for r in rows], "conv_id long, turn long, role string, text string, ini string, pos int, syms string, digest string, fault string, row int")
    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.repair(df.repartition(5), damage).collect()}
    assert got == repaired_by_definition(rows, damage)
    assert got[778][2] > 200 and len(got[777][6]) > 3000


def test_repair_of_nothing(spark):
    rows = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_repair.repair(rows).count() == 0
    dropped = next(k for k in range(100) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(dropped, 0, "user", "Hello.")], rows.schema)
    assert [tuple(r) for r in conversation_repair.repair(one).collect()] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_grammar_gives_what_symbols_give():
    rng = random.Random(1)
    grammar, plain = conversation_repair.Grammar(), conversation_repair.Grammar()
    for pair in ("ua", "\u0100\u0100", "x\u0101", "Us"):
        grammar.add(pair)
    for _ in range(200):
        s = "".join(rng.choice("suaoSUAOxuaua") for _ in range(rng.randint(1, 30)))
        assert grammar.matrix(s) == plain.matrix(s)


def classes_of_vectors(rows, cosine):
    out, first = [], {i: r[0] for i, r in enumerate(rows)}
    ok = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for i in ok:
        x = np.array(rows[i][1], float)
        for j in ok:
            y = np.array(rows[j][1], float)
            if i != j and rows[i][2] == rows[j][2] and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= cosine:
                links[i].add(j)
    for i, r in enumerate(rows):
        reached, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - reached
            reached |= new
            todo += new
        first[i] = min((rows[j][0] for j in reached if rows[j][0] is not None), default=None)
        out.append((r[0], len(links[i]), first[i], r[0] == first[i]))
    return Counter(out)


def vectors():
    """Tight groups, chains near the limit, copies, scaled copies, other lengths, and everything that links with nothing."""
    rng, rows = np.random.default_rng(2), []
    for g in range(12):
        centre = rng.normal(size=12)
        for _ in range(12):
            rows.append((len(rows), (centre + rng.normal(size=12) * [0.02, 0.3, 0.45][g % 3]).tolist(), g % 3))
    rows += [(len(rows) + k, rng.normal(size=12).tolist(), k % 3) for k in range(60)]
    same = rng.normal(size=12).tolist()
    rows += [(1000 + k, same, 1) for k in range(90)] + [(1100, [3 * x for x in same], 1), (1101, same, 2), (1102, same, None)]
    rows += [(1200, None, 0), (1201, [0.0] * 12, 0), (1202, [], 0), (1203, [None, *same[1:]], 1), (1204, [float("nan"), *same[1:]], 1), (1205, [float("inf"), *same[1:]], 1), (None, same, 1), (1000, same, 1)]
    return rows + [(1300 + k, [1.0, 0.01 * k, 0.5], 0) for k in range(5)]


@pytest.mark.parametrize("block", [embedding_dedup.BLOCK, 16])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "CELL", 10)
    rows = vectors()
    df = spark.createDataFrame([(*r, "h", 1, 2, 3.0, [1]) for r in rows], "vec_id long, embedding array<double>, label int, sid string, list int, dim int, copies double, v array<int>")
    got = embedding_dedup.near_duplicates(df.repartition(3))
    assert Counter(map(tuple, got.collect())) == classes_of_vectors(rows, 0.93)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_no_link_is_lost_at_list_borders():
    """Of each linked pair one visits the other's list, and no decoded distance rules the pair out."""
    rng = np.random.default_rng(4)
    x = embedding_dedup.unit(rng.normal(size=(1500, 16)))
    y = embedding_dedup.unit(x + rng.normal(size=x.shape) * 0.075)
    r, near = np.sqrt(2 - 2 * 0.93), (x * y).sum(1) >= 0.93
    book = embedding_dedup.Codebook(x[::3], 40)
    a, b = book.home(x), book.home(y)
    at = np.arange(len(x))
    assert near.sum() > 300 and (a != b)[near].sum() > 100
    assert (book.visits(x, a, r / 2)[at, b] | book.visits(y, b, r / 2)[at, a])[near].all()
    codes, error = book.encode(y, b)
    d = book.distances(book.tables(x), codes, b)[at, at]
    assert (d <= r + error + embedding_dedup.SLACK)[near].all() and (d > r + error).mean() < 0.9
