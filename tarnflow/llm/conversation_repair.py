"""Conversation structure repair: the cheapest edits that make roles alternate, by dynamic programming over a grammar.

Each turn is a symbol: its role and whether it is whole, truncated or has to go.  Repaired roles read ``(s?(ua)+)?``, which
an automaton of four states accepts (nothing yet; after the system; after the user; after the assistant).  What a
symbol may cost between any two states, insertions before it included, is a matrix over (min, +); the matrix of a
sequence is the product of those of its symbols.  Each entry keeps its audit, the initials of its edits, as a rope of
those that it was made from.  Of equal costs the least audit wins: audits of one sequence hold as many edits of given
turns, and the last of these closes them, so none begins another, and the smaller stays smaller whatever follows.

Grammar.  Sequences of all conversations are written as symbols of a Re-Pair grammar: rounds count neighbouring pairs of
symbols over all different sequences, and the most frequent ones become rules, up to ``RULES`` of them.  Matrices of
rules are computed once, bottom up, and shared by all conversations; a sequence takes one product for each of its symbols.

Long conversations.  Rows are sorted by range of conversation and turn, so tasks share a long one; pieces of at most
``PIECE`` turns are evaluated apart.  A conversation's pieces are then chained: costs from the end, audits from the front.
The digest of a repaired conversation takes all its bytes in order, so one task streams them; it holds the audit and one
batch of rows at a time.

Defined results.  Null roles and texts are one space, as are nulls in the text that decides on damage.  Rows of one turn
are in order of role, the first 32 characters of the text and the text's digest; repeated rows are separate rows, all
but the first duplicates.  A null ``conv_id`` is a conversation.  A role counts by its first character.  A conversation
without rows gives zeros, an empty audit and the digest of nothing; an empty table no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.llm import _base

BLANKS = " \t\n\x0b\x0c\r"
RULES, ROUNDS = 192, 6  #: of the grammar, and in how many rounds they are found
PIECE_BITS = 12  #: a piece has up to 2 ** 12 turns
STATES = range(4)
#: Edits that write a user or an assistant turn: which states they leave, and where they lead.
WRITTEN = {0: 2, 1: 2, 2: 3, 3: 2}
#: What closes a conversation in each state.
CLOSING = ((0, ""), (4, "II"), (2, "I"), (0, ""))

Rope = str | tuple
Matrix = tuple  #: rows of entries ``(cost, rope)``, or None


def spelled(rope: Rope) -> str:
    out, todo = [], [rope]
    while todo:
        r = todo.pop()
        if isinstance(r, str):
            out.append(r)
        else:
            todo += (r[1], r[0])
    return "".join(out)


def cheaper(x: tuple | None, y: tuple | None) -> tuple | None:
    if x is None or y is None:
        return x or y
    if x[0] != y[0]:
        return x if x[0] < y[0] else y
    return x if spelled(x[1]) <= spelled(y[1]) else y


def product(x: Matrix, y: Matrix) -> Matrix:
    def entry(i: int, j: int) -> tuple | None:
        through = [(x[i][k][0] + y[k][j][0], (x[i][k][1], y[k][j][1])) for k in STATES if x[i][k] and y[k][j]]
        low = min((t[0] for t in through), default=None)
        best = None
        for t in through:
            if t[0] == low:
                best = cheaper(best, t)
        return best

    return tuple(tuple(entry(i, j) for j in STATES) for i in STATES)


def _inserted() -> Matrix:
    """The cheapest insertions between two states."""
    out = [[None] * 4 for _ in STATES]
    for i in STATES:
        at, n = i, 0
        out[i][i] = (0, "")
        while n < 3:
            at, n = WRITTEN[at], n + 1
            out[i][at] = out[i][at] or (2 * n, "I" * n)
    return tuple(map(tuple, out))


def symbol_matrix(symbol: str) -> Matrix:
    """Of one turn: its role's initial (``o``: any other), upper case if truncated; ``x`` if it has to go."""
    own = [[None] * 4 for _ in STATES]
    for i in STATES:
        own[i][i] = (3, "D")
        if symbol != "x":
            more = int(symbol.isupper())
            own[i][WRITTEN[i]] = (2 + more, "R")
            to = {"s": 1 if i == 0 else None, "u": 2 if i != 2 else None, "a": 3 if i == 2 else None}.get(symbol.lower())
            if to is not None:
                own[i][to] = cheaper(own[i][to], (more, "K"))
    return product(_inserted(), tuple(map(tuple, own)))


class Grammar:
    """Rules in order, each a pair of symbols that became a new one, with the matrices of all symbols."""

    def __init__(self) -> None:
        self.rules: list[tuple[str, str]] = []
        self.matrices = {c: symbol_matrix(c) for c in "suaoSUAOx"}
        self.known: dict[str, Matrix] = {}

    def add(self, pair: str) -> None:
        name = chr(0x100 + len(self.rules))
        self.rules.append((pair, name))
        self.matrices[name] = product(*(self.matrices[c] for c in pair))

    def written(self, sequence: str) -> str:
        for pair, name in self.rules:
            sequence = sequence.replace(pair, name)
        return sequence

    def matrix(self, sequence: str) -> Matrix:
        """Of a whole sequence; sequences that a worker meets again are remembered."""
        found = self.known.get(sequence)
        if found is None:
            if len(self.known) > 20_000:
                self.known.clear()
            symbols = self.written(sequence)
            found = self.matrices[symbols[0]]
            for c in symbols[1:]:
                found = product(found, self.matrices[c])
            self.known[sequence] = found = tuple(tuple(e and (e[0], spelled(e[1])) for e in row) for row in found)
        return found


def _pairs(sequences: DataFrame, grammar: Grammar, most: int) -> list[str]:
    """The most frequent pairs of neighbours in the sequences as the grammar writes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: Counter[str] = Counter()
            for s in b.column("syms").to_pylist():
                s = grammar.written(s)
                n.update(map(str.__add__, s, s[1:]))
            yield _base.record_batch(["pair", "n"], [pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())])

    counts = sequences.mapInArrow(run, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return [r.pair for r in counts.where("n > 1").orderBy(F.desc("n"), "pair").limit(most).collect()]


def re_pair(sequences: DataFrame) -> Grammar:
    """A grammar of ``sequences (syms)``; a round takes the most frequent pairs that share no symbol, most frequent first."""
    grammar = Grammar()
    for k in range(ROUNDS):
        used: set[str] = set()
        for pair in _pairs(sequences, grammar, (RULES - len(grammar.rules)) // (ROUNDS - k)):
            if not used & set(pair):
                grammar.add(pair)
                used |= set(pair)
        if not used:
            break
    return grammar


def _hit(conv_id: Column, turn: Column) -> Column:
    text = F.concat(F.coalesce(conv_id.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    return F.crc32(text.cast("binary")) % 20


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after damage, for tests of the repair: some dropped, emptied, cut short, repeated or given to the user."""
    hit = F.col("hit")
    rows = rows.withColumn("hit", _hit(F.col("conv_id"), F.col("turn"))).where("hit <> 0")
    text = F.when(hit == 1, "").when(hit == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(hit == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.sequence(F.lit(1), F.when(hit == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("time")).drop("time")


ORDER = ["turn", "role", "head", "digest"]  #: of the rows of a conversation


def _keyed(rows: DataFrame) -> DataFrame:
    """The rows with what orders them."""
    return rows.withColumn("head", F.substring("text", 1, 32)).withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))


def _turns(rows: DataFrame) -> DataFrame:
    """``(conv_id, pos, ini, fault, role, digest)`` of all rows, ``pos`` in order; without texts."""
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(end == "", "blank").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "truncated")
    ini = F.substring("role", 1, 1)
    small = _keyed(rows).select("conv_id", *ORDER, F.when(ini.isin("s", "u", "a"), ini).otherwise("o").alias("ini"), fault.alias("fault"))
    small = small.withColumn("row", F.monotonically_increasing_id())
    ordered = small.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv_id", *ORDER, "row").sortWithinPartitions("conv_id", *ORDER, "row")
    return _base.materialize(ordered.select("conv_id", "role", "digest", "ini", "fault", F.monotonically_increasing_id().alias("pos")), "turns")


def _pieces(turns: DataFrame) -> DataFrame:
    """``(conv_id, seg, syms, inis, blank, duplicate, truncated)``: up to ``2 ** PIECE_BITS`` rows of a conversation each."""
    firsts = turns.groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    fault = F.when(F.col("fault") == "blank", "blank").when(F.col("first").isNull(), "duplicate").otherwise(F.col("fault"))
    marked = turns.drop("role", "digest").join(firsts, "pos", "left").withColumn("fault", fault)
    sym = F.when(F.col("fault") == "truncated", F.upper("ini")).when(F.col("fault").isNotNull(), "x").otherwise(F.col("ini"))
    marked = marked.select("conv_id", "pos", F.shiftright("pos", PIECE_BITS).alias("seg"), "fault", F.struct("pos", sym.alias("sym"), "ini").alias("t"))
    faults = [F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
    pieces = marked.groupBy("conv_id", "seg").agg(F.sort_array(F.collect_list("t")).alias("t"), *faults)
    return _base.materialize(pieces.select("conv_id", "seg", F.concat_ws("", "t.sym").alias("syms"), F.concat_ws("", "t.ini").alias("inis"), "blank", "duplicate", "truncated"), "pieces")


LEGAL = {"su", "ua", "au"}


def _evaluated(pieces: DataFrame, grammar: Grammar) -> DataFrame:
    """Each piece with the entries of its matrix; -1 where there is none."""
    shared = pieces.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            costs, audits, illegal = [], [], []
            for s, i in zip(b.column("syms").to_pylist(), b.column("inis").to_pylist()):
                entries = [e for row in shared.value.matrix(s) for e in row]
                costs.append([e[0] if e else -1 for e in entries])
                audits.append([e[1] if e else "" for e in entries])
                illegal.append(sum(x + y not in LEGAL for x, y in zip(i, i[1:])))
            inis = b.column("inis").to_pylist()
            ends = [i[0] + i[-1] for i in inis]
            yield _base.record_batch(
                ["conv_id", "seg", "costs", "audits", "illegal", "ends", "blank", "duplicate", "truncated"],
                [b.column("conv_id"), b.column("seg"), pa.array(costs, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string())), pa.array(illegal, pa.int64()), pa.array(ends), *(b.column(c) for c in ("blank", "duplicate", "truncated"))],
            )

    kind = dict(pieces.dtypes)["conv_id"]
    return pieces.mapInArrow(run, f"conv_id {kind}, seg long, costs array<long>, audits array<string>, illegal long, ends string, blank long, duplicate long, truncated long")


def chained(pieces: list[tuple[list[int], list[str]]]) -> tuple[int, str]:
    """The cheapest cost of a conversation and its least audit, from the matrices of its pieces in order."""
    ahead = [[c for c, _ in CLOSING]]
    for costs, _ in reversed(pieces):
        ahead.append([min((costs[4 * i + j] + ahead[-1][j] for j in STATES if costs[4 * i + j] >= 0), default=1 << 60) for i in STATES])
    ahead.reverse()
    at, out = 0, []
    for k, (costs, audits) in enumerate(pieces):
        text, at = min((audits[4 * at + j], j) for j in STATES if costs[4 * at + j] >= 0 and costs[4 * at + j] + ahead[k + 1][j] == ahead[k][at])
        out.append(text)
    return ahead[0][0], "".join(out) + CLOSING[at][1]


class Repaired:
    """The digest of a repaired conversation, fed row by row."""

    def __init__(self, audit: str):
        self.edits, self.state, self.digest, self.empty = iter(audit), 0, hashlib.sha256(), True

    def write(self, role: str, text: str) -> None:
        self.digest.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        self.empty = False

    def new_role(self) -> str:
        self.state = WRITTEN[self.state]
        return "user" if self.state == 2 else "assistant"

    def row(self, role: str, text: str) -> None:
        while (edit := next(self.edits)) == "I":
            self.write(self.new_role(), "")
        if edit == "K":
            self.state = {"s": 1, "u": 2, "a": 3}[role[0]]
            self.write(role, text)
        elif edit == "R":
            self.write(self.new_role(), text)

    def end(self) -> str:
        for _ in self.edits:
            self.write(self.new_role(), "")
        return self.digest.hexdigest()


OUT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _finished(stream: DataFrame, kind: str) -> DataFrame:
    """The results from each conversation's span, pieces and rows, which come in this order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts, pieces, last, text = None, None, [], "", None

        def done() -> tuple:
            r = text or Repaired(opened())
            return (now[0], *(counts[c] for c in OUT), counts["audit"], r.end())

        def opened() -> str:
            counts["cost"], counts["audit"] = chained(pieces) if pieces else (0, "")
            return counts["audit"]

        for b in batches:
            out = []
            side, ids = b.column("side").to_pylist(), b.column("conv_id").to_pylist()
            roles, texts, rows = b.column("role").to_pylist(), b.column("text"), b.column("piece")
            for i, (s, c) in enumerate(zip(side, ids)):
                if s == 0:
                    if now is not None:
                        out.append(done())
                    now, counts, pieces, last, text = (c,), dict.fromkeys(OUT, 0), [], "", None
                    counts["gaps"] = b.column("gaps")[i].as_py()
                elif s == 1:
                    p = rows[i].as_py()
                    pieces.append((p["costs"], p["audits"]))
                    counts["illegal"] += p["illegal"] + (bool(last) and last + p["ends"][0] not in LEGAL)
                    last = p["ends"][1]
                    for f in ("blank", "duplicate", "truncated"):
                        counts[f] += p[f]
                else:
                    if text is None:
                        text = Repaired(opened())
                        pieces = []
                    text.row(roles[i], texts[i].as_py())
            if out:
                yield rendered(out)
        if now is not None:
            yield rendered([done()])

    def rendered(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out))
        ids = pa.array(columns[0], pa.string() if kind == "string" else None if any(x is not None for x in columns[0]) else pa.int64())
        return _base.record_batch(["conv_id", *OUT, "audit", "repaired_sha256"], [ids, *(pa.array(c, pa.int64()) for c in columns[1:-2]), pa.array(columns[-2]), pa.array(columns[-1])])

    return stream.mapInArrow(run, f"conv_id {kind}, {', '.join(f'{c} long' for c in OUT)}, audit string, repaired_sha256 string")


def repair(conversations: DataFrame, damage: bool = True) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` of every conversation."""
    spark = conversations.sparkSession
    _base.batches_of(spark, 2000)
    began = _base.mark()
    kind = "string" if dict(conversations.dtypes)["conv_id"] == "string" else "long"
    space = F.lit(" ")
    rows = conversations.select(F.col("conv_id").cast(kind).alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), space).alias(c) for c in ("role", "text")))
    stays = _hit(F.col("conv_id"), F.col("turn")) != 0 if damage else F.lit(True)
    spans = rows.select("conv_id", F.when(stays, F.col("turn")).alias("turn")).groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id")
    spans = spans.agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    rows = damaged(rows) if damage else rows
    pieces = _pieces(_turns(rows))
    grammar = re_pair(_base.materialize(pieces.select("syms").distinct(), "sequences"))
    found = _base.materialize(_evaluated(pieces, grammar), "matrices")
    _base.discard(began, found)
    parts = ("costs", "audits", "illegal", "ends", "blank", "duplicate", "truncated")
    shape = "struct<costs:array<bigint>,audits:array<string>,illegal:bigint,ends:string,blank:bigint,duplicate:bigint,truncated:bigint>"
    none = {"gaps": "long", "seg": "long", "piece": shape, "turn": "long", "role": "string", "head": "string", "digest": "binary", "text": "string"}

    def side(df: DataFrame, k: int) -> DataFrame:
        return df.select("conv_id", F.lit(k).alias("side"), *((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in none.items()))

    stream = side(spans, 0).union(side(found.select("conv_id", "seg", F.struct(*parts).alias("piece")), 1)).union(side(_keyed(rows), 2))
    stream = stream.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id").sortWithinPartitions("conv_id", "side", "seg", *ORDER)
    return _finished(stream.select("conv_id", "side", "gaps", "piece", "role", "text"), kind)
