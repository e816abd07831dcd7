"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.llm import _base


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def word_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnflow.llm import media_chunks

    return media_chunks.media(_base.documents(spark, sf_dir))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnflow.llm import byte_bpe

    return byte_bpe.round_trip(_base.documents(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken"), word_pattern())


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnflow.llm import token_counts

    return token_counts.token_counts(_base.documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnflow.llm import line_dedup

    kept = line_dedup.line_dedup(_base.documents(spark, sf_dir).select("doc_id", "text"), min_chars=40, min_docs=5)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that repeat across documents."""
    from tarnflow.llm import substring_dedup

    return substring_dedup.passages(_base.documents(spark, sf_dir), within=False)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnflow.llm import token_files

    return token_files.read(token_files.write(_base.documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), end_id=2))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnflow.llm import packing

    return packing.pack_documents(_base.documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnflow.llm import langid

    docs = _base.documents(spark, sf_dir)
    return langid.predict(docs, langid.train(docs))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnflow.llm import jaccard_join

    return jaccard_join.join(_base.documents(spark, sf_dir), k=4, percent=85)


def jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of ``op9_jaccard_join`` with the number of links of each document."""
    from tarnflow.llm import jaccard_join

    return jaccard_join.join(_base.documents(spark, sf_dir), k=4, percent=85, count_links=True)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnflow.llm import repetition

    return repetition.quality(_base.documents(spark, sf_dir))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnflow.llm import alignment

    return alignment.align(_base.documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnflow.llm import conversation_repair

    return conversation_repair.repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnflow.llm import embedding_dedup

    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.93)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return import_module("corpus_pipeline").run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_media_chunks, op2_byte_bpe, op3_line_dedup, op4_substring_dedup, op5_token_files, op6_token_counts, op7_packing, op8_language_id, op9_jaccard_join, op10_quality_rules, op11_token_alignment, op12_conversation_repair, op13_embedding_dedup, jaccard_components, pipeline)
    return {f.__name__: f for f in own}


#: Lines as in the contract of op3: blanks stripped, A-Z lowered.
LINE_DEDUP_SQL = r"""
WITH lines AS (
    SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), shared AS (
    SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
    SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.holder AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


#: Classes as in the contract of op9, from all pairs that share a shingle.
JACCARD_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words
), shingles AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
    SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reached(x, y) AS (
    SELECT doc_id, doc_id FROM sets UNION SELECT r.x, l.y FROM reached r JOIN links l ON l.x = r.y
)
SELECT s.doc_id, CAST(len(any_value(s.s)) AS BIGINT) AS n_shingles, min(r.y) AS component_id FROM sets s JOIN reached r ON r.x = s.doc_id GROUP BY s.doc_id
"""

#: The same with all links counted.
LINKS_SQL = JACCARD_SQL.rstrip().replace("AS component_id FROM", "AS component_id, (SELECT count(*) FROM links l WHERE l.x = s.doc_id) AS n_links FROM") + "\n"


#: Damage, faults and the cheapest edits of op12, one turn after the other over four states.
REPAIR_SQL = r"""
WITH RECURSIVE bits(n, k, c) AS (
    SELECT range, 0, CAST(range AS BIGINT) FROM range(256) UNION ALL
    SELECT n, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), crc AS (
    SELECT list(c ORDER BY n) AS tab FROM bits WHERE k = 8
), hit AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
            lambda a, b: xor(a >> 8, tab[xor(a, b) % 256 + 1])), 4294967295) % 20 AS h
    FROM conversations, crc
), after AS (
    SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM (SELECT *, unnest(range(CASE h WHEN 3 THEN 2 ELSE 1 END)) FROM hit WHERE h <> 0)
), ordered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
        rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM after)
), faults AS (
    SELECT conv_id, turn, role, text, i, left(role, 1) AS ini, CASE WHEN body = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
        lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal FROM ordered
), inserted(s, m, cost, audit, more) AS (
    VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 2, 'I', chr(10) || 'user:'), (1, 2, 2, 'I', chr(10) || 'user:'), (3, 2, 2, 'I', chr(10) || 'user:'),
        (2, 3, 2, 'I', chr(10) || 'assistant:'), (0, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')
), edits(op, m, t, ini, cost, name) AS (
    VALUES ('D', 0, 0, NULL, 3, NULL), ('D', 1, 1, NULL, 3, NULL), ('D', 2, 2, NULL, 3, NULL), ('D', 3, 3, NULL, 3, NULL), ('R', 0, 2, NULL, 2, 'user'), ('R', 1, 2, NULL, 2, 'user'), ('R', 3, 2, NULL, 2, 'user'), ('R', 2, 3, NULL, 2, 'assistant'),
        ('K', 0, 1, 's', 0, NULL), ('K', 0, 2, 'u', 0, NULL), ('K', 1, 2, 'u', 0, NULL), ('K', 3, 2, 'u', 0, NULL), ('K', 2, 3, 'a', 0, NULL)
), steps(conv_id, i, s, cost, audit, out) AS (
    SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, 0, '', '' FROM faults UNION ALL
    SELECT conv_id, i, t, b.cost, b.audit, b.out FROM (
        SELECT p.conv_id, f.i, e.t, min(struct_pack(cost := p.cost + n.cost + e.cost + CASE WHEN op <> 'D' AND fault = 'truncated' THEN 1 ELSE 0 END, audit := p.audit || n.audit || op,
            out := p.out || CASE WHEN op = 'D' THEN n.more ELSE n.more || chr(10) || coalesce(name, f.role) || ':' || f.text END)) AS b
        FROM steps p JOIN faults f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1 JOIN inserted n ON n.s = p.s JOIN edits e ON e.m = n.m
        WHERE op = 'D' OR fault NOT IN ('blank', 'duplicate') AND (op = 'R' OR e.ini = f.ini) GROUP BY ALL)
), closed AS (
    SELECT conv_id, min(struct_pack(cost := p.cost + c.cost, audit := p.audit || c.audit, out := p.out || c.more)) AS b
    FROM steps p JOIN (VALUES (0, 0, '', ''), (1, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 2, 'I', chr(10) || 'assistant:'), (3, 0, '', '')) AS c(s, cost, audit, more) ON c.s = p.s
    WHERE p.i = (SELECT max(f.i) FROM faults f WHERE f.conv_id IS NOT DISTINCT FROM p.conv_id) GROUP BY conv_id
), counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal FROM faults GROUP BY conv_id
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    CAST(coalesce(b.cost, 0) AS BIGINT) AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(b.out[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN closed d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
"""

#: Classes as in the contract of op13, from all pairs of a label.
EMBEDDING_SQL = """
WITH RECURSIVE usable AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93
), reached(x, y) AS (
    SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM reached r JOIN links l ON l.x = r.y
)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.x = v.vec_id) AS n_links, min(r.y) AS component_id, min(r.y) = v.vec_id AS kept FROM embeddings v JOIN reached r ON r.x = v.vec_id GROUP BY v.vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": LINE_DEDUP_SQL, "op9_jaccard_join": JACCARD_SQL, "op12_conversation_repair": REPAIR_SQL, "op13_embedding_dedup": EMBEDDING_SQL, "jaccard_components": LINKS_SQL}
