"""Registered queries of the training-data operators, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (alignment, ctw, decontam, jaccard, language, merkle, mixing, packing, pii, quality, repair, substrings,
               tokens)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": substrings.query,
    "op2_language_id": language.query,
    "op3_packing": packing.query,
    "op4_pii": pii.query,
    "op5_jaccard_join": jaccard.query,
    "op6_decontamination": decontam.query,
    "op7_merkle_fingerprints": merkle.query,
    "op8_context_tree_lm": ctw.query,
    "op9_token_counts": tokens.query,
    "op10_quality": quality.query,
    "op11_tokenizer_alignment": alignment.query,
    "op12_source_mixing": mixing.query,
    "op13_conversation_repair": repair.query,
}

#: The words that the contracts fix, null and empty texts as no words.
_WORDS = r"[x FOR x IN regexp_split_to_array({0}, '[\x20\x09-\x0D]+') IF x <> '']"

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op12_source_mixing": mixing.ORACLE,
    "op1_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS g FROM p),
r AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
s AS (SELECT doc_id, i FROM g SEMI JOIN r USING (g)),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM s),
e AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT doc_id, count(c.i) AS gone, string_agg(x, ' ' ORDER BY e.i) FILTER (c.i IS NULL) AS kept
      FROM e LEFT JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""",
    "op5_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_FOLDED)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b USING (g) JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
      WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)""",
}
