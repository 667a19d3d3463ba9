"""Driver queries of this subpackage and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folio.llm import leakage, mixing, neardup, pairs, residue, sentences, sharedspans, splitting, tokens

#: The modules are imported here, so that what keeps one from being imported keeps the whole subpackage out.
_WHERE = {
    leakage: ["p7_found"],
    neardup: ["p1_found", "p1_groups"],
    mixing: ["p8_mix", "p8_shares"],
    pairs: ["p5_found"],
    residue: ["p9_found", "p9_messages"],
    sentences: ["p3_found"],
    sharedspans: ["p4_found", "p4_report", "p4_passages", "p4_copies"],
    tokens: ["p2_documents", "p2_budget", "p2_against_log"],
    splitting: ["p6_found", "p6_pieces"],
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(module, name) for module, names in _WHERE.items() for name in names}


_P1 = r"""
WITH g AS (
  SELECT 'gist' AS record_kind, '' AS grp, gist_id AS id,
         list_distinct(regexp_extract_all(lower(max(text)), '[\p{L}\p{N}_]+')) AS s
  FROM teacher_gists_anticollapse_wiki20_pilot GROUP BY gist_id
), m AS (
  SELECT 'slot' AS record_kind, doc_key AS grp, slot_id AS id,
         list_transform(list_distinct(list_filter(any_value(origin_indices), lambda x: x IS NOT NULL)), lambda x: CAST(x AS VARCHAR)) AS s
  FROM memory_slot WHERE doc_key IS NOT NULL GROUP BY slot_id, doc_key
), r AS (SELECT * FROM g WHERE len(s) > 0 UNION ALL SELECT * FROM m WHERE len(s) > 0)
SELECT a.record_kind, a.id AS id_a, b.id AS id_b
FROM r a JOIN r b ON a.record_kind = b.record_kind AND a.grp = b.grp AND a.id < b.id
WHERE 10 * len(a.s) >= 7 * len(b.s) AND 10 * len(b.s) >= 7 * len(a.s)
  AND 17 * len(list_intersect(a.s, b.s)) >= 7 * (len(a.s) + len(b.s))
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": _P1}
