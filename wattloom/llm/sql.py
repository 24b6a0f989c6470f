"""SQL that queries of this subpackage are checked against, over whole tables."""

from __future__ import annotations

from wattloom.plans.problems_sql import STARTS

DIGESTS = r"""h AS (SELECT id, regexp_replace(regexp_replace(lower(trim(file_hash)), '^[a-z0-9_-]+:\s*', ''), '\s', '', 'g') AS digest FROM ingestion_history WHERE lower(trim(status)) IN ('success', 'warning')),
 f AS (SELECT min(id) OVER (PARTITION BY digest) AS key_a, id AS key_b FROM h WHERE digest <> '')"""

#: Pairs within the radius; rides with no earlier neighbour are heads, and the nearest of them counts.
P2_FOUND = f"""WITH {STARTS}, {DIGESTS},
 n AS (SELECT a.row_id AS a, b.row_id AS b, greatest(abs(a.start_s - b.start_s) / 300.0, coalesce(abs(a.d - b.d) / 0.012, 0), coalesce(abs(a.m - b.m) / 0.015, 0)) AS far
  FROM r a JOIN r b ON a.athlete_id = b.athlete_id AND a.row_id < b.row_id AND b.start_s BETWEEN a.start_s - 300 AND a.start_s + 300),
 w AS (SELECT * FROM n WHERE far <= 1), p AS (SELECT * FROM w WHERE a NOT IN (SELECT b FROM w)),
 q AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY far, a) AS k FROM p)
 SELECT 'file' AS dup_level, key_a, key_b FROM f WHERE key_a <> key_b UNION ALL SELECT 'activity', a, b FROM q WHERE k = 1"""

#: Words without case, accents, tags and punctuation, and every twelve of them in a row.
CLEAN = r"""regexp_replace(replace(lower(strip_accents(nfc_normalize(regexp_replace(replace(text, chr(160), ' '), '<([/?]?[A-Za-z]|!)[^<>]*>', ' ', 'g')))), 'ß', 'ss'), '[^a-z0-9\s]+', '', 'g')"""


def _shingles(name: str, key: str) -> str:
    words = f"SELECT {key}, list_filter(regexp_split_to_array({CLEAN}, '\\s+'), lambda x: x <> '') AS w FROM {name} WHERE text IS NOT NULL"
    return f"SELECT DISTINCT {key}, array_to_string(w[i:i+11], ' ') AS s FROM (SELECT {key}, w, unnest(generate_series(1, len(w) - 11)) AS i FROM ({words}) WHERE len(w) >= 12)"


P9_FOUND = f"SELECT DISTINCT d.doc_id, i.item_id FROM ({_shingles('documents', 'doc_id')}) d JOIN ({_shingles('eval_items', 'item_id')}) i ON d.s = i.s"


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_FOUND, "p9_found": P9_FOUND}
