"""SQL building blocks of the oracle statements (DuckDB dialect).

They restate the table recipes from their definition; nothing here calls the Spark side.
"""

MASK = ("CASE WHEN l_returnflag='A' THEN 1 WHEN l_returnflag='R' THEN 2 "
        "WHEN l_linestatus='O' THEN 4 ELSE 8 END")
CODES = "-ACMGRSVTWYHKDBN"

_M = ", ".join(f"coalesce(bit_or(CASE WHEN l_linenumber={k} THEN {MASK} END),0) AS m{k}" for k in range(1, 8))
_P = " || ".join(f"substr('{CODES}', m{k}+1, 1)" for k in range(1, 8))

LINE_SITES = f"""lm AS (SELECT l_orderkey AS site, {_M} FROM lineitem GROUP BY 1),
line_sites AS (SELECT CAST(site % 3 AS INTEGER) AS part_id, site, {_P} AS pattern FROM lm)"""

LINE_PATTERNS = LINE_SITES + """,
pats AS (SELECT part_id, pattern, count(*)::BIGINT AS weight, min(site) AS first_site FROM line_sites GROUP BY 1,2)"""

# the same with the two symbols for an undetermined state written alike
FOLDED_PATTERNS = LINE_SITES + """,
pats AS (SELECT part_id, replace(pattern, 'N', '-') AS pattern, count(*)::BIGINT AS weight, min(site) AS first_site
  FROM line_sites GROUP BY 1,2)"""

ORDER_SITES = LINE_SITES + """,
order_sites AS (SELECT CAST(o_orderkey % 3 AS INTEGER) AS part_id, o_orderkey AS site,
  coalesce(pattern, '-------') AS pattern FROM orders LEFT JOIN line_sites ON site = o_orderkey)"""

_C = ("CASE WHEN x < -0.084 THEN 'A' WHEN x < 0 THEN 'C' WHEN x < 0.084 THEN 'G' ELSE 'T' END")
VECTOR_SITES = f"""vector_sites AS (SELECT label AS part_id, vec_id AS site,
  array_to_string(list_transform(embedding::DOUBLE[], lambda x: {_C}), '') AS pattern FROM embeddings)"""

VECTOR_CELLS = f"""vcells AS (SELECT vec_id AS site, label AS part_id, i - 1 AS taxon_id, {_C} AS state FROM
  (SELECT vec_id, label, unnest(range(1, 65)) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings))"""

_E = " || ".join(f"CASE WHEN bool_or(event_type='{t}') THEN '1' ELSE '0' END"
                 for t in ("click", "error", "purchase", "signup", "view"))
EVENT_SITES = f"""event_sites AS (SELECT 0 AS part_id,
  user_id * 1000 + date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS site, {_E} AS pattern
  FROM events GROUP BY 2)"""

# cells of the line alignment: one row per column and line number, with its state mask (0: no line)
LINE_CELLS = f"""ck AS (SELECT DISTINCT l_orderkey AS site FROM lineitem),
lcells AS (SELECT ck.site, CAST(ck.site % 3 AS INTEGER) AS part_id, t.taxon,
  coalesce(bit_or({MASK}) FILTER (l_orderkey IS NOT NULL), 0) AS mask
  FROM ck CROSS JOIN (SELECT unnest(range(1, 8)) AS taxon) t
  LEFT JOIN lineitem l ON l.l_orderkey = ck.site AND l.l_linenumber = t.taxon GROUP BY 1,2,3)"""

# hash draws: one 62-bit word per (stream, counter), as defined by the resampling operator
def mix(s: str) -> str:
    y = f"(({s}) * 48271 % 2147483647)"
    z = f"(({y} * {y} + ({s})) % 2147483647)"
    return f"(({z} * {z} + {y}) % 2147483647)"


# -- trees ------------------------------------------------------------------------------

NATIONS = "SELECT n_nationkey::BIGINT AS taxon_id FROM nation"

SEG_COUNTS = f"""segc AS (SELECT c_mktsegment || '-' || year(o_orderdate) AS tree_id, c_nationkey::BIGINT AS taxon_id,
  count(*)::BIGINT AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1,2),
counts AS (SELECT t.tree_id, x.taxon_id, coalesce(n, 0) AS n FROM (SELECT DISTINCT tree_id FROM segc) t
  CROSS JOIN ({NATIONS}) x LEFT JOIN segc USING (tree_id, taxon_id))"""

MONTH_COUNTS = f"""counts AS (SELECT m.k AS tree_id, x.taxon_id, count(o_orderkey) FILTER (month(o_orderdate) <> m.k)::BIGINT AS n
  FROM (SELECT unnest(range(1,13))::BIGINT AS k) m CROSS JOIN ({NATIONS}) x
  LEFT JOIN (orders JOIN customer ON o_custkey = c_custkey) ON c_nationkey = x.taxon_id GROUP BY 1,2)"""


def line_counts(key: str) -> str:
    return f"""counts AS (SELECT k.tree_id, x.taxon_id, count(l_orderkey)::BIGINT AS n
  FROM (SELECT DISTINCT {key} AS tree_id FROM lineitem) k CROSS JOIN (SELECT unnest(range(0,7))::BIGINT AS taxon_id) x
  LEFT JOIN lineitem ON {key} = k.tree_id AND l_linenumber = x.taxon_id + 1 GROUP BY 1,2)"""


def ladder_splits(name: str = "splits", counts: str = "counts", n: int = 25) -> str:
    """Ranking -> the n-3 canonical splits of the caterpillar, as 0/1 strings."""
    return f"""{name}_r AS (SELECT tree_id, taxon_id, row_number() OVER (PARTITION BY tree_id ORDER BY n DESC, taxon_id) AS rk
  FROM {counts}),
{name}_b AS (SELECT r.tree_id, k.k, string_agg(CASE WHEN r.rk <= k.k THEN '1' ELSE '0' END, '' ORDER BY r.taxon_id) AS b
  FROM {name}_r r CROSS JOIN (SELECT unnest(range(2, {n} - 1)) AS k) k GROUP BY 1,2),
{name} AS (SELECT tree_id, CASE WHEN b[1] = '1' THEN translate(b, '01', '10') ELSE b END AS split FROM {name}_b)"""
