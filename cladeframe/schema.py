"""Table layouts shared by the operators (DDL strings).

An alignment is kept one row per column (``sites``) because the column is the unit that
grows without bound and the unit every statistic and likelihood is summed over; the number
of taxa bounds the width of a row.  Trees are rows holding Newick text; their bipartitions
are one row per split, written as a '0'/'1' string in taxon order whose first character is
'0' (the side without the first taxon).
"""

CELLS = "part_id INT, site BIGINT, taxon_id BIGINT, state STRING"
SITES = "part_id INT, site BIGINT, pattern STRING"
PATTERNS = "part_id INT, pattern STRING, weight BIGINT, first_site BIGINT"
TAXA = "taxon_id BIGINT, label STRING"
PARTITIONS = "part_id INT, name STRING, model STRING, range_string STRING"
RANGES = "part_id INT, start BIGINT, stop BIGINT, stride BIGINT"
TREES = "tree_id BIGINT, newick STRING"
EDGES = "tree_id BIGINT, node INT, parent INT, label STRING, length DOUBLE"
SPLITS = "tree_id BIGINT, split STRING, length DOUBLE"
SCORED = "tree_id BIGINT, loglh DOUBLE, newick STRING"
BS_WEIGHTS = "replicate INT, part_id INT, pattern STRING, weight BIGINT"
