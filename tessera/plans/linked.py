"""Modules that SQL can name too: components of strongly co-firing features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import coactivation as co
from tessera.operators import modules
from tessera.plans.features import encoded
from tessera.session import materialize

#: Features are linked at a PMI of ``LINKED`` and 5 common positions; components of ``LEAST`` members count as modules.
LINKED, LEAST = 0.7, 3

PAIRS = """,
tot AS (SELECT layer, count(*) AS total FROM pos GROUP BY layer),
one AS (SELECT layer, feature, count(*) AS n_item FROM acts GROUP BY layer, feature),
two AS (SELECT a.layer, a.feature AS i, b.feature AS j, count(*) AS n FROM acts a JOIN acts b ON a.layer = b.layer AND a.pos_id = b.pos_id AND a.feature < b.feature GROUP BY ALL),
edges AS (SELECT layer, i, j, n, log2(n * CAST(total AS DOUBLE) / (x.n_item * y.n_item)) AS pmi FROM two JOIN one x USING (layer) JOIN one y USING (layer) JOIN tot USING (layer)
          WHERE x.feature = i AND y.feature = j AND n >= 5)"""

#: fm (layer, module_id, feature), after ``ACTS`` in a recursive WITH.
MODULES = PAIRS + f""",
strong AS (SELECT layer, i AS u, j AS v FROM edges WHERE pmi >= {LINKED} UNION SELECT layer, j, i FROM edges WHERE pmi >= {LINKED}),
walk(layer, node, seen) AS (SELECT layer, u, u FROM strong UNION SELECT w.layer, w.node, s.v FROM walk w JOIN strong s ON s.layer = w.layer AND s.u = w.seen),
cc AS (SELECT layer, node, min(seen) AS root FROM walk GROUP BY layer, node HAVING count(*) >= {LEAST}),
fm AS (SELECT CAST(layer AS INT) AS layer, CAST(dense_rank() OVER (PARTITION BY layer ORDER BY root) - 1 AS INT) AS module_id, CAST(node AS BIGINT) AS feature FROM cc)"""


def baskets(spark, sf_dir, active="index") -> DataFrame:
    _, e, _, _ = encoded(spark, sf_dir)
    return e.select("layer", "pos_id", co.features_of(F.col("top"), active).alias("items"))


def linked_modules(spark, sf_dir) -> DataFrame:
    """(layer, module_id, feature)."""
    edges = materialize(co.pmi_edges(baskets(spark, sf_dir), "items", ["layer"], least_count=5, least_pmi=LINKED), "linked-edges")
    return materialize(modules.linked_modules(edges, LEAST), "linked-modules")
