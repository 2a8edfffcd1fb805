"""Queries on the trees of items, artefacts and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discatlas.catalog import Catalogue, Registry
from discatlas.functions import paths
from discatlas.operators import hierarchy as tree

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle
UP = ", up(node, ancestor, distance) AS (SELECT id, parent_id, 1 FROM i WHERE parent_id IS NOT NULL UNION ALL SELECT up.node, i.parent_id, distance + 1 FROM up JOIN i ON i.id = up.ancestor WHERE i.parent_id IS NOT NULL), self AS (SELECT * FROM up UNION ALL SELECT id, id, 0 FROM i)"
DERIVED = ", up(node, ancestor, distance) AS (SELECT id, parent_artefact_id, 1 FROM a WHERE parent_artefact_id IS NOT NULL UNION ALL SELECT up.node, a.parent_artefact_id, distance + 1 FROM up JOIN a ON a.id = up.ancestor WHERE a.parent_artefact_id IS NOT NULL), self AS (SELECT * FROM up UNION ALL SELECT id, id, 0 FROM a), top AS (SELECT node, ancestor AS root, distance FROM self WHERE ancestor IN (SELECT id FROM a WHERE parent_artefact_id IS NULL))"


@R.query(DERIVED + " SELECT ancestor AS root, node, distance FROM up")
def rec01_derived_closure(c: Catalogue) -> DataFrame:
    """Everything derived from each artefact, with the distance."""
    return tree.closure(c.artefacts, "id", "parent_artefact_id").select(F.col("ancestor").alias("root"), "node", "distance")


@R.query(DERIVED + " SELECT DISTINCT a.item_id, s.node FROM self s JOIN a ON a.id = s.ancestor WHERE a.item_id IS NOT NULL")
def rec02_derived_of_items(c: Catalogue) -> DataFrame:
    """All artefacts of every item and what is derived from them."""
    below = tree.closure(c.artefacts, "id", "parent_artefact_id", itself=True)
    return below.join(c.artefacts.where("item_id IS NOT NULL").select(F.col("id").alias("ancestor"), "item_id"), "ancestor").select("item_id", "node").distinct()


@R.query(UP + " SELECT ancestor AS item_id, count(*) AS n_descendants, max(distance) AS height FROM up GROUP BY ancestor")
def rec03_item_descendants(c: Catalogue) -> DataFrame:
    """Number of descendants of every item that has any, and its height."""
    return tree.closure(c.items).groupBy(F.col("ancestor").alias("item_id")).agg(F.count(F.lit(1)).alias("n_descendants"), F.max("distance").alias("height"))


@R.query(UP + " SELECT s.node AS item_id, arg_min(i.platform, s.distance) AS platform FROM self s JOIN i ON i.id = s.ancestor WHERE i.platform IS NOT NULL GROUP BY s.node")
def rec05_effective_platform(c: Catalogue) -> DataFrame:
    """Platform of every item, its own or its nearest ancestor's."""
    return tree.nearest(c.items, "platform").select(F.col("node").alias("item_id"), F.col("value").alias("platform"))


@R.query(UP + " SELECT s.node AS item_id, string_agg(i.name, ' / ' ORDER BY s.distance DESC) AS breadcrumb FROM self s JOIN i ON i.id = s.ancestor WHERE i.name IS NOT NULL GROUP BY s.node")
def rec05_item_breadcrumbs(c: Catalogue) -> DataFrame:
    """Names from the root down to every item."""
    named = tree.closure(c.items, itself=True).join(c.items.where("name IS NOT NULL").select(F.col("id").alias("ancestor"), "name"), "ancestor")
    steps = named.groupBy("node").agg(F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("d"), "name"))).alias("steps"))
    return steps.select(F.col("node").alias("item_id"), F.array_join(F.transform("steps", lambda s: s["name"]), " / ").alias("breadcrumb"))


@R.query(DERIVED + " SELECT node AS artefact_id, root AS root_id, distance AS depth FROM top")
def rec06_artefact_roots(c: Catalogue) -> DataFrame:
    """Root artefact and depth of every artefact."""
    return tree.roots(c.artefacts, "id", "parent_artefact_id").select(F.col("node").alias("artefact_id"), F.col("root").alias("root_id"), "depth")


@R.query(UP + " SELECT s.node AS item_id, bool_or(coalesce(i.is_private, false)) AS private_effective FROM self s JOIN i ON i.id = s.ancestor GROUP BY s.node")
def rec07_effective_privacy(c: Catalogue) -> DataFrame:
    """Whether an item or any ancestor is private."""
    return tree.any_above(c.items, F.col("is_private")).select(F.col("node").alias("item_id"), F.col("flag").alias("private_effective"))


@R.query(""", up(node, ancestor) AS (SELECT id, parent_file_id FROM f WHERE parent_file_id IS NOT NULL UNION ALL SELECT up.node, f.parent_file_id FROM up JOIN f ON f.id = up.ancestor WHERE f.parent_file_id IS NOT NULL)
SELECT ancestor AS archive_id, count(*) AS n_members FROM up GROUP BY ancestor""")
def rec08_archive_members(c: Catalogue) -> DataFrame:
    """Members of every archive at any depth."""
    return tree.closure(c.files_of("parent_file_id"), "id", "parent_file_id").groupBy(F.col("ancestor").alias("archive_id")).agg(F.count(F.lit(1)).alias("n_members"))


@R.query(""", d AS (SELECT DISTINCT partition_id, string_split(path, '/') AS parts FROM f WHERE path IS NOT NULL), x AS (SELECT DISTINCT partition_id, array_to_string(parts[1:k], '/') AS path, k AS depth FROM d, unnest(range(1, len(parts))) AS t(k))
SELECT partition_id, path, depth, CASE WHEN depth = 1 THEN '' ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) END AS parent FROM x""")
def rec10_directory_tree(c: Catalogue) -> DataFrame:
    """Directories of every partition as flat (path, parent, depth) rows."""
    # Repeated deliveries fold with the folders themselves.
    folders = c.raw("extracted_files").where("path IS NOT NULL").select("partition_id", F.explode(paths.ancestors("path")).alias("path")).distinct()
    return folders.select("partition_id", "path", paths.depth("path").cast("long").alias("depth"), paths.parent("path").alias("parent"))


@R.query(" SELECT partition_id, split_part(path, '/', 1) AS name, count(*) AS n FROM f WHERE path IS NOT NULL AND split_part(path, '/', 1) <> '' GROUP BY ALL")
def rec11_top_folders(c: Catalogue) -> DataFrame:
    """What lies directly at the top of every partition, and how many paths are in it."""
    named = c.files_of("partition_id", "path").select("partition_id", paths.child_segment("path", "").alias("name")).where("name IS NOT NULL")
    return named.groupBy("partition_id", "name").agg(F.count(F.lit(1)).alias("n"))


@R.query(", d AS (SELECT DISTINCT path FROM f WHERE path IS NOT NULL), x AS (SELECT path, list_filter(string_split(path, '/'), lambda s: s <> '') AS parts FROM d) SELECT path, k - 1 AS position, parts[k] AS name, array_to_string(parts[1:k], '/') AS prefix FROM x, unnest(range(1, len(parts) + 1)) AS t(k)")
def rec12_breadcrumb_segments(c: Catalogue) -> DataFrame:
    """Breadcrumb of every distinct path, a row per segment."""
    distinct = c.raw("extracted_files").select("path").where("path IS NOT NULL").distinct()
    exploded = distinct.select("path", F.posexplode(paths.breadcrumb("path")).alias("position", "step"))
    return exploded.select("path", F.col("position").cast("long").alias("position"), F.col("step.name").alias("name"), F.col("step.path").alias("prefix"))


@R.query(UP + ", st AS (SELECT s.node, max(s.distance) AS depth, string_agg(rpad(lower(coalesce(i.name, '')), 60, chr(1)) || lpad(s.ancestor::VARCHAR, 12, '0'), chr(1) ORDER BY s.distance DESC) AS path FROM self s JOIN i ON i.id = s.ancestor GROUP BY s.node) SELECT node AS item_id, depth, row_number() OVER (ORDER BY path) AS position FROM st")
def srt09_depth_first_items(c: Catalogue) -> DataFrame:
    """Items in depth-first order with their depth, siblings by name."""
    return tree.depth_first(c.items, "name").select(F.col("node").alias("item_id"), "depth", "position")


@R.query(DERIVED + """, x AS (SELECT t.root, an.status, count(*) AS c FROM an JOIN top t ON t.node = an.artefact_id GROUP BY ALL)
SELECT root AS root_id, arg_min(status, list_position(['RUNNING','FAILED','PENDING','COMPLETED'], status)) AS status, arg_min(c, list_position(['RUNNING','FAILED','PENDING','COMPLETED'], status)) AS n, sum(c)::BIGINT AS total FROM x GROUP BY root""")
def agg24_worst_status(c: Catalogue) -> DataFrame:
    """Worst status of all analyses under each root artefact, with its count and the total."""
    tops = tree.roots(c.artefacts, "id", "parent_artefact_id").select("node", "root")
    found = tree.worst_status(c.analyses.select(F.col("artefact_id").alias("node"), "status"), tops, ["RUNNING", "FAILED", "PENDING", "COMPLETED"])
    return found.withColumnRenamed("root", "root_id")


@R.query(DERIVED + " SELECT t.root AS root_id, an.status, count(*) AS n FROM an JOIN top t ON t.node = an.artefact_id GROUP BY ALL")
def agg23_status_of_tree(c: Catalogue) -> DataFrame:
    """Analyses under each root artefact by status."""
    tops = tree.roots(c.artefacts, "id", "parent_artefact_id").select(F.col("node").alias("artefact_id"), F.col("root").alias("root_id"))
    return c.analyses.select("artefact_id", "status").join(tops, "artefact_id").groupBy("root_id", "status").agg(F.count(F.lit(1)).alias("n"))


@R.query(DERIVED + " SELECT t.root AS root_id, an.id AS analysis_id, an.analysis_type, an.created_at FROM an JOIN top t ON t.node = an.artefact_id")
def lif01_analyses_of_tree(c: Catalogue) -> DataFrame:
    """All analyses over each derivation tree."""
    tops = tree.roots(c.artefacts, "id", "parent_artefact_id").select(F.col("node").alias("artefact_id"), F.col("root").alias("root_id"))
    return c.analyses.select("artefact_id", F.col("id").alias("analysis_id"), "analysis_type", "created_at").join(tops, "artefact_id").select("root_id", "analysis_id", "analysis_type", "created_at")


@R.query(DERIVED + ", doomed AS (SELECT DISTINCT s.node FROM self s JOIN a ON a.id = s.ancestor WHERE a.is_private), x AS (SELECT DISTINCT upload_blob_id AS blob_id FROM a WHERE id IN (SELECT node FROM doomed) AND upload_blob_id IS NOT NULL) SELECT blob_id FROM x WHERE blob_id NOT IN (SELECT upload_blob_id FROM a WHERE upload_blob_id IS NOT NULL AND id NOT IN (SELECT node FROM doomed))")
def lif03_freed_blobs(c: Catalogue) -> DataFrame:
    """Blobs that nothing would refer to any more if the private artefacts and all derived from them were deleted."""
    below = tree.closure(c.artefacts, "id", "parent_artefact_id", itself=True)
    doomed = below.join(c.artefacts.where("is_private").select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select(F.col("node").alias("id")).distinct()
    held = c.artefacts.where("upload_blob_id IS NOT NULL").select("id", F.col("upload_blob_id").alias("blob_id"))
    kept = held.join(doomed, "id", "left_anti").select("blob_id")
    return held.join(doomed, "id", "left_semi").select("blob_id").distinct().join(kept, "blob_id", "left_anti")


@R.query(UP + " SELECT i.id AS item_id, count(x.id) AS n_choices FROM i CROSS JOIN (SELECT id FROM i) x WHERE x.id <> i.id AND NOT EXISTS (SELECT 1 FROM up WHERE up.node = x.id AND up.ancestor = i.id) GROUP BY i.id")
def itm02_parent_choices(c: Catalogue) -> DataFrame:
    """How many items each item could be moved under: all but itself and its descendants."""
    total = c.items.count()
    below = tree.closure(c.items).groupBy(F.col("ancestor").alias("item_id")).agg(F.count(F.lit(1)).alias("n_below"))
    return c.items.select(F.col("id").alias("item_id")).join(below, "item_id", "left").select("item_id", (F.lit(total - 1) - F.coalesce("n_below", F.lit(0))).alias("n_choices"))


@R.query(UP + ", pe AS (SELECT s.node AS item_id, bool_or(coalesce(i.is_private, false)) AS p FROM self s JOIN i ON i.id = s.ancestor GROUP BY s.node) SELECT a.id AS artefact_id FROM a LEFT JOIN pe USING (item_id) WHERE NOT coalesce(a.is_private, false) AND NOT coalesce(pe.p, false)")
def flt17_public_artefacts(c: Catalogue) -> DataFrame:
    """Artefacts that anybody may see: neither they nor their item nor any item above it is private."""
    hidden = tree.any_above(c.items, F.col("is_private")).where("flag").select(F.col("node").alias("item_id"))
    return c.artefacts.where(~F.coalesce("is_private", F.lit(False))).join(hidden, "item_id", "left_anti").select(F.col("id").alias("artefact_id"))
