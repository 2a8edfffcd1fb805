"""Queries on set similarity between partitions and between directory components."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discatlas.catalog import Catalogue, Registry
from discatlas.functions import paths
from discatlas.operators import similarity as sim
from discatlas.runtime import shared_dir, stored
from discatlas.streaming import live

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle

#: SQL of the content sets and of scored pairs.
SETS = ", s AS (SELECT partition_id AS owner, md5 AS h, min(file_size) AS size FROM f WHERE NOT is_directory AND md5 IS NOT NULL AND file_size > 0 AND partition_id IS NOT NULL GROUP BY ALL)"
PAIRS = SETS + """, df AS (SELECT h, count(*) AS df FROM s GROUP BY h),
c AS (SELECT DISTINCT x.owner AS a, y.owner AS b FROM s x JOIN s y ON x.h = y.h AND x.owner < y.owner JOIN df ON df.h = x.h WHERE df.df BETWEEN 2 AND 50),
t AS (SELECT owner, count(*) AS n, sum(size)::BIGINT AS bytes FROM s GROUP BY owner),
sh AS (SELECT c.a, c.b, count(*) AS sf, sum(least(x.size, y.size))::BIGINT AS sb FROM c JOIN s x ON x.owner = c.a JOIN s y ON y.owner = c.b AND y.h = x.h GROUP BY ALL),
sc AS (SELECT sh.a, sh.b, sh.sb::DOUBLE / (ta.bytes + tb.bytes - sh.sb)::DOUBLE AS score, sh.sf AS shared_files, ta.n + tb.n - sh.sf AS union_files, sh.sb AS shared_bytes, (ta.bytes + tb.bytes - sh.sb)::BIGINT AS union_bytes
  FROM sh JOIN t ta ON ta.owner = sh.a JOIN t tb ON tb.owner = sh.b),
pr AS (SELECT * FROM sc WHERE score >= 0.1)"""


def _hashable(files: DataFrame) -> DataFrame:
    return files.where("NOT is_directory AND md5 IS NOT NULL AND file_size > 0 AND partition_id IS NOT NULL").select(F.col("partition_id").alias("owner"), "path", F.col("md5").alias("h"), F.col("file_size").alias("size"))


def hashable(c: Catalogue) -> DataFrame:
    """Files that count in similarity: owner (partition), path, h, size."""
    return _hashable(c.files_of("partition_id", "path", "md5", "file_size", "is_directory"))


def content(c: Catalogue) -> DataFrame:
    """Content of every partition; repeated deliveries fold with the contents themselves."""
    return sim.content_sets(_hashable(c.raw("extracted_files")))


def scored(c: Catalogue) -> DataFrame:
    return sim.weighted_jaccard(content(c))


@R.query(SETS + " SELECT f.partition_id AS owner, f.path, f.md5 AS h, f.file_size AS size FROM f WHERE NOT is_directory AND md5 IS NOT NULL AND file_size > 0 AND partition_id IS NOT NULL")
def src01_hashable_files(c: Catalogue) -> DataFrame:
    """Scan of the files that count in similarity."""
    return hashable(c)


@R.query(PAIRS + " SELECT * FROM pr")
def agg01_weighted_jaccard(c: Catalogue) -> DataFrame:
    """Similar pairs of partitions with score, shared and union files and bytes."""
    return scored(c)


#: SQL of classes of equal content and of pairs between them, without a cap on how many hold a content.
CLASSES = SETS + """, g AS (SELECT owner, string_agg(h || ':' || size, ',' ORDER BY h) AS print FROM s GROUP BY owner),
cl AS (SELECT owner, min(owner) OVER (PARTITION BY print) AS class_id, count(*) OVER (PARTITION BY print) AS n_copies FROM g),
r AS (SELECT s.* FROM s WHERE owner IN (SELECT class_id FROM cl)), t AS (SELECT owner, count(*) AS n, sum(size)::BIGINT AS bytes FROM r GROUP BY owner),
sh AS (SELECT x.owner AS a, y.owner AS b, count(*) AS sf, sum(least(x.size, y.size))::BIGINT AS sb FROM r x JOIN r y ON x.h = y.h AND x.owner < y.owner GROUP BY ALL),
un AS (SELECT sh.a, sh.b, sh.sb::DOUBLE / (ta.bytes + tb.bytes - sh.sb)::DOUBLE AS score, sh.sf AS shared_files, ta.n + tb.n - sh.sf AS union_files, sh.sb AS shared_bytes, (ta.bytes + tb.bytes - sh.sb)::BIGINT AS union_bytes
  FROM sh JOIN t ta ON ta.owner = sh.a JOIN t tb ON tb.owner = sh.b WHERE sh.sb::DOUBLE / (ta.bytes + tb.bytes - sh.sb)::DOUBLE >= 0.1)"""


def _uncapped(c: Catalogue) -> tuple[DataFrame, DataFrame]:
    """(classes, pairs between their smallest owners)."""
    sets = stored(content(c), "contents")
    classes = stored(sim.content_classes(sets), "classes")
    return classes, sim.uncapped_pairs(sets.join(classes.where("owner = class_id").select("owner"), "owner", "left_semi"))


@R.query(CLASSES + " SELECT * FROM un")
def agg01_uncapped_pairs(c: Catalogue) -> DataFrame:
    """Similar pairs between classes of equal partitions, exact however many partitions hold a content."""
    return _uncapped(c)[1]


@R.query(CLASSES + ", ln AS (SELECT a AS class_id FROM un UNION ALL SELECT b FROM un), lc AS (SELECT class_id, count(*) AS n FROM ln GROUP BY class_id) SELECT cl.owner, cl.class_id, cl.n_copies, coalesce(lc.n, 0) AS n_links FROM cl LEFT JOIN lc USING (class_id)")
def agg01_uncapped_links(c: Catalogue) -> DataFrame:
    """Every partition with its class of equal content and how many classes are similar to that."""
    classes, pairs = _uncapped(c)
    links = sim.both_directions(pairs).groupBy(F.col("owner").alias("class_id")).agg(F.count(F.lit(1)).alias("n_links"))
    return classes.join(links, "class_id", "left").select("owner", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))


@R.query(SETS + " SELECT * FROM s")
def agg02_content_sets(c: Catalogue) -> DataFrame:
    """Content of every partition, once each."""
    return content(c)


@R.query(SETS + " SELECT h, count(*) AS df FROM s GROUP BY h")
def agg03_document_frequency(c: Catalogue) -> DataFrame:
    """In how many partitions each content occurs."""
    return sim.document_frequency(content(c))


@R.query(SETS + " SELECT h, count(*) AS df, round(ln(1 + (SELECT count(DISTINCT owner) FROM s)::DOUBLE / count(*)), 9) AS weight FROM s GROUP BY h")
def agg04_idf(c: Catalogue) -> DataFrame:
    """Rarity weight of every content."""
    sets = content(c)
    owners = sets.agg(F.count_distinct("owner")).first()[0]
    return sim.idf(sim.document_frequency(sets), owners).withColumn("weight", F.round("weight", 9))


@R.query(SETS + " SELECT count(DISTINCT owner) AS n_owners, count(*) AS n_entries, count(DISTINCT h) AS n_contents, sum(size)::BIGINT AS n_bytes FROM s")
def agg05_corpus_size(c: Catalogue) -> DataFrame:
    """Owners, entries, contents and bytes that similarity works on."""
    return content(c).agg(F.count_distinct("owner").alias("n_owners"), F.count(F.lit(1)).alias("n_entries"), F.count_distinct("h").alias("n_contents"), F.sum("size").alias("n_bytes"))


@R.query(PAIRS + " SELECT a, b FROM c")
def joi10_candidate_pairs(c: Catalogue) -> DataFrame:
    """Pairs of partitions that share content held by 2 to 50 partitions."""
    return sim.candidates(content(c))


@R.query(PAIRS + """, w AS (SELECT s.*, s.size * ln(1 + (SELECT count(DISTINCT owner) FROM s)::DOUBLE / df.df) AS w FROM s JOIN df USING (h)),
tw AS (SELECT owner, sum(w) AS tw FROM w GROUP BY owner),
cw AS (SELECT pr.a, pr.b, sum(least(x.w, y.w)) AS cw FROM pr JOIN w x ON x.owner = pr.a JOIN w y ON y.owner = pr.b AND y.h = x.h GROUP BY ALL)
SELECT cw.a, cw.b, round(cw / (ta.tw + tb.tw - cw), 6) AS score FROM cw JOIN tw ta ON ta.owner = cw.a JOIN tw tb ON tb.owner = cw.b""")
def agg04_idf_jaccard(c: Catalogue) -> DataFrame:
    """Scores of the similar pairs with content weighted by rarity."""
    sets = content(c)
    owners = sets.agg(F.count_distinct("owner")).first()[0]
    return sim.idf_jaccard(sets, scored(c), sim.idf(sim.document_frequency(sets), owners)).withColumn("score", F.round("score", 6))


COMPONENTS = """, cf AS (SELECT partition_id AS owner, path, md5 AS h, file_size AS size, string_split(path, '/') AS parts FROM f WHERE NOT is_directory AND md5 IS NOT NULL AND file_size > 0 AND partition_id IS NOT NULL),
ce AS (SELECT owner, h, size, array_to_string(parts[1:k], '/') AS root FROM cf, unnest(range(1, least(len(parts) - 1, 4) + 1)) AS t(k)),
cd AS (SELECT owner, root, h, min(size) AS size FROM ce GROUP BY ALL),
cb AS (SELECT owner, root, count(*) AS n_files, sum(size)::BIGINT AS n_bytes, md5(count(h || ':' || size) || ':' || bit_xor(('0x' || substr(md5(h || ':' || size), 1, 15))::BIGINT) || ':' || sum(('0x' || substr(md5(h || ':' || size), 16, 15))::BIGINT)::HUGEINT) AS fingerprint, len(string_split(root, '/')) AS depth FROM cd GROUP BY owner, root HAVING count(*) >= 2),
co AS (SELECT * FROM (SELECT * FROM cb QUALIFY row_number() OVER (PARTITION BY owner, fingerprint ORDER BY depth, root) = 1) QUALIFY row_number() OVER (PARTITION BY owner ORDER BY n_files DESC, root) <= 500)"""


@R.query(COMPONENTS + " SELECT owner, root, depth, n_files, n_bytes, fingerprint FROM co")
def agg06_components(c: Catalogue) -> DataFrame:
    """Directory components of every partition, equal ones folded."""
    return sim.components(hashable(c))


@R.query(COMPONENTS + " SELECT x.owner AS a, x.root AS root_a, y.owner AS b, y.root AS root_b, x.fingerprint FROM co x JOIN co y ON x.fingerprint = y.fingerprint AND x.owner < y.owner")
def joi12_equal_components(c: Catalogue) -> DataFrame:
    """Directory components of different partitions with equal content: an equi-join instead of a comparison of all."""
    found = sim.components(hashable(c)).select("owner", "root", "fingerprint")
    left = found.select(F.col("owner").alias("a"), F.col("root").alias("root_a"), "fingerprint")
    right = found.select(F.col("owner").alias("b"), F.col("root").alias("root_b"), "fingerprint")
    return left.join(right, "fingerprint").where("a < b").select("a", "root_a", "b", "root_b", "fingerprint")


@R.query(COMPONENTS + """, m AS (SELECT x.root, x.owner, count(DISTINCT y.owner) AS n FROM co x JOIN co y ON x.fingerprint = y.fingerprint AND x.owner <> y.owner GROUP BY ALL)
SELECT root, max(n) AS most_matches FROM m GROUP BY root""")
def agg07_component_matches(c: Catalogue) -> DataFrame:
    """For every root path the most partitions that any of its components matches."""
    found = sim.components(hashable(c)).select("owner", "root", "fingerprint")
    other = found.select(F.col("owner").alias("other"), "fingerprint")
    matched = found.join(other, "fingerprint").where("owner != other").groupBy("root", "owner").agg(F.count_distinct("other").alias("n"))
    return matched.groupBy("root").agg(F.max("n").alias("most_matches"))


#: SQL of scored pairs of components; directories that begin with '!' are components at any depth.
COMPONENT_PAIRS = """, qf AS (SELECT partition_id AS owner, md5 AS h, file_size AS size, string_split(path, '/') AS parts FROM f WHERE NOT is_directory AND md5 IS NOT NULL AND file_size > 0 AND partition_id IS NOT NULL),
qe AS (SELECT owner, h, size, array_to_string(parts[1:k], '/') AS root FROM qf, unnest(range(1, len(parts))) AS t(k) WHERE k <= 4 OR k = list_position([starts_with(x, '!') for x in parts], true)),
qd AS (SELECT owner, root, h, min(size) AS size FROM qe GROUP BY ALL),
qb AS (SELECT owner, root, count(*) AS n, sum(size)::BIGINT AS bytes, md5(string_agg(h || ':' || size, ',' ORDER BY h)) AS content, len(string_split(root, '/')) AS depth FROM qd GROUP BY owner, root HAVING count(*) >= 2),
qo AS (SELECT * FROM (SELECT * FROM qb QUALIFY row_number() OVER (PARTITION BY owner, content ORDER BY depth, root) = 1) QUALIFY row_number() OVER (PARTITION BY owner ORDER BY n DESC, root) <= 500),
qs AS (SELECT qd.* FROM qd JOIN qo ON qo.owner = qd.owner AND qo.root = qd.root),
qr AS (SELECT h FROM qs GROUP BY h HAVING count(*) BETWEEN 2 AND 50),
qc AS (SELECT DISTINCT x.owner AS a, x.root AS root_a, y.owner AS b, y.root AS root_b FROM qs x JOIN qs y ON x.h = y.h AND x.owner < y.owner WHERE x.h IN (SELECT h FROM qr)),
qj AS (SELECT qc.*, count(*) AS shared_files, sum(least(x.size, y.size))::BIGINT AS shared_bytes FROM qc JOIN qs x ON x.owner = qc.a AND x.root = qc.root_a JOIN qs y ON y.owner = qc.b AND y.root = qc.root_b AND y.h = x.h GROUP BY ALL),
qp AS (SELECT qj.a, qj.root_a, qj.b, qj.root_b, shared_bytes::DOUBLE / (x.bytes + y.bytes - shared_bytes)::DOUBLE AS score, shared_files, x.n + y.n - shared_files AS union_files, shared_bytes, (x.bytes + y.bytes - shared_bytes)::BIGINT AS union_bytes
  FROM qj JOIN qo x ON x.owner = qj.a AND x.root = qj.root_a JOIN qo y ON y.owner = qj.b AND y.root = qj.root_b WHERE shared_bytes::DOUBLE / (x.bytes + y.bytes - shared_bytes)::DOUBLE >= 0.1),
qm AS (SELECT a AS owner, root_a AS root, b AS other, root_b AS other_root FROM qp UNION ALL SELECT b, root_b, a, root_a FROM qp)"""


@R.query(COMPONENT_PAIRS + " SELECT * FROM qp")
def joi12_component_pairs(c: Catalogue) -> DataFrame:
    """Similar directory components of different partitions with score, shared and union files and bytes; partial overlaps too."""
    return sim.component_pairs(hashable(c))


def _component_matches(c: Catalogue) -> DataFrame:
    """Similar components from both ends: owner, root, other, other_root."""
    pairs = sim.component_pairs(hashable(c)).select("a", "root_a", "b", "root_b")
    ends = F.array(*(F.struct(F.col(x).alias("owner"), F.col(f"root_{x}").alias("root"), F.col(y).alias("other"), F.col(f"root_{y}").alias("other_root")) for x, y in ("ab", "ba")))
    return pairs.select(F.inline(ends))


@R.query(COMPONENT_PAIRS + """, m AS (SELECT root, owner, count(*) AS n FROM qm GROUP BY ALL)
SELECT root, n AS most_matches, owner AS partition_id FROM m QUALIFY row_number() OVER (PARTITION BY root ORDER BY n DESC, owner) = 1""")
def agg07_similar_components(c: Catalogue) -> DataFrame:
    """For every root path the most components of other partitions that one component resembles, and the first partition where it does."""
    matched = _component_matches(c).groupBy("root", "owner").agg(F.count(F.lit(1)).alias("n"))
    best = matched.groupBy("root").agg(F.max(F.struct("n", (-F.col("owner")).alias("last"))).alias("best"))
    return best.select("root", F.col("best.n").alias("most_matches"), (-F.col("best.last")).alias("partition_id"))


DIST = """, v AS (SELECT {value} AS v FROM {source}), o AS (SELECT v, row_number() OVER (ORDER BY v) AS r, count(*) OVER () AS n FROM v),
pick AS (SELECT {picks} FROM o)
SELECT (SELECT count(*) FROM v) AS n, (SELECT sum(v)::BIGINT FROM v) AS total, (SELECT sum(v)::BIGINT::DOUBLE / count(*) FROM v) AS mean, pick.* FROM pick"""
PICKS = ", ".join(f"min(v) FILTER (WHERE r >= greatest(1, least(n, round_even({p / 100} * n + 0.5, 0)::BIGINT))) AS p{p}" for p in (50, 90, 95, 99)) + ", max(v) AS p100"


@R.query(SETS + ", cnt AS (SELECT count(*) AS c FROM s GROUP BY owner)" + DIST.format(value="c", source="cnt", picks=PICKS))
def agg08_set_size_distribution(c: Catalogue) -> DataFrame:
    """Count, total, mean and percentiles of the set sizes."""
    return sim.distribution(sim.totals(content(c)), "n")


@R.query(PAIRS + " SELECT floor(score * 10) / 10 AS bucket, count(*) AS n FROM (SELECT least(score, 0.9999) AS score FROM pr) GROUP BY 1")
def agg09_score_histogram(c: Catalogue) -> DataFrame:
    """Similar pairs by tenths of the score."""
    return sim.histogram(scored(c).withColumn("bucketed", F.floor(F.least("score", F.lit(0.9999)) * 10) / 10), "bucketed", tuple(i / 10 for i in range(10)))


@R.query(SETS + ", d AS (SELECT count(*) AS df FROM s GROUP BY h) SELECT CASE WHEN df >= 1000 THEN 1000 WHEN df >= 100 THEN 100 WHEN df >= 51 THEN 51 WHEN df >= 10 THEN 10 WHEN df >= 2 THEN 2 ELSE 1 END AS bucket, count(*) AS n FROM d GROUP BY 1")
def agg09_df_histogram(c: Catalogue) -> DataFrame:
    """Contents by how many partitions hold them."""
    return sim.histogram(sim.document_frequency(content(c)), "df", (1, 2, 10, 51, 100, 1000))


@R.query(SETS + ", t AS (SELECT owner, count(*) AS n FROM s GROUP BY owner) SELECT " + ", ".join(f"count(*) FILTER (WHERE n > {k}) AS above_{k}" for k in (10, 25, 50, 100)) + " FROM t")
def agg10_threshold_counts(c: Catalogue) -> DataFrame:
    """How many partitions hold more than 10, 25, 50 and 100 contents."""
    return sim.totals(content(c)).agg(*(F.count_if(F.col("n") > k).alias(f"above_{k}") for k in (10, 25, 50, 100)))


@R.query(PAIRS + " SELECT pr.a, pr.b, least(ta.n, tb.n)::DOUBLE / greatest(ta.n, tb.n) AS count_ratio, least(ta.bytes, tb.bytes)::DOUBLE / greatest(ta.bytes, tb.bytes) AS byte_ratio FROM pr JOIN t ta ON ta.owner = pr.a JOIN t tb ON tb.owner = pr.b")
def agg11_pair_ratios(c: Catalogue) -> DataFrame:
    """How far apart the sizes of similar partitions are."""
    sums = sim.totals(content(c))
    joined = scored(c).select("a", "b").join(sums.toDF("a", "na", "ba"), "a").join(sums.toDF("b", "nb", "bb"), "b")
    return joined.select("a", "b", (F.least("na", "nb") / F.greatest("na", "nb")).alias("count_ratio"), (F.least("ba", "bb") / F.greatest("ba", "bb")).alias("byte_ratio"))


@R.query(SETS + """, x AS (SELECT s.* FROM s JOIN p ON p.id = s.owner WHERE p.filesystem = 'ISO9660'), ex AS (SELECT DISTINCT h FROM x)
SELECT count(*) AS n_files, sum(size)::BIGINT AS n_bytes, count(DISTINCT owner) AS n_owners FROM s WHERE h IN (SELECT h FROM ex)""")
def agg12_exclusion_impact(c: Catalogue) -> DataFrame:
    """Files, bytes and partitions that would be left out if the content of CD file systems counted as base system."""
    sets = content(c)
    flagged = sets.join(c.partitions.where("filesystem = 'ISO9660'").select(F.col("id").alias("owner")), "owner", "left_semi").select("h").distinct()
    return sets.join(flagged, "h", "left_semi").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("n_bytes"), F.count_distinct("owner").alias("n_owners"))


@R.query(SETS + """, ex AS (SELECT DISTINCT s.h FROM s JOIN p ON p.id = s.owner WHERE p.filesystem = 'ISO9660')
SELECT s.* FROM s WHERE h NOT IN (SELECT h FROM ex)""")
def flt31_base_system_excluded(c: Catalogue) -> DataFrame:
    """Content sets without what CD file systems hold."""
    sets = content(c)
    flagged = sets.join(c.partitions.where("filesystem = 'ISO9660'").select(F.col("id").alias("owner")), "owner", "left_semi").select("h").distinct()
    return sets.join(flagged, "h", "left_anti").select("owner", "h", "size")


@R.query(PAIRS + COMPONENTS + """, e AS (SELECT DISTINCT x.owner FROM co x JOIN co y ON x.fingerprint = y.fingerprint AND x.owner <> y.owner)
SELECT owner FROM e WHERE owner NOT IN (SELECT a FROM pr UNION SELECT b FROM pr)""")
def agg13_component_only(c: Catalogue) -> DataFrame:
    """Partitions that resemble another only in a directory."""
    found = sim.components(hashable(c)).select("owner", "fingerprint")
    matched = found.join(found.select(F.col("owner").alias("other"), "fingerprint"), "fingerprint").where("owner != other").select("owner").distinct()
    return matched.join(sim.both_directions(scored(c)).select("owner"), "owner", "left_anti")


@R.query(PAIRS + COMPONENT_PAIRS + " SELECT DISTINCT owner FROM qm WHERE owner NOT IN (SELECT a FROM pr UNION SELECT b FROM pr)")
def agg13_similar_component_only(c: Catalogue) -> DataFrame:
    """Partitions that resemble another in a directory, wholly or in part, and in no whole."""
    return _component_matches(c).select("owner").distinct().join(sim.both_directions(scored(c)).select("owner"), "owner", "left_anti")


@R.query(PAIRS + " SELECT a AS owner, b AS other, score FROM pr UNION ALL SELECT b, a, score FROM pr")
def joi13_neighbours(c: Catalogue) -> DataFrame:
    """Similar partitions from both ends."""
    return sim.both_directions(scored(c)).select("owner", "other", "score")


@R.query(PAIRS + " SELECT a, b, score FROM pr ORDER BY score DESC, a, b LIMIT 20")
def srt06_top_pairs(c: Catalogue) -> DataFrame:
    """The twenty most similar pairs."""
    return scored(c).select("a", "b", "score").orderBy(F.desc("score"), "a", "b").limit(20)


@R.query(SETS + " SELECT h, count(*) AS df, max(size) AS size FROM s GROUP BY h ORDER BY df DESC, h LIMIT 20")
def srt06_top_ubiquity(c: Catalogue) -> DataFrame:
    """The twenty contents that most partitions hold."""
    return content(c).groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.max("size").alias("size")).orderBy(F.desc("df"), "h").limit(20)


@R.query(PAIRS + " SELECT pr.* FROM pr WHERE a IN (SELECT id FROM p) AND b IN (SELECT id FROM p)")
def sim01_endpoints_exist(c: Catalogue) -> DataFrame:
    """Similar pairs both of whose partitions still exist."""
    ids = c.partitions.select("id")
    return scored(c).join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")


@R.query(PAIRS + " SELECT * FROM pr")
def pip02_incremental_refresh(c: Catalogue) -> DataFrame:
    """Pairs refreshed for the partitions of one file system: the same as a full rebuild.

    The pairs kept from before lie below the shared folder; only the first run over
    a folder of tables builds them.
    """
    dirty = c.partitions.where("filesystem = 'ADFS'").select(F.col("id").alias("owner"))
    path = f"{shared_dir(c.spark)}/pairs/{hashlib.sha256(c.folder.encode()).hexdigest()[:16]}"
    if live.latest(c.spark, path) is None:
        scored(c).write.mode("overwrite").parquet(f"{path}/v=0")
    return sim.refresh(live.latest(c.spark, path), content(c), dirty)


@R.query(COMPONENTS + """, cs AS (SELECT co.owner, co.root, x.h, x.size FROM co JOIN cd x ON x.owner = co.owner AND x.root = co.root)
SELECT cs.owner, cs.root, count(*) AS n_files, sum(cs.size)::BIGINT AS n_bytes FROM cs GROUP BY ALL""")
def joi18_files_under_components(c: Catalogue) -> DataFrame:
    """Content below each component, by the exploded ancestors of every path instead of a prefix comparison."""
    files = hashable(c)
    below = files.select("owner", "h", "size", F.explode(paths.ancestors("path", 4)).alias("root")).groupBy("owner", "root", "h").agg(F.min("size").alias("size"))
    return sim.components(files).select("owner", "root").join(below, ["owner", "root"]).groupBy("owner", "root").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("n_bytes"))
