"""Queries of the curation operators over the tables at hand: embeddings stand for pixel patches, customers for scored
stills, documents for items of datasets (their source), orders and line items for cards, files and boxes, events for
job logs and masks. Every query reads its whole tables. The SQL beside each is written independently for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions import thresholds as T
from ..operators import agreement, catalog, geometry, kernels, library, logs, marks, quality, selection, spreads
from ..streaming import progress as streaming

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Stills: measurements of patches.

PATCH_SQL = """
px AS (SELECT vec_id, embedding AS e, list_transform(embedding, lambda x: greatest(0.0::DOUBLE, least(255.0::DOUBLE, 128 + 400 * x::DOUBLE))) AS p FROM embeddings),
lap AS (SELECT vec_id, e, p, list_transform(range(64), lambda k:
  p[(k // 8) * 8 + abs(k % 8 - 1) + 1] + p[(k // 8) * 8 + (7 - abs(7 - (k % 8 + 1))) + 1]
  + p[abs(k // 8 - 1) * 8 + k % 8 + 1] + p[(7 - abs(7 - (k // 8 + 1))) * 8 + k % 8 + 1] - 4 * p[k + 1]) AS l FROM px),
m AS (SELECT vec_id, e, p, list_avg(p) AS mean, len(list_filter(p, lambda x: x < 15 OR x > 240)) / 64.0 AS clipped,
  abs(list_avg(list_transform(list_filter(range(64), lambda k: k % 8 < 4), lambda k: p[k + 1]))
    - list_avg(list_transform(list_filter(range(64), lambda k: k % 8 >= 4), lambda k: p[k + 1]))) / 255.0 AS split,
  list_var_pop(l) AS variance FROM lap)"""


def patches(spark, sf_dir):
    px = F.transform("embedding", lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), 128 + 400 * x.cast("double"))))
    return kernels.measured(table(spark, sf_dir, "embeddings").withColumn("px", px))


@query("pixel_stats", f"WITH {PATCH_SQL} SELECT vec_id, round(mean, 6) AS mean, round(clipped, 6) AS clipped, round(split, 6) AS split, round(variance, 4) AS variance FROM m")
def pixel_stats(spark, sf_dir):
    return patches(spark, sf_dir).select("vec_id", *(F.round(c, 6).alias(c) for c in ("mean", "clipped", "split")), F.round("variance", 4).alias("variance"))


@query("histogram", f"WITH {PATCH_SQL} SELECT label, floor(x * 16 / 256)::BIGINT AS bin, count(*) AS n FROM (SELECT label, unnest(p) AS x FROM px JOIN embeddings USING (vec_id)) GROUP BY ALL")
def histogram(spark, sf_dir):
    return kernels.histogram(patches(spark, sf_dir), ["label"])


def stills(spark, sf_dir):
    e = lambda k: F.col("embedding")[k].cast("double")
    features = patches(spark, sf_dir).withColumns({
        "name": F.concat(F.lit("Still_"), F.col("vec_id").cast("string")), "eyes": F.abs(e(0)) * 600, "box_side": F.abs(e(1)) * 900,
        "image_side": F.when(F.col("vec_id") % 7 == 0, 200.0).otherwise(800.0),
        "yaw": F.when(F.col("vec_id") % 11 != 0, e(2) * 300), "pitch": F.when(F.col("vec_id") % 13 != 0, e(3) * 100),
        "face_share": F.abs(e(4)) * 2, "eyes_share": F.abs(e(5)) / 2,
    })
    return quality.scored(features)


STILLS_SQL = PATCH_SQL + """,
f AS (SELECT vec_id, mean, clipped, split, variance, abs(e[1]::DOUBLE) * 600 AS eyes, abs(e[2]::DOUBLE) * 900 AS box, CASE WHEN vec_id % 7 = 0 THEN 200.0 ELSE 800.0 END AS side,
  CASE WHEN vec_id % 11 <> 0 THEN e[3]::DOUBLE * 300 END AS yaw, CASE WHEN vec_id % 13 <> 0 THEN e[4]::DOUBLE * 100 END AS pitch, abs(e[5]::DOUBLE) * 2 AS face_share, abs(e[6]::DOUBLE) / 2 AS eyes_share FROM m),
t AS (SELECT *, greatest(0, least(1, (ln(1 + variance) - ln(41)) / (ln(351) - ln(41)))) AS s_sharp,
  least(CASE WHEN side < 256 THEN 0.4 ELSE 1 END, greatest(0, least(1, CASE WHEN eyes > 0 THEN (eyes - 40) / 120 ELSE (box - 80) / 240 END))) AS s_face,
  exp(-0.5 * ((mean - 128) / 55) ** 2) * greatest(0, 1 - 8 * clipped) * greatest(0, 1 - 2.5 * split) AS s_light,
  CASE WHEN yaw IS NULL AND pitch IS NULL THEN 1.0 ELSE greatest(0.35, greatest(0, 1 - coalesce(abs(yaw), 0) / 75) * greatest(0, 1 - coalesce(abs(pitch), 0) / 40)) END AS s_pose FROM f),
r AS (SELECT *, 100 * s_sharp * s_face * s_light * s_pose AS raw, least(s_sharp, s_face, s_light, s_pose) AS worst FROM t),
s AS (SELECT vec_id, 'Still_' || vec_id AS name, round_even(raw, 1) AS score, mean, clipped, split, yaw, pitch, s_sharp,
  CASE WHEN raw >= 20 AND worst >= 0.35 THEN 'ok' WHEN s_sharp = worst THEN 'blurry' WHEN s_face = worst THEN 'face_too_small' WHEN s_light > worst THEN 'profile'
    WHEN mean < 90 THEN 'dark' WHEN mean > 170 OR (clipped > 0.08 AND mean >= 128) THEN 'blown' WHEN split > 0.12 THEN 'split_light' WHEN mean < 128 THEN 'dark' ELSE 'blown' END AS reason,
  CASE WHEN face_share >= 0.38 OR eyes_share >= 0.14 THEN 'closeup' WHEN face_share >= 0.16 OR eyes_share >= 0.06 THEN 'medium' ELSE 'full' END AS scale,
  CASE WHEN yaw IS NULL THEN 'unknown' WHEN abs(yaw) < 18 THEN 'front' ELSE CASE WHEN abs(yaw) >= 48 THEN 'profile-' ELSE 'three-quarter-' END || CASE WHEN yaw >= 0 THEN 'right' ELSE 'left' END END AS pose_bin FROM r)"""


@query("score_rank", f"WITH {STILLS_SQL} SELECT label, name, score, reason, scale, pose_bin, row_number() OVER (PARTITION BY label ORDER BY score DESC NULLS LAST, lower(name), name) AS rank FROM s JOIN embeddings USING (vec_id)")
def score_rank(spark, sf_dir):
    return quality.ranked(stills(spark, sf_dir), ["label"]).select("label", "name", "score", "reason", "scale", "pose_bin", "rank")


@query("score_band", f"WITH {STILLS_SQL} SELECT CASE WHEN score >= 20 THEN 'hi' WHEN score >= 8 THEN 'mid' ELSE 'lo' END AS band, count(*) AS n, count(*) FILTER (reason <> 'ok') AS flagged FROM s GROUP BY ALL")
def score_band(spark, sf_dir):
    return stills(spark, sf_dir).groupBy("band").agg(F.count("*").alias("n"), F.count_if(F.col("reason") != "ok").alias("flagged"))


CUSTOMERS_SQL = """
c AS (SELECT c_nationkey AS nation, c_name AS name, round_even(abs(c_acctbal) / 100, 1) AS score, c_acctbal / 60 AS yaw, (c_custkey % 40) - 20.0 AS pitch,
  CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'closeup' WHEN c_mktsegment = 'MACHINERY' THEN 'medium' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'full' END AS scale,
  CASE c_custkey % 9 WHEN 0 THEN 'blurry' WHEN 1 THEN 'dark' WHEN 2 THEN 'face_too_small' WHEN 3 THEN 'not_image' ELSE 'ok' END AS reason FROM customer),
b AS (SELECT *, CASE WHEN abs(yaw) < 18 THEN 'front' ELSE CASE WHEN abs(yaw) >= 48 THEN 'profile-' ELSE 'three-quarter-' END || CASE WHEN yaw >= 0 THEN 'right' ELSE 'left' END END AS pose_bin FROM c)"""


def customers(spark, sf_dir):
    seg = F.col("c_mktsegment")
    scale = F.when(seg.isin("AUTOMOBILE", "BUILDING"), "closeup").when(seg == "MACHINERY", "medium").when(seg == "HOUSEHOLD", "full")
    kind = F.col("c_custkey") % 9
    reason = F.when(kind == 0, "blurry").when(kind == 1, "dark").when(kind == 2, "face_too_small").when(kind == 3, "not_image").otherwise("ok")
    return table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"), F.bround(F.abs("c_acctbal") / 100, 1).alias("score"),
        (F.col("c_acctbal") / 60).alias("yaw"), ((F.col("c_custkey") % 40) - 20.0).alias("pitch"), scale.alias("scale"), reason.alias("reason"),
        F.lit(0.5).alias("s_sharp")).withColumn("pose_bin", X.pose_bin(F.col("yaw")))


CROWD_SQL = """
k AS (SELECT nation, coalesce(scale, 'closeup') AS scale, pose_bin, count(*) AS n FROM b WHERE score > 0 GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY nation)::BIGINT AS total FROM k)"""


@query("crowding", f"WITH {CUSTOMERS_SQL}, {CROWD_SQL} SELECT nation, scale, pose_bin, n, total, round(n / total, 6) AS share FROM w WHERE total >= 3 AND n >= 4 AND n / total >= 0.3")
def crowding(spark, sf_dir):
    return quality.crowding(customers(spark, sf_dir), ["nation"]).withColumn("share", F.round("share", 6))


@query("bin_histograms", f"WITH {CUSTOMERS_SQL} SELECT nation, scale, pose_bin, count(*) AS n FROM b GROUP BY GROUPING SETS ((nation, scale), (nation, pose_bin), (nation, scale, pose_bin))")
def bin_histograms(spark, sf_dir):
    return quality.histograms(customers(spark, sf_dir), ["nation"])


@query("best_per_bin", f"WITH {CUSTOMERS_SQL} SELECT nation, pose_bin, name, score FROM b QUALIFY row_number() OVER (PARTITION BY nation, pose_bin ORDER BY score DESC NULLS LAST, lower(name), name) = 1")
def best_per_bin(spark, sf_dir):
    return quality.best_per_bin(customers(spark, sf_dir), ["nation"]).select("nation", "pose_bin", "name", "score")


@query("advise", f"""WITH {CUSTOMERS_SQL}, {CROWD_SQL},
g AS (SELECT nation, count(*) FILTER (reason <> 'not_image') AS images, count(*) FILTER (reason <> 'not_image' AND score > 0) AS faced,
  count(*) FILTER (reason <> 'not_image' AND score >= 8) AS usable, count(*) FILTER (reason = 'blurry' AND score > 0) AS soft, count(*) FILTER (reason = 'dark' AND score > 0) AS lit,
  count(*) FILTER (reason <> 'not_image' AND score > 0 AND (reason = 'face_too_small' OR scale = 'full')) AS tiny,
  count(*) FILTER (reason <> 'not_image' AND score > 0 AND scale = 'closeup') AS cu, count(*) FILTER (reason <> 'not_image' AND score > 0 AND scale = 'medium') AS md,
  count(*) FILTER (reason <> 'not_image' AND score > 0 AND scale = 'full') AS fu FROM b GROUP BY nation),
have AS (SELECT DISTINCT nation, pose_bin FROM b WHERE reason <> 'not_image' AND score > 0 AND scale = 'closeup'),
poses AS (SELECT * FROM (VALUES ('front', 3, 'need'), ('three-quarter-left', 4, 'need'), ('three-quarter-right', 5, 'need'), ('profile-left', 6, 'improve'), ('profile-right', 7, 'improve')) v(pose, ord, level)),
tips AS (
  SELECT nation, 'need' AS level, 'empty' AS id, 0 AS ord FROM g WHERE images = 0
  UNION ALL SELECT nation, 'need', 'count', 2 FROM g WHERE images > 0 AND usable < 8
  UNION ALL SELECT nation, level, 'cu_' || pose, ord FROM g, poses WHERE images > 0 AND NOT EXISTS (SELECT 1 FROM have h WHERE h.nation = g.nation AND h.pose_bin = pose)
  UNION ALL SELECT nation, 'need', 'medium', 8 FROM g WHERE images > 0 AND md < 1
  UNION ALL SELECT nation, 'improve', 'medium2', 8 FROM g WHERE images > 0 AND md = 1
  UNION ALL SELECT nation, 'improve', 'full', 9 FROM g WHERE images > 0 AND fu < 1
  UNION ALL SELECT nation, CASE WHEN n / total >= 0.4 THEN 'need' ELSE 'improve' END, 'crowd_' || scale || '_' || pose_bin, 1000 + row_number() OVER (PARTITION BY nation ORDER BY n DESC, scale, pose_bin)
    FROM w WHERE total >= 3 AND n >= 4 AND n / total >= 0.3
  UNION ALL SELECT nation, 'need', 'sharp', 2000 FROM g WHERE images > 0 AND (soft >= 3 OR soft / greatest(1, faced) >= 0.4)
  UNION ALL SELECT nation, 'improve', 'light', 2001 FROM g WHERE images > 0 AND (lit >= 3 OR lit / greatest(1, faced) >= 0.4)
  UNION ALL SELECT nation, 'need', 'tighter', 2002 FROM g WHERE images > 0 AND cu < 5 AND tiny > 0),
a AS (SELECT * FROM tips UNION ALL SELECT nation, 'ok', 'balanced', 0 FROM g WHERE nation NOT IN (SELECT nation FROM tips))
SELECT nation, level, id, row_number() OVER (PARTITION BY nation ORDER BY CASE level WHEN 'need' THEN 0 WHEN 'improve' THEN 1 ELSE 2 END, ord) AS place FROM a QUALIFY place <= 10""")
def advise(spark, sf_dir):
    return quality.advise(customers(spark, sf_dir), ["nation"])


@query("pick_diverse", f"""WITH RECURSIVE {CUSTOMERS_SQL},
pool AS (SELECT nation, name, score, coalesce(yaw, 0) AS yaw, coalesce(pitch, 0) AS pitch, coalesce(scale, '') AS scale, pose_bin, row_number() OVER (PARTITION BY nation ORDER BY score DESC, lower(name), name) AS k, count(*) OVER (PARTITION BY nation) AS n FROM b WHERE score > 0),
slots AS (SELECT row_number() OVER (ORDER BY part, o, i) AS t, * FROM (
  SELECT 1 AS part, o, 1 AS i, pose, NULL AS scale FROM (VALUES (1, 'front'), (2, 'three-quarter-left'), (3, 'three-quarter-right'), (4, 'profile-left'), (5, 'profile-right')) v(o, pose)
  UNION ALL SELECT 2, o, i, NULL, s FROM (VALUES (1, 'closeup', 7), (2, 'medium', 2), (3, 'full', 1)) v(o, s, quota), range(1, 8) r(i) WHERE i <= quota
  UNION ALL SELECT 3, 1, i, NULL, NULL FROM range(1, 11) r(i))),
state AS (SELECT 0::BIGINT AS t, nation, name, score, yaw, pitch, scale, pose_bin, k, NULL::DOUBLE AS near, 0::BIGINT AS alike, NULL::BIGINT AS place, 0::BIGINT AS done, 0::BIGINT AS boots FROM pool WHERE n > 10
  UNION ALL
  SELECT t, nation, name, score, yaw, pitch, scale, pose_bin, k, CASE WHEN taken THEN least(coalesce(near, 1e300), sqrt((yaw - y) ** 2 + (0.6 * (pitch - p)) ** 2)) ELSE near END,
    alike + CASE WHEN taken AND scale = sc THEN 1 ELSE 0 END, CASE WHEN pick THEN done + 1 ELSE place END, done + CASE WHEN taken THEN 1 ELSE 0 END, CASE WHEN t <= 5 THEN done + CASE WHEN taken THEN 1 ELSE 0 END ELSE boots END
  FROM (SELECT *, max(CASE WHEN pick THEN 1 ELSE 0 END) OVER g = 1 AS taken, max(CASE WHEN pick THEN yaw END) OVER g AS y, max(CASE WHEN pick THEN pitch END) OVER g AS p, max(CASE WHEN pick THEN scale END) OVER g AS sc
    FROM (SELECT *, ok AND row_number() OVER (PARTITION BY nation ORDER BY ok DESC, CASE WHEN t <= 5 THEN 0 ELSE gain END DESC, k) = 1 AS pick
      FROM (SELECT s.t + 1 AS t, nation, name, score, yaw, pitch, s.scale, pose_bin, k, near, alike, place, done, boots, score + CASE WHEN done > 0 THEN 10 * least(near / 30, 2.5) - 3 * alike ELSE 0 END AS gain,
          place IS NULL AND done < 10 AND CASE q.part WHEN 1 THEN s.scale = 'closeup' AND pose_bin = q.pose WHEN 2 THEN s.scale = q.scale AND (q.scale <> 'closeup' OR q.i > boots) ELSE true END AS ok
        FROM state s JOIN slots q ON q.t = s.t + 1)) WINDOW g AS (PARTITION BY nation)))
SELECT nation, name, place FROM state WHERE t = 25 AND place IS NOT NULL UNION ALL SELECT nation, name, k FROM pool WHERE n <= 10""")
def pick_diverse(spark, sf_dir):
    return quality.pick_diverse(customers(spark, sf_dir), ["nation"])


@query("price_spread", """SELECT l_returnflag, l_linenumber, count(*) AS n, round(max(l_extendedprice), 6) AS top, round(median(l_extendedprice), 6) AS median, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90, round(stddev_pop(l_extendedprice), 4) AS deviation
FROM lineitem GROUP BY 1, 2""")
def price_spread(spark, sf_dir):
    """A few groups that have all rows."""
    got = spreads.spread(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linenumber"], F.col("l_extendedprice"))
    return got.select("l_returnflag", "l_linenumber", "n", *(F.round(c, 6).alias(c) for c in ("top", "median", "p90")), F.round("deviation", 4).alias("deviation"))


# Catalog: documents as items of their source.


def items(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.select("doc_id", "source", "lang", "n_chars").join(labels, "doc_id", "left").select(
        F.col("source").alias("slug"), F.col("doc_id").alias("pos"), F.coalesce(F.col("quality") == 1, F.lit(True)).alias("enabled"),
        F.when(F.col("doc_id") % 5 == 0, "video").otherwise("image").alias("kind"), (F.col("doc_id") % 17 != 0).alias("present"),
        F.col("n_chars").alias("short_side"), F.when(F.col("lang") == "en", "front").when(F.col("lang") == "de", "profile").when(F.col("lang") == "fr", "other").alias("shot"),
        F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file"), F.col("n_chars").cast("string").alias("size"))


ITEMS_SQL = """i AS (SELECT source AS slug, doc_id AS pos, coalesce(quality = 1, true) AS enabled, CASE WHEN doc_id % 5 = 0 THEN 'video' ELSE 'image' END AS kind, doc_id % 17 <> 0 AS present,
  n_chars, CASE lang WHEN 'en' THEN 'front' WHEN 'de' THEN 'profile' WHEN 'fr' THEN 'other' END AS shot, 'f' || doc_id AS file FROM documents LEFT JOIN labels USING (doc_id))"""
HASH_SQL = ITEMS_SQL + """, t AS (SELECT slug, file || ',' || n_chars AS said, row_number() OVER (PARTITION BY slug ORDER BY pos) - 1 AS k FROM i WHERE enabled AND present),
leaf AS (SELECT slug, k // 1024 AS leaf, sha256(string_agg(said, ';' ORDER BY k)) AS digest FROM t GROUP BY 1, 2),
branch AS (SELECT slug, leaf // 1024 AS branch, sha256(string_agg(digest, ';' ORDER BY leaf)) AS digest FROM leaf GROUP BY 1, 2),
root AS (SELECT slug, string_agg(digest, ';' ORDER BY branch) AS digests FROM branch GROUP BY 1),
h AS (SELECT slug, sha256(concat_ws(';', 'v1', coalesce(any_value(digests), ''))) AS hash, count(*) FILTER (enabled AND present) AS enabled_files FROM i LEFT JOIN root USING (slug) GROUP BY slug)"""


@query("dataset_cards", f"WITH {ITEMS_SQL} SELECT slug, count(*) FILTER (present AND kind = 'image') AS images, count(*) FILTER (present AND kind = 'video') AS videos, count(*) FILTER (present AND enabled) AS enabled, count(*) FILTER (present) AS total, count(*) FILTER (present AND kind = 'image' AND n_chars < 1024) AS low_res FROM i GROUP BY slug")
def dataset_cards(spark, sf_dir):
    return catalog.cards(items(spark, sf_dir))


@query("mix_counts", f"WITH {ITEMS_SQL} SELECT slug, count(*) FILTER (enabled AND shot = 'front') AS front, 0::BIGINT AS three_quarter, count(*) FILTER (enabled AND shot = 'profile') AS profile, 0::BIGINT AS full_body, count(*) FILTER (enabled AND (shot IS NULL OR shot = 'other')) AS untagged FROM i WHERE kind = 'image' GROUP BY slug")
def mix_counts(spark, sf_dir):
    return catalog.mix_counts(items(spark, sf_dir).where("kind = 'image'"))


@query("count_advice", f"WITH {ITEMS_SQL}, k AS (SELECT slug, count(*) AS n, CASE WHEN slug < 'src2' THEN 'identity' ELSE 'style' END AS concept FROM i GROUP BY slug) SELECT slug, n, CASE WHEN concept = 'identity' AND n NOT BETWEEN 8 AND 20 OR concept <> 'identity' AND n NOT BETWEEN 6 AND 12 THEN 'warn' ELSE '' END AS advice FROM k")
def count_advice(spark, sf_dir):
    n = items(spark, sf_dir).groupBy("slug").agg(F.count("*").alias("n"))
    return n.withColumn("advice", X.count_advice(F.col("n"), F.when(F.col("slug") < "src2", "identity").otherwise("style")))


@query("cover_pick", f"WITH {ITEMS_SQL} SELECT slug, file FROM i WHERE kind = 'image' QUALIFY row_number() OVER (PARTITION BY slug ORDER BY (pos % 97 = 3) DESC, enabled DESC, pos) = 1")
def cover_pick(spark, sf_dir):
    return catalog.cover(items(spark, sf_dir).where("kind = 'image'"), F.col("pos") % 97 == 3).select("slug", "file")


@query("content_hash", f"WITH {HASH_SQL} SELECT slug, hash, enabled_files FROM h")
def content_hash(spark, sf_dir):
    return catalog.content_hash(items(spark, sf_dir), F.lit("v1"))


@query("dirty_flag", f"WITH {HASH_SQL} SELECT slug, CASE WHEN slug LIKE '%1' THEN enabled_files > 0 WHEN slug LIKE '%2' THEN true ELSE false END AS dirty FROM h")
def dirty_flag(spark, sf_dir):
    now = catalog.content_hash(items(spark, sf_dir), F.lit("v1"))
    stored = now.where("slug NOT LIKE '%1'").select("slug", F.when(F.col("slug").like("%2"), "old").otherwise(F.col("hash")).alias("stored_hash"))
    return catalog.dirty(now, stored).select("slug", "dirty")


@query("reconcile", """
WITH m AS (SELECT o_custkey AS slug, o_orderkey AS file, o_orderkey % 3 <> 0 AS enabled FROM orders WHERE o_orderpriority < '3'),
f AS (SELECT DISTINCT o_custkey AS slug, l_orderkey AS file FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber > 1),
r AS (SELECT m.slug, m.file, m.enabled, 0 AS new, m.file AS pos FROM m SEMI JOIN f USING (slug, file)
  UNION ALL SELECT f.slug, f.file, true, 1, NULL FROM f ANTI JOIN m USING (slug, file))
SELECT slug, file::VARCHAR AS file, enabled, row_number() OVER (PARTITION BY slug ORDER BY new, pos, file::VARCHAR) AS pos FROM r""")
def reconcile(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("slug"), F.col("o_orderkey").alias("pos"), "o_orderpriority")
    manifest = orders.where("o_orderpriority < '3'").select("slug", F.col("pos").cast("string").alias("file"), "pos", (F.col("pos") % 3 != 0).alias("enabled"))
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber > 1").select(F.col("l_orderkey").alias("pos"))
    files = lines.join(orders, "pos").select("slug", F.col("pos").cast("string").alias("file"))
    return catalog.reconcile(manifest, files).select("slug", "file", "enabled", "pos")


@query("card_search", "SELECT doc_id, source FROM documents WHERE contains(lower(concat_ws(' ', text, lang, source)), 'license') AND (source = 'src1' OR source LIKE 'src1/%')")
def card_search(spark, sf_dir):
    return catalog.search(table(spark, sf_dir, "documents"), " License ", ("text", "lang", "source"), "src1", "source").select("doc_id", "source")


@query("first_seen_groups", "SELECT role, count(*) AS n, min(conv_id * 1000 + turn) AS first_seen FROM conversations GROUP BY role")
def first_seen_groups(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("first_seen"))


@query("unique_names", """WITH w AS (SELECT p_partkey AS ord, p_brand AS stem FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY lower(stem) ORDER BY ord) AS k FROM w)
SELECT ord, CASE WHEN k < 3 THEN stem || CASE WHEN k = 1 THEN '' ELSE '-2' END ELSE stem || '-' || (k + 1) END AS name FROM k""")
def unique_names(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    taken = part.select(F.concat("p_brand", F.lit("-3")).alias("name")).distinct()
    return catalog.unique_names(part.select(F.col("p_partkey").alias("ord"), F.col("p_brand").alias("stem")), taken).select("ord", "name")


# Names and paths.


@query("slug_names", r"""WITH s AS (SELECT p_partkey, p_name, coalesce(nullif(trim(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'dataset') AS slug FROM part)
SELECT p_partkey, slug, 'set_base_' || replace(slug, '-', '') || '_v1_artefact' AS artefact, 'x_v' || (p_partkey % 9 + 1) || '_artefact' AS bumped, trim(regexp_replace(p_name, '[^\w.\-]+', '_', 'g'), '._') AS safe FROM s""")
def slug_names(spark, sf_dir):
    name = F.col("p_name")
    version = F.concat(F.lit("x_v"), (F.col("p_partkey") % 9).cast("string"), F.lit("_artefact"))
    return table(spark, sf_dir, "part").select("p_partkey", X.slug(name).alias("slug"), X.artefact_name(name, F.lit(" se-t ")).alias("artefact"), X.next_version(version).alias("bumped"), X.safe_name(name).alias("safe"))


PATH_SQL = r"p AS (SELECT page_id, regexp_replace(url, '^https?://[^/]*/?', '') AS path FROM pages)"


def paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^https?://[^/]*/?", "").alias("path"))


@query("folder_ancestors", rf"WITH {PATH_SQL}, s AS (SELECT list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM p), a AS (SELECT DISTINCT array_to_string(parts[1:k], '/') AS folder FROM (SELECT parts, unnest(range(1, len(parts) + 1)) AS k FROM s)) SELECT folder, len(string_split(folder, '/'))::BIGINT AS depth FROM a")
def folder_ancestors(spark, sf_dir):
    return library.ancestors(paths(spark, sf_dir))


@query("prefix_remap", rf"WITH {PATH_SQL} SELECT page_id, CASE WHEN path = 'fr' THEN 'x/fr' WHEN starts_with(path, 'fr/') THEN 'x/fr' || substr(path, 3) ELSE path END AS path FROM p")
def prefix_remap(spark, sf_dir):
    return paths(spark, sf_dir).select("page_id", X.moved(F.col("path"), "fr", "x/fr").alias("path"))


@query("hub_url", rf"WITH {PATH_SQL} SELECT page_id, array_to_string(list_transform(string_split(path || '/a b*~é', '/'), lambda x: url_encode(x)), '/') AS url FROM p")
def hub_url(spark, sf_dir):
    return paths(spark, sf_dir).select("page_id", X.url_path(F.concat("path", F.lit("/a b*~é"))).alias("url"))


@query("subfolders", rf"WITH {PATH_SQL}, q AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '..\' || path WHEN 1 THEN ' ./' || path || '//z ' WHEN 2 THEN path || '/.git' ELSE '' END AS raw FROM p), s AS (SELECT page_id, list_filter(list_transform(string_split(replace(raw, '\', '/'), '/'), lambda x: trim(x)), lambda x: x NOT IN ('', '.')) AS parts FROM q) SELECT page_id, CASE WHEN len(list_filter(parts, lambda x: starts_with(x, '.') OR regexp_matches(x, '[<>:\"|?*]'))) = 0 THEN array_to_string(parts, '/') END AS folder FROM s")
def subfolders(spark, sf_dir):
    kind, path = F.col("page_id") % 4, F.col("path")
    raw = F.when(kind == 0, F.concat(F.lit("..\\"), path)).when(kind == 1, F.concat(F.lit(" ./"), path, F.lit("//z "))).when(kind == 2, F.concat(path, F.lit("/.git"))).otherwise("")
    return paths(spark, sf_dir).select("page_id", X.subfolder(raw).alias("folder"))


@query("fmt_bytes", "SELECT doc_id, CASE WHEN b = 0 THEN '0 B' WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN format('{:.1f} KB', floor(b / 1024 * 10 + 0.5) / 10) ELSE format('{:.2f} MB', floor(b / 1048576 * 100 + 0.5) / 100) END AS size FROM (SELECT doc_id, n_chars * (doc_id % 1000) AS b FROM documents)")
def fmt_bytes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.bytes_text(F.col("n_chars") * (F.col("doc_id") % 1000)).alias("size"))


@query("ui_labels", "SELECT doc_id, CASE WHEN length(line) > 72 THEN line[1:72] || '…' ELSE line END AS preview, replace(replace(replace(replace(replace(source || '<&\">''', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS label FROM (SELECT doc_id, source, string_split(trim(text), chr(10))[1] AS line FROM documents)")
def ui_labels(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.preview(F.col("text")).alias("preview"), X.html_escaped(F.concat("source", F.lit("<&\">'"))).alias("label"))


@query("token_count", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN CASE WHEN p_size > 0 THEN 2 * p_size END WHEN p_partkey % 7 = 0 THEN NULL ELSE greatest(1, p_partkey % 4) * (p_size // 2) * ((p_partkey % 90 + 1) // 2) END::BIGINT AS tokens FROM part")
def token_count(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    audio = key % 5 == 0
    return table(spark, sf_dir, "part").select("p_partkey", X.token_count(
        F.when(audio, "audio"), F.when(audio, size).otherwise((key % 4).cast("string")), F.when(key % 7 == 0, "tall").otherwise(size), (key % 90 + 1).cast("string")).alias("tokens"))


@query("json_props", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


# Library.


@query("index_lookup", """WITH e AS (SELECT n_name AS key, 'n' || n_nationkey AS value, n_nationkey AS ord FROM nation UNION ALL SELECT 'S' || (s_suppkey % 40), CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 's' || s_suppkey END, 1000 + s_suppkey FROM supplier),
x AS (SELECT key, arg_max(value, ord) AS value FROM e GROUP BY key HAVING arg_max(value, ord) <> '')
SELECT s_suppkey, coalesce(a.value, b.value) AS found FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN x a ON a.key = 'S' || s_suppkey LEFT JOIN x b ON b.key = n_name""")
def index_lookup(spark, sf_dir):
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    own = nation.select(F.col("n_name").alias("key"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("value"), F.col("n_nationkey").cast("long").alias("ord"))
    key = F.col("s_suppkey")
    more = supplier.select(F.concat(F.lit("S"), (key % 40).cast("string")).alias("key"), F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("s"), key.cast("string"))).alias("value"), (key + 1000).alias("ord"))
    rows = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat(F.lit("S"), key.cast("string")).alias("a"), F.col("n_name").alias("b"))
    return library.lookup(rows, own.unionByName(more), ("a", "b")).select("s_suppkey", "found")


@query("studio_status", """WITH l AS (SELECT l_orderkey AS key, sum(l_linenumber)::BIGINT AS bytes FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), r AS (SELECT l_orderkey AS key, sum(l_linenumber)::BIGINT AS bytes FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
SELECT o_orderkey AS key, l.bytes AS local_bytes, r.bytes AS remote_bytes, CASE WHEN l.bytes IS NULL THEN 'remote_only' WHEN r.bytes IS NULL THEN 'missing' WHEN l.bytes = r.bytes THEN 'in_sync' ELSE 'stale' END AS status
FROM orders LEFT JOIN l ON l.key = o_orderkey LEFT JOIN r ON r.key = o_orderkey WHERE l.key IS NOT NULL OR r.key IS NOT NULL""")
def studio_status(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber", "l_returnflag", "l_linestatus")
    side = lambda c: lines.where(c).groupBy("key").agg(F.sum("l_linenumber").alias("bytes"))
    cards = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    return library.status(cards, side("l_returnflag = 'A'"), side("l_linestatus = 'O'"))


def sync_cards(spark, sf_dir):
    k = F.col("c_custkey")
    size = (k % 50 + 1).cast("long")
    return table(spark, sf_dir, "customer").select(
        k.alias("key"), F.when(k % 2 == 0, "a").otherwise("b").alias("current"), F.when(k % 3 == 0, "a").otherwise("b").alias("dest"),
        F.when(k % 5 != 0, size).alias("local_bytes"), F.when(k % 7 < 3, size + F.when(k % 4 == 0, 1).otherwise(0)).alias("current_bytes"),
        F.when(k % 11 < 6, size + F.when(k % 13 == 0, 1).otherwise(0)).alias("dest_bytes"))


SYNC_SQL = """c AS (SELECT c_custkey AS key, c_custkey % 2 = 0 AS ca, c_custkey % 3 = 0 AS da, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 50 + 1 END AS l,
  CASE WHEN c_custkey % 7 < 3 THEN c_custkey % 50 + 1 + (c_custkey % 4 = 0)::INT END AS c, CASE WHEN c_custkey % 11 < 6 THEN c_custkey % 50 + 1 + (c_custkey % 13 = 0)::INT END AS d FROM customer),
a AS (SELECT key, CASE WHEN l IS NULL AND c IS NULL AND d IS NULL THEN 'skipped' WHEN c IS NOT NULL AND ca <> da THEN 'moved' WHEN d IS NULL THEN 'copied' WHEN l IS NOT NULL AND l <> d THEN 'replaced' ELSE 'kept' END AS action FROM c)"""


@query("sync_plan", f"WITH {SYNC_SQL} SELECT key, action FROM a")
def sync_plan(spark, sf_dir):
    return library.sync_plan(sync_cards(spark, sf_dir)).select("key", "action")


@query("sync_tally", f"WITH {SYNC_SQL} SELECT v.action, count(a.key) AS n FROM (VALUES ('skipped'), ('kept'), ('moved'), ('copied'), ('replaced')) v(action) LEFT JOIN a USING (action) GROUP BY 1")
def sync_tally(spark, sf_dir):
    return library.tally(library.sync_plan(sync_cards(spark, sf_dir)))


@query("unique_name_match", "WITH u AS (SELECT lower(p_name) AS k, min(p_partkey) AS match FROM part GROUP BY 1 HAVING count(*) = 1) SELECT p_partkey, match FROM part LEFT JOIN u ON upper(lower(p_name)) = upper(k)")
def unique_name_match(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return library.unique_match(part.select("p_partkey", F.upper("p_name").alias("name")), part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))).select("p_partkey", "match")


# Geometry: hourly buckets of events as a line of pixels, line items as boxes.

MASK_SQL = """t AS (SELECT event_type, floor(epoch(ts) / 3600)::BIGINT AS hour, 20 * count(*) FILTER (value > 40) >= 7 * count(*) AS mask FROM events GROUP BY 1, 2),
q AS (SELECT event_type, hour, hour - row_number() OVER (PARTITION BY event_type ORDER BY hour) AS g FROM t WHERE mask),
r AS (SELECT event_type, min(hour) AS s, max(hour) AS e FROM q GROUP BY event_type, g),
n AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY event_type ORDER BY s) - 1 <= 2 THEN 0 ELSE 1 END AS new FROM r),
z AS (SELECT event_type, min(s) AS s, max(e) AS e FROM (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY s) AS g FROM n) GROUP BY event_type, g)"""


def mask(spark, sf_dir):
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).alias("at")
    return table(spark, sf_dir, "events").groupBy("event_type", hour).agg((20 * F.count_if(F.col("value") > 40) >= 7 * F.count("*")).alias("mask"))


def mask_runs(spark, sf_dir):
    return geometry.runs(mask(spark, sf_dir), ["event_type"])


@query("runs", f'WITH {MASK_SQL} SELECT event_type, s AS start, e AS "end" FROM r')
def runs(spark, sf_dir):
    return mask_runs(spark, sf_dir)


@query("merged_runs", f'WITH {MASK_SQL} SELECT event_type, s AS start, e AS "end" FROM z WHERE e - s >= 1')
def merged_runs(spark, sf_dir):
    return geometry.merged(mask_runs(spark, sf_dir), ["event_type"], least=2)


@query("spans", f"""WITH {MASK_SQL}, b AS (SELECT event_type, s, e FROM z UNION ALL SELECT event_type, max(hour) + 1, max(hour) + 1 FROM t GROUP BY 1),
x AS (SELECT event_type, coalesce(lag(e) OVER (PARTITION BY event_type ORDER BY s, e) + 1, 0) AS start, s AS "end" FROM b) SELECT * FROM x WHERE "end" - start >= 1""")
def spans(spark, sf_dir):
    lengths = mask(spark, sf_dir).groupBy("event_type").agg((F.max("at") + 1).alias("length"))
    return geometry.spans(geometry.merged(mask_runs(spark, sf_dir), ["event_type"]), lengths, ["event_type"])


BOX_SQL = """d AS (SELECT DISTINCT l_orderkey AS page, l_partkey * 10 + l_linenumber AS id, (l_partkey % 37) / 50.0 AS x0, (l_suppkey % 29) / 40.0 AS y0, (l_partkey % 37) / 50.0 + l_quantity / 200 + 0.02 AS x1, (l_suppkey % 29) / 40.0 + l_linenumber / 20.0 AS y1, l_linenumber FROM lineitem),
b AS (SELECT page, id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, ['top', 'bottom', 'left', 'right'][min(l_linenumber) % 4 + 1] AS edge FROM d GROUP BY page, id)"""


def boxes(spark, sf_dir):
    x0, y0 = (F.col("l_partkey") % 37) / 50.0, (F.col("l_suppkey") % 29) / 40.0
    found = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("id"), x0.alias("x0"), y0.alias("y0"),
        (x0 + F.col("l_quantity") / 200 + 0.02).alias("x1"), (y0 + F.col("l_linenumber") / 20.0).alias("y1"), "l_linenumber")
    edge = F.element_at(F.array(*map(F.lit, T.EDGES)), F.min("l_linenumber") % 4 + 1)
    return found.groupBy("page", "id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), edge.alias("edge"))


@query("iou_pairs", f"""WITH {BOX_SQL}, p AS (SELECT p.page, p.id AS a, q.id AS b, least(p.x1, q.x1) - greatest(p.x0, q.x0) AS w, least(p.y1, q.y1) - greatest(p.y0, q.y0) AS h, (p.x1 - p.x0) * (p.y1 - p.y0) + (q.x1 - q.x0) * (q.y1 - q.y0) AS s FROM b p JOIN b q ON p.page = q.page AND p.id < q.id)
SELECT page, a, b, round(w * h / (s - w * h), 6) AS iou FROM p WHERE w > 0 AND h > 0 AND w * h / (s - w * h) >= 0.35""")
def iou_pairs(spark, sf_dir):
    return geometry.overlapping(boxes(spark, sf_dir), ["page"]).withColumn("iou", F.round("iou", 6))


@query("keep_rect", f"""WITH {BOX_SQL}, k AS (SELECT page, greatest(0, max(x1) FILTER (edge = 'left')) AS x0, greatest(0, max(y1) FILTER (edge = 'top')) AS y0, least(1, min(x0) FILTER (edge = 'right')) AS x1, least(1, min(y0) FILTER (edge = 'bottom')) AS y1 FROM b GROUP BY page),
s AS (SELECT *, x1 - x0 < 0.05 OR y1 - y0 < 0.05 AS small FROM k)
SELECT page, CASE WHEN small THEN 0 ELSE round_even(x0, 5) END AS x0, CASE WHEN small THEN 0 ELSE round_even(y0, 5) END AS y0, CASE WHEN small THEN 1 ELSE round_even(x1, 5) END AS x1, CASE WHEN small THEN 1 ELSE round_even(y1, 5) END AS y1 FROM s""")
def keep_rect(spark, sf_dir):
    return geometry.kept_rectangle(boxes(spark, sf_dir), ["page"])


@query("edge_strips", f"WITH {BOX_SQL} SELECT page, edge, round(min(x0), 6) AS x0, round(min(y0), 6) AS y0, round(max(x1), 6) AS x1, round(max(y1), 6) AS y1 FROM b GROUP BY page, edge")
def edge_strips(spark, sf_dir):
    return geometry.strips(boxes(spark, sf_dir), ["page"]).select("page", "edge", *(F.round(c, 6).alias(c) for c in geometry.BOX))


@query("without_slivers", f"WITH {BOX_SQL}, s AS (SELECT page, id, x1 - x0 AS w, y1 - y0 AS h FROM b), g AS (SELECT *, w >= 0.35 * median(w) OVER p AND h >= 0.35 * median(h) OVER p AND w * h >= 0.35 * median(w * h) OVER p AS good FROM s WINDOW p AS (PARTITION BY page)) SELECT page, id FROM g QUALIFY good OR NOT bool_or(good) OVER (PARTITION BY page)")
def without_slivers(spark, sf_dir):
    return geometry.without_slivers(boxes(spark, sf_dir), ["page"]).select("page", "id")


PIXEL_SQL = BOX_SQL + ", i AS (SELECT page, id, floor(x0 * 1000)::BIGINT AS x0, floor(y0 * 1000)::BIGINT AS y0, least(1200, floor(x1 * 1000))::BIGINT AS x1, least(1200, floor(y1 * 1000))::BIGINT AS y1 FROM b)"


def pixel_boxes(spark, sf_dir):
    whole = lambda c, top=None: F.floor(F.col(c) * 1000) if top is None else F.least(F.lit(top), F.floor(F.col(c) * 1000))
    return boxes(spark, sf_dir).select("page", "id", whole("x0").alias("x0"), whole("y0").alias("y0"), whole("x1", 1200).alias("x1"), whole("y1", 1200).alias("y1"))


@query("dominant_edge", f"""WITH {PIXEL_SQL}, o AS (SELECT page, id, list_filter([
  CASE WHEN y0 <= 120 THEN {{'l': -least(1200, 1200 - y1), 'd': y1, 'o': 0, 'e': 'top'}} END, CASE WHEN y1 >= 1080 THEN {{'l': -least(1200, y0), 'd': 1200 - y0, 'o': 1, 'e': 'bottom'}} END,
  CASE WHEN x0 <= 120 THEN {{'l': -least(1200, 1200 - x1), 'd': x1, 'o': 2, 'e': 'left'}} END, CASE WHEN x1 >= 1080 THEN {{'l': -least(1200, x0), 'd': 1200 - x0, 'o': 3, 'e': 'right'}} END], lambda z: z IS NOT NULL) AS near,
  [{{'d': x0, 'o': 0, 'e': 'left'}}, {{'d': 1200 - x1, 'o': 1, 'e': 'right'}}, {{'d': y0, 'o': 2, 'e': 'top'}}, {{'d': 1200 - y1, 'o': 3, 'e': 'bottom'}}] AS far FROM i)
SELECT page, id, coalesce(list_sort(near)[1].e, list_sort(far)[1].e) AS edge FROM o""")
def dominant_edge(spark, sf_dir):
    box = F.struct(*geometry.BOX)
    return pixel_boxes(spark, sf_dir).select("page", "id", X.dominant_edge(box, F.lit(1200), F.lit(1200)).alias("edge"))


@query("plausible_marks", f"""WITH {PIXEL_SQL} SELECT page, id FROM (SELECT *, x1 - x0 AS w, y1 - y0 AS h, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM i)
WHERE w >= 54 AND h >= 9 AND h <= 84 AND w <= 792 AND w * h <= 86400 AND (x0 <= 24 OR y0 <= 24 OR 1200 - x1 <= 24 OR 1200 - y1 <= 24)
AND ((cx <= 384 OR cx >= 816) AND (cy <= 192 OR cy >= 1008) OR h <= 90 AND w >= 192 AND (y0 <= 36 OR y1 >= 1164))""")
def plausible_marks(spark, sf_dir):
    return pixel_boxes(spark, sf_dir).where(X.plausible_mark(F.struct(*geometry.BOX), F.lit(1200), F.lit(1200))).select("page", "id")


@query("topmost_box", f"""WITH {BOX_SQL}, p AS (SELECT o_orderkey AS page, o_custkey AS point, (o_orderkey % 100) / 100 AS x, (o_custkey % 100) / 100 AS y FROM orders)
SELECT p.page, p.point, max(b.id) AS hit FROM p LEFT JOIN b ON p.page = b.page AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY ALL""")
def topmost_box(spark, sf_dir):
    at = lambda c: ((F.col(c) % 100) / 100)
    points = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), F.col("o_custkey").alias("point"), at("o_orderkey").alias("x"), at("o_custkey").alias("y"))
    return selection.hit(points, boxes(spark, sf_dir).withColumn("ord", F.col("id")), ["page"])


@query("default_method", "WITH m AS (SELECT l_orderkey AS sheet, l_linenumber AS ord, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT sheet, ord, n AS count FROM m QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY (n >= 2) DESC, ord) = 1")
def default_method(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("ord")).agg(F.count("*").alias("count"))
    return selection.default_method(found, ["sheet"])


@query("reading_order", f"""WITH RECURSIVE {PIXEL_SQL},
c AS (SELECT page, x0, y0, x1, y1, (y0 + y1) / 2 AS cy, greatest(20, 0.4 * median(y1 - y0) OVER (PARTITION BY page)) AS reach, row_number() OVER (PARTITION BY page ORDER BY (y0 + y1) / 2, x0, id) AS k FROM i),
f AS (SELECT page, 0::BIGINT AS k, []::DOUBLE[] AS sums, []::DOUBLE[] AS counts, 0::BIGINT AS at FROM (SELECT DISTINCT page FROM c)
  UNION ALL
  SELECT page, k, CASE WHEN fit = 0 THEN list_append(sums, cy) ELSE list_transform(range(1, len(sums) + 1), lambda j: sums[j] + CASE WHEN j = fit THEN cy ELSE 0 END) END,
    CASE WHEN fit = 0 THEN list_append(counts, 1.0) ELSE list_transform(range(1, len(counts) + 1), lambda j: counts[j] + CASE WHEN j = fit THEN 1 ELSE 0 END) END, CASE WHEN fit = 0 THEN len(sums) + 1 ELSE fit END
  FROM (SELECT f.page, c.k, c.cy, f.sums, f.counts, coalesce(list_position(list_transform(range(1, len(f.sums) + 1), lambda j: abs(c.cy - f.sums[j] / f.counts[j]) <= c.reach), true), 0) AS fit FROM f JOIN c ON c.page = f.page AND c.k = f.k + 1)),
last AS (SELECT page, arg_max(sums, k) AS sums, arg_max(counts, k) AS counts FROM f GROUP BY page)
SELECT f.page, row_number() OVER (PARTITION BY f.page ORDER BY l.sums[f.at] / l.counts[f.at], f.at, c.x0, c.k) AS ord, c.x0::DOUBLE AS x0, c.y0::DOUBLE AS y0, c.x1::DOUBLE AS x1, c.y1::DOUBLE AS y1
FROM f JOIN last l USING (page) JOIN c ON c.page = f.page AND c.k = f.k WHERE f.k > 0""")
def reading_order(spark, sf_dir):
    return geometry.reading_order(pixel_boxes(spark, sf_dir).withColumn("ord", F.col("id")), ["page"])


@query("box_merge", f"""WITH RECURSIVE {PIXEL_SQL}, l AS (SELECT page, list([x0, y0, x1, y1] ORDER BY id) AS boxes FROM i GROUP BY page),
m AS (SELECT page, boxes[1] AS cur, boxes[2:] AS rest, []::BIGINT[][] AS later, []::BIGINT[][] AS done, false AS grew, false AS ended FROM l
  UNION ALL
  SELECT page, CASE WHEN step = 'compare' AND joins THEN u WHEN step = 'next' THEN later[1] WHEN step = 'again' THEN list_append(done, cur)[1] ELSE cur END,
    CASE step WHEN 'compare' THEN rest[2:] WHEN 'next' THEN later[2:] WHEN 'again' THEN list_append(done, cur)[2:] ELSE rest END,
    CASE WHEN step = 'compare' AND NOT joins THEN list_append(later, rest[1]) WHEN step = 'compare' THEN later ELSE [] END,
    CASE step WHEN 'compare' THEN done WHEN 'again' THEN [] ELSE list_append(done, cur) END, CASE step WHEN 'compare' THEN grew OR joins WHEN 'again' THEN false ELSE grew END, step = 'end'
  FROM (SELECT *, CASE WHEN len(rest) > 0 THEN 'compare' WHEN len(later) > 0 THEN 'next' WHEN grew THEN 'again' ELSE 'end' END AS step,
      cur[1] - 12 <= rest[1][3] AND rest[1][1] - 12 <= cur[3] AND cur[2] - 12 <= rest[1][4] AND rest[1][2] - 12 <= cur[4] AND u[3] - u[1] <= 792 AND u[4] - u[2] <= 480 AS joins
    FROM (SELECT *, [least(cur[1], rest[1][1]), least(cur[2], rest[1][2]), greatest(cur[3], rest[1][3]), greatest(cur[4], rest[1][4])] AS u FROM m WHERE NOT ended)))
SELECT page, k AS ord, done[k][1]::DOUBLE AS x0, done[k][2]::DOUBLE AS y0, done[k][3]::DOUBLE AS x1, done[k][4]::DOUBLE AS y1 FROM (SELECT page, done, unnest(range(1, len(done) + 1)) AS k FROM m WHERE ended)""")
def box_merge(spark, sf_dir):
    return geometry.merged_boxes(pixel_boxes(spark, sf_dir).withColumn("ord", F.col("id")), ["page"], 1200, 1200, most=(0.66, 0.4))


@query("consensus", f"""WITH RECURSIVE {BOX_SQL},
x AS (SELECT page % 100 AS dataset, (page % 1000)::VARCHAR AS file, id, x0, y0, x1, y1, row_number() OVER (PARTITION BY page % 100 ORDER BY (page % 1000)::VARCHAR, id, x0, y0, x1, y1) AS k FROM b),
f AS (SELECT dataset, 0::BIGINT AS k, []::STRUCT(a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE)[] AS firsts, 0::BIGINT AS grp FROM (SELECT DISTINCT dataset FROM x)
  UNION ALL
  SELECT dataset, k, CASE WHEN fit = 0 THEN list_append(firsts, struct_pack(a := x0, b := y0, c := x1, d := y1)) ELSE firsts END, CASE WHEN fit = 0 THEN len(firsts) + 1 ELSE fit END
  FROM (SELECT f.dataset, x.k, x0, y0, x1, y1, firsts, coalesce(list_position(list_transform(firsts, lambda o: greatest(0, least(x1, o.c) - greatest(x0, o.a)) * greatest(0, least(y1, o.d) - greatest(y0, o.b))
      / (greatest(1e-9, (x1 - x0) * (y1 - y0)) + greatest(1e-9, (o.c - o.a) * (o.d - o.b)) - greatest(0, least(x1, o.c) - greatest(x0, o.a)) * greatest(0, least(y1, o.d) - greatest(y0, o.b))) >= 0.35), true), 0) AS fit
    FROM f JOIN x ON x.dataset = f.dataset AND x.k = f.k + 1)),
g AS (SELECT x.*, f.grp FROM x JOIN f ON f.dataset = x.dataset AND f.k = x.k),
files AS (SELECT DISTINCT dataset, file FROM x), size AS (SELECT dataset, count(*) AS n FROM files GROUP BY 1),
big AS (SELECT g.dataset, g.grp, count(*) AS count, arg_min(x0, k) AS x0, arg_min(y0, k) AS y0, arg_min(x1, k) AS x1, arg_min(y1, k) AS y1, any_value(n) AS n FROM g JOIN size USING (dataset) GROUP BY 1, 2 HAVING count(*) >= greatest(2, floor(0.35 * any_value(n))) AND any_value(n) > 1),
has AS (SELECT big.dataset, big.grp, g.file FROM big JOIN g ON g.dataset = big.dataset WHERE g.grp = big.grp OR greatest(0, least(g.x1, big.x1) - greatest(g.x0, big.x0)) * greatest(0, least(g.y1, big.y1) - greatest(g.y0, big.y0))
  / (greatest(1e-9, (g.x1 - g.x0) * (g.y1 - g.y0)) + greatest(1e-9, (big.x1 - big.x0) * (big.y1 - big.y0)) - greatest(0, least(g.x1, big.x1) - greatest(g.x0, big.x0)) * greatest(0, least(g.y1, big.y1) - greatest(g.y0, big.y0))) >= 0.35)
SELECT big.dataset, files.file, x0, y0, x1, y1, count FROM big JOIN files USING (dataset) WHERE (big.dataset, grp, files.file) NOT IN (SELECT dataset, grp, file FROM has)""")
def consensus(spark, sf_dir):
    lines = boxes(spark, sf_dir).withColumns({"dataset": F.col("page") % 100, "file": (F.col("page") % 1000).cast("string"), "ord": F.col("id")})
    return agreement.consensus(lines, lines.select("dataset", "file"), ["dataset"])


@query("split_region")
def split_region(spark, sf_dir):
    grid = F.transform(F.sequence(F.lit(0), F.lit(119)), lambda y: F.transform(F.sequence(F.lit(0), F.lit(119)), lambda x: F.when(
        (x % (30 + F.col("vec_id") % 17) < 4) | (y % (28 + F.col("vec_id") % 23) < 4), 255.0).otherwise(128 + 400 * F.element_at("embedding", ((x + y) % 64 + 1).cast("int")).cast("double"))))
    return geometry.split_sheets(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sheet"), grid.alias("gray")), least=16)


def drawn(batches, rows: int = 32):
    """Pictures of edge_marks, so many at a time: one has 158,400 bytes, and a batch of embeddings up to 10,000 rows."""
    import numpy as np
    import pandas as pd

    for pdf in batches:
        for at in range(0, len(pdf), rows):
            out = []
            for k, e in zip(pdf["picture"][at : at + rows], pdf["embedding"][at : at + rows], strict=True):
                noise = np.resize(np.asarray(e, float), (220, 240)) * 60
                rgb = np.clip(np.linspace(90, 170, 240)[None] + noise, 60, 230)[..., None].repeat(3, 2)
                if k % 3:
                    y = 2 if k % 3 == 1 else 208
                    rgb[y : y + 10, 10:70] = 8
                    rgb[y + 3 : y + 7, 14:66:4] = 240
                out.append((k, 240, 220, rgb.astype(np.uint8).tobytes()))
            yield pd.DataFrame(out, columns=["picture", "w", "h", "rgb"])


@query("edge_marks")
def edge_marks(spark, sf_dir):
    """Pictures drawn from embeddings: a gradient with noise, and for two of three a dark bar with letters at an edge."""
    source = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("picture"), "embedding")
    return marks.detect(source.mapInPandas(drawn, "picture long, w int, h int, rgb binary"))


# Logs.

LINES_SQL = """g AS (SELECT user_id AS job, event_id AS line_no, CASE event_type WHEN 'signup' THEN '[main] loading VAE' WHEN 'view' THEN '[extract] image a/b' || event_id || '.png: ok'
  WHEN 'click' THEN '[run] identity ' || (event_id % 9) || '/9' WHEN 'purchase' THEN 'saved new mod ''m' || event_id || ''' (' || event_id || ' tokens, 1.5 MB) -> out/' || event_id WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN '[studio] error: x' ELSE 'token cap reached' END END AS line FROM events)"""


def lines(spark, sf_dir):
    i, kind = F.col("event_id").cast("string"), F.col("event_type")
    text = (
        F.when(kind == "signup", "[main] loading VAE").when(kind == "view", F.concat(F.lit("[extract] image a/b"), i, F.lit(".png: ok")))
        .when(kind == "click", F.concat(F.lit("[run] identity "), (F.col("event_id") % 9).cast("string"), F.lit("/9")))
        .when(kind == "purchase", F.concat(F.lit("saved new mod 'm"), i, F.lit("' ("), i, F.lit(" tokens, 1.5 MB) -> out/"), i))
        .when(kind == "error", F.when(F.col("event_id") % 2 == 0, "[studio] error: x").otherwise("token cap reached"))
    )
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("line_no"), text.alias("line"))


@query("log_parse", f"WITH {LINES_SQL} SELECT job, 'm' || line_no AS name, line_no AS token_count, 1.5::DOUBLE AS mb, 'out/' || line_no AS path FROM g WHERE line LIKE 'saved%'")
def log_parse(spark, sf_dir):
    return logs.saved(lines(spark, sf_dir)).select("job", "name", "token_count", "mb", "path")


@query("log_progress", f"""WITH {LINES_SQL}, s AS (SELECT *, CASE WHEN line LIKE '%[studio] error%' THEN 'error' WHEN line LIKE '%loading VAE%' THEN 'loading_vae' WHEN line LIKE '[extract]%' THEN 'encoding' WHEN line LIKE '%identity%' THEN 'refining' WHEN line LIKE '%token cap%' THEN 'fitting' WHEN line LIKE 'saved%' THEN 'saved' END AS st FROM g),
a AS (SELECT job, arg_max(st, line_no) AS stage, count(*) FILTER (st = 'encoding') AS encoded, coalesce(arg_max('b' || line_no || '.png', line_no) FILTER (st = 'encoding'), '') AS current, coalesce(arg_max(line_no % 9, line_no) FILTER (st = 'refining'), 0) AS step FROM s GROUP BY job)
SELECT job, stage, encoded, 'image' AS kind, current, step, CASE WHEN step = 0 AND job NOT IN (SELECT job FROM s WHERE st = 'refining') THEN 0 ELSE 9 END::BIGINT AS steps, greatest(3, encoded) AS total,
  CASE stage WHEN 'loading_vae' THEN 6 WHEN 'encoding' THEN least(92, 8 + 84 * encoded // greatest(3, encoded)) WHEN 'refining' THEN least(96, 8 + 84 * greatest(encoded - 1, 0) // 3 + floor(28.0 * step / 9)) WHEN 'fitting' THEN 96 WHEN 'saved' THEN 100 ELSE 0 END::BIGINT AS percent FROM a""")
def log_progress(spark, sf_dir):
    said = lines(spark, sf_dir)
    return logs.progress(said, said.select("job").distinct().withColumn("total", F.lit(3).cast("long")))


@query("stream_progress", f"""WITH {LINES_SQL}, s AS (SELECT *, CASE WHEN line LIKE '%[studio] error%' THEN 'error' WHEN line LIKE '%loading VAE%' THEN 'loading_vae' WHEN line LIKE '[extract]%' THEN 'encoding' WHEN line LIKE '%identity%' THEN 'refining' WHEN line LIKE '%token cap%' THEN 'fitting' WHEN line LIKE 'saved%' THEN 'saved' END AS st FROM g)
SELECT job, coalesce(arg_max(st, line_no) FILTER (st IS NOT NULL), 'starting') AS stage, count(*) FILTER (st = 'encoding') AS encoded, coalesce(arg_max(line_no % 9, line_no) FILTER (st = 'refining'), 0) AS step, count(*) AS lines FROM s GROUP BY job""")
def stream_progress(spark, sf_dir):
    """The same fold as a streaming aggregation, here over the table as it is; tests run it as a stream."""
    return streaming.progress_stream(lines(spark, sf_dir))
