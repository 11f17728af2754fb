"""Queries over detection quality and dataset building."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonewatch.catalog.base import BOXES, center_sql, query
from zonewatch.functions import geometry as G
from zonewatch.functions import keys as K
from zonewatch.functions.grading import COARSE_BANDS, FRACTION_BANDS, PX_BANDS, usable_negative
from zonewatch.functions.replies import parse_replies
from zonewatch.operators import boxes as BX
from zonewatch.operators import sampling as S
from zonewatch.operators import tiling as TL
from zonewatch.plans import dataset as D
from zonewatch.plans import evaluation as E
from zonewatch.session import dealt_by_some_keys, materialize
from zonewatch.sources import bindings as B

CORNERS = ["x1", "y1", "x2", "y2"]


def band_sql(v: str, bands) -> str:
    arms = " ".join(f"WHEN {v} >= {lo} " + ("" if hi == float("inf") else f"AND {v} < {hi} ") + f"THEN '{n}'"
                    for n, lo, hi in bands)
    return f"CASE {arms} END"


SIDE = "greatest(x2-x1, y2-y1)"
HITS = BOXES + f""", h AS (SELECT g.*, g.image % 3 AS ds, EXISTS (SELECT 1 FROM det d WHERE d.image=g.image AND {center_sql('d', 'g')}) AS hit FROM gt g)"""


def _hits(spark, sf):
    m = BX.match_gt(B.truth_boxes(spark, sf), B.detections(spark, sf), ["image"], CORNERS)
    return m.withColumn("ds", F.col("image") % 3)


@query("recall_by_group", f"""WITH {HITS}, d AS (SELECT image % 3 AS ds, image, count(*) AS n_det FROM det GROUP BY ALL),
m AS (SELECT ds, image, count(*) AS n_gt, count(*) FILTER (hit) AS n_hit FROM h GROUP BY ALL),
p AS (SELECT ds, image, coalesce(n_gt,0) AS n_gt, coalesce(n_hit,0) AS n_hit, coalesce(n_det,0) AS n_det FROM m FULL JOIN d USING (ds, image))
SELECT ds, CAST(sum(n_hit) AS BIGINT) AS n_hit, CAST(sum(n_gt) AS BIGINT) AS n_gt, CAST(sum(n_det) AS BIGINT) AS n_det, count(*) AS n_images,
  CAST(sum(greatest(0,n_det-n_gt)) AS BIGINT) AS n_extra, sum(n_hit)/nullif(sum(n_gt),0) AS recall FROM p GROUP BY ds""")
def recall_by_group(spark, sf):
    det = B.detections(spark, sf).withColumn("ds", F.col("image") % 3)
    return E.recall_by_group(_hits(spark, sf), det, "image", ["ds"])


@query("recall_by_size", f"""WITH {HITS}, b AS (SELECT {band_sql(SIDE, PX_BANDS)} AS band, CAST(ds AS VARCHAR) AS ds, hit FROM h)
SELECT band, coalesce(ds,'(all)') AS ds, count(*) AS n_gt, count(*) FILTER (hit) AS n_hit, count(*) FILTER (hit)/count(*) AS recall
FROM b GROUP BY GROUPING SETS ((band, ds), (band))""")
def recall_by_size(spark, sf):
    return E.recall_by_band(_hits(spark, sf), PX_BANDS, "ds")


@query("recall_three_bands", f"""WITH {HITS}, b AS (SELECT {band_sql(SIDE, COARSE_BANDS)} AS band, CAST(ds AS VARCHAR) AS ds, hit FROM h)
SELECT band, coalesce(ds,'(all)') AS ds, count(*) AS n_gt, count(*) FILTER (hit) AS n_hit, count(*) FILTER (hit)/count(*) AS recall
FROM b GROUP BY GROUPING SETS ((band, ds), (band))""")
def recall_three_bands(spark, sf):
    return E.recall_by_band(_hits(spark, sf), COARSE_BANDS, "ds")


_XT = ", ".join(f"100.0::DOUBLE*count(*) FILTER ({band_sql('v', FRACTION_BANDS)} = '{n}')/count(*) AS pct_{i}"
                for i, (n, _, _) in enumerate(FRACTION_BANDS))


@query("band_crosstab", f"""WITH {BOXES}, v AS (SELECT model, {SIDE}/640.0::DOUBLE AS v FROM boxes)
SELECT coalesce(model,'(all)') AS model, count(*) AS n_boxes, {_XT} FROM v GROUP BY ROLLUP (model)""")
def band_crosstab(spark, sf):
    return E.band_crosstab(B.boxes(spark, sf), "model", E.long_side() / 640.0, FRACTION_BANDS)


@query("image_recall", f"""WITH {HITS}, i AS (SELECT ds, image, bool_or(hit) AS hit FROM h GROUP BY ALL)
SELECT ds, count(*) AS n_images, count(*) FILTER (hit) AS n_hit, avg(hit::INT) AS recall FROM i GROUP BY ds""")
def image_recall(spark, sf):
    m = _hits(spark, sf)
    return E.image_recall(m, m.filter("hit"), ["image"], ["ds"])


@query("compare_configs", f"""WITH {BOXES}, u AS (SELECT DISTINCT image,x1,y1,x2,y2,model FROM boxes),
n AS (SELECT image, count(*) AS n_gt FROM gt GROUP BY image), fr AS (SELECT DISTINCT image FROM boxes),
hh AS (SELECT model, g.image, count(*) AS n_hit FROM (SELECT DISTINCT d.model, g.image, g.x1, g.y1, g.x2, g.y2 FROM gt g
   JOIN u d ON d.image=g.image AND {center_sql('d', 'g')}) g GROUP BY ALL),
bb AS (SELECT model, image, count(*) AS n_box FROM u GROUP BY ALL),
r AS (SELECT m.model AS config, fr.image, coalesce(n_gt,0) AS n_gt, coalesce(n_hit,0) AS n_hit, coalesce(n_box,0) AS n_box,
   n_gt IS NULL AS clean FROM (SELECT DISTINCT model FROM boxes) m CROSS JOIN fr LEFT JOIN n USING (image)
   LEFT JOIN hh ON hh.model=m.model AND hh.image=fr.image LEFT JOIN bb ON bb.model=m.model AND bb.image=fr.image)
SELECT config, CAST(sum(n_hit) FILTER (NOT clean) AS BIGINT) AS n_hit, CAST(sum(n_gt) FILTER (NOT clean) AS BIGINT) AS n_gt,
  CAST(sum(greatest(0,n_box-n_gt)) FILTER (NOT clean) AS BIGINT) AS n_extra, count(*) FILTER (clean) AS n_clean,
  count(*) FILTER (clean AND n_box > 0) AS n_clean_false, count(*) FILTER (clean AND n_box > 0)/nullif(count(*) FILTER (clean),0) AS clean_false_share
FROM r GROUP BY config""")
def compare_configs(spark, sf):
    parts = 2 * B.image_parts(spark, sf)  # all steps up to the totals go image by image, in one task
    b = B.boxes(spark, sf, parts)
    gt = B.truth_boxes(spark, sf, parts)
    det = b.select("image", *CORNERS, "model").distinct()
    configs = B.boxes(spark, sf).select(F.col("model").alias("config")).distinct()
    frames = per_model(b.select("image").distinct(), configs)
    hits = (BX.matched_by(gt, det.withColumnRenamed("model", "config"), ["image"], CORNERS, ["config"])
            .groupBy("image", "config").agg(F.count(F.lit(1)).alias("n_hit")))
    n_gt = gt.groupBy("image").agg(F.count(F.lit(1)).alias("n_gt"))
    n_box = det.groupBy("image", F.col("model").alias("config")).agg(F.count(F.lit(1)).alias("n_box"))
    z = F.lit(0).cast("bigint")
    r = (frames.join(n_gt, "image", "left").join(hits, ["image", "config"], "left")
         .join(n_box, ["image", "config"], "left").withColumn("clean", F.col("n_gt").isNull()))
    with dealt_by_some_keys(spark):  # boxes are read in here, and only the totals are written
        return materialize(E.compare_configs(r.withColumns({c: F.coalesce(c, z) for c in ("n_gt", "n_hit", "n_box")})))


def per_model(df, models):
    """Rows once per model: a list of the models of the data, one row, is put beside every row."""
    name = models.columns[0]
    listed = models.agg(F.array_sort(F.collect_set(name)).alias("_models"))
    return df.join(F.broadcast(listed)).withColumn(name, F.explode("_models")).drop("_models")


CONFS = [0.0, 0.2, 0.4, 0.6, 0.8]
CURVE = BOXES + f""", md AS (SELECT DISTINCT image,x1,y1,x2,y2,model,score FROM boxes), ms AS (SELECT DISTINCT model FROM md),
b AS (SELECT ms.model, g.image, g.x1, g.y1, g.x2, g.y2, max(d.score) AS best FROM gt g CROSS JOIN ms
  LEFT JOIN md d ON d.model=ms.model AND d.image=g.image AND {center_sql('d', 'g')} GROUP BY ALL),
cf AS (SELECT unnest({[f'{c}' for c in CONFS]})::DOUBLE AS conf),
hc AS (SELECT model, conf, count(*) FILTER (best >= conf) AS n_hit, count(*) AS n_gt FROM b, cf GROUP BY ALL),
dc AS (SELECT model, conf, count(*) FILTER (score >= conf) AS n_box FROM md, cf WHERE image IN (SELECT image FROM gt) GROUP BY ALL),
cc AS (SELECT model, conf, count(*) FILTER (score >= conf)/count(DISTINCT image) AS clean_boxes FROM md, cf
  WHERE image NOT IN (SELECT image FROM gt) GROUP BY ALL),
curve AS (SELECT model, conf, n_hit, n_gt, coalesce(n_box,0) AS n_box, greatest(0, coalesce(n_box,0)-n_gt) AS n_extra,
  coalesce(clean_boxes,0.0) AS clean_boxes FROM hc LEFT JOIN dc USING (model,conf) LEFT JOIN cc USING (model,conf))"""


def _curve(spark, sf):
    truth = B.truth_boxes(spark, sf)
    det = materialize(B.boxes(spark, sf).select("image", *CORNERS, "model", "score").distinct())
    best = E.hit_scores(truth, det, ["image"], CORNERS, ["model"])
    n_gt = det.select("model").distinct().join(F.broadcast(truth.agg(F.count(F.lit(1)).alias("n_gt"))))
    has_gt = truth.select("image").distinct()
    clean = det.join(has_gt, "image", "left_anti").withColumnRenamed("image", "frame")
    return E.threshold_curve(best, det.join(has_gt, "image", "left_semi"), clean, CONFS, ["model"], n_gt)


@query("threshold_curve", f"WITH {CURVE} SELECT * FROM curve")
def threshold_curve(spark, sf):
    return _curve(spark, sf)


@query("operating_point", f"""WITH {CURVE}, a AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY n_hit DESC, conf) AS rn FROM curve WHERE n_extra <= 4),
g AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY n_extra, conf) AS rn FROM curve WHERE n_hit >= 0.3*n_gt)
SELECT m.model, a.conf AS calm_conf, a.n_hit/a.n_gt AS calm_recall, g.conf AS good_conf, g.n_extra AS good_extra
FROM (SELECT DISTINCT model FROM curve) m LEFT JOIN a ON a.model=m.model AND a.rn=1 LEFT JOIN g ON g.model=m.model AND g.rn=1""")
def operating_point(spark, sf):
    return E.operating_point(_curve(spark, sf), ["model"], 4, 0.3)


@query("heldout_tally", f"""WITH {HITS}, r AS (SELECT model, conf, held, source, n_hit, n_gt, n_extra FROM (
  SELECT 'm' AS model, 0.2::DOUBLE AS conf, ds = 2 AS held, CAST(image % 7 AS VARCHAR) AS source, count(*) FILTER (hit) AS n_hit, count(*) AS n_gt,
   count(*) FILTER (NOT hit) AS n_extra FROM h GROUP BY ALL))
SELECT model, conf, held, coalesce(source,'(all)') AS source, CAST(sum(n_hit) AS BIGINT) AS n_hit, CAST(sum(n_gt) AS BIGINT) AS n_gt,
  CAST(sum(n_extra) AS BIGINT) AS n_extra FROM r GROUP BY GROUPING SETS ((model,conf,held,source),(model,conf,held))""")
def heldout_tally(spark, sf):
    r = (_hits(spark, sf).groupBy((F.col("ds") == 2).alias("held"), (F.col("image") % 7).cast("string").alias("source"))
         .agg(F.count_if("hit").alias("n_hit"), F.count(F.lit(1)).alias("n_gt"), F.count_if(~F.col("hit")).alias("n_extra"))
         .withColumns({"model": F.lit("m"), "conf": F.lit(0.2)}))
    return E.heldout_tally(r)


@query("detector_summary", f"""WITH {BOXES} SELECT model, count(*) AS n_boxes, max(score) AS max_score, avg({SIDE}) AS mean_side FROM boxes GROUP BY model""")
def detector_summary(spark, sf):
    return E.detector_summary(B.boxes(spark, sf), ["model"])


@query("outcome_sample", f"""WITH {HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY hit ORDER BY md5('0|'||image||'|'||
   CAST(x1 AS BIGINT)||'|'||CAST(y1 AS BIGINT)||'|'||CAST(x2 AS BIGINT)||'|'||CAST(y2 AS BIGINT)), image, x1, y1, x2, y2) AS rn FROM h)
SELECT image, x1, y1, x2, y2, hit FROM r WHERE rn <= 25""")
def outcome_sample(spark, sf):
    m = _hits(spark, sf).withColumns({c: F.col(c).cast("bigint") for c in CORNERS})
    return S.outcome_sample(m, 25, ["image", *CORNERS]).select(
        "image", *[F.col(c).cast("double").alias(c) for c in CORNERS], "hit")


@query("target_window", f"""WITH {BOXES}, b AS (SELECT image,x1,y1,x2,y2, 45.0::DOUBLE/{SIDE} AS s FROM gt),
w AS (SELECT *, round_even(least(greatest(0,(x1+x2)/2-640/s/2), 2000-640/s),0) AS wx, round_even(least(greatest(0,(y1+y2)/2-480/s/2), 1500-480/s),0) AS wy FROM b),
g AS (SELECT *, (x1-wx)*s AS a1, (y1-wy)*s AS b1, (x2-wx)*s AS a2, (y2-wy)*s AS b2,
   x2-x1 >= 2 AND y2-y1 >= 2 AND 640/s <= 2000 AND 480/s <= 1500 AS fits FROM w)
SELECT image, x1, y1, x2, y2, CASE WHEN ok THEN a1 END AS gx1, CASE WHEN ok THEN b1 END AS gy1, CASE WHEN ok THEN a2 END AS gx2, CASE WHEN ok THEN b2 END AS gy2
FROM (SELECT *, fits AND a1>=0 AND b1>=0 AND a2<=640 AND b2<=480 AS ok FROM g)""")
def target_window(spark, sf):
    b = B.truth_boxes(spark, sf).withColumns({"width": F.lit(2000.0), "height": F.lit(1500.0)})
    return TL.target_window(b, 45).select("image", *CORNERS, "gx1", "gy1", "gx2", "gy2")


# --- dataset ------------------------------------------------------------------------

FILES = """files AS (SELECT doc_id AS image_id, CAST(replace(source,'src','') AS INTEGER) AS s, lang, n_chars,
  CASE WHEN s < 7 THEN 'RoLIDv' WHEN s < 14 THEN 'UAVVaste' ELSE 'TACO' END AS source,
  CASE WHEN s < 7 THEN 'images/v' || doc_id // 10 || '_frame' || doc_id || '.jpg'
       WHEN s < 14 THEN 'images/BATCH_d' || doc_id // 8 || '_img_' || doc_id || '.jpg'
       ELSE 'batch_' || s || '/' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || '.jpg' END AS file_name FROM documents),
clips AS (SELECT image_id, source, file_name, lang, n_chars,
  CASE WHEN source = 'RoLIDv' THEN 'R:' || regexp_replace(split_part(file_name,'/',-1), '_frame\\d+\\.\\w+$', '')
       WHEN source = 'UAVVaste' THEN 'U:' || regexp_extract(split_part(file_name,'/',-1), '^(BATCH_[A-Za-z0-9]+)_', 1)
       ELSE file_name END AS clip FROM files),
splits AS (SELECT *, CASE WHEN CAST('0x' || substr(md5(clip),1,8) AS BIGINT) % 10000 < 1500 THEN 'val' ELSE 'train' END AS split FROM clips)"""


def _files(spark, sf):
    clip = K.clip_key(F.col("source"), F.col("file_name"))
    return (B.files(spark, sf).withColumn("clip", clip)
            .withColumn("split", K.split_of(F.col("clip"), 0.15)))


@query("clip_split", f"WITH {FILES} SELECT image_id, clip, split FROM splits")
def clip_split(spark, sf):
    return _files(spark, sf).select("image_id", "clip", "split")


@query("split_leakage", f"""WITH {FILES}, bad AS (SELECT source, clip, CASE WHEN CAST('0x' || substr(md5(file_name),1,8) AS BIGINT) % 10000 < 1500 THEN 'val' ELSE 'train' END AS split FROM clips),
c AS (SELECT source, clip, count(DISTINCT split) AS k FROM bad GROUP BY ALL)
SELECT source, count(*) AS n_clips, count(*) FILTER (k = 2) AS n_leaked FROM c GROUP BY source""")
def split_leakage(spark, sf):
    by_image = _files(spark, sf).withColumn("split", K.split_of(F.col("file_name"), 0.15))
    return D.split_leakage(by_image)


@query("audit_clip_keys", f"""WITH {FILES} SELECT source, count(DISTINCT regexp_replace(clip, '^[RU]:', '')) AS n_clips FROM clips GROUP BY source""")
def audit_clip_keys(spark, sf):
    kind = F.when(F.col("source") == "RoLIDv", "rolid").when(F.col("source") == "UAVVaste", "uav")
    f = B.files(spark, sf).withColumn("k", K.audit_clip_key(kind, F.col("file_name")))
    return f.groupBy("source").agg(F.count_distinct("k").alias("n_clips"))


@query("tile_names", f"""WITH {FILES}, n AS (SELECT image_id, source || '_' || image_id || CASE WHEN image_id % 3 = 0 THEN '_full'
   WHEN image_id % 3 = 1 THEN '_t' || image_id % 9 ELSE '_n' || image_id % 9 END AS name FROM files)
SELECT image_id, name, nullif(regexp_extract(name, '^([A-Za-z]+)_(.+?)_(?:t\\d+|n\\d+|full)$', 1), '') AS src,
  nullif(regexp_extract(name, '^([A-Za-z]+)_(.+?)_(?:t\\d+|n\\d+|full)$', 2), '') AS img FROM n""")
def tile_names(spark, sf):
    i, s = F.col("image_id"), F.col("source")
    name = (F.when(i % 3 == 0, TL.tile_name(s, i, "full")).when(i % 3 == 1, TL.tile_name(s, i, "t", i % 9))
            .otherwise(TL.tile_name(s, i, "n", i % 9)))
    f = B.files(spark, sf).withColumn("name", name)
    return f.select("image_id", "name", K.tile_source(F.col("name")).alias("src"), K.tile_image(F.col("name")).alias("img"))


@query("label_orphans", """SELECT doc_id, 'label_without_image' AS issue FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT doc_id, 'image_without_label' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def label_orphans(spark, sf):
    return D.orphans(B.table(spark, sf, "labels").select("doc_id"), B.table(spark, sf, "documents").select("doc_id"), "doc_id")


LINES = """lines AS (SELECT CASE WHEN l_linestatus = 'F' THEN 'train' ELSE 'val' END AS split,
  CASE WHEN l_partkey % 50 = 0 THEN 4 ELSE 5 END AS n_fields, l_partkey % 97 / 97.0::DOUBLE AS cx, l_suppkey % 89 / 89.0::DOUBLE AS cy,
  (l_quantity-1)/100.0::DOUBLE AS w, l_tax*5 AS h FROM lineitem)"""


def _lines(spark, sf):
    return B.table(spark, sf, "lineitem").select(
        F.when(F.col("l_linestatus") == "F", "train").otherwise("val").alias("split"),
        F.when(F.col("l_partkey") % 50 == 0, 4).otherwise(5).alias("n_fields"),
        (F.col("l_partkey") % 97 / 97.0).alias("cx"), (F.col("l_suppkey") % 89 / 89.0).alias("cy"),
        ((F.col("l_quantity") - 1) / 100.0).alias("w"), (F.col("l_tax") * 5).alias("h"))


_DEG = "(n_fields <> 5 OR w <= 0 OR h <= 0)"
_OUT = "(cx-w/2 < -0.001 OR cy-h/2 < -0.001 OR cx+w/2 > 1.001 OR cy+h/2 > 1.001 OR cx-w/2 > 1.001 OR cy-h/2 > 1.001)"


@query("label_integrity", f"""WITH {LINES} SELECT split, count(*) AS n_labels, count(*) FILTER ({_DEG}) AS n_degenerate,
  count(*) FILTER (NOT {_DEG} AND {_OUT}) AS n_outside FROM lines GROUP BY split""")
def label_integrity(spark, sf):
    return D.label_integrity(_lines(spark, sf), ["split"])


@query("audit_passes", f"""WITH {LINES}, {FILES}, c AS (SELECT source, clip, count(DISTINCT split) AS k FROM splits GROUP BY ALL)
SELECT *, n_degenerate + n_leaked + n_orphans = 0 AS passes FROM (SELECT (SELECT count(*) FILTER ({_DEG}) FROM lines) AS n_degenerate,
 (SELECT count(*) FILTER (k = 2) FROM c) AS n_leaked, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS n_orphans)""")
def audit_passes(spark, sf):
    o = D.orphans(B.table(spark, sf, "labels").select("doc_id"), B.table(spark, sf, "documents").select("doc_id"), "doc_id")
    return D.audit_passes(D.label_integrity(_lines(spark, sf), ["split"]), D.split_leakage(_files(spark, sf)), o)


@query("source_balance", """WITH n AS (SELECT lang AS source, count(*) AS n FROM documents GROUP BY lang)
SELECT source, n, n/sum(n) OVER () AS share, n/sum(n) OVER () > 0.5 AS dominates FROM n""")
def source_balance(spark, sf):
    return D.source_balance(B.table(spark, sf, "documents").select(F.col("lang").alias("source")))


@query("class_topk", "SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 10")
def class_topk(spark, sf):
    return D.class_counts(B.table(spark, sf, "part"), "p_type", 10)


@query("class_keywords", """SELECT p_name, p_type, count(*) AS n FROM part WHERE lower(p_name || ' ' || p_type) LIKE '%ring%'
  OR lower(p_name || ' ' || p_type) LIKE '%econ%' GROUP BY ALL""")
def class_keywords(spark, sf):
    p = B.table(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("supercategory"))
    f = D.filter_classes(p, words=["ring", "econ"])
    return f.groupBy(F.col("name").alias("p_name"), F.col("supercategory").alias("p_type")).agg(F.count(F.lit(1)).alias("n"))


@query("folder_filter", "SELECT source, count(*) AS n FROM documents WHERE source IN ('src1','src4','src9') GROUP BY source")
def folder_filter(spark, sf):
    d = D.filter_folders(B.table(spark, sf, "documents"), ["src1", "src4", "src9"], "source")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("missing_files", """SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 2 = 0 THEN 'a' || d.doc_id END, CASE WHEN d.doc_id % 3 = 0 THEN 'b' || d.doc_id END) AS url
FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)""")
def missing_files(spark, sf):
    i = F.col("doc_id")
    d = B.table(spark, sf, "documents").select(
        "doc_id", F.format_string("%d.jpg", i).alias("file_name"),
        F.when(i % 2 == 0, F.concat(F.lit("a"), i.cast("string"))).alias("u1"),
        F.when(i % 3 == 0, F.concat(F.lit("b"), i.cast("string"))).alias("u2"))
    have = B.table(spark, sf, "labels").select(F.format_string("%d.jpg", i).alias("file_name"))
    return D.missing_files(d, have, ["u1", "u2"]).select("doc_id", "url")


@query("annotation_join", """SELECT coalesce(p_type,'?') AS name, count(*) AS n, sum(o_totalprice) AS total FROM lineitem
JOIN orders ON l_orderkey=o_orderkey LEFT JOIN part ON p_partkey=l_partkey AND p_size > 10 GROUP BY ALL""")
def annotation_join(spark, sf):
    src = F.lit("s").alias("source")
    ann = B.table(spark, sf, "lineitem").select(src, F.col("l_orderkey").alias("image_id"), F.col("l_partkey").alias("category_id"))
    img = B.table(spark, sf, "orders").select(src, F.col("o_orderkey").alias("image_id"), "o_totalprice")
    cat = (B.table(spark, sf, "part").filter("p_size > 10")
           .select(src, F.col("p_partkey").alias("id"), F.col("p_type").alias("name"), F.col("p_brand").alias("supercategory")))
    return D.join_annotations(ann, img, cat).groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))


DIMS = """dims AS (SELECT b.*, 600.0::DOUBLE AS width, 400.0::DOUBLE AS height, 300.0::DOUBLE AS disk_width, 200.0::DOUBLE AS disk_height FROM boxes b)"""


def _dims(spark, sf):
    return B.boxes(spark, sf).withColumns({"width": F.lit(600.0), "height": F.lit(400.0),
                                           "disk_width": F.lit(300.0), "disk_height": F.lit(200.0)})


@query("rescale_boxes", f"""WITH {BOXES}, {DIMS}, r AS (SELECT image, x1*0.5 AS x1, y1*0.5 AS y1, x2*0.5 AS x2, y2*0.5 AS y2 FROM dims),
c AS (SELECT image, greatest(x1,0) AS x1, greatest(y1,0) AS y1, least(x2,300) AS x2, least(y2,200) AS y2 FROM r WHERE x2-x1>=2 AND y2-y1>=2)
SELECT image, x1, y1, x2, y2, true AS rescaled FROM c WHERE x2-x1>=2 AND y2-y1>=2""")
def rescale_boxes(spark, sf):
    return D.rescale_boxes(_dims(spark, sf)).select("image", *CORNERS, "rescaled")


@query("fit_max_side", f"""WITH {BOXES}, {DIMS} SELECT image, x1*k AS x1, y1*k AS y1, x2*k AS x2, y2*k AS y2 FROM (SELECT *, least(1.0::DOUBLE,320/600.0::DOUBLE) AS k FROM dims)""")
def fit_max_side(spark, sf):
    return D.fit_max_side(_dims(spark, sf), 320).select("image", *CORNERS)


@query("region_label_filter", f"""WITH {BOXES}, {DIMS} SELECT image, count(*) AS n_kept FROM dims WHERE {SIDE} <= 0.20*greatest(width,height) GROUP BY image""")
def region_label_filter(spark, sf):
    return D.drop_region_labels(_dims(spark, sf), 0.20).groupBy("image").agg(F.count(F.lit(1)).alias("n_kept"))


@query("region_label_share", f"""WITH {BOXES}, {DIMS} SELECT model, count(*) AS n_labels, avg(({SIDE}/greatest(width,height) >= 0.20)::INT) AS region_share FROM dims GROUP BY model""")
def region_label_share(spark, sf):
    return D.region_label_share(_dims(spark, sf), ["model"], 0.20)


@query("closeup_route", f"""WITH {BOXES}, {DIMS}, s AS (SELECT image, {SIDE} AS side, row_number() OVER (PARTITION BY image ORDER BY {SIDE}) - 1 AS i,
  count(*) OVER (PARTITION BY image) AS n FROM dims)
SELECT image, side AS median_side, CASE WHEN side > 0.12*600 THEN 'whole' ELSE 'tile' END AS route FROM s WHERE i = n // 2""")
def closeup_route(spark, sf):
    return D.route_closeup(_dims(spark, sf), ["image"]).select("image", "median_side", "route")


@query("size_quantiles_upper", f"""WITH {BOXES}, v AS (SELECT model, {SIDE}/640.0::DOUBLE AS side FROM boxes),
s AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY side) - 1 AS i, count(*) OVER (PARTITION BY model) AS n FROM v)
SELECT model, max(n) AS n, max(side) FILTER (i = n//4) AS p25, max(side) FILTER (i = n//2) AS p50, max(side) FILTER (i = 3*n//4) AS p75,
  avg((side*640 < 12.5)::INT) AS tiny_share FROM s GROUP BY model""")
def size_quantiles_upper(spark, sf):
    b = B.boxes(spark, sf).withColumn("side", E.long_side() / 640.0)
    return D.size_stats(b, ["model"], "side", 640 * 12 / 12.5)


@query("in_band_share", f"""WITH {BOXES}, {DIMS}, v AS (SELECT model, {SIDE}*1280/600.0::DOUBLE/240 AS frac FROM dims),
s AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY frac) - 1 AS i, count(*) OVER (PARTITION BY model) AS n FROM v)
SELECT model, max(n) AS n, max(frac) FILTER (i = n//2) AS median_frac, avg((frac BETWEEN 0.06 AND 0.40)::INT) AS in_band FROM s GROUP BY model""")
def in_band_share(spark, sf):
    return D.in_band_share(_dims(spark, sf), ["model"])


@query("yolo_roundtrip", f"""WITH {BOXES} SELECT image, sum((x1+x2)/2.0/640*640) AS cx, sum((y1+y2)/2.0/480*480) AS cy, sum((x2-x1)/640*640) AS w,
  sum((y2-y1)/480*480) AS h, count(*)*5 AS n_fields, true AS exact FROM gt GROUP BY image""")
def yolo_roundtrip(spark, sf):
    W, H = F.lit(640), F.lit(480)
    y = B.truth_boxes(spark, sf).select("image", *CORNERS, *G.xyxy_to_yolo(G.box(), W, H),
                                        G.yolo_line(F.lit(0), G.box(), W, H).alias("line"))
    back = G.yolo_to_xyxy(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), W, H)
    near = F.lit(True)
    for a, c in zip(back, CORNERS):
        near = near & (F.abs(a - F.col(c)) < 1e-9)
    return y.groupBy("image").agg(*[F.sum(F.col(c) * k).alias(c) for c, k in (("cx", 640), ("cy", 480), ("w", 640), ("h", 480))],
                                  F.sum(F.size(F.split("line", " "))).alias("n_fields"), F.bool_and(near).alias("exact"))


@query("letterbox", """SELECT p_partkey, least(640/w, 640/h, 3.0::DOUBLE) AS scale, CAST(floor((640-floor(w*least(640/w,640/h,3.0::DOUBLE)))/2) AS BIGINT) AS off_x,
  CAST(floor((640-floor(h*least(640/w,640/h,3.0::DOUBLE)))/2) AS BIGINT) AS off_y FROM (SELECT p_partkey, p_size*20+100 AS w, p_partkey % 700 + 50 AS h FROM part)""")
def letterbox(spark, sf):
    w, h = F.col("p_size") * 20 + 100, F.col("p_partkey") % 700 + 50
    return B.table(spark, sf, "part").select("p_partkey", *G.letterbox(w, h, 640))


@query("usable_negatives", """WITH p AS (SELECT event_type AS zone, user_id, stddev_pop(least(255, value)) AS sd, avg(least(255, value)) AS mu FROM events GROUP BY ALL)
SELECT zone, count(*) AS n, count(*) FILTER (sd >= 16 AND (zone = 'view' OR mu <= 60)) AS n_usable FROM p GROUP BY zone""")
def usable_negatives(spark, sf):
    v = F.least(F.lit(255.0), F.col("value"))
    p = B.observations(spark, sf).groupBy("zone", "user_id").agg(F.stddev_pop(v).alias("sd"), F.avg(v).alias("mu"))
    ok = usable_negative(F.col("sd"), F.col("mu"), F.col("zone") == "view", max_mean=60)
    return p.groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_usable"))


@query("per_source_cap", """WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('0|' || doc_id), doc_id) AS rn FROM documents)
SELECT source, doc_id FROM r WHERE rn <= 10""")
def per_source_cap(spark, sf):
    return S.cap_per_group(B.table(spark, sf, "documents").select("source", "doc_id"), 10, ["source"], ["doc_id"])


@query("quota_sample", """WITH r AS (SELECT source, doc_id, md5('0|' || doc_id) AS o, row_number() OVER (PARTITION BY source ORDER BY md5('0|' || doc_id), doc_id) AS rn FROM documents)
SELECT source, doc_id FROM r WHERE rn <= 6 ORDER BY o, doc_id LIMIT 24""")
def quota_sample(spark, sf):
    return S.quota_sample(B.table(spark, sf, "documents").select("source", "doc_id"), 24, ["source"], ["doc_id"])


@query("warmup_window", f"""WITH {BOXES}, f AS (SELECT model, image, count(*) AS n_objects FROM boxes GROUP BY ALL HAVING count(*) >= 3),
r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY image) AS rn FROM f) SELECT model, image, n_objects FROM r WHERE rn > 11 AND rn <= 41""")
def warmup_window(spark, sf):
    f = B.boxes(spark, sf).groupBy("model", "image").agg(F.count(F.lit(1)).alias("n_objects"))
    return S.warmup_window(f, 11, 30, ["model"], "image")


U = "CAST('0x' || substr(md5({s} || '|' || image_id || '|' || c),1,8) AS BIGINT)/4294967296.0::DOUBLE"


@query("augment_plan", f"""WITH {FILES}, f AS (SELECT image_id, c FROM files, (VALUES (0),(1)) v(c))
SELECT image_id, CAST(c AS INTEGER) AS copy, CASE WHEN {U.format(s="'1'")} < 0.5 THEN [3,3,5][CAST(floor({U.format(s="'2'")}*3) AS INTEGER)+1] END AS blur_k,
  CASE WHEN {U.format(s="'3'")} < 0.7 THEN 2.0 + {U.format(s="'4'")}*5.0 END AS noise_sigma,
  CASE WHEN {U.format(s="'5'")} < 0.7 THEN CAST(floor(35 + {U.format(s="'6'")}*40) AS INTEGER) END AS quality FROM f""")
def augment_plan(spark, sf):
    return TL.augment_plan(B.files(spark, sf).select("image_id"), ["image_id"], 2)


@query("fraction_crop", f"""WITH {BOXES}, u AS (SELECT *, CAST('0x' || substr(md5('0|' || image || '|' || CAST(x1 AS BIGINT) || '|' || CAST(y1 AS BIGINT)),1,8) AS BIGINT)/4294967296.0::DOUBLE AS u FROM gt),
s AS (SELECT *, least(greatest({SIDE}/(0.08+u*(0.35::DOUBLE-0.08::DOUBLE)), 24.0), 400.0::DOUBLE) AS side FROM u)
SELECT image, x1, y1, x2, y2, side, greatest(0, least((x1+x2)/2-side/2, 600-side)) AS cx1, greatest(0, least((y1+y2)/2-side/2, 400-side)) AS cy1 FROM s""")
def fraction_crop(spark, sf):
    b = B.truth_boxes(spark, sf).withColumns({"width": F.lit(600.0), "height": F.lit(400.0),
                                              "kx": F.col("x1").cast("bigint"), "ky": F.col("y1").cast("bigint")})
    return TL.fraction_crop(b, 0.08, 0.35, ["image", "kx", "ky"]).select("image", *CORNERS, "side", "cx1", "cy1")


def _crop_boxes(spark, sf):
    return B.truth_boxes(spark, sf, B.image_parts(spark, sf)).withColumns({"width": F.lit(600), "height": F.lit(400)})


@query("repeat_crops")
def repeat_crops(spark, sf):
    labels = TL.repeat_crops(_crop_boxes(spark, sf), ["image"], CORNERS, 4, 320)[1]
    return labels.groupBy("image", "copy", *G.box("c"), "scale").agg(F.count(F.lit(1)).alias("n_labels"))


@query("target_crops")
def target_crops(spark, sf):
    labels = TL.target_crops(_crop_boxes(spark, sf), ["image"], CORNERS, copies=2)[1]
    return labels.groupBy("image", "copy", *G.box("c"), "scale").agg(F.count(F.lit(1)).alias("n_labels"))


REPLY = """r AS (SELECT conv_id, turn, CASE WHEN conv_id % 4 = 0 THEN '```json\n{"litter": true, "confidence": 0.' || turn % 10 || ', "what": "bag ' || conv_id || '"}\n```'
   WHEN conv_id % 4 = 1 THEN 'Yes, ' || text WHEN conv_id % 4 = 2 THEN '{"litter": false, "confidence": 1.' || turn % 10 || '}' ELSE text END AS reply FROM conversations)"""


@query("reply_parse", f"""WITH {REPLY} SELECT conv_id, turn, CASE WHEN conv_id % 4 = 0 THEN CAST('0.' || turn % 10 AS DOUBLE) WHEN conv_id % 4 = 1 THEN 1.0
  WHEN conv_id % 4 = 2 THEN 0.0 ELSE CASE WHEN lower(ltrim(trim(text, ' \n\t\r'), '*_# \n\t"''')) SIMILAR TO '(yes|true|có rác|co rac)[\\s\\S]*' THEN 1.0 ELSE 0.0 END END::DOUBLE AS score,
  CASE WHEN conv_id % 4 = 0 THEN 'bag ' || conv_id WHEN conv_id % 4 = 1 THEN 'unparsed-yes' WHEN conv_id % 4 = 2 THEN ''
  WHEN lower(ltrim(trim(text, ' \n\t\r'), '*_# \n\t"''')) SIMILAR TO '(yes|true|có rác|co rac)[\\s\\S]*' THEN 'unparsed-yes' ELSE 'unparsed: ' || substr(trim(text, ' \n\t\r'), 1, 30) END AS note
FROM r JOIN conversations USING (conv_id, turn)""")
def reply_parse(spark, sf):
    i, t = F.col("conv_id"), F.col("turn")
    digit = (t % 10).cast("string")
    reply = (F.when(i % 4 == 0, F.concat(F.lit('```json\n{"litter": true, "confidence": 0.'), digit,
                                         F.lit(', "what": "bag '), i.cast("string"), F.lit('"}\n```')))
             .when(i % 4 == 1, F.concat(F.lit("Yes, "), F.col("text")))
             .when(i % 4 == 2, F.concat(F.lit('{"litter": false, "confidence": 1.'), digit, F.lit("}")))
             .otherwise(F.col("text")))
    c = B.table(spark, sf, "conversations").withColumn("reply", reply)
    return parse_replies(c, "reply").select("conv_id", "turn", "score", "note")
