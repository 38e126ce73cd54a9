"""Driver queries of raster operators on small rasters made from the tables, with DuckDB SQL that counts sample by sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from luxtrace.functions import labels
from luxtrace.operators import catalogue, statistics
from luxtrace.operators.raster import frames
from luxtrace.plans.workload import query, table
from luxtrace.schema import FINGERPRINT_TAG

PATTERN = [[0, 1], [3, 2]]
_BYTES = " || ".join(f"sha256(coalesce(text, '') || '#{i}')" for i in range(32))
#: 1,024 bytes of each text's digests: ``doc_id, i, v``.
PX = f"WITH hx AS (SELECT doc_id, {_BYTES} AS hx FROM documents), px AS (SELECT doc_id, i, ('0x' || substr(hx, 2 * i::int + 1, 2))::int AS v FROM (SELECT doc_id, hx, unnest(range(1024)) AS i FROM hx) u)"


def _digests(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.concat(*[F.unhex(F.sha2(F.concat(text, F.lit(f"#{i}")).cast("binary"), 256)) for i in range(32)]).alias("p"))


def _total(column: str, scale: F.Column) -> F.Column:
    """The sum of samples as whole numbers of a scale."""
    return F.aggregate(column, F.lit(0).cast("long"), lambda a, x: a + F.round(x.cast("double") * scale).cast("long"))


@query(PX + """, s AS (SELECT doc_id, i // 3 // 16 AS y, i // 3 % 16 AS x, i % 3 AS ch, v FROM px WHERE i < 960), p AS (SELECT *, CASE WHEN y % 2 = 0 THEN CASE WHEN x % 2 = 0 THEN 0 ELSE 1 END ELSE CASE WHEN x % 2 = 0 THEN 3 ELSE 2 END END AS plane FROM s)
SELECT doc_id, plane, 10 AS h, 8 AS w, sum(v)::bigint AS total FROM p WHERE ch = CASE plane WHEN 0 THEN 0 WHEN 2 THEN 2 ELSE 1 END GROUP BY ALL""")
def delivered_planes(spark, d):
    """Small colour images read back at the places of the mosaic."""
    images = _digests(spark, d).select(F.col("doc_id").cast("string").alias("image_id"), F.lit(20).alias("h"), F.lit(16).alias("w"), F.substring("p", 1, 960).alias("data"))
    return frames.delivered_planes(images, PATTERN).select(F.col("image_id").cast("long").alias("doc_id"), "plane", "h", "w", _total("data", F.lit(255.0)).alias("total"))


@query(PX + """, s AS (SELECT doc_id, i // 32 - 6 AS y, i % 32 - 6 AS x, v FROM px WHERE i // 32 BETWEEN 6 AND 25 AND i % 32 BETWEEN 6 AND 25), p AS (SELECT *, CASE WHEN y % 2 = 0 THEN CASE WHEN x % 2 = 0 THEN 0 ELSE 1 END ELSE CASE WHEN x % 2 = 0 THEN 3 ELSE 2 END END AS plane FROM s)
SELECT doc_id, plane, 10 AS h, sum(greatest(0, least(240 - 2 * plane, v - (10 + 2 * plane))))::bigint AS total FROM p GROUP BY ALL""")
def mosaic_planes(spark, d):
    """Small mosaics, cropped at the centre and split by colour, as shares of the range."""
    colours = F.flatten(F.array_repeat(F.array(*[F.lit(c) for row in PATTERN for c in row * 16]), 16))
    image = frames.samples(_digests(spark, d).select(F.col("doc_id").cast("string").alias("frame_id"), "p"), "p", "data")
    rows = image.select("frame_id", F.lit(32).alias("h"), F.lit(32).alias("w"), "data", colours.alias("colours"), F.array(*map(F.lit, (10.0, 12.0, 14.0, 16.0))).alias("black"), F.lit(250.0).alias("white"))
    return frames.split_mosaics(rows, 20).select(F.col("frame_id").cast("long").alias("doc_id"), "plane", "h", _total("data", 240.0 - 2 * F.col("plane")).alias("total"))


@query(PX + """, g AS (SELECT doc_id, i // 31 AS y, i % 31 AS x, v FROM px WHERE i < 961), l AS (SELECT doc_id, coalesce(lag(v) OVER r, v) + coalesce(lead(v) OVER r, v) + coalesce(lag(v) OVER c, v) + coalesce(lead(v) OVER c, v) - 4 * v AS l FROM g WINDOW r AS (PARTITION BY doc_id, y ORDER BY x), c AS (PARTITION BY doc_id, x ORDER BY y))
SELECT doc_id, round(var_pop(l), 1) AS detail FROM l GROUP BY 1""")
def picture_detail(spark, d):
    """How much detail small grey images have: the variance of their Laplacian, edges repeated."""
    grey = _digests(spark, d).select(F.col("doc_id").cast("string").alias("image_id"), F.lit(31).alias("h"), F.lit(31).alias("w"), F.unhex(F.regexp_replace(F.hex(F.substring("p", 1, 961)), "(..)", "$1$1$1")).alias("data"))
    return frames.signals(grey).select(F.col("image_id").cast("long").alias("doc_id"), "detail")


_WINDOWS = "(VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(wy, wx)"


@query(f"""WITH px AS (SELECT vec_id, i, round(embedding[i + 1]::double * 50 + 128) AS a, round(embedding[64 - i]::double * 50 + 128) AS b FROM embeddings, (SELECT unnest(range(64)) AS i) u),
w AS (SELECT vec_id, wy, wx, avg(a) AS ma, avg(b) AS mb, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS c FROM px, {_WINDOWS} WHERE i // 8 BETWEEN wy AND wy + 6 AND i % 8 BETWEEN wx AND wx + 6 GROUP BY ALL)
SELECT vec_id, round(avg((2 * ma * mb + 6.5025) * (2 * c + 58.5225) / ((ma * ma + mb * mb + 6.5025) * (va + vb + 58.5225))), 7) AS ssim FROM w GROUP BY 1""")
def picture_similarity(spark, d):
    """Structural similarity of small images and the same turned round."""
    e = F.transform("embedding", lambda x: F.round(x.cast("double") * 50 + 128))
    rows = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("pair_id"), F.lit(8).alias("h"), F.lit(8).alias("w"), e.alias("a"), F.reverse(e).alias("b"))
    return frames.structural_similarity(rows).select(F.col("pair_id").cast("long").alias("vec_id"), F.round("ssim", 7).alias("ssim"))


@query("""WITH v AS (SELECT vec_id, label, i, embedding[i + 1]::double AS x FROM embeddings, (SELECT unnest(range(64)) AS i) u),
c AS (SELECT p.vec_id AS probe_id, r.vec_id AS ref_id, sum(p.x * r.x) / sqrt(sum(p.x * p.x) * sum(r.x * r.x)) AS c FROM v p JOIN v r ON r.label = p.label AND r.i = p.i WHERE r.vec_id % 50 = 1 AND p.vec_id % 50 <> 1 GROUP BY ALL) SELECT probe_id, round(avg(c), 8) AS consistency FROM c GROUP BY 1""")
def reference_consistency(spark, d):
    """Mean cosine of each vector with the references of its label."""
    v = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("body_id"), F.posexplode("embedding").alias("pos", "v")).withColumn("v", F.col("v").cast("double"))
    probes, references = v.where("vec_id % 50 <> 1").withColumnRenamed("vec_id", "probe_id"), v.where("vec_id % 50 = 1").withColumnRenamed("vec_id", "ref_id")
    return statistics.body_consistency(probes, references).select("probe_id", F.round("consistency", 8).alias("consistency"))


@query("""WITH n AS (SELECT 'IMG' || (o_custkey % 60) || CASE o_orderkey % 6 WHEN 0 THEN '' ELSE '-' || (o_orderkey % 6 + 1) END AS name FROM orders WHERE o_custkey % 7 < 4), s AS (SELECT 'IMG' || k AS stem FROM (SELECT DISTINCT o_custkey % 64 AS k FROM orders)),
t AS (SELECT DISTINCT stem, CASE WHEN name = stem THEN 1 ELSE split_part(name, '-', 2)::bigint END AS k FROM s JOIN n ON split_part(name, '-', 1) = stem), c AS (SELECT stem, 1 AS k FROM s UNION SELECT stem, k + 1 FROM t)
SELECT stem, CASE WHEN min(k) = 1 THEN stem ELSE stem || '-' || min(k) END AS name FROM c WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.stem = c.stem AND t.k = c.k) GROUP BY stem""")
def import_names(spark, d):
    """The first free name of each of many imports."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey") % 6
    names = o.where("o_custkey % 7 < 4").select(F.concat(F.lit("IMG"), (F.col("o_custkey") % 60).cast("string"), F.when(k == 0, "").otherwise(F.concat(F.lit("-"), (k + 1).cast("string")))).alias("name"))
    stems = o.select(F.concat(F.lit("IMG"), (F.col("o_custkey") % 64).cast("string")).alias("stem")).distinct()
    return catalogue.import_names(names, stems)


@query("""WITH t AS (SELECT doc_id, coalesce(text, '') || CASE doc_id % 7 WHEN 0 THEN ' is Authentic' WHEN 1 THEN ' verified REAL' WHEN 2 THEN ' ai-free, authentic' ELSE '' END AS t FROM documents)
SELECT doc_id, CASE WHEN lower(t) LIKE '%authentic%' THEN 'authentic' WHEN lower(t) LIKE '%ai-free%' THEN 'ai-free' WHEN lower(t) LIKE '%verified real%' THEN 'verified real' END AS word FROM t""")
def forbidden_words(spark, d):
    """What no output may say of a photograph."""
    k = F.col("doc_id") % 7
    said = F.concat(F.coalesce("text", F.lit("")), F.when(k == 0, " is Authentic").when(k == 1, " verified REAL").when(k == 2, " ai-free, authentic").otherwise(""))
    return table(spark, d, "documents").select("doc_id", labels.forbidden_word(said).alias("word"))


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    """Four planes of 4 × 4 samples of each vector."""
    part = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("plane")
    return table(spark, d, "embeddings").select("vec_id", "embedding", part).select(F.col("vec_id").cast("string").alias("body_id"), "plane", F.lit(4).alias("h"), F.lit(4).alias("w"), F.slice("embedding", F.col("plane") * 16 + 1, F.lit(16)).alias("data"))


@query("SELECT vec_id, i AS pos, ((embedding[17 + i]::float + embedding[49 + i]::float) / 2::float)::float::double AS value FROM embeddings, (SELECT unnest(range(16)) AS i) u")
def sensor_fields(spark, d):
    """One field for each body: the mean of its green planes."""
    fields = frames.sensor_fields(_bodies(spark, d))
    return fields.select(F.col("body_id").cast("long").alias("vec_id"), F.posexplode("data").alias("pos", "value")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("value").cast("double").alias("value"))


_LEVEL = "floor(abs({0}) * 1000)::bigint % 4"


@query(f"""WITH p AS (SELECT vec_id, c, string_agg(CASE {_LEVEL.format('embedding[c * 16 + i + 1]::double')} WHEN 0 THEN '00000000' WHEN 1 THEN '0000003f' WHEN 2 THEN '0000803f' ELSE '00000040' END, '' ORDER BY i) AS hx FROM embeddings, (SELECT unnest(range(4)) AS c) a, (SELECT unnest(range(16)) AS i) b GROUP BY ALL)
SELECT vec_id, sha256(unhex('{FINGERPRINT_TAG.hex()}' || string_agg(lpad(c::varchar, 8, '0') || '00000002' || '0000000000000004' || '0000000000000004' || hx, '' ORDER BY c))) AS commitment FROM p GROUP BY 1""")
def fingerprint_commitments(spark, d):
    """Digests of fingerprints whose samples are 0, 1/2, 1 or 2."""
    level = F.transform("data", lambda x: F.when(F.floor(F.abs(x.cast("double")) * 1000) % 4 == 0, 0.0).when(F.floor(F.abs(x.cast("double")) * 1000) % 4 == 1, 0.5).when(F.floor(F.abs(x.cast("double")) * 1000) % 4 == 2, 1.0).otherwise(2.0).cast("float"))
    return frames.commitments(_bodies(spark, d).withColumn("data", level)).select(F.col("body_id").cast("long").alias("vec_id"), F.lower(F.hex("commitment")).alias("commitment"))


@query("""WITH p AS (SELECT vec_id, y, x, ((embedding[y * 8 + 2 * x + 1]::double + embedding[y * 8 + 2 * x + 2]::double) / 2)::float AS a FROM embeddings, (SELECT unnest(range(8)) AS y) u, (SELECT unnest(range(4)) AS x) t)
SELECT t.vec_id, t.y // 2 * 4 + t.x AS pos, ((t.a::double + b.a::double) / 2)::float::double AS value FROM p t JOIN p b ON b.vec_id = t.vec_id AND b.x = t.x AND b.y = t.y + 1 WHERE t.y % 2 = 0""")
def area_means(spark, d):
    """Planes of 8 × 8 samples at half their size."""
    planes = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("frame_id"), F.lit(0).alias("plane"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.col("embedding").cast("array<float>").alias("data"))
    small = frames.area_resized(planes, 4, 4)
    return small.select(F.col("frame_id").cast("long").alias("vec_id"), F.posexplode("data").alias("pos", "value")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("value").cast("double").alias("value"))
