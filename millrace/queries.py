"""The catalogue queries over the driver tables (through the stand-ins of ``sources.surrogates``), and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace import config as C
from millrace.functions import scalar as S
from millrace.operators import exact, people as P, similar as N, snapshot as V
from millrace.operators.vectors import best_matches
from millrace.plans import folders
from millrace.sources import surrogates as R
from millrace.storage import Workspace

#: Head bytes of the tier query over texts (files take config.HEAD_BYTES).
TEXT_HEAD = 64
FACE_BAR = 0.30


def _doc_photos(spark: SparkSession, d: str) -> DataFrame:
    return R.photos(spark, d).drop("text")


def exact_groups(spark, d):
    return exact.exact_groups(_doc_photos(spark, d))


def exact_members(spark, d):
    return exact.exact_members(_doc_photos(spark, d))


def exact_waste_summary(spark, d):
    return exact.waste(exact.exact_groups(_doc_photos(spark, d)))


def _keeper(rule):
    def query(spark, d):
        return _doc_photos(spark, d).groupBy("bucket").agg(exact.keeper_id(rule).alias("keeper_id"))

    return query


def size_tier_candidates(spark, d):
    return exact.size_tier(_doc_photos(spark, d)).select("id", "size", "same")


def head_tier_candidates(spark, d):
    photos = R.photos(spark, d).withColumn("head", exact.head_hash(F.col("text").cast("binary"), TEXT_HEAD)).drop("text")
    return exact.head_tier(exact.size_tier(photos)).select("id", "size", "head", "same")


def scope_filter_prefix(spark, d):
    return V.in_scope(_doc_photos(spark, d), ("/corpus/en/src1", "/corpus/de"), ("src11",)).select("id", "bucket", "relPath")


def album_list(spark, d):
    return V.album_list(_doc_photos(spark, d), ("/corpus/en",))


def band_keys(spark, d):
    return N.band_keys(R.signed_photos(spark, d)).groupBy((F.floor(F.col("key") / 4096)).cast("int").alias("band")).agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"))


def band_bucket_sizes(spark, d):
    return N.bucket_sizes(R.signed_photos(spark, d)).groupBy("n").agg(F.count("*").alias("buckets"))


def lsh_candidates(spark, d):
    return N.candidates(R.signed_photos(spark, d))


def hamming_pairs(spark, d):
    return N.near_in_hash(R.signed_photos(spark, d), 7, Workspace(spark, "near"))


def _similar(level):
    def query(spark, d):
        return N.similar_pairs(R.signed_photos(spark, d), level).select("a", "b", F.col("dp").cast("int").alias("dp"), F.col("dd").cast("int").alias("dd"), F.col("dc").cast("int").alias("dc"))

    return query


def flat_documents(spark, d):
    return N.flat(R.signed_photos(spark, d)).select("id", S.color_spread(F.col("colorSig")).alias("spread"))


def similar_components(spark, d):
    return N.similar_components(R.signed_photos(spark, d))


def similar_groups(spark, d):
    return N.similar_groups(R.signed_photos(spark, d), C.LOOSE)


def _halves(spark, d):
    """Two overlapping halves of the catalogue; every fifth shared row has changed, and all shared rows a new album."""
    base = _doc_photos(spark, d).withColumn("dhash", F.lit(7).cast("bigint")).withColumn("sigVersion", F.lit(1))
    stored = base.where("id % 3 <> 0")
    fresh = base.where("id % 4 <> 0").withColumn("bucket", F.concat("bucket", F.lit("-new"))).withColumn("size", F.when(F.col("id") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return stored, fresh


def snapshot_merge(spark, d):
    stored, fresh = _halves(spark, d)
    return V.merge_snapshot(stored, fresh).select("id", "bucket", "size", "sha", "dhash", "sigVersion", "outcome")


def snapshot_gone(spark, d):
    return V.gone_ids(*_halves(spark, d))


def cascade_delete(spark, d):
    gone = V.gone_ids(*_halves(spark, d))
    kept = V.cascade_delete({"faces": (R.faces(spark, d).drop("embedding"), "photoId")}, gone)["faces"]
    return kept.select("faceId", "photoId")


def faces_needing_scan(spark, d):
    photos = _doc_photos(spark, d)
    scans = photos.where("id % 2 = 0").select(F.col("id").alias("photoId"), F.when(F.col("id") % 6 == 0, F.col("dateModified") + 1).otherwise(F.col("dateModified")).alias("dateModified"), F.when(F.col("id") % 10 == 0, 2).otherwise(1).alias("embVersion"))
    return V.faces_needing_scan(photos, scans, 1).select("id")


def version_purge(spark, d):
    faces = R.faces(spark, d).drop("embedding").withColumn("embVersion", (F.col("faceId") % 3).cast("int"))
    return V.purge_versions(faces, 1).select("faceId", "embVersion")


def l2_normalised(spark, d):
    return R.faces(spark, d).select("faceId", F.round(F.aggregate(S.l2_normalised(F.col("embedding")), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def centroids(spark, d):
    return P.centroids(R.faces(spark, d)).select("clusterId", F.posexplode("centroid").alias("k", "v")).select("clusterId", "k", F.round("v", 6).alias("v"))


def nearest_centroid(spark, d):
    faces = R.faces(spark, d)
    return P.nearest_cluster(faces, P.centroids(faces)).select("faceId", "clusterId", F.round("cosine", 5).alias("cosine"))


def cosine_topk(spark, d, k: int = 3):
    """The k nearest vectors of each query (ids divisible by 50) among all others."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")
    found = best_matches(e.where("vec_id % 50 = 0"), e, k, "vec_id", "vec_id", others=True, digits=6)
    return found.select("query", "place", F.col("item").alias("vec_id"), F.round("cosine", 6).alias("cosine"))


def face_clusters(spark, d):
    return P.cluster(R.faces(spark, d), FACE_BAR)


def people_view(spark, d):
    return P.people_view(R.faces(spark, d), R.people(spark, d))


def pins_and_names(spark, d):
    """Homes, forced names, votes and parking over given assignments; every third person has pinned faces only."""
    f = R.faces(spark, d)
    pinned = F.col("personId") % 3 == 0
    assigned = f.select("faceId", "clusterId", "personId", (F.col("pinned") | (pinned & (F.col("personId") > 0))).alias("pinned"), (F.col("clusterId") + 50).alias("old"), (F.col("quality") >= 0.3).alias("used"))
    return P.with_people(assigned, Workspace(spark, "pins"))


def majority_person(spark, d):
    return P.majority_person(R.faces(spark, d))


def home_cluster(spark, d):
    return P.home_cluster(R.faces(spark, d))


def cluster_rename_merge_pin(spark, d):
    faces, people = R.faces(spark, d).drop("embedding"), R.people(spark, d)
    faces, people = P.rename(faces, people, 1, " Anar ")
    faces = P.merge_clusters(faces, 2, [3])
    faces = P.pin(faces, faces.where("faceId % 7 = 0").select("faceId"), 4, 9)
    return faces.select("faceId", "clusterId", "personId", "pinned")


def _claims(spark, d):
    faces = R.faces(spark, d).select("clusterId", "photoId", "personId")
    extra = faces.select(((F.col("clusterId") + 1) % 5).cast("int").alias("clusterId"), "photoId", "personId").where("photoId % 4 = 0")
    named = faces.unionByName(extra).withColumn("personId", (F.col("clusterId") + 1).cast("bigint"))
    return named.join(R.people(spark, d), "personId", "left")


def folder_plan_people(spark, d):
    return folders.by_people(_claims(spark, d)).groupBy("key", "suggestedName").agg(F.count("*").alias("n"), F.min("photoId").alias("first"))


def folder_plan_months(spark, d):
    return folders.by_months(_doc_photos(spark, d))


def month_orders(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    photos = o.select(F.col("o_orderkey").alias("id"), F.lit(0).cast("bigint").alias("dateTaken"), F.unix_timestamp("o_orderdate").alias("dateModified"))
    return folders.by_months(photos)


def captured_at(spark, d):
    return _doc_photos(spark, d).select("id", S.captured_at(F.col("dateTaken"), F.col("dateModified")).alias("at"))


def date_text(spark, d):
    return _doc_photos(spark, d).select("id", S.date_text(F.col("dateModified")).alias("day"))


def human_bytes(spark, d):
    n = F.col("n_chars") * F.col("n_chars") * (F.col("doc_id") % 40) * (F.col("doc_id") % 40)
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", n.alias("bytes"), S.human_bytes(n).alias("text"))


def similarity_words(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", S.similarity_words(F.col("doc_id") % 9).alias("words"))


def sanitize_album(spark, d):
    name = F.regexp_replace("text", "\n", " ")
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", S.sanitize_move(name).alias("move"), S.sanitize_folder(name).alias("folder"))


def path_parts(spark, d):
    p = _doc_photos(spark, d)
    return p.select("id", S.folder_label(F.col("relPath")).alias("label"), S.root_label(F.col("relPath")).alias("last"), S.tree_path(F.concat(F.when(F.col("id") % 2 == 0, "primary:").otherwise("12-AB:"), F.col("bucket"), F.lit("/x/"))).alias("path"))


_DETECTED = "doc_id, doc_id % 700 AS l, doc_id % 500 AS t, doc_id % 700 + 40 + doc_id % 211 AS r, doc_id % 500 + 30 + doc_id % 307 AS b, (doc_id % 91) - 45 AS yaw, (doc_id % 61) - 30 AS roll, doc_id % 2 = 0 AS eyes"


def face_quality(spark, d):
    f = spark.read.parquet(f"{d}/documents.parquet").selectExpr(*[x.strip() for x in _DETECTED.split(", ")])
    w, h = F.col("r") - F.col("l"), F.col("b") - F.col("t")
    q = S.face_quality(F.least(w, h) / 900.0, F.col("yaw"), F.col("roll"), F.col("eyes"))
    return f.where(S.face_gate(w, h, F.col("yaw"), F.col("roll"), F.col("eyes"))).select("doc_id", F.round(q, 6).alias("quality"))


def square_box(spark, d):
    f = spark.read.parquet(f"{d}/documents.parquet").selectExpr(*[x.strip() for x in _DETECTED.split(", ")])
    box = S.square_box(F.col("l"), F.col("t"), F.col("r"), F.col("b"), F.lit(1000), F.lit(900))
    return f.select("doc_id", box.alias("x")).select("doc_id", "x.l", "x.t", "x.r", "x.b")


def removal_plan(spark, d):
    return folders.freed(folders.removal_plan(_doc_photos(spark, d).withColumn("docUri", F.when(F.col("id") % 3 == 0, F.col("name")))))


QUERIES = {
    "exact_groups": exact_groups, "exact_members": exact_members, "exact_waste_summary": exact_waste_summary,
    "keeper_best": _keeper(C.KeeperRule.BEST_QUALITY), "keeper_oldest": _keeper(C.KeeperRule.OLDEST), "keeper_newest": _keeper(C.KeeperRule.NEWEST),
    "size_tier_candidates": size_tier_candidates, "head_tier_candidates": head_tier_candidates, "scope_filter_prefix": scope_filter_prefix, "album_list": album_list,
    "band_keys": band_keys, "band_bucket_sizes": band_bucket_sizes, "lsh_candidates": lsh_candidates, "hamming_pairs": hamming_pairs,
    "similar_pairs_strict": _similar(C.STRICT), "similar_pairs_balanced": _similar(C.BALANCED), "similar_pairs_loose": _similar(C.LOOSE),
    "flat_documents": flat_documents, "similar_components": similar_components, "similar_groups": similar_groups,
    "snapshot_merge": snapshot_merge, "snapshot_gone": snapshot_gone, "cascade_delete": cascade_delete, "faces_needing_scan": faces_needing_scan, "version_purge": version_purge,
    "l2_normalised": l2_normalised, "centroids": centroids, "nearest_centroid": nearest_centroid, "cosine_topk": cosine_topk, "face_clusters": face_clusters,
    "people_view": people_view, "pins_and_names": pins_and_names, "majority_person": majority_person, "home_cluster": home_cluster, "cluster_rename_merge_pin": cluster_rename_merge_pin,
    "folder_plan_people": folder_plan_people, "folder_plan_months": folder_plan_months, "month_orders": month_orders, "captured_at": captured_at, "date_text": date_text,
    "human_bytes": human_bytes, "similarity_words": similarity_words, "sanitize_album": sanitize_album, "path_parts": path_parts,
    "face_quality": face_quality, "square_box": square_box, "removal_plan": removal_plan,
}

_WORDS = r"string_split_regex(trim(lower(text), ' ' || chr(9) || chr(10) || chr(13)), '[ \t\n\r]+')"
_PHOTOS = rf"""photos AS (SELECT doc_id AS id, 'doc_' || doc_id AS name, source AS bucket, '/corpus/' || lang || '/' || source || '/' || doc_id AS relPath, n_chars AS size, n_chars::INT AS width,
  len({_WORDS})::INT AS height, 1700000000 + doc_id * 3600 AS dateModified, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE (1600000000 + doc_id * 86400) * 1000 END AS dateTaken, sha256(text) AS sha, text FROM documents),
scored AS (SELECT *, width::BIGINT * height * 1000 + size // 1024 AS score FROM photos)"""
_GROUPS = f"""{_PHOTOS}, groups AS (SELECT sha, arg_max(id, (score, -dateModified, -id)) AS keeper_id, count(*) AS n, sum(size)::BIGINT AS total FROM scored GROUP BY sha HAVING count(*) > 1),
g AS (SELECT groups.sha, keeper_id, n, (total - size)::BIGINT AS reclaimable FROM groups JOIN photos ON photos.id = keeper_id)"""
_SIG = rf"""{_PHOTOS}, ws AS (SELECT doc_id AS id, {_WORDS} AS w FROM documents), one AS (SELECT id, unnest(w) AS t FROM ws),
two AS (SELECT id, unnest(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS t FROM ws),
toks AS (SELECT id, 0 AS salt, ('0x' || substr(md5(t), 1, 16))::UBIGINT AS h FROM one UNION ALL SELECT id, 1, ('0x' || substr(md5(t), 1, 16))::UBIGINT FROM two),
bits AS (SELECT id, salt, bit, 2 * sum(((h >> bit) & 1)::INT) > count(*) AS is_set FROM toks, range(64) x(bit) GROUP BY ALL),
hashes AS (SELECT id, salt, sum(CASE WHEN is_set THEN 1::UBIGINT << bit ELSE 0::UBIGINT END)::UBIGINT AS h FROM bits GROUP BY ALL),
col AS (SELECT id, list(least(255, 255 * c // greatest(1, n))::INT ORDER BY k) AS sig FROM (SELECT ws.id, k, len(w) AS n, len(list_filter(w, lambda x: ('0x' || substr(md5(x), 1, 8))::UBIGINT % 48 = k)) AS c FROM ws, range(48) y(k)) GROUP BY id),
sig AS (SELECT p.*, coalesce(a.h, 0::UBIGINT) AS ph, coalesce(b.h, 0::UBIGINT) AS dh, col.sig FROM photos p LEFT JOIN hashes a ON a.id = p.id AND a.salt = 0 LEFT JOIN hashes b ON b.id = p.id AND b.salt = 1 JOIN col ON col.id = p.id),
keys AS (SELECT id, (0 << 20) + k * 4096 + ((ph >> (8 * k)) & 255)::INT AS key FROM sig, range(8) z(k) UNION ALL SELECT id, (1 << 20) + k * 4096 + ((dh >> (8 * k)) & 255)::INT FROM sig, range(8) z(k))"""


def _pairs_sql(items: str = "sig", cap: int | None = None) -> str:
    most = f"BETWEEN 2 AND {cap}" if cap else "> 1"
    return f"""kk AS (SELECT keys.* FROM keys WHERE id IN (SELECT id FROM {items})), ok AS (SELECT key FROM kk GROUP BY key HAVING count(*) {most}),
cand AS (SELECT DISTINCT x.id AS a, y.id AS b FROM kk x JOIN kk y ON x.key = y.key AND x.id < y.id WHERE x.key IN (SELECT key FROM ok)),
dist AS (SELECT cand.*, bit_count(xor(p.ph, q.ph))::INT AS dp, bit_count(xor(p.dh, q.dh))::INT AS dd, p.width AS wa, p.height AS ha, q.width AS wb, q.height AS hb, p.sig AS sa, q.sig AS sb FROM cand JOIN sig p ON p.id = a JOIN sig q ON q.id = b)"""


def _level_sql(v: C.Level, cap: int | None = None) -> str:
    total = lambda v, c: f"list_sum(list_transform(range(0, 16), lambda m: {v}[m * 3 + {c} + 1]))"
    part = lambda c: f"((list_sum(list_transform(range(0, 16), lambda k: abs((sa[k * 3 + {c} + 1] - sb[k * 3 + {c} + 1]) * 16 - ({total('sa', c)} - {total('sb', c)}))))::BIGINT + 128) // 256)"
    return f"""{_SIG}, live AS (SELECT * FROM sig WHERE list_max(sig) - list_min(sig) >= {C.FLAT_SPREAD}), {_pairs_sql("live", cap)},
near AS (SELECT *, (({part(0)} + {part(1)} + {part(2)}) // 3)::INT AS dc FROM dist WHERE ((dp <= {v.p_max} AND dd <= {v.d_max}) OR (dp <= {v.p_strict} AND dd <= {v.d_max + 6}) OR (dd <= {v.d_strict} AND dp <= {v.p_max + 4}))
  AND (least(wa, ha, wb, hb) <= 0 OR abs(ln((wa / ha) / (wb / hb))) <= {v.aspect_tol})),
pairs AS (SELECT a, b, dp, dd, dc FROM near WHERE dc <= {v.color_max})"""


_HALVES = f"""{_PHOTOS}, stored AS (SELECT * FROM photos WHERE id % 3 <> 0), fresh AS (SELECT * REPLACE (bucket || '-new' AS bucket, CASE WHEN id % 5 = 0 THEN size + 1 ELSE size END AS size) FROM photos WHERE id % 4 <> 0)"""
_FACES = """faces AS (SELECT vec_id AS faceId, vec_id // 2 AS photoId, ((vec_id * 37 % 100) / 100.0)::DOUBLE AS quality, embedding, (label % 5)::INT AS clusterId, CASE WHEN vec_id % 4 = 0 THEN (label + 1)::BIGINT ELSE 0 END AS personId, vec_id % 16 = 0 AS pinned FROM embeddings),
people AS (SELECT (n_nationkey + 1)::BIGINT AS personId, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE n_name END AS name FROM nation)"""
_CENT = f"""{_FACES}, parts AS (SELECT clusterId, k, sum(embedding[k + 1]::DOUBLE) AS s FROM faces, range(64) r(k) GROUP BY ALL), norms AS (SELECT clusterId, sqrt(sum(s * s)) AS n FROM parts GROUP BY clusterId),
cent AS (SELECT clusterId, k::INT AS k, s / n AS v FROM parts JOIN norms USING (clusterId))"""
_MONTHS = "[" + ", ".join(f"'{m}'" for m in S.MONTHS) + "]"


def _months_sql(source: str) -> str:
    return f"""stamped AS (SELECT id, make_timestamp(ms * 1000) AS ts FROM {source}), m AS (SELECT year(ts) * 100 + month(ts) - 1 AS stamp, count(*) AS n, min(id) AS first_id FROM stamped GROUP BY 1)
SELECT 'month-' || stamp AS key, printf('%04d-%02d %s', stamp // 100, stamp % 100 + 1, {_MONTHS}[stamp % 100 + 1]) AS suggestedName, n, first_id FROM m"""


_KEEP = f"WITH {_PHOTOS} SELECT bucket, {{}} AS keeper_id FROM scored GROUP BY bucket"
_UNITS = ["KB", "MB", "GB", "TB"]
_HUMAN = "CASE WHEN bytes <= 0 THEN '0 B' WHEN bytes < 1024 THEN bytes || ' B' " + " ".join(f"WHEN bytes < {1024 ** (k + 2)} THEN printf('%.1f {u}', floor(bytes / {float(1024 ** (k + 1))}::DOUBLE * 10 + 0.5) / 10)" for k, u in enumerate(_UNITS[:3])) + f" ELSE printf('%.1f TB', floor(bytes / {float(1024**4)}::DOUBLE * 10 + 0.5) / 10) END"

SQL = {
    "exact_groups": f"WITH {_GROUPS} SELECT * FROM g",
    "exact_members": f"WITH {_GROUPS} SELECT s.sha, s.id, g.keeper_id, s.id = g.keeper_id AS is_keeper, 0 AS distance, (row_number() OVER (PARTITION BY s.sha ORDER BY s.id = g.keeper_id DESC, score DESC, s.id) - 1)::INT AS place FROM scored s JOIN g USING (sha)",
    "exact_waste_summary": f"WITH {_GROUPS} SELECT count(*) AS groups, coalesce(sum(n), 0)::BIGINT AS members, coalesce(sum(reclaimable), 0)::BIGINT AS reclaimable FROM g",
    "keeper_best": _KEEP.format("arg_max(id, (score, -dateModified, -id))"),
    "keeper_oldest": _KEEP.format("arg_min(id, (dateModified, id))"),
    "keeper_newest": _KEEP.format("arg_max(id, (dateModified, -id))"),
    "size_tier_candidates": f"WITH {_PHOTOS} SELECT id, size, same FROM (SELECT *, count(*) OVER (PARTITION BY size) AS same FROM photos) WHERE same > 1",
    "head_tier_candidates": f"WITH {_PHOTOS}, t AS (SELECT *, count(*) OVER (PARTITION BY size) AS s1, sha256(array_slice(encode(text), 1, {TEXT_HEAD})) AS head FROM photos) SELECT id, size, head, same FROM (SELECT *, count(*) OVER (PARTITION BY size, head) AS same FROM t WHERE s1 > 1) WHERE same > 1",
    "scope_filter_prefix": f"WITH {_PHOTOS} SELECT id, bucket, relPath FROM photos WHERE (starts_with(relPath, '/corpus/en/src1') OR starts_with(relPath, '/corpus/de')) AND bucket <> 'src11'",
    "album_list": f"WITH {_PHOTOS} SELECT bucket, count(*) AS n FROM photos WHERE starts_with(relPath, '/corpus/en') GROUP BY bucket",
    "band_keys": f"WITH {_SIG} SELECT (key // 4096)::INT AS band, count(*) AS n, count(DISTINCT key) AS keys FROM keys GROUP BY 1",
    "band_bucket_sizes": f"WITH {_SIG}, s AS (SELECT key, count(*) AS n FROM keys GROUP BY key) SELECT n, count(*) AS buckets FROM s GROUP BY n",
    "lsh_candidates": f"WITH {_SIG}, {_pairs_sql(cap=C.BUCKET_CAP)} SELECT a, b FROM cand",
    "hamming_pairs": f"WITH {_SIG}, {_pairs_sql(cap=C.BUCKET_CAP)} SELECT a, b, dp, dd FROM dist WHERE dp <= 7",
    **{f"similar_pairs_{v.name}": f"WITH {_level_sql(v)} SELECT * FROM pairs" for v in C.LEVELS.values()},
    "flat_documents": f"WITH {_SIG} SELECT id, list_max(sig) - list_min(sig) AS spread FROM sig WHERE list_max(sig) - list_min(sig) < 12",
    "similar_components": f"WITH RECURSIVE {_level_sql(C.BALANCED)}, e AS (SELECT a AS x, b AS y FROM pairs UNION SELECT b, a FROM pairs), walk AS (SELECT x, x AS y FROM e UNION SELECT walk.x, e.y FROM walk JOIN e ON walk.y = e.x) SELECT x AS id, min(y) AS component FROM walk GROUP BY x",
    "snapshot_merge": f"""WITH {_HALVES} SELECT coalesce(s.id, f.id) AS id, CASE WHEN f.id IS NULL THEN s.bucket ELSE f.bucket END AS bucket, CASE WHEN f.id IS NULL THEN s.size ELSE f.size END AS size,
  CASE WHEN f.id IS NULL OR s.size = f.size THEN s.sha END AS sha, CASE WHEN s.id IS NOT NULL AND (f.id IS NULL OR s.size = f.size) THEN 7 ELSE 0 END::BIGINT AS dhash, CASE WHEN s.id IS NOT NULL AND (f.id IS NULL OR s.size = f.size) THEN 1 ELSE 0 END::INT AS sigVersion,
  CASE WHEN f.id IS NULL THEN 'gone' WHEN s.id IS NULL THEN 'new' WHEN s.size = f.size THEN 'touched' ELSE 'changed' END AS outcome FROM stored s FULL JOIN fresh f ON s.id = f.id""",
    "snapshot_gone": f"WITH {_HALVES} SELECT id FROM stored WHERE id NOT IN (SELECT id FROM fresh)",
    "cascade_delete": f"WITH {_HALVES}, {_FACES} SELECT faceId, photoId FROM faces WHERE photoId NOT IN (SELECT id FROM stored WHERE id NOT IN (SELECT id FROM fresh))",
    "faces_needing_scan": f"WITH {_PHOTOS} SELECT id FROM photos WHERE NOT (id % 2 = 0 AND id % 6 <> 0 AND id % 10 <> 0)",
    "version_purge": f"WITH {_FACES} SELECT faceId, (faceId % 3)::INT AS embVersion FROM faces WHERE faceId % 3 = 1",
    "l2_normalised": f"WITH {_FACES} SELECT faceId, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS total FROM faces",
    "centroids": f"WITH {_CENT} SELECT clusterId, k, round(v, 6) AS v FROM cent",
    "nearest_centroid": f"WITH {_CENT}, c AS (SELECT clusterId, list(v ORDER BY k) AS c FROM cent GROUP BY 1), s AS (SELECT faceId, c.clusterId, list_dot_product(embedding::DOUBLE[], c.c) AS cosine FROM faces, c) SELECT faceId, arg_max(clusterId, (cosine, clusterId)) AS clusterId, round(max(cosine), 5) AS cosine FROM s GROUP BY faceId",
    "cosine_topk": "WITH s AS (SELECT q.vec_id AS query, e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS cosine FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0), r AS (SELECT *, (row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id) - 1)::INT AS place FROM s) SELECT query, place, vec_id, cosine FROM r WHERE place < 3",
    "people_view": f"""WITH {_FACES}, v AS (SELECT clusterId, arg_max(faceId, (quality, -faceId)) AS coverFace, coalesce(arg_max(personId, (quality, -faceId)) FILTER (personId > 0), 0) AS personId, count(*) AS n_faces, count(DISTINCT photoId) AS n_photos FROM faces WHERE clusterId >= 0 GROUP BY 1)
  SELECT clusterId, v.personId, coalesce(name, '{S.NAMELESS}') AS displayName, coverFace, n_faces, n_photos FROM v LEFT JOIN people USING (personId)""",
    "pins_and_names": f"""WITH {_FACES}, a AS (SELECT faceId, clusterId, personId, pinned OR (personId % 3 = 0 AND personId > 0) AS pinned, clusterId + 50 AS old, quality >= 0.3 AS used FROM faces),
  pins AS (SELECT DISTINCT personId FROM a WHERE used AND pinned AND personId > 0), tally AS (SELECT personId, clusterId, count(*) AS n FROM a WHERE used AND personId > 0 AND NOT pinned AND clusterId >= 0 GROUP BY ALL),
  home AS (SELECT personId, arg_max(clusterId, (n, -clusterId)) AS home FROM tally GROUP BY 1), lives AS (SELECT personId, home FROM pins LEFT JOIN home USING (personId)), top AS (SELECT coalesce(max(clusterId), -1) AS m FROM a WHERE used),
  homes AS (SELECT personId, coalesce(home, m + row_number() OVER (PARTITION BY home IS NULL ORDER BY personId)) AS home FROM lives, top), forced AS (SELECT home AS c, max(personId) AS forced FROM homes GROUP BY 1),
  moved AS (SELECT a.* REPLACE (coalesce(home, clusterId) AS clusterId) FROM a LEFT JOIN homes h ON a.used AND a.pinned AND h.personId = a.personId),
  vote AS (SELECT clusterId AS c, arg_max(personId, (n, -personId)) AS person FROM (SELECT clusterId, personId, count(*) AS n FROM moved WHERE used AND personId > 0 AND clusterId >= 0 GROUP BY ALL) GROUP BY 1)
  SELECT faceId, CASE WHEN used THEN clusterId WHEN pinned THEN old ELSE -1 END::INT AS clusterId, CASE WHEN used THEN coalesce(forced, person, 0) WHEN pinned THEN personId ELSE 0 END::BIGINT AS personId
  FROM moved LEFT JOIN forced ON forced.c = clusterId LEFT JOIN vote ON vote.c = clusterId""",
    "majority_person": f"WITH {_FACES}, c AS (SELECT clusterId, personId, count(*) AS n FROM faces WHERE personId > 0 AND clusterId >= 0 GROUP BY ALL) SELECT clusterId, arg_max(personId, (n, -personId)) AS person FROM c GROUP BY 1",
    "home_cluster": f"WITH {_FACES}, c AS (SELECT clusterId, personId, count(*) AS n FROM faces WHERE personId > 0 AND NOT pinned AND clusterId >= 0 GROUP BY ALL) SELECT personId, arg_max(clusterId, (n, -clusterId)) AS home FROM c GROUP BY 1",
    "cluster_rename_merge_pin": f"""WITH {_FACES}, a AS (SELECT * REPLACE (CASE WHEN clusterId = 1 THEN (SELECT max(personId) + 1 FROM people) ELSE personId END AS personId) FROM faces),
  b AS (SELECT * REPLACE (CASE WHEN clusterId = 3 THEN (SELECT arg_min(personId, faceId) FROM a WHERE clusterId = 2) ELSE personId END AS personId, CASE WHEN clusterId = 3 THEN 2 ELSE clusterId END::INT AS clusterId) FROM a)
  SELECT faceId, CASE WHEN faceId % 7 = 0 THEN 4 ELSE clusterId END::INT AS clusterId, CASE WHEN faceId % 7 = 0 THEN 9 ELSE personId END::BIGINT AS personId, pinned OR faceId % 7 = 0 AS pinned FROM b""",
    "folder_plan_people": f"""WITH {_FACES}, u AS (SELECT clusterId, photoId FROM faces UNION ALL SELECT ((clusterId + 1) % 5)::INT, photoId FROM faces WHERE photoId % 4 = 0), m AS (SELECT u.*, p.personId, p.name FROM u LEFT JOIN people p ON p.personId = clusterId + 1),
  r AS (SELECT clusterId, max(personId) AS personId, max(name) AS name, row_number() OVER (ORDER BY count(DISTINCT photoId) DESC, count(*) DESC, clusterId) AS rk FROM m GROUP BY clusterId), c AS (SELECT photoId, min(rk) AS rk FROM m JOIN r USING (clusterId) GROUP BY 1),
  k AS (SELECT rk, count(*) AS n, min(photoId) AS first FROM c GROUP BY 1 HAVING count(*) >= 2), q AS (SELECT k.*, r.personId, r.name, sum((trim(coalesce(r.name, '')) = '')::INT) OVER (ORDER BY k.rk) AS num FROM k JOIN r USING (rk))
  SELECT 'person-' || personId AS key, CASE WHEN trim(coalesce(name, '')) = '' THEN '{S.PERSON} ' || num::BIGINT ELSE name END AS suggestedName, n, first FROM q""",
    "folder_plan_months": f"WITH {_PHOTOS}, p AS (SELECT id, CASE WHEN dateTaken > 0 THEN dateTaken ELSE dateModified * 1000 END AS ms FROM photos), " + _months_sql("p"),
    "month_orders": "WITH p AS (SELECT o_orderkey AS id, epoch(o_orderdate)::BIGINT * 1000 AS ms FROM orders), " + _months_sql("p"),
    "captured_at": f"WITH {_PHOTOS} SELECT id, CASE WHEN dateTaken > 0 THEN dateTaken ELSE dateModified * 1000 END AS at FROM photos",
    "date_text": f"WITH {_PHOTOS} SELECT id, strftime(epoch_ms(dateModified * 1000), '%d.%m.%Y') AS day FROM photos",
    "human_bytes": f"WITH x AS (SELECT doc_id, n_chars * n_chars * (doc_id % 40) * (doc_id % 40) AS bytes FROM documents) SELECT doc_id, bytes, {_HUMAN} AS text FROM x",
    "similarity_words": f"SELECT doc_id, CASE WHEN doc_id % 9 <= 2 THEN '{S.SIMILARITY_WORDS[0]}' WHEN doc_id % 9 <= 6 THEN '{S.SIMILARITY_WORDS[1]}' ELSE '{S.SIMILARITY_WORDS[2]}' END AS words FROM documents",
    "sanitize_album": r"WITH x AS (SELECT doc_id, trim(replace(text, chr(10), ' ')) AS h FROM documents), y AS (SELECT doc_id, regexp_replace(h, '[^\p{L}\p{N} _-]', '', 'g') AS m, substr(regexp_replace(h, '[^\p{L}\p{N} _.-]', '', 'g'), 1, 60) AS f FROM x) SELECT doc_id, CASE WHEN trim(m) = '' THEN 'Album' ELSE m END AS move, CASE WHEN trim(f) = '' THEN 'Album' ELSE f END AS folder FROM y",
    "path_parts": f"WITH {_PHOTOS} SELECT id, bucket AS label, id::VARCHAR AS last, CASE WHEN id % 2 = 0 THEN '{S.STORAGE_ROOT}/' ELSE '/storage/12-AB/' END || bucket || '/x' AS path FROM photos",
    "face_quality": f"WITH f AS (SELECT {_DETECTED} FROM documents), g AS (SELECT *, least(r - l, b - t) / 900.0::DOUBLE AS rel FROM f WHERE r - l >= 40 AND b - t >= 40 AND abs(yaw) <= 45 AND (eyes OR abs(roll) <= 30)) SELECT doc_id, round(least(rel / 0.35::DOUBLE, 1.0::DOUBLE) * 0.45::DOUBLE + (1 - abs(yaw) / 45.0::DOUBLE) * 0.25::DOUBLE + (1 - least(abs(roll), 30) / 30.0::DOUBLE) * 0.15::DOUBLE + CASE WHEN eyes THEN 0.15::DOUBLE ELSE 0 END, 6) AS quality FROM g",
    "square_box": f"""WITH f AS (SELECT {_DETECTED} FROM documents), s AS (SELECT *, floor(greatest(r - l, b - t) * 1.28::DOUBLE)::INT // 2 AS h, (l + r) // 2 AS cx, (t + b) // 2 - floor((b - t) * 0.04::DOUBLE)::INT AS cy FROM f),
  o AS (SELECT *, -least(0, cx - h) - greatest(0, cx + h - 1000) AS dx, -least(0, cy - h) - greatest(0, cy + h - 900) AS dy FROM s)
  SELECT doc_id, (least(greatest(cx - h + dx, 0), 1000) * 10000 // 1000)::INT AS l, (least(greatest(cy - h + dy, 0), 900) * 10000 // 900)::INT AS t, (least(greatest(cx + h + dx, 0), 1000) * 10000 // 1000)::INT AS r, (least(greatest(cy + h + dy, 0), 900) * 10000 // 900)::INT AS b FROM o""",
    "removal_plan": f"WITH {_PHOTOS} SELECT CASE WHEN id % 3 = 0 THEN 'delete_document' ELSE 'trash' END AS action, count(*) AS n, sum(size)::BIGINT AS bytes FROM photos GROUP BY 1",
}
