"""More catalogue queries: sources, writes, lookups, selections and plans over the driver tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace import config as C, queries as Q, schemas
from millrace.functions import scalar as S
from millrace.operators import exact, people as P, regroup, similar as N, snapshot as V, views as W
from millrace.plans import folders
from millrace.sources import catalogue, surrogates as R
from millrace.storage import Workspace

_ROOT = "/storage/emulated/0/Pics"
#: Bucket cap of the query that shows it (the original's, config.BUCKET_CAP, is never reached by the small tables).
SMALL_CAP = 40


def _photos(spark, d) -> DataFrame:
    return R.photos(spark, d).drop("text")


# sources


def _provider_rows(spark, d) -> DataFrame:
    """Rows as a media provider lists them: some paths twice, some fields null, some files empty."""
    p = _photos(spark, d).select(
        "id", F.when(F.col("id") % 5 != 0, F.col("name")).alias("name"), F.when(F.col("id") % 6 != 0, F.col("bucket")).alias("bucket"), F.when(F.col("id") % 7 != 0, F.col("relPath")).alias("relPath"),
        F.when(F.col("id") % 13 == 0, 0).otherwise(F.col("size")).alias("size"), F.when(F.col("id") % 3 != 0, F.col("dateTaken")).alias("dateTaken"), F.when(F.col("id") % 2 == 0, "image/png").alias("mime"),
    )
    again = p.where("id % 4 = 0").withColumn("id", F.col("id") + 1_000_000).withColumn("name", F.lit("again"))
    return p.unionByName(again)


def catalogue_scan(spark, d):
    return catalogue.scan_catalogue(_provider_rows(spark, d))


def _listing(spark, d) -> DataFrame:
    """A folder listing: hidden and deep folders, several endings, some stated kinds, empty files."""
    i = F.col("doc_id")
    ending = F.element_at(F.array(*[F.lit(x) for x in (".JPG", ".txt", "", ".heic", ".tar.png")]), (i % 5 + 1).cast("int"))
    rel = F.concat(F.when(i % 11 == 0, ".hidden/").otherwise(""), F.repeat(F.lit("d/"), (i % 15).cast("int")), F.lit("f"), i.cast("string"), ending)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select(
        F.concat(F.lit("content://tree/"), i.cast("string")).alias("uri"), rel.alias("rel"), F.when(i % 9 == 0, 0).otherwise(F.col("n_chars")).alias("length"),
        (i * 1234567).alias("millis"), F.when(i % 4 == 0, "image/webp").when(i % 4 == 1, "text/plain").alias("mime"),
    )


def _walked(spark, d) -> DataFrame:
    return catalogue.accepted(_listing(spark, d), _ROOT)


def folder_walk(spark, d):
    return _walked(spark, d).select("id", "name", "bucket", "relPath", "size", "dateModified", "mime", "docUri")


def walk_known_anti(spark, d):
    walked = _walked(spark, d).withColumn("relPath", F.when(F.col("size") % 3 != 0, F.col("relPath")))
    known = _walked(spark, d).where("dateModified % 2 = 0").select("relPath", "name", "size")
    return catalogue.not_known(walked, known).select("id", "relPath", "name", "size")


def walk_union(spark, d):
    """Two roots of which the second repeats some files of the first, after the provider's rows."""
    first = _walked(spark, d)
    second = first.where("size % 2 = 0").withColumn("name", F.lit("second")).unionByName(first.where("size % 2 = 1").withColumn("id", F.col("id") + 1).withColumn("relPath", F.concat("relPath", F.lit("x"))))
    rows = _provider_rows(spark, d).unionByName(first.where("size % 5 = 0").select("id", "name", "bucket", "relPath", "size", "dateTaken", "mime"))
    return catalogue.whole_catalogue(rows, catalogue.first_of_roots([first, second])).select("id", "name", "relPath", "size", "docUri")


def tiered_dedup(spark, d):
    photos = R.photos(spark, d).withColumn("sha", F.when(F.col("id") % 3 == 0, F.col("sha")))
    texts = photos.select("id", F.col("text").cast("binary").alias("content"))
    heads = lambda df: df.select("id").join(texts, "id").select("id", exact.head_hash(F.col("content"), Q.TEXT_HEAD).alias("head"))
    whole = lambda df: df.select("id").join(texts, "id").select("id", F.sha2("content", 256).alias("sha"))
    return exact.tiered(photos.drop("text"), heads, whole).select("id", "size", "sha")


# writes


def write_sha(spark, d):
    p = _photos(spark, d).withColumn("sha", F.when(F.col("id") % 2 == 0, F.lit("old")))
    return V.write_sha(p, p.where("id % 3 = 0").select("id", F.concat(F.lit("new"), F.col("id")).alias("sha"))).select("id", "sha")


def _signed_half(spark, d):
    grid = F.array(*[F.lit(k) for k in range(48)])
    return _photos(spark, d).withColumns({"dhash": F.lit(1).cast("bigint"), "phash": F.lit(2).cast("bigint"), "colorSig": F.when(F.col("id") % 2 == 0, grid), "sigVersion": (F.col("id") % 3).cast("int")})


def write_signatures(spark, d):
    p = _signed_half(spark, d)
    rows = p.where("id % 5 = 0").select("id", F.col("id").alias("dhash"), (-F.col("id")).alias("phash"), F.array_repeat(F.lit(9), 48).alias("colorSig"))
    return V.write_signatures(p, rows, 7).select("id", "dhash", "phash", F.element_at("colorSig", 1).alias("first"), "sigVersion")


def needs_signature(spark, d):
    return V.needs_signature(_signed_half(spark, d), 1).select("id")


def needs_full_hash(spark, d):
    photos = R.photos(spark, d).withColumn("head", exact.head_hash(F.col("text").cast("binary"), Q.TEXT_HEAD)).drop("text").withColumn("sha", F.when(F.col("id") % 4 == 0, F.col("sha")))
    return exact.needs_full_hash(exact.head_tier(exact.size_tier(photos))).select("id")


def replace_faces(spark, d):
    f = R.faces(spark, d)
    checkpoints = f.where("photoId % 3 = 0").select("photoId", F.lit(5).cast("bigint").alias("dateModified"), F.lit(1).alias("faceCount"), F.lit(1).alias("embVersion"))
    detected = f.where("photoId % 6 = 0").select("photoId", (F.col("faceId") % 50).cast("int").alias("l"), "t", "r", F.col("faceId").cast("int").alias("b"), F.lit(0.5).alias("quality"), "embedding", "embVersion")
    scans = f.select("photoId", F.lit(1).cast("bigint").alias("dateModified"), F.lit(2).alias("faceCount"), F.lit(1).alias("embVersion")).distinct()
    faces, _ = V.replace_faces(f, scans, detected, checkpoints)
    return faces.select("faceId", "photoId", "b", "clusterId", "personId", "pinned")


def write_clusters(spark, d):
    f = R.faces(spark, d)
    rows = f.where("faceId % 2 = 0").select("faceId", (F.col("faceId") % 7).cast("int").alias("clusterId"), F.lit(3).cast("bigint").alias("personId"))
    return V.write_clusters(f, rows).select("faceId", "clusterId", "personId", "pinned")


def clear_faces(spark, d):
    return V.clear(R.faces(spark, d)).agg(F.count("*").alias("n"))


def migrated(spark, d):
    old = _photos(spark, d).select("id", "name", "size", F.col("dateTaken").cast("string").alias("dateTaken"), F.lit(1).alias("gone"))
    return V.migrate(old, schemas.PHOTOS).select("id", "name", "size", "dateTaken", "sha", "sigVersion")


def forget(spark, d):
    ids = _photos(spark, d).where("id % 4 = 0").select("id")
    faces, scans = R.faces(spark, d), R.faces(spark, d).select("photoId").distinct()
    after = W.forget(_photos(spark, d), faces, scans, R.people(spark, d), ids)
    return after["albums"].select(F.lit("album").alias("kind"), F.col("bucket").alias("name"), "n").unionByName(after["groups"].select(F.lit("group").alias("kind"), F.col("sha").alias("name"), "n")).unionByName(after["people"].select(F.lit("person").alias("kind"), F.col("clusterId").cast("string").alias("name"), F.col("n_faces").alias("n")))


def forget_similar(spark, d):
    """Similar groups after every fourth row has gone, from the groups before."""
    photos = R.signed_photos(spark, d)
    return regroup.without(regroup.solve(photos, C.LOOSE), photos, photos.where("id % 4 = 0").select("id")).groups.drop("component")


# groups


def flat_count(spark, d):
    return N.flat_count(R.signed_photos(spark, d))


def lsh_candidates_capped(spark, d):
    return N.candidates(R.signed_photos(spark, d), SMALL_CAP)


def hamming_links(spark, d):
    """All pairs of ``hamming_pairs`` as one row a document, so that buckets of any size can be checked by SQL."""
    return N.links_in_hash(R.signed_photos(spark, d), 7, Workspace(spark, "links"))


def lsh_links(spark, d):
    """All pairs of ``lsh_candidates`` as one row a document."""
    return N.links_by_byte(R.signed_photos(spark, d), Workspace(spark, "links"))


def similar_pairs_capped(spark, d):
    return N.similar_pairs(R.signed_photos(spark, d), C.BALANCED, SMALL_CAP).select("a", "b", "dp", "dd", "dc")


def _groups(spark, d) -> DataFrame:
    return N.similar_groups(R.signed_photos(spark, d), C.LOOSE)


def similar_places(spark, d):
    return N.places(_groups(spark, d)).select("set_id", "place", "id", "is_keeper", "distance")


def similar_group_order(spark, d):
    return N.group_order(_groups(spark, d))


def group_previews(spark, d):
    members = exact.exact_members(_photos(spark, d)).withColumnRenamed("sha", "set_id")
    return W.previews(members, 1).select("set_id", F.array_join("first", ",").alias("first"), "overflow")


def keeper_override(spark, d):
    """The group of the smallest keeper, with its member of the greatest id as the new keeper."""
    members = exact.exact_members(_photos(spark, d)).select(F.col("keeper_id").alias("set_id"), "id", "keeper_id", "is_keeper", "distance")
    least = members.agg(F.min("set_id")).first()[0]
    if least is None:
        return members
    new = W.group_of_keeper(members, least).agg(F.max("id")).first()[0]
    return N.with_keeper(members, least, new)


def waste_by_kind(spark, d):
    similar = N.group_order(_groups(spark, d))
    return W.total_waste(exact=exact.exact_groups(_photos(spark, d)), similar=similar)


# people


def people_split(spark, d):
    view = P.people_view(R.faces(spark, d), R.people(spark, d))
    mean = view.agg(F.avg("n_faces")).first()[0] or 0
    many, few = P.split_by_size(view, int(mean))
    return many.select("clusterId", "n_faces", F.lit(True).alias("shown")).unionByName(few.select("clusterId", "n_faces", F.lit(False).alias("shown")))


def cluster_members(spark, d):
    return P.members(R.faces(spark, d))


def cover_photos(spark, d):
    view = P.people_view(R.faces(spark, d), R.people(spark, d))
    return P.with_covers(view, R.faces(spark, d), _photos(spark, d).where("id % 2 = 0")).select("clusterId", "coverFace", "coverPhoto", "coverPath")


def person_photos(spark, d):
    return P.person_photos(R.faces(spark, d), _photos(spark, d).where("id % 5 <> 0"), 2).select("id", "relPath")


def person_lookup(spark, d):
    return W.person_of_cluster(P.people_view(R.faces(spark, d), R.people(spark, d)), 3).select("clusterId", "displayName", "n_photos")


def move_photos(spark, d):
    """Photos of cluster 1 to a new person, then some of cluster 2 to cluster 0."""
    faces, people = R.faces(spark, d).drop("embedding"), R.people(spark, d)
    photos = _photos(spark, d)
    faces, people = P.move_photos(faces, people, 1, photos.where("id % 3 = 0").select("id"))
    faces, people = P.move_photos(faces, people, 2, photos.where("id % 4 = 0").select("id"), 0)
    return faces.select("faceId", "clusterId", "personId", "pinned")


def people_after_rename(spark, d):
    faces, people = R.faces(spark, d).drop("embedding"), R.people(spark, d)
    _, people = P.rename(faces, people, 1, "  Anar ")
    _, people = P.rename(faces, people, 2, " Leyla", 3)
    return people


def face_sizes(spark, d):
    return W.face_sizes(R.faces(spark, d)).select("faceId", "width", "height")


# selections and counts


def derived_columns(spark, d):
    p = _signed_half(spark, d).withColumn("docUri", F.when(F.col("id") % 3 == 0, F.col("name")))
    return W.derived(p).select("id", "fromFolder", "capturedAt", "pixels", "hasSignature")


def table_counts(spark, d):
    return W.counts(_photos(spark, d), R.faces(spark, d), V.in_scope(_photos(spark, d), ("/corpus/fr",)))


def selection(spark, d):
    """Ids after add, subtract and two toggles, with what they would free."""
    ids = lambda rule: _photos(spark, d).where(rule).select("id")
    now = W.select(ids("id % 2 = 0"), "add", ids("id % 3 = 0"))
    now = W.select(now, "subtract", ids("id % 10 = 0"))
    now = W.select(now, "toggle", ids("id % 9 = 3"))
    now = W.select(now, "toggle", ids("id % 6 = 3"))
    return now


def selected_bytes(spark, d):
    return W.selected_bytes(_photos(spark, d), selection(spark, d))


def rows_of_ids(spark, d):
    wanted = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id")).where("id % 3 = 0")
    return W.rows_of(_photos(spark, d), wanted).select("id", "name")


# plans


def month_members(spark, d):
    return folders.month_members(_photos(spark, d))


def _plan(spark, d) -> DataFrame:
    plan = folders.month_members(_photos(spark, d)).withColumn("name", F.col("suggestedName")).withColumn("enabled", F.col("photoId") >= 0)
    first = plan.agg(F.min("key")).first()[0]
    last = plan.agg(F.max("key")).first()[0]
    plan = folders.with_choice(plan, first, name=" ") if first else plan
    return folders.with_choice(plan, last, name="A.b/c", enabled=True) if last else plan


def chosen_folders(spark, d):
    return folders.chosen_count(_plan(spark, d))


def organise_plan(spark, d):
    photos = _photos(spark, d).withColumn("docUri", F.when(F.col("id") % 5 == 0, F.col("name")))
    chosen = folders.chosen(_plan(spark, d)).select("photoId", F.col("name").alias("suggestedName"))
    return folders.organise_plan(chosen, photos)


def move_plan(spark, d):
    photos = _photos(spark, d).withColumn("docUri", F.when(F.col("id") % 5 == 0, F.col("name")))
    return folders.move_plan(photos, " Ev. şəkilləri/2 ")


# pictures


def _texts(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")


def _picture(text: str, side: int, channels: int = 3):
    """A picture of a whole text: the pixel grid is filled with its bytes again and again, each round counts once more, and
    every place adds its own share; all modulo 256, as bytes count."""
    import numpy as np

    raw, n = (text or "").encode(), side * side
    rounds = np.frombuffer(raw + bytes(-len(raw) % n), np.uint8).reshape(-1, n)
    once, place = rounds.sum(0, dtype=np.uint8) if len(rounds) != 1 else rounds[0], np.arange(n).astype(np.uint8)
    total = np.arange(len(rounds)).astype(np.uint8) @ rounds + place * np.uint8(6) if len(rounds) > 1 else place * np.uint8(6)
    out, more = np.empty((n, channels), np.uint8), once + place
    for c in range(channels):
        total = total + more
        out[:, c] = total
    return out.reshape(side, side, channels)


def _pixels(text: str, side: int, channel: int):
    """A channel of ``_picture``."""
    return _picture(text, side, channel + 1)[..., channel].astype(int)


def _pictured(spark, d, names: str, one) -> DataFrame:
    import pandas as pd

    columns = [x.split()[0] for x in names.split(", ")]

    def run(frames):
        for f in frames:
            yield pd.DataFrame([(r.doc_id, *one(r.text)) for r in f.itertuples()], columns=columns)

    return _texts(spark, d).mapInPandas(run, names)


def image_signatures(spark, d):
    import numpy as np

    from millrace.functions import images

    def one(text):
        rgb = _picture(text, images.PLANE).astype(int)
        dhash, phash, grid = images.signature(rgb)
        return format(dhash & (1 << 64) - 1, "016x"), format(phash & (1 << 64) - 1, "016x"), ",".join(map(str, grid))

    return _pictured(spark, d, "id bigint, dhash string, phash string, grid string", one)


#: Side of a made picture in which faces are looked for; pictures drawn at once.
_FRAME, _PICTURES = 160, 32


def face_scan(spark, d):
    """Faces of pictures made from whole texts: the gated ones, their boxes, transforms and lengths of embeddings. How many there
    are, where they lie and how they are turned comes from hashes of the text."""
    import numpy as np
    import pyarrow as pa

    from millrace.sources import faces

    def drawn(batches):
        """A few pictures at a time: a batch of short texts makes many times its bytes of pixels."""
        for batch in batches:
            for k in range(0, len(batch), _PICTURES):
                some = batch.slice(k, _PICTURES)
                data = [_picture(text, _FRAME).tobytes() for text in some["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([some["origin"], pa.array(data, pa.binary()), some["detections"]], names=["origin", "data", "detections"])

    def detection(k: int):
        byte = lambda j: F.conv(F.substring(F.md5(F.concat(F.coalesce("text", F.lit("")), F.lit(str(k)))), 2 * j + 1, 2), 16, 10).cast("int")
        left, top, seen = byte(0) % 120 - 20, byte(1) % 120 - 20, byte(6) % 4 > 0
        eye = lambda v: F.when(seen, v.cast("double"))
        fields = {"l": left, "t": top, "r": left + 30 + byte(2) % 80, "b": top + 30 + byte(3) % 80, "yaw": (byte(4) % 101 - 50).cast("double"), "roll": (byte(5) % 81 - 40).cast("double"),
                  "lx": eye(left + byte(7) % 40), "ly": eye(top + byte(8) % 40), "rx": eye(left + byte(9) % 60), "ry": eye(top + byte(10) % 40)}
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    found = F.slice(F.array(*map(detection, range(3))), F.lit(1), F.pmod("doc_id", F.lit(4)).cast("int"))
    photos = _texts(spark, d).select(F.col("doc_id").alias("origin"), "text", found.alias("detections")).mapInArrow(drawn, f"origin bigint, data binary, detections {faces.DETECTIONS}")
    rows = faces.photo_faces(photos.withColumns({"width": F.lit(_FRAME), "height": F.lit(_FRAME), "nChannels": F.lit(3)}))
    cells = [(F.round(F.element_at("transform", k + 1), 6) + F.lit(0.0)).alias(f"m{k}") for k in range(6)]
    return rows.select(F.col("origin").alias("id"), "face", "l", "t", "r", "b", F.round("quality", 6).alias("quality"), *cells, F.size("embedding").alias("dim"))


#: Shares of a brightness step that keep directions off the borders between bins.
_GOLDEN = 0.6180339887498949


def hog_descriptors(spark, d):
    """The descriptor's length, its norm, and a sum in which every component counts with a weight of its own."""
    import numpy as np

    from millrace.functions import images

    def one(text):
        side = images.HOG_SIDE
        gray = _pixels(text, side, 0) + (np.arange(side * side) * _GOLDEN % 1).reshape(side, side)
        v = images.hog(np.repeat(gray[..., None], 3, 2))
        return len(v), round(float((v * v).sum()), 6), round(float((v * (np.arange(len(v)) % 97 + 1)).sum()), 4)

    return _pictured(spark, d, "id bigint, dim int, norm double, total double", one)


def dequantised(spark, d):
    """Bytes of a text as a quantised model's output: their sum and greatest value."""
    import numpy as np

    from millrace.functions import images

    def one(text):
        v = images.dequantised(np.frombuffer((text or "").encode() or b" ", np.uint8), 128, 0.0078125)
        return float(v.sum(dtype=np.float64)), float(v.max())

    return _pictured(spark, d, "id bigint, total double, most double", one)


def activity_by_hour(spark, d):
    from millrace.streaming.incremental import activity

    return activity(spark.read.parquet(f"{d}/events.parquet")).select(F.unix_timestamp("window.start").alias("start"), "event_type", "n")


QUERIES = {
    f.__name__: f
    for f in (
        catalogue_scan, folder_walk, walk_known_anti, walk_union, tiered_dedup, write_sha, write_signatures, needs_signature, needs_full_hash, replace_faces, write_clusters, clear_faces, migrated, forget, forget_similar,
        flat_count, lsh_candidates_capped, hamming_links, lsh_links, similar_pairs_capped, similar_places, similar_group_order, group_previews, keeper_override, waste_by_kind,
        people_split, cluster_members, cover_photos, person_photos, person_lookup, move_photos, people_after_rename, face_sizes,
        derived_columns, table_counts, selection, selected_bytes, rows_of_ids, month_members, chosen_folders, organise_plan, move_plan,
        image_signatures, face_scan, hog_descriptors, dequantised, activity_by_hour,
    )
}


_PROVIDER = f"""{Q._PHOTOS}, prov AS (SELECT id, CASE WHEN id % 5 <> 0 THEN name END AS name, CASE WHEN id % 6 <> 0 THEN bucket END AS bucket, CASE WHEN id % 7 <> 0 THEN relPath END AS relPath,
  CASE WHEN id % 13 = 0 THEN 0 ELSE size END AS size, CASE WHEN id % 3 <> 0 THEN dateTaken END AS dateTaken, CASE WHEN id % 2 = 0 THEN 'image/png' END AS mime FROM photos),
provider AS (SELECT * FROM prov UNION ALL SELECT id + 1000000, 'again', bucket, relPath, size, dateTaken, mime FROM prov WHERE id % 4 = 0)"""


def _scan_sql(source: str, name: str) -> str:
    """Rows with content, one per path, nulls filled."""
    return f"""{name}_f AS (SELECT arg_min(x, x.id) AS r FROM {source} x WHERE size > 0 AND relPath <> '' GROUP BY relPath),
{name}_a AS (SELECT r.id, r.name, r.bucket, r.relPath, r.size, r.dateTaken, r.mime FROM {name}_f UNION ALL SELECT id, name, bucket, relPath, size, dateTaken, mime FROM {source} WHERE size > 0 AND coalesce(relPath, '') = ''),
{name} AS (SELECT id, coalesce(name, split_part(relPath, '/', -1)) AS name, coalesce(bucket, split_part(relPath, '/', -2)) AS bucket, relPath, size, coalesce(dateTaken, 0) AS dateTaken, coalesce(mime, 'image/*') AS mime FROM {name}_a)"""


_ENDINGS = "['.JPG', '.txt', '', '.heic', '.tar.png']"
_EXTENSIONS = ", ".join(f"'{x}'" for x in S.IMAGE_EXTENSIONS)
_WALK = f"""lst AS (SELECT doc_id AS i, 'content://tree/' || doc_id AS uri, CASE WHEN doc_id % 11 = 0 THEN '.hidden/' ELSE '' END || repeat('d/', (doc_id % 15)::INT) AS dir, 'f' || doc_id || {_ENDINGS}[(doc_id % 5 + 1)::INT] AS name,
  CASE WHEN doc_id % 9 = 0 THEN 0 ELSE n_chars END AS size, doc_id * 1234567 AS millis, CASE WHEN doc_id % 4 = 0 THEN 'image/webp' WHEN doc_id % 4 = 1 THEN 'text/plain' END AS mime FROM documents),
fnv AS (SELECT i, list_reduce(list_transform(range(1, len(uri) + 1), lambda k: unicode(uri[k])::UHUGEINT), lambda h, c: (xor(h, c) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT, 14695981039346656037::UHUGEINT) AS h FROM lst),
walked AS (SELECT (h % 70368744177664::UHUGEINT)::BIGINT + 4611686018427387904 AS id, name, CASE WHEN lst.i % 15 = 0 THEN 'Pics' ELSE 'd' END AS bucket, '{_ROOT}/' || dir || name AS relPath, size, millis // 1000 AS dateModified,
  CASE WHEN mime LIKE 'image/%' THEN mime ELSE 'image/*' END AS mime, uri AS docUri FROM lst JOIN fnv USING (i)
  WHERE lst.i % 11 <> 0 AND lst.i % 15 <= 12 AND size > 0 AND (mime LIKE 'image/%' OR (contains(name, '.') AND lower(split_part(name, '.', -1)) IN ({_EXTENSIONS}))))"""


def _not_known(walked: str, known: str) -> str:
    return f"SELECT w.* FROM {walked} w WHERE CASE WHEN relPath IS NOT NULL THEN relPath NOT IN (SELECT relPath FROM {known} WHERE relPath IS NOT NULL) ELSE (name, size) NOT IN (SELECT (name, size) FROM {known}) END"


_TIERS = f"""{Q._PHOTOS}, stored AS (SELECT id, size, CASE WHEN id % 3 = 0 THEN sha END AS sha, sha256(array_slice(encode(text), 1, {Q.TEXT_HEAD})) AS head, sha256(text) AS true_sha FROM photos),
sized AS (SELECT *, count(*) OVER (PARTITION BY size) AS n, count(*) FILTER (sha IS NULL) OVER (PARTITION BY size) AS open FROM stored),
headed AS (SELECT *, count(*) OVER (PARTITION BY size, head) AS same FROM sized WHERE n > 1 AND open > 0)"""
_MAXP = "(SELECT max(personId) FROM people)"


def _groups_sql(level) -> str:
    """Similar groups: components, then the rounds of re-anchoring one after the other."""
    total = lambda v, c: f"list_sum(list_transform(range(0, 16), lambda m: {v}[m * 3 + {c} + 1]))"
    part = lambda c: f"((list_sum(list_transform(range(0, 16), lambda k: abs((p.sig[k * 3 + {c} + 1] - q.sig[k * 3 + {c} + 1]) * 16 - ({total('p.sig', c)} - {total('q.sig', c)}))))::BIGINT + 128) // 256)"
    dp, dd = "bit_count(xor(p.ph, q.ph))::INT", "bit_count(xor(p.dh, q.dh))::INT"
    near = f"""((({dp} <= {level.p_max} AND {dd} <= {level.d_max}) OR ({dp} <= {level.p_strict} AND {dd} <= {level.d_max + 6}) OR ({dd} <= {level.d_strict} AND {dp} <= {level.p_max + 4}))
  AND (least(p.width, p.height, q.width, q.height) <= 0 OR abs(ln((p.width / p.height) / (q.width / q.height))) <= {level.aspect_tol}) AND ({part(0)} + {part(1)} + {part(2)}) // 3 <= {level.color_max})"""
    out = f"""WITH RECURSIVE {Q._level_sql(level)}, e AS MATERIALIZED (SELECT a AS x, b AS y FROM pairs UNION SELECT b, a FROM pairs), walk AS (SELECT x, x AS y FROM e UNION SELECT walk.x, e.y FROM walk JOIN e ON walk.y = e.x),
pool0 AS MATERIALIZED (SELECT x AS id, min(y) AS component FROM walk GROUP BY x), info AS MATERIALIZED (SELECT sig.*, width::BIGINT * height * 1000 + size // 1024 AS score FROM sig WHERE id IN (SELECT id FROM pool0))"""
    for k in range(C.REFINE_ROUNDS):
        out += f""", a{k} AS MATERIALIZED (SELECT component, count(*) AS n, arg_max(id, (score, -id)) AS anchor FROM pool{k} JOIN info USING (id) GROUP BY component),
m{k} AS MATERIALIZED (SELECT o.id, o.component, a.anchor, o.id = a.anchor OR a.n <= {2 if k == 0 else 1} OR {near} AS taken FROM pool{k} o JOIN a{k} a USING (component) JOIN info p ON p.id = o.id JOIN info q ON q.id = a.anchor),
pool{k + 1} AS MATERIALIZED (SELECT id, component FROM m{k} WHERE NOT taken)"""
    placed = " UNION ALL ".join(f"SELECT id, anchor AS set_id FROM m{k} WHERE taken" for k in range(C.REFINE_ROUNDS))
    return out + f""", sets AS ({placed} UNION ALL SELECT id, first_value(id) OVER (PARTITION BY component ORDER BY score DESC, id) FROM pool{C.REFINE_ROUNDS} JOIN info USING (id)),
stats AS (SELECT set_id, count(*) AS n, count(DISTINCT sha) AS kinds, arg_max(id, (score, -dateModified, -id)) AS keeper_id, sum(size) AS total FROM sets JOIN info USING (id) GROUP BY set_id HAVING count(*) > 1 AND count(DISTINCT sha) > 1),
members AS (SELECT s.set_id, s.id, t.keeper_id, s.id = t.keeper_id AS is_keeper, bit_count(xor(p.ph, k.ph))::INT AS distance, (t.total - k.size)::BIGINT AS reclaimable, p.score FROM sets s JOIN stats t USING (set_id) JOIN info p ON p.id = s.id JOIN info k ON k.id = t.keeper_id),
orders AS (SELECT set_id, max(keeper_id) AS keeper_id, count(*) AS n, max(reclaimable) AS reclaimable, max(distance) AS worst FROM members GROUP BY set_id)"""


def _loose() -> str:
    return _groups_sql(C.LOOSE)


_BYTES = "bytes AS MATERIALIZED (SELECT doc_id, k, ('0x' || hex(array_slice(b, k + 1, k + 1)))::INT AS v FROM (SELECT doc_id, encode(coalesce(text, '')) AS b, unnest(range(strlen(coalesce(text, '')))) AS k FROM documents))"


def _picture_sql(side: int, channels: int) -> str:
    n = side * side
    return f"""{_BYTES}, filled AS (SELECT doc_id, k % {n} AS p, c, sum(v * (k // {n} + c + 1)) AS t FROM bytes, range({channels}) z(c) GROUP BY ALL),
pic AS MATERIALIZED (SELECT d.doc_id AS id, p, c, p // {side} AS y, p % {side} AS x, ((coalesce(t, 0) + p * (7 + c)) % 256)::DOUBLE AS v FROM documents d CROSS JOIN range({n}) a(p) CROSS JOIN range({channels}) b(c) LEFT JOIN filled f USING (doc_id, p, c))"""


_LUMA = "max(v) FILTER (c = 0) * 0.299::DOUBLE + max(v) FILTER (c = 1) * 0.587::DOUBLE + max(v) FILTER (c = 2) * 0.114::DOUBLE"
_SIGNATURES = f"""{_picture_sql(32, 3)}, gray AS MATERIALIZED (SELECT id, y, x, {_LUMA} AS v FROM pic GROUP BY id, y, x),
basis AS (SELECT k, n, cos(pi() / 32 * (k * (n + 0.5::DOUBLE))) AS c FROM range(8) a(k), range(32) b(n)),
halfway AS (SELECT id, y, k AS col, sum(v * c) AS s FROM gray JOIN basis ON n = x GROUP BY id, y, k),
dct AS (SELECT id, 8 * k + col AS bit, sum(s * c) AS s FROM halfway JOIN basis ON n = y GROUP BY id, k, col),
middle AS (SELECT id, (l[31] + l[32]) / 2 AS m FROM (SELECT id, list(s ORDER BY s) AS l FROM dct WHERE bit > 0 GROUP BY id)),
ph AS (SELECT id, sum(CASE WHEN bit > 0 AND s > m THEN 1::UBIGINT << bit ELSE 0::UBIGINT END)::UBIGINT AS h FROM dct JOIN middle USING (id) GROUP BY id),
ticks AS (SELECT i, o, least(greatest((i + 0.5::DOUBLE) * 32 / o - 0.5::DOUBLE, 0), 31) AS spot FROM range(9) a(i), (VALUES (8), (9)) b(o) WHERE i < o),
axis AS (SELECT i, o, floor(spot)::INT AS k, least(floor(spot)::INT + 1, 31) AS k2, spot - floor(spot) AS f FROM ticks),
corner AS (SELECT ay.i AS y, ax.i AS x, ay.f AS fy, ax.f AS fx, ay.k AS y1, ay.k2 AS y2, ax.k AS x1, ax.k2 AS x2 FROM axis ay JOIN axis ax ON ay.o = 8 AND ax.o = 9),
around AS (SELECT id, c, o.y, o.x, o.fy, o.fx, max(v) FILTER (pic.y = y1 AND pic.x = x1) AS a, max(v) FILTER (pic.y = y1 AND pic.x = x2) AS b, max(v) FILTER (pic.y = y2 AND pic.x = x1) AS d, max(v) FILTER (pic.y = y2 AND pic.x = x2) AS e
  FROM pic JOIN (SELECT *, unnest([y1, y2]) AS at_y FROM corner) o ON pic.y = o.at_y AND (pic.x = o.x1 OR pic.x = o.x2) GROUP BY ALL),
small AS (SELECT id, y, x, c, floor((a * (1 - fx) + b * fx) * (1 - fy) + (d * (1 - fx) + e * fx) * fy + 0.5::DOUBLE) AS v FROM around),
plane AS (SELECT id, y, x, {_LUMA} AS v FROM small GROUP BY id, y, x),
dh AS (SELECT l.id, sum(CASE WHEN l.v > r.v THEN 1::UBIGINT << (8 * l.y + l.x) ELSE 0::UBIGINT END)::UBIGINT AS h FROM plane l JOIN plane r ON l.id = r.id AND l.y = r.y AND r.x = l.x + 1 GROUP BY l.id),
cells AS (SELECT id, y // 8 AS cy, x // 8 AS cx, c, (sum(v)::BIGINT // 64) AS m FROM pic GROUP BY ALL), grid AS (SELECT id, string_agg(m::VARCHAR, ',' ORDER BY cy, cx, c) AS grid FROM cells GROUP BY id)"""
_HOG = f"""{_picture_sql(64, 1)}, gray AS (SELECT id, y, x, u * 0.299::DOUBLE + u * 0.587::DOUBLE + u * 0.114::DOUBLE AS v FROM (SELECT id, y, x, v + (p * {_GOLDEN}::DOUBLE) % 1 AS u FROM pic)),
grad AS (SELECT id, y, x, lead(v) OVER r - lag(v) OVER r AS gx, lead(v) OVER k - lag(v) OVER k AS gy FROM gray WINDOW r AS (PARTITION BY id, y ORDER BY x), k AS (PARTITION BY id, x ORDER BY y)),
edge AS (SELECT id, y // 8 AS cy, x // 8 AS cx, sqrt(gx * gx + gy * gy) AS size, CASE WHEN atan2(gy, gx) < 0 THEN atan2(gy, gx) + pi() ELSE atan2(gy, gx) END AS angle FROM grad WHERE x BETWEEN 1 AND 62 AND y BETWEEN 1 AND 62),
cell AS (SELECT id, cy, cx, least(floor(angle / pi() * 8), 7)::INT AS bin, sum(CASE WHEN size < 0.0001::DOUBLE THEN 0 ELSE size END) AS s FROM edge GROUP BY ALL),
full_ AS (SELECT d.doc_id AS id, a.cy, b.cx, e.bin, coalesce(s, 0) AS s FROM documents d CROSS JOIN range(8) a(cy) CROSS JOIN range(8) b(cx) CROSS JOIN range(8) e(bin) LEFT JOIN cell f ON f.id = d.doc_id AND f.cy = a.cy AND f.cx = b.cx AND f.bin = e.bin),
block AS (SELECT f.id, by_ * 7 + bx AS k, (f.cy - by_) * 2 + f.cx - bx AS q, f.bin, f.s FROM full_ f, range(7) a(by_), range(7) b(bx) WHERE f.cy - by_ BETWEEN 0 AND 1 AND f.cx - bx BETWEEN 0 AND 1),
norm AS (SELECT id, (k * 4 + q) * 8 + bin AS j, s / sqrt(sum(s * s) OVER (PARTITION BY id, k) + 0.000001::DOUBLE) AS v FROM block),
long AS (SELECT id, sqrt(sum(v * v)) AS l FROM norm GROUP BY id),
desc_ AS (SELECT id, j, CASE WHEN l < 0.00000001::DOUBLE THEN v ELSE v / l END AS v FROM norm JOIN long USING (id))"""
_BYTE = "('0x' || substr(h, 2 * {0} + 1, 2))::INT".format
_FOUND = f"""found AS (SELECT doc_id AS id, k AS face, {_BYTE(0)} % 120 - 20 AS l, {_BYTE(1)} % 120 - 20 AS t, 30 + {_BYTE(2)} % 80 AS w, 30 + {_BYTE(3)} % 80 AS h_, {_BYTE(4)} % 101 - 50 AS yaw, {_BYTE(5)} % 81 - 40 AS roll,
  {_BYTE(6)} % 4 > 0 AS seen, {_BYTE(7)} % 40 AS lx, {_BYTE(8)} % 40 AS ly, {_BYTE(9)} % 60 AS rx, {_BYTE(10)} % 40 AS ry FROM (SELECT doc_id, k, md5(coalesce(text, '') || k) AS h FROM documents, range(3) s(k) WHERE k < doc_id % 4)),
clipped AS (SELECT *, greatest(l, 0) AS cl, greatest(t, 0) AS ct, least(l + w, {_FRAME}) AS cr, least(t + h_, {_FRAME}) AS cb FROM found),
gated AS (SELECT *, cr - cl AS cw, cb - ct AS ch FROM clipped WHERE cr - cl >= 40 AND cb - ct >= 40 AND abs(yaw) <= 45 AND (seen OR abs(roll) <= 30)),
eyes AS (SELECT *, l + least(lx, rx) AS ax, t + CASE WHEN lx <= rx THEN ly ELSE ry END AS ay, abs(rx - lx)::DOUBLE AS dx, CASE WHEN lx <= rx THEN ry - ly ELSE ly - ry END::DOUBLE AS dy FROM gated),
boxes AS (SELECT *, CASE WHEN seen THEN dx * dx + dy * dy END AS gap2, floor(greatest(cw, ch) * 1.28::DOUBLE)::INT AS side, (cl + cr) // 2 AS mx, (ct + cb) // 2 - floor(ch * 0.04::DOUBLE)::INT AS my FROM eyes),
fit AS (SELECT *, CASE WHEN gap2 >= 1 THEN (73.5318::DOUBLE - 38.2946::DOUBLE) * dx / gap2 WHEN seen THEN 112 / (1.35::DOUBLE * 80) ELSE 112 / (1.35::DOUBLE * greatest(cw, ch)) END AS c, CASE WHEN gap2 >= 1 THEN -(73.5318::DOUBLE - 38.2946::DOUBLE) * dy / gap2 ELSE 0 END AS s,
  CASE WHEN gap2 >= 1 THEN ax + dx / 2 WHEN seen THEN ax ELSE (cl + cr) / 2 END AS px, CASE WHEN gap2 >= 1 THEN ay + dy / 2 WHEN seen THEN ay - 4 ELSE (ct + cb) / 2 - 0.05::DOUBLE * ch END AS py,
  CASE WHEN gap2 >= 1 THEN (38.2946::DOUBLE + 73.5318::DOUBLE) / 2 ELSE 56 END AS tx, CASE WHEN gap2 >= 1 THEN (51.6963::DOUBLE + 51.5014::DOUBLE) / 2 ELSE 56 END AS ty,
  -least(0, mx - side // 2) - greatest(0, mx + side // 2 - {_FRAME}) AS ox, -least(0, my - side // 2) - greatest(0, my + side // 2 - {_FRAME}) AS oy FROM boxes)"""
_MONTH_PLAN = f"""{Q._PHOTOS}, stamped AS (SELECT id, size, make_timestamp(CASE WHEN dateTaken > 0 THEN dateTaken ELSE dateModified * 1000 END * 1000) AS ts FROM photos), mm AS (SELECT id, size, year(ts) * 100 + month(ts) - 1 AS stamp FROM stamped),
named AS (SELECT id AS photoId, size, 'month-' || stamp AS key, printf('%04d-%02d %s', stamp // 100, stamp % 100 + 1, {Q._MONTHS}[stamp % 100 + 1]) AS suggestedName FROM mm),
plan AS (SELECT * FROM (SELECT *, CASE WHEN key = (SELECT max(key) FROM named) THEN 'A.bc' WHEN key = (SELECT min(key) FROM named) THEN ' ' ELSE suggestedName END AS name FROM named) WHERE trim(name) <> '')"""

SQL = {
    "catalogue_scan": f"WITH {_PROVIDER}, {_scan_sql('provider', 'scanned')} SELECT * FROM scanned",
    "folder_walk": f"WITH {_WALK} SELECT * FROM walked",
    "walk_known_anti": f"WITH {_WALK}, known AS (SELECT relPath, name, size FROM walked WHERE dateModified % 2 = 0), w AS (SELECT * REPLACE (CASE WHEN size % 3 <> 0 THEN relPath END AS relPath) FROM walked), r AS ({_not_known('w', 'known')}) SELECT id, relPath, name, size FROM r",
    "walk_union": f"""WITH {_PROVIDER}, {_WALK}, both_ AS (SELECT *, 0 AS root FROM walked UNION ALL SELECT * REPLACE ('second' AS name), 1 FROM walked WHERE size % 2 = 0 UNION ALL SELECT * REPLACE (id + 1 AS id, relPath || 'x' AS relPath), 1 FROM walked WHERE size % 2 = 1),
  roots AS (SELECT x.* FROM (SELECT arg_min(b, root) AS x FROM both_ b GROUP BY id)), rows_ AS (SELECT * FROM provider UNION ALL SELECT id, name, bucket, relPath, size, 0, mime FROM walked WHERE size % 5 = 0), {_scan_sql('rows_', 'scanned')},
  fresh AS ({_not_known('roots', 'scanned')}) SELECT id, name, relPath, size, NULL::VARCHAR AS docUri FROM scanned UNION ALL SELECT id, name, relPath, size, docUri FROM fresh""",
    "tiered_dedup": f"WITH {_TIERS} SELECT s.id, s.size, coalesce(s.sha, CASE WHEN h.same > 1 THEN s.true_sha END) AS sha FROM stored s LEFT JOIN headed h ON h.id = s.id",
    "write_sha": f"WITH {Q._PHOTOS} SELECT id, CASE WHEN id % 3 = 0 THEN 'new' || id WHEN id % 2 = 0 THEN 'old' END AS sha FROM photos",
    "write_signatures": f"WITH {Q._PHOTOS} SELECT id, CASE WHEN id % 5 = 0 THEN id ELSE 1 END AS dhash, CASE WHEN id % 5 = 0 THEN -id ELSE 2 END AS phash, CASE WHEN id % 5 = 0 THEN 9 WHEN id % 2 = 0 THEN 0 END::INT AS first, CASE WHEN id % 5 = 0 THEN 7 ELSE id % 3 END::INT AS sigVersion FROM photos",
    "needs_signature": "SELECT doc_id AS id FROM documents WHERE doc_id % 3 < 1 OR doc_id % 2 <> 0",
    "needs_full_hash": f"WITH {Q._PHOTOS}, t AS (SELECT *, count(*) OVER (PARTITION BY size) AS s1, sha256(array_slice(encode(text), 1, {Q.TEXT_HEAD})) AS head FROM photos) SELECT id FROM (SELECT *, count(*) OVER (PARTITION BY size, head) AS same FROM t WHERE s1 > 1) WHERE same > 1 AND id % 4 <> 0",
    "replace_faces": f"""WITH {Q._FACES}, top AS (SELECT max(faceId) AS m FROM faces) SELECT faceId, photoId, 100 AS b, clusterId, personId, pinned FROM faces WHERE photoId % 3 <> 0
  UNION ALL SELECT m + row_number() OVER (ORDER BY photoId, faceId % 50, faceId), photoId, faceId::INT, -1, 0, false FROM faces, top WHERE photoId % 6 = 0""",
    "write_clusters": f"WITH {Q._FACES} SELECT faceId, CASE WHEN faceId % 2 = 0 THEN faceId % 7 ELSE clusterId END::INT AS clusterId, CASE WHEN faceId % 2 = 0 THEN 3 ELSE personId END::BIGINT AS personId, pinned FROM faces",
    "clear_faces": "SELECT 0::BIGINT AS n",
    "migrated": f"WITH {Q._PHOTOS} SELECT id, name, size, dateTaken::BIGINT AS dateTaken, NULL::VARCHAR AS sha, NULL::INT AS sigVersion FROM photos",
    "forget": f"""WITH {Q._PHOTOS}, {Q._FACES}, p AS (SELECT * FROM photos WHERE id % 4 <> 0), f AS (SELECT * FROM faces WHERE photoId NOT IN (SELECT id FROM photos WHERE id % 4 = 0))
  SELECT 'album' AS kind, bucket AS name, count(*) AS n FROM p GROUP BY bucket UNION ALL SELECT 'group', sha, count(*) FROM p GROUP BY sha HAVING count(*) > 1 UNION ALL SELECT 'person', clusterId::VARCHAR, count(*) FROM f WHERE clusterId >= 0 GROUP BY clusterId""",
    "flat_count": f"WITH {Q._SIG} SELECT count(*) AS skipped_flat FROM sig WHERE list_max(sig) - list_min(sig) < 12",
    "lsh_candidates_capped": f"WITH {Q._SIG}, {Q._pairs_sql(cap=SMALL_CAP)} SELECT a, b FROM cand",
    "similar_places": f"{_loose()} SELECT set_id, (row_number() OVER (PARTITION BY set_id ORDER BY is_keeper DESC, distance, score DESC, id) - 1)::INT AS place, id, is_keeper, distance FROM members",
    "similar_group_order": f"{_loose()} SELECT * FROM orders",
    "group_previews": f"WITH {Q._GROUPS}, r AS (SELECT s.sha, s.id, row_number() OVER (PARTITION BY s.sha ORDER BY s.id = g.keeper_id DESC, score DESC, s.id) - 1 AS place, g.n FROM scored s JOIN g USING (sha)) SELECT sha AS set_id, id::VARCHAR AS first, greatest(n - 2, 0) AS overflow FROM r WHERE place = 1",
    "keeper_override": f"""WITH {Q._GROUPS}, m AS (SELECT g.keeper_id AS set_id, s.id FROM scored s JOIN g USING (sha)), chosen AS (SELECT min(set_id) AS least FROM m), new AS (SELECT max(id) AS id FROM m, chosen WHERE set_id = least)
  SELECT m.set_id, m.id, CASE WHEN m.set_id = least THEN new.id ELSE m.set_id END AS keeper_id, m.id = CASE WHEN m.set_id = least THEN new.id ELSE m.set_id END AS is_keeper, CASE WHEN m.set_id = least AND m.id = m.set_id THEN NULL ELSE 0 END AS distance FROM m, chosen, new""",
    "waste_by_kind": f"{_loose()}, x AS (SELECT sha, count(*) AS n, sum(size) - arg_max(size, (width::BIGINT * height * 1000 + size // 1024, -dateModified, -id)) AS r FROM photos GROUP BY sha HAVING count(*) > 1) SELECT 'exact' AS kind, count(*) AS groups, coalesce(sum(n), 0)::BIGINT AS members, coalesce(sum(r), 0)::BIGINT AS reclaimable FROM x UNION ALL SELECT 'similar', count(*), coalesce(sum(n), 0)::BIGINT, coalesce(sum(reclaimable), 0)::BIGINT FROM orders",
    "people_split": f"WITH {Q._FACES}, v AS (SELECT clusterId, count(*) AS n_faces FROM faces WHERE clusterId >= 0 GROUP BY 1) SELECT *, n_faces >= (SELECT floor(avg(n_faces)) FROM v) AS shown FROM v",
    "cluster_members": f"WITH {Q._FACES} SELECT clusterId, (row_number() OVER (PARTITION BY clusterId ORDER BY quality DESC, faceId) - 1)::INT AS place, faceId, photoId, quality FROM faces WHERE clusterId >= 0",
    "cover_photos": f"WITH {Q._PHOTOS}, {Q._FACES}, v AS (SELECT clusterId, arg_max(faceId, (quality, -faceId)) AS coverFace FROM faces WHERE clusterId >= 0 GROUP BY 1) SELECT v.*, f.photoId AS coverPhoto, p.relPath AS coverPath FROM (SELECT clusterId, coverFace FROM v) v JOIN faces f ON f.faceId = coverFace LEFT JOIN photos p ON p.id = f.photoId AND p.id % 2 = 0",
    "person_photos": f"WITH {Q._PHOTOS}, {Q._FACES} SELECT id, relPath FROM photos WHERE id % 5 <> 0 AND id IN (SELECT photoId FROM faces WHERE clusterId = 2)",
    "person_lookup": f"WITH {Q._FACES}, v AS (SELECT clusterId, coalesce(arg_max(personId, (quality, -faceId)) FILTER (personId > 0), 0) AS personId, count(DISTINCT photoId) AS n_photos FROM faces WHERE clusterId = 3 GROUP BY 1) SELECT clusterId, coalesce(name, '{S.NAMELESS}') AS displayName, n_photos FROM v LEFT JOIN people USING (personId)",
    "move_photos": f"""WITH {Q._PHOTOS}, {Q._FACES}, a AS (SELECT faceId, photoId, CASE WHEN hit THEN top + 1 ELSE clusterId END AS clusterId, CASE WHEN hit THEN {_MAXP} + 1 ELSE personId END AS personId, pinned OR hit AS pinned
  FROM (SELECT *, clusterId = 1 AND photoId % 3 = 0 AND photoId IN (SELECT id FROM photos) AS hit, (SELECT max(clusterId) FROM faces) AS top FROM faces)),
  k AS (SELECT min(personId) AS person FROM a WHERE clusterId = 0 AND personId > 0), b AS (SELECT a.*, person, clusterId = 2 AND photoId % 4 = 0 AND photoId IN (SELECT id FROM photos) AS hit FROM a, k)
  SELECT faceId, CASE WHEN hit THEN 0 ELSE clusterId END::INT AS clusterId, CASE WHEN hit THEN person ELSE personId END::BIGINT AS personId, pinned OR hit AS pinned FROM b""",
    "people_after_rename": f"WITH {Q._FACES} SELECT personId, CASE WHEN personId = 3 THEN 'Leyla' ELSE name END AS name FROM people UNION ALL SELECT max(personId) + 1, 'Anar' FROM people",
    "face_sizes": "SELECT vec_id AS faceId, 100 AS width, 100 AS height FROM embeddings",
    "derived_columns": f"WITH {Q._PHOTOS} SELECT id, id % 3 = 0 AS fromFolder, CASE WHEN dateTaken > 0 THEN dateTaken ELSE dateModified * 1000 END AS capturedAt, width::BIGINT * height AS pixels, id % 2 = 0 AND id % 3 >= 1 AS hasSignature FROM photos",
    "table_counts": f"WITH {Q._PHOTOS} SELECT (SELECT count(*) FROM photos) AS photos, (SELECT count(*) FROM embeddings) AS faces, (SELECT count(*) FROM photos WHERE starts_with(relPath, '/corpus/fr')) AS scoped",
    "selection": "SELECT doc_id AS id FROM documents WHERE (((doc_id % 2 = 0 OR doc_id % 3 = 0) AND doc_id % 10 <> 0) OR doc_id % 9 = 3) AND doc_id % 6 <> 3",
    "selected_bytes": "SELECT count(*) AS n, coalesce(sum(n_chars), 0)::BIGINT AS bytes FROM documents WHERE (((doc_id % 2 = 0 OR doc_id % 3 = 0) AND doc_id % 10 <> 0) OR doc_id % 9 = 3) AND doc_id % 6 <> 3",
    "rows_of_ids": f"WITH {Q._PHOTOS} SELECT id, name FROM photos WHERE id IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)",
    "month_members": f"WITH {_MONTH_PLAN} SELECT key, suggestedName, photoId FROM named",
    "chosen_folders": f"WITH {_MONTH_PLAN} SELECT count(DISTINCT key) AS folders, count(photoId) AS photos FROM plan",
    "organise_plan": f"WITH {_MONTH_PLAN} SELECT CASE WHEN photoId % 5 = 0 THEN 'unsupported' ELSE 'relocate' END AS action, photoId, size AS bytes, 'Pictures/' || name || '/' AS target FROM plan",
    "move_plan": "SELECT CASE WHEN doc_id % 5 = 0 THEN 'copy_then_delete' ELSE 'relocate' END AS action, doc_id AS id, n_chars AS bytes, 'Pictures/Ev şəkilləri2/' AS target FROM documents",
    "image_signatures": f"WITH {_SIGNATURES} SELECT d.id, lower(lpad(to_hex(d.h), 16, '0')) AS dhash, lower(lpad(to_hex(p.h), 16, '0')) AS phash, grid FROM dh d JOIN ph p USING (id) JOIN grid USING (id)",
    "face_scan": f"""WITH {_FOUND} SELECT id, face::INT AS face, {", ".join(f"(least(greatest({m} {sign} side // 2 + {o}, 0), {_FRAME}) * 10000 // {_FRAME})::INT AS {name}" for name, m, sign, o in (("l", "mx", "-", "ox"), ("t", "my", "-", "oy"), ("r", "mx", "+", "ox"), ("b", "my", "+", "oy")))},
  round(least(least(cw, ch) / {_FRAME} / 0.35::DOUBLE, 1) * 0.45::DOUBLE + (1 - abs(yaw) / 45::DOUBLE) * 0.25::DOUBLE + (1 - least(abs(roll), 30) / 30::DOUBLE) * 0.15::DOUBLE + CASE WHEN seen THEN 0.15::DOUBLE ELSE 0 END, 6) AS quality,
  {", ".join(f"round({m}, 6) + 0::DOUBLE AS m{k}" for k, m in enumerate(("c", "-s", "tx - c * px + s * py", "s", "c", "ty - s * px - c * py")))}, 1568 AS dim FROM fit""",
    "hog_descriptors": f"WITH {_HOG} SELECT id, count(*)::INT AS dim, round(sum(v * v), 6) AS norm, round(sum(v * (j % 97 + 1)), 4) AS total FROM desc_ GROUP BY id",
    "dequantised": f"WITH {_BYTES}, b AS (SELECT * FROM bytes UNION ALL SELECT doc_id, 0, 32 FROM documents WHERE coalesce(text, '') = '') SELECT doc_id AS id, sum((v - 128) * 0.0078125::DOUBLE) AS total, max((v - 128) * 0.0078125::DOUBLE) AS most FROM b GROUP BY doc_id",
    "activity_by_hour": "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
SQL["hamming_links"] = f"""WITH RECURSIVE {Q._SIG}, {Q._pairs_sql()}, near AS MATERIALIZED (SELECT a, b FROM dist WHERE dp <= 7), e AS MATERIALIZED (SELECT a AS x, b AS y FROM near UNION ALL SELECT b, a FROM near),
walk(id, c) USING KEY (id) AS (SELECT id, id FROM sig UNION SELECT e.x, min(walk.c) FROM walk JOIN e ON e.y = walk.id JOIN recurring.walk AS r ON r.id = e.x WHERE walk.c < r.c GROUP BY e.x)
SELECT id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id FROM walk LEFT JOIN (SELECT x AS id, count(*) AS n FROM e GROUP BY x) USING (id)"""
SQL["lsh_links"] = f"""WITH RECURSIVE {Q._SIG}, {Q._pairs_sql()}, k AS MATERIALIZED (SELECT id, key FROM keys), met AS MATERIALIZED (SELECT a, b FROM cand),
walk(id, c) USING KEY (id) AS (SELECT id, id FROM sig UNION SELECT k.id, min(m.c) FROM (SELECT key, min(c) AS c FROM walk JOIN k USING (id) GROUP BY key) m JOIN k USING (key) JOIN recurring.walk AS r ON r.id = k.id WHERE m.c < r.c GROUP BY k.id)
SELECT id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id FROM walk LEFT JOIN (SELECT id, sum(n) AS n FROM (SELECT a AS id, count(*) AS n FROM met GROUP BY a UNION ALL SELECT b, count(*) FROM met GROUP BY b) GROUP BY id) USING (id)"""
SQL["forget_similar"] = _loose().replace("FROM sig WHERE list_max", "FROM sig WHERE id % 4 <> 0 AND list_max") + " SELECT * FROM members"
SQL["similar_pairs_capped"] = f"WITH {Q._level_sql(C.BALANCED, SMALL_CAP)} SELECT * FROM pairs"
SQL["similar_groups"] = f"{_loose()} SELECT * FROM members"
