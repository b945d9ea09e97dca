"""Grouping embedding vectors into identities, and edits of the result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.config import FACE_QUALITY, MERGE_CAP
from millrace.functions import scalar as S
from millrace.functions.scalar import NAMELESS
from millrace.operators.ranked import numbered, placed
from millrace.operators.seeding import SEED_BLOCK, list_array, matrix, merged, seeded, unit
from millrace.operators.vectors import best_matches
from millrace.storage import Workspace, scratch

#: Added to the threshold when clusters are merged, and its bound.
MERGE_MARGIN, MERGE_BOUND = 0.04, 0.97
#: Centroids up to this size go along with every task; more are met block by block.
SENT_BYTES = 64 << 20


def usable(faces: DataFrame, quality: float = FACE_QUALITY) -> DataFrame:
    return faces.where(F.col("embedding").isNotNull() & (F.col("quality") >= quality))


def nearest(vectors: DataFrame, centroids: np.ndarray, vec_col: str = "embedding", id_col: str = "faceId", sent_bytes: int = SENT_BYTES) -> DataFrame:
    """Adds ``near`` and ``cosine``: the best centroid (the later of equal ones), -1 for vectors of another length. Few
    centroids go along with the task, many meet the vectors in blocks."""
    if centroids.nbytes > sent_bytes:
        flat = pa.FixedSizeListArray.from_arrays(pa.array(centroids.ravel()), centroids.shape[1]).cast(pa.list_(pa.float64()))
        table = vectors.sparkSession.createDataFrame(pa.table({"c": pa.array(-np.arange(len(centroids))), "v": flat}))
        found = best_matches(vectors.select(id_col, F.col(vec_col).alias("v")), table, 1, id_col, "c", "v")
        found = found.select(F.col("query").alias(id_col), (-F.col("item")).cast("int").alias("near"), "cosine")
        return vectors.join(found, id_col, "left").fillna({"near": -1, "cosine": -1.0}).select(*vectors.columns, "near", "cosine")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            at = batch.schema.get_field_index(vec_col) if at is None else at
            rows = batch.column(at).to_pylist()
            near, best = np.full(len(rows), -1, np.int32), np.full(len(rows), -1.0)
            good = [k for k, v in enumerate(rows) if v is not None and len(v) == centroids.shape[1]]
            if good and len(centroids):
                cosine = np.array([rows[k] for k in good], float) @ centroids.T
                pick = cosine.shape[1] - 1 - np.argmax(cosine[:, ::-1], 1)
                near[good], best[good] = pick, cosine[np.arange(len(good)), pick]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near), pa.array(best)], names=[*batch.schema.names, "near", "cosine"])

    from pyspark.sql.types import DoubleType, IntegerType, StructType

    schema = StructType([*vectors.schema.fields]).add("near", IntegerType()).add("cosine", DoubleType())
    return vectors.mapInArrow(run, schema)


def nearest_cluster(faces: DataFrame, centers: DataFrame) -> DataFrame:
    """``faceId, clusterId, cosine``: the best centroid of each face, block by block, however many centroids there are; the
    later cluster of equal ones. ``centers`` has ``clusterId, centroid``."""
    negated = centers.select((-F.col("clusterId")).cast("bigint").alias("c"), F.col("centroid").alias("v"))
    found = best_matches(faces.select("faceId", F.col("embedding").alias("v")), negated, 1, "faceId", "c", "v")
    return found.select(F.col("query").alias("faceId"), (-F.col("item")).cast("int").alias("clusterId"), "cosine")


def home_cluster(assigned: DataFrame) -> DataFrame:
    """A person's home: the cluster with most of their unpinned assigned faces; the smallest id of equals."""
    counts = assigned.where("personId > 0 and not pinned and clusterId >= 0").groupBy("personId", "clusterId").agg(F.count("*").alias("n"))
    return counts.groupBy("personId").agg(F.max_by("clusterId", F.struct("n", -F.col("clusterId"))).alias("home"))


def majority_person(assigned: DataFrame) -> DataFrame:
    """A cluster's name: the person most of its faces had; the smallest id of equals."""
    counts = assigned.where("personId > 0 and clusterId >= 0").groupBy("clusterId", "personId").agg(F.count("*").alias("n"))
    return counts.groupBy("clusterId").agg(F.max_by("personId", F.struct("n", -F.col("personId"))).alias("person"))


def with_people(assigned: DataFrame, ws: Workspace) -> DataFrame:
    """``faceId, clusterId, personId`` of faces with the cluster that they were put in (-1: none). ``assigned``: faceId,
    clusterId, personId, pinned, old (their earlier cluster) and used (faces that take part).

    Pinned faces go to their person's home or, where the person has none, to a new cluster, and that cluster is the
    person's: a pin outranks the vote of the cluster's faces. Of two persons who are at home in one cluster, the greater
    id has it. Faces that take no part stay where a pin put them, or are parked.
    """
    used = assigned.where("used")
    pins = used.where("pinned and personId > 0").select("personId").distinct()
    at = ws.save(pins.join(home_cluster(used), "personId", "left"), "homes")
    following = used.agg(F.coalesce(F.max("clusterId"), F.lit(-1)) + 1).first()[0]
    new = numbered(at.where("home is null").select("personId"), ["personId"], "k", ws).select("personId", (F.lit(following) + F.col("k")).cast("int").alias("home"))
    homes = ws.save(at.where("home is not null").unionByName(new), "all-homes")
    moved = assigned.join(homes.select(F.col("personId").alias("_p"), "home"), F.col("used") & F.col("pinned") & (F.col("personId") == F.col("_p")), "left").withColumn("clusterId", F.coalesce("home", "clusterId"))
    forced = homes.groupBy(F.col("home").alias("_h")).agg(F.max("personId").alias("forced"))
    names = majority_person(moved.where("used")).withColumnRenamed("clusterId", "_c")
    named = moved.join(names, F.col("clusterId") == F.col("_c"), "left").join(forced, F.col("clusterId") == F.col("_h"), "left")
    stays, parked = ~F.col("used") & F.col("pinned"), ~F.col("used") & ~F.col("pinned")
    return named.select(
        "faceId", F.when(stays, F.col("old")).when(parked, -1).otherwise(F.col("clusterId")).cast("int").alias("clusterId"),
        F.when(stays, F.col("personId")).when(parked, 0).otherwise(F.coalesce("forced", "person", F.lit(0))).cast("bigint").alias("personId"),
    )


def _merged(centers: DataFrame, n: int, dim: int, threshold: float, merge_cap: int | None) -> tuple[DataFrame, DataFrame | None]:
    """``clusterId, total`` after one merge pass, and where each cluster went (None: nowhere). More than ``merge_cap``
    clusters are not merged, as the original has it; with None the driver holds the centroids of any number."""
    if n < 2 or merge_cap is not None and n > merge_cap:
        return centers, None
    table = centers.orderBy("clusterId").toArrow()
    totals = matrix(table["total"], dim)
    into = merged(totals, min(threshold + MERGE_MARGIN, MERGE_BOUND))
    roots, compact = np.unique(into, return_inverse=True)
    sums = np.zeros((len(roots), dim))
    np.add.at(sums, compact, totals)
    spark = centers.sparkSession
    moves = spark.createDataFrame(pa.table({"seeded": pa.array(np.arange(n)), "into": pa.array(compact.astype(np.int64))}))
    return spark.createDataFrame(pa.table({"clusterId": pa.array(np.arange(len(roots))), "total": list_array(sums)}), "clusterId bigint, total array<double>"), moves


def _settled(vectors: DataFrame, centers: DataFrame, n: int, dim: int, sent_bytes: int) -> DataFrame:
    """``faceId, near, cosine`` against the centroids of a table."""
    if n * dim * 8 <= sent_bytes:
        return nearest(vectors, unit(matrix(centers.orderBy("clusterId").select("total").toArrow()["total"], dim))).select("faceId", "near", "cosine")
    found = nearest_cluster(vectors, centers.select("clusterId", S.l2_normalised(F.col("total")).alias("centroid")))
    return found.select("faceId", F.col("clusterId").alias("near"), "cosine")


def cluster(faces: DataFrame, threshold: float, seed_block: int = SEED_BLOCK, ws: Workspace | None = None, merge_cap: int | None = MERGE_CAP, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """``faceId, clusterId, personId``. Usable faces, best quality first, seed clusters block by block (``seeding``), the
    clusters are merged once, and then every face settles with the nearest centroid in parallel; pins, names and parking
    are joins. Vectors of another length than the best face's belong to no cluster. No result depends on ``seed_block``."""
    spark = faces.sparkSession
    ws = scratch(spark, "people", ws)
    order = [F.col("quality").desc(), F.col("faceId")]
    best = usable(faces).orderBy(*order).select(F.size("embedding").alias("dim")).first()
    dim = best.dim if best else 0
    good = usable(faces).where(F.size("embedding") == dim)
    ordered = ws.save(numbered(good.select("faceId", "quality", F.col("embedding").cast("array<double>").alias("embedding")), order, "position", ws).select("position", "faceId", "embedding"), "ordered")
    start, centers, n = seeded(ordered, ordered.count(), dim, threshold, ws, seed_block)
    centers, moves = _merged(centers, n, dim, threshold, merge_cap)
    if moves is not None:
        start, n = start.join(moves, "seeded").select("faceId", F.col("into").alias("seeded")), centers.count()
    settled = _settled(ordered.select("faceId", "embedding"), centers, n, dim, sent_bytes)
    placed_ = start.join(settled, "faceId", "left").select("faceId", F.when(F.col("cosine") >= threshold, F.col("near")).otherwise(F.col("seeded")).cast("int").alias("place"))
    ok = F.col("embedding").isNotNull() & F.coalesce(F.col("quality") >= FACE_QUALITY, F.lit(False))
    now = faces.select("faceId", "personId", "pinned", F.col("clusterId").alias("old"), ok.alias("used")).join(placed_, "faceId", "left")
    return with_people(ws.save(now.select("faceId", F.coalesce("place", F.lit(-1)).alias("clusterId"), "personId", "pinned", "old", "used"), "placed"), ws)


def people_view(faces: DataFrame, people: DataFrame) -> DataFrame:
    """``clusterId, personId, displayName, coverFace, n_faces, n_photos``, largest first. ``members`` lists the faces."""
    live = faces.where("clusterId >= 0")
    view = live.groupBy("clusterId").agg(
        F.max_by("faceId", F.struct("quality", -F.col("faceId"))).alias("coverFace"),
        F.coalesce(F.max_by(F.col("personId"), F.when(F.col("personId") > 0, F.struct("quality", -F.col("faceId")))), F.lit(0)).alias("personId"),
        F.count("*").alias("n_faces"), F.count_distinct("photoId").alias("n_photos"),
    )
    joined = view.join(people.select(F.col("personId").alias("_p"), "name"), F.col("personId") == F.col("_p"), "left")
    return joined.select("clusterId", "personId", F.coalesce("name", F.lit(NAMELESS)).alias("displayName"), "coverFace", "n_faces", "n_photos").orderBy(F.col("n_faces").desc(), "clusterId")


def members(faces: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """``clusterId, place, faceId, photoId, quality``: the faces of each cluster, best quality first."""
    ws = scratch(faces.sparkSession, "members", ws)
    rows = faces.where("clusterId >= 0").select("clusterId", "faceId", "photoId", "quality", (-F.col("quality")).alias("minus"))
    return placed(rows, "clusterId", ["minus", "faceId"], ws).select("clusterId", "place", "faceId", "photoId", "quality")


def split_by_size(view: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """People with at least so many faces, and the others, which are shown apart."""
    return view.where(F.col("n_faces") >= least), view.where(F.col("n_faces") < least)


def person_photos(faces: DataFrame, photos: DataFrame, cluster_id: int) -> DataFrame:
    """The photos of a cluster, each once; faces whose photo is gone have none."""
    ids = faces.where(F.col("clusterId") == cluster_id).select(F.col("photoId").alias("id")).distinct()
    return photos.join(ids, "id", "left_semi")


def with_covers(view: DataFrame, faces: DataFrame, photos: DataFrame) -> DataFrame:
    """The people view with the cover's photo and its path, null where the photo is gone."""
    cover = faces.select(F.col("faceId").alias("coverFace"), F.col("photoId").alias("coverPhoto"))
    paths = photos.select(F.col("id").alias("coverPhoto"), F.col("relPath").alias("coverPath"))
    return view.join(cover, "coverFace", "left").join(paths, "coverPhoto", "left")


def centroids(faces: DataFrame) -> DataFrame:
    """``clusterId, centroid``: unit sums of the member vectors, added by position so a large cluster combines first."""
    parts = faces.where("clusterId >= 0").select("clusterId", F.posexplode("embedding").alias("k", "v")).groupBy("clusterId", "k").agg(F.sum(F.col("v").cast("double")).alias("s"))
    joined = parts.groupBy("clusterId").agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("norm"), F.array_sort(F.collect_list(F.struct("k", "s"))).alias("parts"))
    return joined.select("clusterId", F.transform("parts", lambda p: F.when(F.col("norm") < 1e-8, p["s"]).otherwise(p["s"] / F.col("norm"))).alias("centroid"))


def next_cluster(faces: DataFrame) -> int:
    return faces.agg(F.coalesce(F.max("clusterId"), F.lit(-1)) + 1).first()[0]


def create_person(people: DataFrame, name: str = "") -> tuple[DataFrame, int]:
    new = (people.agg(F.coalesce(F.max("personId"), F.lit(0)) + 1).first()[0])
    return people.unionByName(people.sparkSession.createDataFrame([(new, name)], "personId bigint, name string")), new


def rename(faces: DataFrame, people: DataFrame, cluster_id: int, name: str, person: int = 0) -> tuple[DataFrame, DataFrame]:
    """Name a cluster: an existing person is renamed, else a new one made; every face of the cluster is stamped."""
    name = name.strip()
    if person > 0:
        people = people.withColumn("name", F.when(F.col("personId") == person, F.lit(name)).otherwise(F.col("name")))
    else:
        people, person = create_person(people, name)
    return faces.withColumn("personId", F.when(F.col("clusterId") == cluster_id, F.lit(person)).otherwise(F.col("personId"))), people


def ensure_person(faces: DataFrame, people: DataFrame, cluster_id: int) -> tuple[DataFrame, DataFrame, int]:
    known = faces.where((F.col("clusterId") == cluster_id) & (F.col("personId") > 0)).agg(F.min("personId")).first()[0]
    if known:
        return faces, people, known
    people, person = create_person(people)
    return faces.withColumn("personId", F.when(F.col("clusterId") == cluster_id, F.lit(person)).otherwise(F.col("personId"))), people, person


def pin(faces: DataFrame, ids: DataFrame, cluster_id: int, person: int) -> DataFrame:
    joined = faces.join(ids.select(F.col("faceId").alias("_f")).distinct(), F.col("faceId") == F.col("_f"), "left")
    hit = F.col("_f").isNotNull()
    return joined.withColumn("clusterId", F.when(hit, F.lit(cluster_id)).otherwise(F.col("clusterId"))).withColumn("personId", F.when(hit, F.lit(person)).otherwise(F.col("personId"))).withColumn("pinned", hit | F.col("pinned")).select(*faces.columns)


def merge_clusters(faces: DataFrame, into: int, sources: list[int]) -> DataFrame:
    """Repoint the sources' faces to the target and its person, which may be nobody."""
    person = faces.where(F.col("clusterId") == into).agg(F.min_by("personId", "faceId")).first()[0] or 0
    hit = F.col("clusterId").isin(sources)
    return faces.withColumn("personId", F.when(hit, F.lit(person)).otherwise(F.col("personId"))).withColumn("clusterId", F.when(hit, F.lit(into)).otherwise(F.col("clusterId")))


def move_photos(faces: DataFrame, people: DataFrame, source: int, photos: DataFrame, target: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Pin the cluster's faces on these photos to another cluster, or to a new one with a new person."""
    ids = faces.where(F.col("clusterId") == source).join(photos.select(F.col("id").alias("photoId")).distinct(), "photoId", "left_semi").select("faceId")
    if target is None:
        target = next_cluster(faces)
        people, person = create_person(people)
    else:
        faces, people, person = ensure_person(faces, people, target)
    return pin(faces, ids, target, person), people
