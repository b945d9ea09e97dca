"""Column expressions: text, dates, bits, arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: Month names of folders, labels of distances, size units, image extensions.
MONTHS = ["Yanvar", "Fevral", "Mart", "Aprel", "May", "İyun", "İyul", "Avqust", "Sentyabr", "Oktyabr", "Noyabr", "Dekabr"]
SIMILARITY_WORDS = ("demək olar eyni", "çox oxşar", "oxşar")
UNITS = ("B", "KB", "MB", "GB", "TB")
IMAGE_EXTENSIONS = "jpg jpeg png heic heif gif bmp tif tiff webp dng raw cr2 cr3 nef arw orf rw2 avif".split()
#: Folder labels without a parent and at the storage root; names of people without one.
NO_PARENT, STORAGE_LABEL, NAMELESS, PERSON = "Digər", "Daxili yaddaş", "Adsız", "Şəxs"
STORAGE_ROOT = "/storage/emulated/0"


def extension(name: Column) -> Column:
    return F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).otherwise("")


def is_hidden(name: Column) -> Column:
    return name.startswith(".")


def folder_label(path: Column, root: str = STORAGE_ROOT) -> Column:
    """Name of the parent folder; fixed labels at the storage root and where there is no parent."""
    parent = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(parent == "", NO_PARENT).when(parent == root, STORAGE_LABEL).otherwise(F.substring_index(parent, "/", -1))


def tree_path(doc_id: Column, root: str = STORAGE_ROOT) -> Column:
    """``primary:A/B`` is below the storage root, ``volume:A`` below /storage/volume; trailing slashes go."""
    volume, rest = F.substring_index(doc_id, ":", 1), F.get(F.split(doc_id, ":", 2), F.lit(1))
    base = F.when(volume == "primary", F.lit(root)).otherwise(F.concat(F.lit("/storage/"), volume))
    return F.rtrim(F.when(F.coalesce(rest, F.lit("")) == "", base).otherwise(F.concat(base, F.lit("/"), rest)), F.lit("/"))


def root_label(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _album(name: Column, drop: str, most: int | None, fallback: str) -> Column:
    kept = F.regexp_replace(F.trim(name), drop, "")
    kept = F.substring(kept, 1, most) if most else kept
    return F.when(F.trim(F.coalesce(kept, F.lit(""))) == "", fallback).otherwise(kept)


def sanitize_move(name: Column, fallback: str = "Album") -> Column:
    """Album name for a move: letters, digits, blank, underscore, hyphen."""
    return _album(name, r"[^\p{L}\p{N} _-]", None, fallback)


def sanitize_folder(name: Column, fallback: str = "Album") -> Column:
    """Album name for a plan: dots too, 60 characters at most."""
    return _album(name, r"[^\p{L}\p{N} _.-]", 60, fallback)


def human_bytes(n: Column) -> Column:
    out = F.format_string(f"%.1f {UNITS[-1]}", n / F.lit(float(1024 ** (len(UNITS) - 1))))
    for k in range(len(UNITS) - 2, 0, -1):
        out = F.when(n < 1024 ** (k + 1), F.format_string(f"%.1f {UNITS[k]}", n / F.lit(float(1024**k)))).otherwise(out)
    return F.when(n <= 0, "0 B").when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(out)


def similarity_words(distance: Column) -> Column:
    return F.when(distance <= 2, SIMILARITY_WORDS[0]).when(distance <= 6, SIMILARITY_WORDS[1]).otherwise(SIMILARITY_WORDS[2])


def captured_at(date_taken: Column, date_modified: Column) -> Column:
    """Milliseconds: the capture time, else the file time."""
    return F.when(date_taken > 0, date_taken).otherwise(date_modified * 1000)


def month_stamp(millis: Column) -> Column:
    """year * 100 + month counted from zero, in the session's zone."""
    at = F.timestamp_millis(millis)
    return F.year(at) * 100 + F.month(at) - 1


def month_name(stamp: Column) -> Column:
    year, month = F.floor(stamp / 100).cast("int"), (stamp % 100).cast("int")
    return F.format_string("%04d-%02d %s", year, month + 1, F.element_at(F.array(*[F.lit(m) for m in MONTHS]), month + 1))


def date_text(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "dd.MM.yyyy")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def bands(value: Column, salt: int) -> Column:
    """The eight byte keys of a 64-bit hash: (salt << 20) | (band << 12) | byte."""
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.lit(salt << 20) + k * 4096 + F.call_function("shiftrightunsigned", value, k * 8).bitwiseAND(255).cast("int"))


def quality_score(width: Column, height: Column, size: Column) -> Column:
    return width.cast("bigint") * height * 1000 + F.floor(size / 1024).cast("bigint")


def aspect_ok(wa: Column, ha: Column, wb: Column, hb: Column, tolerance: float) -> Column:
    unknown = (wa <= 0) | (ha <= 0) | (wb <= 0) | (hb <= 0)
    return F.when(unknown, True).otherwise(F.abs(F.ln((wa / ha) / (wb / hb))) <= tolerance)


def _channel(sig: Column, c: int) -> Column:
    return F.filter(sig, lambda x, k: k % 3 == c)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda s, x: s + x)


def _channel_gap(x: Column, y: Column) -> Column:
    """The shift is bound by ``transform``: an expression inside a lambda is evaluated for every element."""
    gap = lambda shift: _total(F.zip_with(x, y, lambda p, q: F.abs((p - q) * 16 - shift)))
    return F.get(F.transform(F.array(_total(x) - _total(y)), gap), F.lit(0))


def color_distance(a: Column, b: Column) -> Column:
    """Mean absolute difference of mean-free channels, rounded half up, summed, divided by three; all in integers."""
    parts = []
    for c in range(3):
        x, y = _channel(a, c), _channel(b, c)
        gap = _channel_gap(x, y)
        parts.append(F.floor((gap + 128) / 256))
    return F.when((F.size(a) == 48) & (F.size(b) == 48), F.floor(reduce(lambda p, q: p + q, parts) / 3).cast("int")).otherwise(2**31 - 1)


def color_spread(sig: Column) -> Column:
    return F.array_max(sig) - F.array_min(sig)


def dot(a: Column, b: Column) -> Column:
    """Cosine of unit vectors; -1 where sizes differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(-1.0)


def l2_normalised(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.when(norm < 1e-8, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def face_quality(rel: Column, yaw: Column, roll: Column, has_eyes: Column) -> Column:
    return F.least(rel / 0.35, F.lit(1.0)) * 0.45 + (1 - F.abs(yaw) / 45) * 0.25 + (1 - F.least(F.abs(roll), F.lit(30.0)) / 30) * 0.15 + F.when(has_eyes, 0.15).otherwise(0.0)


def face_gate(width: Column, height: Column, yaw: Column, roll: Column, has_eyes: Column) -> Column:
    return (width >= 40) & (height >= 40) & (F.abs(yaw) <= 45) & (has_eyes | (F.abs(roll) <= 30))


def square_box(l: Column, t: Column, r: Column, b: Column, width: Column, height: Column) -> Column:  # noqa: E741
    """Square box with headroom, slid into the frame, clamped, in ten-thousandths of the frame."""
    side = F.floor(F.greatest(r - l, b - t) * F.lit(1.28)).cast("int")
    half = F.floor(side / 2).cast("int")
    cx, cy = F.floor((l + r) / 2).cast("int"), F.floor((t + b) / 2).cast("int") - F.floor((b - t) * F.lit(0.04)).cast("int")
    low, high, left, right = cy - half, cy + half, cx - half, cx + half
    dx = -F.least(F.lit(0), left) - F.greatest(F.lit(0), right - width)
    dy = -F.least(F.lit(0), low) - F.greatest(F.lit(0), high - height)
    scaled = lambda v, frame: F.floor(F.least(F.greatest(v, F.lit(0)), frame) * 10000 / frame).cast("int")
    return F.struct(scaled(left + dx, width).alias("l"), scaled(low + dy, height).alias("t"), scaled(right + dx, width).alias("r"), scaled(high + dy, height).alias("b"))
