"""Parameters of the operators."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class KeeperRule(Enum):
    BEST_QUALITY = "best"
    OLDEST = "oldest"
    NEWEST = "newest"


@dataclass(frozen=True)
class Level:
    """Similarity thresholds; the strict halves are integer halves."""

    name: str
    p_max: int
    d_max: int
    color_max: int
    aspect_tol: float

    @property
    def p_strict(self) -> int:
        return self.p_max // 2

    @property
    def d_strict(self) -> int:
        return self.d_max // 2


#: Fixed values: (hash, gradient hash, colour, aspect) limits by level.
STRICT = Level("strict", 4, 8, 14, 0.15)
BALANCED = Level("balanced", 8, 12, 22, 0.30)
LOOSE = Level("loose", 12, 18, 34, 0.60)
LEVELS = {x.name: x for x in (STRICT, BALANCED, LOOSE)}
#: Cosine thresholds of a learned embedder and of the gradient-histogram one.
FACE_THRESHOLD = {"strict": 0.72, "balanced": 0.62, "loose": 0.52}
HOG_THRESHOLD = {"strict": 0.88, "balanced": 0.82, "loose": 0.75}
#: Head bytes, bucket cap, flat spread, least face quality, rounds of re-anchoring, centroid cap.
HEAD_BYTES, BUCKET_CAP, FLAT_SPREAD, FACE_QUALITY, REFINE_ROUNDS, MERGE_CAP = 65_536, 4_000, 12, 0.30, 32, 3_000
SIG_VERSION = 1
#: Long and short side at which faces are looked for.
FACE_DETAIL = {"normal": (1280, 480), "high": (1920, 720)}


@dataclass(frozen=True)
class Prefs:
    """User settings; unknown names fall back to the defaults."""

    similarity: str = "balanced"
    face_level: str = "balanced"
    keeper_rule: str = "best"
    use_trash: bool = True
    min_people_group: int = 2
    excluded_buckets: tuple[str, ...] = ()
    scan_roots: tuple[str, ...] = ()
    face_detail: str = "normal"

    def update(self, **changes) -> Prefs:
        """New settings; values that ``read`` would not take are left as they are."""
        now = self.__dict__ | changes
        taken = Prefs.read(now)
        return Prefs(**{k: getattr(self, k) if k in changes and now[k] != (list(v) if isinstance(now[k], list) else v) else v for k, v in taken.__dict__.items()})

    @classmethod
    def read(cls, stored: dict) -> Prefs:
        known = {k: v for k, v in stored.items() if k in cls.__dataclass_fields__}
        for key, allowed in (("similarity", LEVELS), ("face_level", LEVELS), ("face_detail", FACE_DETAIL), ("keeper_rule", {r.value for r in KeeperRule})):
            if key in known and known[key] not in allowed:
                known.pop(key)
        for key in ("excluded_buckets", "scan_roots"):
            if key in known:
                known[key] = tuple(known[key])
        return cls(**known)


def scan_version(embedder_version: int, detail: str = "normal") -> int:
    """Version stamp of stored faces: changes with the embedder and with the detail."""
    return embedder_version + list(FACE_DETAIL).index(detail) * 7919


def model_version(length: int, dim: int) -> int:
    return 2000 + length % 900_000 + dim
