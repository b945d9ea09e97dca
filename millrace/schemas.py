"""Explicit schemas of the stored tables."""

from __future__ import annotations

PHOTOS = "id bigint, name string, bucket string, relPath string, size bigint, width int, height int, dateAdded bigint, dateModified bigint, dateTaken bigint, mime string, sha string, dhash bigint, phash bigint, colorSig array<int>, sigVersion int, docUri string"
FACES = "faceId bigint, photoId bigint, l int, t int, r int, b int, quality float, embedding array<float>, embVersion int, clusterId int, personId bigint, pinned boolean"
FACE_SCAN = "photoId bigint, dateModified bigint, faceCount int, embVersion int"
PEOPLE = "personId bigint, name string"
