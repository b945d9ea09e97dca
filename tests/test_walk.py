"""Folder walks over real trees, and hashing of files of any size."""

import hashlib
import os
import subprocess
import sys

import pytest

from millrace.sources import catalogue, files, walk as W
from tests.test_catalogue import frame, photo


def grow(root, *names, size=10):
    for name in names:
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * size)
    return str(root)


def names(df):
    return sorted(r.relPath for r in df.select("relPath").collect())


def plain_walk(root, most=None, depth_limit=12, known=()):
    """Queue of folders, entries by name."""
    out, queue = [], [("", 0)]
    while queue and (most is None or len(out) < most):
        folder, depth = queue.pop(0)
        try:
            children = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name)
        except OSError:
            continue
        for e in children:
            rel = f"{folder}/{e.name}" if folder else e.name
            if e.name.startswith("."):
                continue
            if e.is_dir():
                if depth < depth_limit:
                    queue.append((rel, depth + 1))
            elif e.name.lower().endswith((".jpg", ".png", ".cr2")) and e.stat().st_size > 0 and f"{root}/{rel}" not in known and (most is None or len(out) < most):
                out.append(f"{root}/{rel}")
    return sorted(out)


TREE = ["_DSC1.jpg", "IMG2.JPG", "_sub/IMG3.jpg", "_sub/_deep/x.cr2", "a/b.jpg", "a/.no.jpg", ".hid/c.jpg", "a/.hid/d.jpg", "z.txt", "b/z.png", "b/a b%20c#d.jpg", "a-b/e.jpg", "a b/f.jpg", "noext", "ä/ö.jpg", "Z/q.png", *["/".join("d" * k) + f"/{k}.jpg" for k in range(1, 15)]]


def test_a_walk_finds_what_a_queue_finds(spark, tmp_path):
    root = grow(tmp_path / "pics", *TREE)
    (tmp_path / "pics" / "empty.jpg").write_bytes(b"")
    found = catalogue.walk(spark, root)
    assert names(found) == plain_walk(root) and {f"{root}/_DSC1.jpg", f"{root}/_sub/IMG3.jpg"} <= set(names(found))
    assert len({r.id for r in found.collect()}) == len(plain_walk(root))
    assert [names(catalogue.walk(spark, root, depth)) for depth in (0, 1, 3)] == [plain_walk(root, None, depth) for depth in (0, 1, 3)]
    uris = {r.name: r.docUri for r in found.collect()}
    assert uris["a b%20c#d.jpg"] == f"file:{root}/b/a b%20c#d.jpg"
    hashes = catalogue.content_hash(found.selectExpr("docUri path")).collect()
    assert {r.hash for r in hashes} == {hashlib.sha256(b"x" * 10).hexdigest()} and len(hashes) == len(uris)


@pytest.mark.parametrize("most", [1, 2, 3, 5, 8, 13, 100])
def test_the_cap_keeps_the_first_breadth_first(spark, tmp_path, most):
    root = grow(tmp_path, *TREE)
    known = {f"{root}/IMG2.JPG", f"{root}/a/b.jpg"}
    assert names(catalogue.walk(spark, root, max_files=most)) == plain_walk(root, most)
    have = frame(spark, *[photo(k, relPath=p) for k, p in enumerate(known)])
    assert names(catalogue.walk(spark, root, max_files=most, known=have)) == plain_walk(root, most, known=known)


def listed(levels, kind="listed"):
    return sorted(r.rel for r in W.whole(levels).where(f"kind = '{kind}'").collect())


def test_only_the_folders_that_count_are_listed(spark, tmp_path):
    root = grow(tmp_path, "a/x.jpg", "a/.thumbs/y.jpg", "b/c/z.jpg", *[f".cache/{k}/p.jpg" for k in range(300)])
    assert listed(W.levels(spark, root, 12)) == ["", "a", "b", "b/c"]
    assert listed(W.levels(spark, root, 1)) == ["", "a", "b"]
    wide = grow(tmp_path / "wide", *[f"f{k}/p.jpg" for k in range(250)])
    assert len(listed(W.levels(spark, wide, 12))) == 251
    seen = []
    W.levels(spark, root, 12, lambda found: bool(seen.append(found.count())) or len(seen) == 2)
    assert len(seen) == 2


def test_a_level_beyond_the_cap_is_not_listed(spark, tmp_path, monkeypatch):
    root = grow(tmp_path, "1.jpg", "2.jpg", "a/3.jpg", "a/b/4.jpg", "a/b/c/5.jpg")
    made, plain = [], W.levels
    monkeypatch.setattr(catalogue, "levels", lambda *args: made.append(plain(*args)) or made[-1])
    assert [catalogue.walk(spark, root, max_files=n).count() for n in (2, 3, 4, 9)] == [2, 3, 4, 5]
    assert [len(x) for x in made] == [1, 2, 3, 4]


def test_folders_that_cannot_be_listed_are_skipped_alone(spark, tmp_path):
    root = grow(tmp_path, "a/x.jpg", "b/y.jpg")
    gone = spark.createDataFrame([("",), ("a",), ("gone",), ("a/x.jpg",), ("b",)], "rel string")
    rows = [tuple(r) for r in W.entries(gone, root).select("rel", "kind").collect()]
    assert sorted(rows) == sorted([("", "listed"), ("a", "folder"), ("b", "folder"), ("a", "listed"), ("a/x.jpg", "file"), ("gone", "failed"), ("a/x.jpg", "failed"), ("b", "listed"), ("b/y.jpg", "file")])
    assert catalogue.walk(spark, str(tmp_path / "nowhere")).count() == 0 and listed(W.levels(spark, str(tmp_path / "nowhere"), 12), "failed") == [""]
    if os.getuid():  # the superuser can list any folder
        os.chmod(tmp_path / "a", 0)
        assert names(catalogue.walk(spark, root)) == [f"{root}/b/y.jpg"]
        os.chmod(tmp_path / "a", 0o700)


def test_roots_are_capped_one_by_one_and_joined(spark, tmp_path):
    one, two = grow(tmp_path / "one", "a.jpg", "_b.jpg", "c/d.jpg"), grow(tmp_path / "two", "_x/e.jpg", "f.jpg", "g.jpg")
    nothing = frame(spark)
    both = catalogue.walk_roots(spark, [one, str(tmp_path / "no"), two, one], nothing)
    assert names(both) == sorted(plain_walk(one) + plain_walk(two))
    assert names(catalogue.walk_roots(spark, [one, two], frame(spark, photo(1, relPath=f"{one}/_b.jpg")), max_files=2)) == sorted([f"{one}/a.jpg", f"{one}/c/d.jpg", f"{two}/f.jpg", f"{two}/g.jpg"])
    assert catalogue.walk_roots(spark, [], nothing) is None


def test_hashes_of_heads_and_wholes(spark, tmp_path):
    sizes = [0, 1, files.CHUNK - 1, files.CHUNK, files.CHUNK + 1, 3 * files.CHUNK + 7]
    data = {str(tmp_path / f"f{n}"): bytes(k % 251 for k in range(n)) for n in sizes}
    for path, content in data.items():
        open(path, "wb").write(content)
    paths = spark.createDataFrame([(p,) for p in [*data, "file:" + next(iter(data)), str(tmp_path / "gone"), str(tmp_path), None]], "path string")
    for limit in (None, 1, files.CHUNK, files.CHUNK + 1, 10**9):
        got = {r.path: (r.hash, r.bytes_read) for r in catalogue.content_hash(paths, limit).collect()}
        want = {p: (hashlib.sha256(c[:limit]).hexdigest(), len(c[:limit])) for p, c in data.items()}
        first = next(iter(data))
        assert got == want | {"file:" + first: want[first], str(tmp_path / "gone"): (None, None), str(tmp_path): (None, None), None: (None, None)}


def test_a_file_over_two_gigabytes_takes_little_memory(tmp_path):
    path = tmp_path / "large.bin"
    size = (2 << 30) + 12345
    with open(path, "wb") as f:
        f.truncate(size)
    code = f"import resource; from millrace.sources import files; print(*files.digest({str(path)!r}), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)"
    sha, read, peak = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), capture_output=True, text=True, check=True).stdout.split()
    zeros, want = bytes(1 << 20), hashlib.sha256()
    for k in range(0, size, 1 << 20):
        want.update(zeros[: min(1 << 20, size - k)])
    assert (sha, int(read)) == (want.hexdigest(), size) and int(peak) < 300_000  # KB
