"""Scans, ids, folder checksums and listings."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from twinframe.functions.paths import base_name, extension, order_key, parent_path, size_suffix
from twinframe.operators import merkle, tree
from twinframe.operators.numbering import number
from twinframe.operators.session import Session, part
from twinframe.sources import csv_tree

EMPTY = "D41D8CD98F00B204E9800998ECF8427E"

#: A listing of two locations, scanned in this order (kind, path, size, file count, checksum, group).
LISTING = """\
Folder TestDir2 706 10 - -2
File TestDir2/q 0 - D41D8CD98F00B204E9800998ECF8427E 0
File TestDir2/w 410 - - -1
Folder TestDir2/a 62 4 FD6B870D55DB2EE2C8AB46F552D9D5DC 1
File TestDir2/a/g 18 - EFFCC6F94FEED1EFDF1AD2B10520EEF0 2
Folder TestDir2/a/b 44 3 A395AEA66929CF656ECAB8E23787E46E 3
File TestDir2/a/b/l 26 - D172394FA76D347A2E3A26A42BC6177A 4
Folder TestDir2/a/b/j 18 2 560C6EEFAD7CBCE35748E9B5333CDD17 5
File TestDir2/a/b/j/m 0 - D41D8CD98F00B204E9800998ECF8427E 0
File TestDir2/a/b/j/v 18 - 6F3216BAFA7D839686EF0BFD8C29AB06 6
Folder TestDir2/a/b/k 0 0 D41D8CD98F00B204E9800998ECF8427E 7
Folder TestDir2/a/c 0 0 D41D8CD98F00B204E9800998ECF8427E 7
Folder TestDir2/a/d 0 0 D41D8CD98F00B204E9800998ECF8427E 7
Folder TestDir2/e 190 1 - -2
File TestDir2/e/x 190 - - -1
Folder TestDir2/f 44 3 6B3D291D42DEFC162EDB9900D2264453 8
Folder TestDir2/f/b 44 3 A395AEA66929CF656ECAB8E23787E46E 3
File TestDir2/f/b/l 26 - D172394FA76D347A2E3A26A42BC6177A 4
Folder TestDir2/f/b/j 18 2 560C6EEFAD7CBCE35748E9B5333CDD17 5
File TestDir2/f/b/j/m 0 - D41D8CD98F00B204E9800998ECF8427E 0
File TestDir2/f/b/j/v 18 - 6F3216BAFA7D839686EF0BFD8C29AB06 6
Folder TestDir2/f/b/k 0 0 D41D8CD98F00B204E9800998ECF8427E 7
Folder TestDir1 104 3 - -2
File TestDir1/file1.txt 0 - D41D8CD98F00B204E9800998ECF8427E 0
File TestDir1/file2.txt 78 - - -1
Folder TestDir1/folder1 26 1 FCC2DA11FEB2F67A237927A4CC18867F 9
File TestDir1/folder1/l 26 - D172394FA76D347A2E3A26A42BC6177A 4
"""


def _locations():
    rows = [x.split() for x in LISTING.splitlines()]
    for root in ("TestDir2", "TestDir1"):
        files = [(p, int(s), h if h != "-" else "F" * 32) for k, p, s, _, h, _ in rows if k == "File" and p.startswith(root)]
        folders = [(p,) for k, p, *_ in rows if k == "Folder" and p.startswith(root)]
        yield root, files, folders


def _scanned(spark):
    session = Session(spark)
    for root, files, folders in _locations():
        session.scan(spark.createDataFrame(files, "path string, size long, checksum string"), root, spark.createDataFrame(folders, "path string"))
    return session


def test_two_locations(spark, tmp_path):
    session = _scanned(spark)
    got = [(r.kind, r.path, str(r.size), "-" if r.file_count is None else str(r.file_count), r.checksum or "-", str(r.group_id)) for r in session.nodes.orderBy("ord").collect()]
    assert got == [tuple(x.split()) for x in LISTING.splitlines()]
    # Again: nothing changes. Then out and in again: the same lines.
    root, files, folders = next(_locations())
    session.scan(spark.createDataFrame(files, "path string, size long, checksum string"), root)
    assert session.nodes.count() == 27
    session.export_csv(str(tmp_path / "a.csv"))
    lines = (tmp_path / "a.csv").read_text().splitlines()
    assert lines[0] == csv_tree.HEADER and lines[2] == f'File,"TestDir2/q",0,,"",{EMPTY}, 0' and lines[1] == 'Folder,"TestDir2",706,10,,,-2'
    other = Session(spark)
    assert other.import_csv(str(tmp_path / "a.csv")).count() == 0
    other.export_csv(str(tmp_path / "b.csv"))
    assert sorted((tmp_path / "b.csv").read_text().splitlines()) == sorted(lines)


def _simulate(locations):
    """The scans, step by step."""
    sizes, hashes, ids, seen, out = {}, {}, {}, [], {}
    for root, files in locations:
        seen.append((root, files))
        for _, s, _ in files:
            sizes[s] = sizes.get(s, 0) + 1
        for _, fs in seen:
            for p, s, h in fs:
                if sizes[s] > 1:
                    hashes[p] = h

        def visit(folder, fs):
            below = [f for f in fs if f[0].startswith(folder + "/")]
            own = sorted(f for f in below if "/" not in f[0][len(folder) + 1 :])
            subs = sorted({folder + "/" + f[0][len(folder) + 1 :].split("/")[0] for f in below if "/" in f[0][len(folder) + 1 :]})
            sums = {s: visit_sum(s, fs) for s in subs}
            parts = [hashes.get(f[0]) for f in own] + [sums[s] for s in subs]
            me = None if None in parts else hashlib.md5("".join(parts).encode()).hexdigest().upper()
            yield ("Folder", folder, me)
            for f in own:
                yield ("File", f[0], hashes.get(f[0]))
            for s in subs:
                yield from visit(s, fs)

        def visit_sum(folder, fs):
            return next(visit(folder, fs))[2]

        for r, fs in seen:
            for kind, path, h in visit(r, fs):
                if h is not None and (kind, h) not in ids:
                    ids[kind, h] = len(ids)
                out[path] = (-1 if kind == "File" else -2) if h is None else ids[kind, h]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests(spark, seed):
    rng = random.Random(seed)
    locations = []
    for n in range(3):
        files = set()
        for _ in range(rng.randrange(3, 9)):
            path = "/".join([f"r{n}", *[rng.choice("ab") for _ in range(rng.randrange(0, 3))], f"f{rng.randrange(9)}"])
            files.add(path)
        locations.append((f"r{n}", [(p, s := rng.choice([1, 1, 2, 2, 3, 4, 5, 6]), hashlib.md5(f"{s}{rng.randrange(2)}".encode()).hexdigest().upper()) for p in sorted(files)]))
    want = _simulate(locations)
    session, whole = Session(spark), None
    for n, (root, files) in enumerate(locations):
        df = spark.createDataFrame(files, "path string, size long, checksum string")
        session.scan(df, root)
        part = df.select(F.lit(n).alias("location_seq"), F.lit(root).alias("root"), "path", "size", "checksum")
        whole = part if whole is None else whole.unionByName(part)
    assert {r.path: r.group_id for r in session.nodes.collect()} == want
    closed, _ = merkle.group_ids(merkle.nodes(whole, tree.folders(whole)))
    assert {r.path: r.group_id for r in closed.collect()} == want


def test_directory(spark, tmp_path):
    root = tmp_path / "x"
    (root / "sub" / "none").mkdir(parents=True)
    (root / ".hidden").write_text("aa")
    (root / "_under").write_text("bb")
    (root / "nil").write_text("")
    (root / "sub" / "twin").write_text("aa")
    (root / "link").symlink_to(root / "sub")
    s = Session(spark).scan(str(root))
    got = {r.path[len(str(root)) :]: (r.size, r.checksum, r.group_id) for r in s.nodes.collect()}
    assert set(got) == {"", "/sub", "/sub/none", "/.hidden", "/_under", "/nil", "/sub/twin"}
    assert got["/.hidden"][2] == got["/sub/twin"][2] != got["/_under"][2] and got["/nil"][1] is None and got["/sub/none"][1] == EMPTY
    assert got[""][0] == 6 and got[""][2] == -2
    missing = Session(spark).scan(str(tmp_path / "gone"))
    assert [(r.checksum, r.group_id) for r in missing.nodes.collect()] == [(None, -2)]


@pytest.mark.parametrize(
    "text, message",
    [
        ("", "Empty File"),
        ("a,b,c\n", "Insufficient number of headings detected"),
        ("{h}\nFile,\"a\",1,,\"\",,0\nOther,\"b\",1,,\"\",,0\n", "Error parsing data on row 2"),
        ("{h}\nFile,\"a\",x,,\"\",,0\n", "Error parsing data on row 1"),
        ("{h}\nFolder,\"a\",1,,,,0\n", "Error parsing data on row 1"),
        ("{h}\nFile,\"a,b\",1,,\"\",, 0\n", "Error parsing data on row 1"),
        ("{h}\nFile,\"a\",1,,\"\",\n", "Error parsing data on row 1"),
    ],
)
def test_listing_errors(spark, tmp_path, text, message):
    p = tmp_path / "l.csv"
    p.write_text(text.replace("{h}", csv_tree.HEADER))
    with pytest.raises(csv_tree.InvalidFormat, match=message):
        csv_tree.read(spark, str(p))


def test_lenient_listing(spark, tmp_path):
    p = tmp_path / "l.csv"
    p.write_text(csv_tree.HEADER + '\nFolder,"d",1,1,,,-2\nFile,"d/a,b",1,,".c",AA, 3\nFile,"e/z",1,,"",,-1\n')
    rows, lost = csv_tree.read(spark, str(p), lenient=True)
    assert {(r.path, r.group_id) for r in rows.collect()} == {("d", -2), ("d/a,b", 3)} and [r.path for r in lost.collect()] == ["e/z"]


def test_paths(spark):
    df = spark.createDataFrame([("a/b.tar.gz",), ("a.b/c",), (".hid",), ("x.",), ("c:\\d\\e.f",)], "p string")
    p = F.col("p")
    got = [tuple(r) for r in df.select(extension(p), parent_path(p), base_name(p)).collect()]
    assert got == [(".gz", "a", "b.tar.gz"), ("", "a.b", "c"), (".hid", None, ".hid"), ("", None, "x."), (".f", "c:\\d", "e.f")]


def test_size_suffix(spark):
    df = spark.createDataFrame([(0,), (999,), (1000,), (-1024,), (1536,), (1 << 60,), (None,)], "v long")
    assert [r[0] for r in df.select(size_suffix(F.col("v"))).collect()] == ["0.0 bytes", "999.0 bytes", "1.0 KB", "-1.0 KB", "1.5 KB", None, None]
    with pytest.raises(ValueError):
        size_suffix(F.col("v"), -1)


def test_progress(spark, tmp_path):
    assert [part(x) for x in (-0.2, 1.3, 0.5, None)] == [0, 1, 0.5, 0]
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "f").write_text("x")
    told = []
    Session(spark).scan(str(tmp_path / "a"), progress=lambda step, done: told.append((step, done)))
    assert [s for s, d in told if d == 0] == ["list", "hash", "fold", "group"]
    assert all(0 <= d <= 1 for _, d in told) and any(0 < d < 1 for s, d in told if s == "fold") and dict(told) == dict.fromkeys(["list", "hash", "fold", "group"], 1.0)


def test_numbering_in_ranges(spark):
    df = spark.range(0, 1000).select((F.lit(5000) - F.col("id") * 3).alias("k"))
    got = sorted((r.k, r.n) for r in number(df, ["k"], "n", 7, small=10).collect())
    assert [n for _, n in got] == list(range(7, 1007))


def test_gate_either_way(spark, monkeypatch):
    from twinframe.operators import duplicates

    df = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("c", 2, "yy"), ("d", 3, None), ("e", 3, "zzz"), ("f", None, "q")], "path string, size long, content string")
    few = {r.path: r.checksum for r in duplicates.gated_checksums(df).collect()}
    monkeypatch.setattr(duplicates, "BROADCAST_SIZES", -1)
    assert few == {r.path: r.checksum for r in duplicates.gated_checksums(df).collect()}
    assert few["a"] == few["b"] == hashlib.md5(b"x").hexdigest().upper() and few["c"] is few["d"] is few["f"] is None and few["e"]


def test_empty_session(spark, tmp_path):
    Session(spark).export_csv(str(tmp_path / "e.csv"))
    assert (tmp_path / "e.csv").read_text() == csv_tree.HEADER + "\n"


def test_stream(spark, tmp_path):
    from twinframe.streaming.incremental import feed

    schema = "path string, size long, checksum string"
    for n in range(2):
        spark.createDataFrame([(f"batch{n}/a", 1, "A"), (f"batch{n}/b", n + 2, f"B{n}")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    session = Session(spark)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    feed(session, stream, str(tmp_path / "cp"), root=lambda n: f"batch{n}").awaitTermination(120)
    ids = {r.path: r.group_id for r in session.nodes.filter("kind = 'File'").collect()}
    assert len(ids) == 4 and sorted(ids.values()) == [-1, -1, 0, 0]


def test_unique_sizes_are_not_hashed(spark):
    """Contents of a unique size are not hashed until another scan brings the second one."""
    rel = lambda *rows: spark.createDataFrame(rows, "path string, size long, content string")
    session = Session(spark).scan(rel(("p/a", 1, "x"), ("p/b/c", 2, "yy"), ("p/b/d", 3, "zzz"), ("p/e", 3, "www")), "p")
    by = lambda: {r.path: (r.checksum, r.group_id) for r in session.nodes.collect()}
    first, sums = by(), {k: hashlib.md5(k.encode()).hexdigest().upper() for k in ("x", "yy", "zzz")}
    assert first["p/a"] == first["p/b/c"] == (None, -1) and first["p/b/d"][0] == sums["zzz"] and first["p/b"][0] is None
    session.scan(rel(("q/f", 2, "yy")), "q")
    second = by()
    assert second["p/a"] == (None, -1) and second["p/b/c"][0] == second["q/f"][0] == sums["yy"]
    assert second["p/b"][0] == hashlib.md5((sums["yy"] + sums["zzz"]).encode()).hexdigest().upper()
    assert all(second[k] == v for k, v in first.items() if v[1] >= 0) and session.nodes.count() == 8


def test_listing_from_directories(spark, tmp_path):
    """The tree of LISTING as real files; contents that it has hashes of are fixed values, others filled to their size."""
    known = {"D172394FA76D347A2E3A26A42BC6177A": None, EMPTY: b""}
    rows = [x.split() for x in LISTING.splitlines()]
    for kind, path, size, _, md5, _ in rows:
        at = tmp_path / path
        if kind == "Folder":
            at.mkdir(parents=True, exist_ok=True)
        else:
            # The same hash, the same bytes: groups do not depend on which.
            at.write_bytes(known.get(md5) or (md5.encode() * 30 if md5 != "-" else path.encode() * 99)[: int(size)])
    session = Session(spark)
    for root in ("TestDir2", "TestDir1"):
        session.scan(str(tmp_path / root))
    got = [(r.kind, r.path[len(str(tmp_path)) + 1 :], str(r.size), "-" if r.file_count is None else str(r.file_count), str(r.group_id)) for r in session.nodes.orderBy("ord").collect()]
    assert got == [(k, p, s, n, g) for k, p, s, n, _, g in (tuple(r) for r in rows)]


def test_locations_that_are_refused(spark, tmp_path):
    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "f").write_text("a file")
    with pytest.raises(NotADirectoryError):
        Session(spark).scan(str(tmp_path / "f"))
    strict = Session(spark, refuse_overlap=True).scan(str(tmp_path / "x"))
    for other in (tmp_path, tmp_path / "x" / "z"):
        with pytest.raises(ValueError, match="overlaps"):
            strict.scan(str(other))
    assert strict.scan(str(tmp_path / "x" / "y")).nodes.count() == 2


def test_collation(spark):
    files = spark.createDataFrame([(f"r/{n}", 1, n.upper()) for n in ("b", "B", "a", "A", "_x")], "path string, size long, checksum string")
    session = Session(spark, collation="UNICODE").scan(files, "r")
    assert [r.path[2:] for r in session.files.orderBy("ord").collect()] == ["_x", "a", "A", "b", "B"]
    plain = Session(spark).scan(files, "r")
    assert [r.path[2:] for r in plain.files.orderBy("ord").collect()] == ["A", "B", "_x", "a", "b"]
    sums = [s.folders.first().checksum for s in (session, plain)]
    assert sums == [hashlib.md5(t.encode()).hexdigest().upper() for t in ("_XAABB", "AB_XAB")]


def test_order_keys_of_many_locations(spark):
    seqs = [0, 9, 100_000, 1_000_001, 1_000_002, 2**31 - 1]
    df = spark.createDataFrame([(n, "p/f") for n in reversed(seqs)], "n int, path string")
    keyed = df.select("n", order_key(F.col("n"), F.col("path"), F.lit(True)).alias("ord"))
    assert [r.n for r in keyed.orderBy("ord").collect()] == seqs and keyed.select("ord").distinct().count() == 6


def test_numbers_beyond_int(spark):
    got = number(spark.range(3), ["id"], "n", 2**31)
    assert [r.n for r in got.orderBy("id").collect()] == [2**31, 2**31 + 1, 2**31 + 2]
    assert [r.n for r in number(spark.range(3), ["id"], "n", 2**31, small=1).orderBy("id").collect()] == [2**31, 2**31 + 1, 2**31 + 2]


def test_command_line(spark, tmp_path):
    from twinframe.__main__ import bar, main

    for d in ("a", "b"):
        (tmp_path / d).mkdir()
        (tmp_path / d / ".same").write_text("same")
    out = tmp_path / "out.csv"
    assert main(["scan", "-d", f"{tmp_path}/a,{tmp_path}/b", "-o", str(out), "--log", str(tmp_path / "log.txt")]) == 0
    lines = out.read_text().splitlines()
    assert lines[0] == csv_tree.HEADER and len(lines) == 5 and "list" in (tmp_path / "log.txt").read_text()
    assert main(["scan", "-d", f"{tmp_path}/a", "-o", str(tmp_path / "no" / "out.csv"), "--log", str(tmp_path / "log.txt")]) == 0
    assert bar(0.25, 1) == "[#####---------------]  25% /"


def test_cancel(spark):
    import threading
    import time

    @F.udf("string")
    def slow(x):
        time.sleep(60)
        return x

    session, failed = Session(spark), []

    def run():
        try:
            session.scan(spark.createDataFrame([("p/a", 1, "x")], "path string, size long, content string").withColumn("content", slow("content")), "p", hash_all=True)
        except Exception as e:
            failed.append(e)

    t = threading.Thread(target=run)
    t.start()
    for _ in range(40):
        time.sleep(0.5)
        session.cancel()
        if failed:
            break
    t.join(60)
    assert failed and session.nodes is None


def test_parallel_export(spark, tmp_path):
    files = spark.createDataFrame([(f"r/{n % 50}/{n}", 1, "A") for n in range(2000)], "path string, size long, checksum string")
    session = Session(spark).scan(files, "r")
    # Else so few rows are one range.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    csv_tree.export(session.nodes, str(tmp_path / "parts"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    session.export_csv(str(tmp_path / "one.csv"))
    parts = sorted((tmp_path / "parts").glob("part-*"))
    one = (tmp_path / "one.csv").read_text()
    assert len(parts) > 1 and "".join(p.read_text() for p in parts) == one and len(one.splitlines()) == 2052
    want = [r.line for r in csv_tree.lines(session.nodes).orderBy("ord").collect()]
    assert one.splitlines() == [csv_tree.HEADER, *want]
