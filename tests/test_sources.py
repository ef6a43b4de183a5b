"""Folders as a source and a sink, and sizes from headers."""

import os
import struct
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quarrymill.sources import folders, ingest


@pytest.fixture
def tree(tmp_path):
    for k in range(12):
        (tmp_path / f"d{k}" / "deep" / "er").mkdir(parents=True)
        (tmp_path / f"d{k}" / f"a{k}.png").write_bytes(b"x" * k)
        (tmp_path / f"d{k}" / "deep" / "er" / f"b{k}.JPG").write_bytes(b"yy")
    (tmp_path / "empty.png").write_bytes(b"")
    (tmp_path / "note.txt").write_text("no image")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "c.png").write_bytes(b"z")
    (tmp_path / "link.png").symlink_to(tmp_path / "d3" / "a3.png")
    (tmp_path / "loop").symlink_to(tmp_path)
    return tmp_path


def test_folders_are_listed_in_partitions(spark, tree):
    want = {f"a{k}.png": k for k in range(12)} | {f"b{k}.JPG": 2 for k in range(12)} | {"empty.png": 0}
    assert {r.name: r.length for r in ingest.scan_files(spark, str(tree)).collect()} == want
    assert {r.name: r.length for r in ingest.scan_files(spark, f"file://{tree}", most=5).collect()} == {k: n for k, n in want.items() if n <= 5}
    linked = {r.name for r in ingest.scan_files(spark, str(tree), links=True).filter("is_link").collect()}
    assert linked == {"link.png"}  # a link to a folder isn't followed, and has no known ending
    reader = folders.FolderReader({"path": str(tree)})
    parts = reader.partitions()
    assert len(parts) > 20 and len({p.folder for p in parts}) == len(parts)
    every = [path for p in parts for path, *_ in reader.read(p)]
    assert len(every) == len(set(every)) == len(want) + 3  # the note and both links too
    assert ingest.scan_files(spark, str(tree / "gone")).count() == 0
    folders.register(spark)
    shown = spark.read.format("folder").option("path", str(tree)).option("hidden", "true").option("endings", "png").load()
    assert {os.path.basename(r.path) for r in shown.collect()} == {f"a{k}.png" for k in range(12)} | {"empty.png", "c.png", "link.png"}


def files_in(folder):
    return {os.path.relpath(os.path.join(d, n), folder): open(os.path.join(d, n)).read() for d, _, names in os.walk(folder) for n in names}


def test_text_files_are_written_whole_or_not_at_all(spark, tmp_path):
    folders.register(spark)
    rows = spark.createDataFrame([(f"p{i % 3}/{i}.txt", None if i == 4 else f"caption é {i}") for i in range(40)], "name string, text string").repartition(4)
    good = tmp_path / "good"
    rows.write.format("text_files").option("path", str(good)).mode("append").save()
    assert files_in(good) == {f"p{i % 3}/{i}.txt": "" if i == 4 else f"caption é {i}" for i in range(40)}
    rows.withColumn("text", F.lit("again")).write.format("text_files").option("path", str(good)).mode("append").save()
    assert set(files_in(good).values()) == {"again"} and not [d for d in os.listdir(good) if d.startswith(".")]

    bad = tmp_path / "bad"
    broken = rows.withColumn("text", F.when(F.col("name") == "p2/38.txt", F.raise_error(F.lit("no text"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="no text"):
        broken.write.format("text_files").option("path", str(bad)).mode("append").save()
    assert files_in(bad) == {}
    out = spark.createDataFrame([("../out.txt", "x")], "name string, text string")
    with pytest.raises(Exception, match="leads out"):
        out.write.format("text_files").option("path", str(bad)).mode("append").save()
    assert files_in(bad) == {} and not (tmp_path / "out.txt").exists()


def test_a_task_that_outlives_an_abort_leaves_nothing(tmp_path, monkeypatch):
    """The job is aborted while one of its tasks goes on with further files, in old and in new folders."""
    monkeypatch.setattr(folders, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(taskAttemptId=lambda: 7)))
    for later in ("p/b.txt", "q/r/b.txt"):
        writer = folders.TextFileWriter({"path": str(tmp_path / "out")})

        def rows(writer=writer, later=later):
            yield Row(name="p/a.txt", text="a")
            assert os.path.exists(f"{writer.staging}/7/p/a.txt")
            writer.abort([])
            yield Row(name=later, text="b")

        with pytest.raises(OSError):
            writer.write(rows())
        assert os.listdir(tmp_path / "out") == []


def test_a_repeated_attempt_leaves_one_file(tmp_path):
    """Two attempts of a task have written; Spark takes the second one's message."""
    writer = folders.TextFileWriter({"path": str(tmp_path)})
    for attempt, text in (("7", "first"), ("9", "second")):
        os.makedirs(f"{writer.staging}/{attempt}/p")
        for n in range(3):
            with open(f"{writer.staging}/{attempt}/p/{n}.txt", "w") as out:
                out.write(text)
    writer.commit([folders.Staged(f"{writer.staging}/9", 3), None])
    assert files_in(tmp_path) == {f"p/{n}.txt": "second" for n in range(3)}


def jpeg(*segments, size=(640, 480), frame=0xC0):
    parts = b"".join(b"\xff" + bytes([m]) + struct.pack(">H", len(body) + 2) + body for m, body in segments)
    return b"\xff\xd8" + parts + b"\xff" + bytes([frame]) + struct.pack(">HBHHB", 17, 8, size[1], size[0], 3) + bytes(9) + b"\xff\xda"


def webp(*chunks):
    body = b"".join(k + struct.pack("<I", len(d)) + d + bytes(len(d) % 2) for k, d in chunks)
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body


def test_sizes_of_jpeg_and_webp(spark):
    long = [(0xE1, b"\xff\xc0" + bytes(60_000)), (0xE2, bytes(65_000)), (0xDB, bytes(65))]
    lossless = b"\x2f" + struct.pack("<I", (799) | (599 << 14))
    lossy = b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 321 | 0x4000, 123)
    extended = b"\0\0\0\0" + struct.pack("<I", 16_000)[:3] + struct.pack("<I", 9)[:3]
    cases = {
        "long": (jpeg(*long), "image/jpeg", 640, 480), "progressive": (jpeg(size=(3, 65_535), frame=0xC2), "image/jpeg", 3, 65_535), "table": (jpeg((0xC4, bytes(30)), size=(9, 8)), "image/jpeg", 9, 8),
        "filled": (b"\xff\xd8\xff\xff\xff\xff\xe0\x00\x04ab\xff\xd0" + jpeg(size=(5, 6))[2:], "image/jpeg", 5, 6), "cut in a segment": (jpeg(*long)[:70_000], "image/jpeg", None, None), "cut in the frame": (jpeg()[:8], "image/jpeg", None, None),
        "scan first": (b"\xff\xd8\xff\xda\x00\x08" + bytes(6) + jpeg()[2:], "image/jpeg", None, None), "odd": (b"\xff\xd8\xff\xe0\x00\x00" + bytes(30), "image/jpeg", None, None),
        "lossless": (webp((b"VP8L", lossless)), "image/webp", 800, 600), "lossy": (webp((b"VP8 ", lossy)), "image/webp", 321, 123), "extended": (webp((b"VP8X", extended), (b"VP8 ", lossy)), "image/webp", 16_001, 10),
        "chunks before": (webp((b"ICCP", bytes(7)), (b"VP8L", lossless)), "image/webp", 800, 600), "cut": (webp((b"VP8 ", lossy))[:24], "image/webp", None, None), "no chunk": (webp(), "image/webp", None, None), "text": (b"plain", None, None, None),
    }
    df = spark.createDataFrame([(k, bytearray(v[0])) for k, v in cases.items()], "name string, content binary")
    assert {r.name: (r.mime, r.width, r.height) for r in ingest.image_header(df).collect()} == {k: v[1:] for k, v in cases.items()}
