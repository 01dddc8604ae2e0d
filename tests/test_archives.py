"""Tar, Arrow and zip files, and files chosen by name."""

import os
import tarfile
import zipfile

import pyarrow as pa

from folioscope.sources import archives
from tests.conftest import rows

DATA = [("train", f"line_{i:06d}", bytes([137, i]), f"té {i}", "x") for i in range(30)] + [("test", "line_000100", b"i", "t", "x"), ("test", "line_000101", b"", "t", "x"), ("test", "line_000102", b"i", " \n", "x"), (None, "a", b"i", "t", "x"), ("val", "b", None, "t", "x")]
SCHEMA = "split string, stem string, img_bytes binary, text string, path string"


def usable():
    return sorted((s, stem, image, text) for s, stem, image, text, _ in DATA if s and image and text.strip())


def test_tars(spark, tmp_path):
    df = spark.createDataFrame(DATA, SCHEMA)
    for files in (1, 4):
        out = str(tmp_path / f"t{files}")
        assert archives.write_tars(df, out, files) == {"train": 30, "test": 1}
        assert archives.write_tars(df, out, files) == {"train": 30, "test": 1}  # the same files again
        back = archives.read_tars(spark, out, ["train", "test", "val"])
        assert sorted((r.split, r.stem, bytes(r.img_bytes), r.text) for r in back.collect()) == usable()
        assert all(n.endswith(".tar") for n in os.listdir(f"{out}/train"))
    with tarfile.open(f"{tmp_path}/t1/test/{os.listdir(f'{tmp_path}/t1/test')[0]}") as tar:
        assert tar.getnames() == ["line_000100.png", "line_000100.gt.txt"]
    assert archives.write_tars(df.limit(0), str(tmp_path / "e")) == {} and archives.read_tars(spark, str(tmp_path / "none"), ["train"]).count() == 0


def test_arrow_files(spark, tmp_path):
    paths = archives.write_arrow(spark.createDataFrame(DATA, SCHEMA), str(tmp_path / "a"), 3, batch=4)
    got = [(p.split("/")[-2], r["stem"], r["img_bytes"], r["text"]) for p in paths for r in pa.ipc.open_file(p).read_all().to_pylist()]
    assert sorted(got) == usable() and paths == sorted(paths)


def test_zip_and_names(spark, tmp_path):
    for name in ("b/m_2.ckpt", "b/m_10.ckpt", "a.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    names = archives.zip_files([str(tmp_path / n) for n in ("b/m_2.ckpt", "a.txt", "none")], str(tmp_path / "o.zip"), str(tmp_path))
    assert names == ["a.txt", "b/m_2.ckpt"] and zipfile.ZipFile(tmp_path / "o.zip").read("a.txt") == b"a.txt"
    assert archives.named_file(spark, str(tmp_path / "b"), "*.ckpt").endswith("m_10.ckpt") and archives.named_file(spark, str(tmp_path / "b"), "*.ckpt", last=True).endswith("m_2.ckpt")
    assert archives.named_file(spark, str(tmp_path), "*.none") is None and rows(spark.range(1)) == [(0,)]
