"""Archives of prepared lines: tar files by split, Arrow files for a trainer, a zip of a run's files; paths may be URIs of any store that pyarrow knows.

Tasks write: one tar or Arrow file a split and partition, under a name of its own that is moved into place when it is whole, so a task that
runs again leaves the same files. Nothing of the lines passes the driver.
"""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator, Sequence
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES = "split string, stem string, img_bytes binary, text string"
WRITTEN = "split string, path string, n_lines bigint"


def _placed(lines: DataFrame, files: int) -> DataFrame:
    """Lines with an image and a text that is not blank, spread over `files` partitions, in order of split and stem in each."""
    kept = lines.select("split", "stem", "img_bytes", "text").where("split is not null and stem is not null and length(img_bytes) > 0").where(F.col("text").rlike(r"\S"))
    return kept.repartition(files, "split", F.pmod(F.xxhash64("stem"), F.lit(files))).sortWithinPartitions("split", "stem")


def _write(lines: DataFrame, path: str, files: int, ending: str, opened) -> DataFrame:
    """Run `opened(stream)`, which gives (add, close), for each split of each partition; (split, path, n_lines) of what was written."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as stores
        from pyspark import TaskContext

        here = TaskContext.get()
        store, root = stores.FileSystem.from_uri(path if "://" in path else Path(path).absolute().as_uri())
        done, split, state = [], None, None

        def finish() -> None:
            nonlocal state
            if state:
                stream, close, temporary, final, n = state
                close()
                stream.close()
                store.move(temporary, final)
                done.append((split, final, n))
                state = None

        for pdf in batches:
            for own, stem, image, text in pdf.itertuples(index=False):
                if own != split:
                    finish()
                    split = own
                    store.create_dir(f"{root}/{own}", recursive=True)
                    final = f"{root}/{own}/part-{here.partitionId():05d}{ending}"
                    temporary = f"{final}.{here.taskAttemptId()}"
                    stream = store.open_output_stream(temporary)
                    add, close = opened(stream)
                    state = [stream, close, temporary, final, 0]
                add(stem, bytes(image), text)
                state[4] += 1
        finish()
        yield pd.DataFrame(done, columns=["split", "path", "n_lines"])

    return _placed(lines, files).mapInPandas(run, WRITTEN)


def write_tars(lines: DataFrame, path: str, files: int = 1) -> dict[str, int]:
    """Tar files of lines (split, stem, img_bytes, text) below `path`, a folder a split; the number of lines of each split.

    A line is `<stem>.png` and `<stem>.gt.txt`. Lines without split, stem, image or text are left out; a split without lines has no
    folder. Files of an earlier, wider run are not removed.
    """

    def opened(stream):
        tar = tarfile.open(fileobj=stream, mode="w|")

        def add(stem: str, image: bytes, text: str) -> None:
            for name, body in ((f"{stem}.png", image), (f"{stem}.gt.txt", text.encode())):
                info = tarfile.TarInfo(name)
                info.size = len(body)
                tar.addfile(info, io.BytesIO(body))

        return add, tar.close

    return _sums(_write(lines, path, files, ".tar", opened))


def write_arrow(lines: DataFrame, path: str, files: int = 1, batch: int = 512) -> list[str]:
    """Arrow files (stem, img_bytes, text) of lines as in `write_tars`; the sorted paths, which the trainer is given."""
    schema = pa.schema([("stem", pa.string()), ("img_bytes", pa.binary()), ("text", pa.string())])

    def opened(stream):
        writer, rows = pa.ipc.new_file(stream, schema), []

        def flush() -> None:
            if rows:
                writer.write_batch(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema))
                rows.clear()

        def add(*row) -> None:
            rows.append(row)
            if len(rows) >= batch:
                flush()

        def close() -> None:
            flush()
            writer.close()

        return add, close

    return sorted(r.path for r in _write(lines, path, files, ".arrow", opened).collect())  # a row a file


def _sums(written: DataFrame) -> dict[str, int]:
    return {r.split: r.n for r in written.groupBy("split").agg(F.sum("n_lines").alias("n")).collect()}  # a row a split


def read_tars(spark: SparkSession, path: str, splits: Sequence[str]) -> DataFrame:
    """Lines (LINES) of the tar files below `path`, a folder a split; splits without a folder are skipped, text without an image has a null one."""
    from folioscope.sources.files import exists

    there = [s for s in splits if exists(spark, f"{path}/{s}/*.tar")]
    if not there:
        return spark.createDataFrame([], LINES)
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar").load([f"{path}/{s}" for s in there])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for where, body in zip(pdf["path"], pdf["content"]):
                found: dict[str, list] = {}
                with tarfile.open(fileobj=io.BytesIO(bytes(body))) as tar:
                    for member in tar:
                        for k, ending in ((0, ".png"), (1, ".gt.txt")):
                            if member.isfile() and member.name.endswith(ending):
                                found.setdefault(Path(member.name).name[: -len(ending)], [None, None])[k] = tar.extractfile(member).read()
                yield pd.DataFrame([(where.rsplit("/", 2)[1], stem, image, None if text is None else text.decode()) for stem, (image, text) in found.items()], columns=["split", "stem", "img_bytes", "text"])

    return raw.select("path", "content").mapInPandas(run, LINES)


def zip_files(paths: Sequence[str], target: str, root: str) -> list[str]:
    """A zip of small local files, named as they lie below `root`; those that do not exist are left out. The names, in order."""
    names = []
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for p in sorted(map(Path, paths)):
            if p.is_file():
                names.append(p.relative_to(root).as_posix())
                out.write(p, names[-1])
    return names


def named_file(spark: SparkSession, directory: str, pattern: str, last: bool = False) -> str | None:
    """The first, or last, file by name that fits a pattern, such as a stored model or checkpoint; None if there is none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{directory}/{pattern}")
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop) or []
    paths = sorted((f.getPath().getName(), f.getPath().toString()) for f in found)
    return paths[-1 if last else 0][1] if paths else None
