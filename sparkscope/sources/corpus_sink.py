"""A corpus of files as a Spark sink: one file for each row, and none before all are there.

After ``register``, ``df.write.format("file_corpus").mode("append").save(folder)``
writes rows (file, bytes). Each task attempt writes into a folder of its own
below ``_staged``; the commit moves the files of the attempts that Spark counts,
so an attempt that failed or was repeated leaves nothing behind. An abort
removes what was staged.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from sparkscope.session import workers_see_package
from sparkscope.sources.recorded import store_of

STAGED = "_staged"


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    files: list[str]


class CorpusWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.job = folder, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        store, root = store_of(self.folder)
        own = f"{STAGED}/{self.job}/{uuid.uuid4().hex}"
        store.create_dir(f"{root}/{own}", recursive=True)
        files = []
        for batch in iterator:
            for name, data in zip(batch.column("file").to_pylist(), batch.column("bytes"), strict=True):
                if not name or "/" in name or name in (".", "..", STAGED):
                    raise ValueError(f"not a name for a file: {name!r}")
                with store.open_output_stream(f"{root}/{own}/{len(files)}") as out:
                    out.write(data.as_buffer() if data.is_valid else b"")
                files.append(name)
        return Staged(own, files)

    def commit(self, messages: list[Staged | None]) -> None:
        store, root = store_of(self.folder)
        staged = [(f"{m.folder}/{i}", name) for m in messages if m for i, name in enumerate(m.files)]
        names = [name for _, name in staged]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("files of one name: " + ", ".join(sorted({n for n in names if names.count(n) > 1})[:5]))
        if self.overwrite:
            for info in store.get_file_info(pyarrow.fs.FileSelector(root)):
                if info.is_file:
                    store.delete_file(info.path)
        for place, name in staged:
            store.move(f"{root}/{place}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        store, root = store_of(self.folder)
        for folder in (f"{STAGED}/{self.job}", STAGED):
            info = store.get_file_info(f"{root}/{folder}")
            others = folder == STAGED and info.type == pyarrow.fs.FileType.Directory and store.get_file_info(pyarrow.fs.FileSelector(info.path))
            if info.type == pyarrow.fs.FileType.Directory and not others:
                store.delete_dir(info.path)


class FileCorpus(DataSource):
    """The format ``file_corpus``; its option ``path`` is a folder, (file string, bytes binary) its rows."""

    @classmethod
    def name(cls) -> str:
        return "file_corpus"

    def schema(self) -> str:
        return "file string, bytes binary"

    def writer(self, schema, overwrite: bool) -> CorpusWriter:
        if sorted(f.name for f in schema) != ["bytes", "file"]:
            raise ValueError("rows have to be (file string, bytes binary)")
        return CorpusWriter(self.options["path"], overwrite)


def write_corpus(corpus: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Write (file, bytes) rows, such as ``seeds.corpus`` gives, as files of a folder. Two rows with one name raise, and no file is written then."""
    spark: SparkSession = corpus.sparkSession
    workers_see_package(spark)
    spark.dataSource.register(FileCorpus)
    corpus.select("file", "bytes").write.format("file_corpus").mode("overwrite" if overwrite else "append").save(folder)
