"""Résumé files -> ``path, text, error``; a file that cannot be read becomes an error row."""

import re
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from io import BytesIO
from typing import BinaryIO
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Accepted suffixes, paragraph and text tags of a .docx document, texts of the errors.
PLAIN_SUFFIXES = ["", ".txt", ".md", ".rst"]
BAD_DOCX, EMPTY_DOCX = "not a valid .docx file: ", "DOCX contained no text"
EMPTY_FILE, UNSUPPORTED = "empty file upload", "unsupported resume format "
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


# Texts of about so many bytes leave a task together, and so many files of one folder are one task.
BATCH_BYTES, FILES_PER_TASK = 8 << 20, 500


def _docx_text(file: BinaryIO) -> tuple[str | None, str | None]:
    """(text, error) of one .docx file, read paragraph by paragraph."""
    found, open_paragraphs = [], 0
    try:
        with zipfile.ZipFile(file) as archive, archive.open("word/document.xml") as part:
            for event, node in ElementTree.iterparse(part, ("start", "end")):
                if node.tag != f"{WORD}p":
                    continue
                open_paragraphs += 1 if event == "start" else -1
                if event == "end" and not open_paragraphs:
                    found += ["".join(t.text or "" for t in p.iter(f"{WORD}t")).strip() for p in node.iter(f"{WORD}p")]
                    node.clear()
    except (KeyError, EOFError, zlib.error, zipfile.BadZipFile, ElementTree.ParseError) as problem:
        return None, f"{BAD_DOCX}{problem}"
    text = "\n".join(p for p in found if p)
    return (text, None) if text else (None, EMPTY_DOCX)


def _read_docx(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        read = [_docx_text(BytesIO(bytes(content))) for content in batch["content"]]
        yield pd.DataFrame(
            {"path": batch["path"], "text": [t for t, _ in read], "error": [e for _, e in read]}, dtype=object
        )


def resume_texts(files: DataFrame) -> DataFrame:
    """``files(path, content)`` -> ``path, text, error``.

    Plain text is decoded by Spark; only .docx archives go through Python.
    """
    suffix = F.lower(F.regexp_extract("path", r"[^/.]+(\.[^./]+)$", 1))
    typed = files.select("path", "content", suffix.alias("suffix"))
    empty, docx = F.length("content") == 0, F.col("suffix") == ".docx"
    plain = F.col("suffix").isin(PLAIN_SUFFIXES)
    decoded = typed.where(empty | ~docx).select(
        "path",
        F.when(~empty & plain, F.make_valid_utf8(F.col("content").cast("string"))).alias("text"),
        F.when(empty, F.lit(EMPTY_FILE))
        .when(~plain, F.concat(F.lit(UNSUPPORTED), F.col("suffix")))
        .alias("error"),
    )
    archives = typed.where(docx & ~empty).select("path", "content")
    return decoded.unionByName(archives.mapInPandas(_read_docx, "path string, text string, error string"))


@dataclass
class _Files(InputPartition):
    """Some files of one folder, or with ``names`` None everything below a folder."""

    folder: str
    names: list[str] | None = None


def _is_read(name: str) -> bool:
    return not name.startswith((".", "_"))


class ResumeReader(DataSourceReader):
    """Tasks list the sub-folders and read one file after another; the driver lists the top only."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _open(self) -> tuple[fs.FileSystem, str, str]:
        """File system, its path of the top, and what precedes such a path in a row."""
        system, top = fs.FileSystem.from_uri(self.path)
        scheme = re.match("([a-z0-9]+):/+", self.path)
        return system, top, f"{scheme[1]}:" if scheme else "file:"

    def partitions(self) -> list[_Files]:
        system, top, _ = self._open()
        listed = [i for i in system.get_file_info(fs.FileSelector(top)) if _is_read(i.base_name)]
        files = sorted(i.base_name for i in listed if i.type == fs.FileType.File)
        parts = [_Files(top, files[i : i + FILES_PER_TASK]) for i in range(0, len(files), FILES_PER_TASK)]
        parts += [_Files(i.path) for i in listed if i.type == fs.FileType.Directory]
        return parts or [_Files(top, [])]

    def _listed(self, system: fs.FileSystem, partition: _Files) -> Iterator[fs.FileInfo]:
        if partition.names is not None:
            yield from system.get_file_info([f"{partition.folder}/{name}" for name in partition.names])
            return
        folders = [partition.folder]
        while folders:
            for found in system.get_file_info(fs.FileSelector(folders.pop())):
                if not _is_read(found.base_name):
                    continue
                if found.type == fs.FileType.Directory:
                    folders.append(found.path)
                else:
                    yield found

    @staticmethod
    def _read_file(system: fs.FileSystem, info: fs.FileInfo) -> tuple[str | None, str | None]:
        suffix = re.search(r"[^/.]+(\.[^./]+)$", info.path)
        suffix = suffix[1].lower() if suffix else ""
        if info.size == 0:
            return None, EMPTY_FILE
        if suffix == ".docx":
            with system.open_input_file(info.path) as file:
                # No archive is shorter than its end record, from which reading starts.
                return _docx_text(file if info.size >= 22 else BytesIO(file.read()))
        if suffix not in PLAIN_SUFFIXES:
            return None, UNSUPPORTED + suffix
        with system.open_input_stream(info.path, compression=None) as file:
            return file.read().decode("utf-8", "replace"), None

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        system, _, before = self._open()
        rows, held = [], 0
        for info in self._listed(system, partition):
            text, error = self._read_file(system, info)
            rows.append({"path": before + info.path, "text": text, "error": error})
            held += len(text or "") + 200
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, _ROWS)
                rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, _ROWS)


_ROWS = pa.schema([("path", pa.string()), ("text", pa.string()), ("error", pa.string())])


class ResumeFolder(DataSource):
    """``spark.read.format("resumes").load(folder)`` -> ``path, text, error`` of every file below the folder."""

    @classmethod
    def name(cls) -> str:
        return "resumes"

    def schema(self) -> str:
        return "path string, text string, error string"

    def reader(self, schema) -> ResumeReader:
        return ResumeReader(self.options["path"])


def read_resumes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Every file below the folders: its text, or why there is none."""
    spark.dataSource.register(ResumeFolder)
    folders = [paths] if isinstance(paths, str) else paths
    found = [spark.read.format("resumes").load(folder) for folder in folders]
    for more in found[1:]:
        found[0] = found[0].unionByName(more)
    return found[0]
