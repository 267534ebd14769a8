"""Documents from files: whole files with their text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def text_of(path: str, content: bytes) -> str | None:
    """Plain text as it is; a PDF's pages joined by line breaks, or a document's paragraphs, if their readers are
    installed; null for what can't be read."""
    name = path.lower()
    if name.endswith((".txt", ".md", ".html")):
        return content.decode("utf-8", "replace")
    import io

    try:
        if name.endswith(".pdf"):
            from pypdf import PdfReader

            return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages)
        if name.endswith(".docx"):
            from docx import Document

            return "\n".join(p.text for p in Document(io.BytesIO(content)).paragraphs)
    except ImportError:
        return None  # the reader isn't installed
    return None


def documents(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, size, text of the files below a folder whose names match; a file is one row, so it must fit one."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                path = row.column("path")[0].as_py()
                yield pa.RecordBatch.from_arrays([row.column("path"), row.column("length"), pa.array([text_of(path, row.column("content")[0].as_py())], pa.string())], names=["path", "size", "text"])

    return files.select("path", "length", "content").mapInArrow(run, "path string, size long, text string")
