"""Word boxes of PDF files, by optional libraries that are imported where they are used."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.extract_spatial import CANVAS, pdf_type

_SCHEMA = "doc_id string, page int, pos int, text string, x0 double, y0 double, x1 double, y1 double, score double, images int, error string"


def word_boxes(files: DataFrame) -> DataFrame:
    """One row for each word of each page, on the common canvas; a file that can't be read gives one row with `error`.

    Needs PyMuPDF on the executors; where it is missing every file's error says so.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _SCHEMA.split(", ")]
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                rows: list[tuple] = []
                try:
                    import fitz

                    with fitz.open(stream=content, filetype="pdf") as doc:
                        for n, page in enumerate(doc, 1):
                            sx, sy, images = CANVAS[0] / page.rect.width, CANVAS[1] / page.rect.height, len(page.get_images())
                            words = page.get_text("words")
                            rows += [(path, n, i, w[4], w[0] * sx, w[1] * sy, w[2] * sx, w[3] * sy, 1.0, images, None) for i, w in enumerate(words)]
                            rows += [(path, n, None, None, None, None, None, None, None, images, None)] * (not words)
                except Exception as e:  # noqa: BLE001  a broken file must not stop the others
                    rows = [(path, None, None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(read, _SCHEMA)


def refusal(path: Column, mime: Column, content: Column) -> Column:
    """Why a file is not read as a PDF: neither its name nor its type says so, or its first bytes don't; null if it is one."""
    named = F.endswith(F.lower(path), F.lit(".pdf")) | F.contains(F.lower(F.coalesce(mime, F.lit(""))), F.lit("pdf"))
    wrong = (F.octet_length(content) >= 4) & (F.substring(content, 1, 4) != F.lit(b"%PDF"))
    return F.when(~named, "non-pdf").when(wrong, "not-pdf-binary")


def texts(files: DataFrame) -> DataFrame:
    """path, text (all pages in one string), reason, error: one row for each file (path, content; mimeType if there is one).

    A file that is no PDF has a reason and no text. Needs PyMuPDF on the executors; where it is missing every file's error says so.
    """
    mime = F.col("mimeType") if "mimeType" in files.columns else F.lit(None).cast("string")
    files = files.select("path", "content", refusal(F.col("path"), mime, F.col("content")).alias("reason"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content, reason in zip(b["path"], b["content"], b["reason"], strict=True):
                text = error = None
                if reason is None:
                    try:
                        import fitz

                        with fitz.open(stream=content, filetype="pdf") as doc:
                            text = "\n".join(page.get_text() for page in doc)
                    except Exception as e:  # noqa: BLE001  a broken file must not stop the others
                        error = f"{type(e).__name__}: {e}"
                rows.append((path, text, reason, error))
            yield pd.DataFrame(rows, columns=["path", "text", "reason", "error"])

    return files.mapInPandas(read, "path string, text string, reason string, error string")


def classify(words: DataFrame) -> DataFrame:
    """doc_id, words, images, pdf_type: totals over pages."""
    pages = words.where("error is null").groupBy("doc_id", "page").agg(F.count("text").alias("words"), F.max("images").alias("images"))
    return pages.groupBy("doc_id").agg(F.sum("words").alias("words"), F.sum("images").alias("images")).withColumn("pdf_type", pdf_type(F.col("words"), F.col("images")))


def routed(words: DataFrame, ocr: DataFrame) -> DataFrame:
    """Words of digital documents as they are, those of image documents from the other source."""
    kind = classify(words).select("doc_id", "pdf_type")
    own = words.join(kind.where("pdf_type = 'DIGITAL_TEXT_PDF'"), "doc_id", "left_semi")
    return own.unionByName(ocr.join(kind.where("pdf_type <> 'DIGITAL_TEXT_PDF'"), "doc_id", "left_semi"), allowMissingColumns=True)
