"""Files of unknown kind: sniffing, unpacking, finding the main source."""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.sources.latex import without_comments

#: Bytes that an archive may hold when expanded.
EXPANDED = 200 << 20
#: Bytes of members that are held before they are handed on.
GATHERED = 8 << 20


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, content) of all files below a folder, in any store that Spark reads."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)


def kind_of(content: Column, path: Column) -> Column:
    """pdf, zip, gzip, tar, tex or unknown, by the first bytes, in this order, then by the name or a document class."""
    starts = lambda b: F.substring(content, 1, len(b)) == F.lit(bytearray(b))
    head = F.decode(F.substring(content, 1, 20_000), "ISO-8859-1")
    return (
        F.when(starts(b"%PDF"), "pdf").when(starts(b"PK"), "zip").when(starts(b"\x1f\x8b"), "gzip").when(F.substring(content, 258, 5) == F.lit(bytearray(b"ustar")), "tar")
        .when(path.endswith(".tex") | head.contains("\\documentclass"), "tex").otherwise("unknown")
    )


def _members(data: bytes, name: str, limit: int) -> Iterator[tuple[str, bytes]]:
    """Regular files of an archive, nested gzip opened once; members outside the archive's root are passed over."""

    def safe(path: str) -> bool:
        parts = PurePosixPath(path.replace("\\", "/"))
        return not parts.is_absolute() and ".." not in parts.parts

    if data[:2] == b"\x1f\x8b":
        with gzip.GzipFile(fileobj=io.BytesIO(data)) as f:
            data = f.read(limit + 1)
        if len(data) > limit:
            raise ValueError("the archive is too large")
        name = name.removesuffix(".gz")
    if data[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            if sum(i.file_size for i in z.infolist()) > limit:
                raise ValueError("the archive is too large")
            for i in z.infolist():
                if not i.is_dir() and safe(i.filename):
                    yield i.filename, z.read(i)
    elif data[257:262] == b"ustar":
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            total = 0
            for m in t:
                if m.isfile() and safe(m.name):
                    total += m.size
                    if total > limit:
                        raise ValueError("the archive is too large")
                    yield m.name, t.extractfile(m).read()
    else:
        yield name, data


def unpack(files: DataFrame, limit: int = EXPANDED) -> DataFrame:
    """(archive, path, content, error): the files inside each file; what can't be read is a row with an error, so that one bad file does not sink the job.

    Members are handed on by the thousand, or by GATHERED bytes where that is less."""
    columns = ["archive", "path", "content", "error"]

    def members(path: str, content: bytes) -> Iterator[tuple]:
        try:
            for name, data in _members(bytes(content), PurePosixPath(path).name, limit):
                yield path, name, data, None
        except Exception as e:  # noqa: BLE001  any reader's error belongs in the row
            yield path, None, None, f"{type(e).__name__}: {e}"[:240]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                for row in members(path, content):
                    rows.append(row)
                    held += len(row[2] or b"")
                    if len(rows) == 1000 or held >= GATHERED:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
        yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content").mapInPandas(run, "archive string, path string, content binary, error string")


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8, or Latin-1 where they are not valid UTF-8."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.decode(content, "ISO-8859-1"))


def main_score(path: Column, text: Column) -> Column:
    """How much a file without comments looks like a paper's main LaTeX file: most inputs, sections and length, usual names first; null for one that can't be."""
    count = lambda rx: F.size(F.regexp_extract_all(text, F.lit(rx), F.lit(0)))
    usual = F.lower(F.regexp_extract(path, "[^/]*$", 0)).isin("main.tex", "paper.tex", "ms.tex")
    score = count(r"\\input") + count(r"\\section") + F.length(text) / 5000 + F.when(usual, 5).otherwise(0)
    return F.when(F.lower(path).endswith(".tex") & text.contains("\\documentclass") & text.contains("\\begin{document}"), score)


def main_tex(members: DataFrame) -> DataFrame:
    """(archive, path, text) of each archive's main LaTeX file, the one of the best score, without comments."""
    tex = members.filter(F.lower("path").endswith(".tex")).withColumn("text", without_comments(decoded(F.col("content"))))
    scored = tex.select("archive", "path", "text", main_score(F.col("path"), F.col("text")).alias("score")).filter("score is not null")
    return scored.groupBy("archive").agg(F.max_by(F.struct("path", "text"), F.struct("score", "path")).alias("m")).select("archive", "m.*")


def largest_pdf(members: DataFrame) -> DataFrame:
    """(archive, path) of the largest PDF of each archive, the fallback where there is no main source."""
    pdf = members.filter(F.lower("path").endswith(".pdf"))
    return pdf.groupBy("archive").agg(F.max_by("path", F.struct(F.length("content"), "path")).alias("path"))


def paper_source(members: DataFrame) -> DataFrame:
    """(archive, kind, path) of what stands for each archive's paper: its main LaTeX file (tex), else its largest PDF (pdf), else unknown and null."""
    tex = main_tex(members).select("archive", F.lit("tex").alias("kind"), "path")
    pdf = largest_pdf(members).select("archive", F.lit("pdf").alias("kind"), "path")
    none = members.select("archive", F.lit("unknown").alias("kind"), F.lit(None).cast("string").alias("path")).distinct()
    rank = F.when(F.col("kind") == "tex", 0).when(F.col("kind") == "pdf", 1).otherwise(2)
    found = tex.unionByName(pdf).unionByName(none).groupBy("archive").agg(F.min_by(F.struct("kind", "path"), rank).alias("m"))
    return found.select("archive", "m.*")


def paper_pdf(titles: DataFrame, candidates: DataFrame, least: float = 0.6) -> DataFrame:
    """(doc_id, path): among PDFs (doc_id, path, pages, text) of four pages or more, the one with most of the title's words, if enough; the first path on a tie."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3,}"), F.lit(0)))
    both = candidates.filter("pages >= 4").join(titles.withColumn("tw", words(F.col("title"))), "doc_id")
    both = both.withColumn("share", F.size(F.array_intersect("tw", words(F.col("text")))) / F.greatest(F.size("tw"), F.lit(1))).filter(F.col("share") >= least)
    return both.groupBy("doc_id").agg(F.min_by("path", F.struct(-F.col("share"), "path")).alias("path"))


def address_kind(url: Column) -> Column:
    """What an address points at: arxiv:<id without version>, openreview:<id>, pdf or page."""
    arxiv = F.regexp_extract(url, r"(?i)(?:arxiv\.org/(?:abs|pdf|html|e-print)/|^arxiv:\s*)([a-z\-]+(?:\.[a-z]{2})?/\d{7}|\d{4}\.\d{4,5})", 1)
    review = F.regexp_extract(url, r"(?i)openreview\.net/(?:forum|pdf|attachment)\?id=([\w\-]+)", 1)
    return F.when(arxiv != "", F.concat(F.lit("arxiv:"), arxiv)).when(review != "", F.concat(F.lit("openreview:"), review)).when(F.lower(url).rlike(r"\.pdf($|[?#])"), "pdf").otherwise("page")
