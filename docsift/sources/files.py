"""Document files in and records out: listing, validation, text extraction, word lists, JSON, CSV, retention."""

from __future__ import annotations

import io
import time
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from docsift.operators.deadline import limited

MAX_BYTES = 10 * 1024 * 1024
SUFFIXES = ("pdf", "docx")
MIN_LINES, MAX_LINES = 3, 5000
MIN_BLOCK_WORDS = 20
#: An archive of at most MAX_BYTES may unpack to much more; beyond this it is refused unread.
MAX_UNPACKED = 200 * 1024 * 1024
#: Seconds that a worker spends on one document.
DEADLINE = 30.0
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def listed(reader: Callable[[], DataFrameReader | DataStreamReader], folder: str) -> DataFrame:
    """path, modificationTime, length, content, suffix, status (ok, too_large, unsupported) of files.

    Suffix and size are judged from the listing. Content is asked for only of files that are accepted: the source applies
    the bound on length before it opens a file, and never opens one whose content isn't selected."""
    accepted = reader().option("pathGlobFilter", f"*.{{{','.join(''.join(f'[{c}{c.upper()}]' for c in s) for s in SUFFIXES)}}}").load(folder).filter(F.col("length") <= MAX_BYTES)
    others = with_status(reader().load(folder).select("path", "modificationTime", "length")).filter("status <> 'ok'")
    return with_status(accepted).unionByName(others.withColumn("content", F.lit(None).cast("binary")))


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every file below the folder, as ``listed`` gives them; Spark lists no empty files."""
    return listed(lambda: spark.read.format("binaryFile").option("recursiveFileLookup", "true"), folder)


def with_status(files: DataFrame) -> DataFrame:
    """Adds suffix and status."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    status = F.when(~suffix.isin(*SUFFIXES), "unsupported").when(F.col("length") > MAX_BYTES, "too_large").otherwise("ok")
    return files.withColumns({"suffix": suffix, "status": status})


def docx_text(content: bytes) -> str:
    """Paragraphs of the body, then the rows of its tables with cells joined by a space."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if z.getinfo("word/document.xml").file_size > MAX_UNPACKED:
            raise ValueError("unpacked size")
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    lines = [said(p) for p in body.findall(f"{_W}p")]
    lines += [" ".join(filter(None, map(said, row.findall(f"{_W}tc")))) for table in body.findall(f"{_W}tbl") for row in table.findall(f"{_W}tr")]
    lines = [x for x in lines if x]
    if not MIN_LINES <= len(lines) <= MAX_LINES:
        raise ValueError(f"{len(lines)} lines")
    return "\n".join(lines)


def extract_text(files: DataFrame, pdf_text: Callable[[bytes], str] | None = None, deadline: float = DEADLINE) -> DataFrame:
    """path, text, error of listed files. A file that cannot be read, or not within the deadline in seconds, has a null
    text and an error; the job goes on.

    No PDF library is bundled: pass a function from bytes to text, else PDF files get the error ``no pdf reader``.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, suffix, status, content in zip(batch["path"], batch["suffix"], batch["status"], batch["content"]):
                text, error = None, None if status == "ok" else status
                if error is None and suffix == "pdf" and pdf_text is None:
                    error = "no pdf reader"
                if error is None:
                    try:
                        text = limited(deadline, pdf_text if suffix == "pdf" else docx_text, bytes(content))
                    except Exception as e:  # noqa: BLE001 - any broken file becomes a row with its error
                        error = f"{type(e).__name__}: {e}"[:200]
                rows.append((path, text, error))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    readable = F.when(F.col("status") == "ok", F.col("content"))
    return files.select("path", "suffix", "status", readable.alias("content")).mapInPandas(read, "path string, text string, error string")


def two_columns(blocks: Column, page_width: Column | float) -> Column:
    """Texts of (x0, y0, x1, text) blocks of a page, from the top: all that end left of the middle before the others if
    both sides hold over four, else as they come."""
    ordered = F.array_sort(F.transform(blocks, lambda b: F.struct(b["y0"].alias("y0"), b["x0"].alias("x0"), b["x1"].alias("x1"), b["text"].alias("text"))))
    left = F.filter(ordered, lambda b: b["x1"] < page_width / 2)
    right = F.filter(ordered, lambda b: b["x1"] >= page_width / 2)
    return F.transform(F.when((F.size(left) > 4) & (F.size(right) > 4), F.concat(left, right)).otherwise(ordered), lambda b: b["text"])


def page_text(pages: DataFrame, plain: DataFrame | None = None) -> DataFrame:
    """doc_id, text of (doc_id, page, width, blocks): the blocks of all pages in column order, and below them the projects
    recovered from the raw lines. Where they hold fewer than MIN_BLOCK_WORDS words, ``plain`` (doc_id, text) counts."""
    from docsift.operators.layout import register_layout

    _, recover = register_layout(pages.sparkSession)
    ordered = pages.select("doc_id", "page", F.array_join(two_columns(F.col("blocks"), F.col("width")), "\n").alias("text"))
    whole = ordered.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n").alias("text"))
    if plain is not None:
        sparse = F.regexp_count("text", F.lit(r"\S+")) < MIN_BLOCK_WORDS
        whole = whole.join(plain.select("doc_id", F.col("text").alias("plain")), "doc_id", "left").select("doc_id", F.when(sparse, F.coalesce("plain", "text")).otherwise(F.col("text")).alias("text"))
    found = whole.withColumn("found", F.expr(f"{recover}(split(text, '\\n', -1))"))
    more = F.concat(F.lit("\n\n[RECOVERED_PROJECTS]\n"), F.array_join("found", "\n"))
    text = F.when(F.size("found") > 0, F.concat(F.col("text"), more)).otherwise(F.col("text"))
    return found.select("doc_id", F.replace(text, F.lit("\r"), F.lit("\n")).alias("text"))


def load_wordlist(spark: SparkSession, path: str, limit: int = 100_000) -> tuple[str, ...]:
    """Distinct lower-case entries of a word list, sorted; blank lines and # comments go. More than limit is an error."""
    words = spark.read.text(path).select(F.lower(F.trim("value")).alias("w")).filter("w <> '' AND NOT startswith(w, '#')").distinct()
    out = [r.w for r in words.limit(limit + 1).collect()]
    if len(out) > limit:
        raise ValueError(f"word list over {limit} entries")
    return tuple(sorted(out))


def load_records(spark: SparkSession, folder: str, names: tuple[str, ...]) -> DataFrame:
    """Feature records of a folder of JSON files as doubles by name; missing values are 0, files without features go."""
    schema = "slug string, label int, features struct<" + ", ".join(f"{n}: double" for n in names) + ">"
    rows = spark.read.schema(schema).json(folder, multiLine=True).filter("features IS NOT NULL")
    return rows.select("slug", "label", *[F.coalesce(F.col(f"features.{n}"), F.lit(0.0)).alias(n) for n in names])


def write_records(rows: DataFrame, folder: str, key: str = "slug") -> None:
    """One JSON object per row: key and a struct of all other columns."""
    rows.select(key, F.struct(*[c for c in rows.columns if c != key]).alias("features")).write.mode("overwrite").json(folder)


def write_csv(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(folder)


def stale(files: DataFrame, hours: int = 168) -> DataFrame:
    """Paths of files older than the retention."""
    return files.filter(F.col("modificationTime") < F.current_timestamp() - F.expr(f"INTERVAL {hours} HOURS")).select("path")


def purge(spark: SparkSession, folder: str, hours: int = 168, delete: bool = False) -> dict[str, int]:
    """Deletes the document files of a folder that are older than the retention; without ``delete`` it only counts them.

    The listing is a Spark job, whose rows come to the driver a partition at a time. Each file's age is read again from its
    file system right before it goes, so that one written meanwhile stays. Gives how many are stale, deleted, changed since
    and failed."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    found = with_status(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime", "length")).filter(F.col("suffix").isin(*SUFFIXES))
    out = {"stale": 0, "deleted": 0, "changed": 0, "failed": 0}
    for row in stale(found, hours).toLocalIterator():
        out["stale"] += 1
        if not delete:
            continue
        path = hadoop(row.path)
        fs = path.getFileSystem(conf)
        try:
            if time.time() - fs.getFileStatus(path).getModificationTime() / 1000 < hours * 3600:
                out["changed"] += 1
            else:
                out["deleted" if fs.delete(path, False) else "failed"] += 1
        except Py4JJavaError:  # gone, or not allowed: the others go on
            out["failed"] += 1
    return out
