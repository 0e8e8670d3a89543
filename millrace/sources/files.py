"""Reading and writing files: JSON lines, whole JSON files, text by suffix, CSV and TSV sheets, resuming, audits."""

from __future__ import annotations

import dataclasses
import io
import json
import os
import zipfile
from collections.abc import Iterator, Mapping
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, missing_ok: bool = False) -> DataFrame:
    """JSON lines of a set schema. A line that is no JSON, or doesn't fit, fails the read and is named in the error; blank
    lines are skipped. A path that doesn't exist is an error, or empty if `missing_ok`."""
    if missing_ok and not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_lenient(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The same with `_corrupt_record` in place of an error."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])).option("mode", "PERMISSIVE").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_atomic(df: DataFrame, path: str) -> None:
    """JSON in place of what was there: readers see the old files or, after the commit, the new ones."""
    df.write.mode("overwrite").json(path)


def read_result_files(spark: SparkSession, path: str, result: str) -> DataFrame:
    """Whole-file JSON with a list `results` of `result` (DDL): a row per result, without those whose status is error."""
    t = spark.read.schema(f"results array<{result}>").option("multiLine", True).json(path)
    r = t.select(F.explode("results").alias("r")).select("r.*")
    return r.where(F.coalesce(F.col("status"), F.lit("")) != "error") if "status" in r.columns else r


def ranked_contexts(chunks: Column, fields: tuple[str, ...] = ("text", "source_id", "score")) -> Column:
    """Chunks of any retriever as one kind of context; null chunks left out."""
    return F.transform(F.filter(chunks, lambda c: c.isNotNull()), lambda c: F.struct(*(c[f].alias(f) for f in fields)))


def read_texts(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".txt", ".md")) -> DataFrame:
    """(path, text, n_bytes) of all files below a folder with one of the suffixes; others, as of PDF and office documents,
    need a parser that turns `read_binary` into texts."""
    return read_binary(spark, path, suffixes).select("path", F.decode("content", "UTF-8").alias("text"), F.col("length").alias("n_bytes"))


def find_files(spark: SparkSession, path: str, suffixes: tuple[str, ...]) -> DataFrame:
    """(path, length) of the files below a folder, however deep, with one of the suffixes; contents are not read."""
    return read_binary(spark, path, suffixes).select("path", "length")


def docx_text(data: bytes) -> str:
    """The paragraphs of an office document, a line each, and its tables as lines of cells between bars, in their order."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{w}body")

    def said(p) -> str:
        return "".join("\t" if e.tag == f"{w}tab" else "\n" if e.tag in (f"{w}br", f"{w}cr") else e.text or "" for e in p.iter() if e.tag in (f"{w}t", f"{w}tab", f"{w}br", f"{w}cr"))

    out = []
    for e in body if body is not None else ():
        if e.tag == f"{w}p" and said(e).strip():
            out.append(said(e).strip())
        elif e.tag == f"{w}tbl":
            for row in e.iter(f"{w}tr"):
                out.append(" | ".join(" ".join(said(p).strip() for p in c.iter(f"{w}p")).strip() for c in row.iter(f"{w}tc")))
    return "\n".join(out)


def pdf_pages(data: bytes) -> list[str]:
    """The texts of a PDF's pages, by a reader that is installed (pypdf or PyMuPDF); without one an error."""
    try:
        import pypdf

        return [p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(data)).pages]
    except ImportError:
        try:
            import fitz
        except ImportError:
            raise RuntimeError("reading PDF files needs pypdf or PyMuPDF") from None
        return [p.get_text() for p in fitz.open(stream=data, filetype="pdf")]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, text, error) of the text, office and PDF files below a folder, read by their suffix; other files are
    passed over. A file that can't be read has a null text and the error, and doesn't fail the others. Pages of a PDF are
    parted by form feeds."""
    src = read_binary(spark, path, (".txt", ".md", ".docx", ".pdf")).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, texts, errors = [], [], []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                kind = name.rpartition(".")[2].lower()
                kinds.append(kind)
                try:
                    texts.append(docx_text(data) if kind == "docx" else "\f".join(pdf_pages(data)) if kind == "pdf" else data.decode("utf-8"))
                    errors.append(None)
                except Exception as e:  # one bad file costs itself only
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string()) for x in (kinds, texts, errors))], names=["path", "kind", "text", "error"])

    return src.mapInArrow(run, "path string, kind string, text string, error string")


def page_tokens(pages: DataFrame, page: str = "page", text: str = "text") -> DataFrame:
    """Pages with `tokens`, a token for four characters and one at least; pages without a number or text are left out."""
    return pages.where(F.col(page).isNotNull() & F.col(text).isNotNull()).withColumn("tokens", F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int")))


def read_binary(spark: SparkSession, path: str, suffixes: tuple[str, ...]) -> DataFrame:
    """Files below a folder as bytes, with their SHA-256."""
    t = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    keep = F.lit(False)
    for s in suffixes:
        keep = keep | F.lower("path").endswith(s)
    return t.where(keep).withColumn("file_hash", F.sha2("content", 256))


def not_indexed(files: DataFrame, index: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys (a file's hash, a query and its retriever, an id) are not done yet."""
    return files.join(index.select(*keys).distinct(), list(keys), "left_anti")


def write_index(df: DataFrame, path: str, fingerprint: str, mode: str = "append") -> None:
    """A vector index as Parquet by model fingerprint. Vectors of another model already there are an error, unless the
    index is made anew."""
    spark = df.sparkSession
    if mode == "append" and _exists(spark, path):
        other = spark.read.parquet(path).where(F.col("fingerprint") != fingerprint).limit(1).count()
        if other:
            raise ValueError("the index holds vectors of another model; write it anew")
    df.withColumn("fingerprint", F.lit(fingerprint)).write.mode(mode).partitionBy("fingerprint").parquet(path)


def write_sheet(df: DataFrame, path: str, sep: str = ",", longest: int | None = None) -> None:
    """CSV, or with another separator a review sheet: separators and line feeds in texts become blanks, and texts are cut
    at `longest` characters if that is given (the sheet's feature, not a sample)."""
    cols = []
    for f in df.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            c = F.translate(c, f"{sep if sep != ',' else ''}\r\n", "   ") if sep != "," else c
            c = F.left(c, F.lit(longest)) if longest else c
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        cols.append(c.alias(f.name))
    df.select(*cols).write.mode("overwrite").option("header", True).option("sep", sep).option("ignoreTrailingWhiteSpace", False).option("ignoreLeadingWhiteSpace", False).csv(path)


def combine_summaries(spark: SparkSession, paths: list[str], summary: str) -> DataFrame:
    """The `summary` structs (DDL) of several whole-file JSONs as rows with their file; files without one are marked."""
    t = spark.read.schema(f"summary {summary}").option("multiLine", True).json(paths)
    return t.select(F.input_file_name().alias("file"), F.col("summary").isNull().alias("skipped"), "summary.*")


def audit(df: DataFrame, file: str, text: str) -> DataFrame:
    """Rows, empty texts and characters of every file, and a total with a null file, in one pass."""
    return df.rollup(file).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(text).isNull() | (F.length(F.trim(text)) == 0)).alias("empty"), F.sum(F.length(text)).alias("chars"))


def registry(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, description) of tree documents: what they are said to cover, or their first five titles at the top."""
    top = nodes.where("parent_path = ''").select(key, F.col("node_path").cast("int").alias("i"), "title").where("title IS NOT NULL")
    t = top.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct("i", "title"))), 1, 5).alias("x"))
    return t.select(key, F.concat(F.lit("Document covering: "), F.array_join(F.transform("x", lambda s: s["title"]), ", ")).alias("description"))


def load_config(kind: type, path: str | None = None, env: Mapping[str, str] | None = None, prefix: str = "MILLRACE_"):
    """A dataclass of settings: its defaults, then a JSON file, then the environment. Keys that it doesn't have are errors."""
    values: dict = {}
    names = {f.name: f for f in dataclasses.fields(kind)}
    if path:
        with open(path, encoding="utf-8") as f:
            values |= json.load(f)
    for k, v in (os.environ if env is None else env).items():
        if k.startswith(prefix) and (n := k[len(prefix) :].lower()) in names:
            t = names[n].type
            values[n] = v if t in (str, "str") else json.loads(v)
    if unknown := sorted(set(values) - set(names)):
        raise ValueError("unknown settings: " + ", ".join(unknown))
    return kind(**values)
