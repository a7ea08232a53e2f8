"""Readers: messy CSV into one canonical schema, whole documents, JSON lines, pages of a service."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulewake.functions import text
from rulewake.operators.tables import conformed, snake, snake_columns
from rulewake.session import prepare

BROKEN = "_broken"
#: Dates of a record, parsed as UTC.
DATE_COLUMNS = ["posted_date", "received_date", "comment_start_date", "comment_due_date", "effective_date", "implementation_date", "postmark_date", "author_date"]


def listed(spark: SparkSession, folder: str, glob: str = "*.csv") -> DataFrame:
    """(path, name, agency, year, size) of the files of a folder and those below; agency and year are read from names such as AGENCY_2019_full.csv, else null."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    part = lambda i: F.when(name.rlike(r"^[A-Za-z]+_\d{4}"), F.regexp_extract(name, r"^([A-Za-z]+)_(\d{4})", i))
    return files.select("path", name.alias("name"), part(1).alias("agency"), part(2).cast("int").alias("year"), F.col("length").alias("size"))


def encoding_of(head: bytes) -> str:
    """utf-8 if the bytes are, else latin-1, which takes any; a cut sequence at the end is no error. A byte order mark counts as utf-8."""
    try:
        head.decode("utf-8")
    except UnicodeDecodeError as e:
        if e.start < len(head) - 3:
            return "latin-1"
    return "utf-8"


def csv(spark: SparkSession, paths: str | list[str], columns: list[str] | None = None, encoding: str = "utf-8") -> DataFrame:
    """All columns as text, only the empty string null, quotes doubled, line breaks inside quotes kept; records that don't fit are in the column _broken.

    columns is the header; without it the first file's is used. Selecting a few columns prunes the others.
    """
    reader = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", encoding).option("mode", "PERMISSIVE")
    names = columns or reader.load(paths, format="csv").columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, BROKEN]])
    return reader.option("columnNameOfCorruptRecord", BROKEN).option("enforceSchema", True).schema(schema).load(paths, format="csv")


def csv_quality(df: DataFrame) -> DataFrame:
    """One row (n_records, n_parsed, n_broken) of a table read by csv()."""
    # a record can only be judged if its columns are parsed, so all of them are referred to
    parsed = F.col(BROKEN).isNull() & (F.xxhash64(*(c for c in df.columns if c != BROKEN)) >= F.lit(-(1 << 63)))
    return df.agg(F.count_if(F.coalesce(parsed, F.lit(False)) | F.col(BROKEN).isNotNull()).alias("n_records"), F.count_if(parsed).alias("n_parsed"), F.count_if(F.col(BROKEN).isNotNull()).alias("n_broken"))


def union_schema(headers: list[list[str]]) -> list[str]:
    """All columns of several headers as snake names, in the order in which they are first met."""
    out: dict[str, None] = {}
    for header in headers:
        for name in header:
            out.setdefault(snake(name))
    return list(out)


def ingested(raw: DataFrame, schema: list[str], agency: Column, year: Column) -> DataFrame:
    """Records in the canonical schema: dates as timestamps, hash and attachment flag of the comment, agency, year and row_kind.

    A record with a link to another document is a comment, else a document. Bad dates become null.
    """
    kept = snake_columns(raw.drop(BROKEN))
    df = conformed(kept, {n: "string" for n in schema})
    dates = {n: F.try_to_timestamp(F.col(n)) for n in schema if n in DATE_COLUMNS}
    comment = F.col("comment") if "comment" in schema else F.lit(None).cast("string")
    link = F.col("comment_on_document_id") if "comment_on_document_id" in schema else F.lit(None).cast("string")
    return df.withColumns(dates).withColumns(
        {"agency": agency, "data_year": year, "comment_text_hash": text.comment_hash(comment), "is_attachment_only": text.is_attachment_only(comment), "row_kind": F.when(F.trim(F.coalesce(link, F.lit(""))) != "", "comment").otherwise("document")}
    )


def kind_mismatches(df: DataFrame, link: str, document_type: str) -> DataFrame:
    """Records whose link and type disagree on their being a comment."""
    by_link = F.trim(F.coalesce(F.col(link), F.lit(""))) != ""
    by_type = F.lower(F.coalesce(F.col(document_type), F.lit(""))).rlike("public submission|comment")
    return df.filter(by_link != by_type)


def dominant(df: DataFrame, columns: list[str], rows: int = 5000) -> DataFrame:
    """The most frequent value of each column among the first rows, to tell what a file is; nulls don't count."""
    return df.limit(rows).agg(*(F.mode(F.col(c), True).alias(c) for c in columns))


def tables(spark: SparkSession, paths: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """Parquet files whose schemas may differ, as one table; columns prunes the scan and leaves out those that don't exist."""
    df = spark.read.option("mergeSchema", "true").parquet(*([paths] if isinstance(paths, str) else paths))
    return df.select(*(c for c in columns if c in df.columns)) if columns else df


def whole_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, text) of whole files; bytes that are no UTF-8 become replacement characters."""
    return spark.read.option("wholetext", True).text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def kind_of(content: Column, path: Column | None = None) -> Column:
    """pdf, doc (any old office file), docx or what else a zip's extension says, html, rtf, text or unknown by the first bytes.

    A zip without a path is what its first entries say, or zip. Bytes beyond ASCII that are no UTF-8 are unknown.
    """
    head = F.hex(F.substring(content, 1, 8))
    starts = lambda b: head.startswith(b.hex().upper())
    begin = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    entry = F.when(begin.contains("word/"), "docx").when(begin.contains("xl/"), "xlsx").when(begin.contains("ppt/"), "pptx").otherwise("zip")
    suffix = F.nullif(F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)), F.lit("")) if path is not None else F.lit(None).cast("string")
    return (
        F.when(starts(b"%PDF"), "pdf")
        .when(starts(b"PK\x03\x04"), F.coalesce(suffix, entry))
        .when(starts(b"\xd0\xcf\x11\xe0"), "doc")
        .when(starts(b"{\\rtf"), "rtf")
        .when(F.lower(F.substring(begin, 1, 256)).rlike(r"^\s*(?:<!doctype html|<html)"), "html")
        .when((F.length(content) > 0) & (F.is_valid_utf8(content.cast("string")) | ~begin.rlike(r"\x00")), "text")
        .otherwise("unknown")
    )


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 where they are, else as Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def extracted(files: DataFrame, extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(path, kind, text, status) of binary files: text and HTML natively, other kinds by an injected function on the bytes, else `unsupported`; a failing file is `failed`."""
    prepare(files.sparkSession)
    own = files.select("path", "content", kind_of(F.col("content"), F.col("path")).alias("kind"))
    native = own.filter(F.col("kind").isin("text", "html", "unknown"))
    plain = decoded(F.col("content"))
    done = native.select("path", "kind", F.when(F.col("kind") == "html", text.without_tags(plain)).otherwise(plain).alias("text"), F.when(F.col("kind") == "unknown", "empty").otherwise("ok").alias("status"))
    functions = extractors or {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content, kind in zip(b["path"], b["content"], b["kind"]):
                if kind not in functions:
                    out.append((path, kind, None, "unsupported"))
                    continue
                try:
                    out.append((path, kind, functions[kind](bytes(content)), "ok"))
                except Exception:
                    out.append((path, kind, None, "failed"))
            yield pd.DataFrame(out, columns=["path", "kind", "text", "status"])

    others = own.filter(~F.col("kind").isin("text", "html", "unknown")).mapInPandas(run, "path string, kind string, text string, status string")
    return done.unionByName(others)


def recognised(pages: DataFrame, recogniser: Callable[[bytes], str]) -> DataFrame:
    """(doc_id, text, n_failed) of page images (doc_id, page, image): each page by an injected function, joined in order by blank lines; a failing page is skipped and counted."""
    prepare(pages.sparkSession)
    kind = pages.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, p, image in zip(b["doc_id"], b["page"], b["image"]):
                try:
                    out.append((d, p, recogniser(bytes(image))))
                except Exception:
                    out.append((d, p, None))
            yield pd.DataFrame(out, columns=["doc_id", "page", "text"])

    read = pages.select("doc_id", "page", "image").mapInPandas(run, f"doc_id {kind}, page int, text string")
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    return read.groupBy("doc_id").agg(F.array_join(F.filter(F.transform(ordered, lambda x: x["text"]), lambda t: t.isNotNull()), "\n\n").alias("text"), F.count_if(F.col("text").isNull()).alias("n_failed"))


def fetched(requests: DataFrame, fetch: Callable[[str], str | None], tries: int = 3) -> DataFrame:
    """Adds body and status (ok, missing, failed) to requests (url): an injected function asks the service; errors are tried again, null is missing."""
    prepare(requests.sparkSession)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)

    def one(url: str) -> tuple[str | None, str]:
        for _ in range(tries):
            try:
                body = fetch(url)
                return (body, "ok") if body is not None else (None, "missing")
            except Exception:
                continue
        return None, "failed"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [one(u) for u in b["url"]]
            yield b.assign(body=[g[0] for g in got], status=[g[1] for g in got])

    return requests.mapInPandas(run, f"{kinds}, body string, status string")


def attachments(responses: DataFrame) -> DataFrame:
    """(document_id, attachment, url, format, size) of API answers (document_id, body): one row per file, and one of nulls for a document without any."""
    schema = "struct<included:array<struct<id:string,attributes:struct<title:string,fileFormats:array<struct<fileUrl:string,format:string,size:bigint>>>>>>"
    parsed = responses.select("document_id", F.from_json("body", schema).alias("j"))
    each = parsed.select("document_id", F.explode_outer("j.included").alias("a")).select("document_id", F.col("a.id").alias("attachment"), F.explode_outer("a.attributes.fileFormats").alias("f"))
    return each.select("document_id", "attachment", F.col("f.fileUrl").alias("url"), F.col("f.format").alias("format"), F.col("f.size").alias("size"))


def chosen_url(urls: Column) -> tuple[Column, Column]:
    """(url, status) of a list separated by commas: the first PDF among the web addresses, else the first of them; no_urls or no_http where there is none."""
    every = F.transform(F.split(F.coalesce(urls, F.lit("")), ","), lambda u: F.trim(u))
    web = F.filter(every, lambda u: u.rlike("^https?://"))
    pdf = F.filter(web, lambda u: F.lower(u).endswith(".pdf"))
    url = F.coalesce(F.get(pdf, F.lit(0)), F.get(web, F.lit(0)))
    return url, F.when(F.trim(F.coalesce(urls, F.lit(""))) == "", "no_urls").when(url.isNull(), "no_http").otherwise("ok")


def text_source(attachment_only: Column, embedded: Column, recognised_text: Column, vision: Column) -> tuple[Column, Column]:
    """(text_source, recovered text): comments with text of their own are `inform`; the others take the first text that was recovered, else attachment_failed."""
    full = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    source = F.when(~F.coalesce(attachment_only, F.lit(False)), "inform").when(full(embedded), "attachment_pdfplumber").when(full(recognised_text), "attachment_pytesseract").when(full(vision), "attachment_vision_llm").otherwise("attachment_failed")
    recovered = F.when(source == "attachment_pdfplumber", embedded).when(source == "attachment_pytesseract", recognised_text).when(source == "attachment_vision_llm", vision)
    return source, recovered


def schema_to_json(schema: T.StructType) -> str:
    return json.dumps(schema.jsonValue(), indent=1)


def schema_from_json(saved: str) -> T.StructType:
    return T.StructType.fromJson(json.loads(saved))
