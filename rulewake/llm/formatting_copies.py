"""Copies that differ only in white space, case, punctuation or the order of form fields.

Byte-identical texts are collapsed first, with counts, so that only distinct texts are canonicalised. Those are grouped
again on the full canonical text, summing the counts. Both groupings combine on the map side; members are attached by
joins on keys, so no group is ever gathered in one row.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewake.session import prepare, stored

#: A form is a text of labelled fields; labels are short. Fields stand on lines or between ; and |.
FIELD = r"^\s*([\p{L}][\p{L}\p{N} '’/_.-]{0,38}?)\s*[:=]\s*(.*)$"
SEPARATORS = r"[\r\n\x{85}\x{2028}\x{2029};|]+"
LEAST_FIELDS = 2


def letters(column: Column) -> Column:
    """The letters and digits of a composed text, with the marks that belong to them, case ignored: null for null."""
    return F.replace(F.lower(F.regexp_replace(column, r"[^\p{L}\p{N}\p{M}]+", "")), F.lit("ß"), F.lit("ss"))


def composed(rows: DataFrame) -> DataFrame:
    """(text, ...) with accents composed (NFC), so that a letter and its combining mark equal the accented letter. One map in Arrow batches, without shuffle."""
    at = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            own = [t if t.isascii() or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t) for t in texts]
            columns = list(b.columns)
            if own != texts:
                columns[at] = pa.array(own, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return rows.mapInArrow(run, rows.schema)


def fields(column: Column) -> Column:
    """The sorted labelled fields of a form as one string, or null where any part of the text is no labelled field.

    Parts without letters and digits are skipped. A repeated field counts as often as it stands there.
    """
    parts = F.filter(F.split(column, SEPARATORS), lambda p: F.length(letters(p)) > 0)
    one = F.transform(parts, lambda p: F.when(p.rlike(FIELD), F.concat(letters(F.regexp_extract(p, FIELD, 1)), F.lit(":"), letters(F.regexp_extract(p, FIELD, 2)))))
    whole = (F.size(parts) >= LEAST_FIELDS) & ~F.exists(one, lambda x: x.isNull())
    return F.when(column.rlike("[:=]") & column.rlike(r"[\r\n;|]") & whole, F.array_join(F.array_sort(one), "|"))


def _rows(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return df.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).cast("string").alias("text")).filter(F.col("id").isNotNull() & F.col("text").isNotNull())


def classes(df: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame]:
    """(members, texts). members: (id, raw) without repeats. texts: (raw, first_id, n_copies), one row per distinct text, with
    the smallest id and the number of ids of its class.

    raw is the SHA-256 of the bytes of a text. Texts without any letter or digit are copies of each other only if
    byte-identical. Null texts and null ids are left out. An id that stands with two different texts is a member of both.
    """
    prepare(df.sparkSession)
    members = _rows(df, id_column, text_column).select("id", "text", F.unhex(F.sha2("text", 256)).alias("raw"))
    ids = members.select("id", "raw").distinct()
    counted = ids.groupBy("raw").agg(F.min("id").alias("raw_first"), F.count("*").alias("raw_copies"))
    texts = members.groupBy("raw").agg(F.any_value("text").alias("text"))
    # one row per distinct text from here on; canonicalised once and written, since two later steps read it
    bare = letters(F.col("text"))
    canonical = F.when(bare != "", bare).otherwise(F.concat(F.lit("\u0000"), F.hex("raw")))
    survivors = composed(texts.join(counted, "raw")).select("raw", "raw_first", "raw_copies", canonical.alias("bare"), fields(F.col("text")).alias("form"))
    survivors = stored(survivors.withColumn("bare_key", F.unhex(F.sha2("bare", 256))), "canonical-texts")
    # The same letters in the same order are the same text, form or not; the smallest field list of such texts stands for all of them.
    grouped = survivors.groupBy("bare").agg(F.any_value("bare_key").alias("bare_key"), F.min("form").alias("form"), F.min("raw_first").alias("first_id"), F.sum("raw_copies").alias("n_copies"))
    by_letters = stored(grouped.drop("bare"), "canonical-groups")
    forms = by_letters.filter("form IS NOT NULL")
    by_fields = forms.groupBy("form").agg(F.min("first_id").alias("first_id"), F.sum("n_copies").alias("n_copies"))
    named = by_letters.filter("form IS NULL").select("bare_key", "first_id", "n_copies").unionByName(forms.select("bare_key", "form").join(by_fields, "form").select("bare_key", "first_id", "n_copies"))
    return ids, survivors.select("raw", "bare_key").join(named, "bare_key").select("raw", "first_id", "n_copies")


def collapsed(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(first_id, text, n_copies): each distinct text once, as written in the row of the smallest id, with its number of copies."""
    ids, texts = classes(df, id_column, text_column)
    groups = texts.select("first_id", "n_copies").distinct()
    source = _rows(df, id_column, text_column).groupBy("id").agg(F.min("text").alias("text"))
    return groups.join(source, groups["first_id"] == source["id"]).select("first_id", "text", "n_copies")


def copies(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(first_id, id) of every member of a class of at least two but its smallest id."""
    ids, texts = classes(df, id_column, text_column)
    # texts has one row per key, so a key with very many members is split by the skew join without multiplying anything
    return ids.join(texts.filter("n_copies > 1"), "raw").filter(F.col("id") != F.col("first_id")).select("first_id", "id").distinct()
