"""Writers: partitioned tables, shards merged by key, appended results that can be resumed, reports of small frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewake.operators.tables import upsert


def table(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet, in one folder per value of `by`. Rows are shuffled on `by` and a salt, so that a value with many rows gets several files."""
    if by:
        df.repartition(*by, F.pmod(F.xxhash64(*df.columns[:1]), F.lit(8))).write.mode(mode).partitionBy(*by).parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def csv(df: DataFrame, path: str, compressed: bool = False, mode: str = "overwrite") -> None:
    """CSV with a header, quotes doubled; gzip on request."""
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').option("compression", "gzip" if compressed else "none").csv(path)


def append_new(df: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows whose key the table does not hold yet; returns their number. Running it again appends nothing."""
    spark = df.sparkSession
    new = df.dropDuplicates(keys)
    try:
        new = new.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    before = _count(spark, path)
    new.write.mode("append").parquet(path)
    return _count(spark, path) - before


def _count(spark, path: str) -> int:
    try:
        return spark.read.parquet(path).count()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return 0
        raise


def merged(original: DataFrame, rerun: DataFrame, keys: list[str], cap: int, column: str = "truncation_cap_used") -> DataFrame:
    """Rerun rows in place of the originals, with the cap they used; merging again changes nothing."""
    rows = rerun if column in rerun.columns else rerun.withColumn(column, F.lit(cap))
    return upsert(original, rows, keys)


def truncated_pairs(matches: DataFrame, column: str = "truncation_cap_used") -> DataFrame:
    """Pairs whose comment was cut and that no rerun has covered, with docket and rule type; a table without the cap column has had none."""
    done = F.col(column).isNotNull() if column in matches.columns else F.lit(False)
    docket, rule = F.regexp_extract("obligation_id", "^(.+?)__(proposed|final)__", 1), F.regexp_extract("obligation_id", "^(.+?)__(proposed|final)__", 2)
    return matches.filter(F.col("uncertainty_truncated") & ~done).select("comment_id", "obligation_id", docket.alias("docket_id"), rule.alias("rule_type"))


def recovered(index: DataFrame, found: DataFrame, keys: list[str], missing: Column) -> DataFrame:
    """Missing rows replaced by recovered ones of the same key; other rows stay."""
    gaps = index.filter(missing)
    return upsert(index, found.join(gaps.select(*keys).distinct(), keys, "left_semi"), keys)


def release(df: DataFrame, keep: list[str]) -> DataFrame:
    """Ids and labels only, once each: what can be published without texts."""
    return df.select(*keep).distinct()


def markdown(df: DataFrame, most: int = 200) -> str:
    """A small frame as a Markdown table."""
    rows = df.limit(most).collect()
    line = lambda cells: "| " + " | ".join(str("" if c is None else c).replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(df.columns), line(["-"] * len(df.columns)), *(line(r) for r in rows)])
