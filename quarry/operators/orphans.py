"""References to records that do not exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import trim_all
from quarry.sources.tables import cut

#: A key is hot if more than one in so many of all rows has it; so there are fewer hot keys than that.
HOT = 1000


def clean_id(c: Column) -> Column:
    """An id without surrounding blanks, in lower case; null where nothing is left."""
    t = F.lower(trim_all(c))
    return F.when(t != "", t)


def clean_symbol(c: Column) -> Column:
    """A target as it is compared: no blanks around it, lower case, no leading @, no final (); null if it was blank."""
    t = F.lower(trim_all(c))
    return F.when(t != "", trim_all(F.regexp_replace(t, r"^@|\(\)$", "")))


def symbol_ends(c: Column) -> Column:
    """c itself and each of its ends after a `.`, `\\`, `/` or `::`, without repeats."""
    return F.array_distinct(F.concat(F.array(c), F.regexp_extract_all(c, F.lit(r"(?s)(?:[.\\/]|::)(?=(.*))"), F.lit(1))))


def orphan_keys(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct child keys that no parent row has, with `n`, their child rows.

    Both sides are tagged, put one under the other in long form and grouped by key once: the sums are partial
    before the shuffle, so a key with a third of all rows travels as one row per task. children may carry `n`.
    Null keys are equal to null keys; drop them first if they are no references.
    """
    count = F.col("n") if "n" in children.columns else F.lit(1)
    long = children.select(*keys, count.cast("long").alias("n"), F.lit(False).alias("parent")).unionByName(
        parents.select(*keys, F.lit(0).cast("long").alias("n"), F.lit(True).alias("parent"))
    )
    grouped = long.groupBy(*keys).agg(F.max("parent").alias("parent"), F.sum("n").alias("n"))
    return grouped.where(~F.col("parent") & (F.col("n") > 0)).drop("parent")


def rows_with_keys(rows: DataFrame, found: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows whose keys are in `found` (distinct keys with `n`, their rows); total is the number of all rows.

    Hot keys, fewer than HOT whatever the data, go to the rows where they are read; the rest meet in a shuffle in which
    no key has more than one in HOT of all rows."""

    def on(a: DataFrame, b: DataFrame) -> Column:
        out = a[keys[0]].eqNullSafe(b[keys[0]])
        for k in keys[1:]:
            out = out & a[k].eqNullSafe(b[k])
        return out

    much = total // HOT
    hot = F.broadcast(found.where(F.col("n") > much).select(*keys))
    rest = found.where(F.col("n") <= much).select(*keys)
    return rows.join(hot, on(rows, hot), "left_semi").unionByName(rows.join(hot, on(rows, hot), "left_anti").join(rest, on(rows, rest), "left_semi"))


def reference_rows(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """All references in long form: table_name, field_name, row_key, space, repo, key, at.

    Rows delivered twice count once, with their first time. Null, empty and blank keys are no references.
    """
    r = refs.groupBy("ref_id", "repo", "source_chunk_id", "target_symbol").agg(F.min("seen_at").alias("at"))
    c = chunks.groupBy("id", "parent_chunk_id").agg(F.min("indexed_at").alias("at"))

    def long(df, table, field, row_key, space, repo, key):
        return df.select(
            F.lit(table).alias("table_name"), F.lit(field).alias("field_name"), F.col(row_key).cast("string").alias("row_key"),
            F.lit(space).alias("space"), repo.alias("repo"), key.alias("key"), "at",
        )

    none = F.lit(None).cast("string")
    return (
        long(r, "refs", "source_chunk_id", "ref_id", "chunk", none, clean_id(F.col("source_chunk_id")))
        .unionByName(long(r, "refs", "target_symbol", "ref_id", "symbol", F.col("repo"), clean_symbol(F.col("target_symbol"))))
        .unionByName(long(c, "chunks", "parent_chunk_id", "id", "chunk", none, clean_id(F.col("parent_chunk_id"))))
        .where(F.col("key").isNotNull())
    )


def parent_rows(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """space, repo, key and the time (`at`) of each record that can be referred to; withdrawn definitions are none."""
    name = F.lower(trim_all(F.col("symbol_name")))
    return chunks.select(F.lit("chunk").alias("space"), F.lit(None).cast("string").alias("repo"), clean_id(F.col("id")).alias("key"), F.col("indexed_at").alias("at")).unionByName(
        symbols.where(F.col("removed_at").isNull() & (name != "")).select(F.lit("symbol").alias("space"), "repo", name.alias("key"), F.col("indexed_at").alias("at"))
    )


def lost_keys(rows: DataFrame, chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """(space, repo, key, n): the keys of reference_rows that lead nowhere, with the number of references that name them.

    A symbol target may be met by any of its ends, so the distinct targets are expanded to their ends, those
    ends are grouped with the parents, and a target dangles when all of its ends are orphans."""
    keys = ["space", "repo", "key"]
    wanted = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    ends = wanted.select("space", "repo", F.col("key").alias("full"), "n", F.explode(F.when(F.col("space") == "symbol", symbol_ends(F.col("key"))).otherwise(F.array("key"))).alias("key"))
    orphan = orphan_keys(ends, parent_rows(chunks, symbols).where(F.col("key").isNotNull()), keys).select(*keys, F.lit(1).alias("lost"))
    o, e = orphan.alias("o"), ends.alias("e")
    judged = e.join(o, (F.col("e.space") == F.col("o.space")) & F.col("e.repo").eqNullSafe(F.col("o.repo")) & (F.col("e.key") == F.col("o.key")), "left")
    lost = judged.groupBy("e.space", "e.repo", "e.full").agg(F.min(F.coalesce("o.lost", F.lit(0))).alias("lost"), F.first("e.n").alias("n")).where("lost = 1")
    return lost.select("space", "repo", F.col("full").alias("key"), "n")


def dangling(refs: DataFrame, chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row per dangling reference at the end of the data: table_name, field_name, row_key, repo, at.

    The long form of the references is written once and serves the grouping and the rows that come out.
    Empty tables give no rows; a row_key appears once per field."""
    rows = cut(reference_rows(refs, chunks))
    lost = cut(lost_keys(rows, chunks, symbols))
    return rows_with_keys(rows, lost, ["space", "repo", "key"], rows.count()).select("table_name", "field_name", "row_key", "repo", "at")


def dangling_by_period(refs: DataFrame, chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per table, field and month: references, dangling ones and their share.

    References are counted by key and month before the lost keys meet the counts; no row is joined."""
    rows = cut(reference_rows(refs, chunks))
    counts = rows.groupBy("table_name", "field_name", "space", "repo", "key", F.date_format("at", "yyyy-MM").alias("period")).agg(F.count("*").alias("n"))
    lost = lost_keys(rows, chunks, symbols).select("space", "repo", "key", F.lit(True).alias("lost")).alias("l")
    c = counts.alias("c")
    j = c.join(lost, (F.col("c.space") == F.col("l.space")) & F.col("c.repo").eqNullSafe(F.col("l.repo")) & (F.col("c.key") == F.col("l.key")), "left")
    total = j.groupBy("table_name", "field_name", "period").agg(F.sum("n").alias("n_references"), F.sum(F.when(F.col("lost"), F.col("n")).otherwise(0)).alias("n_dangling"))
    return total.withColumn("share", F.round(F.col("n_dangling") / F.col("n_references"), 6))
