"""Taxonomy: ancestor closure, lowest common ancestors, rank tests, roll-up, lineages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.session import settle

RANKS = ("superkingdom", "phylum", "class", "order", "family", "genus", "species", "strain")


def current(ids: DataFrame, merged: DataFrame | None = None, deleted: DataFrame | None = None, col: str = "taxid") -> DataFrame:
    """ids with merged taxids replaced by the new ones and deleted ones left out."""
    if merged is not None:
        m = merged.select(F.col("old").alias(col), F.col("new").alias("_new"))
        ids = ids.join(m, col, "left").withColumn(col, F.coalesce("_new", col)).drop("_new")
    return ids.join(deleted.select(F.col("taxid").alias(col)), col, "left_anti") if deleted is not None else ids


def closure(nodes: DataFrame) -> DataFrame:
    """(taxid, ancestor, rank, depth) of nodes (taxid, parent, rank): every node with itself and all above.

    depth is the ancestor's distance from the root (a node that is its own parent).
    Paths double in length each round until none grows, so the rounds are the logarithm of
    the height; a path as long as there are nodes is a cycle, and an error."""
    up = nodes.filter("taxid <> parent").select("taxid", F.col("parent").alias("ancestor"), F.lit(1).alias("steps"))
    paths = settle(nodes.select("taxid", F.col("taxid").alias("ancestor"), F.lit(0).alias("steps")).unionByName(up))
    n = paths.filter("steps = 0").count()
    reach = 1
    while True:
        far = paths.filter(F.col("steps") == reach).select("taxid", F.col("ancestor").alias("_via"))
        more = far.join(paths.filter("steps > 0").select(F.col("taxid").alias("_via"), "ancestor", F.col("steps").alias("_s")), "_via").select("taxid", "ancestor", (F.col("_s") + reach).alias("steps"))
        more = settle(more)
        if more.isEmpty():
            break
        reach *= 2
        if reach > 2 * n:
            raise ValueError("the taxonomy has a cycle")
        paths = paths.unionByName(more)
    height = paths.groupBy("taxid").agg(F.max("steps").alias("_h"))
    ranks = nodes.select(F.col("taxid").alias("ancestor"), "rank")
    return paths.join(height, "taxid").join(ranks, "ancestor").select("taxid", "ancestor", "rank", (F.col("_h") - F.col("steps")).cast("int").alias("depth"))


def lca(members: DataFrame, closed: DataFrame, key: str = "query") -> DataFrame:
    """(key, lca, rank, n): the deepest ancestor that all taxids of a key have; keys with an unknown taxid are left out."""
    ids = members.select(key, "taxid").distinct()
    n = ids.groupBy(key).agg(F.count("*").alias("n"))
    shared = ids.join(closed, "taxid").groupBy(key, "ancestor", "rank", "depth").agg(F.count("*").alias("_c"))
    common = shared.join(n, key).filter("_c = n")
    return common.groupBy(key, "n").agg(F.max(F.struct("depth", "ancestor", "rank")).alias("_m")).select(key, F.col("_m.ancestor").alias("lca"), F.col("_m.rank").alias("rank"), "n")


def at_or_below(closed: DataFrame, rank: str = "species") -> DataFrame:
    """(taxid, at): taxids at the rank or below it, with their ancestor of that rank."""
    return closed.filter(F.col("rank") == rank).groupBy("taxid").agg(F.max(F.struct("depth", "ancestor")).alias("_m")).select("taxid", F.col("_m.ancestor").alias("at"))


def rolled_up(amounts: DataFrame, closed: DataFrame, value: str = "percentage") -> DataFrame:
    """(taxid, rank, depth, value): amounts of taxids added up over everything below."""
    out = amounts.join(closed, "taxid").groupBy("ancestor", "rank", "depth").agg(F.sum(value).alias(value))
    return out.withColumnRenamed("ancestor", "taxid")


def lineages(closed: DataFrame, names: DataFrame, show: tuple[str, ...] = RANKS) -> DataFrame:
    """(taxid, lineage_ids, lineage_names, lineage_ranks): ancestors of the shown ranks from the top."""
    rows = closed.filter(F.col("rank").isin(*show)).join(names.select(F.col("taxid").alias("ancestor"), "name"), "ancestor")
    path = F.array_sort(F.collect_list(F.struct("depth", "ancestor", "name", "rank")))
    return rows.groupBy("taxid").agg(path.alias("_p")).select("taxid", F.transform("_p", lambda x: x["ancestor"]).alias("lineage_ids"), F.transform("_p", lambda x: x["name"]).alias("lineage_names"), F.transform("_p", lambda x: x["rank"]).alias("lineage_ranks"))


def with_taxids(found: DataFrame, mapping: DataFrame, strict: bool = True) -> DataFrame:
    """found with the taxid of each target; a missing one is an error where strict, else null."""
    out = found.join(mapping.select("target", "taxid"), "target", "left")
    if strict:
        known = F.when(F.col("taxid").isNull(), F.raise_error(F.concat(F.lit("no taxid for target "), F.col("target").cast("string"))).cast("long")).otherwise(F.col("taxid"))
        out = out.withColumn("taxid", known)
    return out


def specific(found: DataFrame, mapping: DataFrame, closed: DataFrame, level: str = "species") -> DataFrame:
    """Rows of queries with one target, or, at species level, whose targets all lie at or below one species."""
    per = found.groupBy("query").agg(F.countDistinct("target").alias("_n"))
    if level == "strain":
        keep = per.filter("_n = 1").select("query")
    else:
        common = lca(with_taxids(found.select("query", "target").distinct(), mapping), closed)
        below = at_or_below(closed, level).select(F.col("taxid").alias("lca"))
        keep = per.filter("_n = 1").select("query").unionByName(common.filter("n > 1").join(below, "lca", "left_semi").select("query")).distinct()
    return found.join(keep, "query", "left_semi")


def binning(found: DataFrame, mapping: DataFrame, closed: DataFrame) -> DataFrame:
    """(query, taxid): the lowest common ancestor of a query's targets."""
    return lca(with_taxids(found.select("query", "target").distinct(), mapping), closed).select("query", F.col("lca").alias("taxid"))
