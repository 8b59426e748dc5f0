"""Profiles as report tables and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators.taxonomy import RANKS, lineages, rolled_up

#: Prefixes of the ranks in clade names (fixed values of the format).
PREFIXES = dict(zip(RANKS, ("k__", "p__", "c__", "o__", "f__", "g__", "s__", "t__"), strict=True))


def _rolled(amounts: DataFrame, closed: DataFrame, names: DataFrame, show: tuple[str, ...]) -> DataFrame:
    rows = rolled_up(amounts, closed).filter(F.col("rank").isin(*show))
    return rows.join(lineages(closed, names, show), "taxid")


def cami(amounts: DataFrame, closed: DataFrame, names: DataFrame, show: tuple[str, ...] = RANKS) -> DataFrame:
    """(taxid, rank, taxpath, taxpathsn, percentage, place): every rank's taxa; place orders ranks, then percentages."""
    rows = _rolled(amounts, closed, names, show)
    return rows.select("taxid", "rank", F.array_join("lineage_ids", "|").alias("taxpath"), F.array_join("lineage_names", "|").alias("taxpathsn"), "percentage", _place("rank", show).alias("place"))


def metaphlan(amounts: DataFrame, closed: DataFrame, names: DataFrame, show: tuple[str, ...] = RANKS, prefixes: dict[str, str] = PREFIXES) -> DataFrame:
    """(clade_name, ncbi_tax_id, relative_abundance, additional_species, place)."""
    rows = _rolled(amounts, closed, names, show)
    mark = F.create_map(*[F.lit(x) for r in show for x in (r, prefixes[r])])
    clade = F.array_join(F.zip_with("lineage_ranks", "lineage_names", lambda r, n: F.concat(F.element_at(mark, r), n)), "|")
    return rows.select(clade.alias("clade_name"), F.array_join("lineage_ids", "|").alias("ncbi_tax_id"), F.col("percentage").alias("relative_abundance"), F.lit("").alias("additional_species"), _place("rank", show).alias("place"))


def _place(rank: str, show: tuple[str, ...]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for i, r in enumerate(show) for x in (r, i)]), F.col(rank))


def profile_table(t: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """A profile with its numbers as text, in the columns and formats of the profile file."""
    fmt = lambda c, f: F.format_string(f, c)
    rows = t if "name" in t.columns else t.withColumn("name", F.lit(""))
    return rows.select(
        F.col("target").alias("ref"), fmt("percentage", "%.6f").alias("percentage"), fmt("coverage", "%.6f").alias("coverage"), fmt("score", "%.2f").alias("score"), fmt("chunks_frac", "%.2f").alias("chunksFrac"),
        F.bround("reads", 0).cast("long").alias("reads"), F.bround("uniq", 0).cast("long").alias("ureads"), F.bround("hic", 0).cast("long").alias("hicureads"), F.col("name").alias("refname"),
    )


def write_tsv(df: DataFrame, path: str, header: bool = True, gzip: bool = False) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", header).option("compression", "gzip" if gzip else "none").csv(path)


def write_lines(df: DataFrame, path: str, head: list[str], columns: list[str], order: list[Column]) -> None:
    """Head lines, then rows as tab-separated text in order, as one file: reports have as many rows as taxa."""
    from pyspark.sql import Window

    line = F.concat_ws("\t", *[F.col(c).cast("string") for c in columns])
    rows = df.select((F.row_number().over(Window.orderBy(*order)) + len(head)).cast("long").alias("n"), line.alias("value"))
    if head:
        rows = df.sparkSession.createDataFrame(list(enumerate(head)), "n long, value string").unionByName(rows)
    rows.repartition(1).sortWithinPartitions("n").select("value").write.mode("overwrite").text(path)


def write_cami(report: DataFrame, path: str, sample: str = "", version: str = "0.9.1", taxonomy: str = "", show: tuple[str, ...] = RANKS) -> None:
    head = [f"@SampleID:{sample}", f"@Version:{version}", f"@Ranks:{'|'.join(show)}", f"@TaxonomyID:{taxonomy}", "@@TAXID\tRANK\tTAXPATH\tTAXPATHSN\tPERCENTAGE"]
    rows = report.withColumn("pct", F.format_string("%.15f", "percentage"))
    write_lines(rows, path, head, ["taxid", "rank", "taxpath", "taxpathsn", "pct"], [F.col("place"), F.col("percentage").desc(), F.col("taxid")])


def write_metaphlan(report: DataFrame, path: str, sample: str = "", version: int = 3) -> None:
    rows = report.withColumn("pct", F.format_string("%.6f", "relative_abundance"))
    if version == 2:
        return write_lines(rows, path, [f"#SampleID\t{sample}"], ["clade_name", "pct"], [F.col("place"), F.col("relative_abundance").desc()])
    head = [f"#SampleID\t{sample}", "#clade_name\tNCBI_tax_id\trelative_abundance\tadditional_species"]
    return write_lines(rows, path, head, ["clade_name", "ncbi_tax_id", "pct", "additional_species"], [F.col("place"), F.col("relative_abundance").desc()])


def write_binning(bins: DataFrame, path: str, sample: str = "", version: str = "0.9.0") -> None:
    """Sequence ids and taxids; many rows, so part files, with the head lines in the first."""
    rows = bins.select(F.concat_ws("\t", F.col("query").cast("string"), F.col("taxid").cast("string")).alias("value"))
    head = bins.sparkSession.createDataFrame([(h,) for h in (f"@SampleID:{sample}", f"@Version:{version}", "@@SEQUENCEID\tTAXID")], "value string").coalesce(1)
    head.unionByName(rows).write.mode("overwrite").text(path)


def write_bed(regions_bed: DataFrame, path: str) -> None:
    regions_bed.write.mode("overwrite").option("sep", "\t").csv(path)
