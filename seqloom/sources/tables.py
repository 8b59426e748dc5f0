"""Readers and writers of the engine's own tables and text formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import bloom, sketch
from seqloom.operators.matches import latest
from seqloom.sources import schemas as S


def read_matches(spark: SparkSession, paths: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """Search results from text files under this engine's names; header and trailer lines are comments.

    Columns that aren't asked for are not parsed. file and line tell repeated indices of several files apart."""
    raw = spark.read.schema(S.SEARCH_RESULT).option("sep", "\t").option("comment", "#").option("quote", "").csv(paths)
    names = {"qLen": "q_len", "qKmers": "q_kmers", "FPR": "fpr", "chunkIdx": "chunk_idx", "tLen": "t_len", "kSize": "k_size", "mKmers": "m_kmers", "qCov": "q_cov", "tCov": "t_cov", "queryIdx": "query_idx"}
    out = raw.select(*[F.col(c).alias(names.get(c, c)) for c in raw.columns])
    return out.select(*columns) if columns else out


def read_stats(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(name, value) of the trailer lines of search results, e.g. the number of input queries."""
    lines = spark.read.text(paths).filter(F.col("value").rlike(r"^# ([\w ]+): (.+)"))
    return lines.select(F.regexp_extract("value", r"^# ([\w ]+): (.+)", 1).alias("name"), F.regexp_extract("value", r"^# ([\w ]+): (.+)", 2).alias("value"))


def match_lines(found: DataFrame) -> DataFrame:
    """One text line for each match, in the columns and number formats of the result file."""
    num = {"fpr": "%.4e", "q_cov": "%.4f", "t_cov": "%.4f", "jacc": "%.4f"}
    order = ["query", "q_len", "q_kmers", "fpr", "hits", "target", "chunk_idx", "chunks", "t_len", "k_size", "m_kmers", "q_cov", "t_cov", "jacc", "query_idx"]
    text = [F.format_string(num[c], F.col(c)) if c in num else F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order]
    return found.select("query_idx", "q_cov", "target", "chunk_idx", F.concat_ws("\t", *text).alias("value"))


def write_matches(found: DataFrame, path: str, queries: int, matched: int, gzip: bool = False) -> None:
    """Part files in the order of the queries: the first has the header, the last the trailer."""
    spark = found.sparkSession
    rows = match_lines(found).repartitionByRange("query_idx").sortWithinPartitions("query_idx", F.col("q_cov").desc(), "target", "chunk_idx").select("value")
    head = spark.createDataFrame([("#" + "\t".join(f.name for f in S.SEARCH_RESULT.fields),)], "value string").coalesce(1)
    share = matched / queries * 100 if queries else 0.0
    tail = spark.createDataFrame([(f"# input queries: {queries}",), (f"# matched queries: {matched}",), (f"# matched percentage: {share:.4f}%",)], "value string").coalesce(1)
    head.union(rows).union(tail).write.mode("overwrite").option("compression", "gzip" if gzip else "none").text(path)


def read_map(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(key, value) of tab-separated maps; a later file overrides an earlier one."""
    parts = None
    for i, p in enumerate(paths):
        one = spark.read.schema(S.KEY_VALUE).option("sep", "\t").option("quote", "").csv(p)
        one = one.select("key", "value", F.lit(i).alias("file"), F.monotonically_increasing_id().alias("line"))
        parts = one if parts is None else parts.unionByName(one)
    return latest(parts)


def read_taxdump(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """nodes (taxid, parent, rank), names (taxid, name), merged (old, new), deleted (taxid) of a taxonomy dump.

    Nodes and names must be there; the other files may be missing."""

    def fields(name: str) -> DataFrame:
        return spark.read.text(f"{path}/{name}").select(F.split(F.regexp_replace("value", r"\t\|$", ""), r"\t\|\t").alias("f")).filter(F.length(F.trim(F.col("f")[0])) > 0)

    def optional(name: str, columns: list, empty: str) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return fields(name).select(*columns)
        except AnalysisException:
            return spark.createDataFrame([], empty)

    f = F.col("f")
    nodes = fields("nodes.dmp").select(f[0].cast("long").alias("taxid"), f[1].cast("long").alias("parent"), f[2].alias("rank"))
    names = fields("names.dmp").filter(f[3] == "scientific name").select(f[0].cast("long").alias("taxid"), f[1].alias("name"))
    merged = optional("merged.dmp", [f[0].cast("long").alias("old"), f[1].cast("long").alias("new")], "old long, new long")
    deleted = optional("delnodes.dmp", [f[0].cast("long").alias("taxid")], "taxid long")
    return {"nodes": nodes, "names": names, "merged": merged, "deleted": deleted}


def write_sets(path: str, sets: DataFrame) -> DataFrame:
    """The sets of a database folder, written and read again."""
    sets.write.mode("overwrite").parquet(f"{path}/sets")
    return sets.sparkSession.read.parquet(f"{path}/sets")


def write_database(path: str, sets: DataFrame, matrix: DataFrame | None, packed: DataFrame | None, manifest: dict, with_sets: bool = True) -> None:
    """A database folder: sets, and, where there is an index, its slots and words of bits by block; the manifest last."""
    spark = sets.sparkSession
    if with_sets:
        write_sets(path, sets)
    if matrix is not None and packed is not None:
        packed.write.mode("overwrite").parquet(f"{path}/slots")
        # dense() gives the rows of a word together and in order already; they aren't shuffled again.
        if "slot" in matrix.columns:
            matrix = bloom.dense_rows(matrix).repartition("block", "word").sortWithinPartitions("block", "word", "loc")
        matrix.write.mode("overwrite").partitionBy("block").parquet(f"{path}/bits")
    row = {f.name: manifest.get(f.name) for f in S.MANIFEST.fields} | {"version": S.DB_VERSION}
    spark.createDataFrame([tuple(row[f.name] for f in S.MANIFEST.fields)], S.MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def read_database(spark: SparkSession, path: str) -> dict:
    """manifest (dict), names (sets without k-mers), sets, and slots and bits where they were written.

    Where the database keeps texts, their k-mers are made from them as the manifest says."""
    from pyspark.errors import AnalysisException

    manifest = spark.read.schema(S.MANIFEST).parquet(f"{path}/manifest").first()
    if manifest is None or manifest["version"] != S.DB_VERSION:
        raise ValueError(f"{path} is not a database of version {S.DB_VERSION}")
    kept = spark.read.parquet(f"{path}/sets")
    names = kept.drop("kmers", "seq")
    sets = kept if "kmers" in kept.columns else sketch.sets_of(kept, sketch.Settings.of(manifest.asDict()), tuple(c for c in names.columns if c != "n_kmers"))
    out = {"manifest": manifest.asDict(), "names": names, "sets": sets}
    try:
        out |= {"slots": spark.read.parquet(f"{path}/slots"), "bits": spark.read.parquet(f"{path}/bits")}
    except AnalysisException:
        pass
    return out


def discover(spark: SparkSession, path: str) -> list[str]:
    """The folder itself if it is a database, else the databases in it, by name; an error if there is none."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    here = lambda p: fs.exists(jvm.org.apache.hadoop.fs.Path(p, "manifest"))
    if here(at):
        return [path]
    inside = sorted(s.getPath().toString() for s in (fs.listStatus(at) if fs.exists(at) else []) if s.isDirectory() and here(s.getPath()))
    if not inside:
        raise ValueError(f"no database in {path}")
    return inside


def read_list(spark: SparkSession, path: str) -> list[str]:
    """The paths that a list file names, one a line, blank lines left out; a list of inputs is small."""
    return [r.value.strip() for r in spark.read.text(path).collect() if r.value.strip()]


def check_same_settings(databases: list[dict]) -> None:
    """Databases that are searched together must agree in what makes their k-mers."""
    keys = ("k", "canonical", "hashed", "scaled", "scale", "minimizer_w", "syncmer_s", "hash")
    first = databases[0]["manifest"]
    for other in databases[1:]:
        different = [k for k in keys if other["manifest"][k] != first[k]]
        if different:
            raise ValueError(f"databases differ in {', '.join(different)}")


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """A set summary; malformed rows are left out."""
    return spark.read.schema(S.SET_SUMMARY).option("sep", "\t").option("comment", "#").option("mode", "DROPMALFORMED").csv(path)


def write_summary(described: DataFrame, path: str) -> None:
    head = [F.col(f.name) for f in S.SET_SUMMARY.fields]
    described.select(*head).write.mode("overwrite").option("sep", "\t").csv(path)
