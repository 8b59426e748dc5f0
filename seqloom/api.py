"""The engine's commands as functions: compute, index, search, merge, profile and the utilities.

Keyword arguments have the meaning and defaults of the commands' flags.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.rates import byte_size
from seqloom.operators import bloom, regions, sketch, split, taxonomy
from seqloom.operators import matches as M
from seqloom.operators import profile as P
from seqloom.operators import search as S
from seqloom.plans.modes import mode as preset
from seqloom.session import settle
from seqloom.sources import fastx, reports, tables

#: Fixed value: the default pattern of reference names.
REF_NAME = r"(?i)([^/]+)\.(f[aq](st[aq])?|fna)(.gz)?$"


def session(threads: int | str = "*", log_level: str = "WARN", **options: str) -> SparkSession:
    """A session as the commands' root flags would have it: threads, how much is logged, any Spark option (dots as double underscores)."""
    build = SparkSession.builder.master(f"local[{threads}]")
    for name, value in options.items():
        build = build.config(name.replace("__", "."), value)
    spark = build.getOrCreate()
    spark.sparkContext.setLogLevel(log_level)
    return spark


def version() -> str:
    from seqloom import __version__

    return __version__


def compute(
    spark: SparkSession,
    inputs: str | list[str] | DataFrame,
    k: int | tuple[int, ...] = 21,
    scale: int = 1,
    minimizer_w: int = 0,
    syncmer_s: int = 0,
    split_number: int = 0,
    split_size: int = 0,
    split_overlap: int | None = None,
    split_min_ref: int = 1000,
    by_seq: bool = False,
    circular: bool = False,
    file_regexp: str = fastx.FILES,
    ref_name_regexp: str = REF_NAME,
    seq_name_filter: tuple[str, ...] = (),
    kind: str = "md5",
    canonical: bool = True,
    infile_list: str | None = None,
    texts: bool = False,
) -> DataFrame:
    """(target, chunk_idx, chunks, genome_size, n_kmers, kmers or seq): k-mer sets of files or of records (file, pos, seq_id, name, seq).

    Sequences are DNA: of a k-mer and its reverse complement the lesser counts, windows with
    other letters are skipped. With canonical=False they are texts of any letters. Circular
    sequences have k-mers across their ends if they stay whole; chunks are linear, and
    go round the end in genomes of one contig. infile_list is a file of more paths, one a line.
    texts: with the sequence instead of its k-mers, which a database then makes anew from it
    where they are used; a k-mer takes eight bytes, a letter one at most.
    settings_of() gives what index() is to know."""
    if texts and circular:
        raise ValueError("texts don't say that they are circular")
    made = settings_of(k, scale, minimizer_w, syncmer_s, kind, canonical)
    ks = made.ks
    if infile_list is not None:
        inputs = [*([inputs] if isinstance(inputs, str) and inputs else inputs or []), *tables.read_list(spark, infile_list)]
    if isinstance(inputs, list) and len(set(inputs)) < len(inputs):
        raise ValueError("an input is given twice")
    records = inputs if isinstance(inputs, DataFrame) else fastx.read_fastx(spark, inputs, file_regexp)
    records = split.blacklist(records, "name", list(seq_name_filter))
    if by_seq:
        refs = records.select(F.col("seq_id").alias("target"), "seq", F.lit(1).cast("long").alias("contigs"), F.length("seq").cast("long").alias("genome_size"))
    else:
        named = records.withColumn("target", split.reference_name(F.col("file"), ref_name_regexp))
        whole = sketch.concatenated(named, "target", "pos", max(ks))
        refs = whole.withColumn("genome_size", (F.length("seq") - (F.col("contigs") - 1) * (max(ks) - 1)).cast("long"))
    parts = split_number > 1 or split_size > 0
    cut = lambda rows, round_: sketch.chunks(rows, max(ks), split_number, split_size, split_overlap, split_min_ref, round_, id_col="target", keep=("genome_size",))
    if circular and split_number > 1:
        chunked = cut(refs.filter("contigs = 1"), True).unionByName(cut(refs.filter("contigs > 1"), False))
    else:
        chunked = cut(refs, False)
    keys = ("target", "chunk_idx", "chunks", "genome_size")
    sets = sketch.sets_of(chunked, made, (*keys, "seq") if texts else keys, circular=circular and not parts)
    return sets.select(*keys, "n_kmers", "seq" if texts else "kmers")


def settings_of(k: int | tuple[int, ...] = 21, scale: int = 1, minimizer_w: int = 0, syncmer_s: int = 0, kind: str = "md5", canonical: bool = True) -> sketch.Settings:
    """What compute() makes sets with; its manifest() goes to index()."""
    return sketch.Settings((k,) if isinstance(k, int) else tuple(k), kind, canonical, scale, minimizer_w, syncmer_s)


def index(
    sets: DataFrame,
    out_dir: str,
    fpr: float = 0.3,
    num_hash: int = 1,
    block_size: int = 0,
    block_size_x_kmers_t: str = "10M",
    block_size_x: int = 256,
    block_size_8_kmers_t: str = "20M",
    block_size_1_kmers_t: str = "200M",
    threads: int = 8,
    dry_run: bool = False,
    **settings,
) -> DataFrame:
    """Writes a database folder and returns what index_info says of it; dry_run only estimates.

    settings: what the sets were made with (settings_of(...).manifest(), and others), kept in the manifest."""
    if not dry_run:  # the sets are made once, where the database keeps them
        sets = tables.write_sets(out_dir, sets)
    names = sets.count()
    size = block_size or bloom.base_block_size(names, threads)
    regimes = ((byte_size(block_size_x_kmers_t), block_size_x), (byte_size(block_size_8_kmers_t), 8), (byte_size(block_size_1_kmers_t), 1))
    packed = settle(bloom.pack(sets, size, regimes, fpr, num_hash))
    if dry_run:
        return bloom.index_info(packed, num_hash)
    total = sets.agg(F.sum("n_kmers")).first()[0] or 0
    manifest = settings_of().manifest() | {"num_hash": num_hash, "fpr": fpr, "block_size": size, "kmers": total, "names": names} | settings
    matrix = bloom.dense(bloom.filled(sets, packed), packed, num_hash, sketch.Settings.of(dict.fromkeys(sketch.Settings().manifest()) | manifest))
    tables.write_database(out_dir, sets, matrix, packed, manifest, with_sets=False)
    return bloom.index_info(sets.sparkSession.read.parquet(f"{out_dir}/slots"), num_hash)


def search(
    spark: SparkSession,
    queries: DataFrame,
    db_dirs: str | list[str],
    min_kmers: int = 10,
    min_query_len: int = 30,
    min_query_cov: float = 0.55,
    min_target_cov: float = 0.0,
    max_fpr: float = 0.01,
    kmer_dedup_threshold: int = 256,
    keep_unmatched: bool = False,
    keep_top_scores: int = 0,
    sort_by: str = "qcov",
    do_not_sort: bool = False,
    name_map: DataFrame | None = None,
    try_se: bool = False,
    exact: bool = False,
    whole_file: bool = False,
    query_id: str | None = None,
    use_filename: bool = False,
) -> DataFrame:
    """Matches of queries (query, seq[, seq2]) in one database, or in all of several; exact counts k-mers without the index.

    A folder may be a database or hold databases. Queries are numbered by their column
    query_idx, else by file and pos, else by query; equal names stay apart. Their k-mers are
    made as the database's manifest says. whole_file: records (file, pos, seq_id, seq) are
    one query a file, named after its first record, query_id or the file."""
    dirs = [d for given in ([db_dirs] if isinstance(db_dirs, str) else db_dirs) for d in tables.discover(spark, given)]
    dbs = [tables.read_database(spark, d) for d in dirs]
    tables.check_same_settings(dbs)
    made = sketch.Settings.of(dbs[0]["manifest"])
    if whole_file:
        queries = whole_files(queries, max(made.ks), query_id, use_filename)
    elif "query" not in queries.columns:
        queries = queries.withColumn("query", F.col("seq_id"))
    if "query_idx" not in queries.columns:
        queries = sketch.numbered(queries, [c for c in ("file", "pos") if c in queries.columns] or ["query"])
    columns = [("seq", "seq2"), ("seq", None), ("seq2", None)] if "seq2" in queries.columns else [("seq", None)]
    queries = settle(queries.select("query_idx", "query", *[c for c in ("seq", "seq2") if c in queries.columns]))
    names = queries.select("query_idx", F.col("query").alias("_name"))
    numbers = queries.withColumn("query", F.col("query_idx"))
    made_of = lambda k, seq, seq2: sketch.query_sets(numbers, made, k, kmer_dedup_threshold, seq_col=seq, seq2_col=seq2, min_len=min_query_len)
    found = []
    for db in dbs:
        m = db["manifest"]
        # An index knows false hits at its nominal rate; exact counts have none.
        rate = None if exact else m["fpr"]
        info = db["names"].select("target", "chunk_idx", "chunks", F.col("genome_size").alias("t_len"))
        tries = []
        for k in sorted(made.ks, reverse=True):
            for seq, seq2 in columns[: None if try_se else 1]:
                q = made_of(k, seq, seq2)
                hit = S.matches(q, db["sets"]) if exact else bloom.search(q, db["bits"], db["slots"], m["num_hash"] or 1, min_kmers=min_kmers, min_q_cov=min_query_cov)
                tries.append(S.filtered(hit, min_kmers, min_query_cov, min_target_cov, rate, max_fpr).withColumn("k_size", F.lit(k)))
        one = S.fall_back(tries).drop("attempt") if len(tries) > 1 else tries[0]
        found.append(one.join(info, ["target", "chunk_idx"]))
    out = S.intersect_databases(found) if len(found) > 1 else found[0]
    out = S.with_hits(out)
    if not do_not_sort:
        out = S.ranked(S.top_scores(out, keep_top_scores, sort_by), sort_by)
    if name_map is not None:
        out = M.named(out, name_map).withColumn("target", F.col("name")).drop("name")
    if keep_unmatched:
        seq, seq2 = columns[0]
        out = S.keep_unmatched(made_of(max(made.ks), seq, seq2), out)
    return out.withColumnRenamed("query", "query_idx").join(names, "query_idx").withColumnRenamed("_name", "query").select("query", *[c for c in out.columns if c != "query"], "query_idx")


def whole_files(records: DataFrame, k: int, query_id: str | None = None, use_filename: bool = False) -> DataFrame:
    """(file, query, seq): the records of each file as one query, with gaps of k - 1 letters N."""
    first = records.groupBy("file").agg(F.min(F.struct("pos", "seq_id")).alias("_f"))
    base = F.regexp_replace(F.regexp_extract("file", r"([^/]+)$", 1), r"(?i)(\.(f[aq](st[aq])?|fna))?(\.gz)?$", "")
    name = base if use_filename else F.lit(query_id) if query_id is not None else F.col("_f.seq_id")
    return sketch.concatenated(records, "file", "pos", k).join(first, "file").select("file", name.alias("query"), "seq")


def merge(results: list[DataFrame], sort_by: str = "qcov") -> DataFrame:
    """Results of the same queries from several databases as one; the same result twice is an error."""
    if len({id(r) for r in results}) < len(results):
        raise ValueError("a result is given twice")
    return S.merge_databases(results, sort_by, check=True)


def profile(
    found: DataFrame,
    sizes: DataFrame,
    taxid_map: DataFrame | None = None,
    taxdump: dict[str, DataFrame] | None = None,
    mode: int = 3,
    min_query_cov: float = 0.55,
    max_fpr: float = 0.01,
    filter_low_pct: float = 0.0,
    **thresholds,
) -> dict[str, DataFrame]:
    """profile, failures and stats, and with a taxonomy also cami, metaphlan and binning tables; thresholds override the mode's.

    failures: (target, stage, reason, value) of targets that didn't exist; stats: matched and assigned reads."""
    p = preset(mode, **thresholds)
    rows = M.refilter(found, min_query_cov, max_fpr)
    species = closed = None
    if taxdump is not None and taxid_map is not None:
        taxid_map = taxonomy.current(taxid_map, taxdump.get("merged"), taxdump.get("deleted"))
        closed = taxonomy.closure(taxdump["nodes"])
        taxonomy.with_taxids(rows.select("target").distinct(), taxid_map).agg(F.count("taxid")).collect()
        at = taxonomy.at_or_below(closed, "species")
        species = taxid_map.join(at, "taxid", "left").select("target", F.col("at").alias("species"))
    done = P.profiled(rows, species, sizes, p)
    result = settle(done.profile)
    if filter_low_pct > 0:
        result = P.tail_cut(result, filter_low_pct, [c for c in _ascending(mode)])
    out = {"profile": result, "failures": done.failures, "stats": done.stats}
    if closed is not None:
        amounts = result.join(taxid_map, "target").select("taxid", "percentage")
        out |= {"cami": reports.cami(amounts, closed, taxdump["names"]), "metaphlan": reports.metaphlan(amounts, closed, taxdump["names"])}
        out["binning"] = taxonomy.binning(M.prefix(P.restricted(rows, result), p.perfect, p.main_gap, p.top_n), taxid_map, closed)
    return out


def _ascending(mode: int) -> list:
    if mode == 0:
        return [(F.col("score") * F.col("chunks_frac")).asc(), F.col("score").asc(), F.col("chunks_frac").asc(), F.col("reads").asc(), F.col("target").desc()]
    return [F.col("coverage").asc(), F.col("chunks_frac").asc(), F.col("target").desc()]


def filter_specific(found: DataFrame, taxid_map: DataFrame, nodes: DataFrame, level: str = "species", min_query_cov: float = 0.55, max_fpr: float = 0.05) -> DataFrame:
    """Matches of queries that only one species, or at level "strain" one target, has."""
    return taxonomy.specific(M.refilter(found, min_query_cov, max_fpr), taxid_map, taxonomy.closure(nodes), level)


def merge_regions(found: DataFrame, regexp: str = regions.NAME, max_gap: int = 0, min_overlap: int = 1, ignore_type: bool = False, min_query_cov: float = 0.55, max_fpr: float = 0.05) -> DataFrame:
    """BED rows of the regions that sliding-window hits make up."""
    return regions.bed(regions.merge(regions.windows(found, regexp, min_query_cov, max_fpr), max_gap, min_overlap, ignore_type))


def split_genomes(spark: SparkSession, inputs: str | list[str] | DataFrame, k: int = 21, split_number: int = 0, split_overlap: int | None = None, split_min_ref: int = 1000, circular: bool = False, seq_name_filter: tuple[str, ...] = (), frag_size: int = 100) -> tuple[DataFrame, DataFrame]:
    """(chunks of the best genome, fragments of the others with the chunk each belongs to)."""
    records = inputs if isinstance(inputs, DataFrame) else fastx.read_fastx(spark, inputs)
    records = split.blacklist(records, "name", list(seq_name_filter))
    genomes = sketch.concatenated(records, "file", "pos", k).withColumn("size", F.length("seq")).withColumn("ref_id", F.lit(0))
    best = split.choose_reference(genomes, "file")
    chunked = sketch.chunks(genomes.join(best, "file", "left_semi"), k, split_number, 0, split_overlap, split_min_ref, circular)
    others = genomes.join(best, "file", "left_anti")
    frags = split.fragments(others, k, frag_size, keep=("ref_id", "file"))
    return chunked, split.assign_fragments(chunked, frags, k, keep=("file",), all_if_none=True)


def density_image(density: DataFrame, path: str, target: str | int, bins: int) -> None:
    """A one-row grey image (PGM) of a filter's bins; at most as many values as bins reach the driver."""
    got = {r["bin"]: r["gray"] for r in density.filter(F.col("target") == target).select("bin", "gray").limit(bins).collect()}
    with open(path, "wb") as f:
        f.write(f"P5 {bins} 1 255\n".encode() + bytes(max(0, got.get(i, 255)) for i in range(bins)))
