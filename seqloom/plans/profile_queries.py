"""Queries of match filters, taxonomy, profiling and regions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import rates
from seqloom.operators import matches as M
from seqloom.operators import profile as P
from seqloom.operators import regions as R
from seqloom.operators import taxonomy as T
from seqloom.plans import inputs as I
from seqloom.plans.modes import mode
from seqloom.plans.search_queries import rounded
from seqloom.session import settle

QUERIES: dict = {}
ORACLE_SQL: dict = {}
ROW = ["query", "target", "chunk_idx", "line", "q_len", "q_cov"]
ROW_SQL = ", ".join(ROW)


def query(name: str, sql: str | None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


@query("cov_to_similarity", f"WITH {I.MATCHES_SQL} SELECT query, line, round(87.456::DOUBLE + 26.410 * q_cov - 22.008 * q_cov * q_cov + 7.325 * q_cov * q_cov * q_cov, 6) AS similarity FROM matches")
def cov_to_similarity(spark, d):
    return rounded(I.matches(spark, d).select("query", "line", rates.cov_to_similarity(F.col("q_cov")).alias("similarity")), "similarity")


@query("chernoff_bound", f"WITH {I.MATCHES_SQL} SELECT query, line, round(exp(-q_len * pow(q_cov - 0.3::DOUBLE, 2) / (2 * (1 - 0.3::DOUBLE))), 6) AS bound FROM matches")
def chernoff_bound(spark, d):
    return rounded(I.matches(spark, d).select("query", "line", rates.chernoff_fpr(F.col("q_len"), F.col("q_cov"), 0.3).alias("bound")), "bound")


@query("query_fpr", f"WITH {I.MATCHES_SQL}, p AS (SELECT DISTINCT q_len AS n, CAST(floor(q_len * q_cov) AS INTEGER) AS k FROM matches), t AS (SELECT n, k, unnest(range(0, k + 1)) AS i FROM p) SELECT n, k, round(greatest(0, 1 - sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.3) + (n - i) * ln(0.7)))), 6) AS fpr FROM t GROUP BY n, k")
def query_fpr(spark, d):
    pairs = I.matches(spark, d).select(F.col("q_len").alias("n"), F.floor(F.col("q_len") * F.col("q_cov")).cast("int").alias("k")).distinct()
    return rounded(pairs.withColumn("fpr", rates.query_fpr(F.col("n"), F.col("k"), 0.3)), "fpr")


@query("match_filter", f"WITH {I.MATCHES_SQL} SELECT {ROW_SQL} FROM matches WHERE q_cov >= 0.55::DOUBLE AND fpr <= 0.05")
def match_filter(spark, d):
    return M.refilter(I.matches(spark, d), 0.55, 0.05).select(*ROW)


ORDER_SQL = "PARTITION BY query ORDER BY q_cov DESC, target, chunk_idx, line"


def prefix_sql(stop: str) -> str:
    return (
        f"WITH {I.MATCHES_SQL}, l AS (SELECT *, lag(q_cov) OVER (w) AS prev FROM matches WINDOW w AS ({ORDER_SQL})), s AS (SELECT *, max(CASE WHEN {stop} THEN 1 ELSE 0 END) OVER ({ORDER_SQL} ROWS UNBOUNDED PRECEDING) AS gone FROM l) SELECT {ROW_SQL} FROM s WHERE gone = 0"
    )


@query("keep_perfect", prefix_sql("prev = 1 AND q_cov < 1").replace("round(0.5::DOUBLE + 4 * l_discount + 1.25::DOUBLE * l_tax, 4) AS q_cov", "CASE WHEN l_discount >= 0.08 THEN 1.0::DOUBLE ELSE round(0.5::DOUBLE + 4 * l_discount + 1.25::DOUBLE * l_tax, 4) END AS q_cov"))
def keep_perfect(spark, d):
    """Coverage counts as full here from a discount of 8 percent on, so that there are perfect matches."""
    m = I.matches(spark, d, F.when(F.col("l_discount") >= 0.08, 1.0))
    return M.prefix(m, perfect=True).select(*ROW)


@query("keep_main", prefix_sql("prev - q_cov > 0.15::DOUBLE"))
def keep_main(spark, d):
    return M.prefix(I.matches(spark, d), main_gap=0.15).select(*ROW)


@query("keep_top_n", f"WITH {I.MATCHES_SQL} SELECT {ROW_SQL} FROM (SELECT *, dense_rank() OVER (PARTITION BY query ORDER BY q_cov DESC) AS l FROM matches) WHERE l <= 2")
def keep_top_n(spark, d):
    return M.prefix(I.matches(spark, d), top_n=2).select(*ROW)


@query(
    "name_map_latest",
    f"WITH {I.MATCHES_SQL}, maps AS (SELECT s_suppkey AS key, s_name AS value, 0 AS file FROM supplier UNION ALL SELECT n_nationkey, n_name, 1 FROM nation), m AS (SELECT key, arg_max(value, file) AS value FROM maps GROUP BY key) "
    "SELECT query, line, target, coalesce(value, CAST(target AS VARCHAR)) AS name FROM matches LEFT JOIN m ON key = target",
)
def name_map_latest(spark, d):
    """Two map files, suppliers and nations; where both have a key the second counts."""
    a = I.table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("key"), F.col("s_name").alias("value"), F.lit(0).alias("file"), F.lit(0).alias("line"))
    b = I.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("value"), F.lit(1).alias("file"), F.lit(0).alias("line"))
    return M.named(I.matches(spark, d), M.latest(a.unionByName(b))).select("query", "line", "target", "name")


TAX = f"{I.MATCHES_SQL}, {I.TAXONOMY_SQL}, {I.TAXIDS_SQL}"


@query("taxonomy_closure", f"WITH {I.TAXONOMY_SQL} SELECT taxid, ancestor, rank, depth FROM closure")
def taxonomy_closure(spark, d):
    return T.closure(I.taxonomy(spark, d))


LCA_SQL = (
    "mem AS (SELECT DISTINCT query, taxid FROM matches JOIN taxids USING (target)), mn AS (SELECT query, count(*) AS n FROM mem GROUP BY query), "
    "anc AS (SELECT query, ancestor, rank, depth, count(*) AS c FROM mem JOIN closure USING (taxid) GROUP BY ALL), lca AS (SELECT query, n, arg_max(ancestor, depth) AS lca, arg_max(rank, depth) AS rank FROM anc JOIN mn USING (query) WHERE c = n GROUP BY query, n)"
)


@query("query_lca", f"WITH {TAX}, {LCA_SQL} SELECT query, lca, rank, n FROM lca")
def query_lca(spark, d):
    ids = T.with_taxids(I.matches(spark, d).select("query", "target").distinct(), I.taxid_map(spark, d))
    return T.lca(ids, T.closure(I.taxonomy(spark, d)))


@query("binning", f"WITH {TAX}, {LCA_SQL} SELECT query, lca AS taxid FROM lca")
def binning(spark, d):
    return T.binning(I.matches(spark, d), I.taxid_map(spark, d), T.closure(I.taxonomy(spark, d)))


@query("filter_specific_strain", f"WITH {I.MATCHES_SQL} SELECT {ROW_SQL} FROM matches WHERE query IN (SELECT query FROM matches GROUP BY query HAVING count(DISTINCT target) = 1)")
def filter_specific_strain(spark, d):
    return T.specific(I.matches(spark, d), I.taxid_map(spark, d), T.closure(I.taxonomy(spark, d)), "strain").select(*ROW)


@query("filter_specific_species", f"WITH {TAX}, {LCA_SQL} SELECT {ROW_SQL} FROM matches WHERE query IN (SELECT query FROM lca WHERE rank IN ('species', 'strain'))")
def filter_specific_species(spark, d):
    return T.specific(I.matches(spark, d), I.taxid_map(spark, d), T.closure(I.taxonomy(spark, d))).select(*ROW)


#: Thresholds under which the small tables leave some targets.
PARAMS = mode(0, main_gap=None, min_reads=1, min_chunks_frac=0.2, min_uniq=1, min_hic=1, hic_cov=0.7, min_hic_prop=0.01, max_depth_sd=10, dominance=0.05, mismatch=0.9)


def _species(spark, d, closed=None):
    at = T.at_or_below(closed if closed is not None else T.closure(I.taxonomy(spark, d)))
    return I.taxid_map(spark, d).join(at, "taxid", "left").select("target", F.col("at").alias("species"))


def _inputs(spark, d, closed=None):
    return I.matches(spark, d), settle(_species(spark, d, closed)), I.ref_sizes(spark, d)


SPECIES_SQL = "species AS (SELECT s_suppkey AS target, CAST(1000 + s_nationkey AS BIGINT) AS species FROM supplier)"


def ann_sql(source: str, name: str) -> str:
    return (
        f"{name}_a AS (SELECT *, count(*) OVER (PARTITION BY query, target) AS n_qt, row_number() OVER (PARTITION BY query, target ORDER BY q_cov DESC, chunk_idx, line) = 1 AS first FROM {source} JOIN species USING (target)), "
        f"{name} AS (SELECT *, sum(CASE WHEN first THEN 1 ELSE 0 END) OVER (PARTITION BY query) AS n_targets, min(species) OVER (PARTITION BY query) = max(species) OVER (PARTITION BY query) AS same FROM {name}_a)"
    )


S1_CHUNK_SQL = "c1 AS (SELECT target, chunk_idx, sum(1.0::DOUBLE / n_qt) AS reads, sum(CASE WHEN first AND (n_targets = 1 OR same) THEN 1.0::DOUBLE ELSE 0 END) AS uniq, sum(CASE WHEN first AND (n_targets = 1 OR same) AND q_cov >= 0.7::DOUBLE THEN 1.0::DOUBLE ELSE 0 END) AS hic FROM ann1 GROUP BY target, chunk_idx)"
S1_SQL = f"{I.MATCHES_SQL}, {SPECIES_SQL}, {ann_sql('matches', 'ann1')}, {S1_CHUNK_SQL}, s1 AS (SELECT target, sum(reads) AS sum_match, sum(uniq) AS uniq, sum(hic) AS hic, count(*) FILTER (reads > 0) / 10 AS chunks_frac FROM c1 GROUP BY target HAVING sum(uniq) >= 1 AND sum(hic) >= 1 AND count(*) FILTER (reads > 0) / 10 >= 0.2::DOUBLE)"


@query("profile_stage1", f"WITH {S1_SQL} SELECT target, round(sum_match, 6) AS sum_match, uniq, hic, round(chunks_frac, 6) AS chunks_frac FROM s1")
def profile_stage1(spark, d):
    m, s, _ = _inputs(spark, d)
    return rounded(P.stage1(P.annotated(m, s, PARAMS), PARAMS), "sum_match", "chunks_frac")


@query("profile_stage1_chunks", f"WITH {I.MATCHES_SQL}, {SPECIES_SQL}, {ann_sql('matches', 'ann1')}, {S1_CHUNK_SQL} SELECT target, chunk_idx, 10 AS chunks, round(reads, 6) AS reads, uniq, hic FROM c1")
def profile_stage1_chunks(spark, d):
    m, s, _ = _inputs(spark, d)
    return rounded(P.stage1_chunks(P.annotated(m, s, PARAMS), PARAMS), "reads")


CO_SQL = f"{S1_SQL}, r2 AS (SELECT m.* FROM matches m SEMI JOIN s1 USING (target)), t2 AS (SELECT DISTINCT query, target FROM r2), co AS (SELECT a.target AS a, b.target AS b, count(*) AS shared FROM t2 a JOIN t2 b ON a.query = b.query AND a.target < b.target GROUP BY 1, 2)"


@query("profile_cooccurrence", f"WITH {CO_SQL} SELECT a, b, shared FROM co")
def profile_cooccurrence(spark, d):
    m, s, _ = _inputs(spark, d)
    return P.cooccurrence(P.annotated(P.restricted(m, P.stage1(P.annotated(m, s, PARAMS), PARAMS)), s, PARAMS))


#: Targets of a query in the order of coverage; each in its turn meets the later ones, and what is gone meets no more.
DOM_SQL = (
    f"{CO_SQL}, pr AS (SELECT a, b, shared, x.sum_match AS ma, x.uniq AS ua, y.sum_match AS mb, y.uniq AS ub FROM co JOIN s1 x ON x.target = a JOIN s1 y ON y.target = b), "
    "dom AS (SELECT b AS loser, a AS winner FROM pr WHERE ma * 0.95::DOUBLE >= shared AND ub < ua * 0.9::DOUBLE UNION ALL SELECT a, b FROM pr WHERE mb * 0.95::DOUBLE >= shared AND ua < ub * 0.9::DOUBLE), "
    "ord AS (SELECT query, target, row_number() OVER (PARTITION BY query ORDER BY max(q_cov) DESC, target) AS i FROM r2 GROUP BY query, target), "
    "ed AS (SELECT query, i, j, bool_or(w) AS w FROM (SELECT x.query, x.i, y.i AS j, true AS w FROM ord x JOIN ord y ON x.query = y.query AND x.i < y.i JOIN dom ON winner = x.target AND loser = y.target "
    "UNION ALL SELECT x.query, x.i, y.i, false FROM ord x JOIN ord y ON x.query = y.query AND x.i < y.i JOIN dom ON winner = y.target AND loser = x.target) GROUP BY ALL), "
    "el AS (SELECT query, i, list(struct_pack(j := j, w := w)) AS es FROM ed GROUP BY query, i), last AS (SELECT coalesce(max(j), 0) AS n FROM ed), "
    "st(query, i, gone) AS (SELECT DISTINCT query, 1::BIGINT, []::BIGINT[] FROM el UNION ALL "
    "SELECT s.query, s.i + 1, CASE WHEN es IS NULL OR list_contains(gone, s.i) THEN gone ELSE list_concat(gone, list_transform(list_filter(es, lambda e: NOT list_contains(gone, e.j)), lambda e: CASE WHEN e.w THEN e.j ELSE s.i END)) END "
    "FROM st s LEFT JOIN el ON el.query = s.query AND el.i = s.i WHERE s.i < (SELECT n FROM last)), "
    "gone AS (SELECT o.query, o.target FROM ord o JOIN (SELECT query, arg_max(gone, i) AS g FROM st GROUP BY query) f ON f.query = o.query WHERE list_contains(g, o.i)), r3 AS (SELECT * FROM r2 ANTI JOIN gone USING (query, target))"
)


@query("profile_ambiguity_correction", f"WITH RECURSIVE {DOM_SQL} SELECT {ROW_SQL} FROM r3")
def profile_ambiguity_correction(spark, d):
    m, s, z = _inputs(spark, d)
    return P.before_em(m, s, z, PARAMS)[0].select(*ROW)


def targets_sql(source: str, share: str | None, chunk: str, out: str, norm: str = "mean") -> str:
    part = f"CASE WHEN n_targets > 1 THEN {share or '1.0::DOUBLE'} / n_qt ELSE 1.0::DOUBLE / n_qt END"
    base = f"q_len * CASE WHEN n_targets > 1 THEN {share or '1.0::DOUBLE / n_targets'} / n_qt ELSE 1.0::DOUBLE / n_qt END"
    single = f"CASE WHEN first AND n_targets = 1 THEN 1.0::DOUBLE WHEN first AND same THEN {share or '1.0::DOUBLE'} / n_qt ELSE 0 END"
    cover = {"mean": "sum(bases) / max(size)", "min": "min(CASE WHEN bases > 0 THEN bases END) * 10 / max(size)", "max": "max(bases) * 10 / max(size)"}[norm]
    return (
        f"{chunk} AS (SELECT target, chunk_idx, sum({part}) AS reads, sum({base}) AS bases, sum({single}) AS uniq, sum(CASE WHEN q_cov >= 0.7::DOUBLE THEN {single} ELSE 0 END) AS hic FROM {source} GROUP BY target, chunk_idx), "
        f"{chunk}_grid AS (SELECT target, chunk_idx, coalesce(reads, 0) AS reads, coalesce(bases, 0) AS bases, coalesce(uniq, 0) AS uniq, coalesce(hic, 0) AS hic FROM (SELECT DISTINCT target FROM {chunk}) CROSS JOIN (SELECT unnest(range(0, 10)) AS chunk_idx) LEFT JOIN {chunk} USING (target, chunk_idx)), "
        f"{chunk}_rel AS (SELECT *, bases / sum(bases) OVER (PARTITION BY target) * 10 AS rel FROM {chunk}_grid), "
        f"{out} AS (SELECT target, sum(reads) AS reads, sum(uniq) AS uniq, sum(hic) AS hic, sum(bases) AS bases, count(*) FILTER (reads >= 1) / 10 AS chunks_frac, stddev_pop(rel) AS depth_sd, {cover} AS coverage FROM {chunk}_rel JOIN sizes USING (target) GROUP BY target)"
    )


EXISTS_SQL = "uniq >= 1 AND hic >= 1 AND hic >= 0.01::DOUBLE * uniq AND chunks_frac >= 0.2::DOUBLE AND depth_sd <= 10"
TARGET = ["target", "reads", "uniq", "hic", "bases", "chunks_frac", "depth_sd", "coverage"]
TARGET_SQL = "target, " + ", ".join(f"round({c}, 6) AS {c}" for c in TARGET[1:])


def s3_sql(norm: str = "mean") -> str:
    return f"{DOM_SQL}, {I.SIZES_SQL}, {ann_sql('r3', 'ann3')}, {targets_sql('ann3', None, 'c3', 't3', norm)}, s3 AS (SELECT * FROM t3 WHERE {EXISTS_SQL})"


def _stage3(norm):
    def run(spark, d):
        m, s, z = _inputs(spark, d)
        return rounded(P.before_em(m, s, z, PARAMS.but(norm=norm))[2].select(*TARGET), *TARGET[1:])

    return run


for _name, _norm in (("profile_stage3", "mean"), ("profile_norm_min", "min"), ("profile_norm_max", "max")):
    QUERIES[_name], ORACLE_SQL[_name] = _stage3(_norm), f"WITH RECURSIVE {s3_sql(_norm)} SELECT {TARGET_SQL} FROM s3"


def em_sql(iters: int) -> str:
    """CTEs up to em{iters}: the targets after so many passes beyond the first."""
    out, cover = s3_sql(), "s3"
    for i in range(iters + 1):
        keep = "s3" if i == 0 else "em0"
        rows = f"r4_{i} AS (SELECT m.* FROM matches m SEMI JOIN {keep} USING (target)), {ann_sql(f'r4_{i}', f'ann4_{i}')}"
        share = f"sh{i} AS (SELECT a.*, coverage / sum(CASE WHEN first THEN coverage ELSE 0 END) OVER (PARTITION BY query) AS share FROM ann4_{i} a JOIN {cover} USING (target))"
        score = f"sc{i} AS (SELECT target, quantile_cont(q_cov, 0.9) * 100 AS score FROM sh{i} WHERE first AND (n_targets = 1 OR same) GROUP BY target)"
        test = f"WHERE {EXISTS_SQL}" if i == 0 else ""
        out += f", {rows}, {share}, {score}, {targets_sql(f'sh{i}', 'share', f'c4_{i}', f't4_{i}')}, k{i} AS (SELECT * FROM t4_{i} {test}), em{i} AS (SELECT k.*, coalesce(score, 0) AS score, coverage / sum(coverage) OVER () * 100 AS percentage FROM k{i} k LEFT JOIN sc{i} USING (target))"
        cover = f"em{i}"
    return out


EM_SQL = f"{TARGET_SQL}, round(score, 6) AS score, round(percentage, 6) AS percentage"


def _em(spark, d, iters, closed=None):
    m, s, z = _inputs(spark, d, closed)
    return P.profile(m, s, z, PARAMS, iters)


def _em_query(iters):
    return lambda spark, d: rounded(_em(spark, d, iters).select(*TARGET, "score", "percentage"), *TARGET[1:], "score", "percentage")


for _name, _n in (("profile_em_step1", 0), ("profile_em_step3", 2)):
    QUERIES[_name], ORACLE_SQL[_name] = _em_query(_n), f"WITH RECURSIVE {em_sql(_n)} SELECT {EM_SQL} FROM em{_n}"


#: Thresholds that fail some of the targets of stage 3.
STRICT = mode(3)
TESTS = {"uniq": ("uniq < 20", "uniq"), "hic": ("hic < 5", "hic"), "hic_prop": ("hic < 0.1::DOUBLE * uniq", "hic"), "chunks_frac": ("chunks_frac < 0.8::DOUBLE", "chunks_frac"), "depth_sd": ("depth_sd > 2", "depth_sd")}


@query("profile_failures", f"WITH RECURSIVE {s3_sql()} " + " UNION ALL ".join(f"SELECT target, 'stage 3' AS stage, '{r}' AS reason, round(CAST({v} AS DOUBLE), 6) AS value FROM t3 WHERE {c}" for r, (c, v) in TESTS.items()))
def profile_failures(spark, d):
    """What each target of stage 3 would fail in mode 3."""
    m, s, z = _inputs(spark, d)
    return rounded(P.failures(P.before_em(m, s, z, PARAMS)[1], STRICT, "stage 3"), "value")


@query(
    "profile_stats",
    f"WITH RECURSIVE {em_sql(0)}, n AS (SELECT count(DISTINCT query) AS matched_reads, (SELECT count(DISTINCT query) FROM matches SEMI JOIN em0 USING (target)) AS assigned_reads FROM matches) SELECT *, round(assigned_reads / matched_reads * 100, 6) AS assigned_pct FROM n",
)
def profile_stats(spark, d):
    m, s, z = _inputs(spark, d)
    return rounded(P.profiled(m, s, z, PARAMS, 0).stats, "assigned_pct")


@query("profile_converged", None)
def profile_converged(spark, d):
    m, s, z = _inputs(spark, d)
    return rounded(P.profile(m, s, z, PARAMS).select(*TARGET, "score", "percentage"), *TARGET[1:], "score", "percentage")


@query(
    "profile_low_abundance_cut",
    f"WITH RECURSIVE {em_sql(0)}, tail AS (SELECT target, coverage, sum(percentage) OVER (ORDER BY coverage, chunks_frac, target DESC ROWS UNBOUNDED PRECEDING) AS t FROM em0) SELECT target, round(coverage / sum(coverage) OVER () * 100, 6) AS percentage FROM tail WHERE t > 10",
)
def profile_low_abundance_cut(spark, d):
    return rounded(P.tail_cut(_em(spark, d, 0), 10).select("target", "percentage"), "percentage")


@query(
    "profile_mode0_order",
    f"WITH RECURSIVE {em_sql(0)} SELECT target, CAST(row_number() OVER (ORDER BY round(score * chunks_frac, 6) DESC, round(score, 6) DESC, chunks_frac DESC, round(reads, 6) DESC, target) AS INTEGER) AS place FROM em0",
)
def profile_mode0_order(spark, d):
    from pyspark.sql import Window

    t = _em(spark, d, 0)
    t = t.withColumns({"score": F.round("score", 6), "reads": F.round("reads", 6)})
    key = [F.round(F.col("score") * F.col("chunks_frac"), 6).desc(), *P.pathogen_order(t)[1:]]
    return t.select("target", F.row_number().over(Window.orderBy(*key)).cast("int").alias("place"))


ROLL_SQL = f"{em_sql(0)}, {I.TAXONOMY_SQL}, {I.TAXIDS_SQL}, roll AS (SELECT c.ancestor AS taxid, c.rank, c.depth, sum(percentage) AS percentage FROM em0 JOIN taxids USING (target) JOIN closure c USING (taxid) GROUP BY 1, 2, 3)"
PATH_SQL = "path AS (SELECT taxid, string_agg({0}, '|' ORDER BY depth) AS p, string_agg({1}, '|' ORDER BY depth) AS n FROM (SELECT c.taxid, c.depth, c.rank, t.taxid AS id, t.name FROM closure c JOIN taxonomy t ON t.taxid = c.ancestor WHERE c.rank IN ('phylum', 'species', 'strain')) GROUP BY taxid)"


@query(
    "taxon_rollup_cami",
    f"WITH RECURSIVE {ROLL_SQL}, {PATH_SQL.format('CAST(id AS VARCHAR)', 'name')} SELECT taxid, rank, p AS taxpath, n AS taxpathsn, round(percentage, 6) AS percentage FROM roll JOIN path USING (taxid) WHERE rank IN ('phylum', 'species', 'strain')",
)
def taxon_rollup_cami(spark, d):
    from seqloom.sources import reports

    closed = settle(T.closure(I.taxonomy(spark, d)))
    amounts = _em(spark, d, 0, closed).join(I.taxid_map(spark, d), "target").select("taxid", "percentage")
    return rounded(reports.cami(amounts, closed, I.taxonomy(spark, d)).select("taxid", "rank", "taxpath", "taxpathsn", "percentage"), "percentage")


PREFIX_SQL = "CASE rank WHEN 'phylum' THEN 'p__' WHEN 'species' THEN 's__' ELSE 't__' END || name"


@query(
    "taxon_rollup_metaphlan",
    f"WITH RECURSIVE {ROLL_SQL}, {PATH_SQL.format('CAST(id AS VARCHAR)', PREFIX_SQL)} SELECT n AS clade_name, p AS ncbi_tax_id, round(percentage, 6) AS relative_abundance, '' AS additional_species FROM roll JOIN path USING (taxid) WHERE rank IN ('phylum', 'species', 'strain')",
)
def taxon_rollup_metaphlan(spark, d):
    from seqloom.sources import reports

    closed = settle(T.closure(I.taxonomy(spark, d)))
    amounts = _em(spark, d, 0, closed).join(I.taxid_map(spark, d), "target").select("taxid", "percentage")
    return rounded(reports.metaphlan(amounts, closed, I.taxonomy(spark, d)).select("clade_name", "ncbi_tax_id", "relative_abundance", "additional_species"), "relative_abundance")


ITEM_SQL = "items AS (SELECT ref, begin_, end_, avg(q) AS score, CASE WHEN count(*) = 1 THEN 'assembly-specific' ELSE 'species-specific' END AS type FROM (SELECT ref, begin_, end_, target, max(q_cov) AS q FROM region_rows WHERE q_cov >= 0.55::DOUBLE GROUP BY ALL) GROUP BY ref, begin_, end_)"


def region_sql(ignore: bool) -> str:
    same = "true" if ignore else "type = lag(type) OVER w"
    fold = (
        "CASE WHEN list_position(types, 'species-specific') IS NULL THEN scores[1] ELSE list_reduce(list_concat([scores[1]], scores[greatest(2, list_position(types, 'species-specific')):]), lambda a, b: (a + b) / 2) END"
    )
    return (
        f"WITH {I.REGIONS_SQL}, {ITEM_SQL}, l AS (SELECT *, CASE WHEN begin_ <= lag(end_) OVER w AND {same} THEN 0 ELSE 1 END AS new FROM items WINDOW w AS (PARTITION BY ref ORDER BY begin_, end_)), "
        "i AS (SELECT *, sum(new) OVER (PARTITION BY ref ORDER BY begin_, end_ ROWS UNBOUNDED PRECEDING) AS island FROM l), "
        "g AS (SELECT ref, island, CAST(min(begin_) - 1 AS INTEGER) AS begin_, arg_max(end_, begin_) AS end_, list(type ORDER BY begin_) AS types, list(score ORDER BY begin_) AS scores FROM i GROUP BY ref, island) "
        f"SELECT ref, begin_, end_, CASE WHEN list_position(types, 'species-specific') IS NULL THEN 'assembly-specific' ELSE 'species-specific' END AS type, round({fold} + 1e-9::DOUBLE, 6) AS score FROM g"
    )


def _regions(ignore):
    def run(spark, d):
        r = R.merge(R.windows(I.regions(spark, d)), ignore_type=ignore)
        # A nudge, the same in the SQL, keeps halves from falling to either side.
        return r.select("ref", F.col("begin").alias("begin_"), F.col("end").alias("end_"), "type", F.round(F.col("score") + 1e-9, 6).alias("score"))

    return run


QUERIES["merge_regions"], ORACLE_SQL["merge_regions"] = _regions(False), region_sql(False)
QUERIES["merge_regions_ignore_type"], ORACLE_SQL["merge_regions_ignore_type"] = _regions(True), region_sql(True)
