"""Scoring with columns in any order (an option of G7).

A generated result matches its gold result under a column mapping if some of its
columns, in some order, hold the gold rows as a multiset. Mappings are not tried one by
one: a gold column can only be a column with the same multiset of cells, so per-column
fingerprints (one aggregate per run) leave few candidates. Where a gold column has
several, partial mappings are compared by the fingerprint of the rows so far, one job
for all pairs and one more column at a time; columns that are equal row by row stand for
each other and are taken in order. What is left is confirmed on the rows themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlgauge.operators import score
from sqlgauge.operators.execute import hash_sum
from sqlgauge.session import written

PAIR = ["gold_run_id", "gen_run_id"]


def _cells() -> Column:
    return F.from_json("row", "array<string>")


def column_fingerprints(results: DataFrame) -> DataFrame:
    """run_id, width, n_rows, prints: per column the sums of two hashes of its cells.

    One pass: rows are parsed once and fall into one group per run and column.
    """
    cells = results.select("run_id", F.posexplode(_cells()).alias("i", "cell"))
    per = cells.select("run_id", "i", F.xxhash64("cell").alias("x"), F.hash("cell", F.lit(7)).alias("y")) \
        .groupBy("run_id", "i").agg(F.count(F.lit(1)).alias("n"), hash_sum(F.col("x")).alias("x"),
                                    F.sum(F.col("y").cast("bigint")).alias("y"))
    ordered = F.array_sort(F.collect_list(F.struct("i", F.struct("x", "y").alias("p"))))
    return per.groupBy("run_id").agg(F.count(F.lit(1)).cast("int").alias("width"), F.max("n").alias("n_rows"),
                                     ordered.alias("o")).select("run_id", "width", "n_rows", F.col("o.p").alias("prints"))


def candidates(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """Pairs with ``options``: for each gold column, the generated columns (from 0) that it may be.

    Pairs with a gold column that has none are left out.
    """
    g = prints.select(F.col("run_id").alias("gold_run_id"), F.col("prints").alias("g"), F.col("n_rows").alias("gn"))
    n = prints.select(F.col("run_id").alias("gen_run_id"), F.col("prints").alias("p"), F.col("n_rows").alias("nn"))
    both = pairs.select(*PAIR).distinct().join(g, "gold_run_id").join(n, "gen_run_id").where(
        (F.col("gn") == F.col("nn")) & (F.size("g") <= F.size("p")) & (F.size("g") > 0))
    places = F.sequence(F.lit(0), F.size("p") - 1)
    options = F.transform("g", lambda a: F.filter(places, lambda j: F.get(F.col("p"), j) == a))
    return both.withColumn("options", options).where(F.forall("options", lambda o: F.size(o) > 0)).select(
        *PAIR, "options")


def equal_columns(found: DataFrame, results: DataFrame, prints: DataFrame) -> DataFrame:
    """gen_run_id, twins: for each column, the earlier columns that are equal to it row by row."""
    doubtful = found.where(F.exists("options", lambda o: F.size(o) > 1)).select("gen_run_id").distinct()
    p = prints.select(F.col("run_id").alias("gen_run_id"), "prints", "width").join(doubtful, "gen_run_id")
    twin = p.select("gen_run_id", "prints", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("j")).select(
        "gen_run_id", "prints", "j", F.explode(F.sequence(F.lit(0), F.col("j"))).alias("k")).where(
        "k < j AND prints[k] = prints[j]").select("gen_run_id", "j", "k")
    rows = results.select(F.col("run_id").alias("gen_run_id"), _cells().alias("c"))
    same = (rows.join(twin, "gen_run_id").groupBy("gen_run_id", "j", "k")
            .agg(F.bool_and(F.get("c", F.col("k")).eqNullSafe(F.get("c", F.col("j")))).alias("same")).where("same"))
    return (same.groupBy("gen_run_id", "j").agg(F.collect_list("k").alias("ks")).groupBy("gen_run_id")
            .agg(F.map_from_entries(F.collect_list(F.struct("j", "ks"))).alias("twins")))


def _prefix_prints(rows: DataFrame, wanted: DataFrame, run: str, taken: Column, name: str) -> DataFrame:
    """``wanted`` (run, key columns) with the fingerprint of the rows' taken cells."""
    keys = wanted.columns
    cells = results_cells(rows, run)
    return (cells.join(wanted, run).withColumn("h", F.xxhash64(taken)).groupBy(*keys)
            .agg(hash_sum(F.col("h")).alias(name)))


def results_cells(results: DataFrame, run: str) -> DataFrame:
    return results.select(F.col("run_id").alias(run), _cells().alias("c"))


def mappings(pairs: DataFrame, results: DataFrame) -> DataFrame:
    """gold_run_id, gen_run_id, mapping: the column mappings that the fingerprints leave.

    ``mapping`` names, for each gold column, the generated column (from 0) that stands for it.
    """
    prints = written(column_fingerprints(results), "column-prints")
    found = written(candidates(pairs, prints), "column-options")
    twins = written(equal_columns(found, results, prints), "equal-columns")
    state = found.join(twins, "gen_run_id", "left").withColumn("mapping", F.array().cast("array<int>"))
    width = found.agg(F.max(F.size("options"))).first()[0] or 0
    doubtful = [r[0] for r in found.select(F.posexplode("options").alias("i", "o")).where("size(o) > 1")
                .select("i").distinct().collect()]  # column numbers
    for i in range(width):
        done = state.where(F.size("options") <= i)
        earlier = lambda j: F.coalesce(F.try_element_at("twins", j),
                                       F.array().cast("array<int>"))
        free = F.filter(F.get("options", F.lit(i)), lambda j: ~F.array_contains(F.col("mapping"), j) & (
            F.size(F.array_except(earlier(j), F.col("mapping"))) == 0))
        grown = (state.where(F.size("options") > i).withColumn("next", F.explode(free))
                 .withColumn("mapping", F.concat("mapping", F.array("next"))).drop("next"))
        if i in doubtful:
            grown = written(grown, "column-states")
            ours = grown.select("gold_run_id").distinct()
            theirs = grown.select("gen_run_id", "mapping").distinct()
            gold = _prefix_prints(results, ours, "gold_run_id", F.slice("c", 1, i + 1), "gold_print")
            gen = _prefix_prints(results, theirs, "gen_run_id",
                                 F.transform("mapping", lambda j: F.get(F.col("c"), j)), "gen_print")
            grown = (grown.join(gold, "gold_run_id").join(gen, ["gen_run_id", "mapping"])
                     .where("gold_print = gen_print").drop("gold_print", "gen_print").select(*state.columns))
        state = written(done.unionByName(grown), "column-states") if i in doubtful else done.unionByName(grown)
    return state.select(*PAIR, "mapping")


def matching_columns(pairs: DataFrame, results: DataFrame) -> DataFrame:
    """gold_run_id, gen_run_id, mapping of the pairs that match under some column mapping (the
    smallest one), confirmed on all rows. Pairs that do not match have no row; empty results
    have no columns to match."""
    left = written(mappings(pairs, results), "mappings")
    named = left.withColumn("as_run", F.sha2(F.concat_ws("/", F.col("gen_run_id"), F.to_json("mapping")), 256))
    moved = (results_cells(results, "gen_run_id").join(named.select("gen_run_id", "mapping", "as_run").distinct(),
                                                       "gen_run_id")
             .select(F.col("as_run").alias("run_id"),
                     F.to_json(F.transform("mapping", lambda j: F.get(F.col("c"), j))).alias("row")))
    golds = results.join(named.select(F.col("gold_run_id").alias("run_id")).distinct(), "run_id", "left_semi")
    again = golds.select("run_id", F.to_json(_cells()).alias("row"))  # rendered alike
    asked = named.select("gold_run_id", F.col("as_run").alias("gen_run_id")).distinct()
    sure = score.exactly_equal(asked, moved.unionByName(again)).where("exact").select(
        "gold_run_id", F.col("gen_run_id").alias("as_run"))
    return named.join(sure, ["gold_run_id", "as_run"]).groupBy(*PAIR).agg(F.min("mapping").alias("mapping"))
