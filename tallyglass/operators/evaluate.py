"""Evaluation: confusion counts, threshold sweeps, splits, audits and integrity."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyglass.operators.consolidate import count_if

#: Thresholds of the sweep, in thousandths.
TAUS = [300 + 25 * i for i in range(15)]


def confusion(df: DataFrame, predicted: Column, truth: Column, keys: list[str] = ()) -> DataFrame:
    """Tp, fp, fn, tn."""
    return df.groupBy(*keys).agg(
        count_if(predicted & truth).alias("tp"), count_if(predicted & ~truth).alias("fp"),
        count_if(~predicted & truth).alias("fn"), count_if(~predicted & ~truth).alias("tn"),
    )


def with_ratios(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1; an empty denominator gives 1."""
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(1.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(1.0)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return counts.withColumns({"precision": p, "recall": r, "f1": f1})


def tau_sweep(df: DataFrame, score: str, truth: str) -> DataFrame:
    """Confusion counts at each threshold of the grid (tau in thousandths). Rows are expanded 15 times at most."""
    grid = F.explode(F.array(*map(F.lit, TAUS))).alias("tau")
    rows = df.select(F.col(score).alias("s"), F.col(truth).alias("t"), grid)
    return confusion(rows, F.col("s") * 1000 >= F.col("tau"), F.col("t"), ["tau"])


def choose_tau(sweep: DataFrame, min_precision: float = 0.90) -> DataFrame:
    """Best recall among thresholds of enough precision, the smallest on ties; else the best precision, then recall."""
    rated = with_ratios(sweep)
    enough = F.col("precision") >= min_precision
    order = [F.desc(enough.cast("int")), F.desc(F.when(enough, F.col("recall")).otherwise(F.col("precision"))), F.desc("recall"), "tau"]
    return rated.orderBy(*order).limit(1)


def calibrated(holdout: DataFrame, score: str, truth: str, tau: float, margin: float = 0.05, min_negatives: int = 10) -> DataFrame:
    """One row for a threshold on held-out rows: counts, ratios, the keep-all baseline, and ``usable``:
    F1 better than the baseline by the margin, fewer false positives, and enough negatives to tell."""
    got = with_ratios(confusion(holdout, F.col(score) >= tau, F.col(truth)))
    base = with_ratios(confusion(holdout, F.lit(True), F.col(truth))).select(F.col("f1").alias("base_f1"), F.col("fp").alias("base_fp"))
    both = got.crossJoin(F.broadcast(base))  # one row each
    usable = (F.col("f1") >= F.col("base_f1") + margin) & (F.col("fp") < F.col("base_fp")) & (F.col("fp") + F.col("tn") >= min_negatives)
    return both.withColumn("usable", usable)


def passes(rates: DataFrame, least: float = 1.0) -> bool:
    """Whether every suite's pass rate (n, n_passed) is high enough; a suite without cases does not pass."""
    return not rates.where((F.col("n") == 0) | (F.col("n_passed") < least * F.col("n"))).limit(1).count()


def axis_report(df: DataFrame, bucket: str, truth: str) -> DataFrame:
    """Per bucket: n and how many are wanted; wasted calls are the rest."""
    return df.groupBy(F.col(bucket).alias("bucket")).agg(F.count("*").alias("n"), count_if(F.col(truth)).alias("n_wanted"))


def holdout_split(df: DataFrame, id: str, every: int = 3) -> DataFrame:
    """Every third row by id is held out. ``id`` has to be dense from 0, as an index is."""
    return df.withColumn("holdout", F.pmod(F.col(id), F.lit(every)) == 0)


def kfold(df: DataFrame, id: str, k: int = 5) -> DataFrame:
    """Fold of a dense index."""
    return df.withColumn("fold", F.pmod(F.col(id), F.lit(k)).cast("int"))


def consume(df: DataFrame, order: list[str], budget: int, keep: str) -> DataFrame:
    """Wanted rows that a budget reaches, in order over all threads."""
    n = df.where(F.col(keep)).orderBy(*order).limit(budget)
    return n


def budget_sweep(df: DataFrame, order: list[str], keep: str, most: int) -> DataFrame:
    """For budgets 1 to ``most``: how many wanted rows are taken. Only the first ``most`` rows matter."""
    first = df.orderBy(*order).limit(most).withColumn("_r", F.row_number().over(Window.orderBy(*order)))
    grid = first.select(F.col(keep).alias("keep"), F.explode(F.sequence(F.col("_r"), F.lit(most))).alias("budget"))
    return grid.groupBy("budget").agg(count_if(F.col("keep")).alias("n_taken"))


def tie_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sizes of groups of equal rank keys: size, n_groups."""
    return df.groupBy(*keys).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_groups"))


def integrity_check(df: DataFrame, text: str, labels: list[str]) -> DataFrame:
    """Trimmed texts that occur more than once with different labels: text_md5, n_rows, n_labels."""
    n = F.count_distinct(F.struct(*labels))
    out = df.groupBy(F.md5(F.trim(F.col(text)).cast("binary")).alias("text_md5")).agg(F.count("*").alias("n_rows"), n.alias("n_labels"))
    return out.where("n_labels > 1")


def pass_rate(got: DataFrame, gold: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """N and n_passed over gold rows; a missing answer does not pass."""
    both = gold.alias("g").join(got.alias("a"), key, "left")
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"g.{f}").eqNullSafe(F.col(f"a.{f}"))
    return both.agg(F.count("*").alias("n"), count_if(same).alias("n_passed"))


def ledger_summary(calls: DataFrame) -> DataFrame:
    """Calls, errors, tokens and cost of a model-call ledger."""
    return calls.agg(
        F.count("*").alias("calls"), count_if(F.col("error").isNotNull()).alias("errors"),
        F.sum("n_in").alias("n_in"), F.sum("n_cached").alias("n_cached"), F.sum("n_out").alias("n_out"), F.sum("cost").alias("cost"),
    )


def manifest(runs: DataFrame, kind: str, key: str, item_at: str, scraped: str, cost: str) -> DataFrame:
    """Per kind and key, and per kind (key NULL): n_items, oldest, newest, last_scrape, cost."""
    rows = runs.select(F.col(kind).alias("kind"), F.col(key).alias("key"), F.col(item_at).alias("at"), F.col(scraped).alias("scraped"), F.col(cost).alias("cost"))
    k, v = F.col("kind"), F.col("key")
    return rows.groupingSets([[k, v], [k]], k, v).agg(
        F.count("*").alias("n_items"), F.min("at").alias("oldest"), F.max("at").alias("newest"), F.max("scraped").alias("last_scrape"), F.sum("cost").alias("cost")
    )


def attribution_audit(reviews: DataFrame, source: str, market: str, product: str, text: str) -> DataFrame:
    """Per source: row counts by what is attributed, distinct names, and surplus copies of one text and product."""
    per = reviews.groupBy(source, product, F.md5(F.col(text).cast("binary")).alias("_t")).agg(F.count("*").alias("k"))
    copies = per.groupBy(source).agg(
        count_if(F.col("k") > 1).alias("dup_groups"), F.sum(F.when(F.col("k") > 1, F.col("k") - 1).otherwise(0)).cast("long").alias("surplus")
    )
    has_m, has_p = F.col(market).isNotNull(), F.col(product).isNotNull()
    counts = reviews.groupBy(source).agg(
        F.count("*").alias("n_rows"), count_if(has_m).alias("with_market"), count_if(has_p).alias("with_product"),
        count_if(has_m & has_p).alias("with_both"), count_if(~has_m & ~has_p).alias("with_neither"),
        F.count_distinct(market).alias("n_markets"), F.count_distinct(product).alias("n_products"),
    )
    return counts.join(copies, source)


def occurrence_join(gold: DataFrame, raw: DataFrame, text: str, gold_order: str, raw_order: str) -> DataFrame:
    """The k-th gold occurrence of a text meets its k-th raw occurrence; ``alignment`` has the cursor of J24."""
    k = lambda o: F.row_number().over(Window.partitionBy(text).orderBy(o))
    a, b = gold.withColumn("_k", k(gold_order)), raw.withColumn("_k", k(raw_order))
    return a.join(b, [text, "_k"]).drop("_k")


def weak_labels(df: DataFrame, text: str, rules: list[tuple[str, bool]]) -> DataFrame:
    """First matching pattern decides; rows with the same text count once; NULL where none matches."""
    label = None
    for pattern, value in rules:
        c = F.col(text).rlike(pattern)
        label = F.when(c, value) if label is None else label.when(c, value)
    return df.dropDuplicates([text]).withColumn("keep", label)


def gold_with_rulings(gold: DataFrame, rulings: DataFrame) -> DataFrame:
    """Axes of gold items, overridden by rulings that name them (also_applies included); Q is not passed on."""
    own = rulings.select(F.explode(F.array_distinct(F.concat(F.array("id"), F.coalesce("also_applies", F.array())))).alias("id"),
                         F.col("M").alias("_M"), F.col("E").alias("_E"))
    one = own.groupBy("id").agg(F.max("_M").alias("_M"), F.max("_E").alias("_E"))
    out = gold.join(one, "id", "left")
    return out.withColumns({"M": F.coalesce("_M", "M"), "E": F.coalesce("_E", "E")}).drop("_M", "_E")


def fill_batch(threads: DataFrame, thread: str, order: str, n: int) -> DataFrame:
    """Pieces of the largest threads first until ``n`` are taken."""
    size = threads.groupBy(thread).agg(F.count("*").alias("_size"))
    return threads.join(size, thread).orderBy(F.desc("_size"), thread, order).limit(n).drop("_size")


def harvest(pieces: DataFrame, post: str, order: str, text: str, per_post: int = 8, most: int = 130, width: int = 200) -> DataFrame:
    """A labelling sample: the first comments of each post, cut for display, at most ``most`` in all."""
    r = F.row_number().over(Window.partitionBy(post).orderBy(order))
    own = pieces.withColumn("_r", r).where(F.col("_r") <= per_post).drop("_r")
    return own.withColumn(text, F.substring(text, 1, width)).orderBy(post, order).limit(most)


def fit_probe(x: np.ndarray, y: np.ndarray, rate: float = 2.0, rounds: int = 4000, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """V8 for a labelled set of a few hundred rows in memory; ``probe`` fits tables."""
    w, b, n = np.zeros(x.shape[1]), 0.0, len(x)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-((x * w).sum(axis=1) + b)))
        w -= rate * (((p - y)[:, None] * x).sum(axis=0) / n + l2 * w / n)
        b -= rate * float((p - y).mean())
    return w, b


def cross_validated(x: np.ndarray, y: np.ndarray, folds: int = 5) -> dict[str, int]:
    """Confusion counts over folds by index."""
    out = {"tp": 0, "fp": 0, "fn": 0, "tn": 0}
    for k in range(folds):
        test = np.arange(len(x)) % folds == k
        w, b = fit_probe(x[~test], y[~test], rounds=400)
        p = (x[test] * w).sum(axis=1) + b >= 0
        for a, t in zip(p, y[test] > 0.5):
            out[("t" if a == t else "f") + ("p" if a else "n")] += 1
    return out
