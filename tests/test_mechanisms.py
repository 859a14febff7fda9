"""Mechanisms against brute force, replays, restarts and damaged input."""

import json
import os
import random
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tallyglass.operators import alignment, ann, evaluate, extraction, gate, hooks, linking, maintenance, probe, running
from tallyglass.operators.merge import latest_items
from tallyglass.plans import mechanisms, summaries
from tallyglass.sources import pieceslog, rowgroups, social
from tallyglass.streaming import incremental, latest
from tallyglass.streaming.sink import BatchTable

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- running sums


@pytest.mark.parametrize("parts", [None, 1, 5, 40])
def test_running_equals_brute_force(spark, parts):
    r = random.Random(1)
    rows = [(r.choice([None, "a", "a", "b"]), r.choice([None, *range(60)]), i, r.choice([None, 0, 1, 7])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, at long, id long, v long").repartition(7)
    first = lambda x: (x is not None, x if x is not None else 0)
    for keys in ([], ["k"]):
        got = running.running(df, ["at", "id"], {"before": F.col("v"), "place": F.lit(1)}, keys, parts)
        assert got.columns == [*df.columns, "before", "place"]
        want, sums = {}, {}
        for k, at, i, v in sorted(rows, key=lambda x: (first(x[1]), x[2])):
            s = sums.setdefault(k if keys else "", [0, 0])
            want[i] = tuple(s)
            s[0] += v or 0
            s[1] += 1
        assert {x.id: (x.before, x.place) for x in got.collect()} == want
    assert running.numbered(df.limit(0), ["id"], "n").count() == 0


def test_budget_has_no_window_over_all_rows(spark):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").select(F.col("l_orderkey").alias("batch"), F.col("l_linenumber").alias("pos"), (F.col("l_quantity") > 20).alias("keep"))
    out = gate.budget(rows, 50)
    assert "SinglePartition" not in plan_of(out) and "Window" in plan_of(out)
    assert out.where("emitted").count() == 50


# --- monotone positional join


def brute_join(gold, raw):
    cursor, out = -1, []
    for g, t in enumerate(gold):
        later = [i for i, u in enumerate(raw) if u == t and t is not None and i > cursor]
        if later:
            cursor = later[0]
            out.append((g, cursor))
    return out


@pytest.mark.parametrize(("seed", "block"), [(s, b) for s in range(3) for b in (1, 3, 8, 4096)])
def test_positional_join_equals_a_cursor(spark, seed, block):
    r = random.Random(seed)
    raw = r.choices(["a", "b", "c", None, *"defgh"], [9, 3, 3, 1, 1, 1, 1, 1, 1], k=60)
    gold = [t for t in raw if r.random() < 0.6]
    for _ in range(6):
        i, j = r.randrange(len(gold)), r.randrange(len(gold))
        gold[i], gold[j] = gold[j], gold[i]
    gold[5:5] = ["nowhere", None, "a"]
    frames = [spark.createDataFrame(list(enumerate(x)), "at long, text string").repartition(3) for x in (gold, raw)]
    got = alignment.positional_join(*frames, "text", ["at"], ["at"], block)
    assert sorted((x.gold_place, x.raw_place) for x in got.collect()) == brute_join(gold, raw)


def test_positional_join_where_gold_is_swapped(spark):
    df = lambda xs: spark.createDataFrame(list(enumerate(xs)), "at long, text string")
    got = alignment.positional_join(df(["b", "a"]), df(["a", "b"]), "text", ["at"], ["at"])
    assert [(x.gold_place, x.raw_place) for x in got.collect()] == [(0, 1)]
    assert alignment.positional_join(df(["x"]), df(["a"]), "text", ["at"], ["at"]).count() == 0
    assert alignment.positional_join(df(["x"]).limit(0), df(["a"]), "text", ["at"], ["at"]).count() == 0


def test_step_functions_compose():
    r = random.Random(4)
    for _ in range(200):
        lists = [np.array(sorted(r.sample(range(30), r.randint(0, 6))), dtype=np.int64) for _ in range(r.randint(1, 9))]
        cut = r.randint(0, len(lists))
        parts = []
        for own in (lists[:cut], lists[cut:]):
            f = alignment.Steps()
            for places in own:
                f = f.then(places)
            parts.append(f)
        both = alignment._steps(alignment._frame(0, parts[1].after(parts[0])))
        for c in range(-1, 31):
            want = c
            for places in lists:
                want = next((p for p in places.tolist() if p > want), want)
            assert both(np.array([c]))[0] == want


# --- exactly-once sink


def test_a_replayed_batch_leaves_the_table_as_it_was(spark, tmp_path):
    src, table, check = (str(tmp_path / n) for n in ("in", "table", "check"))
    calls = []

    def prepare(df):
        calls.append(1)
        return df

    def run(at=check):
        stream = spark.readStream.schema("k int, v int").option("maxFilesPerTrigger", 1).parquet(src)
        incremental.ingest_stream(stream, table, ["k"], ["v"], at, prepare).awaitTermination()
        return sorted((str(r.k), r.v) for r in BatchTable(spark, table, "k int, v int").read().collect())

    spark.createDataFrame([(1, 10), (None, 11)], "k int, v int").coalesce(1).write.parquet(src)
    once = run()
    assert once == [("1", 10), ("None", 11)]
    for name in os.listdir(f"{check}/commits"):  # the crash came after the table's commit and before the checkpoint's
        os.remove(f"{check}/commits/{name}")
    assert run() == once and len(calls) == 1  # not paid for again
    marker = BatchTable(spark, table, "k int").commits()
    assert len(marker) == 1 and BatchTable(spark, table, "k int").note(marker[0])["n_rows"] == 2
    os.remove(f"{table}/_commits/{marker[0]}.json")  # and before the table's: the batch's folder is there, but not committed
    for name in os.listdir(f"{check}/commits"):
        os.remove(f"{check}/commits/{name}")
    assert BatchTable(spark, table, "k int, v int").read().count() == 0
    assert run() == once
    spark.createDataFrame([(1, 20), (2, 21), (None, 22)], "k int, v int").coalesce(1).write.mode("append").parquet(src)
    assert run() == [("1", 10), ("2", 21), ("None", 11), ("None", 22)]
    assert run(str(tmp_path / "other")) == [("1", 10), ("2", 21), *[("None", v) for v in (11, 11, 22, 22)]]  # another ingestion, as U1 says


# --- latest capture on a stream


def test_latest_stream_equals_batch_and_forgets(spark, tmp_path):
    r = random.Random(2)
    start = 1_700_000_000
    rows = [(i, r.randrange(8), start + 60 * (i // 4) + r.randrange(300)) for i in range(160)]
    rows += [(1000, None, start), (1001, 3, None)]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "event_id long, user_id long, at long"
    for k in range(4):
        part = spark.createDataFrame(rows[40 * k : 40 * (k + 1)] + (rows[160:] if k == 0 else []), schema)
        part.select("event_id", "user_id", F.timestamp_seconds("at").alias("ts")).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # files are taken in the order of their times
    own = latest.session_for_state(spark)
    assert spark.conf.get(latest.SETTING) != latest.PROVIDER
    kind = "event_id long, user_id long, ts timestamp"
    stream = own.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(src)
    log = latest.latest_stream(stream, "user_id", late="1 hour", keep=600)
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
    q = log.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = latest_items(spark.read.schema(kind).parquet(out), "user_id", ["ts", "event_id"])
    all_rows = spark.read.schema(kind).parquet(src).where("user_id is not null and ts is not null")
    want = latest_items(all_rows, "user_id", ["ts", "event_id"])
    key = lambda df: sorted((x.user_id, x.event_id) for x in df.collect())
    assert key(got) == key(want)
    assert spark.read.schema(kind).parquet(out).count() < all_rows.count()  # only what is newer goes on
    # far later, one other user's event moves the watermark on, and the rest is forgotten
    late = spark.createDataFrame([(5000, 99, start + 10**6), (5001, 99, start + 10**6 + 1)], schema)
    late.select("event_id", "user_id", F.timestamp_seconds("at").alias("ts")).repartition(2, "event_id").write.mode("append").parquet(src)
    q = log.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert kept[-1] < 8


# --- row groups


@pytest.fixture
def grouped(tmp_path):
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").sort_by("page_id")
    os.makedirs(tmp_path / "pages")
    half = len(pages) // 2
    pq.write_table(pages.slice(0, half), tmp_path / "pages/a.parquet", row_group_size=20)
    pq.write_table(pages.slice(half), tmp_path / "pages/b.parquet", row_group_size=20)
    return pages, str(tmp_path / "pages")


def opened(path, *filters):
    reader = rowgroups.RowGroupReader(path, None, "PERMISSIVE")
    assert list(reader.pushFilters(list(filters))) == list(filters)  # Spark applies all of them to the rows
    return [(os.path.basename(g.file), g.group) for g in reader.partitions()]


def test_row_groups_that_cannot_match_are_not_opened(spark, grouped):
    from pyspark.sql import datasource as ds

    pages, path = grouped
    ids, half = pages["page_id"].to_pylist(), len(pages) // 2
    every = [(f, g) for f, n in (("a.parquet", half), ("b.parquet", len(pages) - half)) for g in range(-(-n // 20))]
    assert opened(path) == every
    assert opened(path, ds.EqualTo(("page_id",), ids[45])) == [("a.parquet", 2)]
    assert opened(path, ds.GreaterThanOrEqual(("page_id",), ids[15]), ds.LessThanOrEqual(("page_id",), ids[25])) == every[:2]
    assert opened(path, ds.LessThan(("page_id",), -5)) == [] and opened(path, ds.StringContains(("url",), "x")) == every
    df = rowgroups.session(spark).read.format(rowgroups.NAME).load(path)
    assert sorted(r.page_id for r in df.collect()) == ids
    assert df.select(F.spark_partition_id().alias("p")).distinct().count() == len(every)
    assert df.where("page_id is null").count() == 0 and df.where("url like 'http%'").count() > 0
    chunk = pq.ParquetFile(f"{path}/a.parquet").metadata.row_group(0)  # damage the first row group's pages
    low = min(chunk.column(c).dictionary_page_offset or chunk.column(c).data_page_offset for c in range(chunk.num_columns))
    with open(f"{path}/a.parquet", "r+b") as f:
        f.seek(low)
        f.write(bytes(chunk.total_byte_size // 2))
    df = rowgroups.session(spark).read.format(rowgroups.NAME).load(path)
    (bad,) = df.where("_corrupt is not null").collect()
    assert "a.parquet, row group 0" in bad._corrupt
    span = df.where((F.col("page_id") >= ids[20]) & (F.col("page_id") <= ids[59])).collect()  # the filter reached the source
    assert sorted(r.page_id for r in span) == ids[20:60] and all(r._corrupt is None for r in span)


def test_damaged_files_are_reported_one_by_one(spark, grouped):
    pages, path = grouped
    with open(f"{path}/c.parquet", "wb") as f:
        f.write(b"PAR1 this is no table")
    open(f"{path}/d.parquet", "wb").close()
    own = rowgroups.session(spark)
    df = own.read.format(rowgroups.NAME).load(path)
    bad = [r._corrupt for r in df.where("_corrupt is not null").collect()]
    assert len(bad) == 2 and {b.split(":")[0].rsplit("/", 1)[1] for b in bad} == {"c.parquet", "d.parquet"}
    assert df.where("_corrupt is null").count() == len(pages)
    with pytest.raises(Exception, match="Parquet|parquet"):
        own.read.format(rowgroups.NAME).option("mode", "FAILFAST").load(path).count()


@pytest.mark.parametrize(("low", "high"), [(3, 9), (5, 5)])
def test_row_group_statistics(low, high):
    from pyspark.sql import datasource as ds

    values = list(range(low, high + 1))
    makes = [(ds.EqualTo, lambda v, x: v == x), (ds.GreaterThan, lambda v, x: v > x), (ds.GreaterThanOrEqual, lambda v, x: v >= x), (ds.LessThan, lambda v, x: v < x), (ds.LessThanOrEqual, lambda v, x: v <= x)]
    for make, holds in makes:
        for x in range(low - 2, high + 3):
            may = rowgroups.may_hold(make(("c",), x), {"c": low}, {"c": high}, {"c": 0}, 10)
            assert may == any(holds(v, x) for v in values)
    assert not rowgroups.may_hold(ds.EqualTo(("c",), 1), {}, {}, {"c": 10}, 10)
    assert rowgroups.may_hold(ds.EqualTo(("other",), 1), {"c": 3}, {"c": 3}, {}, 10)
    assert rowgroups.may_hold(ds.EqualTo(("c",), "x"), {"c": 3}, {"c": 3}, {}, 10)


# --- a log with offsets of its own


def test_pieces_log_gives_each_row_once_over_restarts(spark, tmp_path):
    root, out, check = (str(tmp_path / n) for n in ("log", "out", "check"))
    pieceslog.register(spark)

    def put(key, first, texts):
        file = f"{root}/{pieceslog.file_name(key, first, first + len(texts) - 1)}"
        os.makedirs(os.path.dirname(file), exist_ok=True)
        pq.write_table(pa.table({"key": [key] * len(texts), "no": range(first, first + len(texts)), "text": texts}), file)

    def run(slack=0):
        stream = spark.readStream.format(pieceslog.NAME).schema("key string, no long, text string").option("item", "no").option("slack", slack).load(root)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.key, r.no, r.text) for r in spark.read.schema("key string, no long, text string").parquet(out).collect())

    put("a/b ", 0, ["x", "y"])
    put("c", 7, ["z"])
    first = [("a/b ", 0, "x"), ("a/b ", 1, "y"), ("c", 7, "z")]
    assert run() == first and run() == first  # a restart without news gives nothing
    put("a/b ", 1, ["y again", "w"])  # overlaps what was taken: only the newer item comes
    put("new", 0, ["n"])
    more = sorted([*first, ("a/b ", 2, "w"), ("new", 0, "n")])
    assert run() == more
    with open(f"{root}/{pieceslog.REVISIT}", "w") as f:
        json.dump({"a/b ": 1}, f)
    again = run(slack=1)
    assert again == sorted([*more, ("a/b ", 2, "w")]) and run(slack=1) == again  # once for each time it is asked


# --- probe


def brute_probe(x, y, rounds, rate=2.0, l2=1e-4):
    w, b, n = np.zeros(x.shape[1]), 0.0, len(x)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        w = w - rate * (x.T @ (p - y) / n + l2 * w / n)
        b -= rate * float((p - y).mean())
    return w, b


def test_probe_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = {(r.fold, r.dim): r.weight for r in mechanisms.probe_weights(spark, SF).collect()}
    own = rows.orderBy("vec_id").collect()
    x, y, fold = np.array([r.embedding for r in own], dtype=np.float64), np.array([float(r.label % 2 == 0) for r in own]), np.array([r.vec_id % 3 for r in own])
    assert len(got) == 4 * (x.shape[1] + 1)
    for k in (-1, 0, 1, 2):
        w, b = brute_probe(x[fold != k], y[fold != k], 25)
        assert np.allclose([got[k, i] for i in range(x.shape[1] + 1)], [*w, b], atol=1e-6, rtol=0)


def test_probe_judges_each_fold_by_a_probe_that_has_not_seen_it(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(120, 3))
    rows = [(i, [float(v) for v in x[i]], bool(x[i, 0] > 0)) for i in range(120)] + [(500, None, True), (501, [0.0, 0.0, 0.0], None)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, t boolean")
    fold = (F.col("id") % 4).cast("int")
    probes = probe.fit(df, F.col("t").cast("double"), fold=fold, folds=4, rounds=30)
    out = {v.fold: v for v in probe.cross_validated(df, probes, F.col("t"), fold).collect()}
    assert sum(v.tp + v.fp + v.fn + v.tn for v in out.values()) == 120 and sum(v.tp + v.tn for v in out.values()) > 108
    for k, v in out.items():
        use = np.arange(120) % 4 == k
        w, b = brute_probe(x[~use], (x[~use, 0] > 0).astype(float), 30)
        p = x[use] @ w + b >= 0
        assert (v.tp, v.fp) == (int((p & (x[use, 0] > 0)).sum()), int((p & (x[use, 0] <= 0)).sum()))
    assert probes[-1].loss < 0.3
    with pytest.raises(ValueError, match="vectors of"):
        probe.fit(df.unionByName(spark.createDataFrame([(9, [1.0], True)], df.schema)), F.col("t").cast("double"), rounds=1)
    assert probe.fit(df.limit(0), F.col("t").cast("double"), rounds=2)[-1].weights.size == 0
    assert evaluate.fit_probe(x, (x[:, 0] > 0).astype(float), rounds=5)[0][0] > 0


# --- nearest neighbours by cells


def test_nearest_by_cells_reaches_the_exact_list(spark):
    for sf in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        got = {}
        scanned = set()
        for r in mechanisms.nearest_by_cells(spark, sf).collect():
            got.setdefault(r.query, {})[r.id] = r.score
            scanned.add(r.scanned)
        rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
        x = np.array([r.embedding for r in rows], dtype=np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        ids, hits, n = [r.vec_id for r in rows], 0, 0
        for i, vec_id in enumerate(ids):
            if vec_id % 20 == 0:
                s = x @ x[i]
                bound = np.sort(s)[::-1][:8][-1]
                assert len(got[vec_id]) == 8 and all(abs(v - s[ids.index(k)]) < 1e-9 for k, v in got[vec_id].items())
                hits += sum(v >= bound - 1e-9 for v in got[vec_id].values())
                n += 8
        assert hits >= 0.95 * n
        assert max(scanned) < len(ids)


def test_clustered_vectors_need_few_cells(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(20, 16))[np.arange(800) % 20] + 0.05 * r.normal(size=(800, 16))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(800)], "id long, embedding array<double>")
    q = ann.fit(df, cells=20)
    assert q.probes <= 3
    asked = df.where("id % 20 = 0").select(F.col("id").alias("query"), "embedding")
    got = ann.search(asked, df, ann.index(df, q), q, 8).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = sum(g.score >= np.sort(u @ u[g.query])[::-1][7] - 1e-9 for g in got)
    assert hits >= 0.95 * 8 * 40 and max(g.scanned for g in got) < 300


def test_nearest_by_cells_with_many_alike(spark):
    """A cell that holds most rows is dealt out in slices, and what lies in other cells is found as well."""
    r = np.random.default_rng(1)
    x = np.r_[np.tile(r.normal(size=8), (300, 1)), r.normal(size=(200, 8))]
    rows = [(i, [float(v) for v in x[i]]) for i in range(500)] + [(900, None)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    q = ann.fit(df, cells=6, parts=3)
    slices, blocks, ann.SLICE_ROWS, ann.SLICE_QUERIES = ann.SLICE_ROWS, ann.SLICE_QUERIES, 40, 7
    try:
        asked = df.where("id % 5 = 0").select(F.col("id").alias("query"), "embedding")
        got = ann.search(asked, df, ann.index(df, q), q, 5, probes=6, reranked=500).collect()
    finally:
        ann.SLICE_ROWS, ann.SLICE_QUERIES = slices, blocks
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    by = {}
    for g in got:
        by.setdefault(g.query, {})[g.rank] = (g.id, g.scanned)
    assert set(by) == set(range(0, 500, 5)) and {s for own in by.values() for _, s in own.values()} == {500}
    for i, own in by.items():
        s = np.round(u @ u[i], 9)
        assert np.allclose([s[own[k][0]] for k in range(5)], np.sort(s)[::-1][:5])  # every cell was looked into
    with pytest.raises(ValueError, match="no vectors"):
        ann.fit(df.limit(0))


def test_a_slice_hands_on_the_k_best_of_a_query_only(spark, tmp_path, monkeypatch):
    """Not the candidates of each cell, which are as many as all rows times all queries where vectors have no clusters."""
    log, real = str(tmp_path / "bytes"), ann._compare

    def counted(*args):
        run = real(*args)

        def told(key, asked, held):
            out = run(key, asked, held)
            with open(log, "a") as f:
                f.write(f"{out.nbytes}\n")
            return out

        return told

    monkeypatch.setattr(ann, "_compare", counted)
    monkeypatch.setattr(ann, "SLICE_ROWS", 500)
    r = np.random.default_rng(5)
    x = r.normal(size=(2000, 16))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(2000)], "id long, embedding array<float>")
    q = ann.fit(df, parts=4)
    asked = df.where("id % 20 = 0").select(F.col("id").alias("query"), "embedding")
    got = ann.search(asked, df, ann.index(df, q), q, 8, probes=len(q.cells)).collect()
    assert sum(int(line) for line in open(log)) < 100 * 4 * 8 * 16 * 2  # queries, slices, rows, bytes of an id and a score
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert len(got) == 800 and {g.scanned for g in got} == {2000}
    assert sum(g.score >= np.sort(u @ u[g.query])[::-1][7] - 1e-6 for g in got) >= 0.95 * 800


def test_nearest_of_more_copies_than_are_ranked_again_are_those_of_the_smallest_ids(spark):
    r = np.random.default_rng(2)
    x = np.r_[np.tile(r.normal(size=6), (400, 1)), r.normal(size=(100, 6)), np.zeros((1, 6))]
    order = r.permutation(len(x))
    df = spark.createDataFrame([(f"{i:03}", [float(v) for v in x[i]]) for i in order], "id string, embedding array<double>")
    q = ann.fit(df, cells=5, parts=4)
    asked = df.where("id < '010' or id = '500'").select(F.col("id").alias("query"), "embedding")
    got = ann.search(asked, df, ann.index(df, q), q, 4, probes=5, reranked=20).orderBy("query", "rank").collect()
    assert [(g.query, g.id, g.rank) for g in got if g.query < "010"] == [(f"{i:03}", f"{k:03}", k) for i in range(10) for k in range(4)]
    assert [g.score for g in got if g.query == "500"] == [0.0] * 4  # a vector of zeros is like nothing


# --- extraction as a table function


def test_extraction_pads_asks_again_and_calls_once_a_batch(spark, tmp_path):
    log = str(tmp_path / "calls")

    def complete(prompt):
        with open(log, "a") as f:
            f.write(json.dumps(prompt) + "\n")
        if "broken" in prompt:
            return "no json"
        docs = [{"source_id": f"S{i}", "text": p} for i, p in enumerate(prompt.split("\n\n")) if "skip" not in p]
        return json.dumps({"docs": [*docs, {"source_id": "S0", "text": "a second one"}, {"source_id": "S99", "text": "nobody"}]})

    rows = [("t", i, f"piece {i}" if i != 4 else "skip me") for i in range(7)] + [("u", 5, "broken"), ("u", 6, "x"), (None, 1, "orphan"), ("v", 0, None)]
    df = spark.createDataFrame(rows, "thread string, no int, text string").repartition(5)
    out = {(r.thread, r.no): r for r in extraction.extract(df, complete, "thread", "no", "text", batch=3).collect()}
    assert len(out) == len(rows)
    assert json.loads(out["t", 0].doc) == {"text": "[S0]\npiece 0"} and [out["t", i].call for i in range(7)] == [0, 0, 0, 1, 1, 1, 2]
    assert out["t", 4].is_padded and out["t", 4].doc is None and not out["t", 4].is_failed and not out["t", 3].is_padded
    assert out["u", 5].is_failed and out["u", 6].is_failed and not out[None, 1].is_failed and out["v", 0].doc
    calls = [json.loads(line) for line in open(log)]
    assert len(calls) == 3 + 2 + 1 + 1 and sum("broken" in c for c in calls) == 2  # the broken one is asked once more
    assert extraction.extract(df.limit(0), complete, "thread", "no", "text").count() == 0


# --- plans in place


def test_a_plan_in_place_touches_its_partitions_only(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = [(i, f"v{i}", ["a", "b", None, "d"][i % 4]) for i in range(40)]
    spark.createDataFrame(rows, "id long, value string, part string").repartition("part").write.partitionBy("part").parquet(path)
    files = lambda p: {f: os.stat(f"{path}/part={p}/{f}").st_mtime_ns for f in os.listdir(f"{path}/part={p}") if f.startswith("part-")}
    null = "__HIVE_DEFAULT_PARTITION__"
    before = {p: files(p) for p in ("a", "b", null, "d")}
    plan = spark.createDataFrame([(1, False, "new"), (5, True, None), (2, False, "none")] + [(i, True, None) for i in range(3, 40, 4)], "id long, dropped boolean, new_value string")
    assert maintenance.apply_in_place(spark, path, "part", plan) == [None, "b", "d"]
    got = {r.id: (r.value, r.part) for r in spark.read.parquet(path).collect()}
    want = {i: (v, p) for i, v, p in rows if i != 5 and i % 4 != 3} | {1: ("new", "b"), 2: ("none", None)}
    assert got == want
    assert files("a") == before["a"] and files("b") != before["b"] and files(null) != before[null] and not os.path.exists(f"{path}/part=d")
    assert maintenance.apply_in_place(spark, path, "part", plan.where("id = -1")) == []
    with pytest.raises(ValueError, match="cannot move"):
        maintenance.apply_in_place(spark, path, "part", plan.withColumnRenamed("new_value", "new_part"))


# --- faults that were found


def test_items_without_a_short_code_stay(spark):
    post = lambda code, url, when, text: ("i", code, url, text, "own", [], when, 1, 2, None)
    rows = [post(None, None, "1", "글 하나 입니다 길게"), post(None, "", "1", "글 둘 입니다 길게"), post("", None, "1", "글 셋 입니다 길게"),
            post(None, "u", "1", "주소가 같은 옛 글"), post(None, "u", "2", "주소가 같은 새 글"), post("S", "x", "1", "코드가 같은 옛 글"), post("S", "y", "2", "코드가 같은 새 글")]
    got = sorted(r.text for r in social.to_pieces(spark.createDataFrame(rows, social.ITEM)).collect())
    assert got == sorted(["글 하나 입니다 길게", "글 둘 입니다 길게", "글 셋 입니다 길게", "주소가 같은 새 글", "코드가 같은 새 글"])


def test_nearest_centroid_with_labels_of_any_kind(spark):
    cents = spark.createDataFrame([("slime", [1.0, 0.0]), ("not_slime", [0.0, 1.0]), ("zero", [0.0, 0.0])], "label string, centroid array<double>")
    rows = spark.createDataFrame([(1, [2.0, 1.0]), (2, [1.0, 3.0]), (3, [1.0, 1.0]), (4, None)], "id long, embedding array<double>")
    got = {r.id: r.label for r in gate.nearest_centroid(rows, cents).collect()}
    assert {k: got[k] for k in (1, 2, 3)} == {1: "slime", 2: "not_slime", 3: "not_slime"} and got.get(4) is None  # a tie goes to the smaller label


def test_sections_that_offend_are_asked_for_once_more(spark, tmp_path):
    log = str(tmp_path / "asked")

    def model(prompt):
        with open(log, "a") as f:
            f.write(prompt.replace("\n", " ") + "\n")
        if prompt.startswith("bad"):
            return {"scent": "은은해요. 소리 언급은 없어요."}
        if "Leave out" in prompt:
            return {"scent": "다시 쓴 글이에요."}
        return {"scent": "은은해요." if prompt == "good" else "은은해요. 소리 언급은 없어요."}

    material = spark.createDataFrame([("a", "good"), ("b", "mend"), ("c", "bad"), ("d", None)], "k string, prompt string")
    got = {r.k: (r.scent, r.n_asked) for r in hooks.sectionize(material, ["k"], model, ["scent"]).collect()}
    assert got == {"a": ("은은해요.", 1), "b": ("다시 쓴 글이에요.", 2), "c": ("은은해요.", 2), "d": (None, 0)}
    asked = open(log).read().splitlines()
    assert len(asked) == 5 and sum("소리 언급은 없어요" in a for a in asked) == 2


def test_summaries_of_both_sources_and_their_refresh(spark, tmp_path):
    log = str(tmp_path / "prompts")

    def model(prompt):
        with open(log, "a") as f:
            f.write(json.dumps(prompt) + "\n")
        return {"scent": "둘 다 말해요" if "counts:" in prompt else prompt.replace("\n", "; ")}

    kind = "id int, market string, platform string, scent string, texture string"
    rows = spark.createDataFrame([(1, "m", "instagram", "은은해요", "쫀득"), (2, "m", "instagram", "상큼", None), (3, "m", "dcinside", "강해요", " "),
                                  (4, "one", "dcinside", "약해요", None), (5, "m", "elsewhere", "x", "y"), (6, "blank", "dcinside", None, "")], kind)
    promo = spark.createDataFrame([(7, "m", "instagram", "협찬 향", None)], kind)
    tones = spark.createDataFrame([("m", "instagram", "scent", "pos"), ("m", "dcinside", "scent", "neg"), ("m", "instagram", "scent", "pos")], "market string, platform string, criterion string, value string")
    out = summaries.axis_summaries(rows, promo, ["scent", "texture"], ["market"], model, polarities=tones)
    got = {(r.market, r.card): (r.scent, r.n_reviews) for r in out.collect()}
    assert got["m", "instagram"] == ("scent (for 2, against 0): 은은해요 | 상큼; texture: 쫀득", 3)
    assert got["m", "dcinside"] == ("scent (for 0, against 1): 강해요", 1) and got["m", "supporter"][0] == "scent: 협찬 향"
    asked = [json.loads(line) for line in open(log)]
    (both,) = [p for p in asked if "counts:" in p]
    assert got["m", "integrated"] == ("둘 다 말해요", 4) and both.endswith("counts: scent 2:1") and "강해요" in both and "상큼" in both and len(asked) == 5
    assert set(got) == {("m", c) for c in ("instagram", "dcinside", "integrated", "supporter")} | {("one", "dcinside")}
    lines = spark.createDataFrame([("m", "p", "integrated", "향", None), ("m", "q", "integrated", " ", "제품 배송")], "market string, product string, card string, scent string, shipping string")
    market = spark.createDataFrame([("m", "integrated", "빨라요"), ("m", "dcinside", "느려요")], "market string, card string, shipping string")
    shown = sorted((r.product, r.card, r.criterion, r.scope, r.verdict) for r in summaries.cards(lines, market, ["market", "product"], ["scent", "shipping"], ["market"]).collect())
    assert shown == sorted([("p", "integrated", "scent", "product", "향"), *[(p, c, "shipping", "market", v) for p in "pq" for c, v in (("integrated", "빨라요"), ("dcinside", "느려요"))]])
    old = spark.createDataFrame([("a", 5, "x"), ("b", 5, "y"), ("gone", 9, "z")], "market string, n_reviews long, scent string")
    now = spark.createDataFrame([("a", 6), ("b", 9), ("new", 4), ("few", 2)], "market string, n_reviews long")
    made = []

    def generate(keys):
        made.append(sorted(r.market for r in keys.collect()))
        return now.join(keys, "market").withColumn("scent", F.lit("made"))

    dry = summaries.refresh(old, now, ["market"], generate, 0.0072)
    assert (dry.n, dry.cost, dry.summaries, made) == (2, round(2 * 3.3 * 0.0072, 4), None, [])
    done = summaries.refresh(old, now, ["market"], generate, 0.0072, dry_run=False)
    assert sorted((r.market, r.n_reviews, r.scent) for r in done.summaries.collect()) == [("a", 5, "x"), ("b", 9, "made"), ("gone", 9, "z"), ("new", 4, "made")]
    assert made == [["b", "new"]]


def test_counters_cost_no_job(spark):
    """Every job of a dry thread run writes or sizes a step; the counters are there when the last is written."""
    run = mechanisms.thread_run_counters(spark, SF)
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    got = {r.counter: r.n for r in run.collect()}
    assert got["collected"] == got["above_mark"] > got["emitted"] - 1 and got["calls"] <= got["calls_without_cut"] and got["skipped_seen"] > 0
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before <= 1  # a local table


def test_a_failing_source_is_reported_and_stops_nothing(spark):
    good = spark.createDataFrame([(1, "a")], "id long, text string")

    @F.udf("string")
    def fails(x):
        raise RuntimeError("the page is gone")

    sources = {"good": lambda: good, "late": lambda: good.withColumn("text", fails("text")), "early": lambda: 1 / 0, "unwritten": lambda: None, "more": lambda: good.select("id")}
    union, report = social.collect_all(spark, sources)
    assert {(r.id, r.text, r.collected_from) for r in union.collect()} == {(1, "a", "good"), (1, None, "more")}
    found = {r.source: (r.n_rows, r.error) for r in report.collect()}
    assert found["good"] == (1, None) and found["more"] == (1, None) and found["unwritten"] == (0, None)
    assert found["late"][0] is None and found["late"][1] and "division" in found["early"][1]
    assert social.collect_all(spark, {"bad": lambda: 1 / 0})[0] is None


def test_repeated_market_words_have_one_row(spark):
    kb = spark.createDataFrame([("연 찌", "b"), ("연찌", "z"), ("연찌", "a"), ("다른", None)], "market_word string, handle string")
    df = spark.createDataFrame([("연찌",), ("없음",)], "word string")
    got = {r.word: (r.kb_market_word, r.kb_handle) for r in linking.exact_market(df.repartition(3), "word", kb.repartition(4)).collect()}
    assert got == {"연찌": ("연 찌", "b"), "없음": (None, None)}
