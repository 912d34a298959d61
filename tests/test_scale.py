"""Work and memory that must follow the input: plans, paths for full and sparse keys, bounds."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kinfold.functions import numeric as num
from kinfold.operators import audit, candidates, documents as docs, identity, layout, metrics, neighbours, profiling, resampling
from kinfold.plans import texts
from kinfold.plans.ordered import lookup
from kinfold.plans.session import cut_lineage
from kinfold.sources import documents as sources, sinks


def test_match_regions_on_sparse_and_full_pages(spark):
    rng = random.Random(5)
    box = lambda: (lambda x, y: (x, y, x + rng.randint(0, 120), y + rng.randint(0, 90)))(rng.randint(-20, 580), rng.randint(-20, 780))
    blocks = [(d, p, i, *map(float, box())) for d, p, n in ((1, 0, 200), (1, 1, 5), (2, 0, 1), (3, 0, 65)) for i in range(n)]
    regions = [(d, p, i, f"L{i % 3}", i / 100, *map(float, box())) for d, p, n in ((1, 0, 40), (1, 1, 30), (2, 0, 3), (4, 0, 9)) for i in range(n)]
    b = spark.createDataFrame(blocks, "doc int, page int, block_id int, x0 double, y0 double, x1 double, y1 double")
    r = spark.createDataFrame(regions, "doc int, page int, region_id int, label string, score double, x0 double, y0 double, x1 double, y1 double")

    def best(k):
        found = []
        for d, p, i, label, score, u0, v0, u1, v1 in regions:
            if (d, p) != k[:2]:
                continue
            x0, y0, x1, y1 = k[3:]
            w, h = min(x1, u1) - max(x0, u0), min(y1, v1) - max(y0, v0)
            inter, a, o = (w * h if w > 0 and h > 0 else 0.0), (x1 - x0) * (y1 - y0), (u1 - u0) * (v1 - v0)
            inside = u0 <= (x0 + x1) / 2 <= u1 and v0 <= (y0 + y1) / 2 <= v1
            found.append((inter / (a + o - inter) if a + o - inter else 0.0, inter / a if a else 0.0, int(inside), -i, label, score))
        top = max(found, default=None)
        return (top[4], top[5], top[0]) if top and (top[0] >= 0.02 or top[1] >= 0.2 or top[2]) else (None, None, None)

    got = {(x.doc, x.page, x.block_id): (x.region_label, x.region_score, x.iou) for x in layout.match_regions(b, r, 600.0, 800.0).collect()}
    assert got == {k[:3]: best(k) for k in blocks}
    sparse = layout.match_regions(b.where("doc = 2"), r, 600.0, 800.0)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in sparse


def test_regions_are_made_beside_their_blocks(spark, sf_dir):
    """regions of every customer and supplier of its nation are never dealt out; pairs are settled batch by batch."""
    out = entry.queries()["j9_match_regions"](spark, sf_dir)
    plan = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
    dealt = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", plan)
    assert dealt and not any("region_id" in x for x in dealt)


def test_best_regions_of_pairs_in_any_batches(spark):
    box = lambda i, p="": [(F.col(i) * k % 40 + d).cast("double").alias(f"{p}{c}") for c, k, d in (("x0", 3, 0), ("y0", 7, 0), ("x1", 3, 25), ("y1", 7, 25))]
    b = spark.range(60).select(F.lit(1).alias("doc"), (F.col("id") % 2).cast("int").alias("page"), F.col("id").alias("block_id"), *box("id"))
    # regions 40 apart lie alike, so the smaller one must win
    r = spark.range(120).select(F.col("id").alias("region_id"), F.concat(F.lit("L"), "id").alias("label"), (F.col("id") / 100).alias("score"), *box("id", "r"))
    small = "spark.sql.execution.arrow.maxRecordsPerBatch"
    try:
        outs = []
        for n in ("7", "10000"):
            spark.conf.set(small, n)
            outs.append(sorted(layout.best_regions(b, b.crossJoin(r)).select("block_id", "region_label", "iou").collect()))
    finally:
        spark.conf.unset(small)
    assert outs[0] == outs[1] == [(i, f"L{i % 40}", 1.0) for i in range(60)]


def test_a_lookup_table_that_grows_is_not_broadcast(spark):
    table = cut_lineage(spark.range(1000).select("id", F.array_repeat(F.lit(True), 50).alias("sides")))
    out = lookup(spark.range(5000).select((F.col("id") % 1200).alias("id"), F.col("id").alias("row")), table, ["id"], grows=True)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.where("sides is not null").count() == 1000 * 4 + 200


def test_markdown_files_are_read_once(spark, sf_dir):
    out = entry.queries()["s8_markdown_lines"](spark, sf_dir)
    assert "Format: Text" not in out._jdf.queryExecution().toString()  # the files were read before, into one table
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = docs.select("doc_id", F.size(F.split("text", "\r\n|\r|\n")).cast("long").alias("n_lines"), F.md5("text").alias("digest"))
    assert sorted(out.select("doc_id", "n_lines", "digest").collect()) == sorted(want.collect())


def test_markdown_files_share_folders_and_are_scanned_in_pieces(spark, sf_dir, monkeypatch, tmp_path):
    """one file per document, but not one folder; the driver holds the names of some files only."""
    monkeypatch.setattr(sinks, "shared_folder", lambda s: str(tmp_path / "md"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = docs.select("doc_id", F.size(F.split("text", "\r\n|\r|\n")).cast("long").alias("n_lines"), F.md5("text").alias("digest")).collect()
    out = entry.queries()["s8_markdown_lines"](spark, sf_dir).select("doc_id", "n_lines", "digest")
    assert sorted(out.collect()) == sorted(want)
    folders = [p for p in (tmp_path / "md").iterdir() if p.is_dir()]
    assert len(folders) <= 8 and sum(len(list(p.glob("*.txt"))) for p in folders) == len(want)

    scans, read = [], sources.read_markdown
    monkeypatch.setattr(sources, "FOLDER", 20)
    monkeypatch.setattr(sources, "SCAN", 40)
    monkeypatch.setattr(sources, "read_markdown", lambda s, paths: scans.append(len(paths)) or read(s, paths))
    odd = spark.createDataFrame([(-5, "---\ndoc_id: 9\n---\nx"), (7, ""), (8, "a\r\nb\x00"), (9, "\n")] + [(i, f"t{i}\n") for i in range(10, 300)], "doc_id long, text string")
    found = sources.write_markdown(odd, "doc_id", "text", str(tmp_path / "odd"))
    assert sorted(sources.read_folders(spark, found, "doc_id").collect()) == sorted(odd.collect())
    assert len(found) == 15 and scans == [2] * 7 + [1]


@pytest.mark.parametrize("metric", ["l1", "l2"])
def test_neighbours_of_many_dimensions_are_screened_without_loss(spark, metric):
    """Vectors far from the origin, near copies, ties and a huge outlier; visits carry no list of cells."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 24)) + 1e4
    base[100:130] = base[7]
    base[130:160] = base[8] + 1e-7 * rng.normal(size=(30, 24))
    base[160:200] = np.round(base[160:200])
    base[399] = 1e12
    df = spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in enumerate(base)], "ref_id long, v array<double>, ref_label int")
    near = neighbours.knn_join(df.select(F.col("ref_id").alias("qid"), "v"), df, "qid", "v", 5, metric, exclude_self=True)
    assert "dqs" not in near._jdf.queryExecution().toString()
    got = {}
    for r in near.collect():
        got.setdefault(r["qid"], {})[r["rank"]] = r["ref_id"]
    d = neighbours._distances(base, base, metric)
    for i in range(400):
        want = sorted((j for j in range(400) if j != i), key=lambda j: (d[i, j], j))[:5]
        assert [got[i][k] for k in range(1, 6)] == want


def test_blocks_of_neighbours_grow_with_the_rows(spark):
    """Each vector travels to rows / block others, so a fixed block would send the square of the rows."""
    small, large = neighbours._block(2_000, spark), neighbours._block(10**8, spark)
    assert small == neighbours.BLOCK_ROWS and large == neighbours.MOST_ROWS
    assert small < neighbours._block(20_000, spark) < large


@pytest.mark.parametrize("groups, few", [(60, True), (60, False)])
def test_pooled_intervals_add_groups_up_to_few_scores(spark, monkeypatch, groups, few):
    """Both ways give the same intervals; with few scores no cell carries its group's replicates."""
    rng = np.random.default_rng(4)
    rows = [(int(g), int(rng.random() < 0.3 + 0.01 * g), int(rng.integers(0, 6)) / 8) for g in range(groups) for _ in range(40)]
    rows += [(0, int(rng.random() < 0.5), s / 8) for s in range(6) for _ in range(50)]  # a large group
    df = spark.createDataFrame([*rows, (None, 1, 0.5)], "g long, y int, p double")
    carried = []
    plain = resampling.lookup
    monkeypatch.setattr(resampling, "lookup", lambda *a, **k: carried.append(1) or plain(*a, **k))
    if not few:
        monkeypatch.setattr(resampling, "HELD_BYTES", 0)
    got = {r["metric"]: r for r in resampling.pooled_ranking_intervals(df, "g", "y", "p", replicates=25).collect()}
    assert bool(carried) is not few
    times = np.zeros((25, groups), int)
    for r in resampling.group_multiplicities(df, "g", 25).collect():
        times[r["replicate"], r["g"]] = r["times"]
    g, y, p = (np.array(c) for c in zip(*rows))
    auc = []
    for t in times:
        w, levels = t[g], np.unique(p)
        pos, neg = (np.array([w[(p == s) & (y == c)].sum() for s in levels]) for c in (1, 0))
        auc.append((pos * (np.cumsum(neg) - neg / 2)).sum() / (pos.sum() * neg.sum()))
    r = got["pooled_roc_auc"]
    assert r["valid_iterations"] == 25 and r["n"] == groups and r["mean"] == pytest.approx(np.mean(auc))
    assert (r["ci_low"], r["ci_high"]) == pytest.approx(tuple(np.quantile(auc, [0.025, 0.975])))


def test_leave_out_quantiles_sort_only_the_values_in_question(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(int(g), float(v), int(v) % 5 if g % 3 else None) for g in range(80) for v in rng.integers(0, 4000, 50)]
    rows += [(3, None, 1), (81, None, None)]
    df = spark.createDataFrame(rows, "g long, v double, few int")
    sorted_by_group = []
    plain = audit.prefix_sums

    def counted(d, order, sums, by=(), *rest):
        if "g" in by:
            sorted_by_group.append(d.count())
        return plain(d, order, sums, by, *rest)

    monkeypatch.setattr(audit, "prefix_sums", counted)
    got = {(r["feature"], r["g"]): (r["q0"], r["q1"], r["q2"]) for r in audit.leave_out_quantiles(df, "g", ["v", "few"]).collect()}
    assert sum(sorted_by_group) < len(rows)  # of twice as many values
    for i, c in ((1, "v"), (2, "few")):
        for g in {r[0] for r in rows}:
            rest = [r[i] for r in rows if r[0] != g and r[i] is not None]
            assert got[c, g] == pytest.approx(tuple(np.quantile(rest, [0.25, 0.5, 0.75])))


@pytest.mark.parametrize("few", [0, 20_000])
def test_aliases_read_each_text_once(spark, monkeypatch, few):
    """Citations and DOIs are cleaned on one row per distinct text; copies of a hot key only look their entity up."""
    rows = [(f"r{i:04}", ("https://doi.org/10.1/A.%d" % (i % 3)) if i % 4 else None, "Smith, J. (20%02d)" % (i % 5), None if i % 50 == 0 else f"key {i % 6}")
            for i in range(400)]
    rows = [(r, d, c, k if i % 7 else d) for i, (r, d, c, k) in enumerate(rows)]
    df = spark.createDataFrame(rows, "row string, doi string, cit string, k string")
    read = []
    plain = identity.canonical_citation
    monkeypatch.setattr(identity, "FEW_KEYS", few)
    monkeypatch.setattr(identity, "canonical_citation", lambda c: read.append(1) or plain(c))
    out = identity.resolve_aliases(df, "k", "doi", "cit", "row")
    final = out._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" not in final and read
    clean = lambda s: " ".join("".join(ch if ch.isalnum() else " " for ch in s.lower()).split())
    bare = lambda s: s.lower().replace("https://doi.org/", "").rstrip("/. ") if s else None
    by_key, by_doi = {}, {}
    for r, d, c, _ in rows:
        key = d or c
        by_key.setdefault(key, clean(c))
        by_doi.setdefault(bare(key), clean(c))
    want = {r: by_doi.get(bare(k)) or by_key.get(k) or k for r, _, _, k in rows}
    assert {x["row"]: x["entity"] for x in out.collect()} == want and out.columns == [*df.columns, "entity"]


@pytest.mark.parametrize("name, source", [("x4_chunk_types", "documents"), ("x11_normalize_rows", "part"), ("x12_unique_rows", "part")])
def test_texts_of_a_table_with_one_split_are_read_by_many_tasks(spark, sf_dir, monkeypatch, name, source):
    monkeypatch.setattr("kinfold.queries.documents.DOCS_A_TASK", 20)
    monkeypatch.setattr("kinfold.queries.documents.PAYLOADS_A_TASK", 20)
    n = spark.read.parquet(f"{sf_dir}/{source}.parquet").count()
    plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert f", {-(-n // 20)}), REPARTITION_BY_NUM" in plan


def test_fields_keep_their_meaning(spark):
    cells = [None, "", " N/A ", "a\u00a0 \t b", "\u3000x\u2028\n y ", "a\x1cb", "...", "  Not   stated", "plain"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    got = [r.v for r in df.select("i", docs.field_text(F.col("c")).alias("v")).orderBy("i").collect()]
    assert got == [None, None, None, "a b", "x y", "a\x1cb", None, None, "plain"]


def test_texts_are_read_once_where_they_are_few(spark):
    """Few distinct texts: rows look them up (F22, F29); many: row by row, with equal results and NULL read too."""
    df = spark.range(12_000).select(
        "id", F.when(F.col("id") % 5 > 0, F.concat((F.col("id") % 5).cast("string"), F.lit(" cm/s"))).alias("few"),
        F.concat(F.col("id").cast("string"), F.lit(" m/s")).alias("many"))
    readers = {"few": lambda c: F.coalesce(num.flow_mm_s(c), F.lit(-1.0)), "many": num.flow_mm_s}
    assert texts.few_texts(df, ["few", "many"]) == ["few"]
    got = texts.read_once(df, readers)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and "lower(few" not in plan and "lower(many" in plan
    want = df.select("id", readers["few"](F.col("few")).alias("few"), num.flow_mm_s(F.col("many")).alias("many"))
    assert got.columns == want.columns and got.exceptAll(want).count() == 0 and got.count() == 12_000


def test_cleaning_plan_looks_texts_up(spark, sf_dir):
    """no text column of few texts is read row by row, and rows aren't shuffled to mark rare materials."""
    out = entry.queries()["n25_clean_experiments"](spark, sf_dir)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") >= 15 and "lower(pressure" not in plan and "__salt" not in plan


def test_rank_matrix_keeps_rows_whole(spark, monkeypatch):
    """rows aren't taken apart and put together again; joined and broadcast ranks agree, also with a hot value and NULLs."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, F.col("id") % 700).alias("a"), F.greatest(F.col("id") % 900, F.lit(600)).alias("b"),
        F.when(F.col("id") % 5 > 0, -(F.col("id") % 11)).alias("c"))
    whole = profiling.rank_correlation_matrix(df, ["a", "b", "c"])
    assert "collect_list" not in whole._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(profiling, "FEW_VALUES", 20)
    joined = profiling.rank_correlation_matrix(df, ["a", "b", "c"])
    assert "rightHint=(strategy=merge)" in joined._jdf.queryExecution().optimizedPlan().toString()
    p = df.toPandas()
    for out in (whole, joined):
        got = {(r["a"], r["b"]): (r["n"], r["rho"]) for r in out.collect()}
        assert len(got) == 3
        for (x, y), (n, rho) in got.items():
            both = p[[x, y]].dropna()
            assert n == len(both) and rho == pytest.approx(both[x].rank().corr(both[y].rank()), abs=1e-9)


@pytest.mark.parametrize("hot", [False, True])
def test_rank_matrix_joins_a_bounded_part_of_the_rows(spark, monkeypatch, hot):
    """rows look their ranks up part by part, whether or not one value of the longest column holds most of them."""
    a = F.when(F.col("id") % 3 > 0, F.when(F.lit(hot) & (F.col("id") % 7 > 0), F.lit(1500)).otherwise(F.col("id") % 1700))
    df = spark.range(3000).select(a.alias("a"), F.greatest(F.col("id") % 120, F.lit(40)).alias("b"), F.when(F.col("id") % 5 > 0, -(F.col("id") % 11)).alias("c"))
    joined = []
    monkeypatch.setattr(profiling, "FEW_VALUES", 20)
    monkeypatch.setattr(profiling, "ROWS_AT_ONCE", 500, raising=False)
    monkeypatch.setattr(profiling, "lookup", lambda rows, *x, **y: joined.append(rows.count()) or lookup(rows, *x, **y))
    got = {(r["a"], r["b"]): (r["n"], r["rho"]) for r in profiling.rank_correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert sum(joined) == 2 * 3000 and max(joined) <= 1000
    p = df.toPandas()
    for (x, y), (n, rho) in got.items():
        both = p[[x, y]].dropna()
        assert n == len(both) and rho == pytest.approx(both[x].rank().corr(both[y].rank()), abs=1e-9)
    assert len(got) == 3 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_encoded_features_work_out_each_row_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(i):
        seen.add(1)
        return None if i % 9 == 0 else float(i * 7 % 50)

    rows = spark.range(400).select(counted("id").alias("x"), (F.col("id") % 5).alias("y"), F.concat(F.lit("k"), F.col("id") % 3).alias("c"))
    got = profiling.encoded_features(rows, ["x", "y"], ["c"])
    known = sorted(i * 7 % 50 for i in range(400) if i % 9)
    median = (known[(len(known) - 1) // 2] + known[len(known) // 2]) / 2
    assert sorted(map(tuple, got.collect())) == sorted((median if i % 9 == 0 else float(i * 7 % 50), float(i % 5), float(i % 3)) for i in range(400))
    assert seen.value == 400


def test_keys_of_candidates_are_worked_out_once_a_group(spark):
    """the test for empty arrays that Spark adds before an explode must not hash the candidates' keys for every row."""
    rows = spark.range(500).select((F.col("id") % 25).alias("g"), F.col("id").cast("double").alias("y"))
    groups = rows.groupBy("g").agg(F.avg("y").alias("m"))
    out = candidates.group_sides(groups, "g", 42, 50, 0.2)
    assert "md5" not in out._jdf.queryExecution().optimizedPlan().toString()
    sides = [r["sides"] for r in out.collect()]
    assert len(sides) == 25 and all(sum(s[c] for s in sides) == 5 for c in range(50))


def test_neighbour_information_counts_in_one_sweep(spark):
    """one sketch and one sweep for both ends; nulls take the median, ties and a class of one row as before."""
    rng = np.random.default_rng(5)
    n, k = 300, 5
    v = np.round(rng.normal(size=n), 1)
    y = np.where(v + rng.normal(size=n) > 0, "a", "b").astype(object)
    y[0] = "single"
    w = [None if i % 7 == 0 else float(x) for i, x in enumerate(v)]
    df = spark.createDataFrame([(i, float(v[i]), w[i], y[i], None) for i in range(n)], "id long, v double, w double, y string, gone double")
    out = audit.neighbour_information(df, ["v", "w", "gone"], "y", "id", k)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("percentile_approx") <= 2  # named twice in one sketch

    def digamma(x):
        x, s = np.asarray(x, float), 0.0
        for _ in range(6):
            s, x = s - 1 / x, x + 1
        return s + np.log(x) - 0.5 / x - (1 / 12 - (1 / 120 - (1 / 252 - 1 / (240 * x * x)) / (x * x)) / (x * x)) / (x * x)

    def brute(x):
        keep = np.array([np.sum(y == c) > 1 for c in y])
        x, t = x[keep], y[keep]
        size = np.array([np.sum(t == c) for c in t])
        d = np.abs(x[:, None] - x[None, :])
        kk = np.minimum(k, size - 1)
        near = np.array([np.sort(np.delete(d[i], i)[np.delete(t, i) == t[i]])[kk[i] - 1] for i in range(len(x))]) * (1 - 1e-10)
        inside = np.maximum(1, np.sum((x[None, :] >= (x - near)[:, None]) & (x[None, :] <= (x + near)[:, None]), axis=1))
        return max(0.0, float(digamma(len(x)) + digamma(kk).mean() - digamma(size).mean() - digamma(inside).mean()))

    mid = float(np.median([x for x in w if x is not None]))
    got = {r["feature"]: r["mi"] for r in out.collect()}
    want = {"v": brute(v), "w": brute(np.array([mid if x is None else x for x in w]))}
    assert {f: x for f, x in got.items() if f != "gone"} == {f: pytest.approx(x, abs=1e-6) for f, x in want.items()}
    assert "gone" not in got


def test_decomposition_reads_the_rows_once(spark):
    """all parts come from counts; no row looks its group's mean up.  Values by brute force, with a one-class group and nulls."""
    rng = np.random.default_rng(4)
    g, y, q = rng.integers(0, 6, 300), rng.integers(0, 2, 300), np.round(rng.random(300), 1)
    y[g == 5] = 1
    rows = [(int(a), int(b), float(c)) for a, b, c in zip(g, y, q)]
    df = spark.createDataFrame(rows + [(0, None, 0.9), (1, 1, None)], "g long, y int, q double")
    summary, table = metrics.ranking_decomposition(df, "g", "y", "q")
    assert "__salt" not in summary._jdf.queryExecution().optimizedPlan().toString()

    def auc(pairs):
        pos, neg = [s for t, s in pairs if t == 1], [s for t, s in pairs if t == 0]
        return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None

    scored = {k: [c for a, _, c in rows if a == k] + ([0.9] if k == 0 else []) for k in range(6)}
    mean = {k: round(float(np.mean(v)), 12) for k, v in scored.items()}
    r = summary.first()
    assert r["pooled_auc"] == pytest.approx(auc([(b, c) for _, b, c in rows]))
    assert r["between_auc"] == pytest.approx(auc([(b, mean[a]) for a, b, _ in rows] + [(1, mean[1])]))
    within = {k: auc([(b, c) for a, b, c in rows if a == k]) for k in range(6)}
    assert r["within_auc_mean"] == pytest.approx(np.mean([x for x in within.values() if x is not None])) and r["n_two_class_groups"] == 5
    got = {t["g"]: t for t in table.collect()}
    for k in range(6):
        mine = [(b, c) for a, b, c in rows if a == k]
        assert got[k]["n_rows"] == len(mine) + (k < 2) and got[k]["mean_pred_pos"] == pytest.approx(np.mean([c for b, c in mine if b == 1]))
        if within[k] is None:
            assert got[k]["balanced_acc_05"] is None
        else:
            rec = [np.mean([(c >= 0.5) == b for b, c in mine if b == t]) for t in (0, 1)]
            assert got[k]["within_auc"] == pytest.approx(within[k]) and got[k]["balanced_acc_05"] == pytest.approx(np.mean(rec))


def test_draws_are_made_in_more_tasks_than_their_input_has(spark):
    """a small table of folds is not multiplied inside the one or two tasks that adaptive execution leaves it."""
    folds = spark.range(300).select((F.col("id") % 2).alias("method"), F.col("id").alias("fold_key"), (F.col("id") / 7).alias("v"))
    out = resampling.mean_interval(folds, "v", "fold_key", ["method"], 50)
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 2
