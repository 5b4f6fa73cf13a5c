from concurrent.futures import ThreadPoolExecutor

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seriesforge.llm import near_dedup, sharding, topk
from seriesforge.llm.common import components, shared_folder, whole_groups
from tests.llm import brute

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(seed, n=300, dims=12):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, dims))
    rows = [(i, (base[rng.integers(40)] + rng.normal(size=dims) * rng.choice([0, 0.05, 0.12, 1])).astype(np.float32).tolist(), 1) for i in range(n)]
    odd = [None, [], [0.0] * dims, [float("nan")] * dims, [None] * dims, [float("inf")] + [1.0] * (dims - 1), [1.0, 2.0], rows[3][1]]
    return rows + [(n + k, v, None) for k, v in enumerate(odd)] + [(None, rows[0][1], 0)]


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


def filled(v, dims=12):
    return np.array([*v, *[0.0] * (dims - len(v))])


@pytest.mark.parametrize("cosine,members,pack", [(0.95, 8192, 512), (0.5, 5, 16)])
def test_near_duplicates(spark, monkeypatch, cosine, members, pack):
    monkeypatch.setattr(near_dedup, "MEMBERS", members)
    monkeypatch.setattr(near_dedup, "PACK", pack)
    rows = vectors(1)
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"node": F.lit(1), "copies": F.lit("x")}).repartition(6)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_dedup.near_duplicates(frame, cosine=cosine, target_recall=1.0).collect()}
    ok = [(i, filled(v)) for i, v, _ in rows if i is not None and usable(v) and any(v)]
    forest, links = brute.Forest([i for i, _, _ in rows if i is not None]), {}
    for i, a in ok:
        near = [j for j, b in ok if i != j and a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine]
        links[i] = len(near)
        for j in near:
            forest.link(i, j)
    want = {i: (links.get(i, 0), forest.find(i), forest.find(i) == i) for i in forest.top} | {None: (0, None, None)}
    assert got == want


def test_recall_of_near_duplicates(spark, caplog):
    base = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").select("embedding").limit(1200).collect()
    rng = np.random.default_rng(7)
    v = np.array([r.embedding for r in base], float)
    v /= np.sqrt((v**2).sum(1))[:, None]
    far = rng.uniform(0, 0.3, size=(5, len(v), 1)) * rng.normal(size=(5, *v.shape)) / np.sqrt(v.shape[1])
    v = np.concatenate([v, *(v + far)]).astype(np.float32)
    frame = spark.createDataFrame([(k, x, 0) for k, x in enumerate(v.tolist())], SCHEMA).repartition(5)
    with caplog.at_level("INFO", near_dedup.log.name):
        got = {r.vec_id: r.n_links for r in near_dedup.near_duplicates(frame).collect()}
    assert "lie within the traversal" in caplog.text
    v = v.astype(float)
    v /= np.sqrt((v**2).sum(1))[:, None]
    true = {k: int((v @ v[k] >= 0.95).sum()) - 1 for k in range(0, len(v), 100)}
    assert sum(true.values()) > 100 and all(got[k] <= n for k, n in true.items())
    assert sum(got[k] for k in true) >= 0.99 * sum(true.values())


def near_pairs(v):
    v = v.astype(np.float32).astype(float)
    v /= np.sqrt((v**2).sum(1))[:, None]
    p, q = np.nonzero(np.triu(v @ v.T >= 0.95, 1))
    return set(zip(p.tolist(), q.tolist()))


def test_a_huge_group_does_not_outvote_sparse_pairs(spark, monkeypatch):
    """1,500 near copies of one vector and 700 pairs elsewhere: at least 0.99 of the links of each kind."""
    monkeypatch.setattr(near_dedup, "ENOUGH", 50)
    rng = np.random.default_rng(11)
    group = rng.normal(size=32) + 0.02 * rng.normal(size=(1500, 32))
    one = rng.normal(size=(700, 32))
    v = np.concatenate([group, one, one + 0.28 * rng.normal(size=one.shape)]).astype(np.float32)
    true = near_pairs(v)
    links = np.bincount(np.array(sorted(true)).ravel(), minlength=len(v))
    frame = spark.createDataFrame([(k, x, 0) for k, x in enumerate(v.tolist())], SCHEMA).repartition(5)
    got = {r.vec_id: r.n_links for r in near_dedup.near_duplicates(frame).collect()}
    for rows in range(1500), range(1500, len(v)):
        assert sum(links[k] for k in rows) > 300 and all(got[k] <= links[k] for k in rows)
        assert sum(got[k] for k in rows) >= 0.99 * sum(links[k] for k in rows)


def test_without_evidence_the_traversal_goes_the_whole_way(spark, monkeypatch, caplog):
    """Ten pairs among 3,000 vectors, hardly any of them probed: none is lost."""
    monkeypatch.setattr(near_dedup, "PROBES", (50, 100))
    rng = np.random.default_rng(13)
    v = rng.normal(size=(3000, 16))
    v[2990:] = v[:10] + 0.25 * rng.normal(size=(10, 16))
    true = near_pairs(v)
    frame = spark.createDataFrame([(k, x, 0) for k, x in enumerate(v.tolist())], "vec_id long, embedding array<float>, label int").repartition(3)
    with caplog.at_level("INFO", near_dedup.log.name):
        got = {r.vec_id: r.n_links for r in near_dedup.near_duplicates(frame).collect() if r.n_links}
    assert "the whole way" in caplog.text and len(true) >= 5
    assert sum(got.values()) == 2 * len(true)


def test_forest_of_links():
    rng = np.random.default_rng(3)
    for n, m in ((1, 0), (50, 20), (200, 180), (300, 2000)):
        p, q = rng.integers(n, size=(2, m))
        plain = brute.Forest(range(n))
        for a, b in zip(p.tolist(), q.tolist()):
            plain.link(a, b)
        node, root = near_dedup.forest(n, p, q)
        assert dict(zip(node.tolist(), root.tolist())) == {i: plain.find(i) for i in range(n) if plain.find(i) != i}


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [tuple(r) for r in near_dedup.near_duplicates(spark.createDataFrame([(5, None, 1)], SCHEMA)).collect()] == [(5, 0, 5, True)]


@pytest.mark.parametrize("block", [8192, 64])
def test_top_k(spark, block, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "PAGE", 8)
    rows = vectors(2)
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"q": F.lit(9), "score": F.lit(1)}).repartition(3)
    got = sorted(tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 7 == 0).collect())
    ok = [(i, np.floor(256 * filled(v)).astype(np.int64)) for i, v, _ in rows if i is not None and usable(v)]
    want = []
    for i, a in ok:
        if i % 7 == 0:
            best = sorted(((-int(a @ b), j) for j, b in ok if j != i))[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == sorted(want)


def test_top_k_of_nothing_and_few(spark):
    assert topk.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 7 == 0).collect() == []
    few = spark.createDataFrame([(0, [1.0], 1), (1, [2.0], 1), (3, [2.0], 1)], SCHEMA)
    assert sorted(tuple(r) for r in topk.top_k(few, F.col("vec_id") % 50 == 0).collect()) == [(0, 1, 1, 131072), (0, 2, 3, 131072)]


def test_top_k_of_a_query_id_with_two_vectors(spark):
    rows = [(0, [3.0, 1.0], 1), (0, [1.0, 3.0], 1), (1, [2.0, 0.0], 1), (2, [0.0, 2.0], 1)]
    for given in (rows, rows[::-1]):
        out = topk.top_k(spark.createDataFrame(given, SCHEMA).coalesce(1), F.col("vec_id") == 0)
        assert sorted(tuple(r) for r in out.collect()) == [(0, 1, 2, 393216), (0, 2, 1, 131072)]
        assert "exchange singlepartition, ensure_requirements" not in out._jdf.queryExecution().toString().lower()


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(10, 60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (3, 4), (3, 4)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 10 for k in range(10, 61)} | {k: 100 for k in range(100, 160)} | {3: 3, 4: 3}


def test_shards_are_compacted_and_versions_stay(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}" if i % 5 else None, None) for i in range(40)], "doc_id long, text string, tier int")
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store", rows.schema, target_bytes=1 << 20, fanout=3)
    for k in range(5):
        store.append(rows.where(f"doc_id % 5 = {k}"))
    store.append(rows.where("false"))
    key = lambda r: (r.doc_id, r.text)
    assert sorted(map(key, store.read().collect()), key=str) == sorted(map(key, rows.collect()), key=str)
    assert {r.tier for r in store.manifest().collect()} == {1} and store.version == 8
    assert store.read(2).count() == 16
    assert store.read().select("__shard").distinct().count() == 2
    other = sharding.ShardStore(spark, f"file://{tmp_path}/store", rows.schema)
    assert other.refresh() == 8
    store.append(rows.limit(1))
    with pytest.raises(Exception, match="(?i)exists"):
        other.append(rows.limit(1))
    assert sharding.ShardStore(spark, f"file://{tmp_path}/none", rows.schema).read().collect() == []


def store_of(spark, path, rows, **kw):
    return sharding.ShardStore(spark, f"file://{path}/store", rows.schema, **kw)


def test_shards_merge_runs_of_like_size_only(spark, tmp_path):
    rows = spark.range(2000).selectExpr("id AS doc_id", "repeat('x', 90) AS text", "1 AS __tier", "'s' AS __shard")
    store = store_of(spark, tmp_path, rows, fanout=3)
    store.append(rows.where("doc_id >= 100"))
    for k in range(3):
        store.append(rows.where(f"doc_id % 3 = {k} AND doc_id < 100"))
    assert sorted((r.tier, r.n_rows) for r in store.manifest().collect()) == [(0, 1900), (1, 100)] and store.version == 5
    back = store.read()
    assert back.count() == 2000 and sorted(back.columns) == ["__shard", "__tier", "doc_id", "text"]
    assert {r[0] for r in back.select("__tier").distinct().collect()} == {0, 1}
    run = lambda name, n, settled=False: (name, 0, n, n, settled)
    big = [run("a", 1 << 40, True), run("b", 1 << 40, True), run("c", 1 << 40, True), run("d", 9)]
    assert store.due(big) == [] and store.due([*big, run("e", 0), run("f", 12)]) == [run("e", 0), run("d", 9), run("f", 12)]


def test_settled_files_are_left_alone(spark, tmp_path):
    rows = spark.range(400).selectExpr("id AS doc_id", "uuid() AS text")
    store = store_of(spark, tmp_path, rows, target_bytes=1 << 10, fanout=2)
    for k in range(4):
        store.append(rows.where(f"doc_id % 4 = {k}").coalesce(1))
    assert {(r.tier, r.settled) for r in store.manifest().collect()} == {(0, True)} and store.version == 4


def test_racing_writers_lose_nothing_and_a_dead_one_blocks_nothing(spark, tmp_path):
    rows = spark.range(6).selectExpr("id AS doc_id", "'t' AS text")
    store_of(spark, tmp_path, rows).append(rows.where("doc_id = 0"))
    dead = tmp_path / "store" / "manifest" / "_dead"
    dead.mkdir()
    (dead / "part-0.parquet").write_text("half")

    def work(k):
        own, lost = store_of(spark, tmp_path, rows, fanout=9), 0
        own.refresh()
        while True:
            try:
                own.append(rows.where(f"doc_id = {k}"))
                return lost
            except FileExistsError:
                lost += 1
                own.refresh()

    with ThreadPoolExecutor(5) as pool:
        list(pool.map(work, range(1, 6)))
    last = store_of(spark, tmp_path, rows, fanout=2)
    assert last.refresh() == 6 and sorted(r.doc_id for r in last.read().collect()) == list(range(6))
    last.compact()
    last.clean(keep=1, older_seconds=-60)
    assert sorted(r.doc_id for r in last.read().collect()) == list(range(6)) and not dead.exists()
    assert len(list((tmp_path / "store" / "runs").iterdir())) == last.manifest().count()
    assert [f.name for f in (tmp_path / "store" / "manifest").iterdir()] == [f"version={last.version}"]


def test_sql_agrees(spark):
    d = "/root/testdata/sf0.001"
    for name in ("documents", "embeddings"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")
    for query, sql in ((sharding.op7_sharding, sharding.OP7_SQL), (topk.op10_topk, topk.OP10_SQL)):
        frame, want = query(spark, d), duckdb.sql(sql)
        columns = sorted(frame.columns)
        assert sorted(want.columns) == columns
        assert sorted(tuple(r[c] for c in columns) for r in frame.collect()) == sorted(want.select(*columns).fetchall())


def test_the_shared_folder_is_the_sessions(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_whole_groups_cut_no_group():
    rng = np.random.default_rng(5)
    a = np.sort(rng.integers(0, 60, 3000))
    b = np.sort(rng.integers(0, 2, 3000))
    order = np.lexsort((b, a))
    columns = a[order], b[order], np.arange(3000)
    batches = [pa.RecordBatch.from_arrays([pa.array(c[k : k + 70]) for c in columns], ["a", "b", "c"]) for k in range(0, 3000, 70)]
    for rows in (1, 100, 5000):
        pieces = list(whole_groups(iter(batches), 2, rows))
        assert all((np.concatenate(c) == want).all() for c, want in zip(zip(*pieces), columns))
        ends = [(p[0][-1], p[1][-1]) for p in pieces]
        assert len(set(ends)) == len(ends) and all((p[0][0], p[1][0]) != e for p, e in zip(pieces[1:], ends))
    one = [pa.RecordBatch.from_arrays([pa.array([7] * 50), pa.array([1] * 50)], ["a", "b"])] * 4
    assert [len(p[0]) for p in whole_groups(iter(one), 2, 60)] == [200] and list(whole_groups(iter([]), 2)) == []
