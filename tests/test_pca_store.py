"""PCA fit (A1-A4, R1, R2, trap 3), projection and the index store."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitdex.operators import index as ix
from bitdex.operators import pca as pc
from bitdex.sources import store


def _emb(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet")


def test_pca_fit_against_numpy(spark, sf001):
    e = _emb(spark, sf001)
    x = np.array([r[0] for r in e.select("embedding").collect()], dtype=np.float64)
    p = pc.pca_fit(e, 16, "embedding")
    assert np.allclose(p.mean, x.mean(0))
    cov = np.cov(x, rowvar=False)
    evals, _ = np.linalg.eigh(cov)
    top = evals[::-1][:16]
    for i in range(16):
        v = p.components[i]
        lam = v @ cov @ v
        assert np.linalg.norm(cov @ v - lam * v) < 1e-9
        assert abs(lam - top[i]) < 1e-9
    assert np.allclose(p.components @ p.components.T, np.eye(16), atol=1e-9)
    assert np.allclose(p.explained_variance, top / evals.clip(0).sum(), atol=1e-9)


def test_covariance_against_numpy(spark, sf001):
    e = _emb(spark, sf001)
    x = np.array([r[0] for r in e.select("embedding").collect()], dtype=np.float64)
    got = pc.covariance(e, "embedding").toPandas()
    m = np.zeros((64, 64))
    m[got["i"], got["j"]] = got["cov"]
    assert np.allclose(m, np.cov(x, rowvar=False), atol=1e-12)


def test_projection_centres_with_our_mean(spark, sf001):
    e = _emb(spark, sf001)
    p = pc.pca_fit(e, 8, "embedding")
    out = pc.project_keys(e.select("vec_id", "embedding"), p, "embedding", with_y=True).toPandas()
    x = np.array([r[0] for r in e.orderBy("vec_id").select("embedding").collect()])
    y = (x - p.mean) @ p.components.T
    got = np.array(out.sort_values("vec_id").y.tolist())
    assert np.allclose(got, y)


def test_require_rows_and_sample(spark):
    one = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    with pytest.raises(ValueError, match="need >= 2 rows"):
        pc.pca_fit(one, 1, "v")
    big = spark.range(5000)
    assert pc.fit_sample(big, cap=1000, seed=1).count() == 1000
    assert pc.fit_sample(big, cap=10000).count() == 5000


def test_pca_checks_tell_right_from_wrong(spark, sf001):
    e = _emb(spark, sf001)
    p = pc.pca_fit(e, 6, "embedding")
    for r in pc.pca_checks(e, p, "embedding").collect():
        assert r.residual < 1e-9 and abs(r.norm - 1) < 1e-12 and r.cross < 1e-12
    p.components[2, 5] += 0.1
    assert [r.residual > 1e-6 for r in pc.pca_checks(e, p, "embedding").orderBy("component").collect()] == \
        [False, False, True, False, False, False]


def test_wrong_length_vector_gets_null_key(spark):
    p = pc.PcaParams.identity(np.zeros(3), 3)
    df = spark.createDataFrame([(1, [1.0, -1.0, 2.0]), (2, [1.0])], "id long, v array<double>")
    rows = {r.id: r.w0 for r in pc.project_keys(df, p, "v").collect()}
    assert rows[2] is None and rows[1] == -(1 << 63) + (1 << 61)   # bits 0 and 2 set


def test_store_round_trip_and_pack(spark, sf001, tmp_path):
    e = _emb(spark, sf001)
    params = ix.identity_params(e, 64, "embedding")
    index = pc.project_keys(e.select(F.col("vec_id").alias("ord"), F.col("vec_id").alias("id"),
                                     F.lit("t").alias("title"), "embedding"),
                            params, "embedding", keep=["ord", "id", "title"])
    root = str(tmp_path / "idx")
    with pytest.raises(FileNotFoundError):
        store.pack_index(spark, root)
    store.write_index(index, params, root)
    i1, p1 = store.load_index(spark, root)                # loose
    assert i1.count() == e.count() and np.allclose(p1.mean, params.mean)
    assert store.pack_index(spark, root) == 1
    assert store.pack_index(spark, root) == 2            # re-pack -> next version
    i2, p2 = store.load_index(spark, root)
    assert i2.count() == e.count() and p2.k == 64
    got = sorted(tuple(r) for r in i2.select("id", "w0").collect())
    want = sorted(tuple(r) for r in index.select("id", "w0").collect())
    assert got == want


def test_rebuild_packs_next_version(spark, sf001, tmp_path):
    e = _emb(spark, sf001)
    params = ix.identity_params(e, 64, "embedding")
    index = pc.project_keys(e.select(F.col("vec_id").alias("ord"), F.col("vec_id").alias("id"),
                                     F.lit("t").alias("title"), "embedding"),
                            params, "embedding", keep=["ord", "id", "title"])
    root = str(tmp_path / "rb")
    assert store.rebuild(spark, index, params, root) == 1
    assert store.rebuild(spark, index.filter(F.col("id") < 10), params, root) == 2
    i2, _ = store.load_index(spark, root)
    assert i2.count() == 10                      # the newest snapshot wins
    assert store.rebuild(spark, *store.load_index(spark, root), root) == 3      # from itself
    assert store.load_index(spark, root)[0].count() == 10


def test_broken_bundles(spark, sf001, tmp_path):
    import shutil
    e = _emb(spark, sf001)
    params = ix.identity_params(e, 64, "embedding")
    index = pc.project_keys(e.select(F.col("vec_id").alias("ord"), F.col("vec_id").alias("id"),
                                     F.lit("t").alias("title"), "embedding"),
                            params, "embedding", keep=["ord", "id", "title"])
    root = tmp_path / "b"
    store.rebuild(spark, index, params, str(root))
    store.rebuild(spark, index.limit(5), params, str(root))
    shutil.rmtree(root / "bundle" / "v=2" / "_manifest")          # incomplete: not there yet
    assert store.load_index(spark, str(root))[0].count() == e.count()
    assert store.rebuild(spark, index.limit(7), params, str(root)) == 3      # a claimed version is not taken again
    shutil.rmtree(root / "bundle" / "v=3" / "index")              # complete, but broken
    with pytest.raises(Exception, match="v=3"):
        store.load_index(spark, str(root))


def _small(spark, sf001):
    e = _emb(spark, sf001)
    params = ix.identity_params(e, 64, "embedding")
    return pc.project_keys(e.select(F.col("vec_id").alias("ord"), F.col("vec_id").alias("id"),
                                    F.col("vec_id").alias("row"), F.lit("t").alias("title"), "embedding"),
                           params, "embedding", keep=["row", "ord", "id", "title"]), params


def test_packers_at_once_make_whole_bundles(spark, sf001, tmp_path):
    from concurrent.futures import ThreadPoolExecutor
    index, params = _small(spark, sf001)
    root = str(tmp_path / "c")
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(lambda n: store.rebuild(spark, index.limit(n), params, root), [10, 11, 12, 13]))
    assert sorted(versions) == [1, 2, 3, 4]
    for v, n in zip(versions, [10, 11, 12, 13]):
        assert spark.read.parquet(f"{root}/bundle/v={v}/index").count() == n
        assert spark.read.json(f"{root}/bundle/v={v}/_manifest").first()["n_keys"] == n
    assert store.load_index(spark, root, checksums=True)[0].count() == 10 + versions.index(4)
    assert not [p for p in (tmp_path / "c" / "bundle").iterdir() if p.name.startswith("_claim")]


def test_lost_truncated_and_changed_parts_are_errors(spark, sf001, tmp_path):
    import shutil
    index, params = _small(spark, sf001)
    for harm in ("lost", "truncated", "changed"):
        root = tmp_path / harm
        store.rebuild(spark, index.limit(3), params, str(root))
        store.rebuild(spark, index.repartition(3), params, str(root))
        files = sorted((root / "bundle" / "v=2" / "index").glob("*.parquet"))
        assert store.load_index(spark, str(root), checksums=True)[0].count() == index.count()
        if harm == "lost":
            files[1].unlink()
        elif harm == "truncated":
            files[1].write_bytes(files[1].read_bytes()[:-40])
            (root / "bundle" / "v=2" / "index" / f".{files[1].name}.crc").unlink()
        else:
            shutil.copy(files[0], files[1])
        with pytest.raises(Exception):
            store.load_index(spark, str(root), checksums=True)[0].collect()


def test_block_index_beside_a_bundle(spark, sf001, tmp_path):
    import shutil
    index, params = _small(spark, sf001)
    root = str(tmp_path / "blocks")
    with pytest.raises(FileNotFoundError):
        store.pack_blocks(spark, root)
    assert store.load_blocks(spark, root) is None
    store.rebuild(spark, index, params, root)
    assert store.load_blocks(spark, root) is None                # packed without
    store.pack_blocks(spark, root)
    found = store.load_blocks(spark, root)
    assert found.k == 64 and found.rows.count() == 4 * index.count()
    shutil.rmtree(next((tmp_path / "blocks" / "bundle" / "v=1" / "blocks" / "buckets").glob("block=2")))
    with pytest.raises(ValueError, match="block rows"):
        store.load_blocks(spark, root)


def test_stored_search_answers_from_what_was_packed(spark, sf001, monkeypatch):
    """The query's answer is that of the index itself, over the loose and packed copies of all its
    rows; rows lost in writing or packing show in it."""
    from bitdex.plans import catalog
    roots = []
    folder = catalog._run_folder
    monkeypatch.setattr(catalog, "_run_folder", lambda s: roots.append(folder(s)) or roots[-1])

    def answer():
        return sorted((tuple(r) for r in catalog.stored_search(spark, sf001).collect()), key=str)

    want = sorted((tuple(r) for r in catalog.benchmark_search(spark, sf001).collect()), key=str)
    assert answer() == want
    n = spark.read.parquet(f"{roots[-1]}/index").count()
    assert n > 100 and [spark.read.parquet(f"{roots[-1]}/bundle/v={v}/index").count() for v in (1, 2)] == [n, n]
    write = store.write_index
    monkeypatch.setattr(store, "write_index", lambda index, *rest: write(index.limit(3), *rest))
    assert answer() != want
