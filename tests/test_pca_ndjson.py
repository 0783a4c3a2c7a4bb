"""PCA against numpy; NDJSON corpus reader."""

import json

import numpy as np

from quarry.operators.pca import fit_pca, project
from quarry.sources.ndjson import read_texts


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8)) @ rng.normal(size=(8, 8))
    df = spark.createDataFrame([(row.tolist(),) for row in x.astype(np.float32)], "vector array<float>")
    res = fit_pca(df, "vector", k=4)
    xc = x.astype(np.float32).astype(np.float64)
    mean = xc.mean(axis=0)
    _, _, vt = np.linalg.svd(xc - mean, full_matrices=False)
    v = vt.T[:, :4]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(4)])
    assert np.allclose(res.mean, mean, atol=1e-6)
    assert np.allclose(res.components, v, atol=1e-5)
    proj = np.array([r.projected for r in project(df, res).collect()])
    assert np.allclose(proj, (xc - mean) @ v, atol=1e-4)
    doc = json.loads(res.to_json())
    assert len(doc["components"]) == 8 and all(len(r) == 1024 for r in doc["components"])


def test_read_texts(spark, tmp_path):
    p = tmp_path / "corpus.ndjson"
    p.write_text("\n".join([
        json.dumps({"text": "first"}), "not json", json.dumps({"text": 42}), json.dumps({"text": ""}),
        json.dumps({"other": "x"}), json.dumps({"text": "second", "n": 1}), json.dumps({"text": "third"}),
    ]) + "\n")
    assert [r.text for r in read_texts(spark, str(p)).collect()] == ["first", "second", "third"]
    assert read_texts(spark, str(p), 2).count() == 2


def test_fit_pca_on_corpus(spark, tmp_path):
    from quarry.operators.embedding import HashEmbedder
    from quarry.plans.pca_job import fit_pca_on_corpus

    p = tmp_path / "c.ndjson"
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]
    p.write_text("\n".join(json.dumps({"text": " ".join(words[(i + j) % 8] for j in range(i % 5 + 1))}) for i in range(60)))
    res, tid = fit_pca_on_corpus(spark, str(p), HashEmbedder(16), str(tmp_path / "model"), "pca-test", k=4)
    assert res.components.shape == (16, 4) and res.n == 60
    assert tid.startswith("pca-test@") and len(tid) == len("pca-test@") + 8
    import hashlib
    written = (next((tmp_path / "model").glob("part-*"))).read_text().strip()
    assert tid.endswith(hashlib.sha256(written.encode()).hexdigest()[:8])
