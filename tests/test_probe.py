"""Class scores by blocks and the trained probe against plain numpy, with edge cases."""

import numpy as np
import pytest

from gradebook.operators import probe as pb

ROWS = "id long, label int, embedding array<float>, part string"


def _vectors(n=60, seed=2):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        label = int(rng.integers(0, 3)) * 5
        v = rng.normal(size=4) + np.eye(4)[label // 5] * 1.5
        out.append((i, label, [float(np.float32(x)) for x in v],
                    ["train", "train", "validation", "test"][i % 4]))
    return out


@pytest.fixture(scope="module")
def odd(spark):
    """Vectors with a NULL, NULL vectors, NULL labels, repeated rows beside the clean ones."""
    rows = _vectors()
    rows += [(100, 0, None, "train"), (101, 0, [1.0, None, 0.0, 0.0], "train"),
             (102, None, [1.0, 0.0, 0.0, 0.0], "validation"), (103, 77, [0.0, 9.0, 0.0, 0.0], "test")]
    return spark.createDataFrame(rows, ROWS)


@pytest.mark.parametrize("chunk, block", [(1024, 256), (7, 2), (1, 1)])
def test_class_scores(spark, odd, monkeypatch, chunk, block):
    monkeypatch.setattr(pb, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(pb, "BLOCK_CLASSES", block)
    cents = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0]), (5, [1.0, 0.0, 0.0, 0.0]),
                                   (10, [0.0, 0.0, 1.0, 0.0])], "label int, centroid array<double>")
    c = np.array([[1.0, 0, 0, 0], [1.0, 0, 0, 0], [0, 0, 1.0, 0]])
    got = {r.id: r for r in pb.class_scores(odd, cents, "id").collect()}
    assert set(got) == {*range(60), 102, 103}
    for i, label, v, _ in _vectors():
        z = -((np.array(v) - c) ** 2).sum(1)
        assert got[i].prediction == (0 if z[0] >= z[2] else 10)  # ties: the smallest class
        assert got[i].log_sum == pytest.approx(np.log(np.exp(z).sum()))
        assert got[i].target_logit == pytest.approx(z[label // 5])
    assert got[102].target_logit is None and got[103].target_logit is None
    assert pb.nearest_centroid(odd, cents, "id").where("prediction is null").count() == 2
    assert pb.class_scores(odd.limit(0), cents, "id").count() == 0
    assert pb.class_scores(odd, cents.limit(0), "id").count() == 0


def _train(rows, epochs, rate):
    x = {p: np.array([[*r[2], 1.0] for r in rows if r[3] == p]) for p in
         ("train", "validation", "test")}
    y = {p: np.array([r[1] // 5 for r in rows if r[3] == p]) for p in x}
    w, out = np.zeros((3, 5)), []

    def softmax(z):
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)
    for _ in range(epochs):
        p = softmax(x["train"] @ w.T)
        w = w - rate * (p - np.eye(3)[y["train"]]).T @ x["train"] / len(p)
        p = softmax(x["train"] @ w.T)
        out.append([-np.log(p[np.arange(len(p)), y["train"]]).mean()] + [
            ((x[k] @ w.T).argmax(1) == y[k]).mean() for k in x])
    return out


def test_trained_probe(spark):
    rows = _vectors()
    want = _train(rows, 5, 0.7)
    got = pb.trained_probe(spark.createDataFrame(rows, ROWS), 5, 0.7).orderBy("epoch").collect()
    for r, w in zip(got, want, strict=True):
        assert [r.train_loss, r.train_accuracy, r.val_accuracy, r.test_accuracy] == pytest.approx(w)
    best = [w[2] for w in want]
    assert [r.epoch for r in got if r.is_best] == [best.index(max(best)) + 1]


def test_trained_probe_edges(spark, odd):
    got = pb.trained_probe(odd, 1, 0.5).first()
    assert got.train_accuracy == pytest.approx(_train(_vectors(), 1, 0.5)[0][1])
    assert pb.trained_probe(odd.limit(0), 3, 0.5).count() == 0
    only = pb.trained_probe(odd.where("part = 'train'"), 2, 0.5).collect()
    assert [r.val_accuracy for r in only] == [None, None] and not any(r.is_best for r in only)


@pytest.mark.parametrize("heads, mlp", [(1, False), (4, True), (2, True)])
def test_attentive_pooler_against_numpy(spark, heads, mlp):
    from math import erf

    from gradebook.operators import pooling as pl
    rng = np.random.default_rng(heads)
    d, m = 8, 12
    w = pl.PoolerWeights(
        rng.normal(size=d), *(rng.normal(size=(d, d)) for _ in range(3)), heads,
        rng.normal(size=(m, d)) if mlp else None, rng.normal(size=(d, m)) if mlp else None,
        {"k": rng.normal(size=d), "norm2": rng.normal(size=d), "fc2": rng.normal(size=d)},
        {"norm1": rng.normal(size=d)})
    rows = [(g, rng.normal(size=d).tolist()) for g in (1, 1, 1, 2, None, None) for _ in range(7)]
    odd = [(1, None), (2, [1.0] * 7), (2, [None] * 8), (9, None)]
    df = spark.createDataFrame(rows + odd, "g long, vec array<double>").repartition(5)
    got = {r.g: r.pooled for r in pl.attentive_pooler(df, "g", "vec", w).collect()}

    def norm(name, x):
        if not mlp:
            return x
        x = (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + 1e-5)
        return x * w.scale.get(name, 1.0) + w.bias.get(name, 0.0)
    assert set(got) == {1, 2, None}
    for g in got:
        x = norm("norm1", np.array([v for k, v in rows if k == g]))
        k, v, q = x @ w.k.T + w.bias["k"], x @ w.v.T, w.query @ w.q.T
        y = np.zeros(d)
        for h in range(heads):
            s = slice(h * d // heads, (h + 1) * d // heads)
            score = np.exp(k[:, s] @ q[s] * (d // heads) ** -0.5)
            y[s] = score / score.sum() @ v[:, s]
        if mlp:
            y = w.query + y
            z = norm("norm2", y) @ w.fc1.T
            z = np.array([a * 0.5 * (1 + erf(a / 2 ** 0.5)) for a in z])
            y = y + z @ w.fc2.T + w.bias["fc2"]
        assert got[g] == pytest.approx(y.tolist())
    assert pl.attentive_pooler(df.limit(0), "g", "vec", w).count() == 0
