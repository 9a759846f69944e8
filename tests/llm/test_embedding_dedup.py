import numpy as np

from corvine.llm import embedding_dedup as E
from corvine.session import table


def brute(rows, cosine=0.93):
    good = [(i, e, lab) for i, e, lab in rows if lab is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    links = {i: set() for i, _, _ in rows}
    for a, (i, e, lab) in enumerate(good):
        for j, f, m in good[:a]:
            if lab == m and len(e) == len(f) and np.dot(e, f) / np.linalg.norm(e) / np.linalg.norm(f) >= cosine:
                links[i].add(j)
                links[j].add(i)
    label = {i: i for i in links}
    for _ in links:
        for i, js in links.items():
            label[i] = min([label[i], *(label[j] for j in js)])
    return links, label


def near(rng, x, cosine):
    """A vector at that cosine of unit vector x."""
    away = rng.normal(size=len(x))
    away -= (away @ x) * x
    return cosine * x + np.sqrt(1 - cosine**2) * away / np.linalg.norm(away)


def planted(rng, n, dim=64):
    """Vectors of three labels: half of them around centres, half anywhere, each third with a partner at 0.935 to 0.95."""
    centres = rng.normal(size=(20, dim))
    rows = []
    for i in range(n):
        x = rng.normal(size=dim)
        x = x if i % 2 else centres[i % 20] + 0.6 * x
        x /= np.linalg.norm(x)
        rows.append((x, i % 3))
        if i % 3 == 0:
            rows.append((near(rng, x, rng.uniform(0.935, 0.95)) * rng.uniform(0.1, 9), i % 3))
    return [(i, x.astype(np.float32).tolist(), lab) for i, (x, lab) in enumerate(rows)]


def test_recall_of_planted_links_and_no_other(spark):
    rows = planted(np.random.default_rng(3), 4500)
    x, label = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(want, False)
    assert len(rows) >= 5000 and want.sum() >= 2800
    got = {r.vec_id: r for r in E.near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    found = np.array([got[i].n_links for i in range(len(rows))])
    assert (found <= want.sum(1)).all() and found.sum() >= 0.9 * want.sum()
    for i in range(len(rows)):  # pairs are met whole or not at all, and components hold linked vectors only
        if want[i].sum() == 1 and found[i]:
            j = int(np.flatnonzero(want[i])[0])
            if want[j].sum() == 1:
                assert got[i].component_id == min(i, j)
    assert all(r.component_id == i for i, r in got.items() if not want[i].any())


def test_given_table(spark, sf):
    df = table(spark, sf, "embeddings")
    rows = [(r.vec_id, list(map(float, r.embedding)), r.label) for r in df.collect()]
    links, label = brute(rows)
    got = {r.vec_id: r for r in E.near_dedup(df).collect()}
    assert all(got[i].n_links <= len(js) for i, js in links.items())
    assert sum(got[i].component_id == c for i, c in label.items()) >= 0.95 * len(label)


def test_one_label_and_many_lengths(spark):
    rng = np.random.default_rng(9)
    rows = []
    for dim in range(1, 40):
        for _ in range(6):
            x = rng.normal(size=dim)
            rows += [x, near(rng, x / np.linalg.norm(x), 0.97) if dim > 1 else 2 * x]
    rows = [(i, x.tolist(), 1) for i, x in enumerate(rows)]
    links, _ = brute(rows)
    got = {r.vec_id: r.n_links for r in E.near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), recall=1.0).collect()}
    assert all(got[i] <= len(js) for i, js in links.items()) and sum(got.values()) >= 0.95 * sum(map(len, links.values()))


def test_centres_in_two_levels():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 6))
    many, few = E.k_means(x, 300), E.k_means(x, 100)
    assert 250 <= len(many) <= 350
    assert E.distances(x, many).min(1).mean() < E.distances(x, few).min(1).mean()


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], 1), (4, [0.0, 0.0], 0), (5, None, 0), (6, [float("nan"), 1.0], 0), (7, [1.0, 0.0], None), (8, [1.0, None], 0), (9, [1.0, 0.01, 0.0], 0), (10, [1.0, 0.0], 0), (10, [1.0, 0.0], 0), (None, [0.0, 1.0], 0), (11, [], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, rep string")
    got = sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in E.near_dedup(df).collect())
    want = [(-1, 0, -1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 0, 3, True), *((i, 0, i, True) for i in (4, 5, 6, 7, 8, 9)), (10, 3, 1, False), (10, 3, 1, False), (11, 0, 11, True)]
    assert got == want
    assert E.near_dedup(df.limit(0)).collect() == []


def test_hot_cell_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    base = rng.normal(size=8)
    rows = [(i, (base + rng.normal(scale=0.15, size=8)).tolist(), 1) for i in range(150)]
    whole = E.deal
    monkeypatch.setattr(E, "deal", lambda m, g, k, w, most, much, tasks: whole(m, g, k, w, 20, 10**9, 3))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    links, _ = brute(rows)
    got = {r.vec_id: r.n_links for r in E.near_dedup(df, recall=1.0).collect()}
    assert all(got[i] <= len(js) for i, js in links.items())
    assert sum(got.values()) >= 0.97 * sum(map(len, links.values()))


def test_multi_sequence_order():
    rng = np.random.default_rng(1)
    x = E.unit(rng.normal(size=(50, 8)))
    g = E.Grid(x, 6, 0.93, 0.95)
    d = E.distances(x[:, :4], g.books[0])[:, :, None] + E.distances(x[:, 4:], g.books[1])[:, None, :]
    want = np.sort(d.reshape(50, -1), 1)[:, :9]
    assert np.allclose(np.take_along_axis(d.reshape(50, -1), g.traverse(x, 9), 1), want)


def test_null_and_repeated_ids_join_nothing(spark):
    x, y, z = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    off = lambda v: [a + 0.1 * b for a, b in zip(v, [0.3, 0.5, 0.7], strict=True)]
    rows = [(5, x), (None, off(x)), (9, y), (None, off(y)), (None, z), (None, off(z)), (7, [-1.0, 0.0, 0.0]), (7, [0.0, -1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_dedup(df, recall=1.0).collect()]
    count = lambda *r: got.count(r)
    assert count(5, 1, 5, True) == count(9, 1, 9, True) == count(None, 1, 5, False) == count(None, 1, 9, False) == 1
    assert count(None, 1, None, True) == count(None, 1, None, False) == 1 and count(7, 0, 7, True) == 2
