"""Language identification, vector codes and whitening against plain versions, and on odd rows."""

import hashlib
import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallybox.llm import cover_tree, language_id, vector_codes, vectors, whitening

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id bigint, embedding array<float>, label int, id string, v double, w int, component int"


def spread(n, dims, seed, groups=5):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 1, (groups, dims))
    return (centres[r.integers(0, groups, n)] + r.normal(0, 0.2, (n, dims))).astype(np.float32)


def frame(spark, vecs, labels=None, parts=3):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], labels[i] if labels else i % 3, "x", None, 1, 2) for i, v in enumerate(vecs)]
    return spark.createDataFrame(rows, VECTORS).repartition(parts)


# ---- cover trees


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.integers(1, 8), st.sampled_from([2, 50, 10_000, 2**40]), st.integers(1, 20), st.integers(0, 10_000))
def test_tree_keeps_its_rules_and_assigns_as_the_plain_loop(n, dims, size, k, seed):
    r = np.random.default_rng(seed)
    points = cover_tree.exact(r.integers(-size, size + 1, (n, dims)))
    order, nodes = cover_tree.build(points)
    assert sorted(order.tolist()) == list(range(n))
    for x in nodes:
        run = order[x["start"] : x["stop"]]
        assert x["centre"] in run
        far = max(float(d) for d in cover_tree.squared(points[run], points[x["centre"]]))
        assert math.isclose(x["radius"], far**0.5, rel_tol=1e-9, abs_tol=1e-9)
        below = nodes[x["child"] : x["child"] + x["children"]]
        if len(below):
            assert below["start"][0] == x["start"] and below["stop"][-1] == x["stop"] and (below["start"][1:] == below["stop"][:-1]).all()
            assert below["centre"][0] == x["centre"]
            assert (below["radius"] <= x["radius"] / cover_tree.BASE * (1 + 1e-9)).all()
            for i, c in enumerate(below["centre"]):
                apart = [float(cover_tree.squared(points[c], points[o])) ** 0.5 for o in below["centre"][:i]]
                assert all(a > x["radius"] / cover_tree.BASE * (1 - 1e-9) for a in apart)
    entries = points[r.integers(0, n, k)] + r.integers(-2, 3, (k, dims))
    code, sums, counts, _ = cover_tree.assign(points, order, nodes, entries)
    far = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(p, e, strict=True)) for e in entries] for p in points], object)
    want = far.argmin(axis=1).astype(int)
    assert (code == want).all() and (counts == np.bincount(want, minlength=k)).all()
    assert all([int(s) for s in sums[j]] == [sum(int(points[i][c]) for i in np.flatnonzero(want == j)) for c in range(dims)] for j in range(k))


def test_tight_groups_go_whole():
    points = np.concatenate([np.random.default_rng(1).integers(0, 20, (500, 4)) + 10_000 * g for g in range(4)])
    order, nodes = cover_tree.build(points)
    *_, compared = cover_tree.assign(points, order, nodes, np.array([[10 + 10_000 * g] * 4 for g in range(4)]))
    assert compared == 0


# ---- codes


def plain_codes(rows, parts, entries, rounds, scale):
    """rows: (id, vector, label) that can be taken, of one length."""
    x = {k: [math.floor(scale * float(c)) for c in v] for k, (_, v, _) in enumerate(rows)}
    d = len(rows[0][1]) // parts
    cut = lambda k, p: x[k][p * d : (p + 1) * d]
    first = sorted(x, key=lambda k: (rows[k][0], list(rows[k][1])))[:entries]
    books = [[cut(k, p) for k in first] for p in range(parts)]
    dist = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))
    near = lambda k, p: min(range(len(books[p])), key=lambda j: (dist(cut(k, p), books[p][j]), j))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for k in x:
                own.setdefault(near(k, p), []).append(cut(k, p))
            for j, m in own.items():
                books[p][j] = [sum(c) // len(m) for c in zip(*m, strict=True)]
    code = {k: [near(k, p) for p in range(parts)] for k in x}
    error = {k: sum(dist(cut(k, p), books[p][code[k][p]]) for p in range(parts)) for k in x}
    label = {}
    for k in x:
        label[rows[k][2]] = label.get(rows[k][2], 0) + error[k]
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted((rows[k][0], "".join(f"{c:02x}" for c in code[k]), error[k], label[rows[k][2]], digest) for k in x)


@pytest.mark.parametrize(("n", "parts", "entries", "block"), [(150, 4, 16, 40), (9, 2, 16, 8_192), (200, 1, 5, 64)])
def test_codes_equal_the_plain_rounds(spark, n, parts, entries, block):
    vecs = [*spread(n, 8, n), *spread(4, 8, 1)[[0, 0, 0, 1]]]
    labels = [None if i % 5 == 0 else i % 3 for i in range(len(vecs))]
    got = vector_codes.vector_codes(frame(spark, vecs, labels), parts=parts, entries=entries, rounds=3, block=block).collect()
    assert sorted(map(tuple, got)) == plain_codes([(i, v, labels[i]) for i, v in enumerate(vecs)], parts, entries, 3, vector_codes.SCALE)


def test_codes_drop_what_has_no_numbers_and_take_large_ones(spark):
    ok = [*spread(30, 8, 3), [1e6, -1e6, 3e7, 0, 0, 0, 0, 1], [2e12] * 8]
    bad = [None, [], [1.0] * 7, [None] * 8, [float("nan")] * 8, [float("inf")] + [0.0] * 7, [1e30] * 8]
    got = vector_codes.vector_codes(frame(spark, [*ok, *bad]), parts=4, rounds=2, block=16).collect()
    want = plain_codes([(i, np.float32(v), i % 3) for i, v in enumerate(ok)], 4, 16, 2, vector_codes.SCALE)
    fits = lambda e: e if e < 2**63 else None
    hidden = {i % 3 for i, (_, _, e, _, _) in enumerate(want) if e >= 2**63}  # a null error isn't added
    got, want = sorted(map(tuple, got)), [(*w[:2], fits(w[2]), w[3], w[4]) for w in want]
    assert [(*g[:3], g[4]) for g in got] == [(*w[:3], w[4]) for w in want]
    assert [g[3] for g in got if g[0] % 3 not in hidden] == [w[3] for w in want if w[0] % 3 not in hidden]


def test_codes_equal_their_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    df = vector_codes.vector_codes(spark.read.parquet(f"{SF}/embeddings.parquet"), block=100)
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(vector_codes.ORACLE).fetchall())


def test_one_round_moves_entries_to_rounded_down_means(spark):
    seen = []
    vector_codes.vector_codes(frame(spark, [[-1.0], [-1.0 - 1 / 4096], [5.0]]), parts=1, entries=2, rounds=1, watch=seen.append)
    assert seen == [[[[-4096], [-4097]]], [[[(-4096 + 20480) // 2], [-4097]]]]


# ---- whitening


def plain_whitening(vecs, most=8):
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vecs], object)
    n, s = len(x), x.sum(axis=0)
    y = n * x - s
    v = np.array((y.T @ y) / n**3, float)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    return (y**2).sum(axis=1), (y / n).astype(float) @ u / np.sqrt(e), e / np.trace(v)


@pytest.mark.parametrize(("n", "dims"), [(80, 12), (500, 5)])
def test_whitening_equals_numpy(spark, n, dims):
    vecs = spread(n, dims, n)
    far, w, share = plain_whitening(vecs)
    rows = whitening.whitened(frame(spark, vecs)).collect()
    assert len(rows) == n * min(8, dims)
    by = {}
    for r in rows:
        assert r["deviation"] == far[r["vec_id"]] and r["n"] == n and r["identity_error"] < 1e-9
        assert math.isclose(r["explained"], share[r["component"] - 1], rel_tol=1e-9)
        by.setdefault(r["component"], {})[r["vec_id"]] = r["whitened"]
    for c, own in by.items():
        got = np.array([own[i] for i in range(n)])
        assert min(np.abs(got - w[:, c - 1]).max(), np.abs(got + w[:, c - 1]).max()) < 1e-7


def test_polarisation_gives_exact_products():
    r = np.random.default_rng(4)
    for size in (10, 10**6, 2**45):
        z = r.integers(-size, size, (40, 6))
        sums = [int(v) for v in whitening._squares(z)]
        rest = [int(v) for v in z.sum(axis=0)]
        y = z.astype(object) * 40 - np.array(rest, object)
        assert np.allclose(whitening.covariance(40, sums, rest), np.array((y.T @ y) / 40**3, float), rtol=1e-14)


def test_whitening_of_odd_tables(spark):
    ok = spread(20, 4, 9)
    bad = [None, [], [1.0] * 3, [None] * 4, [float("nan")] * 4, [float("-inf")] * 4, [1e30] * 4]
    got = whitening.whitened(frame(spark, [*ok, *bad]))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "distance"]
    assert {r["n"] for r in got.collect()} == {20} and got.count() == 80
    assert whitening.whitened(frame(spark, bad[:2])).count() == 0
    assert whitening.whitened(frame(spark, [[1.0, 2.0]] * 3)).count() == 0  # no variance
    two = whitening.whitened(frame(spark, [[1.0, 2.0], [2.0, 2.0], [2.0, 2.0]])).collect()
    assert sorted(r["component"] for r in two) == [1, 1, 1] and {r["explained"] for r in two} == {1.0}
    far = whitening.whitened(frame(spark, [[1e9, 0.0], [-1e9, 0.0]])).collect()
    assert {abs(round(r["whitened"], 9)) for r in far} == {1.0} and {r["deviation"] for r in far} == {None}


def test_dropped_rows_of_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0, 2.0],), ([1.0],), ([float("nan"), 1.0],), (None,)], "v array<double>")
    kept, dims = vectors.usable(df, "v", 4096)
    assert dims == 2 and kept.count() == 2
    assert vectors.usable(df, "v", 4096, 3) [1] == 0


# ---- languages


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def net(docs):
    return language_id.fit(docs)


def test_held_out_languages_are_found(spark, docs, net):
    rows = language_id.languages(docs, net).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in rows if r["held_out"]]
    assert len(out) > 30 and sum(r["lang"] == r["lang_pred"] for r in out) >= 0.98 * len(out)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_only_rows_that_are_not_held_out_teach(docs, net):
    wrong = docs.withColumn("lang", F.when(language_id.held_out(), "xx").otherwise(F.col("lang")))
    again = language_id.fit(wrong)
    assert again.langs == net.langs and np.array_equal(again.filters, net.filters)


def test_every_window_of_a_text_speaks(net):
    english, french = "the that and hathe " * 40, "le que de la éan eux " * 40
    for text in (english, french, english + french * 3, "", "a", "x" * 124, "x" * 125, "é" * 5_000):
        data = np.frombuffer(text.encode(), np.uint8)
        total, weight = 0.0, 0
        for at in range(0, max(1, len(data) - language_id.WIDEST + 1), language_id.STEP):
            part = data[at : at + language_id.WINDOW]
            w = np.zeros((1, language_id.WINDOW), np.uint8)
            w[0, : len(part)] = part
            seen = [net.table[w[0, i : i + language_id.WIDEST]].ravel() @ net.filters for i in range(language_id.STEP)]
            z = np.maximum(np.max(seen, axis=0) + net.bias, 0) @ net.out + net.base
            total, weight = total + (z - np.log(np.exp(z - z.max()).sum()) - z.max()) * max(1, len(part)), weight + max(1, len(part))
        p = np.exp(total / weight)
        p /= p.sum()
        (best,), (score,) = language_id.predict(pa.array([text]), net, 3)
        assert best == p.argmax() and math.isclose(score, p.max(), rel_tol=1e-3)


def test_gradient_step_lowers_the_loss():
    r = np.random.default_rng(0)
    windows = np.concatenate([r.integers(97, 105, (200, 128)), r.integers(105, 113, (200, 128))]).astype(np.uint8)
    y = np.repeat([0, 1], 200)
    net = language_id.train(windows, y, ["a", "b"], steps=20)
    assert (net.log_probabilities(windows).argmax(axis=1) == y).all()


def test_odd_texts(spark, net):
    schema = "doc_id bigint, text string, lang string, source string, score double, held_out boolean, lang_pred string, letter string"
    texts = [None, "", "  \n", "123 -- !!", "the that and of", "THE THAT AND OF", "le que é", "the that and of " * 20_000]
    df = spark.createDataFrame([(i, t, "en", None, None, None, None, None) for i, t in enumerate(texts)] + [(None, "the that", "en", None, None, None, None, None)], schema)
    got = {r["doc_id"]: r for r in language_id.languages(df, net).collect()}
    assert [got[i]["lang_pred"] for i in range(4)] == ["und"] * 4 and [got[i]["score"] for i in range(4)] == [0.0] * 4
    assert got[4]["lang_pred"] == got[5]["lang_pred"] == got[7]["lang_pred"] == "en" and got[4]["score"] == got[5]["score"]
    assert got[None]["held_out"] is False
    assert language_id.fit(df.where("doc_id < 4")) is None
    assert {r["lang_pred"] for r in language_id.languages(df, None).collect()} == {"und"}
    assert language_id.identified(df.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language_id.identified(df).collect()} == {"und", "en"}
