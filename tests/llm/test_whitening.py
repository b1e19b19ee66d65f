import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm.whitening import Centre, eigenvalues_below, leading_components, tridiagonal, whitened_embeddings
from riskloom.operators.graph import Graph
from riskloom.operators.iterative import spectral_embedding


def covariance(random, spectrum):
    basis = np.linalg.qr(random.normal(size=(len(spectrum), len(spectrum))))[0]
    return (basis * spectrum) @ basis.T


@pytest.mark.parametrize(
    "spectrum",
    [
        np.linspace(1, 50, 40),
        np.r_[np.full(10, 3.0), np.full(10, 1.0)],  # equal eigenvalues
        1 + np.arange(30) * 1e-13,  # a cluster
        np.r_[1e9, 1e3, 1.0, 1e-3],
        np.r_[5.0],
        np.r_[2.0, 1.0],
    ],
)
def test_components_are_eigenvectors(spectrum):
    matrix = covariance(np.random.default_rng(3), spectrum)
    matrix = (matrix + matrix.T) / 2
    values, vectors = leading_components(matrix, 32)
    wanted = np.linalg.eigvalsh(matrix)[::-1][: len(values)]
    size = np.abs(matrix).max()
    assert len(values) == min(32, len(spectrum))
    assert np.allclose(values, wanted, rtol=0, atol=1e-13 * len(matrix) * size)
    assert np.abs(matrix @ vectors - vectors * values).max() < 1e-13 * len(matrix) * size
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12


def test_diagonal_and_zero_matrices():
    values, vectors = leading_components(np.diag([1.0, 4.0, 4.0, 2.0]), 3)
    assert np.allclose(values, [4, 4, 2]) and np.allclose(vectors.T @ vectors, np.eye(3))
    assert len(leading_components(np.zeros((5, 5)), 3)[0]) == 0
    assert len(leading_components(np.outer([1.0, 2, 3], [1.0, 2, 3]), 3)[0]) == 1


def test_reflections_and_counts():
    matrix = covariance(np.random.default_rng(1), np.arange(1.0, 13))
    diagonal, off, _ = tridiagonal(matrix)
    band = np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1)
    assert np.allclose(np.linalg.eigvalsh(band), np.arange(1, 13))
    assert eigenvalues_below(diagonal, off**2, np.array([0.5, 3.5, 12.5])).tolist() == [0, 3, 12]


def test_deviations_are_exact_beyond_64_bits():
    x = np.array([[3, -5], [4, 2]], np.int64)
    for n, sums in ((7, (10, 20)), (10**13, (10**15, -(10**14)))):
        want = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
        assert [int(d) for d in Centre(n, sums).deviations(x)] == want


def plain(vectors, components, scale, offset):
    x = np.floor(scale * np.array(vectors, np.float64)) + offset
    away = x - x.mean(axis=0)
    values, basis = np.linalg.eigh(away.T @ away / len(x))
    values, basis = values[::-1][:components], basis[:, ::-1][:, :components]
    return away @ basis / np.sqrt(values), values / np.trace(away.T @ away / len(x)), [int(((len(x) * r - x.sum(axis=0)) ** 2).sum()) for r in x]


def test_against_plain_version(spark):
    random = np.random.default_rng(5)
    vectors = (random.normal(size=(300, 6)) @ random.normal(size=(6, 6))).tolist()
    vectors += vectors[:3]  # repeated rows
    odd = [None, [1.0] * 5 + [None], [float("nan")] * 6, [float("inf")] + [0.0] * 5, [], [1.0]]
    rows = [(i, v, "x", 1) for i, v in enumerate(vectors)] + [(1000 + i, v, None, None) for i, v in enumerate(odd)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, _key string, n int").repartition(5)
    found = whitened_embeddings(frame, key="vec_id", vector="embedding", components=4, scale=64, offset=1_000_000).orderBy("vec_id").collect()
    coordinates, explained, deviations = plain(vectors, 4, 64, 1_000_000)
    assert [r["vec_id"] for r in found] == list(range(303)) and {r["n"] for r in found} == {303}
    got = np.array([r["whitened"] for r in found])
    signs = np.sign((got * coordinates).sum(axis=0))
    assert np.allclose(got * signs, coordinates, atol=1e-9)
    assert np.allclose(found[0]["explained"], explained, rtol=1e-9)
    assert [int(r["deviation"]) for r in found] == deviations
    assert max(r["identity_error"] for r in found) < 1e-10


def test_account_embeddings_of_the_graph(spark):
    """The project's own embedding: columns embedding_0.., text account ids."""
    random = np.random.default_rng(2)
    edges = {(f"A{a}", f"A{b}") for a, b in random.integers(0, 40, (160, 2)) if a != b}
    vertices = spark.createDataFrame([(f"A{i}",) for i in range(40)], "node_id string")
    rows = [(a, b, 1, 10.0, 0, 0) for a, b in edges]
    graph = Graph(vertices, spark.createDataFrame(rows, "src string, dst string, edge_count bigint, total_amount double, first_time bigint, last_time bigint"))
    embedding = spectral_embedding(graph, dimensions=4)
    found = whitened_embeddings(embedding, components=3).orderBy("node_id").collect()
    vectors = [[r[f"embedding_{i}"] for i in range(4)] for r in embedding.orderBy("node_id").collect()]
    coordinates, _, _ = plain(vectors, 3, 2.0**20, 0)
    assert [r["node_id"] for r in found] == sorted(f"A{i}" for i in range(40))
    assert np.allclose(np.abs([r["whitened"] for r in found]), np.abs(coordinates), atol=1e-4)


def test_few_rows(spark):
    frame = spark.createDataFrame([(None, [1.0, 2.0]), (1, [1.0, 2.0])], "node_id bigint, e array<double>")
    found = whitened_embeddings(frame, vector="e").collect()
    assert [r["whitened"] for r in found] == [[], []] and {int(r["deviation"]) for r in found} == {0}
    assert whitened_embeddings(frame.limit(0), vector="e").count() == 0
    assert whitened_embeddings(frame.withColumn("e", F.lit(None).cast("array<double>")), vector="e").count() == 0
