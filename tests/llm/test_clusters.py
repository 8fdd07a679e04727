import numpy as np
import pytest

from tessera.llm import clusters as C


def groups(seed=0, sizes=(300, 60, 40, 8), loners=25):
    rng = np.random.default_rng(seed)
    centres = rng.choice([40.0, 95.0, 150.0], (len(sizes), 3))
    kinds = rng.choice([0.0, 1.0, 2.0, 4.0], (len(sizes), 6))
    kinds[1], centres[1] = kinds[0], centres[0] + [55, -55, 55]  # like another in one of the fields
    rows, truth = [], {}
    for g, n in enumerate(sizes):
        ids = []
        for _ in range(n):
            k = len(rows) + 1
            e = kinds[g].copy()
            if rng.random() < 0.1:
                e[rng.integers(6)] -= 0.25
            rows.append((k, [float(x) for x in np.round(centres[g] + rng.normal(0, 2, 3))], [float(x) for x in e]))
            ids.append(k)
        truth |= {i: min(ids) for i in ids}
    for _ in range(loners):
        rows.append((len(rows) + 1, [float(x) for x in rng.uniform(20, 170, 3)], [float(x) for x in rng.uniform(0, 4, 6)]))
    return rows, truth


SCHEMA = "id long, a array<double>, b array<double>, cluster_id string, component int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


@pytest.mark.parametrize("seed", [0, 1])
def test_groups_and_loners(spark, seed):
    rows, truth = groups(seed)
    incomplete = [(9001, None, rows[0][2]), (9002, rows[0][1][:2], rows[0][2]), (9003, [1.0, None, 2.0], rows[0][2]), (9004, rows[0][1], None), (None, *rows[0][1:]), (9005, [1.0, float("nan"), 1.0], rows[0][2])]
    c = C.Clusters(table(spark, rows + rows[:50] + incomplete), "id", [("a", 3), ("b", 6)])
    assert {r["id"]: r["cluster_id"] for r in c.members().collect()} == truth
    told = {r["cluster_id"]: r for r in c.described(3).collect()}
    assert {k: r["size"] for k, r in told.items()} == {v: list(truth.values()).count(v) for v in set(truth.values())}
    assert all(len(r["typical"]) == 3 and all(truth[i] == k for i in r["typical"]) for k, r in told.items())


def test_many_copies_of_one_record(spark):
    rows, truth = groups()
    more = [(1000 + k, *rows[0][1:]) for k in range(500)]
    got = {r["id"]: r["cluster_id"] for r in C.Clusters(table(spark, rows + more), "id", [("a", 3), ("b", 6)]).members().collect()}
    assert got == truth | {k: truth[1] for k, *_ in more}


def test_small_and_empty_tables(spark):
    rows, _ = groups()
    for few in ([], rows[:1], [(k, *rows[0][1:]) for k in range(4)]):
        assert C.Clusters(table(spark, few), "id", [("a", 3), ("b", 6)]).members().count() == 0
    six = C.Clusters(table(spark, [(k, *rows[0][1:]) for k in range(6)]), "id", [("a", 3), ("b", 6)])
    assert six.members().count() in (0, 6)


def test_density_against_the_formula():
    rng = np.random.default_rng(0)
    cov = np.array([[0.5, 0.1], [0.1, 0.3]])
    m = C.Mixture(np.zeros(2), np.ones(2), np.eye(2), -3.0, 0.3, np.array([0.4, 0.3]), np.array([[0.0, 0.0], [4.0, 4.0]]), np.array([cov, cov * 2]))
    x = rng.normal(0, 2, (50, 2))
    want = np.exp(-3.0) * 0.3
    for w, mu, s in zip(m.weight, m.mean, m.cov):
        d = x - mu
        want = want + w * np.exp(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d)) / (2 * np.pi * np.sqrt(np.linalg.det(s)))
    seen = []
    for rows, near, r, log in m.shares(x):
        assert np.allclose(log, np.log(want[rows])) and np.allclose(r.sum(axis=1), 1) and r.shape == (len(rows), len(near) + 1)
        seen += rows.tolist()
    assert sorted(seen) == list(range(50))


def close(groups=30, members=20, seed=0):
    """Groups of which some are near each other on the scale of the table and far on their own."""
    rng = np.random.default_rng(seed)
    at, kinds = rng.integers(20, 180, (groups, 6)).astype(float), rng.choice([0.5, 1.0, 2.0, 4.0], (groups, 18))
    for g in (1, 3):
        at[g], kinds[g] = at[g - 1], kinds[g - 1]
        at[g, 0] += 32
    rows, truth = [], {}
    for g in range(groups):
        ids = list(range(g * members + 1, (g + 1) * members + 1))
        rows += [(k, (at[g] + rng.normal(0, 1, 6)).tolist(), kinds[g].tolist()) for k in ids]
        truth |= {k: ids[0] for k in ids}
    return rows, truth


def found(spark, rows, rules=C.MixtureRules()):
    return {r["id"]: r["cluster_id"] for r in C.Clusters(table(spark, rows), "id", [("a", 6), ("b", 18)], rules).members().collect()}


def test_close_groups_stay_apart_however_few_places_a_round_takes(spark):
    rows, truth = close()
    for rules in (C.MixtureRules(), C.MixtureRules(candidates=7), C.MixtureRules(radius=0.25)):
        assert found(spark, rows, rules) == truth
    with pytest.raises(RuntimeError, match="most_components"):
        found(spark, rows, C.MixtureRules(most_components=8))


def test_thousands_of_groups(spark):
    rows, truth = close(2200, 6, 3)
    assert found(spark, rows) == truth
