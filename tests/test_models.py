import random

import numpy as np
import pytest

from pairlocus.models import ancestry, fitting, graph, theory

U = 1.2e-8
ONE = """
time_units: generations
demes:
- {name: A, epochs: [{end_time: 2000, start_size: 8000}, {end_time: 0, start_size: 16000}]}
"""
SPLIT = """
time_units: years
generation_time: 25
demes:
- {name: root, epochs: [{end_time: 50000, start_size: 10000}]}
- {name: X, ancestors: [root], epochs: [{end_time: 0, start_size: 4000}]}
- {name: Y, ancestors: [root], epochs: [{end_time: 0, start_size: 20000}]}
"""
ISLANDS = """
time_units: generations
demes:
- {name: P, epochs: [{start_size: 5000}]}
- {name: Q, epochs: [{start_size: 5000}]}
migrations:
- {demes: [P, Q], rate: 1.0e-4}
"""


def test_one_deme_equals_the_moments():
    g = graph.read_graph(ONE)
    rs = [0.0, 1e-6, 1e-5, 1e-4, 1e-3, 0.1]
    h2, h = ancestry.pair_statistics(g, "A", "A", U, rs)
    want = [theory.moments([(2000.0, 8000.0), (0.0, 16000.0)], U, r) for r in rs]
    assert h == pytest.approx(want[0][0], rel=1e-9)
    assert h2 == pytest.approx([w[1] for w in want], rel=1e-7)


@pytest.mark.parametrize("rho", [0.0, 0.5, 3.0, 40.0])
def test_equilibrium_is_hudsons_form(rho):
    n = 10_000
    g = {"time_units": "generations", "demes": [{"name": "A", "epochs": [{"start_size": n}]}]}
    h2, h = ancestry.pair_statistics(g, "A", "A", U, [rho / (4 * n)])
    assert h2[0] / h**2 == pytest.approx(1 + (rho + 18) / (rho**2 + 13 * rho + 18), rel=1e-9)


def test_split_times_in_years():
    g = graph.read_graph(SPLIT)
    h2, h = ancestry.pair_statistics(g, "X", "Y", U, [1e-8, 0.1])
    assert h == pytest.approx(2 * U * (2000 + 2 * 10_000), rel=1e-9)
    assert h2[0] > h**2 and h2[1] == pytest.approx(h**2, rel=1e-3)
    _, within = ancestry.pair_statistics(g, "X", "X", U, [0.1])
    left = np.exp(-2000 / 8000)
    assert within == pytest.approx(2 * U * (8000 * (1 - left) + left * 20_000), rel=1e-9)


def test_islands_have_known_times():
    g = graph.read_graph(ISLANDS)
    _, within = ancestry.pair_statistics(g, "P", "P", U, [0.1])
    _, between = ancestry.pair_statistics(g, "P", "Q", U, [0.1])
    assert within == pytest.approx(2 * U * 20_000, rel=1e-9)
    assert between == pytest.approx(2 * U * (20_000 + 1 / (2 * 1e-4)), rel=1e-9)


def test_a_pulse_of_everything_is_a_split():
    pulse = SPLIT.replace("ancestors: [root], epochs: [{end_time: 0, start_size: 20000}]", "ancestors: [root], start_time: 50000, epochs: [{end_time: 0, start_size: 20000}]")
    pulse += "pulses:\n- {sources: [X], dest: Y, time: 25000, proportions: [1.0]}\n"
    rs = [1e-6, 1e-4]
    h2, h = ancestry.pair_statistics(graph.read_graph(pulse), "X", "Y", U, rs)
    left = np.exp(-1000 / 8000)
    assert h == pytest.approx(2 * U * (1000 + 8000 * (1 - left) + left * 20_000), rel=1e-9)
    assert (h2 > h**2).all()
    none = pulse.replace("[1.0]", "[0.0]")
    assert ancestry.pair_statistics(graph.read_graph(none), "X", "Y", U, rs)[0] == pytest.approx(
        ancestry.pair_statistics(graph.read_graph(SPLIT), "X", "Y", U, rs)[0], rel=1e-9
    )


def test_a_merger_of_two_ancestors():
    text = """
time_units: generations
demes:
- {name: root, epochs: [{end_time: 3000, start_size: 10000}]}
- {name: X, ancestors: [root], epochs: [{end_time: 0, start_size: 5000}]}
- {name: Y, ancestors: [root], epochs: [{end_time: 1000, start_size: 5000}]}
- {name: Z, ancestors: [X, Y], proportions: [0.25, 0.75], start_time: 1000, epochs: [{end_time: 0, start_size: 5000}]}
"""
    g = graph.read_graph(text)
    _, h = ancestry.pair_statistics(g, "X", "Z", U, [0.1])
    left = np.exp(-2000 / 10_000)
    same = 1000 + 10_000 * (1 - left) + left * 20_000
    assert h == pytest.approx(2 * U * (0.25 * same + 0.75 * (3000 + 20_000)), rel=1e-9)


def test_old_samples_have_shorter_branches():
    old = SPLIT.replace("name: Y, ancestors: [root], epochs: [{end_time: 0", "name: Y, ancestors: [root], epochs: [{end_time: 25000")
    h2, h = ancestry.pair_statistics(graph.read_graph(old), "X", "Y", U, [0.1])
    assert h == pytest.approx(U * (2 * (2000 + 20_000) - 1000), rel=1e-9)
    assert h2[0] == pytest.approx(h**2, rel=1e-3)
    _, within = ancestry.pair_statistics(graph.read_graph(old), "Y", "Y", U, [0.1])
    left = np.exp(-1000 / 40_000)
    assert within == pytest.approx(2 * U * (40_000 * (1 - left) + left * 20_000), rel=1e-9)


def test_growth_is_many_small_steps():
    text = "time_units: generations\ndemes:\n- {name: A, epochs: [{end_time: 1000, start_size: 8000}, {end_time: 0, start_size: 8000, end_size: 16000}]}\n"
    _, h = ancestry.pair_statistics(graph.read_graph(text), "A", "A", U, [0.1])
    fine = [(1000.0, 8000.0)] + [(1000.0 * (1 - (k + 1) / 400), 8000.0 * 2 ** ((k + 0.5) / 400)) for k in range(400)]
    assert h == pytest.approx(theory.moments(fine, U, 0.1)[0], rel=1e-5)


@pytest.mark.parametrize("rule", ["none", "trapezoid", "simpson"])
def test_expected_has_a_row_a_bin_and_one_for_h(rule):
    g = graph.read_graph(SPLIT)
    edges = [1e-6, 1e-5, 1e-4]
    out = ancestry.expected(g, ["X", "Y"], U, edges, rule)
    assert out.shape == (3, 3) and (out > 0).all() and (out[0] > out[1]).all()
    assert out[-1, 1] == pytest.approx(2 * U * 22_000)
    with pytest.raises(ValueError, match="no such rule"):
        ancestry.expected(g, ["X"], U, edges, "other")


PARAMETERS = """
parameters:
- {name: NX, lower_bound: 100, upper_bound: 50000, values: [demes: {X: {epochs: {0: start_size}}}]}
- {name: NY, values: [demes: {Y: {epochs: {0: start_size}}}]}
constraints:
- {params: [NY, NX], constraint: greater_than}
contraints: []
"""


def test_parameters_of_graphs():
    g, p = graph.read_graph(SPLIT), graph.read_parameters(PARAMETERS)
    assert p.names == ["NX", "NY"] and p.warnings == ["unknown key: contraints"]
    assert graph.get_values(g, p) == [4000, 20000]
    new = graph.with_values(g, p, [5000, 6000])
    assert graph.get_values(new, p) == [5000, 6000] and graph.get_values(g, p) == [4000, 20000]
    assert graph.allowed([200, 300], p) and not graph.allowed([300, 200], p) and not graph.allowed([50, 200], p)
    for seed in range(20):
        assert graph.allowed(graph.perturbed([4000, 20000], p, 1.0, random.Random(seed)), p)
    back = graph.read_graph(graph.write_graph(new, {"u": U}))
    assert back["metadata"]["opt_info"]["u"] == U


@pytest.mark.parametrize("text, said", [("demes:\n- {name: A, ancestors: [B], epochs: [{start_size: 1}]}", "ancestor"), ("demes:\n- {name: A}", "epochs"), ("demes:\n- {name: A, epochs: [{start_size: 1}]}\n- {name: A, epochs: [{start_size: 1}]}", "unique")])
def test_graphs_are_checked(text, said):
    with pytest.raises(ValueError, match=said):
        graph.read_graph(text)


@pytest.mark.parametrize("method", ["NelderMead", "BFGS", "LBFGSB", "Powell"])
def test_methods_find_the_minimum(spark, method):
    def bowl(p):
        return (p[0] / 3 - 1) ** 2 + 2 * (p[1] / 50 - 1) ** 2 + 0.3 * (p[0] / 3 - 1) * (p[1] / 50 - 1)

    starts = spark.createDataFrame([(0, [1.0, 20.0]), (1, [5.0, 90.0])], "start long, x0 array<double>")
    fits = fitting.fit_starts(starts, bowl, method)
    for r in fits.collect():
        assert r.x == pytest.approx([3.0, 50.0], rel=2e-3)
    assert fitting.best_fit(fits).count() == 1


def test_penalty_and_unknown_method(spark):
    f = fitting.penalised(sum, [0.0, 0.0], [1.0, 1.0], [(0, 1)])
    assert f([0.5, 0.25]) == 0.75 and f([0.25, 0.5]) == fitting.PENALTY and f([2.0, 0.5]) == fitting.PENALTY
    with pytest.raises(ValueError, match="method"):
        fitting.fit_starts(spark.createDataFrame([(0, [1.0])], "start long, x0 array<double>"), sum, "other")


def test_standard_errors_of_a_normal_mean(spark):
    rng = np.random.default_rng(1)
    reps = [rng.normal(5.0, 1.0, 50) for _ in range(40)]

    def ll(p, data):
        x = np.full(50, 5.0) if data is None else data
        return float(-((x - p[0]) ** 2).sum() / 2)

    assert fitting.uncertainties(spark, [5.0], ll, method="FIM") == pytest.approx([1 / np.sqrt(50)], rel=1e-3)
    own = fitting.uncertainties(spark, [5.0], ll, reps)
    assert own == pytest.approx([np.std([r.mean() for r in reps])], rel=0.2)


def test_likelihood_and_logistic_fit():
    x, mu = np.array([[1.0, 2.0], [3.0, 4.0]]), np.array([[0.0, 2.0], [3.0, 2.0]])
    eye = [np.eye(2)] * 2
    assert theory.log_likelihood(x, mu, eye, False) == -1.0 and theory.log_likelihood(x, mu, eye, True) == -5.0
    r = np.logspace(-6, -1, 20)
    h2 = 1e-6 + 1e-6 / (1 + np.exp(2.0 * (np.log10(r) + 4)))
    out = fitting.estimate_rho_theta(r, h2)
    assert out["theta"] == pytest.approx(1e-3, rel=1e-3) and out["rho_ne"] == pytest.approx(1 / (4e-4) / 1e0 * 1e0 * 1e0, rel=1e-2)
