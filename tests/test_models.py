import numpy as np
import pytest

from cladeframe.functions import models as M
from cladeframe.functions.ratehet import gamma_rates

# How names, aliases and defaults are written out.
DEFAULTS = [
    ("DNA", "GTR+FC+G4m"), ("GTR", "GTR+FO"), ("TrN", "TN93+FO"), ("TrNef", "TN93ef"), ("TPM1", "K81"), ("TPM1uf", "K81uf+FO"),
    ("JC", "JC"), ("LG", "LG"), ("LG4X", "LG4X+R4"),
]


@pytest.mark.parametrize("text,canonical", DEFAULTS)
def test_names_and_defaults(text, canonical):
    m = M.parse_model(text)
    assert m.text() == canonical and M.parse_model(canonical).text() == canonical


def joined(values):
    return "/".join(f"{v:g}" for v in values)


RNG = np.random.default_rng(77)


@pytest.mark.parametrize("name,states,rates", [("GTR", 4, 6), ("HKY", 4, 2), ("TN93", 4, 3), ("SYM", 4, 6), ("K80", 4, 2)])
def test_user_rates_are_relative_to_the_last(name, states, rates):
    given = np.round(RNG.uniform(0.2, 6, rates), 3)
    m = M.parse_model(f"{name}{{{joined(given)}}}+FE")
    assert m.states == states and np.allclose(m.rates, given / given[m.symmetry[-1]])
    assert m.pair_rates()[-1] == 1 and M.parse_model(m.text()).text() == m.text()
    assert m.free_params() == 0


def test_categories_are_scaled_to_mean_one():
    rates, weights = np.array([3.0, 0.5, 1.7]), np.array([2.0, 5.0, 3.0])
    m = M.parse_model(f"JC+R{{{joined(rates)}}}{{{joined(weights)}}}")
    share = weights / weights.sum()
    assert m.ncat == 3 and np.allclose(m.cat_weights, share) and np.allclose(m.cat_rates, rates / (share @ rates))
    free = M.parse_model("JC+R5")
    assert np.isclose(free.cat_weights @ free.cat_rates, 1) and free.free_params() == 2 * 5 - 2


@pytest.mark.parametrize("parts,count", [
    (["GTR"], 5 + 3), (["GTR", "+FE"], 5), (["GTR", "+FC"], 5 + 3), (["GTR", "+FE", "+G6"], 5 + 1), (["GTR", "+FE", "+I"], 5 + 1), (["GTR", "+FE", "+I", "+G"], 5 + 2),
    (["HKY", "+FE"], 1), (["K80"], 1), (["JC"], 0), (["JC", "+G{0.8}"], 0), (["JC", "+IU{0.2}", "+G"], 1), (["JC", "+R3"], 4), (["BIN", "+FE"], 0), (["BIN", "+FO"], 1),
    (["MULTI9_MK"], 0), (["MULTI9_MK", "+FC"], 8), (["MULTI7_GTR", "+FE"], 20), (["MULTI7_GTR"], 20 + 6), (["MULTI4_USER121212", "+FE"], 1), (["GTJC"], 0), (["DNA012301"], 3 + 3),
])
def test_free_parameters_add_up(parts, count):
    m = M.parse_model("".join(parts))
    assert m.free_params() == count
    assert M.parse_model(m.text()).free_params() == count


def test_custom_symbols():
    m = M.parse_model("MULTI3_MK+M{xYz}{!-}")
    assert m.states == 3 and m.custom == ("xYz", "!-", True)
    assert M.parse_model("MULTI3_MK+Mi{xyz}").custom[2] is False
    assert M.parse_model(m.text()).custom == m.custom


def test_kappa():
    assert M.parse_model("HKY{1/3.25}").pair_rates().tolist() == [1, 3.25, 1, 1, 3.25, 1]


@pytest.mark.parametrize("text", ["GTR+X", "NOPE", "HKY+FU{0.5/0.5}", "GTR+FU{1.0/0/0/0}", "GTR{1/2}", "JC+IU{1.5}",
                                  "LG4X{1/2}", "MULTI5_USER12"])
def test_rejects(text):
    with pytest.raises(ValueError):
        M.parse_model(text)


def test_gamma_means():
    for a in (0.05, 0.3, 1.0, 5.0, 80.0):
        for med in (False, True):
            assert abs(gamma_rates(a, 4, med).mean() - 1) < 1e-6


def test_transition_is_jukes_cantor():
    p = M.transition(M.parse_model("JC"), 0.3)[0]
    same = 0.25 + 0.75 * np.exp(-0.4)
    assert np.allclose(np.diag(p), same) and np.allclose(p.sum(axis=1), 1)


def test_transition_derivative_and_stationarity():
    m = M.parse_model("GTR{1/2/3/4/5/1}+FU{0.1/0.2/0.3/0.4}+G4{0.5}+IU{0.2}")
    h = 1e-6
    num = (M.transition(m, 0.4 + h) - M.transition(m, 0.4 - h)) / (2 * h)
    assert np.allclose(num, M.transition(m, 0.4, 1), atol=1e-6)
    assert np.allclose(m.freqs @ M.transition(m, 0.7)[1], m.freqs)


def test_paml_matrix_file(tmp_path):
    f = tmp_path / "m.dat"
    low = list(range(1, 191))
    f.write_text(" ".join(map(str, low)) + "\n" + " ".join(["0.05"] * 20))
    m = M.parse_model(f"LG{{{f}}}+G")
    assert not m.needs_matrix and len(m.rates) == 190
    assert m.rates[0] == 1 and m.rates[1] == 2 and m.rates[19] == 3  # (0,1) (0,2) (1,2)


def test_free_params_and_checks():
    g = M.parse_model("GTR+G")
    assert M.total_free_params([g], 11) == 9 + 11
    assert M.total_free_params([g, g], 11, "scaled") == 18 + 12
    assert M.total_free_params([g, g], 11, "unlinked") == 18 + 22
    assert M.check_model(M.parse_model("HKY+FU{0.1/0.2/0.2/0.2}"))
    assert M.check_model(M.parse_model("LG4X+F"))
    assert M.check_model(M.parse_model("GTR+R4"), 2, "linked") and not M.check_model(M.parse_model("GTR+R4"), 2)
