"""The fit queries run the operators' own budget: default settings, the whole grid, the number of samples there are."""

import os

import pytest

from cisweave.functions.boosting import Settings
from cisweave.plans import catalog, fit, pipeline, tuning

FOLDER = "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def spy(monkeypatch, module, name, calls):
    real = getattr(module, name)

    def call(*args, **options):
        calls.append((args, options))
        return real(*args, **options)

    monkeypatch.setattr(module, name, call)


@pytest.mark.parametrize("name, module, operator", [("run_windows", fit, "fit_windows"), ("run_cpgs", pipeline, "run_windows")])
def test_default_settings(spark, monkeypatch, name, module, operator):
    fits, formulas = [], []
    spy(monkeypatch, module, operator, fits)
    spy(monkeypatch, fit, "with_fixed_penalties", formulas)
    assert catalog.QUERIES[name](spark, FOLDER).where("status = 'ok'").count() > 0
    assert fits[0][1].get("settings", Settings()) == Settings()
    assert [args[2] for args, _ in formulas] == ([2_000] if name == "run_cpgs" else [])


def test_whole_grid(spark, monkeypatch):
    scored = []
    spy(monkeypatch, tuning, "score_combos", scored)
    best = catalog.QUERIES["global_tune"](spark, FOLDER).collect()
    (_, grid, _, _, n, settings), _ = scored[0]
    assert grid.count() == 81 and n == 2_000 and settings == Settings()
    assert len(best) == 1 and all(best[0][k] in v for k, v in tuning.GRID_WINDOWS.items()) and best[0].score > 0
