"""Queries with every key treated as hot: the split joins must give the same rows."""

import pytest

from tallyrack.operators import skew
from tallyrack.plans import recommend
from tallyrack.sources import commands
from tools.compare import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES = ["recommend_cascade", "recommend_by_rows", "candidate_vectors", "session_buffer", "command_state", "stock_probe", "category_candidates"]


@pytest.fixture
def everything_hot(monkeypatch):
    def last_default(function, *values):
        kept = function.__defaults__[: -len(values)]
        monkeypatch.setattr(function, "__defaults__", (*kept, *values))

    last_default(skew.hot_keys, 5)
    last_default(skew.salted_join, 5, None)
    last_default(recommend.recommend, 5, None)
    last_default(commands.apply_commands, 5)


@pytest.mark.parametrize("name", QUERIES)
def test_hot_keys_change_nothing(spark, everything_hot, name):
    ok, note = compare(spark, connect(SF), name, SF)
    assert ok, note
