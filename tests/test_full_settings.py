"""Model queries run the full search of the workflow they cover."""

import os

import pytest

from __spark_entry__ import SMOKE_DIR, queries
from gridspark.catalog.models import CONFIG
from gridspark.models.validation import candidate_penalties

pytestmark = pytest.mark.skipif(not os.path.isdir(SMOKE_DIR), reason="test tables not present")


def test_settings():
    assert (CONFIG.outer_n_splits, CONFIG.inner_n_splits, CONFIG.n_iter) == (10, 5, 20)


def test_search_covers_ten_folds(spark):
    rows = queries()["M4_random_search_c"](spark, SMOKE_DIR).collect()
    assert sorted(r.outer for r in rows) == list(range(10)) and {r.c for r in rows} <= set(candidate_penalties(20))
