from pathlib import Path

import pytest

from termloom.llm.queries import LLM_ORACLES, LLM_QUERIES
from tests.oracle import agree

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_llm_query(spark, name):
    got, want = agree(spark, SF, LLM_QUERIES[name], LLM_ORACLES[name])
    assert got == want
