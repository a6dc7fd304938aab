import os

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", ["op1_chat_format", "op6_warc_fixity", "op8_line_dedup", "op9_source_mix", "op11_vector_codes", "op13_prefix_trie"])
def test_like_sql(spark, name):
    from embera.llm.queries import ORACLES, QUERIES
    from tests.sql_check import differs

    assert differs(QUERIES[name](spark, DATA), ORACLES[name], DATA) == ""
