import pytest
from llm_cases import SMALL

from oracle.compare import compare, connect
from orderlens.llm.queries import QUERIES, SQL

# The columns each query must have, in any order and among others.
COLUMNS = {
    "op1_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op2_near_search": "query_id rank vec_id score",
    "op3_sanitise": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op4_exact_search": "query_id rank vec_id score",
    "op5_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op6_ngram_join": "doc_id n_shingles component_id",
    "op7_quality": "doc_id held_out score predicted",
    "op8_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op9_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op10_toxicity": "doc_id held_out score predicted",
    "op11_variants": "word form root n n_near form_n",
    "op13_merkle": "doc_id leaf subroot root proof_sha256 folded_root verified",
    "op12_slack_packing": "doc_id piece start length ids_crc32 sequence_id offset",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_statement(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    if name in SQL:
        assert compare(df, connect(SMALL), SQL[name]) is None
    else:
        assert df.count() >= 200 or name == "op2_near_search"


def test_pipeline_is_registered():
    assert set(QUERIES) == {*COLUMNS, "pipeline"}
