"""Names and types of the queries' results, and their SQL where there is one."""

from pathlib import Path

import pytest

from test_oracle import SF, compare

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables")

SCHEMAS = {
    "op1_": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op2_": "doc_id bigint, text string, n_chars bigint, n_removed bigint",
    "op3_": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op4_": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op5_": "page_id bigint, url string, text string, n_chars bigint",
    "op6_": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7_": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op8_": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9_": "doc_id bigint, n_tokens bigint, bucket int, boundary bigint, batch bigint, slot bigint",
    "op10_": "doc_id bigint, text string, lang string, source string, n_chars bigint, copy int, shuffle_key string",
}


def test_one_query_an_operator():
    from strandsift.llm import registry

    assert sorted(k.split("_")[0] + "_" for k in registry.queries()) == sorted(SCHEMAS)


@pytest.mark.parametrize("op", sorted(SCHEMAS))
def test_schema(spark, op):
    from strandsift.llm import registry

    (query,) = [q for k, q in registry.queries().items() if k.startswith(op)]
    out = query(spark, SF)
    assert ", ".join(f"{n} {t}" for n, t in out.dtypes) == SCHEMAS[op]
    assert out.count() > 0


@pytest.mark.parametrize("name", ["op4_impact_ordered", "op10_poisson_mix"])
def test_sql(spark, name):
    from strandsift.llm import registry

    compare(spark, name, registry.queries()[name], registry.oracle_sql()[name])
