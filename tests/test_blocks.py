"""A gallery that comes in several blocks gives the same results as in one."""

from larkspur.operators import matching
from larkspur.plans import stateful, vectors

SF = "/root/testdata/sf0.001"
QUERIES = {n: vectors.QUERIES[n] for n in ("q_p14_ambiguity", "q_f33_cosine_map", "q_p6_confidence_gate", "q_a4_column_winner")} | {"q_j13_assignment": stateful.q_j13_assignment}


def test_blocks_do_not_show(spark, monkeypatch):
    whole = {n: sorted(map(str, q(spark, SF).collect())) for n, q in QUERIES.items()}
    one = matching.blocks
    monkeypatch.setattr(matching, "blocks", lambda gallery, block=4: one(gallery, block))
    for n, q in QUERIES.items():
        assert sorted(map(str, q(spark, SF).collect())) == whole[n], n
