"""Each would fail where a query does less than its whole job."""

from collections import Counter

import numpy as np
import oracle

from beaconlake.llm import queries as Q
from beaconlake.llm.common import table


def shares(rows, by, post):
    """Words of each domain over all words."""
    from beaconlake.llm.mixing import DOMAINS

    t = np.array([x.n_tokens * x[by] for x in rows], float)
    return t @ np.array([post(x) for x in rows]) / t.sum(), np.array([Q.TARGETS[d] for d in DOMAINS])


def test_op10_totals_are_the_targets(spark):
    from beaconlake.llm.mixing import DOMAINS

    rows = Q.op10_soft_mixing(spark, oracle.DATA).collect()
    got, want = shares(rows, "rate", lambda x: [x[f"p_{d}"] for d in DOMAINS])
    assert np.abs(got - want).max() < 1e-4
    assert abs(sum(x.rate * x.n_tokens for x in rows) / sum(x.n_tokens for x in rows) - 1) < 1e-4


def test_pipeline_mixing_reaches_the_shares_and_keeps_every_document(spark):
    import corpus_pipeline as P

    from beaconlake.llm.mixing import mix

    data = "/root/testdata/sf0.01"
    docs = table(spark, data, "documents")
    rows = mix(docs, table(spark, data, "labels"), Q.TARGETS, carry=["doc_id"], **P.MIX).collect()
    got, want = shares(rows, "rate", lambda x: x.posterior)
    assert np.abs(got - want).max() < 1e-4 and min(x.rate for x in rows) >= 1
    drawn, _ = shares(rows, "copies", lambda x: x.posterior)
    assert np.abs(drawn - want).max() < 0.01
    assert Counter(r.doc_id for r in P.mixing(spark, docs, data).select("doc_id").collect()) == {x.doc_id: x.copies for x in rows}
