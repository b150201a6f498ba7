"""More scheme names than fit a list."""

from loomwright.operators import registry as R
from loomwright.plans import queries as Q


def test_no_scheme_name_is_left_out(spark, tmp_path):
    rows = [{c: "" for c in R.COLUMNS} | {"source_id": f"s{i}", "scheme": f"Scheme {i} Fund" if i else "Nobody"} for i in range(1500)]
    for r in rows:
        r |= {"url": f"https://{list(Q.HOSTS)[0]}/{r['source_id']}", "authority": list(R.AUTHORITIES)[0], "doc_type": list(R.DOC_TYPES)[0], "discover_only": "true", "enabled": "true"}
    spark.createDataFrame(rows, ", ".join(f"{c} string" for c in R.COLUMNS)).write.parquet(f"{tmp_path}/source_registry.parquet")
    assert [(r["source_id"], r["rule"]) for r in Q.registry_violations(spark, str(tmp_path)).collect()] == [("s0", "scheme")]
