from landgrid.llm.mixing import OP2_SQL, mix, op2_mixing, source_targets, take_mixed
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"


def test_query_agrees_with_sql(spark):
    assert differences(op2_mixing(spark, SF), connect(SF), OP2_SQL) == ""


def test_targets_stop_and_excess_is_shared(spark):
    sized = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, size long")
    got = {r.source: r.target for r in source_targets(sized).collect()}
    assert got["a"] == 20 and got[None] == 0 and abs(sum(got.values()) - 1.5 * 2010) < 1e-6
    assert max(got["b"], got["c"]) <= 2000 and abs(got["c"] - min(2000, 2 * got["b"])) < 1e-6


def test_each_source_comes_near_its_target(docs, empty):
    rows = mix(docs).collect()
    assert len(rows) == docs.count() and mix(empty).count() == 0
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2 * max(r.size for r in own) + 1
        assert all(r.taken in (0, r.size, 2 * r.size) and r.source_size == sum(x.size for x in own) for r in own)
    assert sum(r.taken for r in rows) <= 1.5 * sum(r.size for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mix(docs.repartition(7)).collect()))


def test_taken_documents_keep_their_columns(docs, empty):
    out = take_mixed(docs)
    assert out.columns == docs.columns and take_mixed(empty).count() == 0
    wanted = mix(docs).where("times > 0").groupBy("doc_id").sum("times").collect()
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert {d: n for d, n in counts.items() if d not in (None, 8)} == {r.doc_id: r["sum(times)"] for r in wanted if r.doc_id not in (None, 8)}
