"""Links by vector are the pairs counted, no pair is left out, and vectors are sent a bounded number of times."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_rounding import from_sql
from wickframe.operators import correlation
from wickframe.plans.queries import QUERIES

RNG = np.random.default_rng(5)


def rows_of(n, dims=8):
    centres = RNG.normal(size=(6, dims)) * 3
    return [(k, (centres[k % 6] + RNG.normal(size=dims)).tolist()) for k in range(n)]


@pytest.mark.parametrize("links, block", [(correlation.vector_links, 7), (correlation.vector_links, 4096), (correlation.strong_links, 7), (correlation.strong_links, 4096)])
def test_links_are_the_pairs_counted(spark, links, block):
    rows = rows_of(60)
    rows += [(100, rows[0][1]), (101, rows[0][1]), (102, None), (103, []), (104, [float("nan")] * 8), (105, [1.0] * 8), (106, [*rows[1][1][:-1], None]), (107, rows[2][1][:6])]
    d = spark.createDataFrame(rows, "symbol long, v array<double>").repartition(3)
    series = d.where("symbol != 104").selectExpr("symbol", "posexplode(v) as (pos, ret)").where("ret is not null")
    want = {}
    for x in correlation.peers(correlation.pairs(series), 0.6).collect():
        want.setdefault(x.symbol, []).append(x.r)
    got = {x.symbol: x for x in links(d, 0.6, block).collect()}
    assert got.keys() == {k for k, _ in rows} and want
    for k, x in got.items():
        rs = want.get(k, [])
        assert x.links == len(rs), k
        assert not rs and x.strongest is None and x.mean_r is None or abs(x.strongest - max(rs)) < 1e-9 and abs(x.mean_r - sum(rs) / len(rs)) < 1e-9
    assert [got[k].class_id for k in (0, 100, 101, 1, 102, 105)] == [0, 0, 0, 1, 102, 105]


def test_vectors_are_sent_as_often_in_larger_tables(spark):
    """Of both joins: the rows that tiles receive, for each vector, don't grow with the table."""
    def sent(n, strong):
        d = spark.createDataFrame(rows_of(n), "symbol long, v array<double>")
        dealt, pairs_of = correlation._grid(d, 0.6, 16, 4) if strong else correlation._of_all(d, 16)[:2]
        ends = pairs_of.select("block").unionByName(pairs_of.where("block != block2").select(F.col("block2").alias("block")))
        return dealt.join(ends, "block").count() / n

    assert sent(1024, False) == sent(256, False) == correlation.BLOCKS
    assert sent(2048, True) < 1.5 * sent(512, True)


@pytest.mark.parametrize("block", [7, 4096])
@pytest.mark.parametrize("links", [correlation.vector_links, correlation.strong_links])
def test_links_name_their_peers(spark, links, block):
    """Every pair of r >= 0.6 comes out both ways, copies too; vectors without any come once."""
    rows = rows_of(60)
    rows += [(100, rows[0][1]), (101, rows[0][1]), (102, None), (103, []), (105, [1.0] * 8), (106, [*rows[1][1][:-1], None]), (107, rows[2][1][:6])]
    d = spark.createDataFrame(rows, "symbol long, v array<double>").repartition(3)
    p = correlation.peers(correlation.pairs(d.selectExpr("symbol", "posexplode(v) as (pos, ret)").where("ret is not null")), 0.6)
    want = {(x.symbol, x.peer): x.r for x in p.collect()}
    found = links(d, 0.6, block).collect()
    got = {(x.symbol, x.peer): x.r for x in found}
    without = {(k, None) for k, _ in rows} - {(a, None) for a, _ in want}
    assert len(found) == len(got) and got.keys() == want.keys() | without and (100, 101) in want and (102, None) in without
    assert all(abs(got[k] - r) < 1e-9 for k, r in want.items()) and all(got[k] is None for k in without)


@pytest.mark.parametrize("name, least", [("correlated_vectors", 0.2), ("strong_vectors", 0.4)])
def test_sql_and_query_have_all_pairs(spark, tmp_path, name, least):
    rows = rows_of(60, 16)
    rows += [(100, rows[0][1]), (101, rows[0][1]), (102, None), (103, None), (104, []), (105, [1.0] * 16)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    full = [k for k, v in rows if v and k != 105]
    r = np.corrcoef(np.array([v for k, v in rows if k in full], np.float32).astype(float))
    want = {(full[i], full[j]) for i, j in zip(*np.nonzero(r >= least), strict=True) if i != j}
    sql, query = from_sql(name, embeddings=tmp_path / "embeddings.parquet"), QUERIES[name](spark, str(tmp_path))
    got = Counter(map(tuple, query.collect()))
    assert query.columns == sql.columns and got == Counter(sql.fetchall())
    places = [query.columns.index(c) for c in ("symbol", "peer")]
    pairs = Counter(tuple(x[k] for k in places) for x in got.elements())
    assert max(pairs.values()) == 1 and {p for p in pairs if p[1] is not None} == want and len(want) > 100
