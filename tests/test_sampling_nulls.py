import pytest

from tallyspark.operators import sampling, stats


@pytest.mark.parametrize("parity", [False, True])
def test_cells_with_nulls_are_sampled(spark, parity):
    rows = spark.createDataFrame(
        [(i, None if i % 2 else "a", i % 3 == 0) for i in range(60)], "id int, source string, flag boolean"
    )
    got = sampling.stratified_sample(rows, ["source", "flag"], "id", 24, floor=2, parity=parity).collect()
    assert len(got) == 24 and sum(r.source is None for r in got) == 12


def test_labels_and_batches_of_groups_that_no_task_holds(spark, monkeypatch):
    monkeypatch.setattr(stats, "PLACE_BLOCK", 50)
    rows = spark.range(900).selectExpr("CASE WHEN id % 9 = 0 THEN 'small' ELSE 'large' END AS g", "id")
    got = {(r.g, r.id): r.label for r in sampling.labels(rows.repartition(5), "g", ["id"], "X").collect()}
    assert got["small", 9] == "X2" and got["large", 899] == "X800" and len(set(got.items())) == 900
    mixed = sampling.shuffled_labels(rows, "g", "id", "F").collect()
    assert {r.label for r in mixed if r.g == "large"} == {f"F{k}" for k in range(1, 801)}
    found = sampling.batches(rows, "g", "id", 7, "b-").collect()
    sizes = sorted(len(r["items"]) for r in found if r.g == "large")
    assert sizes == [2] + [7] * 114 and len({r.batch for r in found}) == len(found)
