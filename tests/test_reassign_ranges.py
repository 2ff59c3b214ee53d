"""a hot table is cut into as many ranges as its rows ask for; the cuts are sampled, so each range costs the driver memory."""

from choicefield.functions import groups
from choicefield.operators import checks


def test_reassign_cuts_by_the_number_of_rows(spark, monkeypatch):
    df = spark.createDataFrame([(i % 40 * 3, i) for i in range(200)], "id bigint, o bigint").repartition(3)
    whole = sorted(map(tuple, checks.reassign_duplicate_ids(df, "id", ["o"]).collect()))
    cuts, store = [], groups.stored

    def spied(frame, name):
        cuts.append(frame.rdd.getNumPartitions())
        return store(frame, name)

    monkeypatch.setattr(groups, "stored", spied)
    monkeypatch.setattr(groups, "HOT_ROWS", 30)
    monkeypatch.setattr(groups, "RANGE_ROWS", 50, raising=False)
    assert sorted(map(tuple, checks.reassign_duplicate_ids(df, "id", ["o"]).collect())) == whole
    assert len(set(r[2] for r in whole)) == len(whole) == 200
    assert cuts and max(cuts) <= 8
