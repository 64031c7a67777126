import pytest
from conftest import lay_out, names

from sluice.model import UnresolvedRequest
from sluice.operators import select
from sluice.session import pin
from sluice.sources.tables import folder_partitions, list_partitions

ALL = [f"month={m}/day={d}" for m in (1, 2, 3) for d in (1, 2)]


def test_listing_by_rows_and_by_folders_agree(spark, monthly):
    assert monthly.frame.count() == 12
    assert names(list_partitions(monthly)) == ALL
    folders = folder_partitions(spark, monthly)
    assert names(folders) == ALL
    for row in folders.collect():
        assert row["location"].endswith(row["name"])
        assert row["bytes"] > 0
        assert f"month={row['month']}/day={row['day']}" == row["name"]


@pytest.mark.parametrize("cap, expected", [(2, ALL[-2:]), (0, ALL), (-1, ALL), (100, ALL), (1, ALL[-1:])])
def test_last_n(monthly, cap, expected):
    assert names(select.last_n(list_partitions(monthly), cap)) == expected


def test_capped_copy_has_four_rows(spark, monthly):
    chosen = pin(select.last_n(list_partitions(monthly), 2))
    assert select.rows_of(monthly.frame, chosen, ["month", "day"]).count() == 4


def test_last_n_top_level(monthly):
    assert names(select.last_n_top_level(list_partitions(monthly), 2)) == ALL[2:]
    assert names(select.last_n_top_level(list_partitions(monthly), -1)) == ALL


def test_cap_holds_per_spec_before_distinct(monthly):
    parts = list_partitions(monthly)
    specs = [{"month": "1"}, {"day": "2"}, {"month": "1", "day": "2"}]
    assert names(select.last_n_per_spec(parts, specs, 1)) == ["month=1/day=2", "month=3/day=2"]
    assert names(select.last_n_per_spec(parts, specs, -1)) == [ALL[0], ALL[1], ALL[3], ALL[5]]


def test_salted_ranking_equals_plain_ranking(spark, monthly):
    parts = list_partitions(monthly)
    specs = [{"month": "1"}, {"day": "2"}, {"day": "1"}]
    plain = names(select.last_n_per_spec(parts, specs, 2))
    before = spark.conf.get(select._GROUP_LIMIT_KEY)
    spark.conf.set(select._GROUP_LIMIT_KEY, "1")
    try:
        assert names(select.last_n_per_spec(parts, specs, 2)) == plain
    finally:
        spark.conf.set(select._GROUP_LIMIT_KEY, before)


@pytest.fixture
def with_null(spark):
    rows = [(f"n{i}", i % 4 if i % 4 else None, i % 3) for i in range(120)]
    return lay_out(spark, rows)


def _reference(rows, specs):
    return sorted(
        r["name"] for r in rows if any(all(str(r[c]) == str(v) for c, v in s.items()) for s in specs)
    )


@pytest.mark.parametrize(
    "specs",
    [
        [{"month": "1"}],
        [{"month": None}, {"day": "1", "month": "2"}],
        [{"day": "0"}, {"month": "3"}, {"month": None, "day": "1"}],
        [{"month": None, "day": "2"}, {"month": "2", "day": "2"}],
    ],
)
def test_predicate_and_join_forms_agree(monkeypatch, with_null, specs):
    expected = _reference(with_null.frame.collect(), specs)
    parts = list_partitions(with_null)
    short = names(select.matching(with_null.frame, specs)), names(select.last_n_per_spec(parts, specs, 1))
    monkeypatch.setattr(select, "PREDICATE_LIMIT", 0)
    long = names(select.matching(with_null.frame, specs)), names(select.last_n_per_spec(parts, specs, 1))
    assert short[0] == expected
    assert short == long


def test_null_partition_is_kept(spark, with_null):
    parts = folder_partitions(spark, with_null)
    assert "month=__HIVE_DEFAULT_PARTITION__/day=1" in names(parts)
    assert names(parts) == names(list_partitions(with_null))
    chosen = pin(parts)
    assert select.rows_of(with_null.frame, chosen, ["month", "day"]).count() == 120


def test_no_rows_for_no_partitions(with_null):
    chosen = pin(list_partitions(with_null).where("day > 99"))
    assert select.rows_of(with_null.frame, chosen, ["month", "day"]).count() == 0


@pytest.mark.parametrize("limit", [200, 0])
def test_unmatched_spec_is_an_error(monkeypatch, monthly, limit):
    monkeypatch.setattr(select, "PREDICATE_LIMIT", limit)
    parts = list_partitions(monthly)
    good, bad = {"month": "1"}, {"month": "9"}
    assert select.unmatched_specs(parts, [good, bad]) == [bad]
    with pytest.raises(UnresolvedRequest, match="month=9"):
        select.resolve(parts, [good, bad])
    with pytest.raises(UnresolvedRequest, match="invalid column: year"):
        select.resolve(parts, [{"year": "1"}])


def test_request_texts(spark):
    texts = ["db.t", "db.t (a='x y', b=2) (a='z')", "nonsense"]
    parsed = select.specs_from_text(spark, texts)
    assert parsed[0] == ("db.t", [])
    assert parsed[1] == ("db.t", [{"a": "x y", "b": "2"}, {"a": "z"}])
    assert parsed[2][0] is None
