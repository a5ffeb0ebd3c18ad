"""The source of recorded responses: filters that go down, files that stay unread, odd responses."""

from __future__ import annotations

import json
from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull, LessThan, Not, StringContains

from sieveline.plans import source_plans
from sieveline.sources import recorded as rec


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("responses")

    def put(provider, year, *lines):
        at = root / f"provider={provider}" / f"year={year}"
        at.mkdir(parents=True, exist_ok=True)
        (at / "part-0.txt").write_text("\n".join(lines))
        (at / "_SUCCESS").write_text("")

    alex = [{"id": "https://o.org/W1", "display_name": "One", "publication_date": "2019-05-01", "language": "en", "abstract": "nuclear power"}, {"id": "https://o.org/W2", "display_name": None, "publication_date": None, "language": "de"}, "no record"]
    put("openalex", 2019, json.dumps({"results": alex}), "{broken", json.dumps({"results": None}), json.dumps([1]))
    put("crossref", 2020, json.dumps({"message": {"items": [{"DOI": "10.1/x", "title": ["Two", "other"], "issued": {"date-parts": [[2020, 7]]}, "URL": "u", "language": "en", "abstract": "é" * 3_000_000}, {"DOI": "10.1/y", "title": [], "issued": None}]}}))
    put("gdelt", 2021, json.dumps({"articles": [{"url": "g", "title": "Three", "seendate": "20210203T040506Z"}]}))
    put("other", 2021, json.dumps({"results": [{"id": "x"}]}))
    return str(root)


def test_reads_every_shape(spark, folder):
    got = {r.external_id: (r.provider, r.year, r.title, r.published, r.lang, r.n) for r in rec.recorded(spark, folder).withColumn("n", F.length("text")).collect()}
    assert got == {
        "W1": ("openalex", 2019, "One", "2019-05-01", "en", 13), "W2": ("openalex", 2019, None, None, "de", None), "10.1/x": ("crossref", 2020, "Two", "2020-07-01", "en", 3_000_000),
        "10.1/y": ("crossref", 2020, None, None, None, None), "g": ("gdelt", 2021, "Three", "2021-02-03", None, None),
    }
    assert rec.recorded(spark, folder + "/none").count() == 0


@pytest.mark.parametrize(
    "where, want",
    [
        ("provider = 'openalex'", {"W1", "W2"}), ("provider in ('gdelt', 'crossref') and year < 2021", {"10.1/x", "10.1/y"}), ("published >= '2020-01-01'", {"10.1/x", "g"}), ("published is null", {"W2", "10.1/y"}),
        ("lang <> 'de'", {"W1", "10.1/x"}), ("title like '%wo%'", {"10.1/x"}), ("lang = 'en' or year = 2021", {"W1", "10.1/x", "g"}), ("upper(title) = 'ONE'", {"W1"}), ("text is not null and text like 'nuc%'", {"W1"}), ("provider = 'none'", set()),
    ],
)
def test_filters_keep_what_sql_keeps(spark, folder, where, want):
    df = rec.recorded(spark, folder).where(where)
    assert {r.external_id for r in df.collect()} == want


def test_filters_leave_files_unread(folder):
    def files(*filters):
        reader = rec.RecordedReader({"path": folder})
        left = list(reader.pushFilters(list(filters)))
        return sorted(p.value[1] for p in reader.partitions()), left

    name = lambda c: (c,)
    assert files() == (["crossref", "gdelt", "openalex"], [])
    assert files(EqualTo(name("provider"), "gdelt")) == (["gdelt"], [])
    assert files(In(name("provider"), ("gdelt", "openalex")), LessThan(name("year"), 2020)) == (["openalex"], [])
    assert files(GreaterThanOrEqual(name("published"), "2020-06-01"), IsNotNull(name("published"))) == (["crossref", "gdelt"], [])
    assert files(LessThan(name("published"), date(2020, 1, 1)))[0] == ["openalex"]
    assert files(StringContains(name("text"), "x"))[0] == ["crossref", "gdelt", "openalex"]
    kept = Not(EqualTo(name("provider"), "gdelt"))
    assert files(kept) == (["crossref", "gdelt", "openalex"], [kept])


def test_filters_are_seen_in_the_plan(spark, sf):
    plan = source_plans.recorded_search(spark, sf)._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "recorded" in x.lower())
    assert "Filter" not in plan.split("Scan")[0].rsplit("\n", 2)[-1], plan
    assert "provider" in scan


def test_limit_is_a_request_s(spark, folder):
    assert sorted(r.external_id for r in rec.recorded(spark, folder, limit=1).collect()) == ["10.1/x", "W1", "g"]
