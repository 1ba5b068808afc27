import re

import pytest

from fiberloom.plans import detectors, planted, registry, surfaces
from fiberloom.scratch import settle
from tests.oracle import DATA, connect, same

FOLDER = DATA / "sf0.001"


@pytest.fixture(scope="module")
def oracle():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.CODE_QUERIES))
def test_what_is_planted_is_found_and_nothing_else(spark, oracle, name):
    assert same(registry.CODE_QUERIES[name](spark, str(FOLDER)), oracle, registry.CODE_SQL[name]) == ""


def test_every_detector_has_a_case_and_a_number_of_its_own():
    assert set(planted.CASES) == set(detectors.DETECTORS)
    assert sorted(n for g in planted.groups().values() for n in g) == sorted(detectors.DETECTORS)
    assert len(set(surfaces.NUMBERS.values())) == len(surfaces.NUMBERS) and set(surfaces.NUMBERS) <= set(detectors.DETECTORS)


def test_trees_are_parsed_by_several_tasks_and_read_by_folder(spark, monkeypatch):
    made = {}
    monkeypatch.setattr(planted, "settle", lambda df, label, **more: made.setdefault(label, settle(df, label, **more)))
    monkeypatch.setattr(planted, "TASK_MODULES", 20, raising=False)
    cases = planted.groups()["code_findings_10"][:3]
    planted.found(spark.range(40).withColumnRenamed("id", "s_suppkey"), cases).collect()
    files = made["planted-facts"].inputFiles()
    assert {re.search(r"/_case=([^/]+)/", f)[1] for f in files if "/_case=" in f} == set(cases)
    assert len({re.search(r"/part-(\d+)", f)[1] for f in files}) > 1
