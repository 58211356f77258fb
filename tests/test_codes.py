"""Prefix tables against the regular expressions they stand for."""

import random
import re

import pytest

from stayline.operators import codes as C
from stayline.sources import reference as R

ALL = [(v, p) for _, _, v, p in R.CHARLSON] + [(v, R.undotted(p)) for _, v, p in R.ELIXHAUSER] + [(v, p) for _, v, p in R.ELIXHAUSER]


def codes(n=3000):
    r = random.Random(2)
    for _ in range(n):
        yield r.choice("0123456789CEIKMNB") + "".join(r.choice("0123456789") for _ in range(r.randrange(0, 5)))
    yield from ("", "$", "583,", "402", "4020", "C01", "C011", "I1.0", "I110")


@pytest.mark.parametrize("version, pattern", ALL)
def test_reference_patterns_become_prefixes(version, pattern):
    texts = C.literal_prefixes(pattern)
    assert texts
    for code in codes(600):
        assert any(code == t if whole else code.startswith(t) for t, whole in texts) == bool(re.search(pattern, code)), code


@pytest.mark.parametrize("pattern", ["410", "^4.0", "^(41|(42|43))", "^4[^1]", "^41+", r"^\d{3}", "^(4[0-9]{2})", "(^41)", "^41|42"])
def test_other_patterns_stay_expressions(pattern):
    assert C.literal_prefixes(pattern) is None


@pytest.mark.parametrize("pattern", ["^41", "^41$", r"^4\.1", "^(41$|42)", "^([A-C]1|D[02,])"])
def test_forms_of_prefixes(pattern):
    texts = C.literal_prefixes(pattern)
    for code in [*codes(), "41", "411", "4.1", "42", "421", "A1", "C12", "D,", "D0", "D1"]:
        assert any(code == t if whole else code.startswith(t) for t, whole in texts) == bool(re.search(pattern, code)), code


def test_both_ways_meet(spark):
    events = spark.createDataFrame(
        [(i, c, 9 + i % 2) for i, c in enumerate(codes(500))] + [(1, None, 9), (2, "410", None)], "hadm_id long, icd_code string, icd_version int"
    )
    table = spark.createDataFrame(
        [("a", 9, "^(41|42$)", 1), ("a", 9, "^411", 1), ("b", 10, "[CK].*3", 2), ("b", 9, "9$", 2), ("c", 10, "^I1", 3), ("d", 9, None, 4), ("e", None, "^4", 5)],
        "group_name string, icd_version int, pattern string, weight int",
    )
    want = set()
    for h, code, version in events.collect():
        for group, v, pattern, weight in table.collect():
            if code is not None and pattern and version is not None and version == v and re.search(pattern, code.strip().upper().replace(".", "")):
                want.add((h, group, weight))
    found = C.match_patterns(events, table)
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    repeated = C.match_patterns(events, table, distinct=False)
    assert {tuple(r) for r in repeated.collect()} == want


def test_prefixes_need_no_expression_and_no_shuffle_of_events(spark):
    events = spark.createDataFrame([(1, "410", 9)], "hadm_id long, icd_code string, icd_version int")
    found = C.match_patterns(events, R.charlson_table(spark), distinct=False)
    plan = found._jdf.queryExecution().toString().lower()
    assert "rlike" not in plan and "broadcasthashjoin" in plan and "exchange hashpartitioning" not in plan
    assert [tuple(r) for r in found.collect()] == [(1, "mi", 1)]
