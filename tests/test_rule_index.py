import random

import pytest

from casewright.operators import detect, rule_index
from casewright.plans import derived

TEXTS = ["cmd.exe", "CMD", "a", "", "*", "?", "c*d", "*.exe", "??d*", "ä*", "Äx", "pow[e]r", "C:\\tmp\\*", "x\n"]
FIELDS = ["host", "process.name", "process.command_line", "file.path", "custom", "process.pid"]


def random_rule(pick, i):
    def spec():
        if pick.random() < 0.05:
            return pick.choice([{}, "not a selection", {"host": []}])
        return {f: pick.choice(TEXTS) if pick.random() < 0.6 else pick.sample(TEXTS, 2) for f in pick.sample(FIELDS, pick.randrange(1, 3))}

    names = ["sel_a", "Sel_B", "other"]
    condition = pick.choice(["sel_a", "sel_b and other", "1 of sel*", "all of sel*", "sel_a or other and sel_b", "1 of none*", "all of none*", "missing", "", "1 of *"])
    return {"id": f"R{i}", "level": pick.choice(["low", "critical", "?"]), "tags": ["attack.t1059"], "detection": {**{n: spec() for n in names}, "condition": condition}}


@pytest.fixture(scope="module")
def events(make_events):
    pick = random.Random(9)
    values = [*TEXTS, "cmd.exe /c dir", "power", "pow[e]r", "ÄX", "C:\\tmp\\a.exe", None]
    rows = [
        {
            "event_id": f"E{i}", "host": pick.choice(values), "process": {"name": pick.choice(values), "command_line": pick.choice(values), "pid": pick.choice([7, None])},
            "file": {"path": pick.choice(values)}, "metadata": {"custom": pick.choice(values)},
        }
        for i in range(120)
    ]
    return make_events(rows, case_id="C").cache()


def test_index_finds_what_the_expressions_find(events):
    pick = random.Random(2)
    rules = [random_rule(pick, i) for i in range(150)]
    by_index = detect.apply_indexed(events, rules)
    found = 0
    for begin in range(0, len(rules), 30):
        some = rules[begin : begin + 30]
        by_column = detect.apply_rules(events, some)
        names = [r["id"] for r in some]
        mine = by_index.filter(by_index.rule_id.isin(names)).drop("matched_fields")
        assert mine.columns == by_column.drop("matched_fields").columns
        assert sorted(map(str, mine.collect())) == sorted(map(str, by_column.drop("matched_fields").collect()))
        found += by_column.count()
    assert found > 1000


def test_plan_does_not_grow_with_rules(events):
    def plan(n):
        return detect.apply_rules(events, derived.many_rules(n))._jdf.queryExecution().analyzed().toString()

    assert abs(len(plan(2000)) - len(plan(100))) < 200


def test_only_pointed_rules_are_looked_at(monkeypatch):
    index = rule_index.Index([detect.tree(r["detection"]) for r in derived.many_rules(2000)])
    looked = []
    monkeypatch.setattr(rule_index, "holds", lambda rule, true: looked.append(rule) or False)
    tables = index.tables()
    index.matching(set(tables["user"].true("user7")) | set(tables["host"].true("host-7")))
    assert 0 < len(looked) <= 100 and not index.always


def test_necessary_atoms():
    def one(**detection):
        return rule_index.necessary(detect.tree(detection))

    assert {a.text for a in one(a={"host": "h*", "user": "longer"}, condition="a")} == {"longer"}
    assert {a.text for a in one(a={"host": ["x", "y"]}, b={"user": "u"}, condition="a or b")} == {"x", "y", "u"}
    assert one(a={"host": "*"}, condition="a") is None and one(a={}, condition="a") is None
    assert one(a={"host": "x"}, condition="nothing") == frozenset()
