"""The product of columns, constants and operators against a small model in plain Python."""

import math
from datetime import datetime

import pytest

from quarry.database.manager import DatabaseManager
from quarry.functions import literals as lt

ROWS = [
    (3, "Carol", "a", 0, 1.5, True, datetime(2024, 3, 1)),
    (1, "Alice", "a", 2, None, False, datetime(2024, 1, 15)),
    (4, "Dave", "b", 1, 0.0, True, datetime(2023, 12, 31)),
    (2, "Bob", None, 5, -3.25, None, None),
    (5, "Erin", "c", 0, 2.5, False, datetime(2024, 1, 15)),
]
NAMES = ["id", "name", "role", "visits", "score", "active", "seen"]
CONSTANTS = {
    "role": ["a", "b", "", 5],
    "visits": [0, 2, 1.5, "2", "", "x", True, "1.5"],
    "score": [0, 1.5, "-3.25", "", "x", math.nan],
    "active": [True, False, "false", "0", 1, "yes"],
    "seen": ["2024-01-15", datetime(2024, 1, 15), "2024-01-15T00:00:00Z", "never", 1705276800000, "2024-01-15T02:00:00+02:00"],
}
OPERATORS = ["=", "==", "===", "!=", "<>", "!==", "<", ">", "<=", ">="]
KIND = {"role": "string", "visits": "integer", "score": "float", "active": "boolean", "seen": "datetime"}


@pytest.fixture(scope="module")
def users(spark):
    df = spark.createDataFrame(ROWS, "id long, name string, role string, visits long, score double, active boolean, seen timestamp_ntz")
    c = DatabaseManager().configure({"connections": {"x": {}}}).connection().register("users", df.cache(), "id")
    return lambda: c.table("users")


def model(v, op, k, kind):
    """True, False or None (unknown)."""
    if v is None:
        return None
    strict = op in ("===", "!==")
    unequal = op in ("!=", "<>", "!==")
    same = {"string": str, "integer": (int, float), "float": (int, float), "boolean": bool, "datetime": datetime}[kind]
    if strict and (not isinstance(k, same) or (kind in ("integer", "float") and isinstance(k, bool))):
        return unequal
    if kind == "boolean":
        a, b = int(v), int(lt.truthy(k))
    elif kind == "datetime" and lt.instant(k, "UTC") is not None:
        a, b = v, lt.instant(k, "UTC")
    elif kind == "string" and isinstance(k, str):
        a, b = v, k
    else:
        a = lt.number(v) if kind != "datetime" else lt.millis(v)
        b = lt.number(k)
        if math.isnan(a) or math.isnan(b):
            return unequal
    return {"=": a == b, "==": a == b, "===": a == b, "!=": a != b, "<>": a != b, "!==": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]


@pytest.mark.parametrize("column", CONSTANTS)
def test_matrix(users, column):
    at = NAMES.index(column)
    for k in CONSTANTS[column]:
        q = users()
        want, got = [], []
        for op in OPERATORS:
            truth = {r[0]: model(r[at], op, k, KIND[column]) for r in ROWS}
            want.append((op, sorted(i for i, t in truth.items() if t is True), sorted(i for i, t in truth.items() if t is False)))
            q = users().where(column, op, k).select("id").to_df().collect(), users().where_not(column, op, k).select("id").to_df().collect()
            got.append((op, sorted(r.id for r in q[0]), sorted(r.id for r in q[1])))
        assert got == want, (column, k)


def ids(q):
    return sorted(q.pluck("id"))


def test_in_and_not_in_with_nulls(users):
    assert ids(users().where_in("role", [])) == []
    assert ids(users().where_not_in("role", [])) == [1, 3, 4, 5]
    assert ids(users().where_in("role", ["a", None])) == [1, 3]
    assert ids(users().where_not_in("role", ["a", None])) == []
    assert ids(users().where_not_in("role", ["a"])) == [4, 5]
    assert ids(users().where_in("visits", ["2", 5, "x"])) == [1, 2]
    with pytest.raises(TypeError):
        users().where_in("role", [["a"]])


def test_between(users):
    assert ids(users().where_between("visits", [1, 2])) == [1, 4]
    assert ids(users().where_between("visits", [2, 1])) == []
    assert ids(users().where_not_between("visits", [2, 1])) == [1, 2, 3, 4, 5]
    assert ids(users().where_between("visits", [1, None])) == []
    assert ids(users().where_not_between("visits", [1, None])) == [3, 5]
    assert ids(users().where_between("score", [[0], 2])) == [3, 4]


def test_nulls_and_groups(users):
    assert ids(users().where("role", None)) == [2]
    assert ids(users().where("role", "!=", None)) == [1, 3, 4, 5]
    assert ids(users().where_not("role", None)) == [1, 3, 4, 5]
    assert ids(users().where("role", ">", None)) == []
    assert ids(users().where_not(lambda q: q.where("role", "a").where("visits", 0))) == [1, 2, 4, 5]
    assert ids(users().where({}).where(lambda q: None)) == [1, 2, 3, 4, 5]
    assert ids(users().or_where({"role": "b", "visits": 0})) == [3, 4, 5]
    assert ids(users().where({"role": "a", "visits": 0})) == [3]
    assert ids(users().where("visits", 5).or_where("role", "a").where("visits", 0)) == [2, 3]
    assert ids(users().where_any(["visits", "id"], 2)) == [1, 2]
    assert ids(users().where_all(["visits", "id"], ">", 1)) == [2]
    assert ids(users().where_none(["visits", "id"], 2)) == [3, 4, 5]
    assert ids(users().where_any([], 2)) == [1, 2, 3, 4, 5]


def test_like(spark):
    rows = [(1, "50% off"), (2, "a_b"), (3, "a\\b"), (4, "AxB"), (5, "line\nbreak"), (6, None)]
    c = DatabaseManager().configure({"connections": {"x": {}}}).connection().register("t", spark.createDataFrame(rows, "id long, s string"), "id")
    t = lambda: c.table("t")
    assert ids(t().where_like("s", "%\\%%")) == [1]
    assert ids(t().where_like("s", "a_b")) == [2, 3, 4]
    assert ids(t().where_like("s", "a\\_b")) == [2]
    assert ids(t().where_like("s", "a\\b")) == [3]
    assert ids(t().where_like("s", "a_b", True)) == [2, 3]
    assert ids(t().where_like("s", "line%break")) == [5]
    assert ids(t().where_not_like("s", "a%")) == [1, 5]
    assert ids(t().where_like("id", "1")) == ids(t().where_not_like("id", "1")) == []


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "America/Santiago", "Asia/Kolkata"])
def test_days_and_times(spark, zone):
    from datetime import timedelta, timezone
    from zoneinfo import ZoneInfo

    begin = datetime(2024, 3, 9)
    rows = [(i, begin + timedelta(minutes=37 * i)) for i in range(120)]
    c = DatabaseManager().configure({"connections": {"x": {"timezone": zone}}}).connection().register("t", spark.createDataFrame(rows, "id long, at timestamp_ntz"), "id")
    local = {i: at.replace(tzinfo=timezone.utc).astimezone(ZoneInfo(zone)) for i, at in rows}
    day = datetime(2024, 3, 10).date()
    assert ids(c.table("t").where_date("at", "2024-03-10")) == [i for i, x in local.items() if x.date() == day]
    assert ids(c.table("t").where_date("at", "!=", "2024-03-10")) == [i for i, x in local.items() if x.date() != day]
    assert ids(c.table("t").where_date("at", ">", "2024-03-10")) == [i for i, x in local.items() if x.date() > day]
    assert ids(c.table("t").where_date("at", "<=", "2024-03-10")) == [i for i, x in local.items() if x.date() <= day]
    assert ids(c.table("t").where_date("at", "someday")) == []
    assert ids(c.table("t").where_day("at", 10)) == [i for i, x in local.items() if x.day == 10]
    assert ids(c.table("t").where_time("at", "<", "03:00")) == [i for i, x in local.items() if x.strftime("%H:%M:%S") < "03:00:00"]
    assert ids(c.table("t").where_year("at", "2024").where_month("at", 3)) == list(local)


def test_json(spark):
    import json

    docs = [{"a": {"b": 1}, "t": ["x", 1]}, {"a": {"b": "1"}, "t": []}, {"a": {"b": None}}, None, {"a": {"b": True}, "t": "x"}, {"a": [1]}, 5, "5"]
    rows = [(i, None if d is None else json.dumps(d)) for i, d in enumerate(docs)]
    c = DatabaseManager().configure({"connections": {"x": {}}}).connection().register("t", spark.createDataFrame(rows, "id long, d string"), "id", ("d",))
    t = lambda: c.table("t")
    assert ids(t().where("d->a->b", 1)) == [0, 1, 4]
    assert ids(t().where("d->a->b", "===", 1)) == [0]
    assert ids(t().where("d->a->b", "1")) == [0, 1, 4]
    assert ids(t().where_null("d->a->b")) == [2, 3, 5, 6, 7]
    assert ids(t().where_json_contains("d->t", ["x", 1])) == [0]
    assert ids(t().where_json_contains("d->t", [])) == [0, 1]
    assert ids(t().where_json_doesnt_contain("d->t", "x")) == [1]
    assert ids(t().where_json_length("d->t", 0)) == [1]
    assert ids(t().where("d", 5)) == [6]
    assert ids(t().where("d", "5")) == [7]
    assert ids(t().where("d", "<", "5")) == [6]
    assert t().where("id", 0).value("d->a") == {"b": 1}
    assert t().order_by("d->a->b").limit(9).pluck("id")[-3:] == [0, 1, 4]


def rank(v):
    """A sort key of JSON values, by recursion."""
    plain = lambda x: isinstance(x, str) or (isinstance(x, (int, float)) and not isinstance(x, bool)) or (isinstance(x, list) and all(map(plain, x)))
    if v is None:
        return (0,)
    if isinstance(v, bool):
        return (4, v)
    if isinstance(v, (int, float)):
        return (1, v)
    if isinstance(v, str):
        return (2, v)
    if isinstance(v, list):
        return (3 if plain(v) else 5, [rank(x) for x in v])
    return (6,)


def test_order_of_json_values(spark):
    import json

    values = ["9", "10", "z", True, 3, None, 10, 9, 100, False, [9], [10], [9, 1], [1, "a"], [1, "b"], [[1]], [[1], 0], [], [0], ["z"], [True], [None], [None, 1], [{}], [[True]], 2.5, "", {"x": 1}, -1, "3"]
    rows = [(i, None if i == 5 else json.dumps({"v": v})) for i, v in enumerate(values)]
    c = DatabaseManager().configure({"connections": {"x": {}}}).connection().register("t", spark.createDataFrame(rows, "id long, d string").repartition(3), "id", ("d",))
    t = lambda: c.table("t")
    want = sorted(range(len(values)), key=lambda i: (rank(values[i]), i))
    assert t().order_by("d->v").pluck("id") == want
    down = sorted(range(len(values)), key=lambda i: rank(values[i]), reverse=True)
    got = t().order_by("d->v", "desc").pluck("id")
    assert [rank(values[i]) for i in got] == [rank(values[i]) for i in down]
    present = [v for i, v in enumerate(values) if v is not None and i != 5]
    assert (t().min("d->v"), t().max("d->v")) == (min(present, key=rank), max(present, key=rank))
    assert (t().where("id", "<", 27).min("d->v"), t().where("id", "<", 27).max("d->v")) == (2.5, [{}])
    assert t().where("id", 5).min("d->v") is None
    assert t().select("d->v as v").distinct().order_by("d->v").pluck("v") == [values[i] for i in want]
    assert t().select("d->v as v").distinct().order_by("d->v", "desc").limit(3).pluck("v") == [values[i] for i in down[:3]]
    (g,) = t().where("id", "<", 12).group_by().aggregate({"lo": {"min": "d->v"}, "hi": {"max": "d->v"}}).get()
    assert (g["lo"], g["hi"]) == (3, True)
    assert t().distinct().sum("d->v") == sum(x for x in present if isinstance(x, (int, float)) and not isinstance(x, bool)) + 1 + 22 and t().min("d") == {"v": "9"}


def test_numbers_written_in_columns(spark):
    texts = ["16", "0x10", "0X1f", "0b101", "0o17", " 7 ", "", "x", "0x", "1e2", "-Infinity", "0xffffffffffffffffff", None]
    c = DatabaseManager().configure({"connections": {"x": {}}}).connection().register("t", spark.createDataFrame(list(enumerate(texts)), "id long, s string"), "id")
    for n in (16, 31, 5, 15, 7, 0, 100, -math.inf, float(0xFFFFFFFFFFFFFFFFFF)):
        assert ids(c.table("t").where("s", n)) == [i for i, s in enumerate(texts) if s is not None and lt.number(s) == n], n
