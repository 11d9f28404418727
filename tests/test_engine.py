"""Reads, joins, grouping, writes, transactions, migrations and events, end to end."""

import uuid

import pytest

from quarry import DB, Blueprint, DatabaseManager, Migration, Schema, Seeder, exceptions
from quarry.functions import literals


@pytest.fixture
def db(spark, tmp_path):
    class CreateUsers(Migration):
        def up(self):
            Schema.create("users", self.users)
            Schema.create("posts", lambda t: (t.id(), t.integer("user_id").index(), t.string("title")))
            Schema.create("tagged", lambda t: (t.id(), t.json("tags").nullable().unique().multi_entry(), t.string("title")))
            Schema.create("slugs", lambda t: (t.uuid("slug").primary(), t.string("label")))
            Schema.create("tallies", lambda t: t.integer("count"))

        @staticmethod
        def users(t: Blueprint):
            t.id()
            t.string("name")
            t.string("email").unique()
            t.string("role").default("member").index()
            t.integer("visits").default(0)
            t.integer("age").nullable()
            t.timestamps()

    class Users(Seeder):
        def run(self):
            DB.table("users").insert({"name": "Seed", "email": "s@x"})

    DB.configure({"connections": {"app": {"path": str(tmp_path), "database": uuid.uuid4().hex, "migrations": [CreateUsers], "seeders": [Users]}}})
    DB.table("users").insert([
        {"name": "Alice", "email": "a@x", "role": "admin", "visits": 10, "age": 30}, {"name": "Bob", "email": "b@x", "visits": 4, "age": 25},
        {"name": "Carol", "email": "c@x", "visits": 6, "age": 35}, {"name": "Dave", "email": "d@x", "visits": 1},
    ])
    DB.table("posts").insert([{"user_id": 1, "title": "First"}, {"user_id": 1, "title": "Second"}, {"user_id": 2, "title": "Third"}, {"user_id": 9, "title": "Lost"}])
    return DB


def test_reads(db):
    t = lambda: db.table("users")
    assert t().order_by("age").pluck("name") == ["Dave", "Bob", "Alice", "Carol"]
    assert t().order_by("age", "desc").pluck("name") == ["Carol", "Alice", "Bob", "Dave"]
    assert t().find("2")["name"] == "Bob" and t().where("role", "admin").find(2) is None and t().find(None) is None
    assert t().select("name as n", "users.role").first() == {"n": "Alice", "role": "admin"}
    assert t().select("name as x", "role as x").first() == {"x": "admin"}
    assert t().pluck("name", "role") == {"admin": "Alice", "member": "Dave"}
    assert t().select("role").distinct().pluck("role") == ["admin", "member"]
    assert t().distinct().select("role").order_by("age", "desc").limit(1).pluck("role") == ["member"]
    assert t().limit(-1).limit(2.9).offset(1).pluck("id") == [2, 3]
    assert (t().sum("age"), t().avg("age"), t().min("age"), t().max("name")) == (90, 30.0, 25, "Dave")
    assert (t().where("id", 0).sum("age"), t().where("id", 0).avg("age")) == (0, None)
    assert t().limit(1).count() == 4 and t().where("id", 9).doesnt_exist()
    page = t().paginate(2, 3)
    assert (page["total"], page["last_page"], len(page["data"])) == (4, 2, 1)
    seen = []
    assert t().chunk(3, lambda rows, n: seen.append((n, len(rows)))) and seen == [(1, 3), (2, 1)]
    assert not t().each(lambda row, i: i < 1)
    assert [r["id"] for r in t().lazy(2)] == [1, 2, 3, 4]
    assert t().where("name", "Bob").sole()["id"] == 2
    assert t().when(True, lambda q, _: q.where("id", 1)).unless(True, lambda q, _: q.where("id", 2)).count() == 1
    assert t().whereIn("id", [1, 2]).orderBy("id").pluck("id") == [1, 2]
    for call, error in ((lambda: t().where("id", 9).first_or_fail(), exceptions.RecordsNotFoundException), (lambda: t().sole(), exceptions.MultipleRecordsFoundException), (lambda: t().where("none", 1).get(), exceptions.SchemaException),
                        (lambda: t().chunk(0, print), exceptions.SchemaException), (lambda: db.table("none").get(), exceptions.TableNotFoundException), (lambda: t().select("id").value("name"), exceptions.SchemaException)):
        with pytest.raises(error):
            call()
    assert [t().explain(), t().where("id", 1).explain(), t().where("email", "x").explain(), t().where("role", "x").explain(), t().where("id", 1).or_where("id", 2).explain()] == ["scan", "key", "index:users_email_unique", "index:users_role_index", "scan"]


def test_joins(db):
    t = lambda: db.table("users")
    inner = t().join("posts", "users.id", "=", "posts.user_id").get()
    assert [r["title"] for r in inner] == ["First", "Second", "Third"] and inner[0]["id"] == 1 and inner[1]["id"] == 2
    assert list(inner[0])[0] == "id"
    left = t().left_join("posts", "users.id", "posts.user_id").get()
    assert [r["id"] for r in left] == [1, 2, 3, None, None]
    assert t().left_join("posts", "users.id", "posts.user_id").where_null("posts.id").pluck("name") == ["Carol", "Dave"]
    assert sorted(str(x) for x in t().right_join("posts", "users.id", "posts.user_id").pluck("name")) == ["Alice", "Alice", "Bob", "None"]
    assert t().cross_join("posts").count() == 16
    assert t().join("posts", lambda j: j.on("users.id", "posts.user_id").or_on("posts.title", "users.name")).count() == 3
    assert t().join("posts", "id", "posts.user_id").count() == 0
    assert t().join("posts", "users.id", "posts.user_id").find(1)["title"] == "First"
    assert t().join("posts", "users.id", "posts.user_id").explain() == "join"
    with pytest.raises(exceptions.SchemaException):
        t().join("posts", "users.id", "posts.user_id").where("id", 1).get()
    with pytest.raises(exceptions.SchemaException):
        t().join("users", "users.id", "users.id").get()
    assert t().join("posts", "users.id", "posts.user_id").where("title", "First").update({"visits": 99}) == 1
    assert t().find(1)["visits"] == 99
    with pytest.raises(exceptions.SchemaException):
        t().join("posts", "users.id", "posts.user_id").limit(1).delete()


def test_grouping(db):
    g = db.table("users").group_by("role").aggregate({"n": {"count": "*"}, "ages": {"count": "age"}, "sum": {"sum": "age"}, "low": {"min": "age"}, "mean": {"avg": "visits"}})
    assert g.get() == [{"role": "admin", "n": 1, "ages": 1, "sum": 30, "low": 30, "mean": 10.0}, {"role": "member", "n": 3, "ages": 2, "sum": 60, "low": 25, "mean": 11 / 3}]
    assert g.having("n", ">", 1).count() == 1 and g.first()["role"] == "member"
    assert db.table("users").group_by("role").order_by("role", "desc").limit(1).get() == [{"role": "member"}]
    assert db.table("users").where("id", 0).group_by().aggregate({"n": {"count": "*"}}).get() == []
    assert db.table("users").group_by("age").aggregate({"n": {"count": "*"}}).having("age", None).get() == []
    assert db.table("users").join("posts", "users.id", "posts.user_id").group_by("users.name").aggregate({"n": {"count": "*"}}).order_by("n", "desc").get()[0] == {"name": "Alice", "n": 2}


def test_writes(db):
    t = lambda: db.table("users")
    assert t().insert_get_id({"name": "E", "email": "e@x"}) == 5
    assert t().insert({"id": 20, "name": "F", "email": "f@x"}) == 1 and t().insert_get_id({"name": "G", "email": "g@x"}) == 21
    with pytest.raises(exceptions.UniqueConstraintViolationException, match="users_email_unique"):
        t().insert([{"name": "H", "email": "h@x"}, {"name": "I", "email": "a@x"}])
    assert t().where("email", "h@x").doesnt_exist()
    with pytest.raises(exceptions.NotNullConstraintViolationException):
        t().insert({"name": "H"})
    with pytest.raises(exceptions.SchemaException):
        t().insert({"name": "H", "users.name": "H", "email": "h"})
    assert t().insert_or_ignore([{"name": "J", "email": "j@x"}, {"name": "K", "email": "j@x"}]) == 1
    assert t().where("id", ">", 4).delete() == 4
    with pytest.raises(exceptions.UniqueConstraintViolationException):
        t().where("id", 2).update({"email": "a@x"})
    with pytest.raises(exceptions.SchemaException):
        t().update({"id": 7})
    rows = t().get()
    db.connection().compact("users")
    assert t().get() == rows
    before = t().find(2)["updated_at"]
    assert t().order_by("age", "desc").limit(1).update({"role": "old"}) == 1 and t().where("role", "old").pluck("name") == ["Carol"]
    assert t().increment("age", 2) == 4 and t().order_by("id").pluck("age") == [32, 27, 37, None]
    assert t().where("id", 1).decrement("visits", 3, {"role": "x"}) == 1 and t().find(1)["visits"] == 7
    assert t().find(2)["updated_at"] >= before
    with pytest.raises(TypeError):
        t().increment("age", float("nan"))
    assert t().upsert([{"name": "Al", "email": "a@x"}, {"name": "New", "email": "n@x"}, {"name": "Newer", "email": "n@x"}], "email", ["name"]) == 3
    assert t().order_by("id").pluck("name") == ["Al", "Bob", "Carol", "Dave", "Newer"]
    with pytest.raises(exceptions.SchemaException):
        t().upsert([{"name": "x", "email": "y"}], "name")
    assert t().update_or_insert({"email": "b@x"}, {"name": "Bobby"}) and t().find(2)["name"] == "Bobby"
    t().truncate()
    assert t().count() == 0 and t().insert_get_id({"name": "Z", "email": "z"}) > 21


def test_multi_entry_and_keyless(db):
    t = lambda: db.table("tagged")
    t().insert([{"title": "one", "tags": ["a", "b"]}, {"title": "two", "tags": ["c", "c"]}, {"title": "none"}])
    with pytest.raises(exceptions.UniqueConstraintViolationException):
        t().insert({"title": "x", "tags": ["b", "z"]})
    assert t().where_json_contains("tags", "a").explain() == "index:tagged_tags_unique"
    assert t().upsert([{"title": "ONE", "tags": ["a", "d"]}], "tags") == 1 and t().find(1)["title"] == "ONE" and t().find(1)["tags"] == ["a", "d"]
    with pytest.raises(exceptions.UniqueConstraintViolationException):
        t().upsert([{"title": "both", "tags": ["a", "c"]}], "tags")
    db.table("tallies").insert([{"count": 5}, {"count": 5}])
    assert db.table("tallies").get() == [{"count": 5}, {"count": 5}] and db.table("tallies").limit(1).delete() == 1
    db.table("slugs").insert({"slug": "s", "label": "L"})
    assert db.table("slugs").find("s")["label"] == "L"


def test_transactions(db):
    events = []
    for key in ("transaction-beginning", "transaction-committed", "transaction-rolled-back"):
        db.listen(key, lambda e: events.append(e.key))
    held = []

    def fails(tx):
        held.append(tx)
        tx.table("users").delete()
        assert db.table("users").count() == 0
        db.transaction(lambda inner: inner.table("posts").delete())
        raise ValueError("stop")

    with pytest.raises(ValueError):
        db.transaction(fails)
    assert db.table("users").count() == 4 and db.table("posts").count() == 4
    with pytest.raises(exceptions.TransactionClosedException):
        held[0].table("users")
    assert db.transaction(lambda tx: tx.table("users").where("id", 1).delete()) == 1 and db.table("users").count() == 3
    with pytest.raises(exceptions.SchemaException):
        db.transaction(lambda tx: tx.table("posts").get(), tables=["users"])
    assert events == ["transaction-beginning", "transaction-rolled-back", "transaction-beginning", "transaction-committed", "transaction-beginning", "transaction-rolled-back"]
    other = DatabaseManager().configure({"connections": {"app": {"path": db.connection()._root, "database": db.connection().database}}}).connection()
    stale, seen = other._catalog(), []
    other.manager.listen("database-blocked", lambda e: seen.append(e.key))
    other.manager.listen("database-version-changed", lambda e: seen.append(e.key))
    db.table("posts").where("id", 1).delete()
    with pytest.raises(exceptions.DatabaseBlockedException):
        other._commit(stale)
    assert other.table("posts").count() == 3 and seen == ["database-blocked", "database-version-changed"]


def test_migrations(db):
    c = db.connection()
    assert db.status() == [{"migration": "create_users", "ran": True}]
    seen = []
    db.listen("no-pending-migrations", seen.append)
    assert db.migrate() == [] and len(seen) == 1

    class Bad(Migration):
        def up(self):
            Schema.table("users", lambda t: t.string("nick").default("x"))
            Schema.table("users", lambda t: t.integer("level"))

    c.migrations.append(Bad)
    with pytest.raises(exceptions.SchemaException, match="level"):
        db.migrate()
    assert not c.schema().has_column("users", "nick")
    c.migrations.pop()

    class Better(Migration):
        def up(self):
            Schema.table("users", lambda t: (t.string("nick").default("x"), t.rename_column("email", "mail"), t.drop_column("age")))
            DB.table("users").where("id", 1).update({"nick": "y"})
            Schema.rename("posts", "articles")

    c.migrations.append(Better)
    assert db.migrate() == ["better"]
    assert db.table("users").pluck("nick") == ["y", "x", "x", "x"] and [i.name for i in c.get_indexes("users")] == ["users_mail_unique", "users_role_index"]
    assert db.table("articles").count() == 4 and c.get_tables() == ["articles", "slugs", "tagged", "tallies", "users"]
    c.migrations.pop(0)
    with pytest.raises(exceptions.MigrationMismatchException):
        db.migrate()
    with pytest.raises(exceptions.SchemaException):
        Schema.create("late", lambda t: t.id())


@pytest.mark.parametrize("declare", [
    lambda t: (t.id(), t.id("other")), lambda t: (t.string("a"), t.string("a")), lambda t: t.index("missing"), lambda t: t.boolean("b").index(), lambda t: t.string("k").primary().nullable(), lambda t: t.string("a.b"),
    lambda t: t.string("x as y"), lambda t: t.integer("i").default("abc"), lambda t: t.decimal("d").default(19.99), lambda t: t.decimal("d", 1.5), lambda t: t.enum("e", []), lambda t: t.enum("e", ["a"]).default("b"),
    lambda t: t.string("s").default(None), lambda t: t.drop_column("none"),
])
def test_refused_blueprints(db, declare):
    class Refused(Migration):
        def up(self):
            Schema.create("refused", declare)

    db.connection().migrations.append(Refused)
    with pytest.raises(exceptions.SchemaException):
        db.migrate()
    assert not db.connection().schema().has_table("refused")


def test_columns_and_coercion(db):
    class More(Migration):
        def up(self):
            Schema.create("items", lambda t: (t.id(), t.decimal("price").nullable(), t.enum("status", ["draft", "live"]).default("draft"), t.boolean("on").nullable(), t.datetime("at").nullable(), t.float("f").nullable(), t.json("j").nullable(), t.string("s").nullable()))

    db.connection().migrations.append(More)
    db.migrate()
    t = lambda: db.table("items")
    t().insert({"price": "1999", "on": "false", "at": "2024-01-15", "f": "1.5", "j": '{"b":1,"a":[1.0]}', "s": 5.0})
    row = t().first()
    assert (row["price"], row["status"], row["on"], row["at"].isoformat(), row["f"], row["j"], row["s"]) == (1999, "draft", False, "2024-01-15T00:00:00", 1.5, {"a": [1], "b": 1}, "5")
    for bad, error in (({"price": 19.99}, TypeError), ({"status": "x"}, exceptions.CheckConstraintViolationException), ({"at": "soon"}, TypeError), ({"f": "x"}, TypeError), ({"j": "{"}, TypeError)):
        with pytest.raises(error):
            t().insert(bad)
    db.connection().strict = False
    t().insert({"price": -2.5, "at": "soon", "f": "x", "j": "{"})
    assert t().order_by("id", "desc").select("price", "at", "f", "j").first() == {"price": -2, "at": None, "f": None, "j": None}
    with pytest.raises(exceptions.NotNullConstraintViolationException):
        t().insert({"status": "x"})
    assert db.connection().estimate()["usage"] > 0 and db.persist()


def test_events_log_seeding_and_fresh(db):
    db.enable_query_log()
    db.flush_query_log()
    queries = []
    db.on_query_executed(queries.append, once=True)
    db.table("users").where("id", 1).get()
    db.table("users").count()
    db.disable_query_log()
    db.table("users").count()
    assert [(e["table"], e["plan"], e["records"]) for e in db.get_query_log()] == [("users", "key", 1), ("users", "scan", 4)] and len(queries) == 1 and not db.logging()
    seeded = []
    db.listen("seeder-ended", seeded.append)
    db.seed()
    assert db.table("users").where("name", "Seed").count() == 1 and seeded[0].seeder == "Users"
    db.fresh(seed=True)
    assert db.table("users").pluck("name") == ["Seed"]
    with pytest.raises(exceptions.ConnectionNotConfiguredException):
        db.connection("none")


def test_binding_and_literals():
    loop = []
    loop.append(loop)
    with pytest.raises(TypeError):
        literals.flattened(loop)
    assert literals.flattened([[], {"a": [3]}]) == 3 and literals.flattened([]) is False
    assert literals.instant("2024-02-30", "UTC") is None and literals.instant("2024", "UTC") is None
    assert literals.instant("2024-03-10T02:30", "America/New_York").isoformat() == "2024-03-10T07:30:00"
    assert literals.like_pattern("%%%a\\%b\\c") == "%a\\%b\\\\c"


def test_plans_push_down(spark):
    from quarry.sources.external import opened

    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    c = opened(spark, "/root/testdata/sf0.001", ("orders", "customer"))
    plan = c.table("orders").where_date("o_orderdate", "1996-03-01").where_in("o_custkey", [1, 2]).select("o_orderkey").to_df()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "In(o_custkey" in plan and "o_totalprice" not in plan.split("ReadSchema")[1]
    joined = c.table("orders").join("customer", "orders.o_custkey", "customer.c_custkey").select("c_name").to_df()._jdf.queryExecution().executedPlan().toString()
    assert "HashJoin" in joined and "NestedLoop" not in joined


def test_joins_of_two_kinds_are_by_keys(spark):
    """Numbers, texts and values inside JSON are joined by keys, and match as they do pair by pair."""
    from quarry.database.manager import DatabaseManager

    inside = ["1", "1.0", "0", "-0.0", '"1"', '"1.0"', '" 1 "', '"0x1"', '"x"', '""', "true", "null", "[1]", '"[1]"', '{"a":1,"b":2}', '{"b":2,"a":1}']
    texts = ["1", "1.0", " 1 ", "0x1", "1e0", "", "-0", "x", "[1]", "n1.0", "null", None]
    rows = [(i, (None, 0, 1, 2)[i % 4], texts[i % len(texts)], (True, False, None)[i % 3], '{"v":%s}' % inside[i] if i < len(inside) else ("{}", None, "1", '"1"')[i % 4]) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, n long, t string, b boolean, j string").selectExpr("*", "timestamp_ntz '1970-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, n / 1000) AS at")
    c = DatabaseManager().configure({"connections": {"files": {}}}).connection()
    for t in ("a", "b"):
        c.register(t, df, ("id",), ("j",))
    pairs = [("n", "t"), ("t", "n"), ("n", "b"), ("at", "t"), ("j", "n"), ("j->v", "n"), ("j->v", "t"), ("t", "j->v"), ("j->v", "j->v"), ("j->v", "j")]
    for first, operator, second in [(x, "=", y) for x, y in pairs] + [(x, "===", y) for x, y in pairs[5:9]] + [("n", "===", "t")]:
        found = c.table("a").join("b", f"a.{first}", operator, f"b.{second}").select("a.id as x", "b.id as y").to_df()
        plain = c.table("a").cross_join("b").where_column(f"a.{first}", operator, f"b.{second}").select("a.id as x", "b.id as y").to_df()
        want = sorted(tuple(r) for r in plain.collect())
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, (first, operator, second)
        assert sorted(tuple(r) for r in found.collect()) == want and bool(want) == (operator + second != "===t" or first != "n"), (first, operator, second)
        left = c.table("a").left_join("b", f"a.{first}", operator, f"b.{second}").select("a.id as x", "b.id as y").to_df()
        lone = set(range(20)) - {x for x, _ in want}
        assert sorted(map(repr, map(tuple, left.collect()))) == sorted(map(repr, want + [(x, None) for x in lone])), (first, operator, second)


def test_json_is_parsed_once_a_row_and_condition(spark, tmp_path):
    """Constraints on one JSON column parse it once, beside others that are pushed down, and keep their three values."""
    from quarry.database.manager import DatabaseManager
    from quarry.functions import predicate
    from quarry.plans import contract

    plan = contract.QUERIES["json_structural"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parsejson") + plan.lower().count("parse_json") == 1 and plan.count("get_json_object") <= 1
    inside = ["1", "5", '"5"', '"x"', "true", "null", "[1]", '[1,"x"]', '{"a":1}', "[true]"]
    docs = ['{"v":%s,"w":%s}' % (v, w) for v in inside for w in inside] + ["{}", '{"v":1}', '{"w":"5"}', "broken", None]
    spark.createDataFrame([(i, d, d, i % 3) for i, d in enumerate(docs)], "id long, doc string, other string, n long").coalesce(1).write.parquet(str(tmp_path / "t"))
    c = DatabaseManager().configure({"connections": {"files": {}}}).connection()
    c.register("t", spark.read.parquet(str(tmp_path / "t")), ("id",), ("doc", "other"))
    t = lambda: c.table("t")
    either, neither = lambda q: q.where("doc->v", ">", 3).or_where("n", 1), lambda q: q.where("doc->w", "x").where_column("doc->v", "doc->w")
    queries = [
        t().where("doc->v", ">", 3).where_not("doc->w", "x").where("id", "<", 90),
        t().where_column("doc->v", "doc->w").or_where_column("t.doc->v", "<", "t.doc->w").or_where("n", 2),
        t().where(either).where_not(neither).where_not_null("doc->w"),
        t().where_not(neither).or_where_in("doc->v", [1, "x"]).or_where_null("doc->w"),
        t().where_column("doc->v", "other->w").where("other->w", "!=", 5).where("doc->w", "!=", 5).where_not_in("doc->v", [1, "x"]),
        t().where_json_contains("doc->v", 1).where_json_length("doc->v", ">", 1).or_where_between("doc->w", [2, 6]),
    ]
    for q in queries:
        compiled = q._compiled()
        each = compiled.query.constraints
        alone = compiled.scope.frames["t"].select("id", *[predicate.compile_one(x, compiled.scope.resolve, "UTC").alias(f"c{i}") for i, x in enumerate(each)])
        want = []
        for row in alone.collect():
            groups: list = [[]]
            for i, x in enumerate(each):
                if i and x.conjunction == "or":
                    groups.append([])
                groups[-1].append(row[f"c{i}"])
            want += [row["id"]] if any(all(g) for g in groups) else []
        assert sorted(q.pluck("id")) == sorted(want) and 0 < len(want) < len(docs)
    assert "LessThan(id,90)" in queries[0].to_df()._jdf.queryExecution().executedPlan().toString()
    both = queries[4].to_df()._jdf.queryExecution().optimizedPlan().toString().lower()
    assert both.count("parsejson") + both.count("parse_json") <= 4


def files(c, table):
    entry = c._catalog()["tables"][table]
    return {f for s in entry["segments"] for f in c._store.files(s)} - set(entry.get("without", ()))


def test_writes_leave_untouched_files(db, spark):
    c, t = db.connection(), lambda: db.table("users")
    many = spark.range(100, 900, 1, 8).selectExpr("id", "concat('n', id) AS name", "concat(id, '@y') AS email", "CAST(id AS int) AS age")
    assert t().insert(many) == 800 and t().count() == 804
    before = files(c, "users")
    n = len(before)
    assert n > 3
    assert t().where("id", 150).update({"name": "changed"}) == 1
    after = files(c, "users")
    assert len(before & after) == n - 1 and t().find(150)["name"] == "changed" and t().count() == 804
    assert t().where("id", 250).delete() == 1 and len(after & files(c, "users")) == n - 1 and t().count() == 803
    held = files(c, "users")
    assert t().upsert([{"name": "up", "email": "350@y"}, {"name": "new", "email": "new@y"}], "email", ["name"]) == 2
    assert len(held & files(c, "users")) == len(held) - 1 and t().find(350)["name"] == "up" and t().count() == 804
    assert t().in_random_order().limit(5).update({"role": "drawn"}) == 5 and t().where("role", "drawn").count() == 5
    with pytest.raises(exceptions.UniqueConstraintViolationException, match="users_email_unique"):
        t().where("id", 300).update({"email": "301@y"})
    with pytest.raises(exceptions.UniqueConstraintViolationException):
        t().where("id", ">", 890).update({"email": "same@y"})
    assert t().where("id", ">=", 100).where("id", "<", 900).delete() == 799 and t().count() == 5
    rows = t().get()
    c.compact("users")
    assert t().get() == rows and len(c._catalog()["tables"]["users"]["segments"]) == 1


def test_inserts_of_dataframes(db, spark):
    t = lambda: db.table("users")
    two = spark.createDataFrame([("X", "x@x", "7"), ("Y", "y@x", None)], "name string, email string, visits string")
    assert t().insert(two.where("visits is not null")) == 1
    x = t().where("email", "x@x").first()
    assert (x["id"], x["visits"], x["role"]) == (5, 7, "member") and x["created_at"] is not None
    with pytest.raises(exceptions.NotNullConstraintViolationException, match="visits"):
        t().insert(two.where("visits is null"))
    with pytest.raises(exceptions.UniqueConstraintViolationException, match="users_email_unique"):
        t().insert(two.drop("visits"))
    with pytest.raises(TypeError):
        t().insert(spark.createDataFrame([("Z", "z@x", "many")], "name string, email string, visits string"))
    with pytest.raises(exceptions.SchemaException):
        t().insert(two.withColumnRenamed("visits", "none"))
    assert t().insert_or_ignore(two.drop("visits").unionByName(two.drop("visits"))) == 1 and t().count() == 6
    assert t().insert(spark.range(50).selectExpr("concat('m', id) AS name", "concat(id, '@m') AS email").repartition(4)) == 50
    assert sorted(t().where("id", ">", 6).pluck("id")) == list(range(7, 57)) and t().insert_get_id({"name": "L", "email": "l@x"}) == 57
    assert db.table("tallies").insert(spark.range(3).selectExpr("id AS count")) == 3 and db.table("tallies").count() == 3
    assert db.table("tagged").insert(spark.createDataFrame([("a", '["q", "r"]')], "title string, tags string")) == 1 and db.table("tagged").where_json_contains("tags", "q").count() == 1


def test_a_commit_has_one_name(db):
    store, catalog = db.connection()._store, db.connection()._catalog()
    draft = store._path(f"{store.root}/catalog/_draft")
    store._fs.create(draft, False).close()
    assert not store._named(draft, store._path(f"{store.root}/catalog/{catalog['version']}.json")) and store.load()["tables"].keys() == catalog["tables"].keys()
