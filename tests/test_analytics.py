import random

from tagtrail.operators import analytics
from tagtrail.operators.greedy import first_accepted

SCHEMA = (
    "point_id string, version string, area string, file_path string, language string, symbol_kind string, symbol_name string, symbol_fqn string, "
    "deprecated_in string, content string, css_classes array<string>, target_version string, section string, issue string"
)
BASE = dict.fromkeys([c.split()[0] for c in SCHEMA.split(", ")])


def chunks(spark, *rows):
    full = [tuple((BASE | {"point_id": f"p{i:03}", "content": "", "symbol_name": "", "symbol_fqn": ""} | r).values()) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def test_deprecations_group_by_symbol(spark):
    one = {"area": "core", "symbol_fqn": "A::b", "symbol_name": "b", "deprecated_in": "v6.8.0"}
    df = chunks(
        spark, one | {"version": "6.6.0.0", "file_path": "first"}, one | {"version": "6.4.1.0"}, one | {"version": "6.5.0.0"},
        {"area": "core", "symbol_name": "cart", "deprecated_in": "v6.7.0", "version": "6.4.20.2"},
        {"area": "core", "symbol_name": "cart", "deprecated_in": "v6.7.0", "version": "6.4.3.0"},
        {"area": "core", "symbol_name": "x", "version": "6.4.3.0"}, {"area": "changes", "symbol_name": "y", "deprecated_in": "v6"},
        {"area": "core", "deprecated_in": "v6"},
    )
    got = {r["symbol_fqn"]: r for r in analytics.deprecations(df).collect()}
    assert set(got) == {"A::b", "cart"}
    assert (got["A::b"]["first_version_seen"], got["A::b"]["last_version_seen"], got["A::b"]["file_path"]) == ("6.4.1.0", "6.6.0.0", "first")
    assert got["cart"]["first_version_seen"] == "6.4.20.2"  # as strings
    numeric = {r["symbol_fqn"]: r for r in analytics.deprecations(df, numeric=True).collect()}
    assert numeric["cart"]["first_version_seen"] == "6.4.3.0"
    assert [r["symbol_fqn"] for r in analytics.deprecations(df, "CART").collect()] == ["cart"]
    assert analytics.deprecations(df, area="nowhere").count() == 2 and analytics.deprecations(df, area="flow").count() == 0


def test_css_class(spark):
    df = chunks(
        spark, {"area": "storefront", "language": "scss", "css_classes": ["card"]}, {"area": "storefront", "language": "twig", "content": "a cardinal"},
        {"area": "core", "language": "scss", "css_classes": ["card"]}, {"area": "storefront", "language": "vue", "content": "card"},
        {"area": "flow", "language": "twig", "content": "card"},
    )
    assert sorted(r["kind"] for r in analytics.css_class(df, ".card").collect()) == ["definition", "usage", "usage"]
    assert [r["point_id"] for r in analytics.css_class(df, "card", limit=1).filter("kind = 'usage'").collect()] == ["p001"]
    assert [tuple(r) for r in analytics.css_usage(df).collect()] == [("card", 1, 1)]


def entry(file, section, issue=None, target="6.5.0.0", **more):
    return {"area": "changes", "file_path": file, "section": section, "issue": issue, "target_version": target, "symbol_name": file} | more


def test_upgrade_path_keeps_the_first_of_issue_and_of_file_and_section(spark):
    df = chunks(
        spark, entry("f1", "core", "I1"), entry("f1", "api", "I1"), entry("f2", "core"), entry("f2", "core"), entry("f3", "core", "I1"),
        entry("f4", None, target="6.4.0.0"), entry("f5", None, target="6.6.0.0"), entry("f6", None, target="x"), entry("f7", "Api", target="6.4.20.0"),
    )
    got = [(r["section"], r["place"], r["changelog_path"]) for r in analytics.upgrade_path(df, "6.4.0.0", "6.5.0.0").orderBy("section_rank", "place").collect()]
    assert got == [("core", 1, "f1"), ("core", 2, "f2"), ("api", 1, "f7")]
    kept = analytics.upgrade_path(df, "6.4.0.0", "6.5.0.0", keep_sections=True)
    assert {(r["changelog_path"], r["section"]) for r in kept.collect()} == {("f1", "core"), ("f1", "api"), ("f2", "core"), ("f3", "core"), ("f7", "api")}
    assert analytics.upgrade_path(df, "6.5.0.0", "6.4.0.0").count() == analytics.upgrade_path(df, "six", "6.5.0.0").count() == 0
    assert analytics.upgrade_path(df, "6.4.0.0", "6.5.0.0", ["API"]).count() == 2 and analytics.upgrade_path(df, "6.4.0.0", "6.5.0.0", limit=1).count() == 2


def test_upgrade_path_takes_repeated_rows_as_one(spark):
    one = entry("f1", "core", "I1") | {"point_id": "p1"}
    df = chunks(
        spark, one | {"symbol_name": "b"}, one | {"symbol_name": "a", "issue": "I2"}, one | {"symbol_name": "a", "issue": "I3"}, one | {"symbol_name": "a", "issue": "I2"},
        entry("f2", "core", "I2") | {"point_id": "p2"}, entry("f3", "core", "I1") | {"point_id": "p3"}, entry("f4", "core") | {"point_id": "p4"},
    )
    for limit in (50, 3):
        got = analytics.upgrade_path(df, "6.4.0.0", "6.5.0.0", limit=limit).orderBy("place").collect()
        assert [(r["place"], r["changelog_path"], r["title"], r["issue"]) for r in got] == [(1, "f1", "a", "I2"), (2, "f3", "f3", "I1"), (3, "f4", "f4", None)]


def test_greedy_rounds_equal_a_loop(spark):
    rng = random.Random(5)
    for _ in range(3):
        rows = [(i, rng.sample(range(12), rng.randrange(0, 3))) for i in range(60)]
        seen, want = set(), set()
        for i, keys in rows:
            if not seen & set(keys):
                want.add(i)
                seen |= set(keys)
        df = spark.createDataFrame([(i, i) for i, _ in rows], "row_id int, rank int")
        keys = spark.createDataFrame([(i, i, f"k{k}") for i, ks in rows for k in ks], "row_id int, rank int, key string")
        assert {r[0] for r in first_accepted(df, keys.select("row_id", "key"), keys).collect()} == want


def test_file_changes(spark):
    schema = "file_path string, content string, at string"
    before = spark.createDataFrame([
        ("a.php", "function a(int $x) {}\n", "1"), ("b.html.twig", "{% block x %}{% block y %}", "1"), ("c.scss", ".a{}", "1"),
        ("gone.ts", "class A {}", "1"), ("n.php", None, "1"),
    ], schema)
    after = spark.createDataFrame([
        ("a.php", "function a(int $x,  $y) {}\nfunction b() {}\nclass K {}\n/** @deprecated tag:v6.8.0 */", "1"),
        ("b.html.twig", "{% block y %}{% block z %}", "1"), ("c.scss", ".b{}", "1"), ("new.xml", "<a/>", "1"),
    ], schema)
    got = {r["file_path"]: r for r in analytics.file_changes(before, after).collect()}
    assert (got["a.php"]["added"], got["a.php"]["removed"], got["a.php"]["changed"]) == (["b", "K"], [], ["a"])
    assert got["a.php"]["new_deprecations"] == ["@deprecated tag:v6.8.0"]
    assert (got["b.html.twig"]["added"], got["b.html.twig"]["removed"]) == (["z"], ["x"])
    assert (got["c.scss"]["added"], got["c.scss"]["removed"]) == (["b"], ["a"])
    assert (got["gone.ts"]["exists_before"], got["gone.ts"]["exists_after"], got["gone.ts"]["removed"]) == (True, False, [])
    assert got["new.xml"]["language"] == "xml" and got["n.php"]["added"] == []
    rows = {tuple(r) for r in analytics.symbol_changes(before, after).collect()}
    assert rows == {
        ("a.php", "method", "a", "changed"), ("a.php", "method", "b", "added"), ("a.php", "type", "K", "added"),
        ("a.php", "deprecation", "@deprecated tag:v6.8.0", "added"), ("b.html.twig", "block", "z", "added"), ("b.html.twig", "block", "x", "removed"),
        ("c.scss", "class", "b", "added"), ("c.scss", "class", "a", "removed"),
    }


def test_related_changelog(spark):
    df = chunks(
        spark, entry("c1", "core", content="see src/a/FooService.php"), entry("c1", "api", content="FooService.php"), entry("c2", None, content="x FooService.php y", symbol_kind="changelog_entry"),
        entry("c3", "core", content="FooService.php", target="6.9.0.0"), entry("c4", "core", content="src/a/x.php"), entry("c5", "core", content="x.php"),
    )
    got = analytics.related_changelog(df, "src/a/FooService.php", "6.4.0.0", "6.5.0.0").collect()
    assert [(r["changelog_path"], r["section"]) for r in got] == [("c1", "core"), ("c2", "changelog_entry")]
    assert [r["changelog_path"] for r in analytics.related_changelog(df, "src/a/x.php", "6.4", "6.5.0.0").collect()] == ["c4"]
    paths = spark.createDataFrame([("src/a/FooService.php",), ("src/a/x.php",)], "file_path string")
    got = {(r[0], r[1]) for r in analytics.changelog_mentions(df, paths).collect()}
    assert got == {("src/a/FooService.php", c) for c in ("c1", "c2", "c3")} | {("src/a/x.php", "c4")}


def test_a_path_is_found_behind_any_folder(spark):
    said = [("vendor/x/src/a/FooService.php", "c1"), ("see ./src/a/FooService.php.", "c2"), ("Core/FooService.php", "c3"), ("XFooService.php", "c4"), (None, "c5")]
    df = chunks(spark, *[{"area": "changes", "content": t, "file_path": c} for t, c in said])
    paths = spark.createDataFrame([("src/a/FooService.php",), ("src/a/FooService.php",)], "file_path string")
    assert sorted(r[1] for r in analytics.changelog_mentions(df, paths).collect()) == ["c1", "c2", "c3"]
