import pytest

from tagtrail.operators.chunking import FIELDS, chunk_files, php_symbols
from tagtrail.plans.code_index import chunk_documents

SCHEMA = "version string, file_path string, area string, language string, content string"


def chunks(spark, path, language, content, area="core"):
    df = spark.createDataFrame([("6.7.0.0", path, area, language, content)], SCHEMA)
    return [r.asDict() for r in chunk_files(df).orderBy("chunk_idx").collect()]


def test_scss(spark):
    one = chunks(spark, "src/a.scss", "scss", ".card { }\n.btn, .x:hover {}\n.card { }")
    assert [c["css_classes"] for c in one] == [["btn", "card", "x"]] and one[0]["symbol_kind"] == "file" and one[0]["end_line"] == 3
    assert chunks(spark, "src/a.css", "css", ".a{}")[0]["language"] == "scss"
    assert chunks(spark, "src/a.scss", "scss", " \n ") == []


def test_xml_and_long_content(spark):
    (one,) = chunks(spark, "src/a.xml", "xml", "<a>" + "x" * 5000)
    assert len(one["content"]) == 2000 and one["symbol_name"] == "a.xml"


TWIG = (
    "{% sw_extends '@S/base.html.twig' %}\n{# @deprecated tag:v6.8.0 - gone #}\n{% block outer %}\n{% block title %}T{% endblock %}\n"
    "{% block body %}B{% endblock %}\n{% endblock %}\n{% block meta %}m{% endblock meta %}\n"
)


def test_twig_ends_are_given_out_in_order(spark):
    file, *blocks = chunks(spark, "src/p.html.twig", "twig", TWIG)
    assert file["extends_target"] == "@S/base.html.twig" and file["deprecated_in"] == "v6.8.0" and file["end_line"] == 8
    assert [(b["symbol_name"], b["start_line"], b["end_line"]) for b in blocks] == [
        ("outer", 3, 4), ("title", 4, 5), ("body", 5, 6), ("meta", 7, 7)
    ]
    assert len(chunks(spark, "src/p.twig", "twig", "{% block a %}{% endblock %}")) == 1


def test_vue(spark):
    text = "<template>\n<div/>\n</template>\n<script>\nComponent.override('my-comp', {});\n</script>\n"
    assert [(c["symbol_kind"], c["symbol_name"], c["start_line"], c["end_line"]) for c in chunks(spark, "src/x.vue", "vue", text)] == [
        ("vue_template", "my-comp", 1, 3), ("vue_script", "my-comp", 4, 6)
    ]
    assert [c["symbol_kind"] for c in chunks(spark, "src/x.vue", "vue", "plain")] == ["vue_component"]


def test_scripts(spark):
    text = "import a;\nexport default class Foo {\n}\nconst b = 1;\nexport abstract class Bar {}\n"
    got = chunks(spark, "src/x.ts", "ts", text)
    assert [(c["symbol_kind"], c["symbol_name"], c["start_line"], c["end_line"]) for c in got] == [
        ("ts_class", "Foo", 2, 3), ("ts_const", "b", 4, 4), ("ts_class", "Bar", 5, 5)
    ]
    assert [c["symbol_kind"] for c in chunks(spark, "src/x.js", "js", "let a;")] == ["file"]


def test_changelog(spark):
    text = "---\ntitle: 'T'\nissue: NEXT-1\nauthor: me\n---\n# Core\n* one\n# API\n* two\n"
    got = chunks(spark, "changelog/release-6-7-2-0/x.md", "markdown", text, "changes")
    assert [(c["section"], c["content"], c["start_line"], c["end_line"]) for c in got] == [
        ("core", "T\n\n# Core\n* one", 1, 4), ("api", "T\n\n# API\n* two", 1, 4)
    ]
    assert {(c["target_version"], c["issue"], c["author"], c["flag"], c["symbol_name"]) for c in got} == {("6.7.2.0", "NEXT-1", "me", None, "T")}
    (plain,) = chunks(spark, "changelog/_unreleased/y.md", "markdown", "no headers", "changes")
    assert (plain["section"], plain["target_version"], plain["symbol_name"]) == ("general", None, "y.md")
    assert chunks(spark, "changelog/_unreleased/y.md", "markdown", "---\ntitle: T\n---\n\n", "changes") == []
    (prose,) = chunks(spark, "changelog/_unreleased/y.md", "markdown", "# core\n\nsome text", "changes")
    assert prose["section"] == "core\n\nsome text"


def test_upgrade_notes(spark):
    text = "lead\n# 6.7.2.0\nhello\n## First\nx\n## Second\ny\n# 6.7.1.0\nonly\n"
    got = chunks(spark, "UPGRADE-6.7.md", "markdown", text, "changes")
    assert [(c["symbol_name"], c["start_line"], c["end_line"]) for c in got] == [
        ("6.7.2.0 — intro", 2, 3), ("6.7.2.0 — First", 4, 6), ("6.7.2.0 — Second", 6, 8), ("6.7.1.0 — general", 8, 10)
    ]
    assert [c["target_version"] for c in chunks(spark, "UPGRADE-6.7.md", "markdown", "nothing", "changes")] == [None]


PHP = """<?php
namespace A\\B;
/** doc
 * @deprecated tag:v6.8.0 x */
#[Package('x')]
final class Foo extends Bar
{
    /** hello */
    #[Route(path: '/a', methods: ['GET'])]
    public function bar(int $x): void { $s = '}'; /* } */ }
    // @deprecated tag:v6.9.0
    private function helper() {}
    /** @deprecated tag:v6.7.0 a
     *  @deprecated tag:v6.9.0 b */
    abstract protected function legacyMethod();
}
interface Z { public function q(); }
"""


def test_php(spark):
    got = chunks(spark, "src/A.php", "php", PHP)
    assert [(c["symbol_kind"], c["symbol_fqn"], c["deprecated_in"]) for c in got] == [
        ("class", "A\\B\\Foo", "v6.8.0"), ("method", "A\\B\\Foo::bar", None), ("method", "A\\B\\Foo::helper", None),
        ("method", "A\\B\\Foo::legacyMethod", "v6.9.0"), ("interface", "A\\B\\Z", None), ("method", "A\\B\\Z::q", None),
    ]
    assert got[0]["content"].startswith("/** doc") and got[0]["content"].endswith("final class Foo extends Bar")
    assert got[1]["content"].startswith("/** hello */\n#[Route") and got[1]["class_name"] == "Foo"
    assert (got[0]["start_line"], got[0]["end_line"]) == (5, 16)


@pytest.mark.parametrize("text", ["", "<?php echo 1;", "<?php namespace A { class B {} }", "<?php class", "<?php class A { function f("])
def test_php_corners(text):
    kinds = [s["symbol_kind"] for s in php_symbols(text, "x.php")]
    assert kinds == (["class", "method"] if "f(" in text else ["file"])


def test_files_that_give_nothing(spark):
    rows = [("6.7.0.0", "a.yaml", "core", "yaml", "a: 1"), ("6.7.0.0", "a.md", "core", "markdown", "x"), ("6.7.0.0", "b.php", "other", "php", "x"),
            ("6.7.0.0", "c.php", "core", None, "x"), ("6.7.0.0", "d.php", "core", "php", None)]
    out = chunk_files(spark.createDataFrame(rows, SCHEMA))
    assert out.count() == 0 and set(FIELDS) <= set(out.columns)
    assert chunk_files(spark.createDataFrame([], SCHEMA)).count() == 0


def test_point_ids_are_stable_and_distinct(spark):
    a, b = (chunks(spark, "src/A.php", "php", PHP) for _ in range(2))
    assert [c["point_id"] for c in a] == [c["point_id"] for c in b] and len({c["point_id"] for c in a}) == len(a)
    assert all(len(c["point_id"]) == 36 for c in a)


def test_php_by_type(spark):
    text = "<?php\nnamespace A\\B;\n/** x\n * @deprecated tag:v6.8.0 y\n */\nfinal class One {\n function f() {}\n}\n\nclass Two {}\n"
    df = spark.createDataFrame([("6.7.0.0", "src/A.php", "core", "php", text), ("6.7.0.0", "src/B.php", "core", "php", "<?php echo 1;")], SCHEMA)
    got = [r for r in chunk_files(df, ids=False, methods=False).orderBy("file_path", "chunk_idx").collect()]
    assert [(r["symbol_kind"], r["symbol_fqn"], r["deprecated_in"], r["start_line"], r["end_line"]) for r in got] == [
        ("class", "A\\B\\One", "v6.8.0", 3, 9), ("class", "A\\B\\Two", "v6.8.0", 10, 10), ("file", "", None, 1, 1)
    ]
    assert got[0]["content"].startswith("/** x") and got[0]["content"].endswith("}")


def test_documents_without_kind_go_by_their_path(spark, tmp_path):
    log, notes, code = "---\ntitle: T\n---\n# Core\n* x\n", "# 6.7.0.0\n## One\nx\n", "<?php\nclass A {}\n"
    rows = [
        ("./p//changelog/a.md", None, log), ("p/changelog/b.md", "changelog", log), ("p/upgrade/c.md", None, notes), ("x/UPGRADE-6.7.md", "upgrade", notes),
        ("p/php/d.php", None, code), ("p/twig/e.html.twig", " ", "{% block a %}{% endblock %}"), ("p/script/f.ts", None, "class A {}"), ("p/scss/g.scss", None, ".a{}"),
        ("p/guide/h.md", None, "# Core\nx"), ("p/issue/i.txt", None, "x"), ("p/guide/changelog/j.md", "guide", log), (None, "php", code), ("p/php/k.php", None, None),
    ]
    spark.createDataFrame([(*r, "v6.7.0.0") for r in rows], "file_path string, kind string, text string, version string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [r.asDict() for r in chunk_documents(spark, str(tmp_path)).collect()]
    assert {(r["file_path"], r["language"], r["symbol_kind"]) for r in got} == {
        ("p/changelog/a.md", "markdown", "changelog_entry"), ("p/changelog/b.md", "markdown", "changelog_entry"), ("p/upgrade/c.md", "markdown", "upgrade_note"),
        ("x/UPGRADE-6.7.md", "markdown", "upgrade_note"), ("p/php/d.php", "php", "class"), ("p/twig/e.html.twig", "twig", "file"), ("p/script/f.ts", "ts", "ts_class"),
        ("p/scss/g.scss", "scss", "file"), (None, "php", "class"),
    }
    assert len({r["point_id"] for r in got}) == len(got) and {tuple(r["version_tuple"]) for r in got} == {(6, 7, 0, 0)}
    assert [r["css_classes"] for r in got if r["language"] == "scss"] == [["a"]]


def test_texts_of_many_pieces(spark):
    text = "// first\n" + "".join(f"const a{i} = 1;\n" + "//\n" * (i % 3) for i in range(700))
    got = chunks(spark, "src/x.ts", "ts", text)
    starts, at = [], 2
    for i in range(700):
        starts.append((f"a{i}", at, at + i % 3))
        at += 1 + i % 3
    assert [(c["symbol_name"], c["start_line"], c["end_line"]) for c in got] == starts


def test_blocks_of_a_long_template_against_a_loop(spark):
    import random
    import re

    rng = random.Random(3)
    part = lambda i: rng.choice([f"{{% block n{i} %}}", "{% endblock %}", "x", "\n", "é\n"])
    text = "".join(part(i) for i in range(2500))
    ends, free, want = [m for m in re.finditer(r"\{% endblock %\}", text)], 0, []
    line = lambda at: text.count("\n", 0, at) + 1
    for m in re.finditer(r"\{% block (\w+) %\}", text):
        end = next((e for e in ends if e.start() > m.end() and e.start() >= free), None)
        if end:
            free = end.end()
            want.append((m.group(1), line(m.start()), line(free), text[m.start() : free][:2000]))
    _, *blocks = chunks(spark, "src/p.html.twig", "twig", text)
    assert len(want) > 257 and [(b["symbol_name"], b["start_line"], b["end_line"], b["content"]) for b in blocks] == want
