import pytest

from tagtrail.llm import source_spans
from tagtrail.llm.doc_pairs import description, is_trivial, pairs

SCHEMA = "point_id string, language string, content string, key string, name string, symbol_kind string"
DOC = "/** The sorted cart must render every price of the page. */"


def found(spark, *rows):
    df = spark.createDataFrame([(p, lang, c, "k", "n", "class") for p, lang, c in rows], SCHEMA)
    return sorted(tuple(r) for r in pairs(df).select("point_id", "function_name").collect())


def names(content, language):
    return [f[0] for f in source_spans.functions(source_spans.prepared(content, language), language)]


PHP = f"""<?php
class A {{
    {DOC}
    // a note
    #[Route('/x', methods: ['GET'])]
    final public static function &good(array $a = ['x' => 1]): ?array
    {{
        {DOC}
        $x = $this->call('function fake() {{}}');
        $f = function () {{ return 1; }};
        $s = <<<'S'
        {DOC}
        function heredoc() {{}}
        S;
    }}
    {DOC}
    const X = 1;
    public function undocumented() {{}}
    {DOC}
    abstract protected function noBody(int $x): void;
    /* The sorted cart must render every price of the page. */
    public function plainComment() {{}}
    {DOC}
    public function cutOff(string $a
"""


def test_php(spark):
    assert names(PHP, "php") == ["good", "undocumented", "noBody", "plainComment", "cutOff"]
    assert found(spark, ("p", "php", PHP)) == [("p", "cutOff"), ("p", "good"), ("p", "noBody")]
    assert found(spark, ("p", "PHP ", PHP.replace("\n", "\r\n").replace("    ", "\t"))) == [("p", "cutOff"), ("p", "good"), ("p", "noBody")]


SCRIPT = f"""import a from 'b';
{DOC}
export default async function top(x: number): Promise<void> {{
    {DOC}
    helper(x);
    {DOC}
    const y = 1;
    if (x) {{ other(); }}
}}
export class K extends B<string> {{
    {DOC}
    private field: string;
    {DOC}
    @Input()
    private async method<T>(a: Map<string, T>, b = {{ c: 1 }}): Promise<T> {{ return `${{a ? `/** no */` : '}}'}}`; }}
    {DOC}
    arrow = async (x) => x + 1;
    {DOC}
    static get size(): number {{ return /[/'"]/.test('x') ? 1 : 2; }}
    {DOC}
    abstract sign(x: number): void;
}}
interface I {{
    {DOC}
    declared(x: string): void;
}}
export default {{
    methods: {{
        {DOC}
        short(a, b) {{ return a; }},
        {DOC}
        long: function () {{ return 1; }},
        {DOC}
        lambda: async ({{ a }}) => {{ return a; }},
        {DOC}
        data: {{ x: 1 }},
        {DOC}
        value: compute(1),
    }},
}};
"""


@pytest.mark.parametrize("language", ["typescript", "javascript"])
def test_scripts(spark, language):
    want = ["arrow", "declared", "lambda", "long", "method", "short", "sign", "size", "top"]
    assert sorted(names(SCRIPT, language)) == want
    assert [n for _, n in found(spark, ("p", language, SCRIPT))] == want


LONG = f"""{DOC}
@Decorated({{ a: '{'x' * 2000}', b: [1, (2)], }})
async far(): Promise<void> {{}}
"""


def test_no_distance_hides_a_declaration(spark):
    many = ", ".join(f"Long{i}<T{i}>" for i in range(120))
    assert len(many) > 1000
    interface = f"export interface I extends {many} {{\n{DOC}\nload(id: string): void\n{DOC}\nlast(): Map<string, () => void>\n}}\n"
    got = found(spark, ("a", "typescript", "class K {\n" + LONG + "}\n"), ("b", "typescript", interface), ("c", "typescript", "x = {" + "\n" * 900 + LONG + "}"))
    assert got == [("a", "far"), ("b", "last"), ("b", "load"), ("c", "far")]


def test_members_without_a_semicolon_and_types_of_functions():
    text = f"""abstract class K extends mixin({{ a: 1 }}) {{
    abstract one(x: string): (a: number) => void
    two?(a): {{ b: string }} | null
    abstract three()
    private value = compute(1)
    other =
        compute(2)
    handler = () =>
        compute(3)
    'quoted key'(a) {{ return a ? call(b) : call(c) }}
    four(): Promise<Array<{{ x: number }}>> {{ return 1 }}
}}
type T = {{ five(a: string): asserts a is string, six(): void }}
export default defineComponent({{ 'seven': function (a) {{}}, eight: wrap(a) }})
const n = a
    ? call(b)
    : call(c)
"""
    assert sorted(names(text, "typescript")) == sorted(["one", "two", "three", "quoted key", "four", "five", "six", "seven", "handler"])


def test_vue_scripts_alone_count(spark):
    vue = f"<template>\n<p>don't `{DOC}\nfoo(a) {{ }}</p>\n</template>\n<script>\nexport default {{\n{DOC}\nrun() {{}},\n}};\n</script>\n<style>{DOC} .a(b) {{}}</style>"
    assert found(spark, ("p", "vue", vue)) == [("p", "run")]
    assert found(spark, ("p", "vue", f"{DOC}\nrun() {{}}")) == [("p", "run")]


@pytest.mark.parametrize(
    "text, name, trivial",
    [
        ("", "f", True), ("Sorts the cart", "f", True), ("Sort cart price list now please", "sortCartPriceList", True),
        ("The sorted cart must render every price", "sortCart", False), ("TODO: describe what this method does and why it exists", "f", True),
        ("Auto-generated method stub, documentation has to be written later", "f", True), ("Hier fehlt noch eine Beschreibung dieser Methode", "f", True),
        ("For the description see the parent class or its interface", "f", True), ("[Insert a short description of this function here]", "f", True),
        ("This function is not documented yet, please add a description", "f", True), ("TODO: describe. The sorted cart must render every price.", "f", False),
        ("The inherited cart must render every missing price", "f", False), ("Returns the description of the parent product", "f", False),
        ("Builds the auto-generated promotion code of an order", "f", False), ("Placeholder values are replaced by the renderer", "f", False),
        ("Please document this function later on, it is still undocumented", "f", True), ("Documentation for this method will follow in a later release", "f", True),
        ("Die Dokumentation dieser Funktion wird noch nachgetragen, bitte ergänzen", "f", True), ("A comment is required for every rejected order", "f", False),
    ],
)
def test_trivial(text, name, trivial):
    assert is_trivial(text, name) is trivial


def test_description():
    assert description("/** {@inheritDoc} */") == "" and description("/** @var Foo $x the long story of it */") == ""
    assert description("/**\n * <p>One <b>two</b></p>\n * three\n *\n * @param x four\n * five\n */").split() == ["One", "two", "three"]


def test_corners(spark):
    assert found(spark) == []
    rows = [("p", "php", f"{DOC} function a() {{}}")] * 3 + [(None, "php", PHP), ("q", "php", None), ("r", "twig", PHP), ("s", None, PHP), ("t", "php", ""),
            ("u", "php", "/** never closed function a() {}"), ("v", "javascript", "`${"), ("w", "php", "<<<X\n" + DOC), ("x", "php", "#[" * 50)]
    assert found(spark, *rows) == [("p", "a")]
    long = f"{DOC} function b() {{}}\n" + "$x = 1;\n" * 20000
    assert found(spark, ("p", "php", long)) == [("p", "b")]


def test_code_and_description(spark):
    df = spark.createDataFrame([("p", "php", f"{DOC}\npublic function a() {{ return '}}'; }} $x;", "k", "n", "c")], SCHEMA)
    (row,) = pairs(df).collect()
    assert row["code"] == "function a() { return '}'; }" and row["description"] == "The sorted cart must render every price of the page."
