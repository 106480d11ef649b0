import pytest
from pyspark.sql import functions as F

from tagtrail.functions import embedding, reading, routing, versions
from tagtrail.functions import text as T


def column(spark, values, expr, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr("v").alias("x")).collect()]


@pytest.mark.parametrize(
    "function, cases",
    [
        (reading.tag, {"v6.5.2.0": "v6.5.2.0", " V6.5.2.0\t": "v6.5.2.0", "refs/tags/v6.5.2.0": "v6.5.2.0", "6.5.2.0": "v6.5.2.0", " ": None, None: None}),
        (reading.version, {"tag:v6.5.2.0": "v6.5.2.0", "6.5.2.0": "v6.5.2.0", "": None}),
        (reading.deprecated_in, {"v6.8.0.0": "v6.8.0", "tag:v6.8.0": "v6.8.0", "6.8.0 ": "v6.8.0", "v6.8.10": "v6.8.10", "\n": None}),
        (reading.file_path, {"./src//A/./B.php": "src/A/B.php", "/src\\A.php ": "src/A.php", "././a": "a", "Src/A": "Src/A", " ": None}),
        (reading.content_sha, {"SHA256:AB": "ab", "0xAB\n": "ab", " ab": "ab", "": None}),
        (reading.symbol_fqn, {"\\A\\B::c()": "A\\B::c", " A ": "A", "()": None, None: None}),
    ],
)
def test_spellings(spark, function, cases):
    assert column(spark, list(cases), function) == list(cases.values())


def test_area_and_candidates(spark):
    cases = {
        "src/Core/Framework/A.php": ("core", True), "src/Core/Checkout/Cart/A.php": ("checkout", True),
        "src/Storefront/Resources/views/storefront/page/checkout/x.html.twig": ("checkout", True),
        "./src/Core/Content/Flow/X.php": ("flow", True), "src/Core/Contents/Flow.php": ("core", True),
        "docs/UPGRADE-6.7.md": ("other", True), "UPGRADE-6.7.md": ("changes", True), "changelog/release-6-7-0-0/x.md": ("changes", True),
        "src/Administration/a.vue": ("administration", True), "src/Core/Test/A.php": ("core", False),
        "src/Core/Testing/A.php": ("core", True), "src/a.Spec.js": ("other", True), "src/a.spec.js": ("other", False),
        "vendor/x/A.php": ("other", False), "src/Core/Migration_1.php": ("core", False), "README": ("other", False),
    }
    assert column(spark, list(cases), routing.area) == [a for a, _ in cases.values()]
    assert column(spark, list(cases), routing.is_candidate) == [c for _, c in cases.values()]


def test_language(spark):
    cases = {"a.PHP": "php", "a.html.twig": "twig", "a.yml": "yaml", ".php": None, "a": None, "x.d/a": None, "a.md": "markdown", None: None}
    assert column(spark, list(cases), routing.language) == list(cases.values())


def test_versions(spark):
    cases = {"6.5.2.0": [6, 5, 2, 0], "6.10": [6, 10], "6.x": None, "": None, None: None}
    assert column(spark, list(cases), versions.version_tuple) == list(cases.values())
    assert column(spark, ["6.4.20.2"], lambda v: versions.after_up_to(F.col(v), "6.4.3.0", "6.5.0.0")) == [True]
    assert column(spark, ["6.4.20.2"], lambda v: versions.after_up_to(F.col(v), "6.4.3.0", "6.5.0.0", numeric=False)) == [False]
    assert column(spark, ["v6.7.0.0-rc1", "v6.10.0.1"], versions.tag_order) == [[0, 0, 0, 0], [6, 10, 0, 1]]
    assert versions.parsed("6.5.0.0") < versions.parsed("6.10.0.0") and versions.parsed("six") == ()


def test_names_in_texts(spark):
    assert column(spark, [".card { } .a .b > .c.d:hover{} .i>.j{ .card:x"], T.css_classes) == [["card", "d", "j"]]
    php = "class A {\n  public function a(int  $x,\n $y) {}\n  static function b() {}\n final public function no() {}\n  function a() {}\n}\nfinal class K"
    assert column(spark, [php], lambda c: T.php_methods(c)) == [{"b": "", "a": ""}]
    assert column(spark, [php], lambda c: T.name_set(c, T.PHP_TYPE)) == [["A", "K"]]
    assert column(spark, ["@deprecated tag:v6.7.0 @deprecated tag:v6.8.0.1", "none", None], T.last_deprecation) == ["v6.8.0.1", None, None]
    assert column(spark, ["x" * 5, "x" * 6], lambda c: T.snippet(c, 5)) == ["xxxxx", "xxxxx…"]
    assert column(spark, ["core", "what"], T.section_rank) == [2, 8]
    assert column(spark, ["changelog/release-6-7-2-0/a.md", "b/c.md"], T.target_version) == ["6.7.2.0", None]


def test_embedding_text(spark):
    rows = [("markdown", "f", "n", "p", "c"), ("php", "", "", "p", "c"), ("php", "", "bar", "p", "a bar"), ("php", "A::b", "b", "p", "x")]
    df = spark.createDataFrame(rows, "l string, f string, n string, p string, c string")
    got = [r[0] for r in df.select(T.embedding_text("l", "f", "n", "p", "c")).collect()]
    assert got == ["c", "p\nc", "a bar", "A::b\nx"]


def test_cosine_and_embedder(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), (None, [1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(T.cosine("a", "b")).collect()]
    assert got[0] == pytest.approx(0.5**0.5) and got[1:] == [None, None, None]
    embedder = embedding.hashing_embedder(32)
    texts = spark.createDataFrame([("cart price",), (None,), ("",)], "t string")
    vectors = [r[0] for r in texts.select(embedding.embed("t", embedder)).collect()]
    assert len(vectors[0]) == 32 and vectors[1] is None
    assert embedding.embed_one("cart price", embedder, "document") == pytest.approx(vectors[0])


def test_read_text(spark):
    df = spark.createDataFrame([(bytearray(b"a\r\nb\rc\xff"),)], "v binary")
    assert df.select(T.read_text("v")).first()[0] == "a\nb\nc�"
