"""Source operators on files written by hand."""

from tessera.operators import catalog as G
from tessera.operators import source as S


def test_lines_of_odd_files(spark):
    rows = [
        ("null", "python", None), ("empty", "python", ""), ("doc", "python", '"""a\n\nb"""\nx = "#"  # y\n'), ("plain", None, "# a\n\nb\n"),
        ("open", "typescript", "a\n/* never\n\nclosed"), ("quote", "typescript", "s = '/* no */'\n// 'yes\nt = `//\nx`"), ("sql", "sql", "select 1 -- a\n-- b\n"),
    ]
    got = {r.path: (r.total, r.code, r.comment, r.blank) for r in S.line_totals(spark.createDataFrame(rows, "path string, language string, text string")).collect()}
    # A docstring is a comment, in line counts as in metrics.
    assert got == {"null": (1, 0, 0, 1), "empty": (1, 0, 0, 1), "doc": (4, 1, 2, 1), "plain": (3, 2, 0, 1), "open": (4, 1, 2, 1), "quote": (4, 3, 1, 0), "sql": (2, 1, 1, 0)}


def test_function_spans(spark):
    js = "function a(x) {\n  const b = (y, z) => {\n    return y ? 1 : 2;\n  }\n  if (x) { b(1) }\n}\nfunction c() { return 1 }\nfunction d() {\n  open("
    py = "class A:\n    def one(self):\n        if x:\n            pass\n\n    def two(self, a):\n        def inner():\n            return 1\n        return inner\nz = 1\ndef last():\n    pass"
    go = "func (s *S) Run(a int, b int) {\n\tfor {\n\t\tselect {\n\t\tcase <-a:\n\t\t}\n\t}\n}\n"
    rb = "def go?(a)\n  x unless a\nend\n"
    files = spark.createDataFrame([("j", "javascript", js), ("p", "python", py), ("g", "go", go), ("r", "ruby", rb), ("n", "python", None), ("m", "markdown", "def x()")], "path string, language string, text string")
    got = {(r.path, r.name): (r.line_no, r.end_line, r.parameters, r.complexity) for r in S.function_units(files).collect()}
    assert got == {
        ("j", "a"): (1, 6, 1, 3), ("j", "b"): (2, 4, 2, 2), ("j", "c"): (7, 7, 0, 1), ("j", "d"): (8, 9, 0, 1),
        ("p", "one"): (2, 5, 1, 2), ("p", "two"): (6, 9, 2, 1), ("p", "inner"): (7, 8, 0, 1), ("p", "last"): (11, 12, 0, 1),
        ("g", "Run"): (1, 7, 2, 4), ("r", "go?"): (1, 2, 1, 2),
    }


def spans(spark, language, text):
    df = spark.createDataFrame([("f", language, text)], "path string, language string, text string")
    return {r.name: (r.line_no, r.end_line, r.parameters, r.complexity) for r in S.function_units(df).collect()}


def test_headers_over_lines(spark):
    assert spans(spark, "typescript", "function a(\n  x,\n  y\n) {\n  if (x) y();\n}\n") == {"a": (1, 6, 2, 2)}
    assert spans(spark, "python", "def f(\n    a,\n    b,\n):\n    if a:\n        return b\n\nx = 1\n") == {"f": (1, 7, 2, 2)}
    assert spans(spark, "java", "class A {\n  public int run(int x, Map<K, V> y)\n  {\n    return x > 0 ? 1 : 2;\n  }\n\n  void b() throws E, F {\n  }\n}\n") == {"run": (2, 5, 2, 2), "b": (7, 8, 0, 1)}
    assert spans(spark, "rust", "pub fn go(\n    a: i32,\n    f: (u8, u8),\n) -> i32\n{\n    a\n}\nfn z() {}\n") == {"go": (1, 7, 2, 1), "z": (8, 8, 0, 1)}
    assert spans(spark, "go", "func (s *Server) Serve(\n\ta int,\n) error {\n\tif a > 1 {\n\t}\n}\n") == {"Serve": (1, 6, 1, 2)}
    assert spans(spark, "c", "static int add(int a,\n               int b)\n{\n  return a + b;\n}\n") == {"add": (1, 5, 2, 1)}


def test_methods_and_calls(spark):
    text = """class A {
  constructor(private x: number) {
    super(x);
  }
  async run({ a, b }, cb = () => 1): Promise<void> {
    if (a) { b(); } else if (b) {
      for (const x of a) {
      }
    }
  }
  get size() { return 1 }
}
describe('a', () => {
  it("b", function () {
    const inner = async (x) => {
      return x;
    };
  });
});
const f = function (a, b) {
};
"""
    got = spans(spark, "typescript", text)
    assert got == {"constructor": (2, 4, 1, 1), "run": (5, 10, 2, 4), "size": (11, 11, 0, 1), "inner": (15, 17, 1, 1), "f": (20, 21, 2, 1)}


def test_module_imports(spark):
    def found(language, text):
        df = spark.createDataFrame([("f", language, text)], "path string, language string, text string")
        return sorted((r.line_no, r.specifier, r.kind) for r in S.module_imports(df).collect())

    js = "import a, {\n  b\n} from './x';\nimport 'side'\n/* import y from 'no' */\nexport { z } from \"./z\"\nconst q = require('q'), r = require('q')\nawait import('./lazy')\nimport type T from 't'\nconst s = \"import k from 'k'\""
    assert found("typescript", js)[:6] == [(1, "./x", "static"), (4, "side", "side-effect"), (6, "./z", "reexport"), (7, "q", "require"), (8, "./lazy", "dynamic"), (9, "t", "static")]
    assert found("python", "from . import a\nfrom ..b.c import (\n  d,\n)\nimport e, f.g as h\n# import no\nx = 'import no'\n") == [(1, ".", "static"), (2, "..b.c", "static"), (5, "e", "static"), (5, "f.g", "static")]
    assert found("go", 'import (\n\t"a"\n\t_ "b/c" // why\n)\nimport d "e"\n') == [(1, "a", "static"), (1, "b/c", "static"), (5, "e", "static")]
    assert found("kotlin", "import a.b.C\nimport d.*\n") == [(1, "a.b.C", "static"), (2, "d.*", "static")]
    assert found("rust", "pub use a::b;\npub(crate) mod c;\n") == [(1, "a::b", "static"), (2, "c", "module")]
    assert found("scss", '@use "a";\n@import url(b.css);\n') == [(1, "a", "static"), (2, "b.css", "static")]
    assert found("python", None) == [] and found("markdown", "import a") == []


def test_parameters(spark):
    from pyspark.sql import functions as F

    from tessera.operators.code import parameter_count

    want = {"f(cb = () => 1, b, c)": 3, "f()": 0, "f( )": 0, "f(a,)": 1, "f(a, (b, c), [d, e], {f, g})": 4, "f(m: Map<K, V>, n)": 2, "f": 0, "f(a, g(h(i, j), k), l) { x(1, 2, 3) }": 3, "f(a": 0}
    rows = spark.createDataFrame([(k,) for k in want], "h string").select("h", parameter_count(F.col("h")).alias("n")).collect()
    assert {r.h: r.n for r in rows} == want


def test_import_resolution(spark):
    files = spark.createDataFrame([(p,) for p in ("src/a.ts", "src/a.py", "src/lib/index.tsx", "pkg/__init__.py", "pkg/mod.py", "src/b.vue", "src/x.test.ts")], "path string")
    links = [
        ("src/m.ts", "./a", "src/a.ts"), ("src/m.ts", "./a.js", "src/a.ts"), ("src/m.ts", "./lib", "src/lib/index.tsx"), ("src/lib/q.ts", "../b", "src/b.vue"), ("pkg/mod.py", ".", "pkg/__init__.py"),
        ("src/m.py", "pkg.mod", "pkg/mod.py"), ("src/m.ts", "@/lib", "src/lib/index.tsx"), ("src/m.ts", "/src/a.py", "src/a.py"), ("src/m.ts", "react", None), ("src/m.ts", "./x", None), ("src/m.ts", None, None),
    ]
    got = S.resolve_imports(spark.createDataFrame(links, "path string, specifier string, want string"), files, {"@": "src"}).collect()
    assert len(got) == len(links) and all(r.target == r.want for r in got), got


def test_flattening_takes_no_broken_text(spark):
    rows = [(1, None), (2, "no json"), (3, "{}"), (4, '{"paths": {"/a": {"get": {}, "trace": {}}}}')]
    ops = G.flattened(spark.createDataFrame(rows, "k int, text string"), "k")
    assert [(r.k, r.method, r.path, r.id, r.statuses) for r in ops.collect()] == [(4, "get", "/a", None, [])]
    assert {r.problem for r in G.lint_operations(ops, "k").collect()} == {"no-id", "no-response", "no-success-response", "no-error-response", "no-summary"}


def test_scores_of_nothing(spark):
    cases = spark.createDataFrame([(1, None, None, None, None), (2, '```json\n{"a": 1}\n```', "b", ["A"], ["z"])], "k int, output string, expected string, must array<string>, never array<string>")
    got = {(r.k, r.scorer): (r.score, r.weight) for r in G.scored_outputs(cases, "k").collect()}
    assert {s: w for (k, s), (_, w) in got.items() if k == 1} == {"exact-match": 0, "contains": 0, "not-contains": 0, "json-valid": 1, "regex": 0, "length": 1, "similarity": 0}
    assert got[2, "contains"] == (1, 1) and got[2, "not-contains"] == (1, 1) and got[2, "json-valid"] == (1, 1) and got[1, "json-valid"] == (0, 1)
