"""Declarations of other languages than Python on hand-made sources: nesting, comments, strings, missing semicolons."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import declarations, symbols

SOURCES = {
    "a.js": ("javascript", "import React, { useState } from 'react';\nimport './side.css';\n// function no() {}\nexport async function load(a, b = 1, ...rest) {\n  const x = `tpl ${a}\n  function nope() {}`;\n  for (const k of a) { let inner = k; }\n  return x => x + 1;\n}\nexport default class Box extends Base {\n  constructor(w, h) { super(w); this.w = w; }\n  static async get(id) {\n    return [1, 2].map((v) => v);\n  }\n  get area() { return this.w }\n}\nvar LIMIT = 10, other = 2\nconst { p, q } = load(1, 2);\nconst add = (m, n) => {\n  return m + n;\n}\nlet s = \"it's /* no */ fine\";\nif (s) { run(); }\nconst re = /[\"']{/g;\n"),
    "b.ts": ("typescript", 'import { A } from "./a";\ninterface Shape { area(): number; }\nexport class Sq extends Other implements Shape {\n  private side: number;\n  constructor(private s: number, public name?: string) { }\n  area(): number {\n    return this.s * this.s;\n  }\n}\nfunction gen<T>(x: T, y: number = 2, { z }: any): T { return x; }\nconst f = async (a: string, b?: number): Promise<void> => { await g(a); };\nenum Color { Red }\n'),
    "C.java": ("java", 'package a.b;\nimport java.util.List;\nimport java.util.*;\nimport static java.lang.Math.max;\n\n@Entity(name = "x")\npublic class C extends Base implements Runnable, Foo<Bar> {\n    private static final int LIMIT = 10;\n    private Map<String, Integer> names = new HashMap<>();\n    int a, b;\n    public C(int a) { super(a); this.a = a; }\n    @Override\n    public void run() {\n        int count = 0;\n        String s = "x;y{";\n        for (int i = 0; i < 3; i++) { go(i); }\n        for (String t : list) { use(t); }\n        if (count > 0) { return; }\n    }\n    abstract List<String> get(final Map<String, List<Integer>> m, int[] xs, String... rest);\n    interface Inner { void m(); }\n}\n'),
    "d.cpp": ("cpp", '#include <vector>\n#include "my.h"\n#define X { ( \nnamespace n {\nclass A : public B, private C {\n public:\n  A(int x) : B(x), y(2) {}\n  int get() const { return y; }\n  int y;\n};\nstruct P;\nstruct Q { int z; };\nint total;\nint main(int argc, char** argv) {\n  int i = 0;\n  int j;\n  if (i) { j = 2; }\n  return j;\n}\nenum class E { a };\n}\n'),
    "e.go": ("go", 'package main\n\nimport "fmt"\nimport (\n\t"os"\n\t"strings"\n)\n\ntype T struct {\n\ta int\n}\ntype ID int\n\nfunc add(a, b int, c string) (int, error) {\n\tx := 1\n\tf := func(q int) int { return q }\n\treturn f(a) + x, nil\n}\n\nfunc (t *T) Name(p string) string {\n\treturn t.a\n}\nconst Max = 3\n'),
    "broken.js": ("javascript", "} ) function ( { `"),
    "none.js": ("javascript", None),
    "u.rb": ("ruby", "def x"),
    "p.py": ("python", "def f(a):\n    return a\n"),
}
FUNCTIONS = {
    "a.js": [("load", ["a"], 4, 9), ("x", [], 8, 8), ("constructor", ["w", "h"], 11, 11), ("get", ["id"], 12, 14), ("v", ["v"], 13, 13), ("area", [], 15, 15), ("<anonymous>", ["m", "n"], 19, 21)],
    "b.ts": [("constructor", ["s", "name"], 5, 5), ("area", [], 6, 8), ("gen", ["x", "y"], 10, 10), ("<anonymous>", ["a", "b"], 11, 11)],
    "C.java": [("C", ["a"], 11, 11), ("run", [], 12, 19), ("get", ["m", "xs"], 20, 20), ("m", [], 21, 21)],
    "d.cpp": [("<anonymous>", [], 6, 7), ("<anonymous>", [], 8, 8), ("<anonymous>", [], 14, 19)],
    "e.go": [("add", ["a", "c"], 14, 18), ("<anonymous>", ["t"], 20, 22)],
    "p.py": [("f", ["a"], 1, 2)],
}
CLASSES = {
    "a.js": [("Box", ["Base"], ["constructor", "get", "area"], 10, 16)],
    "b.ts": [("Sq", [], ["constructor", "area"], 3, 9)],
    "C.java": [("C", ["Base"], ["run", "get"], 6, 22), ("Inner", [], [], 21, 21)],
    "d.cpp": [("A", ["B", "C"], [], 5, 10), ("P", [], [], 11, 11), ("Q", [], [], 12, 12)],
    "e.go": [("<anonymous>", [], [], 9, 11), ("<anonymous>", [], [], 12, 12)],
}
IMPORTS = {
    "a.js": [("react", True, 1), ("./side.css", False, 2)],
    "b.ts": [("./a", True, 1)],
    "C.java": [("java.util.List", False, 2), ("java.util", False, 3), ("java.lang.Math.max", False, 4)],
    "d.cpp": [("#include <vector>", False, 1), ("my.h", False, 2)],
    "e.go": [('import "fmt"', False, 3), ('import (\n\t"os"\n\t"strings"\n)', False, 4)],
}
VARIABLES = {
    "a.js": [("x", 5, False), ("inner", 7, False), ("LIMIT", 17, True), ("{ p, q } = load(1, 2)", 18, False), ("add", 19, False), ("s", 22, False), ("re", 24, False)],
    "b.ts": [("f", 11, False)],
    "C.java": [("LIMIT", 8, True), ("names", 9, False), ("a", 10, False), ("count", 14, False), ("s", 15, False), ("i", 16, False)],
    "d.cpp": [("total", 13, False), ("j", 16, False)],
}


@pytest.fixture(scope="module")
def analyzed(spark):
    files = spark.createDataFrame([(p, *v) for p, v in SOURCES.items()], "path string, language string, code string").repartition(3)
    return {r["path"]: r for r in declarations.analyze_all(files).collect()}


@pytest.mark.parametrize("path", list(SOURCES))
def test_symbols(analyzed, path):
    r = analyzed[path]
    assert r["valid"] == (path != "u.rb") and (r["error"] is None) == r["valid"]
    assert r["total_lines"] == len((SOURCES[path][1] or "").splitlines())
    assert [(f["name"], f["args"], f["start_line"], f["end_line"]) for f in r["functions"]] == FUNCTIONS.get(path, [])
    assert all(f["line_count"] == f["end_line"] - f["start_line"] + 1 for f in r["functions"])
    assert [(c["name"], c["bases"], c["methods"], c["start_line"], c["end_line"]) for c in r["classes"]] == CLASSES.get(path, [])
    assert [(i["module"], i["is_from_import"], i["line"]) for i in r["imports"]] == IMPORTS.get(path, [])
    assert [(v["name"], v["line"], v["is_constant"]) for v in r["variables"]] == VARIABLES.get(path, [])


def test_no_python_for_tokens(spark):
    """Files of these languages go through no Python worker, and their tokens give the source back."""
    files = spark.createDataFrame([(p, *v) for p, v in SOURCES.items() if v[0] in declarations.LANGUAGES], "path string, language string, code string")
    plan = declarations.declarations(files)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "PythonUDF" not in plan
    from pyspark.sql import functions as F

    rows = files.where("code IS NOT NULL").select("code", F.array_join(declarations.tokens(F.col("language"), F.col("code")), "").alias("again")).collect()
    assert all(r["code"] == r["again"] for r in rows)


def test_sections_give_the_same(spark, analyzed):
    """Sources cut wherever they can be, comments, templates and strings that hold such places included."""
    odd = {
        "o.js": ("javascript", "let a = `x;\nfunction no() {}\n`;\nfunction yes(p) {\n}\n/* }\nclass No {}\n*/\nclass Yes {\n}\nvar z = 1;  \nconst f = (q) => {\n}\nof(1);\nlet s = 'it;\\\nlet no = 1';\nvar t = 2;\n"),
        "r.js": ("javascript", "class Yes {\n}\nvar z = 1;  \nconst f = (q) => {\n}\nof(1);\nlet s = 'it;\\\nlet no = 1';\nvar t = `;\nfunction no() {}\n`;\nvar u = 3;\n"),
        "o.go": ("go", "type A struct {\n}\nfunc f(a int) {\n}\ntype B int\nfunc g() {\n}\n"),
        "o.cpp": ("cpp", "#define X {;\nint a;\n#include \"m.h\"\nstruct S {\n};\nint f() {\n}\nint b; // };\nint c;\n} ;\nint d;\n"),
    }
    files = spark.createDataFrame([(p, *v) for p, v in (SOURCES | odd).items()], "path string, language string, code string").where(F.col("language").isin(*declarations.LANGUAGES))
    assert {p: declarations.sections(files.where(f"path = '{p}'"), "path", 1).count() for p in odd} == {"o.js": 1, "r.js": 5, "o.go": 3, "o.cpp": 5}
    whole, cut = ({(r["path"], kind, tuple(map(str, x))) for r in declarations.declared_parts(files, size=n).collect() for kind in declarations.PARTS for x in r[kind]} for n in (1 << 30, 1))
    assert whole == cut and {p for p, _, _ in whole} > set(odd)


def test_long_sources_are_bounded(spark):
    """A source of many statements gives many token arrays, none of which is broadcast."""
    code = "\n".join(f"class C{i} {{\n  int m(int a) {{ return a; }}\n}}" for i in range(5000))
    files = spark.createDataFrame([("L.java", "java", code)], "path string, language string, code string")
    parts = declarations.declared_parts(files)
    assert "SortMergeJoin" in parts._jdf.queryExecution().executedPlan().toString()
    rows = parts.select("path", F.size("classes").alias("n"), F.col("classes")[0]["start_line"].alias("line")).collect()
    assert len(rows) > 10 and sum(r["n"] for r in rows) == 5000 and max(r["n"] for r in rows) < 1000
    whole = declarations.declarations(files).first()
    assert [c["start_line"] for c in whole["classes"]] == list(range(1, 15001, 3)) and whole["total_lines"] == 15000


def test_totals_of_parts(spark):
    """Totals over parts are those over whole files, and no row holds a whole long one."""
    long_ = {"L.java": ("java", "\n".join(f"class C{i} {{\n  int m(int a) {{ return a; }}\n}}" for i in range(3000))), "l.py": ("python", "def f(): pass\n" * 9000)}
    files = spark.createDataFrame([(p, *v) for p, v in (SOURCES | long_).items()], "path string, language string, code string")
    parts = declarations.analyze_all_parts(files)
    assert symbols.repository_summary(parts).collect() == symbols.repository_summary(declarations.analyze_all(files)).collect()
    assert parts.agg(F.max(F.size("functions"))).first()[0] < 3000
