"""Long Python sources: parsed in runs of statements, with the symbols, lines and errors of the whole source."""

import ast
import tracemalloc

import pytest
from pyspark.sql import functions as F

from lodestone.operators import chunks, quality, symbols
from lodestone.plans import corpora as C

PIECES = [p.replace("{0}", str(i)).replace("{1}", str(i % 7)) for i in range(40) for p in C.PYTHON + C.PYTHON_MORE]
ODD = [
    "", "\n\n", "x = 1", "# only\n# comments\n", "if a:\n    def f(): pass\nelif b:\n    class D: pass\nelse:\n    import z\ntry:\n    pass\nexcept E:\n    y = 2\nfinally:\n    pass\nw = 3\n",
    'x = """\ndef no(): pass\nclass No: pass\n"""\n@deco\n@other\ndef f(a,\nb,\n):\n    return (\n1\n)\ny = [\n1,\n]\n', "a = 1 + \\\n2\r\ndef f():\r    pass\r\nb = 'x'\n", "match x:\n    case 1:\n        def g(): pass\n\f\ndef h(): pass\n",
    "\n".join(PIECES),
]
BROKEN = [x + end for x in (ODD[5], ODD[-1]) for end in ("\n  z = 1\n", "\nelse:\n    pass\n", '\n"""never ends\nx = 1\n', "\nf(\n", "\nx = $\n", "\n@deco\n", "\n)\ny = 1\n", "\0")]


@pytest.mark.parametrize("code", ODD + BROKEN)
def test_runs_give_the_whole(code):
    try:
        ast.parse(code)
        error = None
    except SyntaxError as e:
        error = f"SyntaxError at line {e.lineno}: {e.msg}"
    whole = symbols.parse(code, 1 << 30)
    assert whole["error"] == error and whole["valid"] == (error is None) and whole["total_lines"] == len(code.splitlines())
    for size in (1, 40, 500):
        assert symbols.parse(code, size) == whole
        assert symbols.blocks(code, size) == [(b["start"], b["end"]) for b in whole["blocks"]]


def test_memory_is_that_of_a_run():
    """Tokens for tokens, a tree takes some hundred times the room of its source: that of a long one is never held."""
    code = "\n".join(f"total = f{i}(a + b, c[{i}], d.e, g=[{i}, {i + 1}])" for i in range(20000))
    tracemalloc.start()
    assert len(symbols.parse(code)["variables"]) == 20000
    room = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    chunks.tile_starts(code, 4)
    tiles = tracemalloc.get_traced_memory()[1] - tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert room < 30 * len(code) and tiles < 10 * len(code)


def test_parts(spark):
    code = "\n".join(PIECES * 8)
    files = spark.createDataFrame([("a.py", "python", code), ("b.py", "python", code + "\nx = ("), ("c.rb", "ruby", "x"), ("d.py", "python", None), ("e", None, "y")], "path string, language string, code string")
    whole, parts = symbols.analyze(files).cache(), symbols.analyze_parts(files).cache()
    assert {r["path"]: r["count"] > 2 for r in parts.groupBy("path").count().collect()} == {"a.py": True, "b.py": False, "c.rb": False, "d.py": False, "e": False}
    assert symbols.repository_summary(parts).collect() == symbols.repository_summary(whole).collect()
    for kind in ("functions", "classes", "imports", "variables"):
        one, other = (symbols.symbols(d, kind).drop("ordinal").withColumn("x", F.lit(1)) for d in (whole, parts))
        assert one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty() and not one.isEmpty()
    assert quality.quality(files).where("type = 'Naming Convention Violation'").count() == 2 * 40 * 8  # Bad and low_ of each, of a.py alone


def test_tiles_of_a_long_source(spark):
    """Tiles of a source of many runs keep within definitions, and together are the source."""
    code = "\n".join(PIECES * 8)
    files = spark.createDataFrame([("a.py", code)], "path string, code string")
    rows = chunks.chunk_python(files, "path", "code", 4).orderBy("chunk_index").collect()
    assert "\n".join(r["content"] for r in rows) == code and [r["chunk_index"] for r in rows] == list(range(len(rows)))
    starts = {b["start"] for b in symbols.parse(code, 1 << 30)["blocks"]}
    assert len(code) > 4 * symbols.RUN and starts <= set(chunks.tile_starts(code, 4))


@pytest.mark.parametrize("code", [*ODD, "def f(): pass\r\r\r\rdef g(): pass\n", "x\n" * 9])
def test_tiles_one_by_one(code):
    """Tiles come as a stream and are the lines between their starts."""
    for size in (1, 4):
        starts, lines = chunks.tile_starts(code, size), code.split("\n")
        assert list(chunks._tiles(code, size)) == ["\n".join(lines[a:z]) for a, z in zip(starts, [*starts[1:], len(lines)])]
