import uuid

from pyspark.sql import functions as F

from lodestone.functions import paths, text


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", make(F.col("v")).alias("r")).collect()
    return [r["r"] for r in sorted(rows)]


def test_language(spark):
    names = ["lib/a.TSX", "ops/Dockerfile.prod", ".dockerfile", "notes", "a.", "x.dockerfile", "a.hpp", "b.h", "Dockerfile", "c.d.py"]
    assert column(spark, names, paths.language) == ["typescript", "dockerfile", None, None, None, "dockerfile", "cpp", "c", "dockerfile", "python"]


def test_ignored_and_binary(spark):
    assert column(spark, [".cache", "build", "src", "foo.egg-info"], paths.is_ignored_dir) == [True, True, False, False]
    assert column(spark, ["a/.env", "build/x", "x/.git/y", "src/build"], paths.in_ignored_dir) == [False, True, True, False]
    assert column(spark, ["a.PNG", "b.svg", "c.txt", ".png"], paths.is_binary) == [True, True, False, False]
    assert [paths.binary_name(n) for n in ("a.PNG", "c.txt", ".png")] == [True, False, False]


def test_lines(spark):
    assert column(spark, ["a\nb", "a\r\nb\r\n", "", "a\rb\n"], text.count_lines) == [2, 2, 0, 2]
    for make, plain in ((text.lines, lambda s: s.split("\n")), (text.split_lines, str.splitlines)):
        values = ["a\nb\n", "", "x", "a\r\nb\x0bc\u2028d\n\n"]
        assert column(spark, values, make) == [plain(v) for v in values]


def test_strip_and_tokens(spark):
    values = ["  a b\u00a0", "\t\x1cx\u3000", "", "   "]
    assert column(spark, values, text.strip) == [v.strip() for v in values]
    assert column(spark, values, text.tokens) == [v.lower().split() for v in values]


def test_modules(spark):
    values = ["src/a.py", "src\\b.py", "src/a.js", "x"]
    assert column(spark, values, text.module_strict) == ["src.a", "src.b", None, None]
    assert column(spark, values, text.module_lenient) == ["src.a", "src.b", "src.a.js", "x"]


def test_uuid5(spark):
    values = ["src/utils.py_0", "", "é_1"]
    assert column(spark, values, text.uuid5_dns) == [str(uuid.uuid5(uuid.NAMESPACE_DNS, v)) for v in values]
    assert column(spark, values[:1], text.uuid5_dns) == ["6e58aebd-8a3a-5f31-b558-4cceea2fcc96"]


def test_decode(spark):
    rows = spark.createDataFrame([(bytearray(b"a\xffb\r\nc"),), (bytearray(b""),)], "c binary").select(text.decode(F.col("c")).alias("t")).collect()
    assert [r["t"] for r in rows] == ["ab\nc", ""]


def test_stand_in_vectors(spark):
    """Against the generator written out: the seed is the SHA-256 of the text, read as a number."""
    import hashlib
    import random

    from lodestone.operators import chunks

    rows = spark.createDataFrame([(1, "a text"), (2, ""), (3, None)], "id int, content string")
    for r in chunks.embed(rows).collect():
        draw = random.Random(int.from_bytes(hashlib.sha256((r["content"] or "").encode()).digest(), "big"))
        want = [draw.uniform(-0.1, 0.1) for _ in range(384)]
        assert len(r["embedding"]) == 384 and all(abs(a - b) < 1e-8 for a, b in zip(r["embedding"], want))
