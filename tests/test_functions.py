import random
import re

from pyspark.sql import functions as F

from codesift.functions import folds, text as T
from codesift.functions.dialect import alternatives, is_literal, portable, required_literals
from codesift.functions.expr import quoted


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first()[0]


def rlike(spark, text, pattern):
    return one(spark, text, F.col("t").rlike(portable(pattern)))


def test_dialect_traps(spark):
    assert rlike(spark, "a b", r"a\sb")  # every Unicode space
    assert not rlike(spark, "a b", r"a.b")  # a dot stops at line ends
    assert not rlike(spark, "x {\n", r"\{$")  # the end is the very end
    assert rlike(spark, "a\nvar x", r"^^var")
    assert rlike(spark, "a\nb", r"a[\s\S]b")
    assert not rlike(spark, "x = x + 1", r"\w\s*=\s*\+\s*1")
    assert one(spark, "\U0001f6a8", F.length("t")) == 1


def test_literals():
    assert alternatives(r"a|(b|c)|[|]|\|") == ["a", "(b|c)", "[|]", r"\|"]
    assert is_literal(r"db\.") == "db." and is_literal(r"a\s") is None and is_literal(r"\w") is None
    assert {"token"} in required_literals(r"token.*expired") and {"expired"} in required_literals(r"token.*expired")
    assert required_literals(r"(?:ab|cd)?x*") == []


def plain_depths(lines):
    stack, out = [], []
    for line in lines:
        net = line.count("{") - line.count("}")
        if re.match(r"\s*(for|while)\s*\(", line) or re.search(r"\.(forEach|map|filter|reduce)\s*\(", line):
            stack.append(net)
        elif stack:
            stack[-1] += net
            while stack and stack[-1] <= 0:
                stack.pop()
        out.append(len(stack))
    return out


def test_loop_depth_against_plain_python(spark):
    rnd = random.Random(7)
    parts = ["for (a of b) {", "x.map(y => y)", "}", "if (c) {", "s += 'q';", "while (d) e();", "z.filter(f => {", "});", "} else {", ""]
    cases = [[rnd.choice(parts) for _ in range(rnd.randint(1, 40))] for _ in range(200)]
    cases.append([rnd.choice(parts) for _ in range(3000)])
    cases.append(["for (a of b) {", " x += 'q'", "}", "y = arr.map(z => z+1)", "w = 1", "v += 'n'"])
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, l array<string>")
    rows = "transform(l, (s, k) -> named_struct('n', k + 1, 's', s))"
    got = {r.i: r.d for r in df.selectExpr("i", f"{folds.loop_depths(rows)} AS d").collect()}
    for i, c in enumerate(cases):
        assert got[i] == plain_depths(c)
    assert got[len(cases) - 1] == [1, 1, 0, 1, 0, 0]
    inside = {r.i: r.d for r in df.selectExpr("i", f"transform({folds.rows_in_loops(rows)}, r -> r.n) AS d").collect()}
    for i, c in enumerate(cases):
        assert inside[i] == [k + 1 for k, d in enumerate(plain_depths(c)) if d > 0]


def test_names_and_languages(spark):
    rows = [("a.JAVA", ""), (".js", "def f(x):"), ("d/.x", "public class A"), ("a.tar.gz", ""), ("x", " import os"), ("x", "import os"), ("h.h", "")]
    df = spark.createDataFrame(rows, "n string, t string")
    got = [tuple(r) for r in df.select(T.file_extension(F.col("n")), T.detect_language(F.col("n"), F.col("t"))).collect()]
    assert got == [(".java", "java"), ("", "python"), ("", "java"), (".gz", "javascript"), ("", "javascript"), ("", "python"), (".h", "cpp")]
    p = [r[0] for r in spark.createDataFrame([("a.cs",), ("a.CPP",), ("js",)], "n string").select(T.prompt_language(F.col("n"))).collect()]
    assert p == ["text", "c++", "javascript"]


def test_seconds_match_ecmascript(spark):
    df = spark.range(0, 6000).select("id", T.seconds_text(F.col("id")).alias("s"))
    from decimal import ROUND_HALF_UP, Decimal
    for r in df.collect():
        assert r.s == f"{Decimal(r.id / 1000).quantize(Decimal('0.1'), ROUND_HALF_UP)}s", r.id


def test_small_helpers(spark):
    assert one(spark, " ```json\n{}\n``` ", T.strip_fences(F.col("t"))) == "{}"
    assert one(spark, "```", T.strip_fences(F.col("t"))) == ""
    assert one(spark, "x", T.parse_int(F.col("t"), 5)) == 5
    assert one(spark, "0", T.count_default(F.col("t").cast("int"))) == 1
    assert one(spark, None, T.count_default(F.col("t").cast("int"))) == 1
    assert one(spark, "2.5", T.round_half_up(F.col("t").cast("double"))) == 3
    assert one(spark, "it's", F.expr(f"t = {quoted(chr(105) + 't' + chr(39) + 's')}"))
