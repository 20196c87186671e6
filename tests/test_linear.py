"""Presence tests in linear form find what the fixed patterns find, and their time grows with the text."""

import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codesift.functions.dialect import alternatives
from codesift.functions.expr import rlike
from codesift.functions.linear import linear
from codesift.operators import scan as S
from codesift.rules import CATALOGUE, auth as au, semantic as sm

PATTERNS = sorted({a for p in [sm.LIMITER, sm.LOOP_WAIT, au.EXPIRED, au.RACE_GUARD, r"setTimeout.*reject", r"throw.*Error", r"retry.*after",
                               r"return\s+new Promise[^}]*\.push\s*\(\s*(?:resolve|reject|\{[^}]*resolve)"] for a in alternatives(p) if linear(a) != a})
PARTS = ["rate", "limit", "token", "bucket", "expired", "single", "refresh", "setTimeout", "reject", "throw", "Error", "retry", "after", "\n", " ", "x",
         "while (a) {", "while (", ")", "{", "}", "await", "return new Promise", ".push(", ".length", "resolve", "{ a, resolve", "}", "(", ";"]


def all_tests():
    """Every presence test of every rule."""
    for rule in CATALOGUE:
        tests = [*rule.file, *rule.line, *[t for _, _, ts in rule.frames for t in ts]]
        tests += [t for t in (rule.at, rule.head[1] if rule.head else None) if t]
        for t in tests:
            yield from ((rule.key, a) for a in alternatives(t.pattern))


OWN = [(au, n) for n in ("IF_HEAD", "BODY_ITERATES", "IF_RESOLVES", "FINALLY_FALSE", "CATCH_BLOCK")]
OWN += [(sm, n) for n in ("WHILE_HEAD", "AFTER_AWAIT", "NESTED_ARROWS", "HANDLER", "LOOP_WAIT")]
CHANGED = sorted({a for _, a in all_tests() if linear(a) != a} | {a for m, n in OWN for a in alternatives(getattr(m, n)) if linear(a) != a})


def pieces(pattern):
    """Words and signs out of which texts that nearly match are made."""
    plain = re.sub(r"\\[sSwWdD]|\(\?:|\[\^?|\]", " ", pattern).replace("\\", "")
    words = re.findall(r"[A-Za-z][A-Za-z-]*", plain)
    signs = re.findall(r"[^\sA-Za-z*?|]", plain)
    return words + [w + "(" for w in words[:2]] + signs + ["\n", " ", "x", "\r", ")", "(", "{", "}", ";", "'"]


@pytest.mark.parametrize("pattern", CHANGED)
def test_every_linear_form_finds_what_its_pattern_finds(pattern):
    r, seen, form = random.Random(2), Counter(), re.compile(python_form(linear(pattern)))
    plain, parts = re.compile(python_form(pattern)), pieces(pattern)
    head = [x for x in re.split(r"\.\*|\[\^[^\]]+\][*+]|\[.s.S\]\*\?", pattern) if x]
    parts += [sample(x) for x in head] * 3
    for _ in range(4000):
        some = [r.choice(parts) for _ in range(r.randint(1, 10))]
        if r.random() < 0.3:  # its own parts in their order, with a little between
            some = [x for h in head for x in (sample(h), r.choice(["", "", "x", " ", r.choice(parts)]))]
        text = "".join(some)
        want = plain.search(text) is not None
        assert (form.search(text) is not None) == want, (text, linear(pattern))
        seen[want] += 1
    assert seen[True] > 20 and seen[False] > 20, seen


def sample(part):
    """A text that a plain part matches."""
    part = re.sub(r"\(\?:([^|()]*)\|(?:[^()]|\([^()]*\))*\)", r"\1", part)
    part = re.sub(r"\(([^|()?]*)\|[^()]*\)", r"\1", part)
    part = re.sub(r"\\s\+", " ", re.sub(r"\\s\*", "", part))
    part = re.sub(r"\\w[*+]?", "w", part)
    part = re.sub(r"\[\^?(\\?.)[^\]]*\][*+]?", lambda m: m[1][-1], part)
    return re.sub(r"\\(.)", r"\1", re.sub(r"\(\?:|(?<!\\)[()*+?]", "", part))


def test_no_pattern_is_quadratic_in_its_own_unclosed_heads(spark):
    """Each head over and over on one line, with all other words the rule asks for in front of it."""
    slow = []
    rows = []
    for key, a in sorted(set(all_tests())):
        cut = re.split(r"\.\*|\[\^[^\]]+\][*+]|\[.s.S\]\*\?", a)
        if len(cut) > 1 and cut[0]:
            rows.append((key, a, sample(cut[0]) + " "))
    assert len(rows) > 25
    for key, a, unit in rows:
        took = []
        for n in (60_000, 240_000):
            df = spark.createDataFrame([(unit * (n // len(unit)),)], "s string")
            t = time.time()
            df.selectExpr(f"{rlike('s', a)} AS found").collect()
            took.append(time.time() - t)
        if took[1] > 1.5 and took[1] > 6 * took[0]:
            slow.append((key, a, took))
    assert not slow, slow


def python_form(p):
    return p.replace("^^", r"(?:^|\n)")


@pytest.mark.parametrize("pattern", PATTERNS)
def test_same_presence(pattern):
    r, seen = random.Random(1), set()
    for _ in range(6000):
        text = "".join(r.choice(PARTS) for _ in range(r.randint(1, 12)))
        want = re.search(pattern, text) is not None
        assert (re.search(python_form(linear(pattern)), text) is not None) == want, (text, linear(pattern))
        seen.add(want)
    assert len(PATTERNS) >= 7 and True in seen


LONG = {
    "rate limit words on one line": ("f.js", lambda n: "limit generate " * (n // 15), ["SM-14", "SM-15", "SM-16"]),
    "heads after a wait": ("f.js", lambda n: "await x;\n" + "while (a) { b(); }\n" * (n // 19), ["SM-03", "SM-04"]),
    "promises": ("f.js", lambda n: "login token return new Promise " * (n // 31), ["AU-14"]),
    "pushes": ("f.js", lambda n: "login token return new Promise " + ".push({ a " * (n // 10), ["AU-14"]),
    "resources": ("F.java", lambda n: "public class A {\n" + "Connection c = open();\n" * (n // 23) + "}", ["JV-06"]),
    "names": ("f.js", lambda n: "".join(f"const a{i} = 1;\n" for i in range(n // 18)), ["LT-07"]),
}


@pytest.mark.parametrize("case", sorted(LONG))
def test_time_grows_with_the_text(spark, case):
    name, text, keys = LONG[case]

    def seconds(n):
        df = spark.createDataFrame([(1, name, text(n))], "file_id long, file_name string, content string").cache()
        df.count()
        took = []
        for _ in range(2):
            t = time.time()
            S.scan(df, keys).select(F.size("hits")).collect()
            took.append(time.time() - t)
        df.unpersist()
        return min(took)

    seconds(1000)
    small, large = seconds(300_000), seconds(2_400_000)
    assert large < 12 * max(small, 0.3), (small, large)


def test_no_rules_and_no_text(spark):
    df = spark.createDataFrame([(1, "a.js", None), (2, "b.js", "x")], "file_id long, file_name string, content string")
    assert S.findings(S.scan(df, [])).count() == 0
    assert len(CATALOGUE) > 70 and S.findings(S.scan(df)).count() >= 0
