"""Golden cases of the code metrics: values by hand from the rules."""

import pytest

from textloom.functions import codemetrics as C

# source, depth, for, while, recursion, nested blocks, baseline class of nesting, enhanced class by loop depth
GOLDEN = [
    ("def f(a):\n    return a + 1\n", 0, 0, 0, False, 0, "constant", "constant"),
    ("def f(a):\n    s = 0\n    for x in a:\n        s += x\n    return s\n", 1, 1, 0, False, 1, "linear", "linear"),
    ("def f(a):\n    for x in a:\n        for y in a:\n            print(x, y)\n", 2, 2, 0, False, 2, "quadratic", "quadratic"),
    ("def f(a):\n    for x in a:\n        for y in a:\n            while y:\n                y -= 1\n", 3, 2, 1, False, 3, "cubic", "cubic"),
    ("for a in r:\n    for b in r:\n        for c in r:\n            for d in r:\n                pass\n", 4, 4, 0, False, 4, "exponential", "exponential"),
    ("def f(n):\n    while n:\n        if n > 2:\n            n -= 1\n        elif n > 1:\n            n -= 2\n        elif n > 0:\n            n = 0\n", 1, 0, 1, False, 4, "exponential", "linear"),
    ("def fact(n):\n    return 1 if n < 2 else n * fact(n - 1)\n", 0, 0, 0, True, 0, "constant", "nlogn"),
    ("def p(a):\n    for x in a:\n        p(a[1:])\n", 1, 1, 0, True, 1, "linear", "exponential"),
    ("class A:\n    def f(self, n):\n        return self.f(n - 1)\n", 0, 0, 0, False, 0, "constant", "constant"),
    ("def f(n):\n    return g(n)\ndef g(n):\n    return f(n)\n", 0, 0, 0, False, 0, "constant", "constant"),
    ("for x in a:\n    pass\nelse:\n    for y in a:\n        pass\n", 2, 2, 0, False, 2, "quadratic", "quadratic"),
    ("def f(a):\n    return [x for x in a for _ in a]\n", 0, 0, 0, False, 0, "constant", "constant"),
    ("for x in a:\n    def g():\n        for y in a:\n            pass\n", 2, 2, 0, False, 2, "quadratic", "quadratic"),
    ("def f(:\n", 0, 0, 0, False, 0, "constant", "constant"),
    ("", 0, 0, 0, False, 0, "constant", "constant"),
    ("for x in a:\n    pass\nfor x in a:\n    pass\nwhile b:\n    b -= 1\n", 1, 2, 1, False, 1, "linear", "linear"),
    ("async def f(a):\n    async for x in a:\n        pass\n", 0, 0, 0, False, 0, "constant", "constant"),
    ("def f(n):\n    def g():\n        return f(n - 1)\n    return g()\n", 0, 0, 0, False, 0, "constant", "constant"),
    ("def f(p):\n    if p:\n        with open(p) as h:\n            return h\n", 0, 0, 0, False, 2, "quadratic", "constant"),
]


@pytest.mark.parametrize("case", GOLDEN)
def test_structure(case):
    m = C.measure(case[0])
    assert (m["max_loop_depth"], m["for_loops"], m["while_loops"], m["has_recursion"], m["nested_block_depth"]) == case[1:6]


def test_classes(spark):
    from textloom.operators.code import code_metrics, predictions

    df = code_metrics(spark.createDataFrame([(i, c[0]) for i, c in enumerate(GOLDEN)], "i int, src string"))
    for mode, place in (("baseline", 6), ("enhanced", 7)):
        got = {r.i: r.predicted_complexity for r in predictions(df, mode, ["nbd"]).collect()}
        assert got == {i: c[place] for i, c in enumerate(GOLDEN)}


def test_cyclomatic():
    source = "def f(a, b):\n    if a and b or a:\n        return 1\n    for x in a:\n        pass\n    else:\n        pass\n    try:\n        pass\n    except ValueError:\n        pass\n    return [x for x in a if x]\n"
    m = C.measure(source)
    # 1 + if + (or: 1, and: 1) + (for and its else: 2) + except + (comprehension and its if: 2)
    assert m["cyclomatic"] == 9
    # 1 + if, and, or, for, except, for, if
    assert m["token_cyclomatic"] == 8
    # 1 + if + for + try with one handler (2)
    assert m["path_cyclomatic"] == 5
    assert m["parameters"] == 2 and m["functions_count"] == 1 and m["nloc"] == 12


def test_cognitive():
    # if 1, for 1 + 1, nested if 1 + 2, else 1, and 1
    assert C.measure("def f(a, b):\n    if a:\n        for x in a:\n            if x and b:\n                pass\n            else:\n                pass\n")["cognitive"] == 8
    # if 1, elif 1, else 1
    assert C.measure("if a:\n    pass\nelif b:\n    pass\nelse:\n    pass\n")["cognitive"] == 3


def test_halstead():
    m = C.measure("x = a + b\ny = a * 2\n")  # operators +, *; operands a, b, a, 2
    assert m["halstead_volume"] == pytest.approx(6 * 2.321928, abs=1e-5)
    assert m["halstead_difficulty"] == pytest.approx(2 * 4 / (2 * 3))
    assert m["halstead_effort"] == pytest.approx(m["halstead_volume"] * m["halstead_difficulty"])
    assert 0 <= m["maintainability"] <= 100
    assert C.measure("x = 1\n")["halstead_difficulty"] == 1.0 and C.measure("x = 1\n")["maintainability"] == 100.0


def test_errors_give_defaults():
    for source in (None, "", "  \n", "def f(:\n", "x = 1\0"):
        m = C.measure(source)
        assert m["error"] and {k: m[k] for k in C.DEFAULTS} == C.DEFAULTS


@pytest.mark.parametrize("source", ["Word### other.&&& words%%%", "one, two### three", "this or that, not those### x\nif_### y", "Word # rest"])
def test_words_that_parse_are_no_program(source):
    m = C.measure(source)
    assert m.pop("error") == "no program: bare words" and m == C.DEFAULTS


@pytest.mark.parametrize("source", ["x = 1", "f()", "a + b", "a < b", "pass", "import x", "'text'", "a.b", "x: int", "# only a comment", "1", "[a]", "a\nf(b)"])
def test_other_sources_are(source):
    assert C.measure(source)["error"] is None
