"""Formulas: the cases that the checks promise, and random ones against exact arithmetic."""

import random
from fractions import Fraction

import pytest

from galleyproof.functions import algebra, latex
from galleyproof.operators import formulas


@pytest.mark.parametrize(
    ("lhs", "rhs", "status", "kind"),
    [
        ("x + 0", "x", "verified", None),
        ("(a+b)^2", "a^2 + 2ab + b^2", "verified", None),
        (r"\frac{1}{x} + \frac{1}{y}", r"\frac{x+y}{x y}", "verified", None),
        (r"\sin^2 x + \cos^2 x", "1", "verified", None),
        (r"\sqrt{x} \cdot \sqrt{x}", "x", "verified", None),
        (r"\left(\alpha_1 - \beta\right)^{2}", r"\beta^2 - 2\alpha_{1}\beta + \alpha_1^2", "verified", None),
        ("a + b", "-(a+b)", "failed", None),
        (r"\exp(x+y)", r"\exp(x) + \exp(y)", "failed", None),
        (r"\sqrt{-x}", "1", "unverifiable", "evidence"),
        ("1/0", "1", "unverifiable", "evidence"),
        (r"\unknown x", "x", "unverifiable", "tool"),
        ("x + ", "x", "unverifiable", "tool"),
        ("(a+b+c+d)^{400}", "1", "unverifiable", "tool"),
        ("(" * 5000 + "x" + ")" * 5000, "x", "unverifiable", "tool"),
    ],
)
def test_equal(lhs, rhs, status, kind):
    assert algebra.equal(lhs, rhs)[:2] == (status, kind)


def test_sign_flip():
    assert algebra.equal("a + b", "-(a+b)").sign_flip and not algebra.equal("a + b", "a - b").sign_flip


def test_random_polynomials():
    r = random.Random(2)

    def make(depth):
        """(tex, value at x, y)"""
        if not depth or r.random() < 0.2:
            n = r.randint(1, 9)
            return r.choice([("x", lambda x, y: x), ("y", lambda x, y: y), (str(n), lambda x, y: Fraction(n))])
        (a, f), (b, g) = make(depth - 1), make(depth - 1)
        return r.choice([(f"({a} + {b})", lambda x, y: f(x, y) + g(x, y)), (f"({a} - {b})", lambda x, y: f(x, y) - g(x, y)), (f"({a}) ({b})", lambda x, y: f(x, y) * g(x, y))])

    for _ in range(150):
        (a, f), (b, g) = make(3), make(3)
        places = [(Fraction(r.randint(-40, 40), 7), Fraction(r.randint(-40, 40), 9)) for _ in range(8)]
        assert algebra.equal(a, b).status == ("verified" if all(f(*p) == g(*p) for p in places) else "failed")
        assert algebra.equal(a, f"{b} + ({a}) - {b}").status == "verified"


def test_macros():
    known = latex.macros(r"\newcommand{\RR}{\mathbb{R}}\newcommand{\calC}{\mathcal{C}}\newcommand{\calCstar}{\calC^{\ast}}")
    assert known["RR"] == (0, r"\mathbb{R}") and latex.expand(r"\calCstar", known) == (r"\mathcal{C}^{\ast}", None)
    assert latex.expand(r"\calCstar \RR", known, all_calls=False)[0] == r"\mathcal{C}^{\ast} \mathbb{R}"
    assert latex.expand(" ".join([r"\RR"] * 7), known, all_calls=False)[1] and not latex.expand(" ".join([r"\RR"] * 7), known)[1]
    assert latex.macros(r"\newcommand{\open}{\frac{1}") == {}


def test_targets(spark):
    tex = [
        (1, 1, r"\begin{equation}\begin{aligned} X &= a Y \\ Y &= b X \end{aligned}\end{equation}"),
        (2, 1, r"\newcommand{\calA}{A} $$ \calA = A $$"),
        (3, 1, r"$$ \int x\, dx = \frac{x^2}{2} $$"),
        (4, 1, None),
        (5, 1, "% $$ a = b $$\nno formula"),
        (6, 1, r"$$ q := r $$ \[ a = a + 0 = b \]"),
    ]
    rows = formulas.math_targets(spark.createDataFrame(tex, "paper_id long, round int, tex string")).collect()
    got = {}
    for row in rows:
        got.setdefault(row.paper_id, []).append((row.locator, row.status, row.kind, row.severity, row.tool))
    assert [x[:2] for x in got[1]] == [("eq:0", "failed"), ("eq:1", "failed")] and not any(r.sign_flip for r in rows)
    assert got[2] == [("eq:0", "verified", None, "minor", "sympy_with_macros")] and got[3] == [("eq:0", "unverifiable", "tool", "major", "none")]
    assert got[4] == got[5] == [("eq:none", "verified", None, "minor", "none")]
    assert [x[:2] for x in got[6]] == [("eq:0", "unverifiable"), ("eq:1", "verified"), ("eq:1.1", "failed")]
    absent = formulas.math_targets(spark.createDataFrame(tex, "paper_id long, round int, tex string"), available=False).collect()
    assert {(r.locator, r.status, r.kind, r.severity) for r in absent} == {("eq:preflight", "unverifiable", "env", "P0")}
