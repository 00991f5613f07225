"""Slices of a project, held against hand-worked texts."""

from spindrift.functions import slices as S

A = '''import os
from b import Account


class Widget:
    size = 1


def outer(widget, n: Secret):
    left, right = n, widget
    total = left + 1
    total: Hidden = total * 2
    return helper(total)


class Holder:
    def outer(self, x):
        self.account: Money = x
        return self.account


def helper(value):
    return value
'''
B = '''from a import outer, helper


class Account:
    pass


def use():
    w = make()
    q = 3
    outer(w, n=q)
    helper(q)
    helper(1)
    helper(2)
    helper(3)
    helper(4)


def make():
    return 1
'''


def project():
    return S.Project([("a.py", "a", A), ("b.py", "b", B), ("bad.py", "bad", "def (")])


def test_parameter_with_callers_and_class_of_its_name():
    made = project().slice("a.py", "arg", "widget", "outer", 9)
    assert made["slice"].splitlines()[:3] == ["import os", "from b import Account", "class Widget:"] and "def outer(widget: <mask>, n: Secret):" in made["slice"]
    assert made["slice"].endswith("\ndef make():\n    return 1\nouter(w, n=q)\nq = 3\nhelper(q)\nw = make()")
    assert made["qualified"] == "a.outer" and made["target_function"] == "outer"


def test_no_label_is_shown():
    p = project()
    assert "Secret" not in p.slice("a.py", "arg", "n", "outer", 9)["slice"]
    total = p.slice("a.py", "local", "total", "outer", 9)["slice"]
    assert "Hidden" not in total and total.count("<mask>") == 2 and "total: <mask> = left + 1" in total
    account = p.slice("a.py", "local", "self.account", "outer", 17)
    assert "Money" not in account["slice"] and "self.account: <mask> = x" in account["slice"] and account["target_function"] == "Holder.outer" and account["qualified"] == "a.Holder.outer"


def test_callers_are_bounded_and_targets_exact():
    p = project()
    assert p.slice("a.py", "return", "helper", "helper")["slice"].count("\nhelper(") == S.CALLERS
    assert p.slice("a.py", "arg", "x", "outer") is None and p.slice("a.py", "arg", "zz", "outer", 9) is None and p.slice("bad.py", "local", "x") is None and p.slice("no.py", "local", "x") is None
    assert p.slice("a.py", "return", "helper", "outer", 9) is None and p.slice("a.py", "local", "nothing") is None


def test_hints_of_the_form():
    p = S.Project([("m.py", "m", "class K: pass\nk = K()\nf = g()\nn = 1\na = b = 2\nc = d\n")])
    hints = {n: p.slice("m.py", "local", n)["hints"] for n in "kfnc"}
    assert hints == {"k": ["The type that initially passes static analysis is class K", "The possible type of target is a class"], "f": ["The type that initially passes static analysis is The return value of g or class g"], "n": ["The type that initially passes static analysis is int"], "c": []}


def test_class_like_a_name():
    p = S.Project([("a.py", "a", "from b import Account\nfrom c import Unknown\nclass Users: pass\n"), ("b.py", "b", "class Account: pass\nclass Other: pass\n")])
    assert p.class_like("a.py", "user") == ["class Users:"] and p.class_like("a.py", "account") == ["class Account:"] and p.class_like("a.py", "other") == [] and p.class_like("a.py", "unknown") == []


def test_a_parameter_is_told_by_all_callers():
    made = project().slice("a.py", "arg", "value", "helper")["slice"].splitlines()
    assert [x for x in made if x.startswith("helper(")] == ["helper(total)", "helper(q)", "helper(1)", "helper(2)", "helper(3)", "helper(4)"]
