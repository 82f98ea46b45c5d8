"""Small selections against exhaustive search, and parsers on odd bodies."""

import itertools

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.operators import selection
from lodestrata.sources import adapters


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(0, 20), st.integers(1, 9), max_size=7), st.integers(0, 30))
def test_exact_size_split(sizes, target):
    got = selection.exact_size_split(sizes, target)
    possible = any(sum(sizes[k] for k in c) == target for n in range(len(sizes) + 1) for c in itertools.combinations(sizes, n))
    assert (got is not None) == possible
    assert got is None or sum(sizes[k] for k in got) == target and len(set(got)) == len(got)


def test_greedy_cover():
    items = [(1, frozenset("abc")), (2, frozenset("cd")), (3, frozenset("d")), (4, frozenset())]
    assert selection.greedy_cover(items, 5) == [1, 2]
    assert selection.greedy_cover(items, 1) == [1]


def test_greedy_distinct():
    assert selection.greedy_distinct([("g", 1, "x"), ("g", 2, "x"), ("h", 3, "x"), ("h", 4, "y")], 1) == [("g", 1, "x"), ("h", 4, "y")]


def test_quota_restarts():
    rows = [(i, "ab"[i % 2]) for i in range(20)]
    got = selection.quota_restarts(rows, {"a": 3, "b": 2}, "s")
    assert len(got) == 5 and sum(i % 2 for i in got) == 2 and got == selection.quota_restarts(rows[::-1], {"a": 3, "b": 2}, "s")
    assert selection.quota_restarts(rows, {"c": 1}, "s") == []


def test_parsers_fail_closed():
    assert adapters.html_page("<p>no title") is None
    assert adapters.html_page("<title> a  b </title><script>x</script><p>c&amp;d") == ("a b", "a b c&d")
    assert adapters.json_article("[1]") is None and adapters.json_article("{") is None
    assert adapters.json_article('{"title": "t", "text": "x"}') == ("t", "x")
    assert adapters.plain_text("") is None


def test_env_values():
    assert adapters.env_values("#x=1\nexport A='b c'\nnothing\nB=1=2") == {"A": "b c", "B": "1=2"}
