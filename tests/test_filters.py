import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rillstone.plans import filters, order
from rillstone.plans.frame import Frame

DATA = [(1, "one", 1.0, True, ["a", "b"], None), (2, "Two 2", 2.5, False, [], "x"), (3, 'say "hi"', 10.0, None, None, "null")]
SCHEMA = "n int, s string, d double, b boolean, l array<string>, o string"


def kept(spark, text, **options):
    frame = Frame.of(spark.createDataFrame(DATA, SCHEMA))
    return [r.n for r in frame.df.where(filters.to_column(filters.parse(text, **options), frame.look)).orderBy("n").collect()]


@pytest.mark.parametrize(
    "text, ids",
    [
        ("*", [1, 2, 3]), ("o", [2, 3]), ("NOT o", [1]), ("nothing", []), ("NOT nothing", [1, 2, 3]), ("n: 2", [2]), ("n: 2.0", []), ("d: 1.0", [1]), ("d: 1", []), ("d: 2.5", [2]), ("b: True", [1]), ("b: true", []),
        ("l: a", [1]), ("l: /[bc]/", [1]), ("s: /t.*/", []), ("s: /(?i)t.*/", [2]), ('s: "Two 2"', [2]), ("s: Two\\ 2", [2]), ('s: "say \\"hi\\""', [3]), ("n: [1 TO 2]", [1, 2]), ("n: {1 TO 3}", [2]), ("d: [1.0 TO 2.5]", [1, 2]),
        ("d: [1 TO 3]", []), ("n: [1.0 TO 3.0]", []), ("s: [a TO p]", [1]), ("n: (1 OR 3)", [1, 3]), ("n: 1 OR n: 2 AND o: x", [1, 2]), ("(n: 1 OR n: 2) AND o: x", [2]), ("NOT (n: 1 OR b: False)", [3]), ('o: "null"', [3]), ("o: null", [1]), ("s|re: .*n.*", [1]),
    ],
)
def test_filters(spark, text, ids):
    assert kept(spark, text) == ids


def test_wildcards(spark):
    assert kept(spark, "s: ON?", like_keys=("s",)) == [1]
    assert kept(spark, "s: ON?") == []
    assert kept(spark, "s: *2", like_keys=True) == [2]


@pytest.mark.parametrize("text", ["a b", "a: [1 TO x]", "a: [2 TO 1]", "a: [1 TO *]", "(a", 'a: "x', "a: /x", "a: x~2", "a AND", ""])
def test_errors(text):
    with pytest.raises(filters.FilterError):
        filters.parse(text)


leaf = st.sampled_from([filters.Equals("n", "1"), filters.Equals("s", "one"), filters.Exists("o"), filters.Equals("b", "True")])
tree = st.recursive(leaf, lambda t: st.one_of(t.map(filters.Not), st.tuples(t, t).map(filters.And), st.tuples(t, t).map(filters.Or)), max_leaves=6)


@settings(max_examples=60, deadline=None)
@given(tree, st.lists(st.booleans(), min_size=4, max_size=4))
def test_conjunctions_are_equivalent(node, truths):
    values = dict(zip(["n", "s", "o", "b"], truths))

    def holds(x):
        if isinstance(x, filters.Not):
            return not holds(x.of)
        if isinstance(x, filters.And):
            return all(map(holds, x.of))
        return any(map(holds, x.of)) if isinstance(x, filters.Or) else values[x.key]

    assert any(all(holds(x) for x in c) for c in order.conjunctions(order.pushed(node))) == holds(node)


def test_order_is_that_of_the_tree():
    nodes = [filters.parse(t) for t in ("b: 1 AND a: 1", "c: 1", "a: 1", "a: 1 AND b: 1")]
    # rules 0, 2 and 3 share the beginning a; rule 2 ends where it ends, and the equal conjunctions of 0 and 3 meet
    assert order.ordered(nodes) == [2, 0, 3, 1]
