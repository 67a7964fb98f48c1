"""The order in which the rules of one stage are applied.

Each filter is expanded to conjunctions whose members are sorted; conjunctions are put into a tree that shares equal
beginnings, and rules are applied in the order in which a walk of that tree meets them first.
"""

from .filters import Always, And, Exists, Leaf, Node, Not, Null, Or

Conjunction = tuple[Node, ...]


def pushed(node: Node, negative: bool = False) -> Node:
    """Negations moved down to the leaves."""
    if isinstance(node, Not):
        return pushed(node.of, not negative)
    if isinstance(node, (And, Or)):
        kind = (Or if isinstance(node, And) else And) if negative else type(node)
        return kind(tuple(pushed(x, negative) for x in node.of))
    return Not(node) if negative else node


def conjunctions(node: Node) -> list[Conjunction]:
    if isinstance(node, Or):
        return [c for x in node.of for c in conjunctions(x)]
    if isinstance(node, And):
        found: list[Conjunction] = [()]
        for x in node.of:
            more = conjunctions(x)
            found = [a + b for a in found for b in more]
        return found
    return [(node,)]


def key_of(node: Node) -> str | None:
    inner = node.of if isinstance(node, Not) else node
    return inner.key if isinstance(inner, Leaf) else None


def prepared(node: Node, priority: dict[str, str] | None = None, tags: dict[str, str] | None = None) -> list[Conjunction]:
    """Sorted conjunctions with a test of existence before each leaf, and of the tag that a key asks for before all."""
    from .filters import Equals

    out = []
    for c in conjunctions(pushed(node)):
        unique = list(dict.fromkeys(c))
        unique.sort(key=lambda x: (priority or {}).get(key_of(x) or "", (x.of if isinstance(x, Not) else x).text))
        guarded: list[Node] = []
        for x in unique:
            if isinstance(x, Leaf) and not isinstance(x, Exists) and Exists(x.key) not in guarded:
                guarded.append(Exists(x.key))
            if x not in guarded:
                guarded.append(x)
        front: list[Node] = []
        for x in unique:
            if (tag := (tags or {}).get(key_of(x) or "")) is not None:
                name, _, value = tag.partition(":")
                guard = Equals(name, value.strip('" ')) if value else Exists(name)
                if guard not in front:
                    front.append(guard)
        out.append((*front, *guarded))
    return out


def ordered(filters: list[Node], priority: dict[str, str] | None = None, tags: dict[str, str] | None = None) -> list[int]:
    """Positions of the rules in the order of application, by the first place at which each is met."""
    root: dict = {"next": {}, "rules": []}
    for i, node in enumerate(filters):
        for c in prepared(node, priority, tags):
            at = root
            for x in c:
                at = at["next"].setdefault(x, {"next": {}, "rules": []})
            at["rules"].append(i)
    found: dict[int, None] = {}
    stack = [root]
    while stack:
        at = stack.pop()
        found.update(dict.fromkeys(at["rules"]))
        stack += reversed(at["next"].values())
    return list(found)


def guarded(node: Node, tags: dict[str, str] | None) -> Node:
    """The filter with the tests of tags that its keys ask for."""
    if not tags:
        return node
    nulls = lambda c: {x.key for x in c if isinstance(x, Null)}
    found = tuple(And(d) if len(d) > 1 else d[0] for c in prepared(node, None, tags) if (d := tuple(x for x in c if not (isinstance(x, Exists) and x.key in nulls(c)))))
    return Or(found) if len(found) > 1 else found[0]


__all__ = ["Always", "ordered", "guarded", "prepared", "pushed"]
