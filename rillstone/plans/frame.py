"""Events as a DataFrame with one column for each leaf path, and what a rule may do to them.

Nested structs are taken apart on entry and put together again on exit, so that a rule can write any path with one
projection. Beside the paths there are hidden columns for errors, warnings, side outputs and whether the event goes on.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import paths

ALIVE, DELETED, ERRORS, WARNINGS, EXTRA, MATCH = "__alive", "__deleted", "__errors", "__warnings", "__extra", "__match"
EXTRA_TYPE = "array<struct<output:string,target:string,doc:string>>"
HIDDEN = {ALIVE: "boolean", DELETED: "boolean", ERRORS: "array<string>", WARNINGS: "array<string>", EXTRA: EXTRA_TYPE}
TAGS = "tags"


def ticked(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def quoted(name: str) -> Column:
    return F.col(ticked(name))


@dataclass
class Write:
    """A value for a path. Null values aren't written unless ``nulls``."""

    path: str
    value: Column
    mode: str = "add"  # or overwrite, merge
    nulls: bool = False
    when: Column | None = None


@dataclass
class Effect:
    """What a rule does to the events that it matches. ``warn`` and ``fail`` pair a condition with a tag or message;
    a condition that is null doesn't hold."""

    writes: list[Write] = field(default_factory=list)
    warn: list[tuple[Column, list[str]]] = field(default_factory=list)
    fail: list[tuple[Column, str]] = field(default_factory=list)
    remove: list[str] = field(default_factory=list)
    remove_if: Column | None = None
    extra: Column | None = None
    delete: bool = False
    conflict_tags: list[str] = field(default_factory=list)
    together: Column | None = None  # writes happen only where this holds
    prepare: list[dict[str, Column]] = field(default_factory=list)  # columns for the others to use, projected one after the other
    lookups: list[tuple[str, Column, DataFrame]] = field(default_factory=list)  # name, key and table (k, v), for the others to use under the name


def yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def union_tags(old: Column | None, new: list[Column]) -> Column:
    base = F.coalesce(old, F.array().cast("array<string>")) if old is not None else F.array().cast("array<string>")
    return F.sort_array(F.array_distinct(F.concat(base, F.array_compact(F.array(*new)))))


class Frame:
    """A DataFrame of events and the types of its leaf paths, in order."""

    def __init__(self, df: DataFrame, kinds: dict[str, T.DataType]) -> None:
        self.df, self.kinds = df, kinds
        self._shape: DataFrame | None = None

    @classmethod
    def of(cls, df: DataFrame) -> Frame:
        leaves: dict[str, tuple[Column, T.DataType]] = {}

        def walk(parts: list[str], column: Column, kind: T.DataType) -> None:
            if isinstance(kind, T.StructType) and kind.fields:
                for f in kind.fields:
                    walk([*parts, f.name], column.getField(f.name), f.dataType)
            else:
                leaves[paths.join(parts)] = column, kind

        for f in df.schema.fields:
            walk([f.name], quoted(f.name), f.dataType)
        start = {ALIVE: F.lit(True), DELETED: F.lit(False)}
        hidden = [start.get(n, F.array().cast(k) if k.startswith("array") else F.lit(None)).cast(k).alias(n) for n, k in HIDDEN.items()]
        return cls(df.select(*(c.alias(p) for p, (c, _) in leaves.items()), *hidden), {p: k for p, (_, k) in leaves.items()})

    # -- reading ---------------------------------------------------------------------------------------------------

    def children(self, path: str) -> list[str]:
        return [p for p in self.kinds if p.startswith(path + ".")]

    def leaf(self, path: str) -> str | None:
        """The leaf under that path; names that differ only in how dots are escaped are the same."""
        normal = paths.join(paths.split(path))
        return normal if normal in self.kinds else None

    def look(self, path: str, elements: bool = True) -> tuple[Column, T.DataType] | None:
        """Column and type of a path, of a struct for a path with others below it, or None if it can't exist."""
        if (own := self.leaf(path)) is not None:
            return quoted(own), self.kinds[own]
        if below := self.children(paths.join(paths.split(path))):
            return self._struct(paths.split(path), below)
        parts = paths.split(path)
        for n in range(len(parts) - 1, 0, -1):
            head = self.leaf(paths.join(parts[:n]))
            if head is not None:
                return self._inside(quoted(head), self.kinds[head], parts[n:], elements)
        return None

    def _struct(self, parts: list[str], below: list[str]) -> tuple[Column, T.DataType]:
        tree = _tree({tuple(paths.split(p)[len(parts) :]): p for p in below})
        return _node(tree, self.kinds), _kind(tree, self.kinds)

    def _inside(self, column: Column, kind: T.DataType, parts: list[str], elements: bool) -> tuple[Column, T.DataType] | None:
        for part in parts:
            if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
                column, kind = F.try_element_at(column, F.lit(part)), kind.valueType
            elif isinstance(kind, T.ArrayType) and elements and (at := paths.element(part)) is not None:
                if isinstance(at, int):
                    column, kind = F.try_element_at(column, F.lit(at + 1 if at >= 0 else at)), kind.elementType
                else:
                    column = _sliced(column, at)
            elif isinstance(kind, T.StructType) and part in kind.names:
                column, kind = column.getField(part), kind[part].dataType
            else:
                return None
        return column, kind

    def get(self, path: str) -> Column | None:
        found = self.look(path)
        return found[0] if found else None

    def kind(self, path: str) -> T.DataType | None:
        found = self.look(path)
        return found[1] if found else None

    # -- writing ---------------------------------------------------------------------------------------------------

    def select(self, changed: dict[str, Column], **hidden: Column) -> Frame:
        """The frame with other columns for some paths and hidden columns."""
        names = {**dict.fromkeys(self.kinds), **dict.fromkeys(changed)}
        extras = [c for c in self.df.columns if c not in self.kinds]
        # what stays is given by name, which takes the driver less than a Column
        df = self.df.select(*(changed[p].alias(p) if p in changed else ticked(p) for p in names), *(hidden[c].alias(c) if c in hidden else ticked(c) for c in extras))
        schema = df.schema
        return Frame(df, {p: schema[i].dataType for i, p in enumerate(names)})

    def apply(self, effect: Effect, match: Column) -> Frame:
        """One projection: writes, removals, tags, errors and side outputs of a rule where it matches."""
        if effect.prepare:
            df = self.df
            for columns in effect.prepare:
                df = df.select("*", *(c.alias(n) for n, c in columns.items()))
            done = Frame(df, self.kinds).apply(replace(effect, prepare=[]), match)
            return Frame(done.df.drop(*(n for columns in effect.prepare for n in columns)), done.kinds)
        if effect.lookups:
            df = self.df
            for name, key, table in effect.lookups:
                rows = table.select(F.col("k").alias("__k"), F.col("v").alias(name))
                df = df.select("*", key.alias("__key")).join(rows, F.col("__key") == F.col("__k"), "left").drop("__key", "__k")
            done = Frame(df, self.kinds).apply(replace(effect, lookups=[]), match)
            return Frame(done.df.drop(*(name for name, _, _ in effect.lookups)), done.kinds)
        go = match & quoted(ALIVE)
        failed = F.lit(False)
        for condition, _ in effect.fail:
            failed = failed | yes(condition)
        able = go & ~failed if effect.fail else go
        changed: dict[str, Column] = {}
        conflicts: list[Column] = []
        for w in effect.writes:
            self._write(w, able if effect.together is None else able & yes(effect.together), changed, conflicts)
        for path in effect.remove:
            for leaf in [p for p in ([self.leaf(path)] if self.leaf(path) else self.children(paths.join(paths.split(path))))]:
                gone = able if effect.remove_if is None else able & yes(effect.remove_if)
                changed[leaf] = F.when(~gone, changed.get(leaf, quoted(leaf)))
        marks = [F.when(go & yes(c), F.lit(t)) for c, tags in effect.warn for t in tags]
        clash = None
        if conflicts:
            clash = conflicts[0]
            for c in conflicts[1:]:
                clash = clash | c
            marks += [F.when(clash, F.lit(t)) for t in effect.conflict_tags]
        if marks:
            old = changed.get(TAGS, quoted(TAGS) if TAGS in self.kinds else None)
            some = F.lit(False)
            for m in marks:
                some = some | m.isNotNull()
            changed[TAGS] = F.when(some, union_tags(_listed(old, self.kinds.get(TAGS)), marks)).otherwise(_listed(old, self.kinds.get(TAGS)) if old is not None else F.lit(None).cast("array<string>"))
        hidden: dict[str, Column] = {}
        if effect.fail:
            messages = [F.when(go & yes(c), F.lit(m)) for c, m in effect.fail]
            hidden[ERRORS] = F.concat(quoted(ERRORS), F.array_compact(F.array(*messages)))
            hidden[ALIVE] = quoted(ALIVE) & ~(go & failed)
        if clash is not None:
            hidden[WARNINGS] = F.when(clash, F.array_append(quoted(WARNINGS), F.lit("field exists: " + ", ".join(w.path for w in effect.writes)))).otherwise(quoted(WARNINGS))
        if effect.extra is not None:
            hidden[EXTRA] = F.when(able, F.array_distinct(F.concat(quoted(EXTRA), effect.extra.cast(EXTRA_TYPE)))).otherwise(quoted(EXTRA))
        if effect.delete:
            hidden[DELETED] = quoted(DELETED) | able
            hidden[ALIVE] = hidden.get(ALIVE, quoted(ALIVE)) & ~able
        return self.select(changed, **hidden)

    def _write(self, w: Write, able: Column, changed: dict[str, Column], conflicts: list[Column]) -> None:
        parts = paths.split(w.path)
        name = paths.join(parts)
        outer = able
        value, able = w.value, able if w.when is None else able & yes(w.when)
        if not w.nulls:
            able = able & value.isNotNull()
        now = lambda p: changed.get(p, quoted(p))
        above = [p for n in range(1, len(parts)) if (p := paths.join(parts[:n])) in self.kinds or p in changed]
        below = [p for p in {**self.kinds, **changed} if p.startswith(name + ".")]
        blocked = F.lit(False)
        for p in [*above, *(below if w.mode != "overwrite" else [])]:
            blocked = blocked | now(p).isNotNull()
        known = name in self.kinds or name in changed
        if w.mode == "overwrite":
            for p in [*above, *below]:
                changed[p] = F.when(able, F.lit(None)).otherwise(now(p))
            changed[name] = self._either(able, value, now(name), name) if known else F.when(able, value)
            return
        if w.mode == "merge" and not known and below and isinstance(kind := self._type(value), T.StructType):
            for f in kind.fields:  # of two with fields, those of the new one count
                self._write(replace(w, path=paths.join([*parts, f.name]), value=value.getField(f.name), mode="overwrite"), outer, changed, conflicts)
            return
        if w.mode == "merge" and known:
            merged, clash = self._merged(now(name), name, value)
            blocked = yes(blocked) | (now(name).isNotNull() & yes(clash)) if clash is not None else yes(blocked)
            conflicts.append(able & blocked)
            changed[name] = self._either(able & ~blocked, merged, now(name), name)
            return
        taken = yes(blocked) | now(name).isNotNull() if known else yes(blocked)
        conflicts.append(able & taken)
        changed[name] = self._either(able & ~taken, value, now(name), name) if known else F.when(able & ~taken, value)

    def _type(self, column: Column) -> T.DataType:
        """Type of an expression, found on an empty table of the same columns, whatever the plan so far."""
        if self._shape is None:
            self._shape = self.df.sparkSession.createDataFrame([], self.df.schema)
        return self._shape.select(column.alias("x")).schema[0].dataType

    def _either(self, condition: Column, new: Column, old: Column, name: str) -> Column:
        """New or old; where their types differ both become text, a list stays a list."""
        a, b = self._type(new), self.kinds.get(name)
        if b is None or isinstance(b, T.NullType) or a == b:
            return F.when(condition, new).otherwise(old) if b is not None and not isinstance(b, T.NullType) else F.when(condition, new)
        if isinstance(a, T.ArrayType) != isinstance(b, T.ArrayType):
            if isinstance(a, T.ArrayType):
                return F.when(condition, new.cast("array<string>")).otherwise(_listed(old, b))
            return F.when(condition, F.array(new.cast("string"))).otherwise(old.cast("array<string>"))
        if isinstance(a, T.ArrayType) or isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
            return F.when(condition, new).otherwise(old) if isinstance(a, T.NumericType) else F.when(condition, new.cast("array<string>")).otherwise(old.cast("array<string>"))
        text = lambda c, k: F.to_json(c) if isinstance(k, (T.StructType, T.MapType)) else c.cast("string")
        return F.when(condition, text(new, a)).otherwise(text(old, b))

    def _merged(self, old: Column, name: str, value: Column) -> tuple[Column, Column | None]:
        """Lists grow, maps unite; two scalars clash unless the target is missing."""
        a, b = self.kinds.get(name), self._type(value)
        if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
            return F.when(old.isNull(), value.cast(a)).otherwise(F.concat(old, value.cast(a))), None
        if isinstance(a, T.ArrayType):
            return F.when(old.isNull(), F.array(value.cast(a.elementType))).otherwise(F.array_append(old, value.cast(a.elementType))), None
        if isinstance(b, T.ArrayType):
            return F.when(old.isNull(), value).otherwise(F.array_prepend(value, old.cast(b.elementType))), None
        if isinstance(a, T.MapType) and a == b:
            return F.when(old.isNull(), value).otherwise(F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(value, k)), value)), None
        return value, old.isNotNull()

    # -- leaving ---------------------------------------------------------------------------------------------------

    def nested(self, keep_hidden: bool = False) -> DataFrame:
        """Structs put together again; a struct without any value is null."""
        tree = _tree({tuple(paths.split(p)): p for p in self.kinds})
        top = []
        for name, node in tree.items():
            if isinstance(node, str):
                top.append(quoted(node).alias(name))
            else:
                top.append(_node(node, self.kinds).alias(name))
        hidden = [quoted(n) for n in HIDDEN] if keep_hidden else []
        return self.df.select(*top, *hidden)


def _listed(column: Column | None, kind: T.DataType | None) -> Column | None:
    if column is None or isinstance(kind, T.ArrayType) or kind is None:
        return column
    return F.when(column.isNotNull(), F.array(column.cast("string")))


def _sliced(column: Column, at: slice) -> Column:
    """The elements that a slice picks, in its order; null for null."""
    n = F.size(column)
    step = at.step or 1
    bound = lambda x, default: default if x is None else (F.lit(x) if x >= 0 else n + x)
    if step > 0:
        low, high = F.greatest(bound(at.start, F.lit(0)), F.lit(0)), F.least(bound(at.stop, n), n)
        picks = F.when(low < high, F.sequence(low, high - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    else:
        low, high = F.least(bound(at.start, n - 1), n - 1), F.greatest(bound(at.stop, F.lit(-1)) if at.stop is not None else F.lit(-1), F.lit(-1))
        picks = F.when(low > high, F.sequence(low, high + 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.when(column.isNotNull(), F.transform(picks, lambda i: F.get(column, i)))


def _tree(leaves: dict[tuple[str, ...], str]) -> dict:
    tree: dict = {}
    for parts, name in leaves.items():
        at = tree
        for p in parts[:-1]:
            below = at.setdefault(p, {})
            if isinstance(below, str):  # a field that once held a scalar and now holds fields
                below = at[p] = {"": below}
            at = below
        if isinstance(at.get(parts[-1]), dict):
            at[parts[-1]][""] = name
        else:
            at[parts[-1]] = name
    return tree


def _build(tree: dict, kinds: dict[str, T.DataType]) -> Column:
    """A struct; a field that holds nothing in an event is null there."""
    return F.struct(*((quoted(node) if isinstance(node, str) else _node(node, kinds)).alias(name) for name, node in tree.items()))


def _node(tree: dict, kinds: dict[str, T.DataType]) -> Column:
    """A struct that is null where nothing in it has a value. What is a scalar in some events and has fields in others
    becomes text, with the fields as JSON."""
    own, below = tree.get(""), {k: v for k, v in tree.items() if k}
    some = F.lit(False)
    for leaf in _leaves(below):
        some = some | quoted(leaf).isNotNull()
    struct = F.when(some, _build(below, kinds))
    return struct if own is None else F.coalesce(quoted(own).cast("string"), F.to_json(struct))


def _leaves(tree: dict) -> list[str]:
    return [x for node in tree.values() for x in ([node] if isinstance(node, str) else _leaves(node))]


def _kind(tree: dict, kinds: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, kinds[x] if isinstance(x, str) else T.StringType() if "" in x else _kind(x, kinds)) for n, x in tree.items()])


__all__ = ["Frame", "Effect", "Write", "replace", "yes", "quoted", "ticked"]
