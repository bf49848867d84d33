"""Small helpers that compose Spark SQL expression text.

The scan is one large expression per file. Composed as SQL text it reaches the JVM in one call and is
parsed there in milliseconds; composed from Column objects every node is a call of its own and takes
seconds. All functions take and return expression text; ``F.expr`` turns the result into a column.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable

_names = itertools.count()


def lit(value: str) -> str:
    """SQL string literal. Everything but plain characters is written as an escape."""
    out = []
    for char in value:
        if char in "\\'":
            out.append("\\" + char)
        elif 32 <= ord(char) < 127:
            out.append(char)
        else:
            out.append(f"\\u{ord(char):04x}")
    return "'" + "".join(out) + "'"


def strings(values: Iterable[str]) -> str:
    values = list(values)
    return f"array({', '.join(map(lit, values))})" if values else "cast(array() AS array<string>)"


def struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def fresh(prefix: str = "v") -> str:
    return f"{prefix}{next(_names)}"


def let(value: str, body: Callable[[str], str]) -> str:
    """Bind ``value`` once and use it many times inside ``body``.

    Catalyst may copy an expression into each place that names it, and a lambda body is evaluated
    once per element. A one-element ``transform`` binds the value to a lambda variable instead, so
    that it is computed once. The analyzer resolves one level of lambdas per iteration and has a
    limit on iterations, so bindings that depend on each other should stay few.
    """
    name = fresh()
    return f"get(transform(array({value}), {name} -> {body(name)}), 0)"


def each(array: str, body: Callable[[str], str]) -> str:
    name = fresh()
    return f"transform({array}, {name} -> {body(name)})"


def each_at(array: str, body: Callable[[str, str], str]) -> str:
    """``body`` gets the element and its zero-based position."""
    name, at = fresh(), fresh("i")
    return f"transform({array}, ({name}, {at}) -> {body(name, at)})"


def keep(array: str, test: Callable[[str], str]) -> str:
    name = fresh()
    return f"filter({array}, {name} -> {test(name)})"


def keep_at(array: str, test: Callable[[str, str], str]) -> str:
    """``test`` gets the element and its zero-based position."""
    name, at = fresh(), fresh("i")
    return f"filter({array}, ({name}, {at}) -> {test(name, at)})"


def any_of(array: str, test: Callable[[str], str]) -> str:
    name = fresh()
    return f"exists({array}, {name} -> {test(name)})"


def first_of(array: str) -> str:
    return f"get({array}, 0)"


def last_of(array: str) -> str:
    return f"try_element_at({array}, -1)"


CHUNK = 256


def folded(array: str, state: str, kind: str, body: Callable[[str, str], str]) -> str:
    """One pass over ``array`` with a state; ``body`` gives ``struct<state, out>``, nulls of ``out`` are left out.

    Each ``array_append`` copies what there is already. Outputs are gathered in chunks and the chunks in
    a list, so that the copies of a pass over n elements stay far below n squared. ``kind`` is the type
    of ``out``.
    """
    outer, at, inner, x = fresh("a"), fresh("k"), fresh("b"), fresh("x")
    none = f"cast(array() AS array<{kind}>)"

    def pass_over(items: str) -> str:
        step = let(body(f"{inner}.state", x), lambda r: struct(
            state=f"{r}.state",
            seen=when(f"{r}.out IS NULL", f"{inner}.seen", f"array_append({inner}.seen, {r}.out)")))
        part = (f"aggregate(slice({items}, {at} * {CHUNK} + 1, {CHUNK}), "
                + struct(state=f"{outer}.state", seen=none) + f", ({inner}, {x}) -> {step})")
        chunk = let(part, lambda r: struct(
            state=f"{r}.state", seen=f"array_append({outer}.seen, {r}.seen)"))
        start = struct(state=state, seen=f"cast(array() AS array<array<{kind}>>)")
        chunks = f"sequence(0, greatest(0, cast((size({items}) - 1) div {CHUNK} AS int)))"
        return (f"flatten(aggregate({chunks}, {start}, ({outer}, {at}) -> {chunk},"
                f" {outer} -> {outer}.seen))")
    return let(array, pass_over)


def either(tests: Iterable[str]) -> str:
    return "(" + " OR ".join(tests) + ")"


def both(tests: Iterable[str]) -> str:
    return "(" + " AND ".join(tests) + ")"


def when(test: str, value: str, otherwise: str = "NULL") -> str:
    return f"CASE WHEN {test} THEN {value} ELSE {otherwise} END"
