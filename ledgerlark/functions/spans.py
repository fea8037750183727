"""Spans of a text as sorted arrays of (start, end), counted in code points, end exclusive; unions and differences by a sweep.

All functions take and give SQL text, for ``expr``: expressions of this depth would take thousands of calls to build one by one.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

SPANS = "array<struct<start:int,end:int>>"
NONE = f"cast(array() AS {SPANS})"
_names = count()


def raw(pattern: str) -> str:
    """A pattern, or other text without double quotes, as a literal."""
    return f'r"{pattern}"'


def let(value: str, use: Callable[[str], str]) -> str:
    """use(value) with value computed once."""
    v = f"v{next(_names)}"
    return f"element_at(transform(array({value}), {v} -> {use(v)}), 1)"


def each(values: str, use: Callable[[str], str], function: str = "transform") -> str:
    v = f"v{next(_names)}"
    return f"{function}({values}, {v} -> {use(v)})"


def span(start: str, end: str) -> str:
    return f"named_struct('start', cast({start} AS int), 'end', cast({end} AS int))"


def running(values: str, op: Callable[[str, str], str]) -> str:
    """op over the first one, two, three ... of values, op being associative.

    A fold that appends to a list copies it at every step. Parts of about the root of the length are folded by
    themselves, then what stands before each part is put on top, so n values take n to the power of 1.5 copies.
    """
    s, v, i = (f"{x}{next(_names)}" for x in "svi")

    def folded(values: str, first: str, taken: Callable[[str], str]) -> str:
        return f"aggregate(slice({values}, 2, size({values})), {first}, ({s}, {v}) -> concat({s}, array({op(f'element_at({s}, -1)', taken(v))})))"

    def of(values: str) -> str:
        parts = let(f"cast(ceil(sqrt(size({values}))) AS int)", lambda n: each(f"sequence(0, size({values}) - 1, {n})", lambda k: f"slice({values}, {k} + 1, {n})"))
        return let(each(parts, lambda part: folded(part, f"slice({part}, 1, 1)", lambda x: x)), put)

    def put(inner: str) -> str:
        totals = folded(inner, f"slice(get({inner}, 0), -1, 1)", lambda part: f"element_at({part}, -1)")
        p = f"p{next(_names)}"
        return let(totals, lambda t: f"flatten(transform({inner}, ({p}, {i}) -> IF({i} = 0, {p}, {each(p, lambda x: op(f'get({t}, {i} - 1)', x))})))")

    return let(values, lambda x: f"IF(size({x}) > 0, {of(x)}, {x})")


def found(text: str, pattern: str, tail: bool = False, mark: str | None = None) -> str:
    """The matches of a pattern (an expression), leftmost first; of each what its first group holds at its end, if tail.

    mark: a character that the text doesn't have; without one a text is split by the pattern itself, which is compiled for every row.
    """
    gaps = f"split(regexp_replace({text}, {pattern}, '{mark}'), '{mark}', -1)" if mark else f"split({text}, {pattern}, -1)"

    def placed(shown: str) -> str:
        e, m = f"e{next(_names)}", f"m{next(_names)}"
        ends = running(f"zip_with(slice({gaps}, 1, size({shown})), {shown}, ({e}, {m}) -> length({e}) + length({m}))", lambda a, b: f"{a} + {b}")
        counted = f"regexp_extract_all({text}, {pattern}, 1)" if tail else shown
        return f"zip_with({ends}, {counted}, ({e}, {m}) -> {span(f'{e} - length({m})', e)})"

    return f"IF(rlike({text}, {pattern}), {let(f'regexp_extract_all({text}, {pattern}, 0)', placed)}, {NONE})"


def part(text: str, one: str) -> str:
    return f"substring({text}, {one}.start + 1, {one}.end - {one}.start)"


def pieces(layers: list[str]) -> str:
    """The text cut at all starts and ends: array of (start, end, n0, n1 ...), n of a layer telling how many of its spans lie over it.

    One sweep: a start adds one to its layer, an end takes it away, and the sums in order of place are running ones.
    """
    names = [f"n{k}" for k in range(len(layers))]

    def event(place: str, k: int, by: int) -> str:
        return f"named_struct('at', {place}, {', '.join(f"'{n}', {by if i == k else 0}" for i, n in enumerate(names))})"

    events = ", ".join("flatten(" + each(layer, lambda s: f"array({event(f'{s}.start', k, 1)}, {event(f'{s}.end', k, -1)})") + ")" for k, layer in enumerate(layers))
    sums = running(f"array_sort(concat({events}))", lambda a, b: f"named_struct('at', {b}.at, {', '.join(f"'{n}', {a}.{n} + {b}.{n}" for n in names)})")
    s, i = f"s{next(_names)}", f"i{next(_names)}"

    def cut(sums: str) -> str:
        own = f"transform(slice({sums}, 1, greatest(size({sums}) - 1, 0)), ({s}, {i}) -> named_struct('start', {s}.at, 'end', get({sums}, {i} + 1).at, {', '.join(f"'{n}', {s}.{n}" for n in names)}))"
        return each(own, lambda p: f"{p}.start < {p}.end", "filter")

    return let(sums, cut)


def kept_of(cuts: str, is_in: Callable[[str], str]) -> str:
    """The spans of the pieces for which is_in holds."""
    return each(each(cuts, is_in, "filter"), lambda p: span(f"{p}.start", f"{p}.end"))


def union(*layers: str) -> str:
    return kept_of(pieces([f"concat({', '.join(layers)})"]), lambda p: f"{p}.n0 > 0")


def minus(spans: str, *others: str) -> str:
    return kept_of(pieces([spans, f"concat({', '.join(others)})"]), lambda p: f"{p}.n0 > 0 AND {p}.n1 = 0")


def painted(text: str, spans: str, mark: str, paint: str = r"(?s).") -> str:
    """text with each character of sorted, disjoint spans that paint matches replaced by mark; it stays as long as it was."""
    a, b = f"a{next(_names)}", f"b{next(_names)}"

    def put(spans: str) -> str:
        ends = f"concat(array(0), {each(spans, lambda s: f'{s}.end')})"
        starts = f"concat({each(spans, lambda s: f'{s}.start')}, array(length({text})))"
        gaps = f"zip_with({ends}, {starts}, ({a}, {b}) -> substring({text}, {a} + 1, {b} - {a}))"
        marks = f"concat({each(spans, lambda s: f'regexp_replace({part(text, s)}, {raw(paint)}, {raw(mark)})')}, array(''))"
        return f"array_join(zip_with({gaps}, {marks}, ({a}, {b}) -> concat({a}, {b})), '')"

    return let(spans, lambda s: f"IF(size({s}) > 0, {put(s)}, {text})")
