"""Sets of spans as SQL snippets, in n log n steps for n spans.

A span is a struct with s and e (from, to); spans overlap where each begins before the other ends. A fold over an array copies
its state at each element, so none here has a state that grows with the array: running sums and maxima are found by doubling
(each round looks twice as far back), and choices are made within clusters of spans that overlap one another, which are small
unless a text's spans form one long chain.
"""

from __future__ import annotations


def let(name: str, value: str, body: str) -> str:
    """SQL: body with ``name`` bound to a value that is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def running(rows: str, merge: str) -> str:
    """SQL: for each element all up to it, merged; ``merge`` is over __x (an element) and __b (one further back)."""
    step = f"transform(__r, (__x, __i) -> CASE WHEN __i < shiftleft(1, __k) THEN __x ELSE {let('__b', 'get(__r, __i - shiftleft(1, __k))', merge)} END)"
    return let("__v", rows, f"CASE WHEN size(__v) < 2 THEN __v ELSE aggregate(sequence(0, cast(ceil(log2(size(__v))) AS int) - 1), __v, (__r, __k) -> {step}) END")


def cut(rows: str, new: str) -> str:
    """SQL: ``rows`` (a bound name) as arrays, a new one wherever ``new`` (over the place __i, from 1 on) says so."""
    begins = f"filter(sequence(0, size({rows}) - 1), __i -> __i = 0 OR {new})"
    one = f"transform(sequence(__b, coalesce(get(__s, __g + 1), size({rows})) - 1), __j -> get({rows}, __j))"
    return f"CASE WHEN size({rows}) = 0 THEN array() ELSE {let('__s', begins, f'transform(__s, (__b, __g) -> {one})')} END"


def groups(rows: str, key: str) -> str:
    """SQL: sorted ``rows`` (a bound name) as arrays of those whose ``key`` (a field) is the same."""
    return cut(rows, f"get({rows}, __i).{key} <> get({rows}, __i - 1).{key}")


def disjoint(lists: str) -> str:
    """SQL: whether no two spans overlap of elements of an array that each have an array of spans (s and e alone) ``offs``."""
    clash = "exists(sequence(1, size(__o) - 1), __i -> get(__o, __i - 1).e > get(__o, __i).s)"
    return let("__o", f"sort_array(flatten(transform({lists}, __c -> __c.offs)))", f"size(__o) < 2 OR NOT {clash}")


def before(spans: str, end: str) -> str:
    """SQL: how many of sorted ``spans`` begin before ``end``."""
    middle = "shiftright(__a.l + __a.h, 1)"
    step = f"CASE WHEN __a.l >= __a.h THEN __a WHEN get({spans}, {middle}).s < {end} THEN named_struct('l', {middle} + 1, 'h', __a.h) ELSE named_struct('l', __a.l, 'h', {middle}) END"
    return f"CASE WHEN size({spans}) = 0 THEN 0 ELSE aggregate(sequence(1, cast(ceil(log2(size({spans}) + 1)) AS int)), named_struct('l', 0, 'h', size({spans})), (__a, __i) -> {step}, __a -> __a.l) END"


def apart(spans: str, kind: str, order: str, blocks: str = "true") -> str:
    """SQL: each of ``spans`` in the order of a comparison of l and r is kept unless it overlaps a kept one (that ``blocks`` it: a
    test over __y, the span, and __k, the kept one); the kept ones by place."""
    overlap = f"__y.s < __k.e AND __y.e > __k.s AND {blocks}"
    chosen = f"aggregate(array_sort(__c, (l, r) -> {order}), cast(array() AS array<{kind}>), (__a, __y) -> CASE WHEN exists(__a, __k -> {overlap}) THEN __a ELSE concat(__a, array(__y)) END)"
    clusters = cut("__p", "get(__m, __i - 1) <= get(__p, __i).s")
    kept = f"flatten(transform({clusters}, __c -> CASE WHEN size(__c) = 1 THEN __c ELSE {chosen} END))"
    by_place = f"array_sort({spans}, (__l, __x) -> CASE WHEN __l.s <> __x.s THEN __l.s - __x.s ELSE __l.e - __x.e END)"
    reach = running("transform(__p, __x -> __x.e)", "greatest(__x, __b)")
    # Where none overlaps the next, all stay.
    clash = "exists(sequence(1, size(__p) - 1), __i -> get(__p, __i - 1).e > get(__p, __i).s)"
    chosen_of = let("__m", reach, f"array_sort({kept}, (__l, __x) -> __l.s - __x.s)")
    whole = let("__p", by_place, f"CASE WHEN {clash} THEN {chosen_of} ELSE __p END")
    return f"CASE WHEN size({spans}) < 2 THEN {spans} ELSE {whole} END"
