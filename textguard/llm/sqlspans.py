"""Spark SQL text for spans of regular-expression matches, linear in the length of a text.

``split`` gives the pieces between the matches that ``regexp_extract_all`` gives, so running sums
of their lengths are the places of the matches, in code points. An array is bound to a name by a
one-element ``transform``; a plain alias would be copied into every lambda and computed anew
for every element.
"""

from __future__ import annotations


def let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def literal(regex: str) -> str:
    """A regular expression as a raw SQL literal."""
    if "'" not in regex:
        return f"r'{regex}'"
    if '"' not in regex:
        return f'r"{regex}"'
    raise ValueError("a pattern may hold one kind of quote")


def running(values: str, block: int = 256) -> str:
    """Running sums of an int array, block by block (an array grows inside its block only)."""
    def sums(array: str) -> str:
        return f"aggregate({array}, cast(array() as array<int>), (acc_, v_) -> array_append(acc_, v_ + coalesce(try_element_at(acc_, -1), 0)))"
    blocks = f"transform(sequence(0, (size(vals_) - 1) div {block}), c_ -> {sums(f'slice(vals_, c_ * {block} + 1, {block})')})"
    joined = let("tops_", sums("transform(parts_, x_ -> element_at(x_, -1))"),
                 "flatten(transform(parts_, (x_, i_) -> transform(x_, v_ -> v_ + if(i_ = 0, 0, tops_[i_ - 1]))))")
    return let("vals_", values, f"if(size(vals_) = 0, vals_, {let('parts_', blocks, joined)})")


def running_max(values: str, block: int = 256) -> str:
    """Running maxima of an array of ints of 0 and more, block by block."""
    def tops(array: str) -> str:
        return f"aggregate({array}, cast(array() as array<int>), (acc_, v_) -> array_append(acc_, greatest(v_, coalesce(try_element_at(acc_, -1), 0))))"
    blocks = f"transform(sequence(0, (size(vals_) - 1) div {block}), c_ -> {tops(f'slice(vals_, c_ * {block} + 1, {block})')})"
    joined = let("tops_", tops("transform(parts_, x_ -> element_at(x_, -1))"),
                 "flatten(transform(parts_, (x_, i_) -> transform(x_, v_ -> if(i_ = 0, v_, greatest(v_, tops_[i_ - 1])))))")
    return let("vals_", values, f"if(size(vals_) = 0, vals_, {let('parts_', blocks, joined)})")


def pieces(text: str, cuts: str) -> str:
    """The pieces of a text between ascending places (an array of structs with start and end, code points, end exclusive), the last one to the
    end of the text. ``substring`` walks a text from its start, so a piece is read from the blocks it lies in."""
    between = let("b_", "x_.start div width_", "if(x_.end <= x_.start, '', substring(if((x_.end - 1) div width_ = b_, blocks_[b_], "
                  "array_join(slice(blocks_, b_ + 1, (x_.end - 1) div width_ - b_ + 1), '')), x_.start - b_ * width_ + 1, x_.end - x_.start))")
    blocks = f"transform(sequence(0, length({text}) div width_), k_ -> substring({text}, k_ * width_ + 1, width_))"
    return let("width_", f"greatest(4096, cast(sqrt(length({text})) * 16 as int))", let("blocks_", blocks, f"transform({cuts}, x_ -> {between})"))


def matches(text: str, regex: str, body: str) -> str:
    """Array with ``body`` for every match; body may use m_ (the match), s_ and e_ (its place), before_ and
    after_ (the pieces of text around it)."""
    r = literal(regex)
    ends = running("transform(found_.m, (x_, i_) -> length(found_.g[i_]) + length(x_))")
    each = let("ends_", ends, "transform(found_.m, (m_, k_) -> " + let("e_", "ends_[k_]", let("s_", "e_ - length(m_)",
               body.replace("before_", "found_.g[k_]").replace("after_", "found_.g[k_ + 1]"))) + ")")
    return let("found_", f"struct(regexp_extract_all({text}, {r}, 0) AS m, split({text}, {r}, -1) AS g)", each)
