"""Reading semi-structured layout items held as VARIANT."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import LAYOUT_SPACES

# Fixed value: keys of a text-bearing object, first present one wins.
TEXT_KEYS = ["text", "content", "paragraph_content", "title_content", "math_content"]


def field(v: Column, key: str) -> Column:
    """Sub-variant under a key; SQL null when absent, variant null when JSON null."""
    return F.try_variant_get(v, f"$['{key}']", "variant")


def kind(v: Column) -> Column:
    """STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, VOID, ARRAY or OBJECT."""
    return F.substring_index(F.substring_index(F.schema_of_variant(v), "<", 1), "(", 1)


def text_of(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def items(v: Column) -> Column:
    """array<variant> when the value is a list, else null."""
    return F.try_variant_get(v, "$", "array<variant>")


def plain_number(x: Column) -> Column:
    """A double as a variant that prints without a needless point: 85, 85.5."""
    whole = (x == F.floor(x)) & (F.abs(x) < F.lit(1e15))
    return F.when(whole, x.cast("bigint").cast("variant")).otherwise(x.cast("variant"))


def is_object(v: Column) -> Column:
    """Does it read as a struct? One field is looked up, the others are not walked."""
    return F.try_variant_get(v, "$", "struct<type:variant>").isNotNull()


def bind(c: Column, fn: Callable[[Column], Column]) -> Column:
    """Evaluate ``c`` once and use it several times inside one expression."""
    return F.get(F.transform(F.array(c), lambda x: fn(x)), F.lit(0))


_KIND = "substring_index(substring_index(schema_of_variant({v}), '<', 1), '(', 1)"
_TRUTHY = (
    "case {kind} when 'STRING' then try_variant_get({v}, '$', 'string') <> ''"
    " when 'ARRAY' then size(try_variant_get({v}, '$', 'array<variant>')) > 0"
    " when 'OBJECT' then try_variant_get({v}, '$', 'string') <> '{{}}'"
    " when 'BOOLEAN' then try_variant_get({v}, '$', 'boolean')"
    " when 'VOID' then false else try_variant_get({v}, '$', 'double') <> 0 end"
)


def first_truthy(v: str, *keys: str) -> Column:
    """First sub-variant of column ``v`` that is not absent, null, empty, zero or false."""
    subs = ", ".join(f"try_variant_get({v}, '$.{k}', 'variant')" for k in keys)
    test = _TRUTHY.format(v="f", kind=_KIND.format(v="f"))
    return F.expr(f"get(filter(array({subs}), f -> f is not null and {test}), 0)")


def _nested(v: str) -> str:
    return _KIND.format(v=v) + " in ('ARRAY', 'OBJECT')"


def _leaves(v: str) -> str:
    """SQL of the scalars under ``v`` in their order, however deep they nest.

    A step puts a list's items in place of the list and its text in place of an
    object. The brackets of the value bound the steps; once nothing is nested the
    others do no work.
    """
    # A key that is present but null still ends the search.
    named = "coalesce(" + ", ".join(f"try_variant_get(e, '$.{key}', 'variant')" for key in TEXT_KEYS) + ")"
    opened = (
        f"case {_KIND.format(v='e')} when 'ARRAY' then try_variant_get(e, '$', 'array<variant>')"
        f" when 'OBJECT' then filter(array({named}), y -> y is not null) else array(e) end"
    )
    step = (
        f"if(s.more, named_struct('a', flatten(transform(s.a, e -> {opened})),"
        f" 'more', exists(s.a, e -> {_nested('e')})), s)"
    )
    json = f"try_variant_get({v}, '$', 'string')"
    depth = f"length({json}) - length(translate({json}, '[{{', ''))"
    start = f"named_struct('a', array({v}), 'more', true)"
    return f"if({_nested(v)}, aggregate(sequence(1, {depth}), {start}, (s, i) -> {step}).a, array({v}))"


def _leaf_text(v: str) -> str:
    text = f"try_variant_get({v}, '$', 'string')"
    cases = [
        f"when k = 'STRING' then nullif(btrim({text}, '{LAYOUT_SPACES}'), '')",
        f"when k = 'BOOLEAN' then initcap({text})",
        # A number written with a point or an exponent keeps its point.
        f"when k in ('DECIMAL', 'DOUBLE', 'FLOAT') and {text} rlike '^-?[0-9]+$' then {text} || '.0'",
        f"when k <> 'VOID' then {text}",
    ]
    return f"get(transform(array({_KIND.format(v=v)}), k -> case {' '.join(cases)} end), 0)"


def join_texts(values: str) -> Column:
    """Texts of an array<variant> column: a trimmed string, list items on lines, or
    an object's text key, nested to any depth."""
    texts = f"filter(transform({_leaves('v')}, x -> {_leaf_text('x')}), t -> t is not null)"
    return F.expr(f"transform({values}, v -> nullif(array_join({texts}, '\\n'), ''))")
