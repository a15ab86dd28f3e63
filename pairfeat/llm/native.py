"""Text primitives as plain column expressions (no Python in any task).

Offsets are code points throughout. A null text counts as the empty one: it has no
word, no line with a word and no span. Rows are looked at one by one, so repeated
rows and empty tables need no rule.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the characters of [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"

SPAN = "array<struct<start:int,end:int,value:string>>"


def content(df: DataFrame) -> list[Column]:
    """All columns of ``df`` in a form that hashes take: maps as JSON, and a mark for each null, which hashes skip."""
    out: list[Column] = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        out += [F.to_json(F.struct(c)) if "map<" in f.dataType.simpleString() else c, c.isNull()]
    return out


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def blank_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order: split at single blanks, drop empties."""
    flat = text
    for ch in BLANKS[1:]:
        flat = F.replace(flat, F.lit(ch), F.lit(" "))
    return F.array_remove(F.split(flat, " ", -1), "")


def without_blanks(text: Column) -> Column:
    out = text
    for ch in BLANKS:
        out = F.replace(out, F.lit(ch), F.lit(""))
    return out


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else (``lower`` also folds other scripts)."""
    out = text
    for k in range(26):
        out = F.replace(out, F.lit(chr(65 + k)), F.lit(chr(97 + k)))
    return out


#: Pairs that a fold walks at a time: arrays grow by copying, so longer folds would take the square of their length.
SLICE = 256
#: Code points of a block of text; places in a text are found by their block.
BLOCK = 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where lambdas in it come back to the value."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sliced(arr: Column) -> Column:
    """An array cut into arrays of ``SLICE``; one empty array for an empty one."""
    return let(arr, lambda a: F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor((F.size(a) - 1) / F.lit(SLICE)).cast("int"), F.lit(0))),
        lambda k: F.slice(a, k * SLICE + 1, F.lit(SLICE))))


def before_each(values: Column, zero: Column, join: Callable[[Column, Column], Column], kind: str) -> Column:
    """For each value of a short array, all values before it joined from ``zero`` on."""
    return F.aggregate(values, F.struct(zero.alias("now"), F.array().cast(f"array<{kind}>").alias("out")),
                       lambda acc, x: F.struct(join(acc["now"], x).alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out")),
                       lambda acc: acc["out"])


def spans(text: Column, pattern: str, guard: Column | None = None,
          keep: Callable[[Column], Column] | None = None, value: Callable[[Column], Column] | None = None,
          context: int = 0) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` as (start, end, value), in order.

    Spark has no function for match positions. The text between matches comes
    from ``split`` and the matches from ``regexp_extract_all``; running lengths
    of the two give the offsets, slice by slice. ``keep`` drops failing matches
    after they have taken their place (no retries). ``context``: spans also carry
    ``before``, so many characters before them. ``guard`` is a cheap necessary
    condition; without it (or where it holds) ``rlike`` decides whether to cut at all.
    Patterns must be possessive where a group repeats: Java's matcher recurses
    on other repeated groups and would overflow its stack on long runs.
    """
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1),
                       lambda m, g: F.struct(m.alias("m"), g.alias("gap")))
    kind = SPAN if not context else "array<struct<start:int,end:int,value:string,before:string>>"
    none = F.array().cast(kind)

    def all_of(p: Column) -> Column:
        return F.concat(p["gap"], F.coalesce(p["m"], F.lit("")))

    def tail(x: Column) -> Column:
        return F.substring(x, -context, context)

    def cut(first: Column, seen: Column, slice_: Column) -> Column:
        """The spans of a slice that begins at ``first``; ``seen`` ends with the characters before it."""
        def step(acc: Column, x: Column) -> Column:
            start = acc["pos"] + F.length(x["gap"])
            end = start + F.length(x["m"])
            fields = [start.alias("start"), end.alias("end"), (value(x["m"]) if value else x["m"]).alias("value")]
            if context:
                fields.append(tail(F.concat(acc["seen"], x["gap"])).alias("before"))
            ok = x["m"].isNotNull() & (keep(x["m"]) if keep else F.lit(True))
            return F.struct(F.coalesce(end, acc["pos"]).alias("pos"),
                            F.when(ok, F.concat(acc["out"], F.array(F.struct(*fields)))).otherwise(acc["out"]).alias("out"),
                            *([tail(F.concat(acc["seen"], all_of(x))).alias("seen")] if context else []))

        zero = [first.alias("pos"), none.alias("out"), *([seen.alias("seen")] if context else [])]
        return F.aggregate(slice_, F.struct(*zero), step, lambda acc: acc["out"])

    def whole_cut(parts: Column) -> Column:
        sizes = F.transform(parts, lambda part: F.aggregate(
            part, F.lit(0), lambda acc, p: acc + F.length(p["gap"]) + F.coalesce(F.length(p["m"]), F.lit(0))))
        firsts = before_each(sizes, F.lit(0), lambda now, x: now + x, "int")
        # A slice holds more characters than any context, one match each at least.
        ends = F.transform(parts, lambda part: tail(F.array_join(F.transform(
            F.slice(part, F.greatest(F.size(part) - context, F.lit(0)) + 1, F.lit(context + 1)), all_of), ""))) if context else None
        return let(F.struct(firsts.alias("firsts"), *([ends.alias("ends")] if context else [])), lambda v: F.flatten(F.transform(
            parts, lambda part, k: cut(F.get(v["firsts"], k), F.coalesce(F.get(v["ends"], k - 1), F.lit("")) if context else F.lit(""), part))))

    test = text.rlike(pattern) if guard is None else guard & text.rlike(pattern)
    return F.when(test, let(sliced(pairs), whole_cut)).otherwise(none)


def blocks(text: Column) -> Column:
    """A text in blocks of ``BLOCK`` code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def between(blocks_col: Column, start: Column, end: Column) -> Column:
    """Characters ``start`` to ``end`` of a text in blocks, without a walk from its beginning."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int")
    inside = F.array_join(F.slice(blocks_col, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
    return F.when(end > start, F.substring(inside, start - first * BLOCK + 1, end - start)).otherwise(F.lit(""))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]+", "")


def luhn(number: Column) -> Column:
    """Luhn check over a string of digits."""
    n = F.length(number)

    def weighed(k: Column) -> Column:
        d = F.substring(number, n - k, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(k % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, k: acc + weighed(k)) % 10 == 0


def mod97(code: Column) -> Column:
    """ISO 7064 mod-97 check over upper-case letters and digits, first four characters moved to the end."""
    moved = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, F.lit(1), F.lit(4)))

    def fold(acc: Column, ch: Column) -> Column:
        point = F.ascii(ch)
        v = F.when(point >= 65, point - 55).otherwise(point - 48)
        return (acc * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), fold) == 1


def joined(spans_col: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined in array order."""
    return F.array_join(F.transform(spans_col, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans_col: Column, rank: int, kind: str) -> Column:
    """Spans with their kind and its rank in the listed order."""
    return F.transform(spans_col, lambda s: F.struct(
        F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["start"].alias("start"),
        s["end"].alias("end"), s["value"].alias("value")))


def count_kind(spans_col: str, kind: str) -> Column:
    return F.size(F.filter(spans_col, lambda s: s["kind"] == kind)).cast("long")
