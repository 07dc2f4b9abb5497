"""Text functions as Spark expressions: display text, search folding, snippets, n-gram buckets."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decoding passes and the named references that are decoded.
DECODE_PASSES = 3
NAMED_REFERENCES = {
    "amp": "&",
    "apos": "'",
    "quot": '"',
    "lt": "<",
    "gt": ">",
    "nbsp": " ",
    "ldquo": "“",
    "rdquo": "”",
    "hellip": "…",
    "ndash": "–",
    "Eacute": "É",
}
#: Least code points of a search, hash buckets, and bytes around a hit.
MIN_SEARCH, GRAM_BUCKETS, SNIPPET_BYTES = 2, 65_536, 96

_REFERENCE = r"&(?:#(?:[xX][0-9a-fA-F]+|[0-9]+)|[A-Za-z][A-Za-z0-9]+);"


def _decoded(piece: Column) -> Column:
    """One piece of a text: a reference that is known becomes its character."""
    names = _table([(f"&{k};", v) for k, v in NAMED_REFERENCES.items()])
    body = F.substring(piece, F.lit(3), F.length(piece) - 3)
    hexadecimal = F.lower(F.substring(piece, 3, 1)) == "x"
    digits = F.ltrim(F.when(hexadecimal, F.substring(body, F.lit(2), F.length(body))).otherwise(body), F.lit("0"))
    # more digits than U+10FFFF has are out of range whatever they say
    code = F.when(F.length(digits) > 7, F.lit(None)).otherwise(F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10))).cast("long")
    valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    character = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(F.startswith(piece, F.lit("&#")) & F.endswith(piece, F.lit(";")), F.when(valid, character).otherwise(piece)).otherwise(F.coalesce(F.try_element_at(names, piece), piece))


def display_text(col: Column) -> Column:
    """References decoded, at most three passes; null becomes empty. Not idempotent: apply once."""

    def one_pass(x: Column) -> Column:
        return F.array_join(F.transform(F.regexp_extract_all(x, F.lit(f"({_REFERENCE}|[^&]+|&)"), F.lit(1)), _decoded), "")

    def decoded(x: Column) -> Column:
        out = x
        for _ in range(DECODE_PASSES):  # a pass over a text without references returns it
            out = one_pass(out)
        return F.when(F.contains(x, F.lit("&")) & F.contains(x, F.lit(";")), out).otherwise(x)

    return _let(F.coalesce(col, F.lit("")), decoded)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it; expressions that nest would else grow as a power."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@lru_cache(1)
def _folding() -> tuple[str, str, list[tuple[str, str]]]:
    """Where case folding differs from lower case: single characters, and those that become several."""
    one, to, many = [], [], []
    for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x1F000)]):
        folded, low = c.casefold(), c.lower()
        if folded != low and c == low:  # what lower() leaves
            if len(folded) == 1:
                one.append(c)
                to.append(folded)
            else:
                many.append((c, folded))
    return "".join(one), "".join(to), many


def fold(col: Column) -> Column:
    """Trimmed of white space of any kind and case folded for search."""
    space = r"[\p{IsWhite_Space}\x1c-\x1f]"
    trimmed = lambda x: F.when(x.rlike(f"^{space}|{space}$"), F.regexp_replace(x, f"^{space}+|{space}+$", "")).otherwise(x)
    return _let(casefold(col), trimmed)


def casefold(col: Column) -> Column:
    """Lower case alone folds most texts: ASCII, and Latin letters but for a few."""
    one, to, many = _folding()
    several = "[" + "".join(c for c, _ in many) + "]"

    def full(low: Column) -> Column:
        return _let(F.translate(low, one, to), lambda x: F.when(x.rlike(several), _chain(x, many)).otherwise(x))

    def folded(low: Column) -> Column:
        return F.when(low.rlike(r"[^\x00-\xb4\xb6-\u0148\u014a-\u017e]"), full(low)).otherwise(F.replace(low, F.lit("ß"), F.lit("ss")))

    return _let(F.lower(col), folded)


def _chain(col: Column, many: list[tuple[str, str]]) -> Column:
    table = _table(many)
    return F.array_join(F.transform(F.split(col, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")


def _table(pairs: list[tuple[str, str]]) -> Column:
    """A constant map, written as one literal."""
    return F.str_to_map(F.lit("\x1e".join(f"{a}\x1f{b}" for a, b in pairs)), F.lit("\x1e"), F.lit("\x1f"))


def fold_literal(text: str) -> str:
    return text.strip().casefold()


def snippet(source: Column, start: Column, end: Column) -> Column:
    """About 96 bytes on either side of byte range [start, end), cut at character boundaries, with ellipses where cut."""
    raw, n = source.cast("binary"), F.octet_length(source)
    low = F.greatest(start - SNIPPET_BYTES, F.lit(0))
    high = F.least(end + SNIPPET_BYTES, n)
    # a cut inside a character leaves replacement marks at that end
    piece = F.make_valid_utf8(F.substring(raw, low + 1, high - low).cast("string"))
    clean = F.regexp_replace(piece, "^\ufffd+|\ufffd+$", "")
    return F.concat(F.when(low > 0, "…").otherwise(""), clean, F.when(high < n, "…").otherwise(""))


def highlight(source: Column, query: str, before: str = "<mark>", after: str = "</mark>") -> Column:
    """The first hit between marks; a text whose folding has another length is left alone, as its places are not the folded ones."""
    needle = fold_literal(query)
    folded = casefold(source)
    at = F.instr(folded, needle)
    hit = F.substring(source, at, F.lit(len(needle)))
    marked = F.concat(F.substring(source, F.lit(1), at - 1), F.lit(before), hit, F.lit(after), F.substring(source, at + len(needle), F.length(source)))
    return F.when((at > 0) & (F.length(folded) == F.length(source)), marked).otherwise(source)


def match_range(source: Column, query: str) -> Column:
    """Byte range [start, end) in ``source`` of the first hit of the folded query; null if there is none, or if it begins or ends inside the folding of one character."""
    needle = fold_literal(query)
    bytes_to = lambda k: F.octet_length(F.substring(source, F.lit(1), k)).cast("long")

    def checked(p: Column) -> Column:
        same = casefold(F.substring(source, p["start"] + 1, p["end"] - p["start"])) == needle
        return F.when(same, F.struct(bytes_to(p["start"]).alias("start"), bytes_to(p["end"]).alias("end")))

    places = lambda at: F.struct(_source_place(source, at).alias("start"), _source_place(source, at + len(needle)).alias("end"))
    return _let(F.instr(casefold(source), needle) - 1, lambda at: F.when(at >= 0, _let(places(at), checked)))


@lru_cache(1)
def _lengthened() -> str:
    """The characters that fold to several, as a class of a pattern."""
    return "".join(c for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x1F000)]) if len(c.casefold()) > 1)


def _source_place(source: Column, at: Column) -> Column:
    """How many source characters fold to the first ``at`` folded ones. Only the characters that fold to several part the two counts; the text is taken in pieces
    that end with one. A place inside the folding of one character is given as some place after it."""
    several = _lengthened()
    pieces = F.regexp_extract_all(source, F.lit(f"[^{several}]*[{several}]"), F.lit(0))
    sizes = F.transform(pieces, lambda x: F.struct(F.length(x).alias("n"), (F.length(x) - 1 + F.length(casefold(F.substring(x, -1, 1)))).alias("folded")))
    on = lambda s, x: s["open"] & (s["folded"] + x["folded"] <= at)
    step = lambda s, x: F.when(on(s, x), F.struct((s["place"] + x["n"]).alias("place"), (s["folded"] + x["folded"]).alias("folded"), F.lit(True).alias("open"))).otherwise(F.struct(s["place"].alias("place"), s["folded"].alias("folded"), F.lit(False).alias("open")))
    start = F.struct(F.lit(0).alias("place"), F.lit(0).alias("folded"), F.lit(True).alias("open"))
    found = F.aggregate(sizes, start, step, lambda s: s["place"] + (at - s["folded"]).cast("int"))
    return F.when(source.rlike(f"[{several}]"), found).otherwise(at)


def grams(col: Column, width: int) -> Column:
    """Distinct n-grams of code points."""
    n = F.length(col)
    return F.when(n >= width, F.array_distinct(F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda k: F.substring(col, k, F.lit(width))))).otherwise(F.array().cast("array<string>"))


def gram_bucket(gram: Column, width: int) -> Column:
    """FNV-1a over code points, 32 bits, started from the width."""
    step = lambda h, c: F.pmod((h.bitwiseXOR(F.ascii(c).cast("long"))) * F.lit(16777619), F.lit(1 << 32))
    value = F.aggregate(F.filter(F.split(gram, ""), lambda c: c != ""), F.lit(2166136261 ^ width).cast("long"), step)
    return value.bitwiseAND(F.lit(GRAM_BUCKETS - 1)).cast("int")
