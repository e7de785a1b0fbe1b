"""Secret scans. Built-in functions only.

Three fixed patterns give the base spans. The method adds spans of kind
``random``: runs of token characters outside of base spans, at least ``LEAST``
long, that look drawn at random. Two character Markov models decide: one of
random strings and one of ordinary identifiers. They are trained on labelled
samples from all texts: the values of base spans are the random strings, and
runs of letters with joining marks are the identifiers. The score of a run is
its log-likelihood ratio; it is taken if that reaches ``TOTAL`` and ``MEAN`` for
each transition. As known secrets cover few alphabets, the model of random
strings is mixed with one that draws every character alike.

What goes to the driver are the two tables of transition counts, 80 by 80
symbols at most whatever the input.

Positions are code points. A pattern's places come from one scan in which the
text before each match is captured beside it, so they are running sums of
lengths; after the last match the rest is taken in one step. Running values are
taken in blocks, texts are cut by bytes, and a run is split into characters once, so
the time grows with the length of a text and with the number of its spans, not with
their square. Null texts count as empty. Repeated rows are scanned each.
Other columns pass through, but for those named like the results.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import let

# The base patterns, and the least length of what each must hold.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
#: A text without a match of this has no assignment. Runs of hexadecimal digits are maximal, so only long ones need matching.
KEYED = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
HEX_RUN = HEX[:-1] + "{16,}"
KINDS = ("assign", "access", "hex", "random")

LEAST = 16
TOTAL = 12.0
MEAN = 0.8
RUN = r"[A-Za-z0-9+/_=-]"
IDENTIFIER = r"(?<![A-Za-z0-9+/_=-])[A-Za-z]+(?:[_-][A-Za-z]+)*(?![A-Za-z0-9+/_=-])"
#: Symbols are ASCII codes from ``+`` on.
FIRST, SYMBOLS = 43, 80
#: Spans order by start, then kind. All that the patterns match is ASCII, so a span has as many bytes as code points; ``byte`` is where they begin.
_SPAN = "struct<start: int, kind: int, end: int, byte: int>"
BLOCK = 256


def running(items: Column, start: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """``emit(state, item)`` of each item, an array of ``kind``; the state of the next one is ``step(state, item)``.

    Adding to an array copies it, so results gather in blocks and then by block.
    """
    none = F.array().cast(f"array<{kind}>")

    def add(acc: Column, x: Column) -> Column:
        return F.struct(step(acc["state"], x).alias("state"), F.concat(acc["out"], F.array(emit(acc["state"], x))).alias("out"))

    def block(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["state"].alias("state"), none.alias("out")), add)
        return let(inner, lambda i: F.struct(i["state"].alias("state"), F.concat(acc["out"], F.array(i["out"])).alias("out")))

    def blocks(given: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(given) - 1) / BLOCK).cast("int")), lambda i: F.slice(given, i * BLOCK + 1, F.lit(BLOCK)))
        nothing = F.array().cast(f"array<array<{kind}>>")
        return F.when(F.size(given) > 0, F.flatten(F.aggregate(parts, F.struct(start.alias("state"), nothing.alias("out")), block, lambda acc: acc["out"]))).otherwise(none)

    return let(items, blocks)


def _places(text: Column, pattern: str, guard: str, value_group: int, least: int, kind: int, hold: bool = False) -> Column:
    """Spans of the matches whose group holds at least ``least`` characters, with the matches as ``run`` if ``hold``. ``guard`` must match wherever one could be."""
    scan = F.lit(rf"([\s\S]*?)({pattern})|[\s\S]+")
    part = lambda k: F.regexp_extract_all(text, scan, F.lit(k))
    run = lambda m: [m.alias("run")] if hold else []
    sizes = F.zip_with(part(1), part(2), lambda g, m: F.struct(F.length(g).alias("gap"), F.octet_length(g).alias("bytes"), F.length(m).alias("n"), *run(m)))
    if value_group != 2:
        sizes = F.zip_with(sizes, part(value_group), lambda s, v: F.struct(s["gap"].alias("gap"), s["bytes"].alias("bytes"), s["n"].alias("n"), F.length(v).alias("value")))
    value = "value" if value_group != 2 else "n"
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("byte"))

    def step(acc: Column, s: Column) -> Column:
        return F.struct((acc["at"] + s["gap"] + s["n"]).alias("at"), (acc["byte"] + s["bytes"] + s["n"]).alias("byte"))

    def emit(acc: Column, s: Column) -> Column:
        begin = acc["at"] + s["gap"]
        return F.struct(begin.alias("start"), F.lit(kind).alias("kind"), (begin + s["n"]).alias("end"), (acc["byte"] + s["bytes"]).alias("byte"), *(run(s["run"]) if hold else []), (s[value] >= least).alias("holds"))

    fields = _SPAN[:-1] + (", run: string" if hold else "")
    found = F.filter(running(sizes, start, step, emit, f"{fields}, holds: boolean>"), lambda s: s["holds"])
    found = F.transform(found, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "kind", "end", "byte")], *(run(s["run"]) if hold else [])))
    return F.when(F.regexp_like(text, F.lit(guard)), found).otherwise(F.array().cast(f"array<{fields}>>"))


def base_spans(text: Column) -> Column:
    """Base spans by start, then kind."""
    found = [
        _places(text, ASSIGN, KEYED, 4, LEAST_ASSIGN, 0),
        _places(text, ACCESS, "AKIA[A-Z0-9]{14}", 2, LEAST_ACCESS, 1),
        _places(text, HEX_RUN, "[0-9a-f]{16}", 2, LEAST_HEX, 2),
    ]
    return ordered(*found)


def _neighbours(token: Column, both: Callable[[Column, Column], Column]) -> Column:
    """``both`` of each two neighbouring characters; the token is split once."""
    chars = F.split(token, "")
    return let(chars, lambda c: F.zip_with(F.slice(c, F.lit(1), F.length(token) - 1), F.slice(c, F.lit(2), F.length(token) - 1), both))


def _transitions(tokens: DataFrame, token: str, weight: str) -> DataFrame:
    pairs = F.explode(_neighbours(F.col(token), lambda a, b: F.concat(a, b)))
    return tokens.where(F.length(token) > 1).select(pairs.alias("pair"), F.col(weight).alias("n")).groupBy("pair").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text_col: str = "text", mix: float = 0.5) -> list[float]:
    """Log-likelihood ratio of each transition, ``SYMBOLS`` squared, row by row."""
    text = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    value = F.concat(
        F.when(F.regexp_like("text", F.lit(KEYED)), F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2))).otherwise(F.array().cast("array<string>")),
        F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)), F.when(F.regexp_like("text", F.lit("[0-9a-f]{16}")), F.regexp_extract_all("text", F.lit(HEX_RUN), F.lit(0))).otherwise(F.array().cast("array<string>")),
    )
    least = min(LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX)
    random = text.select(F.explode(F.filter(value, lambda v: F.length(v) >= least)).alias("token")).select("token", F.lit(1).alias("n"))
    names = text.select(F.explode(F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    found = _transitions(random, "token", "n").select("pair", "n", F.lit(0).alias("side")).unionByName(_transitions(names, "token", "n").select("pair", "n", F.lit(1).alias("side"))).collect()
    counts = [[[0.0] * SYMBOLS for _ in range(SYMBOLS)] for _ in range(2)]
    for r in found:
        a, b = (ord(c) - FIRST for c in r["pair"])
        if 0 <= a < SYMBOLS and 0 <= b < SYMBOLS:
            counts[r["side"]][a][b] += r["n"]
    usable, out = 66, []
    for a in range(SYMBOLS):
        rand, name = counts[0][a], counts[1][a]
        for b in range(SYMBOLS):
            p = (1 - mix) * (rand[b] + 1) / (sum(rand) + usable) + mix / usable
            q = (name[b] + 0.5) / (sum(name) + 0.5 * usable)
            out.append(math.log(p / q))
    return out


def _ratio(token: Column, model: Column) -> Column:
    cell = lambda a, b: F.get(model, (F.ascii(a) - FIRST) * SYMBOLS + F.ascii(b) - FIRST)
    return F.aggregate(_neighbours(token, cell), F.lit(0.0), lambda s, x: s + x)


def _byte_end(s: Column) -> Column:
    return s["byte"] + s["end"] - s["start"]


def _replaced(text: Column, spans: Column, by: Callable[[Column, Column], Column]) -> Column:
    """``text`` with ``by(at, span)`` in place of what each span covers beyond byte ``at``, where the spans before it end (-1 for the first)."""

    def cut(data: Column, s: Column) -> Column:
        part = lambda a, n: F.substring(data, a + 1, F.greatest(n, F.lit(0))).cast("string")
        done = lambda at: F.greatest(at, F.lit(0))
        parts = running(s, F.lit(-1), lambda at, x: F.greatest(at, _byte_end(x)), lambda at, x: F.concat(part(done(at), x["byte"] - done(at)), by(at, x)), "string")
        end = F.array_max(F.transform(s, _byte_end))
        return F.concat(F.array_join(parts, ""), let(end, lambda e: part(e, F.octet_length(data) - e)))

    return F.when(F.size(spans) > 0, let(text.cast("binary"), lambda data: let(spans, lambda s: cut(data, s)))).otherwise(text)


def random_spans(text: Column, base: Column, ratios: list[float]) -> Column:
    """Spans of the runs, or the parts of runs outside of base spans, that the models call random."""
    model = F.split(F.lit(",".join(f"{x:.5f}" for x in ratios)), ",").cast("array<double>")
    blank = _replaced(text, base, lambda at, s: F.repeat(F.lit(" "), F.greatest(_byte_end(s) - F.greatest(at, s["byte"]), F.lit(0))))
    taken = lambda s: let(_ratio(s["run"], model), lambda x: (x >= TOTAL) & (x >= MEAN * (F.length(s["run"]) - 1)))
    found = F.filter(_places(blank, RUN + "{16,}", RUN + "{16}", 2, LEAST, 3, hold=True), taken)
    return F.transform(found, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "kind", "end", "byte")]))


def scan(docs: DataFrame, ratios: list[float], text_col: str = "text", base: str = "base_spans", random: str = "random_spans") -> DataFrame:
    """``docs`` with two more columns: base and random spans, arrays of start, kind, end and first byte."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = docs.withColumn(base, base_spans(text))
    return spans.withColumn(random, random_spans(text, F.col(base), ratios))


def ordered(*spans: Column | str) -> Column:
    return F.array_sort(F.concat(*spans))


def is_kind(kind: int):  # noqa: ANN201
    return lambda s: s["kind"] == kind


def written(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each maximal covered stretch replaced by ``mark``; ``spans`` by start."""
    return _replaced(text, spans, lambda at, s: F.when(s["byte"] > at, F.lit(mark)).otherwise(F.lit("")))
