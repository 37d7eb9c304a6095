"""Secret scans in DataFrame functions only: patterns, and a battery of randomness tests.

Patterns find assignments of secrets, access keys and hexadecimal keys. Besides them, every run of
20 or more letters, digits and ``+/_-`` is a *candidate*. Its encoding is inferred (the smallest of
decimal, hexadecimal, base 32, and base 64 that has all its symbols), and four tests ask whether it
could be uniformly random in it:

* chi-squared: are the symbols equally frequent?
* chi-squared by kind: are lower-case letters, capitals and other symbols as frequent as the alphabet has them?
* runs: how often do neighbours change between the lower and the upper half of the alphabet?
* serial correlation: do neighbours go together?

The smallest of the four p-values, times four, is the candidate's. Within each class of length
and encoding, the Benjamini-Hochberg step-up over *all* candidates of the table finds those that
are certainly not random; their share of wrongly discarded secrets is held below ``RATE``. Of a
candidate that goes on after a key of the patterns, the rest is tested. What is left is reported as
``random``, as a whole, unless a span of a pattern covers it. Only one count per class
and step of the logarithm of p leaves the executors.

Positions are code points, ends are exclusive. The text is marked by one replacement per pattern
and cut at the marks; sums of lengths are taken in blocks, so a text with very many matches stays
linear enough. Nothing is shuffled but the counts.

Nulls: a null text is empty and has no spans. Repeated rows are each scanned, and count each in the
step-up; an empty table has no rows. Spans that start together are in the order of ``KINDS``. A very
long text takes time linear in its length and matches. Columns of any name are kept as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the base rules.
ASSIGN = (
    r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_VALUE = 6

KINDS = ("assign", "access", "hex", "random")
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
ALPHABETS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
RATE = 0.05
#: Least rest beside a key of the patterns that is tested on its own.
LEAST_REST = 8
#: p-values are counted in steps of a tenth of a power of ten, down to 10 ** -30.
STEPS_A_POWER, LEAST_POWER = 10, 30
MARK, STAND_IN = "\u0001", "\u0003"
BLOCK = 128
MASK = "[SECRET]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, also where ``use`` has functions over elements."""
    return F.transform(F.array(value), use)[0]


def _folded(values: Column, whole: str) -> Column:
    """Running ``sum`` or ``max`` of the values before each place, in blocks."""
    if whole == "sum":
        total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
        both = lambda x, y: x + y
    else:
        total = lambda a: F.coalesce(F.array_max(a), F.lit(0))
        both = F.greatest

    def blocks(v: Column) -> Column:
        count = F.ceil(F.size(v) / BLOCK).cast("int")
        cut = F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))
        return F.when(F.size(v) > 0, cut).otherwise(F.array().cast("array<array<int>>"))

    def running(cut: Column) -> Column:
        starts = let(
            F.transform(cut, total),
            lambda wholes: F.transform(wholes, lambda _, b: total(F.slice(wholes, 1, b))),
        )
        placed = F.zip_with(cut, starts, lambda block, start: F.struct(block.alias("block"), start.alias("start")))
        inner = lambda x: F.transform(x["block"], lambda _, i: both(x["start"], total(F.slice(x["block"], 1, i))))
        return F.flatten(F.transform(placed, inner))

    return let(let(values, blocks), running)


def _pieces(text: Column, pattern: str) -> Column:
    """The text cut at the matches: every second piece is one."""
    return F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)


def _matches(pieces: str, starts: str, kind: str) -> Column:
    """``(start, end, kind, value)`` of each match."""
    places = F.when(F.size(pieces) > 1, F.sequence(F.lit(1), F.size(pieces) - 1, F.lit(2))).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(
        places,
        lambda i: F.struct(
            F.get(starts, i).alias("start"),
            (F.get(starts, i) + F.length(F.get(pieces, i))).alias("end"),
            F.lit(KINDS.index(kind)).alias("kind"),
            F.get(pieces, i).alias("value"),
        ),
    )


def with_matches(docs: DataFrame, text: str, pattern: str, kind: str, name: str) -> DataFrame:
    """Adds the matches of a pattern. ``docs`` must not have columns that start with ``name``."""
    pieces, starts = f"{name}_pieces", f"{name}_starts"
    return (
        docs.withColumn(pieces, _pieces(F.col(text), pattern))
        .withColumn(starts, F.transform(pieces, lambda p: F.length(p)))
        .withColumn(starts, _folded(F.col(starts), "sum"))
        .withColumn(name, _matches(pieces, starts, kind))
        .drop(pieces, starts)
    )


# --- the battery


def encoding(value: Column) -> Column:
    return (
        F.when(value.rlike("^[0-9]+$"), "decimal")
        .when(value.rlike("^[0-9a-f]+$") | value.rlike("^[0-9A-F]+$"), "hex")
        .when(value.rlike("^[A-Z2-7]+$"), "base32")
        .otherwise("base64")
    )


def symbol_values(value: Column, code: Column) -> Column:
    """The place of each symbol in its alphabet. ``code`` is looked at for every symbol."""
    plain = F.when(code == "hex", F.lower(value)).otherwise(F.translate(value, "-_", "+/"))
    letters = F.filter(F.split(plain, ""), lambda c: c != "")
    alphabet = F.create_map(*(F.lit(x) for pair in ALPHABETS.items() for x in pair))[code]
    return F.transform(letters, lambda c: F.instr(alphabet, c) - 1)


def alphabet_size(code: Column) -> Column:
    return F.create_map(*(F.lit(x) for c, a in ALPHABETS.items() for x in (c, len(a))))[code]


def kinds_tail(value: Column, code: Column) -> Column:
    """The chi-squared tail of lower-case letters, capitals and other symbols, for base 64.

    Two degrees of freedom, for which the tail is exact. The other alphabets have one case.
    """
    n = F.length(value)
    lower, upper = (F.length(F.regexp_replace(value, pattern, "")) for pattern in ("[^a-z]", "[^A-Z]"))
    parts = ((lower, 26), (upper, 26), (n - lower - upper, 12))
    chi = sum((often * often * F.lit(64.0) / share for often, share in parts), F.lit(0.0)) / n - n
    return F.when(code == "base64", F.exp(-chi / 2)).otherwise(1.0)


def upper_tail(z: Column) -> Column:
    """The normal distribution's upper tail for z >= 0 (a known approximation, within 0.01)."""
    return 0.5 * F.exp(-0.717 * z - 0.416 * z * z)


def battery(value: Column) -> Column:
    """``(p_chi, p_kinds, p_runs, p_serial)`` of a string of 20 or more symbols."""

    def tests(v: Column, k: Column, code: Column) -> Column:
        n = F.size(v).cast("double")
        often = F.transform(F.sequence(F.lit(0), k - 1), lambda s: F.size(F.filter(v, lambda x: x == s)))
        squares = F.aggregate(often, F.lit(0.0), lambda t, o: t + o.cast("double") * o)
        chi = k * squares / n - n
        z_chi = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n))

        first, second = F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1)
        changes = F.zip_with(first, second, lambda x, y: ((2 * x >= k) != (2 * y >= k)).cast("double"))
        z_runs = (F.aggregate(changes, F.lit(0.0), lambda a, b: a + b) - (n - 1) / 2) / F.sqrt((n - 1) / 4)

        middle, variance = (k - 1) / 2.0, (k * k - 1) / 12.0
        products = F.zip_with(first, second, lambda x, y: (x - middle) * (y - middle))
        z_serial = F.aggregate(products, F.lit(0.0), lambda a, b: a + b) / (variance * F.sqrt(n - 1))

        two = lambda z: F.least(F.lit(1.0), 2 * upper_tail(F.abs(z)))
        return F.struct(
            two(z_chi).alias("p_chi"), kinds_tail(value, code).alias("p_kinds"),
            two(z_runs).alias("p_runs"), two(z_serial).alias("p_serial"),
        )

    return let(
        encoding(value),
        lambda code: let(
            alphabet_size(code), lambda k: let(symbol_values(value, code), lambda v: tests(v, k, code))
        ),
    )


def combined(p: Column) -> Column:
    return let(p, lambda t: F.least(F.lit(1.0), 4 * F.least(t["p_chi"], t["p_kinds"], t["p_runs"], t["p_serial"])))


def length_class(value: Column) -> Column:
    """Lengths by powers of two up to 1024 and beyond, and the encoding."""
    power = F.least(F.floor(F.log2(F.length(value))), F.lit(10)).cast("string")
    return F.concat_ws("-", encoding(value), power)


def step(p: Column) -> Column:
    """0 for p = 1, one more for each tenth of a power of ten below."""
    small = F.greatest(p, F.lit(10.0**-LEAST_POWER))
    return F.floor(-F.log10(small) * STEPS_A_POWER).cast("int")


def judged(value: Column) -> Column:
    """What is tested of a candidate: what keys of the patterns leave of it, if that is enough."""
    rest = F.regexp_replace(value, f"{ACCESS}|{HEX}", "")
    return F.when(F.length(rest) >= LEAST_REST, rest).otherwise(value)


def tested(matches: str) -> Column:
    """The candidates with their class and step."""
    return F.transform(
        matches,
        lambda m: let(
            judged(m["value"]),
            lambda v: F.struct(
                m["start"].alias("start"), m["end"].alias("end"), m["kind"].alias("kind"), m["value"].alias("value"),
                length_class(v).alias("class"), step(combined(battery(v))).alias("step"),
            ),
        ),
    )


def rejected_from(docs: DataFrame, text: str = "text", rate: float = RATE) -> dict[str, int]:
    """For each class the least step whose candidates are taken as not random.

    Benjamini-Hochberg on counts: the largest p whose expected share of random strings among the
    candidates at or below it, ``m p / count``, is within the rate.
    """
    clean = docs.select(F.replace(F.coalesce(text, F.lit("")), F.lit(MARK), F.lit(STAND_IN)).alias("text"))
    found = with_matches(clean, "text", CANDIDATE, "random", "found")
    # No filter on the matches: Spark would move it below them and split the text anew for each one.
    each = found.select(F.explode(tested("found")).alias("c"))
    counts = each.groupBy("c.class", "c.step").count().collect()  # classes by steps: a few thousand at most
    out = {}
    for name in {r["class"] for r in counts}:
        steps = {r["step"]: r["count"] for r in counts if r["class"] == name}
        total, reached = sum(steps.values()), 0
        for at in sorted(steps, reverse=True):  # smallest p first
            reached += steps[at]
            if total * 10 ** (-at / STEPS_A_POWER) <= rate * reached:
                out[name] = at
    return out


# --- spans


def find_secrets(docs: DataFrame, text: str = "text", rate: float = RATE) -> DataFrame:
    """``docs`` with ``secrets``: sorted ``(start, end, kind)``, ``kind`` a place in ``KINDS``."""
    limits = rejected_from(docs, text, rate)
    columns = docs.columns
    work = docs.select(
        F.struct(*columns).alias("row"),
        F.replace(F.coalesce(text, F.lit("")), F.lit(MARK), F.lit(STAND_IN)).alias("t"),
    )
    for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("random", CANDIDATE)):
        work = with_matches(work, "t", pattern, name, name)
    value = lambda m: F.regexp_extract(m["value"], ASSIGN, 2)
    plain = lambda name: F.transform(name, lambda m: F.struct(m["start"], m["end"], m["kind"]))
    work = work.withColumn("assign", F.filter("assign", lambda m: F.length(value(m)) >= ASSIGN_VALUE))
    work = work.withColumn("base", F.concat(plain("assign"), plain("access"), plain("hex")))

    # One number per class; a class without one has nothing to discard.
    limit_of = F.create_map(*(F.lit(x) for pair in ({"": -1} | limits).items() for x in pair))
    random = F.filter(tested("random"), lambda m: F.coalesce(m["step"] < limit_of[m["class"]], F.lit(True)))
    work = work.withColumn("kept", random)
    work = work.withColumn("kept", F.array_sort(F.concat("base", plain("kept")), _by_start))
    # Patterns come first among spans with one start: how far those at or before each place reach.
    of_pattern = lambda m: m["kind"] < KINDS.index("random")
    ends = F.transform("kept", lambda m: F.when(of_pattern(m), m["end"]).otherwise(0))
    work = work.withColumn("reached", _folded(ends, "max"))
    placed = F.zip_with("kept", "reached", lambda m, end: F.struct(m.alias("m"), end.alias("end")))
    open_ones = F.filter(placed, lambda x: of_pattern(x["m"]) | (x["end"] < x["m"]["end"]))
    secrets = F.transform(open_ones, lambda x: x["m"])
    return work.select("row.*", secrets.alias("secrets"))


def _by_start(a: Column, b: Column) -> Column:
    less = (a["start"] < b["start"]) | (a["start"] == b["start"]) & (a["kind"] < b["kind"])
    more = (a["start"] > b["start"]) | (a["start"] == b["start"]) & (a["kind"] > b["kind"])
    return F.when(less, -1).when(more, 1).otherwise(0)


def listed(secrets: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    one = lambda m: F.concat_ws(":", F.get(names, m["kind"]), m["start"].cast("string"), m["end"].cast("string"))
    return F.array_join(F.transform(secrets, one), ",")


def masked(text: str, secrets: str) -> Column:
    """The text with every span, overlapping ones as one, replaced by ``MASK``."""
    ends = _folded(F.transform(secrets, lambda m: m["end"]), "max")
    parts = F.transform(
        F.zip_with(
            secrets, ends,
            lambda m, before: F.struct(m["start"].alias("start"), before.alias("before")),
        ),
        lambda x, i: F.when(
            (x["start"] > x["before"]) | (i == 0),
            F.concat(F.substring(text, x["before"] + 1, x["start"] - x["before"]), F.lit(MASK)),
        ).otherwise(""),
    )
    last = F.array_max(F.transform(secrets, lambda m: m["end"]))
    rest = F.substring(text, last + 1, F.length(text))
    return F.when(F.size(secrets) > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(F.col(text))
