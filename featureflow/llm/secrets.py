"""Secrets in texts: fixed patterns, and a battery of randomness tests, in DataFrame functions only.

Fixed patterns find assignments, access keys and long hex runs. The battery looks at every long run
of encoding characters, and where fixed patterns cover some of it, at every long piece that they leave
(those shorter than `LEAST_RUN` are not looked at). Its encoding is inferred from the characters that it has; under the
hypothesis that it is random, three statistics have known means and variances at any length:
chi-squared of the characters' counts against a uniform alphabet, the number of runs above and below
the alphabet's middle, and the serial correlation of neighbours. A run that random text would hardly
be by any of them is out. What passes may still be words, short ones above all; how likely is so even
a count from written text follows from the coincidence rate of letters and the length. These chances,
of all candidates of the corpus, are put through Benjamini-Hochberg, so that at most `false_share`
of the reported runs are expected to be words, whatever their lengths.

Chances are counted in steps of a tenth of a power of ten (a few hundred counts, whatever the
input), and each step counts as its upper end.

Cases: null text is empty (`redact` leaves it null); null doc_ids and repeated rows are rows as any
others; an empty table has no candidates. Texts are read whole: work grows with length and matches,
and arrays of single characters are made of a block at a time. Spans that
start together are ordered by kind, in the order of KINDS, then end. Places are code points, ends
exclusive. Other columns are kept by `redact`, clashing names raise ValueError; `scan` ignores them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featureflow.llm.common import let, materialise, part, text_blocks

_ASSIGN_HEAD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ASSIGN = _ASSIGN_HEAD + r"[A-Za-z0-9+/_.=-]+"
#: A longest run that is long enough, which is the same as a longest run, kept if long enough.
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
LEAST_RUN = 20
#: Values of a scan that are joined one after another.
GROUP = 256
RUN = rf"[A-Za-z0-9+/_-]{{{LEAST_RUN},}}"
SPAN = "array<struct<start:bigint,ord:int,end:bigint>>"
CANDIDATE = "array<struct<start:bigint,end:bigint,step:int>>"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Params:
    least_z: float = 3.2  # deviations at which one of three tests rejects randomness, all together about 0.4 %
    coincidence: float = 0.065  # chance that two letters of written text are equal
    hex_coincidence: float = 0.12
    digit_coincidence: float = 0.15
    false_share: float = 0.02
    most_steps: int = 400


def _scan(values: Column, join: Callable[[Column, Column], Column], levels: int = 2) -> Column:
    """`join` of all values of an array up to each place: in groups, and over the groups' last ones likewise, so that no array grows by appending beyond a group's size."""

    def within(group: Column) -> Column:
        first = F.slice(group, F.lit(1), F.lit(1))
        return F.aggregate(F.slice(group, F.lit(2), F.size(group)), first, lambda acc, x: F.array_append(acc, join(F.element_at(acc, -1), x)))

    def over(values: Column, levels: int) -> Column:
        if not levels:
            return within(values)
        groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / GROUP).cast("int")), lambda g: within(F.slice(values, g * GROUP + 1, F.lit(GROUP))))

        def joined(groups: Column) -> Column:
            before = over(F.transform(groups, lambda g: F.element_at(g, -1)), levels - 1)
            return let(before, lambda b: F.flatten(F.transform(groups, lambda g, i: F.when(i == 0, g).otherwise(F.transform(g, lambda x: join(x, F.get(b, i - 1)))))))

        return let(groups, joined)

    return let(values, lambda v: F.when(F.size(v) > 0, over(v, levels)).otherwise(v))


def _found(text: Column, pattern: str) -> Column:
    """Matches from left to right with their places: the text is split by them, and lengths are added up."""
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint,hit:string>>)")

    def placed(gaps: Column, hits: Column) -> Column:
        sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda gap, hit: (F.length(gap) + F.length(hit)).cast("long"))
        return F.zip_with(_scan(sizes, lambda x, y: x + y), hits, lambda end, hit: F.struct((end - F.length(hit)).alias("start"), end.alias("end"), hit.alias("hit")))

    places = let(F.split(text, pattern, -1), lambda gaps: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: placed(gaps, hits)))
    return F.when(text.rlike(pattern), places).otherwise(none)


def _replaced(text: Column, spans: Column, by: Callable[[Column, Column], Column]) -> Column:
    """The text with each of the spans (by start) replaced by by(whether it begins outside of those before it, how much it adds to them)."""

    def pieces(blocks: Column, spans: Column) -> Column:
        reach = _scan(F.transform(spans, lambda s: s["end"]), lambda x, y: F.greatest(x, y))

        def written(reach: Column) -> Column:
            before = lambda i: F.when(i > 0, F.get(reach, i - 1)).otherwise(F.lit(0).cast("long"))
            parts = F.transform(spans, lambda s, i: let(before(i), lambda at: F.concat(part(blocks, at, s["start"]), by(s["start"] >= at, F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], at))))))
            return F.concat(F.array_join(parts, ""), part(blocks, F.element_at(reach, -1), F.length(text).cast("long")))

        return let(reach, written)

    return F.when(F.size(spans) > 0, let(text_blocks(text), lambda blocks: let(spans, lambda s: pieces(blocks, s)))).otherwise(text)


def _spans(found: Column, order: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("ord"), x["end"].alias("end")))


def _alphabet(run: Column) -> Column:
    """The smallest alphabet that a run may be over."""
    both = UPPER + LOWER
    return (
        F.when(run.rlike("^[0-9]+$"), DIGITS)
        .when(run.rlike("^[0-9_-]+$"), DIGITS + "-_")
        .when(run.rlike("^[0-9+/]+$"), DIGITS + "+/")
        .when(run.rlike("^[0-9a-f]+$"), DIGITS + "abcdef")
        .when(run.rlike("^[0-9A-F]+$"), DIGITS + "ABCDEF")
        .when(run.rlike("^[a-z]+$"), LOWER)
        .when(run.rlike("^[A-Z]+$"), UPPER)
        .when(run.rlike("^[a-z_-]+$"), LOWER + "-_")
        .when(run.rlike("^[A-Z_-]+$"), UPPER + "-_")
        .when(run.rlike("^[a-z+/]+$"), LOWER + "+/")
        .when(run.rlike("^[A-Z+/]+$"), UPPER + "+/")
        .when(run.rlike("^[A-Z2-7]+$"), UPPER + "234567")
        .when(run.rlike("^[0-9a-z]+$"), DIGITS + LOWER)
        .when(run.rlike("^[0-9A-Z]+$"), DIGITS + UPPER)
        .when(run.rlike("^[A-Za-z]+$"), both)
        .when(run.rlike("^[A-Za-z0-9]+$"), both + DIGITS)
        .when(run.rlike("^[A-Za-z0-9+/]+$"), both + DIGITS + "+/")
        .when(run.rlike("^[A-Za-z0-9_-]+$"), both + DIGITS + "-_")
        .otherwise(both + DIGITS + "+/-_")
    )


def _upper_tail(z: Column) -> Column:
    """Chance that a normal variable is above z >= 0 (Abramowitz and Stegun 26.2.17; fixed values)."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) * 0.3989422804014327 * poly


def _judged(candidates: Column, p: Params) -> Column:
    """Runs (start, end, hit) with a letter or digit -> start, end and the step of their chance to be words; 0 if they don't pass the battery."""
    number = lambda x: x.cast("double")
    signed = F.filter(candidates, lambda c: c["hit"].rlike("[A-Za-z0-9]"))
    named = F.transform(signed, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["hit"].alias("hit"), _alphabet(c["hit"]).alias("signs")))

    def neighbours(c: Column) -> Column:
        """Changes of side and products of neighbours, added up over blocks that share one character."""
        middle = (F.length(c["signs"]) - 1) / 2

        def block(text: Column) -> Column:
            x = F.transform(F.filter(F.split(text, ""), lambda s: s != ""), lambda s: number(F.instr(c["signs"], s) - 1) - middle)

            def sums(x: Column) -> Column:
                pairs = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
                none = F.struct(F.lit(0.0).alias("turns"), F.lit(0.0).alias("serial"))
                return F.aggregate(pairs, none, lambda acc, p: F.struct((acc["turns"] + F.when((p["a"] > 0) == (p["b"] > 0), 0.0).otherwise(1.0)).alias("turns"), (acc["serial"] + p["a"] * p["b"]).alias("serial")))

            return let(x, sums)

        whole = lambda blocks: F.transform(blocks, lambda b, i: block(F.concat(b, F.coalesce(F.substr(F.get(blocks, i + 1), F.lit(1), F.lit(1)), F.lit("")))))
        return let(text_blocks(c["hit"]), whole)

    total = lambda sums, name: F.aggregate(sums, F.lit(0.0), lambda acc, x: acc + x[name])
    squares = lambda c: F.aggregate(F.split(c["signs"], ""), F.lit(0.0), lambda acc, s: acc + F.when(s == "", 0.0).otherwise(F.pow(F.length(c["hit"]) - F.length(F.replace(c["hit"], s, F.lit(""))), F.lit(2.0))))
    counted = F.transform(
        F.transform(named, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), number(F.length(c["hit"])).alias("n"), number(F.length(c["signs"])).alias("m"), squares(c).alias("squares"), neighbours(c).alias("sums"))),
        lambda c: F.struct(
            c["start"].alias("start"),
            c["end"].alias("end"),
            c["n"].alias("n"),
            c["m"].alias("m"),
            (c["m"] / c["n"] * c["squares"] - c["n"]).alias("chi"),
            total(c["sums"], "turns").alias("turns"),
            total(c["sums"], "serial").alias("serial"),
        ),
    )

    def random(c: Column) -> Column:
        n, m = c["n"], c["m"]
        chi = (c["chi"] - (m - 1)) / F.sqrt(2 * (m - 1) * (n - 1) / n)
        runs = (c["turns"] - (n - 1) / 2) / (F.sqrt(n - 1) / 2)
        serial = c["serial"] / ((m * m - 1) / 12 * F.sqrt(n - 1))
        return (chi < p.least_z) & (F.abs(runs) < p.least_z) & (F.abs(serial) < p.least_z)

    def step(c: Column) -> Column:
        n, m = c["n"], c["m"]
        rate = F.when(m == 16, F.lit(p.hex_coincidence)).when(m < 16, F.lit(p.digit_coincidence)).otherwise(F.lit(p.coincidence))
        shift = n * (m * rate - 1)
        z = (m - 1 + shift - c["chi"]) / F.sqrt(2 * (m - 1 + 2 * shift))
        chance = F.when(z <= 0, F.lit(1.0)).otherwise(_upper_tail(F.least(z, F.lit(30.0))))
        return F.least(F.floor(-10 * F.log10(chance)).cast("int"), F.lit(p.most_steps))

    return F.transform(counted, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.when(random(c), step(c)).otherwise(F.lit(0)).alias("step")))


def spans(documents: DataFrame, p: Params = Params()) -> DataFrame:
    """documents with `base` (spans of the fixed patterns by start, then kind) and `candidates` (runs outside of them)."""
    text = F.coalesce("text", F.lit(""))
    value = lambda hit: F.regexp_replace(hit, "^" + _ASSIGN_HEAD, "")
    df = documents.withColumn("_a", F.filter(_found(text, ASSIGN), lambda x: F.length(value(x["hit"])) >= 6))
    df = df.withColumn("base", F.array_sort(F.concat(_spans(F.col("_a"), 0), _spans(_found(text, ACCESS), 1), _spans(_found(text, HEX), 2))).cast(SPAN)).drop("_a")
    # What fixed patterns leave of runs are the runs of the text with spaces in their place.
    left = _replaced(text, F.col("base"), lambda _, size: F.repeat(F.lit(" "), size.cast("int")))
    df = df.withColumn("_t", left).withColumn("_r", _found(F.col("_t"), RUN)).drop("_t")
    return df.withColumn("candidates", F.when(F.size("_r") > 0, _judged(F.col("_r"), p)).otherwise(F.array()).cast(CANDIDATE)).drop("_r")


def limit(found: DataFrame, p: Params = Params()) -> int:
    """Benjamini-Hochberg over the candidates of `spans`: the least step that is reported; above all steps if none is."""
    counts = dict(found.select(F.explode("candidates.step").alias("s")).groupBy("s").count().collect())  # at most most_steps rows
    total, above, best = sum(counts.values()), 0, p.most_steps + 1
    for s in range(p.most_steps, -1, -1):
        above += counts.get(s, 0)
        if above and 10 ** (-s / 10) * total <= p.false_share * above:
            best = s
    return best


def _all(least: int) -> Column:
    random = F.filter("candidates", lambda c: c["step"] >= least)
    added = F.transform(random, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("ord"), c["end"].alias("end")))
    return F.array_sort(F.concat("base", added))


def _written(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["ord"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(documents: DataFrame, p: Params = Params()) -> DataFrame:
    """documents (doc_id, text) -> doc_id, n_assign, n_access, n_hex, base_sha256, spans ("kind:start:end", comma-joined)."""
    found = materialise(spans(documents.select("doc_id", "text"), p).drop("text"), "spans")
    count = lambda order: F.size(F.filter("base", lambda s: s["ord"] == order)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(_all(limit(found, p))).alias("spans"))


def redact(documents: DataFrame, mask: str = "[SECRET]", p: Params = Params()) -> DataFrame:
    """documents with every span of `scan` in their texts replaced by `mask`; overlapping spans become one. Other texts stay as they are."""
    if clash := {"base", "candidates", "_a", "_r", "_s", "_t"} & set(documents.columns):
        raise ValueError(f"columns {sorted(clash)} are already there")
    found = materialise(spans(documents, p), "found")  # with the texts: reading them again is cheaper than finding again
    least = limit(found, p)
    clean = _replaced(F.col("text"), F.col("_s"), lambda apart, _: F.when(apart, mask).otherwise(""))
    return found.withColumn("_s", _all(least)).withColumn("text", F.when(F.col("text").isNotNull(), clean)).select(*documents.columns)
