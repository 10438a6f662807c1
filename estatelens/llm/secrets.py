"""Secrets in texts: fixed patterns, and a battery of randomness tests on long tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelens.llm.common import whole_text
from estatelens.session import settle

# The patterns of the base kinds in their order, the group whose length counts, and its least length.
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
#: What a text must hold for a pattern to be tried; longest-run patterns need no shorter runs.
NEEDED = {"assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": "AKIA", "hex": "[0-9a-f]{32}"}
RUNS = {"hex": r"[0-9a-f]{32,}"}

TOKEN_LENGTH = 20
TOKEN = rf"[A-Za-z0-9+/_-]{{{TOKEN_LENGTH},}}={{0,2}}"
RATE = 0.01  # of false discoveries within a band of lengths
LEAST_RANDOM = 0.001  # p-value below which a token is not random
TEXT_REPEATS = 0.065  # chance that two letters of ordinary text are equal
TEXT_SWITCHES = 2.0  # mean changes between letters and digits in an ordinary token

DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: Encodings by what their tokens match, narrowest first, each with its alphabet in order.
ENCODINGS = (
    ("decimal", r"^[0-9]+$", DIGITS),
    ("hex", r"^[0-9a-f]+$", DIGITS + LOWER[:6]),
    ("hex", r"^[0-9A-F]+$", DIGITS + LOWER[:6].upper()),
    ("lower", r"^[a-z]+$", LOWER),
    ("upper", r"^[A-Z]+$", LOWER.upper()),
    ("base32", r"^[A-Z2-7]+$", LOWER.upper() + "234567"),
    ("base36", r"^[a-z0-9]+$", DIGITS + LOWER),
    ("letters", r"^[A-Za-z]+$", LOWER.upper() + LOWER),
    ("base62", r"^[A-Za-z0-9]+$", LOWER.upper() + LOWER + DIGITS),
    ("base64", r"^[A-Za-z0-9+/]+$", LOWER.upper() + LOWER + DIGITS + "+/"),
    ("base64url", r"", LOWER.upper() + LOWER + DIGITS + "-_+/"),
)


def matches(text: Column, pattern: str, group: int) -> Column:
    """Leftmost non-overlapping matches as (start, end, size of the group), in code points.

    The text between the matches comes from `split`, so positions are running sums of lengths.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.char_length)
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    both = F.zip_with(F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), F.char_length(m).alias("long"))), sizes,
                      lambda a, n: F.struct(a["gap"].alias("gap"), a["long"].alias("long"), n.alias("size")))
    both = F.filter(both, lambda x: x["long"].isNotNull())
    empty = F.array().cast("array<struct<start:int,end:int,size:int>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def add(state, x):
        begin = state["at"] + x["gap"]
        end = begin + x["long"]
        span = F.struct(begin.alias("start"), end.alias("end"), x["size"].alias("size"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    return F.aggregate(both, start, add, lambda s: s["out"])


def base_spans(text: Column) -> Column:
    """Spans of all base kinds as (start, kind number, end), sorted."""
    parts = []
    for i, (kind, pattern, group, least) in enumerate(BASE):
        found = F.filter(matches(text, RUNS.get(kind, pattern), group), lambda m: m["size"] >= least)  # noqa: B023
        spans = F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(i).alias("kind"), m["end"].alias("end")))  # noqa: B023
        parts.append(F.when(text.rlike(NEEDED[kind]), spans).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>")))
    return F.array_sort(F.concat(*parts))


def candidates(text: Column) -> Column:
    """Long tokens as (start, end, token)."""
    found = matches(text, TOKEN, 0)
    cut = F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.substr(text, m["start"] + 1, m["end"] - m["start"]).alias("token")))
    return F.when(text.rlike(f"[A-Za-z0-9+/_-]{{{TOKEN_LENGTH}}}"), cut).otherwise(F.array().cast("array<struct<start:int,end:int,token:string>>"))


def upper_tail(z: Column) -> Column:
    """P(normal > z), by the usual polynomial, to seven digits."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def tested(tokens: DataFrame) -> DataFrame:
    """The battery's results for distinct ``token`` strings.

    ``p_random`` is the chance that a uniformly random token of this length and encoding
    scores as badly in one of three tests (Bonferroni): chi-squared uniformity over the
    alphabet, Wald-Wolfowitz runs about the alphabet's middle, and serial correlation of
    neighbours. ``p_text`` is the chance that an ordinary token of this length scores as
    randomly as this: ordinary text repeats its letters more often (by an excess of the
    chi-squared score that grows with the length) and changes between letters and digits
    seldom.
    """
    body = F.rtrim(F.col("token"), F.lit("="))
    rows = tokens.withColumn("body", body).withColumn("n", F.char_length("body").cast("double"))
    which = reduce(lambda rest, i: F.when(F.col("body").rlike(ENCODINGS[i][1]), i).otherwise(rest), reversed(range(len(ENCODINGS) - 1)), F.lit(len(ENCODINGS) - 1))
    rows = rows.withColumn("which", which)
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("which") + 1)
    rows = rows.withColumn("encoding", pick([e[0] for e in ENCODINGS])).withColumn("alphabet", pick([e[2] for e in ENCODINGS]))
    rows = rows.withColumn("a", F.char_length("alphabet").cast("double"))
    signs = F.filter(F.split("body", ""), lambda c: c != "")
    rows = rows.withColumn("signs", signs).withColumn("v", F.expr("transform(signs, c -> cast(instr(alphabet, c) - 1 as double))"))
    squares = F.expr("aggregate(array_distinct(signs), 0D, (s, c) -> s + pow(n - length(replace(body, c, '')), 2))")
    chi = F.col("a") / F.col("n") * squares - F.col("n")
    rows = rows.withColumn("z_chi", (chi - (F.col("a") - 1)) / F.sqrt(2 * (F.col("a") - 1) * (F.col("n") - 1) / F.col("n")))
    rows = rows.withColumn("high", F.expr("transform(v, x -> if(x >= a / 2, 1D, 0D))"))
    rows = rows.withColumn("n1", F.expr("aggregate(high, 0D, (s, x) -> s + x)"))
    changes = F.expr("aggregate(zip_with(slice(high, 1, size(high) - 1), slice(high, 2, size(high)), (x, y) -> abs(x - y)), 0D, (s, x) -> s + x)")
    mean = 2 * F.col("n1") * (F.col("n") - F.col("n1")) / F.col("n") + 1
    var = (mean - 1) * (mean - 2) / (F.col("n") - 1)
    rows = rows.withColumn("z_runs", F.when(var > 0, (changes + 1 - mean) / F.sqrt(var)).otherwise(F.lit(9.0)))
    near = F.expr("aggregate(zip_with(slice(v, 1, size(v) - 1), slice(v, 2, size(v)), (x, y) -> (x - (a - 1) / 2) * (y - (a - 1) / 2)), 0D, (s, x) -> s + x)")
    rows = rows.withColumn("z_serial", near / ((F.col("a") * F.col("a") - 1) / 12 * F.sqrt(F.col("n") - 1)))
    worst = F.least(upper_tail(F.col("z_chi")), 2 * upper_tail(F.abs("z_runs")), 2 * upper_tail(F.abs("z_serial")))
    rows = rows.withColumn("p_random", F.least(F.lit(1.0), 3 * worst))
    # ordinary text
    kinds = F.translate("body", LOWER + LOWER.upper() + DIGITS + "+/-_", "l" * 52 + "d" * 10)  # signs go
    rows = rows.withColumn("kinds", F.split(kinds, ""))
    switches = F.expr("size(filter(zip_with(slice(kinds, 1, size(kinds) - 1), slice(kinds, 2, size(kinds)), (x, y) -> x <> y), b -> b))")
    excess = F.greatest(F.lit(0.0), F.col("n") * (F.col("a") * TEXT_REPEATS - 1) / F.sqrt(2 * (F.col("a") - 1)))
    by_repeats = F.when(F.col("a") > 16, excess - F.col("z_chi")).otherwise(0.0)
    mixes = ~F.col("encoding").isin("decimal", "lower", "upper", "letters")
    by_switches = F.when(mixes, (switches - TEXT_SWITCHES) / TEXT_SWITCHES ** 0.5).otherwise(0.0)
    weight = F.sqrt((F.col("a") > 16).cast("double") + mixes.cast("double"))
    z_text = F.when(weight > 0, (by_repeats + by_switches) / weight).otherwise(0.0)
    rows = rows.withColumn("p_text", upper_tail(z_text))
    return rows.select("token", "encoding", F.col("n").cast("int").alias("length"), "z_chi", "z_runs", "z_serial", "p_random", "p_text")


def discovered(tests: DataFrame, rate: float = RATE) -> DataFrame:
    """Tokens that stand out from ordinary text at the false-discovery rate ``rate`` and pass the battery.

    Benjamini-Hochberg within bands of doubling length, so the many short tokens do not pay
    for the few long ones. p-values are counted in steps of a quarter of a decimal place and
    each is rounded up, which keeps the bound: what is sorted is a fixed number of steps.
    """
    step = F.floor(F.least(F.lit(80.0), -4 * F.log10(F.greatest(F.col("p_text"), F.lit(1e-20))))).cast("int")
    rows = tests.withColumn("band", F.floor(F.log2("length")).cast("int")).withColumn("step", F.greatest(step, F.lit(0)))
    counts = rows.groupBy("band", "step").agg(F.count("*").alias("n"))
    smaller = Window.partitionBy("band").orderBy(F.desc("step"))
    every = Window.partitionBy("band")
    counts = counts.withColumn("upto", F.sum("n").over(smaller)).withColumn("m", F.sum("n").over(every))
    bound = F.pow(F.lit(10.0), -F.col("step") / 4.0)
    limits = counts.where(bound <= rate * F.col("upto") / F.col("m")).groupBy("band").agg(F.min("step").alias("least"))
    return rows.join(limits, "band").where((F.col("step") >= F.col("least")) & (F.col("p_random") >= LEAST_RANDOM)).select("token")


def document_secrets(documents: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for each document.

    Base spans are the patterns' matches of sufficient length, over the whole text (null:
    empty), in code points, ends exclusive. The battery adds spans of kind ``random``: long
    tokens that no base span overlaps and that `discovered` names; it judges each distinct
    token once, whatever the number of its copies. Spans are written kind:start:end, by
    start, then kind in the listed order. Repeated rows give repeated results; other columns
    are not read; an empty table gives an empty result.
    """
    text = whole_text("text")
    apart = "filter(tokens, c -> not exists(base, b -> b.start < c.end and c.start < b.end))"
    rows = documents.select("doc_id", base_spans(text).alias("base"), candidates(text).alias("tokens"))
    rows = settle(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "base", F.expr(apart).alias("tokens")))
    held = rows.select("row", F.explode("tokens").alias("t")).select("row", "t.start", "t.end", "t.token")
    found = discovered(settle(tested(held.select("token").distinct())))
    added = held.join(found, "token").groupBy("row").agg(
        F.collect_list(F.struct("start", F.lit(len(BASE)).alias("kind"), "end")).alias("more"))
    rows = rows.join(added, "row", "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    kinds = [k for k, *_ in BASE] + ["random"]
    name = lambda s: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in kinds]), s["kind"] + 1), s["start"], s["end"])
    joined = lambda spans: F.array_join(F.transform(spans, name), ",")
    number = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return rows.select(
        "doc_id", *[number(i).alias(f"n_{k}") for i, (k, *_) in enumerate(BASE)],
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", F.coalesce("more", none)))).alias("spans"))
