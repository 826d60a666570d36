r"""Secret scans with DataFrame functions only: fixed patterns, and a randomness test battery for other tokens.

Patterns (kinds assign, access and hex) always count. In what their spans leave, maximal runs of 16 or more characters of
[A-Za-z0-9+/_-] are candidates. A candidate's encoding is inferred from its letters without separators - and _ (hex 16,
base32 32, lower 36, base62 62 and base64 64 symbols). Three tests look at it: chi-squared for uniform letters of that
alphabet (by the pairs of equal letters), the number of runs of one letter class, and the serial correlation of
neighbouring code points. The battery has one p-value of being word-like (letters as uneven as in prose, few changes of
class, no correlation by chance alone): that of the runs, divided by what the other two give as evidence, numbers whose
mean is at most 1 for such tokens. P-values, weighted by length (short tokens
prove less; weights have mean 1), pass the step-up procedure for the false-discovery rate over all candidates of the
data; its ranks come from counts in bins of log p, a table with a fixed number of rows. What passes must also look
uniform: letters, runs or correlation that are far from those of uniform letters (by size, not only surely) make a
sequence or another pattern.

Null text is empty: no spans. Each row gives one result, repeated rows too; an empty table gives an empty result; other
columns pass by. Texts are scanned whole. Spans are in code points, the end exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasonloom.llm.common import stored

#: Fixed by the contract: patterns by kind in order, the group that is measured, and its least length.
KINDS = ("assign", "access", "hex")
PATTERNS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
#: Where any of the kinds has a span, by the leftmost one.
ANY_BASE = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,}|AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}"""
CANDIDATE, LEAST = r"[A-Za-z0-9+/_-]{16,}", 16
#: Null of a word-like token: chance of two and of three equal letters in prose, and of a change of class between neighbours.
TEXT_PAIRS, TEXT_TRIPLES, TEXT_CHANGES = 0.065, 0.0055, 0.15
#: Of each encoding: symbols, and the chance of a change of class between neighbours of a uniform token.
SYMBOLS = {"hex": 16.0, "base32": 32.0, "lower": 36.0, "base62": 62.0, "base64": 64.0}
UNIFORM_CHANGES = {"hex": 0.469, "base32": 0.305, "lower": 0.401, "base62": 0.622, "base64": 0.65}
RATE, BIN_WIDTH, BINS = 0.01, 0.25, 400
#: Length with weight 1 before weights are scaled to mean 1, and the greatest weight.
LENGTH, MOST_WEIGHT = 40.0, 2.0
#: A uniform token whose battery p-value is below this is no random string either.
UNIFORM_P = 1e-5
#: Matches that are walked together.
CHUNK = 128


def bound(value: Column, body) -> Column:
    """body(value) with value worked out once, however often a lambda inside asks for it."""
    return F.transform(F.array(value), body)[0]


def chunked(items: Column, state: Column, chunk) -> Column:
    """state after chunk(state, part) for each part of CHUNK items in turn: long arrays are built from short ones, so that
    n items cost n * sqrt(n) steps at most for any n that fits a text, not n * n."""
    parts = lambda every: F.sequence(F.lit(0), F.greatest(F.ceil(F.size(every) / CHUNK) - 1, F.lit(0)).cast("int"))
    return bound(items, lambda every: F.aggregate(parts(every), state, lambda now, k: chunk(now, F.slice(every, k * CHUNK + 1, F.lit(CHUNK)))))


def found_spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, end, kind, token>> of a pattern's leftmost non-overlapping matches whose group is long enough."""
    between, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    none = F.expr("cast(array() as array<struct<start: int, end: int, kind: string, token: string>>)")
    steps = F.arrays_zip(F.slice(between, 1, F.size(matches)).alias("gap"), matches.alias("m"), groups.alias("g"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x["m"].alias("token"))
        return F.struct(end.alias("at"), F.when(F.length(x["g"]) >= least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    def chunk(state: Column, part: Column) -> Column:
        more = F.aggregate(part, F.struct(state["at"].alias("at"), none.alias("spans")), step)
        return bound(more, lambda m: F.struct(m["at"].alias("at"), F.concat(state["spans"], m["spans"]).alias("spans")))

    walked = chunked(steps, F.struct(F.lit(0).alias("at"), none.alias("spans")), chunk)["spans"]
    return F.when(F.regexp_like(text, F.lit(pattern)), walked).otherwise(none)


def without_base(text: Column) -> Column:
    """text with the patterns' spans (the leftmost chain of them) as blanks, so that places stay the same."""
    matches = F.regexp_extract_all(text, F.lit(ANY_BASE), F.lit(0))
    parts = F.zip_with(F.split(text, ANY_BASE, -1), matches, lambda gap, m: F.concat(gap, F.repeat(F.lit(" "), F.coalesce(F.length(m), F.lit(0)))))
    return F.when(F.regexp_like(text, F.lit(ANY_BASE)), F.array_join(parts, "")).otherwise(text)


def battery(tokens: DataFrame) -> DataFrame:
    """tokens (with a column token) with encoding, log_p (one p-value of the three tests, of being word-like), weight (of
    the token's length) and uniform_p."""
    t = F.col("token")
    # separators tell nothing of the alphabet: the rest does, and is what the tests look at
    bare = F.translate(t, "-_", "")
    only = lambda letters: F.regexp_like(bare, F.lit(f"^[{letters}]+$"))
    tokens = tokens.withColumn("encoding", F.when(only("0-9a-f") | only("0-9A-F"), "hex").when(only("A-Z2-7"), "base32").when(only("a-z0-9") | only("A-Z0-9"), "lower").when(only("A-Za-z0-9"), "base62").otherwise("base64"))
    of = lambda numbers: F.element_at(F.create_map(*[F.lit(x) for kv in numbers.items() for x in kv]), F.col("encoding"))
    k, change = of(SYMBOLS), of(UNIFORM_CHANGES)
    tokens = tokens.withColumn("bare", bare).withColumn("code", F.transform(F.split(F.col("bare"), ""), lambda c: F.ascii(c).cast("double")))
    # equal pairs, from each letter's count
    alphabet = [chr(x) for x in (*range(48, 58), *range(65, 91), *range(97, 123))] + ["+", "/"]
    pairs = F.aggregate(F.transform(F.array(*[F.lit(c) for c in alphabet]), lambda c: (F.length("bare") - F.length(F.replace(F.col("bare"), c, F.lit("")))).cast("double")), F.lit(0.0), lambda s, n: s + n * (n - 1))
    classes = F.translate(F.col("bare"), "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "a" * 26 + "A" * 26 + "0" * 10 + "--")
    changes = F.regexp_count(classes, F.lit(r"(?<=(.))(?!\1|$)")).cast("double")
    m = F.greatest(F.length("bare"), F.lit(2)).cast("double")
    mean = F.aggregate("code", F.lit(0.0), lambda s, x: s + x) / m
    tokens = tokens.withColumn("pairs", pairs).withColumn("changes", changes).withColumn("mean", mean)
    tokens = tokens.withColumn("spread", F.aggregate("code", F.lit(0.0), lambda s, x: s + (x - F.col("mean")) * (x - F.col("mean"))))
    rest = F.greatest(F.length("bare") - 1, F.lit(0))
    ahead = F.aggregate(F.zip_with(F.slice("code", F.lit(1), rest), F.slice("code", F.lit(2), rest), lambda a, b: (a - F.col("mean")) * (b - F.col("mean"))), F.lit(0.0), lambda s, x: s + x)
    tokens = tokens.withColumn("serial", F.coalesce(F.try_divide(ahead, F.col("spread")), F.lit(1.0)))
    serial = F.col("serial")
    # runs: the upper tail of changes among word-like tokens, at most Chernoff's bound times Stirling's factor and a geometric rest
    steps, c = m - 1, F.least(F.col("changes"), m - 1)
    part = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(F.lit(0.0))
    far = steps * (part(c / steps, F.lit(TEXT_CHANGES)) + part(1 - c / steps, F.lit(1 - TEXT_CHANGES)))
    sharper = F.when(c < steps, F.least(F.lit(0.0), 0.5 * F.log(steps / (2 * math.pi * c * (steps - c))) - F.log(1 - TEXT_CHANGES * (steps - c) / ((1 - TEXT_CHANGES) * (c + 1))))).otherwise(F.lit(0.0))
    runs = F.when(c > TEXT_CHANGES * steps, far - sharper).otherwise(F.lit(0.0))
    # the other two give evidence, a number whose mean is 1 at most if the token is word-like: a p-value divided by it is one
    # chi-squared is symbols / m * (pairs + m) - m, so that pairs decide; few of them are as rare in prose as Janson's bound says
    two = m * (m - 1) / 2
    around = two * TEXT_PAIRS + m * (m - 1) * (m - 2) * TEXT_TRIPLES
    tilt = F.greatest(two * TEXT_PAIRS - two / k, F.lit(0.0)) / around
    uniform = tilt * (two * TEXT_PAIRS - F.col("pairs") / 2) - tilt * tilt * around / 2
    uncorrelated = F.lit(0.5 * math.log(2)) - serial * serial * m / 2
    tokens = tokens.withColumn("log_p", F.least(F.lit(0.0), -(runs + uniform + uncorrelated)))
    tokens = tokens.withColumn("weight", F.least(F.lit(MOST_WEIGHT), F.length(t) / LENGTH))
    # a statistic counts against uniform letters if it is far off, not only surely off: long tokens are never quite uniform
    share = F.col("pairs") * k / (m * (m - 1))
    moved = F.col("changes") / (m - 1) - change
    uniform_pairs = F.when(~share.between(0.5, 2.0), F.abs(share - 1) * F.sqrt(m * (m - 1) / (2 * (k - 1))))
    uniform_runs = F.when(F.abs(moved) > 0.2, F.abs(moved) * F.sqrt((m - 1) / (change * (1 - change))))
    uniform_serial = F.when(F.abs(serial) > 0.3, F.abs(serial) * F.sqrt(m))
    worst = F.greatest(F.lit(0.0), uniform_pairs, uniform_runs, uniform_serial)
    return tokens.withColumn("uniform_p", F.least(F.lit(1.0), 6 * F.exp(log_tail(worst)))).drop("bare", "code", "pairs", "changes", "mean", "spread", "serial")


def log_tail(z: Column) -> Column:
    """The log of the normal upper tail for z >= 0, by density * 2 / (z + sqrt(z * z + 8 / pi)), within 1 per cent; below the mean the complement."""
    a = F.abs(z)
    upper = F.least(-a * a / 2 - F.lit(0.5 * math.log(2 * math.pi)) + F.log(2.0 / (a + F.sqrt(a * a + 8 / math.pi))), F.lit(math.log(0.5)))
    return F.when(z >= 0, upper).otherwise(F.log(1 - F.exp(upper)))


def discoveries(tested: DataFrame, rate: float = RATE) -> DataFrame:
    """tested with secret: whether the step-up procedure accepts the token at the rate over all tokens, with weights of mean 1."""
    evidence = -F.col("log_p") + F.log("weight")
    binned = tested.withColumn("bin", F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(evidence / BIN_WIDTH))).cast("int"))
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))
    down, every = Window.orderBy(F.desc("bin")), Window.partitionBy()
    ranks = counts.withColumn("rank", F.sum("n").over(down)).withColumn("all", F.sum("n").over(every)).withColumn("weights", F.sum("weight").over(every))
    # a bin's least evidence is at its lower edge; dividing by the mean weight makes the weights' mean 1
    edge = F.col("bin") * BIN_WIDTH - F.log(F.col("weights") / F.col("all"))
    passed = ranks.where((edge >= F.log(F.col("all") / F.col("rank")) - math.log(rate)) & (F.col("bin") > 0)).agg(F.min("bin").alias("least"))
    return binned.join(F.broadcast(passed)).withColumn("secret", F.coalesce(F.col("bin") >= F.col("least"), F.lit(False)) & (F.col("uniform_p") >= UNIFORM_P)).drop("bin", "least")  # one row


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """id_col and spans, array<struct<start, end, kind, token>>: patterns' spans and random tokens (kind random), by start.

    Texts are scanned once; only rows with a candidate go through the tests, and their spans come back by row number.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.concat(*[found_spans(text, kind, *PATTERNS[kind]) for kind in KINDS])
    rows = docs.select(F.col(id_col), base.alias("base"), without_base(text).alias("left"))
    rows = rows.select(id_col, "base", found_spans(F.col("left"), "random", CANDIDATE, 0, LEAST).alias("found"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "secret-spans")
    tokens = rows.where(F.size("found") > 0).select("row", F.explode("found").alias("span")).select("row", "span", F.col("span.token").alias("token"))
    kept = discoveries(stored(battery(tokens), "secret-tests"), rate).where("secret")
    more = kept.groupBy("row").agg(F.collect_list("span").alias("more"))
    order = lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(rank_of(a) - rank_of(b))
    # few rows have a candidate: only these are joined
    tested = rows.where(F.size("found") > 0).join(more, "row", "left").withColumn("base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more")))
    both = rows.where(F.size("found") <= 0).select(id_col, "base").unionByName(tested.select(id_col, "base"))
    return both.select(id_col, F.array_sort("base", order).alias("spans"))


def rank_of(span: Column) -> Column:
    """A kind's place among equal starts."""
    return F.array_position(F.array(*[F.lit(k) for k in (*KINDS, "random")]), span["kind"]).cast("int")


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with each secret in the text replaced by <kind>; null texts stay null. Overlapping spans count as one."""
    spans = scan(docs.select(F.struct(*docs.columns).alias("key"), F.col(text_col).alias("scanned")), "key", "scanned", **options)
    text = F.col(f"key.{text_col}")
    words = F.expr("cast(array() as array<string>)")

    def chunk(state: Column, part: Column) -> Column:
        begin = state["at"]
        region = F.substring(text, begin + 1, F.array_max(F.transform(part, lambda s: s["end"])) - begin)

        def step(now: Column, s: Column, here: Column) -> Column:
            piece = F.concat(F.substring(here, now["at"] - begin + 1, s["start"] - now["at"]), F.lit("<"), s["kind"], F.lit(">"))
            return F.struct(F.greatest(now["at"], s["end"]).alias("at"), F.when(s["start"] >= now["at"], F.concat(now["out"], F.array(piece))).otherwise(now["out"]).alias("out"))

        more = bound(region, lambda here: F.aggregate(part, F.struct(begin.alias("at"), words.alias("out")), lambda now, s: step(now, s, here)))
        return bound(more, lambda m: F.struct(m["at"].alias("at"), F.concat(state["out"], F.array(F.array_join(m["out"], ""))).alias("out")))

    walked = chunked(F.col("spans"), F.struct(F.lit(0).alias("at"), words.alias("out")), chunk)
    whole = bound(walked, lambda w: F.concat(F.array_join(w["out"], ""), F.substring(text, w["at"] + 1, F.length(text))))
    clean = F.when(F.size("spans") == 0, text).otherwise(whole)
    return spans.select(*[clean.alias(c) if c == text_col else F.col(f"key.{c}").alias(c) for c in docs.columns])


def digest(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
