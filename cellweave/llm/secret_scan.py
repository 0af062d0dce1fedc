"""Secret scans in DataFrame operations only: fixed patterns, and a battery of randomness tests.

The battery looks at long tokens that no pattern covers. It infers a token's encoding, maps its characters to
numbers, and tests them against uniform independent draws: chi-squared of the alphabet's counts, runs above and
below the middle, and serial correlation. Text is not random, keys are. The combined p-values go through
Benjamini-Hochberg control within each band of lengths, over the whole corpus: tokens that it calls non-random
are text, the others are secrets. So what RATE bounds is the share of random tokens among those called text, that
is, of secrets missed; text of short length that passes all three tests, such as long CamelCase names, is called
a secret at no set rate. Tokens of fewer than LEAST characters, where the tests have no power, are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The base patterns, in their order at equal starts.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
ASSIGN_LEAST = 6
#: Tokens of the battery: characters and least length; the lengths at which bands begin.
TOKEN, LEAST = r"[A-Za-z0-9+/_=-]{20,}", 20
BANDS = (20, 24, 32, 48, 64, 128, 512)
#: False-discovery rate within a band, and steps of the p-value histogram in nats.
RATE, STEP, DEEPEST = 0.05, 0.125, 40.0
#: Alphabets by encoding. The first whose characters cover a token is its encoding.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
MASK = "[SECRET]"
SPAN = "array<struct<kind:string,start:int,end:int,text:string>>"


#: Items that a walk over a long array takes at a time: what it has given so far is copied once a block, not once an item.
BLOCK = 256


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then of a value that is computed once, not again for each item or character that a formula goes over."""
    return F.transform(F.array(value), then)[0]


def in_blocks(items: Column, start: Column, block: Callable[[Column, Column], Column], size: int = BLOCK) -> Column:
    """The state after all blocks of items: block gives the next one from a state and some items."""

    def steps(xs: Column) -> Column:
        numbers = F.sequence(F.lit(1), F.size(xs), F.lit(size))
        return F.when(F.size(xs) > 0, F.aggregate(numbers, start, lambda acc, i: block(acc, F.slice(xs, i, F.lit(size))))).otherwise(start)

    return let(items, steps)


def walk(items: Column, start: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """What step gives for each item, in order: an array of kind. step makes the next state and an output of a state and an item."""
    none, nothing = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def one(acc: Column, x: Column) -> Column:
        state, out = step(acc["s"], x)
        return F.struct(state.alias("s"), F.concat(acc["out"], F.array(out)).alias("out"))

    def block(acc: Column, xs: Column) -> Column:
        done = F.aggregate(xs, F.struct(acc["s"].alias("s"), none.alias("out")), one)
        return let(done, lambda d: F.struct(d["s"].alias("s"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    return F.flatten(in_blocks(items, F.struct(start.alias("s"), nothing.alias("out")), block)["out"])


def pattern_spans(text: Column, kind: str, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (kind, start, end, text) in code points.

    split() gives the pieces between the matches, so that lengths place each match."""
    none = F.array().cast(SPAN)
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = let(found, lambda hits: F.arrays_zip(F.slice(pieces, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit")))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["gap"])
        end = start + F.length(x["hit"])
        return end, F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["hit"].alias("text"))

    return F.when(text.rlike(pattern), walk(gaps, F.lit(0), SPAN[6:-1], step)).otherwise(none)


def base_spans(text: Column) -> Column:
    """The spans of the fixed patterns, by start, then kind as listed."""
    assign = F.filter(pattern_spans(text, "assign", ASSIGN), lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 2)) >= ASSIGN_LEAST)
    return in_order(F.concat(assign, *(pattern_spans(text, k, p) for k, p in BASE.items() if k != "assign")))


def in_order(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, [*BASE, "random"]))
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("nth"), s["end"].alias("end"), s["kind"].alias("kind"), s["text"].alias("text")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")))


def log_p(token: Column) -> Column:
    """Natural logarithm of the battery's p-value under uniform independent characters; padding doesn't count."""

    def encoded(body: Column) -> Column:
        pick = F.coalesce(*(F.when(body.rlike(f"^[{a.replace('-', '')}{'-' if '-' in a else ''}]+$"), F.lit(a)) for a in ALPHABETS.values()), F.lit(ALPHABETS["base64"]))
        return F.struct(body.alias("body"), pick.alias("pick"), F.split(body, "").alias("chars"))

    def numbered(e: Column) -> Column:
        x = F.transform(e["chars"], lambda c: F.position(c, e["pick"]).cast("double"))
        n = F.greatest(F.length(e["body"]), F.lit(2)).cast("double")
        return F.struct(e["body"].alias("body"), F.array_distinct(e["chars"]).alias("kinds"), x.alias("x"), n.alias("n"), F.length(e["pick"]).cast("double").alias("k"))

    def tested(e: Column) -> Column:
        n, k, x = e["n"], e["k"], e["x"]
        squares = F.aggregate(e["kinds"], F.lit(0.0), lambda acc, c: acc + F.pow(n - F.length(F.replace(e["body"], c, F.lit(""))), F.lit(2.0)))
        chi, df = squares * k / n - n, k - 1
        z_chi = F.greatest((F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)), F.lit(0.0))
        steps = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        middle = (k + 1) / 2
        start = F.struct(F.lit(0.0).alias("changes"), F.lit(0.0).alias("serial"))

        def step(acc: Column, s: Column) -> Column:
            changed = F.when((s["a"] > middle) != (s["b"] > middle), 1.0).otherwise(0.0)
            return F.struct((acc["changes"] + changed).alias("changes"), (acc["serial"] + (s["a"] - middle) * (s["b"] - middle)).alias("serial"))

        sums = F.aggregate(steps, start, step)
        return let(F.struct(z_chi.alias("z"), sums.alias("s"), n.alias("n"), k.alias("k")), combined)

    def combined(t: Column) -> Column:
        z_runs = (t["s"]["changes"] - (t["n"] - 1) / 2) / F.sqrt((t["n"] - 1) / 4)
        z_serial = t["s"]["serial"] / (F.sqrt(t["n"] - 1) * (t["k"] * t["k"] - 1) / 12)
        total = t["z"] * t["z"] + z_runs * z_runs + z_serial * z_serial
        # the upper tail of chi-squared with four degrees: more than three have, so cautious
        return let(total, lambda x: -x / 2 + F.log1p(x / 2))

    return let(let(let(F.regexp_replace(token, "=+$", ""), encoded), numbered), tested)


def untouched(tokens: Column, base: Column) -> Column:
    """The tokens that no base span overlaps: one walk over both by start. A token waits for what comes next, and must begin behind the end
    of all before it."""
    first, item = "struct<start:int,end:int,text:string>", "start:int,token:int,end:int,text:string"

    def row(s: Column, token: int) -> Column:
        return F.struct(s["start"].alias("start"), F.lit(token).alias("token"), s["end"].alias("end"), F.when(F.lit(token == 1), s["text"]).alias("text")).cast(f"struct<{item}>")

    last = F.array(F.struct(F.lit(2**31 - 1), F.lit(1), F.lit(2**31 - 1), F.lit(None).cast("string")).cast(f"struct<{item}>"))
    both = F.concat(F.array_sort(F.concat(F.transform(base, lambda s: row(s, 0)), F.transform(tokens, lambda s: row(s, 1)))), last)
    none = F.lit(None).cast(first)

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        stays = F.when(x["start"] >= state["waits"]["end"], state["waits"])
        reach = F.when(x["token"] == 0, F.greatest(state["reach"], x["end"])).otherwise(state["reach"])
        waits = F.when((x["token"] == 1) & (x["start"] >= state["reach"]), F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text")))
        return F.struct(reach.alias("reach"), waits.alias("waits")), stays

    return F.filter(walk(both, F.struct(F.lit(0).alias("reach"), none.alias("waits")), first, step), lambda s: s.isNotNull())


def candidates(text: Column, base: Column) -> Column:
    """Tokens of the battery that no base span touches, with their p-values."""
    free = untouched(pattern_spans(text, "random", TOKEN), base)
    return F.transform(free, lambda s: F.struct(F.lit("random").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), log_p(s["text"]).alias("p"), band(s["text"]).alias("band")))


def band(token: Column) -> Column:
    return sum((F.when(F.length(token) >= b, 1).otherwise(0) for b in BANDS), F.lit(0))


def thresholds(docs: DataFrame, text: str = "text") -> dict[int, float]:
    """For each band of lengths, the largest logarithm of a p-value that is called non-random; no band: none is.

    p-values are counted in steps, so that only len(BANDS) rows of a bounded table reach the driver."""
    t = F.coalesce(F.col(text), F.lit(""))
    some = docs.select(t.alias("t")).where(F.col("t").rlike(TOKEN))
    each = some.select(F.explode(candidates(F.col("t"), base_spans(F.col("t")))).alias("c")).select("c.band", "c.p")
    # the upper end of a step stands for its p-values: cautious by at most STEP
    step = F.floor(F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(-DEEPEST)) / STEP).cast("int") + 1
    counted = each.groupBy("band", step.alias("step")).agg(F.count("*").alias("n"))
    rising = W.partitionBy("band").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    ranked = counted.select("band", "step", F.sum("n").over(rising).alias("below"), F.sum("n").over(W.partitionBy("band")).alias("all"))
    called = ranked.where(F.col("step") * STEP <= F.log(F.lit(RATE) * F.col("below") / F.col("all")))
    return {r["band"]: r["top"] * STEP for r in called.groupBy("band").agg(F.max("step").alias("top")).collect()}


def all_spans(text: Column, base: Column, limits: dict[int, float]) -> Column:
    """Base spans with the tokens that stay random, in order."""
    pairs, never = [F.lit(v) for b, t in limits.items() for v in (b, t)], F.lit(float("-inf"))

    def stays(s: Column) -> Column:
        return s["p"] > (F.coalesce(F.element_at(F.create_map(*pairs), s["band"]), never) if pairs else never)

    more = F.when(text.rlike(TOKEN), F.transform(F.filter(candidates(text, base), stays), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"))))
    return in_order(F.concat(base, F.coalesce(more, F.array().cast(SPAN))))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans) of each whole text.

    Null text is empty; an empty text has no spans and the digest of the empty string. Rows repeat as they are,
    null keys pass, other columns are ignored, an empty table gives no rows. Equal texts have equal results
    within a run; the battery's limits depend on the whole table."""
    limits = thresholds(docs, text)
    t = docs.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    t = t.withColumn("_b", base_spans(F.col("_t"))).withColumn("_a", all_spans(F.col("_t"), F.col("_b"), limits))

    def count(kind: str) -> Column:
        return F.size(F.filter("_b", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in BASE]
    return t.select(key, *counts, F.sha2(written(F.col("_b")), 256).alias("base_sha256"), written(F.col("_a")).alias("spans"))


def redact_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of the text replaced by MASK; spans that touch or overlap become one mask. Null stays null."""
    limits = thresholds(docs, text)
    t = F.col(text)
    names = iter(f"_spans{i}" for i in range(len(docs.columns) + 2))
    b, n = (next(x for x in names if x not in docs.columns) for _ in range(2))
    out = docs.withColumn(b, base_spans(F.coalesce(t, F.lit(""))))
    out = out.withColumn(n, all_spans(F.coalesce(t, F.lit("")), F.col(b), limits))
    return out.withColumn(text, F.when((F.size(n) > 0) & t.isNotNull(), masked(t, F.col(n))).otherwise(t)).drop(b, n)


def masked(text: Column, spans: Column) -> Column:
    """Text with each span (by start) replaced by MASK; one that begins inside another adds none.

    A block of spans is cut from the rest of the text as one piece, within which its spans are placed."""
    start = F.struct(F.lit(0).alias("at"), text.alias("rest"), F.array().cast("array<string>").alias("out"))

    def block(acc: Column, some: Column) -> Column:
        length = F.greatest(F.array_max(F.transform(some, lambda s: s["end"])) - acc["at"], F.lit(0))
        piece = F.substring(acc["rest"], F.lit(1), length)

        def inside(p: Column) -> Column:
            begin = F.struct(acc["at"].alias("at"), F.lit("").alias("out"))

            def step(a: Column, s: Column) -> Column:
                kept = F.substring(p, a["at"] - acc["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
                return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], kept, F.lit(MASK))).alias("out"))

            done = F.aggregate(some, begin, step)
            return let(done, lambda d: F.struct(d["at"].alias("at"), F.substring(acc["rest"], length + 1, F.length(acc["rest"])).alias("rest"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

        return let(piece, inside)

    return let(in_blocks(spans, start, block, 64), lambda d: F.concat(F.array_join(d["out"], ""), d["rest"]))
