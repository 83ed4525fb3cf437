"""Secret scans: fixed patterns, and character Markov models beside them.

Base kinds are regular expressions; a match is kept if it is long enough. The method
adds tokens of secret-like characters whose log-likelihood ratio between a Markov
model of random strings and one of ordinary identifiers is high. Both models are
bigram tables learned from labelled samples by counting transitions in Spark SQL.

Everything is a column expression: positions come from the lengths of what
``split`` leaves between the matches of the same pattern.

Null text is an empty text, and ``redact`` keeps it null. Offsets are code points, ends
exclusive. Rows are independent: repeated ones have equal results, a null doc_id is kept,
and an empty table gives no rows. Spans of equal start come in the order of kinds; a
Markov span that overlaps a base span is dropped. The cost of a very long text grows with
its length. ``scan`` keeps all columns in a struct, so no name can clash.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds in their order, patterns, and the group whose length counts (fixed values).
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE = [("assign", ASSIGN, 2, 8), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 32)]
#: What must occur in a text for a kind to be looked for at all: a necessary condition.
HINT = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{12}", "hex": "[0-9a-f]{32}"}
#: Characters of tokens that the Markov models judge (fixed values).
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
ALPHABET = 67
#: Weight of the single character against the counts of a transition.
BACKOFF = 20
MARKOV = 3
#: More than any start.
NO_START = 1 << 30
#: Values that a fold appends one by one before it goes on with a new list.
FOLD = 256
KINDS = "array('assign', 'access', 'hex', 'markov')"
SPAN = "struct<start:int,kind:int,end:int>"


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, combine) -> Column:
    """Inclusive prefix combinations of an array of ints, begun at 0. The fold appends to
    lists of ``FOLD`` values, so its cost grows with the array, not with its square."""
    ints = lambda: F.array().cast("array<int>")
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(values) - 1, F.lit(0)) / FOLD).cast("int")), lambda k: F.slice(values, k * FOLD + 1, FOLD))

    def append(st: Column, x: Column) -> Column:
        return bound(combine(st["last"], x), lambda v: F.struct(v.alias("last"), F.concat(st["out"], F.array(v)).alias("out")))

    def block(st: Column, xs: Column) -> Column:
        inner = F.aggregate(xs, F.struct(st["last"].alias("last"), ints().alias("out")), append)
        return bound(inner, lambda i: F.struct(i["last"].alias("last"), F.concat(st["out"], F.array(i["out"])).alias("out")))

    return F.flatten(F.aggregate(blocks, F.struct(F.lit(0).alias("last"), F.array().cast("array<array<int>>").alias("out")), block)["out"])


def matches(text: Column, pattern: str, kind: int, group: int, least: int, keep=None) -> Column:
    """Spans of all leftmost non-overlapping matches whose ``group`` has ``least``
    characters (and that ``keep`` accepts)."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.split(text, pattern, -1)
    rows = F.arrays_zip(
        F.transform(gaps, F.char_length).alias("gap"),
        F.transform(whole, F.char_length).alias("len"),
        F.transform(judged, lambda x: (F.char_length(x) >= least) & (keep(x) if keep else F.lit(True))).alias("ok"),
    )

    def spans(rows: Column) -> Column:
        ends = running(F.transform(rows, lambda r: r["gap"] + r["len"]), lambda s, x: s + x)
        placed = F.zip_with(rows, ends, lambda r, e: F.when(r["ok"], F.struct((e - r["len"]).alias("start"), F.lit(kind).alias("kind"), e.alias("end"))))
        return F.filter(placed, lambda x: x.isNotNull()).cast(f"array<{SPAN}>")

    return bound(F.filter(rows, lambda r: r["len"].isNotNull()), spans)


def apart(spans: Column) -> Column:
    """The spans without those of the last kind that overlap another kind's. In the order
    of starts, one overlaps a span before it that ends later than it starts (the running
    greatest end tells), or one after it that starts before it ends (the least start)."""
    other = lambda x, end, value: F.when(x["kind"] < MARKOV, value).otherwise(end)

    def kept(spans: Column) -> Column:
        latest = running(F.transform(spans, lambda x: other(x, F.lit(0), x["end"])), F.greatest)
        # From the back, with starts as negative numbers: 0 is none.
        soonest = F.reverse(running(F.transform(F.reverse(spans), lambda x: other(x, F.lit(0), x["start"] - NO_START)), lambda s, x: F.least(s, x)))
        rows = F.arrays_zip(spans.alias("x"), latest.alias("latest"), soonest.alias("soonest"))
        free = F.filter(rows, lambda r: (r["x"]["kind"] < MARKOV) | ((r["latest"] <= r["x"]["start"]) & (r["soonest"] + NO_START >= r["x"]["end"])))
        return F.transform(free, lambda r: r["x"])

    return bound(F.array_sort(spans), kept)


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def base_spans(text: Column) -> dict[str, Column]:
    return {name: F.when(text.rlike(HINT[name]), matches(text, pattern, k, group, least)).otherwise(no_spans()) for k, (name, pattern, group, least) in enumerate(BASE)}


def samples(docs: DataFrame, max_docs: int = 2000, n_random: int = 2000) -> DataFrame:
    """Labelled tokens: (token, random). Random ones are digests written in base 64,
    base 62 and base 16; ordinary ones are the words of about ``max_docs`` documents
    that do not mix letters and digits."""
    spark = docs.sparkSession
    n = docs.count()
    digest = F.sha2(F.col("id").cast("string"), 256)
    code = F.base64(F.unhex(digest))
    random = spark.range(n_random).select(F.explode(F.array(code, F.regexp_replace(code, "[+/=]", ""), digest)).alias("token"), F.lit(True).alias("random"))
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(min(1.0, max_docs / max(1, n)) * (1 << 20))))
    words = some.select(F.explode(F.regexp_extract_all(F.col("text"), F.lit("[A-Za-z0-9+/_=-]{3,}"), F.lit(0))).alias("token"))
    plain = words.where(~(F.col("token").rlike("[0-9]") & F.col("token").rlike("[A-Za-z]"))).select("token", F.lit(False).alias("random"))
    return random.unionByName(plain)


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratio (random over ordinary) of every transition between two
    ASCII characters, at 128 * first + second. A transition's probability is backed off
    to its second character's, and that one has add-one smoothing over the alphabet."""
    pairs = labelled.select("random", F.explode(F.expr("transform(sequence(1, greatest(1, char_length(token) - 1)), i -> struct(ascii(substring(token, i, 1)) as a, ascii(substring(token, i + 1, 1)) as b))")).alias("p"))
    rows = pairs.where("p.a between 1 and 127 and p.b between 1 and 127").groupBy("random", "p.a", "p.b").agg(F.count(F.lit(1)).alias("n")).collect()  # 2 * 128 ** 2 rows at most
    n = {(r["random"], r["a"], r["b"]): r["n"] for r in rows}
    first: dict[tuple[bool, int], int] = {}
    second: dict[tuple[bool, int], int] = {}
    total = {True: 0, False: 0}
    for (label, a, b), k in n.items():
        first[label, a] = first.get((label, a), 0) + k
        second[label, b] = second.get((label, b), 0) + k
        total[label] += k

    def log(label: bool, a: int, b: int) -> float:
        alone = (second.get((label, b), 0) + 1) / (total[label] + ALPHABET)
        return math.log((n.get((label, a, b), 0) + BACKOFF * alone) / (first.get((label, a), 0) + BACKOFF))

    return [log(True, a, b) - log(False, a, b) for a in range(128) for b in range(128)]


def llr(token: Column, table: Column) -> Column:
    """Mean log-likelihood ratio of a token's transitions."""
    codes = F.transform(F.split(token, ""), F.ascii)
    steps = F.zip_with(F.slice(codes, 1, F.char_length(token) - 1), F.slice(codes, 2, F.char_length(token) - 1), lambda a, b: F.get(table, a * 128 + b))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))) / (F.char_length(token) - 1)


def model_column(model: list[float]) -> Column:
    """The table as a constant; Catalyst folds it once. 128 ** 2 numbers."""
    return F.from_json(F.lit(json.dumps([round(x, 6) for x in model])), "array<double>")


def all_spans(text: Column, model: list[float], threshold: float) -> tuple[dict[str, Column], Column]:
    """Base spans by kind, and the Markov spans before those that overlap are removed."""
    table = model_column(model)
    markov = F.when(text.rlike(TOKEN), matches(text, TOKEN, MARKOV, 0, 20, lambda x: llr(x, table) > threshold)).otherwise(no_spans())
    return base_spans(text), markov


def scan(docs: DataFrame, model: list[float], threshold: float = 0.5) -> DataFrame:
    """doc (struct of the input's columns), n_assign, n_access, n_hex, base (array of
    spans), spans (array of spans with the model's), both by start, then kind."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    kinds, markov = all_spans(text, model, threshold)
    found = packed.select("doc", *[v.alias(k) for k, v in kinds.items()], markov.alias("markov"))
    base = F.array_sort(F.concat("assign", "access", "hex"))
    return (
        found.select("doc", *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")], base.alias("base"), "markov")
        .withColumn("spans", apart(F.concat("base", "markov")))
        .drop("markov")
    )


def listed(spans: str) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', {KINDS}[x.kind], x.start, x.end)), ',')")


def redact(text: Column, spans: str, mask: str = "[SECRET]") -> Column:
    """The text with every span (overlapping ones united) replaced by the mask. It is cut
    as UTF-32, where a code point's place is known without counting."""

    def cut(wide: Column) -> Column:
        ends = running(F.transform(F.col(spans), lambda x: x["end"]), F.greatest)
        part = lambda start, end: F.decode(F.substring(wide, start * 4 + 1, (end - start) * 4), "UTF-32")
        before = F.concat(F.array(F.lit(0)), ends)
        pieces = F.zip_with(F.col(spans), F.slice(before, 1, F.size(spans)), lambda x, at: F.when(x["start"] >= at, F.concat(part(at, x["start"]), F.lit(mask))).otherwise(F.lit("")))
        last = F.element_at(ends, -1)
        return F.concat(F.array_join(pieces, ""), part(last, F.floor(F.octet_length(wide) / 4).cast("int")))

    return F.when(F.size(spans) > 0, bound(F.encode(text, "UTF-32"), cut)).otherwise(text)
