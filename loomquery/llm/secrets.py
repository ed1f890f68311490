"""Secret scans: patterns, and a battery of randomness tests, in DataFrame functions only.

Besides three patterns, every token of LEAST or more letters, digits and signs
of base64 is tested. Its encoding is inferred: the smallest of a few alphabets
that holds its symbols. Within that alphabet it takes three tests of
randomness: chi-squared uniformity, runs about the middle, and serial
correlation, whose combined statistic has a p-value. The hypothesis to reject
is that the token is text: letters, capitals or digits in the main, drawn with
text's frequencies. Its e-value is the likelihood of uniform draws from the
alphabet over the largest likelihood under these, divided by the number of
alphabets that could have been inferred, times the battery's p-value. Under
text it is 1 at most on average, as the alphabets' likelihoods add up to one
and the p-value isn't beyond 1; under randomness it grows with length, so
short tokens need more evidence a symbol. Over all tokens of the corpus,
e-values are held to a false discovery rate by the e-Benjamini-Hochberg rule,
whatever the tokens' dependence.
"""

from __future__ import annotations

from functools import reduce
from math import log2, pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomquery.llm._store import Store

# The patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The whole run after AKIA, or nothing: the same as a run of any length of which short ones are dropped.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
KINDS = ["assign", "access", "hex", "random"]
#: A match of ASSIGN holds one of these, in either case.
NAMES = ["password", "passwd", "secret", "token", "apikey", "api_key"]

#: Symbols from which on the tests' distributions hold.
LEAST = 16
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST

# The per-mille letter frequencies of text, a to z, over western
# European languages, and the coefficients of the normal tail's approximation
# (Abramowitz and Stegun, 26.2.17).
LETTERS = dict(zip("abcdefghijklmnopqrstuvwxyz", [78, 14, 29, 44, 150, 14, 17, 30, 75, 3, 5, 45, 26, 80, 60, 25, 5, 68, 72, 75, 38, 14, 12, 4, 9, 8], strict=True))
TAIL = [0.2316419, 0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]

_LOWER, _DIGITS, _SIGNS = "".join(LETTERS), "0123456789", "+/-_"
_UPPER = _LOWER.upper()
#: Parts of small letters, capitals, digits and signs in text that is mainly one of the first three.
TEXTS = [(0.88, 0.06, 0.04, 0.02), (0.06, 0.88, 0.04, 0.02), (0.06, 0.04, 0.88, 0.02)]
#: The encodings, smallest first.
ALPHABETS = [_DIGITS, _DIGITS + "abcdef", _DIGITS + "ABCDEF", _LOWER, _UPPER, _UPPER + "234567", _LOWER + _DIGITS, _UPPER + _DIGITS, _UPPER + _LOWER, _UPPER + _LOWER + _DIGITS, _UPPER + _LOWER + _DIGITS + _SIGNS]

RATE = 0.01
#: Whole bits of evidence that are told apart: a threshold is log2(tokens / RATE) at most.
MOST = 128
#: Steps that a running fold takes in one piece.
PIECE = 256

_FOUND = "array<struct<start:int,end:int,token:string,value:string>>"


def text_costs() -> list[list[float]]:
    """-log2 of each symbol's probability, by code, in each kind of text."""
    total = sum(LETTERS.values())
    out = []
    for lower, upper, digit, sign in TEXTS:
        own = {c: lower * f / total for c, f in LETTERS.items()} | {c.upper(): upper * f / total for c, f in LETTERS.items()}
        own |= dict.fromkeys(_DIGITS, digit / len(_DIGITS)) | dict.fromkeys(_SIGNS, sign / len(_SIGNS))
        out.append([-log2(own[chr(i)]) if chr(i) in own else 0.0 for i in range(128)])
    return out


def _let(value: Column, function):
    """function of a value that is computed once."""
    return F.transform(F.array(value), function)[0]


def running(values: Column, step, zero: Column) -> Column:
    """The fold of an array of integers up to each place, in pieces: no piece's fold copies another's."""
    empty = F.array().cast("array<int>")

    def fold(x, first):
        """(the last value, all values) of a fold over x."""
        def more(a, v):
            now = step(a["at"], v)
            return F.struct(now.alias("at"), F.concat(a["all"], F.array(now)).alias("all"))
        return F.aggregate(x, F.struct(first.alias("at"), empty.alias("all")), more)

    def cut(x):
        last = F.greatest(F.ceil(F.size(x) / PIECE).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(x, i * PIECE + 1, PIECE))

    def joined(pieces):
        ends = fold(F.transform(pieces, lambda x: F.aggregate(x, zero, step)), zero)["all"]
        paired = F.arrays_zip(pieces.alias("x"), F.concat(F.array(zero), ends).alias("first"))
        return F.flatten(F.transform(F.filter(paired, lambda p: p["x"].isNotNull()), lambda p: fold(p["x"], p["first"])["all"]))

    return _let(_let(values, cut), joined)


def matches(text: str, pattern: str, group: int = 0) -> Column:
    """(start, end, token, value) of each match of a pattern in a column, leftmost and not overlapping, in code points."""
    p = F.lit(pattern)
    zipped = F.arrays_zip(F.split(F.col(text), pattern, -1).alias("before"), F.regexp_extract_all(text, p, F.lit(0)).alias("token"), F.regexp_extract_all(text, p, F.lit(group)).alias("value"))

    def placed(found):
        ends = running(F.transform(found, lambda m: F.char_length(m["before"]) + F.char_length(m["token"])), lambda a, n: a + n, F.lit(0))
        return F.transform(F.arrays_zip(found.alias("m"), ends.alias("end")), lambda x: F.struct((x["end"] - F.char_length(x["m"]["token"])).alias("start"), x["end"].alias("end"), x["m"]["token"].alias("token"), x["m"]["value"].alias("value")))

    # what is left after the last match has no token
    return F.when(F.col(text).rlike(pattern), _let(F.filter(zipped, lambda m: m["token"].isNotNull()), placed)).otherwise(F.array().cast(_FOUND))


def _spans(kind: str, found: Column) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end")))


def alphabet(token: Column) -> Column:
    """The encoding inferred for a token: the first alphabet that holds all its symbols."""
    found = F.lit(ALPHABETS[-1])
    for letters in reversed(ALPHABETS[:-1]):
        found = F.when(token.rlike(f"^[{letters}]*$"), F.lit(letters)).otherwise(found)
    return found


def _symbols(token: Column) -> Column:
    return F.filter(F.split(token, ""), lambda c: c != "")


def battery(token: Column) -> Column:
    """The combined statistic of the three tests of a bare token, about chi-squared with 3 degrees of freedom under randomness."""
    return _let(F.struct(token.alias("t"), alphabet(token).alias("a")), _tests)


def _tests(s: Column) -> Column:
    symbols = _symbols(s["t"])
    x = F.transform(symbols, lambda c: F.call_function("locate", c, s["a"]).cast("double"))
    times = F.transform(F.array_distinct(symbols), lambda c: F.char_length(s["t"]) - F.char_length(F.replace(s["t"], c, F.lit(""))))
    squares = F.aggregate(times, F.lit(0.0), lambda a, v: a + v.cast("double") * v)
    return _let(F.struct(x.alias("x"), F.char_length(s["a"]).cast("double").alias("k"), squares.alias("squares")), _halves)


def _halves(s: Column) -> Column:
    """The values that later steps ask for at every symbol."""
    high = F.transform(s["x"], lambda v: v * 2 > s["k"] + 1)
    middle = F.aggregate(s["x"], F.lit(0.0), lambda a, v: a + v) / F.size(s["x"])
    return _let(F.struct(s["x"].alias("x"), s["k"].alias("k"), s["squares"].alias("squares"), high.alias("high"), middle.alias("middle")), _statistic)


def _statistic(s: Column) -> Column:
    x, k, high, middle = s["x"], s["k"], s["high"], s["middle"]
    n = F.size(x).cast("double")
    chi, df = s["squares"] * k / n - n, k - 1
    # the root of twice the exponent by which the chance of such a chi-squared falls
    z1 = F.when(chi > df, F.sqrt(F.greatest(chi - df - df * F.log(chi / df), F.lit(0.0)))).otherwise(F.lit(0.0))
    up = F.size(F.filter(high, lambda v: v)).cast("double")
    at = F.sequence(F.lit(1), F.size(x) - 1)
    runs = F.size(F.filter(at, lambda i: F.get(high, i) != F.get(high, i - 1))) + 1.0
    mean = up * (n - up) * 2 / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    z2 = F.when(spread > 0, (runs - mean) / F.sqrt(spread)).otherwise(F.lit(10.0))
    power = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - middle) * (v - middle))
    lagged = F.aggregate(at, F.lit(0.0), lambda a, i: a + (F.get(x, i) - middle) * (F.get(x, i - 1) - middle))
    z3 = F.when(power > 0, lagged / power * F.sqrt(n)).otherwise(F.lit(10.0))
    return F.aggregate(F.array(z1, z2, z3), F.lit(0.0), lambda a, z: a + z * z)


def log_p(q: Column) -> Column:
    """log2 of the upper tail of chi-squared with 3 degrees of freedom, 0 at most."""
    def tail(x):
        t = F.lit(1.0) / (x * TAIL[0] + 1)
        near = F.lit(0.0)
        for c in reversed(TAIL[1:]):
            near = (near + c) * t
        return F.least(F.lit(0.0), (F.log(near + x) - x * x / 2) / F.log(F.lit(2.0)) + log2(2 / pi) / 2)

    return _let(F.sqrt(q), tail)


def log_ratio(token: Column) -> Column:
    """log2 of a bare token's likelihood under uniform draws from its encoding over that under text, by the number of encodings."""
    costs = F.array(*[F.array(*[F.lit(v) for v in one]) for one in text_costs()])
    codes = F.transform(_symbols(token), F.ascii)
    likeliest = _let(codes, lambda x: F.array_min(F.transform(costs, lambda one: F.aggregate(x, F.lit(0.0), lambda a, c: a + F.get(one, c)))))
    return likeliest - F.char_length(token) * F.log2(F.char_length(alphabet(token)).cast("double")) - log2(len(ALPHABETS))


def log_evidence(token: Column) -> Column:
    """log2 of a token's e-value against text. The battery is asked only where it could still be a discovery."""
    def both(t):
        return _let(log_ratio(t), lambda ratio: F.when(ratio >= log2(1 / RATE), ratio + log_p(battery(t))).otherwise(F.least(ratio, F.lit(0.0))))

    return _let(F.regexp_replace(token, "=+$", ""), both)


def scan(df: DataFrame, text: str, rate: float = RATE) -> DataFrame:
    """df with base (spans of the patterns), tokens (how many were tested) and likely (those apart from base whose e-value reaches 1 / rate: start, end, log2 e-value)."""
    low = F.lower(text)
    named = reduce(lambda a, b: a | b, [F.contains(low, F.lit(name)) for name in NAMES])
    assign = F.when(named, F.filter(matches(text, ASSIGN, 2), lambda m: F.char_length(m["value"]) >= 8)).otherwise(F.array().cast(_FOUND))
    base = F.concat(_spans("assign", assign), _spans("access", matches(text, ACCESS)), _spans("hex", matches(text, HEX)))
    tested = F.transform(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), log_evidence)
    df = df.withColumns({"base": F.array_sort(base), "__bits": tested})
    empty = F.array().cast("array<struct<start:int,end:int,bits:double>>")
    placed = F.transform(F.arrays_zip(matches(text, CANDIDATE).alias("m"), F.col("__bits").alias("bits")), lambda x: F.struct(x["m"]["start"].alias("start"), x["m"]["end"].alias("end"), x["bits"].alias("bits")))
    reach = log2(1 / rate)  # no threshold is less
    apart = F.filter(placed, lambda m: (m["bits"] >= reach) & ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    some = F.exists("__bits", lambda b: b >= reach)
    return df.withColumns({"tokens": F.size("__bits").cast("long"), "likely": F.when(some, apart).otherwise(empty)}).drop("__bits")


def threshold(scanned: DataFrame, rate: float = RATE) -> float:
    """The least log2 e-value that is a discovery: of a number of discoveries, each has tokens / (rate * number) at least. From a histogram of whole bits over all rows."""
    tokens = scanned.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    bits = scanned.select(F.explode("likely.bits").alias("b")).groupBy(F.least(F.floor("b"), F.lit(MOST)).alias("b")).count().collect()  # at most MOST rows
    seen, least = 0, float("inf")
    for b, n in sorted(((int(b), n) for b, n in bits), reverse=True):
        seen += n
        if b >= log2(tokens / (rate * seen)):
            least = float(b)
    return least


def _discovered(least: float) -> Column:
    passed = F.filter("likely", lambda m: m["bits"] >= least)
    return F.array_sort(F.concat("base", F.transform(passed, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), m["end"].alias("end")))))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """One row per row of df: the id, base and spans, arrays of (start, kind, end) in code points, the end exclusive.

    kind indexes KINDS. base holds the patterns' matches, spans also the
    tokens that the battery finds apart from them. A null text is empty;
    repeated rows each give a row and count each in the false discovery rate;
    other columns are ignored; an empty table gives an empty result.
    """
    store = Store(df.sparkSession, "secrets")
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scanned = store.cut(scan(rows, "text", rate).select("id", "base", "tokens", "likely"), "scanned")
    return scanned.select(F.col("id").alias(id_col), "base", _discovered(threshold(scanned, rate)).alias("spans"))


def redact(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[SECRET]", rate: float = RATE) -> DataFrame:
    """df with every found span of its texts replaced by a mark; texts without any stay as they are.

    All columns stay; where a text changes, length_col (where there is one)
    follows it. Null texts stay null; repeated rows each give a row; an empty
    table gives an empty result. Each text is scanned once: the rows are
    written with what was found in them.
    """
    store = Store(df.sparkSession, "secrets")
    names = df.columns
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scanned = store.cut(scan(row, "text", rate).drop("text"), "scanned")
    found = scanned.withColumns({"text": F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")), "spans": _discovered(threshold(scanned, rate))})
    # runs of spans that overlap or touch become one; what stands before each is kept
    reach = running(F.transform("spans", lambda s: s["end"]), lambda a, e: F.greatest(a, e), F.lit(0))
    found = found.withColumn("reach", reach)
    parts = F.transform("spans", lambda s, i: F.struct(F.coalesce(F.get("reach", i - 1), F.lit(0)).alias("at"), s["start"].alias("start")))
    parts = F.transform(F.filter(parts, lambda p: p["start"] >= p["at"]), lambda p: F.substring(F.col("text"), p["at"] + 1, p["start"] - p["at"]))
    rest = F.substring(F.col("text"), F.element_at("reach", -1) + 1, F.char_length("text"))
    some = F.size("spans") > 0
    found = found.withColumn("clean", F.when(some, F.array_join(F.concat(parts, F.array(rest)), mark)).otherwise(F.col(f"row.`{text_col}`")))
    out = []
    for c in names:
        value = F.col(f"row.`{c}`")
        if c == text_col:
            value = F.col("clean")
        elif c == length_col:
            value = F.when(some, F.char_length("clean")).otherwise(value).cast(df.schema[c].dataType)
        out.append(value.alias(c))
    return found.select(*out)


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, a checksum of the base spans, and all spans in writing."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select(id_col, count("assign"), count("access"), count("hex"), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
