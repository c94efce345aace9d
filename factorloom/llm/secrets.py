"""Secret scanning by fixed forms and a battery of randomness tests.

Base spans have fixed forms (assignments, access keys, long hex).  Beside them, every
maximal run of 20 or more key characters outside assignments is a candidate, its encoding
is inferred, and three tests hold its symbols against independent even draws from that
alphabet:

* chi-squared uniformity of the alphabet, its variance corrected for the token's length;
* Wald-Wolfowitz runs above and below the middle of the alphabet; a token wholly on one
  side has the probability of that;
* serial correlation of neighbours.

Fisher's method joins the three p-values.  Then, within each stratum of encoding and length
(powers of two), two rules at rate ``RATE`` choose what is reported as random:

* the Benjamini-Hochberg procedure decides which candidates are not random, so among those
  cleared as words at most that share is expected to be truly random;
* of the others, those with the least p-values go until the estimated share of words among
  the reported is at most that rate: truly random tokens have even p-values, so twice those
  above one half estimate their number, to two standard errors.

Candidates too short for the tests to have power (``LEAST``: letters or digits only) are
counted as untested.  A candidate that is a base span itself isn't reported again.

Everything is DataFrame expressions; no Python runs on the executors.

Defined results
* null texts are empty; texts without spans give an empty list and the digest of the
  empty string; repeated rows stay repeated rows and equal texts give equal spans;
* an empty table gives no rows; extra columns are never read;
* places count code points, ends are exclusive, texts are scanned whole.

Scale: one pass over the texts without a shuffle; its spans and candidates are written
to the shared checkpoint folder.  The procedure needs only counts of candidates by
stratum and p-value bin, and one threshold for each stratum (at most 352) returns to the
driver.  Prefix sums of long match lists work in blocks, so a text of many matches costs
little more than its length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, documents

#: The base forms.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the same spans as one or more of them, then at least 20 in all
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: Candidates that are base spans as they stand.
_IS_BASE = r"^(?:[0-9a-f]{24,}|AKIA[A-Z0-9]{16,})$"
KINDS = ("assign", "access", "hex", "random")

RATE = 0.05
#: p-values are binned by a fiftieth of a power of ten, down to 1e-20.
BINS_PER_TEN, LAST_BIN = 50, 1000

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encoding: pattern of the whole token, alphabet, least length at which the tests have power.
ENCODINGS = (
    ("decimal", "[0-9]+", _DIGITS, 40),
    ("hex", "[0-9a-f]+", _DIGITS + "abcdef", 20),
    ("upper hex", "[0-9A-F]+", _DIGITS + "ABCDEF", 20),
    ("lower letters", "[a-z]+", _LOWER, 48),
    ("letters", "[A-Za-z]+", _UPPER + _LOWER, 48),
    ("base 32", "[A-Z2-7]+", _UPPER + "234567", 20),
    ("base 36", "[a-z0-9]+", _DIGITS + _LOWER, 20),
    ("letters and digits", "[A-Za-z0-9]+", _UPPER + _LOWER + _DIGITS, 20),
    ("base 64", "[A-Za-z0-9+/]+", _UPPER + _LOWER + _DIGITS + "+/", 20),
    ("base 64 for addresses", "[A-Za-z0-9_-]+", _UPPER + _LOWER + _DIGITS + "-_", 20),
    ("other", ".*", _UPPER + _LOWER + _DIGITS + "+/-_", 20),
)
_SPAN = "array<struct<start:int,rank:int,end:int>>"
_SCORED = "array<struct<start:int,end:int,stratum:int,bin:int>>"
_BLOCK = 128


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def prefix_sums(values: Column) -> Column:
    """For each element of an array of ints, the sum of those before it."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    blocks = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int"))
    sums = F.transform(blocks, lambda b: total(F.slice(values, b * _BLOCK + 1, _BLOCK)))
    inner = lambda b, part, base: F.transform(part, lambda x, i: base + total(F.slice(part, F.lit(1), i)))
    return _let(
        sums,
        lambda s: F.flatten(
            F.transform(blocks, lambda b: _let(F.slice(values, b * _BLOCK + 1, _BLOCK), lambda part: _let(total(F.slice(s, F.lit(1), b)), lambda base: inner(b, part, base))))
        ),
    )


def found(text: Column, pattern: str) -> Column:
    """start and token of the leftmost non-overlapping matches of an ASCII pattern, in code points."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    sizes = F.zip_with(matches, F.slice(pieces, F.lit(1), F.size(matches)), lambda m, p: F.struct(F.char_length(p).alias("gap"), F.char_length(m).alias("width"), m.alias("token")))
    return _let(
        sizes,
        lambda s: F.when(F.size(s) == 0, F.array().cast("array<struct<start:int,token:string>>")).otherwise(
            F.zip_with(prefix_sums(F.transform(s, lambda x: x["gap"] + x["width"])), s, lambda before, x: F.struct((before + x["gap"]).alias("start"), x["token"].alias("token")))
        ),
    )


def _spans(text: Column, pattern: str, rank: int, possible: Column, good=None) -> Column:
    tokens = found(text, pattern)
    if good is not None:
        tokens = F.filter(tokens, good)
    spans = F.transform(tokens, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), (x["start"] + F.char_length(x["token"])).alias("end")))
    return F.when(possible, spans).otherwise(F.array().cast(_SPAN))


#: The published Chebyshev coefficients of erfc, relative error 1.2e-7.
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(x: Column) -> Column:
    """The complementary error function, its relative error small in both tails."""

    def positive(z: Column) -> Column:
        t = 1 / (1 + z / 2)
        total = F.lit(0.0)
        for c in reversed(_ERFC):
            total = total * t + c
        return t * F.exp(-z * z + total)

    return _let(positive(F.abs(x)), lambda y: F.when(x < 0, 2 - y).otherwise(y))


def normal_tail(z: Column) -> Column:
    return erfc(z / math.sqrt(2)) / 2


def chi_squared_tail(x: Column, degrees: Column) -> Column:
    """P(chi-squared > x) for whole degrees of freedom, by the finite sums of its closed form."""

    def tail(s: Column) -> Column:
        y, odd = s["y"], s["odd"]
        first = F.exp(-y) * F.when(odd, 2 * F.sqrt(y / math.pi)).otherwise(y)
        steps = F.when(odd, (s["degrees"] - 1) / 2).otherwise(s["degrees"] / 2 - 1).cast("int")
        shift = F.when(odd, 0.5).otherwise(1.0)
        start = F.struct(first.alias("term"), F.lit(0.0).alias("total"))
        add = lambda a, j: F.struct((a["term"] * y / (j + shift)).alias("term"), (a["total"] + a["term"]).alias("total"))
        terms = F.when(steps > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), start, add, lambda a: a["total"])).otherwise(0.0)
        return F.when(odd, erfc(F.sqrt(y))).otherwise(F.exp(-y)) + terms

    return _let(F.struct((F.greatest(x, F.lit(0.0)) / 2).alias("y"), (degrees % 2 == 1).alias("odd"), degrees.alias("degrees")), tail)


def randomness(token: Column, alphabet: Column, k: Column) -> Column:
    """The joint p-value that a token's symbols are independent even draws from its alphabet of k (even) symbols."""
    at_least = lambda p: F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-300))

    def tests(x: Column) -> Column:
        symbols, n = x["symbols"], F.size(x["symbols"]).cast("double")
        k = x["k"].cast("double")
        counts = F.transform(F.split(x["alphabet"], ""), lambda c: F.char_length(x["token"]) - F.char_length(F.replace(x["token"], c, F.lit(""))))
        chi = k / n * F.aggregate(counts, F.lit(0.0), lambda a, c: a + c.cast("double") * c) - n
        # an even multinomial's statistic has mean k - 1 and variance 2 (k - 1) (n - 1) / n
        uneven = at_least(chi_squared_tail((chi - (k - 1)) * F.sqrt(n / (n - 1)) + (k - 1), x["k"] - 1))
        high = F.aggregate(symbols, F.lit(0.0), lambda a, s: a + F.when(2 * s >= k, 1.0).otherwise(0.0))
        low = n - high
        rest, start = F.slice(symbols, F.lit(2), F.size(symbols)), F.slice(symbols, F.lit(1), F.size(symbols) - 1)
        turns = F.aggregate(F.zip_with(start, rest, lambda a, b: F.when((2 * a >= k) != (2 * b >= k), 1.0).otherwise(0.0)), F.lit(1.0), lambda a, t: a + t)
        mean = 2 * high * low / n + 1
        spread = F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9)))
        runs = at_least(F.when((high == 0) | (low == 0), F.pow(F.lit(0.5), n - 1)).otherwise(2 * normal_tail(F.abs(turns - mean) / spread)))
        middle, variance = (k - 1) / 2, (k * k - 1) / 12
        product = F.aggregate(F.zip_with(start, rest, lambda a, b: (a - middle) * (b - middle)), F.lit(0.0), lambda a, p: a + p)
        serial = at_least(2 * normal_tail(F.abs(product) / (variance * F.sqrt(n - 1))))
        half = -(F.log(uneven) + F.log(runs) + F.log(serial))
        return F.exp(-half) * (1 + half + half * half / 2)

    symbols = F.transform(F.split(token, ""), lambda c: F.call_function("instr", alphabet, c).cast("double") - 1)
    return _let(F.struct(token.alias("token"), symbols.alias("symbols"), alphabet.alias("alphabet"), k.alias("k")), tests)


def _pick(token: Column, value) -> Column:
    """A value of the first encoding that the whole token belongs to."""
    out = None
    for number, encoding in reversed(list(enumerate(ENCODINGS))):
        here = F.lit(value(number, encoding))
        out = here if out is None else F.when(F.regexp_like(token, F.lit(f"^(?:{encoding[1]})$")), here).otherwise(out)
    return out


def scored_candidates(text: Column) -> Column:
    """start, end, stratum and p-value bin of each candidate that is no base span; the bin is -1 where the tests lack power."""

    def score(x: Column) -> Column:
        token, n = x["token"], F.char_length(x["token"])
        joint = randomness(token, x["alphabet"], F.char_length(x["alphabet"]))
        size = F.least(F.floor(F.log2(n.cast("double"))), F.lit(31)).cast("int")
        return F.struct(
            x["start"].alias("start"),
            (x["start"] + n).alias("end"),
            (x["encoding"] * 32 + size).alias("stratum"),
            F.when(n < x["least"], -1).otherwise(F.least(F.greatest(F.floor(-F.log10(F.greatest(joint, F.lit(1e-300))) * BINS_PER_TEN), F.lit(0)), F.lit(LAST_BIN))).cast("int").alias("bin"),
        )

    # Assignments match first, so that their values are no candidates.
    own = F.filter(found(text, f"{ASSIGN}|{CANDIDATE}"), lambda x: ~F.rlike(x["token"], F.lit("[=:]")) & ~F.rlike(x["token"], F.lit(_IS_BASE)))
    typed = F.transform(
        own,
        lambda x: F.struct(
            x["start"].alias("start"),
            x["token"].alias("token"),
            _pick(x["token"], lambda number, e: number).alias("encoding"),
            _pick(x["token"], lambda number, e: e[2]).alias("alphabet"),
            _pick(x["token"], lambda number, e: e[3]).alias("least"),
        ),
    )
    return F.transform(typed, score)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base (sorted spans) and scored candidates of each row's text."""
    text = F.col("text")
    marked = docs.select(
        "doc_id",
        "text",
        (F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))).alias("has_assign"),
        F.contains(text, F.lit("AKIA")).alias("has_access"),
        F.regexp_like(text, F.lit("[A-Za-z0-9+/_-]{20}")).alias("has_run"),
    )
    long_value = lambda x: F.char_length(F.regexp_extract(x["token"], ASSIGN, 1)) >= 6
    spans = F.concat(
        _spans(text, ASSIGN, 0, F.col("has_assign"), long_value),
        _spans(text, ACCESS, 1, F.col("has_access")),
        _spans(text, HEX, 2, F.col("has_run")),
    )
    return marked.select(
        "doc_id",
        F.array_sort(spans).alias("base"),
        F.when(F.col("has_run"), scored_candidates(text)).otherwise(F.array().cast(_SCORED)).alias("candidates"),
    )


def clearing_bins(scanned: DataFrame, rate: float = RATE) -> DataFrame:
    """stratum, bin: candidates of a stratum in this bin or a later one aren't reported.

    The Benjamini-Hochberg procedure on binned p-values gives the first bin whose largest
    p-value is at most rate * (candidates in it or later) / (candidates of the stratum).
    Of the bins before it, the last remains up to which the estimated share of words is at
    most the rate.
    """
    tested = scanned.select(F.explode("candidates").alias("c")).where("c.bin >= 0")
    counts = tested.groupBy("c.stratum", "c.bin").agg(F.count(F.lit(1)).alias("n"))
    later = Window.partitionBy("stratum").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("stratum").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("stratum")
    half = math.ceil(math.log10(2) * BINS_PER_TEN)  # bins below it hold p-values above a half
    share = 1 - 10.0 ** (-half / BINS_PER_TEN)
    ranked = counts.select(
        "stratum",
        "bin",
        F.sum("n").over(later).alias("at_least"),
        F.sum("n").over(whole).alias("all"),
        F.sum("n").over(before).alias("reported"),
        F.coalesce(F.sum(F.when(F.col("bin") < half, F.col("n"))).over(whole), F.lit(0)).alias("even"),
    )
    largest, least = F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_TEN), F.pow(F.lit(10.0), -(F.col("bin") + 1) / BINS_PER_TEN)
    random = (F.col("even") + 2 * F.sqrt(F.col("even") + 1)) / share
    cleared = F.min(F.when(largest <= rate * F.col("at_least") / F.col("all"), F.col("bin")))
    pure = F.max(F.when(1 - random * (1 - least) / F.col("reported") <= rate, F.col("bin") + 1))
    return ranked.groupBy("stratum").agg(F.least(F.coalesce(cleared, F.lit(LAST_BIN + 1)), F.coalesce(pure, F.lit(0))).alias("bin"))


def secret_spans(docs: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans, arrays of (start, rank, end) in order whose rank names one of ``KINDS``, and n_untested."""
    scanned = checkpointed(scan(documents(docs, id_col, text_col)))
    # At most 11 encodings by 32 lengths.
    bins = {r["stratum"]: r["bin"] for r in clearing_bins(scanned, rate).collect()}
    first = F.create_map(*[F.lit(x) for pair in sorted(bins.items()) for x in pair]) if bins else F.create_map().cast("map<int,int>")
    random = F.transform(
        F.filter("candidates", lambda c: (c["bin"] >= 0) & (c["bin"] < F.coalesce(F.try_element_at(first, c["stratum"]), F.lit(0)))),
        lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("rank"), c["end"].alias("end")),
    )
    untested = F.size(F.filter("candidates", lambda c: c["bin"] < 0)).cast("long")
    return scanned.select("doc_id", "base", F.array_sort(F.concat("base", random)).alias("spans"), untested.alias("n_untested"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kind = lambda x: F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["rank"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind(x), x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_digests(docs: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digest of each document's base spans, and all its spans written out."""
    rows = secret_spans(docs, rate, id_col, text_col)
    count = lambda rank: F.size(F.filter("base", lambda x: x["rank"] == rank)).cast("long")
    return rows.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: x["rank"] == 3)).cast("long").alias("n_random"),
        "n_untested",
    )
