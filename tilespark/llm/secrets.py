"""Secret scanning with a battery of randomness tests, in Spark SQL expressions only.

Fixed patterns give the base spans.  The method adds long strings that could have come
from a random generator.  For each candidate an encoding is inferred from its characters
(hex, base32, base36, base64), which gives the alphabet; three tests of the hypothesis
"drawn at random from it" follow:

* chi-squared: are the characters as even as the alphabet asks; while a character is
  expected fewer than five times, they are counted in cells (vowels and consonants of
  either case, digits and signs);
* runs: does the string change between small and capital letters, digits and signs as
  often as it should;
* serial correlation: does a character say anything about the next.

Fisher's method combines the p-values into one that is even between 0 and 1 for random
strings and close to 0 for ordinary ones.  A reported string is a discovery, a false one
if it is ordinary, and the share of false ones is held down over the whole corpus,
separately in bands of length since the tests' power grows with it.  Ordinary strings
hardly reach the upper half of the p-values, so the number there tells how many random
ones there are at any p; what a band holds beyond that number above its threshold is
ordinary.  The threshold begins at ``LEAST_P``, which loses one random string in a
thousand, and rises until the ordinary share, less its error of estimation, is below the
rate.  Only counts in a table of fixed size (bands by steps of log p) reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespark.llm.common import fresh, settled

# The base patterns, their kinds in order, and the least length of each.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LENGTH = 12
KINDS = ("assign", "access", "hex", "random")

#: "=" only as padding at the end, so that the value of NAME=VALUE is tested by itself.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,6}"
#: Least entropy of a candidate in bits, if it is random.
LEAST_BITS = 80
#: Bands of length: below 32, 48, 80, and longer.
BANDS = (32, 48, 80)
#: Steps of p-values per factor of ten, and their number.
STEPS, MOST_STEPS = 20, 400
#: Random strings with a lower p-value are given up; the least of the upper half.
LEAST_P, UPPER_P = 1e-3, 10 ** (-6 / STEPS)


def _spans(text: Column, pattern: str, kind: int, group: int | None = None, least: int = 0, keep_text: bool = False) -> Column:
    """Start, rank of the kind and end (code points) of the pattern's matches, as an array.

    Java splits a text at exactly the matches that it extracts, so running sums over both
    lists give the places.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lists = [F.split(text, pattern, -1).alias("part"), hits.alias("hit")]
    if group:
        lists.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
    kinds = "start: int, rank: int, end: int" + (", hit: string" if keep_text else "")
    empty = F.expr(f"cast(array() as array<struct<{kinds}>>)")
    first = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(a, x):
        start = a["at"] + F.length(x["part"])
        end = start + F.length(x["hit"])
        fields = [start.alias("start"), F.lit(kind).alias("rank"), end.alias("end")] + ([x["hit"].alias("hit")] if keep_text else [])
        wanted = F.length(x["value"]) >= least if group else F.lit(True)
        out = F.when(wanted, F.concat(a["out"], F.array(F.struct(*fields)))).otherwise(a["out"])
        more = F.struct(end.alias("at"), out.alias("out"))
        return F.when(x["hit"].isNull(), a).otherwise(more)

    found = F.aggregate(F.arrays_zip(*lists), first, step, lambda a: a["out"])
    return F.when(text.rlike(pattern), found).otherwise(empty)


def _let(value: Column, f) -> Column:
    """``f`` of a value that is written, planned and computed once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _log_p(z: Column, two_sided: bool) -> Column:
    """Logarithm of the p-value of a normal z (Abramowitz and Stegun 26.2.17)."""

    def of(v: Column, t: Column) -> Column:
        poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        up = F.exp(-v * v / 2) * 0.3989422804014327 * poly
        p = 2 * up if two_sided else F.when(v >= 0, up).otherwise(1 - up)
        return F.log(F.greatest(F.lit(1e-300), F.least(F.lit(1.0), p)))

    return _let(z, lambda v: _let(1 / (1 + 0.2316419 * F.abs(v)), lambda t: of(v, t)))


_LOWER = "abcdefghijklmnopqrstuvwxyz"
_DIGITS = "0123456789"
#: Cells that characters are counted in, and their kinds.
_VOWELS, _CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"
CELLS = (_VOWELS, _CONSONANTS, _VOWELS.upper(), _CONSONANTS.upper(), _DIGITS + "+/")
_KINDS = (_DIGITS, _LOWER, _LOWER.upper(), "+/")
_ALPHABETS = (
    ("hex", r"[0-9a-f]*[0-9][0-9a-f]*", _DIGITS + "abcdef"),
    ("HEX", r"[0-9A-F]*[0-9][0-9A-F]*", _DIGITS + "ABCDEF"),
    ("base32", r"[A-Z2-7]*[2-7][A-Z2-7]*=*", _LOWER.upper() + "234567"),
    ("base36", r"[a-z0-9]*[0-9][a-z0-9]*", _DIGITS + _LOWER),
    ("BASE36", r"[A-Z0-9]*[0-9][A-Z0-9]*", _DIGITS + _LOWER.upper()),
    ("base64", r"[A-Za-z0-9+/_-]*=*", _LOWER.upper() + _LOWER + _DIGITS + "+/"),
)


def _alphabet(token: Column) -> Column:
    """The alphabet that a string seems to be written in; null if it is none of them (only
    digits, only letters of a case, separators in a word)."""
    digit, lower, upper = (token.rlike(x) for x in ("[0-9]", "[a-z]", "[A-Z]"))
    out = F.lit(None).cast("string")
    for name, pattern, alphabet in reversed(_ALPHABETS):
        fits = token.rlike(f"^{pattern}$") & digit & (lower & upper if name == "base64" else lower | upper)
        out = F.when(fits, F.lit(alphabet)).otherwise(out)
    return out


def _count(text: Column, chars: str) -> Column:
    """How many characters of a text are among ``chars``."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("double")


def _total(values: list[Column]) -> Column:
    out = values[0]
    for v in values[1:]:
        out = out + v
    return out


def p_value(token: Column) -> Column:
    """Combined p-value of "random in its inferred encoding"; null without an encoding or
    with fewer bits than ``LEAST_BITS`` (14 characters are too few in any alphabet)."""
    clean = F.translate(F.rtrim(F.translate(token, "=", " ")), "-_ ", "+/")

    def of(x):  # x: chars, alphabet, text
        chars, alphabet, text = x["chars"], x["alphabet"], x["text"]
        n, k = F.size(chars).cast("double"), F.length(alphabet).cast("double")
        squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s + F.pow(F.size(F.filter(chars, lambda y: y == c)).cast("double"), F.lit(2.0)))
        # cells: what is in the string, what is in the alphabet
        cells = [(_count(text, c), _count(alphabet, c)) for c in CELLS]
        merged = _total([F.when(size > 0, F.pow(o - n * size / k, F.lit(2.0)) * k / (n * size)).otherwise(0.0) for o, size in cells])
        df = F.when(n >= 5 * k, k).otherwise(_total([F.when(size > 0, 1.0).otherwise(0.0) for _, size in cells])) - 1
        chi = F.greatest(F.when(n >= 5 * k, squares * k / n - n).otherwise(merged), F.lit(1e-9))
        z1 = _let(F.struct(chi.alias("c"), df.alias("d")), lambda v: (F.pow(v["c"] / v["d"], F.lit(1 / 3)) - (1 - 2 / (9 * v["d"]))) / F.sqrt(2 / (9 * v["d"])))
        # places in the alphabet, from 0; sums over neighbours in one pass
        zero = F.lit(0.0)
        start = F.struct(F.lit(-1.0).alias("v"), F.lit(-1).alias("kind"), zero.alias("s"), zero.alias("q"), zero.alias("c"), zero.alias("runs"), zero.alias("first"))

        def step(a, y):
            v = F.instr(alphabet, y).cast("double") - 1
            kind = F.when(y.between("0", "9"), 0).when(y.between("a", "z"), 1).when(y.between("A", "Z"), 2).otherwise(3)
            begins = a["v"] < 0
            return F.struct(
                v.alias("v"),
                kind.alias("kind"),
                (a["s"] + v).alias("s"),
                (a["q"] + v * v).alias("q"),
                (a["c"] + F.when(begins, 0.0).otherwise(a["v"] * v)).alias("c"),
                (a["runs"] + F.when(a["kind"] != kind, 1.0).otherwise(0.0)).alias("runs"),
                F.when(begins, v).otherwise(a["first"]).alias("first"),
            )

        def correlation(a, m, var):
            # sum over neighbours of (v_i - m)(v_(i+1) - m)
            lag = a["c"] - m * (a["s"] - a["v"]) - m * (a["s"] - a["first"]) + (n - 1) * m * m
            return F.when(var <= 0, F.lit(30.0)).otherwise((lag / var + 1 / n) * F.sqrt(n))

        def runs(a, of_kind):  # as many kinds as there are, each so often
            two, three = (_total([F.pow(c, F.lit(e)) for c in of_kind]) for e in (2.0, 3.0))
            spread = (two * (two + n * (n + 1)) - 2 * n * three - n * n * n) / (n * n * (n - 1))
            return F.when(spread <= 1e-9, F.lit(30.0)).otherwise((a["runs"] - 1 - (n * n - two) / n) / F.sqrt(F.greatest(spread, F.lit(1e-9))))

        def finish(a):
            z3 = _let(a["s"] / n, lambda m: _let(a["q"] - n * m * m, lambda var: correlation(a, m, var)))
            z2 = _let(F.array(*(_count(text, c) for c in _KINDS)), lambda c: runs(a, [c[i] for i in range(len(_KINDS))]))
            half = -(_log_p(z1, False) + _log_p(z2, True) + _log_p(z3, True))
            fisher = _let(half, lambda h: F.exp(-h) * (1 + h + h * h / 2))  # chi-squared of 6 degrees
            return F.when(n * F.log2(k) >= LEAST_BITS, F.greatest(F.lit(1e-300), F.least(F.lit(1.0), fisher)))

        return F.aggregate(chars, start, step, finish)

    alphabet = _alphabet(token)
    packed = F.array(F.struct(F.filter(F.split(clean, ""), lambda c: c != "").alias("chars"), alphabet.alias("alphabet"), clean.alias("text")))
    # a list of one, so that what is computed once is not computed for each character
    return F.when(alphabet.isNotNull() & (F.length(clean) >= 14), F.element_at(F.transform(packed, of), 1))


def _band(length: Column) -> Column:
    out = F.lit(len(BANDS))
    for i in reversed(range(len(BANDS))):
        out = F.when(length < BANDS[i], F.lit(i)).otherwise(out)
    return out


def _step(p: Column) -> Column:
    return F.least(F.lit(MOST_STEPS), F.floor(-F.log10(p) * STEPS)).cast("int")


def _candidates(text: Column) -> Column:
    spans = _spans(text, CANDIDATE, len(KINDS) - 1, keep_text=True)
    return F.filter(spans, lambda x: x["hit"].rlike("[0-9]") & x["hit"].rlike("[A-Za-z]"))


def threshold(counts: list[int], rate: float) -> int:
    """The least step of -log10 p at which a string is taken for ordinary, from the number
    of strings in each step."""
    upper = round(-math.log10(UPPER_P) * STEPS)
    seen = sum(counts[:upper])
    for least in range(round(-math.log10(LEAST_P) * STEPS), upper, -1):
        share = (1 - 10 ** (-least / STEPS)) / (1 - UPPER_P)  # of random strings above, to those in the upper half
        ordinary = sum(counts[:least]) - seen * share
        if ordinary - 1.645 * share * math.sqrt(seen + 1) <= rate * sum(counts[:least]):
            return least
    return upper


def rejection_steps(df: DataFrame, text_col: str = "text", rate: float = 0.1) -> dict[int, int]:
    """Band -> least step of -log10 p at which a string is taken for ordinary."""
    found = df.select(_candidates(F.coalesce(df[text_col], F.lit(""))).alias("found")).select(F.explode("found").alias("x")).select(F.col("x.hit").alias("hit"))
    found = found.select("hit", p_value(F.col("hit")).alias("p")).where("p is not null")
    counts = found.groupBy(_band(F.length("hit")).alias("band"), _step(F.col("p")).alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()
    known = {(r.band, r.step): r.n for r in counts}
    return {band: threshold([known.get((band, k), 0) for k in range(MOST_STEPS + 1)], rate) for band in range(len(BANDS) + 1)}


def find_secrets(df: DataFrame, text_col: str = "text", *, rate: float = 0.1, out_col: str = "spans") -> DataFrame:
    """``df`` with an array of spans (start, rank, end, kind), by start and then kind.

    Starts and ends count code points, ends are exclusive.  Spans of the base patterns
    are all there; one of kind ``random`` is there only where it overlaps none of them.
    Null and empty texts have no spans.  The columns of ``df`` are left as they are; one
    that is called ``out_col`` is replaced.
    """
    steps = rejection_steps(df, text_col, rate)
    limits = F.create_map(*(F.lit(x) for kv in steps.items() for x in kv))
    text = F.coalesce(df[text_col], F.lit(""))
    base = F.array_sort(F.concat(_spans(text, ASSIGN, 0, 1, ASSIGN_LENGTH), _spans(text, ACCESS, 1), _spans(text, HEX, 2)))
    first, found = fresh([*df.columns, out_col], "base", "found")
    out = df.withColumn(first, base).withColumn(found, settled(_candidates(text)))

    def unexplained(x):
        clear = ~F.exists(first, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
        p = p_value(x["hit"])
        return clear & F.coalesce(_step(p) < F.element_at(limits, _band(F.length(x["hit"]))), F.lit(False))

    added = F.transform(F.filter(found, unexplained), lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end")))
    names = F.array(*map(F.lit, KINDS))
    spans = F.transform(
        F.array_sort(F.concat(F.col(first), F.when(F.size(found) > 0, added).otherwise(F.expr("cast(array() as array<struct<start:int,rank:int,end:int>>)")))),
        lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), F.element_at(names, x["rank"] + 1).alias("kind")),
    )
    return out.withColumn(out_col, settled(spans)).drop(first, found)


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(df: DataFrame, text_col: str = "text", *, rate: float = 0.1, mask: str = "[REDACTED]") -> DataFrame:
    """``df`` with every span of its text replaced; overlapping spans by one mask.  A null
    text stays null, an empty one empty, all other columns as they are.  Repeated rows
    give repeated results; an empty table stays empty."""
    (spans,) = fresh(df.columns, "spans")
    found = find_secrets(df, text_col, rate=rate, out_col=spans)
    text = F.col(text_col)
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a, x):
        gap = F.substring(text, a["at"] + 1, x["start"] - a["at"])
        apart = F.concat(a["out"], gap, F.lit(mask))
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.when((x["start"] >= a["at"]), apart).otherwise(a["out"]).alias("out"))

    def finish(a):
        return F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text)))

    clean = F.when(F.size(spans) > 0, F.aggregate(spans, first, step, finish)).otherwise(text)
    return found.withColumn(text_col, clean).drop(spans)
